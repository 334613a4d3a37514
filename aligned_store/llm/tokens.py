"""Token counts with a digest cache, and the encoders behind it.

:func:`token_counts` joins digests of normalised content and the tokenizer's version to a table of
stored counts; only distinct texts that the table lacks are encoded, and their counts are appended. Digests alone
are shuffled: of each that is missing one row's place is marked, and its text is encoded where it is stored
(:mod:`.places`), whether few are missing or all.

Encoding byte-level BPE files: the distinct stretches between white space of plain Latin text are encoded
once for each pack of texts and kept in a bounded table in each worker; any text with another
character, with crowded white space or with a special string goes to the library whole, so every result
is the library's.

Defined results: null text counts as empty and has no tokens. Repeated rows are counted each, and
encoded once. Ids may be of any type and null; they are only carried along. An empty table gives no rows and
leaves the cache as it is. Texts of any length are encoded whole, in packs of about a megabyte. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, held, lookup, map_batches, scratch
from .hashing import powers
from .places import in_place, marks, place, placed

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Characters whose classes all versions of Unicode agree on; the pattern is the usual one of byte-level BPE.
_PLAIN = re.compile(f"[\n -~‐-‧{_LETTERS}]*")
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_CUT = re.compile(rf"(?<=\S) (?=[{_LETTERS}])")
#: By byte: letters (with the bytes of Latin letters beyond ASCII), digits, white space, other; 9 for what keeps a word whole.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 1
_CLASS[48:58], _CLASS[[10, 32]], _CLASS[[39, 0xC0, 0xC1, 0xC2, *range(0xCA, 256)]] = 2, 3, 9
_PIECE, _KEPT, _LONGEST = 1 << 20, 120_000, 64


def _raw(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Table(dict):
    """Stretch of text -> its ids as bytes, or None where the library has to judge; in two generations of bounded size."""

    def __init__(self, piece: Callable[[bytes], list[int]]):
        self.piece, self.old = piece, {}

    def __missing__(self, stretch: bytes):
        value = self.old.get(stretch, self)
        if value is self:
            if (stretch[1:] if stretch[:1] == b" " else stretch).isalpha():  # an ASCII word is one pre-token
                value = _raw(self.piece(stretch))
            elif _PLAIN.fullmatch(text := stretch.decode()):
                value = _raw([i for p in _PRETOKEN.findall(text) for i in self.piece(p.encode())])
            else:
                value = None
        if len(stretch) <= _LONGEST:
            if len(self) >= _KEPT:
                self.old = dict(self)
                self.clear()
            self[stretch] = value
        return value


class Encoder:
    """Ids of whole texts by the file at ``path``: ``tokenizers`` for .json, ``sentencepiece`` for .model."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.plain = path, None
        if path.endswith(".model"):
            import sentencepiece

            self._model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self._model.no_truncation()
        self._model.no_padding()
        with open(path, encoding="utf-8") as f:
            self._plain(json.load(f))

    def _plain(self, spec: dict) -> None:
        """Set up the table of pre-tokens, if the file is byte-level BPE whose ids ascend in the order of its merges."""
        model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges") or []]
        if not merges or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return
        special = [t["content"] for t in spec.get("added_tokens") or []]
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        made = [vocab.get(a + b, -1) for a, b in merges]
        if min(made) < 0 or made != sorted(made) or len(vocab) != len(merges) + 256:
            return
        import tiktoken

        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items()}
        bpe = tiktoken.Encoding("plain", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.plain = _Table(bpe._core_bpe.encode_single_piece)

    def _library(self, text: str) -> np.ndarray:
        if self.path.endswith(".model"):
            return np.array(self._model.encode(text), "<u4")
        return np.array(self._model.encode(text, add_special_tokens=False).ids, "<u4")

    def _packs(self, texts: list[str]):
        """Pieces of texts, gathered to packs of about ``_PIECE`` bytes, with whose each is; longer texts are cut between words."""
        who, some, size = [], [], 0
        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                m = _CUT.search(text, at + _PIECE) if len(text) - at > _PIECE else None
                end = m.start() if m else len(text)
                raw = text[at:end].encode()
                if some and size + len(raw) > _PIECE:
                    yield who, some
                    who, some, size = [], [], 0
                who.append(i)
                some.append(raw)
                size += len(raw)
                at = end
        if some:
            yield who, some

    def batch(self, texts: list[str], ids: bool = True) -> list:
        """The ids of each text, or only how many.

        Where white space is single spaces and line ends, each of these begins a pre-token; there and where
        letters, digits and others meet a text falls into stretches, and each distinct stretch of a pack
        is looked up once.
        """
        if self.plain is None:
            return [x if ids else len(x) for x in map(self._library, texts)]
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        parts: list[list] = [[] for _ in texts]
        for who, some in self._packs(texts):
            raw = np.frombuffer(b"".join(some), np.uint8)
            begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))])
            white = (raw == 32) | (raw == 10)
            bad = (raw < 32) & (raw != 10) | (raw == 127)
            crowd = white[1:] & white[:-1]
            crowd[begin[1:-1] - 1] = False
            bad[1:] |= crowd
            at = white.copy()
            at[begin[:-1]] = True
            # further, a pre-token ends where the class of characters changes; words with an apostrophe or
            # characters other than ASCII and Latin letters aren't split
            kind = _CLASS[raw]
            glue = kind == 9
            glue[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
            word = np.cumsum(at) - 1
            glued = np.zeros(word[-1] + 1 if len(word) else 0, bool)
            glued[word[glue]] = True
            at[1:] |= (kind[1:] != kind[:-1]) & (raw[:-1] != 32) & ~glued[word[1:]]
            first = np.flatnonzero(at)
            up, down = powers(max(2 * _PIECE, len(raw)))
            with np.errstate(over="ignore"):
                total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
                name = (total[np.append(first[1:], len(raw))] - total[first]) * down[first]
            _, index, inverse = np.unique(name, return_index=True, return_inverse=True)
            long = np.diff(np.append(first, len(raw)))
            # equal names aren't proof: each stretch is compared with the one that stands for it
            same = long == long[index][inverse]
            shift = np.repeat(first[index][inverse] - first, long)
            there = np.minimum(np.arange(len(raw)) + shift, len(raw) - 1)
            same &= np.add.reduceat(raw[there] != raw, first, dtype=np.int64) == 0
            bad[first[~same]] = True
            ends, buffer = np.append(first[1:], len(raw))[index].tolist(), raw.tobytes()
            values = list(map(self.plain.__getitem__, [buffer[a:b] for a, b in zip(first[index].tolist(), ends, strict=True)]))
            unknown = np.fromiter((v is None for v in values), bool, len(values))
            bad[first[unknown[inverse]]] = True
            odd.update(np.array(who)[np.add.reduceat(bad, begin[:-1], dtype=np.int64) > 0].tolist())
            size = np.fromiter((len(v or b"") // 4 for v in values), np.int64, len(values))
            each = size[inverse]
            done = np.concatenate([[0], np.cumsum(each)])
            border = done[np.searchsorted(first, begin)]
            if ids:
                flat = np.frombuffer(b"".join([v or b"" for v in values]), "<u4")
                where = np.concatenate([[0], np.cumsum(size)[:-1]])[inverse] - done[:-1]
                found = flat[np.repeat(where, each) + np.arange(done[-1])]
            for k, i in enumerate(who):
                parts[i].append(found[border[k] : border[k + 1]] if ids else int(border[k + 1] - border[k]))
        out = []
        for i, text in enumerate(texts):
            if i in odd:
                whole = self._library(text)
                out.append(whole if ids else len(whole))
            elif ids:
                out.append(parts[i][0] if len(parts[i]) == 1 else np.concatenate([np.zeros(0, "<u4"), *parts[i]]))
            else:
                out.append(sum(parts[i]))
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]

    def count(self, text: str) -> int:
        return self.batch([text], ids=False)[0]


def encoder(path: str) -> Encoder:
    """The encoder for a file, one in each process as long as its tasks ask for it."""
    return held(f"encoder {path}", lambda: Encoder(path))


def version(path: str) -> str:
    """Digest of the tokenizer file and the library that reads it."""
    import sentencepiece
    import tokenizers

    name = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(name.encode() + hashlib.file_digest(f, "sha256").digest()).hexdigest()


COUNTS = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
#: The cache is a Parquet table with a folder for each version, so another version's counts aren't read.
CACHE = T.StructType([*COUNTS.fields, T.StructField("version", T.StringType())])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, cache_path: str | None = None, normalise: Callable = lambda text: text) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document; the cache at ``cache_path`` grows by what it lacked.

    Without ``cache_path`` a new cache is made in the shared folder. ``normalise`` maps the text column
    to the content that is digested and encoded; the default keeps it as it is.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch(spark, "token-cache")
    stamp = version(path)
    whole = placed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "texts")
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    file, row = place(whole)
    keyed = cut(whole.select("doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"), digest, file.alias("file"), row.alias("row")), "digests")
    jvm, hadoop = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    there = jvm.org.apache.hadoop.fs.Path(cache_path)
    first = keyed.groupBy("digest").agg(F.min(F.struct("file", "row")).alias("at"))
    if there.getFileSystem(hadoop).exists(there):
        # both sides are dealt by digest already; merged, so that the planner sends neither to all tasks
        first = first.join(_stored(spark, cache_path, stamp).select("digest").hint("merge"), "digest", "left_anti")
    misses = marks(first.select("at.file", "at.row"))

    def make():
        own = encoder(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(1), pa.array(own.batch(batch.column(0).to_pylist(), ids=False), pa.int64())], names=["digest", "n_tokens"])

        return step

    # texts are encoded where they stand: one row of each digest that the cache lacks is marked
    for part in in_place(whole, misses, keep=True):
        encoded = map_batches(part.select(text.alias("text"), digest), make, COUNTS)
        encoded.withColumn("version", F.lit(stamp)).write.mode("append").partitionBy("version").parquet(cache_path)
    counts = lookup(keyed.drop("file", "row"), _stored(spark, cache_path, stamp), ["digest"], "inner")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark: SparkSession, cache_path: str, stamp: str) -> DataFrame:
    """The counts that the cache has for a tokenizer's version, one row for each digest.

    Two writers, or one that was run again, may have stored a digest twice; their counts are equal.
    """
    of = spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == stamp)
    return of.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
