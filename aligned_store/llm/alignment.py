"""Alignment of two tokenizers' tokens over the bytes of each text, and corpus-wide counts of linked ids.

Tokens of either side that share a byte are joined by an edge. The connected components of this bipartite graph,
found by union-find, are exactly the smallest groups that both tokenizers end together. Within a group every token of
one side is linked to every token of the other. A pair of ids counts once for each document that holds it linked.

Work is dealt in chunks of documents with a bounded number of distinct pairs. A chunk keeps its distinct pairs with
numbers of documents, and for each document the places of its pairs among them. Pairs are summed over chunks; each
chunk then looks up its own pairs, once each, so a pair that all documents hold is one row of a chunk, not of each
document.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no
tokens: zeros, and an empty digest. Repeated rows count as documents each. Ids may be of any type and null; they are
only carried along. An empty table gives no rows. A text of any length is aligned whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import begin_task, bounded, cut, give_back, held, lean_batches
from .tokens import Encoder

#: A pair of ids as one number: the first shifted by so many bits, and the second.
SHIFT = 20
#: A chunk ends with the document that brings it to so many pairs, each document's counted apart.
CHUNK_PAIRS = 1 << 19
#: Larger groups are expanded by their distinct ids.
WIDE = 1 << 10


class Side:
    """One tokenizer: the ids of texts, special strings being plain text, and the bytes of each id."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        model = self.encoder._model
        if path.endswith(".model"):
            self.lead = ""  # the model itself puts a space before a text
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.bytes = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        else:
            self.lead = " "
            model.encode_special_tokens = True
            if self.encoder.plain is not None:
                self.encoder.special = []
            of = {c: bytes([b]) for b, c in enumerate(byte_characters())}
            names = [model.id_to_token(i) or "" for i in range(model.get_vocab_size(with_added_tokens=True))]
            self.bytes = [b"".join(of.get(c, c.encode()) for c in n) for n in names]
        if len(self.bytes) > 1 << SHIFT:
            raise ValueError(f"{path} has more than {1 << SHIFT} ids")
        self.long = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; none where their bytes are not a space and the text."""
        out = []
        for text, ids in zip(texts, self.encoder.batch([self.lead + t if t else "" for t in texts]), strict=True):
            exact = b"".join(map(self.bytes.__getitem__, ids.tolist())) == b" " + text.encode()
            out.append(ids.astype(np.int64) if exact else None)
        return out


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over nodes 0 to n - 1 with edges (u, v): the smallest node of each one's component.

    In each round the larger root of every edge that still joins two is hooked to the least root beside it, and
    paths are halved until all point to roots.
    """
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


class Aligned:
    """Tokens and groups of several texts, one after the other.

    a, b: ids; group_a, group_b: the group of each token, ascending; size_a, size_b: tokens of each group; doc: the
    text of each group; docs: how many texts.
    """

    def __init__(self, texts: list[str], first: Side, second: Side):
        none = np.zeros(0, np.int64)
        both = [(x, y) if x is not None and y is not None else (none, none) for x, y in zip(first.encode(texts), second.encode(texts), strict=True)]
        self.docs = len(texts)
        self.count_a, self.count_b = (np.array([len(p[k]) for p in both], np.int64) for k in (0, 1))
        self.a, self.b = (np.concatenate([none, *[p[k] for p in both]]) for k in (0, 1))
        # both sides spell the same bytes, so offsets may run on from text to text
        ends_a, ends_b = np.cumsum(first.long[self.a]), np.cumsum(second.long[self.b])
        n = len(self.a)
        total = int(ends_a[-1]) if n else 0
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[ends_a], is_b[ends_b] = True, True
        begins = np.flatnonzero(is_a | is_b)
        begins = np.concatenate([np.zeros(min(n, 1), np.int64), begins[begins < total]])
        # stretches without an end inside: each is an edge of the two tokens that hold it
        over_a, over_b = np.cumsum(is_a)[begins], np.cumsum(is_b)[begins]
        root = components(n + len(self.b), over_a, over_b + n)
        # the smallest node of a component is its first token of the first side
        number = np.cumsum(root[:n] == np.arange(n)) - 1
        self.group_a, self.group_b = number, number[root[n:]] if n else none
        groups = int(number[-1]) + 1 if n else 0
        self.size_a, self.size_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        self.start_a, self.start_b = np.cumsum(self.size_a) - self.size_a, np.cumsum(self.size_b) - self.size_b
        self.doc = np.repeat(np.arange(self.docs), self.count_a)[self.start_a]

    def per_doc(self, weights: np.ndarray) -> np.ndarray:
        """Sums of whole numbers of the groups, by text."""
        done = np.concatenate([[0], np.cumsum(weights)])
        border = np.searchsorted(self.doc, np.arange(self.docs + 1))
        return np.diff(done[border])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links) of the distinct linked pairs of each text, ascending."""
        links = self.size_a * self.size_b
        usual = np.flatnonzero(links <= WIDE)
        many = links[usual]
        group = np.repeat(usual, many)
        k = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
        width = self.size_b[group]
        pair = self.a[self.start_a[group] + k // width] << SHIFT | self.b[self.start_b[group] + k % width]
        doc, times = [self.doc[group]], [np.ones(len(group), np.int64)]
        pair = [pair]
        for g in np.flatnonzero(links > WIDE).tolist():
            (x, nx), (y, ny) = (np.unique(ids[s : s + m], return_counts=True) for ids, s, m in ((self.a, self.start_a[g], self.size_a[g]), (self.b, self.start_b[g], self.size_b[g])))
            pair.append((x[:, None] << SHIFT | y).ravel())
            times.append(np.outer(nx, ny).ravel())
            doc.append(np.full(len(pair[-1]), self.doc[g]))
        doc, pair, times = map(np.concatenate, (doc, pair, times))
        order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        return doc[at], pair[at], np.add.reduceat(times, at) if len(at) else times

    def spelled(self, words: list[bytes], vocabulary: int) -> list[bytes]:
        """The groups of each text as ``a1,a2|b1;a3|b2``. ``words``: ids with each of the four marks behind, as :func:`marked` has them."""
        last_a, last_b = np.ones(len(self.a), bool), np.ones(len(self.b), bool)
        last_a[:-1], last_b[:-1] = self.group_a[1:] != self.group_a[:-1], self.group_b[1:] != self.group_b[:-1]
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + self.start_b[self.group_a]] = self.a + vocabulary * last_a
        out[np.arange(len(self.b)) + (self.start_a + self.size_a)[self.group_b]] = self.b + vocabulary * (2 * last_b)
        parts = list(map(words.__getitem__, out.tolist()))
        ends = np.concatenate([[0], np.cumsum(self.count_a + self.count_b)]).tolist()
        return [b"".join(parts[x:y])[:-1] for x, y in zip(ends, ends[1:], strict=False)]

    def groups(self) -> list[list[dict]]:
        """The groups of each text as lists of ids."""
        out: list[list[dict]] = [[] for _ in range(self.docs)]
        for g, d in enumerate(self.doc.tolist()):
            out[d].append({"a": self.a[self.start_a[g] : self.start_a[g] + self.size_a[g]].tolist(), "b": self.b[self.start_b[g] : self.start_b[g] + self.size_b[g]].tolist()})
        return out


def marked(vocabulary: int) -> list[bytes]:
    """Each id followed by a comma, by a bar and by a semicolon, one list after the other."""
    return [b"%d%s" % (i, m) for m in (b",", b"|", b";") for i in range(vocabulary)]


def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    return tuple(held(f"side {p}", lambda p=p: Side(p)) for p in (path_a, path_b))


def aligned_groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): the ids of each group of a text, in order."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType([base.schema["doc_id"], T.StructField("groups", T.ArrayType(T.StructType([T.StructField("a", ids), T.StructField("b", ids)])))])
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = begin_task(lambda: sides(path_a, path_b))
        for batch in batches:
            for part in bounded(batch, 1 << 20):
                found = Aligned(part.column(1).to_pylist(), *own).groups()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "groups"])
        give_back()

    lean_batches(docs.sparkSession)
    return base.mapInArrow(run, schema)


_LONG, _BYTES = T.LongType(), T.BinaryType()
_DOC = [("n_a", _LONG), ("n_b", _LONG), ("n_groups", _LONG), ("n_links", _LONG), ("groups_sha256", T.StringType())]


def _chunks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, chunk_pairs: int) -> DataFrame:
    """A row for each document: the columns of ``_DOC``, the places of its pairs in its chunk and their links; and one for each chunk: its pairs, and in how many of its documents each is."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    longs = T.ArrayType(_LONG)
    schema = T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), *[T.StructField(n, t) for n, t in (("chunk", _LONG), *_DOC, ("places", _BYTES), ("links", _BYTES), ("pairs", longs), ("documents", longs))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = begin_task(lambda: sides(path_a, path_b))
        vocabulary = max(len(first.bytes), len(second.bytes))
        words = held(f"marked {vocabulary}", lambda: marked(vocabulary))
        number, size, docs_of, columns, ids = TaskContext.get().partitionId() << 32, 0, [], [], []

        def chunk() -> pa.RecordBatch:
            many, pair, times = map(np.concatenate, zip(*docs_of, strict=True))  # many: pairs of each document
            pairs, place = np.unique(pair, return_inverse=True)
            ends = np.concatenate([[0], np.cumsum(many)])
            # places ascend within a document, and are kept as steps, which compress
            step = np.diff(place, prepend=0)
            begin = ends[:-1][many > 0]
            step[begin] = place[begin]
            # what has more links than 32 bits say doesn't fit in a text
            raw = [step.astype("<i4").tobytes(), times.astype("<u4").tobytes()]
            cut_up = [pa.array([r[4 * x : 4 * y] for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)] + [None], pa.binary()) for r in raw]
            n = len(many)
            own = [pa.concat_arrays([*some, pa.nulls(1, some[0].type)]) for some in zip(*columns, strict=True)]
            last = [pa.array([None] * n + [x.tolist()], pa.list_(pa.int64())) for x in (pairs, np.bincount(place, minlength=len(pairs)))]
            who = pa.concat_arrays([*ids, pa.nulls(1, ids[0].type)])
            return pa.RecordBatch.from_arrays([who, pa.array(np.full(n + 1, number)), *own, *cut_up, *last], names=schema.names)

        for batch in batches:
            for part in bounded(batch, 1 << 20):
                x = Aligned(part.column(1).to_pylist(), first, second)
                doc, pair, times = x.pairs()
                sha = [hashlib.sha256(s).hexdigest() if s else "" for s in x.spelled(words, vocabulary)]
                docs_of.append((np.bincount(doc, minlength=x.docs), pair, times))
                ids.append(part.column(0))
                columns.append([pa.array(v, t) for v, t in ((x.count_a, pa.int64()), (x.count_b, pa.int64()), (x.per_doc(np.ones(len(x.doc), np.int64)), pa.int64()), (x.per_doc(x.size_a * x.size_b), pa.int64()), (sha, pa.string()))])
                size += len(pair)
                if size >= chunk_pairs:
                    yield chunk()
                    number, size, docs_of, columns, ids = number + 1, 0, [], [], []
        if ids:
            yield chunk()
        give_back()

    lean_batches(docs.sparkSession)
    return base.mapInArrow(run, schema)


def _counted(chunks: DataFrame) -> DataFrame:
    """(pair, n): the documents that hold each pair linked."""
    return chunks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "documents")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.documents").alias("n"))


def link_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, documents) of all linked pairs of ids."""
    counts = _counted(_chunks(docs, path_a, path_b, id_col, text_col, CHUNK_PAIRS))
    return counts.select(F.shiftright("pair", SHIFT).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).cast("int").alias("b_id"), F.col("n").alias("documents"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    n_best: links whose pair's count is the highest of all pairs of its first id; count_sum: the counts of all links
    together. What is sent to all tasks has a row for each id of the first vocabulary at most.
    """
    chunks = cut(_chunks(docs, path_a, path_b, id_col, text_col, chunk_pairs), "chunks")
    counts = cut(_counted(chunks), "pair-counts")
    first = F.shiftright("pair", SHIFT)
    best = counts.groupBy(first.alias("id")).agg(F.max("n").alias("most"))
    judged = counts.join(F.broadcast(best), first == F.col("id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    own = chunks.where("pairs is not null").select(F.col("chunk").alias("of"), F.explode("pairs").alias("pair"))
    found = own.join(judged.hint("shuffle_hash"), "pair")
    names = [n for n, _ in _DOC[:4]]
    schema = T.StructType([chunks.schema["doc_id"], *[T.StructField(n, _LONG) for n in (*names, "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType())])

    def judge(rows: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("pair").to_numpy())
        n, best = known.column("n").to_numpy()[order], known.column("best").to_numpy()[order].astype(np.int64)
        step, links = ([np.frombuffer(x, k) for x in rows.column(c).to_pylist()] for c, k in (("places", "<i4"), ("links", "<u4")))
        place = [np.cumsum(s) for s in step]
        sums = [(int(t.astype(np.int64) @ best[p]), int(t.astype(np.int64) @ n[p])) for p, t in zip(place, links, strict=True)]
        new = [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]
        return pa.Table.from_arrays([rows.column("doc_id"), *[rows.column(c) for c in names], *new, rows.column("groups_sha256")], names=schema.names)

    rows = chunks.where("pairs is null").select("chunk", "doc_id", *[n for n, _ in _DOC], "places", "links")
    return rows.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(judge, schema)
