"""Benchmark decontamination with a generalised suffix automaton.

The words of every test item go into one automaton. Training tokens are streamed through it: after
each token the state and length give the longest stretch ending there that occurs in an item. A
stretch of ``window`` words or more is a match (for an item shorter than that, the whole item).

Defined results: null or empty text has no words, is never contaminated and comes back unchanged.
Items with a null id or without words are ignored; items repeated under one id count once. Repeated
document rows are judged one by one. Documents may have any further columns; result columns get
underscores before their names where a document column is called so. An empty table of documents gives no
rows; without items nothing is hit. Ties can't arise: a word is hit or not. Texts of any length are read whole.

Scale: with one shard of test items documents aren't shuffled. Items are taken in shards of ``shard_words``
words at most, so the automaton in a worker is bounded, and it is made once in a worker. A further shard is a
further reading of the documents that leaves the spans of hit ones only; these are joined at the end.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, held, lookup, map_batches, utf8

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 8
SHARD_WORDS = 250_000


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of words, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        shorts: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
            if 0 < len(words) < window:
                shorts.setdefault(last, []).append((len(words), item))
        self.windows: dict[int, set[str]] = {}
        for item, words in items:
            for state, length, _ in self._walk(words):
                if length >= window:
                    self.windows.setdefault(self._reduce(state), set()).add(item)
        #: Whole short items that end at a state, from its suffixes too.
        self.shorts: dict[int, list[tuple[int, str]]] = {}
        if shorts:
            for s in sorted(range(len(self.length)), key=self.length.__getitem__):
                if found := shorts.get(s, []) + self.shorts.get(self.link[s], []):
                    self.shorts[s] = found

    def _new(self, length: int, edges: dict[bytes, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state for the stretches of ``q`` that are one word longer than those of ``p``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        cur, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, w, self.next[p][w])
        return cur

    def _reduce(self, state: int) -> int:
        """The state of the last ``window`` words of a longer match."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _walk(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """State, match length and position wherever a match may end: of ``window`` words, or a short item."""
        nexts, link, length, window = self.next, self.link, self.length, self.window
        ends = getattr(self, "shorts", {})
        root = nexts[0].get
        state = run = 0
        for i, w in enumerate(words):
            if state:
                to = nexts[state].get(w)
                if to is None:
                    while to is None and state:
                        state = link[state]
                        to = nexts[state].get(w)
                    run = length[state]
                    if to is None:
                        continue
                run += 1
                state = to
            else:
                to = root(w)
                if to is None:
                    continue
                state, run = to, 1
            if run >= window or state in ends:
                yield state, run, i

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Stretches of hit words, as disjoint ascending (begin, end), and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for state, run, i in self._walk(words):
            if run >= self.window:
                spans.append((i + 1 - run, i + 1))
                items |= self.windows.get(self._reduce(state), set())
            for size, item in self.shorts.get(state, ()):
                if run >= size:
                    spans.append((i + 1 - size, i + 1))
                    items.add(item)
        return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shards(items: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in ascending id, in lists of ``most`` words (one item at least); one list at a time is on the driver."""
    rows = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(item_col).alias("o")).where("i is not null and t is not null").orderBy("o", "t")
    part, size = [], 0
    for r in rows.toLocalIterator():
        text = r.t.encode().lower()
        n = len(WORD.findall(text))
        if part and size + n > most:
            yield part
            part, size = [], 0
        if n:
            part.append((r.i, text))
            size += n
    yield part


def match_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, finish: Callable | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Documents with n_words, spans (hit words, as [begin, end) pairs in one list) and items; and the names these columns got.

    ``finish`` (batch, names) turns the batches into rows like ``docs`` in the same Python worker.
    """
    names = {n: fresh(docs.columns, n) for n in ("n_words", "spans", "items")}
    parts = shards(items, item_col, item_text_col, shard_words)
    last, later = next(parts), next(parts, None)
    if later is None:
        return _pass(docs, last, text_col, window, names, finish=finish), names
    # more shards than one: rows are written once with a number, each earlier shard leaves what it found of those
    # that it hit, and the last pass adds that up; texts aren't written again for each
    row, found = fresh(docs.columns, "row"), []
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    while later is not None:
        own = _pass(rows.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text")), last, "text", window, {n: n for n in names})
        found.append(cut(own.where(F.size("items") > 0).select("row", "spans", "items"), "found"))
        last, later = later, next(parts, None)
    earlier = reduce(DataFrame.unionByName, found).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias(names["spans"]), F.flatten(F.collect_list("items")).alias(names["items"]))
    joined = lookup(rows, cut(earlier.withColumnRenamed("row", row), "earlier"), [row]).select(*[F.col(f"`{c}`") for c in docs.columns], names["spans"], names["items"])
    return _pass(joined, last, text_col, window, names, docs.schema, finish), names


def _pass(docs: DataFrame, part: list[tuple[str, bytes]], text_col: str, window: int, names: dict[str, str], own: T.StructType | None = None, finish: Callable | None = None) -> DataFrame:
    """One shard over all rows of ``docs``; where spans and items of others are at hand, ``own`` has the columns before them."""
    shared = docs.sparkSession.sparkContext.broadcast(part)
    key = f"automaton {uuid.uuid4().hex}"
    first = own is None
    own = own or docs.schema
    schema = T.StructType([*own.fields, T.StructField(names["n_words"], T.LongType()), T.StructField(names["spans"], T.ArrayType(T.IntegerType())), T.StructField(names["items"], T.ArrayType(T.StringType()))])

    def make():
        automaton = held(key, lambda: SuffixAutomaton([(i, WORD.findall(t)) for i, t in shared.value], window))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, spans, found = [], [], []
            old = None if first else [batch.column(len(own) + k).to_pylist() for k in range(2)]
            for k, text in enumerate(utf8(batch.column(own.fieldNames().index(text_col)))):
                words = WORD.findall(text.lower())
                s, i = automaton.match(words)
                if old and old[0][k]:
                    before = old[0][k]
                    s, i = merge(s + list(zip(before[::2], before[1::2], strict=True))), i | set(old[1][k])
                n.append(len(words))
                spans.append([x for ab in s for x in ab])
                found.append(sorted(i))
            arrays = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *arrays], names=schema.names)
            return finish(out, names) if finish else out

        return step

    return map_batches(docs, make, own if finish else schema)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_items: int = 2, **kw) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined) and contaminated."""
    found, n = match_documents(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), items, **kw)
    spans = F.col(n["spans"])
    hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    count = F.size(n["items"]).cast("long")
    return found.select("doc_id", F.col(n["n_words"]).alias("n_words"), hit.alias("n_hit"), count.alias("n_items"), F.sha2(F.concat_ws(",", n["items"]), 256).alias("items_sha256"), (count >= min_items).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = 0.8, **kw) -> DataFrame:
    """Documents without the matched spans, of ``window`` words or more; one whose words are hit to ``max_coverage`` or more is dropped.

    Spans of short items, which are whole items, go too. The columns stay those of ``docs``.
    """
    own = docs.columns

    def finish(batch: pa.RecordBatch, names: dict[str, str]) -> pa.RecordBatch:
        at = {k: batch.schema.get_field_index(v) for k, v in (names | {"text": text_col}).items()}
        spans, n = batch.column(at["spans"]).to_pylist(), batch.column(at["n_words"]).to_pylist()
        column = batch.column(at["text"])
        texts, keep = None, []
        for k, s in enumerate(spans):
            pairs = list(zip(s[::2], s[1::2], strict=True))
            hit = sum(b - a for a, b in pairs)
            keep.append(not n[k] or hit < max_coverage * n[k])
            if pairs and keep[-1]:
                texts = texts or column.to_pylist()
                texts[k] = strip(texts[k], pairs)
        cols = [pa.array(texts, pa.string()) if texts and i == at["text"] else batch.column(i) for i in range(len(own))]
        return pa.RecordBatch.from_arrays(cols, names=own).filter(pa.array(keep))

    return match_documents(docs, items, text_col, finish=finish, **kw)[0]


def strip(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the stretches of words given as ascending (begin, end)."""
    raw = text.encode()
    ends = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : ends[a][0]])
        at = ends[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()

