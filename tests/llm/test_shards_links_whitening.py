"""Sharding, token alignment and whitening against slow versions of themselves, and odd rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from aligned_store.llm import alignment, kdtree, whitening
from aligned_store.llm.queries import tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# sharding


def shards_of(spark, rows, shards, dims=("lang", "source", "n_chars"), schema=DOCS):
    return kdtree.sharding(spark.createDataFrame(rows, schema), shards, list(dims)).collect()


def test_shards_hold_near_equal_bytes_and_slots_have_no_gaps(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        n = rng.choice([0, 5, 40, 900])
        lang = rng.choice(["en", "fr", None, "zh"])
        rows.append((i, None if n == 0 else "é" * n, lang, "hot" if i % 3 else f"src{i % 7}", n))
    got = shards_of(spark, rows, 7)
    assert sorted(r.doc_id for r in got) == list(range(600))
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert set(size) == set(range(7))
    mean = sum(size.values()) / 7
    # each of the three splits on the way to a shard misplaces half of the longest document at most
    assert max(abs(s - mean) for s in size.values()) <= 3 * (2 * 900 + 16) / 2
    for k in range(7):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    text = {r[0]: r[1] for r in rows}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 and r.law == "bytes" and r.grown_shard is None for r in got)


def test_a_tree_splits_the_widest_dimension_at_the_weighted_median(spark):
    # along n a hundred rows of which one outweighs the rest; lang is the same for all
    rows = [(i, "x" * (5000 if i == 90 else 10), "en", "s", i) for i in range(100)]
    got = {r.doc_id: r.shard for r in shards_of(spark, rows, 2)}
    # of 7600 bytes 2340 stand before the long row: less is on the wrong side if it opens the right shard
    assert {i for i, s in got.items() if s == 1} == set(range(90, 100))
    deeper = {r.doc_id: r.shard for r in shards_of(spark, [(i, "x", ("a", "b")[i % 2], "s", 1) for i in range(80)], 4)}
    assert all(len({i % 2 for i, s in deeper.items() if s == k}) == 1 for k in range(4))


def test_rows_that_are_equal_in_all_columns_are_split(spark):
    got = shards_of(spark, [(1, "same text", "en", "s", 9)] * 400, 4)
    sizes = Counter(r.shard for r in got)
    assert len(got) == 400 and set(sizes.values()) == {100}


def test_odd_rows_are_sharded(spark):
    assert shards_of(spark, [], 40) == []
    few = shards_of(spark, [(None, None, None, None, None), (None, "", None, None, None), (5, "long " * 50_000, "", "https://a.b/c", -1)], 40)
    assert len(few) == 3 and len({r.shard for r in few}) == 3 and sorted(r.size for r in few) == [16, 16, 250_016]
    schema = "doc_id string, text string, shard double, _shard int, slot string, day date, at timestamp_ntz"
    rows = [(f"d{i}", f"t{i}", float("nan") if i % 3 == 0 else float("inf") if i % 5 == 0 else i * 1e307, i, "s", None, None) for i in range(17)]
    df = spark.createDataFrame(rows, schema).withColumn("day", F.expr("date'2024-01-01' + _shard"))
    done = kdtree.kd_shards(df, ["shard", "day", "at"], shards=3)
    assert spark.read.parquet(done.path).count() == 17
    assert len(kdtree.sharding(df, 3, ["shard", "slot", "_shard", "day"]).collect()) == 17
    with pytest.raises(TypeError):
        kdtree.kd_shards(df.withColumn("m", F.array("slot")), ["m"], shards=2)
    with pytest.raises(ValueError):
        kdtree.kd_shards(df, ["slot"])


def test_target_bytes_choose_the_number_of_shards(spark):
    df = spark.createDataFrame([(i, "x" * 84, "en", f"s{i % 9}", i) for i in range(200)], DOCS)
    done = kdtree.kd_shards(df, ["source"], target_bytes=4000)
    assert done.tree.shards == 5 and done.tree.bytes == 20_000
    assert {r.shard: r.n for r in done.read(spark).groupBy("shard").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(5), 40)


# alignment

TEXTS = ["The quick brown fox, 1234 jumps!", "", None, "a<|endoftext|>b </s> <0x41> <s>", "   two  spaces\n\n and\ttabs ", "漢字テスト🙂🙂é", "has ▁ in it", "A" * 300, "\x00\x01", "The quick brown fox, 1234 jumps!", "x=-" * 200 + "y", "the the the the"]


def slow_groups(text, a, b):
    import sentencepiece
    import tokenizers

    first = tokenizers.Tokenizer.from_file(A)
    first.encode_special_tokens = True
    if not text:
        return []
    ids = first.encode(" " + text, add_special_tokens=False).ids, sentencepiece.SentencePieceProcessor(model_file=B).encode(text)
    spans = [[s.bytes[i] for i in own] for s, own in zip((a, b), ids, strict=True)]
    if any(b"".join(s) != b" " + text.encode() for s in spans):
        return []
    ends = [np.cumsum(list(map(len, s))).tolist() for s in spans]
    out, begin = [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        upto = [e.index(end) + 1 for e in ends]
        out.append(tuple(own[x:y] for own, x, y in zip(ids, begin, upto, strict=True)))
        begin = upto
    return out


@pytest.mark.parametrize("chunk_pairs", [1, 1 << 19])
def test_alignment_equals_a_slow_one(spark, chunk_pairs):
    import hashlib

    a, b = alignment.Side(A), alignment.Side(B)
    groups = [slow_groups(t, a, b) for t in TEXTS]
    assert groups[3] and groups[4] and not groups[6]  # special strings are text; a piece's mark can't come back
    counts, best = Counter(), defaultdict(int)
    for own in groups:
        counts.update({(x, y) for ga, gb in own for x in ga for y in gb})
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in alignment.alignment(df, A, B, chunk_pairs=chunk_pairs).collect()}
    for i, own in enumerate(groups):
        links = [(x, y) for ga, gb in own for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in own)
        want = (sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if own else "")
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, TEXTS[i]
    listed = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in alignment.aligned_groups(df, A, B).collect()}
    assert listed == {i: own for i, own in enumerate(groups)}
    assert {(r.a_id, r.b_id): r.documents for r in alignment.link_counts(df, A, B).collect()} == dict(counts)


def test_components_are_those_of_a_slow_union_find():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (5, 3), (200, 150), (2000, 1999)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        if m == 1999:  # a path, its nodes in any order
            order = rng.permutation(n)
            u, v = order[:-1], order[1:]
        label = list(range(n))
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            p, q = label[x], label[y]
            label = [min(p, q) if k in (p, q) else k for k in label]
        assert alignment.components(n, u, v).tolist() == label


def test_wide_groups_are_expanded_by_their_distinct_ids(monkeypatch):
    a, b = alignment.Side(A), alignment.Side(B)
    texts = [t or "" for t in TEXTS]
    whole = alignment.Aligned(texts, a, b).pairs()
    monkeypatch.setattr(alignment, "WIDE", 1)
    assert all(np.array_equal(x, y) for x, y in zip(whole, alignment.Aligned(texts, a, b).pairs(), strict=True))


def test_odd_rows_are_aligned(spark):
    assert alignment.alignment(spark.createDataFrame([], DOCS), A, B).collect() == []
    rows = [("x", "same words", 1, 2), ("x", "same words", 3, 4), (None, "same words", 5, 6), (None, None, 7, 8), ("y", "many words " * 60_000, 9, 9)]
    got = alignment.alignment(spark.createDataFrame(rows, "doc_id string, text string, chunk long, pairs int"), A, B).collect()
    assert sorted(r.n_a for r in got)[:4] == [0, 2, 2, 2] and len(got) == 5
    small = [r for r in got if r.n_a == 2]
    assert len({r.count_sum for r in small}) == 1 and small[0].n_best == small[0].n_links == 2


# whitening


def slow_whitening(vectors, components=4):
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    unique = np.unique(x, axis=0)
    n, s = len(unique), unique.sum(0)
    centred = unique - s / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ vectors / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize("width", [3, 32])
def test_whitening_equals_a_slow_one(spark, width):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 7)) * np.array([9, 5, 3, 2, 1, 1, 0.5])).astype(np.float32)
    vectors = np.concatenate([vectors, vectors[:1].repeat(150, 0)])  # a third are one vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(5)
    got = sorted(whitening.whiten(df, width=width).collect(), key=lambda r: (r.vec_id, r.component))
    n, deviation, whitened, explained = slow_whitening(vectors)
    assert n == 300 and {r.n for r in got} == {300}
    assert [r.deviation for r in got] == deviation.repeat(4).tolist()
    mine = np.array([r.whitened for r in got]).reshape(-1, 4)
    sign = np.sign((mine * whitened).sum(0))
    assert np.abs(mine - whitened * sign).max() < 1e-9
    assert np.allclose([r.explained for r in got[:4]], explained, rtol=1e-9) and got[0].identity_error < 1e-9


def test_covariance_is_summed_over_many_row_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-(10**6), 10**6, (500, 5))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(7)
    want = np.cov(x.T, bias=True)
    assert np.allclose(whitening.covariance(df, x.mean(0), 500, width=2, entries=40), want, rtol=1e-12)
    assert whitening.exact_sums(spark.createDataFrame([([2**62, -5],)] * 6, "x array<long>"), 2) == (6, [6 * 2**62, -30])


def test_odd_vectors(spark):
    schema = "vec_id string, embedding array<double>, component int, x string"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    inf, nan = float("inf"), float("nan")
    rows = [("a", None), ("b", [1.0, None]), ("c", [nan, 1.0]), ("d", [inf, 1.0]), ("e", []), (None, [0.5, -0.25]), ("f", [0.5, -0.25]), ("f", [-0.001, 0.0]), ("g", [1e300, 1.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, 1, "x") for r in rows], schema)).collect()
    assert Counter(r.vec_id for r in got) == {None: 2, "f": 4, "g": 2} and {r.n for r in got} == {3}
    assert all(r.deviation is None for r in got) and {r.component for r in got} == {1, 2}
    plain = whitening.whiten(spark.createDataFrame([(*r, 1, "x") for r in rows[:-1]], schema)).collect()
    assert {r.whitened for r in plain if r.component == 2} == {None}  # two vectors lie on one line
    assert all(abs(abs(r.whitened) - 1) < 1e-9 for r in plain if r.component == 1) and plain[0].identity_error < 1e-9
    one = whitening.whiten(spark.createDataFrame([("a", [1.0, 2.0], 1, "x")], schema)).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(None, 0.0, None, 0)] * 2
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([("a", [1.0], 1, "x"), ("b", [1.0, 2.0], 1, "x")], schema))


# earlier operators


def test_references_are_decoded_where_they_stand_and_raw_text_has_no_markup():
    from aligned_store.llm.html import blocks

    def texts(html):
        return [b.text for b in blocks(html)]

    assert texts("<p>a&lt<b>;</b>b</p>") == ["a<;b"]
    assert texts("<p>x &am<!-- c -->p; y</p>") == ["x &amp; y"]
    assert texts("<p>AT&am<b>p;</b>lt; x") == ["AT&amp;lt; x"]
    assert texts("<p>a</p><iframe><p>no</p></iframe><noframes><p>no</noframes>b&#32;&amp; c") == ["a", "b & c"]
    assert texts("<textarea><p>x &amp; y</p></textarea><p>z") == ["<p>x & y</p>", "z"]
    assert texts("<xmp><b>raw &amp;</b></xmp>z") == ["<b>raw &amp;</b>", "z"]
    assert texts("<iframe>open <p>kept<textarea>and <b>this") == ["open", "kept", "and this"]


def test_fingerprints_over_a_thousand_ranges(spark):
    from aligned_store.llm import phrases

    rows = [(None if i % 50 == 0 else i % 300, f"text {i} " * (i % 7)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = df.transform(phrases.document_fingerprints).collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1000)
    try:
        found = phrases.document_fingerprints(df)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("CASE") < 5  # the search is one expression
        many = found.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(str, few)) == sorted(map(str, many))
