"""The training-data operators against slow, independent versions of what they compute, and on rows that are odd."""

import base64
import hashlib
import random
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aligned_store.llm import common, decontaminate, graph, hashing, html, langid, packing, phrases, quality, simhash, tokens, urlgraph, warc
from aligned_store.llm.queries import oracle_sql, tokenizer_path

M = (1 << 64) - 1
ODD = ["", " ", "\n\t", "é", "a", "ab", "日本語 text", "x " * 40, "same same", "😀 ok"]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# features


def slow_features(text, bits, pairs=False):
    """Bucket -> number of features, one code point after the other."""
    points = [32 if 9 <= ord(c) <= 13 else ord(c) for c in text]
    bucket = lambda h: (((h ^ (h >> 29)) * 0x9E3779B97F4A7C15) & M) >> (64 - bits)
    out = {}

    def add(b):
        out[b] = out.get(b, 0) + 1

    padded = [32, *points, 32]
    for n in (3, 4):
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if 32 not in gram[1:-1]:
                h = gram[0]
                for x in gram[1:]:
                    h = ((h * 0x100000001B3) & M) ^ (x + n)
                add(bucket(h))
    before = None
    for word in "".join(map(chr, points)).split(" "):
        if word:
            b = bucket(sum((ord(c) + 1) * pow(0x100000001B3, i, 1 << 64) for i, c in enumerate(word)) & M)
            add(b)
            add(1 if b == before else 2)
            if pairs and before is not None:
                add(bucket(before << 32 | b))
            before = b
    return out


@pytest.mark.parametrize("pairs", [False, True])
@pytest.mark.parametrize("window", [1, 2, 7, 16, 50, 1 << 18])
def test_features_have_no_borders(monkeypatch, window, pairs):
    monkeypatch.setattr(hashing, "WINDOW", window)
    rng = random.Random(window)
    texts = [*ODD, *("".join(rng.choice("ab é ñ日 \n😀") for _ in range(n)) for n in (window - 1, window, window + 1, 2 * window, 3 * window + 1, 40) if n < 200), "x" * 60, "y " + "x" * 60 + " x"]
    for text in texts:
        at, share = hashing.sparse(text.encode(), 9, pairs)
        want = slow_features(text, 9, pairs)
        assert dict(zip(at.tolist(), (share * max(1, sum(want.values()))).round(6).tolist(), strict=True)) == want
    table = np.random.default_rng(1).normal(size=(512, 2))
    together, n = hashing.mean_scores([t.encode() for t in texts] * 2, table, pairs)
    for k, text in enumerate(texts):
        alone, m = hashing.mean_scores([text.encode()], table, pairs)
        want = slow_features(text, 9, pairs)
        assert m[0] == n[k] == sum(want.values())
        # the same to the last bit, whatever else is in the batch
        assert (alone[0] == together[k]).all() and (alone[0] == together[k + len(texts)]).all()
        assert np.allclose(alone[0], sum((table[b] * x for b, x in want.items()), np.zeros(2)) / max(1, m[0]))


# quality


def test_quality_gradients_and_folding():
    rng = np.random.default_rng(5)
    net = quality.Network(rng.normal(size=(64, 3)), rng.random(64) + 0.5, rng.normal(size=(3, 2)), rng.normal(size=2))
    some = [hashing.sparse(t.encode(), 6, True) for t in ("one text", "and another one", "third, third")]
    y, w = np.array([0, 1, 1]), np.array([1.0, 0.5, 2.0])

    def loss():
        p, _ = net.probabilities(some)
        return -(w * np.log(p[np.arange(3), y])).sum() / 3

    for x, g in zip((net.vectors, net.out, net.bias), net.gradients(some, y, w), strict=True):
        flat = x.reshape(-1)
        for i in rng.choice(len(flat), min(20, len(flat)), replace=False):
            kept = flat[i]
            flat[i] = kept + 1e-5
            up = loss()
            flat[i] = kept - 1e-5
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-6
    # scoring by one number for each bucket is the softmax of the mapped mean vector
    for text in ("one text", "something else", "é ü"):
        found = slow_features(text, 6, pairs=True)
        mean = sum(net.vectors[b] * net.scale[b] * k for b, k in found.items()) / sum(found.values()) / 16
        logits = mean @ net.out + net.bias
        assert np.allclose(net.folded().score([text.encode()])[0], np.exp(logits[1]) / np.exp(logits).sum())


def test_quality_labels_of_a_hot_id(spark):
    docs = frame(spark, [(i, f"text number {i} " * 3) for i in range(40)])
    labels = frame(spark, [(i, i % 2) for i in range(40)] + [(3, 1)] * 3000, "doc_id long, quality int")
    got = quality.quality(docs, labels)
    assert got.count() == 40
    assert quality.quality(docs.limit(0), labels).count() == 0


# language


def slow_vote(model, chance):
    def best(names):
        if len(names) == 1:
            return names[0], 1.0
        points = {n: 0.0 for n in names}
        least = {n: 1.0 for n in names}
        for a, b in combinations(names, 2):
            p = chance[a, b]
            points[a if p >= 0.5 else b] += 1
            points[a] += 1e-3 * p
            points[b] += 1e-3 * (1 - p)
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        top = max(points.values())
        name = next(n for n in names if points[n] == top)
        return name, least[name]

    family, sure = best(sorted(model.languages))
    lang, inner = best(sorted(model.languages[family]))
    return lang, sure * inner


def test_language_votes_family_first():
    rng = np.random.default_rng(9)
    languages = {"=germanic": ["de", "en", "nl"], "=romance": ["es", "fr"], "=xx": ["xx"]}
    pairs = [*combinations(sorted(languages), 2), *(p for v in languages.values() for p in combinations(v, 2))]
    model = langid.LanguageModel(languages, pairs, rng.normal(size=(512, len(pairs))), rng.normal(size=len(pairs)) / 20)
    texts = [f"{a} text {b}" for a in ("der", "le", "un", "the", "zwei") for b in range(12)]
    got, score = model.predict([t.encode() for t in texts])
    for text, lang, s in zip(texts, got, score, strict=True):
        found = slow_features(text, 9)
        margin = {p: sum(model.table[b, k] * n for b, n in found.items()) / sum(found.values()) + model.bias[k] for k, p in enumerate(pairs)}
        want = slow_vote(model, {p: 1 / (1 + np.exp(-2 * m)) for p, m in margin.items()})
        assert lang == want[0] and abs(s - want[1]) < 1e-9
    assert len(set(got)) > 2
    # a tie goes to the alphabetically first
    flat = langid.LanguageModel({"=a": ["aa"], "=b": ["bb"]}, [("=a", "=b")], np.zeros((512, 1)), np.zeros(1))
    assert flat.predict([b"any"])[0] == ["aa"]


def test_svm_separates_what_can_be_separated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) > 0, 1.0, -1.0)
    w, b = langid.svm(x, y)
    assert np.mean(np.sign(x @ w + b) == y) > 0.95


def test_language_of_texts_without_letters(spark):
    rows = [(i, ("the and of " if i % 2 else "der und die ") * 5, "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, "²³ 12", None), (101, "½", None), (102, "Ⅷ ①", None), (103, "ª", None), (104, "12 日", None), (105, None, "en"), (106, "", "de"), (107, "the and of " * 80_000, None)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.language(docs).collect()}
    assert all(got[i] == ("und", 0.0) for i in (100, 101, 102, 105, 106))
    assert got[103][0] in ("de", "en") and got[104][0] in ("de", "en") and got[107][0] == "en"
    assert langid.language(docs.limit(0)).count() == 0
    assert langid.keep_languages(docs.limit(0)).columns == docs.columns


# phrases


def slow_level(names, level):
    mixed = lambda x: (lambda v: v ^ (v >> 29))(((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & M)
    runs, k = [], 0
    while k < len(names):
        n = 1
        while k + n < len(names) and names[k + n] == names[k]:
            n += 1
        runs.append(mixed((names[k] + n * 0xBF58476D1CE4E5B9) & M) if n > 1 else names[k])
        k += n
    lowest = lambda x: (x & -x).bit_length() - 1 if x else 63
    label = [0] * len(runs)
    for i in range(1, len(runs)):
        bit = lowest(runs[i] ^ runs[i - 1])
        label[i] = ((bit & 31) << 1) | (runs[i] >> bit & 1)
    for _ in range(2):
        new = [0] * len(label)
        for i in range(1, len(label)):
            bit = lowest(label[i] ^ label[i - 1]) if label[i] != label[i - 1] else 0
            new[i] = 2 * bit + (label[i] >> bit & 1)
        label = new
    if not runs:
        return []
    begins = [i for i in range(len(runs)) if i == 0 or (1 < i < len(runs) - 1 and label[i] > label[i - 1] and label[i] >= label[i + 1])]
    out = []
    for a, b in zip(begins, [*begins[1:], len(runs)], strict=True):
        out.append(mixed(sum(mixed((runs[a + k] + (k + 1) * 0xBF58476D1CE4E5B9 + level) & M) for k in range(b - a)) & M))
    return out


def slow_fingerprint(text):
    names, least = [b + 1 for b in text.encode()], {}
    for level in range(1, max(phrases.LEVELS) + 1):
        names = slow_level(names, level)
        if level in phrases.LEVELS:
            for n in names:
                slot = (n >> 58) + 64 * phrases.LEVELS.index(level)
                h = n >> 20 & 0xFFFFFFFF
                least[slot] = min(least.get(slot, h), h)
    return bytes(least[s] % 255 if s in least else 255 for s in range(64 * len(phrases.LEVELS)))


def slow_likeness(a, b):
    found = None
    every = [(x, y) for x, y in zip(a, b, strict=True) if x != 255 or y != 255]
    found = every
    for k in range(0, len(a), 64):
        part = [(x, y) for x, y in zip(a[k : k + 64], b[k : k + 64], strict=True) if x != 255 or y != 255]
        if len(part) >= 32:
            found = part
    return sum(x == y for x, y in found) / len(found) if found else 1.0


def test_fingerprints_are_those_of_a_slow_parser(spark):
    rng = random.Random(4)
    texts = [*ODD, "aaaa", "a" * 5000, *("".join(rng.choice("abc dé") for _ in range(rng.randint(0, 900))) for _ in range(25))]
    fps = phrases.fingerprints([t.encode() for t in texts])
    slow = [slow_fingerprint(t) for t in texts]
    assert [f.tobytes() for f in fps] == slow
    order = rng.sample(range(len(texts)), len(texts))
    got = phrases.likeness(fps, fps[order])
    assert np.allclose(got, [slow_likeness(slow[i], slow[j]) for i, j in enumerate(order)])
    rows = list(enumerate(texts))
    out = {r.doc_id: r for r in phrases.document_fingerprints(frame(spark, rows)).collect()}
    for i, t in rows:
        edit = phrases.edited(t, texts[(i + 1) % len(texts)])
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (slow[i].hex(), slow_fingerprint(edit).hex())
        assert abs(out[i].near_edited - slow_likeness(slow[i], slow_fingerprint(edit))) < 1e-9
        assert abs(out[i].near_next - slow_likeness(slow[i], slow[(i + 1) % len(texts)])) < 1e-9


def test_fingerprints_of_other_ids_and_hot_rows(spark):
    rng = random.Random(7)
    ids = [None, "b", "a", "é", "zz", "10", "9"]
    text = {i: " ".join(rng.choice(["ab", "cde", "f"]) for _ in range(60)) for i in ids}
    order = sorted((i for i in ids if i is not None), key=lambda i: i.encode())
    order = [None, *order]
    out = {r.doc_id: r for r in phrases.document_fingerprints(frame(spark, [(i, text[i]) for i in ids], "doc_id string, text string")).collect()}
    for k, i in enumerate(order):
        edit = phrases.edited(text[i], text[order[(k + 1) % len(order)]])
        assert out[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
    hot = frame(spark, [(5, "hot text")] * 500 + [(i, f"text {i}") for i in range(20)])
    placed = phrases.document_fingerprints(hot).withColumn("p", F.spark_partition_id())
    assert placed.count() == 520
    assert placed.where("doc_id = 5").select("p").distinct().count() > 1


# SimHash and components


@pytest.mark.parametrize("radius", [3, 4])
def test_full_cells_lose_no_link(spark, radius):
    rng = random.Random(radius)
    fps = {0, M}
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(30):  # a chain of near ones, and a ball around it
            at ^= 1 << rng.randrange(64)
            fps |= {at, at ^ (1 << rng.randrange(64)), at ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
    fps |= {rng.getrandbits(64) for _ in range(60)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    root = {f: f for f in signed}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(signed, 2):
        if ((a ^ b) & M).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {f: find(f) for f in signed}
    table = common.cut(frame(spark, [(f,) for f in signed], "fp long"))
    for dense in (2000, 4) if radius == 4 else (0,):
        links = simhash.connecting_links(table, radius, dense)
        assert all(((r.a ^ r.b) & M).bit_count() <= radius and r.a < r.b for r in links.collect())
        found = {r.node: r.root for r in graph.components(links).collect()}
        assert {f: found.get(f, f) for f in signed} == want


def test_cells_grow_with_the_number_of_fingerprints():
    assert [simhash.agreeing(n) for n in (1, 10**6, 10**7, 10**8, 10**9, 10**12)] == [3, 3, 4, 5, 7, 8]
    rng = random.Random(2)
    for agree in (3, 5):
        cells, masks = list(combinations(range(4 + agree), agree)), simhash._group_masks(4 + agree)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), rng.randint(0, 4)):
                b ^= 1 << k
            assert any(all((_thermometer(a) ^ _thermometer(b)) & masks[g] == 0 for g in c) for c in cells)


def _thermometer(f):
    return sum((0, 1, 3)[(f >> 2 * k & 3).bit_count()] << 2 * k for k in range(32))


@pytest.mark.parametrize("n", [10_000])
def test_an_ascending_path_takes_few_rounds(spark, n):
    got = graph.components(spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.count() == n and got.where("root <> 0").count() == 0
    assert graph.components.rounds <= 20


def test_hubs_and_hot_keys(spark, monkeypatch):
    left = common.cut(frame(spark, [(i % 3 if i % 2 else 100 + i, i) for i in range(600)] + [(None, 7)], "k long, v long"))
    right = common.cut(frame(spark, [(k, k * 10) for k in range(500)], "k long, w long"))
    for how in ("left", "inner"):
        want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
        assert sorted(map(tuple, common.lookup(left, right, ["k"], how, limit=0).collect()), key=str) == want
    monkeypatch.setattr(common, "HOT_SHARE", 1 / 8)
    assert sorted(map(tuple, common.lookup(left, right, ["k"], "left", limit=0).collect()), key=str) == sorted(map(tuple, left.join(right, ["k"], "left").collect()), key=str)
    star = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(30)]
    found = {r.node: r.root for r in graph.components(frame(spark, star, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(31)}


def test_near_duplicates_of_other_ids(spark):
    rng = random.Random(3)
    text = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(90)) for _ in range(4)]
    rows = [("b", text[0]), ("a", text[0]), (None, text[0]), ("c", text[1]), (None, text[2]), ("d", text[3] + " tail"), ("e", "w " * 70_000), ("e2", "w " * 70_000 + "v")]
    docs = frame(spark, [(*r, 1, 2) for r in rows], "doc_id string, text string, near_fp int, near_row int")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {("b", "a"), ("a", "a"), (None, "a"), ("c", "c"), (None, None), ("d", "d"), ("e", "e"), ("e2", "e")}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [None, "a", "c", "d", "e"]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    same = simhash.drop_near_duplicates(frame(spark, [(1, "one text here")] * 5)).collect()
    assert len(same) == 1


def test_near_duplicates_leave_no_join_to_the_planner(spark, monkeypatch):
    plans = {}

    def cut(df, label="cut"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return common.cut(df, label)

    docs = frame(spark, [(i, f"some words of text {i % 30}") for i in range(60)])
    want = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "cut", cut)
    monkeypatch.setattr(simhash, "FEW_ROWS", -1)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert all("Join" in plans[x] and "Broadcast" not in plans[x] for x in ("links", "rooted"))


# tokens and packing


def thue_morse(n):
    s = "a"
    for _ in range(n):
        s += s.translate({97: 98, 98: 97})
    return s


@pytest.mark.parametrize("n", [10, 11, 12])
def test_equal_hashes_are_not_taken_for_equal_text(n):
    own = tokens.Encoder(tokenizer_path())
    x = thue_morse(n)
    y = x.translate({97: 98, 98: 97})
    for texts in ([x + " " + y + " " + x, y], [y, x], [y + "\n" + x]):
        assert [t.tolist() for t in own.batch(texts)] == [own._model.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_are_encoded_as_in_one_piece(monkeypatch):
    monkeypatch.setattr(tokens, "_PIECE", 500)
    own, rng = tokens.Encoder(tokenizer_path()), random.Random(6)
    for _ in range(20):
        text = "".join(rng.choice(["word ", "é", "\n", "12", "don't ", "... ", "X"]) for _ in range(900))
        assert own.ids(text).tolist() == own._model.encode(text, add_special_tokens=False).ids


def test_token_cache_with_repeated_digests_and_other_ids(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    docs = frame(spark, [("x", "one two"), ("y", "one two"), (None, None)], "doc_id string, text string")
    first = tokens.token_counts(docs, tokenizer_path(), cache_path=path).collect()
    spark.read.parquet(path).write.mode("append").partitionBy("version").parquet(path + "2")
    for _ in range(2):  # two writers that stored the same
        spark.read.parquet(path).write.mode("append").partitionBy("version").parquet(path + "2")
    again = tokens.token_counts(docs, tokenizer_path(), cache_path=path + "2").collect()
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(first) == 3
    assert tokens.token_counts(docs.limit(0), tokenizer_path(), cache_path=path).count() == 0


def test_a_warm_cache_shuffles_no_text(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    docs = frame(spark, [(i, f"text {i} " * 50) for i in range(200)])
    tokens.token_counts(docs, tokenizer_path(), cache_path=path)
    plans = []
    kept = tokens.map_batches
    try:
        tokens.map_batches = lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, *a))[1]
        tokens.token_counts(docs.unionByName(frame(spark, [(900, "new")])), tokenizer_path(), cache_path=path)
    finally:
        tokens.map_batches = kept
    assert "BroadcastHashJoin" in plans[0] and "Exchange hashpartitioning" not in plans[0]


def test_packing_other_ids_and_repeated_rows(spark):
    own = tokens.Encoder(tokenizer_path())
    rows = [("a", "some words here " * 30), (None, "null id"), ("b", None), ("c", "")] + [("hot", "repeated row")] * 200
    docs = frame(spark, [(*r, 1, 2) for r in rows], "doc_id string, text string, bucket int, length int")
    got = packing.pack(docs, tokenizer_path(), capacity=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in by.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in dict(rows).items():
        ids = [*own.ids(t or "").tolist(), 2]
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i})
        assert sum(p[2] for p in pieces) == len(ids)
        assert [p[3] for p in pieces] == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for _, s, n, _ in pieces]
    assert sum(r.doc_id == "hot" for r in got) == 200
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 64) + 2
    made = packing.pieces(docs.where("doc_id = 'hot'").coalesce(1), tokenizer_path(), capacity=64, buckets=8)
    assert {r["count"] for r in made.groupBy("bucket").count().collect()} == {25}


# WARC


def test_archives_of_other_ids_and_without_broadcasts(spark, monkeypatch):
    pages = [("p 2", "u", "<p>same</p>"), ("p 1", "u", "<p>same</p>"), ("é\r\n", None, None), ("zz", "u", ""), (None, "u", "x"), ("big", "u", "\r\n\r\n" * 5000 + "\r\r\n\r\n\r" + "é" * 100_000), ("line", "u", " \x85a\rb\nc")]
    df = frame(spark, [(*r, "clash") for r in pages], "page_id string, url string, html string, payload string")
    for limit in (common.FEW_ROWS, 0):
        monkeypatch.setattr(common.lookup, "__defaults__", ("left", limit))
        got = {r.page_id: r for r in warc.round_trip(df).collect()}
        assert set(got) == {r[0] for r in pages}
        for i, _, h in pages:
            raw = (h or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (got["p 2"].record_type, got["p 2"].refers_to, got["p 1"].record_type) == ("revisit", "p 1", "response")
        assert (got["é\r\n"].refers_to, got["zz"].refers_to, got[None].record_type) == (None, "é\r\n", "response") or got["é\r\n"].refers_to == "zz"
    repeated = frame(spark, [(1, "u", "a")] * 3 + [(2, "u", "a")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(repeated).collect()) == [(1, "response", None)] * 3 + [(2, "revisit", 1)]


def test_headers_alone_meet_by_digest(spark):
    df = frame(spark, [(i, "u", f"page {i % 5}") for i in range(50)], "page_id long, url string, html string")
    plan = warc.resolve(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(payload_digest" not in plan


# URL graph


def test_links_by_element_and_base(spark):
    rows = [
        ("http://a.com/", "<a class=x href='http://B.com/1?x'>1</a><AREA HREF=//c.com><a href='/own'>o</a><a href=mailto:x@d.com><link href='http://e.com/'>"),
        ("http://a.com/2", "<base href='https://f.com/dir/'><a href='page'>p</a><a href=\"http://b.com\">b</a>"),
        ("http://g.com", None), ("no url", "<a href='http://b.com/'>x</a>"), (None, "<a href='http://b.com/'>x</a>"), ("http://h.com", "<a data-href='http://b.com/'>x</a>"),
    ]
    got = {(r.src, r.dst): r.w for r in urlgraph.links_of(frame(spark, rows, "url string, html string")).collect()}
    assert got == {("a.com", "b.com"): 2.0, ("a.com", "c.com"): 1.0, ("a.com", "f.com"): 1.0}


def test_url_filter_is_its_sql(spark):
    rng = random.Random(5)
    hosts = [f"{a}{b}.{c}" for a in ("", "www.", "x.") for b in ("one", "two", "example") for c in ("org", "com", "net")]
    rows = []
    for i in range(150):
        path = rng.choice(["", "/", "/es/1", "/en/12", "/fr/", "/de/x", "/q?a#b"])
        links = "".join(f'<a href="{rng.choice(["http://", "//", "HTTPS://"])}{rng.choice(hosts).upper() if rng.random() < 0.2 else rng.choice(hosts)}/x">l</a>' for _ in range(rng.randint(0, 4)))
        rows.append((i if i % 10 else i // 2, rng.choice(["http://", "https://"]) + rng.choice(hosts) + path, links, 1))
    rows += [(500, None, "x", 1), (501, "nothing", None, 1), (None, "http://tie.net/", None, 1)]
    df = frame(spark, rows, "page_id long, url string, html string, host int")
    names = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted((tuple(r) for r in urlgraph.judge(df).select(*names).collect()), key=str)
    db = duckdb.connect()
    db.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html", "host"]).astype({"page_id": "Int64"}))
    want = sorted((tuple(r) for r in db.sql(f"SELECT {', '.join(names)} FROM ({oracle_sql()['op2_url_filter']})").fetchall()), key=str)
    assert got == want
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_a_tie_of_trust_and_distrust_blocks(spark):
    pages = [(1, "http://t.com/fr/", None), (2, "http://t.com/de/", None), (3, "http://t.com/", None), (4, "http://u.com/fr/", None), (5, "http://u.com/de/", None), (6, "http://u.com/x", None)]
    got = {r.page_id: r.verdict for r in urlgraph.judge(frame(spark, pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block"}


# HTML


def test_lstm_is_one_step_after_the_other_and_its_gradients():
    own, rng = html.Labeller(), np.random.default_rng(2)
    own.w = {k: v.astype(np.float64) for k, v in own.w.items()}
    x, mask = rng.normal(size=(2, 7, 2 * html.DIM + html.NUMBERS)), np.ones((2, 7), np.float32)
    mask[1, 4:] = 0
    sig = lambda z: 1 / (1 + np.exp(-z))
    h = html.HIDDEN

    def walk(page, d):
        state = cell = np.zeros(h)
        out = []
        for row in page if d == "f" else page[::-1]:
            z = row @ own.w[f"x{d}"] + own.w[f"c{d}"] + state @ own.w[f"h{d}"]
            cell = sig(z[h : 2 * h]) * cell + sig(z[:h]) * np.tanh(z[3 * h :])
            state = sig(z[2 * h : 3 * h]) * np.tanh(cell)
            out.append(state)
        return out if d == "f" else out[::-1]

    p, _ = own.forward(x, mask, tape=False)
    for k, n in ((0, 7), (1, 4)):
        page = x[k, :n]
        want = [sig(np.concatenate([f, b, r]) @ own.w["out"][:, 0] + own.w["bias"][0]) for f, b, r in zip(walk(page, "f"), walk(page, "b"), page, strict=True)]
        assert np.allclose(p[k, :n], want, atol=1e-6)
    path, word, number = rng.random((2, 7, html.PATHS)), rng.random((2, 7, html.WORDS)), rng.normal(size=(2, 7, html.NUMBERS))
    y = rng.integers(0, 2, (2, 7)).astype(float)

    def loss():
        q, _ = own.forward(np.concatenate([path @ own.w["path"], word @ own.w["word"], number], 2), mask)
        return -((y * np.log(q) + (1 - y) * np.log(1 - q)) * mask).sum() / mask.sum()

    for name, g in own.gradients(path, word, number, mask, y).items():
        flat = own.w[name].reshape(-1)
        for i in rng.choice(len(flat), min(4, len(flat)), replace=False):
            kept = flat[i]
            flat[i] = kept + 1e-3
            up = loss()
            flat[i] = kept - 1e-3
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-3 - np.asarray(g).reshape(-1)[i]) < 2e-4, name


def test_long_and_broken_pages(spark):
    open_tags = "<div class=a>" * 4000 + "text. " + "<p>One more sentence of the text.</p>" * 50
    assert len(html.blocks(open_tags)) == 51 and len(html.blocks(open_tags)[0].path) == 8000
    assert [b.text for b in html.blocks('<p title="abc>Hello<p>More')] == ["Hello", "More"]
    assert html.blocks("<p") == [] and html.blocks('<p title="' * 20_000) == []
    assert [b.text for b in html.blocks("<p>a < b and 1<2</p>x")] == ["a < b and 1<2", "x"]
    own = html.Labeller()
    some = [html.blocks(f"<p>{'word ' * n}</p>" * m) for n, m in ((3, 700), (2, 5), (9, 300))]
    together = own.label(some, cells=800)
    assert all((a == own.label([p])[0]).all() for a, p in zip(together, some, strict=True))
    # a path's kept vector is that of the labeller that asks
    other, block = html.Labeller(seed=9), html.blocks("<div class=a><p>x</p></div>")
    for who in (own, other, own):
        mean = who.w["path"][html._path_buckets(block[0].path)].mean(0)
        assert np.allclose(who.vectors([block])[0][0, : html.DIM], mean, atol=1e-6)
        block[0].at.enter(("i",)).vector(other.w["path"])
    pages = frame(spark, [("x", None, "<p", 1), (None, "u", open_tags, 2)], "page_id string, url string, html string, text int")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert (got["x"].text, got["x"].n_chars) == ("", 0) and got[None].n_chars == len(got[None].text)
    assert html.extract(pages.limit(0)).count() == 0


# decontamination


def test_shards_find_the_same_and_keep_clashing_columns(spark):
    rng = random.Random(8)
    stock = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(rng.choice(stock) for _ in range(rng.choice([3, 8, 12])))) for i in range(12)]
    rows = [(i % 25, " ".join(rng.choice(stock) for _ in range(200)), 1, 2, 3, 4) for i in range(40)] + [(None, None, 1, 2, 3, 4), (7, "w1 " * 100_000, 1, 2, 3, 4)]
    docs = frame(spark, rows, "doc_id int, text string, row int, spans int, items int, n_words int")
    bench = frame(spark, items, "item_id long, text string")
    one, many = (sorted(map(str, decontaminate.contamination(docs, bench, shard_words=n).collect())) for n in (10**6, 20))
    assert one == many
    one, many = (decontaminate.decontaminate(docs, bench, shard_words=n) for n in (10**6, 20))
    assert one.columns == many.columns == docs.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert one.dtypes == many.dtypes == docs.dtypes
