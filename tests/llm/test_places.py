"""Rows that are found again where they are stored, and the operators that shuffle no text for it."""

import pytest
from pyspark.sql import functions as F

from aligned_store.llm import places, simhash, tokens, warc
from aligned_store.llm.queries import tokenizer_path


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [places.STRETCHES, 3, 1])
def test_marked_rows_are_found_in_any_number_of_blocks(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(places, "STRETCHES", limit)
    path = f"file://{tmp_path}/rows"
    spark.range(0, 30_000, 1, 3).select("id", F.lit("x").alias("AT_FILE"), F.lit(1).alias("row"), F.lit(2).alias("_metadata")).write.parquet(path)
    df = places.placed(spark.read.parquet(path))
    file, row = places.place(df)
    wanted = (F.col("id") % 7 == 0) | F.col("id").between(4000, 4200) | F.col("id").isin(9_999, 10_000, 29_999)
    marked = places.marks(df.where(wanted).select(file.alias("file"), row.alias("row")))
    assert places.blocks_of(marked) >= (1 if limit == places.STRETCHES else 3)
    want = {r.id for r in df.where(wanted).collect()}
    for keep in (True, False):
        frames = places.in_place(df, marked, keep)
        assert all(f.columns == df.columns and "Exchange hashpartitioning" not in plan_of(f) for f in frames)
        got = [r.id for f in frames for r in f.collect()]
        assert len(got) == len(set(got)) and set(got) == (want if keep else set(range(30_000)) - want)
        assert sorted(r.id for r in places.as_one(frames, "one").collect()) == sorted(got)
    if len(frames) > 1:  # each block reads its own files alone
        assert sum(f.rdd.getNumPartitions() for f in frames) < len(frames) * df.rdd.getNumPartitions()


def test_no_marks_and_no_files(spark):
    made = frame(spark, [(1, "a"), (1, "a")])
    df = places.placed(made)
    assert places.placed(df) is df
    none = places.marks(frame(spark, [], "file string, row long"))
    assert [f.count() for f in places.in_place(df, none, True)] == [0]
    assert [f.count() for f in places.in_place(df, none, False)] == [2]
    twice = df.unionByName(df)  # rows of two scans of a file aren't told apart by their places
    assert places.placed(twice) is not twice and places.placed(twice).count() == 4


def test_fifty_thousand_misses_shuffle_no_text(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cache"
    spark.range(0, 60_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    tokens.token_counts(docs.where("doc_id < 10000"), tokenizer_path(), cache_path=path)
    seen = []
    kept = tokens.map_batches
    monkeypatch.setattr(tokens, "map_batches", lambda df, *a: (seen.append(df), kept(df, *a))[1])
    got = tokens.token_counts(docs, tokenizer_path(), cache_path=path)
    assert len(seen) == 1 and "Exchange hashpartitioning" not in plan_of(seen[0])
    assert seen[0].count() == 50_000  # known texts aren't encoded
    own = tokens.Encoder(tokenizer_path())
    rows = got.collect()
    assert len(rows) == 60_000 and all(r.n_tokens == own.count(f"text {r.doc_id}") for r in rows[::97])
    assert spark.read.parquet(path).count() == 60_000


def test_rows_repeated_under_one_id_are_encoded_once(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cache"
    seen = []
    kept = tokens.map_batches
    monkeypatch.setattr(tokens, "map_batches", lambda df, *a: (seen.append(df.count()), kept(df, *a))[1])
    docs = frame(spark, [(None, "the same")] * 400 + [(1, None), (1, "")])
    assert tokens.token_counts(docs, tokenizer_path(), cache_path=path).count() == 402
    assert sum(seen) == 2 and spark.read.parquet(path).count() == 2


def test_blocks_of_texts_fill_the_cache(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(places, "STRETCHES", 1)
    path = f"file://{tmp_path}/docs"
    spark.range(0, 40, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 25).cast("string")).alias("text")).write.parquet(path)
    docs = spark.read.parquet(path)
    cache = f"file://{tmp_path}/cache"
    assert tokens.token_counts(docs, tokenizer_path(), cache_path=cache).count() == 40
    assert spark.read.parquet(cache).count() == 25
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {i: ("response", None) if i < 25 else ("revisit", i - 25) for i in range(40)}
    kept = simhash.drop_near_duplicates(docs.withColumn("text", F.concat_ws(" ", *["text"] * 5)))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(25))


def test_fifty_thousand_repeated_digests_shuffle_no_payload(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    page = F.concat(F.lit("page "), (F.col("id") % 60_000).cast("string"))
    spark.range(0, 110_000, 1, 4).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), page.alias("html")).write.parquet(path)
    responses, revisits = warc.split(spark.read.parquet(path))
    assert all("Exchange hashpartitioning" not in plan_of(f) for f in responses)
    assert "html" not in plan_of(revisits) and revisits.count() == 50_000
    assert sum(f.count() for f in responses) == 60_000
    assert revisits.where("refers_to <> page_id - 60000").count() == 0


def test_kept_rows_are_read_where_they_are(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    frame(spark, [(i % 60, f"some words of text {i % 30}") for i in range(3000)]).repartition(3).write.parquet(path)
    kept = simhash.drop_near_duplicates(spark.read.parquet(path))
    assert "Exchange hashpartitioning" not in plan_of(kept)
    want = {r.component_id for r in simhash.near_duplicates(spark.read.parquet(path)).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
