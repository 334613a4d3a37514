"""The pipeline's stages on small tables with planted cases."""

import random

import corpus_pipeline
from aligned_store.llm import common, simhash


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    stock = [f"{a}{b}" for a in ("the", "an", "ing", "er", "on") for b in ("sh", "ou", "ti", "ea", "nd", "ly", "ha")]
    sentence = lambda n: " ".join(rng.choice(stock) for _ in range(n)) + "."
    passage = sentence(20)
    rows = [(i, sentence(60), "en", "src", 1) for i in range(120)]
    rows += [(200 + i, sentence(40).upper() + "!! $$$ %%%", "en", "src", 1) for i in range(40)]
    rows += [(300, rows[7][1], "en", "src", 1), (301, rows[8][1] + " " + passage, "en", "src", 1), (302, None, "en", "src", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(120), *range(200, 240)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    first, second, third, fourth = seen.values()
    assert not [i for i in first if 200 <= i < 240] and len([i for i in first if i < 120]) == 120
    assert 302 not in second
    assert 300 not in third and 7 in third
    assert all(passage not in t for t in fourth.values())
    assert len(fourth) >= 119
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(fourth)


def test_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    stock = [f"{a}{b}" for a in ("the", "an", "ing", "er") for b in ("sh", "ou", "ti", "ea", "nd")]
    sentence = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    passage = sentence(12)
    good = [sentence(50) for _ in range(12)]
    rows = [(f"d{i:02d}", t) for i, t in enumerate(good)]
    rows += [("d00", good[0]), ("d00", sentence(50)), (None, sentence(50)), ("nul", None), ("emp", ""), ("bad", "12 %% 34"), ("dirty", sentence(40) + " " + passage), ("whole", passage), ("long", "word " + sentence(60_000))]
    schema = "doc_id string, text string, lang string, source string, n_chars long, score int, near_fp int, spans int, bucket int, lang_pred int"
    spark.createDataFrame([(i, t, "en" if k % 2 else None, None, None, 1, 2, 3, 4, 5) for k, (i, t) in enumerate(rows)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns and empty.columns == columns
            seen.append(docs.collect())
    ids = [sorted(str(r.doc_id) for r in some) for some in seen]
    assert len(ids[0]) == len(rows)  # without labels nothing is rejected
    assert sorted(set(ids[0]) - set(ids[1])) == ["bad", "emp", "nul"]
    assert ids[2].count("d00") == 2 and len(ids[2]) == len(ids[1]) - 1
    assert set(ids[2]) - set(ids[3]) == {"whole"}
    assert all(passage not in r.text for r in seen[3])
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in seen[3]}
    assert docs.where("doc_id = 'long'").count() > 50


def test_near_duplicate_stage_leaves_no_join_to_the_planner(spark, tmp_path, monkeypatch):
    plans = {}

    def cut(df, label="cut"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return common.cut(df, label)

    monkeypatch.setattr(simhash, "cut", cut)
    rows = [(i, f"some words of text {i % 30}") for i in range(60)]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert {r.text for r in kept.collect()} <= {t for _, t in rows} and 0 < kept.count() <= 30
    assert all("SortMergeJoin" in plans[x] and "Broadcast" not in plans[x] for x in ("links", "gone"))
