"""Scenarios of a feature lake: small deterministic frames, expected values worked out in plain Python."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import types as T

from aligned_store import schemas as S
from aligned_store.lake import FeatureLake
from aligned_store.operators.asof import as_of_join, tolerance_of
from aligned_store.plans.catalog import FeatureMetadata

DAY = dt.datetime(2024, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def frame(spark, rows, **kinds):
    """rows: (day, symbol, *values)."""
    schema = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("symbol", T.StringType()), *[T.StructField(n, t) for n, t in kinds.items()]])
    return spark.createDataFrame([(None if r[0] is None else day(r[0]), *r[1:]) for r in rows], schema)


def values(df, *names):
    return {((r.timestamp - DAY).days, r.symbol): tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


@pytest.fixture
def lake(spark, tmp_path):
    return FeatureLake(spark, f"file://{tmp_path}/lake", enable_runtime_computed_features=True).initialize()


L, D = T.LongType(), T.DoubleType()


def test_uninitialized_and_keys(spark, tmp_path):
    bare = FeatureLake(spark, f"file://{tmp_path}/none")
    with pytest.raises(S.UninitializedLakeException):
        bare.read(["x"])
    with pytest.raises(ValueError, match="primary sort key"):
        FeatureLake(spark, f"file://{tmp_path}/none", primary_sort_key="when").initialize()
    with pytest.raises(ValueError, match="compression"):
        FeatureLake(spark, f"file://{tmp_path}/none", compression="middle_out")
    assert FeatureLake(spark, f"file://{tmp_path}/none", compression="GZIP").compression == "gzip"


def test_dirty_input_range_and_errors(spark, lake):
    rows = [(0, "a", 1), (0, "a", 9), (1, "a", 2), (None, "a", 3), (2, None, 4), (1, "b", 5)]
    lake.add_features(frame(spark, rows, x=L).coalesce(1))
    assert values(lake.read(["x"]), "x") == {(0, "a"): 1, (1, "a"): 2, (1, "b"): 5}
    assert values(lake.read(["x", "unknown"], start=day(1), end=day(1)), "x") == {(1, "a"): 2, (1, "b"): 5}
    assert lake.read(["x"]).columns == ["x", "timestamp", "symbol"]
    with pytest.raises(S.MissingFeaturesException):
        lake.read(["unknown"])
    with pytest.raises(S.MissingFeaturesException):
        lake.read(["x", "unknown"], strict=True)
    with pytest.raises(S.MissingOrMisregisteredSignalsException):
        lake.read(["x"], targets=["x"])
    with pytest.raises(TypeError):
        lake.read("x")
    with pytest.raises(ValueError, match="no rows"):
        lake.add_features(frame(spark, [(None, "a", 1)], x=L))


@pytest.mark.parametrize("mode", ["copy", "merge"])
def test_overlap_is_a_replacement(spark, lake, mode):
    lake.add_features(frame(spark, [(i, s, i) for i in range(10) for s in "ab"], x=L))
    lake.add_features(frame(spark, [(i, "a", 999) for i in range(5, 8)], x=L), overlap_mode=mode)
    expected = {(i, s): i for i in range(10) for s in "ab"} | {(i, "a"): 999 for i in range(5, 8)} | {(i, "b"): None for i in range(5, 8)}
    assert values(lake.read(["x"]), "x") == expected
    rows = lake.feature_metadata_frame().orderBy("version").collect()
    assert [r.version for r in rows] == [0, 1]
    assert (rows[0].table_addr == rows[1].table_addr) is (mode == "merge")
    old = lake.read(FeatureMetadata(["x"], [0]).get_metadata_frame(lake))
    if mode == "copy":
        assert values(old, "x") == {(i, s): i for i in range(10) for s in "ab"}
    with pytest.raises(ValueError, match="multiple versions"):
        lake.read(lake.feature_metadata_frame())


def test_new_keys_never_replace(spark, lake):
    lake.add_features(frame(spark, [(i, "a", i) for i in range(5)], x=L))
    lake.add_features(frame(spark, [(2, "b", 7)], x=L))
    lake.add_features(frame(spark, [(6, "a", 6)], x=L))
    assert values(lake.read(["x"]), "x") == {(i, "a"): i for i in range(5)} | {(2, "b"): 7, (6, "a"): 6}
    assert lake.feature_metadata_frame().count() == 1


def test_sibling_columns_and_groups(spark, lake):
    lake.add_features(frame(spark, [(i, "a", i, -i) for i in range(4)], x=L, y=L))
    lake.add_features(frame(spark, [(i, "a", 10 * i) for i in range(1, 3)], x=L), overlap_mode="merge")
    lake.add_targets(frame(spark, [(5, "a", 1)], t=L), owner="me")
    got = values(lake.read(["x", "y"], targets=["t"]), "x", "y", "t")
    assert got == {(0, "a"): (0, 0, None), (1, "a"): (10, -1, None), (2, "a"): (20, -2, None), (3, "a"): (3, -3, None), (5, "a"): (None, None, 1)}


def test_group_write_lists_the_staged_files_once(spark, lake):
    lake.add_features(frame(spark, [(i, "a", i) for i in range(4)], x=L))
    addr = lake.feature_metadata_frame().first().table_addr
    paths = lambda target: {f["path"] for f in lake.io.files(target, lake.io.snapshot(target))}
    assert paths(addr) == paths(lake.index)
    # what index and group share is read without a join
    plan = lake.read(["x"], materialized=False)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1


@pytest.mark.parametrize(("params", "observed", "window", "expected"), [({}, {0: 10}, (2, 4), [10, 10, 10]), ({"strategy": "forward"}, {4: 20}, (0, 2), [20, 20, 20]), ({"strategy": "nearest"}, {0: 10, 4: 20}, (3, 3), [20]), ({"tolerance": "1d"}, {0: 10}, (0, 2), [10, 10, None]), ({"allow_exact_matches": False}, {1: 5}, (0, 2), [None, None, 5])])
def test_as_of_reads_context_outside_the_range(spark, lake, params, observed, window, expected):
    lake.add_features(frame(spark, [(i, "a", i) for i in range(5)], x=L))
    lake.add_as_of_features(frame(spark, [(i, "a", v) for i, v in observed.items()], e=L), params)
    got = values(lake.read(["e"], start=day(window[0]), end=day(window[1])), "e")
    assert [got[i, "a"] for i in range(window[0], window[1] + 1)] == expected


def test_as_of_picks_the_row_and_checks_strategy(spark, lake):
    left = frame(spark, [(3, "a", 1)], x=L)
    right = frame(spark, [(1, "a", 5), (2, "a", None)], e=L)
    assert as_of_join(left, right, "timestamp", ["symbol"], ["e"]).first().e is None
    with pytest.raises(ValueError, match="strategy"):
        as_of_join(left, right, "timestamp", ["symbol"], ["e"], strategy="linear")
    assert tolerance_of("1d12h", T.TimestampType()) == 36 * 3600 * 10**6
    with pytest.raises(ValueError, match="tolerance"):
        tolerance_of("soon", T.TimestampType())


@pytest.mark.parametrize("by", [["symbol"], []])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("strategy", ["backward", "forward", "nearest"])
def test_as_of_in_blocks_against_brute_force(spark, strategy, exact, by):
    rng = random.Random(5)
    place = [*([("hot")] * 6), "cold", None]
    left = [(rng.randrange(60), rng.choice(place), i) for i in range(80)]
    # one observation for each day and group, so that no two are equally near on one side
    right = [(d, s, None if (d * 7) % 5 == 0 else d * 10) for d, s in sorted({(rng.randrange(60), rng.choice(place)) for _ in range(25)}, key=str)]
    if not by:
        right = list({r[0]: r for r in right}.values())
    got = {r.x: r.e for r in as_of_join(frame(spark, left, x=L), frame(spark, right, e=L), "timestamp", by, ["e"], strategy, "9d", exact, hot_rows=10).collect()}
    want = {}
    for d, s, x in left:
        known = [(r[0], r[2]) for r in right if (not by or r[1] == s) and abs(r[0] - d) <= 9 and (exact or r[0] != d)]
        known = [k for k in known if strategy == "nearest" or (k[0] <= d if strategy == "backward" else k[0] >= d)]
        want[x] = min(known, key=lambda k: (abs(k[0] - d), -k[0]))[1] if known else None
    assert got == want


def test_as_of_in_blocks_of_one_moment_and_of_nothing(spark):
    left, right = frame(spark, [(1, "a", i) for i in range(30)], x=L), frame(spark, [(1, "a", 7)], e=L)
    assert {r.e for r in as_of_join(left, right, "timestamp", ["symbol"], ["e"], hot_rows=5).collect()} == {7}
    assert {r.e for r in as_of_join(left, right.limit(0), "timestamp", ["symbol"], ["e"], hot_rows=5).collect()} == {None}
    assert as_of_join(left.limit(0), right, "timestamp", ["symbol"], ["e"], hot_rows=5).count() == 0


def test_as_of_upload_keeps_other_observations(spark, lake):
    lake.add_features(frame(spark, [(i, "a", i) for i in range(6)], x=L))
    lake.add_as_of_features(frame(spark, [(0, "a", 1), (2, "a", 2), (4, "a", 3)], e=L), {})
    lake.add_as_of_features(frame(spark, [(2, "a", 20)], e=L), {}, overlap_mode="merge")
    assert [v for _, v in sorted(values(lake.read(["e"]), "e").items())] == [1, 1, 20, 20, 3, 3]


def test_sparse(spark, lake):
    lake.add_features(frame(spark, [(i, s, i) for i in range(4) for s in "ab"], x=L))
    lake.add_sparse_features(frame(spark, [(1, "a", 1.5), (2, "b", 2.5), (3, "a", 3.5)], s=D))
    lake.add_sparse_features(frame(spark, [(1, "a", 9.0), (2, "a", 8.0)], s=D), overlap_mode="merge")
    got = {k: v for k, v in values(lake.read(["s"]), "s").items() if v is not None}
    assert got == {(1, "a"): 9.0, (2, "a"): 8.0, (3, "a"): 3.5}
    addr = lake.feature_metadata_frame().where("feature_name = 's'").orderBy("version").collect()[-1].table_addr
    assert lake.io.scan(addr).count() == 3  # no rows without a value


def test_index_rows_consolidate_and_merge(spark, lake, tmp_path):
    lake.add_features(frame(spark, [(0, "a", 1)], x=L), owner="o")
    lake.add_features(frame(spark, [(1, "a", 2)], y=L), owner="o")
    lake.add_index_rows(frame(spark, [(2, "a"), (0, "a")]))
    expected = {(0, "a"): (1, None), (1, "a"): (None, 2), (2, "a"): (None, None)}
    assert values(lake.read(["x", "y"]), "x", "y") == expected
    assert lake.consolidate_feature_groups(["x", "y"])
    assert values(lake.read(["x", "y"]), "x", "y") == expected
    assert lake.consolidate_feature_groups(["x", "y"]) is None
    with pytest.raises(S.MissingFeaturesException):
        lake.consolidate_feature_groups(["z"])
    other = FeatureLake(spark, f"file://{tmp_path}/other").initialize()
    other.add_features(frame(spark, [(1, "a", 7), (3, "b", 8)], x=L))
    got = values(FeatureLake.merge(lake, other, ["x", "y"], ["x"]), "x", "y", "x_right")
    assert got == {(0, "a"): (1, None, None), (1, "a"): (None, 2, 7), (2, "a"): (None, None, None), (3, "b"): (None, None, 8)}


def test_runtime_features(spark, lake):
    rows = [(0, "a", -2.0), (1, "a", 0.0), (2, "a", 3.0), (3, "a", None), (4, "a", float("nan"))]
    lake.add_features(frame(spark, rows, x=D))
    lake.add_runtime_computed_features({"double": "x * 2", "more": "double + 1", "before": "lag(x) OVER (PARTITION BY symbol ORDER BY timestamp)"})
    out = lake.read(["more", "before"], start=day(1), end=day(2))
    assert out.columns == ["more", "before", "double", "x", "timestamp", "symbol"] or set(out.columns) == {"more", "before", "double", "x", "timestamp", "symbol"}
    assert values(out, "more", "before") == {(1, "a"): (1.0, None), (2, "a"): (7.0, 0.0)}
    lake.add_runtime_transforms(["x"], ["nan", "negative", "reciprocal", "missing"])
    got = values(lake.read(["x__nan", "x__negative", "x__reciprocal", "x__missing"]), "x__nan", "x__negative", "x__reciprocal", "x__missing")
    assert got[0, "a"] == (False, 2.0, -0.5, False)
    assert got[1, "a"] == (False, 0.0, None, False)
    assert got[3, "a"] == (None, None, None, True)
    with pytest.raises(ValueError, match="already"):
        lake.add_runtime_computed_features({"double": "x"})
    with pytest.raises(S.MissingFeaturesException):
        lake.add_runtime_computed_features({"odd": "nothing + 1"})
    with pytest.raises(ValueError, match="unknown transforms"):
        lake.add_runtime_transforms(["x"], ["cube"])
    closed = FeatureLake(spark, lake.base_path)
    with pytest.raises(ValueError, match="not enabled"):
        closed.read(["double"])


def test_failed_write_rolls_back(spark, lake):
    lake.add_features(frame(spark, [(0, "a", 1)], x=L))

    def broken(*_):
        raise OSError("disk is gone")

    kept, lake._extend_index = lake._extend_index, broken
    with pytest.raises(OSError, match="gone"):
        lake.add_features(frame(spark, [(0, "a", 5), (1, "a", 2)], x=L), overlap_mode="merge")
    lake._extend_index = kept
    assert values(lake.read(["x"]), "x") == {(0, "a"): 1}
    log = lake.transaction_log_frame().orderBy("updated_at").collect()
    assert [r.status for r in log] == ["pending", "success", "pending", "failed", "rolled_back"]
    assert "disk is gone" in log[3].error


def test_restore_and_annotations(spark, lake):
    lake.add_features(frame(spark, [(0, "a", 1)], x=L))
    good = dt.datetime.now(dt.UTC)
    time.sleep(0.01)
    lake.add_features(frame(spark, [(0, "a", 5), (1, "a", 6)], x=L), overlap_mode="merge")
    lake.restore_to_timestamp(good)
    assert values(lake.read(["x"]), "x") == {(0, "a"): 1}
    with pytest.raises(ValueError, match="time zone"):
        lake.restore_to_timestamp(dt.datetime(2024, 1, 1))
    m = lake.feature_metadata_frame()
    lake.annotate(spark.createDataFrame([(*r, "good", ["a", "b"]) for r in m.collect()], S.ANNOTATIONS))
    r = lake.describe(m).first()
    assert (r.comment, r.tags) == ("good", ["a", "b"])
    with pytest.raises(ValueError, match="schema"):
        lake.annotate(m)


def test_ranges_prune_files_and_filters_reach_the_scan(spark, lake):
    lake.add_features(frame(spark, [(i, "a", i) for i in range(3)], x=L))
    lake.add_features(frame(spark, [(i, "a", i) for i in range(10, 13)], x=L))
    read = lake.read(["x"], start=day(11), materialized=False)
    assert len(read.inputFiles()) < len(lake.read(["x"], materialized=False).inputFiles())
    plan = lake.read(["x"], materialized=False).where("symbol = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(symbol,b)" in plan


def test_merge_delta_interface(spark, lake):
    io = lake.io
    io.write(frame(spark, [(0, "a", 1), (1, "a", 2)], x=L), "t", stats=["timestamp"])
    io.merge(frame(spark, [(1, "a", 20), (2, "a", 30)], x=L), "t", ["timestamp", "symbol"])
    assert values(io.scan("t"), "x") == {(0, "a"): 1, (1, "a"): 20, (2, "a"): 30}
    io.merge(frame(spark, [(0, "a", 7), (2, "a", 8)], x=L), "t", ["timestamp", "symbol"], matched_predicate="target.x > 10", when_matched_update={"x": "source.x + target.x"})
    assert values(io.scan("t"), "x") == {(0, "a"): 1, (1, "a"): 20, (2, "a"): 38}
    assert values(io.scan("t", version=0), "x") == {(0, "a"): 1, (1, "a"): 2}


def test_integer_key_and_secondary_first(spark, tmp_path):
    kind = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("n", T.LongType())])
    lake = FeatureLake(spark, f"file://{tmp_path}/n", primary_sort_key="n").initialize(kind)
    lake.add_features(spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "symbol string, n long, x double"))
    assert [(r.x, r.symbol, r.n) for r in lake.read(["x"], start=2).collect()] == [(2.0, "b", 2)]


def test_stream(spark, lake, tmp_path):
    from aligned_store.streaming.ingest import stream_features

    frame(spark, [(i, "a", i) for i in range(3)], x=L).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame(spark, [], x=L).schema).parquet(f"{tmp_path}/in")
    stream_features(lake, stream, f"{tmp_path}/check").awaitTermination(120)
    assert values(lake.read(["x"]), "x") == {(i, "a"): i for i in range(3)}


def test_widening_and_refused_types(spark, lake):
    I = T.IntegerType()  # noqa: E741
    lake.add_features(frame(spark, [(0, "a", 1, 1), (1, "a", 2, 2)], x=L, y=I))
    lake.add_features(frame(spark, [(2, "a", 2.7)], x=D))
    assert values(lake.read(["x"]), "x") == {(0, "a"): 1.0, (1, "a"): 2.0, (2, "a"): 2.7}
    lake.add_features(frame(spark, [(3, "a", 7)], x=L))
    assert values(lake.read(["x"]), "x")[3, "a"] == 7.0
    lake.add_features(frame(spark, [(4, "a", 2**40)], y=L))
    got = values(lake.read(["x", "y"]), "x", "y")
    assert got[0, "a"] == (1.0, 1) and got[4, "a"] == (None, 2**40) and got[3, "a"] == (7.0, None)
    lake.add_features(frame(spark, [(0, "a", 0.5), (1, "a", 1.5)], y=D), overlap_mode="merge")
    assert values(lake.read(["y"]), "y") == {(0, "a"): 0.5, (1, "a"): 1.5, (2, "a"): None, (3, "a"): None, (4, "a"): float(2**40)}
    with pytest.raises(TypeError, match="x is double"):
        lake.add_features(frame(spark, [(9, "a", "text")], x=T.StringType()))
    assert (9, "a") not in values(lake.read(["x"]), "x")


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
@pytest.mark.parametrize("kind", [T.TimestampType(), T.TimestampNTZType(), T.DateType()])
def test_ranges_keep_their_rows_in_any_zone(spark, tmp_path, monkeypatch, zone, kind):
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        lake = FeatureLake(spark, f"file://{tmp_path}/z", primary_sort_key="t").initialize(T.StructType([T.StructField("t", kind)]))
        naive = [dt.datetime(2024, 3, 10, 2) + dt.timedelta(hours=h) for h in (0, 1, 30, 60)]
        times = [x.date() if isinstance(kind, T.DateType) else x.replace(tzinfo=dt.UTC) if isinstance(kind, T.TimestampType) else x for x in naive]
        for i, t in enumerate(dict.fromkeys(times)):
            lake.add_features(spark.createDataFrame([(t, i)], T.StructType([T.StructField("t", kind), T.StructField("x", L)])))
        everything = lake.read(["x"]).collect()
        assert len(everything) == len(set(times))
        for low, high in ((times[0], times[0]), (times[1], times[2]), (times[2], times[3])):
            bounds = [(low, high)]
            if isinstance(kind, T.TimestampType):
                bounds += [(low.astimezone().replace(tzinfo=None), high.astimezone(dt.timezone(dt.timedelta(hours=5))))]
            want = [i for i, t in enumerate(dict.fromkeys(times)) if low <= t <= high]
            for a, b in bounds:
                assert sorted(r.x for r in lake.read(["x"], start=a, end=b, materialized=False).collect()) == want
        if not isinstance(kind, T.TimestampType):
            assert [r.x for r in lake.read(["x"], start=str(times[-1])).collect()] == [len(set(times)) - 1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        monkeypatch.setenv("TZ", "UTC")
        time.tzset()


def test_many_commits_stay_small(spark, lake, tmp_path):
    io = lake.io
    files = lambda n: [{"path": f"_data/f{n}/part-0", "bytes": 1, "of": 1, "rows": 1, "min": {"n": n}, "max": {"n": n}}]
    kind = T.StructType([T.StructField("n", L)])
    for n in range(300):
        io.commit("many", files(n), kind, "append")
    sizes = [(tmp_path / "lake/many/_log" / f"{v:020d}.json").stat().st_size for v in (100, 200, 299)]
    assert max(sizes) < 20_000
    c = io.snapshot("many")
    assert [f["path"] for f in io.files("many", c)] == [f"_data/f{n}/part-0" for n in range(300)]
    assert [f["min"]["n"] for f in io.files("many", c, {"n": (7, 9)})] == [7, 8, 9]
    assert len(io.files("many", io.snapshot("many", version=123))) == 124
    assert io.snapshot("many", timestamp=dt.datetime.fromtimestamp(io.snapshot("many", version=50).timestamp_us / 1e6, dt.UTC)).version in (49, 50)
    io.restore_to_version("many", 10)
    assert len(io.files("many", io.snapshot("many"))) == 11 and io.version("many") == 300
    io.commit("many", [f for n in range(5000) for f in files(n)], kind, "overwrite", "overwrite")
    io.commit("many", files(5000), kind, "append")
    c = io.snapshot("many")
    assert len(c.manifests) == 3 and [f["min"]["n"] for f in io.files("many", c)] == list(range(5001))


def test_file_sizes_compaction_and_vacuum(spark, tmp_path):
    lake = FeatureLake(spark, f"file://{tmp_path}/s", target_file_size=64 << 10).initialize()
    rng = random.Random(3)
    lake.add_features(frame(spark, [(i % 900, f"s{i}", rng.random()) for i in range(20_000)], x=D))
    addr = lake.feature_metadata_frame().first().table_addr
    big = lake.io.files(addr, lake.io.snapshot(addr))
    assert len(big) >= 3 and max(f["bytes"] for f in big) < 1.2 * (64 << 10)
    for i in range(6):
        lake.add_features(frame(spark, [(1000 + i, "a", i * 1.0)], x=D))
    want = values(lake.read(["x"]), "x")
    done = lake.compact()
    assert done[addr] >= 6 and len(lake.io.files(addr, lake.io.snapshot(addr))) < len(big) + 6
    assert len(lake.io.files(lake.transaction_log, lake.io.snapshot(lake.transaction_log))) == 1
    assert values(lake.read(["x"]), "x") == want
    # index and group share the joined files too
    assert "Join" not in lake.read(["x"], materialized=False)._jdf.queryExecution().executedPlan().toString()
    assert lake.io.vacuum(dt.datetime.now(dt.UTC) + dt.timedelta(hours=1)) > 0
    assert values(lake.read(["x"]), "x") == want


def test_arrow_and_pandas_input(spark, tmp_path):
    import pyarrow as pa

    kind = pa.schema([("timestamp", pa.timestamp("us", "UTC")), ("symbol", pa.string())])
    lake = FeatureLake(spark, f"file://{tmp_path}/a").initialize(kind)
    table = pa.table({"timestamp": pa.array([day(0), day(1)], kind.field(0).type), "symbol": ["a", "b"], "x": [1, 2]})
    lake.add_features(table)
    lake.add_features(table.slice(1).to_batches()[0], overlap_mode="merge")
    lake.add_index_rows(table.select(["timestamp", "symbol"]).slice(0, 1).to_pandas())
    assert values(lake.read(["x"]), "x") == {(0, "a"): 1, (1, "b"): 2}
    with pytest.raises(TypeError, match="Arrow"):
        lake.add_features([1, 2])
    with pytest.raises(ValueError, match="table_addr"):
        lake.add_features(table, metadata=spark.range(1))
    with pytest.raises(ValueError, match="sort key"):
        lake.feature_metadata_frame(start=day(0))
    assert lake.read(["x"], modifier=lambda df: df.where("x = 2")).count() == 1


def test_arrow_tables_that_tasks_make(spark, lake):
    import pyarrow as pa
    import pyarrow.compute as pc

    from aligned_store.sources.shared import arrow_frame

    def make(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            when = t["timestamp"].cast(pa.timestamp("ns", "UTC"))
            yield pa.table({"x": pc.cast(t["x"], pa.int32()), "symbol": t["symbol"], "more": t["x"], "timestamp": when})
            yield b.slice(0, 0)

    df = frame(spark, [(i, s, i if i % 7 else None) for i in range(200) for s in "ab"], x=L).repartition(5)
    lake.add_features(arrow_frame(df, make, df.schema))
    assert values(lake.read(["x"]), "x") == {(i, s): i if i % 7 else None for i in range(200) for s in "ab"}


def test_the_arrow_query_uploads_all_events_past_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from aligned_store.queries import oracle_sql, q33_arrow_upload

    assert oracle_sql()["q33_arrow_upload"] == "SELECT ts, user_id, value FROM events"
    rows = [(dt.datetime(2024, 1, 1, k % 24, microsecond=k), k, "click", None if k % 9 == 0 else k / 4) for k in range(500)]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("all rows come to the driver"))
    got = q33_arrow_upload(spark, f"file://{tmp_path}").collect()
    assert {(r.ts, r.user_id, r.value) for r in got} == {(t, u, v) for t, u, _, v in rows} and len(got) == len(rows)


def paths(lake, target):
    return {f["path"] for f in lake.io.files(target, lake.io.snapshot(target))}


def many_files(spark, lake, name, add=None, n=5):
    """A table of n files of ten days each."""
    add = add or lake.add_features
    for k in range(n):
        add(frame(spark, [(10 * k + i, "a", 10 * k + i) for i in range(10)], **{name: L}).coalesce(1))
    addr = next(r.table_addr for r in lake.feature_metadata_frame().collect() if r.feature_name == name)
    return addr, paths(lake, addr)


@pytest.mark.parametrize("mode", ["copy", "merge"])
def test_an_overlap_rewrites_only_border_files(spark, lake, mode):
    addr, before = many_files(spark, lake, "x")
    # days 18 to 41: all of the files of days 20 to 39, parts of two others
    lake.add_features(frame(spark, [(18, "a", -1), (30, "a", -2), (41, "a", -3)], x=L).coalesce(1), overlap_mode=mode)
    new = max(lake.feature_metadata_frame().collect(), key=lambda r: r.version).table_addr
    assert (new == addr) is (mode == "merge")
    after = paths(lake, new)
    assert len(before & after) == 1  # that of days 0 to 9; the last but one is cut at 41, the second at 18
    want = {(i, "a"): i if i < 18 or i > 41 else {18: -1, 30: -2, 41: -3}.get(i) for i in range(50)}
    assert values(lake.read(["x"]), "x") == want
    # of the stored rows those in the range are the upload's alone
    assert lake.io.scan(new).count() == 50 - 24 + 3
    if mode == "copy":
        assert paths(lake, addr) == before
        assert values(lake.read(FeatureMetadata(["x"], [0]).get_metadata_frame(lake)), "x") == {(i, "a"): i for i in range(50)}


def test_three_rows_rewrite_one_file(spark, lake):
    _, before = many_files(spark, lake, "x")
    lake.add_features(frame(spark, [(i, "a", -i) for i in (22, 23, 24)], x=L).coalesce(1), overlap_mode="merge")
    addr = lake.feature_metadata_frame().first().table_addr
    assert len(before & paths(lake, addr)) == 4
    assert values(lake.read(["x"]), "x") == {(i, "a"): -i if 22 <= i <= 24 else i for i in range(50)}


def test_an_overlap_with_siblings_keeps_their_files_outside(spark, lake):
    for k in range(4):
        lake.add_features(frame(spark, [(10 * k + i, "a", i, -i) for i in range(10)], x=L, y=L).coalesce(1))
    addr = lake.feature_metadata_frame().first().table_addr
    before = paths(lake, addr)
    lake.add_features(frame(spark, [(12, "a", 7), (14, "a", 8)], x=L), overlap_mode="merge")
    assert len(before & paths(lake, addr)) == 3
    got = values(lake.read(["x", "y"]), "x", "y")
    assert got[12, "a"] == (7, -2) and got[13, "a"] == (None, -3) and got[14, "a"] == (8, -4) and got[15, "a"] == (5, -5)


def test_as_of_uploads_rewrite_files_that_hold_their_keys(spark, lake):
    lake.add_features(frame(spark, [(i, "a", i) for i in range(50)], i=L))
    addr, before = many_files(spark, lake, "e", lambda df: lake.add_as_of_features(df, {}, overlap_mode="merge"))
    # between the first and the last key lie files that hold none of the three
    lake.add_as_of_features(frame(spark, [(3, "a", -3), (44, "a", -44)], e=L), {}, overlap_mode="merge")
    now = max(lake.feature_metadata_frame().where("feature_name = 'e'").collect(), key=lambda r: r.version).table_addr
    assert now == addr and len(before & paths(lake, addr)) == 3
    assert values(lake.read(["e"]), "e") == {(i, "a"): -i if i in (3, 44) else i for i in range(50)}


def test_sparse_overlaps_store_no_empty_rows(spark, lake):
    lake.add_features(frame(spark, [(i, "a", i) for i in range(50)], i=L))
    addr, before = many_files(spark, lake, "s", lake.add_sparse_features)
    lake.add_sparse_features(frame(spark, [(3, "a", None), (4, "a", 40), (12, "a", 12)], s=L), overlap_mode="copy")
    now = max(lake.feature_metadata_frame().where("feature_name = 's'").collect(), key=lambda r: r.version).table_addr
    assert len(before & paths(lake, now)) == 3 and lake.io.scan(now).where("s is null").isEmpty()
    want = {(i, "a"): i if i < 3 or i > 12 else {4: 40, 12: 12}.get(i) for i in range(50)}
    assert values(lake.read(["s"]), "s") == want


def test_upserts_rewrite_files_with_matches(spark, lake):
    io = lake.io
    for k in range(5):
        io.write(frame(spark, [(10 * k + i, "a", 10 * k + i) for i in range(10)], x=L).coalesce(1), "t", stats=["timestamp"])
    before = paths(lake, "t")
    io.merge(frame(spark, [(3, "a", 100), (33, "a", 1), (33, "b", 2), (99, "a", 3)], x=L), "t", ["timestamp", "symbol"], matched_predicate="source.x > target.x", stats=["timestamp"])
    assert len(before & paths(lake, "t")) == 4  # the match of day 33 is no update
    assert values(io.scan("t"), "x") == {(i, "a"): i for i in range(50)} | {(3, "a"): 100, (33, "b"): 2, (99, "a"): 3}
    io.merge(frame(spark, [], x=L), "t", ["timestamp", "symbol"])
    assert io.scan("t").count() == 52


def test_an_upsert_never_multiplies_rows(spark, lake):
    io = lake.io
    io.write(frame(spark, [(0, "a", 1), (0, "a", 5), (1, "a", 2)], x=L).coalesce(1), "t", stats=["timestamp"])
    rows = frame(spark, [(0, "a", 3), (0, "a", 0), (9, "a", 4), (9, "a", 4)], x=L)
    got = lambda: sorted((r.timestamp, r.x) for r in io.scan("t").collect())
    with pytest.raises(ValueError, match="several rows"):
        io.merge(rows, "t", ["timestamp", "symbol"])
    with pytest.raises(ValueError, match="several rows"):  # no statistics to count by
        io.merge(rows, "t", ["timestamp", "symbol"], matched_predicate="target.x > 4")
    assert got() == [(day(0), 1), (day(0), 5), (day(1), 2)]
    # one of both matches is an update
    io.merge(rows, "t", ["timestamp", "symbol"], matched_predicate="source.x > target.x", stats=["timestamp"])
    assert got() == [(day(0), 3), (day(0), 5), (day(1), 2), (day(9), 4), (day(9), 4)]


def test_the_upsert_query_on_events_of_one_user_and_time(spark, tmp_path):
    from aligned_store.queries import q31_upsert

    at = [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 10)]
    rows = [(t, u, "click", v) for t in at for u in (1, 3) for v in (60.0, 60.0, 70.0, 40.0, float("inf"), None)]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    want = [(t, u, 0.0 if u == 1 and t == at[1] and (v or 0) > 50 else v if u == 1 else v and -v) for t, u, _, v in rows if u == 1 or t == at[1]]
    order = lambda x: (*x[:2], x[2] is None, x[2] or 0)
    assert sorted([tuple(r) for r in q31_upsert(spark, f"file://{tmp_path}").collect()], key=order) == sorted(want, key=order)


def test_swaps_of_long_lists_keep_manifests(spark, lake):
    io = lake.io
    kind = T.StructType([T.StructField("n", L)])
    file = lambda n: {"path": f"_data/f{n}/part-0", "bytes": 1, "of": 1, "rows": 1, "min": {"n": n}, "max": {"n": n}}
    for at in (0, 1000, 2000):
        io.commit("long", [file(n) for n in range(at, at + 1000)], kind, "append")
    old = io.snapshot("long")
    io.swap("long", "copy", [file(1500)], [file(5000)], kind, "overlap")
    new = io.snapshot("copy")
    assert {m["name"] for m in old.manifests} - {m["name"] for m in new.manifests} == {old.manifests[1]["name"]}
    assert {f["min"]["n"] for f in io.files("copy", new)} == set(range(3000)) - {1500} | {5000}
    assert len(io.files("long", io.snapshot("long"))) == 3000
    io.commit("copy", [file(n) for n in range(6000, 6100)], kind, "append")
    assert len(io.files("copy", io.snapshot("copy"))) == 3100


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("materialized", [True, False])
def test_any_number_of_groups_meet_in_one_exchange(spark, lake, monkeypatch, materialized):
    rng = random.Random(9)
    want = {}
    for g in range(5):
        rows = [(i, s, rng.randrange(100), None if i % 3 else f"t{i}") for i in range(30) for s in "ab" if rng.random() < 0.7]
        lake.add_features(frame(spark, rows, **{f"x{g}": L, f"t{g}": T.StringType()}))
        for i, s, x, t in rows:
            want.setdefault((i, s), {}).update({f"x{g}": x, f"t{g}": t})
    lake.add_sparse_features(frame(spark, [(3, "a", 1), (99, "a", 2)], s=L))
    want.setdefault((3, "a"), {})["s"] = 1
    want[99, "a"] = {"s": 2}
    names = [f"{c}{g}" for g in range(5) for c in "xt"] + ["s"]
    want = {k: tuple(v.get(n) for n in names) for k, v in want.items()}
    assert values(lake.read(names, materialized=materialized), *names) == want  # few rows: sent to the index
    monkeypatch.setattr("aligned_store.lake.FEW_ROWS", 0)
    df = lake.read(names, materialized=materialized)
    assert "Join" not in plan_of(df) and plan_of(df).count("Exchange ") == 1
    assert values(df, *names) == want
    if materialized:
        assert [(r.timestamp, r.symbol) for r in df.collect()] == sorted((day(i), s) for i, s in want)
    part = lake.read(names, start=day(4), end=day(6), where={"symbol": ["b"]}, materialized=materialized)
    assert values(part, *names) == {k: v for k, v in want.items() if 4 <= k[0] <= 6 and k[1] == "b"}


def test_keys_are_deduplicated_in_the_range_exchange(spark, lake):
    from aligned_store.operators.deltas import preprocess

    df = frame(spark, [(i % 7, "a", i) for i in range(50)], x=L).coalesce(1)
    clean = preprocess(df, ["timestamp", "symbol"])
    assert plan_of(clean).count("Exchange ") == 1 and "rangepartitioning" in plan_of(clean)
    assert values(clean, "x") == {(i, "a"): i for i in range(7)}


def test_reads_of_a_secondary_key_open_few_files(spark, tmp_path):
    lake = FeatureLake(spark, f"file://{tmp_path}/z", target_file_size=8 << 10).initialize()
    rng = random.Random(4)
    rows = [(i % 365, f"s{i % 64:02d}", rng.random()) for i in range(12_000)]
    want = {(i, s): x for i, s, x in reversed(rows)}
    lake.add_features(frame(spark, rows, x=D))
    lake.compact(["x"], by=["timestamp", "symbol"])
    everything = lake.read(["x"], materialized=False)
    n = len(everything.inputFiles())
    one = lake.read(["x"], where={"symbol": ["s07"]}, materialized=False)
    month = lake.read(["x"], start=day(30), end=day(40), materialized=False)
    assert n >= 9 and len(one.inputFiles()) <= n / 2 and len(month.inputFiles()) <= n / 2
    assert values(one, "x") == {k: v for k, v in want.items() if k[1] == "s07"}
    assert values(month, "x") == {k: v for k, v in want.items() if 30 <= k[0] <= 40}
    lake.compact(["x"], by=["symbol"])
    two = lake.read(["x"], where={"symbol": ["s07", "s50"]}, materialized=False)
    assert len(everything.inputFiles()) >= 9 and len(two.inputFiles()) <= 4
    assert values(two, "x") == {k: v for k, v in want.items() if k[1] in ("s07", "s50")}
    assert values(lake.read(["x"]), "x") == want
    for wrong in ({"timestamp": [day(1)]}, {"x": [1.0]}):
        with pytest.raises(ValueError, match="secondary"):
            lake.read(["x"], where=wrong)
    with pytest.raises(ValueError, match="sort keys"):
        lake.compact(["x"], by=["x"])


def test_places_among_cuts(spark):
    from pyspark.sql import functions as F

    from aligned_store.operators.layout import at_most

    cuts = [1, 1, 4, 9]
    df = spark.createDataFrame([(v,) for v in (None, 0, 1, 3, 4, 8, 9, 99)], "v int")
    got = [r[0] for r in df.select(at_most(F.array(*map(F.lit, cuts)), F.col("v"), 3)).collect()]
    assert got == [0, 0, 2, 2, 3, 3, 4, 4]


def test_reads_fetch_the_metadata_of_what_is_asked_for(spark, lake):
    from aligned_store.plans.catalog import latest_per_feature

    lake.add_features(frame(spark, [(0, "a", 1, 2, 3)], x=L, y=L, z=L))
    of = {n: next(r for r in lake.feature_metadata_frame().collect() if r.feature_name == n) for n in "xyz"}
    old = spark.range(2000).selectExpr("concat('f', id) AS feature_name", "explode(sequence(0L, 9L)) AS version", "'t' AS table_addr", "'o' AS owner", "'feature' AS signal_type", "CAST(NULL AS STRING) AS feature_params")
    lake.io.write(old, lake.feature_metadata)
    found = latest_per_feature(lake.feature_metadata_frame(), ["x", "y", "z", "f7", "nothing"])
    assert {n: found[n] for n in "xyz"} == of and found["f7"].version == 9 and set(found) == {*"xyz", "f7"}
    assert len(latest_per_feature(lake.feature_metadata_frame(), [f"f{i}" for i in range(900)])) == 900
    assert values(lake.read(["x", "z"]), "x", "z") == {(0, "a"): (1, 3)}
    assert values(lake.read(FeatureMetadata(["z"], [0]).get_metadata_frame(lake)), "z") == {(0, "a"): 3}


def test_readers_see_an_upload_whole_or_not_at_all(spark, lake):
    lake.add_features(frame(spark, [(0, "a", 1), (1, "a", 2)], x=L))
    reader, seen = FeatureLake(spark, lake.base_path), []
    publish = lake.io.publish

    def between_commits(targets):  # data, index and metadata tables are written, but not shown
        seen.append((values(reader.read(["x"]), "x"), reader.feature_metadata_frame().count(), reader.index_frame().count()))
        publish(targets)

    lake.io.publish = between_commits
    lake.add_features(frame(spark, [(1, "a", 20, 0), (2, "a", 30, 0)], x=L, y=L), overlap_mode="merge")
    assert seen == [({(0, "a"): 1, (1, "a"): 2}, 1, 2)]
    assert values(reader.read(["x", "y"]), "x", "y") == {(0, "a"): (1, None), (1, "a"): (20, 0), (2, "a"): (30, 0)}


def test_a_writer_that_is_killed_leaves_nothing_to_see(spark, lake):
    lake.add_features(frame(spark, [(0, "a", 1), (1, "a", 2)], x=L))
    before = dt.datetime.now(dt.UTC)

    class Killed(BaseException):
        pass

    doomed = FeatureLake(spark, lake.base_path)

    def die(*_):
        raise Killed

    doomed.io.publish, doomed.io.undo = die, lambda before: None
    with pytest.raises(Killed):
        doomed.add_features(frame(spark, [(0, "a", -1), (5, "a", -5)], x=L), overlap_mode="merge")
    for one in (lake, FeatureLake(spark, lake.base_path)):
        assert values(one.read(["x"]), "x") == {(0, "a"): 1, (1, "a"): 2}
    lake.add_features(frame(spark, [(1, "a", 3), (2, "a", 4)], x=L), overlap_mode="merge")
    want = {(0, "a"): 1, (1, "a"): 3, (2, "a"): 4}
    assert values(FeatureLake(spark, lake.base_path).read(["x"]), "x") == want
    assert lake.io.vacuum(dt.datetime.now(dt.UTC) + dt.timedelta(hours=1)) >= 0
    assert values(lake.read(["x"]), "x") == want
    lake.restore_to_timestamp(before)
    assert values(FeatureLake(spark, lake.base_path).read(["x"]), "x") == {(0, "a"): 1, (1, "a"): 2}


def test_writers_at_one_time_build_on_each_other(spark, lake):
    from concurrent.futures import ThreadPoolExecutor

    lake.add_features(frame(spark, [(0, "a", 0)], x=L))

    def write(k):
        FeatureLake(spark, lake.base_path).add_features(frame(spark, [(k, "a", k)], **{f"y{k}": L}))

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, [1, 2, 3]))
    got = values(lake.read(["x", "y1", "y2", "y3"]), "x", "y1", "y2", "y3")
    assert got == {(0, "a"): (0, None, None, None), (1, "a"): (None, 1, None, None), (2, "a"): (None, None, 2, None), (3, "a"): (None, None, None, 3)}
    assert lake.transaction_log_frame().where("status = 'success'").count() == 4


def test_commits_of_the_lake_name_all_tables_now_and_then(spark, lake, monkeypatch):
    monkeypatch.setattr("aligned_store.sources.table_io.WHOLE", 3)
    for i in range(5):
        lake.add_index_rows(frame(spark, [(i, "a")]))
    fresh = FeatureLake(spark, lake.base_path)
    assert fresh.index_frame().count() == 5
    assert fresh.io.view.keys() == {lake.index, lake.feature_metadata, lake.table_metadata}
    assert fresh.io._lake(3) == lake.io._lake(3) and fresh.io.seen == 5


@pytest.mark.parametrize("strategy", ["backward", "forward"])
def test_as_of_of_text_keys_in_blocks(spark, strategy):
    rng = random.Random(8)
    name = lambda d: f"k{d:03d}"
    left = [(name(rng.randrange(80)), rng.choice(["hot", "hot", "hot", None, "cold"]), i) for i in range(400)]
    right = [(name(d), s, d) for d in range(0, 80, 3) for s in ("hot", None)]
    make = lambda rows, v: spark.createDataFrame(rows, f"p string, g string, {v} long")
    joined = as_of_join(make(left, "x"), make(right, "e"), "p", ["g"], ["e"], strategy, hot_rows=50)
    want = {}
    for p, g, x in left:
        known = [r for r in right if r[1] == g and (r[0] <= p if strategy == "backward" else r[0] >= p)]
        want[x] = (max if strategy == "backward" else min)(known)[2] if known else None
    assert {r.x: r.e for r in joined.collect()} == want
    from aligned_store.operators.asof import blocks

    both = make(left, "x").selectExpr("g", "p", "struct(x) AS _right", "true AS _left")
    cut = blocks(both, "p", ["g"], T.StringType(), 50).where("g = 'hot'").groupBy("_block").count().collect()
    assert len(cut) > 20


@pytest.mark.parametrize("kind", ["doubles", "texts", "arrays"])
def test_files_come_to_the_target_size_compressed(spark, tmp_path, kind):
    target = 96 << 10
    lake = FeatureLake(spark, f"file://{tmp_path}/s", target_file_size=target).initialize()
    value = {"doubles": [f"rand({k}) AS d{k}" for k in range(12)], "texts": ["array_join(transform(sequence(1, 30), i -> sha2(cast(id * 31 + i AS STRING), 256)), ' ') AS t"], "arrays": ["transform(sequence(1, 40), i -> rand(5)) AS a"]}[kind]
    rows = 12_000 if kind == "doubles" else 1_500 if kind == "texts" else 5_000
    df = spark.range(0, rows, 1, 1).selectExpr("timestamp_seconds(1704067200 + id) AS timestamp", "'s' AS symbol", *value)
    lake.add_features(df)
    addr = lake.feature_metadata_frame().first().table_addr
    sizes = sorted(f["bytes"] for f in lake.io.files(addr, lake.io.snapshot(addr)))
    whole = [s for s in sizes if s > 0.5 * target]  # a task's last file may be smaller
    assert len(whole) >= 5 and len(sizes) - len(whole) <= 4 and sizes[-1] < 1.5 * target


def test_jobs_are_described(spark, lake):
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def told(since):
        jobs = [store.jobsList(None).apply(i) for i in range(store.jobsList(None).size())]
        return {j.description().get() if j.description().isDefined() else None for j in jobs if j.jobId() > since}

    last = lambda: max((store.jobsList(None).apply(i).jobId() for i in range(store.jobsList(None).size())), default=-1)
    since = last()
    lake.add_features(frame(spark, [(0, "a", 1)], x=L))
    assert told(since) == {f"add_features on {lake.base_path}"}
    sc.setLocalProperty("spark.job.description", "nightly")
    try:
        since = last()
        lake.add_features(frame(spark, [(1, "a", 2)], x=L))
        assert told(since) == {f"nightly > add_features on {lake.base_path}"}
        with pytest.raises(S.MissingFeaturesException):
            lake.read(["unknown"])
        assert sc.getLocalProperty("spark.job.description") == "nightly"
    finally:
        sc.setLocalProperty("spark.job.description", None)
