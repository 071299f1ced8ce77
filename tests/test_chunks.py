"""Chunked operators equal brute force, whatever the chunk size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.functions.vectors import one_decimal, pct
from motionlake.operators import chunks
from motionlake.schema import EP
from motionlake.sources import driver_tables
from tests import twins

SCHEMA = "dataset_id string, task_index long, episode_index long, frame_index long, x double"


def series(spark, lengths, seed=0, values=None):
    rng = np.random.default_rng(seed)
    data = {e: (values(rng, n) if values else rng.normal(size=n)) for e, n in enumerate(lengths)}
    return data, spark.createDataFrame([("d", 0, e, f, float(x)) for e, v in data.items() for f, x in enumerate(v)], SCHEMA)


@pytest.mark.parametrize("size", [5, 64, 4096])
def test_scan_is_a_running_value(spark, size):
    data, df = series(spark, [1, 7, 130])
    out = chunks.scan(df, EP, chunks.chunk_of("frame_index", size), "frame_index", exclusive=["before"], total=("sum", F.col("x")), top=("max", F.col("x")), before=("min", F.col("x")))
    for r in out.collect():
        v = data[r.episode_index][:r.frame_index + 1]
        assert r.total == pytest.approx(v.sum()) and r.top == v.max()
        assert r.before == (v[:-1].min() if len(v) > 1 else None)


def test_scan_skips_nulls(spark):
    _, df = series(spark, [20])
    out = chunks.scan(df, EP, chunks.chunk_of("frame_index", 4), "frame_index", last=("max", F.when(F.col("frame_index") % 9 == 5, F.col("frame_index"))))
    for r in out.collect():
        assert r.last == max([f for f in range(r.frame_index + 1) if f % 9 == 5], default=None)


@pytest.mark.parametrize("values", [None, lambda rng, n: rng.integers(-2, 3, n).astype(float), lambda rng, n: np.full(n, 1e6) + rng.normal(size=n), lambda rng, n: np.zeros(n)])
def test_percentiles_are_exact(spark, values):
    data, df = series(spark, [1, 2, 3, 10, 501], values=values)
    out = chunks.order_stats(df, EP, "x", {f"p{p}": pct(p) for p in (0, 20, 50, 95, 100)})
    rows = out.collect()
    assert len(rows) == 5
    for r in rows:
        v = data[r.episode_index]
        assert r.n == len(v)
        for p in (0, 20, 50, 95, 100):
            assert r[f"p{p}"] == pytest.approx(np.percentile(v, p), abs=1e-9)


def test_value_bucket_is_monotone(spark):
    v = np.concatenate([[-1e300, -5.0, -1e-300, 0.0, 1e-300, 1e300], np.random.default_rng(0).normal(size=200)])
    rows = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", chunks.value_bucket("v").alias("b")).orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)


@pytest.mark.parametrize("size", [6, 4096])
@pytest.mark.parametrize("share", [0.3, 0.7, 0.97, 1.0])
def test_runs(spark, size, share):
    data, df = series(spark, [1, 40, 90], values=lambda rng, n: (rng.random(n) < share).astype(float))
    got = {(r.episode_index, r.start, r.end) for r in chunks.runs(df, F.col("x") > 0, size=size).collect()}
    assert got == {(e, a, b) for e, v in data.items() for a, b in twins.run_list(v > 0)}


@pytest.mark.parametrize("k", [2, 3, 5])
@pytest.mark.parametrize("size", [7, 16])
def test_greedy_gap_across_chunks(spark, k, size):
    rng = np.random.default_rng(3)
    cand = {e: np.flatnonzero(rng.random(200) < d) for e, d in enumerate([0.05, 0.4, 0.8, 1.0])}
    df = spark.createDataFrame([("d", 0, e, int(f)) for e, v in cand.items() for f in v], "dataset_id string, task_index long, episode_index long, frame_index long")
    got = {}
    for r in chunks.greedy_min_gap(df, k, size=size).collect():
        got.setdefault(r.episode_index, []).append(r.frame_index)
    assert {e: sorted(v) for e, v in got.items()} == {e: twins.greedy(v.tolist(), k) for e, v in cand.items()}


def test_merge_ranges_keeps_gap_rule(spark):
    rows = [("d", 0, 0, a, b) for a, b in [(0, 5), (8, 12), (20, 30), (32, 40), (90, 95)]]
    df = spark.createDataFrame(rows, "dataset_id string, task_index long, episode_index long, start long, end long")
    got = sorted((r.start, r.end) for r in chunks.merge_ranges(df, 4, size=10).collect())
    assert got == [(0, 12), (20, 40), (90, 95)]


def test_halo_windows_do_not_depend_on_chunk(spark):
    _, df = series(spark, [100])
    w = chunks.by_frame()
    for size in (20, 33, 4096):
        out = chunks.own(chunks.chunked(df, size, 4).withColumn("p", F.lag("x", 3).over(w)).withColumn("q", F.lead("x", 4).over(w))).collect()
        x = {r.frame_index: r.x for r in out}
        assert len(out) == 100
        assert all(r.p == x.get(r.frame_index - 3) and r.q == x.get(r.frame_index + 4) for r in out)


def test_one_decimal_rounds_the_stored_number(spark):
    v = [2.25, 2.35, 2.45, 0.05, 0.15, 9.95, 9.94999, 0.0, 123.25, 1.0]
    rows = spark.createDataFrame([(x,) for x in v], "v double").select("v", one_decimal("v").alias("t")).collect()
    assert [r.t for r in rows] == [f"{r.v:.1f}" for r in rows]


def test_no_plan_gathers_an_episode(spark):
    """Windows over the episode alone may only see chunk summaries."""
    from motionlake.operators.series import motion_signals
    from tests.fixtures import frames_of, random_episodes
    f = frames_of(spark, random_episodes([30]))
    plan = motion_signals(f)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "_chunk" in line


@pytest.mark.parametrize("k, fan", [(5, 2), (20, 3), (3, 64)])
def test_greedy_gap_where_no_chunk_settles(spark, k, fan):
    """Dense candidates, chunks of 8, three levels and more of composed maps, gaps between chunks."""
    rng = np.random.default_rng(3)
    data = {0: np.arange(500), 1: np.flatnonzero(rng.random(400) < 0.9), 2: np.concatenate([np.arange(40), np.arange(97, 150), [151, 640]]), 3: np.array([7])}
    df = spark.createDataFrame([("d", 0, e, int(f)) for e, v in data.items() for f in v], "dataset_id string, task_index long, episode_index long, frame_index long")
    got = {}
    for r in chunks.greedy_min_gap(df, k, size=8, fan=fan).collect():
        got.setdefault(r.episode_index, []).append(r.frame_index)
    for e, v in data.items():
        kept = []
        for f in v:
            if not kept or f - kept[-1] >= k:
                kept.append(int(f))
        assert sorted(got[e]) == kept


def test_percentiles_of_a_narrow_range(spark):
    """Every group that is sorted stays small, though all values share a bucket."""
    v = spark.range(200000).select(F.lit(0).alias("g"), (F.lit(0.5) + F.col("id") * 1e-8 * F.when(F.col("id") % 2 == 0, 1).otherwise(0.5)).alias("x"))
    v = v.unionByName(v.select(F.lit(1).alias("g"), (-F.col("x")).alias("x")))
    rows = {r.g: r for r in chunks.order_stats(v, ["g"], "x", {"a": pct(5), "b": pct(50), "c": pct(99)}).collect()}
    x = 0.5 + np.arange(200000) * 1e-8 * np.where(np.arange(200000) % 2 == 0, 1, 0.5)
    for g, y in ((0, x), (1, -x)):
        assert [rows[g].a, rows[g].b, rows[g].c] == pytest.approx(np.percentile(y, [5, 50, 99]), abs=1e-15)
    digits = v.select("g", chunks.value_bucket("x").alias("b"), chunks.value_digits("x").alias("d"), "x")
    assert digits.groupBy("g", "b").agg(F.countDistinct("x").alias("n")).agg(F.max("n")).first()[0] > 100000
    assert digits.groupBy("g", "b", "d").agg(F.countDistinct("x").alias("n")).agg(F.max("n")).first()[0] <= 1 << 14


def test_digits_are_monotone(spark):
    rng = np.random.default_rng(5)
    v = np.sort(np.concatenate([[0.0, -0.0], rng.normal(size=300), 0.5 + rng.random(300) * 1e-9, -3 - rng.random(300) * 1e-12, 10.0 ** rng.integers(-300, 300, 60)]))
    rows = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", chunks.value_bucket("v").alias("b"), chunks.value_digits("v").alias("d")).orderBy("v").collect()
    places = [(r.b, r.d.d1, r.d.d2) for r in rows]
    assert places == sorted(places)


def test_stored_tables_of_many_rows_are_never_broadcast(spark):
    """Six hundred thousand encoded frames take under 1 MB of files; a join must not collect them on the driver."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    many = spark.range(600000).select(F.lit("d").alias("dataset_id"), F.lit(0).cast("long").alias("task_index"), F.floor(F.col("id") / 60).alias("episode_index"),
                                      (F.col("id") % 60).alias("frame_index"))
    stored = chunks.materialise(many)
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in plan(stored.join(stored.groupBy(*EP).agg(F.count(F.lit(1)).alias("n")), EP))
    few = chunks.lookup(stored.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n")))
    assert "BroadcastHashJoin" in plan(stored.join(few, "dataset_id"))


def test_order_stats_of_small_and_large_keys(spark):
    """Keys on both sides of the limit of a sorted row, with nulls and one value of all; both ways agree with numpy."""
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=chunks.IN_ROW + 900), "b": rng.normal(size=7), "c": np.zeros(3), "d": rng.integers(-4, 4, chunks.IN_ROW * 2).astype(float)}
    df = spark.createDataFrame([(g, float(x)) for g, v in data.items() for x in v] + [("b", None), ("e", None)], "g string, x double")
    rows = {r.g: r for r in chunks.order_stats(df, ["g"], "x", {"p5": pct(5), "p50": pct(50), "p90": pct(90)}).collect()}
    assert set(rows) == set(data)
    for g, v in data.items():
        assert rows[g].n == len(v)
        for p in (5, 50, 90):
            assert rows[g][f"p{p}"] == pytest.approx(np.percentile(v, p), abs=1e-12)


def test_column_stats_of_small_and_large_keys(spark, monkeypatch):
    monkeypatch.setattr(chunks, "IN_ROW", 50)
    rng = np.random.default_rng(8)
    rows = [(key, float(x), None if i % 7 == 0 else float(y)) for key, n in ((1, 1), (2, 40), (3, 400)) for i, (x, y) in enumerate(rng.normal(size=(n, 2)))]
    df = spark.createDataFrame(rows, "key long, x double, y double")
    got = chunks.column_stats(df, ["key"], {"x90": ("x", pct(90)), "y20": ("y", pct(20))}, n=F.count(F.lit(1)), mean=F.avg("x")).collect()
    assert {r.key for r in got} == {1, 2, 3}
    for r in got:
        x, y = [a for k, a, _ in rows if k == r.key], [b for k, _, b in rows if k == r.key and b is not None]
        assert r.n == len(x) and abs(r.mean - np.mean(x)) < 1e-9 and abs(r.x90 - np.percentile(x, 90)) < 1e-9
        assert r.y20 is None if not y else abs(r.y20 - np.percentile(y, 20)) < 1e-9


def test_greedy_gap_needs_no_maps_in_first_chunks(spark, monkeypatch):
    monkeypatch.setattr(chunks, "entry_states", lambda *a, **k: pytest.fail("maps of keys of one chunk"))
    df = spark.createDataFrame([("d", 0, e, f) for e in (1, 2) for f in range(0, 60, e)], "dataset_id string, task_index long, episode_index long, frame_index long")
    assert chunks.greedy_min_gap(df, 10).count() == 12


def test_crowded_users_are_cut_by_time_and_others_are_not(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(driver_tables, "CHUNK", 20)
    seen = []
    plain = driver_tables.scan
    monkeypatch.setattr(driver_tables, "scan", lambda df, keys, chunk, *a, **k: seen.append(df.select("user_id", chunk.alias("c")).distinct().groupBy("user_id").count()) or plain(df, keys, chunk, *a, **k))
    spark.sql("""select id event_id, timestamp_seconds(id * 5000 + id % 3) ts, if(id < 60, 1L, id % 4 + 2) user_id, 'x' event_type, id / 7.0D value, concat('{"k": ', id, '}') props
        from range(120)""").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.episode_index, r.frame_index): r.ts for r in driver_tables.event_frames(spark, str(tmp_path)).collect()}
    parts = {r.user_id: r["count"] for r in seen[0].collect()}
    assert parts[1] > 1 and all(parts[u] == 1 for u in (2, 3, 4, 5))
    for user in range(1, 6):
        times = sorted(i * 5000 + i % 3 for i in range(120) if (1 if i < 60 else i % 4 + 2) == user)
        assert [got[user, f] for f in range(len(times))] == [float(t - times[0]) for t in times]
