"""Inputs beyond the driver tables: running index, wide smoothing, many tasks, deep folders, clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.operators import chunks, relations, series
from motionlake.sources.readers import canonical_frames, file_manifest


def test_frames_from_running_index_are_dense(spark):
    rows = [(e, 1000 + 60 * e + k, [float(k)] * 7) for e in (3, 4) for k in range(60)]
    got = canonical_frames(spark.createDataFrame(rows, "episode_index long, index long, action array<double>"))
    per = {r[0]: (r[1], r[2], r[3]) for r in got.groupBy("episode_index").agg(F.min("frame_index"), F.max("frame_index"), F.count("*")).collect()}
    assert per == {3: (0, 59, 60), 4: (0, 59, 60)}
    assert got.filter("frame_index <> action[0]").count() == 0


def test_datasets_of_one_folder_are_numbered_apart(spark):
    rows = [(d, 0, k, [float(k)] * 7) for d in ("a", "b") for k in range(5)]
    got = canonical_frames(spark.createDataFrame(rows, "dataset_id string, episode_index long, index long, action array<double>"))
    assert sorted((r.dataset_id, r.frame_index) for r in got.collect()) == [(d, k) for d in ("a", "b") for k in range(5)]


def test_lags_across_chunks(spark):
    n, shift = 9000, 20
    f = spark.range(n).select(F.lit("d").alias("dataset_id"), F.lit(0).cast("long").alias("task_index"), F.lit(1).cast("long").alias("episode_index"), F.col("id").alias("frame_index"),
                              F.sin((F.col("id") - shift) * F.col("id") / 900).alias("x"), F.sin(F.col("id") * (F.col("id") + shift) / 900).alias("y"))
    i = np.arange(n)
    x, y = np.sin((i - shift) * i / 900), np.sin(i * (i + shift) / 900)
    x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    want = max((x[k:] @ y[:n - k] if k >= 0 else x[:k] @ y[-k:]) / n for k in range(-25, 26))
    r = series.cross_corr(f, max_lag=25).first()
    assert r.lag == shift and r.peak == pytest.approx(want, abs=1e-12)
    walk = np.cumsum(np.sin(i * i / 500.0))
    g = spark.createDataFrame([("d", 0, 1, int(k), [float(walk[k])] + [0.0] * 6) for k in range(n)], "dataset_id string, task_index long, episode_index long, frame_index long, action array<double>")
    speed = np.abs(np.diff(walk))
    r0 = speed @ speed
    decay = np.clip(sum(speed[k:] @ speed[:n - 1 - k] for k in range(30)) / r0 / 30, 0, 1)
    assert series.autocorr_decay(g, lags=30).first().decay == pytest.approx(float(decay), abs=1e-9)


@pytest.mark.parametrize("sigma", [3.0, 5.0, 8.0])
def test_smoothing_across_chunks(spark, sigma):
    n, r = 9000, int(4 * sigma + 0.5)
    x = np.sin(np.arange(n) / 7) + (np.arange(n) % 13)
    frames = spark.range(n).select(F.lit("d").alias("dataset_id"), F.lit(0).cast("long").alias("task_index"), F.lit(1).cast("long").alias("episode_index"), F.col("id").alias("frame_index"), (F.sin(F.col("id") / 7) + F.col("id") % 13).alias("x"))
    got = np.array([v for _, v in sorted(map(tuple, series.smooth(frames, F.col("x"), sigma).select("frame_index", "smoothed").collect()))])
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    inner = slice(r, n - r)
    assert np.allclose(got[inner], np.convolve(x, w / w.sum(), "same")[inner], atol=1e-9)


def test_counts_of_many_tasks(spark):
    tasks = spark.range(101).select(F.lit("d").alias("dataset_id"), F.col("id").alias("task_index"), F.lit("t").alias("task_description"))
    got = relations.tasks_with_counts(tasks, tasks.drop("task_description"))
    assert got.filter("episode_count = 1").count() == 101


def test_deep_folders_are_listed(spark, tmp_path):
    deep = tmp_path.joinpath(*"abcde")
    deep.mkdir(parents=True)
    (deep / "episode.parquet").write_bytes(b"x")
    assert file_manifest(spark, str(tmp_path)).count() == 1 and file_manifest(spark, str(tmp_path), 3).count() == 0


def test_cluster_without_shared_folder_fails():
    class Nothing:
        def isEmpty(self):
            return True

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"

            class _jsc:
                sc = staticmethod(lambda: type("Context", (), {"getCheckpointDir": lambda self: Nothing()})())

    with pytest.raises(ValueError):
        chunks.shared_folder(Session())
