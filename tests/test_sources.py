"""Readers, sinks, metadata rules, review planning, images."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.functions import scalars
from motionlake.operators import enrichment, images, metadata, projections, relations, stats
from motionlake.sources import commits, readers, sinks
from tests.fixtures import frames_of, random_episodes


def write_frames(spark, path, episodes, **extra):
    rows = [(e, f, f * 0.1, f, 0, [float(x) for x in a[f]], [float(x) for x in s[f]], b"image") for e, (a, s) in episodes.items() for f in range(len(a))]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, timestamp double, index long, task_index long, action array<double>, `observation.state` array<double>, picture binary")
    df.write.mode("overwrite").parquet(path)


def test_only_signal_columns_are_read(spark, tmp_path):
    write_frames(spark, f"{tmp_path}/data", random_episodes([5, 6]))
    df = readers.read_frames(spark, f"{tmp_path}/data")
    assert "picture" not in df.columns
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "picture" not in plan.split("ReadSchema")[1]
    c = readers.canonical_frames(df)
    assert c.columns == ["dataset_id", "task_index", "episode_index", "frame_index", "ts", "action", "state"] and c.count() == 11


def test_state_only_data(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0], 0.4), (0, 1, [1.0, 3.0], 0.5)], "episode_index long, frame_index long, `observation.state` array<double>, gripper_width double")
    rows = readers.canonical_frames(df).orderBy("frame_index").collect()
    assert rows[1].action == [1.0, 3.0, 0.5] and rows[1].ts == pytest.approx(0.1)
    f = frames_of(spark, random_episodes([6], state_dims=6)).withColumn("gripper_width", F.lit(0.2)).drop("action")
    made = projections.synthesize_action(f).orderBy("frame_index").collect()
    assert made[0].action[:6] == [0.0] * 6 and all(r.action[6] == -0.2 for r in made)
    assert made[3].action[4] == pytest.approx(made[3].state[4] - made[2].state[4])


def test_sub_datasets_and_files(spark, tmp_path):
    for name in ("arm.a", "arm.b"):
        write_frames(spark, f"{tmp_path}/root/{name}/data/chunk-000", random_episodes([4, 3]))
    df = readers.read_multi_subdatasets(spark, f"{tmp_path}/root")
    assert {r.episode_id for r in df.select("episode_id").distinct().collect()} == {"arm.a/episode_0", "arm.a/episode_1", "arm.b/episode_0", "arm.b/episode_1"}
    per = stats.episodes_per_file(readers.with_file(frames := df.withColumn("dataset_id", F.col("dataset_id"))))
    assert {r.dataset_id for r in per.collect()} == {"arm.a", "arm.b"} and frames.count() == 14


def test_manifest(spark, tmp_path):
    for p, n in (("t/a.mcap", 10), ("t/x/b.tar", 20), ("t/x/y/z/w/deep.mp4", 5), ("t/readme.md", 9)):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"0" * n)
    rows = {r.path: r.size_bytes for r in readers.file_manifest(spark, str(tmp_path)).collect()}
    assert rows == {"t/a.mcap": 10, "t/x/b.tar": 20, "t/x/y/z/w/deep.mp4": 5}


def test_names_as_list_or_map(spark):
    info = {"fps": 10, "features": {"action": {"dtype": "float32", "shape": [2], "names": {"motors": ["a", "b"]}}, "observation.image": {"dtype": "video", "shape": [1], "info": {"video.is_depth_map": False}},
                                    "observation.images.depth": {"dtype": "video"}, "s_id": {"dtype": "int64", "names": ["k"]}}}
    df = spark.createDataFrame([("d", json.dumps(info))], "dataset_id string, info_json string")
    f = {r.key: r for r in metadata.read_features(df).collect()}
    assert f["action"].names == ["a", "b"] and f["s_id"].names == ["k"] and f["observation.images.depth"].is_depth
    assert f["s_id"].feature_group == "indices" and f["observation.image"].feature_group == "cameras"
    assert metadata.modalities(metadata.read_features(df)).collect()[0].modalities == "rgb,depth,actions"


@pytest.mark.parametrize("url,repo", [("https://huggingface.co/datasets/Acme-Labs/Arm00", "Acme-Labs/Arm00"), ("huggingface.co/datasets/acme/Clips-10K", "acme/Clips-10K"),
                                      ("a/b", "a/b"), ("http://x/y", None), ("a/b/c", None)])
def test_repo_from_url(spark, url, repo):
    assert spark.createDataFrame([(url,)], "u string").select(scalars.repo_from_url("u")).collect()[0][0] == repo


def test_slug_and_estimates(spark):
    one = spark.createDataFrame([("acme2025/10Kh-Real.Open--Data", 10_000_000, 0)], "r string, s long, z long")
    r = one.select(scalars.dataset_slug("r").alias("slug"), scalars.estimate_frames("s", F.lit("webdataset")).alias("tar"), scalars.estimate_frames("s", F.lit("mcap")).alias("mcap"), scalars.estimate_frames("z", F.lit("mcap")).alias("none")).collect()[0]
    assert r.slug == "10kh_real_open_data" and r.tar == int(10_000_000 / (5 * 1024 * 1024 / 8) * 30) and r.mcap == 195 and r.none == 0


def test_step_sequences(spark):
    df = spark.createDataFrame([(3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [7.0, 8.0, 9.0], [1, 0, 0])], "episode_index long, action_flat array<double>, state_flat array<double>, is_first array<int>")
    rows = readers.read_step_sequences(df).orderBy("frame_index").collect()
    assert [r.action for r in rows] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]] and rows[2].ts == pytest.approx(0.4) and rows[1].state == [8.0]


def test_dimension_rules(spark):
    df = spark.createDataFrame([(1, ["x", "y", "z", "roll", "pitch", "yaw", "gripper"], 7), (2, None, 5), (3, ["j1", "j2", "j3", "grip", "j4"], 5), (4, ["right_1", "left_1", "right_gripper", "left_gripper"], 4)], "k int, labels array<string>, dims int")
    server = {r.k: r for r in metadata.classify_dims(df).collect()}
    ui = {r.k: r for r in metadata.classify_dims(df, "ui").collect()}
    assert server[1].group2 == [3, 4, 5] and server[1].grippers == [6]
    assert (server[2].label1, server[2].group1, ui[2].label1, ui[2].group1) == ("Dims(0-1)", [0, 1], "Dims (0-2)", [0, 1, 2])
    assert (server[3].group1, ui[3].group1, ui[3].label2) == ([0, 1], [0, 1], "Joints (2-4)")
    assert (ui[4].label1, ui[4].group1, ui[4].grippers) == ("Left Arm", [1], [3, 2])


def test_results_are_computed_once(spark, tmp_path):
    path, calls = f"{tmp_path}/results", []

    def compute(todo):
        calls.append(todo.count())
        return todo.withColumn("answer", F.col("task_index") * 2)

    req = lambda *t: spark.createDataFrame([("d", i, 30) for i in t], "dataset_id string, task_index long, cohort_size long")
    assert sinks.materialise_results(req(1, 2), path, compute).count() == 2
    assert sinks.materialise_results(req(2, 3), path, compute).count() == 2
    assert calls == [2, 1]


def test_report_pages_keep_every_phase(spark, tmp_path):
    eps = random_episodes([5])
    f = frames_of(spark, eps)
    key = f.select("dataset_id", "task_index", "episode_index").distinct()
    ph = key.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(24)))).select("dataset_id", "task_index", "episode_index", F.concat(F.lit("P"), F.col("i").cast("string")).alias("phase"),
                                                                                F.lit(0).cast("long").alias("cycle"), (F.col("i") * 10).cast("long").alias("start"), (F.col("i") * 10 + 10).cast("long").alias("end"))
    c = key.select("*", F.lit(250).alias("n_frames"), F.lit(0).alias("num_cycles"))
    m = key.select("*", F.lit("C1").alias("cluster"))
    ft = key.withColumn("z_range", F.lit(0.5))
    why = key.select("*", F.lit("shape").alias("signal"), F.lit(None).cast("string").alias("phase"), F.lit(None).cast("long").alias("cycle"), F.lit("x").alias("feature"), F.lit(1.0).alias("magnitude"), F.lit("t").alias("explanation"), F.lit(4).alias("ordinal"))
    r = sinks.episode_reports(c, m, ph, ft, why, page=10)
    rows = r.orderBy("page").collect()
    assert [len(x.phases) for x in rows] == [10, 10, 5] and all(x.is_anomaly for x in rows) and sum(len(x.reasons or []) for x in rows) == 1
    sinks.write_report(r, f"{tmp_path}/report")
    assert spark.read.parquet(f"{tmp_path}/report").count() == 3


def test_review_plan_and_merge(spark):
    key = "dataset_id string, task_index long, episode_index long"
    flagged = spark.createDataFrame([("d", 0, i) for i in range(30)], key)
    cl = spark.createDataFrame([("d", 0, f"C{i}", 5, i) for i in range(1, 5)], "dataset_id string, task_index long, cluster string, size long, medoid long")
    b = enrichment.flag_batches(flagged, cl).collect()
    assert len(b) == 20 and max(r.batch for r in b) == 2 and b[0].normal_ids == "1,2,3"
    assert sum(r.batch == 0 for r in b) == 7
    s = enrichment.cap_summary(flagged).collect()[0]
    assert (s.flagged_shown, s.flagged_total, s.flagged_capped) == (20, 30, True)
    plan = enrichment.enrichment_plan(flagged, cl).collect()
    assert sum(r.role == "target" for r in plan) == 4 and sum(r.role == "contrast" for r in plan) == 12 and sum(r.role == "normal" for r in plan) == 9


def test_context_text(spark):
    ep = spark.createDataFrame([("d", 0, 1, 100, 1)], "dataset_id string, task_index long, episode_index long, n_frames long, num_cycles long")
    ph = spark.createDataFrame([("d", 0, 1, "Approach", 0, 0, 25, 0.5, 0.75, 0.1, 0.2), ("d", 0, 1, "Grasp", 0, 25, 28, 0.5, 0.7, 0.1, 0.2)],
                               "dataset_id string, task_index long, episode_index long, phase string, cycle long, frame_start long, frame_end long, pos_mag_mean double, pos_mag_max double, rot_mag_mean double, rot_mag_max double")
    ev = spark.createDataFrame([("d", 0, 1, k, f) for k, f in (("close", 25), ("open", 40), ("close", 50))], "dataset_id string, task_index long, episode_index long, kind string, frame long")
    text = enrichment.episode_context_text(ep, ph, ev).collect()[0].context.split("\n")
    assert text[0] == "    frames=100 @ 10Hz · cycles=1"
    assert text[1] == "    phases: Approachc0 0.0-2.5s (posM=0.5/0.75,rotM=0.1/0.2), Graspc0 2.5-2.8s"
    assert text[2].startswith("    gripper events (3): [close@2.50s, open@4.00s, close@5.00s] ← 1 extra event(s) vs 2×cycles=2")


def test_rgb_image_scores(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (6, 5, 3))
    df = spark.createDataFrame([("d", 0, 0, 0, 6, 5, 3, [int(x) for x in img.reshape(-1)])], "dataset_id string, task_index long, episode_index long, frame_index long, height int, width int, channels int, pixels array<int>")
    r = images.visual_metrics(df).collect()[0]
    g = img.mean(2)
    p = np.pad(g, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    v = lap.var()
    assert r.blur_score == pytest.approx(v / 100 if v < 50 else min(1, 0.5 + (v - 50) / 900))
    flat = img.reshape(-1)
    clip = min(1, ((flat < 5).mean() + (flat > 250).mean()) * 10)
    assert r.exposure_score == pytest.approx(0.6 * (1 - abs(flat.mean() / 255 - 0.5) * 2) + 0.4 * (1 - clip))
    assert r.contrast_score == pytest.approx(max(0.5, 1 - (g.std() - 0.4) * 2))


def test_catalogue_relations(spark):
    a = spark.createDataFrame([("d", 0, 1, 5), ("d", 0, 2, 7)], "dataset_id string, task_index long, episode_index long, n_frames long")
    assert relations.mirror_check(a, a).collect()[0].is_mirror
    assert [r.repo_id for r in relations.catalogue(spark.createDataFrame([("x/a", 1), ("x/b", 5), ("y/c", 9)], "repo_id string, downloads long"), search="X/").collect()] == ["x/b", "x/a"]


def test_range_of_equal_values(spark):
    df = spark.createDataFrame([("d", 0, 0, i, 2.0) for i in range(5)], "dataset_id string, task_index long, episode_index long, frame_index long, value double")
    r = stats.robust_range(df).collect()[0]
    assert (r.range_min, r.range_max) == (1.5, 2.5)


def _requests(spark, *tasks):
    return spark.createDataFrame([("d", i, 30) for i in tasks], "dataset_id string, task_index long, cohort_size long")


def _two_rows_a_key(todo):
    return todo.withColumn("place", F.explode(F.array(F.lit(0), F.lit(1))))


def test_two_writers_at_once_leave_each_key_once(spark, tmp_path):
    import threading
    path, gate, failed = str(tmp_path / "results"), threading.Barrier(2), []

    def writer(name, *tasks):
        def compute(todo):
            gate.wait(60)  # both have read the same log before either commits
            return _two_rows_a_key(todo).withColumn("writer", F.lit(name))
        try:
            sinks.materialise_results(_requests(spark, *tasks), path, compute)
        except Exception as e:
            failed.append(e)

    both = [threading.Thread(target=writer, args=a) for a in (("a", 1, 2, 3), ("b", 2, 3, 4))]
    for t in both:
        t.start()
    for t in both:
        t.join(120)
    rows = commits.read_committed(spark, path).collect()
    assert not failed and [c["number"] for c in commits.log(spark, path)] == [0, 1]
    assert sorted((r.task_index, r.place) for r in rows) == [(t, p) for t in (1, 2, 3, 4) for p in (0, 1)]
    assert all(len({r.writer for r in rows if r.task_index == t}) == 1 for t in (1, 2, 3, 4))


def test_a_job_stopped_half_way_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "results")
    first = sinks.materialise_results(_requests(spark, 1), path, _two_rows_a_key).count()
    commits.stage(_two_rows_a_key(_requests(spark, 2).withColumn("result_key", F.lit("k"))), path)  # staged, never committed

    def broken(todo):
        return _two_rows_a_key(todo).withColumn("x", F.raise_error(F.lit("stopped")).cast("string"))

    with pytest.raises(Exception, match="stopped"):
        sinks.materialise_results(_requests(spark, 2), path, broken)
    assert first == 2 and commits.read_committed(spark, path).count() == 2 and len(commits.log(spark, path)) == 1
    assert sinks.materialise_results(_requests(spark, 1, 2), path, _two_rows_a_key).count() == 4


def test_a_number_is_claimed_once_and_a_token_commits_once(spark, tmp_path):
    path = str(tmp_path / "t")
    part = commits.stage(_requests(spark, 1), path)
    entry = {"number": 0, "token": None, "parts": {"rows": part}}
    assert commits.claim(spark, path, entry) and not commits.claim(spark, path, entry)
    put = lambda: commits.publish(spark, path, lambda log: {"rows": _requests(spark, 5)}, token="batch 3")
    assert put() == 1 and put() is None and commits.read_committed(spark, path).count() == 2


@pytest.mark.parametrize("name", ["a+(b)", "set[1]", "v{2}.x", "two words"])
def test_manifest_of_a_folder_with_special_signs(spark, tmp_path, name):
    for folder in (name, "set1", "v2.x"):
        (tmp_path / folder / "t").mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "t" / "a.mcap").write_bytes(b"0" * 7)
    (tmp_path / name / "t" / "b.tar").write_bytes(b"0" * 3)
    rows = sorted((r.path, r.size_bytes) for r in readers.file_manifest(spark, str(tmp_path / name)).collect())
    assert rows == [("t/a.mcap", 7), ("t/b.tar", 3)]
