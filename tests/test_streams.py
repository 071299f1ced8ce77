"""Stream results equal the batch operators."""

import datetime as dt

from pyspark.sql import functions as F

from motionlake.operators import events
from motionlake.operators.divergence import task_quality_report
from motionlake.sources import sinks
from motionlake.sources.readers import MESSAGE_SCHEMA
from motionlake.streaming import streams
from tests.fixtures import cohort, frames_of, random_episodes

T0 = dt.datetime(2024, 1, 1)


def drops(spark, path, batches, schema):
    """Micro-batches as numbered files, read one per trigger in order."""
    import os
    import time
    for i, rows in enumerate(batches):
        folder = f"{path}/stage{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
        part = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
        os.makedirs(f"{path}/in", exist_ok=True)
        os.rename(f"{folder}/{part}", f"{path}/in/{i:03d}.parquet")
        os.utime(f"{path}/in/{i:03d}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def frame_rows(eps):
    return [("d", 0, e, f, T0 + dt.timedelta(seconds=f * 0.1), f * 0.1, float(a[f, -1])) for e, (a, _) in eps.items() for f in range(len(a))]


END = [("end", 9, 9, 0, T0 + dt.timedelta(hours=5), 0.0, 1.0)]


def test_late_frames_give_the_batch_result(spark, tmp_path):
    eps = random_episodes([40, 55, 70], seed=2)
    rows = sorted(frame_rows(eps), key=lambda r: (r[3] // 20, -r[3]))  # out of order inside two seconds
    parts = [rows[:50], rows[50:90], rows[90:], END, [(*END[0][:3], 1, T0 + dt.timedelta(hours=6), 0.0, 1.0)]]
    out = sinks.run_to_end(streams.gripper_events(drops(spark, str(tmp_path), parts, streams.FRAME_STREAM), "10 seconds"))
    got = {(r.episode_index, r.frame) for r in out.collect() if r.dataset_id == "d"}
    want = {(r.episode_index, r.frame) for r in events.gripper_events(frames_of(spark, eps)).collect()}
    assert got == want


def test_idle_episodes_are_summarised(spark, tmp_path):
    eps = random_episodes([30, 45], seed=3)
    rows = frame_rows(eps)
    src = drops(spark, str(tmp_path), [rows[:40], rows[40:], END, [(*END[0][:3], 1, T0 + dt.timedelta(hours=6), 0.0, 1.0)]], streams.FRAME_STREAM)
    out = sinks.run_to_end(streams.episode_summaries(src))
    assert {(r.episode_index, r.n_frames) for r in out.collect() if r.dataset_id == "d"} == {(0, 30), (1, 45)}


def message(e, topic, k, data=None):
    payload = (data,) + (None,) * 14
    return (e, topic, "s", int(1.7e18) + k * 10**9, payload)


def test_channel_counts_and_stride(spark, tmp_path):
    rows = [message("r", t, k, [float(k), 1.0]) for k in range(60) for t in ("/arm/cmd", "/camera/rgb", "/imu")]
    src = drops(spark, str(tmp_path), [rows[:100], rows[100:], [message("z", "/x", 10**5)]], MESSAGE_SCHEMA)
    counts = sinks.run_to_end(streams.channel_counts(src))
    total = {r.topic: r.n for r in counts.groupBy("topic").agg(F.sum("messages").alias("n")).collect()}
    assert total == {"/arm/cmd": 60, "/camera/rgb": 60, "/imu": 60}
    batch = spark.createDataFrame(rows, MESSAGE_SCHEMA)
    kept = streams.batch_signals(batch, 20).collect()
    assert [r.kind for r in kept] == ["action"] * 20 and {r.stride for r in kept} == {3}


def test_streamed_stride_counts_across_batches(spark, tmp_path):
    rows = [message("r", "/arm/cmd", k, [float(k)]) for k in range(50)]
    src = drops(spark, str(tmp_path), [rows[:17], rows[17:33], rows[33:]], MESSAGE_SCHEMA)
    out = sinks.run_to_end(streams.stream_signals(src, stride=4))
    assert sorted(r.vec[0] for r in out.collect()) == [float(k) for k in range(0, 50, 4)]


def test_task_quality_follows_new_episodes(spark, tmp_path):
    f = frames_of(spark, cohort(6))
    schema = "dataset_id string, task_index long, episode_index long"
    src = drops(spark, str(tmp_path), [[("d", 0, 0), ("d", 0, 1)], [("d", 0, 2)]], schema)
    load = lambda touched: f.join(touched, ["dataset_id", "task_index"], "left_semi")
    q = streams.task_quality_sink(src, load, f"{tmp_path}/quality", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    row = streams.latest_task_quality(spark, f"{tmp_path}/quality").collect()
    want = task_quality_report(f).collect()[0]
    assert len(row) == 1 and row[0].num_episodes == 6 and abs(row[0].mean_divergence - want.mean_divergence) < 1e-9


def test_strided_signals_count_both_topics_of_a_kind_in_event_time(spark, tmp_path):
    """Two topics of one kind, equal times, late rows: the stream keeps what the batch form keeps."""
    rows = [message("r", t, k, [float(k)]) for k in range(45) for t in ("/arm/cmd", "/gripper/cmd") if t == "/arm/cmd" or k % 2 == 0]
    rows += [message("q", "/arm/cmd", k, [float(k), 1.0]) for k in range(10)]
    late = sorted(rows, key=lambda r: (r[3] // (6 * 10**9), -r[3]))  # backwards inside six seconds
    src = drops(spark, str(tmp_path), [late[:31], late[31:60], late[60:], [message("end", "/arm/cmd", 10**5, [0.0])]], MESSAGE_SCHEMA)
    out = sinks.run_to_end(streams.stream_signals(src, 4, "30 seconds", "10 minutes"))
    cells = lambda df: sorted((r.episode_id, r.topic, r.log_time_ns, r.kind, tuple(r.vec), r.ts) for r in df.collect() if r.episode_id != "end")
    want = cells(streams.batch_signals(spark.createDataFrame(rows, MESSAGE_SCHEMA), stride=4))
    assert cells(out) == want and {r[1] for r in want} == {"/arm/cmd", "/gripper/cmd"}


def test_an_idle_episode_leaves_no_state(spark, tmp_path):
    eps = random_episodes([30, 30], seed=5)
    later = [("d", 0, 0, 100 + f, T0 + dt.timedelta(hours=12, seconds=f), 0.0, g) for f, g in enumerate((1.0, -1.0))]
    parts = [frame_rows(eps), END, later, [(*END[0][:3], 1, T0 + dt.timedelta(hours=20), 0.0, 1.0)]]
    stream = streams.gripper_events(drops(spark, str(tmp_path), parts, streams.FRAME_STREAM), "10 seconds", "1 hour")
    q = (stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    held = lambda name: {r[0].dataset_id for r in spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/state").select("key").collect()}
    assert held("last") <= {"end"}
    # the frames after twelve hours are an episode anew: their first frame is compared with none before it
    got = {(r.episode_index, r.frame) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.dataset_id == "d"}
    assert {f for e, f in got if f >= 100} == {101} and any(f < 100 for _, f in got)


def test_waiting_rows_of_a_batch_are_one_element_of_state(spark, tmp_path):
    stream = streams.gripper_events(drops(spark, str(tmp_path), [frame_rows(random_episodes([30, 40], seed=6))], streams.FRAME_STREAM), "1 hour")
    (stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
     .trigger(availableNow=True).start().awaitTermination())
    held = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/state")
    assert held.count() == 2


def test_a_repeated_batch_of_task_quality_changes_nothing(spark, tmp_path):
    import os
    f = frames_of(spark, cohort(5))
    schema = "dataset_id string, task_index long, episode_index long"
    src = drops(spark, str(tmp_path), [[("d", 0, 0), ("d", 0, 1), ("d", 0, 2)], [("d", 0, 3), ("d", 0, 4)]], schema)
    asked = []

    def load(new):
        asked.append(sorted(r.episode_index for r in new.collect()))
        return f.join(new, ["dataset_id", "task_index", "episode_index"], "left_semi")

    run = lambda: streams.task_quality_sink(src, load, f"{tmp_path}/quality", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    run()
    rows = lambda: [tuple(r) for r in streams.latest_task_quality(spark, f"{tmp_path}/quality").collect()]
    before, want = rows(), [tuple(r) for r in task_quality_report(f).select(*streams.latest_task_quality(spark, f"{tmp_path}/quality").columns).collect()]
    assert asked == [[0, 1, 2], [3, 4]] and len(before) == 1
    assert all(abs(a - b) < 1e-9 if isinstance(a, float) else a == b for a, b in zip(before[0], want[0]))
    # the stream forgets that it finished its last batch, as after a crash between the table and the stream's own log
    os.remove(f"{tmp_path}/state/commits/1")
    if os.path.exists(f"{tmp_path}/state/commits/.1.crc"):
        os.remove(f"{tmp_path}/state/commits/.1.crc")
    run()
    assert rows() == before and len(asked) == 2
