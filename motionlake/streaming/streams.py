"""Live recordings: Structured Streaming forms of the batch operators."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from motionlake.functions.scalars import action_vector, imu_sample, route_signal, seconds
from motionlake.operators.chunks import materialise, numbered, spread_join
from motionlake.operators.divergence import episode_partials, quality_of_partials
from motionlake.schema import EP, TASK
from motionlake.sources import commits

FRAME_STREAM = "dataset_id string, task_index long, episode_index long, frame_index long, event_time timestamp, ts double, grip double"
GRIPPER_OUT = "dataset_id string, task_index long, episode_index long, frame long, kind string"


def channel_counts(messages: DataFrame, window: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Messages per topic and tumbling window; a window closes when the watermark passes it."""
    m = messages.withColumn("event_time", F.timestamp_micros(F.floor(F.col("log_time_ns") / 1000).cast("long")))
    g = m.withWatermark("event_time", late).groupBy(F.window("event_time", window).alias("w"), "topic").agg(F.count(F.lit(1)).alias("messages"))
    return g.select(F.col("w.start").alias("window_start"), "topic", "messages")


def episode_summaries(frames: DataFrame, idle: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """Frames and duration of an episode, emitted once it has been idle."""
    key = ["dataset_id", "task_index", "episode_index"]
    g = frames.withWatermark("event_time", late).groupBy(*key, F.session_window("event_time", idle).alias("s")).agg(
        F.count(F.lit(1)).alias("n_frames"), (F.max("ts") - F.min("ts")).alias("duration_s"))
    return g.drop("s")


#: Rows of a key in one element of its state.
PACK = 10_000
ARROW = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


class InEventTime(StatefulProcessor):
    """Hold the rows of a key until the watermark passes them, then judge them in event-time order.

    State: the rows that wait, packed PACK at most to an Arrow batch, and what ``judge`` carries from row to row. A
    timer at the newest time of each batch lets that batch go; rows that came late but within the watermark are sorted in by then.
    After a gap of more than ``idle_ms`` of event time a key starts anew, and its state is dropped as soon as the
    watermark shows such a gap.
    """

    def __init__(self, schema: str, times: str, order: list[str], carried: str, judge: Callable, idle_ms: int):
        self.schema = pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])
        self.times, self.order = times, [(c, "ascending") for c in order]
        self.carried, self.judge, self.idle_ms = carried, judge, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", f"{self.carried}, newest_ms bigint")

    def _packed(self, rows: pa.Table) -> list[tuple]:
        return [(b.serialize().to_pybytes(),) for b in rows.combine_chunks().to_batches(max_chunksize=PACK)]

    def _unpacked(self) -> pa.Table:
        return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(bytes(rows)), self.schema) for (rows,) in self.waiting.get()], self.schema)

    def _ms(self, times: np.ndarray) -> np.ndarray:
        """Event times, rounded up, so a row never counts as passed before the watermark is there."""
        return -(-times // 1000000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for batch in rows:
            if len(batch):
                table = pa.Table.from_pandas(batch, self.schema, preserve_index=False)
                self.waiting.appendList(self._packed(table))
                top = int(self._ms(table[self.times].to_numpy()).max())
                newest = top if newest is None else max(newest, top)
        if newest is not None:
            # a time that has passed already is due with the next watermark
            self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = self._unpacked().sort_by(self.order)
        old = self.last.get()
        carried, newest = (tuple(old)[:-1], old[-1]) if old is not None else (None, None)
        if len(held):
            every = self._ms(held[self.times].to_numpy())
            # rows are in order of time, so those that are due come first
            n_due = int(np.searchsorted(every, mark, "right"))
            rest = held.slice(n_due)
            if n_due:
                times, ready = every[:n_due], held.slice(0, n_due).to_pandas(integer_object_nulls=True)
                before = np.concatenate(([times[0] if newest is None else newest], times[:-1]))
                anew = np.flatnonzero(times - before > self.idle_ms)
                edges = np.unique(np.concatenate(([0], anew, [n_due])))
                for a, z in zip(edges, edges[1:]):
                    if a in anew:
                        carried = None
                    found, carried = self.judge(ready if z - a == n_due else ready.iloc[a:z].reset_index(drop=True), carried)
                    if len(found):
                        yield found
                newest = int(times[-1])
                if len(rest):
                    self.waiting.put(self._packed(rest))
                else:
                    self.waiting.clear()
            if len(rest):
                if carried is not None:
                    self.last.update((*carried, newest))
                return
        if newest is not None and mark - newest >= self.idle_ms:
            if old is not None:
                self.last.clear()
        elif newest is not None:
            self.last.update((*carried, newest))
            self.handle.registerTimer(newest + self.idle_ms + 1)

    def close(self) -> None:
        pass


def _milliseconds(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _sign_changes(rows: pd.DataFrame, carried: tuple | None):
    """Frames whose sign differs from the frame before; a step through exactly zero is not a change."""
    g = rows["grip"].to_numpy(dtype=float)
    before = np.concatenate(([np.nan if carried is None else carried[0]], g[:-1]))
    hit = before * g < 0
    if not hit.any():
        return (), (float(g[-1]),)
    cells = {c: rows[c].to_numpy()[hit] for c in (*EP, "frame_index")}
    return pd.DataFrame(cells | {"kind": np.where(g[hit] < 0, "close", "open")}).rename(columns={"frame_index": "frame"}), (float(g[-1]),)


def gripper_events(frames: DataFrame, late: str = "10 seconds", idle: str = "1 hour") -> DataFrame:
    """Gripper sign changes per episode; equals the batch operator once the watermark has passed."""
    held = frames.withWatermark("event_time", late).select(*EP, "frame_index", (F.unix_micros("event_time") * 1000).alias("time_ns"), "grip", "event_time")
    schema = "dataset_id string, task_index bigint, episode_index bigint, frame_index bigint, time_ns bigint, grip double"
    judge = InEventTime(schema, "time_ns", ["time_ns", "frame_index"], "grip double", _sign_changes, _milliseconds(idle))
    return held.groupBy(*EP).transformWithStateInPandas(judge, GRIPPER_OUT, "append", "EventTime")


class EveryNthRow:
    """Every n-th row, counted on from what came before."""

    def __init__(self, stride: int):
        self.stride = stride

    def __call__(self, rows: pd.DataFrame, carried: tuple | None):
        seen = 0 if carried is None else carried[0]
        keep = (np.arange(len(rows)) + seen) % self.stride == 0
        return rows[keep], (seen + len(rows),)


class EveryNth(StatefulProcessor):
    """Keep every n-th message of an (episode, topic), counting across batches."""

    def __init__(self, stride: int):
        self.stride = stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        n = self.seen.get()[0] if self.seen.exists() else 0
        for pdf in rows:
            pdf = pdf.sort_values("log_time_ns", kind="stable").reset_index(drop=True)
            keep = (pdf.index.to_numpy() + n) % self.stride == 0
            n += len(pdf)
            if keep.any():
                yield pdf[keep]
        self.seen.update((n,))

    def close(self) -> None:
        pass


SIGNAL_ROWS = "episode_id string, topic string, log_time_ns bigint, kind string, vec array<double>, vec_kind string"


def routed_signals(messages: DataFrame, *rest: str) -> DataFrame:
    """Action and IMU rows of a message table or stream: camera topics go first, then decoding."""
    m = messages.withColumn("kind", route_signal("topic")).filter("kind is not null")
    i = imu_sample()
    imu = F.array(*[i[f"{s}_{k}"] for s in ("accel", "gyro") for k in "xyz"])
    a = action_vector()
    m = m.withColumn("vec", F.when(F.col("kind") == "action", a["vec"]).otherwise(F.when(i.isNotNull(), imu)))
    m = m.withColumn("vec_kind", F.when(F.col("kind") == "action", a["kind"]).otherwise(F.lit("imu"))).filter("vec is not null")
    return m.select("episode_id", "topic", "log_time_ns", "kind", "vec", "vec_kind", *rest)


def stream_signals(messages: DataFrame, stride: int = 1, late: str | None = None, idle: str = "1 hour") -> DataFrame:
    """Signal rows, every ``stride``-th of them.

    With ``late`` rows wait for the watermark and are counted per (episode, kind) in order of their time and topic,
    as ``batch_signals`` counts them. Without it they go as they arrive, counted per (episode, topic).
    """
    if late is None:
        s = routed_signals(messages)
        if stride > 1:
            s = s.groupBy("episode_id", "topic").transformWithStateInPandas(EveryNth(stride), SIGNAL_ROWS, "append", "None")
        return s.withColumn("ts", seconds("log_time_ns"))
    timed = messages.withColumn("event_time", F.timestamp_micros(F.floor(F.col("log_time_ns") / 1000).cast("long")))
    s = routed_signals(timed.withWatermark("event_time", late), "event_time")
    judge = InEventTime(SIGNAL_ROWS, "log_time_ns", ["log_time_ns", "topic"], "seen bigint", EveryNthRow(stride), _milliseconds(idle))
    s = s.groupBy("episode_id", "kind").transformWithStateInPandas(judge, SIGNAL_ROWS, "append", "EventTime")
    return s.withColumn("ts", seconds("log_time_ns"))


def batch_signals(messages: DataFrame, limit: int | None = None, stride: int | None = None) -> DataFrame:
    """Batch form, counted per (episode, kind): the stride is given, or ceil(messages of the kind / limit)."""
    s = routed_signals(messages)
    bucket = F.floor(F.col("log_time_ns") / 1000000000).cast("long")
    r = numbered(s, ["episode_id", "kind"], ["log_time_ns", "topic"], bucket)
    if stride is None:
        n = s.groupBy("episode_id", "kind").agg(F.ceil(F.count(F.lit(1)) / limit).cast("long").alias("stride"))
        r = spread_join(r, n, ["episode_id", "kind"], salt_on="rn")
    else:
        r = r.withColumn("stride", F.lit(stride).cast("long"))
    return r.filter(F.col("rn") % F.col("stride") == 0).drop("rn").withColumn("ts", seconds("log_time_ns"))


def task_quality_sink(finished: DataFrame, load_frames, path: str, checkpoint: str):
    """Keep the quality of tasks up to date with finished episodes, batch by batch.

    ``finished``: stream of (dataset_id, task_index, episode_index). ``load_frames`` maps a table of
    these to the frames to take in; frames of earlier episodes are not read again. An episode is kept as one
    partial of bounded size, and a batch rolls the partials of its tasks up. Partials, roll-up and
    batch number are one commit, so a batch that is repeated changes nothing. Of an episode that
    finishes again the later partial counts.
    """
    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        token = f"{checkpoint}#{number}"
        if any(c["token"] == token for c in commits.log(spark, path)):
            return
        ended = materialise(batch.select(*EP).distinct())
        if ended.isEmpty():
            return
        fresh = materialise(episode_partials(load_frames(ended)))

        def build(seen: list[dict]) -> dict:
            now = fresh.withColumn("version", F.lit(len(seen)).cast("long"))
            mine = commits.stage(now, path)
            all_of = commits.read_part(spark, path, [*[c["parts"]["partials"] for c in seen], mine])
            touched = fresh.select(*TASK).distinct()
            report = quality_of_partials(_latest(all_of.join(touched, TASK, "left_semi"), EP))
            return {"partials": mine, "quality": report.withColumn("version", F.lit(len(seen)).cast("long"))}

        commits.publish(spark, path, build, token)

    return finished.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(*keys, "_r.*").drop("version")


def latest_task_quality(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed roll-up of each task."""
    return _latest(commits.read_committed(spark, path, "quality"), TASK)
