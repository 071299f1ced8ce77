"""Projections and filters over frames and episodes."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.vectors import minus
from motionlake.operators.chunks import attach, by_frame, chunk_of, chunked, episode_lengths, own
from motionlake.schema import EP, TASK

ACTION_SOURCES = ["action", "observation.state", "end_pose", "start_pos"]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def pick_action(df: DataFrame, name: str = "signal") -> DataFrame:
    """First column present of the action sources; a scalar becomes a 1-vector."""
    found = next((s for s in ACTION_SOURCES if s in df.columns), None)
    if found is None:
        raise ValueError("no action or state column")
    v = _q(found)
    return df.withColumn(name, v if dict(df.dtypes)[found].startswith("array") else F.array(v.cast("double")))


def append_gripper(df: DataFrame, name: str = "signal") -> DataFrame:
    """Append gripper_width unless an action column was picked."""
    if "action" in df.columns or "gripper_width" not in df.columns:
        return df
    g = F.col("gripper_width")
    return df.withColumn(name, F.concat(name, g if dict(df.dtypes)["gripper_width"].startswith("array") else F.array(g.cast("double"))))


def synthesize_action(frames: DataFrame) -> DataFrame:
    """Seven dimensions from state changes and -gripper_width, for data without actions."""
    w = by_frame()
    ch = chunked(frames).withColumn("_p", F.lag("state").over(w))
    step = F.when(F.col("_p").isNotNull(), minus("state", "_p"))
    d = lambda i: F.coalesce(F.get(step, F.lit(i)), F.lit(0.0))
    rot = lambda i: F.when(F.size("state") >= 6, d(i)).otherwise(F.lit(0.0))
    grip = -F.col("gripper_width") if "gripper_width" in frames.columns else F.lit(0.0)
    return own(ch.withColumn("action", F.array(d(0), d(1), d(2), rot(3), rot(4), rot(5), grip))).drop("_p", "_chunk")


def synth_timestamps(df: DataFrame, rate: float = 10.0) -> DataFrame:
    """ts_sec: the timestamp, else frame_index / rate (also per row where it is null)."""
    made = F.col("frame_index") / F.lit(float(rate))
    return df.withColumn("ts_sec", F.coalesce(F.col("ts"), made) if "ts" in df.columns else made)


def filter_task(episodes: DataFrame, tasks: DataFrame, name: str) -> DataFrame:
    """Episodes of a task by description or ``Untitled (task N)``; ``_all_`` or empty keeps all."""
    if name in ("_all_", ""):
        return episodes
    untitled = re.match(r"^Untitled \(task (\d+)\)$", name)
    hit = F.col("task_description") == name
    if untitled:
        hit = hit | (F.col("task_index") == int(untitled.group(1)))
    wanted = tasks.filter(hit).select(*TASK)
    return episodes.join(wanted.distinct(), TASK, "left_semi")


def search_tasks(tasks: DataFrame, text: str) -> DataFrame:
    return tasks.filter(F.lower("task_description").contains(text.lower()))


def _with_length(frames: DataFrame) -> DataFrame:
    return attach(frames.withColumn("_chunk", chunk_of()), episode_lengths(frames), ["n_frames"]).drop("_chunk")


def stride_frames(frames: DataFrame, limit: int) -> DataFrame:
    """Every stride-th frame, stride = ceil(n / limit) for episodes longer than the limit."""
    f = _with_length(frames).withColumn("stride", F.when(F.col("n_frames") > limit, F.ceil(F.col("n_frames") / limit)).otherwise(1).cast("long"))
    return f.filter(F.col("frame_index") % F.col("stride") == 0)


def downsample(frames: DataFrame, max_points: int) -> DataFrame:
    """Frames at int(i * n / max) for i < max, when an episode is longer than max."""
    f = _with_length(frames)
    i, n = F.col("frame_index"), F.col("n_frames")
    # frame f is taken by the first i with floor(i*n/max) = f
    first = F.floor((i * max_points + n - 1) / n)
    f = f.withColumn("point", F.when(n > max_points, first).otherwise(i).cast("long"))
    return f.filter((n <= max_points) | ((F.col("point") < max_points) & (F.floor(F.col("point") * n / max_points) == i)))


def slice_frames(frames: DataFrame, start: int, end: int) -> DataFrame:
    return frames.filter((F.col("frame_index") >= start) & (F.col("frame_index") < end))


def frame_at(frames: DataFrame, ts: float) -> DataFrame:
    """Nearest frame to a time, the first on ties, per episode."""
    best = F.min(F.struct(F.abs(F.col("ts") - ts).alias("d"), F.col("frame_index").alias("f"), F.col("ts").alias("t")))
    return frames.filter("ts is not null").groupBy(*EP).agg(best.alias("_b")).select(*EP, F.col("_b.f").alias("frame_index"), F.col("_b.t").alias("ts"))


def even_sample(frames: DataFrame, k: int) -> DataFrame:
    """min(k, n) frames per episode spread evenly, both ends included."""
    f = _with_length(frames)
    n, i = F.col("n_frames"), F.col("frame_index")
    m = F.least(F.lit(k), n)
    gaps = F.greatest(m - 1, F.lit(1))
    j = F.floor((i * gaps + F.greatest(n - 1, F.lit(1)) - 1) / F.greatest(n - 1, F.lit(1)))
    return f.filter((j < m) & (F.floor(j * (n - 1) / gaps) == i))


def edge_rows(frames: DataFrame, n: int, side: str = "first") -> DataFrame:
    """First or last n frames of each episode."""
    if side == "first":
        return frames.filter(F.col("frame_index") < n)
    return _with_length(frames).filter(F.col("frame_index") >= F.col("n_frames") - n).drop("n_frames")


def edge_frames(episodes: DataFrame, side: str, fps: float = 30.0) -> DataFrame:
    """Target video time of the first or last frame of an episode."""
    t0, t1 = F.col("from_timestamp"), F.col("to_timestamp")
    target = F.greatest(t0, t1 - 1.0 / max(fps, 1.0)) if side == "end" else t0
    return episodes.withColumn("target_ts", target)


def position_series(frames: DataFrame) -> DataFrame:
    """Comparison export: (episode, frame_index, ts, entity, value) in long form."""
    a = F.col("action")
    part = lambda lo, n: F.sqrt(F.aggregate(F.slice(a, lo, n), F.lit(0.0), lambda s, x: s + x * x))
    cell = lambda name, v: F.struct(F.lit(name).alias("entity"), v.alias("value"))
    fixed = F.array(cell("position_mag", part(1, 3)), *[cell(k, F.get(a, F.lit(i))) for i, k in enumerate("xyz")],
                    cell("rotation_mag", F.when(F.size(a) > 3, part(4, 3))))
    grips = F.transform(F.slice(a, F.lit(7), F.greatest(F.size(a), F.lit(1))), lambda g: F.struct(F.lit("gripper").alias("entity"), g.alias("value")))
    rows = F.filter(F.concat(fixed, grips), lambda x: x["value"].isNotNull())
    return frames.filter("action is not null").select(*EP, "frame_index", "ts", F.inline(rows))


def semantic_series(frames: DataFrame, names, column: str = "action", prefix: str = "action") -> DataFrame:
    """One series per named dimension; unnamed dimensions become dim_i."""
    labels = F.array(*map(F.lit, names)) if names else F.transform(F.sequence(F.lit(0), F.size(column) - 1), lambda i: F.concat(F.lit("dim_"), i.cast("string")))
    zipped = F.zip_with(labels, column, lambda n, v: F.struct(F.concat(F.lit(prefix + "/"), n).alias("entity"), v.alias("value")))
    rows = F.filter(zipped, lambda x: x["entity"].isNotNull() & x["value"].isNotNull())
    return frames.select(*EP, "frame_index", "ts", F.inline(rows))
