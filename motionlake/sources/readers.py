"""Readers: files and nested tables to the canonical frames and catalogue tables."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.functions.scalars import extension
from motionlake.operators.chunks import numbered
from motionlake.operators.projections import append_gripper, pick_action
from motionlake.schema import CHUNK

SIGNAL_COLUMNS = ["dataset_id", "episode_index", "episode_id", "frame_index", "index", "timestamp", "task_index",
                  "action", "observation.state", "end_pose", "start_pos", "gripper_width"]
EPISODE_FILES = ["mcap", "tar", "mp4", "hdf5", "h5", "parquet"]


def _q(name: str):
    return F.col(f"`{name}`")


def read_frames(spark: SparkSession, path: str, wanted=None) -> DataFrame:
    """Frame parquet with only the signal columns that exist; image columns are never read."""
    df = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)
    return df.select(*[_q(c) for c in (wanted or SIGNAL_COLUMNS) if c in df.columns])


def canonical_frames(df: DataFrame, dataset_id: str = "dataset", rate: float = 10.0) -> DataFrame:
    """Signal columns to (dataset_id, task_index, episode_index, frame_index, ts, action, state)."""
    if "frame_index" not in df.columns:
        # ``index`` runs on over the dataset: frames are its places in each episode
        keys = [c for c in ("dataset_id", "episode_index") if c in df.columns]
        places = numbered(df.select(*keys, "index"), keys, "index", F.floor(F.col("index") / CHUNK), "frame_index")
        df = df.join(places, [*keys, "index"])
    picked = append_gripper(pick_action(df, "_signal"), "_signal")
    has = set(df.columns)
    frame = F.col("frame_index")
    state = _q("observation.state") if "observation.state" in has else F.array().cast("array<double>")
    made = frame / F.lit(float(rate))
    return picked.select(
        F.col("dataset_id") if "dataset_id" in has else F.lit(dataset_id).alias("dataset_id"),
        (F.col("task_index") if "task_index" in has else F.lit(0)).cast("long").alias("task_index"),
        F.col("episode_index").cast("long").alias("episode_index"), frame.cast("long").alias("frame_index"),
        (F.coalesce(F.col("timestamp"), made) if "timestamp" in has else made).cast("double").alias("ts"),
        F.col("_signal").cast("array<double>").alias("action"), state.cast("array<double>").alias("state"))


def read_episodes_meta(spark: SparkSession, path: str) -> DataFrame:
    """Chunked episode metadata as one table."""
    return spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(path)


def video_ranges(meta: DataFrame) -> DataFrame:
    """Wide ``videos/<key>/<field>`` columns to one row per episode and video key."""
    keys = sorted({c.split("/")[1] for c in meta.columns if c.startswith("videos/") and c.endswith("/file_index")})
    cell = lambda k: F.struct(F.lit(k).alias("video_key"), *[
        (_q(f"videos/{k}/{f}") if f"videos/{k}/{f}" in meta.columns else F.lit(None)).cast(t).alias(f)
        for f, t in (("chunk_index", "long"), ("file_index", "long"), ("from_timestamp", "double"), ("to_timestamp", "double"))])
    rest = [_q(c) for c in meta.columns if not c.startswith("videos/")]
    return meta.select(*rest, F.inline(F.array(*map(cell, keys))))


def read_tasks_meta(df: DataFrame) -> DataFrame:
    """task_index and task_description; else the first other column holds the description."""
    cols = df.columns
    text = "task_description" if "task_description" in cols else next((c for c in cols if c != "task_index"), None)
    if text is None:
        raise ValueError("no description column")
    if "task_index" not in cols:
        raise ValueError("no task_index column")
    number = F.col("task_index")
    keep = [F.col("dataset_id")] if "dataset_id" in cols and text != "dataset_id" else []
    return df.select(*keep, number.cast("long").alias("task_index"), _q(text).cast("string").alias("task_description"))


def file_manifest(spark: SparkSession, root: str, max_depth: int | None = None) -> DataFrame:
    """Episode files below a folder with sizes, ``max_depth`` folders deep if given; content is not read."""
    base = root.rstrip("/")
    literal = re.sub(r"([\[\]{}*?\\])", r"\\\1", base)  # signs that would match other folders
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.{" + ",".join(EPISODE_FILES) + "}").load(literal).select("path", F.col("length").alias("size_bytes")))
    base = F.lit((base[len("file:"):] if base.startswith("file:") else base) + "/")
    at = F.instr("path", base)
    rel = F.when(at > 0, F.col("path").substr(at + F.length(base), F.length("path"))).otherwise(F.col("path"))
    out = files.select(rel.alias("path"), "size_bytes").withColumn("ext", extension("path"))
    return out if max_depth is None else out.filter(F.size(F.split("path", "/")) - 1 <= max_depth)


MESSAGE_XYZ = "struct<x:double,y:double,z:double>"
MESSAGE_QUAT = "struct<x:double,y:double,z:double,w:double>"
PAYLOAD = ("struct<data:array<double>,position_list:array<double>,"
           f"linear:{MESSAGE_XYZ},angular:{MESSAGE_XYZ},pose:struct<position:{MESSAGE_XYZ},orientation:{MESSAGE_QUAT}>,"
           f"position:{MESSAGE_XYZ},orientation:{MESSAGE_QUAT},linear_acceleration:{MESSAGE_XYZ},angular_velocity:{MESSAGE_XYZ},"
           "linear_acceleration_x:double,linear_acceleration_y:double,linear_acceleration_z:double,"
           "angular_velocity_x:double,angular_velocity_y:double,angular_velocity_z:double>")
MESSAGE_SCHEMA = f"episode_id string, topic string, schema_name string, log_time_ns bigint, payload {PAYLOAD}"


def read_messages(spark: SparkSession, path: str, fmt: str = "json", streaming: bool = False) -> DataFrame:
    """Decoded messages: (episode_id, topic, schema_name, log_time_ns, payload)."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(MESSAGE_SCHEMA).format(fmt).load(path)


def read_step_sequences(df: DataFrame, fps: float = 5.0) -> DataFrame:
    """One row per episode with flat lists to frames; the dimension is length / steps.

    Columns: episode_index, action_flat, state_flat, is_first, [language].
    """
    n = F.size("is_first")
    dim = lambda c: F.when(n > 0, F.floor(F.size(c) / n)).otherwise(0).cast("int")
    rows = df.filter(n > 0).select("episode_index", F.posexplode("is_first").alias("frame_index", "_f"), "action_flat", "state_flat",
                                   dim("action_flat").alias("_da"), dim("state_flat").alias("_ds"), *(["language"] if "language" in df.columns else []))
    cut = lambda c, d: F.slice(F.col(c), F.col("frame_index") * F.col(d) + 1, F.col(d)).cast("array<double>")
    rest = ["language"] if "language" in df.columns else []
    return rows.select("episode_index", F.col("frame_index").cast("long").alias("frame_index"), (F.col("frame_index") / F.lit(float(fps))).alias("ts"),
                       cut("action_flat", "_da").alias("action"), cut("state_flat", "_ds").alias("state"), *rest)


def read_nested_demos(df: DataFrame, rate: float = 20.0) -> DataFrame:
    """(suite, task_file, demo, frame_index, ...) rows with id suite/task/demo and a title-cased task."""
    return df.filter(F.col("demo").startswith("demo_")).select(
        "*", F.concat_ws("/", F.coalesce(F.nullif("suite", F.lit("")), F.lit("default")), "task_file", "demo").alias("episode_id"),
        F.initcap(F.replace("task_file", F.lit("_"), F.lit(" "))).alias("task_name"), (F.col("frame_index") / F.lit(float(rate))).alias("ts"))


def read_clip_samples(df: DataFrame) -> DataFrame:
    """Clip rows (key, url, json) to metadata with defaults; factory and worker also from the path."""
    meta = F.from_json("json", "struct<fps:double,width:bigint,height:bigint,factory_id:string,worker_id:string,duration_sec:double>")
    part = lambda p: F.get(F.reverse(F.filter(F.split("url", "/"), lambda x: x.startswith(p))), F.lit(0))
    d = df.withColumn("_m", meta)
    return d.select("key", F.regexp_replace(F.element_at(F.split("url", "/"), -1), r"\.tar$", "").alias("archive"), F.coalesce("_m.fps", F.lit(30.0)).alias("fps"),
                    F.coalesce("_m.width", F.lit(1920)).alias("width"), F.coalesce("_m.height", F.lit(1080)).alias("height"),
                    F.coalesce("_m.factory_id", part("factory_")).alias("factory_id"), F.coalesce("_m.worker_id", part("worker_")).alias("worker_id")).withColumn(
        "task_name", F.concat(F.col("factory_id"), F.lit("/"), F.col("worker_id")))


def read_multi_subdatasets(spark: SparkSession, root: str) -> DataFrame:
    """Sub-datasets ``root/<sub>/**/*.parquet`` as one table, ids prefixed ``sub/episode_N``."""
    df = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(root)
    base = root.rstrip("/").split("/")[-1]
    sub = F.regexp_extract(F.col("_metadata.file_path"), "/" + base + "/([^/]+)/", 1)
    return df.withColumn("dataset_id", sub).withColumn("episode_id", F.concat(F.col("dataset_id"), F.lit("/episode_"), F.col("episode_index").cast("string")))


def with_file(df: DataFrame) -> DataFrame:
    """Add the data file each row was read from."""
    return df.withColumn("file_path", F.col("_metadata.file_path"))
