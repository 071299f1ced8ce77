"""Adapters from general business tables to trajectories.

Arithmetic only, so that any engine gives equal values. Running positions are sums of whole
numbers: exact in any order of addition.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.operators.chunks import lookup, materialise, scan
from motionlake.schema import CHUNK

_INGESTED: dict = {}


def ingested(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table, built once per session and read back from the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _INGESTED:
        _INGESTED[key] = materialise(build())
    return _INGESTED[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str, bucket_seconds: int = 3600) -> DataFrame:
    """``events`` as frames: one episode per user, ordered by (ts, event_id). Runs a job.

    Only users of more than ``CHUNK`` events are cut by time; all others are one chunk of the scan.
    """
    ev = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"))
    crowded = lookup(ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK).select("user_id"))
    bucket = F.lit(0).cast("long")
    if not crowded.isEmpty():
        ev = ev.join(crowded.withColumn("_many", F.lit(True)), "user_id", "left")
        bucket = F.when(F.col("_many"), F.floor(F.col("us") / (bucket_seconds * 1000000)).cast("long")).otherwise(bucket)
    seq = scan(
        ev, ["user_id"], bucket, ["us", "event_id"],
        frame_index=("sum", F.lit(1).cast("long")),
        first_ts=("min", F.col("us")),
        cx=("sum", F.round(F.col("value") * 100).cast("long")),
        cy=("sum", F.col("event_id") % 97 - 48),
    ).withColumn("frame_index", F.col("frame_index") - 1)
    u, e = F.col("user_id"), F.col("event_id")
    ph = (F.col("frame_index") + u) % 60
    z = (ph - 32) * (ph - 32)
    return seq.select(
        F.concat(F.lit("ds"), (u % 5 % 2).cast("string")).alias("dataset_id"),
        (u % 5).alias("task_index"),
        u.alias("episode_index"),
        "frame_index",
        ((F.col("us") - F.col("first_ts")) / F.lit(1000000.0)).alias("ts"),
        F.array(
            F.col("value") / 100.0, (e % 97) / 97.0 - 0.5, (e % 31) / 31.0 - 0.5,
            F.col("k") / 100.0, (u % 13) / 13.0, (e % 7) / 7.0,
            F.when(ph.between(20, 44), 1.0).otherwise(-1.0)).alias("action"),
        F.array(F.col("cx") / 100000.0, F.col("cy") / 970.0, 1.0 - z / 1024.0).alias("state"),
    )


def task_table(frames: DataFrame) -> DataFrame:
    return frames.select("dataset_id", "task_index").distinct().withColumn(
        "task_description", F.concat(F.lit("task "), F.col("task_index").cast("string")))


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as short 4-dimensional episodes, one per order."""
    li = table(spark, sf_dir, "lineitem")
    seq = scan(
        li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
        ["l_orderkey"], F.col("l_linenumber").cast("long"), ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"],
        frame_index=("sum", F.lit(1).cast("long"))).withColumn("frame_index", F.col("frame_index") - 1)
    return seq.select(
        F.lit("orders").alias("dataset_id"), (F.col("l_orderkey") % 5).alias("task_index"),
        F.col("l_orderkey").alias("episode_index"), "frame_index",
        (F.col("frame_index") / 10.0).alias("ts"),
        F.array(F.col("l_quantity") / 50.0, F.col("l_extendedprice") / 100000.0, F.col("l_discount"), F.col("l_tax")).alias("action"),
        F.array(F.col("l_quantity") / 50.0, F.col("l_discount"), F.col("l_tax")).alias("state"))
