"""Joins, listings and set operations over catalogue tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.operators.chunks import attach, chunk_of
from motionlake.schema import EP, TASK


def tasks_with_counts(tasks: DataFrame, episodes: DataFrame) -> DataFrame:
    """Tasks with episode counts (null where none)."""
    c = episodes.groupBy(*TASK).agg(F.count(F.lit(1)).alias("episode_count"))
    name = F.trim(F.coalesce("task_description", F.lit("")))
    name = F.when(name == "", F.concat(F.lit("Untitled (task "), F.col("task_index").cast("string"), F.lit(")"))).otherwise(name)
    return tasks.join(c, TASK, "left").select(*TASK, name.alias("task_name"), "episode_count")


def episode_task_map(meta: DataFrame, rows: DataFrame) -> DataFrame:
    """Task per episode: metadata first, then the task of the first data row."""
    key = ["dataset_id", "episode_index"]
    first = rows.groupBy(*key).agg(F.min(F.struct("frame_index", "task_index")).alias("_f")).select(*key, F.col("_f.task_index").alias("_row_task"))
    j = meta.select(*key, F.col("task_index").alias("_meta_task")).join(first, key, "full")
    return j.select(*key, F.coalesce("_meta_task", "_row_task").alias("task_index"))


def episodes_of_tasks(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    return episodes.join(tasks.select(*TASK).distinct(), TASK, "left_semi")


def ordered_lookup(ids: DataFrame, meta: DataFrame, key: str = "episode_index") -> DataFrame:
    """Rows in the order of ``pos``; ids without metadata stay as null rows."""
    return ids.join(meta, key, "left")


def enrich_rows(rows: DataFrame, other: DataFrame, columns) -> DataFrame:
    """Fill missing columns from a second copy of the episode, frame by frame."""
    key = [*EP, "frame_index"]
    o = other.select(*key, *[F.col(x).alias(f"_o_{x}") for x in columns])
    return rows.join(o, key, "left").select(*[
        F.coalesce(x, f"_o_{x}").alias(x) if x in columns else F.col(x) for x in rows.columns])


def mirror_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two datasets hold the same number of episodes and frames: one row."""
    total = lambda d, p: d.groupBy().agg(F.count(F.lit(1)).alias(f"{p}_episodes"), F.sum("n_frames").alias(f"{p}_frames"), F.lit(1).alias("_k")).withColumn("_k", F.lit(1))
    j = total(a, "left").join(total(b, "right"), "_k").drop("_k")
    return j.withColumn("is_mirror", (F.col("left_episodes") == F.col("right_episodes")) & (F.col("left_frames") == F.col("right_frames")))


def page(df: DataFrame, order, offset: int = 0, limit: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_info(df: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return df.groupBy().agg(F.count(F.lit(1)).alias("total")).withColumn("has_more", F.col("total") > offset + limit)


def catalogue(entries: DataFrame, sort: str = "downloads", search: str = "") -> DataFrame:
    """Datasets whose id holds the text, most downloaded, liked or recent first."""
    d = entries.filter(F.lower("repo_id").contains(search.lower())) if search else entries
    return d.orderBy(F.desc_nulls_last(sort), "repo_id")


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """First row per key; combined before the shuffle."""
    rest = [x for x in df.columns if x not in keys]
    low = F.struct(*[F.col(o) for o in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), low).alias("_r")).select(*keys, "_r.*")


def id_intersection(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")


def id_difference(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def merge_missing(fresh: DataFrame, cached: DataFrame, keys) -> DataFrame:
    """Cached rows plus the fresh rows whose key is not cached."""
    return cached.unionByName(fresh.join(cached.select(*keys).distinct(), keys, "left_anti"))


def frames_of(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """Frames of the given episodes (with ``n_frames``), joined per chunk."""
    return attach(frames.withColumn("_chunk", chunk_of()), episodes, []).drop("_chunk")


def in_numeric_order(df: DataFrame, episode_id: str = "episode_id") -> DataFrame:
    from motionlake.functions.scalars import numeric_suffix
    return df.orderBy(numeric_suffix(episode_id).asc_nulls_last(), episode_id)

