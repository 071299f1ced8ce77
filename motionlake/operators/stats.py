"""Counts, distributions, signal envelopes and dataset roll-ups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.vectors import pct
from motionlake.operators.chunks import materialise, order_stats, spread_join
from motionlake.operators.series import resample
from motionlake.schema import EP, TASK


def episode_summary(frames: DataFrame, fps: float = 30.0) -> DataFrame:
    """Frames and duration: last minus first timestamp, else n / fps."""
    a = frames.groupBy(*EP).agg(F.count(F.lit(1)).alias("n_frames"), (F.max("ts") - F.min("ts")).alias("_d"))
    return a.select(*EP, "n_frames", F.coalesce("_d", F.col("n_frames") / fps).alias("duration_s"))


def task_counts(episodes: DataFrame, name: str = "task_name") -> DataFrame:
    return episodes.groupBy(F.coalesce(F.col(name), F.lit("Unknown")).alias("task_name")).agg(F.count(F.lit(1)).alias("episode_count"))


def frame_count_stats(counts: DataFrame, keys=TASK) -> DataFrame:
    """Mean, population sigma, minimum and maximum of n_frames per key (unrounded)."""
    return counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_episodes"), F.avg("n_frames").alias("mean_frames"), F.stddev_pop("n_frames").alias("std_frames"),
        F.min("n_frames").alias("min_frames"), F.max("n_frames").alias("max_frames"))


def frame_count_outliers(counts: DataFrame, keys=TASK, limit: float = 2.0) -> DataFrame:
    """Every episode with its outlier mark: more than ``limit`` sigmas from the mean."""
    j = spread_join(counts, frame_count_stats(counts, keys), keys)
    far = F.when(F.col("std_frames") > 0, F.abs(F.col("n_frames") - F.col("mean_frames")) / F.col("std_frames") > limit).otherwise(F.lit(False))
    return j.withColumn("is_outlier", far)


def frame_count_distribution(counts: DataFrame, keys=TASK) -> DataFrame:
    """One row per key: rounded mean and sigma, range, number of outliers."""
    o = frame_count_outliers(counts, keys).groupBy(*keys).agg(F.sum(F.col("is_outlier").cast("long")).alias("outliers"))
    s = frame_count_stats(counts, keys)
    return s.join(o, keys).select(*keys, "total_episodes", F.round("mean_frames", 1).alias("mean_frames"), F.round("std_frames", 1).alias("std_frames"),
                                  "min_frames", "max_frames", "outliers")


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def histogram_bins(marked: DataFrame, bins: int = 30, keys=TASK) -> DataFrame:
    """Bin of every episode; the range comes from non-outliers and outliers fall in the end bins."""
    r = marked.groupBy(*keys).agg(F.min(F.when(~F.col("is_outlier"), F.col("n_frames"))).alias("_a"), F.max(F.when(~F.col("is_outlier"), F.col("n_frames"))).alias("_b"),
                                  F.min("n_frames").alias("_c"), F.max("n_frames").alias("_d"))
    r = r.select(*keys, F.coalesce("_a", "_c").alias("lo"), F.coalesce("_b", "_d").alias("hi"))
    r = r.withColumn("width", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1) / F.lit(float(bins)))
    j = spread_join(marked, r, keys)
    raw = F.floor((F.col("n_frames") - F.col("lo")) / F.col("width"))
    return j.withColumn("bin", F.greatest(F.lit(0), F.least(raw, F.lit(bins - 1))).cast("long"))


def frame_count_histogram(marked: DataFrame, bins: int = 30, keys=TASK) -> DataFrame:
    """All bins per key, empty ones included: range, count, whether an outlier fell in.

    The episodes of a bin are the rows of ``histogram_bins``.
    """
    b = materialise(histogram_bins(marked, bins, keys))
    c = b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n"), F.max("is_outlier").alias("_o"))
    edges = b.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("width").alias("width"))
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    j = every.join(c, [*keys, "bin"], "left")
    return j.select(*keys, "bin", _half_up(F.col("lo") + F.col("bin") * F.col("width")).alias("range_start"),
                    _half_up(F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("range_end"),
                    F.coalesce("_n", F.lit(0)).cast("long").alias("count"), F.coalesce("_o", F.lit(False)).alias("has_outlier"))


def pct_from_mean(marked: DataFrame, top: int = 10, keys=TASK) -> DataFrame:
    """First ``top`` outliers per key with their deviation from the rounded mean in percent."""
    mean = F.round("mean_frames", 1)
    dev = F.when(mean > 0, _half_up((F.col("n_frames") - mean) / mean * 100)).otherwise(0)
    w = Window.partitionBy(*keys).orderBy("episode_index")
    return marked.filter("is_outlier").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).select(*EP, "n_frames", dev.cast("long").alias("pct_from_mean"))


# ---------------------------------------------------------------- roll-ups

def dataset_quality_stats(scores: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """Score statistics, grade counts (all five), flag shares and component means per dataset."""
    keys = list(keys)
    share = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    a = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_episodes"), F.avg("overall_score").alias("mean_score"), F.stddev_pop("overall_score").alias("std_score"),
        F.min("overall_score").alias("min_score"), F.max("overall_score").alias("max_score"),
        *[F.sum(F.when(F.col("quality_grade") == g, 1).otherwise(0)).alias(f"grade_{g.lower()}") for g in "ABCDF"],
        share("has_recovery_behaviors").alias("pct_with_recovery"), share("is_diverse").alias("pct_diverse"),
        share("is_smooth").alias("pct_smooth"), share("is_well_synced").alias("pct_well_synced"),
        F.avg("overall_temporal_score").alias("avg_temporal"), F.avg("overall_diversity_score").alias("avg_diversity"))
    q = order_stats(scores, keys, "overall_score", {"p10_score": pct(10), "p90_score": pct(90)}).drop("n")
    return a.join(q, keys)


def compare_datasets(stats: DataFrame) -> DataFrame:
    """Best dataset by three scores and by learning value, with the recommendation text: one row.

    Of equal scores the least id wins.
    """
    learn = F.col("avg_diversity") * 0.5 + F.col("pct_with_recovery") * 0.3 + F.col("avg_temporal") * 0.2
    best = lambda c, n: F.min_by("dataset_id", F.when(F.col(c).isNotNull(), F.struct(-F.col(c), "dataset_id"))).alias(n)
    b = stats.withColumn("learning_score", learn).groupBy().agg(
        best("mean_score", "best_overall"), best("avg_diversity", "best_diversity"), best("avg_temporal", "best_temporal"), best("learning_score", "best_learning"))
    same = F.concat(F.col("best_learning"), F.lit(" is recommended: best overall quality and learning value."))
    other = F.concat(F.col("best_learning"), F.lit(" is recommended for learning value (high diversity and recovery behaviors). "),
                     F.col("best_overall"), F.lit(" has highest overall score."))
    return b.withColumn("recommendation", F.when(F.col("best_learning") == F.col("best_overall"), same).otherwise(other))


# ---------------------------------------------------------------- signal comparison

def envelope_bins(signals: DataFrame, bins: int = 200) -> DataFrame:
    """Resampled signal: (episode, bin, value) from (episode, frame_index, value)."""
    return resample(signals, bins, "value", min_frames=1).drop("n_frames")


def signal_envelope(binned: DataFrame, keys=TASK) -> DataFrame:
    """Mean, sigma and mean +- 2 sigma per bin, for keys with two traces or more."""
    e = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("traces"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return e.filter("traces >= 2").withColumn("upper", F.col("mean") + 2 * F.col("std")).withColumn("lower", F.col("mean") - 2 * F.col("std"))


def outlier_fraction(binned: DataFrame, envelope: DataFrame, listed: float = 0.05, keys=TASK) -> DataFrame:
    """Share of bins outside the envelope and the bin of largest deviation, if above ``listed``."""
    j = spread_join(binned, envelope, [*keys, "bin"])
    out = (F.col("value") > F.col("upper")) | (F.col("value") < F.col("lower"))
    dev = F.struct(F.abs(F.col("value") - F.col("mean")).alias("d"), (-F.col("bin")).alias("o"))
    a = j.groupBy(*EP).agg(F.avg(F.when(out, 1.0).otherwise(0.0)).alias("fraction"), F.max(dev).alias("_d"))
    return a.filter(F.col("fraction") > listed).select(*EP, "fraction", _half_up(F.col("fraction") * 100).alias("pct"), (-F.col("_d.o")).alias("max_deviation_bin"))


def robust_range(signals: DataFrame, keys=TASK) -> DataFrame:
    """Values at ranks floor(.02 n) and ceil(.98 n) - 1 of the pooled signal; +-0.5 when equal."""
    low = lambda n: F.greatest(F.lit(0), F.floor(n * F.lit(0.02)))
    high = lambda n: F.least(n - 1, F.ceil(n * F.lit(0.98)) - 1)
    q = order_stats(signals, keys, "value", {"lo": low, "hi": high})
    flat = F.col("hi") <= F.col("lo")
    return q.select(*keys, "n", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("range_min"),
                    F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("range_max"))


def band_coverage(envelope: DataFrame, ranges: DataFrame, keys=TASK) -> DataFrame:
    """Mean band width over the robust range, and its wording."""
    w = envelope.groupBy(*keys).agg(F.avg(F.col("upper") - F.col("lower")).alias("_w")).join(ranges, keys)
    span = F.col("range_max") - F.col("range_min")
    w = w.withColumn("band_coverage", F.col("_w") / F.when(span == 0, F.lit(1.0)).otherwise(span))
    label = F.when(F.col("band_coverage") < 0.25, "Low Variance").when(F.col("band_coverage") < 0.5, "Med Variance").otherwise("High Variance")
    return w.select(*keys, "band_coverage", label.alias("label"))


# ---------------------------------------------------------------- messages and files

def channel_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"))


def signal_totals(counts: DataFrame) -> DataFrame:
    """Action and IMU message totals from per-topic counts."""
    from motionlake.functions.scalars import route_signal
    k = route_signal("topic")
    return counts.groupBy().agg(F.coalesce(F.sum(F.when(k == "action", F.col("messages"))), F.lit(0)).alias("action_messages"),
                                F.coalesce(F.sum(F.when(k == "imu", F.col("messages"))), F.lit(0)).alias("imu_messages"))


def message_stats(messages: DataFrame) -> DataFrame:
    """Totals of a recording; distinct names are counted over per-name counts."""
    per = messages.groupBy("topic", "schema_name").agg(F.count(F.lit(1)).alias("c"), F.min("log_time_ns").alias("a"), F.max("log_time_ns").alias("b"))
    a = per.groupBy().agg(F.sum("c").alias("message_count"), F.countDistinct("topic").alias("channel_count"), F.countDistinct("schema_name").alias("schema_count"),
                          F.min("a").alias("start_time"), F.max("b").alias("end_time"))
    return a.withColumn("duration_ns", F.col("end_time") - F.col("start_time"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    from motionlake.functions.scalars import extension
    return manifest.groupBy(extension("path").alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))


def episodes_per_file(rows: DataFrame, file: str = "file_path") -> DataFrame:
    """Which episodes each data file holds, one row per (file, episode), with the file's count."""
    pairs = rows.select(F.col(file).alias("file"), *EP).distinct()
    n = pairs.groupBy("file").agg(F.count(F.lit(1)).alias("episodes_in_file"))
    return spread_join(pairs, n, ["file"])
