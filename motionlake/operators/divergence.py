"""How far an episode lies from the median trajectory of its task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.vectors import one_decimal, pct
from motionlake.operators.chunks import episode_lengths, greedy_min_gap, keyed_join, materialise, order_stats, spread_join
from motionlake.operators.series import resample
from motionlake.schema import EP, TASK

BINS = 100

# Names of the first seven action dimensions and how they read.
DIMENSIONS = ["pos_x", "pos_y", "pos_z", "rot_x", "rot_y", "rot_z", "gripper"]
READABLE = ["X position", "Y position", "Z position", "Roll", "Pitch", "Yaw", "Gripper"]


def binned_actions(frames: DataFrame, bins: int = BINS) -> DataFrame:
    """(episode, n_frames, bin, dims, dim, x) for episodes of five frames or more."""
    return by_dimension(resample(frames, bins, "action", min_frames=5))


def by_dimension(resampled: DataFrame) -> DataFrame:
    """One row per bin and dimension, from resampled actions (episode, n_frames, bin, action)."""
    return resampled.select(*EP, "n_frames", "bin", F.size("action").alias("dims"), F.posexplode("action").alias("dim", "x"))


def task_trajectory_stats(binned: DataFrame) -> DataFrame:
    """Median, population sigma and quartiles per (task, size of action, bin, dimension).

    Episodes of different action sizes in one task form separate groups.
    """
    keys = [*TASK, "dims", "bin", "dim"]
    q = order_stats(binned, keys, "x", {"med": pct(50), "p25": pct(25), "p75": pct(75)})
    sd = binned.groupBy(*keys).agg(F.stddev_pop("x").alias("std"))
    return q.join(sd, keys).filter("n >= 2")


def scored_bins(binned: DataFrame, stats: DataFrame) -> DataFrame:
    """z distance of each resampled value to the task median: (episode, n_frames, bin, dim, z)."""
    keys = [*TASK, "dims", "bin", "dim"]
    j = spread_join(binned, stats.select(*keys, "med", "std"), keys)
    return j.select(*EP, "n_frames", "dims", "bin", "dim", (F.abs(F.col("x") - F.col("med")) / F.greatest("std", F.lit(1e-6))).alias("z"))


def scored_vectors(resampled: DataFrame, stats: DataFrame) -> DataFrame:
    """``scored_bins`` with one row per bin: (episode, n_frames, dims, bin, zs array of (dim, z)). Runs a job.

    The statistics of a bin are one row, so the actions meet them once and not once per dimension.
    """
    keys = [*TASK, "dims", "bin"]
    few = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "med", "std"))).alias("_st"))
    rows = resampled.withColumn("dims", F.size("action"))
    j = keyed_join(rows, few, keys)
    z = F.transform("_st", lambda s: F.struct(s["dim"].alias("dim"), (F.abs(F.get("action", s["dim"]) - s["med"]) / F.greatest(s["std"], F.lit(1e-6))).alias("z")))
    return j.select(*EP, "n_frames", "dims", "bin", z.alias("zs"))


def long_scores(vectors: DataFrame) -> DataFrame:
    """One row per bin and dimension, as ``scored_bins`` gives them."""
    return vectors.select(*EP, "n_frames", "dims", "bin", F.inline("zs"))


def vector_divergence(vectors: DataFrame) -> DataFrame:
    """``frame_divergence`` of scored vectors, row by row."""
    known = F.filter("zs", lambda x: x["z"].isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda t, x: t + x["z"] * x["z"]))
    return vectors.select(*EP, "n_frames", "bin", (F.sqrt(total) / F.sqrt("dims")).alias("divergence"))


def frame_divergence(z: DataFrame) -> DataFrame:
    """RMS z over the dimensions: (episode, n_frames, bin, divergence)."""
    return z.groupBy(*EP, "n_frames", "bin").agg((F.sqrt(F.sum(F.col("z") * F.col("z"))) / F.sqrt(F.first("dims"))).alias("divergence"))


def episode_divergence(per_bin: DataFrame, lengths: DataFrame, threshold: float = 2.0, bins: int = BINS) -> DataFrame:
    """Score in 0..1 and number of distinct high frames; short episodes score 0.5."""
    mapped = F.when(F.col("divergence") > threshold, F.floor(F.col("bin") * F.col("n_frames") / bins))
    a = per_bin.groupBy(*EP).agg(F.avg("divergence").alias("m"), F.countDistinct(mapped).alias("high_frames"))
    j = lengths.join(a, EP, "left")
    return j.select(*EP, F.coalesce(F.least(F.lit(1.0), F.col("m") / threshold), F.lit(0.5)).alias("divergence_score"),
                    F.coalesce("high_frames", F.lit(0)).cast("long").alias("high_frames"))


def dimension_means(z: DataFrame) -> DataFrame:
    return z.groupBy(*EP, "dim").agg(F.avg("z").alias("mean_z"))


def original_divergence(per_bin: DataFrame, bins: int = BINS) -> DataFrame:
    """Divergence at the original frames, interpolated between bins.

    Each bin emits the frames that fall between it and the next one.
    """
    nxt = per_bin.select(*EP, (F.col("bin") - 1).alias("bin"), F.col("divergence").alias("_next"))
    j = per_bin.join(nxt, [*EP, "bin"], "left")
    b, n = F.col("bin"), F.col("n_frames")
    lo = F.floor((b * (n - 1) + bins - 2) / (bins - 1)).cast("long")
    hi = F.floor(((b + 1) * (n - 1) + bins - 2) / (bins - 1)).cast("long") - 1
    at = (F.when(b == bins - 1, F.array(n - 1)).when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))
    r = j.select(*EP, "n_frames", "bin", "divergence", "_next", F.explode(at).alias("frame_index"))
    t = (F.col("frame_index") * (bins - 1) - b * (n - 1)) / F.greatest(n - 1, F.lit(1))
    value = F.when(t == 0, F.col("divergence")).otherwise(F.col("divergence") + (F.col("_next") - F.col("divergence")) * t)
    return r.select(*EP, "n_frames", "frame_index", value.alias("divergence"))


def divergence_events(z: DataFrame, per_bin: DataFrame, threshold: float = 2.0, gap: int = 3, bins: int = BINS) -> DataFrame:
    """High-divergence frames at least ``gap`` apart, with the dominant dimension."""
    high = per_bin.filter(F.col("divergence") > threshold).select(
        *EP, "n_frames", F.floor(F.col("bin") * F.col("n_frames") / bins).cast("long").alias("frame_index")).distinct()
    kept = materialise(greedy_min_gap(high, gap))
    value = original_divergence(per_bin).join(kept, [*EP, "frame_index"])
    value = value.withColumn("bin", F.least(F.floor(F.col("frame_index") * bins / F.col("n_frames")), F.lit(bins - 1)).cast("long"))
    # equal up to the last digits counts as a tie, which the first dimension wins
    top = z.groupBy(*EP, "bin").agg(F.max(F.struct(F.round("z", 9).alias("r"), (-F.col("dim")).alias("o"), F.col("z"))).alias("_t"), F.first("dims").alias("dims"))
    j = value.join(top, [*EP, "bin"])
    dim = -F.col("_t.o")
    generic = F.concat(F.lit("dim_"), dim.cast("string"))
    named = lambda names: F.when(F.col("dims") <= len(names), F.get(F.array(*map(F.lit, names)), dim)).otherwise(generic)
    return j.select(*EP, F.col("frame_index").alias("frame"), F.lit("high_divergence").alias("event_type"),
                    F.when(F.col("divergence") > threshold * 1.5, "significant").otherwise("warning").alias("severity"),
                    F.least(F.lit(1.0), F.col("divergence") / (threshold * 2)).alias("score"),
                    F.concat(named(READABLE), F.lit(" "), one_decimal(F.col("_t.z")), F.lit(" std from median")).alias("description"),
                    named(DIMENSIONS).alias("dominant"))


def divergence_category(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s < 0.5, "low").when(s < 1.5, "medium").otherwise("high")


def task_quality(divergence: DataFrame, transitions: DataFrame) -> DataFrame:
    """One row per task: expertise, counts, recovery shares, physics score, verdict.

    ``most_divergent`` names the top three; it is ranked apart so a large task is cut to three
    rows per partition before its shuffle.
    """
    d = divergence.join(transitions, EP).withColumn("cat", divergence_category("divergence_score"))
    count = lambda c: F.sum(F.when(F.col("cat") == c, 1).otherwise(0)).alias(f"n_{c}")
    a = d.groupBy(*TASK).agg(
        F.count(F.lit(1)).alias("num_episodes"), F.avg("divergence_score").alias("mean_divergence"),
        count("low"), count("medium"), count("high"), F.avg("high_frames").alias("high_divergence_frame_density"),
        F.avg(F.when(F.col("has_recovery"), 1.0).otherwise(0.0)).alias("pct_with_recovery"),
        F.avg("recovery_count").alias("mean_recovery_count"), F.avg("near_miss_count").alias("mean_near_miss_count"),
        F.max("has_recovery").alias("has_any_recovery_episodes"))
    a = a.withColumn("expertise_score", F.greatest(F.lit(0.0), 1.0 - F.col("mean_divergence")))
    a = a.withColumn("physics_coverage_score", F.least(F.lit(1.0), 0.3 + F.col("pct_with_recovery") * 0.5
                                                       + F.least(F.lit(0.2), F.col("mean_recovery_count") * 0.1)))
    good, some = F.col("expertise_score") > 0.7, F.col("has_any_recovery_episodes")
    a = a.withColumn("quality_assessment", F.when(good & some, "Excellent - consistent technique with recovery behaviors")
                     .when(good, "Good consistency but lacks recovery behaviors")
                     .when(some, "Good physics coverage but high action variance")
                     .otherwise("Needs review - high variance and no recovery behaviors"))
    w = Window.partitionBy(*TASK).orderBy(F.desc("divergence_score"), "episode_index")
    top = divergence.withColumn("_r", F.row_number().over(w)).filter("_r <= 3")
    top = top.groupBy(*TASK).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_r", "episode_index"))),
                                                              lambda x: F.concat(F.lit("episode_"), x["episode_index"].cast("string")))).alias("most_divergent"))
    return a.join(top, TASK)


def episode_partials(frames: DataFrame, bins: int = BINS) -> DataFrame:
    """What the quality of a task needs of an episode: its resampled actions and its transitions.

    One row per episode of five frames or more, of ``bins`` points however long the episode is, and
    independent of all other episodes: partials of new episodes are added to those already kept.
    """
    from motionlake.operators.scores import transition_metrics
    r = resample(frames, bins, "action", min_frames=5)
    points = r.groupBy(*EP).agg(F.max("n_frames").alias("n_frames"), F.array_sort(F.collect_list(F.struct("bin", "action"))).alias("points"))
    return points.join(transition_metrics(frames), EP)


def quality_of_partials(partials: DataFrame) -> DataFrame:
    """Task quality from partials, one row per task; equals ``task_quality_report`` of all their frames."""
    points = partials.select(*EP, "n_frames", F.inline("points"))
    per_bin = vector_divergence(scored_vectors(points, task_trajectory_stats(by_dimension(points))))
    return task_quality(episode_divergence(per_bin, partials.select(*EP, "n_frames")), partials.drop("n_frames", "points"))


def task_quality_report(frames: DataFrame) -> DataFrame:
    """Task quality of every task in one job."""
    from motionlake.operators.scores import transition_metrics
    points = materialise(resample(frames, BINS, "action", min_frames=5))
    per_bin = vector_divergence(scored_vectors(points, task_trajectory_stats(by_dimension(points))))
    lengths = episode_lengths(frames).filter("n_frames >= 5")
    return task_quality(episode_divergence(per_bin, lengths), transition_metrics(frames))
