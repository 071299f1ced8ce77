"""Episode scores, all as grouped sums over per-frame expressions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.vectors import clip
from motionlake.operators import events as ev
from motionlake.operators.chunks import attach, by_frame, chunked, episode_lengths, materialise, own, spread_join
from motionlake.operators.series import autocorr_decay, cross_corr, derivatives, motion_signals, spectral_low_share
from motionlake.schema import EP


def _scored(value: Column, name: str):
    return [*EP, value.cast("double").alias(name)]


# ---------------------------------------------------------------- temporal

def per_dimension(frames: DataFrame, statistic, name: str) -> DataFrame:
    """(episode, n_frames, array of a statistic of each action dimension), in one grouping without a row per cell. Runs a job."""
    most = frames.agg(F.max(F.size("action"))).first()[0] or 0
    cells = F.array(*[statistic(F.get("action", F.lit(i))) for i in range(most)]) if most > 0 else F.array().cast("array<double>")
    held = frames.filter(F.size("action") > 0)
    return held.groupBy(*EP).agg(F.count(F.lit(1)).alias("n_frames"), F.slice(cells, F.lit(1), F.max(F.size("action"))).alias(name))


def motion_smoothness(frames: DataFrame) -> DataFrame:
    """.4 jerk, .3 acceleration reversals, .3 low-frequency share."""
    d = derivatives(frames)
    w = by_frame()
    # one row per episode, one cell per dimension
    def scale(x):
        sd = F.stddev_pop(x)
        return F.when(sd < 1e-8, F.lit(1.0)).otherwise(sd)

    sd = per_dimension(frames, scale, "sd")
    turn = F.zip_with("acc", F.lag("acc").over(w), lambda a, b: F.when(F.signum(a) != F.signum(b), 1.0).otherwise(0.0))
    j = attach(own(d.withColumn("turn", turn)), sd, ["n_frames", "sd"])
    j = j.select(*EP, "n_frames",
                 F.sqrt(F.aggregate(F.zip_with("jerk", "sd", lambda a, s: (a / s) * (a / s)), F.lit(0.0), lambda t, x: t + x)).alias("jn"),
                 (F.aggregate("turn", F.lit(0.0), lambda t, x: t + x) / F.size("turn")).alias("share"))
    agg = j.groupBy(*EP, "n_frames").agg(F.avg("jn").alias("jn"), F.avg("share").alias("share"))
    both = agg.join(spectral_low_share(frames), EP)
    reversal = F.when(F.col("n_frames") > 3, 1.0 - F.col("share")).otherwise(F.lit(0.5))
    score = clip(0.4 * clip(1.0 - F.col("jn") / 0.5) + 0.3 * reversal + 0.3 * F.col("spectral"))
    return both.select(*_scored(F.when(F.col("n_frames") < 4, F.lit(0.5)).otherwise(score), "motion_smoothness"))


def frame_rate_consistency(frames: DataFrame, expected_fps: float = 30.0) -> DataFrame:
    w = by_frame()
    d = own(chunked(frames.select(*EP, "frame_index", "ts")).withColumn("_d", F.col("ts") - F.lag("ts").over(w)))
    a = d.groupBy(*EP).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("m"), F.stddev_pop("_d").alias("s"))
    step = 1.0 / expected_fps
    score = clip(1.0 - F.col("s") / F.col("m") - F.abs(F.col("m") - step) / step * 0.5)
    value = (F.when((F.col("n") > 1) & (F.col("m") < 1e-8), F.lit(0.5)).when(F.col("n") > 1, score)
             .otherwise(F.when(F.col("n") > 10, 0.8).otherwise(0.5)))
    return a.select(*_scored(value, "frame_rate_consistency"))


def frame_rate_without_timestamps(frames: DataFrame) -> DataFrame:
    n = F.col("n_frames")
    return episode_lengths(frames).select(*_scored(F.when(n > 10, F.lit(0.8)).otherwise(F.lit(0.5)), "frame_rate_consistency"))


def action_consistency(frames: DataFrame) -> DataFrame:
    d = own(derivatives(frames)).select(*EP, F.size("action").alias("dims"), F.transform("vel", lambda x: F.abs(x)).alias("v"))
    far = lambda part, t: F.when(F.exists(part, lambda x: x > t), 1.0).otherwise(0.0)
    some = F.col("v").isNotNull()
    a = d.groupBy(*EP).agg(
        F.count(F.lit(1)).alias("n"), F.max("dims").alias("dims"),
        F.avg(F.when(some, far(F.slice("v", 1, 3), 0.2))).alias("p"),
        F.avg(F.when(some, far(F.slice("v", 4, 3), 1.0))).alias("r"),
        F.avg(F.when(some, F.least(F.get("v", F.lit(6)), F.lit(0.5)) / 0.5)).alias("g"),
        F.avg(F.when(some, far(F.col("v"), 0.5))).alias("any"))
    full = 0.4 * (1.0 - F.col("p")) + 0.3 * (1.0 - F.col("r")) + 0.3 * (1.0 - F.col("g") * 0.5)
    value = F.when(F.col("n") < 2, F.lit(0.5)).when(F.col("dims") >= 7, clip(full)).otherwise(clip(1.0 - F.col("any")))
    return a.select(*_scored(value, "action_consistency"))


def sync_score(frames: DataFrame, image_motion: DataFrame = None) -> DataFrame:
    """Autocorrelation decay; with an image motion series, lag-penalised cross-correlation."""
    base = autocorr_decay(frames)
    alone = base.select(*_scored(F.when(F.col("n_frames") < 3, F.lit(0.5)).otherwise(F.col("decay")), "sync_score"))
    if image_motion is None:
        return alone
    s = own(motion_signals(frames)).filter("speed3 is not null").select(*EP, F.col("frame_index") - 1, F.col("speed3").alias("x"))
    s = s.toDF(*EP, "frame_index", "x").join(image_motion.select(*EP, "frame_index", F.col("motion").alias("y")), [*EP, "frame_index"])
    cc = cross_corr(s)
    score = clip(0.7 * clip((F.col("peak") + 1) / 2) + 0.3 * (1.0 - F.abs("lag") / (F.col("lag_range") + 1)))
    seen = cc.select(*EP, F.when(F.col("n") < 3, F.lit(0.5)).otherwise(score).alias("_seen"))
    return alone.join(seen, EP, "left").select(*_scored(F.coalesce("_seen", "sync_score"), "sync_score"))


def trajectory_completeness(frames: DataFrame, labels: DataFrame = None, min_length: int = 10) -> DataFrame:
    """.6 length + .4 settled end; an explicit success label wins."""
    lengths = episode_lengths(frames)
    d = attach(own(derivatives(frames)), lengths, ["n_frames"])
    tail = d.filter(F.col("frame_index") >= F.col("n_frames") - 4).select(*EP, F.explode("vel").alias("x"))
    settled = tail.groupBy(*EP).agg(F.avg(F.abs("x")).alias("v"))
    j = lengths.join(settled, EP, "left")
    n = F.col("n_frames")
    end = F.when(n > 5, clip(1.0 - F.col("v") * 5)).otherwise(F.lit(0.5))
    out = j.select(*_scored(0.6 * F.least(F.lit(1.0), n / float(min_length)) + 0.4 * end, "trajectory_completeness"))
    if labels is None:
        return out
    j = out.join(labels.select(*EP, "success"), EP, "left")
    value = F.when(F.col("success"), F.lit(1.0)).when(~F.col("success"), F.lit(0.3)).otherwise(F.col("trajectory_completeness"))
    return j.select(*_scored(value, "trajectory_completeness"))


def temporal_score(frames: DataFrame, labels: DataFrame = None, timestamps: bool = True, image_motion: DataFrame = None) -> DataFrame:
    """.30 smoothness, .10 frame rate, .20 consistency, .15 completeness, .25 sync."""
    rate = frame_rate_consistency(frames) if timestamps else frame_rate_without_timestamps(frames)
    out = (motion_smoothness(frames).join(rate, EP).join(action_consistency(frames), EP)
           .join(trajectory_completeness(frames, labels), EP).join(sync_score(frames, image_motion), EP))
    return out.withColumn("overall_temporal_score", 0.30 * F.col("motion_smoothness") + 0.10 * F.col("frame_rate_consistency")
                          + 0.20 * F.col("action_consistency") + 0.15 * F.col("trajectory_completeness") + 0.25 * F.col("sync_score"))


# ---------------------------------------------------------------- diversity

def digitize(x, bins: int = 10) -> Column:
    """How many of the evenly spaced edges in [-1, 1] lie at or below x."""
    edges = [i * (2.0 / (bins - 1)) - 1.0 for i in range(bins - 1)] + [1.0]
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))


def distinct_patterns(frames: DataFrame, bins: int = 10) -> DataFrame:
    """Distinct discretised action changes: (episode, n_frames, patterns, steps)."""
    d = own(derivatives(frames)).select(*EP, F.transform("vel", lambda x: digitize(x, bins)).alias("p"))
    # count per pattern first, so a long episode is combined before its final sum
    per = d.groupBy(*EP, "p").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(*EP).agg(
        F.sum("c").alias("n_frames"), F.count("p").alias("patterns"),
        F.coalesce(F.sum(F.when(F.col("p").isNotNull(), F.col("c"))), F.lit(0)).alias("steps"))


def transition_diversity(frames: DataFrame, bins: int = 10) -> DataFrame:
    p = distinct_patterns(frames, bins)
    value = F.when(F.col("n_frames") < 5, F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.col("patterns") / (F.col("steps") * 0.3)))
    return p.select(*_scored(value, "transition_diversity"))


def recovery_score(frames: DataFrame, events: DataFrame = None) -> DataFrame:
    """Score from event density per 30 frames and the number of notable events."""
    events = ev.all_events(frames) if events is None else events
    c = events.groupBy(*EP).agg(F.count(F.lit(1)).alias("total"),
                                F.sum(F.when(F.col("severity").isin("significant", "warning"), 1).otherwise(0)).alias("strong"))
    j = episode_lengths(frames).join(c, EP, "left")
    d = F.col("total") / (F.col("n_frames") / 30.0)
    base = (F.when(d < 0.2, 0.3 + 0.3 * (d / 0.2)).when(d < 3.0, 0.6 + 0.4 * F.least(F.lit(1.0), d / 2.0))
            .otherwise(F.greatest(F.lit(0.5), 1.0 - (d - 3.0) * 0.1)))
    value = (F.when((F.col("n_frames") < 10) | F.col("total").isNull(), F.lit(0.2))
             .otherwise(F.least(F.lit(1.0), base + F.least(F.lit(0.2), F.col("strong") * 0.05))))
    return j.select(*_scored(value, "recovery_behavior_score"))


def near_miss_ratio(frames: DataFrame, ready: DataFrame = None) -> DataFrame:
    ready = ev.prepared(frames) if ready is None else ready
    w = by_frame()
    r = own(ready.withColumn("_post", F.avg("accel_all").over(w.rowsBetween(1, 4))))
    high = F.col("accel_all") > F.col("accel_all_p90")
    near = high & (F.col("frame_index") < F.col("n_frames") - 5) & (F.col("_post") < F.col("accel_all_p90") * 0.3)
    a = r.groupBy(*EP).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(high, 1).otherwise(0)).alias("h"),
                           F.sum(F.when(near, 1).otherwise(0)).alias("m"))
    return a.select(*_scored(F.when((F.col("n") < 10) | (F.col("h") == 0), F.lit(0.0)).otherwise(F.col("m") / F.col("h")), "near_miss_ratio"))


def action_space_coverage(frames: DataFrame) -> DataFrame:
    r = per_dimension(frames, lambda x: F.log(clip((F.max(x) - F.min(x)) / 2.0) + 0.01), "g")
    known = F.filter("g", lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size(known), F.lit(0))
    return r.select(*_scored(F.when(F.col("n_frames") < 2, F.lit(0.0)).otherwise(clip(F.exp(mean))), "action_space_coverage"))


#: A key is cut into BLOCKS blocks, of MOST_ROWS rows at most.
BLOCKS, MOST_ROWS = 12, 1 << 13


def block_cells(vectors: DataFrame, keys, block: int) -> tuple[DataFrame, DataFrame]:
    """Per key (n, number of blocks), and the rows of every pair of blocks: (key, _b, vec, p, q).

    A block has ``block`` rows or more: with the size of the key it grows up to MOST_ROWS, so that a row goes to
    BLOCKS cells and not to one for every ``block`` rows.
    """
    size = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows_of = F.greatest(F.lit(block), F.least(F.ceil(F.col("n") / BLOCKS), F.lit(MOST_ROWS)))
    size = size.withColumn("_nb", F.ceil(F.col("n") / rows_of).cast("int"))
    rows = spread_join(vectors.select(*keys, "id", "vec"), size, keys, salt_on="id")
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int"))
    # block b meets every block: as the first of a pair (b, x >= b) or the second (x < b, b)
    meet = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1),
                       lambda x: F.struct(F.least(x, F.col("_b")).alias("p"), F.greatest(x, F.col("_b")).alias("q")))
    return size, rows.select(*keys, "_b", "vec", F.inline(meet))


def distance_sum(a, b=None, step: int = 1 << 20) -> float:
    """Sum of the distances of all pairs of rows of ``a``, or of rows of ``a`` with rows of ``b``.

    Squares come from products of matrices, some ``step`` pairs at a time. Pairs that lie close for their lengths, or
    whose squares are no numbers, are differenced entry by entry, so nothing cancels.
    """
    import numpy as np

    other, total = a if b is None else b, 0.0
    if not len(a) or not len(other):
        return total
    mid = a.mean(0) if np.isfinite(a).all() and np.isfinite(other).all() else np.zeros(a.shape[1])
    with np.errstate(all="ignore"):
        x, y = a - mid, other - mid
        xx, yy = (x * x).sum(1), (y * y).sum(1)
        height = max(1, step // len(other))
        for k in range(0, len(a), height):
            both = xx[k:k + height, None] + yy[None]
            square = both - 2 * (x[k:k + height] @ y.T)
            far = square > 1e-6 * both
            wanted = np.ones_like(far) if b is not None else np.arange(len(other))[None] > np.arange(k, min(k + height, len(a)))[:, None]
            total += float(np.sqrt(square[far & wanted]).sum())
            i, j = np.nonzero(wanted & ~far)
            for c in range(0, len(i), 1 << 15):
                total += float(np.sqrt(((a[i[c:c + (1 << 15)] + k] - other[j[c:c + (1 << 15)]]) ** 2).sum(1)).sum())
    return total


def starting_distance(vectors: DataFrame, keys, block: int = 1024) -> DataFrame:
    """Mean pairwise distance of one vector per row, per key: (key, n, mean_distance).

    Rows are cut into hashed blocks and only block pairs meet; a task gets two blocks and
    returns one partial sum, so no pair is emitted and a hot key spreads over its block pairs.
    The number of blocks follows the measured size of the key (``block_cells``).
    """
    import numpy as np
    import pandas as pd

    size, cells = block_cells(vectors, keys, block)
    fields = ", ".join(f"{k} {dict(vectors.dtypes)[k]}" for k in keys)

    def partial(key, pdf):
        k, (p, q) = key[:len(keys)], key[len(keys):]
        stacked = lambda at: np.stack(rows) if (rows := pdf.loc[pdf["_b"] == at, "vec"].to_list()) else np.zeros((0, 1))
        total = distance_sum(stacked(p)) if p == q else distance_sum(stacked(p), stacked(q))
        return pd.DataFrame([[*k, total]], columns=[*keys, "s"])

    sums = cells.groupBy(*keys, "p", "q").applyInPandas(partial, f"{fields}, s double").groupBy(*keys).agg(F.sum("s").alias("s"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return size.join(sums, keys).select(*keys, "n", F.when(F.col("n") > 1, F.col("s") / pairs).alias("mean_distance"))


def starting_state_diversity(frames: DataFrame) -> DataFrame:
    """Mean distance of the first actions of a task's episodes, over 0.5: one row per task."""
    first = frames.filter("frame_index = 0").select("dataset_id", "task_index", F.col("episode_index").alias("id"), F.col("action").alias("vec"))
    d = starting_distance(first, ["dataset_id", "task_index"])
    value = F.when(F.col("n") < 2, F.lit(0.5)).otherwise(clip(F.col("mean_distance") / 0.5))
    return d.select("dataset_id", "task_index", "n", value.alias("starting_state_diversity"))


def diversity_score(frames: DataFrame, compare_starts: bool = False) -> DataFrame:
    """.20 transitions, .35 recovery, .20 near misses, .15 coverage, .10 starts."""
    ready = materialise(ev.prepared(frames))
    out = (transition_diversity(frames).join(recovery_score(frames, ev.all_events(frames, ready)), EP)
           .join(near_miss_ratio(frames, ready), EP).join(action_space_coverage(frames), EP))
    if compare_starts:
        out = spread_join(out, starting_state_diversity(frames).drop("n"), ["dataset_id", "task_index"])
    else:
        out = out.withColumn("starting_state_diversity", F.lit(0.5))
    return out.withColumn("overall_diversity_score", 0.20 * F.col("transition_diversity") + 0.35 * F.col("recovery_behavior_score")
                          + 0.20 * F.col("near_miss_ratio") + 0.15 * F.col("action_space_coverage") + 0.10 * F.col("starting_state_diversity"))


def transition_metrics(frames: DataFrame, ready: DataFrame = None) -> DataFrame:
    """Counts of recoveries, near misses and corrections with their score."""
    ready = ev.prepared(frames) if ready is None else ready
    found = (ev.recovery_events(frames, ready=ready).select(*EP, "event_type")
             .unionByName(ev.near_miss_events(frames).select(*EP, "event_type"))
             .unionByName(ev.correction_events(frames).select(*EP, "event_type")))
    count = lambda t: F.sum(F.when(F.col("event_type") == t, 1).otherwise(0))
    c = found.groupBy(*EP).agg(count("recovery").alias("r"), count("near_miss").alias("m"), count("correction").alias("c"))
    j = episode_lengths(frames).join(c, EP, "left")
    long_enough = F.col("n_frames") >= 10
    r, m, k = (F.when(long_enough, F.coalesce(F.col(x), F.lit(0))).otherwise(0) for x in ("r", "m", "c"))
    j = j.select(*EP, "n_frames", r.cast("long").alias("recovery_count"), m.cast("long").alias("near_miss_count"), k.cast("long").alias("correction_count"))
    density = (F.col("recovery_count") + F.col("near_miss_count") * 0.5 + F.col("correction_count") * 0.3) / F.greatest(F.lit(1.0), F.col("n_frames") / 30.0)
    base = F.least(F.lit(1.0), 0.3 + density * 0.35)
    score = F.when(F.col("recovery_count") > 0, F.least(F.lit(1.0), base + 0.2)).otherwise(base)
    return j.select(*EP, ((F.col("recovery_count") > 0) | (F.col("near_miss_count") > 0)).alias("has_recovery"),
                    "recovery_count", "near_miss_count", "correction_count",
                    F.when(F.col("n_frames") < 10, F.lit(0.2)).otherwise(score).alias("overall_transition_score"))


# ---------------------------------------------------------------- roll-up

def grade(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 0.9, "A").when(s >= 0.8, "B").when(s >= 0.7, "C").when(s >= 0.6, "D").otherwise("F")


def quality_score(frames: DataFrame, weights=None, labels: DataFrame = None, timestamps: bool = True, compare_starts: bool = False) -> DataFrame:
    """Weighted temporal and diversity score, grade and four flags per episode."""
    weights = weights or {"temporal": 0.55, "diversity": 0.45}
    t = temporal_score(frames, labels, timestamps)
    d = diversity_score(frames, compare_starts)
    q = t.join(d, EP)
    q = q.withColumn("overall_score", weights["temporal"] * F.col("overall_temporal_score") + weights["diversity"] * F.col("overall_diversity_score"))
    return q.select("*", grade("overall_score").alias("quality_grade"),
                    (F.col("recovery_behavior_score") > 0.5).alias("has_recovery_behaviors"),
                    (F.col("overall_diversity_score") > 0.6).alias("is_diverse"),
                    (F.col("motion_smoothness") > 0.7).alias("is_smooth"),
                    (F.col("sync_score") > 0.7).alias("is_well_synced"))
