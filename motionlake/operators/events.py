"""Event detectors: frames in, events out.

Events: (episode, frame, event_type, severity, score, description, ordinal). ``ordinal`` is the
detector order used for ties when events are merged.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.vectors import clip, dot, fmt, last, minus, motion, norm, one_decimal, pct, whole
from motionlake.operators.chunks import attach, by_frame, chunk_of, chunked, column_stats, episode_lengths, greedy_min_gap, materialise, order_stats, own, scan
from motionlake.operators.series import derivatives, motion_signals
from motionlake.schema import EP

EVENT = [*EP, "frame", "event_type", "severity", "score", "description", "ordinal"]

# Metrics touched by each event type.
EVENT_METRICS = {
    "gripper": ["recovery_behavior_score", "transition_diversity"],
    "pause": ["recovery_behavior_score"],
    "direction_change": ["transition_diversity", "recovery_behavior_score"],
    "speed_change": ["motion_smoothness", "action_consistency"],
    "high_jerk": ["motion_smoothness"],
    "correction": ["recovery_behavior_score", "near_miss_ratio"],
    "recovery": ["recovery_behavior_score", "transition_diversity"],
    "near_miss": ["near_miss_ratio", "recovery_behavior_score"],
    "high_divergence": ["action_divergence"],
}
DIVERGENCE_TYPES = ["high_divergence"]


def _event(kind: str, ordinal: int, frame, severity, score, description):
    return [*EP, F.col(frame).cast("long").alias("frame") if isinstance(frame, str) else frame.cast("long").alias("frame"),
            F.lit(kind).alias("event_type"), severity.alias("severity"), score.cast("double").alias("score"),
            description.alias("description"), F.lit(ordinal).alias("ordinal")]


def event_tags(events: DataFrame) -> DataFrame:
    """Add affected metrics and the metric category."""
    metrics = F.create_map(*[x for k, v in EVENT_METRICS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = events.withColumn("affected_metrics", F.coalesce(metrics[F.col("event_type")], F.array().cast("array<string>")))
    return out.withColumn("metric_category", F.when(F.col("event_type").isin(DIVERGENCE_TYPES), "divergence").otherwise("transition"))


def thresholds(signals: DataFrame) -> DataFrame:
    """Per-episode percentiles and means of the motion series, all in one pass of ranks."""
    wanted = (("speed", "p20", 20), ("jerk", "p95", 95), ("accel", "p90", 90), ("accel_all", "p90", 90), ("delta", "p95", 95))
    return column_stats(own(signals), EP, {f"{n}_{p}": (n, pct(at)) for n, p, at in wanted}, n_frames=F.count(F.lit(1)),
                        **{f"{n}_mean": F.avg(n) for n in ("speed", "jerk", "accel")})


LIMITS = ["n_frames", "speed_mean", "jerk_mean", "accel_mean", "speed_p20", "jerk_p95", "accel_p90", "accel_all_p90", "delta_p95"]


def prepared(frames: DataFrame) -> DataFrame:
    """Motion series with per-episode limits; halo rows kept. Runs jobs."""
    s = materialise(motion_signals(frames))
    return attach(s, materialise(thresholds(s)), LIMITS)


# ---------------------------------------------------------------- single detectors

def gripper_events(frames: DataFrame, least: int = 1) -> DataFrame:
    """Sign change of the last dimension, in episodes of ``least`` frames or more; a step through exactly zero is not a change."""
    w = by_frame()
    ch = chunked(frames.select(*EP, "frame_index", last("action").alias("g")))
    ch = ch.withColumn("_p", F.lag("g").over(w)).withColumn("_far", F.max("frame_index").over(w.rowsBetween(0, least - 1)))
    hit = own(ch).filter((F.col("_p") * F.col("g") < 0) & (F.col("_far") >= least - 1))
    text = F.when(F.col("g") < 0, "Gripper closed (grasping)").otherwise("Gripper opened (releasing)")
    return hit.select(*_event("gripper", 1, "frame_index", F.lit("significant"), F.lit(1.0), text))


def pause_events(frames: DataFrame, percentile: float = 20, ready: DataFrame = None) -> DataFrame:
    """Runs of speed below half the percentile, two frames or more, closed by motion."""
    if ready is None:
        s = materialise(motion_signals(frames))
        q = order_stats(own(s), EP, "speed", {"speed_p20": pct(percentile)}).drop("n")
        m = own(s).groupBy(*EP).agg(F.count(F.lit(1)).alias("n_frames"), F.avg("speed").alias("speed_mean"))
        ready = attach(s, m.join(q, EP), ["n_frames", "speed_mean", "speed_p20"])
    mine = own(ready).filter((F.col("n_frames") >= 5) & (F.col("speed_mean") >= 1e-6))
    low = F.col("speed") < F.col("speed_p20") * 0.5
    # carry speed along the run: mean speed = sum of the run's speeds / length
    marked = mine.select(*EP, "frame_index", "speed", "speed_mean", "n_frames", F.coalesce(low, F.lit(False)).alias("_m"))
    found = scan(marked, EP, chunk_of(), "frame_index", _false=("max", F.when(~F.col("_m"), F.col("frame_index"))))
    r = (found.filter("_m").groupBy(*EP, (F.coalesce("_false", F.lit(-1)) + 1).alias("start"))
         .agg(F.count(F.lit(1)).alias("length"), F.avg("speed").alias("_v"), F.max("frame_index").alias("_last"),
              F.first("speed_mean").alias("speed_mean"), F.first("n_frames").alias("n_frames")))
    closed = r.filter((F.col("length") >= 2) & (F.col("_last") < F.col("n_frames") - 1))
    return closed.select(*_event(
        "pause", 2, "start", F.when(F.col("length") < 5, "info").otherwise("significant"),
        clip(1.0 - F.col("_v") / F.col("speed_mean")), fmt("Motion pause (%d frames)", "length")))


def turn_angles(frames: DataFrame) -> DataFrame:
    """Cosine between consecutive smoothed velocities: (episode, n_frames, frame_index, cos)."""
    w = by_frame()
    ch = chunked(frames.select(*EP, "frame_index", motion("action").alias("m")))
    ch = attach(ch, episode_lengths(frames), ["n_frames"])
    ch = ch.select("*", minus("m", F.lag("m").over(w)).alias("_v"), F.coalesce("m", F.lag("m").over(w), F.lead("m").over(w)).alias("_any"))
    zero = F.transform("_any", lambda x: F.lit(0.0))
    v = lambda x: F.coalesce(x, zero)

    def mix(older, mid, newer):
        half = F.zip_with(older, mid, lambda a, b: a * 0.25 + b * 0.5)
        return F.zip_with(half, newer, lambda s, b: s + b * 0.25)

    cur = F.when(F.col("n_frames") > 4, mix(v(F.lag("_v").over(w)), v("_v"), v(F.lead("_v").over(w)))).otherwise(v("_v"))
    ch = ch.select(*EP, "n_frames", "frame_index", "_chunk", "_own", F.col("m").isNotNull().alias("_known"), cur.alias("_cur"))
    # the velocity before is that of the row before: every frame is smoothed once
    ch = ch.withColumn("_prev", F.lag("_cur").over(w)).drop("_chunk")
    mine = own(ch).filter(F.col("_known") & (F.col("n_frames") >= 4) & (F.col("frame_index") >= 2) & (F.col("frame_index") <= F.col("n_frames") - 2))
    mine = mine.select(*EP, "n_frames", "frame_index", dot("_prev", "_cur").alias("_d"), norm("_prev").alias("_np"), norm("_cur").alias("_nc"))
    return mine.filter((F.col("_np") > 0.01) & (F.col("_nc") > 0.01)).select(
        *EP, "n_frames", "frame_index", (F.col("_d") / (F.col("_np") * F.col("_nc") + 1e-8)).alias("cos"))


def _turns(angles: DataFrame, degrees: float) -> DataFrame:
    hit = angles.filter(F.col("cos") < F.cos(F.radians(F.lit(float(degrees)))))
    return hit.withColumn("angle", F.degrees(F.acos(clip("cos", -1.0, 1.0))))


def direction_changes(frames: DataFrame, degrees: float = 60, angles: DataFrame = None) -> DataFrame:
    a = F.col("angle")
    t = _turns(turn_angles(frames) if angles is None else angles, degrees)
    severity = F.when(a > 120, "significant").when(a > 90, "warning").otherwise("info")
    word = F.when(a > 120, "Sharp direction reversal (").when(a > 90, "Direction reversal (").otherwise("Direction change (")
    return t.select(*_event("direction_change", 3, "frame_index", severity, clip(a / 180.0), F.concat(word, whole(a), F.lit("deg)"))))


def correction_events(frames: DataFrame, angles: DataFrame = None) -> DataFrame:
    """Direction changes above 90 degrees, relabelled."""
    d = direction_changes(frames, 90, angles).filter(F.col("severity") != "info")
    return d.withColumn("event_type", F.lit("correction")).withColumn("description", F.replace("description", F.lit("Direction"), F.lit("Correction")))


def speed_changes(frames: DataFrame, ratio: float = 2.0) -> DataFrame:
    w = by_frame()
    s = motion_signals(frames).withColumn("_c", F.col("speed") - F.lag("speed").over(w))
    s = s.withColumn("_b", F.avg(F.abs("_c")).over(w.rowsBetween(-3, -1)))
    per = own(s).groupBy(*EP).agg(F.count(F.lit(1)).alias("n_frames"), F.avg(F.abs("_c")).alias("_all"))
    mine = attach(own(s), per, ["n_frames", "_all"])
    base = F.when(F.col("_b") < 1e-6, F.col("_all") + 1e-6).otherwise(F.col("_b"))
    # change index t = frame - 2 runs over [3, n - 2 - 3)
    r = mine.filter((F.col("n_frames") >= 5) & (F.col("frame_index") >= 5) & (F.col("frame_index") < F.col("n_frames") - 3))
    r = r.withColumn("_r", F.abs("_c") / base).filter(F.col("_r") > ratio)
    severity = F.when(F.col("_r") > 4, "significant").when(F.col("_r") > 3, "warning").otherwise("info")
    word = F.when(F.col("_c") > 0, "Sudden acceleration (").otherwise("Sudden deceleration (")
    return r.select(*_event("speed_change", 9, "frame_index", severity, clip(F.col("_r") / 5.0), F.concat(word, one_decimal("_r"), F.lit("x)"))))


def high_jerk(frames: DataFrame, gap: int = 3, ready: DataFrame = None) -> DataFrame:
    ready = prepared(frames) if ready is None else ready
    c = own(ready).filter((F.col("n_frames") >= 6) & (F.col("jerk_mean") >= 1e-8) & (F.col("jerk") > F.col("jerk_p95")))
    c = c.select(*EP, "frame_index", (F.col("jerk") / F.col("jerk_mean")).alias("_r"))
    c = materialise(c)
    kept = c.join(greedy_min_gap(c, gap), [*EP, "frame_index"])
    return kept.select(*_event("high_jerk", 4, "frame_index", F.when(F.col("_r") > 3, "warning").otherwise("info"),
                               clip(F.col("_r") / 5.0), F.concat(F.lit("Jerky motion ("), one_decimal("_r"), F.lit("x avg)"))))


def recovery_events(frames: DataFrame, share: float = 0.3, gap: int = 5, ready: DataFrame = None) -> DataFrame:
    ready = prepared(frames) if ready is None else ready
    w = by_frame()
    r = ready.withColumn("_post", F.avg("accel").over(w.rowsBetween(1, 4)))
    # acceleration index = frame - 2 stops five before the end
    c = own(r).filter((F.col("n_frames") >= 10) & (F.col("accel_mean") >= 1e-8) & (F.col("frame_index") < F.col("n_frames") - 5)
                      & (F.col("accel") > F.col("accel_p90")) & (F.col("_post") < F.col("accel_p90") * share))
    c = c.select(*EP, "frame_index", (F.col("accel") / F.col("accel_mean")).alias("_r"))
    c = materialise(c)
    kept = c.join(greedy_min_gap(c, gap), [*EP, "frame_index"])
    return kept.select(*_event("recovery", 5, "frame_index", F.when(F.col("_r") > 3, "significant").otherwise("warning"),
                               F.least(F.lit(1.0), F.col("_r") / 5.0), F.concat(F.lit("Recovery behavior ("), one_decimal("_r"), F.lit("x avg acceleration)"))))


def near_miss_events(frames: DataFrame, gap: int = 5, limit: float = -0.1) -> DataFrame:
    w = by_frame()
    ch = chunked(frames.select(*EP, "frame_index", last("action").alias("g")))
    ch = attach(ch, episode_lengths(frames), ["n_frames"])
    turn = (F.col("g") - F.lag("g", 2).over(w)) * (F.lead("g", 2).over(w) - F.col("g"))
    c = own(ch.withColumn("_t", turn)).filter((F.col("n_frames") >= 10) & (F.col("_t") < limit)
                                              & (F.col("frame_index") >= 2) & (F.col("frame_index") < F.col("n_frames") - 3))
    kept = greedy_min_gap(c.select(*EP, "frame_index"), gap)
    return kept.select(*_event("near_miss", 6, "frame_index", F.lit("warning"), F.lit(0.8),
                               F.lit("Gripper correction (potential slip recovery)")))


def gripper_steps(frames: DataFrame, threshold: float = 0.3) -> DataFrame:
    w = by_frame()
    ch = chunked(frames.select(*EP, "frame_index", last("action").alias("g")))
    hit = own(ch.withColumn("_d", F.col("g") - F.lag("g").over(w))).filter(F.abs("_d") > threshold)
    return hit.select(*EP, F.col("frame_index").alias("frame"), F.when(F.col("_d") > 0, "close").otherwise("open").alias("step"))


def action_jumps(frames: DataFrame, ready: DataFrame = None) -> DataFrame:
    ready = prepared(frames) if ready is None else ready
    hit = own(ready).filter((F.col("n_frames") >= 3) & (F.col("delta") > F.col("delta_p95") * 2))
    return hit.select(*EP, F.col("frame_index").alias("frame"), "delta")


# ---------------------------------------------------------------- merge

def severity_rank(x="severity") -> Column:
    return F.when(F.col(x) == "significant", 3).when(F.col(x) == "warning", 2).when(F.col(x) == "info", 1).otherwise(0)


def dedupe_anchor(events: DataFrame, span: int = 2) -> DataFrame:
    """One event per cluster of frames within ``span`` of the cluster's first event.

    Kept: highest severity, then score to six digits (sums differ in their last ones), then frame and detector
    order. A cluster's first frame is exactly what the greedy gap of ``span + 1`` keeps.
    """
    anchors = greedy_min_gap(events.select(*EP, F.col("frame").alias("frame_index")), span + 1)
    reach = anchors.select(*EP, F.col("frame_index").alias("anchor"),
                           F.explode(F.array(*[F.col("frame_index") + k for k in range(span + 1)])).alias("frame"))
    joined = events.join(reach, [*EP, "frame"])
    rest = [x for x in events.columns if x not in EP]
    rank = F.struct(severity_rank().alias("a"), F.round("score", 6).alias("b"), (-F.col("frame")).alias("c"), (-F.col("ordinal")).alias("d"))
    best = joined.groupBy(*EP, "anchor").agg(F.max_by(F.struct(*rest), rank).alias("_e"))
    return best.select(*EP, "_e.*")


def all_events(frames: DataFrame, ready: DataFrame = None) -> DataFrame:
    ready = prepared(frames) if ready is None else ready
    # the other detectors ask for five frames or more themselves
    angles = turn_angles(frames).filter("n_frames >= 5")
    merged = (gripper_events(frames, least=5).unionByName(pause_events(frames, ready=ready)).unionByName(direction_changes(frames, angles=angles))
              .unionByName(high_jerk(frames, ready=ready)).unionByName(recovery_events(frames, ready=ready))
              .unionByName(near_miss_events(frames)))
    return dedupe_anchor(materialise(merged))
