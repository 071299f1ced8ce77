"""Motion phases of an episode and what is flagged from them.

Ranges, phases and reasons are tables of their own. Where a range has to look at its frames the
two meet on (episode, chunk); nothing gathers an episode.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.vectors import capitalize, last, norm, one_decimal, pct, whole
from motionlake.operators.chunks import (
    attach, by_frame, chunk_of, chunked, episode_lengths, interval_rows, materialise, merge_ranges, numbered,
    order_stats, own, runs, scan, spread_join,
)
from motionlake.operators.series import (
    bin_fraction, bins_of_step, gaussian_array, gaussian_window, local_minima, median_filter_window, median_kernel, motion_signals,
)
from motionlake.schema import EP, TASK

# Fixed values of the method.
PHASE_BINS = 50
MIN_CLOSED, MERGE_GAP = 20, 30
GRASP_FRAMES, RELEASE_FRAMES = 3, 3
PHASE_KEY = ["phase", "cycle", "num_cycles"]
REASON = [*EP, "signal", "phase", "cycle", "feature", "magnitude", "explanation", "ordinal"]


# ---------------------------------------------------------------- cohort

def cohort(frames: DataFrame, n: int) -> DataFrame:
    """Frames of the first ``n`` episodes of each task by index."""
    eps = episode_lengths(frames)
    first = numbered(eps, TASK, "episode_index", chunk_of("episode_index"), "rank").filter(F.col("rank") < n)
    return attach(frames.withColumn("_chunk", chunk_of()), first, []).drop("_chunk")


# ---------------------------------------------------------------- gripper ranges

def filtered_grip(frames: DataFrame) -> DataFrame:
    """Median-filtered last action dimension, for episodes where it moves."""
    g = frames.select(*EP, "frame_index", last("action").alias("g"))
    span = g.groupBy(*EP).agg(F.count(F.lit(1)).alias("n_frames"), F.max("g").alias("_hi"), F.min("g").alias("_lo"))
    ch = attach(chunked(g), span.filter("_hi > _lo"), ["n_frames"])
    return materialise(own(ch.select(*EP, "n_frames", "frame_index", "_chunk", "_own",
                         median_filter_window("g", median_kernel("n_frames"), "n_frames").alias("sm"))))


def closed_mask(filtered: DataFrame) -> DataFrame:
    """(episode, n_frames, frame_index, closed): above mid-range, flipped if that is over 60 %."""
    q = order_stats(filtered, EP, "sm", {"p5": pct(5), "p95": pct(95)})
    mids = materialise(q.select(*EP, F.col("n").alias("n_frames"), ((F.col("p5") + F.col("p95")) / 2).alias("mid")))
    over = attach(filtered.drop("n_frames"), mids, ["mid"]).groupBy(*EP).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("sm") > F.col("mid"), 1).otherwise(0)).alias("_c"))
    rule = mids.join(over, EP).withColumn("flip", F.col("_c") > 0.6 * F.col("_n"))
    j = attach(filtered.drop("n_frames"), rule, ["n_frames", "mid", "flip"])
    return j.select(*EP, "n_frames", "frame_index",
                    F.when(F.col("flip"), F.col("sm") < F.col("mid")).otherwise(F.col("sm") > F.col("mid")).alias("closed"))


def raw_ranges(frames: DataFrame) -> DataFrame:
    """Closed runs before any filter: (episode, start, end, length)."""
    return materialise(runs(materialise(closed_mask(filtered_grip(frames))), F.col("closed")))


def raw_gripper_events(raw: DataFrame) -> DataFrame:
    """Close at a run's start, open one past its end, even at the end of the episode."""
    pairs = F.array(F.struct(F.lit("close").alias("kind"), F.col("start").alias("frame")),
                    F.struct(F.lit("open").alias("kind"), F.col("end").alias("frame")))
    return raw.select(*EP, F.inline(pairs))


def closed_ranges(raw: DataFrame) -> DataFrame:
    """Runs of 20 frames or more, merged over gaps below 30: (episode, start, end, cycle)."""
    merged = merge_ranges(raw.filter(F.col("length") >= MIN_CLOSED).select(*EP, "start", "end"), MERGE_GAP)
    return materialise(numbered(materialise(merged), EP, "start", chunk_of("start"), "cycle"))


# ---------------------------------------------------------------- phases

def _z(frames: DataFrame) -> DataFrame:
    z = F.coalesce(F.get("state", F.lit(2)), F.lit(0.0)) if "state" in frames.columns else F.lit(0.0)
    return frames.select(*EP, "frame_index", chunk_of().alias("_chunk"), z.alias("z"))


def gripper_phases(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """Approach, Grasp, Lift, Transit, Place, Release per cycle, Return after the last."""
    counts = ranges.groupBy(*EP).agg(F.count(F.lit(1)).alias("num_cycles")).join(episode_lengths(frames), EP)
    r = spread_join(ranges, counts, EP, salt_on="start")
    r = r.withColumn("release_end", F.least(F.col("end") + RELEASE_FRAMES, F.col("n_frames")))
    r = scan(r, EP, chunk_of("start"), "start", exclusive=["prev_end"], prev_end=("max", F.col("release_end")))
    r = r.withColumn("prev_end", F.coalesce("prev_end", F.lit(0)).cast("long"))
    r = r.withColumn("grasp_end", F.least(F.col("start") + GRASP_FRAMES, F.col("end")))
    z = _z(frames)
    key = [*EP, "cycle"]
    deep = r.filter(F.col("end") - F.col("grasp_end") > 3).select(*key, "grasp_end", "end")
    top = interval_rows(z, deep, "grasp_end", "end", ["cycle", "end"]).groupBy(*key, "end").agg(
        F.max(F.struct("z", (-F.col("frame_index")).alias("o"))).alias("_t"))
    top = top.select(*key, "end", (-F.col("_t.o")).alias("peak"), F.col("_t.z").alias("peak_z"))
    low = interval_rows(z, top, "peak", "end", ["cycle", "peak", "peak_z", "end"]).groupBy(*key, "peak", "peak_z", "end").agg(F.min("z").alias("_m"))
    low = low.withColumn("_limit", F.col("peak_z") - 0.3 * (F.col("peak_z") - F.col("_m")))
    fall = interval_rows(z, low, "peak", "end", ["cycle", "peak", "peak_z", "_m", "_limit"]).groupBy(*key, "peak", "peak_z", "_m").agg(
        F.min(F.when(F.col("z") < F.col("_limit"), F.col("frame_index"))).alias("_d"))
    fall = fall.select(*key, "peak", F.when(F.col("peak_z") - F.col("_m") > 1e-4, F.coalesce("_d", "peak")).otherwise(F.col("peak")).alias("descent"))
    r = r.join(fall, key, "left")
    peak, descent = F.coalesce("peak", "grasp_end"), F.coalesce("descent", "end")
    n1 = F.col("num_cycles") - 1
    piece = lambda name, a, b, cyc=F.col("cycle"): F.struct(
        F.lit(name).alias("phase"), a.cast("long").alias("start"), b.cast("long").alias("end"), cyc.cast("long").alias("cycle"))
    rows = F.array(
        piece("Approach", F.col("prev_end"), F.col("start")), piece("Grasp", F.col("start"), F.col("grasp_end")),
        piece("Lift", F.col("grasp_end"), peak), piece("Transit", peak, descent), piece("Place", descent, F.col("end")),
        piece("Release", F.col("end"), F.col("release_end")),
        piece("Return", F.when(F.col("cycle") == n1, F.col("release_end")).otherwise(F.col("n_frames")), F.col("n_frames"), n1))
    out = r.select(*EP, "num_cycles", "n_frames", F.inline(F.filter(rows, lambda x: x["end"] > x["start"])))
    return out.withColumn("method", F.lit("gripper")).select(*EP, "n_frames", "method", *PHASE_KEY, "start", "end")


def prune_by_distance(peaks: DataFrame, position: str = "pos", height: str = "v", distance: str = "dist") -> DataFrame:
    """Keep lowest values first, dropping others closer than the episode's distance.

    Runs jobs: each round keeps every candidate that is the lowest of its own and the two
    neighbouring distance-wide buckets, then drops what lies too close to it. An episode has
    few such buckets, which bounds the rounds.
    """
    rest = materialise(peaks.select(*EP, position, height, distance, F.floor(F.col(position) / F.col(distance)).cast("long").alias("_b")))
    kept = None
    order = F.struct(F.col(height).alias("h"), (-F.col(position)).alias("o"))
    while not rest.isEmpty():
        best = rest.groupBy(*EP, "_b").agg(F.min(order).alias("_w"))
        near = best.select(*EP, "_w", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
        near = near.groupBy(*EP, "_b").agg(F.min("_w").alias("_w"))
        take = rest.join(near, [*EP, "_b"]).filter(order == F.col("_w")).drop("_w")
        wide = take.select(*EP, F.col(position).alias("_k"), F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
        hit = rest.join(wide, [*EP, "_b"]).filter(F.abs(F.col(position) - F.col("_k")) < F.col(distance)).select(*EP, position).distinct()
        kept = take if kept is None else kept.unionByName(take)
        rest = materialise(rest.join(hit, [*EP, position], "left_anti"))
    return (kept if kept is not None else rest).drop("_b")


def motion_phases(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """Fallback split at velocity minima, for the episodes in ``lengths``. Runs jobs."""
    speed = motion_signals(frames).select(*EP, "frame_index", "_chunk", "_own", F.col("speed3").alias("v"))
    s = attach(speed, lengths, ["n_frames"])
    smooth = F.when(F.col("v").isNotNull(), F.when(F.col("n_frames") > 4, gaussian_window("v", 3.0, F.col("n_frames") - 1, first=1)).otherwise(F.col("v")))
    s = own(s.select(*EP, "n_frames", "frame_index", "_own", smooth.alias("v"))).filter("v is not null")
    s = materialise(s.withColumn("frame_index", F.col("frame_index") - 1))
    limit = order_stats(s, EP, "v", {"limit": pct(20)}).select(*EP, "limit", (F.col("n") + 1).alias("n_frames"))
    found = attach(local_minima(s, "v").withColumn("_chunk", chunk_of()), limit, ["limit", "n_frames"]).filter(F.col("v") <= F.col("limit"))
    peaks = found.select(*EP, F.col("frame_index").alias("pos"), "v", F.greatest(F.lit(10), F.floor(F.col("n_frames") / 20)).cast("long").alias("dist"))
    kept = prune_by_distance(peaks)
    # at most one kept minimum per distance, i.e. a few dozen cuts per episode
    cuts = kept.groupBy(*EP).agg(F.array_sort(F.collect_list("pos")).alias("cuts"))
    b = lengths.join(cuts, EP, "left")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("cuts", F.array().cast("array<bigint>")), F.array(F.col("n_frames").cast("long")))
    b = b.withColumn("_e", edges)
    b = b.select(*EP, "n_frames", "_e", F.explode(F.sequence(F.lit(0), F.size("_e") - 2)).alias("_i"))
    i = F.col("_i")
    name = F.when(i % 2 == 0, F.concat(F.lit("Motion"), (i + 1).cast("string"))).otherwise(F.concat(F.lit("Pause"), (F.floor(i / 2) + 1).cast("string")))
    out = b.select(*EP, "n_frames", F.lit("velocity_minima").alias("method"), name.alias("phase"), F.lit(0).cast("long").alias("cycle"),
                   F.lit(0).cast("long").alias("num_cycles"), F.get("_e", i).alias("start"), F.get("_e", i + 1).alias("end"))
    return out.filter(F.col("end") - F.col("start") >= 3)


def segment(frames: DataFrame, ranges: DataFrame = None) -> DataFrame:
    """Phases of every episode: gripper cycles, else velocity minima. Runs jobs for the latter."""
    if ranges is None:
        ranges = closed_ranges(raw_ranges(frames))
    rest = episode_lengths(frames).join(ranges.select(*EP).distinct(), EP, "left_anti")
    return gripper_phases(frames, ranges).unionByName(motion_phases(frames, materialise(rest)))


def episode_cycles(frames: DataFrame, ranges: DataFrame, raw: DataFrame) -> DataFrame:
    """(episode, n_frames, num_cycles, closed_frames, gripper_events); zero where none."""
    a = ranges.groupBy(*EP).agg(F.count(F.lit(1)).alias("num_cycles"), F.sum(F.col("end") - F.col("start")).alias("closed_frames"))
    b = raw.groupBy(*EP).agg((F.count(F.lit(1)) * 2).alias("gripper_events"))
    j = episode_lengths(frames).join(a, EP, "left").join(b, EP, "left")
    return j.na.fill(0, ["num_cycles", "closed_frames", "gripper_events"])


# ---------------------------------------------------------------- envelope

def _magnitudes(frames: DataFrame) -> DataFrame:
    w = by_frame()
    rot = F.when(F.size("action") >= 6, norm(F.slice("action", 4, 3))).otherwise(F.lit(0.0))
    ch = chunked(frames.select(*EP, "frame_index", norm(F.slice("action", 1, 3)).alias("position"), rot.alias("rotation")))
    return own(ch.select("*", F.lead("position").over(w).alias("_np"), F.lead("rotation").over(w).alias("_nr")))


def phase_signals(frames: DataFrame, phases: DataFrame) -> DataFrame:
    """Smoothed 50-bin position and rotation magnitude per phase: (episode, key, channel, sig)."""
    wide = phases.filter(~F.col("phase").isin("Grasp", "Release") & (F.col("end") - F.col("start") >= 2))
    rows = interval_rows(_magnitudes(frames), wide, "start", "end", [*PHASE_KEY])
    rows = rows.withColumn("_i", F.col("frame_index") - F.col("_a")).withColumn("_n", F.col("_z") - F.col("_a"))
    rows = rows.withColumn("bin", F.explode(bins_of_step("_i", "_n", PHASE_BINS)))
    t = bin_fraction("_i", "_n", PHASE_BINS)
    mix = lambda x, nx: F.when(t == 0, F.col(x)).otherwise(F.col(x) + (F.col(nx) - F.col(x)) * t)
    rows = rows.select(*EP, *PHASE_KEY, "bin", mix("position", "_np").alias("p"), mix("rotation", "_nr").alias("r"))
    per = rows.groupBy(*EP, *PHASE_KEY).agg(F.array_sort(F.collect_list(F.struct("bin", "p", "r"))).alias("_s"))
    each = F.array(F.struct(F.lit("position").alias("channel"), F.transform("_s", lambda x: x["p"]).alias("a")),
                   F.struct(F.lit("rotation").alias("channel"), F.transform("_s", lambda x: x["r"]).alias("a")))
    per = per.select(*EP, *PHASE_KEY, F.inline(each))
    return per.select(*EP, *PHASE_KEY, "channel", gaussian_array("a", 2.0, PHASE_BINS).alias("sig"))


def envelope_scores(signals: DataFrame, phases: DataFrame, min_cohort: int = 6, min_median: int = 15) -> DataFrame:
    """z distance to the cohort mean per bin: (episode, key, channel, z array)."""
    key = [*TASK, *PHASE_KEY]
    med = order_stats(phases.withColumn("_d", F.col("end") - F.col("start")), key, "_d", {"med": pct(50)})
    med = med.filter(F.floor("med") >= min_median).select(*key)
    bins = signals.select(*key, "channel", F.posexplode("sig").alias("bin", "x"))
    st = bins.groupBy(*key, "channel", "bin").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count(F.lit(1)).alias("c"))
    st = st.filter(F.col("c") >= min_cohort).groupBy(*key, "channel").agg(F.array_sort(F.collect_list(F.struct("bin", "m", "s"))).alias("_st"))
    j = spread_join(signals, st.join(med, key, "left_semi"), [*key, "channel"])
    z = F.zip_with("sig", "_st", lambda x, s: F.abs(x - s["m"]) / F.greatest(s["s"], F.lit(1e-6)))
    return j.select(*EP, *PHASE_KEY, "channel", z.alias("z"))


def _longest_run(z, limit: float) -> Column:
    return F.aggregate(
        z, F.struct(F.lit(0).alias("c"), F.lit(0).alias("b")),
        lambda a, x: F.when(x > limit, F.struct((a["c"] + 1).alias("c"), F.greatest(a["b"], a["c"] + 1).alias("b")))
        .otherwise(F.struct(F.lit(0).alias("c"), a["b"].alias("b"))), lambda a: a["b"])


def phase_envelope_flags(frames: DataFrame, phases: DataFrame, sigma: float = 3.0, run_min: int = 10, run_share: float = 0.4) -> DataFrame:
    """Phases that leave the cohort envelope for 40 % of their length or more."""
    return envelope_flags(materialise(phase_signals(frames, phases)), phases, sigma, run_min, run_share)


def envelope_flags(signals: DataFrame, phases: DataFrame, sigma: float = 3.0, run_min: int = 10, run_share: float = 0.4) -> DataFrame:
    """``phase_envelope_flags`` from the signals of the phases."""
    z = envelope_scores(signals, phases)
    z = z.withColumn("longest", _longest_run(F.col("z"), sigma)).filter(F.col("longest") >= max(run_min, int(run_share * PHASE_BINS)))
    z = z.withColumn("_peak", F.array_max(F.filter("z", lambda x: x > sigma)))
    text = F.concat(F.lit("Unusual "), F.col("channel"), F.lit(" during "), F.col("phase"), F.lit(" (cycle "), F.col("cycle").cast("string"),
                    F.lit("): peak "), one_decimal("_peak"), F.lit("× typical range, sustained for "),
                    whole(F.col("longest") * 100.0 / PHASE_BINS), F.lit("% of the phase"))
    return z.select(*EP, F.lit("envelope").alias("signal"), "phase", "cycle", F.col("channel").alias("feature"),
                    F.round("_peak", 2).alias("magnitude"), text.alias("explanation"), F.lit(1).alias("ordinal"))


# ---------------------------------------------------------------- duration and cycle count

def duration_mad(phases: DataFrame) -> DataFrame:
    """Median and median absolute deviation of phase durations per key."""
    key = [*TASK, *PHASE_KEY]
    d = phases.filter(~F.col("phase").isin("Grasp", "Release")).select(*EP, *PHASE_KEY, (F.col("end") - F.col("start")).alias("d"))
    med = materialise(order_stats(d, key, "d", {"med": pct(50)}))
    dev = spread_join(d, med, key).withColumn("_a", F.abs(F.col("d") - F.col("med")))
    return med.join(order_stats(dev, key, "_a", {"mad": pct(50)}).drop("n"), key)


def duration_label(phase="phase", ratio="ratio") -> Column:
    """Wording of a pacing outlier (fixed values)."""
    p, r = F.col(phase), F.col(ratio)
    long_ = (F.when(p == "Place", "hesitation before release").when(p == "Grasp", "difficulty grasping").when(p == "Approach", "slow approach")
             .when(p == "Transit", "slow transit").when(p == "Lift", "prolonged lift").when(p == "Return", "long idle after release").otherwise("prolonged"))
    short = (F.when(p == "Approach", "cut-short approach").when(p == "Place", "abrupt placement")
             .when(p == "Return", "immediate reset after release").otherwise("abbreviated"))
    mid = F.when(p == "Return", "longer-than-typical idle after release").otherwise("slightly off-typical pacing")
    return F.when(r > 2.0, long_).when(r < 0.4, short).otherwise(mid)


def phase_duration_flags(phases: DataFrame, threshold: float = 3.5, min_cohort: int = 6, min_median: float = 10) -> DataFrame:
    key = [*TASK, *PHASE_KEY]
    st = duration_mad(phases).filter((F.col("n") >= min_cohort) & (F.col("med") >= min_median))
    d = phases.filter(~F.col("phase").isin("Grasp", "Release")).select(*EP, *PHASE_KEY, (F.col("end") - F.col("start")).alias("d"))
    j = spread_join(d, st, key)
    unit = F.when(F.col("mad") > 0, F.col("mad") * 1.4826).otherwise(F.lit(1.0))
    j = j.withColumn("_z", F.abs((F.col("d") - F.col("med")) / unit)).filter(F.col("_z") > threshold).withColumn("ratio", F.col("d") / F.col("med"))
    text = F.concat(capitalize(duration_label()), F.lit(": "), F.col("phase"), F.lit(" phase (cycle "), F.col("cycle").cast("string"), F.lit(") took "),
                    one_decimal("ratio"), F.lit("× typical time ("), F.col("d").cast("string"), F.lit("f vs typical "), whole("med"), F.lit("f)"))
    return j.select(*EP, F.lit("duration").alias("signal"), "phase", "cycle", F.lit(None).cast("string").alias("feature"),
                    F.round("_z", 2).alias("magnitude"), text.alias("explanation"), F.lit(2).alias("ordinal"))


def cycle_mode(cycles: DataFrame) -> DataFrame:
    """Most frequent cycle count per task, smallest on ties, with cohort size and maximum."""
    c = cycles.groupBy(*TASK, "num_cycles").agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy(*TASK).agg(F.sum("c").alias("n"), F.max("num_cycles").alias("most"),
                                (-F.max(F.struct("c", (-F.col("num_cycles")).alias("o")))["o"]).alias("mode"))


def cycle_count_flags(cycles: DataFrame) -> DataFrame:
    m = cycle_mode(cycles).filter((F.col("n") >= 4) & (F.col("most") > 0))
    j = spread_join(cycles.select(*EP, "num_cycles"), m, TASK)
    step = F.when((F.col("mode") <= 1) | (F.col("n") < 15), 1).otherwise(2)
    off = F.abs(F.col("num_cycles") - F.col("mode"))
    j = j.filter(off >= step)
    text = F.concat(F.when(F.col("num_cycles") < F.col("mode"), "Missing cycles: ").otherwise("Extra cycles: "), F.col("num_cycles").cast("string"),
                    F.lit(" pick-place cycle"), F.when(F.col("num_cycles") != 1, "s").otherwise(""), F.lit(" vs typical "), F.col("mode").cast("string"))
    return j.select(*EP, F.lit("cycle_count").alias("signal"), F.lit(None).cast("string").alias("phase"), F.lit(None).cast("long").alias("cycle"),
                    F.lit(None).cast("string").alias("feature"), off.cast("double").alias("magnitude"), text.alias("explanation"), F.lit(3).alias("ordinal"))


# ---------------------------------------------------------------- shape features

FEATURES = ["arc_length_xyz", "arc_length_rot", "num_gripper_events", "num_pauses", "z_range", "xy_bbox_area",
            "path_directness", "gripper_closed_ratio", "num_direction_changes", "episode_duration"]


def shape_features(frames: DataFrame, cycles: DataFrame) -> DataFrame:
    """Ten shape features per episode; ``cycles`` is ``episode_cycles``. Rounded to 4 digits."""
    w = by_frame()
    s = lambda i: F.when(F.size("state") >= 3, F.get("state", F.lit(i))).otherwise(F.lit(0.0))
    ch = chunked(frames.select(*EP, "frame_index", s(0).alias("x"), s(1).alias("y"), s(2).alias("z"), F.slice("action", 4, 3).alias("rot"), F.size("action").alias("dims")))
    ch = attach(ch, cycles, ["n_frames"])
    d = {k: F.col(k) - F.lag(k).over(w) for k in ("x", "y", "z")}
    ch = ch.select("*", *[v.alias(f"d{k}") for k, v in d.items()], F.lag("rot").over(w).alias("_rot"))
    dr = norm(F.zip_with("rot", "_rot", lambda a, b: a - b))
    ch = ch.withColumn("v", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    turn = sum((F.when((F.col(f"d{k}") < 0) != (F.lag(f"d{k}").over(w) < 0), 1).otherwise(0) for k in "xyz"), F.lit(0))
    sm = F.when(F.col("v").isNotNull(), F.when(F.col("n_frames") > 4, gaussian_window("v", 3.0, F.col("n_frames") - 1, first=1)).otherwise(F.col("v")))
    mine = materialise(own(ch.select(*EP, "n_frames", "frame_index", "_own", "_chunk", "x", "y", "z", "v", turn.alias("turn"), sm.alias("sm"),
                                     F.when(F.col("dims") >= 6, dr).alias("dr"))))
    edge = lambda at: [F.max(F.when(at, F.col(k))) for k in "xyz"]
    at0, at1 = F.col("frame_index") == 0, F.col("frame_index") == F.col("n_frames") - 1
    a = mine.groupBy(*EP, "n_frames").agg(
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("arc"), F.coalesce(F.sum("dr"), F.lit(0.0)).alias("arc_rot"), F.sum("turn").alias("turns"),
        *[(F.max(k) - F.min(k)).alias(f"r{k}") for k in "xyz"],
        *[e.alias(f"a{k}") for k, e in zip("xyz", edge(at0))], *[e.alias(f"b{k}") for k, e in zip("xyz", edge(at1))])
    vs = mine.filter("sm is not null").withColumn("frame_index", F.col("frame_index") - 1)
    q = order_stats(vs, EP, "sm", {"limit": pct(25)}).select(*EP, "limit", (F.col("n") + 1).alias("n_frames"))
    slow = attach(vs.drop("n_frames", "_chunk").withColumn("_chunk", chunk_of()), q, ["limit"])
    slow = runs(materialise(slow.select(*EP, "frame_index", (F.col("sm") < F.col("limit")).alias("slow"))), F.col("slow"))
    pauses = slow.filter(F.col("length") >= 10).groupBy(*EP).agg(F.count(F.lit(1)).alias("pauses"))
    j = a.join(cycles.drop("n_frames"), EP).join(pauses, EP, "left")
    straight = F.sqrt(sum(((F.col(f"b{k}") - F.col(f"a{k}")) * (F.col(f"b{k}") - F.col(f"a{k}")) for k in "xyz"), F.lit(0.0)))
    return j.select(
        *EP, F.round("arc", 4).alias("arc_length_xyz"), F.round("arc_rot", 4).alias("arc_length_rot"),
        F.col("gripper_events").cast("long").alias("num_gripper_events"), F.coalesce("pauses", F.lit(0)).cast("long").alias("num_pauses"),
        F.round("rz", 4).alias("z_range"), F.round(F.col("rx") * F.col("ry"), 4).alias("xy_bbox_area"),
        F.round(F.when(F.col("arc") > 0, straight / F.col("arc")).otherwise(F.lit(0.0)), 4).alias("path_directness"),
        F.round(F.col("closed_frames") / F.col("n_frames"), 4).alias("gripper_closed_ratio"),
        F.col("turns").cast("long").alias("num_direction_changes"), F.col("n_frames").cast("long").alias("episode_duration"))


def phase_action_summary(frames: DataFrame, phases: DataFrame) -> DataFrame:
    """Mean and maximum position and rotation magnitude per phase, 3 digits; needs 6 dimensions."""
    m = frames.filter(F.size("action") >= 6).select(*EP, "frame_index", chunk_of().alias("_chunk"),
                                                     norm(F.slice("action", 1, 3)).alias("p"), norm(F.slice("action", 4, 3)).alias("r"))
    rows = interval_rows(m, phases, "start", "end", ["phase", "cycle"])
    return rows.groupBy(*EP, "phase", "cycle", F.col("_a").alias("frame_start"), F.col("_z").alias("frame_end")).agg(
        F.count(F.lit(1)).alias("duration_frames"), F.round(F.avg("p"), 3).alias("pos_mag_mean"), F.round(F.max("p"), 3).alias("pos_mag_max"),
        F.round(F.avg("r"), 3).alias("rot_mag_mean"), F.round(F.max("r"), 3).alias("rot_mag_max"))
