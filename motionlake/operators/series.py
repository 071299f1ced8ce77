"""Series operators: derivatives, smoothing, resampling, correlation, ranges."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.vectors import c, clip, last, minus, motion, norm
from motionlake.operators.chunks import (
    attach, by_frame, chunk_of, chunked, episode_lengths, materialise, numbered, own, scan, spread_join,
)
from motionlake.operators.spectrum import low_power
from motionlake.schema import EP, HALO, TASK


def derivatives(frames: DataFrame, halo: int = HALO) -> DataFrame:
    """Velocity, acceleration and jerk vectors of the action; halo rows are kept.

    Each is the change of the one before, along one window over the chunk.
    """
    w = by_frame()
    moved = chunked(frames, halo=halo).withColumn("vel", minus("action", F.lag("action").over(w)))
    moved = moved.withColumn("acc", minus("vel", F.lag("vel").over(w)))
    return moved.withColumn("jerk", minus("acc", F.lag("acc").over(w)))


def motion_signals(frames: DataFrame, halo: int = HALO) -> DataFrame:
    """Scalar motion series per frame, halo rows kept.

    speed, accel, jerk exclude the gripper; delta and accel_all do not; speed3 is the norm of
    the first three dimensions' change.
    """
    d = derivatives(frames, halo)
    return d.select(
        *EP, "frame_index", "_chunk", "_own",
        norm(motion("vel")).alias("speed"), norm(motion("acc")).alias("accel"), norm(motion("jerk")).alias("jerk"),
        norm("vel").alias("delta"), norm("acc").alias("accel_all"),
        norm(F.slice("vel", 1, 3)).alias("speed3"),
        last("action").alias("grip"))


# ---------------------------------------------------------------- smoothing

def gaussian_weights(sigma: float) -> list[float]:
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [x / total for x in raw]


def _mirror(j: Column, n: Column) -> Column:
    """Index after reflection at the edges: d c b a | a b c d | d c b a."""
    m = F.pmod(j, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def gaussian_window(value, sigma: float, n, position: str = "frame_index", first: int = 0, keys=EP) -> Column:
    """Gaussian smoothing over a chunk window; ``n`` is the series length (column).

    ``first`` is the position of the first value of the series.
    """
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    w = by_frame(position, keys).rowsBetween(-r, r)
    seen = F.collect_list(c(value)).over(w)
    i = F.col(position) - first
    start = F.greatest(i - r, F.lit(0).cast("long"))
    total = None
    for k, weight in enumerate(weights):
        term = F.get(seen, (_mirror(i + (k - r), c(n)) - start).cast("int")) * F.lit(weight)
        total = term if total is None else total + term
    return total


def gaussian_array(arr, sigma: float, size: int) -> Column:
    """Gaussian smoothing of an array of known length (at least the radius), mirrored edges."""
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    a = c(arr)
    padded = F.concat(F.reverse(F.slice(a, 1, r)), a, F.reverse(F.slice(a, size - r + 1, r)))
    w = F.array(*map(F.lit, weights))
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.aggregate(
        F.zip_with(F.slice(padded, i, F.lit(2 * r + 1)), w, lambda x, k: x * k), F.lit(0.0), lambda t, x: t + x))


def smooth(frames: DataFrame, value: Column, sigma: float, name: str = "smoothed") -> DataFrame:
    """Gaussian smoothing of one per-frame value: (episode, frame_index, name)."""
    ch = chunked(frames.select(*EP, "frame_index", value.alias("_x")), halo=max(HALO, int(4 * sigma + 0.5) + 1))
    ch = attach(ch, episode_lengths(frames), ["n_frames"])
    return own(ch.select(*EP, "frame_index", "_own", "_chunk",
                         gaussian_window("_x", sigma, "n_frames").alias(name))).drop("_chunk")


def median_filter_window(value, kernel, n, position: str = "frame_index") -> Column:
    """Median over an odd ``kernel`` (column, at most 15), zero padded at both ends."""
    w = by_frame(position).rowsBetween(-7, 7)
    seen = F.collect_list(c(value)).over(w)
    r = ((c(kernel) - 1) / 2).cast("int")
    here = F.least(F.col(position), F.lit(7)).cast("int")
    left, right = F.least(here, r), F.least((c(n) - 1 - F.col(position)).cast("int"), r)
    part = F.slice(seen, here - left + 1, left + right + 1)
    padded = F.concat(part, F.array_repeat(F.lit(0.0), c(kernel).cast("int") - F.size(part)))
    return F.element_at(F.array_sort(padded), r + 1)


def median_kernel(n) -> Column:
    odd = F.when(c(n) % 2 == 1, c(n)).otherwise(c(n) - 1)
    return F.greatest(F.lit(3), F.least(F.lit(15), odd)).cast("int")


def median_filter(frames: DataFrame, value: Column, name: str = "filtered") -> DataFrame:
    ch = chunked(frames.select(*EP, "frame_index", value.alias("_x")))
    ch = attach(ch, episode_lengths(frames), ["n_frames"])
    return own(ch.select(*EP, "frame_index", "_own",
                         median_filter_window("_x", median_kernel("n_frames"), "n_frames").alias(name)))


def smooth3(frames: DataFrame) -> DataFrame:
    """[.25, .5, .25] smoothing of the velocity with zero-padded edges."""
    w = by_frame()
    d = derivatives(frames)
    zero = F.transform("vel", lambda x: F.lit(0.0))
    before, after = F.coalesce(F.lag("vel").over(w), zero), F.coalesce(F.lead("vel").over(w), zero)
    mixed = F.zip_with(F.zip_with(before, F.col("vel"), lambda a, b: a * 0.25 + b * 0.5), after, lambda s, b: s + b * 0.25)
    return own(d.select(*EP, "frame_index", "_own", "vel", mixed.alias("smoothed"))).filter("vel is not null").drop("vel")


# ---------------------------------------------------------------- resampling

def bins_of_step(i, n, bins: int) -> Column:
    """Target bins whose source position lies in [i, i+1): whole-number arithmetic.

    Source position of bin j is j*(n-1)/(bins-1). Empty array when none.
    """
    i, n = c(i), c(n)
    steps = F.greatest(n - 1, F.lit(1))
    lo = F.floor((i * (bins - 1) + n - 2) / steps).cast("long")
    hi = F.floor(((i + 1) * (bins - 1) + n - 2) / steps).cast("long") - 1
    empty = F.array().cast("array<bigint>")
    return (F.when(i == n - 1, F.array(F.lit(bins - 1).cast("long")))
            .when(lo <= hi, F.sequence(lo, hi)).otherwise(empty))


def bin_fraction(i, n, bins: int, j="bin") -> Column:
    return (c(j) * (c(n) - 1) - c(i) * (bins - 1)) / F.lit(float(bins - 1))


def resample(frames: DataFrame, bins: int, value="action", min_frames: int = 2) -> DataFrame:
    """Linear resampling to ``bins`` points: (episode, n_frames, bin, value).

    ``value`` is a scalar or vector column. Each frame emits the target bins that fall between
    it and the next frame, so an episode is never gathered.
    """
    is_vector = dict(frames.dtypes)[value].startswith("array")
    w = by_frame()
    ch = chunked(frames.select(*EP, "frame_index", value)).withColumn("_next", F.lead(value).over(w))
    ch = attach(own_keep(ch), episode_lengths(frames), ["n_frames"]).filter(F.col("n_frames") >= min_frames)
    rows = ch.select(*EP, "n_frames", "frame_index", value, "_next",
                     F.explode(bins_of_step("frame_index", "n_frames", bins)).alias("bin"))
    t = bin_fraction("frame_index", "n_frames", bins)
    if is_vector:
        mixed = F.when(t == 0, F.col(value)).otherwise(F.zip_with(value, "_next", lambda a, b: a + (b - a) * t))
    else:
        mixed = F.when(t == 0, F.col(value)).otherwise(F.col(value) + (F.col("_next") - F.col(value)) * t)
    return rows.select(*EP, "n_frames", "bin", mixed.alias(value))


def own_keep(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own")


# ---------------------------------------------------------------- other series operators

def normalise(df: DataFrame, keys, value: str, name: str = "scaled") -> DataFrame:
    """(x - min) / (max - min) per key; zero range counts as 1."""
    bounds = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    salted = "frame_index" if "frame_index" in df.columns else value
    joined = spread_join(df, bounds, keys, salt_on=salted)
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    return joined.withColumn(name, (F.col(value) - F.col("_lo")) / span).drop("_lo", "_hi")


def rolling_baseline(frames: DataFrame) -> DataFrame:
    """Mean of the previous three |speed changes|: (episode, frame_index, change, baseline)."""
    w = by_frame()
    s = motion_signals(frames).withColumn("change", F.col("speed") - F.lag("speed").over(w))
    base = F.avg(F.abs("change")).over(w.rowsBetween(-3, -1))
    return own(s.withColumn("baseline", base)).filter("change is not null").select(*EP, "frame_index", "change", "baseline")


def post_mean(frames: DataFrame) -> DataFrame:
    """Mean of the next four acceleration norms."""
    w = by_frame()
    s = motion_signals(frames).withColumn("post", F.avg("accel").over(w.rowsBetween(1, 4)))
    return own(s).filter("accel is not null").select(*EP, "frame_index", "accel", "post")


def autocorr_decay(frames: DataFrame, lags: int = 10) -> DataFrame:
    """Mean of the normalised autocorrelation of speed over the first lags: (episode, n_frames, decay)."""
    w = by_frame()
    s = motion_signals(frames, max(HALO, lags + 1))
    s = s.select(*EP, "frame_index", "_own", F.col("speed3"), *[
        (F.col("speed3") * F.lead("speed3", k).over(w)).alias(f"_r{k}") for k in range(lags)])
    sums = own(s).groupBy(*EP).agg(F.count(F.lit(1)).alias("n_frames"), *[F.sum(f"_r{k}").alias(f"_r{k}") for k in range(lags)])
    used = F.least(F.lit(lags), F.col("n_frames") - 1)
    total = sum((F.coalesce(F.col(f"_r{k}"), F.lit(0.0)) for k in range(lags)), F.lit(0.0))
    return sums.select(*EP, "n_frames", F.when(F.col("_r0") > 1e-10, clip(total / F.col("_r0") / used)).otherwise(F.lit(0.5)).alias("decay"))


def cross_corr(series: DataFrame, left: str = "x", right: str = "y", max_lag: int = 5) -> DataFrame:
    """Peak of the z-normed cross-correlation within +-max_lag: (episode, n, peak, lag).

    ``series`` holds (episode, frame_index, left, right), frame_index dense from 0. A positive
    lag means the left signal comes later.
    """
    stats = series.groupBy(*EP).agg(
        F.count(F.lit(1)).alias("n_frames"),
        *[f(x).alias(f"_{p}{x}") for x in (left, right) for p, f in (("m", F.avg), ("s", F.stddev_pop))])
    ch = attach(chunked(series.select(*EP, "frame_index", left, right), halo=max(HALO, max_lag + 1)), stats,
                ["n_frames", f"_m{left}", f"_s{left}", f"_m{right}", f"_s{right}"])

    def z(x):
        d = F.col(x) - F.col(f"_m{x}")
        return F.when(F.col(f"_s{x}") > 1e-10, d / F.col(f"_s{x}")).otherwise(d)

    w = by_frame()
    ch = ch.withColumn("_zx", z(left)).withColumn("_zy", z(right))
    lags = range(-max_lag, max_lag + 1)
    ch = ch.select(*EP, "n_frames", "_own", *[
        ((F.lead("_zx", k).over(w) if k >= 0 else F.lag("_zx", -k).over(w)) * F.col("_zy")).alias(f"_c{k + max_lag}") for k in lags])
    sums = own(ch).groupBy(*EP, "n_frames").agg(*[F.coalesce(F.sum(f"_c{k + max_lag}"), F.lit(0.0)).alias(f"_c{k + max_lag}") for k in lags])
    reach = F.least(F.lit(max_lag), F.floor(F.col("n_frames") / 2))
    cells = F.array(*[F.struct((F.col(f"_c{k + max_lag}") / F.col("n_frames")).alias("v"), F.lit(-k).alias("o"), F.lit(k).alias("lag")) for k in lags])
    best = F.array_max(F.filter(cells, lambda x: F.abs(x["lag"]) <= reach))
    return sums.select(*EP, F.col("n_frames").alias("n"), best["v"].alias("peak"), best["lag"].cast("long").alias("lag"), reach.alias("lag_range"))


def cumulative_offset(episodes: DataFrame, chunks_size: int = 1000) -> DataFrame:
    """Start frame of an episode inside its video chunk: from timestamps, else summed lengths."""
    group = F.floor(F.col("episode_index") / chunks_size).cast("long")
    eps = episodes.withColumn("chunk_index", group)
    out = scan(eps, ["dataset_id", "chunk_index"], F.floor(F.col("episode_index") / 256).cast("long"), "episode_index",
               exclusive=["_before"], _before=("sum", F.col("length")))
    start = F.coalesce(F.col("_before"), F.lit(0)).cast("long")
    if "from_timestamp" in episodes.columns:
        out = out.withColumn("frame_start", F.coalesce(F.bround(F.col("from_timestamp") * F.col("fps")).cast("long"), start))
        return out.withColumn("frame_end", F.coalesce(
            F.bround(F.col("to_timestamp") * F.col("fps")).cast("long"), F.col("frame_start") + F.col("length"))).drop("_before")
    return out.withColumn("frame_start", start).withColumn("frame_end", F.col("frame_start") + F.col("length")).drop("_before")


def task_local_index(episodes: DataFrame) -> DataFrame:
    """0-based rank of an episode inside its task by global index."""
    return numbered(episodes, TASK, "episode_index", chunk_of("episode_index"), "task_local_index")


def hot_zones(stds: DataFrame, keys, bins: int, share: float = 0.7, gap: int = 5, span: int = 10) -> DataFrame:
    """Bins whose sigma/max reaches its 70th rank, merged over short gaps: (key, start, end, peak).

    ``end`` is the last bin, as in the chart; the number of bins per key is fixed.
    """
    if bins < 20:
        return stds.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("peak")).limit(0)
    w = Window.partitionBy(*keys)
    s = stds.select(*keys, "bin", "std", F.max("std").over(w).alias("_max"), F.count(F.lit(1)).over(w).alias("_n"))
    s = s.filter(F.col("_max") >= 1e-10).withColumn("_v", F.col("std") / F.col("_max"))
    s = s.withColumn("_r", F.row_number().over(w.orderBy("_v")) - 1)
    s = s.withColumn("_t", F.max(F.when(F.col("_r") == F.floor(F.col("_n") * share), F.col("_v"))).over(w)).filter("_v >= _t")
    o = w.orderBy("bin")
    # islands closer than the gap are one zone: break where the distance to the previous hot bin reaches it
    s = s.withColumn("_new", F.when(F.col("bin") - F.lag("bin").over(o) < gap, 0).otherwise(1))
    s = s.withColumn("_z", F.sum("_new").over(o))
    zones = s.groupBy(*keys, "_z").agg(F.min("bin").alias("start"), F.max("bin").alias("end"), F.max("_v").alias("peak"))
    return zones.filter(F.col("end") - F.col("start") >= span).drop("_z")


def local_minima(frames: DataFrame, value: str, floor_by=None) -> DataFrame:
    """Plateau-aware local minima: (episode, frame_index at the plateau's middle, value).

    A plateau counts when both sides are strictly higher. Plateau bounds come from two-level
    scans, so plateaus may be longer than a chunk.
    """
    w = by_frame()
    ch = chunked(frames.select(*EP, "frame_index", value))
    prev, nxt = F.lag(value).over(w), F.lead(value).over(w)
    edge = own(ch.select(*EP, "frame_index", value, "_own",
                         (F.coalesce(prev != F.col(value), F.lit(True))).alias("_head"),
                         (F.coalesce(nxt != F.col(value), F.lit(True))).alias("_tail"),
                         (prev > F.col(value)).alias("_fall"), (nxt > F.col(value)).alias("_rise")))
    ends = scan(edge, EP, chunk_of(), "frame_index",
                _start=("max", F.when(F.col("_head"), F.col("frame_index"))),
                _good=("max", F.when(F.col("_head") & F.col("_fall"), F.col("frame_index"))))
    hit = ends.filter(F.col("_tail") & F.col("_rise") & (F.col("_start") == F.col("_good")))
    return hit.select(*EP, F.floor((F.col("_start") + F.col("frame_index")) / 2).cast("long").alias("frame_index"), value)


def spectral_low_share(frames: DataFrame, in_task: int = 1 << 20) -> DataFrame:
    """Share of velocity power in the lower half of the spectrum: (episode, spectral).

    Dimensions are scaled to unit variance. Up to ``in_task`` frames, one dimension of one
    episode is transformed in a task; longer ones go through ``spectrum.low_power``, which
    never holds a whole series. Runs jobs.
    """
    lengths = materialise(episode_lengths(frames))
    d = attach(own(derivatives(frames)), lengths, ["n_frames"]).select(*EP, "n_frames", "frame_index", F.posexplode("action").alias("dim", "x"), "vel")
    d = materialise(d.select(*EP, "n_frames", "frame_index", "dim", "x", F.get("vel", F.col("dim")).alias("v")))
    scale = d.groupBy(*EP, "dim").agg(F.stddev_pop("x").alias("s"))
    scale = scale.select(*EP, "dim", F.when(F.col("s") < 1e-8, F.lit(1.0)).otherwise(F.col("s") * F.col("s")).alias("s2"))

    @F.pandas_udf("struct<low double, total double>")
    def power(v: pd.Series) -> pd.DataFrame:
        p = [np.abs(np.fft.rfft(np.asarray(x, dtype=float))) ** 2 if len(x) else np.zeros(1) for x in v]
        return pd.DataFrame({"low": [float(x[:len(x) // 2].sum()) for x in p], "total": [float(x.sum()) for x in p]})

    short = d.filter(F.col("n_frames") <= in_task).groupBy(*EP, "dim").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("frame_index", "v")))), lambda t: t["v"]).alias("_v"))
    parts = short.select(*EP, "dim", power("_v").alias("p")).select(*EP, "dim", "p.low", "p.total")
    # lengths hold one row per episode: asking whether a long one exists is cheap
    if not lengths.filter(F.col("n_frames") > in_task).isEmpty():
        long_ = d.filter((F.col("n_frames") > in_task) & F.col("v").isNotNull()).select(
            *EP, "dim", (F.col("n_frames") - 1).alias("n"), (F.col("frame_index") - 1).alias("t"), "v")
        parts = parts.unionByName(low_power(long_, [*EP, "dim"], EP))
    sums = parts.join(scale, [*EP, "dim"]).groupBy(*EP).agg(F.sum(F.col("low") / F.col("s2")).alias("low"), F.sum(F.col("total") / F.col("s2")).alias("total"))
    return sums.select(*EP, F.when(F.col("total") > 1e-10, F.col("low") / F.col("total")).otherwise(F.lit(0.5)).alias("spectral"))


def first_true(df: DataFrame, keys, mask: Column, frame: str = "frame_index") -> DataFrame:
    """First frame where the mask holds, per key."""
    return df.groupBy(*keys).agg(F.min(F.when(mask, F.col(frame))).alias("first_frame"))


def argmax(df: DataFrame, keys, value: str, frame: str = "frame_index") -> DataFrame:
    """Frame of the largest value, the first on ties."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(frame)).alias("o")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, (-F.col("_b.o")).alias("frame_index"), F.col("_b.v").alias(value))

