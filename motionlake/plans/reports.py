"""Whole analyses as one job: phase-aware report, signal comparison."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.functions.vectors import magnitude
from motionlake.operators import clusters, outliers, phases, stats
from motionlake.operators.chunks import attach, chunk_of, episode_lengths, materialise
from motionlake.operators.scopes import scope_episodes, scoped
from motionlake.operators.series import hot_zones
from motionlake.schema import EP


def analyze_tasks(frames: DataFrame, cohort_size: int = None, scopes=("task",)) -> dict:
    """``analyze_phases`` with the clusters of every task (members). Runs jobs."""
    found = analyze_phases(frames, cohort_size, scopes)
    return {**found, "members": materialise(clusters.variance_clusters(found["features"]))}


def analyze_phases(frames: DataFrame, cohort_size: int = None, scopes=("task",)) -> dict:
    """Phases, features and reasons of every task.

    ``scopes``: "task" compares an episode with its task, "dataset" with all episodes of its dataset
    (``task_index`` is then ``ALL_TASKS``); both may be named and share one pass over the frames.
    ``cohort_size`` keeps the first n episodes of a scope; without it every episode counts.
    Returns tables by name, one row per scope for what depends on it (phases, cycles, features,
    reasons); shared intermediates are written once. Runs jobs.
    """
    lengths = episode_lengths(frames)
    episodes = materialise(scope_episodes(lengths, scopes, cohort_size))
    if cohort_size is not None:
        frames = materialise(attach(frames.withColumn("_chunk", chunk_of()), episodes, []).drop("_chunk"))
    raw = phases.raw_ranges(frames)
    ranges = phases.closed_ranges(raw)
    segments = materialise(phases.segment(frames, ranges))
    signals = materialise(phases.phase_signals(frames, segments))
    counted = materialise(phases.episode_cycles(frames, ranges, raw))
    shapes = phases.shape_features(frames, counted)
    found, cycles = scoped(segments, episodes), materialise(scoped(counted, episodes))
    features = materialise(scoped(shapes, episodes))
    reasons = (phases.envelope_flags(scoped(signals, episodes), found).unionByName(phases.phase_duration_flags(found))
               .unionByName(phases.cycle_count_flags(cycles)).unionByName(outliers.shape_outlier_flags(features)))
    return {
        "raw_ranges": raw, "ranges": ranges, "phases": found, "cycles": cycles, "features": features,
        "reasons": materialise(reasons),
    }


def episode_overview(report: dict) -> DataFrame:
    """Flat report: cycles, frames, number of reasons, cluster per episode."""
    r = report["reasons"].groupBy(*EP).agg(F.count(F.lit(1)).alias("reasons"))
    j = report["cycles"].select(*EP, "n_frames", "num_cycles").join(r, EP, "left").join(report["members"].select(*EP, "cluster"), EP, "left")
    return j.withColumn("reasons", F.coalesce("reasons", F.lit(0)).cast("long")).withColumn("is_anomaly", F.col("reasons") > 0)


def position_signal(frames: DataFrame, indices=(0, 1, 2)) -> DataFrame:
    return frames.select(*EP, "frame_index", magnitude("action", indices).alias("value"))


def signal_comparison(frames: DataFrame, bins: int = 200, indices=(0, 1, 2)) -> dict:
    """Envelope, outlying episodes, coverage and hot zones of one signal for every task."""
    signal = position_signal(frames, indices)
    binned = materialise(stats.envelope_bins(signal, bins))
    envelope = materialise(stats.signal_envelope(binned))
    ranges = stats.robust_range(signal)
    return {"binned": binned, "envelope": envelope, "ranges": ranges, "outliers": stats.outlier_fraction(binned, envelope),
            "coverage": stats.band_coverage(envelope, ranges), "hot_zones": hot_zones(envelope, ["dataset_id", "task_index"], bins)}
