"""Events and scores against brute force, ranges and short input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.operators import divergence, events, scores, series, stats
from motionlake.operators.chunks import episode_lengths
from tests import twins
from tests.fixtures import FRAME_SCHEMA, cohort, frames_of, random_episodes

LENGTHS = [1, 2, 3, 4, 5, 6, 9, 10, 11, 40, 77, 150]


@pytest.fixture(scope="module")
def eps():
    return random_episodes(LENGTHS, seed=4)


@pytest.fixture(scope="module")
def frames(spark, eps):
    return frames_of(spark, eps)


def by_episode(df, col):
    return {r.episode_index: r[col] for r in df.collect()}


def test_events_equal_brute_force(frames, eps):
    got = {}
    for r in events.all_events(frames).collect():
        got.setdefault(r.episode_index, []).append((r.frame, r.event_type, r.severity))
    for e, (a, _) in eps.items():
        assert sorted(got.get(e, [])) == sorted(twins.events(a)), e


def test_recovery_is_found(spark):
    a = np.zeros((60, 7))
    a[10:17, 0] = [1, -1, 1, -1, 1, -1, 1]
    a[17:, 0] = 9
    a[:, 6] = -1
    f = frames_of(spark, {0: (a, np.zeros((60, 8)))})
    rows = events.recovery_events(f).collect()
    assert [(r.frame, r.severity) for r in rows] == [(18, "significant")]
    assert scores.transition_metrics(f).collect()[0].has_recovery


def test_zero_cross_and_open_pause(spark):
    a = np.zeros((40, 3))
    a[:, 0] = np.concatenate([np.arange(30) * 0.1, np.full(10, 2.9)])
    a[:, 2] = np.r_[np.ones(10), 0, -np.ones(29)]
    f = frames_of(spark, {0: (a, np.zeros((40, 3)))})
    assert events.gripper_events(f).count() == 0
    assert events.pause_events(f).count() == 0


def test_smoothness_equals_brute_force(frames, eps):
    got = by_episode(scores.motion_smoothness(frames), "motion_smoothness")
    for e, (a, _) in eps.items():
        assert got[e] == pytest.approx(twins.smoothness(a), abs=1e-9), e


def test_scores_stay_in_range(frames):
    q = scores.quality_score(frames)
    rows = q.collect()
    assert len(rows) == len(LENGTHS)
    for r in rows:
        for c in ("overall_score", "motion_smoothness", "sync_score", "transition_diversity", "recovery_behavior_score", "near_miss_ratio", "action_space_coverage"):
            assert 0.0 <= r[c] <= 1.0 and r[c] == r[c], (r.episode_index, c, r[c])
        assert r.quality_grade in "ABCDF"


def test_short_input_defaults(frames):
    t = by_episode(scores.transition_diversity(frames), "transition_diversity")
    assert t[0] == t[3] == 0.5
    assert by_episode(scores.near_miss_ratio(frames), "near_miss_ratio")[6] == 0.0
    assert by_episode(scores.action_space_coverage(frames), "action_space_coverage")[0] == 0.0
    m = scores.transition_metrics(frames)
    assert by_episode(m, "overall_transition_score")[5] == 0.2
    assert by_episode(scores.sync_score(frames), "sync_score")[1] == 0.5


def test_labels_win(spark, frames):
    labels = spark.createDataFrame([("d", 0, 9, True), ("d", 0, 10, False)], "dataset_id string, task_index long, episode_index long, success boolean")
    got = by_episode(scores.trajectory_completeness(frames, labels), "trajectory_completeness")
    assert got[9] == 1.0 and got[10] == 0.3


def test_cross_correlation_finds_the_lag(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=80)
    x = np.r_[np.zeros(3), y[:-3]]
    df = spark.createDataFrame([("d", 0, 0, i, float(x[i]), float(y[i])) for i in range(80)], "dataset_id string, task_index long, episode_index long, frame_index long, x double, y double")
    r = series.cross_corr(df).collect()[0]
    full = np.correlate((x - x.mean()) / x.std(), (y - y.mean()) / y.std(), "full") / 80
    part = full[79 - 5:79 + 6]
    assert r.lag == int(np.argmax(part)) - 5 and r.peak == pytest.approx(part.max())


@pytest.mark.parametrize("limit", [1 << 20, 8])
def test_spectral_share_both_ways(frames, eps, limit):
    got = by_episode(series.spectral_low_share(frames, in_task=limit), "spectral")
    for e, (a, _) in eps.items():
        sd = a.std(0)
        v = np.diff(a / np.where(sd < 1e-8, 1, sd), axis=0)
        p = np.abs(np.fft.rfft(v, axis=0)) ** 2 if len(v) else np.zeros((1, 1))
        want = p[:len(p) // 2].sum() / p.sum() if p.sum() > 1e-10 else 0.5
        assert got[e] == pytest.approx(want, abs=1e-9), (e, limit)


def test_divergent_episode_ranks_first(spark):
    e = cohort(20, seed=6)
    e[5][0][:, :3] += 2.0
    f = frames_of(spark, e)
    b = divergence.binned_actions(f)
    per = divergence.frame_divergence(divergence.scored_bins(b, divergence.task_trajectory_stats(b)))
    got = by_episode(divergence.episode_divergence(per, episode_lengths(f)), "divergence_score")
    want = twins.divergence(e)
    assert max(got, key=got.get) == 5
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    row = divergence.task_quality_report(f).collect()[0]
    assert row.num_episodes == 20 and row.most_divergent.startswith("episode_5")


def test_ragged_action_sizes_form_groups(spark):
    e = random_episodes([20, 21], dims=7)
    e.update({k + 10: v for k, v in random_episodes([20, 22, 23], dims=4).items()})
    b = divergence.binned_actions(frames_of(spark, e))
    assert {(r.dims, r.n) for r in divergence.task_trajectory_stats(b).select("dims", "n").distinct().collect()} == {(7, 2), (4, 3)}


def test_start_distance_over_many_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 3))
    df = spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(x)] + [("b", 0, [1.0, 2.0, 3.0])], "k string, id long, vec array<double>")
    got = {r.k: r for r in scores.starting_distance(df, ["k"], block=16).collect()}
    d = [np.linalg.norm(x[i] - x[j]) for i in range(150) for j in range(i)]
    assert got["a"].n == 150 and got["a"].mean_distance == pytest.approx(np.mean(d)) and got["b"].mean_distance is None


def test_blocks_grow_with_their_key(spark):
    df = spark.range(3000).selectExpr("'a' as k", "id", "array(cast(id as double)) as vec")
    size, cells = scores.block_cells(df, ["k"], 32)
    assert size.first()._nb <= scores.BLOCKS and cells.count() == 3000 * size.first()._nb
    got = scores.starting_distance(df, ["k"], block=32).first()
    assert got.n == 3000 and got.mean_distance == pytest.approx(3001 / 3, rel=1e-12)


def test_close_far_and_infinite_vectors_keep_their_distances():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 5)) + 1e6
    a[10:20] = a[:10]
    a[20:30] = a[:10] + 1e-7
    b = np.concatenate([a[:7], rng.normal(size=(9, 5)) * 1e200, np.full((1, 5), np.inf)])
    plain = lambda x, y: np.sqrt(((x - y) ** 2).sum())
    with np.errstate(all="ignore"):
        assert scores.distance_sum(a, step=100) == pytest.approx(sum(plain(a[i], a[j]) for i in range(40) for j in range(i)), rel=1e-9)
        assert scores.distance_sum(a[:20], a[20:]) == pytest.approx(sum(plain(x, y) for x in a[:20] for y in a[20:]), rel=1e-9)
        assert scores.distance_sum(a, b[:7]) == pytest.approx(sum(plain(x, y) for x in a for y in b[:7]), rel=1e-9)
        assert scores.distance_sum(a, b) == np.inf and scores.distance_sum(a[:0], a) == 0


def test_row_order_does_not_matter(frames):
    a = by_episode(scores.action_consistency(frames), "action_consistency")
    b = by_episode(scores.action_consistency(frames.orderBy(F.rand(3))), "action_consistency")
    assert a.keys() == b.keys() and all(a[e] == pytest.approx(b[e]) for e in a)


def test_null_action_is_not_an_event(spark):
    df = spark.createDataFrame([("d", 0, 0, i, 0.0, None, None) for i in range(12)], FRAME_SCHEMA)
    assert events.gripper_events(df).count() == 0


def test_equal_scores_have_one_winner(spark):
    rows = [("c", 0.5, 0.5, 0.1, 0.5), ("a", 0.5, 0.5, 0.1, 0.5), ("b", None, 0.4, 0.1, 0.5)]
    df = spark.createDataFrame(rows, "dataset_id string, mean_score double, avg_diversity double, avg_temporal double, pct_with_recovery double")
    r = stats.compare_datasets(df).first()
    assert (r["best_overall"], r["best_diversity"], r["best_temporal"], r["best_learning"]) == ("a",) * 4


def test_scored_vectors_equal_scored_bins(spark):
    """One row per bin gives the z distances and divergences of one row per dimension, with two action sizes in a task."""
    five, seven = random_episodes([30, 41, 52], seed=4, dims=5), random_episodes([33, 28, 47], seed=5)
    f = frames_of(spark, {**five, **{e + 10: x for e, x in seven.items()}})
    r = series.resample(f, divergence.BINS, "action", min_frames=5)
    b = divergence.by_dimension(r)
    st = divergence.task_trajectory_stats(b)
    v = divergence.scored_vectors(r, st)
    cells = lambda df: {tuple(x)[:-1]: x[-1] for x in df.collect()}
    long = lambda df: cells(df.select("episode_index", "bin", "dim", "z"))
    got, want = long(divergence.long_scores(v)), long(divergence.scored_bins(b, st))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    each = lambda df: cells(df.select("episode_index", "bin", "divergence"))
    got, want = each(divergence.vector_divergence(v)), each(divergence.frame_divergence(divergence.scored_bins(b, st)))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_scores_equal_to_six_digits_go_to_the_first_frame(spark):
    rows = [("ds0", 0, 1, 10, "high_jerk", "warning", 0.7000001, "a", 4), ("ds0", 0, 1, 11, "high_jerk", "warning", 0.7000002, "b", 4)]
    df = spark.createDataFrame(rows, "dataset_id string, task_index long, episode_index long, frame long, event_type string, severity string, score double, description string, ordinal int")
    assert [r.frame for r in events.dedupe_anchor(df).collect()] == [10]
