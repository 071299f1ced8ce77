"""Phase analysis against brute force and planted anomalies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake.operators import clusters, outliers, phases
from motionlake.operators.chunks import materialise
from motionlake.operators.scopes import ALL_TASKS, scope_episodes, scoped
from motionlake.plans.reports import analyze_tasks, episode_overview
from motionlake.schema import EP
from tests import twins
from tests.fixtures import cohort, cycle_episode, frames_of, random_episodes

RNG = np.random.default_rng(5)


def found_phases(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.episode_index, []).append((r.phase, r.cycle, r.start, r.end))
    return {e: sorted(v, key=lambda p: p[2]) for e, v in got.items()}


@pytest.fixture(scope="module")
def mixed():
    eps = random_episodes([60, 61, 75, 300, 18, 120], seed=9)
    eps[10] = cycle_episode(RNG, cycles=2)
    eps[11] = cycle_episode(RNG)
    still = random_episodes([140], seed=11)[0]
    still[0][:, -1] = 0.5
    eps[12] = still
    flipped = cycle_episode(RNG, hold=120, approach=15, tail=15)
    eps[13] = flipped
    ends = cycle_episode(RNG, tail=0)
    eps[14] = ends
    return eps


def test_segments_equal_brute_force(spark, mixed):
    got = found_phases(phases.segment(frames_of(spark, mixed)))
    for e, (a, s) in mixed.items():
        assert got.get(e, []) == sorted(twins.phases(a, s)[0], key=lambda p: p[2]), e


def test_open_event_one_past_the_end(spark, mixed):
    raw = phases.raw_gripper_events(phases.raw_ranges(frames_of(spark, {14: mixed[14]}))).collect()
    assert max(r.frame for r in raw if r.kind == "open") == len(mixed[14][0])


def test_features_equal_brute_force(spark, mixed):
    f = frames_of(spark, mixed)
    raw = phases.raw_ranges(f)
    c = phases.episode_cycles(f, phases.closed_ranges(raw), raw)
    for r in phases.shape_features(f, materialise(c)).collect():
        assert [r[x] for x in phases.FEATURES] == pytest.approx(twins.features(*mixed[r.episode_index]), abs=2e-4)


def test_clean_cohort_has_no_flags(spark):
    rep = analyze_tasks(frames_of(spark, cohort(30)))
    assert rep["reasons"].filter("signal in ('duration', 'cycle_count', 'envelope')").count() == 0


def test_planted_anomalies(spark):
    shape = {"hold": 80, "approach": 60, "tail": 60}
    eps = cohort(40, hold=80, rest=60)
    rng = np.random.default_rng(77)
    eps[40] = cycle_episode(rng, place_stretch=4, **shape)
    eps[41] = cycle_episode(rng, cycles=2, **shape)
    bump = cycle_episode(rng, **shape)
    bump[0][5:55, 0] += 1.5
    eps[42] = bump
    rep = analyze_tasks(frames_of(spark, eps))
    rows = rep["reasons"].collect()
    by = lambda s: {(r.episode_index, r.phase) for r in rows if r.signal == s}
    assert by("duration") == {(40, "Place")}
    assert by("cycle_count") == {(41, None)}
    assert (42, "Approach") in by("envelope")
    assert by("envelope") == {(e, p) for e, p, _, _ in twins.envelope_flags(eps)}
    text = next(r.explanation for r in rows if r.signal == "duration")
    assert text.startswith("Hesitation before release: Place phase (cycle 0) took")
    flat = {r.episode_index: r for r in episode_overview(rep).collect()}
    assert len(flat) == 43 and flat[40].is_anomaly


def test_envelope_equals_brute_force(spark):
    eps = cohort(25, seed=3)
    for i, e in enumerate((3, 9)):
        eps[e][0][5:28, 3 * i] += 1.2
    f = frames_of(spark, eps)
    got = {(r.episode_index, r.phase, r.cycle, r.feature): r.magnitude for r in phases.phase_envelope_flags(f, phases.segment(f)).collect()}
    want = twins.envelope_flags(eps)
    assert want and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=0.006) for k in want)


def test_envelope_needs_eleven_episodes(spark):
    eps = cohort(10, seed=4)
    eps[3][0][:28, 0] += 50
    f = frames_of(spark, eps)
    assert phases.phase_envelope_flags(f, phases.segment(f)).count() == 0


def feature_frame(spark, x):
    rows = [("d", 0, i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "dataset_id string, task_index long, episode_index long, " + ", ".join(f"{c} double" for c in phases.FEATURES))


def test_mahalanobis_equals_brute_force(spark):
    x = np.random.default_rng(2).normal(size=(60, 10)).round(4)
    x[7, [0, 9]] += 9
    df = feature_frame(spark, x)
    z = outliers.standardised(df)
    m = outliers.mahalanobis(z, outliers.inverse_covariance(outliers.shape_covariance(z)))
    got = {r.episode_index: r.d2 for r in m.collect()}
    want = twins.mahalanobis(x)
    assert all(got[i] == pytest.approx(want[i], rel=1e-6) for i in range(60))
    flags = outliers.shape_outlier_flags(df).collect()
    assert {r.episode_index for r in flags} == {i for i in range(60) if want[i] > outliers.CHI2_99_10}
    top = next(r for r in flags if r.episode_index == 7)
    assert set(top.feature.split(",")) <= {"arc_length_xyz", "episode_duration"}


def test_small_cohort_cannot_flag_shape(spark):
    x = np.random.default_rng(2).normal(size=(25, 10)).round(4)
    x[3] += 1000
    assert outliers.shape_outlier_flags(feature_frame(spark, x)).count() == 0


def test_three_modes_are_recovered(spark):
    rng = np.random.default_rng(8)
    centre = np.array([[0] * 10, [20] * 5 + [0] * 5, [0] * 5 + [20] * 5], float)
    x = np.vstack([c + rng.normal(size=(10, 10)) for c in centre])
    rows = clusters.variance_clusters(feature_frame(spark, x)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster, set()).add(r.episode_index)
    assert sorted(map(sorted, groups.values())) == [list(range(0, 10)), list(range(10, 20)), list(range(20, 30))]
    assert all(r.medoid in groups[r.cluster] for r in rows)


def test_clusters_hold_every_episode(spark):
    x = np.random.default_rng(1).normal(size=(203, 10))
    for n in (4, 203):
        rows = clusters.variance_clusters(feature_frame(spark, x[:n])).collect()
        assert sorted(r.episode_index for r in rows) == list(range(n))
    assert clusters.variance_clusters(feature_frame(spark, x[:3])).count() == 0


def cut_sets(points, k, **options):
    cuts, members = clusters.ward_cuts(points, (2, 3, 4, 5), **options)
    label = {r.id: r.label[k - 2] for r in cuts.filter("set = 0").collect()}
    groups = {}
    for r in members.collect():
        groups.setdefault(label[r.id], set()).add(r.episode_index)
    return sorted(map(sorted, groups.values())), {r.set: r.within[k - 2] for r in cuts.collect()}


@pytest.mark.parametrize("n, bound", [(24, 2048), (300, 2048), (300, 40)])
def test_linkage_equals_plain_ward(spark, n, bound):
    z = np.random.default_rng(4).normal(size=(n, 10)).round(9)
    z[3] = z[9]
    points = spark.createDataFrame([("d", 0, s, i, [float(v) for v in row * (1 + s)]) for s in (0, 1) for i, row in enumerate(z)],
                                   "dataset_id string, task_index long, set int, episode_index long, z array<double>")
    for k in (2, 5):
        groups, within = cut_sets(points, k, bound=bound, per_cell=20)
        want, total = twins.ward(z, k)
        assert groups == want and within[0] == pytest.approx(total, rel=1e-6) and within[1] == pytest.approx(4 * total, rel=1e-6)


def test_nearest_clusters_come_from_bounded_cells(spark):
    """In ten dimensions a cell of space that holds the nearest holds the whole set; a cell of the table of distances does not."""
    rng = np.random.default_rng(8)
    c, n, ids = rng.normal(size=(90, 10)).round(9), rng.integers(1, 5, 90), rng.permutation(90)
    c[7] = c[11]
    gap = clusters.ward(n.astype(float), c, n.astype(float), c)
    np.fill_diagonal(gap, np.inf)
    want = {int(ids[i]): min((float(gap[i, j]), int(ids[j])) for j in range(90)) for i in range(90)}
    rows = [("d", 0, 0, int(ids[i]), int(n[i]), [float(v) for v in c[i]], None) for i in range(90)]
    held = spark.createDataFrame(rows, "dataset_id string, task_index long, set int, id long, n long, c array<double>, other long")
    sizes = spark.createDataFrame([("d", 0, 0, 90, 90)], "dataset_id string, task_index long, set int, _many long, _asks long")
    got = {r.id: (r.gap, r.other) for r in clusters.nearest(held, sizes, 40).collect()}
    assert got == want
    near, whose = clusters.nearest_in(n.astype(float), c, ids, n.astype(float), c, ids)
    assert {int(i): (float(g), int(o)) for i, g, o in zip(ids, near, whose)} == want


@pytest.mark.parametrize("kind", ["plain", "outliers", "sizes", "ties"])
def test_large_sets_are_finished_without_their_matrix(kind, monkeypatch):
    """Sets of any kind have one tree, whether their gaps are in one matrix or clusters ask boxes of others for the nearest."""
    rng = np.random.default_rng(12)
    c, n = rng.uniform(-3, 3, (900, 10)).round(9), np.ones(900, int)
    if kind == "outliers":
        c[::50] *= 100
        c[0] = 1e4
    if kind == "sizes":
        n = rng.integers(1, 9, 900)
    if kind == "ties":
        c = np.unique(np.column_stack([rng.integers(0, 9, (900, 3)), np.zeros((900, 7))]), axis=0)
        n = np.ones(len(c), int)
    ids = rng.permutation(len(c)) * 3 + 1
    monkeypatch.setattr(clusters, "IN_MATRIX", 10**6)
    want = clusters.merge_sequence(ids, n, c)
    asked, ward = [], clusters.ward
    monkeypatch.setattr(clusters, "ward", lambda n, c, m, d: asked.append(len(n) * len(m)) or ward(n, c, m, d))
    monkeypatch.setattr(clusters, "IN_MATRIX", 40)
    monkeypatch.setattr(clusters, "TILE", 64)
    assert clusters.merge_sequence(ids, n, c) == want
    assert max(asked) <= 40 * 40


def test_reasons_of_all_scopes_do_not_wait_for_clusters(spark, monkeypatch):
    import motionlake.plans.phase_queries  # noqa: F401  (fills the registry)
    from motionlake.plans.registry import QUERIES
    from motionlake.sources import driver_tables

    monkeypatch.setattr(driver_tables, "_INGESTED", {})
    monkeypatch.setattr(clusters, "variance_clusters", lambda *a, **k: pytest.fail("clusters were built"))
    QUERIES["anomaly_reasons_all"](spark, "/root/testdata/sf0.001").collect()


def test_few_different_vectors_are_one_cluster(spark):
    rows = clusters.variance_clusters(feature_frame(spark, np.ones((6, 10)))).collect()
    assert {(r.cluster, r.size, r.episode_index) for r in rows} == {("C1", 6, i) for i in range(6)}


@pytest.mark.parametrize("rank", [0, 2, 9, 10])
def test_pseudo_inverse_in_columns(spark, rank):
    rng = np.random.default_rng(rank)
    b = rng.normal(size=(10, rank))
    m = b @ b.T
    cov = spark.createDataFrame([("d", 0, i, j, float(m[i, j])) for i in range(10) for j in range(i, 10)], "dataset_id string, task_index long, i int, j int, cov double")
    got = np.array(outliers.inverse_covariance(cov).first().inv)
    want = np.linalg.pinv(m, rcond=1e-10, hermitian=True)
    assert np.abs(got - want).max() <= 1e-6 * max(1, np.abs(want).max())


def test_medoid_is_the_most_central_member(spark):
    x = np.random.default_rng(6).normal(size=(30, 10)).round(4)
    z = (x - x.mean(0)) / x.std(0)
    rows = clusters.variance_clusters(feature_frame(spark, x)).collect()
    for c in {r.cluster for r in rows}:
        ids = sorted((r.episode_index for r in rows if r.cluster == c), key=str)
        cost = ((z[ids][:, None] - z[ids][None]) ** 2).sum((1, 2))
        assert {r.medoid for r in rows if r.cluster == c} == {ids[int(cost.argmin())]}
        assert {r.size for r in rows if r.cluster == c} == {len(ids)}


def test_cohort_keeps_the_first(spark):
    f = frames_of(spark, random_episodes([12, 9, 15, 20]))
    assert {r.episode_index for r in phases.cohort(f, 2).select(*EP).distinct().collect()} == {0, 1}


def task_of(frames, task, episodes):
    return frames.filter(F.col("episode_index").isin(list(episodes))).withColumn("task_index", F.lit(task).cast("long"))


def rows_of(report, name, task):
    cols = [c for c in report[name].columns if c != "task_index"]
    return sorted(str(tuple(r[c] for c in cols)) for r in report[name].filter(F.col("task_index") == task).collect())


def test_all_scopes_equal_separate_runs(spark):
    """Tasks and the whole dataset in one pass: the same rows as a run for each alone."""
    eps = cohort(24, seed=8)
    eps[3][0][5:28, 0] += 1.4
    eps[20] = cycle_episode(np.random.default_rng(4), cycles=3)
    all_ = materialise(frames_of(spark, eps))
    parted = materialise(task_of(all_, 0, range(0, 11)).unionByName(task_of(all_, 1, range(11, 24))))
    both = analyze_tasks(parted, scopes=("task", "dataset"))
    for task, alone in ((0, task_of(all_, 0, range(0, 11))), (1, task_of(all_, 1, range(11, 24))), (ALL_TASKS, task_of(all_, ALL_TASKS, range(24)))):
        single = analyze_tasks(alone)
        for name in ("phases", "cycles", "features", "reasons", "members"):
            assert rows_of(both, name, task) == rows_of(single, name, task), (name, task)
    assert both["reasons"].filter(F.col("task_index") == ALL_TASKS).count() > 0


def test_first_episodes_of_each_scope(spark):
    """The first n by index: of each task, and of the dataset over all tasks."""
    rows = [("d", i % 2, i, 10) for i in range(9)] + [("e", 5, 3, 10)]
    lengths = spark.createDataFrame(rows, "dataset_id string, task_index long, episode_index long, n_frames long")
    got = {(r.dataset_id, r.episode_index): r.scopes for r in scope_episodes(lengths, ("task", "dataset"), 3).collect()}
    want = {("d", 0): [-1, 0], ("d", 1): [-1, 1], ("d", 2): [-1, 0], ("d", 3): [1], ("d", 4): [0], ("d", 5): [1], ("e", 3): [-1, 5]}
    assert got == want
    only = scope_episodes(lengths, ("dataset",), 2)
    assert sorted((r.dataset_id, r.task_index, r.episode_index) for r in scoped(lengths, only).collect()) == [("d", -1, 0), ("d", -1, 1), ("e", -1, 3)]
    assert scope_episodes(lengths.filter("false"), ("dataset",), 2).count() == 0


def test_duration_reasons_of_the_queries_are_those_of_gripper_phases(spark):
    """The operator also flags phases cut at velocity minima; the SQL of the reasons has gripper phases only."""
    import motionlake.plans.phase_queries  # noqa: F401  (fills the registry)
    from motionlake.plans.registry import QUERIES
    row = lambda signal, phase: ("d", 0, 1, signal, phase)
    rows = [row("duration", "Motion3"), row("duration", "Pause1"), row("duration", "Place"), row("envelope", "Motion1"), row("shape", None), row("cycle_count", None)]
    df = spark.createDataFrame(rows, "dataset_id string, task_index long, episode_index long, signal string, phase string")
    kept = {(r.signal, r.phase) for r in phase_queries.of_gripper_phases(df).collect()}
    assert kept == {("duration", "Place"), ("envelope", "Motion1"), ("shape", None), ("cycle_count", None)}
