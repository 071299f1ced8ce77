"""Queries over frames: sources, projections, series, events, scores."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from motionlake.functions import scalars, vectors
from motionlake.operators import divergence, events, projections, relations, scores, series, stats
from motionlake.operators.chunks import episode_lengths, greedy_min_gap, materialise, merge_ranges, own, runs
from motionlake.plans.registry import DIMS, EPC, EPISODES, FRAMES, SERIES, W, I, R, greedy, query
from motionlake.schema import EP, TASK
from motionlake.sources.driver_tables import event_frames, ingested, order_frames, table, task_table


def frames(spark, sf):
    return ingested(spark, sf, "frames", lambda: event_frames(spark, sf))


def lengths(spark, sf):
    return ingested(spark, sf, "lengths", lambda: episode_lengths(frames(spark, sf)))


def ready(spark, sf):
    return ingested(spark, sf, "prepared", lambda: events.prepared(frames(spark, sf)))


def found_events(spark, sf):
    return ingested(spark, sf, "events", lambda: events.all_events(frames(spark, sf), ready(spark, sf)))


def quality(spark, sf):
    return ingested(spark, sf, "quality", lambda: scores.quality_score(frames(spark, sf), timestamps=False))


def resampled(spark, sf):
    return ingested(spark, sf, "resampled", lambda: series.resample(frames(spark, sf), divergence.BINS, "action", min_frames=5))


def traj_stats(spark, sf):
    return ingested(spark, sf, "traj_stats", lambda: divergence.task_trajectory_stats(divergence.by_dimension(resampled(spark, sf))))


def zvectors(spark, sf):
    return ingested(spark, sf, "zvectors", lambda: divergence.scored_vectors(resampled(spark, sf), traj_stats(spark, sf)))


def zscores(spark, sf):
    return divergence.long_scores(zvectors(spark, sf))


def per_bin(spark, sf):
    return divergence.vector_divergence(zvectors(spark, sf))


def signal(spark, sf):
    return frames(spark, sf).select(*EP, "frame_index", vectors.magnitude("action", (0, 1, 2)).alias("value"))


def envelope_bins(spark, sf):
    return ingested(spark, sf, "envelope_bins", lambda: stats.envelope_bins(signal(spark, sf)))


def envelope(spark, sf):
    return ingested(spark, sf, "envelope", lambda: stats.signal_envelope(envelope_bins(spark, sf)))


EVENT_COLS = [*EP, "frame", "event_type", "severity", "score", "description"]
SQL_EP = f"{EPC}, "


def ev_sql(cte, frame, kind, severity, score, text, where, source):
    return f"WITH {cte} SELECT {SQL_EP}{I(frame, 'frame')}, '{kind}' AS event_type, {severity} AS severity, {R(score, 'score')}, {text} AS description FROM {source} WHERE {where}"


# ---------------------------------------------------------------- sources and projections

@query("frames", f"WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('ts', 'ts')}, {R('a0', 'a0')}, {R('a5', 'a5')}, {R('a6', 'grip')}, {R('s0', 's0')}, {R('s1', 's1')}, {R('s2', 's2')} FROM fr")
def _(spark, sf):
    a, s = (lambda i: F.col("action")[i]), (lambda i: F.col("state")[i])
    return event_frames(spark, sf).select(*EP, "frame_index", "ts", a(0).alias("a0"), a(5).alias("a5"), a(6).alias("grip"), s(0).alias("s0"), s(1).alias("s1"), s(2).alias("s2"))


@query("short_frames", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 f FROM lineitem)
SELECT 'orders' AS dataset_id, CAST(l_orderkey % 5 AS BIGINT) AS task_index, l_orderkey AS episode_index, CAST(f AS BIGINT) AS frame_index, round(f / 10e0, 6) + 0e0 AS ts, round(l_quantity / 50e0, 6) + 0e0 AS a0, round(l_tax, 6) + 0e0 AS a3 FROM o""")
def _(spark, sf):
    return order_frames(spark, sf).select(*EP, "frame_index", "ts", F.col("action")[0].alias("a0"), F.col("action")[3].alias("a3"))


@query("comparison_series", f"""WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('ts', 'ts')}, entity, {R('value', 'value')} FROM (
SELECT *, unnest(['position_mag', 'x', 'y', 'z', 'rotation_mag', 'gripper']) entity, unnest([sqrt(a0*a0+a1*a1+a2*a2), a0, a1, a2, sqrt(a3*a3+a4*a4+a5*a5), a6]) value FROM fr)""")
def _(spark, sf):
    return projections.position_series(frames(spark, sf))


@query("semantic_series", f"""WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('ts', 'ts')}, entity, {R('value', 'value')} FROM (
SELECT *, unnest(['action/x', 'action/y', 'action/z', 'action/roll', 'action/pitch', 'action/yaw', 'action/gripper', 'state/dim_0', 'state/dim_1', 'state/dim_2']) entity, unnest([a0, a1, a2, a3, a4, a5, a6, s0, s1, s2]) value FROM fr)""")
def _(spark, sf):
    f = frames(spark, sf)
    return projections.semantic_series(f, ["x", "y", "z", "roll", "pitch", "yaw", "gripper"]).unionByName(projections.semantic_series(f, None, "state", "state"))


@query("pick_action", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) + 0e0 AS first, round(CAST(embedding[64] AS DOUBLE), 6) + 0e0 AS last FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("observation.state"))
    return projections.pick_action(e).select("vec_id", F.size("signal").alias("dims"), F.element_at("signal", 1).alias("first"), F.element_at("signal", -1).alias("last"))


@query("append_gripper", "SELECT vec_id, CAST(len(embedding) + 1 AS BIGINT) AS dims, CAST(label AS DOUBLE) + 0e0 AS last FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("observation.state"), F.col("label").cast("double").alias("gripper_width"))
    p = projections.append_gripper(projections.pick_action(e))
    return p.select("vec_id", F.size("signal").alias("dims"), F.element_at("signal", -1).alias("last"))


@query("synthesize_action", f"""WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('coalesce(s0 - lag(s0) OVER w, 0)', 'dx')}, {R('coalesce(s1 - lag(s1) OVER w, 0)', 'dy')},
{R('coalesce(s2 - lag(s2) OVER w, 0)', 'dz')}, 0e0 AS roll, {R('-a6', 'grip')} FROM fr WINDOW w AS {W}""")
def _(spark, sf):
    f = frames(spark, sf).withColumn("gripper_width", vectors.last("action")).drop("action")
    a = lambda i, n: F.col("action")[i].alias(n)
    return projections.synthesize_action(f).select(*EP, "frame_index", a(0, "dx"), a(1, "dy"), a(2, "dz"), a(3, "roll"), a(6, "grip"))


@query("synth_timestamps", f"WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('CASE WHEN frame_index % 3 = 0 THEN frame_index / 10e0 ELSE ts END', 'ts_sec')} FROM fr")
def _(spark, sf):
    f = frames(spark, sf).withColumn("ts", F.when(F.col("frame_index") % 3 != 0, F.col("ts")))
    return projections.synth_timestamps(f).select(*EP, "frame_index", "ts_sec")


@query("dimension_labels", """SELECT vec_id, CASE d WHEN 7 THEN 'x,y,z,rx,ry,rz,gripper' WHEN 8 THEN 'x,y,z,rx,ry,rz,state,gripper' WHEN 6 THEN 'x,y,z,rx,ry,rz' WHEN 3 THEN 'x,y,z'
ELSE array_to_string(list_transform(range(d), lambda i: 'dim_' || i), ',') END AS labels FROM (SELECT vec_id, vec_id % 9 + 1 d FROM embeddings)""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 9 + 1).cast("int").alias("d"))
    return e.select("vec_id", F.concat_ws(",", scalars.dimension_labels("d")).alias("labels"))


@query("magnitude", f"WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('sqrt(a0*a0+a1*a1+a2*a2)', 'position')}, {R('sqrt(a5*a5+a6*a6)', 'partial')} FROM fr")
def _(spark, sf):
    return frames(spark, sf).select(*EP, "frame_index", vectors.magnitude("action", (0, 1, 2)).alias("position"), vectors.magnitude("action", (5, 6, 7)).alias("partial"))


@query("stride_frames", f"WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {I('st', 'stride')} FROM (SELECT *, CASE WHEN n > 20 THEN CAST(ceil(n / 20e0) AS BIGINT) ELSE 1 END st FROM fr) WHERE frame_index % st = 0")
def _(spark, sf):
    return projections.stride_frames(frames(spark, sf), 20).select(*EP, "frame_index", "stride")


@query("downsample", f"""WITH {FRAMES}, t AS (SELECT DISTINCT episode_index, n, CAST(floor(i * n / 25e0) AS BIGINT) frame_index, i FROM fr, range(25) r(i) WHERE n > 25)
SELECT {SQL_EP}{I('fr.frame_index', 'frame_index')}, {I('coalesce(t.i, fr.frame_index)', 'point')} FROM fr LEFT JOIN t USING (episode_index, frame_index) WHERE fr.n <= 25 OR t.i IS NOT NULL""")
def _(spark, sf):
    return projections.downsample(frames(spark, sf), 25).select(*EP, "frame_index", "point")


@query("slice_frames", f"WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('a0', 'a0')} FROM fr WHERE frame_index >= 10 AND frame_index < 14")
def _(spark, sf):
    return projections.slice_frames(frames(spark, sf), 10, 14).select(*EP, "frame_index", F.col("action")[0].alias("a0"))


@query("frame_at", f"WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('ts', 'ts')} FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY abs(ts - 500000e0), frame_index) r FROM fr) WHERE r = 1")
def _(spark, sf):
    return projections.frame_at(frames(spark, sf), 500000.0)


@query("even_sample", f"""WITH {FRAMES}, t AS (SELECT DISTINCT episode_index, CAST(floor(i * (n - 1) / 9e0 + 1e-9) AS BIGINT) frame_index FROM fr, range(10) r(i))
SELECT {SQL_EP}{I('fr.frame_index', 'frame_index')} FROM fr JOIN t USING (episode_index, frame_index)""")
def _(spark, sf):
    return projections.even_sample(frames(spark, sf), 10).select(*EP, "frame_index")


@query("edge_rows", f"WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, side FROM (SELECT *, 'first' side FROM fr WHERE frame_index < 5 UNION ALL SELECT *, 'last' side FROM fr WHERE frame_index >= n - 5)")
def _(spark, sf):
    f = frames(spark, sf).select(*EP, "frame_index")
    return projections.edge_rows(f, 5).withColumn("side", F.lit("first")).unionByName(projections.edge_rows(f, 5, "last").withColumn("side", F.lit("last")))


@query("edge_frames", f"WITH {EPISODES} SELECT {SQL_EP}{R('greatest(t0, t1 - 1/30e0)', 'end_ts')}, {R('t0', 'start_ts')} FROM (SELECT *, episode_index / 4e0 t0, episode_index / 4e0 + (n_frames - 1) / 30e0 t1 FROM ep)")
def _(spark, sf):
    e = lengths(spark, sf).withColumn("from_timestamp", F.col("episode_index") / 4.0).withColumn("to_timestamp", F.col("from_timestamp") + (F.col("n_frames") - 1) / 30.0)
    end = projections.edge_frames(e, "end").withColumnRenamed("target_ts", "end_ts")
    return projections.edge_frames(end, "start").select(*EP, "end_ts", F.col("target_ts").alias("start_ts"))


@query("filter_task", f"WITH {EPISODES} SELECT {SQL_EP}{I('n_frames', 'n_frames')}, rule FROM (SELECT *, 'name' rule FROM ep WHERE task_index = 3 UNION ALL SELECT *, 'untitled' rule FROM ep WHERE task_index = 2 UNION ALL SELECT *, 'all' rule FROM ep)")
def _(spark, sf):
    e, t = lengths(spark, sf), task_table(frames(spark, sf))
    pick = lambda name, rule: projections.filter_task(e, t, name).withColumn("rule", F.lit(rule))
    return pick("task 3", "name").unionByName(pick("Untitled (task 2)", "untitled")).unionByName(pick("_all_", "all"))


@query("synth_and_summary", f"WITH {FRAMES} SELECT {SQL_EP}{I('count(*)', 'n_frames')}, {R('max(ts) - min(ts)', 'duration_s')} FROM fr GROUP BY ALL")
def _(spark, sf):
    return stats.episode_summary(frames(spark, sf))


# ---------------------------------------------------------------- series

@query("derivatives", f"WITH {SERIES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('speed', 'speed')}, {R('accel', 'accel')}, {R('jerk', 'jerk')}, {R('delta', 'delta')}, {R('accel_all', 'accel_all')}, {R('speed3', 'speed3')} FROM se")
def _(spark, sf):
    return own(series.motion_signals(frames(spark, sf))).drop("_chunk", "grip")


def gauss_sql(x, sigma, n):
    w = series.gaussian_weights(sigma)
    r = len(w) // 2
    j = lambda k: f"((i + {k}) % (2*{n}) + 2*{n}) % (2*{n})"
    terms = [f"l[CAST(CASE WHEN {j(k - r)} < {n} THEN {j(k - r)} ELSE 2*{n} - 1 - {j(k - r)} END AS BIGINT) + 1] * {w[k]!r}" for k in range(2 * r + 1)]
    return " + ".join(terms)


@query("gaussian_smooth", f"""WITH {FRAMES}, l AS (SELECT {EPC}, n, list(a0 ORDER BY frame_index) l FROM fr GROUP BY ALL)
SELECT {SQL_EP}{I('i', 'frame_index')}, {R(gauss_sql('a0', 3.0, 'n'), 'smoothed')} FROM (SELECT *, unnest(range(n)) i FROM l)""")
def _(spark, sf):
    return series.smooth(frames(spark, sf), F.col("action")[0], 3.0)


@query("median_filter", f"""WITH {FRAMES}, l AS (SELECT *, list(a0) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) l FROM fr)
SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('list_sort(list_concat(l, list_transform(range(15 - len(l)), lambda x: 0e0)))[8]', 'filtered')} FROM l""")
def _(spark, sf):
    return series.median_filter(frames(spark, sf), F.col("action")[0])


@query("smooth3", f"""WITH {SERIES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('coalesce(lag(v0) OVER w, 0)*0.25e0 + v0*0.5e0 + coalesce(lead(v0) OVER w, 0)*0.25e0', 'v0')},
{R('coalesce(lag(v2) OVER w, 0)*0.25e0 + v2*0.5e0 + coalesce(lead(v2) OVER w, 0)*0.25e0', 'v2')} FROM d1 WHERE frame_index >= 1 WINDOW w AS {W}""")
def _(spark, sf):
    return series.smooth3(frames(spark, sf)).select(*EP, "frame_index", F.col("smoothed")[0].alias("v0"), F.col("smoothed")[2].alias("v2"))


RUNS_SQL = f"""runs AS MATERIALIZED (SELECT {EPC}, min(frame_index) s, max(frame_index) + 1 e, count(*) len FROM (
SELECT *, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) g FROM fr WHERE a0 < 0.2e0) GROUP BY {EPC}, g)"""


@query("runs", f"WITH {FRAMES}, {RUNS_SQL} SELECT {SQL_EP}{I('s', 'start')}, {I('e', 'end')}, {I('len', 'length')} FROM runs")
def _(spark, sf):
    f = frames(spark, sf)
    return runs(f, F.col("action")[0] < 0.2)


@query("merge_ranges", f"""WITH {FRAMES}, {RUNS_SQL}, m AS (SELECT *, sum(CASE WHEN s - p < 4 THEN 0 ELSE 1 END) OVER (PARTITION BY episode_index ORDER BY s) g FROM (
SELECT *, lag(e) OVER (PARTITION BY episode_index ORDER BY s) p FROM runs)) SELECT {SQL_EP}{I('min(s)', 'start')}, {I('max(e)', 'end')} FROM m GROUP BY {EPC}, g""")
def _(spark, sf):
    r = runs(frames(spark, sf), F.col("action")[0] < 0.2)
    return merge_ranges(r.select(*EP, "start", "end"), 4)


@query("local_minima", f"""WITH {FRAMES}, q AS (SELECT *, sum(CASE WHEN a5 = p THEN 0 ELSE 1 END) OVER {W} g FROM (SELECT *, lag(a5) OVER {W} p FROM fr)),
pl AS (SELECT {EPC}, n, g, min(a5) v, min(frame_index) a, max(frame_index) b FROM q GROUP BY ALL)
SELECT {SQL_EP}{I('(a + b) // 2', 'frame_index')}, {R('v', 'v')} FROM (SELECT *, lag(v) OVER (PARTITION BY episode_index ORDER BY g) pv, lead(v) OVER (PARTITION BY episode_index ORDER BY g) nv FROM pl) WHERE pv > v AND nv > v""")
def _(spark, sf):
    return series.local_minima(frames(spark, sf).select(*EP, "frame_index", F.col("action")[5].alias("v")), "v")


def resample_sql(cols, bins, src="fr", name="rs", where="true"):
    vals = ", ".join(f"CASE WHEN b*(n-1) = f*{bins - 1} THEN {c} ELSE {c} + (n_{c} - {c}) * ((b*(n-1) - f*{bins - 1}) / {bins - 1}e0) END {c}" for c in cols)
    lead = ", ".join(f"lead({c}) OVER {W} n_{c}" for c in cols)
    return (f"{name} AS MATERIALIZED (SELECT {EPC}, n, b, {vals} FROM (SELECT s.*, b, frame_index f FROM (SELECT {EPC}, n, frame_index, {', '.join(cols)}, {lead} FROM {src} WHERE {where}) s "
            f"JOIN (SELECT episode_index e2, b, least(n - 1, CAST(floor(b * (n - 1) / {bins - 1}e0 + 1e-9) AS BIGINT)) f2 FROM (SELECT DISTINCT episode_index, n FROM {src} WHERE {where}), range({bins}) r(b)) ON episode_index = e2 AND frame_index = f2))")


@query("resample", f"WITH {FRAMES}, {resample_sql(['a0', 'a1', 'a6'], 100)} SELECT {SQL_EP}{I('b', 'bin')}, {R('a0', 'a0')}, {R('a1', 'a1')}, {R('a6', 'a6')} FROM rs")
def _(spark, sf):
    return series.resample(frames(spark, sf), 100).select(*EP, "bin", *[F.col("action")[i].alias(f"a{i}") for i in (0, 1, 6)])


@query("normalise", f"""WITH {FRAMES}, b AS (SELECT dataset_id, task_index, min(a0) lo, max(a0) hi FROM fr GROUP BY ALL)
SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('(a0 - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1e0 END', 'batch')} FROM fr JOIN b USING (dataset_id, task_index)""")
def _(spark, sf):
    f = frames(spark, sf).select(*EP, "frame_index", F.col("action")[0].alias("a0"))
    return series.normalise(f, TASK, "a0", "batch").drop("a0")


@query("rolling_baseline", f"""WITH {SERIES}, c AS (SELECT *, speed - lag(speed) OVER {W} ch FROM se) SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('ch', 'change')}, {R('bl', 'baseline')}
FROM (SELECT *, avg(abs(ch)) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) bl FROM c) WHERE ch IS NOT NULL""")
def _(spark, sf):
    return series.rolling_baseline(frames(spark, sf))


@query("post_mean", f"""WITH {SERIES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('accel', 'accel')}, {R('p', 'post')}
FROM (SELECT *, avg(accel) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) p FROM se) WHERE accel IS NOT NULL""")
def _(spark, sf):
    return series.post_mean(frames(spark, sf))


AUTO = f"""ac AS (SELECT {EPC}, n, {", ".join(f"coalesce(sum(x{k}), 0) r{k}" for k in range(10))} FROM (SELECT {EPC}, n, {", ".join(f"speed3 * lead(speed3, {k}) OVER w x{k}" for k in range(10))} FROM se WINDOW w AS {W}) GROUP BY ALL)"""
AUTO_V = "CASE WHEN r0 > 1e-10 THEN greatest(0, least(1, (" + " + ".join(f"r{k}" for k in range(10)) + ") / r0 / least(10, n - 1))) ELSE 0.5 END"


@query("autocorr_decay", f"WITH {SERIES}, {AUTO} SELECT {SQL_EP}{R(AUTO_V, 'decay')} FROM ac")
def _(spark, sf):
    return series.autocorr_decay(frames(spark, sf)).drop("n_frames")


LAGS = range(-5, 6)


@query("cross_corr", f"""WITH {FRAMES}, st AS (SELECT episode_index, avg(a0) mx, stddev_pop(a0) sx, avg(a3) my, stddev_pop(a3) sy FROM fr GROUP BY 1),
z AS (SELECT fr.*, (a0 - mx) / CASE WHEN sx > 1e-10 THEN sx ELSE 1 END zx, (a3 - my) / CASE WHEN sy > 1e-10 THEN sy ELSE 1 END zy FROM fr JOIN st USING (episode_index)),
p AS (SELECT {EPC}, n, {", ".join(f"{'lead' if k >= 0 else 'lag'}(zx, {abs(k)}) OVER w * zy c{k + 5}" for k in LAGS)} FROM z WINDOW w AS {W}),
g AS (SELECT {EPC}, n, {", ".join(f"sum(c{k + 5}) / n g{k + 5}" for k in LAGS)} FROM p GROUP BY {EPC}, n),
s AS (SELECT {EPC}, n, unnest([{", ".join(f"g{k + 5}" for k in LAGS)}]) v, unnest([{", ".join(map(str, LAGS))}]) lag FROM g)
SELECT {SQL_EP}{I('n', 'n')}, {R('v', 'peak')}, {I('lag', 'lag')}, 5 AS lag_range FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY v DESC, lag) r FROM s) WHERE r = 1""".replace("5 AS lag_range", "CAST(5 AS BIGINT) AS lag_range"))
def _(spark, sf):
    f = frames(spark, sf).select(*EP, "frame_index", F.col("action")[0].alias("x"), F.col("action")[3].alias("y"))
    return series.cross_corr(f)


@query("cumulative_offset", f"""WITH {EPISODES} SELECT dataset_id, {I('episode_index', 'episode_index')}, {I('coalesce(st, 0)', 'frame_start')}, {I('coalesce(st, 0) + n_frames', 'frame_end')} FROM (
SELECT *, sum(n_frames) OVER (PARTITION BY dataset_id, episode_index // 50 ORDER BY episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) st FROM ep)""")
def _(spark, sf):
    e = lengths(spark, sf).select("dataset_id", "episode_index", F.col("n_frames").alias("length"))
    return series.cumulative_offset(e, 50).select("dataset_id", "episode_index", "frame_start", "frame_end")


@query("task_local_index", f"WITH {EPISODES} SELECT {SQL_EP}{I('row_number() OVER (PARTITION BY dataset_id, task_index ORDER BY episode_index) - 1', 'task_local_index')} FROM ep")
def _(spark, sf):
    return series.task_local_index(lengths(spark, sf).select(*EP))


@query("argmax", f"WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('s2', 'z')} FROM (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY s2 DESC, frame_index) r FROM fr) WHERE r = 1")
def _(spark, sf):
    return series.argmax(frames(spark, sf).select(*EP, "frame_index", F.col("state")[2].alias("z")), EP, "z")


@query("first_true", f"WITH {FRAMES} SELECT {SQL_EP}{I('min(frame_index) FILTER (WHERE a6 > 0)', 'first_frame')} FROM fr GROUP BY ALL")
def _(spark, sf):
    return series.first_true(frames(spark, sf), EP, F.col("action")[6] > 0)


@query("greedy_min_gap", f"WITH {SERIES} SELECT {SQL_EP}{I('frame_index', 'frame_index')} FROM {greedy('(SELECT * FROM se WHERE a0 > 0.3e0)', 4)}")
def _(spark, sf):
    return greedy_min_gap(frames(spark, sf).filter(F.col("action")[0] > 0.3), 4)


# ---------------------------------------------------------------- events

ONE = lambda x: f"printf('%.1f', {x})"
WHOLE = lambda x: f"printf('%.0f', {x})"
GRIP_SQL = f"(SELECT *, lag(a6) OVER {W} p FROM fr)"
GRIPPER = ev_sql(FRAMES, "frame_index", "gripper", "'significant'", "1", "CASE WHEN a6 < 0 THEN 'Gripper closed (grasping)' ELSE 'Gripper opened (releasing)' END", "p * a6 < 0", GRIP_SQL)


@query("gripper_events", GRIPPER)
def _(spark, sf):
    return events.gripper_events(frames(spark, sf)).select(*EVENT_COLS)


PAUSE_CTE = SERIES + f""",
pz AS MATERIALIZED (SELECT {EPC}, min(frame_index) s, count(*) len, avg(speed) v, max(frame_index) l, any_value(speed_mean) m, any_value(n) n FROM (
SELECT *, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) g FROM pr WHERE speed < speed_p20 * 0.5e0) GROUP BY {EPC}, g)"""
PAUSE = ev_sql(PAUSE_CTE, "s", "pause", "CASE WHEN len < 5 THEN 'info' ELSE 'significant' END", "greatest(0, least(1, 1 - v / m))", "'Motion pause (' || len || ' frames)'", "len >= 2 AND l < n - 1 AND n >= 5 AND m >= 1e-6", "pz")


@query("pause_events", PAUSE)
def _(spark, sf):
    return events.pause_events(frames(spark, sf), ready=ready(spark, sf)).select(*EVENT_COLS)


def turn_cte():
    z = lambda x: f"coalesce({x}, 0)"
    cur = [f"({z(f'l1_{i}')}*0.25e0 + v{i}*0.5e0) + {z(f'n1_{i}')}*0.25e0 cu{i}" for i in range(6)]
    prev = [f"({z(f'l2_{i}')}*0.25e0 + l1_{i}*0.5e0) + v{i}*0.25e0 pv{i}" for i in range(6)]
    lags = ", ".join(f"lag(v{i}, 1) OVER w l1_{i}, lag(v{i}, 2) OVER w l2_{i}, lead(v{i}) OVER w n1_{i}" for i in range(6))
    norm = lambda p: "sqrt(" + " + ".join(f"{p}{i}*{p}{i}" for i in range(6)) + ")"
    dot = " + ".join(f"pv{i}*cu{i}" for i in range(6))
    return SERIES + f""",
t1 AS (SELECT {EPC}, n, frame_index, {", ".join(cur + prev)} FROM (SELECT *, {lags} FROM d1 WINDOW w AS {W})),
t2 AS (SELECT {EPC}, n, frame_index, {dot} d, {norm('pv')} np, {norm('cu')} nc FROM t1 WHERE frame_index >= 2 AND frame_index <= n - 2 AND n >= 5),
tu AS MATERIALIZED (SELECT *, d / (np * nc + 1e-8) co, degrees(acos(greatest(-1e0, least(1e0, d / (np * nc + 1e-8))))) an FROM t2 WHERE np > 0.01e0 AND nc > 0.01e0)"""


TURN = turn_cte()
TURN_TEXT = f"CASE WHEN an > 120 THEN 'Sharp direction reversal (' WHEN an > 90 THEN 'Direction reversal (' ELSE 'Direction change (' END || {WHOLE('an')} || 'deg)'"
TURN_SEV = "CASE WHEN an > 120 THEN 'significant' WHEN an > 90 THEN 'warning' ELSE 'info' END"
TURNS = ev_sql(TURN, "frame_index", "direction_change", TURN_SEV, "an / 180", TURN_TEXT, "co < cos(radians(60e0))", "tu")


@query("direction_changes", TURNS)
def _(spark, sf):
    return events.direction_changes(frames(spark, sf)).select(*EVENT_COLS)


@query("correction_events", ev_sql(TURN, "frame_index", "correction", TURN_SEV, "an / 180", f"replace({TURN_TEXT}, 'Direction', 'Correction')", "co < cos(radians(90e0)) AND an > 90", "tu"))
def _(spark, sf):
    return events.correction_events(frames(spark, sf)).select(*EVENT_COLS)


SPEED_CTE = SERIES + f""",
sc AS (SELECT *, speed - lag(speed) OVER {W} ch FROM se),
sb AS (SELECT *, avg(abs(ch)) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) bl, avg(abs(ch)) OVER (PARTITION BY episode_index) al FROM sc),
sr AS (SELECT *, abs(ch) / CASE WHEN bl < 1e-6 THEN al + 1e-6 ELSE bl END r FROM sb WHERE n >= 5 AND frame_index >= 5 AND frame_index < n - 3)"""


@query("speed_changes", ev_sql(SPEED_CTE, "frame_index", "speed_change", "CASE WHEN r > 4 THEN 'significant' WHEN r > 3 THEN 'warning' ELSE 'info' END", "least(1, r / 5)",
                               f"CASE WHEN ch > 0 THEN 'Sudden acceleration (' ELSE 'Sudden deceleration (' END || {ONE('r')} || 'x)'", "r > 2", "sr"))
def _(spark, sf):
    return events.speed_changes(frames(spark, sf)).select(*EVENT_COLS)


JC = "(SELECT * FROM pr WHERE n >= 6 AND jerk_mean >= 1e-8 AND jerk > jerk_p95)"
JERK = ev_sql(SERIES, "frame_index", "high_jerk", "CASE WHEN jerk / jerk_mean > 3 THEN 'warning' ELSE 'info' END", "least(1, jerk / jerk_mean / 5)",
              f"'Jerky motion (' || {ONE('jerk / jerk_mean')} || 'x avg)'", "true", f"pr JOIN {greedy(JC, 3)} k USING ({EPC}, frame_index)")


@query("high_jerk", JERK)
def _(spark, sf):
    return events.high_jerk(frames(spark, sf), ready=ready(spark, sf)).select(*EVENT_COLS)


POST = f"(SELECT *, avg(accel) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) po FROM pr)"


def recovery_sql(share):
    rc = f"(SELECT * FROM {POST} WHERE n >= 10 AND accel_mean >= 1e-8 AND frame_index < n - 5 AND accel > accel_p90 AND po < accel_p90 * {share})"
    return ev_sql(SERIES, "frame_index", "recovery", "CASE WHEN accel / accel_mean > 3 THEN 'significant' ELSE 'warning' END", "least(1, accel / accel_mean / 5)",
                  f"'Recovery behavior (' || {ONE('accel / accel_mean')} || 'x avg acceleration)'", "true", f"pr JOIN {greedy(rc, 5)} k USING ({EPC}, frame_index)")


RECOVERY = recovery_sql("0.3e0")


@query("recovery_events", RECOVERY)
def _(spark, sf):
    return events.recovery_events(frames(spark, sf), ready=ready(spark, sf)).select(*EVENT_COLS)


@query("recovery_events_wide", recovery_sql("0.7e0"))
def _(spark, sf):
    return events.recovery_events(frames(spark, sf), share=0.7, ready=ready(spark, sf)).select(*EVENT_COLS)


def near_sql(limit):
    nc = f"(SELECT * FROM (SELECT *, (a6 - lag(a6, 2) OVER w) * (lead(a6, 2) OVER w - a6) t FROM fr WINDOW w AS {W}) WHERE n >= 10 AND t < {limit} AND frame_index >= 2 AND frame_index < n - 3)"
    return ev_sql(FRAMES, "frame_index", "near_miss", "'warning'", "0.8", "'Gripper correction (potential slip recovery)'", "true", greedy(nc, 5))


@query("near_miss_events", near_sql("-0.1e0"))
def _(spark, sf):
    return events.near_miss_events(frames(spark, sf)).select(*EVENT_COLS)


@query("slip_events", near_sql("-0.1e0").replace("(a6 - lag(a6, 2) OVER w) * (lead(a6, 2) OVER w - a6)", "(a0 - lag(a0, 2) OVER w) * (lead(a0, 2) OVER w - a0)").replace("'near_miss'", "'near_miss'"))
def _(spark, sf):
    f = frames(spark, sf).withColumn("action", F.array(F.lit(0.0), F.col("action")[0]))
    return events.near_miss_events(f).select(*EVENT_COLS)


def strip_with(sql, cte):
    return sql[len("WITH " + cte):]


ALL_CTE = TURN + PAUSE_CTE[len(SERIES):]
PARTS = [(strip_with(GRIPPER, FRAMES), 1), (strip_with(PAUSE, PAUSE_CTE), 2), (strip_with(TURNS, TURN), 3), (strip_with(JERK, SERIES), 4), (strip_with(RECOVERY, SERIES), 5), (strip_with(near_sql("-0.1e0"), FRAMES), 6)]
ALL_CTE += ", ae AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT *, {o} o FROM ({s})" for s, o in PARTS) + "), an AS MATERIALIZED (SELECT * FROM " + greedy("ae", 3, frame="frame") + \
    """ g), aj AS (SELECT ae.*, an.frame anchor FROM ae JOIN an ON ae.episode_index = an.episode_index AND ae.frame BETWEEN an.frame AND an.frame + 2),
al AS MATERIALIZED (SELECT * EXCLUDE (r, anchor, o) FROM (SELECT *, row_number() OVER (PARTITION BY episode_index, anchor ORDER BY CASE severity WHEN 'significant' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END DESC, score DESC, frame, o) r FROM aj) WHERE r = 1)"""


@query("all_events", f"WITH {ALL_CTE} SELECT * FROM al")
def _(spark, sf):
    return found_events(spark, sf).select(*EVENT_COLS)


@query("gripper_steps", f"WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame')}, CASE WHEN a6 > p THEN 'close' ELSE 'open' END AS step FROM {GRIP_SQL} WHERE abs(a6 - p) > 0.3")
def _(spark, sf):
    return events.gripper_steps(frames(spark, sf))


@query("action_jumps", f"WITH {SERIES} SELECT {SQL_EP}{I('frame_index', 'frame')}, {R('delta', 'delta')} FROM pr WHERE delta > delta_p95 * 2 AND n >= 3")
def _(spark, sf):
    return events.action_jumps(frames(spark, sf), ready=ready(spark, sf))


@query("event_tags", f"""WITH {ALL_CTE} SELECT event_type, CASE event_type WHEN 'gripper' THEN 'recovery_behavior_score,transition_diversity' WHEN 'pause' THEN 'recovery_behavior_score' WHEN 'direction_change' THEN 'transition_diversity,recovery_behavior_score'
WHEN 'high_jerk' THEN 'motion_smoothness' WHEN 'recovery' THEN 'recovery_behavior_score,transition_diversity' ELSE 'near_miss_ratio,recovery_behavior_score' END AS metrics, 'transition' AS metric_category, count(*) AS events FROM al GROUP BY ALL""")
def _(spark, sf):
    t = events.event_tags(found_events(spark, sf)).withColumn("metrics", F.concat_ws(",", "affected_metrics"))
    return t.groupBy("event_type", "metrics", "metric_category").agg(F.count(F.lit(1)).alias("events"))


# ---------------------------------------------------------------- scores

Q = lambda i: f"CASE WHEN q{i} < 1e-8 THEN 1e0 ELSE q{i} END"
SMOOTH_PARTS = f"""sdv AS MATERIALIZED (SELECT episode_index, {", ".join(f"stddev_pop(a{i}) q{i}" for i in DIMS)} FROM fr GROUP BY 1),
vl AS MATERIALIZED (SELECT episode_index, n - 1 m, frame_index - 1 t, unnest([0,1,2,3,4,5,6]) dim, unnest([{", ".join(f"v{i} / ({Q(i)})" for i in DIMS)}]) v FROM d1 JOIN sdv USING (episode_index) WHERE frame_index > 0),
ft AS (SELECT episode_index, m, dim, k, power(sum(v * cos(2 * pi() * ((k * t) % m) / m)), 2) + power(sum(v * sin(2 * pi() * ((k * t) % m) / m)), 2) p FROM vl, range(60) r(k) WHERE k <= m // 2 GROUP BY ALL),
spc AS MATERIALIZED (SELECT episode_index, CASE WHEN sum(p) > 1e-10 THEN sum(p) FILTER (WHERE k < (m // 2 + 1) // 2) / sum(p) ELSE 0.5e0 END spectral FROM ft GROUP BY 1),
jn AS (SELECT episode_index, avg(sqrt({" + ".join(f"power(j{i} / ({Q(i)}), 2)" for i in DIMS)})) jn FROM d3 JOIN sdv USING (episode_index) GROUP BY 1),
rv AS (SELECT episode_index, avg(x) sh FROM (SELECT episode_index, frame_index, ({" + ".join(f"CASE WHEN sign(c{i}) <> sign(lag(c{i}) OVER w) THEN 1 ELSE 0 END" for i in DIMS)}) / 7e0 x FROM d2 WINDOW w AS {W}) WHERE frame_index >= 3 GROUP BY 1),
smo AS MATERIALIZED (SELECT {EPC}, greatest(0, least(1, 0.4e0 * greatest(0, least(1, 1 - jn / 0.5e0)) + 0.3e0 * (1 - sh) + 0.3e0 * spectral)) motion_smoothness FROM (SELECT DISTINCT {EPC} FROM fr) JOIN spc USING (episode_index) JOIN jn USING (episode_index) JOIN rv USING (episode_index))"""

@query("spectral_low_share", f"WITH {SERIES}, {SMOOTH_PARTS} SELECT {SQL_EP}{R('spectral', 'spectral')} FROM (SELECT DISTINCT {EPC} FROM fr) JOIN spc USING (episode_index)")
def _(spark, sf):
    return series.spectral_low_share(frames(spark, sf))


@query("motion_smoothness", f"WITH {SERIES}, {SMOOTH_PARTS} SELECT {SQL_EP}{R('motion_smoothness', 'motion_smoothness')} FROM smo")
def _(spark, sf):
    return scores.motion_smoothness(frames(spark, sf))


@query("frame_rate_consistency", f"""WITH {FRAMES}, t AS (SELECT {EPC}, avg(d) m, stddev_pop(d) s FROM (SELECT *, ts - lag(ts) OVER {W} d FROM fr) GROUP BY ALL)
SELECT {SQL_EP}{R('greatest(0, least(1, 1 - s / m - abs(m - 2e4) / 2e4 * 0.5))', 'frame_rate_consistency')} FROM t""")
def _(spark, sf):
    return scores.frame_rate_consistency(frames(spark, sf), expected_fps=1 / 20000.0)


VABS = lambda ids, t: "CASE WHEN greatest(" + ", ".join(f"abs(v{i})" for i in ids) + f") > {t} THEN 1 ELSE 0 END"


@query("action_consistency", f"""WITH {SERIES}, t AS (SELECT {EPC}, avg({VABS(range(3), 0.2)}) p, avg({VABS(range(3, 6), 1.0)}) r, avg(least(abs(v6), 0.5) / 0.5) g FROM d1 WHERE frame_index >= 1 GROUP BY ALL)
SELECT {SQL_EP}{R('greatest(0, least(1, 0.4*(1-p) + 0.3*(1-r) + 0.3*(1-g*0.5)))', 'action_consistency')} FROM t""")
def _(spark, sf):
    return scores.action_consistency(frames(spark, sf))


@query("action_consistency_short", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 f FROM lineitem),
v AS (SELECT l_orderkey k, greatest(abs(l_quantity/50e0 - lag(l_quantity/50e0) OVER w), abs(l_extendedprice/100000e0 - lag(l_extendedprice/100000e0) OVER w), abs(l_discount - lag(l_discount) OVER w), abs(l_tax - lag(l_tax) OVER w)) m, f FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY f))
SELECT 'orders' AS dataset_id, k % 5 AS task_index, k AS episode_index, round(CASE WHEN count(*) < 2 THEN 0.5 ELSE 1 - avg(CASE WHEN f = 0 THEN NULL WHEN m > 0.5 THEN 1e0 ELSE 0e0 END) END, 6) + 0e0 AS action_consistency FROM v GROUP BY k""")
def _(spark, sf):
    return scores.action_consistency(order_frames(spark, sf))


@query("sync_score", f"WITH {SERIES}, {AUTO} SELECT {SQL_EP}{R(AUTO_V, 'sync_score')} FROM ac")
def _(spark, sf):
    return scores.sync_score(frames(spark, sf))


@query("trajectory_completeness", f"""WITH {SERIES}, t AS (SELECT {EPC}, any_value(n) n, avg(({" + ".join(f"abs(v{i})" for i in DIMS)}) / 7) FILTER (WHERE frame_index >= n - 4) v FROM d1 GROUP BY ALL)
SELECT {SQL_EP}{R('0.6 * least(1, n / 10e0) + 0.4 * greatest(0, least(1, 1 - v * 5))', 'trajectory_completeness')} FROM t""")
def _(spark, sf):
    return scores.trajectory_completeness(frames(spark, sf))


TEMPORAL_PARTS = SMOOTH_PARTS + f""", {AUTO},
con AS (SELECT {EPC}, greatest(0, least(1, 0.4e0*(1-p) + 0.3e0*(1-r) + 0.3e0*(1-g*0.5e0))) action_consistency FROM (SELECT {EPC}, avg({VABS(range(3), 0.2)}) p, avg({VABS(range(3, 6), 1.0)}) r, avg(least(abs(v6), 0.5e0) / 0.5e0) g FROM d1 WHERE frame_index >= 1 GROUP BY ALL)),
com AS (SELECT episode_index, 0.6e0 * least(1, n / 10e0) + 0.4e0 * greatest(0, least(1, 1 - v * 5)) trajectory_completeness FROM (SELECT episode_index, any_value(n) n, avg(({" + ".join(f"abs(v{i})" for i in DIMS)}) / 7) FILTER (WHERE frame_index >= n - 4) v FROM d1 GROUP BY 1)),
frc AS (SELECT episode_index, greatest(0, least(1, 1 - s / m - abs(m - 1/30e0) * 30e0 * 0.5e0)) rate FROM (SELECT episode_index, avg(d) m, stddev_pop(d) s FROM (SELECT episode_index, ts - lag(ts) OVER {W} d FROM fr) GROUP BY 1)),
tem AS MATERIALIZED (SELECT *, rate frame_rate_timed, 0.30e0 * motion_smoothness + 0.20e0 * action_consistency + 0.15e0 * trajectory_completeness + 0.25e0 * sync_score rest FROM smo JOIN con USING ({EPC}) JOIN com USING (episode_index) JOIN frc USING (episode_index) JOIN (SELECT episode_index, {AUTO_V} sync_score FROM ac) USING (episode_index))"""
TEMPORAL_COLS = ", ".join(R(c, c) for c in ("motion_smoothness", "action_consistency", "trajectory_completeness", "sync_score"))


@query("temporal_score", f"WITH {SERIES}, {TEMPORAL_PARTS} SELECT {SQL_EP}{TEMPORAL_COLS}, {R('rate', 'frame_rate_consistency')}, {R('rest + 0.10e0 * rate', 'overall_temporal_score')} FROM tem")
def _(spark, sf):
    return scores.temporal_score(frames(spark, sf))


EDGES = [i * (2.0 / 9) - 1.0 for i in range(9)] + [1.0]
DIG = lambda x: "(" + " + ".join(f"CASE WHEN {x} >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in EDGES) + ")"
PATTERN = " || ',' || ".join(DIG(f"v{i}") for i in DIMS)
PAT_CTE = SERIES + f", pt AS (SELECT {EPC}, any_value(n) n, count(DISTINCT CASE WHEN frame_index > 0 THEN {PATTERN} END) p FROM d1 GROUP BY ALL)"


@query("distinct_patterns", f"WITH {PAT_CTE} SELECT {SQL_EP}{I('n', 'n_frames')}, {I('p', 'patterns')}, {I('n - 1', 'steps')} FROM pt")
def _(spark, sf):
    return scores.distinct_patterns(frames(spark, sf))


@query("transition_diversity", f"WITH {PAT_CTE} SELECT {SQL_EP}{R('least(1, p / ((n - 1) * 0.3e0))', 'transition_diversity')} FROM pt")
def _(spark, sf):
    return scores.transition_diversity(frames(spark, sf))


REC_CTE = ALL_CTE + f""", rs AS MATERIALIZED (SELECT {EPC}, n, t, CASE WHEN t IS NULL THEN 0.2e0 ELSE least(1e0, CASE WHEN t / (n/30e0) < 0.2 THEN 0.3e0 + 0.3e0 * (t / (n/30e0) / 0.2e0) WHEN t / (n/30e0) < 3 THEN 0.6e0 + 0.4e0 * least(1e0, t / (n/30e0) / 2e0)
ELSE greatest(0.5e0, 1e0 - (t / (n/30e0) - 3e0) * 0.1e0) END + least(0.2e0, st * 0.05e0)) END v FROM (SELECT {EPC}, n, t, st FROM (SELECT {EPC}, count(*) n FROM fr GROUP BY ALL) LEFT JOIN (SELECT {EPC}, count(*) t, count(*) FILTER (WHERE severity IN ('significant', 'warning')) st FROM al GROUP BY ALL) USING ({EPC})))"""


@query("recovery_score", f"WITH {REC_CTE} SELECT {SQL_EP}{R('v', 'recovery_behavior_score')} FROM rs")
def _(spark, sf):
    return scores.recovery_score(frames(spark, sf), found_events(spark, sf))


@query("near_miss_ratio", f"""WITH {SERIES}, t AS (SELECT *, avg(accel_all) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) po FROM pr),
c AS (SELECT {EPC}, any_value(n) n, count(*) FILTER (WHERE accel_all > accel_all_p90) h, count(*) FILTER (WHERE accel_all > accel_all_p90 AND frame_index < n - 5 AND po < accel_all_p90 * 0.3e0) m FROM t GROUP BY ALL)
SELECT {SQL_EP}{R('CASE WHEN n < 10 OR h = 0 THEN 0 ELSE m / h END', 'near_miss_ratio')} FROM c""")
def _(spark, sf):
    return scores.near_miss_ratio(frames(spark, sf), ready(spark, sf))


COVER = "greatest(0, least(1, exp((" + " + ".join(f"ln(greatest(0, least(1, (max(a{i}) - min(a{i})) / 2e0)) + 0.01e0)" for i in DIMS) + ") / 7)))"


@query("action_space_coverage", f"WITH {FRAMES} SELECT {SQL_EP}{R(COVER, 'action_space_coverage')} FROM fr GROUP BY ALL")
def _(spark, sf):
    return scores.action_space_coverage(frames(spark, sf))


@query("starting_state_diversity", f"""WITH {FRAMES}, s AS (SELECT * FROM fr WHERE frame_index = 0)
SELECT a.dataset_id, a.task_index, {I('(SELECT count(*) FROM s x WHERE x.task_index = a.task_index)', 'n')}, {R('greatest(0, least(1, avg(sqrt(' + ' + '.join(f'(a.a{i}-b.a{i})*(a.a{i}-b.a{i})' for i in DIMS) + ')) / 0.5))', 'starting_state_diversity')}
FROM s a JOIN s b ON a.task_index = b.task_index AND a.episode_index < b.episode_index GROUP BY 1, 2, a.task_index""".replace("GROUP BY 1, 2, a.task_index", "GROUP BY a.dataset_id, a.task_index"))
def _(spark, sf):
    return scores.starting_state_diversity(frames(spark, sf))


@query("embedding_distance", f"""WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) v FROM embeddings)
SELECT CAST(a.label AS BIGINT) AS label, CAST((SELECT count(*) FROM e x WHERE x.label = a.label) AS BIGINT) AS n, round(avg(list_distance(a.v, b.v)), 6) + 0e0 AS mean_distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return scores.starting_distance(e, ["label"], block=32)


DIVERSITY_PARTS = f"""pt AS (SELECT episode_index, least(1, count(DISTINCT CASE WHEN frame_index > 0 THEN {PATTERN} END) / ((any_value(n) - 1) * 0.3e0)) transition_diversity FROM d1 GROUP BY 1),
nm1 AS (SELECT *, avg(accel_all) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) po FROM pr),
nm2 AS (SELECT episode_index, CASE WHEN count(*) FILTER (WHERE accel_all > accel_all_p90) = 0 THEN 0e0 ELSE count(*) FILTER (WHERE accel_all > accel_all_p90 AND frame_index < n - 5 AND po < accel_all_p90 * 0.3e0) / count(*) FILTER (WHERE accel_all > accel_all_p90) END near_miss_ratio FROM nm1 GROUP BY 1),
cvr AS (SELECT episode_index, {COVER} action_space_coverage FROM fr GROUP BY 1),
dvs AS MATERIALIZED (SELECT {EPC}, transition_diversity, v recovery_behavior_score, near_miss_ratio, action_space_coverage, 0.5e0 starting_state_diversity, 0.20e0 * transition_diversity + 0.35e0 * v + 0.20e0 * near_miss_ratio + 0.15e0 * action_space_coverage + 0.05e0 overall_diversity_score
  FROM rs JOIN pt USING (episode_index) JOIN nm2 USING (episode_index) JOIN cvr USING (episode_index))"""
DIVERSITY_COLS = ", ".join(R(c, c) for c in ("transition_diversity", "recovery_behavior_score", "near_miss_ratio", "action_space_coverage", "starting_state_diversity", "overall_diversity_score"))


@query("diversity_score", f"WITH {REC_CTE}, {DIVERSITY_PARTS} SELECT {SQL_EP}{DIVERSITY_COLS} FROM dvs")
def _(spark, sf):
    return scores.diversity_score(frames(spark, sf))


@query("transition_metrics", f"""WITH {ALL_CTE}, c AS (SELECT {EPC}, count(*) FILTER (WHERE k = 'r') r, count(*) FILTER (WHERE k = 'm') m, count(*) FILTER (WHERE k = 'c') c FROM (
SELECT {EPC}, 'r' k FROM ae WHERE event_type = 'recovery' UNION ALL SELECT {EPC}, 'm' k FROM ae WHERE event_type = 'near_miss' UNION ALL SELECT {EPC}, 'c' k FROM tu WHERE co < cos(radians(90e0)) AND an > 90) GROUP BY ALL),
j AS (SELECT {EPC}, n, coalesce(r, 0) r, coalesce(m, 0) m, coalesce(c, 0) c FROM (SELECT {EPC}, count(*) n FROM fr GROUP BY ALL) LEFT JOIN c USING ({EPC}))
SELECT {SQL_EP}(r > 0 OR m > 0) AS has_recovery, {I('r', 'recovery_count')}, {I('m', 'near_miss_count')}, {I('c', 'correction_count')},
{R('CASE WHEN r > 0 THEN least(1, least(1, 0.3 + (r + m*0.5 + c*0.3) / greatest(1, n/30e0) * 0.35) + 0.2) ELSE least(1, 0.3 + (r + m*0.5 + c*0.3) / greatest(1, n/30e0) * 0.35) END', 'overall_transition_score')} FROM j""")
def _(spark, sf):
    return scores.transition_metrics(frames(spark, sf), ready(spark, sf))


QUALITY_CTE = f"{REC_CTE}, {DIVERSITY_PARTS}, {TEMPORAL_PARTS}" + f""",
q0 AS MATERIALIZED (SELECT tem.*, dvs.* EXCLUDE ({EPC}), 0.8e0 frame_rate_consistency, rest + 0.08e0 overall_temporal_score FROM tem JOIN dvs USING ({EPC})),
q1 AS MATERIALIZED (SELECT *, 0.55e0 * overall_temporal_score + 0.45e0 * overall_diversity_score v FROM q0),
q AS MATERIALIZED (SELECT *, CASE WHEN v >= 0.9 THEN 'A' WHEN v >= 0.8 THEN 'B' WHEN v >= 0.7 THEN 'C' WHEN v >= 0.6 THEN 'D' ELSE 'F' END g FROM q1)"""


@query("quality_score", f"""WITH {QUALITY_CTE} SELECT {SQL_EP}{TEMPORAL_COLS}, {R('frame_rate_consistency', 'frame_rate_consistency')}, {R('overall_temporal_score', 'overall_temporal_score')}, {DIVERSITY_COLS}, {R('v', 'overall_score')}, g AS quality_grade,
recovery_behavior_score > 0.5 AS has_recovery_behaviors, overall_diversity_score > 0.6 AS is_diverse, motion_smoothness > 0.7 AS is_smooth, sync_score > 0.7 AS is_well_synced FROM q""")
def _(spark, sf):
    return quality(spark, sf)


# Roll-up over a score both engines can form: the recovery score.
ROLL_CTE = REC_CTE + f", q AS (SELECT *, CASE WHEN v >= 0.9 THEN 'A' WHEN v >= 0.8 THEN 'B' WHEN v >= 0.7 THEN 'C' WHEN v >= 0.6 THEN 'D' ELSE 'F' END g FROM (SELECT *, v AS x FROM rs))"


def rolled(spark, sf):
    score = lambda: scores.recovery_score(frames(spark, sf), found_events(spark, sf)).withColumnRenamed("recovery_behavior_score", "overall_score")
    r = ingested(spark, sf, "recovery_scores", score)
    flag = lambda t: F.col("overall_score") > t
    return r.select("*", scores.grade("overall_score").alias("quality_grade"), flag(0.5).alias("has_recovery_behaviors"), flag(0.6).alias("is_diverse"), flag(0.7).alias("is_smooth"),
                    flag(0.8).alias("is_well_synced"), F.col("overall_score").alias("overall_temporal_score"), (1 - F.col("overall_score")).alias("overall_diversity_score"))


def stat_sql(rec, div, smooth, sync, temporal, diversity):
    share = lambda e, n: R(f"avg(CASE WHEN {e} THEN 1 ELSE 0 END)", n)
    grades = ", ".join(I(f"count(*) FILTER (WHERE g = '{x}')", f"grade_{x.lower()}") for x in "ABCDF")
    return f"""SELECT dataset_id, {I('count(*)', 'num_episodes')}, {R('avg(v)', 'mean_score')}, {R('stddev_pop(v)', 'std_score')}, {R('min(v)', 'min_score')}, {R('max(v)', 'max_score')}, {grades},
{share(rec, 'pct_with_recovery')}, {share(div, 'pct_diverse')}, {share(smooth, 'pct_smooth')}, {share(sync, 'pct_well_synced')}, {R(f'avg({temporal})', 'avg_temporal')}, {R(f'avg({diversity})', 'avg_diversity')},
{R('quantile_cont(v, 0.1)', 'p10_score')}, {R('quantile_cont(v, 0.9)', 'p90_score')} FROM q GROUP BY dataset_id"""


def compare_sql(cte, stat):
    return f"""WITH {cte}, s AS ({stat}), l AS (SELECT *, avg_diversity * 0.5 + pct_with_recovery * 0.3 + avg_temporal * 0.2 ls FROM s),
b AS (SELECT arg_max(dataset_id, mean_score) best_overall, arg_max(dataset_id, avg_diversity) best_diversity, arg_max(dataset_id, avg_temporal) best_temporal, arg_max(dataset_id, ls) best_learning FROM l)
SELECT *, CASE WHEN best_learning = best_overall THEN best_learning || ' is recommended: best overall quality and learning value.' ELSE best_learning || ' is recommended for learning value (high diversity and recovery behaviors). ' || best_overall || ' has highest overall score.' END AS recommendation FROM b"""


STAT_SQL = stat_sql("v > 0.5", "v > 0.6", "v > 0.7", "v > 0.8", "v", "1 - v")
QUALITY_STAT = stat_sql("recovery_behavior_score > 0.5", "overall_diversity_score > 0.6", "motion_smoothness > 0.7", "sync_score > 0.7", "overall_temporal_score", "overall_diversity_score")


@query("dataset_quality_stats", f"WITH {QUALITY_CTE} {QUALITY_STAT}")
def _(spark, sf):
    return stats.dataset_quality_stats(quality(spark, sf))


@query("compare_datasets", compare_sql(QUALITY_CTE, QUALITY_STAT))
def _(spark, sf):
    return stats.compare_datasets(stats.dataset_quality_stats(quality(spark, sf)))


@query("score_rollup", f"WITH {ROLL_CTE} {STAT_SQL}")
def _(spark, sf):
    return stats.dataset_quality_stats(rolled(spark, sf))


@query("compare_rollup", compare_sql(ROLL_CTE, STAT_SQL))
def _(spark, sf):
    return stats.compare_datasets(stats.dataset_quality_stats(rolled(spark, sf)))


@query("grade", f"WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, CASE WHEN a3 >= 0.9 THEN 'A' WHEN a3 >= 0.8 THEN 'B' WHEN a3 >= 0.7 THEN 'C' WHEN a3 >= 0.6 THEN 'D' ELSE 'F' END AS grade, CASE WHEN a0 < 0.5 THEN 'low' WHEN a0 < 1.5 THEN 'medium' ELSE 'high' END AS category FROM fr")
def _(spark, sf):
    return frames(spark, sf).select(*EP, "frame_index", scores.grade(F.col("action")[3]).alias("grade"), divergence.divergence_category(F.col("action")[0]).alias("category"))


@query("scalar_rules", f"WITH {SERIES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {I(DIG('v0'), 'bucket')}, {R('least(greatest(a0, 0.1), 0.4)', 'clipped')}, {I('CASE WHEN v1 < 0 THEN -1 ELSE 1 END', 'direction')} FROM d1 WHERE frame_index >= 1")
def _(spark, sf):
    d = own(series.derivatives(frames(spark, sf))).filter("vel is not null")
    return d.select(*EP, "frame_index", scores.digitize(F.col("vel")[0]).alias("bucket"), vectors.clip(F.col("action")[0], 0.1, 0.4).alias("clipped"), vectors.sign_plus(F.col("vel")[1]).alias("direction"))


# ---------------------------------------------------------------- divergence

Z_CTE = FRAMES + ", " + resample_sql([f"a{i}" for i in DIMS], 100) + f""",
lg AS MATERIALIZED (SELECT {EPC}, n, b, unnest([0,1,2,3,4,5,6]) dim, unnest([{", ".join(f"a{i}" for i in DIMS)}]) x FROM rs),
ts_ AS MATERIALIZED (SELECT dataset_id, task_index, b, dim, count(*) c, median(x) med, stddev_pop(x) sd, quantile_cont(x, 0.25) p25, quantile_cont(x, 0.75) p75 FROM lg GROUP BY ALL),
zs AS MATERIALIZED (SELECT lg.*, abs(x - med) / greatest(sd, 1e-6) z FROM lg JOIN ts_ USING (dataset_id, task_index, b, dim)),
pb AS MATERIALIZED (SELECT {EPC}, n, b, sqrt(sum(z * z)) / sqrt(7) dv FROM zs GROUP BY ALL)"""


@query("task_trajectory_stats", f"WITH {Z_CTE} SELECT dataset_id, task_index, {I('b', 'bin')}, {I('dim', 'dim')}, {I('c', 'n')}, {R('med', 'med')}, {R('p25', 'p25')}, {R('p75', 'p75')}, {R('sd', 'std')} FROM ts_")
def _(spark, sf):
    return traj_stats(spark, sf).drop("dims")


@query("frame_divergence", f"WITH {Z_CTE} SELECT {SQL_EP}{I('b', 'bin')}, {R('dv', 'divergence')} FROM pb")
def _(spark, sf):
    return per_bin(spark, sf).drop("n_frames")


DIV = f"(SELECT {EPC}, least(1, avg(dv) / 2) v, count(DISTINCT CASE WHEN dv > 2 THEN CAST(floor(b * n / 100e0) AS BIGINT) END) h FROM pb GROUP BY ALL)"


@query("episode_divergence", f"WITH {Z_CTE} SELECT {SQL_EP}{R('v', 'divergence_score')}, {I('h', 'high_frames')} FROM {DIV}")
def _(spark, sf):
    return divergence.episode_divergence(per_bin(spark, sf), lengths(spark, sf))


@query("dimension_means", f"WITH {Z_CTE} SELECT {SQL_EP}{I('dim', 'dim')}, {R('avg(z)', 'mean_z')} FROM zs GROUP BY {EPC}, dim")
def _(spark, sf):
    return divergence.dimension_means(zscores(spark, sf))


OD = f"""od AS MATERIALIZED (SELECT {EPC}, n, i, dv + coalesce(nx - dv, 0) * (p - b) dv FROM (SELECT f.*, i * 99e0 / (n - 1) p, least(99, CAST(floor(i * 99e0 / (n - 1) + 1e-9) AS BIGINT)) fb FROM (SELECT DISTINCT {EPC}, n, frame_index i FROM fr) f) q
JOIN (SELECT episode_index e3, b, dv, lead(dv) OVER (PARTITION BY episode_index ORDER BY b) nx FROM pb) ON episode_index = e3 AND fb = b)"""


@query("original_divergence", f"WITH {Z_CTE}, {OD} SELECT {SQL_EP}{I('i', 'frame_index')}, {R('dv', 'divergence')} FROM od")
def _(spark, sf):
    return divergence.original_divergence(per_bin(spark, sf)).drop("n_frames")


HF = f"(SELECT {EPC}, CAST(floor(b * n / 100e0) AS BIGINT) frame_index FROM pb WHERE dv > 1.2)"


@query("divergence_events", f"""WITH {Z_CTE}, {OD}, k AS (SELECT * FROM {greedy(HF, 3)}), t AS (SELECT *, row_number() OVER (PARTITION BY episode_index, b ORDER BY round(z, 9) DESC, dim) r FROM zs)
SELECT k.dataset_id, k.task_index, k.episode_index, {I('k.frame_index', 'frame')}, 'high_divergence' AS event_type, CASE WHEN od.dv > 1.2 * 1.5 THEN 'significant' ELSE 'warning' END AS severity, {R('least(1, od.dv / 2.4)', 'score')},
['X position', 'Y position', 'Z position', 'Roll', 'Pitch', 'Yaw', 'Gripper'][t.dim + 1] || ' ' || {ONE('t.z')} || ' std from median' AS description, ['pos_x', 'pos_y', 'pos_z', 'rot_x', 'rot_y', 'rot_z', 'gripper'][t.dim + 1] AS dominant
FROM k JOIN od ON k.episode_index = od.episode_index AND k.frame_index = od.i JOIN t ON t.episode_index = k.episode_index AND t.r = 1 AND t.b = least(99, CAST(floor(k.frame_index * 100 / od.n) AS BIGINT))""")
def _(spark, sf):
    return divergence.divergence_events(zscores(spark, sf), per_bin(spark, sf), threshold=1.2)


@query("task_quality", f"""WITH {Z_CTE}, {ALL_CTE[len(FRAMES) + 2:]}, dv AS {DIV}, tr AS (SELECT {EPC}, count(*) FILTER (WHERE event_type = 'recovery') rc, count(*) FILTER (WHERE event_type = 'near_miss') nm FROM ae GROUP BY ALL),
j AS (SELECT dv.*, coalesce(rc, 0) rc, coalesce(nm, 0) nm FROM dv LEFT JOIN tr USING ({EPC})),
a AS (SELECT dataset_id, task_index, count(*) ne, avg(v) md, count(*) FILTER (WHERE v < 0.5) lo, count(*) FILTER (WHERE v >= 0.5 AND v < 1.5) me, count(*) FILTER (WHERE v >= 1.5) hi, avg(h) hd,
avg(CASE WHEN rc > 0 OR nm > 0 THEN 1 ELSE 0 END) pr_, avg(rc) mr, avg(nm) mn, bool_or(rc > 0 OR nm > 0) ar FROM j GROUP BY ALL),
tp AS (SELECT dataset_id, task_index, string_agg('episode_' || episode_index, ',' ORDER BY r) t FROM (SELECT *, row_number() OVER (PARTITION BY task_index ORDER BY v DESC, episode_index) r FROM dv) WHERE r <= 3 GROUP BY ALL)
SELECT dataset_id, task_index, {I('ne', 'num_episodes')}, {R('md', 'mean_divergence')}, {I('lo', 'n_low')}, {I('me', 'n_medium')}, {I('hi', 'n_high')}, {R('hd', 'high_divergence_frame_density')}, {R('pr_', 'pct_with_recovery')}, {R('mr', 'mean_recovery_count')}, {R('mn', 'mean_near_miss_count')},
ar AS has_any_recovery_episodes, {R('greatest(0, 1 - md)', 'expertise_score')}, {R('least(1, 0.3 + pr_ * 0.5 + least(0.2, mr * 0.1))', 'physics_coverage_score')},
CASE WHEN 1 - md > 0.7 AND ar THEN 'Excellent - consistent technique with recovery behaviors' WHEN 1 - md > 0.7 THEN 'Good consistency but lacks recovery behaviors' WHEN ar THEN 'Good physics coverage but high action variance' ELSE 'Needs review - high variance and no recovery behaviors' END AS quality_assessment,
t AS most_divergent FROM a JOIN tp USING (dataset_id, task_index)""")
def _(spark, sf):
    d = divergence.episode_divergence(per_bin(spark, sf), lengths(spark, sf))
    return divergence.task_quality(materialise(d), scores.transition_metrics(frames(spark, sf), ready(spark, sf)))


# ---------------------------------------------------------------- signal comparison

ENV_CTE = FRAMES + ", sg AS MATERIALIZED (SELECT *, sqrt(a0*a0+a1*a1+a2*a2) v FROM fr), " + resample_sql(["v"], 200, "sg") + """,
en AS MATERIALIZED (SELECT dataset_id, task_index, b, count(*) c, avg(v) m, stddev_pop(v) s FROM rs GROUP BY ALL HAVING count(*) >= 2),
rr AS MATERIALIZED (SELECT dataset_id, task_index, count(*) c, list_sort(list(v)) l FROM sg GROUP BY ALL)"""


@query("signal_envelope", f"WITH {ENV_CTE} SELECT dataset_id, task_index, {I('b', 'bin')}, {I('c', 'traces')}, {R('m', 'mean')}, {R('s', 'std')}, {R('m + 2*s', 'upper')}, {R('m - 2*s', 'lower')} FROM en")
def _(spark, sf):
    return envelope(spark, sf)


@query("outlier_fraction", f"""WITH {ENV_CTE}, o AS (SELECT {EPC}, avg(CASE WHEN v > m + 2*s OR v < m - 2*s THEN 1e0 ELSE 0e0 END) f, arg_max(b, abs(v - m)) mb FROM rs JOIN en USING (dataset_id, task_index, b) GROUP BY ALL)
SELECT {SQL_EP}{R('f', 'fraction')}, {I('floor(f * 100 + 0.5)', 'pct')}, {I('mb', 'max_deviation_bin')} FROM o WHERE f > 0.05""")
def _(spark, sf):
    return stats.outlier_fraction(envelope_bins(spark, sf), envelope(spark, sf))


RANGE = "l[greatest(0, CAST(floor(c * 0.02e0) AS BIGINT)) + 1]", "l[least(c - 1, CAST(ceil(c * 0.98e0) AS BIGINT) - 1) + 1]"


@query("robust_range", f"WITH {ENV_CTE} SELECT dataset_id, task_index, {I('c', 'n')}, {R(RANGE[0], 'range_min')}, {R(RANGE[1], 'range_max')} FROM rr")
def _(spark, sf):
    return stats.robust_range(signal(spark, sf))


@query("band_coverage", f"""WITH {ENV_CTE}, w AS (SELECT dataset_id, task_index, avg((m + 2*s) - (m - 2*s)) / (any_value({RANGE[1].replace('l[', 'rr.l[').replace('(c ', '(rr.c ').replace('least(c', 'least(rr.c')}) - any_value({RANGE[0].replace('l[', 'rr.l[').replace('(c ', '(rr.c ')})) bc FROM en JOIN rr USING (dataset_id, task_index) GROUP BY ALL)
SELECT dataset_id, task_index, {R('bc', 'band_coverage')}, CASE WHEN bc < 0.25 THEN 'Low Variance' WHEN bc < 0.5 THEN 'Med Variance' ELSE 'High Variance' END AS label FROM w""")
def _(spark, sf):
    return stats.band_coverage(envelope(spark, sf), stats.robust_range(signal(spark, sf)))


@query("hot_zones", f"""WITH {ENV_CTE}, h1 AS (SELECT *, s / max(s) OVER (PARTITION BY task_index) v FROM en), h2 AS (SELECT *, list_sort(list(v) OVER (PARTITION BY task_index))[141] t FROM h1),
h3 AS (SELECT *, CASE WHEN b - lag(b) OVER (PARTITION BY task_index ORDER BY b) < 5 THEN 0 ELSE 1 END nw FROM h2 WHERE v >= t), h4 AS (SELECT *, sum(nw) OVER (PARTITION BY task_index ORDER BY b) g FROM h3)
SELECT dataset_id, task_index, {I('min(b)', 'start')}, {I('max(b)', 'end')}, {R('max(v)', 'peak')} FROM h4 GROUP BY dataset_id, task_index, g HAVING max(b) - min(b) >= 10""")
def _(spark, sf):
    return series.hot_zones(envelope(spark, sf), TASK, 200)


# ---------------------------------------------------------------- listings and sets over episodes

DIST_CTE = EPISODES + """,
ds AS (SELECT dataset_id, task_index, count(*) c, avg(n_frames) m, stddev_pop(n_frames) s, min(n_frames) lo, max(n_frames) hi FROM ep GROUP BY ALL),
mk AS MATERIALIZED (SELECT ep.*, m, s, CASE WHEN s > 0 THEN abs(n_frames - m) / s > 2 ELSE false END o FROM ep JOIN ds USING (dataset_id, task_index))"""


def marked(spark, sf):
    return stats.frame_count_outliers(lengths(spark, sf))


@query("frame_count_outliers", f"WITH {DIST_CTE} SELECT {SQL_EP}{I('n_frames', 'n_frames')}, o AS is_outlier FROM mk")
def _(spark, sf):
    return marked(spark, sf).select(*EP, "n_frames", "is_outlier")


@query("frame_count_distribution", f"""WITH {DIST_CTE} SELECT dataset_id, task_index, {I('c', 'total_episodes')}, round(ds.m, 1) + 0e0 AS mean_frames, round(ds.s, 1) + 0e0 AS std_frames, {I('lo', 'min_frames')}, {I('hi', 'max_frames')}, {I('(SELECT count(*) FROM mk WHERE o AND mk.task_index = ds.task_index)', 'outliers')} FROM ds""")
def _(spark, sf):
    return stats.frame_count_distribution(lengths(spark, sf))


HIST_CTE = DIST_CTE + """,
rg AS (SELECT dataset_id, task_index, coalesce(min(n_frames) FILTER (WHERE NOT o), min(n_frames)) lo, coalesce(max(n_frames) FILTER (WHERE NOT o), max(n_frames)) hi FROM mk GROUP BY ALL),
hb AS (SELECT mk.*, lo, (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) / 30e0 w, greatest(0, least(29, CAST(floor((n_frames - lo) / ((CASE WHEN hi > lo THEN hi - lo ELSE 1 END) / 30e0)) AS BIGINT))) b FROM mk JOIN rg USING (dataset_id, task_index))"""


@query("frame_count_histogram", f"""WITH {HIST_CTE}, al AS (SELECT DISTINCT dataset_id, task_index, lo, w, i FROM hb, range(30) r(i))
SELECT dataset_id, task_index, {I('i', 'bin')}, {I('floor(any_value(al.lo) + i * any_value(al.w) + 0.5)', 'range_start')}, {I('floor(any_value(al.lo) + (i + 1) * any_value(al.w) + 0.5)', 'range_end')}, {I('count(hb.b)', 'count')}, coalesce(bool_or(hb.o), false) AS has_outlier
FROM al LEFT JOIN hb USING (dataset_id, task_index) WHERE true GROUP BY dataset_id, task_index, i""".replace("LEFT JOIN hb USING (dataset_id, task_index) WHERE true", "LEFT JOIN (SELECT dataset_id d2, task_index t2, b, o FROM hb) hb ON dataset_id = d2 AND task_index = t2 AND hb.b = al.i"))
def _(spark, sf):
    return stats.frame_count_histogram(marked(spark, sf))


@query("histogram_bins", f"WITH {HIST_CTE} SELECT {SQL_EP}{I('n_frames', 'n_frames')}, {I('b', 'bin')} FROM hb")
def _(spark, sf):
    return stats.histogram_bins(marked(spark, sf)).select(*EP, "n_frames", "bin")


@query("pct_from_mean", f"""WITH {DIST_CTE} SELECT {SQL_EP}{I('n_frames', 'n_frames')}, {I('floor((n_frames - round(m, 1)) / round(m, 1) * 100 + 0.5)', 'pct_from_mean')} FROM (SELECT *, row_number() OVER (PARTITION BY task_index ORDER BY episode_index) r FROM mk WHERE o) WHERE r <= 10""")
def _(spark, sf):
    return stats.pct_from_mean(marked(spark, sf))


@query("top_divergent", f"WITH {Z_CTE} SELECT {SQL_EP}{R('v', 'divergence_score')}, {I('r', 'rank')} FROM (SELECT *, row_number() OVER (PARTITION BY task_index ORDER BY v DESC, episode_index) r FROM {DIV}) WHERE r <= 3")
def _(spark, sf):
    d = divergence.episode_divergence(per_bin(spark, sf), lengths(spark, sf)).drop("high_frames")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*TASK).orderBy(F.desc("divergence_score"), "episode_index"))).filter("rank <= 3")


@query("tasks_with_counts", f"WITH {EPISODES}, t AS (SELECT DISTINCT dataset_id, task_index FROM ep UNION ALL SELECT 'ds0', 99) SELECT dataset_id, task_index, CASE WHEN task_index = 99 THEN 'Untitled (task 99)' ELSE 'task ' || task_index END AS task_name, {I('(SELECT count(*) FROM ep e WHERE e.task_index = t.task_index)', 'c')} FROM t".replace(f"{I('(SELECT count(*) FROM ep e WHERE e.task_index = t.task_index)', 'c')}", "CASE WHEN task_index <> 99 THEN CAST((SELECT count(*) FROM ep e WHERE e.task_index = t.task_index) AS BIGINT) END AS episode_count"))
def _(spark, sf):
    f = frames(spark, sf)
    t = task_table(f)
    extra = lengths(spark, sf).groupBy().agg(F.lit("ds0").alias("dataset_id"), F.lit(99).cast("long").alias("task_index"), F.lit(" ").alias("task_description"))
    return relations.tasks_with_counts(t.unionByName(extra.select(*t.columns)), lengths(spark, sf))


@query("meta_summary", f"WITH {EPISODES} SELECT dataset_id, task_index, 'task ' || task_index AS task_name, {I('count(*)', 'episode_count')} FROM ep GROUP BY ALL ORDER BY 1, 2")
def _(spark, sf):
    return relations.tasks_with_counts(task_table(frames(spark, sf)), lengths(spark, sf)).orderBy(*TASK)


@query("task_counts", f"WITH {EPISODES} SELECT coalesce(CASE WHEN task_index <> 4 THEN 'task ' || task_index END, 'Unknown') AS task_name, {I('count(*)', 'episode_count')} FROM ep GROUP BY 1")
def _(spark, sf):
    e = lengths(spark, sf).withColumn("task_name", F.when(F.col("task_index") != 4, F.concat(F.lit("task "), F.col("task_index").cast("string"))))
    return stats.task_counts(e)


@query("episode_task_map", f"WITH {FRAMES} SELECT dataset_id, {I('episode_index', 'episode_index')}, {I('CASE WHEN n > 66 THEN task_index + 100 ELSE task_index END', 'task_index')} FROM fr WHERE frame_index = 0")
def _(spark, sf):
    meta = lengths(spark, sf).filter("n_frames > 66").select("dataset_id", "episode_index", (F.col("task_index") + 100).alias("task_index"))
    return relations.episode_task_map(meta, frames(spark, sf))


@query("episodes_of_tasks", f"WITH {EPISODES} SELECT {SQL_EP}{I('n_frames', 'n_frames')} FROM ep WHERE task_index IN (1, 3)")
def _(spark, sf):
    t = task_table(frames(spark, sf)).filter(F.col("task_description").isin("task 1", "task 3"))
    return relations.episodes_of_tasks(lengths(spark, sf), t)


@query("ordered_lookup", f"WITH {EPISODES}, q AS (SELECT vec_id pos, vec_id * 3 % 400 episode_index FROM embeddings) SELECT {I('pos', 'pos')}, {I('q.episode_index', 'episode_index')}, {I('n_frames', 'n_frames')} FROM q LEFT JOIN ep ON q.episode_index = ep.episode_index")
def _(spark, sf):
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), (F.col("vec_id") * 3 % 400).alias("episode_index"))
    return relations.ordered_lookup(ids, lengths(spark, sf).select("episode_index", "n_frames")).select("pos", "episode_index", "n_frames")


@query("enrich_rows", f"WITH {FRAMES} SELECT {SQL_EP}{I('frame_index', 'frame_index')}, {R('a0', 'a0')} FROM fr")
def _(spark, sf):
    f = frames(spark, sf).select(*EP, "frame_index", F.col("action")[0].alias("a0"))
    holes = f.withColumn("a0", F.when(F.col("frame_index") % 2 == 0, F.col("a0")))
    return relations.enrich_rows(holes, f, ["a0"])


@query("mirror_check", f"WITH {EPISODES} SELECT {I('count(*)', 'left_episodes')}, {I('sum(n_frames)', 'left_frames')}, {I('count(*)', 'right_episodes')}, {I('sum(n_frames) + count(*)', 'right_frames')}, false AS is_mirror FROM ep")
def _(spark, sf):
    e = lengths(spark, sf)
    return relations.mirror_check(e, e.withColumn("n_frames", F.col("n_frames") + 1))


@query("frames_with_bin_stats", f"WITH {Z_CTE} SELECT {SQL_EP}{I('b', 'bin')}, {I('dim', 'dim')}, {R('z', 'z')} FROM zs")
def _(spark, sf):
    return zscores(spark, sf).drop("n_frames", "dims")


@query("page", f"WITH {EPISODES} SELECT {SQL_EP}{I('n_frames', 'n_frames')} FROM ep ORDER BY n_frames DESC, episode_index LIMIT 7 OFFSET 5")
def _(spark, sf):
    return relations.page(lengths(spark, sf), [F.desc("n_frames"), "episode_index"], 5, 7)


@query("page_info", f"WITH {EPISODES} SELECT {I('count(*)', 'total')}, count(*) > 12 AS has_more FROM ep")
def _(spark, sf):
    return relations.page_info(lengths(spark, sf), 5, 7)


@query("numeric_order", f"WITH {EPISODES} SELECT 'episode_' || episode_index AS episode_id, {I('episode_index', 'number')} FROM ep ORDER BY episode_index")
def _(spark, sf):
    e = lengths(spark, sf).select(F.concat(F.lit("episode_"), F.col("episode_index").cast("string")).alias("episode_id"))
    return relations.in_numeric_order(e).withColumn("number", scalars.numeric_suffix("episode_id"))


@query("union_frames", f"""WITH {FRAMES}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 f FROM lineitem)
SELECT dataset_id, {I('count(*)', 'frames')} FROM fr GROUP BY ALL UNION ALL SELECT 'orders', count(*) FROM lineitem""")
def _(spark, sf):
    u = frames(spark, sf).select("dataset_id", "frame_index").unionByName(order_frames(spark, sf).select("dataset_id", "frame_index"))
    return u.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("frames"))


@query("first_per_key", f"WITH {FRAMES} SELECT {SQL_EP}{R('ts', 'ts')}, {R('a0', 'a0')} FROM fr WHERE frame_index = 0")
def _(spark, sf):
    f = frames(spark, sf).select(*EP, "frame_index", "ts", F.col("action")[0].alias("a0"))
    return relations.first_per_key(f, EP, ["frame_index"]).drop("frame_index")


@query("id_sets", f"""WITH {EPISODES}, a AS (SELECT DISTINCT episode_index e FROM ep), b AS (SELECT DISTINCT vec_id * 2 e FROM embeddings)
SELECT {I('e', 'episode_index')}, 'both' AS side FROM (SELECT e FROM a INTERSECT SELECT e FROM b) UNION ALL SELECT {I('e', 'episode_index')}, 'missing' FROM (SELECT e FROM b EXCEPT SELECT e FROM a)""")
def _(spark, sf):
    a = lengths(spark, sf).select("episode_index")
    b = table(spark, sf, "embeddings").select((F.col("vec_id") * 2).alias("episode_index"))
    both = relations.id_intersection(a, b, ["episode_index"]).withColumn("side", F.lit("both"))
    return both.unionByName(relations.id_difference(b, a, ["episode_index"]).withColumn("side", F.lit("missing")))


@query("merge_missing", f"WITH {EPISODES} SELECT {SQL_EP}{I('CASE WHEN n_frames > 66 THEN 0 ELSE n_frames END', 'n_frames')} FROM ep")
def _(spark, sf):
    e = lengths(spark, sf)
    cached = e.filter("n_frames > 66").withColumn("n_frames", F.lit(0).cast("long"))
    return relations.merge_missing(e, cached, EP)


@query("event_union", f"WITH {ALL_CTE} SELECT event_type, {I('count(*)', 'events')} FROM ae GROUP BY 1")
def _(spark, sf):
    f, p = frames(spark, sf), ready(spark, sf)
    u = None
    for d in (events.gripper_events(f), events.pause_events(f, ready=p), events.direction_changes(f), events.high_jerk(f, ready=p), events.recovery_events(f, ready=p), events.near_miss_events(f)):
        d = d.select(*EVENT_COLS)
        u = d if u is None else u.unionByName(d)
    return u.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
