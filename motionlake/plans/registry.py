"""Named queries over the driver tables, with the SQL each must equal."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
ORACLES: dict = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits, whole numbers to bigint, so both engines print equal values."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its SQL twin where there is one."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def R(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0e0 AS {name}"


def I(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


EPC = "dataset_id, task_index, episode_index"
W = "(PARTITION BY episode_index ORDER BY frame_index)"
DIMS = range(7)

# Frames of the events table; a0..a6 is the action, s0..s2 the state, n the episode's length.
FRAMES = """
ev AS MATERIALIZED (SELECT user_id u, event_id e, epoch_us(ts) us, value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) k,
  row_number() OVER w - 1 f, min(epoch_us(ts)) OVER (PARTITION BY user_id) t0, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) cx,
  CAST(sum(event_id % 97 - 48) OVER w AS BIGINT) cy, count(*) OVER (PARTITION BY user_id) n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
fr AS MATERIALIZED (SELECT 'ds' || (u % 5 % 2) dataset_id, u % 5 task_index, u episode_index, f frame_index, n, (us - t0) / 1000000e0 ts,
  value / 100e0 a0, (e % 97) / 97e0 - 0.5e0 a1, (e % 31) / 31e0 - 0.5e0 a2, k / 100e0 a3, (u % 13) / 13e0 a4, (e % 7) / 7e0 a5,
  CASE WHEN (f + u) % 60 BETWEEN 20 AND 44 THEN 1e0 ELSE -1e0 END a6,
  cx / 100000e0 s0, cy / 970e0 s1, 1e0 - (((f + u) % 60 - 32) * ((f + u) % 60 - 32)) / 1024e0 s2 FROM ev)"""


def _norm(p: str, dims) -> str:
    return "sqrt(" + " + ".join(f"{p}{i}*{p}{i}" for i in dims) + ")"


# Velocity v*, acceleration c*, jerk j* and the scalar series.
SERIES = FRAMES + f""",
d1 AS MATERIALIZED (SELECT *, {", ".join(f"a{i} - lag(a{i}) OVER w v{i}" for i in DIMS)} FROM fr WINDOW w AS {W}),
d2 AS MATERIALIZED (SELECT *, {", ".join(f"v{i} - lag(v{i}) OVER w c{i}" for i in DIMS)} FROM d1 WINDOW w AS {W}),
d3 AS MATERIALIZED (SELECT *, {", ".join(f"c{i} - lag(c{i}) OVER w j{i}" for i in DIMS)} FROM d2 WINDOW w AS {W}),
se AS MATERIALIZED (SELECT *, {_norm("v", range(6))} speed, {_norm("c", range(6))} accel, {_norm("j", range(6))} jerk,
  {_norm("v", DIMS)} delta, {_norm("c", DIMS)} accel_all, {_norm("v", range(3))} speed3 FROM d3),
th AS MATERIALIZED (SELECT episode_index, avg(speed) speed_mean, avg(jerk) jerk_mean, avg(accel) accel_mean, quantile_cont(speed, 0.2) speed_p20,
  quantile_cont(jerk, 0.95) jerk_p95, quantile_cont(accel, 0.9) accel_p90, quantile_cont(accel_all, 0.9) accel_all_p90, quantile_cont(delta, 0.95) delta_p95
  FROM se GROUP BY 1),
pr AS MATERIALIZED (SELECT se.*, th.* EXCLUDE (episode_index) FROM se JOIN th USING (episode_index))"""

EPISODES = FRAMES + """,
ep AS MATERIALIZED (SELECT dataset_id, task_index, episode_index, count(*) n_frames FROM fr GROUP BY ALL)"""


def greedy(candidates: str, k: int, key: str = "dataset_id, task_index, episode_index", frame: str = "frame_index") -> str:
    """SQL of the greedy minimum gap over a candidate relation."""
    return (f"(SELECT {key}, unnest(list_reduce(list_transform(list_sort(list({frame})), lambda x: [x]), "
            f"lambda a, x: CASE WHEN x[1] - a[-1] >= {k} THEN list_concat(a, x) ELSE a END)) {frame} FROM (SELECT DISTINCT {key}, {frame} FROM {candidates}) GROUP BY {key})")
