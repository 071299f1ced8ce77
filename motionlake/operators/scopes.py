"""Statistics over several scopes at once: every task, and every dataset as a whole.

What an episode is (ranges, phases, cycles, features) does not depend on what it is compared
with, so it is computed once from the frames. Its few rows are then repeated once per scope, as
grouping sets would do, with ``task_index`` naming the scope. Every operator that groups
by task works on such rows unchanged. Episode numbers must be unique in a dataset for the scope
of all tasks.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.operators.chunks import chunk_of, numbered, spread_join
from motionlake.schema import EP, TASK

#: ``task_index`` of the rows that stand for a whole dataset.
ALL_TASKS = -1
#: Scopes by name: the value that ``task_index`` takes.
SCOPES = {"task": lambda: F.col("task_index"), "dataset": lambda: F.lit(ALL_TASKS).cast("long")}


def scope_values(scopes: Sequence[str]) -> Column:
    return F.array(*[SCOPES[s]() for s in dict.fromkeys(scopes)])


def scope_episodes(lengths: DataFrame, scopes: Sequence[str] = ("task",), first: int | None = None) -> DataFrame:
    """(episode, n_frames, scopes): the scopes an episode counts in, as an array of ``task_index`` values.

    ``first`` keeps the first n episodes of each scope by index; episodes of no scope are left out.
    """
    if first is None:
        return lengths.select(*EP, "n_frames", scope_values(scopes).alias("scopes"))
    own = F.col("task_index").alias("_own")
    each = lengths.select("dataset_id", F.explode(scope_values(scopes)).alias("_scope"), own, "episode_index", "n_frames")
    ranks = numbered(each.withColumnRenamed("_scope", "task_index"), TASK, ["episode_index", "_own"], chunk_of("episode_index"), "_rank")
    # an episode has one row per scope, so the array holds as many values as there are scopes
    kept = ranks.filter(F.col("_rank") < first).groupBy("dataset_id", "_own", "episode_index").agg(
        F.max("n_frames").alias("n_frames"), F.array_sort(F.collect_set("task_index")).alias("scopes"))
    return kept.select("dataset_id", F.col("_own").alias("task_index"), "episode_index", "n_frames", "scopes")


def scoped(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """Rows of episodes, once per scope of the episode; ``task_index`` becomes the scope."""
    # salted by the whole row, since one episode may have very many phases
    salted = rows.withColumn("_on", F.xxhash64(*rows.columns))
    joined = spread_join(salted, episodes.select(*EP, "scopes"), EP, "_on").withColumn("_scope", F.explode("scopes"))
    return joined.select(*[F.col("_scope").alias(c) if c == "task_index" else F.col(c) for c in rows.columns])
