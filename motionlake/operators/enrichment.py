"""Review planning over a finished report and merging of its answers.

The calls themselves go to an outside service; what is sent and what comes back are tables.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.vectors import one_decimal
from motionlake.schema import EP, TASK

CLIPS_PER_CALL, NORMALS, FLAGGED_CAP = 10, 3, 20  # fixed values


def cap_flagged(flagged: DataFrame, cap: int = FLAGGED_CAP) -> DataFrame:
    """First ``cap`` flagged episodes of a task by index, with their position."""
    w = Window.partitionBy(*TASK).orderBy("episode_index")
    return flagged.select(*EP).distinct().withColumn("position", F.row_number().over(w)).filter(F.col("position") <= cap).withColumn("position", F.col("position") - 1)


def cap_summary(flagged: DataFrame, cap: int = FLAGGED_CAP) -> DataFrame:
    n = flagged.select(*EP).distinct().groupBy(*TASK).agg(F.count(F.lit(1)).alias("flagged_total"))
    return n.select(*TASK, F.least("flagged_total", F.lit(cap)).alias("flagged_shown"), "flagged_total", (F.col("flagged_total") > cap).alias("flagged_capped"))


def cluster_calls(clusters: DataFrame) -> DataFrame:
    """Clips per cluster call: the cluster's medoid and one contrast medoid per other cluster.

    A task has at most five clusters, so its pairs are bounded.
    """
    key = TASK
    t = clusters.select(*key, F.col("cluster").alias("target_cluster"), "size")
    o = clusters.select(*key, "cluster", F.col("medoid").alias("episode_index"))
    j = t.join(o, key)
    return j.select(*key, "target_cluster", F.when(F.col("target_cluster") == F.col("cluster"), "target").otherwise("contrast").alias("role"), "cluster", "episode_index")


def flag_batches(flagged: DataFrame, clusters: DataFrame, cap: int = FLAGGED_CAP) -> DataFrame:
    """Batches of flagged episodes with up to three normal references, ten clips in all."""
    w = Window.partitionBy(*TASK).orderBy("cluster")
    normals = clusters.select(*TASK, "cluster", "medoid").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= NORMALS)
    n = normals.groupBy(*TASK).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list("medoid")).alias("normal_ids"))
    j = cap_flagged(flagged, cap).join(n, TASK, "left")
    per = F.greatest(F.lit(1), F.lit(CLIPS_PER_CALL) - F.coalesce("_n", F.lit(0)))
    return j.select(*EP, F.floor(F.col("position") / per).cast("long").alias("batch"), F.concat_ws(",", F.transform("normal_ids", lambda x: x.cast("string"))).alias("normal_ids"))


def enrichment_plan(flagged: DataFrame, clusters: DataFrame, cap: int = FLAGGED_CAP) -> DataFrame:
    """Every clip to send: (task, call, role, episode_index)."""
    a = cluster_calls(clusters).select(*TASK, F.concat(F.lit("cluster "), F.col("target_cluster")).alias("call"), "role", "episode_index")
    b = flag_batches(flagged, clusters, cap)
    shown = b.select(*TASK, F.concat(F.lit("flags "), F.col("batch").cast("string")).alias("call"), F.lit("flagged").alias("role"), "episode_index")
    refs = b.select(*TASK, "batch", "normal_ids").distinct().select(
        *TASK, F.concat(F.lit("flags "), F.col("batch").cast("string")).alias("call"), F.lit("normal").alias("role"), F.explode(F.split("normal_ids", ",")).alias("e"))
    refs = refs.filter("e <> ''").select(*TASK, "call", "role", F.col("e").cast("long").alias("episode_index"))
    return a.unionByName(shown).unionByName(refs)


def merge_cluster_answers(clusters: DataFrame, answers: DataFrame) -> DataFrame:
    """answers: (task, cluster, proposed_label, description, confidence)."""
    return clusters.join(answers, [*TASK, "cluster"], "left")


def merge_episode_answers(reasons: DataFrame, answers: DataFrame, signal: str = "review") -> DataFrame:
    """Append new observations as reasons.

    answers: (episode, severity, confirmation, observations array<struct<timestamp, observation, phase, cycle>>).
    """
    o = answers.select(*EP, F.explode("observations").alias("o"))
    extra = o.select(*EP, F.lit(signal).alias("signal"), F.col("o.phase").alias("phase"), F.col("o.cycle").cast("long").alias("cycle"),
                     F.lit(None).cast("string").alias("feature"), F.lit(0.0).alias("magnitude"),
                     F.concat(F.lit("AI-observed at "), F.coalesce("o.timestamp", F.lit("?")), F.lit(": "), F.coalesce("o.observation", F.lit(""))).alias("explanation"),
                     F.lit(5).alias("ordinal"))
    return reasons.unionByName(extra)


def episode_context_text(episodes: DataFrame, phases: DataFrame, gripper_events: DataFrame, fps: float = 10.0) -> DataFrame:
    """Compact telemetry block of the episodes to be reviewed (a capped list, see cap_flagged).

    phases: phase_action_summary rows; gripper_events: raw open and close frames.
    """
    sec = lambda x: F.col(x) / F.lit(float(fps))
    two = lambda x: F.format_string("%.2f", sec(x))
    num = lambda x: F.col(x).cast("string")
    head = F.concat(F.col("phase"), F.lit("c"), F.col("cycle").cast("string"), F.lit(" "), one_decimal(sec("frame_start")), F.lit("-"), one_decimal(sec("frame_end")), F.lit("s"))
    body = F.concat(F.lit(" (posM="), num("pos_mag_mean"), F.lit("/"), num("pos_mag_max"), F.lit(",rotM="), num("rot_mag_mean"), F.lit("/"), num("rot_mag_max"), F.lit(")"))
    line = F.when(F.col("phase").isin("Grasp", "Release"), head).otherwise(F.concat(head, body))
    few = episodes.select(*EP)
    p = phases.join(few, EP, "left_semi").groupBy(*EP).agg(F.array_sort(F.collect_list(F.struct("frame_start", line.alias("t")))).alias("_p"))
    g = gripper_events.join(few, EP, "left_semi").groupBy(*EP).agg(
        F.array_sort(F.collect_list(F.struct("frame", F.concat(F.col("kind"), F.lit("@"), two("frame"), F.lit("s")).alias("t")))).alias("_g"))
    j = episodes.join(p, EP, "left").join(g, EP, "left")
    extra = F.size("_g") - F.col("num_cycles") * 2
    note = F.when(extra > 0, F.concat(F.lit(" ← "), extra.cast("string"), F.lit(" extra event(s) vs 2×cycles="), (F.col("num_cycles") * 2).cast("string"),
                                      F.lit(": probable re-grip / failed-grasp"))).otherwise("")
    first = F.concat(F.lit("    frames="), F.col("n_frames").cast("string"), F.lit(f" @ {fps:g}Hz · cycles="), F.col("num_cycles").cast("string"))
    mid = F.when(F.size("_p") > 0, F.concat(F.lit("    phases: "), F.concat_ws(", ", F.transform("_p", lambda x: x["t"]))))
    end = F.when(F.size("_g") > 0, F.concat(F.lit("    gripper events ("), F.size("_g").cast("string"), F.lit("): ["), F.concat_ws(", ", F.transform("_g", lambda x: x["t"])), F.lit("]"), note))
    return j.select(*EP, F.concat_ws("\n", first, mid, end).alias("context"))


def detector_agreement(flags: DataFrame, ratings: DataFrame) -> DataFrame:
    """Counts of (statistically flagged, independent rating); suspicious and mistake count as flags."""
    f = flags.select(*EP).distinct().withColumn("flagged", F.lit(True))
    j = ratings.select(*EP, "rating").join(f, EP, "full")
    return j.groupBy(F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("rating", F.lit("unrated")).alias("rating")).agg(
        F.count(F.lit(1)).alias("episodes")).withColumn("agrees", F.col("flagged") == F.col("rating").isin("suspicious", "mistake"))
