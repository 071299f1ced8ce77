"""Result tables: nested reports and keyed materialisation."""

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.operators.chunks import numbered, shared_folder
from motionlake.schema import CHUNK, EP
from motionlake.sources import commits


def episode_reports(cycles: DataFrame, members: DataFrame, phases: DataFrame, features: DataFrame, reasons: DataFrame, page: int = 1000) -> DataFrame:
    """Nested rows per episode: phases, reasons in signal order, features, cluster.

    A row holds at most ``page`` phases and ``page`` reasons; an episode with more of them
    continues on further pages, so no row grows with the episode and nothing is left out.
    """
    def paged(rows, order, cells, name):
        n = numbered(rows.withColumn("_o", order), EP, ["_o", *[c for c in cells if c != "end"]], F.floor(F.col("_o") / CHUNK).cast("long"), "_rn")
        n = n.withColumn("page", F.floor(F.col("_rn") / page).cast("long"))
        return n.groupBy(*EP, "page").agg(F.array_sort(F.collect_list(F.struct("_rn", *cells))).alias("_c")).select(
            *EP, "page", F.transform("_c", lambda x: F.struct(*[x[c].alias(c) for c in cells])).alias(name))

    p = paged(phases, F.col("start"), ["start", "end", "phase", "cycle"], "phases")
    r = paged(reasons, F.col("ordinal").cast("long"), ["ordinal", "signal", "phase", "cycle", "feature", "magnitude", "explanation"], "reasons")
    nested = p.join(r, [*EP, "page"], "full")
    flagged = reasons.select(*EP).distinct().withColumn("is_anomaly", F.lit(True))
    f = features.select(*EP, F.struct(*[c for c in features.columns if c not in EP]).alias("shape_features"))
    one = (cycles.select(*EP, "n_frames", "num_cycles").join(f, EP).join(members.select(*EP, "cluster"), EP, "left")
           .join(flagged, EP, "left").withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False))))
    return one.join(nested, EP, "left").withColumn("page", F.coalesce("page", F.lit(0)))


def write_report(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Reports as parquet, one folder per dataset; rows of a large task go to several files."""
    (reports.withColumn("report_json", F.to_json(F.struct(*reports.columns)))
     .repartition("dataset_id", F.pmod(F.xxhash64("episode_index"), F.lit(64))).write.mode(mode).partitionBy("dataset_id").parquet(path))


def result_key(*parts, version: str = "phase_aware_v1", length: int = 16):
    """Key of a stored result: hash of its inputs and the algorithm version."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[F.col(p) if isinstance(p, str) else p for p in parts], F.lit(version)), 256), 1, length)


def missing_keys(requests: DataFrame, stored: DataFrame, key: str = "result_key") -> DataFrame:
    return requests.join(stored.select(key).distinct(), key, "left_anti")


def materialise_results(requests: DataFrame, path: str, compute, version: str = "phase_aware_v1") -> DataFrame:
    """Results of the requests; only keys that the table lacks are computed and committed.

    requests: (dataset_id, task_index, cohort_size). ``compute`` maps the missing requests to
    rows that carry ``result_key``. Of two writers of a key the first commit holds.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("result_key", result_key("dataset_id", F.col("task_index").cast("string"), F.concat(F.lit("cohort="), F.col("cohort_size").cast("string")), version=version))
    seen = commits.log(spark, path)
    stored = commits.read_committed(spark, path, commits=seen)
    todo = keyed if stored is None else missing_keys(keyed, stored)
    if stored is None or not todo.isEmpty():
        commits.publish_keys(compute(todo), path, "result_key", seen)
    return commits.read_committed(spark, path).join(keyed.select("result_key"), "result_key", "left_semi")


@contextmanager
def state_on_disk(spark):
    """Streams started inside keep their state in RocksDB, which lists and timers need; the session stays as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into a table of the shared folder; return the last state.

    In complete mode each batch replaces the table, so the last one holds the result.
    """
    spark = stream.sparkSession
    base = shared_folder(spark)
    folder = f"{base}/{uuid.uuid4().hex}"

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    with state_on_disk(spark):
        q = (stream.writeStream.outputMode(mode).foreachBatch(land).option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def replay(rows: DataFrame, closing: dict, after: str, files: int | None = None) -> DataFrame:
    """A stream over given rows with ``event_time``, ended by one row far behind all others.

    ``closing`` gives the cells of that row, which must outlive the filters of the operator; its time lies ``after``
    the last one, so the watermark passes all others. ``files`` files are read a batch where given.
    """
    spark = rows.sparkSession
    end = rows.agg((F.max("event_time") + F.expr(f"INTERVAL {after}")).alias("event_time"))
    last = end.select(*[F.col(c) if c == "event_time" else closing.get(c, F.lit(None)).cast(t).alias(c) for c, t in rows.dtypes])
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    rows.unionByName(last).write.parquet(folder)
    source = spark.readStream.schema(rows.schema)
    return (source.option("maxFilesPerTrigger", files) if files else source).parquet(folder)
