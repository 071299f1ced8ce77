"""What the text operators share: words, tables in the shared folder, ranks, let-bindings."""

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionlake.operators.chunks import numbered, shared_folder

#: ASCII white space, and a word between it; the same in Java and RE2 syntax.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


class Scratch:
    """Tables of one run in the shared folder (``spark.checkpoint.dir``).

    ``keep`` writes rows as parquet and reads them back, so that a lost executor costs no
    recomputation and lineage stays short. ``result`` does so for the rows to return, then
    removes the tables that only led to them.
    """

    def __init__(self, spark: SparkSession):
        folder = shared_folder(spark)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        self.spark, self.base, self.made = spark, f"{folder.rstrip('/')}/{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.made)}"
        self.made.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, *paths: str) -> None:
        jvm = self.spark._jvm
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def result(self, df: DataFrame) -> DataFrame:
        out = self.keep(df)
        self.forget(*self.made[:-1])
        return out


#: Rows of a batch that goes to Python within ``small_batches``.
BATCH = 512


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH):
    """Jobs run inside hand Python batches of at most ``rows`` rows, or of the session's number if that is less; the session stays as it was.

    A batch stands in an executor's memory beside its heap, on both sides of the pipe, so the usual
    10,000 texts cost hundreds of MB there.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    # zero or less stands for no limit
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts(spark: SparkSession, per: int = 2) -> int:
    """Number of hash parts: follows ``spark.sql.shuffle.partitions``, which is set to suit the data."""
    return per * int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the map of ``likely``: at most BITS / 64 rows are broadcast, whatever the data.
BITS = 1 << 23


def likely(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose column may be among the keys, by a broadcast bit map of fixed size.

    Goes before a join that would shuffle long rows. It never loses a row; with more keys than
    bits it only lets more through.
    """
    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BITS))

    bit = F.expr("shiftleft(cast(1 as bigint), cast(_at % 64 as int))")
    words = keys.select(place(key).alias("_at")).select(F.floor(F.col("_at") / 64).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_at", place(column)).withColumn("_word", F.floor(F.col("_at") / 64))
    return marked.join(F.broadcast(words), "_word").filter(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def maybe_among(rows: DataFrame, column: str, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """The rows with a flag: false only where the column is surely not among the keys (same bit map as ``likely``)."""
    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(BITS))

    bit = F.expr("shiftleft(cast(1 as bigint), cast(_at % 64 as int))")
    words = keys.select(place(key).alias("_at")).select(F.floor(F.col("_at") / 64).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = rows.withColumn("_at", place(column)).withColumn("_word", F.floor(F.col("_at") / 64)).join(F.broadcast(words), "_word", "left")
    return marked.select(*rows.columns, (F.coalesce(F.col("_bits").bitwiseAND(bit), F.lit(0)) != 0).alias(flag))


#: Rows of one key that one task numbers.
RUN = 1 << 16


def among_equals(rows: DataFrame, code: str, name: str, scratch: Scratch) -> DataFrame:
    """Number the rows of equal ``code`` (never null) from 0. Runs jobs.

    Codes that stand more than once are counted first; rows that a bit map shows to be single get 0
    where they are. Only the others are written, with a running id, and numbered over runs
    of ``RUN`` ids, so a code that holds a third of all rows is spread over many tasks.
    """
    many = scratch.keep(rows.groupBy(code).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(code))
    flagged = maybe_among(rows, code, many, code, "_maybe")
    single = flagged.filter(~F.col("_maybe")).drop("_maybe").withColumn(name, F.lit(0).cast("long"))
    some = scratch.keep(flagged.filter("_maybe").drop("_maybe").withColumn("_id", F.monotonically_increasing_id()))
    place = numbered(some.select(code, "_id"), [code], "_id", F.floor(F.col("_id") / RUN).cast("long"), name)
    return single.unionByName(some.join(place.select("_id", name), "_id").drop("_id"))


def ranked(df: DataFrame, order, scratch: Scratch, name: str = "rank") -> DataFrame:
    """0-based rank over all rows, without one task that sees them all.

    Rows are dealt by ranges of the order; one count per range gives each its offset.
    """
    dealt = scratch.keep(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return dealt.withColumn(name, inside).join(offsets, "_p").withColumn(name, (F.col(name) + F.col("_o")).cast("long")).drop("_p", "_o")
