"""From raw documents to packed sequences, one operator after the other.

Every stage works on what the one before it kept; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet in the shared folder and read again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionlake.llm import mixing, packing, quality, secrets, setjoin
from motionlake.llm.common import Scratch, documents
from motionlake.operators.chunks import spread_join


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and short texts go, repeated rows are judged one by one."""
    return quality.keep(docs)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose shingle sets link, the one with the least id; rows without id stay.

    Each row counts by its own text, also among rows that share an id: of equal ids in one
    component one row stays, and a row stays if only another text of its id is a copy. Empty
    and null texts link with nothing and all stay; extra columns are kept whatever their names.
    """
    rows = Scratch(spark).keep(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    known = rows.filter("doc.doc_id is not null")
    component = setjoin.join(known.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))).select(F.col("doc_id").alias("row"), "component_id")
    order = known.select("row", F.struct("doc.doc_id", F.xxhash64("doc"), "row").alias("place")).join(component, "row")
    stays = order.groupBy("component_id").agg(F.min("place")["row"].alias("stays"))
    # a large component is one key; its one row meets the members over salts
    copies = spread_join(order, stays, ["component_id"], "row").filter("row <> stays").select("row")
    return rows.join(copies, "row", "left_anti").select("doc.*")


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark, and ``n_chars`` of what is left.

    A null text stays null; equal texts are scanned once; extra columns are kept whatever their names.
    """
    ledger = secrets.fresh_ledger(spark)
    secrets.update(docs.select("text"), ledger)
    found = secrets.paths(docs, ledger)
    text = secrets.redact(F.col("row.text"), F.col("_spans"))
    own = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return found.select(*[own[c].alias(c) if c in own else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them; null or empty texts at the rate of their source."""
    return mixing.emit(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; a null or empty text is one piece of its end mark."""
    return packing.pack(docs)


STAGES = [("quality_rules", good), ("near_duplicates", single), ("secrets", safe), ("mixing", mixed), ("packing", packed)]

#: Tokens and best-fit packing have no SQL. Of the stages of this file, tests/llm compares near
#: duplicates with brute force; the others are compared as operators, not in turn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    out = scratch.result(STAGES[-1][1](spark, docs, sf_dir))
    return out
