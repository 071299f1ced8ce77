"""Operator 1: mixing sources to target weights.

Tokens are added up per source; a source's repetition rate is its target over its size. A
document is taken floor(rate) times, plus once more if a draw falls below the fraction of the
rate. A draw is seeded by a hash of id, source and text and by the row's number among equal
rows, so reruns agree and rows without an id, or with one id, draw apart.

Defined cases: a null source is a source of its own, last in order; null or empty text has
size 0 and is taken at the rate of its source with 0 words; null and repeated ids draw by
their texts, repeated rows one by one; an empty table gives no rows. Columns of the
documents with other names do not matter here and are carried through by ``emit``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import Scratch, WORD, among_equals, ranked
from motionlake.operators.chunks import spread_join

#: Up to so many sources their table is broadcast; more are joined over salted keys.
SMALL = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_rates(sizes: DataFrame, scratch: Scratch, cycle=(1, 2, 3), most: int = 3) -> DataFrame:
    """(_key, source_size, target, rate) from (source, size).

    Sources in order of code points, null last, weigh as ``cycle`` says, over and over. They
    share the sum of all sizes; a target stops at ``most`` times its source, and the excess is
    shared again until none is above. Each round is one aggregate of two sums: the set of
    stopped sources only grows, so it is given by the last share per weight (num / den).
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    places = ranked(totals, [F.col("source").asc_nulls_last()], scratch, "_place")
    weights = F.array(*[F.lit(w).cast("long") for w in cycle])
    table = scratch.keep(places.select(
        source_key(F.col("source")).alias("_key"), "source_size", F.get(weights, (F.col("_place") % len(cycle)).cast("int")).alias("_w")))
    wide = "decimal(38,0)"

    def stopped(num: int, den: int) -> Column:
        cap = F.col("source_size").cast("decimal(18,0)") * F.lit(most * den).cast("decimal(18,0)")
        return cap.cast(wide) < (F.lit(num).cast("decimal(18,0)") * F.col("_w").cast("decimal(6,0)")).cast(wide)

    first = table.agg(F.sum("source_size"), F.sum("_w")).first()
    total, num, den, held = first[0] or 0, first[0] or 0, first[1] or 1, -1
    while True:
        cut = stopped(num, den)
        n, capped, free = table.agg(F.count_if(cut), F.sum(F.when(cut, F.col("source_size") * most)), F.sum(F.when(~cut, F.col("_w")))).first()
        if n == held or not free:
            break
        num, den, held = total - (capped or 0), free, n
    target = F.when(stopped(num, den), (F.col("source_size") * most).cast("double")).otherwise((F.lit(num).cast("long") * F.col("_w")).cast("double") / F.lit(float(den)))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size").cast("double")).otherwise(0.0)
    return table.select("_key", "source_size", target.alias("target"), rate.alias("rate"))


def row_code(doc_id: Column, source: Column, text: Column) -> Column:
    """A code of id, source and text, equal only for rows that agree in all three; never null."""
    own = F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("n"))
    return F.md5(F.concat_ws("|", own, F.coalesce(F.md5(text), F.lit("n")), source_key(source)))


def draw(code: Column, place: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of a row's code and its number among equal rows."""
    bits = F.md5(F.concat_ws("|", F.lit(seed), code, place.cast("string")))
    return F.conv(F.substring(bits, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def with_rates(rows: DataFrame, rates: DataFrame, salt_on: str) -> DataFrame:
    """Join (_key, ...) with the table of sources: broadcast when that is small, else salted."""
    if rates.count() <= SMALL:
        return rows.join(F.broadcast(rates), "_key")
    return spread_join(rows, rates, ["_key"], salt_on)


def mix(docs: DataFrame, seed: str = "mix", cycle=(1, 2, 3), most: int = 3) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken. Runs jobs."""
    scratch = Scratch(docs.sparkSession)
    code = row_code(F.col("doc_id"), F.col("source"), F.col("text"))
    sizes = scratch.keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), code.alias("_code")))
    rates = scratch.keep(source_rates(sizes.select("source", "size"), scratch, cycle, most))
    placed = among_equals(sizes, "_code", "_place", scratch)
    joined = with_rates(placed.withColumn("_key", source_key(F.col("source"))), rates, "_code")
    copies = copies_of("rate", F.col("_code"), F.col("_place"), seed)
    return scratch.result(joined.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")))


def copies_of(rate: str, code: Column, place: Column, seed: str) -> Column:
    whole = F.floor(F.col(rate))
    return (whole + F.when(draw(code, place, seed) < F.col(rate) - whole, 1).otherwise(0)).cast("long")


def emit(docs: DataFrame, seed: str = "mix", cycle=(1, 2, 3), most: int = 3) -> DataFrame:
    """The documents, each as often as the mix takes it. Runs jobs.

    Rows that agree in id, source and text are numbered in the order in which they are read, so which
    of them stays may change if their further columns differ; how many stay does not.
    """
    scratch = Scratch(docs.sparkSession)
    sizes = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    rates = scratch.keep(source_rates(scratch.keep(sizes), scratch, cycle, most))
    code = row_code(F.col("doc_id"), F.col("source"), F.col("text"))
    packed = docs.select(F.struct("*").alias("_row"), source_key(F.col("source")).alias("_key"), code.alias("_code"))
    joined = with_rates(among_equals(packed, "_code", "_place", scratch), rates.select("_key", "rate"), "_code")
    copies = copies_of("rate", F.col("_code"), F.col("_place"), seed).cast("int")
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select("_row.*")
