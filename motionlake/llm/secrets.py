"""Operator 5: secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds one
row per (blob, rule, rule version) that was ever scanned; a run scans only pairs it has not
seen, each blob once however many paths and versions share it, appends them, and joins the
findings back to all paths. A new version of one rule scans old blobs for that rule alone.

Positions are code points, end exclusive. A match is found by wrapping it in a marker and
cutting there; U+0001 in a text is first replaced by U+0002, which no rule contains, so
positions stay.

Defined cases: null content counts as empty and has a blob of its own like any other; equal
contents share a blob; an empty table adds nothing; a path that occurs twice gets its
findings twice; other columns of the versions are carried through whatever their names (columns
named ``_blob`` or ``_spans`` give way to the results of those names in ``findings``; ``paths``
keeps them, in a struct).
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionlake.llm.common import Scratch

#: Fixed values: (kind, version, pattern, group whose length counts, least length). A run of
#: lower hexadecimal digits below 32 fails as a whole, so the pattern asks for 32 at once.
RULES = [
    ("assign", 1, "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                  r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 16),
    ("hex", 1, "[0-9a-f]{32,}", 0, 32),
]

FOUND = "array<struct<start:bigint,end:bigint>>"


def rule_id(kind: str, version: int) -> str:
    return f"{kind}@{version}"


def pieces(text: Column, pattern: str, group: int) -> Column:
    """Gaps and matches of a pattern in turn, as (i, length, counted length)."""
    cut = F.split(F.regexp_replace(F.translate(text, "\u0001", "\u0002"), pattern, "\u0001$0\u0001"), "\u0001", -1)
    counted = (lambda x: F.length(F.regexp_extract(x, pattern, group))) if group else F.length
    return F.transform(cut, lambda x, i: F.struct(i.alias("i"), F.length(x).cast("long").alias("n"), F.when(i % 2 == 1, counted(x)).otherwise(0).alias("c")))


def cut_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """(blob, rule, least, cut) for (blob, content, seen), for the rules not in ``seen``.

    ``cut`` holds the lengths of the pieces of a text with a match, else null; no text.
    """
    todo = F.array(*[
        F.when(~F.array_contains("seen", rule_id(kind, version)), F.struct(
            F.lit(rule_id(kind, version)).alias("rule"), F.lit(least).alias("least"),
            F.when(F.regexp_like("content", F.lit(pattern)), pieces(F.col("content"), pattern, group)).alias("cut")))
        for kind, version, pattern, group, least in rules])
    return blobs.select("blob", F.explode(F.filter(todo, lambda x: x.isNotNull())).alias("x")).select("blob", "x.*")


def place_cuts(cuts: DataFrame) -> DataFrame:
    """(blob, rule, found) of the cut texts. Places are a running sum that can spill."""
    rows = cuts.filter("cut is not null").select("blob", "rule", "least", F.explode("cut").alias("p"))
    along = Window.partitionBy("blob", "rule").orderBy("p.i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select("blob", "rule", "least", "p", F.sum("p.n").over(along).alias("end")).filter((F.col("p.i") % 2 == 1) & (F.col("p.c") >= F.col("least")))
    return placed.groupBy("blob", "rule").agg(
        F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("p.n")).alias("start"), "end"))).cast(FOUND).alias("found"))


def update(versions: DataFrame, ledger: str, content: str = "text", rules=RULES) -> None:
    """Scan what the ledger has not seen and append it. Runs jobs.

    Ledger rows: blob, rule, found (null: scanned, nothing found).
    """
    spark = versions.sparkSession
    scratch = Scratch(spark)
    body = F.coalesce(F.col(content), F.lit(""))
    blobs = versions.select(F.sha2(body, 256).alias("blob"), body.alias("content")).groupBy("blob").agg(F.first("content").alias("content"))
    none = F.array().cast("array<string>")
    if exists(spark, ledger):
        seen = spark.read.parquet(ledger).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", none))
    else:
        blobs = blobs.withColumn("seen", none)
    cuts = scratch.keep(cut_blobs(blobs, rules))
    cuts.select("blob", "rule").join(place_cuts(cuts), ["blob", "rule"], "left").write.mode("append").parquet(ledger)
    scratch.forget(*scratch.made)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def paths(versions: DataFrame, ledger: str, content: str = "text", rules=RULES) -> DataFrame:
    """``row`` (the version as a struct), ``_blob`` and ``_spans``: array of (start, place of the kind, kind, end), in order.

    Only blobs with findings meet the paths; a blob that many paths share is one row here,
    and the rows of its paths can be split by adaptive execution.
    """
    led = versions.sparkSession.read.schema(f"blob string, rule string, found {FOUND}").parquet(ledger)
    ids = {rule_id(r[0], r[1]): (k, r[0]) for k, r in enumerate(rules)}
    place = F.create_map(*[F.lit(x) for k, v in ids.items() for x in (k, v[0])])
    kind = F.create_map(*[F.lit(x) for k, v in ids.items() for x in (k, v[1])])
    spans = (led.filter(F.col("rule").isin(*ids) & F.col("found").isNotNull()).dropDuplicates(["blob", "rule"])
             .select(F.col("blob").alias("_blob"), F.transform("found", lambda x: F.struct(
                 x["start"].alias("start"), place[F.col("rule")].alias("place"),
                 kind[F.col("rule")].alias("kind"), x["end"].alias("end"))).alias("s"))
             .groupBy("_blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("_spans")))
    keyed = versions.select(F.struct("*").alias("row"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("_blob"))
    return keyed.join(spans, "_blob", "left").select("row", "_blob", "_spans")


def findings(versions: DataFrame, ledger: str, content: str = "text", rules=RULES) -> DataFrame:
    """The versions with ``_blob`` and ``_spans``: array of (start, place of the kind, kind, end), in order."""
    own = [F.col(f"row.`{c}`").alias(c) for c in versions.columns if c not in ("_blob", "_spans")]
    return paths(versions, ledger, content, rules).select(*own, "_blob", "_spans")


def scan(versions: DataFrame, ledger: str, content: str = "text", rules=RULES) -> DataFrame:
    """Bring the ledger up to date, then findings of all paths. Runs jobs."""
    update(versions, ledger, content, rules)
    return findings(versions, ledger, content, rules)


def fresh_ledger(spark: SparkSession) -> str:
    return Scratch(spark).base + "/ledger"


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by a mark; spans that touch or overlap become one."""
    edges = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"),
    )).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    done = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(F.aggregate(spans, edges, step, done))
