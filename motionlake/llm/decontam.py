"""Operator 13: benchmark decontamination by a prefix-filtered join of shingles.

A window is ``width`` neighbouring words of an item; an item of fewer words is one window. A
document holds an item if one of its windows occurs in the document, word by word.

1. A window is the ordered set of its shingles of ``gram`` words (a shorter window is one
   shingle). A document that holds the window holds all of them, so the rarest alone is a
   necessary prefix: of an item's m shingles the m - c + 1 rarest at most (c shingles to a window), and of
   these only the rarest of some window.
2. Rarity is the number of occurrences in all documents, counted for the shingles of items
   only: a bit map of fixed size, built by an aggregate, lets a task skip nearly all others,
   and counts are added up before they are shuffled. A window with a shingle that never occurs is done.
3. Documents are read again and join with the prefixes on the shingle, over salts, so that a
   shingle in a third of all documents is no single task. Length and position bound the rest: the
   window must fit into the document around the shingle.
4. Containment is verified on the words themselves, on the document window of the item
   window's size at that place. Covered words are counted over sorted starts; items are looked up once per
   different set of windows, however many documents share it.

Windows of one text are one window whatever number of items holds them. Shingles meet by a 64-bit hash; what
they bring together is compared word by word.

Defined cases: a null or empty text has no words and no hits; rows of the same or of no id are handled one by
one; items with the same id are one item; items without an id are left out; an item without
words occurs nowhere; an empty table of items leaves all documents clean; an empty table of
documents gives no rows; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.llm.common import Scratch
from motionlake.llm.textnum import Texts, slices
from motionlake.operators.chunks import spread_join

WIDTH, GRAM, SALTS = 10, 5, 32

#: Bits of the maps that tasks carry: 4 MB, whatever the data.
BITS = 1 << 25

#: Every byte as it counts: letters lower-cased, 0-9, a-z and bytes of other alphabets stay, the rest is space.
_TABLE = np.full(256, 32, np.uint8)
_TABLE[48:58], _TABLE[97:123], _TABLE[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_TABLE[65:91] = np.arange(97, 123)

WINDOWS = "item_id bigint, window string, n_words int, shingles array<bigint>, grams array<int>"


def tokens(column: pa.Array):
    """(first row, slice with its words) over a column; null counts as empty."""
    for at, part in slices(column):
        part = Texts(_TABLE[part.buf], part.edges)
        part.words()
        yield at, part


def shingled(part: Texts, hashes: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word in the document, hash) of each shingle; sizes differ in their hashes."""
    doc, at, value = part.windows(hashes, gram)
    return doc, at, value ^ np.uint64(gram * 0x9E3779B97F4A7C15 % 2**64)


def item_windows(items: DataFrame, width: int, gram: int) -> DataFrame:
    """WINDOWS of (item_id, text): every window with its shingles in order."""
    def run(batches):
        for batch in batches:
            for at, part in tokens(batch.column(1)):
                raw, hashes, out = part.buf.tobytes(), part.word_hashes(), [[], [], [], [], []]
                for k in range(len(part.edges) - 1):
                    a, z = int(part.first[k]), int(part.first[k + 1])
                    if a == z:
                        continue
                    size = min(width, z - a)
                    g = min(gram, size)
                    one = Texts(part.buf, np.array([0, len(part.buf)]))
                    one.first = np.array([0, z - a])
                    value = shingled(one, hashes[a:z], g)[2].view(np.int64)
                    per = size - g + 1
                    for s in range(z - a - size + 1):
                        words = b" ".join(raw[x:y] for x, y in zip(part.starts[a + s:a + s + size], part.ends[a + s:a + s + size])).decode()
                        for c, v in zip(out, (batch.column(0)[at + k].as_py(), words, size, value[s:s + per].tolist(), [g] * per)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())))], names=["item_id", "window", "n_words", "shingles", "grams"])

    named = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    return named.mapInArrow(run, WINDOWS)


def bit_map(shingles: DataFrame, column: str, bits: int = BITS) -> bytes:
    """A map of ``bits`` bits with those of the column set; one aggregate, a fixed number of rows at most. Runs a job."""
    spot = F.pmod(F.col(column), F.lit(bits))
    words = shingles.select(spot.alias("s")).select(F.floor(F.col("s") / 64).alias("w"), F.expr("shiftleft(cast(1 as bigint), cast(s % 64 as int))").alias("b"))
    out = np.zeros(bits // 64, np.uint64)
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b"))
    for batch in rows.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return out.tobytes()


def marked(value: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes are in the map."""
    spot = (value.view(np.int64) % np.int64(len(bits) * 64)).view(np.uint64)
    return (bits[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) > 0


def rarity(docs: DataFrame, filled: bytes, grams: list[int]) -> DataFrame:
    """(shingle, n): occurrences of the shingles that may be of items."""
    held = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        bits = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            for _, part in tokens(batch.column(0)):
                hashes, some = part.word_hashes(), [np.zeros(0, np.uint64)]
                for g in grams:
                    value = shingled(part, hashes, g)[2]
                    some.append(value[marked(value, bits)])
                value, n = np.unique(np.concatenate(some), return_counts=True)
                if len(value):
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


MET = "row bigint, doc_id bigint, n_words bigint, shingle bigint, at bigint, before int, around string"


def probes(docs: DataFrame, filled: bytes, grams: list[int], width: int) -> DataFrame:
    """MET: a row for each document (shingle null), and one for each place of a marked shingle with the words around it."""
    held = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        bits = np.frombuffer(held.value, np.uint64)
        for batch in batches:
            for at, part in tokens(batch.column(2)):
                n, k = np.diff(part.first), len(part.edges) - 1
                row, ident = batch.column(0).slice(at, k), batch.column(1).slice(at, k)
                none = [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.string())]
                names = ["row", "doc_id", "n_words", "shingle", "at", "before", "around"]
                yield pa.RecordBatch.from_arrays([row, ident, pa.array(n), *none], names=names)
                hashes, raw = part.word_hashes(), part.buf.tobytes()
                for g in grams:
                    doc, spot, value = shingled(part, hashes, g)
                    live = np.flatnonzero(marked(value, bits))
                    for a in range(0, len(live), 4096):
                        some = live[a:a + 4096]
                        d, p = doc[some], spot[some]
                        first, low = part.first[d], np.maximum(p - (width - g), 0)
                        high = np.minimum(p + width, n[d])
                        around = [b" ".join(raw[part.starts[x]:part.ends[y - 1]].split()).decode() for x, y in zip(first + low, first + high)]
                        who = pa.array(d)
                        cols = [row.take(who), ident.take(who), pa.array(n[d]), pa.array(value[some].view(np.int64)), pa.array(p), pa.array((p - low).astype(np.int32)), pa.array(around, pa.string())]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return numbered.mapInArrow(run, MET)


def occurrences(docs: DataFrame, items: DataFrame, scratch: Scratch, width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, n_words) of all documents, (row, window_id, start, size) of item windows in them,
    and (window_id, item_id). Runs jobs."""
    all_windows = scratch.keep(item_windows(items, width, gram).distinct())
    # one row per different text of a window
    distinct = scratch.keep(all_windows.select("window", "n_words", "shingles", "grams").distinct().withColumn("window_id", F.monotonically_increasing_id()))
    of_item = all_windows.select("item_id", "window").join(distinct.select("window", "window_id"), "window").select("window_id", "item_id").distinct()
    parts = distinct.select("window_id", F.posexplode("shingles").alias("offset", "shingle"), F.element_at("grams", 1).alias("gram"))
    grams = sorted(r["gram"] for r in parts.select("gram").distinct().collect())
    counted = scratch.keep(rarity(docs, bit_map(parts, "shingle"), grams))
    # left: a shingle that never occurs is the rarest of its windows and ends them
    ranked = parts.join(counted, "shingle", "left").select("window_id", "shingle", "offset", F.coalesce("n", F.lit(0)).alias("n"))
    prefix = scratch.keep(ranked.groupBy("window_id").agg(F.min(F.struct("n", "shingle", "offset")).alias("p")).filter("p.n > 0")
                          .select("window_id", "p.shingle", "p.offset").join(distinct.select("window_id", "window", "n_words"), "window_id"))
    met = scratch.keep(probes(docs, bit_map(prefix, "shingle"), grams, width))
    places = met.filter("shingle is not null").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    wide = prefix.withColumnRenamed("n_words", "size").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    start = F.col("at") - F.col("offset")
    joined = places.join(wide, ["shingle", "salt"]).filter((start >= 0) & (start + F.col("size") <= F.col("n_words")) & (F.col("offset") <= F.col("before")))
    here = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.col("size")), " ")
    hits = joined.filter(here == F.col("window")).select("row", "window_id", start.alias("start"), F.col("size").cast("long").alias("size"))
    return met.filter("shingle is null").select("row", "doc_id", "n_words"), scratch.keep(hits), of_item


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside item windows), items (sorted as strings). Runs jobs."""
    scratch = Scratch(docs.sparkSession)
    rows, hits, of_item = occurrences(docs, items, scratch, width, gram)
    # the farthest end before each start, in order of starts; one row per place
    spans = hits.groupBy("row", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    gain = F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = spans.withColumn("gain", F.greatest(gain, F.lit(0))).groupBy("row").agg(F.sum("gain").alias("n_hit"))
    sets = scratch.keep(hits.groupBy("row").agg(F.array_sort(F.collect_set("window_id")).alias("windows")))
    kinds = sets.select("windows").distinct()
    named = kinds.select("windows", F.explode("windows").alias("window_id")).join(of_item, "window_id").groupBy("windows").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    of_row = spread_join(sets, named, ["windows"], "row", salts=SALTS).select("row", "items").join(covered, "row")
    return scratch.result(rows.join(of_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")))
