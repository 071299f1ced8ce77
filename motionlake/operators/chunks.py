"""Ordered computation that never gathers one key in one task.

Frames are laid out by (episode, chunk of consecutive frames). Bounded windows run inside a
chunk plus a few neighbour frames; unbounded running values are a local scan plus a prefix
over one summary row per chunk; exact percentiles sort only the value bucket that holds the
wanted rank. Every function is lazy unless it says that it runs jobs.
"""

import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.schema import CHUNK, EP, HALO, SALTS


# ---------------------------------------------------------------- lineage

def shared_folder(spark) -> str:
    """The folder the session names for cut lineage; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="spark-lineage-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage: write the rows as parquet in the shared folder and read them back.

    Runs a job. Later branches read only the columns they need, and a lost executor costs no
    recomputation. On a cluster ``spark.checkpoint.dir`` must be set.

    Spark judges a table by the bytes of its files, and encoded columns take far fewer than their rows do in
    memory: millions of frames pass for a few MB and are collected by the driver to be broadcast. So the rows
    are counted from the footers, and a table of more than ``BROADCAST_BYTES`` is joined by sorting.
    """
    return joined_by_size(_stored(df))


def joined_by_size(stored: DataFrame) -> DataFrame:
    """Rows of files, kept from being broadcast where they are many."""
    return stored.hint("merge") if _size(stored) > BROADCAST_BYTES else stored


def lookup(df: DataFrame) -> DataFrame:
    """Store a table that many rows look up: broadcast where its counted rows are few, else joined by sorting. Runs a job."""
    back = _stored(df)
    return F.broadcast(back) if _size(back) <= BROADCAST_BYTES else back.hint("merge")


#: Bytes of rows in memory beyond which a stored table is never broadcast.
BROADCAST_BYTES = 4 << 20


def _stored(df: DataFrame) -> DataFrame:
    folder = shared_folder(df.sparkSession)
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _size(stored: DataFrame) -> int:
    """Bytes of stored rows in memory, about: a word per column, five for one that is no number."""
    numbers = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")
    return stored.count() * (8 + sum(8 if t in numbers else 40 for _, t in stored.dtypes))


# ---------------------------------------------------------------- chunk layout

def chunk_of(frame="frame_index", size: int = CHUNK) -> Column:
    return F.floor(F.col(frame) / size).cast("long")


def chunked(frames: DataFrame, size: int = CHUNK, halo: int = HALO, order: str = "frame_index") -> DataFrame:
    """Add ``_chunk`` and copy border frames to the neighbour chunk (``_own`` = false there)."""
    home = chunk_of(order, size)
    offset = F.col(order) % size
    homes = F.array_compact(F.array(
        home,
        F.when((offset < halo) & (home > 0), home - 1),
        F.when(offset >= size - halo, home + 1),
    ))
    return (frames.withColumn("_chunk", F.explode(homes))
            .withColumn("_own", F.col("_chunk") == home))


def by_frame(order: str = "frame_index", keys=EP):
    """Window over one chunk, halo included."""
    return Window.partitionBy(*keys, "_chunk").orderBy(order)


def own(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own")


def attach(df: DataFrame, scalars: DataFrame, columns, keys=EP, size: int = CHUNK, how: str = "inner") -> DataFrame:
    """Join per-episode scalars (with ``n_frames``) to chunked frames on (episode, chunk).

    The scalars are repeated once per chunk, so no join key carries a whole episode.
    """
    wide = scalars.select(
        *keys, *columns,
        F.explode(F.sequence(F.lit(0).cast("long"),
                             F.floor((F.greatest(F.col("n_frames"), F.lit(1)) - 1) / size).cast("long"))).alias("_chunk"))
    return df.join(wide, [*keys, "_chunk"], how)


def spread_join(rows: DataFrame, stats: DataFrame, keys, salt_on="episode_index", how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join one small row per key to many rows of that key, over ``salts`` partitions per key."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)).cast("int"))
    right = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def keyed_join(rows: DataFrame, stats: DataFrame, keys, salt_on="episode_index", how: str = "inner") -> DataFrame:
    """Join one row per key to many: few ``stats`` are broadcast and the rows stay where they are, else ``spread_join``. Runs a job."""
    back = _stored(stats)
    return rows.join(F.broadcast(back), keys, how) if _size(back) <= BROADCAST_BYTES else spread_join(rows, back.hint("merge"), keys, salt_on, how)


def episode_lengths(frames: DataFrame, keys=EP) -> DataFrame:
    return frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"))


# ---------------------------------------------------------------- scans

_OPS = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def scan(df: DataFrame, keys, chunk, order, exclusive=None, **aggs) -> DataFrame:
    """Running sum/max/min over a whole key.

    ``aggs``: output name -> (op, expression). ``chunk`` must not decrease along ``order``.
    Local running value inside (key, chunk) plus a prefix over the chunk summaries, one row
    per chunk. Names in ``exclusive`` leave the current row out.
    """
    exclusive = set(exclusive or ())
    order = [order] if isinstance(order, (str, Column)) else list(order)
    chunk = F.col(chunk) if isinstance(chunk, str) else chunk
    df = df.withColumn("_sc", chunk)
    base = Window.partitionBy(*keys, "_sc").orderBy(*order)
    upto, before = base.rowsBetween(Window.unboundedPreceding, 0), base.rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[
        _OPS[op][0](expr).over(before if name in exclusive else upto).alias(f"_l_{name}")
        for name, (op, expr) in aggs.items()])
    summary = df.groupBy(*keys, "_sc").agg(*[_OPS[op][0](expr).alias(f"_t_{name}") for name, (op, expr) in aggs.items()])
    prior = Window.partitionBy(*keys).orderBy("_sc").rowsBetween(Window.unboundedPreceding, -1)
    prefix = summary.select(*keys, "_sc", *[
        _OPS[op][0](f"_t_{name}").over(prior).alias(f"_p_{name}") for name, (op, _) in aggs.items()])
    joined = local.join(prefix, [*keys, "_sc"])
    out = []
    for name, (op, _) in aggs.items():
        a, b = F.col(f"_p_{name}"), F.col(f"_l_{name}")
        if op == "sum":
            out.append(F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b).alias(name))
        else:
            out.append(_OPS[op][1](a, b).alias(name))
    kept = [x for x in df.columns if x != "_sc"]
    return joined.select(*kept, *out)


def numbered(df: DataFrame, keys, order, chunk, name="rn") -> DataFrame:
    """0-based row number over a whole key, as a two-level scan."""
    return scan(df, keys, chunk, order, **{name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1)


# ---------------------------------------------------------------- exact order statistics

def value_bucket(v, per_e: int = 64) -> Column:
    """Monotone bucket of a double: sign and logarithm, at most ~190k distinct values."""
    v = F.col(v) if isinstance(v, str) else v
    shift = 800 * per_e
    return (F.when(v == 0, F.lit(0).cast("long"))
            .when(v > 0, (F.floor(F.log(v) * per_e) + shift).cast("long"))
            .otherwise(-(F.floor(F.log(-v) * per_e) + shift).cast("long")))


#: Bits of a digit below the value bucket.
DIGIT = 16


def value_digits(v, per_e: int = 64) -> Column:
    """Two digits of ``DIGIT`` bits inside the value bucket, monotone like it: (d1, d2).

    They are the next bits of the logarithm that the bucket is the whole part of. Doubles that share
    bucket and both digits are at most 2^14 different ones.
    """
    v = F.col(v) if isinstance(v, str) else v
    base = F.lit(float(1 << DIGIT))
    fold = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    turn = lambda d: F.when(v > 0, d).otherwise((1 << DIGIT) - 1 - d).cast("int")
    rest = lambda y: y - F.floor(y)
    digits = fold(rest(F.log(F.abs(v)) * per_e) * base, lambda y: F.struct(turn(F.floor(y)).alias("d1"), turn(F.floor(rest(y) * base)).alias("d2")))
    return F.when(v != 0, digits).otherwise(F.struct(F.lit(0).alias("d1"), F.lit(0).alias("d2")))


def _located(counts: DataFrame, inside: list, digit: str, weight: Column, need, first: bool = False) -> DataFrame:
    """The digits of each group that hold a wanted rank, with the number of values before them."""
    held = counts.groupBy(*inside, digit, *([] if first else ["n", "_before"])).agg(F.sum(weight).alias("_c"))
    group = Window.partitionBy(*inside)
    before = F.lit(0) if first else F.col("_before")
    held = held.select(*inside, digit, "_c", (F.sum("_c").over(group) if first else F.col("n")).alias("n"),
                       (before + F.sum("_c").over(group.orderBy(digit).rowsBetween(Window.unboundedPreceding, 0))).alias("_cum"))
    return held.filter(need).select(*inside, digit, "n", (F.col("_cum") - F.col("_c")).alias("_before"))


#: Values of a key up to which they are sorted in one row.
IN_ROW = 1 << 12


def order_stats(df: DataFrame, keys, value, picks) -> DataFrame:
    """Exact interpolated order statistics per key. Runs jobs.

    ``picks``: output name -> function of the group size giving a 0-based fractional rank
    (see ``vectors.pct``). The result also carries ``n`` (non-null values).

    Keys are counted first. Up to ``IN_ROW`` values are sorted in a row; keys with more go through a radix selection.
    """
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, (v.cast("double") + F.lit(0.0)).alias("_v")).filter("_v is not null")
    large = lookup(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > IN_ROW).select(*keys))
    if large.isEmpty():
        return _sorted_stats(rows, keys, picks)
    same = reduce(and_, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    few = rows.alias("a").join(large.alias("b"), same, "left_anti")
    many = rows.alias("a").join(large.alias("b"), same, "left_semi")
    return _sorted_stats(few, keys, picks).unionByName(_radix_stats(many, keys, picks))


def _between(picks, at) -> list[Column]:
    """Interpolated values of the picks; ``at`` gives the value of a pick's side and rank."""
    cols = []
    for name, rank in picks.items():
        h = rank(F.col("n"))
        lo, hi = at(name, "lo", F.floor(h)), at(name, "hi", F.least(F.floor(h) + 1, F.col("n") - 1))
        cols.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return cols


def _sorted_stats(rows: DataFrame, keys, picks) -> DataFrame:
    """``order_stats`` of keys whose values fit a row."""
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("_v")).alias("_s")).withColumn("n", F.size("_s").cast("long"))
    return held.select(*keys, "n", *_between(picks, lambda name, side, r: F.get("_s", r.cast("int"))))


def column_stats(df: DataFrame, keys, picks, **aggs) -> DataFrame:
    """Exact interpolated order statistics of several columns per key, with plain aggregates beside them. Runs jobs.

    ``picks``: output name -> (column, function of the number of its non-null values giving a 0-based fractional rank).
    Keys of up to ``IN_ROW`` rows give all of it in one grouping; only larger ones meet ``order_stats``, a row per column.
    """
    keys = list(keys)
    columns = sorted({column for column, _ in picks.values()})
    value = {column: F.col(column).cast("double") + F.lit(0.0) for column in columns}
    large = lookup(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > IN_ROW).select(*keys))

    def in_row(rows):
        out = rows.groupBy(*keys).agg(*[e.alias(f"_a_{n}") for n, e in aggs.items()], *[F.array_sort(F.collect_list(value[c])).alias(f"_s_{c}") for c in columns])
        for name, (c, rank) in picks.items():
            sized = out.withColumn("n", F.size(f"_s_{c}").cast("long"))
            out = sized.withColumn(name, _between({name: rank}, lambda _n, _side, r: F.get(f"_s_{c}", r.cast("int")))[0]).drop("n")
        return out.select(*keys, *[F.col(f"_a_{n}").alias(n) for n in aggs], *picks)

    if large.isEmpty():
        return in_row(df)
    same = reduce(and_, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    many = df.alias("a").join(large.alias("b"), same, "left_semi")
    tall = many.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("_name"), value[c].alias("_x")) for c in columns])))
    found = order_stats(tall, [*keys, "_name"], "_x", {name: rank for name, (_, rank) in picks.items()})
    found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == c, F.col(name))).alias(name) for name, (c, _) in picks.items()])
    wide = many.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()]).join(found, keys, "left").select(*keys, *aggs, *picks)
    return in_row(df.alias("a").join(large.alias("b"), same, "left_anti")).unionByName(wide)


def _radix_stats(rows: DataFrame, keys, picks) -> DataFrame:
    """``order_stats`` of keys of any size, by radix selection.

    1. A histogram of (key, bucket), combined before the shuffle, locates the ranks; its rows per key are bounded.
    2. Values of the located buckets become (value, count) rows: equal values are one row.
    3. Two rounds of digit counts, at most 2^``DIGIT`` rows a group, narrow them; only values that share both digits
       are sorted, at most 2^14 different ones.
    """
    rows = rows.withColumn("_b", value_bucket("_v"))
    need = F.lit(False)
    for rank in picks.values():
        low = F.floor(rank(F.col("n")))
        need = need | ((F.col("_cum") > low) & (F.col("_cum") - F.col("_c") <= F.least(low + 1, F.col("n") - 1)))
    located = lookup(_located(rows, keys, "_b", F.lit(1), need, first=True))
    counts = rows.join(located, [*keys, "_b"]).groupBy(*keys, "_b", "_v", "n", "_before").agg(F.count(F.lit(1)).alias("_m"))
    counts = counts.withColumn("_d", value_digits("_v")).select(*keys, "_b", "_v", "n", "_before", "_m", "_d.d1", "_d.d2")
    inside = [*keys, "_b"]
    for digit in ("d1", "d2"):
        narrow = _located(counts, inside, digit, F.col("_m"), need)
        counts = counts.drop("n", "_before").join(narrow, [*inside, digit])
        inside.append(digit)
    along = Window.partitionBy(*inside).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_hi", F.col("_before") + F.sum("_m").over(along)).withColumn("_lo", F.col("_hi") - F.col("_m"))
    aggs = [F.first("n").alias("n")]
    for name, rank in picks.items():
        h = rank(F.col("n"))
        for side, r in (("lo", F.floor(h)), ("hi", F.least(F.floor(h) + 1, F.col("n") - 1))):
            aggs.append(F.max(F.when((F.col("_lo") <= r) & (F.col("_hi") > r), F.col("_v"))).alias(f"_{name}_{side}"))
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "n", *_between(picks, lambda name, side, r: F.col(f"_{name}_{side}")))


# ---------------------------------------------------------------- runs and greedy picks

def runs(df: DataFrame, mask: Column, keys=EP, size: int = CHUNK, frame: str = "frame_index") -> DataFrame:
    """Maximal runs of true frames: (key, start, end exclusive, length).

    A true frame belongs to the run that starts after the last false frame before it.
    """
    marked = df.select(*keys, frame, F.coalesce(mask, F.lit(False)).alias("_m"))
    found = scan(marked, keys, chunk_of(frame, size), frame,
                 _false=("max", F.when(~F.col("_m"), F.col(frame))))
    return (found.filter("_m")
            .groupBy(*keys, (F.coalesce(F.col("_false"), F.lit(-1)) + 1).alias("start"))
            .agg((F.max(frame) + 1).alias("end"), F.count(F.lit(1)).alias("length")))


def merge_ranges(ranges: DataFrame, gap: int, keys=EP, size: int = CHUNK, extra=None) -> DataFrame:
    """Merge ranges whose start lies less than ``gap`` after the previous end. Runs jobs."""
    extra = extra or {}
    ranges = materialise(ranges)
    prev = materialise(scan(ranges, keys, chunk_of("start", size), "start", exclusive=["_prev"], _prev=("max", F.col("end"))))
    fresh = F.when(F.col("_prev").isNull() | (F.col("start") - F.col("_prev") >= gap), F.col("start"))
    marked = scan(prev, keys, chunk_of("start", size), "start", _head=("max", fresh))
    return (marked.groupBy(*keys, F.col("_head").alias("_start"))
            .agg(F.max("end").alias("end"), *[e.alias(n) for n, e in extra.items()])
            .withColumnRenamed("_start", "start"))


def entry_states(maps: DataFrame, k: int, keys=EP, size: int = CHUNK, fan: int = 64) -> DataFrame:
    """(key, _chunk, _entry): the state each chunk is entered with, from (key, _chunk, _exit). Runs a job.

    ``_exit`` gives for each entry state 0..k-1 the state a chunk is left with; a state is the number of frames that
    stay blocked and falls by one a frame where no chunk stands. Maps of up to ``fan`` neighbours compose to the map
    of a node, those to the map of a wider node, up to one per key; entries then go down the same tree.
    No row holds more than ``fan`` maps, however long the key.
    """
    long = lambda x: F.lit(x).cast("long")
    fall = lambda s, gap: F.greatest(s - gap, long(0))
    through = lambda m, s: F.element_at(m, (s + 1).cast("int"))
    top = maps.agg(F.max("_chunk")).first()[0] or 0
    begin, end = F.col("_up") * fan, (F.col("_up") + 1) * fan

    def entered_with(acc, x, width):
        return fall(acc["s"], (x["_node"] - acc["at"]) * width)

    def composition(width):
        def step(acc, x):
            return F.struct((x["_node"] + 1).alias("at"), through(x["_map"], entered_with(acc, x, width)).alias("s"))

        return lambda s: F.aggregate("_l", F.struct(begin.alias("at"), s.alias("s")), step, lambda acc: fall(acc["s"], (end - acc["at"]) * width))

    def entries(width):
        def step(acc, x):
            s = entered_with(acc, x, width)
            return F.struct((x["_node"] + 1).alias("at"), through(x["_map"], s).alias("s"), F.array_append(acc["o"], F.struct(x["_node"].alias("_node"), s.alias("_entry"))).alias("o"))

        first = F.struct(begin.alias("at"), F.col("_s").alias("s"), F.array().cast("array<struct<_node:bigint,_entry:bigint>>").alias("o"))
        return F.inline(F.aggregate("_l", first, step, lambda acc: acc["o"]))

    levels, span, last = [maps.select(*keys, F.col("_chunk").alias("_node"), F.col("_exit").alias("_map"))], size, top
    parents = []
    while True:
        node = F.floor(F.col("_node") / fan).cast("long")
        group = levels[-1].groupBy(*keys, node.alias("_up")).agg(F.array_sort(F.collect_list(F.struct("_node", "_map"))).alias("_l"))
        parents.append((group, span))
        last //= fan
        if not last:
            break
        composed = group.select(*keys, F.col("_up").alias("_node"), F.transform(F.sequence(long(0), long(k - 1)), composition(span)).alias("_map"))
        levels.append(materialise(composed))
        span *= fan
    entered = None
    for group, width in reversed(parents):
        # a key enters its widest node with nothing blocked
        start = group.withColumn("_s", long(0)) if entered is None else group.join(entered.withColumnsRenamed({"_node": "_up", "_entry": "_s"}), [*keys, "_up"])
        entered = start.select(*keys, entries(width))
    return entered.withColumnRenamed("_node", "_chunk")


def greedy_min_gap(candidates: DataFrame, k: int, keys=EP, frame: str = "frame_index", size: int = CHUNK, fan: int = 64) -> DataFrame:
    """Keep a frame only if it is at least ``k`` after the last kept one: (key, frame). Runs jobs.

    The only state crossing a chunk border is how many frames stay blocked (0..k-1), so each
    chunk is a map from entry to exit state, and maps compose (``entry_states``). A key's first chunk is
    entered with nothing blocked, so keys that end there need no maps.
    """
    cells = materialise(candidates.select(*keys, frame).groupBy(*keys, chunk_of(frame, size).alias("_chunk"))
                        .agg(F.array_sort(F.collect_set(frame)).alias("_f")))
    first, after = F.col("_chunk") * size, (F.col("_chunk") + 1) * size

    long = materialise(cells.filter(F.col("_chunk") > 0).select(*keys).distinct())
    if long.isEmpty():
        joined = cells.withColumn("_entry", F.lit(0).cast("long"))
    else:
        exits = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), lambda entry: F.greatest(
            F.aggregate(F.col("_f"), first + entry, lambda b, f: F.when(f >= b, f + k).otherwise(b)) - after, F.lit(0)))
        maps = materialise(cells.join(long, keys, "left_semi").select(*keys, "_chunk", exits.alias("_exit")))
        joined = cells.join(entry_states(maps, k, keys, size, fan), [*keys, "_chunk"], "left").withColumn("_entry", F.coalesce("_entry", F.lit(0).cast("long")))
    kept = F.aggregate(
        F.col("_f"), F.struct((first + F.col("_entry")).alias("b"), F.array().cast("array<bigint>").alias("o")),
        lambda acc, f: F.when(f >= acc["b"], F.struct((f + k).alias("b"), F.array_append(acc["o"], f).alias("o"))).otherwise(acc),
        lambda acc: acc["o"])
    return joined.select(*keys, F.explode(kept).alias(frame))


def interval_rows(frames: DataFrame, ranges: DataFrame, start: str, end: str, columns, keys=EP,
                  size: int = CHUNK, frame: str = "frame_index") -> DataFrame:
    """Frames inside half-open ranges, as an equi join on (key, chunk).

    ``frames`` must carry ``_chunk``; each range is repeated once per chunk it touches.
    """
    wide = ranges.filter(F.col(end) > F.col(start)).select(
        *keys, *columns, F.col(start).alias("_a"), F.col(end).alias("_z"),
        F.explode(F.sequence(F.floor(F.col(start) / size).cast("long"),
                             F.floor((F.col(end) - 1) / size).cast("long"))).alias("_chunk"))
    hit = frames.join(wide, [*keys, "_chunk"])
    return hit.filter((F.col(frame) >= F.col("_a")) & (F.col(frame) < F.col("_z")))
