"""Operator 9: removal of repeated byte strings by suffix arrays with two-stage sorting.

A string of ``width`` bytes that starts in two or more places, in one document or several, is
removed in all of them.

1. Of every ``width`` - ``gram`` + 1 neighbouring grams of ``gram`` bytes the one with the
   least hash is an anchor (the last of equals). Two equal strings choose the same anchor at the
   same place, so a string can repeat only around an anchor gram that occurs twice.
2. The snippet around an anchor holds every string that chose it. Equal snippets with one
   anchor are one entry with a count; anchors with a single entry need no sorting: its strings
   repeat if its count is above one.
3. The snippets of any other anchor form a suffix array: suffixes smaller than their
   successor are sorted directly, the rest is induced from them by scans of the byte buckets,
   and adjacent common prefixes of ``width`` bytes or more mark the starts that repeat.
4. Marked starts are joined into runs per document, and their bytes removed.

An anchor with more than ``BLOCK`` snippets is split by how far into a string it lies: the strings of
a range of such distances all hold the stretch from the range's last start to its first end, so
snippets are cut to the range and grouped by a second anchor, that stretch. Snippets that are equal
once cut are one entry. Groups that are still too large are split again; a range of one distance is a single
string, so this ends, and every group but those of one entry goes through a suffix array. Only ranges
at the edge of a common passage stay large for a few rounds. Anchors, stretches and snippet digests are
compared by hash (a stretch that collides only joins two groups), suffixes by their bytes.

Defined cases: null text is empty; texts below ``width`` bytes stay; copies of a row count as
other places, also with the same id; rows without an id take part like others; an empty table
gives no rows; other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import Scratch, likely, small_batches
from motionlake.llm.exchange import runs
from motionlake.llm.textnum import mix, powers, slices, spans
from motionlake.operators.chunks import spread_join

#: BLOCK snippets are about one suffix array (LOAD); a large range of distances is split FAN-fold.
WIDTH, GRAM, BLOCK, FAN = 400, 128, 512, 8

ANCHORS = "id bigint, key bigint, anchor bigint, snippet bigint, low bigint, high bigint, place int"

#: Bits of a place beside its hash; longer texts are looked at in steps of half of that.
_BITS = 24


def chosen(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of the places with the least value of a window.

    Windows are ``width`` neighbouring values; of equal values the last counts. The place moves
    forward with the window, so the windows that chose a place stand together.
    """
    n, step = len(values) - width + 1, 1 << (_BITS - 1)
    if n > step:
        found = []
        for a in range(0, n, step):
            place, low, high = chosen(values[a:min(a + step, n) + width - 1], width)
            found.append((place + a, low + a, high + a))
        return tuple(np.concatenate(x) for x in zip(*found))
    mask = np.uint64(2**_BITS - 1)
    keyed = (values & ~mask) | (mask - np.arange(len(values), dtype=np.uint64))
    grid = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:len(values)] = keyed
    grid = grid.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[width - 1:width - 1 + n])
    low = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return (mask - (least[low] & mask)).astype(np.int64), low, np.concatenate([low[1:], [n]]) - 1


def anchors(texts: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """ANCHORS of (id, key, text): bytes low to high + ``width`` hold the strings that chose the anchor."""
    reach = width - gram + 1

    def run(batches):
        for batch in batches:
            rows, found, low, high, snippet, places = [], [], [], [], [], []
            for at, part in slices(batch.column(2)):
                buf, edges, here = part.buf, part.edges, []
                n = max(len(buf) - gram + 1, 0)
                every = spans(buf, np.arange(n), np.arange(n) + gram, 0)
                for k in np.flatnonzero(np.diff(edges) >= width):
                    place, a, z = chosen(every[edges[k]:edges[k + 1] - gram + 1], reach)
                    here.append((np.full(len(place), k), every[edges[k] + place], a, z, place))
                if not here:
                    continue
                k, value, a, z, place = (np.concatenate(x) for x in zip(*here))
                s, e = a + edges[k], z + edges[k] + width
                # the place of the anchor belongs to the digest, so that equal digests mean equal starts
                snippet.append(mix(spans(buf, s, e, 0) ^ mix(spans(buf, s, e, 1) + (place - a).astype(np.uint64))))
                rows.append(k + at)
                found.append(value)
                low.append(a)
                high.append(z)
                places.append((place - a).astype(np.int32))
            if rows:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(found).view(np.int64)),
                     pa.array(np.concatenate(snippet).view(np.int64)), pa.array(np.concatenate(low)), pa.array(np.concatenate(high)), pa.array(np.concatenate(places))],
                    names=["id", "key", "anchor", "snippet", "low", "high", "place"])

    return texts.mapInArrow(run, ANCHORS)


# ---------------------------------------------------------------- suffix array of a few snippets

def two_stage(data: np.ndarray, width: int) -> np.ndarray:
    """Suffix array of whole numbers whose last is the only and least end mark (0).

    Order counts to ``width`` symbols. Stage one sorts the suffixes smaller than their
    successor (type S) directly; stage two scans the buckets of first symbols in rising order and puts
    before each scanned suffix its predecessor, if that is larger than its successor.
    """
    n = len(data)
    small = np.zeros(n, bool)
    # type S: smaller symbol than the next, or equal and the next is of type S
    rise, same = data[:-1] < data[1:], data[:-1] == data[1:]
    decided = np.flatnonzero(~same)
    nearest = np.searchsorted(decided, np.arange(n - 1))
    small[:-1] = np.where(nearest < len(decided), rise[decided[np.minimum(nearest, max(len(decided) - 1, 0))]] if len(decided) else False, False)
    small[-1] = True
    direct = np.flatnonzero(small)
    direct = direct[order_suffixes(data, direct, width)]
    # buckets: larger suffixes of a symbol stand before its smaller ones
    symbols = np.unique(data)
    induced: dict = {int(c): [] for c in symbols}
    direct_of = {int(c): direct[a:b] for c, a, b in _groups(data[direct])}
    out = []
    for c in map(int, symbols):
        front, wave = induced.pop(c), None
        wave = np.concatenate(front) if front else np.zeros(0, np.int64)
        lines = []
        while len(wave):
            lines.append(wave)
            wave = _induce(data, small, wave, c, induced)
        back = direct_of.get(c, np.zeros(0, np.int64))
        _induce(data, small, back, None, induced)
        out += [*lines, back]
    return np.concatenate(out)


def _groups(values: np.ndarray):
    first, _ = runs(values)
    return [(values[a], a, b) for a, b in zip(first, [*first[1:], len(values)])]


def _induce(data, small, scanned, own, induced) -> np.ndarray:
    """Predecessors larger than their successor go, in order, to the bucket of their symbol; those of ``own`` are returned."""
    before = scanned[scanned > 0] - 1
    before = before[~small[before]]
    symbol = data[before]
    mine = before[symbol == own] if own is not None else before[:0]
    rest = before[symbol != own] if own is not None else before
    order = np.argsort(data[rest], kind="stable")
    rest = rest[order]
    for c, a, b in _groups(data[rest]):
        induced[int(c)].append(rest[a:b])
    return mine


def order_suffixes(data: np.ndarray, chosen_: np.ndarray, width: int) -> np.ndarray:
    """Order of the chosen suffixes by their first ``width`` symbols, sorted directly.

    Seven symbols are compared at a time; only groups that are still equal and whose strings
    of ``width`` symbols differ go on. (Induced suffixes are then in order to that depth, too.)
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64), np.zeros(7, np.uint64)])
    seven = np.zeros(n, np.uint64)
    for j in range(7):
        seven = seven * np.uint64(512) + padded[j:j + n]
    strings = string_hashes(data, width)[chosen_]
    first = seven[chosen_]
    order = np.argsort(first, kind="stable")
    new = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    depth = 7
    # suffixes that are still equal to a neighbour, as runs of places in the order
    open_, group = np.arange(len(order)), np.cumsum(new) - 1
    while depth < width:
        starts, _ = runs(group)
        text = strings[order[open_]]
        differ = np.minimum.reduceat(text, starts) != np.maximum.reduceat(text, starts)
        stay = np.repeat(differ, np.diff(np.append(starts, len(group))))
        open_, group = open_[stay], group[stay]
        if not len(open_):
            break
        place = chosen_[order[open_]] + depth
        key = np.where(place < n, seven[np.minimum(place, n - 1)], np.uint64(0))
        again = np.lexsort((key, group))
        order[open_] = order[open_][again]
        key = key[again]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        group = np.cumsum(fresh) - 1
        depth += 7
    return order


def string_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the (at most) ``width`` symbols from each place."""
    n = len(data)
    up, down = powers(n + 1, 0)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(data.astype(np.uint64) + np.uint64(7)) * up[:n])])
    to = np.minimum(np.arange(n) + width, n)
    return mix((run[to] - run[:n]) * down[:n] + (to - np.arange(n)).astype(np.uint64))


def common_prefixes(data: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Whether each suffix and the one before it in order share ``width`` symbols."""
    text = string_hashes(data, width)[order]
    out = np.zeros(len(order), bool)
    alike = np.flatnonzero(text[1:] == text[:-1])
    views = np.lib.stride_tricks.sliding_window_view(data, width)
    a, b = order[alike], order[alike + 1]
    whole = np.maximum(a, b) < len(views)
    alike, a, b = alike[whole], a[whole], b[whole]
    for k in range(0, len(alike), 4096):
        out[alike[k:k + 4096] + 1] = (views[a[k:k + 4096]] == views[b[k:k + 4096]]).all(axis=1)
    return out


def repeated_starts(snippets: list[bytes], counts: list[int], width: int) -> list[np.ndarray]:
    """Starts in each snippet whose string of ``width`` bytes starts at another place of the list.

    A snippet with a count above one stands for several places.
    """
    lengths = np.array([len(s) for s in snippets])
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    # symbols: end of all 0, end of a snippet 1, bytes from 2
    data = np.ones(int((lengths + 1).sum()) + 1, np.uint16)
    for a, s in zip(begin, snippets):
        data[a:a + len(s)] = np.frombuffer(s, np.uint8).astype(np.uint16) + 2
    data[-1] = 0
    order = two_stage(data, width)
    near = common_prefixes(data, order, width)
    owner = np.repeat(np.arange(len(snippets)), lengths + 1)
    inside = np.zeros(len(data), bool)
    for a, n in zip(begin, lengths):
        inside[a:a + max(n - width + 1, 0)] = True
    near[1:] &= inside[order[1:]] & inside[order[:-1]]
    twice = near.copy()
    twice[:-1] |= near[1:]
    hit = np.zeros(len(data), bool)
    hit[order] = twice
    many = np.array([c > 1 for c in counts])
    hit[:-1] |= inside[:-1] & many[owner]
    return [np.flatnonzero(hit[a:a + n]) for a, n in zip(begin, lengths)]


# ---------------------------------------------------------------- the whole table

CUT = "id bigint, key bigint, doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
SNIPPETS = "anchor bigint, snippet bigint, n bigint, place int, bytes binary"
MARKED = "group bigint, piece bigint, marks array<bigint>"
#: Bytes of snippets in one suffix array.
LOAD = 1 << 18


def cut_out(near: DataFrame, width: int) -> DataFrame:
    """SNIPPETS asked for by ``wanted`` of (id, key, text, wanted)."""
    def run(batches):
        for batch in batches:
            out = [[] for _ in SNIPPET_TYPES]
            for at, part in slices(batch.column(2)):
                raw = part.buf.tobytes()
                for k, wanted in enumerate(batch.column(3).slice(at, len(part.edges) - 1)):
                    for x in wanted.as_py():
                        a = part.edges[k]
                        for c, v in zip(out, (x["anchor"], x["snippet"], x["n"], x["place"], raw[a + x["low"]:a + x["high"] + width])):
                            c.append(v)
                    if len(out[0]) > 5000:
                        yield _batch(out, SNIPPET_TYPES)
                        out = [[] for _ in SNIPPET_TYPES]
            yield _batch(out, SNIPPET_TYPES)

    return near.mapInArrow(run, SNIPPETS)


SNIPPET_TYPES = {"anchor": pa.int64(), "snippet": pa.int64(), "n": pa.int64(), "place": pa.int32(), "bytes": pa.binary()}
MARK_TYPES = {"group": pa.int64(), "piece": pa.int64(), "marks": pa.list_(pa.int64())}


def _batch(columns, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def sort_snippets(pieces: DataFrame, width: int, gram: int) -> DataFrame:
    """MARKED from (group, piece, n, place, bytes) in order of groups: starts that repeat, as alternating first and last.

    Whole groups are sorted together up to LOAD bytes.
    """
    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if size > LOAD and row[0] != last:
                    yield solve(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    def solve(rows):
        out = [[], [], []]
        live = np.flatnonzero(may_repeat(rows, width, gram))
        starts_of = dict(zip(live, repeated_starts([rows[i][4] for i in live], [rows[i][2] for i in live], width))) if len(live) else {}
        for k, (group, piece, n, _, text) in enumerate(rows):
            starts = starts_of.get(k, np.arange(len(text) - width + 1) if n > 1 else np.zeros(0, np.int64))
            if len(starts):
                for c, v in zip(out, (group, piece, _pairs(starts))):
                    c.append(v)
        return _batch(out, MARK_TYPES)

    return pieces.select("group", "piece", "n", "place", "bytes").mapInArrow(run, MARKED)


def split(pieces: DataFrame, width: int, fan: int = FAN) -> DataFrame:
    """Pieces cut to parts of their range of distances: the old (group, piece), the start of the part in it, and the new row."""
    step = F.ceil((F.col("high") - F.col("low") + 1) / fan).cast("int")
    parts = pieces.withColumn("a", F.explode(F.sequence("low", "high", step))).withColumn("b", F.least(F.col("a") + step - 1, "high"))
    # distances of the part that the piece holds
    parts = parts.withColumn("near", F.greatest("a", F.col("place") + width - F.length("bytes"))).withColumn("far", F.least("b", "place")).filter("near <= far")
    stretch = F.substring("bytes", F.col("place") - F.col("a") + 1, F.col("a") - F.col("b") + width)
    text = F.substring("bytes", F.col("place") - F.col("far") + 1, F.col("far") - F.col("near") + width)
    parts = parts.select(
        F.col("group").alias("was"), F.col("piece").alias("of"), (F.col("place") - F.col("far")).alias("from"), F.xxhash64("group", "a", "b", stretch).alias("group"),
        F.col("a").alias("low"), F.col("b").alias("high"), "n", F.col("far").alias("place"), text.alias("bytes"))
    return parts.withColumn("piece", F.xxhash64("place", "bytes"))


def group_marks(snippets: DataFrame, scratch: Scratch, width: int, gram: int, block: int) -> DataFrame:
    """(anchor, snippet, marks) of SNIPPETS. Runs jobs; as many rounds as a range of distances can be split."""
    n_parts = int(snippets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = snippets.select(F.col("anchor").alias("group"), F.col("snippet").alias("piece"), "n", "place", "bytes", F.lit(0).alias("low"), F.lit(width - gram).alias("high"))
    members, out = None, []
    while True:
        hot = pieces.groupBy("group").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > block).select("group", F.lit(True).alias("hot"))
        told = scratch.keep(spread_join(pieces, hot, ["group"], "piece", how="left"))
        dealt = told.filter("hot is null").repartition(n_parts, "group").sortWithinPartitions("group")
        marks_ = scratch.keep(sort_snippets(dealt, width, gram))
        if members is None:
            out.append(marks_.select(F.col("group").alias("anchor"), F.col("piece").alias("snippet"), "marks"))
        else:
            # a piece may stand for many snippets
            owned = spread_join(members, marks_.hint("merge"), ["group", "piece"], "snippet")
            out.append(owned.select("anchor", "snippet", F.transform("marks", lambda m: m + F.col("base")).alias("marks")))
        large = told.filter("hot").drop("hot")
        if large.isEmpty():
            break
        parts = scratch.keep(split(large, width))
        step = parts.select("was", "of", "from", "group", "piece")
        if members is None:
            members = step.select(F.col("was").alias("anchor"), F.col("of").alias("snippet"), F.col("from").cast("long").alias("base"), "group", "piece")
        else:
            old = members.withColumnsRenamed({"group": "was", "piece": "of"})
            members = spread_join(old, step.hint("merge"), ["was", "of"], "snippet").select("anchor", "snippet", (F.col("base") + F.col("from")).alias("base"), "group", "piece")
        members = scratch.keep(members)
        same = parts.groupBy("group", "piece").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("place", "bytes", "low", "high")])
        pieces = scratch.keep(same)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every if len(out) == 1 else every.groupBy("anchor", "snippet").agg(F.flatten(F.collect_list("marks")).alias("marks"))


def may_repeat(rows, width: int, gram: int, steps: int = 4) -> np.ndarray:
    """Which snippets can hold a string of another snippet of their group.

    The anchor lies 0 to ``width`` - ``gram`` bytes into a string. For each of ``steps`` ranges of
    that distance all strings hold one stretch around the anchor; only snippets that share
    such a stretch need sorting. The rest have no string in common with others.
    """
    lengths = np.array([len(r[4]) for r in rows])
    begin = np.cumsum(lengths) - lengths
    buf = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    place = np.array([r[3] for r in rows], np.int64)
    group = mix(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    edges = np.linspace(0, width - gram, steps + 1).astype(np.int64)
    live = np.zeros(len(rows), bool)
    for near, far in zip(edges, edges[1:]):
        fits = np.flatnonzero((place >= near) & (place + width - far <= lengths))
        value = spans(buf, begin[fits] + place[fits] - near, begin[fits] + place[fits] + width - far) ^ group[fits]
        _, back, counts = np.unique(value, return_inverse=True, return_counts=True)
        live[fits[counts[back] > 1]] = True
    return live


def _pairs(starts: np.ndarray) -> list[int]:
    """Neighbouring starts as first, last, first, last, ..."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > 1]))
    return np.stack([starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)]], 1).ravel().tolist()


def cut(rows: DataFrame, width: int, with_text: bool = False) -> DataFrame:
    """CUT of (id, key, doc_id, text, marks): bytes of the marked strings removed."""
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for at, part in slices(batch.column(3)):
                raw, marks = part.buf.tobytes(), batch.column(4).slice(at, len(part.edges) - 1)
                for k in range(len(part.edges) - 1):
                    text, spans_ = raw[part.edges[k]:part.edges[k + 1]], 0
                    kept = text
                    if marks[k].is_valid:
                        edge = np.zeros(len(text) + 1, np.int64)
                        flat = np.concatenate([np.array(m["marks"], np.int64) + m["low"] for m in marks[k].as_py()])
                        np.add.at(edge, flat[0::2], 1)
                        np.add.at(edge, flat[1::2] + width, -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        spans_ = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    for c, v in zip(out, (len(text), len(text) - len(kept), spans_, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if with_text else None)):
                        c.append(v)
            cols = [*batch.columns[:3], *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.string())]
            names = ["id", "key", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array(out[4], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, CUT + (", kept string" if with_text else ""))


def marks(texts: DataFrame, scratch: Scratch, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, key, text) of texts with anchors that repeat, and (id, key, marks) of marked ones. Runs jobs."""
    every = scratch.keep(anchors(texts.select("id", "key", "text"), width, gram))
    entry = every.groupBy("anchor", "snippet").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "key", "low")).alias("of"))
    entry = scratch.keep(entry)
    shared = entry.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).filter("all > 1").select("anchor", "kinds")
    entry = scratch.keep(entry.join(shared, "anchor"))
    # copies of a row count in n, and are looked at once
    seen = scratch.keep(every.join(entry, ["anchor", "snippet"]).groupBy("id", "key", "low").agg(*[F.first(c).alias(c) for c in ("anchor", "snippet", "high", "place", "n", "of", "kinds")]))
    # of a snippet that several places share, the first place lends its bytes
    lends = (F.col("kinds") > 1) & (F.col("of.id") == F.col("id")) & (F.col("of.key") == F.col("key")) & (F.col("of.low") == F.col("low"))
    want = F.when(lends, F.struct("anchor", "snippet", "n", "low", "high", "place"))
    asked = scratch.keep(seen.groupBy("id", "key").agg(F.collect_list(want).alias("wanted")))
    near = likely(texts.select("id", "key", "text"), "key", asked, "key").join(asked, ["id", "key"])
    near = scratch.keep(near.groupBy("id", "key").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted")))
    snippets = scratch.keep(cut_out(near.filter(F.size("wanted") > 0), width))
    sorted_ = group_marks(snippets, scratch, width, gram, block)
    plain = entry.filter("kinds = 1 and n > 1").select("anchor", "snippet").withColumn("marks", F.lit(None).cast("array<bigint>"))
    found = seen.select("id", "key", "anchor", "snippet", "low", "high").join(sorted_.unionByName(plain), ["anchor", "snippet"])
    whole = F.array(F.lit(0).cast("long"), F.col("high") - F.col("low"))
    return near, scratch.keep(found.groupBy("id", "key").agg(F.collect_list(F.struct("low", F.coalesce("marks", whole).alias("marks"))).alias("marks")))


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept text). Runs jobs.

    A text is told from others by its id (the least number for none) and a hash. Texts without
    marks are digested where they are read; only texts around repeated anchors are shuffled.
    ``with_text`` drops half-cut characters from the text; the digest is over the bytes.
    """
    with small_batches(docs.sparkSession):
        return _dedup(docs, Scratch(docs.sparkSession), width, gram, block, with_text)


def _dedup(docs: DataFrame, scratch: Scratch, width: int, gram: int, block: int, with_text: bool) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("id"), F.xxhash64(text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    near, found = marks(texts, scratch, width, gram, block)
    if with_text:
        return scratch.result(cut(texts.join(found, ["id", "key"], "left").select("id", "key", "doc_id", "text", "marks"), width, True).drop("id", "key"))
    none = F.lit(None).cast("array<struct<low:bigint,marks:array<bigint>>>").alias("marks")
    whole = cut(texts.select("id", "key", "doc_id", "text", none), width)
    changed = cut(near.join(found, ["id", "key"]).select("id", "key", F.lit(None).cast("long").alias("doc_id"), "text", "marks"), width)
    changed = changed.select("id", "key", *[F.col(c).alias(f"_{c}") for c in ("n_removed", "n_spans", "kept_sha256")])
    return scratch.result(whole.join(changed, ["id", "key"], "left").select(
        "doc_id", "n_bytes", *[F.coalesce(f"_{c}", c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256")]))
