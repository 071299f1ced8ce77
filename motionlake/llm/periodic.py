"""Operator 12: periodic runs of words, by common extensions over a difference cover.

A run is a stretch of words with smallest period q, at least ``least`` words and ``times`` * q
long, that neither neighbour extends with the same period.

1. *Harmonic grid.* Where a run of period q lies, at least (``times`` - 1) * q neighbouring
   words equal the word q further on, so every ((``times`` - 1) * q)-th word is asked: how far do
   the texts at i and i + q agree, forwards and backwards. Over all q these are n * ln(n)
   questions; most end at the first word.
2. *Difference cover.* For any two places some shift below ``v`` brings both to places whose
   remainder modulo ``v`` is in the cover. The words before it are compared one by one; only
   questions that are still open need suffixes.
3. *Sampled suffixes.* Only suffixes at cover places are sorted: by their first ``v`` words,
   then by doubling, since a place plus v is a cover place again. Neighbours in order get their common
   prefix, and a sparse table gives the least over a range, the common prefix of any two.
4. The same on the reversed words answers backwards. A stretch found for several periods keeps
   the least, which divides the others.

Words are compared by 64-bit hashes, numbered densely inside a text. A text is handled by one
task; questions are asked in blocks of ``BLOCK``, so memory follows the longest text.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; rows of
any id, repeated or null, are handled one by one; other columns are not read (``find`` returns
them untouched if named in ``keep``); an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import let, words
from motionlake.llm.textnum import slices

LEAST, TIMES = 6, 4
#: Questions asked at once.
BLOCK = 1 << 19

#: Perfect difference sets (modulus, members); every remainder is a difference of two members.
COVERS = {21: (3, 6, 7, 12, 14), 133: (1, 11, 16, 40, 41, 43, 52, 60, 74, 78, 121, 128)}

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Cover:
    """A difference cover modulo ``v``, with the shift that brings two places to members."""

    def __init__(self, v: int):
        self.v, self.member = v, np.zeros(v, bool)
        self.member[list(COVERS[v])] = True
        #: for each difference d a member x whose x + d is a member, too
        self.anchor = np.zeros(v, np.int64)
        for x in COVERS[v]:
            for y in COVERS[v]:
                self.anchor[(y - x) % v] = x

    def shift(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.anchor[(b - a) % self.v] - a) % self.v


_COVERS: dict[int, Cover] = {}


def cover(n: int) -> Cover:
    """A denser cover for texts below 2^18 words, a thinner one (fewer suffixes) above."""
    v = 21 if n < 1 << 18 else 133
    if v not in _COVERS:
        _COVERS[v] = Cover(v)
    return _COVERS[v]


class Extensions:
    """How far a sequence of whole numbers agrees from two places on; suffixes are sorted when first needed."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.n, self.cover = symbols, len(symbols), cover(len(symbols))
        self.table = None

    def direct(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Words that agree from ``a`` < ``b``, at most ``limit``, one by one."""
        got, live, t = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(live):
            live = live[(limit[live] > t) & (b[live] + t < self.n)]
            live = live[self.symbols[a[live] + t] == self.symbols[b[live] + t]]
            t += 1
            got[live] = t
        return got

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from ``a`` and ``b`` (``a`` < ``b``)."""
        shift = self.cover.shift(a, b)
        got = self.direct(a, b, shift)
        open_ = np.flatnonzero((got == shift) & (b + shift < self.n))
        if len(open_):
            got[open_] += self.sampled(a[open_] + shift[open_], b[open_] + shift[open_])
        return got

    def sampled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for two cover places: the least common prefix between their ranks."""
        # most differ at once
        got = np.zeros(len(a), np.int64)
        alike = np.flatnonzero(self.symbols[a] == self.symbols[b])
        if not len(alike):
            return got
        if self.table is None:
            self.sort()
        x, y = self.rank[self.number[a[alike]]], self.rank[self.number[b[alike]]]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        got[alike] = np.minimum(self.table[level, low], self.table[level, high - (1 << level) + 1])
        return got

    def sort(self) -> None:
        """Ranks of cover suffixes and the sparse table of the common prefixes of neighbours."""
        n, v = self.n, self.cover.v
        places = np.flatnonzero(np.tile(self.cover.member, -(-n // v))[:n])
        m = len(places)
        self.number = np.full(n, -1, np.int64)
        self.number[places] = np.arange(m)
        step = int(self.cover.member.sum())  # the place v further on is that many cover places on
        dense = np.unique(self.symbols, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        bits = int(dense.max()).bit_length() if n else 1
        per = max(1, min(v, 63 // bits))
        padded = np.concatenate([dense, np.zeros(v + per, np.uint64)])
        order, group = np.arange(m), np.zeros(m, np.int64)
        open_ = np.arange(m)  # places in the order that still have an equal neighbour
        for depth in range(0, v, per):
            key = np.zeros(len(open_), np.uint64)
            for j in range(depth, min(depth + per, v)):
                key = (key << np.uint64(bits)) | padded[np.minimum(places[order[open_]] + j, n)]
            open_ = self._refine(order, group, open_, key)
        levels, reach = [self._ranks(order, group)], v
        while len(open_) and reach < n:
            last = levels[-1]
            far = order[open_] + step * (reach // v)
            key = np.where(far < m, last[np.minimum(far, m - 1)] + 1, 0).astype(np.uint64)
            open_ = self._refine(order, group, open_, key)
            levels.append(self._ranks(order, group))
            reach *= 2
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            both = np.flatnonzero((a < m) & (b < m))
            both = both[levels[k][a[both]] == levels[k][b[both]]]
            # a rank names a whole stretch only if it lies inside the text
            both = both[np.maximum(places[a[both]], places[b[both]]) + (v << k) <= n]
            shared[both] += v << k
            a[both] += step << k
            b[both] += step << k
        x, y = places[order[:-1]] + shared, places[order[1:]] + shared
        shared += self.direct(np.minimum(x, y), np.maximum(x, y), np.full(len(x), v, np.int64))
        rows = [np.concatenate([np.zeros(1, np.int64), shared]).astype(np.int32 if n < 2**31 else np.int64)]
        while 2 << (len(rows) - 1) <= m:
            last, half = rows[-1], 1 << (len(rows) - 1)
            row = last.copy()
            row[:m - half] = np.minimum(last[:m - half], last[half:])
            rows.append(row)
        self.table = np.stack(rows)

    @staticmethod
    def _refine(order, group, open_, key) -> np.ndarray:
        """Sort open places by (group, key) and split their groups; what still has an equal neighbour stays open."""
        if not len(open_):
            return open_
        again = np.lexsort((key, group[open_]))
        order[open_] = order[open_][again]
        key, old = key[again], group[open_]
        first = np.concatenate([[True], old[1:] != old[:-1]])
        fresh = first | np.concatenate([[True], key[1:] != key[:-1]])
        # a group is named by the place of its first member
        group[open_] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        last = np.concatenate([fresh[1:], [True]])
        return open_[~(fresh & last)]

    @staticmethod
    def _ranks(order, group) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = group
        return out


def grid(lengths: np.ndarray, first: np.ndarray, times: int):
    """Blocks of questions (place, period) of texts that begin at ``first``."""
    q_max = lengths // times
    rank = np.cumsum(q_max) - q_max
    total = int(q_max.sum())
    for a in range(0, total, BLOCK):
        at = np.arange(a, min(a + BLOCK, total))
        text = np.searchsorted(rank, at, "right") - 1
        q = at - rank[text] + 1
        step = (times - 1) * q
        counts = (lengths[text] - q - 1) // step + 1
        upto = np.cumsum(counts)
        low = 0
        while low < len(q):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + BLOCK, "right")))
            c = counts[low:high]
            # a single period may ask more than a block does
            for skip in range(0, int(c.max()), BLOCK) if high - low == 1 else (0,):
                some = np.minimum(c - skip, BLOCK) if high - low == 1 else c
                k = np.repeat(np.arange(low, high), some)
                nth = np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some) + skip
                yield first[text[k]] + nth * step[k], q[k], text[k]
            low = high


def find_runs(symbols: np.ndarray, edges: np.ndarray, least: int = LEAST, times: int = TIMES):
    """(text, start, length, period) of the runs of texts ``symbols[edges[k]:edges[k + 1]]``, by text, start, period."""
    lengths = np.diff(edges)
    fits = np.flatnonzero(lengths >= least)
    held, asked = [], {}
    for place, q, number in grid(lengths[fits], edges[fits], times):
        alike = symbols[place] == symbols[place + q]
        place, q, text = place[alike], q[alike], fits[number[alike]]
        # of (times - 1) * q agreeing places around this one, q - 1 lie on one side of it at least (for times above 2)
        far, near = place + q - 1, place - q + 1
        after = (far + q < edges[text + 1]) & (symbols[np.minimum(far, len(symbols) - 1)] == symbols[np.minimum(far + q, len(symbols) - 1)])
        before = (near >= edges[text]) & (symbols[np.maximum(near, 0)] == symbols[np.maximum(near + q, 0)])
        live = after | before if times > 2 else np.ones(len(place), bool)
        place, q, text = place[live], q[live], text[live]
        cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]])) if len(text) else []
        for a, z in zip(cuts, cuts[1:]):
            k = int(text[a])
            if k not in asked:
                part = symbols[edges[k]:edges[k + 1]]
                asked = {k: (Extensions(part), Extensions(part[::-1]))}
            forth, back = asked[k]
            i, p = place[a:z] - edges[k], q[a:z]
            ahead = forth.common(i, i + p)
            # words before i agree with words before i + p: in the reversed text the latter come first
            behind = back.common(back.n - (i + p), back.n - i)
            length = ahead + behind + p
            good = length >= np.maximum(least, times * p)
            if good.any():
                held.append(np.unique(np.stack([np.full(good.sum(), k), (i - behind)[good], length[good], p[good]], 1), axis=0))
    if not held:
        return np.zeros((0, 4), np.int64)
    found = np.unique(np.concatenate(held), axis=0)
    # of the periods of one stretch the least counts
    first = np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(1)])
    found = found[first]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(edge[:-1]) > 0


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``runs`` and ``collapsed``: the words outside repeats, joined by one space.

    One narrow pass; nothing is shuffled.
    """
    kept = docs.select(F.struct(*keep).alias("kept"), F.col("text").alias("text"))
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for at, part in slices(batch.column(1)):
                runs, texts = [], []
                part.words()
                raw, hashes = part.buf.tobytes(), part.word_hashes()
                found = find_runs(hashes, part.first, least, times)
                cuts = np.searchsorted(found[:, 0], np.arange(len(part.first)))
                for k, (a, z) in enumerate(zip(part.first, part.first[1:])):
                    mine = found[cuts[k]:cuts[k + 1]]
                    some = raw[part.edges[k]:part.edges[k + 1]].split()
                    if len(mine):
                        gone = dropped(z - a, mine)
                        some = [w for w, g in zip(some, gone) if not g]
                    texts.append(b" ".join(some).decode())
                    runs.append([{"start": int(s), "length": int(n), "period": int(p)} for _, s, n, p in mine])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(runs)), pa.array(runs, runs_type), pa.array(texts, pa.string())], names=["kept", "runs", "collapsed"])

    found = kept.mapInArrow(run, f"kept {kept.schema['kept'].dataType.simpleString()}, runs {RUN}, collapsed string")
    return found.select("kept.*", "runs", "collapsed")


def looped(doc_id: Column, text: Column) -> Column:
    """The text with a periodic tail where the contract asks for one (one id in ten); others unchanged, also without an id."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        spot = let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(w, lambda _, i: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"])))
        return F.when(n > 0, F.array_join(F.transform(spot, lambda i: F.element_at(w, (i + 1).cast("int"))), " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words(F.coalesce(text, F.lit(""))), tail)).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """One row per document: the runs counted, the one with the greatest exponent, and digests."""
    # exact: a / p > b / q as a * q > b * p
    def better(x, y):
        gain = y["length"] * x["period"] - x["length"] * y["period"]
        return F.when(gain != 0, F.signum(gain)).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")

    best = F.get(F.array_sort("runs", better), F.lit(0))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    joined = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"), F.col("_b.length").alias("length"), F.col("_b.period").alias("period"),
        F.floor(F.lit(1000) * F.col("_b.length") / F.col("_b.period")).cast("long").alias("exponent_milli"),
        F.sha2(joined, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
