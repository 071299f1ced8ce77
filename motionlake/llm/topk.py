"""Operator 3: exact top-k search of binary codes by incremental multi-index hashing.

A vector's code holds the sign of each dimension. Rows are dealt to shards of bounded size; a
shard indexes its different codes by segments of ``BITS`` bits. For a query the radius grows one
segment at a time: after the first s segments were searched to radius r and the others to
r - 1, every code within m * r + s - 1 bits has been met, since one farther off in each of the
m segments is at least m * r + s bits away. A query is done once its k-th distance is within
that bound. Queries reach the shards in packed blocks, and the best of all shards are merged.

Defined cases: rows without id or vector, or with another number of dimensions than ``dims`` (if
not given, the most frequent number, of equals the least), are left out, as are null coordinates (bit 0); a query never finds its own id; equal distances
rank by id; rows of one id count once, at the least distance of their vectors; a query id with several
vectors asks with each of them; an empty table gives no rows; other columns
are not read.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, PER_SHARD = 16, 1 << 14

PACKED = "shard int, kind int, ids binary, codes binary"
FOUND = "query_id bigint, vec_id bigint, distance int"


def packed(rows: DataFrame, dims: int, n_shards: int) -> DataFrame:
    """PACKED from (vec_id, embedding, is_query): codes by shard, queries for every shard."""
    wide = -(-dims // BITS) * (BITS // 8)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims)
            bits = np.packbits(flat > 0, axis=1, bitorder="little")
            codes = np.zeros((len(ids), wide), np.uint8)
            codes[:, :bits.shape[1]] = bits
            shard, asked = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            # repeated rows of a batch are packed once
            rows = np.concatenate([ids.view(np.uint8).reshape(-1, 8), codes, asked.astype(np.uint8)[:, None]], 1)
            once = np.sort(np.unique(rows, axis=0, return_index=True)[1]) if len(rows) else np.zeros(0, np.int64)
            ids, codes, shard, asked = ids[once], codes[once], shard[once], asked[once]
            out = [(int(s), 0, ids[shard == s].tobytes(), codes[shard == s].tobytes()) for s in np.unique(shard)]
            for a in range(0, int(asked.sum()), 4096):
                block = ids[asked][a:a + 4096].tobytes(), codes[asked][a:a + 4096].tobytes()
                out += [(s, 1, *block) for s in range(n_shards)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))] if out else
                                             [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())], names=["shard", "kind", "ids", "codes"])

    return rows.mapInArrow(run, PACKED)


class Index:
    """Different codes of a shard, the least ids of each, and a table per segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, k: int):
        order = np.lexsort((ids, *codes.T[::-1]))
        ids, codes = ids[order], codes[order]
        # a row that repeats id and code counts once
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (codes[1:] != codes[:-1]).any(axis=1)
        ids, codes = ids[fresh], codes[fresh]
        new = np.ones(len(ids), bool)
        new[1:] = (codes[1:] != codes[:-1]).any(axis=1)
        self.first = np.append(np.flatnonzero(new), len(ids))
        self.ids, self.codes = ids, codes[new]
        #: codes of one id only; an id may stand in several others, which then need more places
        self.alone = np.diff(self.first) == 1
        shared = ids[~np.repeat(self.alone, np.diff(self.first))]
        self.k = (k + 1) * (int(np.unique(shared, return_counts=True)[1].max()) if len(shared) else 1)
        self.segments = self.codes.view("<u2")
        self.tables = []
        for s in range(self.segments.shape[1]):
            order = np.argsort(self.segments[:, s], kind="stable")
            self.tables.append((order, np.searchsorted(self.segments[order, s], np.arange((1 << BITS) + 1))))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance): codes that hold at least the k + 1 nearest ids of each query."""
        n, m = len(queries), self.segments.shape[1]
        # no more than all ids can be found
        asked, k = queries.view("<u2"), min(self.k, int(len(np.unique(self.ids[self.first[:-1]][self.alone]))) + int((~self.alone).sum()))
        held = [np.zeros(0, np.int64) for _ in range(3)]
        live = np.arange(n)
        for radius in range(BITS + 1):
            masks = np.array([sum(1 << b for b in c) for c in combinations(range(BITS), radius)], np.int64)
            for s in range(m):
                order, table = self.tables[s]
                step = max(1, (1 << 20) // len(masks))
                for a in range(0, len(live), step):
                    who = live[a:a + step]
                    value = asked[who, s].astype(np.int64)[:, None] ^ masks
                    low, many = table[value].ravel(), (table[value + 1] - table[value]).ravel()
                    code = order[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                    query = np.repeat(np.repeat(who, len(masks)), many)
                    far = np.bitwise_count(self.codes[code] ^ queries[query]).sum(axis=1, dtype=np.int64)
                    held = self.best([np.concatenate(x) for x in zip(held, (query, code, far))])
                count = np.bincount(held[0], minlength=n)
                last = np.full(n, np.iinfo(np.int64).max)
                full = np.flatnonzero(count >= k)
                ends = np.cumsum(count)
                last[full] = held[2][ends[full] - count[full] + k - 1]
                live = live[last[live] > m * radius + s]
                if not len(live):
                    return tuple(held)
        return tuple(held)

    def best(self, rows):
        """The least (distance, least id) of each query, enough for k + 1 ids; each code once."""
        query, code, far = rows
        order = np.lexsort((code, query))
        query, code, far = query[order], code[order], far[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (code[1:] != code[:-1])
        query, code, far = query[new], code[new], far[new]
        # of the codes that stand for one id alone the nearest counts
        who = self.ids[self.first[code]]
        order = np.lexsort((far, who, ~self.alone[code], query))
        query, code, far, who = query[order], code[order], far[order], who[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (who[1:] != who[:-1]) | ~self.alone[code[1:]]
        query, code, far, who = query[new], code[new], far[new], who[new]
        order = np.lexsort((who, far, query))
        query, code, far = query[order], code[order], far[order]
        start = np.searchsorted(query, query, "left")
        keep = np.arange(len(query)) - start < self.k
        return [query[keep], code[keep], far[keep]]


def nearest(packed_rows: DataFrame, n_shards: int, k: int, wide: int) -> DataFrame:
    """FOUND: the nearest k of each query in each shard."""
    def run(batches):
        shard, ids, codes, index = None, [], [], None
        for batch in batches:
            for s, kind, some, code in zip(*[c.to_pylist() for c in batch.columns]):
                if s != shard:
                    shard, ids, codes, index = s, [], [], None
                some, code = np.frombuffer(some, np.int64), np.frombuffer(code, np.uint8).reshape(-1, wide)
                if kind == 0:
                    ids.append(some)
                    codes.append(code)
                    continue
                if not ids:
                    continue
                index = index or Index(np.concatenate(ids), np.concatenate(codes), k)
                query, found, far = index.search(code)
                # ids of the found codes, at most k + 1 of each
                many = np.minimum(np.diff(index.first)[found], k + 1)
                at = np.repeat(index.first[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                query, far, ident = np.repeat(query, many), np.repeat(far, many), index.ids[at]
                other = ident != some[query]
                query, far, ident = query[other], far[other], ident[other]
                order = np.lexsort((ident, far, query))
                query, far, ident = query[order], far[order], ident[order]
                # an id takes one place, at its least distance
                once = np.zeros(len(query), bool)
                once[np.unique(np.stack([query, ident]), axis=1, return_index=True)[1]] = True
                query, far, ident = query[once], far[once], ident[once]
                keep = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
                yield pa.RecordBatch.from_arrays([pa.array(some[query[keep]]), pa.array(ident[keep]), pa.array(far[keep].astype(np.int32))], names=["query_id", "vec_id", "distance"])

    return packed_rows.repartition(n_shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, FOUND)


def search(rows: DataFrame, is_query: Column, k: int = 10, dims: int | None = None, per_shard: int = PER_SHARD) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k rows nearest to each query, of all rows. Runs jobs."""
    named = rows.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("_q"))
    if dims is None:
        # vectors of no dimensions have no code
        sizes = named.groupBy(F.size("embedding").alias("dims")).count().filter("dims > 0")
        one = sizes.agg(F.max_by("dims", F.struct("count", -F.col("dims")))).first()[0]
        dims = one or 1
    total = named.count()
    n_shards = max(1, -(-total // per_shard))
    named = named.filter(F.size("embedding") == dims).select(
        "vec_id", F.transform("embedding", lambda x: F.coalesce(x.cast("float"), F.lit(0).cast("float"))).alias("embedding"),
        F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_shards)).cast("int").alias("_s"), F.coalesce("_q", F.lit(False)).alias("_q"))
    found = nearest(packed(named, dims, n_shards), n_shards, k, -(-dims // BITS) * (BITS // 8))
    once = found.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return once.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
