"""Operator 2: best-fit packing of tokenised documents by large-item matching.

A document is its token ids and an end id; the marker <|endoftext|> in a text is one id, as in the
named tokenizer. A document longer than a sequence is cut into full pieces behind a shorter first
one. Packing looks at lengths only, of which there are at most
``capacity``: the counts per length go to the driver, never the documents.

* Pieces above a third of the capacity are matched greedily, longest first, each with the
  longest partner that fits; such pieces meet at most twice in a sequence.
* Smaller pieces, longest first, go where the least room is left that holds them.

Both work on (length, count) runs and give slots: the a-th to b-th piece of a length begin at
an offset of the sequences c, c + 1, ... Pieces are numbered within their length by two-level
counts and looked up in the slots.

Defined cases: null text counts as empty; an empty document is one piece with the end id;
equal documents and ids are packed each on its own; an empty table gives no rows; other
columns of the documents are not read.
"""

import os
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.llm.common import Scratch

CAPACITY, END = 1024, 2

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

#: Slots are broadcast up to this many; their number depends on the capacity alone.
MOST_SLOTS = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: Added tokens by rank file, which does not hold them itself.
SPECIAL = {"byte_bpe_50k.tiktoken": {"<|endoftext|>": 50256}}

_ENCODERS: dict = {}


def encoder(path: str):
    """Byte-level encoder over a file of ranks, once per Python worker."""
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL.get(os.path.basename(path), {}))
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids on request)."""
    path = tokenizer or default_tokenizer()
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(frames):
        enc = encoder(path)
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ids = np.append(enc.encode_to_numpy(text or "", allowed_special="all").astype("<u4"), np.uint32(end)).astype("<u4")
                n = len(ids)
                first = n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                doc = None if pd.isna(doc) else int(doc)
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    row = (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                    out.append(row + (ids[a:b].astype(np.int32),) if with_ids else row)
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            made = pd.DataFrame(out, columns=names)
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first, last + 1, sequence of the first, offset) from pieces per length."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    room: dict[int, list[tuple[int, int]]] = {}
    out, fresh = [], 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        out.append((length, used[length], used[length] + n, sequence, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap > 0:
            room.setdefault(gap, []).append((sequence, n))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for big in large:
        while left[big]:
            partner = next((n for n in large if n <= big and n + big <= capacity and left[n] > (n == big)), None)
            n = left[big] if partner is None else left[big] // 2 if partner == big else min(left[big], left[partner])
            place(big, n, fresh, 0)
            if partner is not None:
                place(partner, n, fresh, big)
            leave(capacity - big - (partner or 0), fresh, n)
            fresh += n
    for small in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[small]:
            gap = min((g for g in room if g >= small), default=None)
            if gap is None:
                n = -(-left[small] // (capacity // small))
                leave(capacity, fresh, n)
                fresh += n
                continue
            sequence, n = room[gap].pop()
            if not room[gap]:
                del room[gap]
            take = min(n, left[small])
            place(small, take, sequence, capacity - gap)
            leave(gap - small, sequence, take)
            if take < n:
                leave(gap, sequence + take, n - take)
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset. Runs jobs."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cut = scratch.keep(pieces(docs, tokenizer, capacity, end, with_ids).withColumn("_p", F.spark_partition_id()))
    per = scratch.keep(cut.groupBy("length", "_p").agg(F.count(F.lit(1)).alias("_n")))
    counts = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("_n")).collect()}
    table = slots(counts, capacity)
    before = Window.partitionBy("length").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("length", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_p", "length").orderBy("doc_id", "piece", "ids_crc32")
    numbered = cut.withColumn("_k", F.row_number().over(inside) - 1).join(offsets, ["length", "_p"])
    numbered = numbered.withColumn("_k", F.col("_k") + F.col("_before"))
    rows = spark.createDataFrame(table, "length long, _first long, _last long, _sequence long, offset long") if table else spark.createDataFrame([], "length long, _first long, _last long, _sequence long, offset long")
    rows = F.broadcast(rows) if len(table) <= MOST_SLOTS else rows
    found = numbered.join(rows, (numbered["length"] == rows["length"]) & (numbered["_k"] >= rows["_first"]) & (numbered["_k"] < rows["_last"])).drop(rows["length"])
    return scratch.result(found.select(
        *[c for c in cut.columns if c != "_p"], (F.col("_sequence") + F.col("_k") - F.col("_first")).alias("sequence_id"), "offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids per sequence, from pieces packed ``with_ids``; a sequence holds at most its capacity."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
