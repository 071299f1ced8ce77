"""Fingerprints of all documents meet without one row each.

A task packs the fingerprints of neighbouring documents, some ``HELD`` at a time, by hash part: one
row per (pack, part) with the document ids, how many fingerprints each has there, and the low bytes of the fingerprints.
Rows are dealt by part and each part is looked at in one go. A document holds a fingerprint
at most once, so even one that a third of all documents share adds few entries to its part
next to all their others. ``parts_for`` gives the number of parts from the counted fingerprints.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm.textnum import expand, mix, narrow, slices, squeeze, widen

#: Fingerprints that a task holds before it packs them; one slice of texts more at most.
HELD = 1 << 20

PACKED = "part int, ids binary, counts binary, prints binary"
_ARROW = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("prints", pa.binary())])


#: Fingerprints of a part that its task sorts, about; more of them make more parts.
PER_PART = 1 << 21


def parts_for(total: int, least: int) -> int:
    """Number of hash parts for so many fingerprints: as the session asks, or more if a part would pass ``PER_PART``."""
    return max(least, -(-total // PER_PART))


def first_of_each(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which entries are the first of their (document, value)."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return np.sort(order[new])


def pack(docs: DataFrame, prints, n_parts: int, size: int, lower: bool = False) -> DataFrame:
    """Rows of PACKED from (doc_id, text). ``prints(texts)`` gives (document, 64-bit value) of a slice.

    Rows without an id are left out. The part is the value modulo ``n_parts``; what is kept of
    the value are ``size`` bytes of its quotient.
    """
    def run(batches):
        for batch in batches:
            ids, docs_, values, held = batch.column(0).to_numpy(zero_copy_only=False), [], [], 0
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int32)
            rank[order] = np.arange(len(ids), dtype=np.int32)
            for at, texts in slices(batch.column(1), lower):
                doc, value = prints(texts)
                docs_.append(rank[doc + at])
                values.append(value)
                held += len(value)
                if held >= HELD:
                    yield dealt(ids[order], np.concatenate(docs_), np.concatenate(values))
                    docs_, values, held = [], [], 0
            if docs_:
                yield dealt(ids[order], np.concatenate(docs_), np.concatenate(values))

    def dealt(ids, doc, value):
        by_doc = np.argsort(doc, kind="stable")
        doc, value = doc[by_doc], value[by_doc]
        part = (value % np.uint64(n_parts)).astype(np.uint32 if n_parts > 65535 else np.uint16)
        by_part = np.argsort(part, kind="stable")
        doc, value, part = doc[by_part], value[by_part] // np.uint64(n_parts), part[by_part]
        cuts = np.searchsorted(part, np.arange(n_parts + 1, dtype=np.int64))
        rows = []
        for p in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[p], cuts[p + 1]
            held, counts = np.unique(doc[a:b], return_counts=True)
            rows.append((int(p), squeeze(ids[held].astype(np.int64)), squeeze(counts.astype(np.int32)), narrow(value[a:b], size)))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)] if rows else [pa.array([], t.type) for t in _ARROW], schema=_ARROW)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(run, PACKED)


def meet(packed: DataFrame, n_parts: int, size: int, judge, schema: str) -> DataFrame:
    """``judge(part, ids, prints)`` sees all entries of a part, sorted by (print, id); it returns a RecordBatch or None."""
    def run(batches):
        part, held = None, []
        for batch in batches:
            for p, ids, counts, prints in zip(*[c.to_pylist() for c in batch.columns]):
                if p != part and held:
                    yield from answer(part, held)
                    held = []
                part = p
                held.append((np.repeat(expand(ids, np.int64), expand(counts, np.int32)), widen(prints, size)))
        if held:
            yield from answer(part, held)

    def answer(part, held):
        ids, prints = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        held.clear()
        order = np.lexsort((ids, prints))
        ids = ids[order]
        prints = prints[order]
        del order
        out = judge(part, ids, prints)
        if out is not None:
            yield out

    return packed.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


ANSWERS = "wide_group int, part int, ids binary, counts binary, prints binary"


def side(n: int) -> int:
    """Least whole number whose square is ``n`` or more."""
    return math.isqrt(max(n - 1, 0)) + 1


def group_of(ids: np.ndarray, n_groups: int) -> np.ndarray:
    """Group of each document."""
    return (mix(ids.view(np.uint64)) % np.uint64(n_groups)).astype(np.int64)


def split(key: np.ndarray, ids: np.ndarray, values: np.ndarray, size: int):
    """(key, ids, counts, values) packed for each key."""
    order = np.lexsort((values, ids, key))
    key, ids, values = key[order], ids[order], values[order]
    first, _ = runs(key)
    for a, b in zip(first, [*first[1:], len(key)]):
        held, counts = np.unique(ids[a:b], return_counts=True)
        yield int(key[a]), squeeze(held), squeeze(counts.astype(np.int32)), narrow(values[a:b], size)


def answer(part: int, ids: np.ndarray, prints: np.ndarray, n_groups: int, size: int) -> pa.RecordBatch | None:
    """Prints found for documents in one part, packed by wide group of documents.

    A wide group is ``side(n_groups)`` neighbouring groups. ``by_document`` splits it later, so that
    parts and groups never meet each with each.
    """
    if not len(ids):
        return None
    rows = [(key, part, *rest) for key, *rest in split(group_of(ids, n_groups) // side(n_groups), ids, prints, size)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 3))], names=["wide_group", "part", "ids", "counts", "prints"])


def answer_counts(part: int, ids: np.ndarray, counts: np.ndarray, n_groups: int) -> pa.RecordBatch:
    """A count for each document in one part, packed by group of documents."""
    group = group_of(ids, n_groups)
    order = np.lexsort((ids, group))
    cuts = np.searchsorted(group[order], np.arange(n_groups + 1))
    rows = [(int(g), squeeze(ids[order[a:b]]), squeeze(counts[order[a:b]].astype(np.int32))) for g, a, b in zip(range(n_groups), cuts, cuts[1:]) if b > a]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["doc_group", "ids", "counts"])


FOUND = "doc_id bigint, found binary"


def by_document(answers: DataFrame, n_parts: int, size: int) -> DataFrame:
    """FOUND: the sorted values found for each document, from all parts.

    Answers go in two steps: a lane takes those of one wide group from about the root of all parts
    and splits them into groups; then the lanes of each group meet. With P parts this makes rows
    in the order of P * sqrt(P), not P * P.
    """
    lanes = side(n_parts)

    def gathered(batches, keys, unpack, done):
        last, held = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:keys] != last and held:
                    yield done(held)
                    held = []
                last = row[:keys]
                held.append(unpack(*row[keys:]))
        if held:
            yield done(held)

    def whole(part, ids, counts, prints):
        return np.repeat(expand(ids, np.int64), expand(counts, np.int32)), widen(prints, size) * np.uint64(n_parts) + np.uint64(part)

    def joined(ids, counts, values):
        return np.repeat(expand(ids, np.int64), expand(counts, np.int32)), widen(values, 8)

    def regroup(held):
        ids, values = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*split(group_of(ids, n_parts), ids, values, 8)), (pa.int32(), *[pa.binary()] * 3))], names=["doc_group", "ids", "counts", "found"])

    def gather(held):
        ids, values = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((values, ids))
        ids, values = ids[order], values[order]
        first, _ = runs(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[first]), pa.array([squeeze(np.unique(values[a:b])) for a, b in zip(first, [*first[1:], len(ids)])], pa.binary())], names=["doc_id", "found"])

    dealt = answers.select("wide_group", F.pmod("part", F.lit(lanes)).alias("lane"), "part", "ids", "counts", "prints")
    dealt = dealt.repartition(n_parts, "wide_group", "lane").sortWithinPartitions("wide_group", "lane")
    groups = dealt.mapInArrow(lambda b: gathered(b, 2, whole, regroup), "doc_group int, ids binary, counts binary, found binary")
    return groups.repartition(n_parts, "doc_group").sortWithinPartitions("doc_group").mapInArrow(lambda b: gathered(b, 1, joined, gather), FOUND)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of equal values, and the run of each place."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1
