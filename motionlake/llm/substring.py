"""Operator 6: removal of repeated passages by fixed-block anchors.

A window is ``width`` consecutive words. The words of every document are cut into blocks of
(width + 1) / 2 words that do not overlap; any window holds one whole block of its document.

1. Blocks are indexed and probed with every rolling window of block size: hits are block
   sequences that also lie in a document with a larger id.
2. Around hits only, full windows are compared, which extends each hit to the maximal exact
   repeat: neighbouring windows that are found form one repeat.
3. A window whose words also start in a document with a smaller id loses all its words.

Windows are compared by two independent 64-bit hashes of words in order; block hits only
choose what is looked at. All occurrences of a passage meet through packed fingerprints, once
per document, never as pairs. The answer for a window depends on its words and the id alone,
so rows that share an id are judged alike.

Defined cases: null text has no words; a row without an id is never a source and stays as it
is; texts below ``width`` words stay; an empty table gives no rows; other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.llm import exchange
from motionlake.llm.common import Scratch, likely, parts
from motionlake.llm.textnum import Texts, expand, mix, narrow, slices, squeeze

WIDTH = 13

#: Bytes of a block print beside its part; false hits only cost time.
SIZE = 5


def block_prints(texts: Texts, block: int, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, value); the value without its lowest quotient bit names the sequence."""
    texts.words()
    doc, at, value = texts.windows(texts.word_hashes(), block)
    part, rest = value % np.uint64(n_parts), value >> np.uint64(24)
    return doc, at, part + np.uint64(n_parts) * ((rest & np.uint64(2**38 - 1)) << np.uint64(1))


def full_prints(texts: Texts, width: int) -> np.ndarray:
    """One 64-bit value per window from two hashes with separate tables."""
    return texts.windows(texts.word_hashes(0), width, 0)[2] ^ mix(texts.windows(texts.word_hashes(1), width, 1)[2] + np.uint64(1))


def block_hits(part: int, ids: np.ndarray, prints: np.ndarray, n_groups: int):
    """Documents and block sequences where a reference block meets a document with a larger id."""
    key, is_block = prints >> np.uint64(1), (prints & np.uint64(1)) == 1
    order = np.lexsort((ids, key))
    key, ids, is_block = key[order], ids[order], is_block[order]
    first, run = exchange.runs(key)
    least = np.minimum.reduceat(np.where(is_block, ids, np.iinfo(np.int64).max), first) if len(first) else ids
    most = np.maximum.reduceat(ids, first) if len(first) else ids
    live = (least < most)[run] & (ids >= least[run])
    return exchange.answer(part, ids[live], key[live], n_groups, SIZE)


def later(part: int, ids: np.ndarray, prints: np.ndarray, n_groups: int):
    """Documents and windows that also start in a document with a smaller id."""
    first, run = exchange.runs(prints)
    live = ids > ids[first][run] if len(first) else np.zeros(0, bool)
    return exchange.answer(part, ids[live], prints[live], n_groups, 8)


def among(value: np.ndarray, held: np.ndarray) -> np.ndarray:
    if not len(held) or not len(value):
        return np.zeros(len(value), bool)
    return held[np.minimum(np.searchsorted(held, value), len(held) - 1)] == value


def around(at_hits: np.ndarray, n_windows: int, block: int, width: int) -> np.ndarray:
    """Which full windows of a document hold one of the hit blocks."""
    edge = np.zeros(n_windows + 1, np.int64)
    np.add.at(edge, np.clip(at_hits - (width - block), 0, n_windows), 1)
    np.add.at(edge, np.clip(at_hits + 1, 0, n_windows), -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, scratch: Scratch, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Documents near a hit (doc_id, text, found), later windows per document. Runs jobs."""
    block, n_parts = (width + 1) // 2, parts(docs.sparkSession)

    def anchors(texts):
        doc, at, value = block_prints(texts, block, n_parts)
        value = value + np.uint64(n_parts) * (at % block == 0)
        keep = exchange.first_of_each(doc, value)
        return doc[keep], value[keep]

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    met = exchange.meet(exchange.pack(named, anchors, n_parts, SIZE), n_parts, SIZE, lambda p, i, v: block_hits(p, i, v, n_parts), exchange.ANSWERS)
    hits = scratch.keep(exchange.by_document(met, n_parts, SIZE))
    near = scratch.keep(likely(named, "doc_id", hits, "doc_id").join(hits, "doc_id"))

    def extend(batches):
        for batch in batches:
            ids, found, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for at, texts in slices(batch.column(1)):
                doc, place, value = block_prints(texts, block, n_parts)
                named_ = (value // np.uint64(2 * n_parts)) * np.uint64(n_parts) + value % np.uint64(n_parts)
                full = full_prints(texts, width)
                many = np.maximum(np.diff(texts.first) - width + 1, 0)
                blocks = np.maximum(np.diff(texts.first) - block + 1, 0)
                a = b = 0
                for k in range(len(many)):
                    hit = place[b:b + blocks[k]][among(named_[b:b + blocks[k]], expand(found[at + k], np.uint64))]
                    rows.append((ids[at + k], np.unique(full[a:a + many[k]][around(hit, many[k], block, width)])))
                    a, b = a + many[k], b + blocks[k]
            yield from dealt(rows, n_parts)

    met = exchange.meet(near.mapInArrow(extend, exchange.PACKED), n_parts, 8, lambda p, i, v: later(p, i, v, n_parts), exchange.ANSWERS)
    later_ = scratch.keep(exchange.by_document(met, n_parts, 8))
    return near, later_


def dealt(rows, n_parts: int):
    """Packed rows from (document, values): as ``exchange.pack``, for values already chosen."""
    rows = sorted((r for r in rows if len(r[1])), key=lambda r: r[0])
    if not rows:
        return
    ids = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows])
    value = np.concatenate([r[1] for r in rows])
    part = value % np.uint64(n_parts)
    order = np.argsort(part, kind="stable")
    ids, value, part = ids[order], value[order] // np.uint64(n_parts), part[order]
    cuts = np.searchsorted(part, np.arange(n_parts + 1, dtype=np.uint64))
    out = []
    for p in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[p], cuts[p + 1]
        held, counts = np.unique(ids[a:b], return_counts=True)
        out.append((int(p), squeeze(held), squeeze(counts.astype(np.int32)), narrow(value[a:b], 8)))
    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), exchange._ARROW)], schema=exchange._ARROW)


CUT = "doc_id bigint, n_words bigint, n_removed bigint, whole_sha256 string, kept_sha256 string"


def cut(rows: DataFrame, width: int, with_text: bool) -> DataFrame:
    """Removes covered words from (doc_id, text, found)."""
    def run(batches):
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out = [[], [], [], [], [], []]
            for at, texts in slices(batch.column(1)):
                texts.words()
                some = any(found[at:at + len(texts.edges) - 1])
                full = full_prints(texts, width) if some else None
                raw, a = texts.buf.tobytes(), 0
                for k in range(len(texts.edges) - 1):
                    words = raw[texts.edges[k]:texts.edges[k + 1]].split()
                    n = len(words)
                    many = max(n - width + 1, 0)
                    kept = words
                    if found[at + k]:
                        gone = np.flatnonzero(among(full[a:a + many], expand(found[at + k], np.uint64)))
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, gone, 1)
                        np.add.at(edge, gone + width, -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                    a += many
                    text = b" ".join(kept)
                    sha = hashlib.sha256(text).hexdigest()
                    whole = sha if len(kept) == n else hashlib.sha256(b" ".join(words)).hexdigest()
                    for c, v in zip(out, (ids[at + k], n, n - len(kept), whole, sha, text.decode() if with_text else None)):
                        c.append(v)
            cols = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
            names = ["doc_id", "n_words", "n_removed", "whole_sha256", "kept_sha256"]
            if with_text:
                cols.append(pa.array(out[5], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, CUT + (", kept string" if with_text else ""))


def dedup(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and the kept text). Runs jobs.

    Only texts near a hit are shuffled. All others are digested where they are read, and the
    digests of cut documents replace theirs, matched by id and digest of the whole text.
    """
    scratch = Scratch(docs.sparkSession)
    near, later_ = repeats(docs, scratch, width)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if with_text:
        return scratch.result(cut(named.join(later_, "doc_id", "left"), width, True).drop("whole_sha256"))
    none = F.lit(None).cast("binary").alias("found")
    whole = cut(named.select("*", none), width, False)
    changed = cut(near.select("doc_id", "text").join(later_, "doc_id"), width, False).dropDuplicates()
    changed = changed.select("doc_id", "whole_sha256", F.col("n_removed").alias("_removed"), F.col("kept_sha256").alias("_kept"))
    return scratch.result(whole.join(changed, ["doc_id", "whole_sha256"], "left").select(
        "doc_id", "n_words", F.coalesce("_removed", "n_removed").alias("n_removed"), F.coalesce("_kept", "kept_sha256").alias("kept_sha256")))
