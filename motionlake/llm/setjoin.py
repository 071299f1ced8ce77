"""Operator 10: n-gram Jaccard join with skipping by set relations.

A text is the set of its distinct word shingles. Two sets link when their intersection is at
least ``share`` percent of their union.

1. Equal sets become one (their least id stands for them); empty sets link with nothing.
2. Shingles that no other document has cannot be shared. A set with more than 100 - ``share``
   percent of them cannot link and is skipped before any list is built.
3. The others are indexed by their prefix: shingles in order from rare to frequent
   by a sketch of counts of fixed size. Lists are cut into blocks by the number of shingles
   from the place on; a probe meets only the blocks whose remainder suits its size, and skips the rest.
4. In each list the set with the fewest private shingles is the leader. Only (leader, member)
   pairs are computed first. Members that link to it are one class, and its distances bound all
   others: |x - y| >= ||r - x| - |r - y||, so a set's answers follow from those of a similar
   set, and only pairs that neither this, nor sizes, places and private shingles exclude are computed.
5. Links are joined into components by passing least ids along them.

Shingles are compared by 64-bit hashes. Defined cases: null or empty text and white space have
the empty set; a row without an id is returned with its set size and no component, and links
nothing; rows that share an id each follow their own set; an empty table gives no rows; other
columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm import exchange
from motionlake.llm.common import Scratch, likely, parts
from motionlake.llm.textnum import Texts, mix, slices

WIDTH, SHARE = 5, 80
SIZE = 5
#: Cells of the sketch of counts that orders shingles; any order gives the same links.
CELLS = 1 << 16


def shingles(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, value): the distinct shingles, sorted; shorter texts are one shingle."""
    texts.words()
    hashes, counts = texts.word_hashes(), np.diff(texts.first)
    doc, _, value = texts.windows(hashes, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    whole = [np.bitwise_xor.reduce(mix(hashes[texts.first[k]:texts.first[k] + counts[k]] + np.arange(1, counts[k] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) for k in short]
    doc = np.concatenate([doc, short]).astype(np.int64)
    value = np.concatenate([value, mix(np.array(whole, np.uint64) + np.uint64(width))])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


SETS = "doc_id bigint, n_shingles bigint, a bigint, b bigint"
_OTHER = np.uint64(0xA5A5A5A5A5A5A5A5)


def digests(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit digests of the set of each of ``n`` documents; 0 for the empty set."""
    out = np.zeros((2, n), np.uint64)
    first, _ = exchange.runs(doc)
    if len(first):
        for k, x in enumerate((mix(value), mix(value ^ _OTHER))):
            out[k, doc[first]] = np.add.reduceat(x, first)
    return out.view(np.int64)


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """SETS: size and two digests of the set of each document."""
    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1), lower=True):
                n = len(texts.edges) - 1
                doc, value = shingles(texts, width)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), pa.array(np.bincount(doc, minlength=n)), *map(pa.array, digests(doc, value, n))], names=["doc_id", "n_shingles", "a", "b"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS)


def shared_counts(packed: DataFrame, n_parts: int) -> DataFrame:
    """(doc_id, held): shingles of each document that some other has too."""
    def judge(part, ids, prints):
        first, run = exchange.runs(prints)
        if not len(first):
            return None
        most, least = np.maximum.reduceat(ids, first), np.minimum.reduceat(ids, first)
        live = np.sort(ids[(most > least)[run]])
        if not len(live):
            return None
        head, _ = exchange.runs(live)
        return exchange.answer_counts(part, live[head], np.diff(np.append(head, len(live))), n_parts)

    def add(batches):
        last, held = None, []
        for batch in batches:
            for group, ids, counts in zip(*[c.to_pylist() for c in batch.columns]):
                if group != last and held:
                    yield total(held)
                    held = []
                last = group
                held.append((exchange.expand(ids, np.int64), exchange.expand(counts, np.int32)))
        if held:
            yield total(held)

    def total(held):
        ids, where = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(where, np.concatenate([x[1] for x in held])).astype(np.int64))], names=["doc_id", "held"])

    met = exchange.meet(packed, n_parts, SIZE, judge, "doc_group int, ids binary, counts binary")
    return met.repartition(n_parts, "doc_group").sortWithinPartitions("doc_group").mapInArrow(add, "doc_id bigint, held bigint")


def set_rows(near: DataFrame, width: int) -> DataFrame:
    """(sid, size, held, shingles) of (a, held, text), for texts whose set has the digest ``a``."""
    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(2), lower=True):
                n = len(texts.edges) - 1
                doc, value = shingles(texts, width)
                cuts = np.searchsorted(doc, np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(value.view(np.int64)))
                whole = pa.RecordBatch.from_arrays([pa.array(digests(doc, value, n)[0]), pa.array(np.diff(cuts)), batch.column(1).slice(at, n), lists], names=["sid", "size", "held", "shingles"])
                yield whole.filter(pa.array(whole.column(0).to_numpy() == batch.column(0).slice(at, n).to_numpy()))

    return near.select("a", "held", "text").mapInArrow(run, "sid bigint, size bigint, held bigint, shingles array<bigint>")


def sketch(sets: DataFrame) -> np.ndarray:
    """Counts of shingles by the low bits of their hash: CELLS numbers, whatever the data."""
    cell = F.col("s").bitwiseAND(F.lit(CELLS - 1)).cast("int")
    rows = sets.select(F.explode("shingles").alias("s")).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = np.zeros(CELLS, np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out


ENTRIES = "token bigint, sid bigint, size int, rest int, rank double"


def prefixes(sets: DataFrame, counts: np.ndarray, share: int) -> DataFrame:
    """ENTRIES: the shingles in the prefix of each set, in an order common to all sets.

    Two linked sets share a shingle of both prefixes. rest: shingles from this place on.
    rank: part of private shingles, least for leaders.
    """
    level = np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)

    def run(batches):
        for batch in batches:
            tokens, docs, sizes, rests, ranks = [], [], [], [], []
            for doc, size, held, shingles_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                value = shingles_.values.to_numpy()
                order = np.lexsort((value, level[value & (CELLS - 1)]))
                need = -(-share * size // 100)
                value = value[order][:size - need + 1]
                tokens.append(value)
                docs.append(np.full(len(value), doc))
                sizes.append(np.full(len(value), size, np.int32))
                rests.append((size - np.arange(len(value))).astype(np.int32))
                ranks.append(np.full(len(value), 1 - held / size))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, docs, sizes, rests, ranks)], names=["token", "sid", "size", "rest", "rank"])

    return sets.mapInArrow(run, ENTRIES)


def need(x: Column, y: Column, share: int) -> Column:
    """Least intersection of two linked sets of these sizes."""
    return F.ceil(F.lit(share) * (x + y) / F.lit(100 + share))


def block_of(n: Column) -> Column:
    """Blocks of list entries, a quarter wide each."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25))).cast("int")


def computed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(x, y, far, linked) for pairs of ids: ``far`` is the size of the symmetric difference."""
    left = pairs.join(sets.select(F.col("sid").alias("x"), F.col("shingles").alias("_x")), "x")
    both = left.join(sets.select(F.col("sid").alias("y"), F.col("shingles").alias("_y")), "y")
    same, total = F.size(F.array_intersect("_x", "_y")), F.size("_x") + F.size("_y")
    return both.select("x", "y", (total - 2 * same).cast("long").alias("far"), (same * 100 >= share * (total - same)).alias("linked"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) from links (x, y): least ids pass along links and are followed to their own.

    Each round hooks every root to the least root next to it, then shortens the chains.
    """
    both = scratch.keep(links.select("x", "y").union(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = scratch.keep(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("component")))
    while True:
        # the least label next to each label
        seen = both.join(label.select(F.col("id").alias("x"), F.col("component").alias("cx")), "x").join(label.select(F.col("id").alias("y"), F.col("component").alias("cy")), "y")
        hook = scratch.keep(seen.filter("cy < cx").groupBy(F.col("cx").alias("root")).agg(F.min("cy").alias("to")))
        if hook.isEmpty():
            return label
        # roots are themselves hooked: follow until nothing moves
        moved = label.join(hook, label["component"] == hook["root"], "left").select("id", F.coalesce("to", "component").alias("component"))
        ends = label.select(F.col("id").alias("component"), F.col("component").alias("_next"))
        label = scratch.keep(moved.join(ends, "component", "left").select("id", F.least(F.col("component"), F.coalesce("_next", "component")).alias("component")))


def links(sets: DataFrame, scratch: Scratch, share: int = SHARE) -> DataFrame:
    """(x, y) of linked sets, enough to connect every class. Runs jobs."""
    entry = scratch.keep(prefixes(sets, sketch(sets), share))
    lead = scratch.keep(entry.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "sid")).alias("first")).filter("n > 1")
                        .select("token", F.col("first.sid").alias("r")))
    listed = scratch.keep(entry.join(lead, "token"))
    size = sets.select(F.col("sid").alias("r"), F.col("size").alias("_rs"), F.col("held").alias("_rh"))
    star = listed.filter("r != sid").select("r", F.col("sid").alias("y")).distinct()
    far = scratch.keep(computed(star.select(F.col("r").alias("x"), "y"), sets, share))
    first = far.filter("linked").select("x", "y")
    near = components(first, scratch) if not first.isEmpty() else None
    # what is left: members of a list that its leader does not hold, against all of the list
    known = far.select(F.col("x").alias("r"), F.col("y").alias("sid"), "far", "linked")
    rows = listed.join(known, ["r", "sid"]).join(sets.select("sid", "held"), "sid")
    if near is not None:
        rows = rows.join(near.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    else:
        rows = rows.withColumn("component", F.col("sid"))
    rows = scratch.keep(rows.withColumn("block", block_of(F.col("rest"))))
    probe = rows.filter("not linked").select(
        "token", F.explode(F.sequence(block_of(F.col("size") * share / 100), block_of(F.col("size") * 100 / share))).alias("block"),
        *[F.col(c).alias(f"_{c}") for c in ("sid", "size", "rest", "far", "held", "component")])
    met = probe.join(rows.select("token", "block", "sid", "size", "rest", "far", "held", "component", "linked"), ["token", "block"])
    least = need(F.col("size"), F.col("_size"), share)
    met = met.filter((F.col("component") != F.col("_component")) & (F.col("linked") | (F.col("sid") < F.col("_sid")))
                     & (F.least("rest", "_rest", "held", "_held") >= least)
                     & (F.abs(F.col("far") - F.col("_far")) <= F.col("size") + F.col("_size") - 2 * least))
    rest = computed(met.select(F.least("sid", "_sid").alias("x"), F.greatest("sid", "_sid").alias("y")).distinct(), sets, share)
    return first.union(rest.filter("linked").select("x", "y"))


def join(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id. Runs jobs."""
    scratch = Scratch(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = scratch.keep(signatures(named, width))
    n_parts = exchange.parts_for(every.agg(F.sum("n_shingles")).first()[0] or 0, parts(docs.sparkSession, 1))
    digest = ["n_shingles", "a", "b"]
    stands = scratch.keep(every.filter("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("rep")))

    def prints(texts):
        return shingles(texts, width)

    held = shared_counts(exchange.pack(named, prints, n_parts, SIZE, lower=True), n_parts)
    able = stands.join(held.withColumnRenamed("doc_id", "rep"), "rep").filter(F.col("held") * 100 >= F.col("n_shingles") * share)
    able = scratch.keep(able.select(F.col("rep").alias("doc_id"), "a", "held"))
    near = likely(named, "doc_id", able, "doc_id").join(able, "doc_id")
    found = scratch.keep(links(scratch.keep(set_rows(near, width)), scratch, share))
    label = found.select(F.col("x").alias("a"), F.col("y").alias("component"))
    label = label if found.isEmpty() else components(found, scratch).withColumnRenamed("id", "a")
    joined = scratch.keep(stands.join(label, "a", "left").withColumn("component", F.coalesce("component", "a")))
    least = joined.groupBy("component").agg(F.min("rep").alias("_c"))
    out = every.join(joined.join(least, "component").select(*digest, "_c"), digest, "left")
    return scratch.result(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id")).alias("component_id")))
