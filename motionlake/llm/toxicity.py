"""Operator 8: toxicity by subword-bag embeddings under a linear softmax, trained in numpy.

A word is the mean vector of its character n-grams (bytes, with marks at both ends, hashed to
a table), a segment of ``SEGMENT`` words is the mean of its different words, and a softmax over two classes
sits on top; table and softmax are trained together. A misspelling never seen shares most
n-grams with the word it stands for. A document scores as its most toxic segment, so a long
text does not hide one. In training the segments of a toxic document bear its label; n-grams
that carry it stand out, and margins of n-grams met in few batches shrink.

Training takes a bounded sample: at most ``MOST`` labelled documents of each class, by hash of
the id (the bound is a parameter), never held-out ones. All documents are scored, whole. The
trained model is folded into one number per n-gram bucket: a table of fixed size.

Defined cases: null or empty text has no words and scores as the bare bias; a document without
id counts as held out; several labels of one id count as toxic if one is; without both
classes among the labels, or without a word in the sample, every score is 0; repeated rows score alike; an empty table gives no
rows; other columns are never read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm.textnum import Texts, mix, slices

MOST, SEGMENT, BUCKETS, SIZES, DIM = 2000, 24, 1 << 17, (3, 4, 5, 6), 8
#: A segment with fewer words is averaged over so many.
FEWEST = 8
#: A margin met in this part of the batches is halved.
RARE = 0.1
#: A small sample is gone through again until so many batches were seen.
STEPS = 300
#: Every so many documents of the sample set the scale of the scores and train nothing else.
CALIBRATE = 5


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def grams(texts: Texts, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the chosen words, bucket) of all n-grams of the words, word by word."""
    length = texts.ends[chosen] - texts.starts[chosen]
    edges = np.concatenate([[0], np.cumsum(length + 2)])
    buf = np.full(edges[-1], 62, np.uint8)
    buf[edges[:-1]] = 60
    inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    buf[np.repeat(edges[:-1] + 1, length) + inner] = texts.buf[np.repeat(texts.starts[chosen], length) + inner]
    owner = np.repeat(np.arange(len(chosen)), length + 2)
    to = edges[1:][owner] if len(chosen) else np.zeros(0, np.int64)
    value, out = np.zeros(len(buf), np.uint64), []
    for n in range(1, max(SIZES) + 1):
        m = max(len(buf) - n + 1, 0)
        value = value[:m] * np.uint64(0x100000001B3) + buf[n - 1:n - 1 + m].astype(np.uint64) + np.uint64(1)
        if n in SIZES:
            fits = np.flatnonzero(np.arange(m) + n <= to[:m])
            out.append((owner[fits], (mix(value[fits] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64)))
    owner, bucket = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


def segments(first: np.ndarray, size: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, word) of the different words of each segment; document of each segment.

    A document without words has no segment.
    """
    counts = np.diff(first)
    many = -(-counts // size)
    doc = np.repeat(np.arange(len(counts)), many)
    base = np.cumsum(many) - many
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    pair = np.unique((np.repeat(base, counts) + at // size).astype(np.int64) * (1 << 32) + word)
    return pair >> 32, pair & ((1 << 32) - 1), doc


class Model:
    """Bias, scale and one number per bucket: the softmax margin of each n-gram's vector."""

    def __init__(self, margin: np.ndarray | None, bias: float = 0.0, scale: float = 1.0, shift: float = 0.0):
        self.margin, self.bias, self.scale, self.shift = margin, bias, scale, shift

    def scores(self, texts: Texts) -> np.ndarray:
        """Probability of the toxic class per document of a slice."""
        n = len(texts.edges) - 1
        if self.margin is None:
            return np.zeros(n)
        texts.words()
        hashes = texts.word_hashes()
        _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        owner, bucket = grams(texts, one)
        word = np.bincount(owner, self.margin[bucket], len(one)) / np.maximum(np.bincount(owner, minlength=len(one)), 1)
        of_word, word_of, doc = segments(texts.first, SEGMENT, back)
        total, count = np.bincount(of_word, word[word_of], len(doc)), np.bincount(of_word, minlength=len(doc))
        value = total / np.maximum(count, FEWEST) + self.bias
        best = np.full(n, self.bias)
        if len(doc):
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            best[doc[starts]] = np.maximum.reduceat(value, starts)
        return 1 / (1 + np.exp(-np.clip(self.scale * best + self.shift, -60, 60)))


def train(texts: list[str], labels: np.ndarray, weight: float, epochs: int = 2, batch: int = 128, rate: float = 0.1) -> Model:
    """Table and softmax by Adagrad on segments. ``weight``: how much rarer the toxic class is in the labels than here."""
    if len(set(labels.tolist())) < 2:
        return Model(None)
    def fresh():
        table = np.random.default_rng(11).normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        head, bias = np.random.default_rng(12).normal(0, 0.5, (DIM, 2)), np.zeros(2)
        return table, head, bias, np.full(BUCKETS, 1e-12), np.full((DIM, 2), 1e-12), np.full(2, 1e-12), np.zeros(BUCKETS)

    table, head, bias, seen, seen_head, seen_bias, touched = fresh()
    # all segments as words, words as n-grams
    n_words = 0
    word_rows, seg_rows, seg_doc = [], [], []
    at_seg = 0
    gram_count, gram_bucket = [], []
    vocabulary, place_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at, part in slices(pa.array(texts, pa.large_string()), lower=True):
        part.words()
        if not len(part.starts):
            continue
        hashes = part.word_hashes()
        known, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        # a word of earlier slices keeps its place: its n-grams are held once
        near = np.minimum(np.searchsorted(vocabulary, known), max(len(vocabulary) - 1, 0))
        old = vocabulary[near] == known if len(vocabulary) else np.zeros(len(known), bool)
        place = np.empty(len(known), np.int64)
        place[old] = place_of[near[old]]
        place[~old] = n_words + np.arange((~old).sum())
        owner, bucket = grams(part, one[~old])
        gram_count.append(np.bincount(owner, minlength=(~old).sum()))
        gram_bucket.append(bucket.astype(np.int32))
        of_word, word_of, doc = segments(part.first, SEGMENT, back)
        word_rows.append(place[word_of])
        seg_rows.append(of_word + at_seg)
        seg_doc.append(doc + at)
        n_words, at_seg = n_words + int((~old).sum()), at_seg + len(doc)
        vocabulary, place_of = np.concatenate([vocabulary, known[~old]]), np.concatenate([place_of, place[~old]])
        order = np.argsort(vocabulary)
        vocabulary, place_of = vocabulary[order], place_of[order]
    if not n_words:
        return Model(None)
    gram_count, gram_bucket, word_rows, seg_rows, seg_doc = map(np.concatenate, (gram_count, gram_bucket, word_rows, seg_rows, seg_doc))
    gram_at = np.concatenate([[0], np.cumsum(gram_count)])
    word_at = np.searchsorted(seg_rows, np.arange(at_seg + 1))
    label = labels[seg_doc]
    rng = np.random.default_rng(13)

    def pieces(chosen):
        """n-grams of chosen segments: (place among the chosen, bucket, share in the mean)."""
        n = np.diff(word_at)[chosen]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        word = word_rows[np.repeat(word_at[chosen], n) + inner]
        seg = np.repeat(np.arange(len(chosen)), n)
        g = gram_at[word + 1] - gram_at[word]
        inner = np.arange(g.sum()) - np.repeat(np.cumsum(g) - g, g)
        share = np.repeat(1 / np.maximum(n, FEWEST), n) / np.maximum(g, 1)
        return np.repeat(seg, g), gram_bucket[np.repeat(gram_at[word], g) + inner], np.repeat(share, g).astype(np.float32)

    def margins():
        # a bucket met in few batches says little: its margin shrinks
        one = (table @ (head[:, 1] - head[:, 0])).astype(np.float64) * touched / (touched + RARE * touched.max())
        word = np.bincount(np.repeat(np.arange(n_words), gram_count), one[gram_bucket], n_words) / np.maximum(gram_count, 1)
        return np.bincount(seg_rows, word[word_rows], at_seg) / np.maximum(np.diff(word_at), FEWEST) + bias[1] - bias[0], one

    learned = np.flatnonzero(seg_doc % CALIBRATE != 0)
    epochs = max(epochs, min(10, -(-STEPS * batch // max(len(learned), 1))))
    for _ in range(epochs):
        order = rng.permutation(learned)
        for k in range(0, len(order), batch):
            chosen = order[k:k + batch]
            seg, bucket, share = pieces(chosen)
            mean = np.stack([np.bincount(seg, table[bucket, d] * share, len(chosen)) for d in range(DIM)], 1)
            logit = mean @ head + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            wrong = p.copy()
            wrong[np.arange(len(chosen)), label[chosen]] -= 1
            to_mean = (wrong @ head.T).astype(np.float32)
            used, where = np.unique(bucket, return_inverse=True)
            step = np.stack([np.bincount(where, to_mean[seg, d] * share, len(used)) for d in range(DIM)], 1)
            seen[used] += (step**2).mean(1)
            touched[used] += 1
            table[used] -= rate * step / np.sqrt(seen[used])[:, None]
            for value, total, gradient in ((head, seen_head, mean.T @ wrong / len(chosen)), (bias, seen_bias, wrong.mean(0))):
                total += gradient**2
                value -= 0.5 * rate * gradient / np.sqrt(total)
    value, one = margins()
    best = np.full(len(labels), bias[1] - bias[0])
    np.maximum.at(best, seg_doc, value)
    apart = np.arange(len(labels)) % CALIBRATE == 0
    apart = apart if len(set(labels[apart].tolist())) == 2 else ~apart
    scale, shift = calibrated(best[apart], labels[apart], weight)
    return Model(one, float(bias[1] - bias[0]), scale, shift)


def calibrated(value: np.ndarray, labels: np.ndarray, weight: float) -> tuple[float, float]:
    """Scale and shift of the document margin by logistic regression, classes as frequent as in the labels."""
    spread = value.std() or 1.0
    x, w = (value - value.mean()) / spread, np.where(labels == 1, weight, 1.0)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = w * (p - labels), np.maximum(w * p * (1 - p), 1e-9)
        m = np.array([[(h * x * x).sum() + 0.01, (h * x).sum()], [(h * x).sum(), h.sum() + 0.01]])
        da, db = np.linalg.solve(m, [(g * x).sum() + 0.01 * a, g.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return float(a / spread), float(b - a * value.mean() / spread)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Train on at most ``most`` documents of each class that are not held out. Runs jobs."""
    known = (labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
             .agg(F.max("toxic").cast("int").alias("_toxic")).filter(~held_out(F.col("_id"))))
    counts = {r[0]: r[1] for r in known.groupBy("_toxic").count().collect()}
    order = [F.xxhash64("_id"), F.col("_id")]
    ids = [known.filter(F.col("_toxic") == c).orderBy(*order).limit(most) for c in (0, 1)]
    sample = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(ids[0].union(ids[1])), "_id")
    rows = sorted(sample.select("_id", "text", "_toxic").collect(), key=lambda r: (r[0], r[1] or ""))
    toxic = np.array([r[2] for r in rows], np.int64)
    have = {c: max(int((toxic == c).sum()), 1) for c in (0, 1)}
    weight = (counts.get(1, 0) / max(counts.get(0, 0), 1)) / (have[1] / have[0])
    return train([r[1] or "" for r in rows], toxic, weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    def run(batches):
        for batch in batches:
            value = [model.scores(texts) for _, texts in slices(batch.column(1), lower=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(value) if value else np.zeros(0))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    return score(docs, fit(docs, labels, most))
