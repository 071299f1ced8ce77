"""Operator 11: whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

1. Entries become whole numbers. Counts and sums per dimension are exact; the scatter is centred
   before multiplying: each task adds the outer products of its centred rows, and the tasks' sums meet
   entry by entry in an aggregate. Only ``dims`` x ``dims`` numbers reach the driver.
2. The scatter is factored with diagonal pivoting, A = P L L' P'.
3. Rotations from the right make the columns of the triangular factor orthogonal, in rounds of
   disjoint pairs. Then the squared norms of the columns are the eigenvalues, and the
   normalised columns, with the pivoting undone, the components.
4. Rows are projected on the leading components; the covariance of the result is measured
   in one more aggregate.

Defined cases: rows whose vector is null, holds a null or non-finite entry, or one beyond
2^52 / ``scale`` (no exact whole number), are left out, as are rows with another number of
dimensions than ``dims`` (if not given, the most frequent number, of equals the least); repeated
rows count as often as they stand; a null id is kept; directions without variance have no component,
so equal vectors give no rows; an empty table gives no rows; other columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.llm.common import Scratch

SCALE, SHIFT, MOST = 1024, 100_000, 8

PROJECTED = "vec_id bigint, deviation decimal(38,0), whitened array<double>"


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Whether all entries are numbers that scale to exact whole ones."""
    most = F.lit(float((1 << 52) // scale))
    return vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > most))


def whole(column: pa.Array, dims: int, scale: int, shift: int) -> np.ndarray:
    """Rows of whole numbers of a batch."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(-1, dims) * scale).astype(np.int64) + shift


def sums(vectors: DataFrame, dims: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """Exact count and sums per dimension. Runs a job."""
    def run(batches):
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = whole(batch.column(0), dims, scale, shift)
            n += len(x)
            # halves keep the sums of a task inside 64 bits
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)], names=["d", "n", "high", "low"])

    part = vectors.select("v").mapInArrow(run, "d bigint, n bigint, high bigint, low bigint")
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = {r["d"]: r for r in part.groupBy("d").agg(big("n"), big("high"), big("low")).collect()}
    if not rows:
        return 0, [0] * dims
    return int(rows[0]["n"]), [(int(rows[d]["high"]) << 32) + int(rows[d]["low"]) for d in range(dims)]


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S / n as doubles: the whole part of the mean is taken off exactly."""
    whole_part = np.array([s // n for s in total], np.int64)
    rest = np.array([(s % n) / n for s in total])
    return (x - whole_part).astype(np.float64) - rest


def scatter(vectors: DataFrame, dims: int, n: int, total: list[int], scale: int, shift: int) -> np.ndarray:
    """Centred scatter matrix. Runs a job; each task gives one number per entry."""
    upper = np.triu_indices(dims)

    def run(batches):
        a = np.zeros((dims, dims))
        for batch in batches:
            y = centred(whole(batch.column(0), dims, scale, shift), n, total)
            a += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(a[upper])], names=["at", "value"])

    part = vectors.select("v").mapInArrow(run, "at bigint, value double")
    out = np.zeros((dims, dims))
    for r in part.groupBy("at").agg(F.sum("value").alias("value")).collect():
        i, j = upper[0][r["at"]], upper[1][r["at"]]
        out[i, j] = out[j, i] = r["value"]
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L) with a[order][:, order] = L L'; L has as many columns as the rank, pivots fall."""
    n = len(a)
    work, order, factor = a.copy(), np.arange(n), np.zeros((n, n))
    least = n * np.finfo(float).eps * max(float(np.diag(a).max(initial=0.0)), 0.0)
    for k in range(n):
        p = k + int(np.argmax(np.diag(work)[k:]))
        if not work[p, p] > least:
            return order, factor[:, :k]
        for m in (work, factor):
            m[[k, p]] = m[[p, k]]
        work[:, [k, p]] = work[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(work[k, k])
        factor[k + 1:, k] = work[k + 1:, k] / factor[k, k]
        work[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return order, factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor times rotations from the right, with orthogonal columns.

    A sweep visits every pair of columns once, in rounds of disjoint pairs (the circle method). It
    ends when no pair is off by more than rounding.
    """
    g = factor.copy()
    r = g.shape[1]
    if r < 2:
        return g
    seats = np.arange(r + r % 2)
    half, tiny = len(seats) // 2, np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            p, q = seats[:half], seats[half:][::-1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            x, y = g[:, p], g[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(gamma) / np.sqrt(alpha * beta)
            worst = max(worst, float(off.max()))
            turn = off > tiny
            zeta = (beta - alpha)[turn] / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            x, y, p, q = x[:, turn], y[:, turn], p[turn], q[turn]
            g[:, p], g[:, q] = c * x - s * y, s * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= 4 * tiny * r:
            return g
    return g


def components(covariance_times_n: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and their unit components as columns."""
    order, factor = pivoted_cholesky(covariance_times_n)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    by_size = np.argsort(-norms, kind="stable")
    unit = np.zeros_like(turned)
    unit[order] = turned / np.where(norms > 0, norms, 1)
    return (norms * norms / n)[by_size], unit[:, by_size]


def project(vectors: DataFrame, dims: int, n: int, total: list[int], values: np.ndarray, unit: np.ndarray, scale: int, shift: int) -> DataFrame:
    """PROJECTED: exact deviations and whitened coordinates."""
    basis = unit / np.sqrt(values)

    def deviations(x: np.ndarray) -> list[int]:
        d = [x[:, k].astype(object) * n - total[k] for k in range(dims)] if float(np.abs(x).max(initial=0)) * n >= 2.0**62 else None
        if d is None:
            y = x * n - np.array(total, np.int64)
            if float(np.abs(y).max(initial=0)) ** 2 * dims < 2.0**62:
                return (y * y).sum(1).tolist()
            d = [y[:, k].astype(object) for k in range(dims)]
        return list(sum(k * k for k in d))

    def run(batches):
        from decimal import Decimal

        for batch in batches:
            x = whole(batch.column(1), dims, scale, shift)
            w = np.ascontiguousarray(centred(x, n, total) @ basis)
            d = [Decimal(int(v)) if abs(v) < 10**38 else None for v in deviations(x)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d, pa.decimal128(38, 0)), flat], names=["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "v").mapInArrow(run, PROJECTED)


def whiten(rows: DataFrame, most: int = MOST, dims: int | None = None, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, dict]:
    """(vec_id, deviation, whitened) and the fit: n, sums, values, components, explained, identity_error. Runs jobs.

    ``deviation`` is the exact sum of (n * x - S)^2; null where it has over 38 digits.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    vector = F.col("embedding")
    sound = rows.filter(usable(vector, scale)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda c: c.cast("double")).alias("v"))
    if dims is None:
        # vectors without entries have no direction
        dims = sound.groupBy(F.size("v").alias("dims")).count().filter("dims > 0").agg(F.max_by("dims", F.struct("count", -F.col("dims")))).first()[0] or 1
    sound = sound.filter(F.size("v") == dims)
    n, total = sums(sound, dims, scale, shift)
    fit = {"n": n, "sums": total, "values": np.zeros(0), "components": np.zeros((dims, 0)), "explained": [], "identity_error": 0.0}
    if not n:
        return spark.createDataFrame([], PROJECTED), fit
    spread = scatter(sound, dims, n, total, scale, shift)
    values, unit = components(spread, n)
    fit["explained"] = (values / (np.trace(spread) / n)).tolist()[:most] if len(values) else []
    values, unit = values[:most], unit[:, :most]
    fit |= {"values": values, "components": unit}
    if not len(values):
        return spark.createDataFrame([], PROJECTED), fit
    out = scratch.keep(project(sound, dims, n, total, values, unit, scale, shift))
    w = [F.get("whitened", F.lit(i)) for i in range(len(values))]
    mean = out.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
    pairs = [(i, j) for i in range(len(w)) for j in range(i, len(w))]
    second = out.agg(*[F.avg((w[i] - F.lit(mean[i])) * (w[j] - F.lit(mean[j]))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    fit["identity_error"] = max(abs(second[k] - (i == j)) for k, (i, j) in enumerate(pairs))
    return out, fit


def components_by_row(rows: DataFrame, **options) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error. Runs jobs.

    ``deviation`` as long is null beyond 64 bits; ``deviation_exact`` still has it.
    """
    out, fit = whiten(rows, **options)
    explained = F.array(*map(F.lit, fit["explained"])).cast("array<double>")
    return out.select("vec_id", F.col("deviation").alias("deviation_exact"), F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit["n"]).cast("long").alias("n"), F.col("deviation_exact").try_cast("long").alias("deviation"), "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(float(fit["identity_error"])).alias("identity_error"), "deviation_exact")
