"""Power of a long series in the lower half of its spectrum, without gathering the series.

A transform of any length n is a convolution with a chirp (Bluestein); the convolution uses
transforms of length P x Q, done as column transforms of length P, a twist, and row transforms
of length Q. A task holds one column or one row, i.e. about the square root of the series.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionlake.operators.chunks import materialise


def _transform(rows: DataFrame, keys) -> DataFrame:
    """Discrete Fourier transform of sparse rows (keys, p, q, t, re, im): (keys, p, q, k, re, im)."""
    types = dict(rows.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)

    def columns(key, pdf):
        *k, p, q, t2 = key
        x = np.zeros(p, dtype=complex)
        x[pdf["t"].to_numpy() // q] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = np.fft.fft(x) * np.exp(-2j * np.pi * (t2 * np.arange(p) % (p * q)) / (p * q))
        return pd.DataFrame({**dict(zip(keys, k)), "p": p, "q": q, "k1": np.arange(p), "t2": t2, "re": y.real, "im": y.imag})

    def lines(key, pdf):
        *k, p, q, k1 = key
        x = np.zeros(q, dtype=complex)
        x[pdf["t2"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        y = np.fft.fft(x)
        return pd.DataFrame({**dict(zip(keys, k)), "p": p, "q": q, "k": k1 + p * np.arange(q), "re": y.real, "im": y.imag})

    c = rows.withColumn("t2", F.col("t") % F.col("q")).groupBy(*keys, "p", "q", "t2").applyInPandas(columns, f"{head}, p long, q long, k1 long, t2 long, re double, im double")
    return c.groupBy(*keys, "p", "q", "k1").applyInPandas(lines, f"{head}, p long, q long, k long, re double, im double")


def low_power(series: DataFrame, keys, group) -> DataFrame:
    """(keys, low, total) of rows (keys, n, t, v), n the length; ``group`` + dim are the keys.

    The chirp depends on the length alone, so it is transformed once per ``group``.
    """
    bits = F.ceil(F.log2(2.0 * F.col("n"))) + 1
    s = series.withColumn("p", F.pow(F.lit(2.0), F.floor(bits / 2)).cast("long")).withColumn("q", F.pow(F.lit(2.0), F.ceil(bits / 2)).cast("long"))
    s = materialise(s)
    angle = F.lit(np.pi) * ((F.col("t") * F.col("t")) % (2 * F.col("n"))) / F.col("n")
    a = s.select(*keys, "p", "q", "t", (F.col("v") * F.cos(angle)).alias("re"), (-F.col("v") * F.sin(angle)).alias("im"))
    places = F.array_compact(F.array(F.col("t"), F.when(F.col("t") > 0, F.col("p") * F.col("q") - F.col("t"))))
    b = s.filter("dim = 0").select(*group, "p", "q", F.cos(angle).alias("re"), F.sin(angle).alias("im"), F.explode(places).alias("t"))
    fa = _transform(a, list(keys))
    fb = _transform(b, list(group)).select(*group, "k", F.col("re").alias("br"), F.col("im").alias("bi"))
    c = fa.join(fb, [*group, "k"])
    # the inverse transform is the transform of the conjugate, over the length
    c = c.select(*keys, "p", "q", F.col("k").alias("t"), (F.col("re") * F.col("br") - F.col("im") * F.col("bi")).alias("re"),
                 (-(F.col("re") * F.col("bi") + F.col("im") * F.col("br"))).alias("im"))
    size = s.groupBy(*group).agg(F.max("n").alias("n"))
    y = _transform(c, list(keys)).join(size, list(group))
    m = (F.col("p") * F.col("q")).cast("double")
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (m * m)
    kept = F.floor(F.col("n") / 2) + 1
    return y.filter(F.col("k") < kept).groupBy(*keys).agg(F.sum(F.when(F.col("k") < F.floor(kept / 2), power).otherwise(0.0)).alias("low"), F.sum(power).alias("total"))
