"""Array-of-double expressions, evaluated in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x):
    return F.col(x) if isinstance(x, str) else x


def minus(a, b) -> Column:
    return F.zip_with(c(a), c(b), lambda x, y: x - y)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    """L2 norm, null when the vector is null."""
    return F.sqrt(F.aggregate(c(a), F.lit(0.0), lambda s, x: s + x * x))


def pick(a, indices) -> Column:
    """Sub-vector of the indices that exist in the vector."""
    a = c(a)
    return F.filter(F.array(*[F.get(a, F.lit(i)) for i in indices]), lambda x: x.isNotNull())


def magnitude(a, indices) -> Column:
    """L2 norm over the indices present in the vector; absent ones count as nothing."""
    total = None
    for i in indices:
        v = F.coalesce(F.get(c(a), F.lit(i)), F.lit(0.0))
        total = v * v if total is None else total + v * v
    return F.sqrt(total)


def motion(a) -> Column:
    """All dimensions but the last (the gripper)."""
    a = c(a)
    return F.slice(a, F.lit(1), F.size(a) - 1)


def last(a) -> Column:
    return F.element_at(c(a), -1)


def clip(x, lo=0.0, hi=1.0) -> Column:
    return F.least(F.greatest(c(x), F.lit(lo)), F.lit(hi))


def sign_plus(x) -> Column:
    """Sign with zero counted as positive."""
    return F.when(c(x) < 0, -1).otherwise(1)


def fmt(pattern: str, *cols) -> Column:
    return F.format_string(pattern, *[c(x) for x in cols])


def capitalize(x) -> Column:
    """First letter upper, the rest lower."""
    x = c(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20)))


def pct(p: float):
    """Fractional rank of a linear-interpolated percentile."""
    return lambda n: (n - 1) * F.lit(float(p) / 100.0)


def one_decimal(x) -> Column:
    """Text of a non-negative double with one decimal, rounded half to even on its exact value.

    8x + 2x with its rounding error is 10x exactly, so ties are judged on the stored number.
    """
    x = c(x).cast("double")
    s = x * 8.0 + x * 2.0
    rest = (s - F.floor(s) - 0.5) + (x * 2.0 - (s - x * 8.0))
    low = F.floor(s).cast("long")
    r = F.when(rest > 0, low + 1).when(rest < 0, low).otherwise(low + low % 2)
    return F.concat(F.floor(r / 10).cast("long").cast("string"), F.lit("."), (r % 10).cast("string"))


def whole(x) -> Column:
    """Text of a double without decimals, ties to even."""
    return F.bround(c(x)).cast("long").cast("string")
