"""Shape outliers: Mahalanobis distance of the ten shape features within a task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.operators.chunks import spread_join
from motionlake.operators.phases import FEATURES
from motionlake.schema import EP, TASK

CHI2_99_10 = 23.209251158954356  # fixed value: 0.99 quantile of chi-squared with 10 degrees of freedom


def standardised(features: DataFrame, keys=TASK) -> DataFrame:
    """Features with their z-scores (array ``z`` in feature order)."""
    st = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                     *[F.avg(f).alias(f"_m{i}") for i, f in enumerate(FEATURES)],
                                     *[F.stddev_pop(f).alias(f"_s{i}") for i, f in enumerate(FEATURES)])
    j = spread_join(features, st, keys)
    z = F.array(*[(F.col(f) - F.col(f"_m{i}")) / F.greatest(F.col(f"_s{i}"), F.lit(1e-9)) for i, f in enumerate(FEATURES)])
    drop = [f"_{p}{i}" for p in "ms" for i in range(len(FEATURES))]
    return j.withColumn("z", z).drop(*drop)


def shape_covariance(scored: DataFrame, keys=TASK) -> DataFrame:
    """Sample covariance of the z-scores: (task, i, j, cov) for i <= j, combined before the shuffle."""
    k = len(FEATURES)
    cols = [F.col("z")[i].alias(f"z{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    a = scored.select(*keys, *cols).groupBy(*keys).agg(*[F.covar_samp(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("cov")) for i, j in pairs])
    return a.select(*keys, F.inline(cells))


def _matrix(cell) -> Column:
    """A square array of rows of the features' size, from cell(i, j)."""
    k = F.sequence(F.lit(0), F.lit(len(FEATURES) - 1))
    return F.transform(k, lambda i: F.transform(k, lambda j: cell(i, j)))


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def _let(value, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def factor(m: Column, tolerance: float = 1e-12) -> Column:
    """Columns of L with m = L L', as many as the rank: elimination by the largest pivot that is left."""
    size = len(FEATURES)
    top = _let(m, lambda a: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: a[i][i])))

    def step(acc, _):
        a = acc["a"]
        pivot = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(a[i][i].alias("v"), (-i).alias("i"))))
        column = _let(pivot, lambda p: F.when(p["v"] > acc["top"] * tolerance, F.transform(a, lambda row: row[-p["i"]] / F.sqrt(p["v"]))))
        return _let(column, lambda c: F.when(c.isNull(), acc).otherwise(F.struct(
            F.transform(a, lambda row, i: F.zip_with(row, c, lambda x, y: x - c[i] * y)).alias("a"), F.concat(acc["l"], F.array(c)).alias("l"), acc["top"].alias("top"))))

    start = F.struct(m.alias("a"), F.array().cast("array<array<double>>").alias("l"), top.alias("top"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), start, step, lambda acc: acc["l"])


def inverse(m: Column) -> Column:
    """Inverse of a positive definite array of rows, by elimination in place."""
    def step(a, p):
        return _let(a[p][p], lambda d: F.transform(a, lambda row, i: F.transform(row, lambda x, j: F.when((i == p) & (j == p), 1 / d).when(i == p, x / d).when(j == p, -x / d)
                                                                                 .otherwise(x - row[p] * a[p][j] / d))))

    return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), m, step)


def inverse_covariance(cov: DataFrame, keys=TASK) -> DataFrame:
    """Pseudo-inverse of each task's matrix: (task, inv array of rows), in column expressions.

    With m = L L' of full column rank, the pseudo-inverse is L S S L' for S = inverse of L'L.
    """
    cells = cov.filter("cov is not null").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") * len(FEATURES) + F.col("j")).alias("k"), F.col("cov").alias("v")))).alias("_c"))
    rows = cells.select(*keys, _matrix(lambda i, j: F.element_at("_c", F.least(i, j) * len(FEATURES) + F.greatest(i, j))).alias("_m"))
    rows = rows.select(*keys, factor(F.col("_m")).alias("_l"))
    # nothing varies: the pseudo-inverse is zero
    gram = F.transform("_l", lambda a: F.transform("_l", lambda b: _dot(a, b)))
    rows = rows.select(*keys, "_l", F.when(F.size("_l") > 0, inverse(gram)).alias("_s"))
    rows = rows.select(*keys, "_l", F.transform("_s", lambda a: F.transform("_s", lambda b: _dot(a, b))).alias("_t"))
    place = F.sequence(F.lit(0), F.lit(len(FEATURES) - 1))
    across = F.transform(place, lambda i: F.transform("_l", lambda c: c[i]))
    rows = rows.select(*keys, "_t", across.alias("_r"))
    cell = lambda a, b: _dot(F.transform(F.col("_t"), lambda t: _dot(t, a)), b)
    return rows.select(*keys, F.when(F.col("_t").isNull(), _matrix(lambda i, j: F.lit(0.0))).otherwise(F.transform("_r", lambda a: F.transform("_r", lambda b: cell(a, b)))).alias("inv"))


def mahalanobis(scored: DataFrame, inverse: DataFrame, keys=TASK) -> DataFrame:
    """Adds contribution per feature (z·inv)_j z_j and their sum d2."""
    j = spread_join(scored, inverse, keys)
    contrib = F.zip_with("inv", "z", lambda row, zj: zj * F.aggregate(F.zip_with(row, F.col("z"), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x))
    j = j.withColumn("contrib", contrib)
    return j.withColumn("d2", F.aggregate("contrib", F.lit(0.0), lambda t, x: t + x)).drop("inv")


def shape_label(feature, high, value) -> Column:
    """Wording of one dominant feature (fixed values)."""
    v = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    pick = lambda a, b: F.when(high, a).otherwise(b)
    return (F.when(feature == "num_gripper_events", F.concat(v, F.lit(" gripper open/close events (more than typical)")))
            .when(feature == "num_pauses", F.concat(v, F.lit(" velocity "), F.when(value != 1, "pauses").otherwise("pause"),
                                                    F.lit(" mid-trajectory ("), pick("many", "few"), F.lit(")")))
            .when(feature == "path_directness", pick("path is unusually straight", "path wanders noticeably (not direct start-to-end)"))
            .when(feature == "arc_length_xyz", pick("much more total translation than typical", "much less total translation than typical"))
            .when(feature == "arc_length_rot", pick("much more wrist rotation than typical", "much less wrist rotation than typical"))
            .when(feature == "num_direction_changes", F.concat(pick("jerky motion (", "unusually smooth motion ("), v, F.lit(" velocity sign flips)")))
            .when(feature == "episode_duration", pick("much longer than typical", "much shorter than typical"))
            .when(feature == "z_range", pick("wider vertical range than typical", "lower ceiling than typical"))
            .when(feature == "xy_bbox_area", pick("wider workspace than typical", "compact workspace"))
            .otherwise(pick("gripper held closed longer than typical", "gripper held closed less than typical")))


def shape_outlier_flags(features: DataFrame, limit: float = CHI2_99_10, keys=TASK) -> DataFrame:
    """Episodes beyond the chi-squared limit, worded by their one or two dominant features."""
    scored = standardised(features, keys)
    m = mahalanobis(scored, inverse_covariance(shape_covariance(scored, keys), keys), keys).filter(F.col("d2") > limit)
    names = F.array(*map(F.lit, FEATURES))
    values = F.array(*[F.col(f).cast("double") for f in FEATURES])
    ranked = F.reverse(F.array_sort(F.zip_with(
        F.sequence(F.lit(0), F.lit(len(FEATURES) - 1)), "contrib",
        lambda i, c: F.struct(F.abs(c).alias("a"), (-i).alias("o"), F.get(names, i).alias("f"), (c > 0).alias("up"), F.get(values, i).alias("v")))))
    top = F.filter(F.slice(ranked, 1, 2), lambda x: x["a"] / F.col("d2") > 0.1)
    m = m.withColumn("_top", top)
    label = F.when(F.size("_top") == 0, "multi-axis deviation without one dominant cause").otherwise(
        F.concat_ws("; ", F.transform("_top", lambda x: shape_label(x["f"], x["up"], x["v"]))))
    feature = F.when(F.size("_top") == 0, "combined").otherwise(F.concat_ws(",", F.transform("_top", lambda x: x["f"])))
    return m.select(*EP, F.lit("shape").alias("signal"), F.lit(None).cast("string").alias("phase"), F.lit(None).cast("long").alias("cycle"),
                    feature.alias("feature"), F.round("d2", 2).alias("magnitude"),
                    F.concat(F.lit("Unusual trajectory shape: "), label).alias("explanation"), F.lit(4).alias("ordinal"))
