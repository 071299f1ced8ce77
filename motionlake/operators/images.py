"""Scores of decoded frames held as rows (height, width, channels, flat pixel array).

Sampling comes first, so pixels of unsampled frames are not processed. One frame is one row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionlake.functions.vectors import clip
from motionlake.operators.chunks import by_frame, chunked, own
from motionlake.operators.projections import even_sample
from motionlake.schema import EP


def resolution_score(height="height", width="width", reference: int = 1080 * 1920) -> Column:
    s = F.least(F.lit(1.0), F.col(height) * F.col(width) / F.lit(float(reference)))
    return F.when(s < 0.1, 0.1 + s * 0.5).otherwise(s)


def gray(pixels="pixels", channels="channels") -> Column:
    """Mean over the channels, as a flat array of doubles."""
    p, k = F.col(pixels), F.col(channels)
    return F.transform(F.sequence(F.lit(0), (F.size(p) / k).cast("int") - 1), lambda i: F.aggregate(
        F.slice(p, i * k + 1, k), F.lit(0.0), lambda s, x: s + x) / k)


def _spread(df: DataFrame, arr: str, mean: str, var: str) -> DataFrame:
    n = F.size(arr)
    df = df.withColumn(mean, F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / n)
    return df.withColumn(var, F.aggregate(F.transform(arr, lambda x: (x - F.col(mean)) * (x - F.col(mean))), F.lit(0.0), lambda s, x: s + x) / n)


def laplacian(df: DataFrame, name: str = "lap") -> DataFrame:
    """4-neighbour Laplacian of the gray image with replicated edges."""
    g, h, w = F.col("gray"), F.col("height").cast("int"), F.col("width").cast("int")

    def at(i):
        y, x = F.floor(i / w).cast("int"), i % w
        cell = lambda yy, xx: F.get(g, F.least(F.greatest(yy, F.lit(0)), h - 1) * w + F.least(F.greatest(xx, F.lit(0)), w - 1))
        return cell(y - 1, x) + cell(y + 1, x) + cell(y, x - 1) + cell(y, x + 1) - cell(y, x) * 4.0

    return df.withColumn(name, F.transform(F.sequence(F.lit(0), h * w - 1), at))


def blur_score(variance) -> Column:
    v = F.col(variance)
    return clip(F.when(v < 50, v / 100.0).when(v < 500, 0.5 + (v - 50) / 900.0).otherwise(F.lit(1.0)))


def exposure_score(pixels="pixels") -> Column:
    """Clipping at both ends and distance of the mean brightness from the middle.

    256 bins over 0..255: the first five hold values 0..4, the last five 251..255.
    """
    p = F.col(pixels)
    n = F.size(p)
    count = lambda f: F.size(F.filter(p, f)) / n
    penalty = F.least(F.lit(1.0), (count(lambda x: x < 5) + count(lambda x: x > 250)) * 10)
    mean = F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / n / 255.0
    return clip(0.6 * (1.0 - F.abs(mean - 0.5) * 2) + 0.4 * (1.0 - penalty))


def contrast_score(sigma) -> Column:
    """Bands of the gray sigma. Multi-channel gray keeps its 0..255 scale, as in the method."""
    s = F.col(sigma)
    return clip(F.when(s < 0.1, s / 0.1 * 0.5).when(s < 0.25, 0.5 + (s - 0.1) / 0.15 * 0.5).when(s < 0.4, F.lit(1.0))
                .otherwise(F.greatest(F.lit(0.5), 1.0 - (s - 0.4) * 2)))


def frame_visual_scores(images: DataFrame) -> DataFrame:
    """Four scores and their weighted sum per frame."""
    d = _spread(images.withColumn("gray", gray()), "gray", "_gm", "_gv")
    d = _spread(laplacian(d), "lap", "_lm", "_lv")
    small = (F.col("height") < 3) | (F.col("width") < 3)
    scale = F.when(F.col("channels") == 1, F.lit(255.0)).otherwise(F.lit(1.0))
    d = d.withColumn("_lv", F.when(small, F.lit(0.0)).otherwise(F.col("_lv"))).withColumn("_sd", F.sqrt(F.greatest(F.col("_gv"), F.lit(0.0))) / scale)
    d = d.select(*EP, "frame_index", resolution_score().alias("resolution_score"), blur_score("_lv").alias("blur_score"),
                 exposure_score().alias("exposure_score"), contrast_score("_sd").alias("contrast_score"))
    return d.withColumn("overall_visual_score", 0.25 * F.col("resolution_score") + 0.35 * F.col("blur_score") + 0.25 * F.col("exposure_score") + 0.15 * F.col("contrast_score"))


def visual_metrics(images: DataFrame, sample: int = 10) -> DataFrame:
    """Scores averaged over evenly sampled frames of an episode."""
    s = frame_visual_scores(even_sample(images, sample))
    return s.groupBy(*EP).agg(*[F.avg(x).alias(x) for x in ("resolution_score", "blur_score", "exposure_score", "contrast_score", "overall_visual_score")])


def image_motion(images: DataFrame) -> DataFrame:
    """Mean absolute gray change to the next frame: (episode, frame_index, motion)."""
    one = F.transform(F.col("pixels"), lambda x: x.cast("double"))
    first = F.transform(F.sequence(F.lit(0), (F.size("pixels") / F.col("channels")).cast("int") - 1), lambda i: F.get(F.col("pixels"), i * F.col("channels")).cast("double"))
    g = images.select(*EP, "frame_index", F.when(F.col("channels") == 3, gray()).when(F.col("channels") == 1, one).otherwise(first).alias("gray"))
    d = own(chunked(g).withColumn("_n", F.lead("gray").over(by_frame()))).filter("_n is not null")
    return d.select(*EP, "frame_index", (F.aggregate(F.zip_with("gray", "_n", lambda a, b: F.abs(b - a)), F.lit(0.0), lambda s, x: s + x) / F.size("gray")).alias("motion"))
