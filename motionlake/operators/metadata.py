"""Dataset metadata: descriptions, feature lists, catalogue cards, manifests."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.scalars import classify_feature, detect_format, extension
from motionlake.functions.vectors import c

# Words that decide a tag, in order of precedence.
ENVIRONMENT = [("Household", ["household", "home", "kitchen", "domestic"]), ("Factory", ["factory", "industrial", "manufacturing", "assembly"]),
               ("Laboratory", ["laboratory", "lab", "research"]), ("Outdoor", ["outdoor", "field", "nature"])]
PERSPECTIVE = [("Egocentric", ["egocentric", "first-person", "first person", "ego-view"]), ("Third-person", ["third-person", "third person", "external view"]),
               ("Robotic", ["robotic", "robot arm", "manipulator"])]
MODALITY = [("rgb", ["rgb", "color image", "video"]), ("depth", ["depth"]), ("imu", ["imu", "inertial", "accelerometer", "gyroscope"]),
            ("tactile", ["tactile", "touch sensor", "force sensor"]), ("actions", ["action", "trajectory", "end-effector"])]
HOURS = r"(\d+(?:,\d+)?(?:\.\d+)?)\s*(?:k|K)?\s*(?:hours?|hrs?|h)\b"
CLIPS = r"(\d+(?:,\d+)?(?:\.\d+)?)\s*(?:million|M|k|K)?\s*(?:clips?|episodes?|videos?|samples?)\b"

FEATURES_SCHEMA = ("struct<fps:double,codebase_version:string,robot_type:string,total_episodes:bigint,total_frames:bigint,total_tasks:bigint,total_videos:bigint,"
                   "features:map<string,struct<dtype:string,shape:array<int>,names:string,info:map<string,string>>>>")


def _strip(x) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _has(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _first_tag(text: Column, rules) -> Column:
    out = None
    for name, words in rules:
        out = F.when(_has(text, words), name) if out is None else out.when(_has(text, words), name)
    return out


def readme_summary(text, limit: int = 500) -> Column:
    """First text outside front matter, headings and tables, joined and cut to the limit.

    A fold over the lines: the flag flips at every ``---``; text past the limit is not kept.
    """
    fold = F.aggregate(
        F.transform(F.split(c(text), "\n"), _strip), F.struct(F.lit(False).alias("y"), F.lit("").alias("o")),
        lambda a, line: F.when(line == "---", F.struct((~a["y"]).alias("y"), a["o"].alias("o")))
        .when(a["y"] | (line == "") | line.startswith("#") | line.startswith("|") | (F.length(a["o"]) > limit), a)
        .otherwise(F.struct(a["y"].alias("y"), F.when(a["o"] == "", line).otherwise(F.concat(a["o"], F.lit(" "), line)).alias("o"))),
        lambda a: a["o"])
    return F.nullif(F.substring(fold, 1, limit), F.lit(""))


def readme_tags(df: DataFrame, text: str = "text") -> DataFrame:
    """environment, perspective and modalities (comma list, null when none)."""
    t = F.lower(F.col(text))
    mods = F.concat_ws(",", *[F.when(_has(t, w), n) for n, w in MODALITY])
    return df.select("*", _first_tag(t, ENVIRONMENT).alias("environment"), _first_tag(t, PERSPECTIVE).alias("perspective"), F.nullif(mods, F.lit("")).alias("modalities"))


def readme_scale(df: DataFrame, text: str = "text") -> DataFrame:
    """estimated_hours and estimated_clips with k / M multipliers."""
    t = F.col(text)

    def found(pattern):
        number = F.regexp_replace(F.regexp_extract(t, pattern, 1), ",", "")
        return F.when(number != "", number.cast("double")), F.lower(F.regexp_extract(t, pattern, 0))

    hours, htext = found(HOURS)
    clips, ctext = found(CLIPS)
    clips = F.when(ctext.contains("million") | ctext.endswith("m"), clips * 1000000).when(ctext.contains("k"), clips * 1000).otherwise(clips)
    return df.select("*", F.when(htext.contains("k"), hours * 1000).otherwise(hours).alias("estimated_hours"), F.floor(clips).cast("long").alias("estimated_clips"))


def front_matter_license(text) -> Column:
    """Licence in the front matter; the last line wins."""
    t = c(text)
    body = F.regexp_extract(t, r"(?s)^---(.*?)---", 1)
    value = lambda line: F.regexp_replace(F.regexp_replace(_strip(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1)), r'^"+|"+$', ""), r"^'+|'+$", "")
    lines = F.filter(F.split(_strip(body), "\n"), lambda line: line.contains(":") & (F.lower(_strip(F.regexp_extract(line, "^([^:]*):", 1))) == "license"))
    return F.when(t.startswith("---"), F.nullif(value(F.get(lines, F.size(lines) - 1)), F.lit("")))


def catalog_card(df: DataFrame, text: str = "description") -> DataFrame:
    """Version, robot type and totals from a card's text."""
    t = F.col(text)
    pick = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    total = lambda k: pick(f'"{k}"\\s*:\\s*(\\d+)').cast("long").alias(k)
    return df.select("*", pick(r'"codebase_version"\s*:\s*"(v?[\d.]+)"').alias("codebase_version"), pick(r'"robot_type"\s*:\s*"([^"]+)"').alias("robot_type"),
                     total("total_episodes"), total("total_frames"), total("total_tasks"))


# ---------------------------------------------------------------- features

def read_features(info: DataFrame, text: str = "info_json") -> DataFrame:
    """Explode a dataset's feature map: (..., key, dtype, shape, names, is_depth, group).

    ``names`` is a flat list or a map holding a list; both give the list.
    """
    rest = [x for x in info.columns if x != text]
    parsed = info.select(*rest, F.from_json(F.col(text), FEATURES_SCHEMA).alias("_i"))
    e = parsed.select(*rest, F.explode("_i.features").alias("key", "_f")).filter("_f is not null")
    flat = F.from_json("_f.names", "array<string>")
    held = F.map_values(F.from_json("_f.names", "map<string,array<string>>"))
    names = F.when(F.col("_f.names").startswith("["), flat).when(F.col("_f.names").startswith("{"), F.get(F.filter(held, lambda x: x.isNotNull()), F.lit(0)))
    depth = F.coalesce(F.col("_f.info")["video.is_depth_map"] == "true", F.lit(False)) | F.lower("key").contains("depth")
    return e.select(*rest, "key", F.coalesce("_f.dtype", F.lit("?")).alias("dtype"), F.col("_f.shape").alias("shape"), names.alias("names"),
                    depth.alias("is_depth"), classify_feature("key", F.coalesce("_f.dtype", F.lit("?"))).alias("feature_group"))


def modalities(features: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """rgb, depth, actions present in the features (comma list); rgb when none."""
    image = F.col("dtype").isin("video", "image")
    has = lambda cond: F.coalesce(F.max(cond), F.lit(False))
    a = features.groupBy(*keys).agg(has(image & ~F.col("is_depth")).alias("r"), has(image & F.col("is_depth")).alias("d"), has(F.col("key") == "action").alias("a"))
    text = F.concat_ws(",", F.when(F.col("r"), "rgb"), F.when(F.col("d"), "depth"), F.when(F.col("a"), "actions"))
    return a.select(*keys, F.when(text == "", "rgb").otherwise(text).alias("modalities"))


def camera_keys(features: DataFrame) -> DataFrame:
    """Non-depth camera features."""
    named = F.col("key").startswith("observation.images.") | (F.col("key") == "observation.image")
    return features.filter(named & F.col("dtype").isin("video", "image") & ~F.col("is_depth"))


def primary_camera(keys_df: DataFrame, keys=("dataset_id",)) -> DataFrame:
    """Lowest rank (depth +100, wrist +10, image2 +5), then name."""
    k = F.lower("key")
    rank = (F.when(k.contains("depth"), 100).otherwise(0) + F.when(k.contains("wrist"), 10).otherwise(0) + F.when(F.col("key").endswith("image2"), 5).otherwise(0))
    return keys_df.groupBy(*keys).agg(F.min_by("key", F.struct(rank.alias("r"), F.col("key"))).alias("primary_camera"))


def classify_dims(df: DataFrame, style: str = "server", labels: str = "labels", dims: str = "dims") -> DataFrame:
    """Two groups of dimensions and the grippers of a dataset, by their labels.

    ``style`` 'server' halves by floor and needs a label per dimension; 'ui' halves by ceil and
    knows left and right arms.
    """
    n, lab = F.col(dims), F.col(labels)
    ui = style == "ui"
    seq = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    low = F.transform(lab, lambda x: F.lower(x))
    index = F.sequence(F.lit(0), n - 1)
    at = lambda i: F.get(low, i)
    grips = F.filter(index, lambda i: F.coalesce(at(i).contains("grip"), F.lit(False)))
    rest = F.filter(index, lambda i: ~F.coalesce(at(i).contains("grip"), F.lit(False)))

    def spot(names, words):
        match = lambda i: F.coalesce(at(i).isin(names), F.lit(False)) | F.exists(F.array(*map(F.lit, words)), lambda w: F.coalesce(at(i).contains(w), F.lit(False)))
        hits = F.filter(index if ui else rest, match)
        return F.get(hits, F.lit(0)) if ui else F.get(hits, F.size(hits) - 1)

    pos = [spot([k], [f"pos_{k}"]) for k in "xyz"]
    rot = [spot([f"r{k}"] if ui else [f"r{k}", w], [f"rot_{k}"] + ([w] if ui else [])) for k, w in zip("xyz", ("roll", "pitch", "yaw"))]
    found = pos[0].isNotNull()
    for x in pos[1:] + rot:
        found = found & x.isNotNull()
    half = (lambda x: F.ceil(x / 2).cast("int")) if ui else (lambda x: F.floor(x / 2).cast("int"))
    unlabelled = lab.isNull() | (F.size(lab) == 0) if ui else lab.isNull() | (F.size(lab) < n)
    mid, rmid = half(n), half(F.size(rest))
    g1, g2 = F.slice(rest, F.lit(1), rmid), F.slice(rest, rmid + 1, F.greatest(F.size(rest) - rmid, F.lit(0)))
    none = F.array().cast("array<int>")
    cell = lambda l1, i1, l2, i2, g: F.struct(l1.alias("label1"), i1.alias("group1"), l2.alias("label2"), i2.alias("group2"), g.alias("grippers"))
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    sep = "Dims (" if ui else "Dims("
    out = F.when(unlabelled & (n == 7), cell(F.lit("Position"), seq(F.lit(0), F.lit(3)), F.lit("Rotation"), seq(F.lit(3), F.lit(6)), F.array(F.lit(6))))
    out = out.when(unlabelled, cell(text(sep, F.lit(0), "-", mid - 1, ")"), seq(F.lit(0), mid), text(sep, mid, "-", n - 1, ")"), seq(mid, n), none))
    out = out.when(found, cell(F.lit("Position"), F.array(*pos), F.lit("Rotation"), F.array(*rot), grips))
    if ui:
        side = lambda s: F.filter(rest, lambda i: F.coalesce(at(i).startswith(s), F.lit(False)))
        left, right = side("left_"), side("right_")
        ordered = F.concat(F.filter(grips, lambda i: at(i).contains("left")), F.filter(grips, lambda i: ~at(i).contains("left")))
        out = out.when((F.size(left) > 0) & (F.size(right) > 0), cell(F.lit("Left Arm"), left, F.lit("Right Arm"), right, ordered))
        span = lambda g: text("Joints (", F.coalesce(F.get(g, F.lit(0)), F.lit(0)), "-", F.coalesce(F.get(g, F.size(g) - 1), F.lit(0)), ")")
        out = out.otherwise(cell(span(g1), g1, span(g2), g2, grips))
    else:
        out = out.otherwise(cell(F.lit("Arm"), g1, F.lit("Wrist"), g2, grips))
    return df.withColumn("_c", out).select("*", "_c.*").drop("_c")


# ---------------------------------------------------------------- datasets

def capabilities(datasets: DataFrame, size_limit_mb: float | None = None) -> DataFrame:
    """What can be analysed per dataset, with the note shown when signals cannot."""
    f = F.coalesce("format", F.lit("unknown"))
    has = F.coalesce("has_actions", f.isin("mcap", "lerobot"))
    video = f.isin("webdataset", "video")
    big = F.coalesce(F.col("max_episode_size_mb") > F.lit(size_limit_mb), F.lit(False))
    blocked = ~has & (f != "unknown")
    note = (F.when(blocked & video, "Video-only dataset — no robot action or IMU signals available").when(blocked, "This dataset does not contain action signals")
            .when(big, F.concat(F.lit("Episode files are too large for signal extraction (~"), F.format_number(F.bround("max_episode_size_mb"), 0),
                                F.lit(" MB each). Frame count analysis is still available.")))
            .when(video, "Signal comparison is not supported for this format").otherwise(""))
    edge = f == "lerobot"
    return datasets.select("dataset_id", f.alias("format"), has.alias("has_actions"), F.coalesce("has_imu", F.lit(False)).alias("has_imu"),
                           F.lit(True).alias("supports_frame_counts"), (~(blocked | big | video)).alias("supports_signal_comparison"),
                           note.alias("signal_comparison_note"), edge.alias("supports_edge_frames"),
                           F.when(edge, "").otherwise("Starting & ending frames are only available for LeRobot datasets.").alias("edge_frames_note"))


def dataset_overview(registry: DataFrame, features: DataFrame, repo_info: DataFrame, readme: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per dataset, each field by precedence.

    Modalities: features, else the registry, and the readme only over a plain rgb. Licence:
    front matter, else the repository's card.
    """
    r = readme_scale(readme_tags(readme.withColumn("readme_summary", readme_summary("text")).withColumn("_l", front_matter_license("text")))).withColumnRenamed("modalities", "_rm").drop("text")
    j = (registry.join(modalities(features).withColumnRenamed("modalities", "_fm"), "dataset_id", "left")
         .join(repo_info.withColumnRenamed("license", "_cl"), "dataset_id", "left").join(r, "dataset_id", "left").join(totals, "dataset_id", "left"))
    own = F.coalesce("_fm", "modalities", F.lit("rgb"))
    return j.select("dataset_id", "name", F.when(own == "rgb", F.coalesce("_rm", own)).otherwise(own).alias("modalities"), F.coalesce("_l", "_cl").alias("license"),
                    F.coalesce(~F.lower(F.col("gated")).isin("false", ""), F.lit(False)).alias("gated"), F.coalesce("downloads", F.lit(0)).alias("downloads_last_month"),
                    "readme_summary", "environment", "perspective", "estimated_hours", "estimated_clips", F.when(F.col("size_bytes") > 0, F.col("size_bytes")).alias("size_bytes"),
                    F.upper("format").alias("format_detected"), "total_episodes", "total_frames")


def probe_summary(manifest: DataFrame) -> DataFrame:
    """Format, whether there are folders, totals and five sample files per repository."""
    ext = manifest.groupBy("repo_id").agg(F.collect_set(extension("path")).alias("_e"), F.max(F.col("path").contains("/")).alias("has_tasks"),
                                          F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))
    w = Window.partitionBy("repo_id").orderBy("path")
    top = manifest.filter(~F.col("path").contains("/")).withColumn("_r", F.row_number().over(w)).filter("_r <= 5")
    top = top.groupBy("repo_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("path"))).alias("sample_files"))
    has = lambda *n: F.arrays_overlap("_e", F.array(*map(F.lit, n)))
    fmt = (F.when(has(".mcap"), "mcap").when(has(".tar", ".tar.gz"), "webdataset").when(has(".parquet"), "lerobot").when(has(".hdf5", ".h5"), "hdf5")
           .when(has(".tfrecord"), "rlds").when(has(".mp4", ".webm", ".avi"), "video"))
    return ext.join(top, "repo_id", "left").select("repo_id", F.element_at(F.split("repo_id", "/"), -1).alias("name"), fmt.alias("format_detected"),
                                                    "has_tasks", "files", "size_bytes", "sample_files")


def format_of_files(manifest: DataFrame, keys=("dataset_id",), style: str = "analysis") -> DataFrame:
    """Format per dataset from the set of its file extensions (a handful of values)."""
    e = manifest.groupBy(*keys).agg(F.collect_set(extension("path")).alias("_e"))
    return e.select(*keys, detect_format("_e", style).alias("format"))
