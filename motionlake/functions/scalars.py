"""Scalar rules as column expressions: ids, names, sizes, paths, topics, formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from motionlake.functions.vectors import c


def _any(x: Column, words) -> Column:
    """True when the text holds one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


# ---------------------------------------------------------------- ids and paths

def episode_number(episode_id) -> Column:
    """N of an id that starts with episode_N, else null."""
    return F.nullif(F.regexp_extract(c(episode_id), r"^episode_(\d+)", 1), F.lit("")).cast("long")


def episode_prefix(episode_id) -> Column:
    """Sub-dataset of ``sub/episode_N``; empty for anything else."""
    return F.regexp_extract(c(episode_id), r"^(.+)/(episode_\d+)$", 1)


def episode_base(episode_id) -> Column:
    base = F.regexp_extract(c(episode_id), r"^(.+)/(episode_\d+)$", 2)
    return F.when(base != "", base).otherwise(c(episode_id))


def numeric_suffix(episode_id) -> Column:
    """Number after the last underscore, null when there is none."""
    return F.nullif(F.regexp_extract(c(episode_id), r"(?:^|_)(\d+)$", 1), F.lit("")).cast("long")


def episode_label(episode_id) -> Column:
    """Last path part without its extension."""
    return F.regexp_replace(F.element_at(F.split(c(episode_id), "/"), -1), r"\.[^.]+$", "")


def repo_from_url(url, host: str = "huggingface.co") -> Column:
    """``owner/name`` of a dataset page address or of a bare id, else null."""
    u = F.trim(c(url))
    pattern = r"^(?:https?://)?(?:www\.)?" + host.replace(".", r"\.") + r"/datasets/([^/]+/[^/\s]+)"
    found = F.regexp_extract(u, pattern, 1)
    bare = (F.size(F.split(u, "/")) == 2) & ~u.startswith("http")
    return F.when(found != "", found).when(bare, u)


def dataset_slug(repo_id) -> Column:
    """Last part of a repo id in lower case, other characters as single underscores."""
    name = F.lower(F.element_at(F.split(c(repo_id), "/"), -1))
    return F.trim(F.regexp_replace(name, "[^a-z0-9]+", "_"), F.lit("_"))


def fill_path(template, episode_index, chunks_size: int = 1000) -> Column:
    """Fill ``{chunk_index:03d}``-like fields; null when the template has no episode field."""
    t, e = c(template), c(episode_index)
    chunk, file = F.floor(e / chunks_size).cast("long"), e % chunks_size
    out = t
    for name, value in (("chunk_index", chunk), ("episode_chunk", chunk), ("file_index", file), ("episode_index", e)):
        for width in (0, 3, 6):
            field = "{" + name + (f":{width:02d}d" if width else "") + "}"
            text = value.cast("string")
            out = F.replace(out, F.lit(field), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text) if width else text)
    return F.when(t.contains("{episode_index"), out)


def extension(path) -> Column:
    """Lower-case extension with its dot; empty when none."""
    return F.lower(F.regexp_extract(c(path), r"[^/](\.[^./]+)$", 1))


def seconds(ns) -> Column:
    return c(ns) / F.lit(1e9)


def duration_s(length, fps) -> Column:
    """Rounded duration, null for length 0 or null."""
    return F.when(c(length) > 0, F.round(c(length) / c(fps), 2))


# ---------------------------------------------------------------- sizes and formats

def estimate_frames(size_bytes, fmt) -> Column:
    """Frames expected in a file of this size (fixed rates per format)."""
    s, f = c(size_bytes), c(fmt)
    video = F.floor(s / (5 * 1024 * 1024 / 8) * 30)
    per = F.when(f == "hdf5", 20 * 1024).when(f == "lerobot", 200).otherwise(50 * 1024)
    n = F.when(f.isin("webdataset", "video"), video).otherwise(F.floor(s / per))
    return F.when(s > 0, F.greatest(F.lit(1), n)).otherwise(0).cast("long")


def listed_frames(size_bytes, fmt) -> Column:
    """Listing variant: 30 KB per frame for raw video, 50 KB otherwise; null for empty files."""
    s = c(size_bytes)
    per = F.when(c(fmt) == "video", 30 * 1024).otherwise(50 * 1024)
    return F.when(s > 0, F.greatest(F.lit(1), F.floor(s / per))).cast("long")


def detect_format(extensions, style: str = "analysis") -> Column:
    """Format by the set of extensions; the two styles differ in priority and wording."""
    has = lambda *names: F.arrays_overlap(c(extensions), F.array(*map(F.lit, names)))
    if style == "analysis":
        return (F.when(has(".parquet"), "lerobot").when(has(".mcap"), "mcap").when(has(".tar"), "webdataset")
                .when(has(".mp4", ".avi", ".mov", ".mkv"), "video").when(has(".hdf5", ".h5"), "hdf5").otherwise("unknown"))
    return (F.when(has(".mcap"), "MCAP").when(has(".tar"), "WebDataset").when(has(".parquet"), "LeRobot")
            .when(has(".hdf5", ".h5"), "HDF5").when(has(".tfrecord"), "RLDS").when(has(".mp4", ".webm"), "Video"))


# ---------------------------------------------------------------- topics

# Words that identify message topics.
RGB = ["rgb", "color", "image", "camera", "compressed"]
DEPTH = ["depth", "disparity", "range"]
IMU = ["imu", "accelerometer", "gyroscope", "accel", "gyro"]
ACTION = ["action", "command", "control", "cmd", "joint_command"]
STATE = ["state", "joint_state", "robot_state", "pose", "odom"]
SIGNAL_ACTION = ["action", "command", "control", "cmd", "joint", "gripper", "target", "eef_pose", "end_effector"]
SIGNAL_SKIP = ["camera", "image", "rgb", "depth", "compressed"]


def classify_topic(topic, schema_name=None) -> Column:
    """rgb, depth, imu, actions or states, in that order; null for none."""
    t = F.lower(c(topic))
    s = F.lower(F.coalesce(c(schema_name), F.lit(""))) if schema_name is not None else F.lit("")
    return (F.when((_any(t, RGB) | s.contains("image")) & ~t.contains("depth"), "rgb").when(_any(t, DEPTH), "depth")
            .when(_any(t, IMU), "imu").when(_any(t, ACTION), "actions").when(_any(t, STATE), "states"))


def route_signal(topic) -> Column:
    """action or imu; null for camera-like and other topics."""
    t = F.lower(c(topic))
    return F.when(_any(t, SIGNAL_SKIP), None).when(_any(t, SIGNAL_ACTION), "action").when(_any(t, IMU), "imu")


# ---------------------------------------------------------------- payloads

def action_vector(payload: str = "payload") -> Column:
    """struct(vec, kind) of a decoded message: array, joint, twist, pose in frame, pose.

    ``payload`` is a struct whose members are null when the message lacks them: data,
    position_list, linear, angular, pose, position, orientation.
    """
    p = lambda x: F.col(f"{payload}.{x}")
    xyz = lambda v: [F.coalesce(F.col(f"{payload}.{v}.{k}"), F.lit(0.0)) for k in "xyz"]
    quat = lambda v: [*xyz(v), F.coalesce(F.col(f"{payload}.{v}.w"), F.lit(1.0))]
    cell = lambda vec, kind: F.struct(vec.alias("vec"), F.lit(kind).alias("kind"))
    return (F.when(p("data").isNotNull(), cell(p("data"), "array"))
            .when(p("position_list").isNotNull() & p("orientation").isNull(), cell(p("position_list"), "joint"))
            .when(p("linear").isNotNull() & p("angular").isNotNull(), cell(F.array(*xyz("linear"), *xyz("angular")), "twist"))
            .when(p("pose.position").isNotNull() & p("pose.orientation").isNotNull(), cell(F.array(*xyz("pose.position"), *quat("pose.orientation")), "pose"))
            .when(p("position").isNotNull() & p("orientation").isNotNull(), cell(F.array(*xyz("position"), *quat("orientation")), "pose")))


def imu_sample(payload: str = "payload") -> Column:
    """struct of accel_x..gyro_z from the nested or the flat message form; gyro defaults to 0."""
    p = lambda x: F.col(f"{payload}.{x}")
    nested, flat = p("linear_acceleration").isNotNull(), p("linear_acceleration_x").isNotNull()
    zero = F.lit(0.0)
    cells = []
    for short, long_ in (("accel", "linear_acceleration"), ("gyro", "angular_velocity")):
        for k in "xyz":
            cells.append(F.when(nested, F.coalesce(p(f"{long_}.{k}"), zero)).otherwise(F.coalesce(p(f"{long_}_{k}"), zero)).alias(f"{short}_{k}"))
    return F.when(nested | flat, F.struct(*cells))


# ---------------------------------------------------------------- dimensions and features

# Labels by vector size.
LABELS = {7: ["x", "y", "z", "rx", "ry", "rz", "gripper"], 8: ["x", "y", "z", "rx", "ry", "rz", "state", "gripper"],
          6: ["x", "y", "z", "rx", "ry", "rz"], 3: ["x", "y", "z"]}
POSE_LABELS = {7: ["x", "y", "z", "qx", "qy", "qz", "qw"], 6: ["x", "y", "z", "qx", "qy", "qz"]}


def dimension_labels(dims, names=None, pose: bool = False) -> Column:
    """Given names when their number fits, else the table for the size, else dim_i."""
    d = c(dims)
    generic = F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.concat(F.lit("dim_"), i.cast("string")))
    out = None
    for size, labels in ({**LABELS, **POSE_LABELS} if pose else LABELS).items():
        cell = F.array(*map(F.lit, labels))
        out = F.when(d == size, cell) if out is None else out.when(d == size, cell)
    out = out.otherwise(generic)
    return out if names is None else F.when(F.size(c(names)) == d, c(names)).otherwise(out)


def classify_feature(key, dtype) -> Column:
    k, t = c(key), c(dtype)
    return (F.when(t.isin("video", "image") | k.rlike("image|video"), "cameras").when((k == "action") | k.startswith("action."), "actions")
            .when(k.startswith("observation."), "observations")
            .when(k.isin("index", "timestamp") | k.endswith("_index") | k.endswith("_id"), "indices").otherwise("other"))
