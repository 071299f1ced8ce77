"""Tables that grow by commits: files are staged first, one rename publishes them.

Below ``path`` lie ``data/<id>``, the staged folders, and ``commits/<number>.json``, one manifest
per commit. A manifest names the folders of a commit, by part. A folder that no manifest names
does not exist for a reader: a job stopped half-way leaves nothing to see. Numbers have no gaps;
whoever puts the next number in place has committed, and all others start again from the new log.
The rename must be atomic and must not replace (HDFS; a hard link on a local disk). Only
manifests pass the driver, one small file per commit.
"""

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from motionlake.operators.chunks import joined_by_size, spread_join


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def log(spark: SparkSession, path: str) -> list[dict]:
    """The commits so far, in order: {"number", "token", "parts": {name: {"folder", "schema"}}}."""
    place, fs = _path(spark, f"{path}/commits")
    if not fs.exists(place):
        return []
    texts = spark.read.text(f"{path}/commits", wholetext=True, pathGlobFilter="*.json").collect()
    return sorted((json.loads(r.value) for r in texts), key=lambda c: c["number"])


def stage(rows: DataFrame, path: str) -> dict:
    """Write rows to a folder of their own, which nobody reads before a commit names it."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{folder}")
    return {"folder": folder, "schema": rows.schema.jsonValue()}


def read_part(spark: SparkSession, path: str, parts: list[dict]) -> DataFrame:
    """Rows of some staged parts; all have the schema of the first."""
    schema = T.StructType.fromJson(parts[0]["schema"])
    return joined_by_size(spark.read.schema(schema).parquet(*[f"{path}/{p['folder']}" for p in parts]))


def read_committed(spark: SparkSession, path: str, part: str = "rows", commits: list[dict] | None = None) -> DataFrame | None:
    """The published rows of a part, or None before the first commit that has it."""
    found = [c["parts"][part] for c in (log(spark, path) if commits is None else commits) if part in c["parts"]]
    return read_part(spark, path, found) if found else None


def claim(spark: SparkSession, path: str, commit: dict) -> bool:
    """Put the manifest in the place of its number; false if another commit holds the number."""
    target, fs = _path(spark, f"{path}/commits/{commit['number']:012d}.json")
    draft, _ = _path(spark, f"{path}/commits/.{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(draft)
    out.write(bytearray(json.dumps(commit).encode()))
    out.close()
    if fs.getUri().getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)
        return True
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    replace = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(draft, target, replace)
    except Py4JJavaError:
        fs.delete(draft, False)
        if fs.exists(target):
            return False
        raise
    return True


def publish(spark: SparkSession, path: str, build: Callable[[list[dict]], dict | None], token: str | None = None) -> int | None:
    """Commit what ``build`` makes of the log; return the number of the commit, or None if there was none.

    ``build`` maps the log to {part: rows, or a staged part}, or None for nothing to commit. It runs again
    when another writer took the number. A ``token`` commits once: where the log has it, nothing happens.
    """
    while True:
        commits = log(spark, path)
        if token is not None and any(c["token"] == token for c in commits):
            return None
        made = build(commits)
        if made is None:
            return None
        parts = {name: p if isinstance(p, dict) else stage(p, path) for name, p in made.items()}
        if claim(spark, path, {"number": len(commits), "token": token, "parts": parts}):
            return len(commits)


def publish_keys(rows: DataFrame, path: str, key: str, seen: list[dict]) -> int | None:
    """Commit rows that were computed against the log ``seen``; keys that others committed since stay theirs."""
    spark = rows.sparkSession
    held = {"rows": stage(rows, path), "seen": len(seen)}

    def build(commits: list[dict]) -> dict:
        newer = commits[held["seen"]:]
        if newer:
            taken = read_committed(spark, path, commits=newer).select(key).distinct()
            mine = read_part(spark, path, [held["rows"]]).selectExpr("*", "monotonically_increasing_id() AS _row")
            held["rows"] = stage(spread_join(mine, taken, [key], "_row", "left_anti").select(*rows.columns), path)
            held["seen"] = len(commits)
        return {"rows": held["rows"]}

    return publish(spark, path, build)
