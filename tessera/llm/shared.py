"""The folder that driver and executors share: `spark.checkpoint.dir` of the session.

Spark writes intermediate tables there; Python workers open files in it through
pyarrow's file systems, so that any store pyarrow knows (a mounted folder, S3, GCS,
HDFS with libhdfs) serves.  Where the setting is unset (tests, a notebook on one
machine) a temporary folder is made, but only for a local master.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root if "://" in root else f"file://{root}" if root.startswith("/") else root
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_dir(spark: SparkSession, label: str) -> str:
    _made.append(f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_all() -> None:
    """Deletes all folders that operators have made so far; call it once their results are written."""
    while _made:
        drop(_made.pop())


def write(df: DataFrame, uri: str) -> None:
    """Writes an intermediate table; the shuffle files that it took go when it is written, not when the driver happens to collect garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.parquet(uri)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Writes under a name of its own and then renames: a repeated or speculative task leaves one whole file."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def drop(uri: str) -> None:
    fs, path = open_fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)
