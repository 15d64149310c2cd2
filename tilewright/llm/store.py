"""Shared storage for intermediate tables and files.

Everything an operator needs twice is written below the folder that the
cluster names in ``spark.checkpoint.dir``; only where that is unset and all runs
in one process (tests) a temporary folder is made and set. Results are lazy and
read these tables, so they stay until ``clear`` is called.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tilewright-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


_thread = threading.local()


def _made() -> list[str]:
    """The paths that this thread made, so that clearing up never reaches another thread's work."""
    if not hasattr(_thread, "made"):
        _thread.made = []
    return _thread.made


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    _made().append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _made()[-1]


def saved_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back (cuts lineage, survives lost executors); and where it is."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame, tag: str) -> DataFrame:
    return saved_at(df, tag)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mark() -> int:
    """What has been made so far; for ``clear``."""
    return len(_made())


def clear(spark: SparkSession, since: int = 0, keep: Iterable[str] = ()) -> None:
    """Delete what this thread made after ``since``, but for the paths in ``keep``."""
    made, keep = _made(), set(keep)
    for path in made[since:]:
        if path not in keep:
            remove(spark, path)
    made[since:] = [path for path in made[since:] if path in keep]


def spare(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all of ``taken``."""
    taken, found = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; used on executors, where there is no session."""
    import pyarrow.fs as pafs

    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put(uri: str, blob: bytes) -> None:
    """Write a file as a whole: under a name of this attempt, then moved, so that retries and twins are harmless."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(attempt, compression=None) as out:
        out.write(blob)
    fs.move(attempt, path)


def mapped(uri: str):
    """The bytes of a shared file: a read-only memory map, or, where the file is on no file system of the machine, what was read."""
    import mmap

    import pyarrow.fs as pafs

    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
    with fs.open_input_stream(path, compression=None) as source:
        return source.read()
