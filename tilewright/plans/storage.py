"""Tables that an operator needs more than once, below the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The URI of the folder that driver and executors share; where none is named and all runs in one process, a temporary one is made and set."""
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tilewright-"))
    return context.getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows from a table in the shared folder: evaluated once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each behind as many underscores as make it differ from all of ``taken``."""
    taken, found = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
