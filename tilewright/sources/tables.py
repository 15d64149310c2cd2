"""Readers and writers of manifests. Text manifests are read as strings; casts come later."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C


def sniff(head: str) -> str:
    """The delimiter of a header line: the most frequent of comma, semicolon and tab, comma if there is none."""
    line = head.lstrip("\ufeff").split("\n", 1)[0]
    return max(",;\t", key=lambda d: (line.count(d), d == ","))


def read_csv(spark: SparkSession, path: str, sep: str | None = None, schema: str | T.StructType | None = None, multi_line: bool = False, infer: bool = False) -> DataFrame:
    """All columns as text (or by ``schema``; what doesn't fit is null; with ``infer`` by their values, see ``inferred``); the delimiter is sniffed, a byte-order mark dropped, empty fields are null.

    Fields with line breaks need ``multi_line``, which reads a file in one task.
    """
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        sep = sniff(first[0].value if first else "")
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multi_line)
    df = (reader.schema(schema).option("enforceSchema", True) if schema else reader).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    return inferred(df) if infer and not schema else df


def inferred(df: DataFrame, sentinels: tuple[str, ...] = ("", "nan", "na", "n/a", "null", "none")) -> DataFrame:
    """Text columns as long, double or boolean where all their values are; ``sentinels`` (in any case, trimmed) are null. Other columns stay. One pass over the text."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    at = lambda c: F.col(f"`{c}`")
    known = df.withColumns({c: F.when(~F.lower(F.trim(at(c))).isin(*sentinels), at(c)) for c in texts})
    plain = {c: F.trim(at(c)) for c in texts}
    tests = {"bigint": lambda c: plain[c].rlike(r"^[+-]?\d{1,18}$"), "double": lambda c: plain[c].rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "boolean": lambda c: F.lower(plain[c]).isin("true", "false")}
    counts = known.agg(*[F.count_if(~t(c)).alias(f"{i} {kind}") for i, c in enumerate(texts) for kind, t in tests.items()], *[F.count(at(c)).alias(f"{i} n") for i, c in enumerate(texts)]).first().asDict()
    chosen = {c: next((kind for kind in tests if not counts[f"{i} {kind}"]), None) for i, c in enumerate(texts) if counts[f"{i} n"]}
    return known.withColumns({c: plain[c].cast(kind) for c, kind in chosen.items() if kind})


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",") -> None:
    """With a header also where there are no rows."""
    out = df if df.head(1) else df.coalesce(1)
    out.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_json(spark: SparkSession, payload: dict, path: str) -> None:
    """One file with sorted keys, on any file system that Spark reaches."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps(payload, sort_keys=True, indent=2).encode()))
    out.close()


def read_config(spark: SparkSession, path: str) -> dict:
    """A nested mapping from a YAML file (JSON is YAML too); anything else in it is an error."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path).coalesce(1).toLocalIterator())
    found = yaml.safe_load(text) or {}
    if not isinstance(found, dict):
        raise ValueError("a configuration must be a mapping")
    return found


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """path, length of the files of a folder whose suffix is this one in any case, by path; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return found.filter(F.lower("path").endswith(suffix.lower())).orderBy("path")


def tile_path(task: Column, split: Column, level: Column, study: Column, name: Column) -> Column:
    """tiles/task/split/level_N/study/name; the study as a safe token."""
    return F.concat_ws("/", F.lit("tiles"), task, split, F.concat(F.lit("level_"), level), C.token(study), name)
