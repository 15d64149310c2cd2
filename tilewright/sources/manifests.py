"""Manifests of any dialect, workbooks among them, and tables that are replaced part by part."""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.manifest import concatenated
from ..operators import groups
from ..plans.storage import unused, written
from .tables import inferred, list_files

#: What a dialect is told from; a header that is longer is read up to its end.
HEAD, LONGEST_HEADER = 4096, 1 << 20


# Text


def dialect(sample: str, strict: bool = False) -> str:
    """The delimiter (comma, semicolon or tab) of a file's first characters, quotes respected; a comma, or an error if strict, where none can be told."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t").delimiter
    except csv.Error:
        if strict:
            raise
        return ","


def _start(spark: SparkSession, path: str, n: int) -> str:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(n)).decode("utf-8-sig", "ignore")
    finally:
        stream.close()


def _header(text: str, sep: str) -> tuple[str, ...] | None:
    """The first record, or None if the text ends inside it."""
    place = text.find("\n")
    while place >= 0 and text.count('"', 0, place) % 2:  # a line break inside quotes
        place = text.find("\n", place + 1)
    return None if place < 0 else tuple(next(csv.reader(io.StringIO(text[:place], newline=""), delimiter=sep), []))


def _text_files(spark: SparkSession, paths: list[str], strict: bool, multi_line: bool) -> list[DataFrame]:
    """The files of each dialect and header as one table."""
    kinds: dict[tuple, list[str]] = {}
    for path in paths:
        head = _start(spark, path, HEAD)
        sep = dialect(head, strict)
        names = _header(head, sep)
        if names is None:
            names = _header(_start(spark, path, LONGEST_HEADER) + "\n", sep) or ()
        if names:
            kinds.setdefault((sep, names), []).append(path)
    out = []
    for (sep, names), own in kinds.items():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multi_line).option("enforceSchema", True)
        out.append(reader.csv(own).toDF(*_distinct(names)))
    return out


def _distinct(names: tuple[str, ...]) -> list[str]:
    """Column names: nameless ones by their place, repeated ones numbered."""
    found: list[str] = []
    for i, name in enumerate(names):
        name, n = name.strip() or f"unnamed_{i}", 1
        same = name
        while same.lower() in {f.lower() for f in found}:
            same, n = f"{name}.{n}", n + 1
        found.append(same)
    return found


# Workbooks

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    """The place of a cell's column, from 0: A is 0, AA is 26."""
    place = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        place = place * 26 + ord(letter) - 64
    return place - 1


def _shared(book: zipfile.ZipFile) -> list[str]:
    found = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as source:
            for _, e in ElementTree.iterparse(source):
                if e.tag == f"{_MAIN}si":
                    found.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                    e.clear()
    return found


def _sheet(book: zipfile.ZipFile, name: str | None) -> str:
    """The part that holds a sheet: the first one, or the one of that name."""
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets")
    own = next((s for s in sheets if name in (None, s.get("name"))), None)
    if own is None:
        raise ValueError(f"the workbook has no sheet {name}")
    for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if r.get("Id") == own.get(_REL):
            target = r.get("Target")
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError("the workbook's sheet has no part")


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The rows of a sheet as text, streamed: numbers as they are stored, truth values as true and false, empty cells and errors as None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        words = _shared(book)
        with book.open(_sheet(book, sheet)) as source:
            for _, e in ElementTree.iterparse(source):
                if e.tag != f"{_MAIN}row":
                    continue
                row: list[str | None] = []
                for cell in e.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
                    text = v.text if v is not None else None
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif text is not None and kind == "s":
                        text = words[int(text)]
                    elif text is not None and kind == "b":
                        text = "true" if text == "1" else "false"
                    row[at] = None if kind == "e" or not text else text
                yield row
                e.clear()


def _workbooks(spark: SparkSession, paths: list[str], sheet: str | None) -> list[DataFrame]:
    """The sheets of each header as one table. A workbook is one task's; its rows are streamed."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content").repartition(max(1, len(paths)))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [[x or "" for x in next((r for r in sheet_rows(c.as_py(), sheet) if any(r)), [])] for c in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(names, pa.list_(pa.string()))], names=["path", "names"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(1):
                held, seen = [], False
                for r in sheet_rows(c.as_py(), sheet):
                    if seen and any(x is not None for x in r):
                        held.append(r)
                    seen = seen or any(r)
                    if len(held) >= 10_000:
                        yield pa.record_batch([pa.array(held, pa.list_(pa.string()))], names=["cells"])
                        held = []
                yield pa.record_batch([pa.array(held, pa.list_(pa.string()))], names=["cells"])

    kinds: dict[tuple[str, ...], list[str]] = {}
    for r in files.mapInArrow(heads, "path string, names array<string>").collect():  # a header a workbook
        if r.names:
            kinds.setdefault(tuple(r.names), []).append(r.path)
    out = []
    for names, own in kinds.items():
        cells = files.filter(F.col("path").isin(own)).mapInArrow(rows, "cells array<string>")
        out.append(cells.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(_distinct(names))]))
    return out


# Both


def read_manifests(spark: SparkSession, path: str, infer: bool = True, strict: bool = False, sheet: str | None = None, multi_line: bool = False) -> DataFrame:
    """A file, or all the files of a folder that are .csv or .xlsx, in one table; columns are matched by name, missing ones are null.

    Each text file has a dialect of its own (see ``dialect``), told from its
    first characters; files of one dialect and header are read together by the
    distributed reader. Fields with line breaks need ``multi_line``. Of a
    workbook the first sheet, or the one named, is read; its first row that isn't
    empty is the header. With ``infer`` columns get types (see ``inferred``).
    """
    found = [r.path for r in list_files(spark, path).select("path").collect()]
    texts, books = ([p for p in found if p.lower().endswith(s)] for s in (".csv", ".xlsx"))
    if bad := [p for p in found if p not in {*texts, *books}] if len(found) == 1 else []:
        raise ValueError(f"a manifest is .csv or .xlsx, not {bad[0]}")
    frames = [*(_text_files(spark, texts, strict, multi_line) if texts else []), *(_workbooks(spark, books, sheet) if books else [])]
    if not frames:
        raise ValueError(f"no manifest with a header in {path}")
    table = concatenated(*frames)
    return inferred(table) if infer else table


# Tables that are replaced part by part


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/_commits")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("number long, run string, part string, rows long").json(f"{root}/_commits")


def _part(keys: list[str]):
    return F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]), {"ignoreNullFields": "false"})


def replace_parts(df: DataFrame, root: str, keys: list[str], run: str | None = None) -> str:
    """Write a table by ``keys``: each part (combination of their values) that ``df`` has takes the place of the earlier one, all others stay. The run's name.

    The rows are evaluated once. A record of the parts and their rows is
    committed last, so a run that died before is told by ``parts``.
    """
    spark, run = df.sparkSession, run or uuid.uuid4().hex
    if missing := set(keys) - set(df.columns):
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    rows = written(df, "parts")
    earlier = _commits(spark, root)
    number = 1 + ((earlier.agg(F.max("number")).first()[0] or 0) if earlier is not None else 0)
    _spread(rows, keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{root}/data")
    record = rows.groupBy(*keys).agg(F.count("*").alias("rows")).select(F.lit(number).cast("long").alias("number"), F.lit(run).alias("run"), _part(keys).alias("part"), "rows")
    record.coalesce(1).write.mode("append").json(f"{root}/_commits")
    return run


def _spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A stored table's rows dealt by part; a large part is dealt to as many tasks (and files) as its rows ask for."""
    part, place, n = unused(rows.columns, "part", "place", "n")
    own = F.xxhash64(*keys)
    sizes = rows.groupBy(own.alias(part)).agg(F.count("*").alias(n))
    each = rows.withColumns({part: own, place: F.monotonically_increasing_id()}).join(F.broadcast(sizes), part)
    file = F.col(place) % F.ceil(F.col(n) / groups.ROWS)
    return each.repartition(groups.tasks(rows.sparkSession, rows.count()), *keys, file).drop(part, place, n)


def read_parts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/data")


def parts(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """part (its keys as JSON), run, rows by its last commit, found (rows that are there), whole (whether these agree)."""
    commits = _commits(spark, root)
    if commits is None:
        raise ValueError(f"nothing was committed in {root}")
    last = commits.groupBy("part").agg(F.max(F.struct("number", "run", "rows")).alias("last")).select("part", F.col("last.run").alias("run"), F.col("last.rows").alias("rows"))
    there = read_parts(spark, root).groupBy(*keys).agg(F.count("*").alias("found")).select(_part(keys).alias("part"), "found")
    both = last.join(there, "part", "full").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.withColumn("whole", F.col("rows").eqNullSafe(F.col("found")))

