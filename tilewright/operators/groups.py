"""Whole groups of rows in Arrow, many at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import unused

#: Rows of a task, about: tables are dealt to as many tasks as their rows ask for, so a task's memory doesn't grow with a table.
ROWS = 500_000


def tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks that many rows are dealt to: the session's number of shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def dealt(table: DataFrame, *keys: str) -> DataFrame:
    """A stored table with whole groups in one task each; it is counted, which reads no rows of a Parquet table."""
    return table.repartition(tasks(table.sparkSession, table.count()), *keys)


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A last column with each row's number in its group: groups are whole and sorted in their tasks, and are left where they are if the rows are dealt by some of the keys."""
    (number,) = unused(rows.columns, "row")
    return rows.withColumn(number, F.row_number().over(W.partitionBy(*keys).orderBy(*(order or keys))))


def _changes(columns: list) -> np.ndarray:
    """Rows (not the first) that differ from the one before in any of the columns."""
    differ = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)) for c in columns]
    found = np.zeros(max(0, len(columns[0]) - 1), bool)
    for d in differ:
        found |= d.to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(found) + 1


def starts(held: pa.Table, keys: int) -> np.ndarray:
    """The first row of each group of a table that is sorted by its first ``keys`` columns."""
    return np.r_[0, _changes([held.column(i).combine_chunks() for i in range(keys)])] if held.num_rows else np.empty(0, np.int64)


def in_groups(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], pa.Table], kind: str | T.StructType) -> DataFrame:
    """``work`` over tables of whole groups (one at least, as many as came along), sorted by ``keys`` and ``order``, which are their first columns.

    Rows are sorted by group once, and a task goes through its groups one after
    the other: it holds a batch, or the largest group. Rows with a null key are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            b = b.select(b.schema.names[:-1])
            first = _changes([b.column(i) for i in range(len(keys))])
            if not held or any(held[-1].column(i)[-1] != b.column(i)[0] for i in range(len(keys))):
                first = np.r_[0, first]
            if not len(first):
                held.append(b)
                continue
            cut = int(first[-1])
            if whole := [x for x in (*held, b.slice(0, cut)) if x.num_rows]:
                yield from work(pa.Table.from_batches(whole).combine_chunks()).combine_chunks().to_batches()
            held = [b.slice(cut)]
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks()).combine_chunks().to_batches()

    rest = [c for c in rows.columns if c not in {*keys, *order}]
    known = rows.select(*keys, *order, *rest).filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return numbered(known, keys, order).mapInArrow(run, kind)


def typed(rows: DataFrame, *names: str, **more: str) -> T.StructType:
    """The fields of ``names`` as they are in ``rows``, then new ones of the given types."""
    return rows.select(*names, *[F.lit(None).cast(kind).alias(name) for name, kind in more.items()]).schema
