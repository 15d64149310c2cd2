"""A function over the rows of a table, a job each, whose failures become rows."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.storage import unused

#: What a job leaves beside its row and its result.
OUTCOME = ("ok", "attempts", "error_type", "error", "trace", "seconds")


def run_jobs(rows: DataFrame, job: Callable[[dict[str, Any]], dict[str, Any] | None], result: str | T.StructType, tries: int = 1, retry_on: tuple[type[Exception], ...] = (Exception,), tasks: int | None = None) -> DataFrame:
    """Each row with ``result`` (null if the job failed), ok, attempts, error_type, error (as the exception shows itself), trace and seconds.

    ``job`` gets a row as a dict and returns the fields of ``result`` (missing
    ones are null). A job that raises is run again up to ``tries`` times if the
    exception is of ``retry_on``; then its last exception is the outcome: no job stops
    the others, and what a job returned that doesn't fit ``result`` is its own
    failure. Jobs may run more than once if an executor is lost, so what they
    write must bear that. ``tasks`` deals the rows out evenly first, for few rows
    with long jobs. Rows come back as they were dealt; see ``in_driving_order``.
    """
    if tries < 1:
        raise ValueError("a job is tried once at least")
    kind = T._parse_datatype_string(result) if isinstance(result, str) else result
    names = unused(rows.columns, "result", *OUTCOME)
    types = [kind, T.BooleanType(), T.IntegerType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType()]
    out = T.StructType([*rows.schema.fields, *(T.StructField(n, t) for n, t in zip(names, types, strict=True))])
    fields, width = [f.name for f in kind.fields], len(rows.columns)

    def one(row: dict[str, Any], made: pa.DataType) -> tuple:
        began = time.perf_counter()
        for attempt in range(1, tries + 1):
            try:
                found = job(dict(row)) or {}
                if unknown := set(found) - set(fields):
                    raise KeyError(f"the result has no field {', '.join(sorted(unknown))}")
                value = {f: found.get(f) for f in fields}
                pa.array([value], made)
                return value, True, attempt, None, None, None, time.perf_counter() - began
            except Exception as e:
                if attempt == tries or not isinstance(e, retry_on):
                    return None, False, attempt, type(e).__name__, repr(e), traceback.format_exc(), time.perf_counter() - began
        raise AssertionError

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        made = schema.field(width).type
        for b in batches:
            done = [one(row, made) for row in b.to_pylist()]
            new = [pa.array([d[i] for d in done], schema.field(width + i).type) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=out.names)

    dealt = rows if tasks is None else rows.repartition(tasks)
    return dealt.mapInArrow(run, out)


def in_driving_order(outcomes: DataFrame, driving: DataFrame, key: str, order: str) -> DataFrame:
    """A row for each row of the driving table, by its ``order``: its outcome by key, and a failure of its own where no job brought one."""
    own = outcomes.drop(*(c for c in driving.columns if c != key and c in outcomes.columns))
    lost = F.col("ok").isNull()
    both = driving.join(own, key, "left").withColumns({"error_type": F.when(lost, "Missing").otherwise(F.col("error_type")), "error": F.when(lost, "no job returned this row").otherwise(F.col("error")), "ok": F.coalesce("ok", F.lit(False)), "attempts": F.coalesce("attempts", F.lit(0))})
    return both.orderBy(order)


def succeeded(outcomes: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and the result's fields of the jobs that ended well."""
    return outcomes.filter("ok").select(*keep, "result.*")


def issues(outcomes: DataFrame, key: str, code: str, stage: str) -> DataFrame:
    """key, stage, issue_code, message of the jobs that failed."""
    return outcomes.filter(~F.col("ok")).select(key, F.lit(stage).alias("stage"), F.lit(code).alias("issue_code"), F.col("error").alias("message"))
