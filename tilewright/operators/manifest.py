"""Projections, filters, joins, set operations and checks of manifests."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans import storage
from .groups import tasks


def columns_first(df: DataFrame, first: list[str]) -> DataFrame:
    """Priority columns (null where missing), then the others in their order."""
    df = df.withColumns({c: F.lit(None).cast("string") for c in first if c not in df.columns})
    return df.select(*[F.col(f"`{c}`") for c in [*first, *[c for c in df.columns if c not in first]]])


def normal_names(df: DataFrame, strict: bool = True) -> DataFrame:
    """Lower-case names; what isn't a letter or digit (or, if not strict, blanks only) becomes an underscore. Names that would become one are an error."""
    name = (lambda c: re.sub(r"[\W_]", "_", c.strip().lower()).strip("_")) if strict else (lambda c: c.strip().lower().replace(" ", "_"))
    names = [*map(name, df.columns)]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns that become one: {', '.join(twice)}")
    return df.toDF(*names)


def renamed(df: DataFrame, aliases: dict[str, list[str]], kind: str = "string") -> DataFrame:
    """Each wanted name: its column, else the first of its aliases renamed, else a null column."""
    for name, others in aliases.items():
        if name not in df.columns:
            found = next((o for o in others if o in df.columns), None)
            df = df.withColumnRenamed(found, name) if found else df.withColumn(name, F.lit(None).cast(kind))
    return df


def with_default(df: DataFrame, name: str, default: str) -> DataFrame:
    """The column with its nulls filled; a new one where it is missing."""
    return df.withColumn(name, F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default))


def keep_list(df: DataFrame, core: list[str], passed: list[str]) -> DataFrame:
    """The core columns, then those of ``passed`` that exist, each name once, in order."""
    required(df, core)
    return df.select(*dict.fromkeys([*core, *[c for c in passed if c in df.columns]]))


def merged(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The record with new fields; they override old ones in place and come last otherwise."""
    return df.withColumns(new)


def in_order(values: Column, order: Column) -> Column:
    """Aggregates the different values of a group by their first place. ``values`` should be grouped before, so that the array is short."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda x: x["v"])


def required(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_column(df: DataFrame, names: list[str], default: str) -> Column:
    """The first of the columns that exists (nulls in it stay), else a literal."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(default))


def probabilities(df: DataFrame, prefix: str = "prob_class_") -> list[str]:
    """Columns by prefix, in the order of their numbers."""
    return sorted((c for c in df.columns if re.fullmatch(re.escape(prefix) + r"\d+", c)), key=lambda c: int(c[len(prefix) :]))


def conditions(df: DataFrame, wanted: dict[str, Column | None]) -> DataFrame:
    """Filter by the conditions whose column exists."""
    held = [c for name, c in wanted.items() if name in df.columns]  # a condition may be None: switched off
    held = [c for c in held if c is not None]
    return df.filter(reduce(lambda a, b: a & b, held)) if held else df


def base_filter(df: DataFrame, exclude_suspect: bool = False, contains: str | None = None) -> DataFrame:
    """Evaluable rows that review has not excluded, by text in the path if asked."""
    ok = (C.normal(F.col("review_category")) != "exclude") & F.col("task_label").isNotNull() & F.col("level").between(0, 5)
    if exclude_suspect:
        ok &= C.normal(F.col("review_category")) != "suspect"
    if contains is not None:
        ok &= F.col("tile_path").contains(contains)
    return df.filter(ok)


def check_all(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """The rows, if the condition holds for all of them (null is a failure)."""
    if bad := df.filter(~F.coalesce(holds, F.lit(False))).count():
        raise ValueError(f"{message}: {bad} rows")
    return df


def with_files(df: DataFrame, path: str, files: DataFrame, drop: bool = True) -> DataFrame:
    """The rows whose file is in the listing (its column ``path``); missing ones are dropped, or an error."""
    listed = files.select(F.col("path").alias(path)).distinct()
    if not drop and (n := df.join(listed, path, "left_anti").count()):
        raise FileNotFoundError(f"{n} files of the manifest don't exist")
    return df.join(listed, path, "left_semi")


def unused(files: DataFrame, rows: DataFrame, path: str = "path", used: str = "match") -> DataFrame:
    """The files that no row took."""
    return files.join(rows.select(F.col(used).alias(path)).filter(F.col(path).isNotNull()).distinct(), path, "left_anti")


def large_enough(components: DataFrame, least: Column) -> DataFrame:
    """Components of at least an area."""
    return components.filter(F.col("area") >= least)


def valid_box(x: str = "bbox_x", y: str = "bbox_y", w: str = "bbox_w", h: str = "bbox_h") -> Column:
    """Four numbers, origin not negative, extent positive; never null."""
    return F.coalesce((F.col(x) >= 0) & (F.col(y) >= 0) & (F.col(w) > 0) & (F.col(h) > 0), F.lit(False))


def reasons(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """``reason``: the first failing check of each row, null if none fails."""
    c = F.lit(None).cast("string")
    for code, fails in reversed(checks):
        c = F.when(fails, F.lit(code)).otherwise(c)
    return df.withColumn("reason", c)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    (at,) = storage.unused(df.columns, "rn")
    return df.withColumn(at, rn).filter(F.col(at) == 1).drop(at)


def metadata_join(left: DataFrame, right: DataFrame, on: str, columns: list[str], order: list[Column], how: str = "left") -> DataFrame:
    """Join projected metadata, the first row of each key; names that both have get _x and _y; null keys match nothing."""
    right = keep_first(right, [on], order).select(on, *[c for c in columns if c != on])
    both = [c for c in right.columns if c in left.columns and c != on]
    for c in both:
        left, right = left.withColumnRenamed(c, f"{c}_x"), right.withColumnRenamed(c, f"{c}_y")
    return left.join(right, on, how)


def map_values(df: DataFrame, key: str, table: DataFrame, value: str) -> DataFrame:
    """``value`` of each row by its key; null where the table (key, value; a key once) has none."""
    return df.join(table.select(key, value), key, "left")


def by_driver(driving: DataFrame, results: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Results of parallel jobs at their rows, in the driving order; a row without a result has ``ok`` false and an ``error``."""
    found = driving.join(results.withColumn("ok", F.coalesce("ok", F.lit(True))), key, "left")
    missing = F.col("ok").isNull()
    return found.withColumns({"ok": F.coalesce("ok", F.lit(False)), "error": F.when(missing, F.lit("no result")).otherwise(F.col("error"))}).orderBy(*order)


def outcomes(df: DataFrame, value: Column, checks: list[tuple[str, Column]]) -> DataFrame:
    """``ok``, ``error`` and ``value``: failures are data (the first failing check), never exceptions."""
    failed = reasons(df, checks).withColumn("error", F.col("reason")).drop("reason")
    return failed.withColumns({"ok": F.col("error").isNull(), "value": F.when(F.col("error").isNull(), value)})


def concatenated(*frames: DataFrame) -> DataFrame:
    """All rows; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def leakage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both sides have."""
    return a.select(key).intersect(b.select(key))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def rule_lookup(df: DataFrame, rules: DataFrame, on: str, default: dict[str, Column]) -> DataFrame:
    """Each row's rule, single values falling back to a default; ``known`` tells whether there was a rule."""
    found = df.join(rules.withColumn("known", F.lit(True)), on, "left")
    return found.withColumns({k: F.coalesce(F.col(k), v) for k, v in default.items()} | {"known": F.coalesce("known", F.lit(False))})


def match_files(rows: DataFrame, key: str, files: DataFrame, path: str = "path") -> DataFrame:
    """``match``, ``tier``: a row's file by equal stem, else the only file whose stem has the key, else the only one whose stem is in the key.

    Inclusion is tested by pieces of equal length: stems are looked up among
    the key's substrings of the stems' lengths, so no pair of all is made.
    """
    key_, b = storage.unused([*rows.columns, "match", "tier"], "key", "b")
    f = files.select(F.col(path).alias("__file"), C.stem(F.col(path)).alias("__stem"))
    r = rows.withColumn(key_, F.lower(C.stripped(F.col(key))))
    one = lambda df, tier: df.groupBy("__key").agg(F.count("*").alias("n"), F.min("__file").alias("__file")).filter("n = 1").select("__key", "__file", F.lit(tier).alias("tier"))
    keys = r.select(F.col(key_).alias("__key")).filter("__key <> ''").distinct()
    pieces = lambda c, low, high: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, n))))))
    low, high = (int(x or 1) for x in keys.agg(F.min(F.length("__key")), F.max(F.length("__key"))).first())
    size = F.length("__stem")
    slow, shigh, most = (int(x or 1) for x in f.agg(F.min(size), F.max(size), F.sum(F.greatest(size - low + 1, F.lit(0)) * F.least(size - low + 1, F.lit(high - low + 1)))).first())
    n = tasks(files.sparkSession, most)  # pieces are dealt by their number, as few files make many; those of a stem are distinct, and only found ones are kept
    whole = f.distinct().repartition(n)
    in_stem = whole.select("__file", "__stem", pieces(F.col("__stem"), low, high).alias("__key")).filter(F.length("__key") >= low).join(keys.repartition(n, "__key"), "__key")
    in_key = keys.select("__key", pieces(F.col("__key"), max(slow, 1), shigh).alias("__stem")).join(f, "__stem")
    equal = f.withColumnRenamed("__stem", "__key").join(keys, "__key").groupBy("__key").agg(F.min("__file").alias("__file")).select("__key", "__file", F.lit(1).alias("tier"))
    best = equal.union(one(in_stem, 2)).union(one(in_key, 3)).groupBy("__key").agg(F.min(F.struct("tier", "__file")).alias("b"))
    found = best.select(F.col("__key").alias(key_), F.col("b").alias(b))
    return r.join(found, key_, "left").withColumns({"match": F.col(f"{b}.__file"), "tier": F.col(f"{b}.tier")}).drop(b, key_)


#: The keys of the tile order and of the extraction order.
TILE_ORDER = ["task", "split", "analysis_unit_id", "read_level", "tile_y_level0", "tile_x_level0", "tile_path"]
EXTRACTION_ORDER = TILE_ORDER[:4]


def output_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted by the keys; null or missing text counts as '', a null or missing number as -1."""
    texts = {"task", "split", "analysis_unit_id", "tile_path"}
    have = lambda k: F.col(k) if k in df.columns else F.lit(None)
    return df.orderBy(*[F.coalesce(have(k).cast("string"), F.lit("")) if k in texts else F.coalesce(have(k).cast("long"), F.lit(-1)) for k in keys])


#: Columns of the box that become numbers.
BOX_NUMBERS = ["bbox_x", "bbox_y", "bbox_w", "bbox_h"]


def master_metadata(df: DataFrame, needed: list[str], key: str = "analysis_unit_id", numbers: tuple[str, ...] = ("is_evaluable",)) -> DataFrame:
    """Checked metadata, one row a unit: needed columns, keys neither null nor twice; box columns and ``numbers`` as doubles, bad ones null."""
    required(df, [key, *needed])
    bad = df.groupBy(key).agg(F.count("*").alias("rows")).filter(F.col(key).isNull() | (F.col("rows") > 1)).limit(10).collect()
    if any(r[key] is None for r in bad):
        raise ValueError(f"{key} is null in some rows")
    if bad:
        raise ValueError(f"{key} comes more than once: {sorted(str(r[key]) for r in bad)}")
    return df.withColumns({c: C.number(F.col(c)) for c in [*BOX_NUMBERS, *numbers] if c in df.columns})
