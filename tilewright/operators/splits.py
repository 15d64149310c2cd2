"""Splits of units, training history and screening statistics."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.statistics import correlation_p, mann_whitney_p
from ..plans.storage import unused, written
from .manifest import concatenated
from .scores import running


def dice(seed: int, key: str) -> Column:
    """A whole number from the MD5 of seed and key: the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")


def units(rows: DataFrame, unit: str, label: str, order: str) -> DataFrame:
    """unit, label: the first label of each unit that isn't null."""
    return rows.groupBy(unit).agg(F.min_by(label, F.when(F.col(label).isNotNull(), F.col(order))).alias(label))


def _numbered(table: DataFrame, by: list[str], unit: str, seed: int) -> DataFrame:
    """``rn``: the units of a group numbered from 1 in the order of their dice. A group is numbered in 256 ranges of the dice, so a large class isn't one task's."""
    die, part, n, start = unused(table.columns, "die", "part", "n", "start")
    rows = table.withColumns({die: dice(seed, unit), part: F.shiftright(dice(seed, unit), 24)})
    inside = F.row_number().over(W.partitionBy(*by, part).orderBy(die, unit))
    before = F.sum(n).over(W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    ranges = rows.groupBy(*by, part).agg(F.count("*").alias(n)).withColumn(start, F.coalesce(before, F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(f"own.{c}").eqNullSafe(F.col(f"other.{c}")) for c in [*by, part]])
    met = rows.withColumn("rn", inside).alias("own").join(ranges.alias("other"), same)
    return met.select(*[F.col(f"own.{c}") for c in table.columns], (F.col("own.rn") + F.col(f"other.{start}")).alias("rn"))


def stratified(table: DataFrame, unit: str, label: str, fraction: float, seed: int, fallback: bool = False) -> DataFrame:
    """``split``: a share of each class's units is val. Quotas are by largest remainder.

    A unit without a class is an error. A class needs two units; else it is an error, or with ``fallback`` the units
    are drawn without regard to classes (one val unit at least).
    """
    c = written(table.groupBy(label).agg(F.count("*").alias("n")), "classes")
    if c.filter(F.col(label).isNull()).head(1):
        raise ValueError(f"every unit needs a {label}")
    if c.filter("n < 2").head(1):
        if not fallback:
            raise ValueError("every class needs two units")
        want = max(1, round(table.count() * fraction))
        return _numbered(table, [], unit, seed).select(unit, label, F.when(F.col("rn") <= want, "val").otherwise("train").alias("split"))
    spread = c.withColumn("k", F.lit(1)).join(c.agg(F.round(F.sum("n") * fraction).cast("long").alias("want")).withColumn("k", F.lit(1)), "k")
    exact = F.col("n") * fraction
    spread = spread.withColumns({"base": F.floor(exact), "rest": exact - F.floor(exact)})
    extra = F.row_number().over(W.orderBy(F.desc("rest"), label)) <= F.col("want") - F.sum("base").over(W.partitionBy())
    quota = spread.withColumn("quota", F.greatest(F.lit(1).cast("long"), F.least(F.col("n") - 1, F.col("base") + extra.cast("long")))).select(label, "quota")
    return _numbered(table, [label], unit, seed).join(quota, label).select(unit, label, F.when(F.col("rn") <= F.col("quota"), "val").otherwise("train").alias("split"))


def folds(table: DataFrame, unit: str, label: str, k: int, seed: int) -> DataFrame:
    """``fold``: the units of each class in turn; a class needs k units, and a unit a class."""
    if table.filter(F.col(label).isNull()).head(1):
        raise ValueError(f"every unit needs a {label}")
    if table.groupBy(label).count().filter(F.col("count") < k).head(1):
        raise ValueError(f"every class needs {k} units")
    return _numbered(table, [label], unit, seed).select(unit, label, ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def fixed_split_checks(rows: DataFrame, unit: str, label: str, labels: tuple[int, ...] = (0, 1), path: str = "tile_path") -> DataFrame:
    """One row: tiles and units of train and val, paths that don't name their split, units in both, label values missing in either."""
    r = rows.filter(F.col("split").isin("train", "val"))
    named = F.coalesce(F.col(path).contains(F.concat(F.lit("/"), F.col("split"), F.lit("/"))), F.lit(False))
    counts = [F.count_if(F.col("split") == s).alias(f"{s}_tiles") for s in ("train", "val")]
    wrong = [F.count_if((F.col("split") == s) & ~named).alias(f"bad_{s}_paths") for s in ("train", "val")]
    missing = [(len(labels) - F.count_distinct(F.when((F.col("split") == s) & F.col(label).isin(*labels), F.col(label)))).alias(f"missing_{s}_classes") for s in ("train", "val")]
    other = F.count_if(~F.coalesce(F.col(label).isin(*labels), F.lit(False))).alias("other_labels")
    per = r.groupBy(unit).agg(F.max(F.when(F.col("split") == "train", 1).otherwise(0)).alias("t"), F.max(F.when(F.col("split") == "val", 1).otherwise(0)).alias("v"))
    units = per.agg(F.sum("t").alias("train_units"), F.sum("v").alias("val_units"), F.sum(F.col("t") * F.col("v")).alias("leaked_units"))
    return r.agg(*counts, *wrong, *missing, other).withColumn("k", F.lit(1)).join(units.withColumn("k", F.lit(1)), "k").drop("k")


def fixed_split(rows: DataFrame, unit: str, label: str, labels: tuple[int, ...] = (0, 1), path: str = "tile_path") -> tuple[DataFrame, DataFrame]:
    """(train, val) by the manifest's own split; any failing check is a ValueError."""
    found = fixed_split_checks(rows, unit, label, labels, path).first().asDict()
    if not found["train_tiles"] or not found["val_tiles"]:
        raise ValueError("train and val must both have rows")
    if bad := {k: v for k, v in found.items() if v and k.startswith(("bad_", "leaked", "missing", "other"))}:
        raise ValueError(f"the split is invalid: {bad}")
    return rows.filter("split = 'train'"), rows.filter("split = 'val'")


def integrity(rows: DataFrame, unit: str, label: str, split: str = "split") -> DataFrame:
    """null_splits, unknown_splits (neither train nor val), leaked_units, missing_cells (class and split pairs without a row)."""
    per = rows.groupBy(unit).agg(F.count_distinct(split).alias("k")).agg(F.count_if(F.col("k") > 1).alias("leaked_units"))
    nulls = rows.agg(F.count_if(F.col(split).isNull()).alias("null_splits"), F.count_if(~F.col(split).isin("train", "val")).alias("unknown_splits"), (F.count_distinct(label) * F.count_distinct(split) - F.count_distinct(label, split)).alias("missing_cells"))
    return nulls.withColumn("k", F.lit(1)).join(per.withColumn("k", F.lit(1)), "k").drop("k")


def early_stopping(history: DataFrame, run: str, patience: int, maximise: bool = True) -> DataFrame:
    """best, waited, stop per epoch: epochs since the metric last beat its best. NaN never improves."""
    v = F.when(~F.isnan("metric"), F.col("metric"))
    v = v if maximise else -v
    past = W.partitionBy(run).orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(run).orderBy("epoch").rowsBetween(W.unboundedPreceding, 0)
    better = F.coalesce(v > F.max(v).over(past), v.isNotNull())
    out = history.withColumn("better", better)
    last = F.max(F.when(F.col("better"), F.col("epoch"))).over(upto)
    first = F.min("epoch").over(W.partitionBy(run))
    best = F.max(v).over(upto)
    out = out.withColumns({"best": best if maximise else -best, "waited": (F.col("epoch") - F.coalesce(last, first - 1)).cast("long")})
    return out.withColumn("stop", F.col("waited") >= patience)


#: Fixed value: the share of the best by which a metric must beat it to count for the rate.
GAIN = 1e-4


def plateau(history: DataFrame, run: str, rate: float, factor: float, patience: int, maximise: bool = True, gain: float = GAIN) -> DataFrame:
    """lr after each run's epochs: cut when the metric hasn't beaten its best by ``gain`` of it for more than ``patience`` epochs. NaN epochs are skipped.

    Bounded: the epochs of a run.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("epoch", "metric"))), lambda x: x["metric"])
    start = F.struct(F.lit(rate).alias("lr"), F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"))

    def step(s: Column, m: Column) -> Column:
        better = s["best"].isNull() | ((m > s["best"] * (1 + gain)) if maximise else (m < s["best"] * (1 - gain)))
        bad = F.when(better, F.lit(0)).otherwise(s["bad"] + 1)
        cut = bad > patience
        moved = F.struct(F.when(cut, s["lr"] * factor).otherwise(s["lr"]).alias("lr"), F.when(better, m).otherwise(s["best"]).alias("best"), F.when(cut, F.lit(0)).otherwise(bad).alias("bad"))
        return F.when(m.isNull() | F.isnan(m), s).otherwise(moved)

    return history.groupBy(run).agg(F.aggregate(ordered, start, step)["lr"].alias("lr"))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """``name``: each row's rank in its group with ties averaged; null has the rank null. Counts are summed per value first.

    A null in ``by`` is a group like any other.
    """
    n, below = unused([*df.columns, name], "n", "below")
    at = running(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias(n)), by, value, {below: n})
    ranks = at.select(*by, value, (F.col(below) + (F.col(n) + 1) / 2).alias(name))
    same = reduce(lambda a, b: a & b, [F.col(f"own.{c}").eqNullSafe(F.col(f"other.{c}")) for c in [*by, value]])
    return df.alias("own").join(ranks.alias("other"), same, "left").select(*[F.col(f"own.{c}") for c in df.columns], F.col(f"other.{name}"))


def rank_sum(df: DataFrame, variable: str = "variable", group: str = "grp", value: str = "value") -> DataFrame:
    """variable, n0, n1, u (of group 0), delta = 1 - 2u/(n0 n1), magnitude."""
    return effect(_rank_sums(df, variable, group, value).drop("ties"))


def _rank_sums(df: DataFrame, variable: str, group: str, value: str) -> DataFrame:
    """variable, n0, n1, u and ties (the sum of t^3 - t over groups of equal values); null values don't count."""
    df = df.filter(F.col(value).isNotNull())
    at = df.groupBy(variable, value).agg(F.count_if(F.col(group) == 0).alias("a"), F.count_if(F.col(group) == 1).alias("b"))
    at = running(at, [variable], value, {"below": "b"})
    same = (F.col("a") + F.col("b")).cast("double")
    return at.withColumns({"w": F.col("a") * (F.col("below") + F.col("b") / 2), "t": same * same * same - same}).groupBy(variable).agg(F.sum("a").alias("n0"), F.sum("b").alias("n1"), F.sum("w").alias("u"), F.sum("t").alias("ties"))


def mann_whitney(df: DataFrame, variable: str = "variable", group: str = "grp", value: str = "value") -> DataFrame:
    """variable, n0, n1, u, p (two-sided; see ``functions.statistics``). The sums are taken by aggregation; p is worked out for a row a variable."""

    @F.pandas_udf("double")
    def p_of(u: pd.Series, n0: pd.Series, n1: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([mann_whitney_p(a, int(b), int(c), int(d)) for a, b, c, d in zip(u, n0, n1, ties, strict=True)], dtype="float64")

    s = _rank_sums(df, variable, group, value)
    return s.select(variable, "n0", "n1", "u", p_of("u", "n0", "n1", "ties").alias("p"))


def effect(s: DataFrame) -> DataFrame:
    """delta and its magnitude (cut-offs 0.147, 0.33, 0.474)."""
    s = s.withColumn("delta", 1 - 2 * F.col("u") / (F.col("n0") * F.col("n1")))
    size = F.abs("delta")
    return s.withColumn("magnitude", F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large"))


def spearman(df: DataFrame, variable: str = "variable", x: str = "x", y: str = "y") -> DataFrame:
    """rho, n: correlation of average ranks per variable, over the rows that have both values."""
    known = written(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(variable, x, y), "pairs")
    r = average_ranks(average_ranks(known, [variable], x, "rx"), [variable], y, "ry")
    return r.groupBy(variable).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def spearman_test(df: DataFrame, variable: str = "variable", x: str = "x", y: str = "y") -> DataFrame:
    """variable, rho, n, p (two-sided, by Student's t)."""

    @F.pandas_udf("double")
    def p_of(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(None if pd.isna(r) else r, int(k)) for r, k in zip(rho, n, strict=True)], dtype="float64")

    return spearman(df, variable, x, y).withColumn("p", p_of("rho", "n"))


def fdr(df: DataFrame, p: str = "p") -> DataFrame:
    """fdr: Benjamini-Hochberg, by reverse running minimum over the tests (a small table: one row per variable)."""
    rank = F.row_number().over(W.orderBy(p, "variable"))
    r, q = unused(df.columns, "r", "q")
    raw = df.withColumn(r, rank).withColumn(q, F.col(p) * F.count("*").over(W.partitionBy()) / F.col(r))
    low = F.min(q).over(W.orderBy(F.desc(r)).rowsBetween(W.unboundedPreceding, 0))
    return raw.withColumn("fdr", F.least(low, F.lit(1.0))).drop(r, q)


def group_summary(df: DataFrame, variable: str = "variable", group: str = "grp", value: str = "value") -> DataFrame:
    """variable, n_total, n_unique_scores, and n, median, mean of both groups. Medians are exact: from counts per value and running counts, two rows a group."""
    per = df.groupBy(variable, group, value).agg(F.count("*").alias("n"))
    sums = per.groupBy(variable, group).agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col(value)) / F.sum("n")).alias("mean"))
    placed = running(per, [variable, group], value, {"below": "n"}).join(sums, [variable, group])
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col(value)))
    mid = placed.groupBy(variable, group).agg(((at(low) + at(high)) / 2).alias("median"), F.max("total").alias("total"), F.max("mean").alias("mean"))
    out = mid.groupBy(variable).agg(F.sum("total").alias("n_total"), *[F.max(F.when(F.col(group) == g, F.col(c))).alias(f"{name}_{g}") for name, c in (("n", "total"), ("median", "median"), ("mean", "mean")) for g in (0, 1)])
    return out.join(per.groupBy(variable).agg(F.count_distinct(value).alias("n_unique_scores")), variable)


def score_text(df: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    """score_distribution: 'value:rows' of an ordinal variable (a few different values), by value, joined by '; '."""
    per = df.groupBy(variable, value).agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col("n")))), lambda x: F.concat(x["v"].cast("string"), F.lit(":"), x["n"].cast("string")))
    return per.groupBy(variable).agg(F.array_join(parts, "; ").alias("score_distribution"))


def shortlist(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The screenings of all kinds of variables in one table, by priority, largest first."""
    parts = [df.select(F.lit(kind).alias("variable_type"), *columns) for kind, df in tables.items()]
    return concatenated(*parts).orderBy(F.desc("priority_score"), "variable")
