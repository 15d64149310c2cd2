"""From tile scores to units: aggregation, decisions, rankings, metrics, weights, losses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.storage import unused, written


#: The methods' names.
METHODS = ("mean", "topk_mean", "proportion_above_threshold")


def method_scores(tiles: DataFrame, methods: tuple[str, ...] = METHODS, top_k: int = 10, threshold: float = 0.5, keep: tuple[str, ...] = ("study", "split", "target")) -> DataFrame:
    """unit, kept columns (of the first tile), tile_count and a column for each method.

    The tiles are read once for the sums; the top ones come from a branch of
    their own, so that only ``top_k`` of a unit's tiles of a task are shuffled.
    Ties at the k-th place don't matter to a mean. NaN scores are a data error
    and become null.
    """
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown method {', '.join(sorted(unknown))}")
    if top_k < 1:
        raise ValueError("top_k must be 1 at least")
    tiles = tiles.withColumn("prob", F.when(~F.isnan("prob"), F.col("prob")))
    sums = {"mean": F.avg("prob"), "proportion_above_threshold": F.avg((F.col("prob") >= threshold).cast("int"))}
    firsts = [F.min_by(c, "tile").alias(c) for c in keep if c in tiles.columns]
    out = tiles.groupBy("unit").agg(*firsts, F.count("*").alias("tile_count"), *[c.alias(m) for m, c in sums.items() if m in methods])
    if "topk_mean" in methods:
        rank = F.row_number().over(W.partitionBy("unit").orderBy(F.col("prob").desc_nulls_last(), "tile"))
        top = tiles.select("unit", "prob", "tile").withColumn("rank", rank).filter(F.col("rank") <= top_k)
        out = out.join(top.groupBy("unit").agg(F.avg("prob").alias("topk_mean")), "unit", "left")
    return out


def unit_scores(tiles: DataFrame, method: str = "topk_mean", top_k: int = 10, threshold: float = 0.5, decision: float = 0.5, keep: tuple[str, ...] = ("study", "split", "target")) -> DataFrame:
    """unit, kept columns (of the first tile), tile_count, score, pred_label, confidence by one method."""
    out = method_scores(tiles, (method,), top_k, threshold, keep).withColumnRenamed(method, "score")
    return out.withColumns({"pred_label": (F.col("score") >= decision).cast("int"), "confidence": F.greatest("score", 1 - F.col("score"))})


def method_comparison(tiles: DataFrame, decisions: dict[str, float], **how) -> DataFrame:
    """The binary metrics of each method, from one table of scores; ``decisions`` has each method's threshold."""
    scores = method_scores(tiles, tuple(decisions), **how)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), (F.col(m) >= t).cast("int").alias("pred_label")) for m, t in decisions.items()]))
    return binary_metrics(scores.select("target", each.alias("m")).select("target", "m.*"), ["method"])


def unit_classes(tiles: DataFrame, probs: list[str]) -> DataFrame:
    """Mean probability per class and unit, the first largest class (1-based), its probability."""
    means = tiles.groupBy("unit").agg(F.min_by("target", "tile").alias("target"), F.count("*").alias("tile_count"), *[F.avg(p).alias(p) for p in probs])
    cols = [F.col(p) for p in probs]
    return means.withColumns({"pred_label": C.argmax(cols), "confidence": F.greatest(*cols)})


def top_rows(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def top_per_group(df: DataFrame, group: list[str], by: list[Column], n: int) -> DataFrame:
    rn = F.row_number().over(W.partitionBy(*group).orderBy(*by))
    return df.withColumn("rank", rn).filter(F.col("rank") <= n)


def confusion(df: DataFrame, labels: list[int], truth: str = "target", pred: str = "pred_label") -> DataFrame:
    """target, pred_label, n for the whole grid of labels."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "target int, pred_label int")
    counts = df.groupBy(F.col(truth).cast("int").alias("target"), F.col(pred).cast("int").alias("pred_label")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["target", "pred_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


#: Rows up to which running sums are taken group by group.
FEW = 1_000_000


def running(df: DataFrame, by: list[str], order: str, sums: dict[str, str], wholes: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """For each column of ``sums``: the sum over the group's rows with a smaller ``order``, under the given name; of ``wholes`` over all. ``order`` comes once a group.

    ``df`` is evaluated once. If it is large, it is sorted into ranges of group
    and order, and the ranges are summed apart, so that no task holds a whole
    group; then the sums of the ranges before (a row a range and group) are added.
    A null in ``by`` is a group like any other. ``parts`` fixes the number of ranges, which a small table then has too.
    """
    part, *names = unused([*df.columns, *sums, *(wholes or {})], "part", *(f"sum{i}" for i in range(len(sums))))
    table = written(df, "running")
    less = lambda w: w.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = lambda w: {n: F.coalesce(F.sum(c).over(less(w)), F.lit(0)) for n, c in sums.items()}
    if parts is None and table.count() <= FEW:
        group = W.partitionBy(*by)
        return table.withColumns(before(group) | {n: F.sum(c).over(group) for n, c in (wholes or {}).items()})
    table = written(table.repartitionByRange(*([parts] if parts else []), *by, order).withColumn(part, F.spark_partition_id()), "ranges")
    group, earlier = W.partitionBy(*by), W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    ranges = table.groupBy(*by, part).agg(*[F.sum(c).alias(c) for c in {*sums.values(), *(wholes or {}).values()}])
    ranges = ranges.select(*by, part, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(x) for x, c in zip(names, sums.values(), strict=True)], *[F.sum(c).over(group).alias(n) for n, c in (wholes or {}).items()])
    inside = table.withColumns(before(W.partitionBy(*by, part)))
    own, other = inside.alias("own"), ranges.alias("other")
    met = own.join(other, (F.col(f"own.{part}") == F.col(f"other.{part}")) & reduce(lambda a, b: a & b, [F.col(f"own.{c}").eqNullSafe(F.col(f"other.{c}")) for c in by], F.lit(True)))
    rest = [F.col(f"own.{c}") for c in df.columns]
    return met.select(*rest, *[(F.col(f"own.{n}") + F.col(f"other.{x}")).alias(n) for x, n in zip(names, sums, strict=True)], *[F.col(f"other.{n}") for n in (wholes or {})])


def cuts(df: DataFrame, by: list[str], truth: str = "target", score: str = "score") -> DataFrame:
    """Per distinct score: positives and negatives at it (p, q), at it and above it (tp, fp), and in all (pos, neg)."""
    at = df.groupBy(*by, F.col(score).alias("cut")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.sum(1 - F.col(truth).cast("long")).alias("q"))
    both = running(at, by, "cut", {"low_p": "p", "low_q": "q"}, {"pos": "p", "neg": "q"})
    return both.withColumns({"tp": F.col("pos") - F.col("low_p"), "fp": F.col("neg") - F.col("low_q")}).drop("low_p", "low_q")


def ranking_metrics(df: DataFrame, by: list[str], truth: str = "target", score: str = "score") -> DataFrame:
    """auroc (ties count half) and average_precision (by steps) per group; null where there is one class only."""
    c = cuts(df, by, truth, score)
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / (F.max("pos") * F.max("neg"))
    steps = F.sum(F.col("p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    ok = (F.max("pos") > 0) & (F.max("neg") > 0)
    safe = c.withColumns({"pos": F.nullif("pos", F.lit(0)), "neg": F.nullif("neg", F.lit(0))})
    return safe.groupBy(*by).agg(F.when(ok, area).alias("auroc"), F.when(ok, steps).alias("average_precision"))


def curve_points(df: DataFrame, truth: str = "target", score: str = "score", ends: bool = False) -> DataFrame:
    """cut, tpr, fpr, precision, recall at each distinct score; with ``ends`` also the points above the largest (cut null): nothing is found there, with a precision of 1."""
    c = cuts(df.withColumn("__all", F.lit(1)), ["__all"], truth, score)
    out = c.select("cut", (F.col("tp") / F.col("pos")).alias("tpr"), (F.col("fp") / F.col("neg")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("pos")).alias("recall"))
    if ends:
        first = df.sparkSession.createDataFrame([(None, 0.0, 0.0, 1.0, 0.0)], "cut double, tpr double, fpr double, precision double, recall double")
        out = first.unionByName(out)
    return out


def curve_areas(df: DataFrame, by: list[str], truth: str = "target", score: str = "score") -> DataFrame:
    """auroc_curve, auprc_curve per group: trapezoids under both curves with their end points; null where there is one class only.

    A trapezoid needs a cut's counts and those above it only, so no order is
    needed once the running counts are there.
    """
    c = cuts(df, by, truth, score).withColumns({"tp0": F.col("tp") - F.col("p"), "fp0": F.col("fp") - F.col("q")})
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    above = F.when(F.col("tp0") + F.col("fp0") == 0, 1.0).otherwise(F.try_divide(F.col("tp0"), F.col("tp0") + F.col("fp0")))
    roc = F.sum(F.col("q") * (F.col("tp") + F.col("tp0")) / 2) / (F.max("pos") * F.max("neg"))
    pr = F.sum(F.col("p") * (precision + above) / 2) / F.max("pos")
    ok = (F.max("pos") > 0) & (F.max("neg") > 0)
    safe = c.withColumns({"pos": F.nullif("pos", F.lit(0)), "neg": F.nullif("neg", F.lit(0))})
    return safe.groupBy(*by).agg(F.when(ok, roc).alias("auroc_curve"), F.when(ok, pr).alias("auprc_curve"))


def binary_metrics(df: DataFrame, by: list[str], truth: str = "target", pred: str = "pred_label") -> DataFrame:
    """tn, fp, fn, tp and f1, sensitivity, specificity (0 on empty denominators), balanced_accuracy (mean over classes that occur)."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    c = df.groupBy(*by).agg(F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sens, spec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    return c.withColumns({"f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), "sensitivity": F.coalesce(sens, F.lit(0.0)), "specificity": F.coalesce(spec, F.lit(0.0)), "balanced_accuracy": (F.coalesce(sens, spec) + F.coalesce(spec, sens)) / 2})


def class_metrics(df: DataFrame, labels: list[int], truth: str = "target", pred: str = "pred_label") -> DataFrame:
    """label, precision, recall, f1 (0 on empty denominators), support for each label of the list."""
    each = df.select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"), F.col(truth).alias("t"), F.col(pred).alias("p"))
    c = each.groupBy("label").agg(F.count_if((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))).alias("hit"), F.count_if(F.col("p") == F.col("label")).alias("said"), F.count_if(F.col("t") == F.col("label")).alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select("label", ratio(F.col("hit"), F.col("said")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), ratio(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support", "said", "hit")


def multiclass_metrics(df: DataFrame, labels: list[int], truth: str = "target", pred: str = "pred_label") -> DataFrame:
    """accuracy, macro_f1 (over labels that occur), weighted_f1."""
    c = class_metrics(df, labels, truth, pred)
    n = F.sum("support")
    return c.agg((F.sum("hit") / n).alias("accuracy"), F.avg(F.when((F.col("support") > 0) | (F.col("said") > 0), F.col("f1"))).alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"))


def quadratic_kappa(df: DataFrame, truth: str = "target", pred: str = "pred_label") -> DataFrame:
    """Weighted by the places of the labels among those that occur; null if the truth has one class."""
    pairs = written(df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n")), "pairs")
    used = pairs.select(F.explode(F.array("t", "p")).alias("label")).distinct()
    place = used.select("label", F.row_number().over(W.orderBy("label")).alias("at"))
    a, b = place.select(F.col("label").alias("t"), F.col("at").alias("i")), place.select(F.col("label").alias("p"), F.col("at").alias("j"))
    o = pairs.join(a, "t").join(b, "p")
    rows, cols = o.groupBy("i").agg(F.sum("n").alias("r")), o.groupBy("j").agg(F.sum("n").alias("c"))
    seen = o.agg(F.sum(F.col("n") * F.pow(F.col("i") - F.col("j"), F.lit(2))).alias("seen"), F.sum("n").alias("total"), F.count_distinct("t").alias("kinds"))
    # The moments of the marginals give the expected disagreement without pairing them.
    rm = rows.agg(F.sum(F.col("r") * F.col("i")).alias("r1"), F.sum(F.col("r") * F.col("i") * F.col("i")).alias("r2"))
    cm = cols.agg(F.sum(F.col("c") * F.col("j")).alias("c1"), F.sum(F.col("c") * F.col("j") * F.col("j")).alias("c2"))
    one = seen.withColumn("k", F.lit(1)).join(rm.withColumn("k", F.lit(1)), "k").join(cm.withColumn("k", F.lit(1)), "k")
    expected = F.col("r2") + F.col("c2") - 2 * F.col("r1") * F.col("c1") / F.col("total")
    return one.select(F.when(F.col("kinds") > 1, 1 - F.try_divide(F.col("seen"), expected)).alias("kappa"))


def histogram(df: DataFrame, score: str, bins: int = 20) -> DataFrame:
    """bin (from 0), n: equal bins from the least to the largest score, the last one closed. Null and NaN don't count; one value is in the middle of a range of 1."""
    v = F.col(score).cast("double")
    known = df.filter(v.isNotNull() & ~F.isnan(v))
    lo, hi = known.agg(F.min(v), F.max(v)).first()
    if lo is not None and lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    at = F.when(v == hi, bins - 1).otherwise(F.floor((v - lo) / (hi - lo) * bins)) if lo is not None else F.lit(0)
    counts = known.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def class_weights(df: DataFrame, labels: list[int], target: str = "target") -> DataFrame:
    """target, n, weight = rows / (classes * n); 0 for a class without rows."""
    grid = df.sparkSession.createDataFrame([(x,) for x in labels], "target int")
    c = df.filter(F.col(target).isin(*labels)).groupBy(F.col(target).cast("int").alias("target")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total")).withColumn("k", F.lit(1))
    full = grid.join(c, "target", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "k": F.lit(1)}).join(total, "k")
    return full.select("target", "n", F.coalesce(F.try_divide(F.col("total"), F.col("n") * len(labels)), F.lit(0.0)).alias("weight"))


def sample_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """``sample_weight``: one over the rows of the row's class. Counted first, so that a large class isn't gathered."""
    c = df.groupBy(target).agg((1 / F.count("*")).alias("sample_weight"))
    return df.join(c, target, "left")


def losses(df: DataFrame, prob: Column, weight: Column, gamma: float | None = None) -> DataFrame:
    """loss: weighted cross entropy (over the sum of weights), or plain mean of focal terms."""
    p = F.greatest(prob, F.lit(1e-12))
    if gamma is None:
        return df.agg((F.sum(-weight * F.log(p)) / F.sum(weight)).alias("loss"))
    return df.agg(F.avg(-weight * F.pow(1 - p, F.lit(gamma)) * F.log(p)).alias("loss"))


def task_summary(units: DataFrame, tiles: DataFrame, levels: list[int], label: str = "target") -> DataFrame:
    """A row per task and level: units in all and by split, classes by split as JSON, tiles by split.

    ``units`` has task, split and the label; ``tiles`` task, split and read_level.
    """
    split = F.col("split")
    per = units.groupBy("task").agg(F.count("*").alias("n_analysis_units_total"), F.count_if(split == "train").alias("n_analysis_units_train"), F.count_if(split == "val").alias("n_analysis_units_val"))
    classes = units.filter(F.col(label).isNotNull()).groupBy("task", "split", label).agg(F.count("*").alias("n"))
    pair = F.struct(F.col(label).alias("o"), F.col(label).cast("string").alias("key"), F.col("n").alias("value"))
    of = lambda s: F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.when(split == s, pair))), lambda x: F.struct(x["key"], x["value"]))))
    counts = classes.groupBy("task").agg(of("train").alias("class_counts_train"), of("val").alias("class_counts_val"))
    held = tiles.groupBy("task", "read_level").agg(F.count_if(split == "train").alias("n_tiles_train"), F.count_if(split == "val").alias("n_tiles_val"))
    grid = per.join(counts, "task", "left").withColumn("read_level", F.explode(F.array(*map(F.lit, levels))))
    return grid.join(held, ["task", "read_level"], "left").fillna(0, ["n_tiles_train", "n_tiles_val"])
