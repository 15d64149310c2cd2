"""Queries over the manifest operators, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import columns as C
from .operators import manifest as M
from .operators import regions as R
from .operators import scores as S
from .operators import splits as P
from .plans import views as V
from .plans.session import ship
from .registry import ORACLES, QUERIES, query

CLASSES = [1, 2, 3, 4, 5]
PROBS = [f"prob_class_{i}" for i in CLASSES]


def _r(name: str, places: int = 9):
    return F.round(name, places).alias(name)


# Aggregation to units


@query(V.sql("SELECT unit, study, tile_count, round(score, 9) AS score, (score >= 0.5)::INT AS pred_label FROM us", "topk"))
def au_topk_mean(spark, d):
    return S.unit_scores(V.tile_predictions(spark, d)).select("unit", "study", "tile_count", _r("score"), "pred_label")


@query(V.sql("SELECT unit, split, target, tile_count, round(mean_score, 9) AS score, (mean_score >= 0.17)::INT AS pred_label FROM us", "topk"))
def au_mean(spark, d):
    return S.unit_scores(V.tile_predictions(spark, d), "mean", decision=0.17).select("unit", "split", "target", "tile_count", _r("score"), "pred_label")


@query(V.sql("SELECT unit, tile_count, round(prop, 9) AS score, (prop >= 0.1)::INT AS pred_label, round(greatest(prop, 1 - prop), 9) AS confidence FROM us", "topk"))
def au_prop_above(spark, d):
    return S.unit_scores(V.tile_predictions(spark, d), "proportion_above_threshold", decision=0.1).select("unit", "tile_count", _r("score"), "pred_label", _r("confidence"))


_METHODS = "me AS (SELECT 'mean' AS method, target, mean_score AS score, (mean_score >= 0.17)::INT AS y FROM us UNION ALL SELECT 'proportion_above_threshold', target, prop, (prop >= 0.1)::INT FROM us UNION ALL SELECT 'topk_mean', target, score, (score >= 0.5)::INT FROM us), cm AS (SELECT method, count(*) FILTER (target = 0 AND y = 0) AS tn, count(*) FILTER (target = 0 AND y = 1) AS fp, count(*) FILTER (target = 1 AND y = 0) AS fn, count(*) FILTER (target = 1 AND y = 1) AS tp FROM me GROUP BY method)"
_METRICS = "tn, fp, fn, tp, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(coalesce(1.0 * tp / nullif(tp + fn, 0), 0), 9) AS sensitivity, round(coalesce(1.0 * tn / nullif(tn + fp, 0), 0), 9) AS specificity, round((1.0 * tp / nullif(tp + fn, 0) + 1.0 * tn / nullif(tn + fp, 0)) / 2, 9) AS balanced_accuracy"
_BINARY = ("f1", "sensitivity", "specificity", "balanced_accuracy")


@query(V.sql(f", {_METHODS} SELECT method, {_METRICS} FROM cm", "topk"))
def au_method_comparison(spark, d):
    found = S.method_comparison(V.tile_predictions(spark, d), {"mean": 0.17, "proportion_above_threshold": 0.1, "topk_mean": 0.5})
    return found.select("method", "tn", "fp", "fn", "tp", *map(_r, _BINARY))


_MC = "uc AS (SELECT unit, arg_min(target, tile) AS target, count(*) AS tile_count, " + ", ".join(f"avg({p}) AS {p}" for p in PROBS) + " FROM mp GROUP BY unit), mc AS (SELECT *, list_position([" + ", ".join(PROBS) + "], greatest(" + ", ".join(PROBS) + "))::INT AS pred_label, greatest(" + ", ".join(PROBS) + ") AS confidence FROM uc)"


def _mc(body: str) -> str:
    return V.sql("", "mp") + f", {_MC} {body}"


@query(_mc("SELECT unit, target, tile_count, pred_label, round(confidence, 7) AS confidence, " + ", ".join(f"round({p}, 7) AS {p}" for p in PROBS) + " FROM mc"))
def au_multiclass_mean(spark, d):
    return S.unit_classes(V.tile_probs(spark, d), PROBS).select("unit", "target", "tile_count", "pred_label", _r("confidence", 7), *[_r(p, 7) for p in PROBS])


@query(V.sql("SELECT unit, tile, " + ", ".join(f"round({p}, 7) AS {p}" for p in PROBS) + " FROM mp", "mp"))
def tile_softmax_scores(spark, d):
    return V.tile_probs(spark, d).select("unit", "tile", *[_r(p, 7) for p in PROBS])


@query(V.sql("SELECT unit, tile, (prob >= 0.5)::INT AS pred_label, round(greatest(prob, 1 - prob), 9) AS confidence, CASE WHEN prob >= 0.5 THEN 'positive' ELSE 'negative' END AS pred_class_name FROM tp", "tp"))
def tile_binary_decision(spark, d):
    t = V.tile_predictions(spark, d).withColumn("confidence", F.greatest("prob", 1 - F.col("prob")))
    return t.select("unit", "tile", (F.col("prob") >= 0.5).cast("int").alias("pred_label"), _r("confidence"), F.when(F.col("prob") >= 0.5, "positive").otherwise("negative").alias("pred_class_name"))


# Manifests: filters, cleaning, joins, sets


@query(V.sql(f"SELECT unit, tile, level FROM tm WHERE lower({V.stripped('review_category')}) <> 'exclude' AND task_label IS NOT NULL AND level BETWEEN 0 AND 5 AND contains(tile_path, 'tiles/train')", "tm"))
def manifest_base_filter(spark, d):
    return M.base_filter(V.tile_manifest(spark, d), contains="tiles/train").select("unit", "tile", "level")


@query(V.sql(f"SELECT unit, tile FROM tm WHERE lower({V.stripped('review_category')}) = 'pass' AND task_label IS NOT NULL AND level BETWEEN 0 AND 5", "tm"))
def manifest_exclude_suspect(spark, d):
    kept = M.base_filter(V.tile_manifest(spark, d))
    return M.conditions(kept, {"review_category": C.normal(F.col("review_category")) != "suspect", "is_suspect": F.col("tile") < 0, "level": None}).select("unit", "tile")


_WHY = "CASE WHEN bbox_w < 200 OR bbox_h < 200 THEN 'invalid_roi' WHEN unit % 7 = 0 THEN 'not_evaluable' WHEN unit % 11 = 0 THEN 'missing_label' END"


def _why(spark, d):
    small = (F.col("bbox_w") < 200) | (F.col("bbox_h") < 200)
    checks = [("invalid_roi", ~M.valid_box() | small), ("not_evaluable", F.col("unit") % 7 == 0), ("missing_label", F.col("unit") % 11 == 0)]
    return M.reasons(V.rois(spark, d), checks)


@query(V.sql(f"SELECT unit, {_WHY} AS reason FROM roi", "roi"))
def eligibility_reasons(spark, d):
    return _why(spark, d).select("unit", "reason")


@query(V.sql(f"SELECT unit, 'eligibility' AS stage, {_WHY} AS issue_code FROM roi WHERE {_WHY} IS NOT NULL UNION ALL SELECT unit, 'size', 'wide' FROM roi WHERE bbox_w > 1500", "roi"))
def issue_log(spark, d):
    a = _why(spark, d).filter("reason IS NOT NULL").select("unit", F.lit("eligibility").alias("stage"), F.col("reason").alias("issue_code"))
    b = V.rois(spark, d).filter("bbox_w > 1500").select("unit", F.lit("size").alias("stage"), F.lit("wide").alias("issue_code"))
    return a.unionByName(b)


@query(V.sql("SELECT tile, CASE WHEN starts_with(tile_path, '/') THEN tile_path ELSE '/root/' || tile_path END AS resolved, string_split(tile_path, '/')[-1] AS filename, 't' || tile AS stem, '.png' AS suffix, 'tiles/enteritis/' || split || '/level_' || level || '/' || study || '/t' || tile AS out_path FROM tm", "tm"))
def path_resolution(spark, d):
    from .sources.tables import tile_path

    p = F.col("tile_path")
    out = tile_path(F.lit("enteritis"), F.col("split"), F.col("level"), F.col("study").cast("string"), F.concat(F.lit("t"), F.col("tile")))
    return V.tile_manifest(spark, d).select("tile", C.under("/root", p).alias("resolved"), C.basename(p).alias("filename"), C.stem(p).alias("stem"), C.suffix(p).alias("suffix"), out.alias("out_path"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(trim(url), '[^\\p{L}\\p{N}_-]', '_', 'g'), '_'), ''), 'unknown') AS token FROM pages")
def safe_tokens(spark, d):
    return V.table(spark, d, "pages").select("page_id", C.token(F.col("url")).alias("token"))


_WORDS = (" True", "1", "yes", "Y", "false", None, "no", "\tyes\n", "\xa0TRUE\u2003", "\x1fy")
_WORD = V.stripped("CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {' || '.join(f'chr({ord(c)})' for c in w)}" for i, w in enumerate(_WORDS) if w) + " ELSE '' END")


@query(f"SELECT event_id, lower({_WORD}) IN ('1', 'true', 'yes', 'y') AS wide, lower({_WORD}) IN ('1', 'true', 'yes') AS narrow FROM events")
def bool_parse(spark, d):
    words = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % len(_WORDS) + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", C.truthy(words).alias("wide"), C.truthy(words, C.TRUE_NARROW).alias("narrow"))


_RAWS = (" 3 ", "2.0", "x", "", "6", None, "\t", "\xa0\n", "\t3\n", "\u20032")
_RAW = V.stripped("CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {' || '.join(f'chr({ord(c)})' for c in w) or chr(39) * 2}" for i, w in enumerate(_RAWS) if w is not None) + " END")


def _raw(spark, d):
    words = F.element_at(F.array(*map(F.lit, _RAWS)), (F.col("event_id") % len(_RAWS) + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", words.alias("raw"))


@query(f"SELECT event_id, try_cast({_RAW} AS DOUBLE) AS num, coalesce(trunc(try_cast({_RAW} AS DOUBLE))::INT, 0) AS whole, nullif({_RAW}, '') AS filled FROM events")
def numeric_coerce(spark, d):
    c = F.col("raw")
    return _raw(spark, d).select("event_id", C.number(c).alias("num"), C.whole(c, 0).alias("whole"), C.filled(c).alias("filled"))


@query(f"SELECT event_id, CASE trunc(try_cast({_RAW} AS DOUBLE))::INT WHEN 2 THEN 0 WHEN 3 THEN 1 END AS target FROM events")
def label_map(spark, d):
    return _raw(spark, d).select("event_id", C.mapped(F.col("raw"), {"2": 0, "3": 1, "6": 9}, [0, 1]).alias("target"))


@query("WITH s AS (SELECT s_nationkey, s_name, s_acctbal AS c_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) SELECT c_custkey, c_acctbal AS c_acctbal_x, s_name, s.c_acctbal AS c_acctbal_y FROM (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS k FROM customer) c LEFT JOIN s ON k = s_nationkey AND rn = 1".replace("SELECT c_custkey, c_acctbal AS", "SELECT c_custkey, c.c_acctbal AS"))
def metadata_join(spark, d):
    left = V.table(spark, d, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 10 != 0, F.col("c_nationkey")).alias("k"))
    right = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_name", F.col("s_acctbal").alias("c_acctbal"), "s_suppkey")
    return M.metadata_join(left, right, "k", ["s_name", "c_acctbal"], [F.asc("s_suppkey")]).select("c_custkey", "c_acctbal_x", "s_name", "c_acctbal_y")


_RULES = [("1-URGENT", "keep_largest", 1), ("2-HIGH", "keep_n_left_to_right", 3), ("3-MEDIUM", "keep_representative", None)]


@query("SELECT o_orderkey, coalesce(mode, 'keep_largest') AS mode, coalesce(n, 2) AS n, mode IS NOT NULL AS known FROM orders LEFT JOIN (VALUES ('1-URGENT', 'keep_largest', 1), ('2-HIGH', 'keep_n_left_to_right', 3), ('3-MEDIUM', 'keep_representative', NULL)) r(p, mode, n) ON o_orderpriority = p")
def layout_lookup(spark, d):
    rules = spark.createDataFrame(_RULES, "o_orderpriority string, mode string, n int")
    return M.rule_lookup(V.table(spark, d, "orders"), F.broadcast(rules), "o_orderpriority", {"mode": F.lit("keep_largest"), "n": F.lit(2)}).select("o_orderkey", "mode", "n", "known")


@query("""WITH f AS (SELECT 'slides/' || s_name || '.SVS' AS path, lower(s_name) AS stem FROM supplier), k AS (SELECT DISTINCT lower(trim(key)) AS key FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'Supplier#' || lpad((n_nationkey + 1)::VARCHAR, 9, '0') WHEN n_nationkey % 3 = 1 THEN lpad(n_nationkey::VARCHAR, 5, '0') ELSE 'x-supplier#' || lpad(n_nationkey::VARCHAR, 9, '0') || '-b' END AS key FROM nation)),
m AS (SELECT key, path, 1 AS tier FROM k JOIN f ON key = stem UNION ALL SELECT key, min(path), 2 FROM k JOIN f ON contains(stem, key) GROUP BY key HAVING count(*) = 1 UNION ALL SELECT key, min(path), 3 FROM k JOIN f ON contains(key, stem) GROUP BY key HAVING count(*) = 1),
b AS (SELECT key, arg_min(path, tier) AS match, min(tier) AS tier FROM m GROUP BY key) SELECT k.key, match, tier FROM k LEFT JOIN b USING (key)""")
def fuzzy_file_match(spark, d):
    k = F.col("n_nationkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    key = F.when(k % 3 == 0, F.concat(F.lit("Supplier#"), pad(k + 1, 9))).when(k % 3 == 1, pad(k, 5)).otherwise(F.concat(F.lit("x-supplier#"), pad(k, 9), F.lit("-b")))
    rows = V.table(spark, d, "nation").select(F.lower(F.trim(key)).alias("key")).distinct()
    files = V.table(spark, d, "supplier").select(F.concat(F.lit("slides/"), "s_name", F.lit(".SVS")).alias("path"))
    return M.match_files(rows, "key", files).select("key", "match", "tier")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_split(spark, d):
    o = V.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return V.table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def anti_split(spark, d):
    o = V.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return V.table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'")
def leakage_check(spark, d):
    e = V.table(spark, d, "events")
    return M.leakage(e.filter("event_type = 'error'"), e.filter("event_type = 'signup'"), "user_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, d):
    return M.duplicates(V.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# Counts and reports


@query(V.sql("SELECT split, target, count(*) AS n FROM tp GROUP BY ALL", "tp"))
def class_distribution(spark, d):
    return V.tile_predictions(spark, d).groupBy("split", "target").agg(F.count("*").alias("n")).orderBy("split", "target")


@query(V.sql("SELECT task_label, count(*) AS n FROM tm WHERE task_label IS NOT NULL GROUP BY ALL", "tm"))
def value_counts(spark, d):
    return V.tile_manifest(spark, d).filter("task_label IS NOT NULL").groupBy("task_label").agg(F.count("*").alias("n"))


@query(V.sql("SELECT split, count(DISTINCT study) AS studies, count(DISTINCT unit) AS units FROM tp GROUP BY split", "tp"))
def study_distinct(spark, d):
    return V.tile_predictions(spark, d).groupBy("split").agg(F.count_distinct("study").alias("studies"), F.count_distinct("unit").alias("units"))


@query(V.sql("SELECT unit, arg_min(task_label, tile) FILTER (task_label IS NOT NULL) AS task_label, arg_min(event_type, tile) AS event_type FROM tm GROUP BY unit", "tm"))
def unit_first_label(spark, d):
    t = V.tile_manifest(spark, d)
    return P.units(t, "unit", "task_label", "tile").join(t.groupBy("unit").agg(F.min_by("event_type", "tile").alias("event_type")), "unit")


@query(V.sql(", c AS (SELECT split, target, count(*) AS n FROM tp GROUP BY ALL) SELECT split, '{' || string_agg('\"' || target || '\":' || n, ',' ORDER BY target) || '}' AS counts FROM c GROUP BY split", "tp"))
def class_counts_json(spark, d):
    c = V.tile_predictions(spark, d).groupBy("split", "target").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct(F.col("target").cast("string").alias("key"), F.col("n").alias("value"))))
    return c.groupBy("split").agg(F.to_json(F.map_from_entries(pairs)).alias("counts"))


@query(V.sql("SELECT event_type, split, study, count(*) AS n FROM tp GROUP BY ALL", "tp"))
def review_counts(spark, d):
    return V.tile_predictions(spark, d).groupBy("event_type", "split", "study").agg(F.count("*").alias("n"))


@query(V.sql(", u AS (SELECT unit, arg_min(split, tile) AS split, arg_min(target, tile) AS target, count(*) AS n FROM tp GROUP BY unit) SELECT split, target, sum(n)::BIGINT AS tiles, count(*) AS units FROM u GROUP BY ALL", "tp"))
def split_summary(spark, d):
    u = V.tile_predictions(spark, d).groupBy("unit").agg(F.min_by("split", "tile").alias("split"), F.min_by("target", "tile").alias("target"), F.count("*").alias("n"))
    return u.groupBy("split", "target").agg(F.sum("n").alias("tiles"), F.count("*").alias("units"))


@query(V.sql("SELECT unit, count(*) AS considered, count(*) FILTER (tissue >= 0.3) AS eligible, least(count(*) FILTER (tissue >= 0.3), 10) AS kept FROM gr GROUP BY unit", "grid"))
def extraction_summary(spark, d):
    g = V.tissue(R.grid(V.rois(spark, d), 256, 128, by="unit"))
    return g.groupBy("unit").agg(F.count("*").alias("considered"), F.count_if(F.col("tissue") >= 0.3).alias("eligible")).withColumn("kept", F.least("eligible", F.lit(10).cast("long")))


@query(V.sql("SELECT count(*) AS tiles, count(DISTINCT unit) AS units, count(DISTINCT study) AS studies, round(avg(prob), 9) AS mean_prob FROM tp", "tp"))
def run_summary(spark, d):
    return V.tile_predictions(spark, d).agg(F.count("*").alias("tiles"), F.count_distinct("unit").alias("units"), F.count_distinct("study").alias("studies"), F.round(F.avg("prob"), 9).alias("mean_prob"))


@query("SELECT CASE WHEN event_type = 'error' THEN 'a' ELSE 'b' END AS part, round(sum(value * user_id) / sum(user_id), 7) AS loss FROM events GROUP BY ALL")
def running_loss(spark, d):
    e = V.table(spark, d, "events").withColumn("part", F.when(F.col("event_type") == "error", "a").otherwise("b"))
    return e.groupBy("part").agg(F.round(F.sum(F.col("value") * F.col("user_id")) / F.sum("user_id"), 7).alias("loss"))


# Metrics


@query(_mc("SELECT t.v AS target, p.v AS pred_label, count(mc.unit) AS n FROM (VALUES (1),(2),(3),(4),(5)) t(v) CROSS JOIN (VALUES (1),(2),(3),(4),(5)) p(v) LEFT JOIN mc ON target = t.v AND pred_label = p.v GROUP BY ALL"))
def confusion_matrix(spark, d):
    return S.confusion(S.unit_classes(V.tile_probs(spark, d), PROBS), CLASSES)


_RANK = ", a AS (SELECT split, target, prob, rank() OVER w AS lo, count(*) OVER (PARTITION BY split, prob) AS n FROM tp WINDOW w AS (PARTITION BY split ORDER BY prob)), b AS (SELECT split, sum(target) AS pos, count(*) - sum(target) AS neg, sum((lo + (n - 1) / 2.0) * target) AS r FROM a GROUP BY split) SELECT split, round((r - pos * (pos + 1) / 2.0) / (pos * neg), 8) AS auroc FROM b"


@query(V.sql(_RANK, "tp"))
def auroc(spark, d):
    return S.ranking_metrics(V.tile_predictions(spark, d), ["split"], score="prob").select("split", _r("auroc", 8))


_CUTS = ", k AS (SELECT prob AS cut, sum(target) AS p, sum(1 - target) AS q FROM tp GROUP BY prob), c AS (SELECT cut, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pos, sum(q) OVER () AS neg FROM k WINDOW w AS (ORDER BY cut DESC))"


@query(V.sql(_CUTS + " SELECT round(sum(p / pos * tp / (tp + fp)), 8) AS average_precision FROM c", "tp"))
def average_precision(spark, d):
    return S.ranking_metrics(V.tile_predictions(spark, d).withColumn("g", F.lit(1)), ["g"], score="prob").select(_r("average_precision", 8))


@query(V.sql(_CUTS + " SELECT round(cut, 9) AS cut, round(tp / pos, 9) AS tpr, round(fp / neg, 9) AS fpr FROM c UNION ALL SELECT NULL, 0.0, 0.0", "tp"))
def roc_points(spark, d):
    return S.curve_points(V.tile_predictions(spark, d), score="prob", ends=True).select(_r("cut"), _r("tpr"), _r("fpr"))


@query(V.sql(_CUTS + " SELECT round(cut, 9) AS cut, round(tp / (tp + fp), 9) AS precision, round(tp / pos, 9) AS recall FROM c UNION ALL SELECT NULL, 1.0, 0.0", "tp"))
def pr_points(spark, d):
    return S.curve_points(V.tile_predictions(spark, d), score="prob", ends=True).select(_r("cut"), _r("precision"), _r("recall"))


_AREAS = ", k AS (SELECT split, prob AS cut, sum(target) AS p, sum(1 - target) AS q FROM tp GROUP BY ALL), c AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY split) AS pos, sum(q) OVER (PARTITION BY split) AS neg FROM k WINDOW w AS (PARTITION BY split ORDER BY cut DESC)), l AS (SELECT *, tp / pos AS tpr, fp / neg AS fpr, tp / (tp + fp) AS pre, lag(tp / pos, 1, 0) OVER w AS tpr0, lag(fp / neg, 1, 0) OVER w AS fpr0, lag(tp / (tp + fp), 1, 1) OVER w AS pre0 FROM c WINDOW w AS (PARTITION BY split ORDER BY cut DESC))"


@query(V.sql(_AREAS + " SELECT split, round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 8) AS auroc_curve, round(sum((tpr - tpr0) * (pre + pre0) / 2), 8) AS auprc_curve FROM l GROUP BY split", "tp"))
def curve_areas(spark, d):
    return S.curve_areas(V.tile_predictions(spark, d), ["split"], score="prob").select("split", _r("auroc_curve", 8), _r("auprc_curve", 8))


@query(V.sql(f", cm AS (SELECT split, count(*) FILTER (target = 0 AND score < 0.5) AS tn, count(*) FILTER (target = 0 AND score >= 0.5) AS fp, count(*) FILTER (target = 1 AND score < 0.5) AS fn, count(*) FILTER (target = 1 AND score >= 0.5) AS tp FROM us GROUP BY split) SELECT split, {_METRICS} FROM cm", "topk"))
def binary_metrics(spark, d):
    return S.binary_metrics(S.unit_scores(V.tile_predictions(spark, d)), ["split"]).select("split", "tn", "fp", "fn", "tp", *map(_r, _BINARY))


_PER = ", pc AS (SELECT v AS label, count(*) FILTER (target = v AND pred_label = v) AS hit, count(*) FILTER (pred_label = v) AS said, count(*) FILTER (target = v) AS support FROM mc CROSS JOIN (VALUES (1),(2),(3),(4),(5)) l(v) GROUP BY v), pf AS (SELECT *, coalesce(2.0 * hit / nullif(said + support, 0), 0) AS f1 FROM pc)"


@query(_mc(_PER + " SELECT round(sum(hit) / sum(support), 9) AS accuracy, round(avg(f1) FILTER (support > 0 OR said > 0), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM pf"))
def multiclass_metrics(spark, d):
    return S.multiclass_metrics(S.unit_classes(V.tile_probs(spark, d), PROBS), CLASSES).select(_r("accuracy"), _r("macro_f1"), _r("weighted_f1"))


@query(_mc(_PER + " SELECT label, round(coalesce(1.0 * hit / nullif(said, 0), 0), 9) AS precision, round(coalesce(1.0 * hit / nullif(support, 0), 0), 9) AS recall, round(f1, 9) AS f1, support FROM pf"))
def per_class_metrics(spark, d):
    return S.class_metrics(S.unit_classes(V.tile_probs(spark, d), PROBS), CLASSES).select("label", _r("precision"), _r("recall"), _r("f1"), "support")


@query(_mc(", ul AS (SELECT v, row_number() OVER (ORDER BY v) AS at FROM (SELECT target AS v FROM mc UNION SELECT pred_label FROM mc)), o AS (SELECT a.at AS i, b.at AS j FROM mc JOIN ul a ON target = a.v JOIN ul b ON pred_label = b.v), e AS (SELECT sum(pow(x.i - y.j, 2)) / count(*) AS expected FROM o x CROSS JOIN o y) SELECT round(1 - (SELECT avg(pow(i - j, 2)) FROM o) / expected, 9) AS kappa FROM e"))
def qwk(spark, d):
    return S.quadratic_kappa(S.unit_classes(V.tile_probs(spark, d), PROBS)).select(_r("kappa"))


_HIST = ", v AS (SELECT 'scores' AS kind, CASE WHEN tile % 13 <> 0 THEN prob END AS v FROM tp UNION ALL SELECT 'one value', CASE WHEN tile % 13 <> 0 THEN 0.25 END FROM tp), m0 AS (SELECT kind, min(v) AS a, max(v) AS b FROM v GROUP BY kind), m AS (SELECT kind, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM m0), h AS (SELECT kind, CASE WHEN v = hi THEN 19 ELSE floor((v - lo) / (hi - lo) * 20)::INT END AS bin FROM v JOIN m USING (kind) WHERE v IS NOT NULL) SELECT k.kind, r::INT AS bin, count(h.bin) AS n FROM range(20) t(r) CROSS JOIN (SELECT DISTINCT kind FROM v) k LEFT JOIN h ON h.bin = r AND h.kind = k.kind GROUP BY ALL"


@query(V.sql(_HIST, "tp"))
def score_histogram(spark, d):
    known = F.col("tile") % 13 != 0
    t = V.tile_predictions(spark, d).select(F.when(known, F.col("prob")).alias("prob"), F.when(known, 0.25).alias("one"))
    kinds = [S.histogram(t, c).select(F.lit(kind).alias("kind"), "bin", "n") for kind, c in (("scores", "prob"), ("one value", "one"))]
    return kinds[0].union(kinds[1])


@query(V.sql(", c AS (SELECT target, count(*) AS n FROM tp GROUP BY target) SELECT v AS target, coalesce(n, 0) AS n, round(coalesce((SELECT sum(n) FROM c) / (n * 3.0), 0), 9) AS weight FROM (VALUES (0),(1),(2)) g(v) LEFT JOIN c ON target = v", "tp"))
def class_weights(spark, d):
    return S.class_weights(V.tile_predictions(spark, d), [0, 1, 2]).select("target", "n", _r("weight"))


@query(V.sql("SELECT tile, round(1.0 / count(*) OVER (PARTITION BY target), 12) AS sample_weight FROM tp", "tp"))
def sample_weights(spark, d):
    return S.sample_weights(V.tile_predictions(spark, d)).select("tile", _r("sample_weight", 12))


@query(V.sql("SELECT round(avg(-(CASE WHEN target = 1 THEN 2.0 ELSE 1.0 END) * pow(1 - p, 2) * ln(p)), 7) AS focal, round(sum(-(CASE WHEN target = 1 THEN 2.0 ELSE 1.0 END) * ln(p)) / sum(CASE WHEN target = 1 THEN 2.0 ELSE 1.0 END), 7) AS cross_entropy FROM (SELECT target, greatest(CASE WHEN target = 1 THEN prob ELSE 1 - prob END, 1e-12) AS p FROM tp)", "tp"))
def focal_loss_eval(spark, d):
    t = V.tile_predictions(spark, d)
    p, w = F.when(F.col("target") == 1, F.col("prob")).otherwise(1 - F.col("prob")), F.when(F.col("target") == 1, 2.0).otherwise(1.0)
    a = S.losses(t, p, w, 2.0).select(F.lit(1).alias("k"), F.round("loss", 7).alias("focal"))
    return a.join(S.losses(t, p, w).select(F.lit(1).alias("k"), F.round("loss", 7).alias("cross_entropy")), "k").drop("k")


# Rankings


@query(V.sql("SELECT unit, tile, round(prob, 9) AS prob FROM tp ORDER BY tp.prob DESC, tile LIMIT 50", "tp"))
def top_tiles_global(spark, d):
    return S.top_rows(V.tile_predictions(spark, d), [F.desc("prob"), F.asc("tile")], 50).select("unit", "tile", _r("prob"))


@query(V.sql("SELECT unit, tile, rn AS rank FROM rk WHERE rn <= 3", "topk"))
def top_tiles_per_unit(spark, d):
    return S.top_per_group(V.tile_predictions(spark, d), ["unit"], [F.desc("prob"), F.asc("tile")], 3).select("unit", "tile", F.col("rank").cast("long").alias("rank"))


@query(V.sql("SELECT tile, round(CASE WHEN target = 1 THEN 1 - prob ELSE prob END, 9) AS difficulty FROM tp ORDER BY CASE WHEN target = 1 THEN 1 - prob ELSE prob END DESC, tile LIMIT 40", "tp"))
def hard_examples_binary(spark, d):
    t = V.tile_predictions(spark, d).withColumn("difficulty", F.when(F.col("target") == 1, 1 - F.col("prob")).otherwise(F.col("prob")))
    return S.top_rows(t, [F.desc("difficulty"), F.asc("tile")], 40).select("tile", _r("difficulty"))


@query(V.sql("SELECT tile, round(1 - [" + ", ".join(PROBS) + "][target], 7) AS difficulty FROM mp ORDER BY 1 - [" + ", ".join(PROBS) + "][target] DESC, tile LIMIT 40", "mp"))
def hard_examples_multiclass(spark, d):
    t = V.tile_probs(spark, d).withColumn("difficulty", 1 - F.element_at(F.array(*PROBS), F.col("target")))
    return S.top_rows(t, [F.desc("difficulty"), F.asc("tile")], 40).select("tile", _r("difficulty", 7))


# Regions


def _components(spark, d):
    return R.ranked(V.components(spark, d), [F.asc(c) for c in ("cx", "cy", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate")])


@query(V.sql("SELECT slide, component_rank, area, cx, cy FROM comp", "comp"))
def component_rank(spark, d):
    return _components(spark, d).select("slide", F.col("component_rank").cast("long").alias("component_rank"), "area", "cx", "cy")


def _grown(edges: str) -> str:
    """SQL of boxes grown by 5 % within a slide of 3000 x 2500 (many lie outside), from x0, y0, x1, y1."""
    return V.sql(f"SELECT unit, a AS bbox_x, b AS bbox_y, greatest(least(x1 + mx, 3000) - a, 1) AS bbox_w, greatest(least(y1 + my, 2500) - b, 1) AS bbox_h FROM (SELECT *, greatest(x0 - mx, 0) AS a, greatest(y0 - my, 0) AS b FROM (SELECT *, round_even((x1 - x0) * 0.05, 0)::BIGINT AS mx, round_even((y1 - y0) * 0.05, 0)::BIGINT AS my FROM (SELECT unit, {edges} FROM roi)))", "roi")


@query(_grown("bbox_x AS x0, bbox_y AS y0, bbox_x + bbox_w AS x1, bbox_y + bbox_h AS y1"))
def bbox_expand(spark, d):
    return R.expanded(V.rois(spark, d), 0.05, F.lit(3000).cast("long"), F.lit(2500).cast("long"))


@query(_grown("floor(bbox_x * 0.75::DOUBLE)::BIGINT AS x0, floor(bbox_y * 0.625::DOUBLE)::BIGINT AS y0, ceil((bbox_x + bbox_w) * 0.75::DOUBLE)::BIGINT AS x1, ceil((bbox_y + bbox_h) * 0.625::DOUBLE)::BIGINT AS y1"))
def bbox_expand_from_thumbnail(spark, d):
    return R.expanded_from_thumbnail(V.rois(spark, d), F.lit(0.75), F.lit(0.625), 0.05, F.lit(3000).cast("long"), F.lit(2500).cast("long"))


@query(V.sql("SELECT unit, round_even(bbox_x * (512 / 6000.0::DOUBLE), 0)::BIGINT AS thumb_x, round_even(bbox_y * (300 / 5000.0::DOUBLE), 0)::BIGINT AS thumb_y, greatest(round_even(bbox_w * (512 / 6000.0::DOUBLE), 0)::BIGINT, 1) AS thumb_w, greatest(round_even(bbox_h * (300 / 5000.0::DOUBLE), 0)::BIGINT, 1) AS thumb_h FROM roi", "roi"))
def bbox_on_thumbnail(spark, d):
    return R.on_thumbnail(V.rois(spark, d), F.lit(6000), F.lit(5000), F.lit(512), F.lit(300)).select("unit", "thumb_x", "thumb_y", "thumb_w", "thumb_h")


@query("SELECT p_partkey AS unit, round_even((p_partkey % 300) * 7.5, 0)::BIGINT AS bbox_x, greatest(round_even(p_size * 0.01 * 7.5, 0)::BIGINT, 1) AS bbox_w, round_even(p_partkey * 7.5 * 7.5, 0)::BIGINT AS area, (p_partkey * 7.5)::DOUBLE AS cx FROM part")
def component_scaling(spark, d):
    k = F.col("p_partkey")
    on_thumb = V.table(spark, d, "part").select(k.alias("unit"), (k % 300).alias("bbox_x"), F.lit(3).alias("bbox_y"), (F.col("p_size") * 0.01).alias("bbox_w"), F.lit(2).alias("bbox_h"), k.cast("double").alias("cx"), F.lit(1.0).alias("cy"), k.alias("area"))
    return R.scaled(on_thumb, F.lit(7.5)).select("unit", "bbox_x", "bbox_w", "area", _r("cx", 6))


@query(V.sql("SELECT slide, area, 'whole' AS section_label FROM comp WHERE component_rank = 1", "comp"))
def select_largest(spark, d):
    return R.selected(_components(spark, d), "keep_largest").select("slide", "area", "section_label")


@query(V.sql(", s AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY cx, component_rank) AS place FROM comp WHERE component_rank <= 3) SELECT slide, area, place, CASE place WHEN 1 THEN 'proximal' WHEN 2 THEN 'distal' ELSE 'section_' || place END AS section_label FROM s", "comp"))
def select_left_to_right(spark, d):
    out = R.selected(_components(spark, d), "keep_n_left_to_right", 3, labels=["proximal", "distal"])
    return out.select("slide", "area", F.col("place").cast("long").alias("place"), "section_label")


@query(V.sql(", s AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY cy DESC, cx, component_rank) AS bl, row_number() OVER (PARTITION BY slide ORDER BY cy, cx, component_rank) AS tl, row_number() OVER (PARTITION BY slide ORDER BY pow(cx - slide_w / 2, 2) + pow(cy - slide_h / 2, 2), component_rank) AS cm FROM comp WHERE component_rank <= 6) SELECT slide, 'bottom_left' AS rule, area, cx, cy FROM s WHERE bl = 1 UNION ALL SELECT slide, 'top_left', area, cx, cy FROM s WHERE tl = 1 UNION ALL SELECT slide, 'center_most', area, cx, cy FROM s WHERE cm = 1", "comp"))
def select_representative(spark, d):
    c = _components(spark, d)
    parts = [R.selected(c, "keep_representative", rule=rule).select("slide", F.lit(rule).alias("rule"), "area", "cx", "cy") for rule in ("bottom_left", "top_left", "center_most")]
    return parts[0].union(parts[1]).union(parts[2])


def _slides(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("slide"), F.when(F.col("o_orderkey") % 4 != 0, 3).alias("expected_sections"), (F.col("o_orderkey") % 5 != 0).alias("matched"))


_SLIDES = ", sl AS (SELECT o_orderkey AS slide, CASE WHEN o_orderkey % 4 <> 0 THEN 3 END AS expected_sections, o_orderkey % 5 <> 0 AS matched FROM orders), n AS (SELECT sl.*, coalesce(n, 0) AS found FROM sl LEFT JOIN (SELECT slide, count(*) AS n FROM comp GROUP BY slide) USING (slide))"


@query(V.sql(_SLIDES + " SELECT slide, 'expected_sections_mismatch' AS issue_code, 'expected_sections=3 but selected_outputs=' || found AS message FROM n WHERE expected_sections <> found", "comp"))
def section_mismatch(spark, d):
    return R.expected_mismatch(_slides(spark, d), V.components(spark, d))


@query(V.sql(_SLIDES + " SELECT slide, found, CASE WHEN found = 0 THEN 'no_valid_components' WHEN found < 3 THEN 'expected_3_major_components_found_' || found END AS warning, CASE WHEN found = 0 THEN 'fail_no_selected_roi' WHEN found < 3 THEN 'warn_expected_3_major_components_found_' || found ELSE 'ok' END AS qc_status FROM n", "comp"))
def selection_status(spark, d):
    return R.selection_status(_slides(spark, d), V.components(spark, d), "keep_bottom_left_among_major_components", 3)


@query(V.sql(_SLIDES + ", s AS (SELECT slide, area, row_number() OVER (PARTITION BY slide ORDER BY cx, component_rank) AS place FROM comp WHERE component_rank <= 2) SELECT sl.slide, l.place::INT AS place, section_label, area FROM sl CROSS JOIN (VALUES (1, 'proximal'), (2, 'distal'), (3, 'rectum')) l(place, section_label) LEFT JOIN s ON s.slide = sl.slide AND s.place = l.place", "comp"))
def labelled_sections(spark, d):
    chosen = R.selected(_components(spark, d), "keep_n_left_to_right", 2, labels=["proximal", "distal"])
    return R.labelled(_slides(spark, d), chosen, ["proximal", "distal", "rectum"]).select("slide", "place", "section_label", "area")


@query(V.sql(_SLIDES + ", b AS (SELECT slide, area, floor(cx)::BIGINT AS x, floor(cy)::BIGINT AS y, row_number() OVER (PARTITION BY slide ORDER BY area DESC, floor(cx), floor(cy)) AS rank FROM comp), s AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY x, rank) AS place, count(*) OVER (PARTITION BY slide) AS n FROM b WHERE rank <= 3) SELECT sl.slide, section_label, CASE WHEN matched THEN x END AS bbox_x, CASE WHEN matched THEN y END AS bbox_y, CASE WHEN NOT matched THEN 'unmatched_metadata' WHEN (SELECT max(n) FROM s WHERE s.slide = sl.slide) = 3 THEN 'ok' ELSE 'insufficient_components' END AS status FROM sl CROSS JOIN (VALUES (1, 'L'), (2, 'C'), (3, 'R')) l(place, section_label) LEFT JOIN s ON s.slide = sl.slide AND s.place = l.place", "comp"))
def three_sections(spark, d):
    boxes = V.components(spark, d).select("slide", "area", F.floor("cx").alias("bbox_x"), F.floor("cy").alias("bbox_y"), F.lit(10).alias("bbox_w"), F.lit(10).alias("bbox_h"))
    return R.three_sections(_slides(spark, d), boxes).select("slide", "section_label", "bbox_x", "bbox_y", "status")


@query(V.sql("SELECT unit, tile_x, tile_y FROM gr", "grid"))
def tile_grid_public(spark, d):
    return R.grid(V.rois(spark, d), 256, 128).select("unit", "tile_x", "tile_y")


@query(V.sql(", ay AS (SELECT *, unnest(list_distinct(list_append(generate_series(bbox_y, bbox_y + greatest(bbox_h - 256, 0), 128), bbox_y + greatest(bbox_h - 256, 0)))) AS tile_y FROM roi), ax AS (SELECT *, unnest(list_distinct(list_append(generate_series(bbox_x, bbox_x + greatest(bbox_w - 256, 0), 128), bbox_x + greatest(bbox_w - 256, 0)))) AS tile_x FROM ay) SELECT unit, tile_x, tile_y, least(256, bbox_x + bbox_w - tile_x) AS tile_w, least(256, bbox_y + bbox_h - tile_y) AS tile_h FROM ax", "roi"))
def tile_grid_aligned(spark, d):
    return R.grid(V.rois(spark, d), 256, 128, aligned=True).select("unit", "tile_x", "tile_y", "tile_w", "tile_h")


def _tiles(spark, d):
    return V.tissue(R.grid(V.rois(spark, d), 256, 128, by="unit"))


@query(V.sql(", p AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round, bin_y, bin_x) AS pick FROM b1) SELECT unit, tile_x, tile_y, pick FROM p WHERE pick <= 10", "bins"))
def spatial_bins(spark, d):
    return R.round_robin(R.bins(_tiles(spark, d), 256, 3), 10).select("unit", "tile_x", "tile_y", F.col("pick").cast("long").alias("pick"))


@query(V.sql(", p AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY tissue DESC, bin_y, bin_x) AS pick FROM b1 WHERE round = 1) SELECT unit, bin_x, bin_y, tile_x, tile_y, pick FROM p WHERE pick <= 5", "bins"))
def bin_seeds(spark, d):
    return R.seeds(R.bins(_tiles(spark, d), 256, 3), 5).select("unit", "bin_x", "bin_y", "tile_x", "tile_y", F.col("pick").cast("long").alias("pick"))


@query(V.sql(", p AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY tile_y, tile_x) AS pick FROM gr WHERE tissue >= 0.3) SELECT unit, tile_x, tile_y, pick FROM p WHERE pick <= 10", "grid"))
def scan_order_cap(spark, d):
    return R.scan_order(_tiles(spark, d).filter("tissue >= 0.3"), 10).select("unit", "tile_x", "tile_y", F.col("pick").cast("long").alias("pick"))


def _farthest(start: str, extra: str = "") -> str:
    """SQL of greedy picks: near is the squared distance to the picks so far, -1 for a pick; the seeds (seed > 0) go first."""
    return V.sql(f"""{extra}, n AS (SELECT *, count(*) OVER (PARTITION BY unit) AS n, row_number() OVER (PARTITION BY unit ORDER BY tile_y, tile_x) AS scan FROM c0),
        g AS (SELECT unit, tile_x, tile_y, tissue, px, py, n, 1e300::DOUBLE AS near, {start} AS seed, 0 AS pick, 1 AS step FROM n WHERE n > 8
          UNION ALL SELECT unit, tile_x, tile_y, tissue, px, py, n,
              CASE WHEN rn = 1 OR near < 0 THEN -1 ELSE least(near, (px - fx) * (px - fx) + (py - fy) * (py - fy)) END,
              seed, CASE WHEN rn = 1 THEN step ELSE 0 END, step + 1
          FROM (SELECT *, row_number() OVER w AS rn, first_value(px) OVER w AS fx, first_value(py) OVER w AS fy FROM g WHERE step <= 8
                WINDOW w AS (PARTITION BY unit ORDER BY seed <> step, near DESC, tissue DESC, tile_y, tile_x)))
        SELECT unit, tile_x, tile_y, pick::BIGINT AS pick FROM g WHERE pick > 0 UNION ALL SELECT unit, tile_x, tile_y, scan FROM n WHERE n <= 8""", "bins" if "bn" in extra else "grid").replace("WITH", "WITH RECURSIVE", 1)


@query(_farthest("CASE WHEN row_number() OVER (PARTITION BY unit ORDER BY tissue DESC, tile_y, tile_x) = 1 THEN 1 ELSE 0 END", ", c0 AS (SELECT unit, tile_x, tile_y, tissue, tile_x::DOUBLE AS px, tile_y::DOUBLE AS py FROM gr)"))
def farthest_pixels(spark, d):
    return R.spread(_tiles(ship(spark), d), 8, 256)


@query(_farthest("seed", ", s0 AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY tissue DESC, bin_y, bin_x) AS seed FROM b1 WHERE round = 1), c0 AS (SELECT bn.unit, bn.tile_x, bn.tile_y, bn.tissue, least(greatest((bn.tile_x + 128.0::DOUBLE - bn.bbox_x) / bn.bbox_w, 0.0), 1.0) AS px, least(greatest((bn.tile_y + 128.0::DOUBLE - bn.bbox_y) / bn.bbox_h, 0.0), 1.0) AS py, coalesce(s0.seed, 0) AS seed FROM bn LEFT JOIN s0 USING (unit, tile_x, tile_y))"))
def farthest_normalised(spark, d):
    return R.spread(_tiles(ship(spark), d), 8, 256, normalised=True, n_bins=3)


_OVERLAP = """, o AS (SELECT slide, component_rank, cx, floor(cx - area / 50)::BIGINT AS l, floor(cx - area / 50)::BIGINT + floor(area / 25)::BIGINT AS r, row_number() OVER (PARTITION BY slide ORDER BY cx, component_rank) AS i FROM comp),
    f AS (SELECT slide, i, l, r, cx, NULL::BIGINT AS before_r, false AS before_cut, false AS before_failed FROM o WHERE i = 1
      UNION ALL SELECT slide, i, CASE WHEN meets AND mid < r THEN mid ELSE l END, r, cx, CASE WHEN meets AND mid < r THEN mid ELSE last_r END, meets AND mid < r, meets AND mid >= r
      FROM (SELECT o.slide, o.i, o.l, o.r, o.cx, f.r AS last_r, f.r > o.l AS meets, greatest(f.l + 1, least(round_even((f.cx + o.cx) / 2, 0)::BIGINT, o.r - 1)) AS mid FROM f JOIN o ON o.slide = f.slide AND o.i = f.i + 1)),
    e AS (SELECT f.slide, f.i, f.l, coalesce(g.before_r, f.r) AS r, coalesce(g.before_failed, false) AS failed, coalesce(g.before_r > g.l, false) AS persisted, bool_or(f.before_cut) OVER (PARTITION BY f.slide) AS corrected FROM f LEFT JOIN f g ON g.slide = f.slide AND g.i = f.i + 1)
    SELECT e.slide, component_rank, o.cx, e.l AS bbox_x, e.r - e.l AS bbox_w, 90::BIGINT AS bbox_h, corrected, failed, persisted FROM e JOIN o USING (slide, i)"""


@query(V.sql(_OVERLAP, "comp").replace("WITH", "WITH RECURSIVE", 1))
def overlap_fix(spark, d):
    c = _components(spark, d).select("slide", F.col("component_rank").cast("long").alias("component_rank"), "cx", F.floor(F.col("cx") - F.col("area") / 50).alias("bbox_x"), F.floor("cy").alias("bbox_y"), F.floor(F.col("area") / 25).alias("bbox_w"), F.lit(90).cast("long").alias("bbox_h"))
    return R.without_overlap(c).drop("bbox_y")


# Splits, history, screening


@query(V.sql("SELECT DISTINCT unit, split FROM tm WHERE contains(tile_path, 'tiles/' || split)", "tm"))
def fixed_split_rows(spark, d):
    t = V.tile_manifest(spark, d)
    return t.filter(F.col("tile_path").contains(F.concat(F.lit("tiles/"), F.col("split")))).select("unit", "split").distinct()


_UNITS = ", un AS (SELECT unit, arg_min(target, tile) AS target FROM tp GROUP BY unit), rn AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ('0x' || substr(md5('7:' || unit), 1, 8))::BIGINT, unit) AS rn FROM un)"


@query(V.sql(_UNITS + ", c AS (SELECT target, count(*) AS n, floor(count(*) * 0.25) AS base, count(*) * 0.25 - floor(count(*) * 0.25) AS rest FROM un GROUP BY target), q AS (SELECT target, greatest(1, least(n - 1, base + (row_number() OVER (ORDER BY rest DESC, target) <= round(sum(n) OVER () * 0.25) - sum(base) OVER ())::INT)) AS quota FROM c) SELECT unit, rn.target, CASE WHEN rn <= quota THEN 'val' ELSE 'train' END AS split FROM rn JOIN q ON rn.target = q.target", "tp"))
def stratified_split(spark, d):
    return P.stratified(P.units(V.tile_predictions(spark, d), "unit", "target", "tile"), "unit", "target", 0.25, 7)


@query(V.sql(_UNITS + " SELECT unit, target, ((rn - 1) % 3)::INT AS fold FROM rn", "tp"))
def stratified_kfold(spark, d):
    return P.folds(P.units(V.tile_predictions(spark, d), "unit", "target", "tile"), "unit", "target", 3, 7)


@query(V.sql("SELECT (SELECT count(*) FROM (SELECT unit FROM tp GROUP BY unit HAVING count(DISTINCT split) > 1)) AS leaked_units, count(*) FILTER (split IS NULL) AS null_splits, count(*) FILTER (split NOT IN ('train', 'val')) AS unknown_splits, count(DISTINCT target) * count(DISTINCT split) - count(DISTINCT (target, split)) AS missing_cells FROM tp", "tp"))
def split_integrity(spark, d):
    return P.integrity(V.tile_predictions(spark, d), "unit", "target")


def _history(spark, d):
    e = V.table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 20).alias("run"), F.floor(F.col("event_id") / 500).cast("long").alias("epoch")).agg(F.round(F.max("value"), 6).alias("metric"))


@query(", ".join(["WITH h AS (SELECT user_id % 20 AS run, event_id // 500 AS epoch, round(max(value), 6) AS metric FROM events GROUP BY ALL)", "m AS (SELECT *, max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM h)", "b AS (SELECT *, max(CASE WHEN past IS NULL OR metric > past THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM m)"]) + " SELECT run, epoch, greatest(metric, coalesce(past, metric)) AS best, epoch - last AS waited, epoch - last >= 5 AS stop FROM b")
def early_stopping(spark, d):
    return P.early_stopping(_history(spark, d), "run", 5).select("run", "epoch", "best", "waited", "stop")


@query("""WITH RECURSIVE h AS (SELECT user_id % 20 AS run, event_id // 500 AS epoch, round(max(value), 6) AS metric FROM events GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i, count(*) OVER (PARTITION BY run) AS n FROM h),
    s AS (SELECT run, 1 AS i, n, 0.001::DOUBLE AS lr, metric AS best, 0 AS bad FROM k WHERE i = 1
      UNION ALL SELECT s.run, s.i + 1, s.n, CASE WHEN NOT (k.metric > best * 1.0001) AND bad + 1 > 2 THEN lr * 0.5 ELSE lr END, CASE WHEN k.metric > best * 1.0001 THEN k.metric ELSE best END,
        CASE WHEN k.metric > best * 1.0001 OR bad + 1 > 2 THEN 0 ELSE bad + 1 END FROM s JOIN k ON k.run = s.run AND k.i = s.i + 1)
    SELECT run, round(lr, 12) AS lr FROM s WHERE i = n""")
def plateau_lr(spark, d):
    return P.plateau(_history(spark, d), "run", 0.001, 0.5, 2).select("run", _r("lr", 12))


def _screen(spark, d):
    x = V.table(spark, d, "lineitem").join(V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).alias("value")) for n in ("l_quantity", "l_discount", "l_tax")]))
    return x.select((F.col("o_orderstatus") == "F").cast("int").alias("grp"), "l_quantity", v.alias("v")).select("grp", "l_quantity", "v.*")


_SCREEN = "WITH x AS (SELECT (o_orderstatus = 'F')::INT AS grp, l_quantity, l_discount, l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey), v AS (SELECT grp, l_quantity, 'l_quantity' AS variable, l_quantity AS value FROM x UNION ALL SELECT grp, l_quantity, 'l_discount', l_discount FROM x UNION ALL SELECT grp, l_quantity, 'l_tax', l_tax FROM x), r AS (SELECT *, rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS rk, rank() OVER (PARTITION BY variable ORDER BY l_quantity) + (count(*) OVER (PARTITION BY variable, l_quantity) - 1) / 2.0 AS rq FROM v), u AS (SELECT variable, count(*) FILTER (grp = 0) AS n0, count(*) FILTER (grp = 1) AS n1, sum(rk) FILTER (grp = 0) - (count(*) FILTER (grp = 0)) * ((count(*) FILTER (grp = 0)) + 1) / 2.0 AS u FROM r GROUP BY variable)"


@query(_SCREEN + " SELECT variable, n0, n1, u FROM u")
def screen_mannwhitney_u(spark, d):
    return P.rank_sum(_screen(spark, d)).select("variable", "n0", "n1", "u")


@query(_SCREEN + " SELECT variable, round(1 - 2 * u / (n0 * n1), 9) AS delta, CASE WHEN abs(1 - 2 * u / (n0 * n1)) < 0.147 THEN 'negligible' WHEN abs(1 - 2 * u / (n0 * n1)) < 0.33 THEN 'small' WHEN abs(1 - 2 * u / (n0 * n1)) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM u")
def screen_cliffs_delta(spark, d):
    return P.rank_sum(_screen(spark, d)).select("variable", _r("delta"), "magnitude")


@query(_SCREEN + " SELECT variable, round(corr(rk, rq), 8) AS rho FROM r GROUP BY variable")
def screen_spearman(spark, d):
    return P.spearman(_screen(spark, d), x="value", y="l_quantity").select("variable", _r("rho", 8))


def _simpson(table: str, keep: str, density: str, low: str, width: int, steps: int = 4000) -> str:
    """SQL of twice the area under a density from ``low`` on (``x`` in it), for each row of a table."""
    h = width / steps
    return f"SELECT {keep}, least(1.0, 2 * sum((CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density}) * {h} / 3) AS p FROM (SELECT *, {low} + i * {h} AS x FROM {table} CROSS JOIN range({steps + 1}) t(i)) GROUP BY ALL"


_TIES = ", tg AS (SELECT variable, sum(t * t * t - t) AS ties FROM (SELECT variable, value, count(*)::DOUBLE AS t FROM v GROUP BY ALL) GROUP BY variable), z AS (SELECT variable, n0, n1, u, (greatest(u, n0 * n1 - u) - n0 * n1 / 2.0 - 0.5) / sqrt(n0 * n1 / 12.0 * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1.0)))) AS z FROM u JOIN tg USING (variable)), pv AS (" + _simpson("z", "variable, n0, n1, u, z", "exp(-x * x / 2) / sqrt(2 * pi())", "z", 12) + ")"


@query(_SCREEN + _TIES + " SELECT variable, n0, n1, u, round(p, 9) AS p FROM pv")
def screen_mannwhitney_p(spark, d):
    return P.mann_whitney(_screen(ship(spark), d)).withColumn("p", F.round("p", 9))


_STUDENT = ", rh AS (SELECT variable, corr(rk, rq) AS rho, count(*) AS n FROM r GROUP BY variable), st AS (SELECT *, abs(rho) * sqrt((n - 2) / greatest((1 - rho) * (1 + rho), 1e-300)) AS s FROM rh), pv AS (" + _simpson("st", "variable, rho, n, s", "exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0) - (n - 1) / 2.0 * ln(1 + x * x / (n - 2))) / sqrt((n - 2) * pi())", "s", 40, 8000) + ")"


@query(_SCREEN + _STUDENT + " SELECT variable, n, round(rho, 8) AS rho, round(p, 8) AS p FROM pv")
def screen_spearman_p(spark, d):
    found = P.spearman_test(_screen(ship(spark), d), x="value", y="l_quantity")
    return found.select("variable", "n", _r("rho", 8), _r("p", 8))


_PVALS = "p AS (SELECT p_brand AS variable, round(min(p_retailprice) / 100000, 9) AS p FROM part GROUP BY p_brand)"
_FDR = f"WITH {_PVALS}, r AS (SELECT *, row_number() OVER (ORDER BY p, variable) AS k, count(*) OVER () AS n FROM p), f AS (SELECT variable, p, least(min(p * n / k) OVER (ORDER BY k DESC), 1.0) AS fdr FROM r)"


def _pvalues(spark, d):
    return V.table(spark, d, "part").groupBy(F.col("p_brand").alias("variable")).agg(F.round(F.min("p_retailprice") / 100000, 9).alias("p"))


@query(_FDR + " SELECT variable, round(fdr, 9) AS fdr, fdr < 0.05 AS reject FROM f")
def screen_bh_fdr(spark, d):
    return P.fdr(_pvalues(spark, d)).select("variable", _r("fdr"), (F.col("fdr") < 0.05).alias("reject"))


@query(_FDR + " SELECT variable, round(-log10(fdr) * p * 100, 8) AS priority FROM f")
def screen_priority(spark, d):
    return P.fdr(_pvalues(spark, d)).select("variable", F.round(-F.log10("fdr") * F.col("p") * 100, 8).alias("priority"))


# Columns, records and joins that manifests need before anything else


@query("SELECT c_custkey AS internal_sample_id, coalesce(NULL::VARCHAR, '-') AS parent_path, c_name AS parent_name FROM customer")
def alias_columns(spark, d):
    raw = V.table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_name").alias("parent_name"))
    named = M.renamed(raw, {"internal_sample_id": ["sample_id", "sampleid"], "parent_path": [], "parent_name": ["slide_name"]})
    return named.select("internal_sample_id", F.coalesce("parent_path", F.lit("-")).alias("parent_path"), "parent_name")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN 'val' END, 'inference') AS split, 'unknown_study' AS study FROM events")
def default_columns(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, "val").alias("split"))
    return M.with_default(M.with_default(e, "split", "inference"), "study", "unknown_study")


@query(V.sql("SELECT tile_path, unit AS analysis_unit_id, split, level, target FROM tm", "tm"))
def keep_columns(spark, d):
    t = V.tile_manifest(spark, d).withColumnRenamed("unit", "analysis_unit_id")
    return M.keep_list(t, ["tile_path", "analysis_unit_id", "split"], ["level", "split", "absent", "target", "level"])


@query(V.sql("SELECT unit, tile, tile % 3 AS study, 'build' AS source FROM tp", "tp"))
def record_merge(spark, d):
    t = V.tile_predictions(spark, d).select("unit", "tile", "study")
    return M.merged(t, {"study": F.col("tile") % 3, "source": F.lit("build")})


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY first) AS types FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def ordered_distinct(spark, d):
    firsts = V.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return firsts.groupBy("user_id").agg(F.array_join(M.in_order(F.col("event_type"), F.col("first")), ">").alias("types"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list(spark, d):
    return V.table(spark, d, "orders").filter(C.among(F.col("o_orderpriority"), ["1-urgent ", "2-High"])).select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def not_null_or_nan(spark, d):
    k = F.col("event_id")
    odd = F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 != 0, F.col("value"))
    return V.table(spark, d, "events").filter(C.present(odd)).select("event_id")


@query(V.sql("SELECT split, count(*) AS n FROM tm GROUP BY split", "tm"))
def all_rows_assertion(spark, d):
    t = M.check_all(V.tile_manifest(spark, d), F.col("tile_path").contains(F.concat(F.lit("/"), "split", F.lit("/"))), "a path doesn't name its split")
    return t.groupBy("split").agg(F.count("*").alias("n"))


_LISTED = "SELECT 'slides/' || s_name || '.svs' AS path FROM supplier WHERE s_suppkey % 3 <> 0"


def _wanted(spark, d):
    """Orders by the slide of a supplier, and the slides that exist."""
    named = lambda k: F.concat(F.lit("slides/Supplier#"), F.lpad(k.cast("string"), 9, "0"), F.lit(".svs"))
    rows = V.table(spark, d, "part").select("p_partkey", named(F.col("p_partkey") % 20 + 1).alias("slide"))
    return rows, V.table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.concat(F.lit("slides/"), "s_name", F.lit(".svs")).alias("path"))


@query(f"WITH f AS ({_LISTED}) SELECT p_partkey FROM part WHERE 'slides/Supplier#' || lpad((p_partkey % 20 + 1)::VARCHAR, 9, '0') || '.svs' IN (SELECT path FROM f)")
def existing_files(spark, d):
    rows, files = _wanted(spark, d)
    return M.with_files(rows, "slide", files).select("p_partkey")


@query(f"WITH f AS ({_LISTED}) SELECT path FROM f WHERE path NOT IN (SELECT 'slides/Supplier#' || lpad((p_partkey % 20 + 1)::VARCHAR, 9, '0') || '.svs' FROM part)")
def unused_files(spark, d):
    rows, files = _wanted(spark, d)
    return M.unused(files, rows, used="slide")


@query(V.sql("SELECT slide, component_rank, area FROM comp WHERE area >= 0.01 * slide_w * slide_h", "comp"))
def minimum_area(spark, d):
    share = F.lit(0.01) * F.col("slide_w") * F.col("slide_h")
    return M.large_enough(_components(spark, d), share).select("slide", F.col("component_rank").cast("long").alias("component_rank"), "area")


@query("SELECT o_orderkey, CASE WHEN c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'val' ELSE 'train' END END AS split FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def value_map(spark, d):
    k = F.col("c_custkey")
    table = V.table(spark, d, "customer").filter(k % 3 != 0).select(k.alias("o_custkey"), F.when(k % 4 == 0, "val").otherwise("train").alias("split"))
    return M.map_values(V.table(spark, d, "orders"), "o_custkey", table, "split").select("o_orderkey", "split")


@query("SELECT p_partkey, p_partkey % 5 > 1 AS ok, CASE p_partkey % 5 WHEN 0 THEN 'no result' WHEN 1 THEN 'open_error' END AS error FROM part")
def results_by_driver(spark, d):
    k = F.col("p_partkey")
    part = V.table(spark, d, "part").select("p_partkey")
    results = part.filter(k % 5 != 0).select("p_partkey", F.when(k % 5 == 1, False).alias("ok"), F.when(k % 5 == 1, "open_error").alias("error"))
    return M.by_driver(part, results, "p_partkey", ["p_partkey"])


@query(V.sql("SELECT unit, bbox_w >= 300 AND unit % 7 <> 0 AS ok, CASE WHEN bbox_w < 300 THEN 'invalid_roi' WHEN unit % 7 = 0 THEN 'not_evaluable' END AS error, CASE WHEN bbox_w >= 300 AND unit % 7 <> 0 THEN bbox_w * bbox_h END AS value FROM roi", "roi"))
def job_outcomes(spark, d):
    checks = [("invalid_roi", F.col("bbox_w") < 300), ("not_evaluable", F.col("unit") % 7 == 0)]
    return M.outcomes(V.rois(spark, d), F.col("bbox_w") * F.col("bbox_h"), checks).select("unit", "ok", "error", "value")


@query("SELECT n_nationkey AS id, n_name AS name, coalesce(n_regionkey, -1) AS region FROM nation UNION ALL SELECT r_regionkey, r_name, -1 FROM region")
def concatenated_frames(spark, d):
    a = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    b = V.table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return M.concatenated(a, b).select("id", "name", F.coalesce("region", F.lit(-1)).alias("region"))


@query(V.sql("SELECT unit AS analysis_unit_id, split, level AS read_level, tile_path FROM tm", "tm"))
def output_order(spark, d):
    t = V.tile_manifest(spark, d).select(F.col("unit").alias("analysis_unit_id"), "split", F.col("level").alias("read_level"), "tile_path")
    return M.output_order(t, M.TILE_ORDER)


@query("SELECT p_partkey AS analysis_unit_id, p_size::DOUBLE AS bbox_x, CASE WHEN p_partkey % 3 <> 0 THEN 1.5 END::DOUBLE AS bbox_w, CASE WHEN p_partkey % 2 = 0 THEN 1.0 END::DOUBLE AS is_evaluable FROM part")
def master_metadata(spark, d):
    k = F.col("p_partkey")
    raw = V.table(spark, d, "part").select(k.alias("analysis_unit_id"), F.col("p_size").cast("string").alias("bbox_x"), F.when(k % 3 != 0, " 1.5").otherwise("wide").alias("bbox_w"), F.when(k % 2 == 0, "1").alias("is_evaluable"))
    return M.master_metadata(raw, ["bbox_x", "bbox_w"])


# Scalar rules


@query(V.sql("SELECT tile, CASE WHEN tile % 3 = 0 THEN string_split(tile_path, '/')[-1] ELSE 'n' || tile END AS filename, lower(coalesce(CASE WHEN tile % 3 <> 1 THEN review_category END, '')) AS lowered FROM tm", "tm"))
def filled_names(spark, d):
    t, k = V.tile_manifest(spark, d), F.col("tile")
    given = F.when(k % 3 == 0, F.when(k % 2 == 0, " ")).otherwise(F.concat(F.lit("n"), k))
    return t.select("tile", C.named(given, F.col("tile_path")).alias("filename"), C.lowered(F.when(k % 3 != 1, F.col("review_category"))).alias("lowered"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '/raw/' || s_name WHEN 1 THEN '/slides/' || s_name || '.svs' END AS slide FROM supplier")
def slide_paths(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_name")
    path, name = F.when(k % 3 == 0, F.concat(F.lit("/raw/"), n)).otherwise(" "), F.when(k % 3 == 1, F.concat(n, F.lit(".svs")))
    return V.table(spark, d, "supplier").select("s_suppkey", C.slide_path(path, name, "/slides/").alias("slide"))


@query(V.sql("SELECT tile, target - 1 AS target_index FROM mp", "mp"))
def target_index(spark, d):
    return V.tile_probs(spark, d).select("tile", C.label_index(F.col("target"), CLASSES).alias("target_index"))


@query(V.sql("SELECT unit, 'au' || unit || '_distal' AS unit_id, 'au' || unit || '__slide_' || unit || '__x' || bbox_x || '_y' || bbox_y || '__l0.png' AS name FROM roi", "roi"))
def unit_names(spark, d):
    au = F.concat(F.lit("au"), "unit")
    return V.rois(spark, d).select("unit", C.unit_id(au, F.lit("distal")).alias("unit_id"), C.tile_name(au, F.concat(F.lit("slide "), "unit"), F.col("bbox_x"), F.col("bbox_y"), F.lit(0)).alias("name"))


@query("SELECT event_type, string_agg(printf('%.4f', v), ', ' ORDER BY i) AS numbers FROM (SELECT event_type, 1 AS i, count(*) / 3.0::DOUBLE AS v FROM events GROUP BY ALL UNION ALL SELECT event_type, 2, min(user_id) / 7.0::DOUBLE FROM events GROUP BY ALL) GROUP BY event_type")
def number_lists(spark, d):
    e = V.table(spark, d, "events").groupBy("event_type").agg((F.count("*") / 3.0).alias("a"), (F.min("user_id") / 7.0).alias("b"))
    return e.select("event_type", C.decimals(F.array("a", "b")).alias("numbers"))


@query("WITH h AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS now, CASE WHEN event_id % 3 <> 0 THEN 100.0 END AS best FROM events) SELECT event_id, now IS NOT NULL AND (best IS NULL OR now > best) AS better, now IS NOT NULL AND (best IS NULL OR now < best) AS lower FROM h")
def improved_metric(spark, d):
    k, nan = F.col("event_id"), F.lit(float("nan"))
    now, best = F.when(k % 5 == 0, nan).otherwise(F.col("value")), F.when(k % 3 == 0, F.when(k % 2 == 0, nan)).otherwise(100.0)
    return V.table(spark, d, "events").select("event_id", C.improved(now, best).alias("better"), C.improved(now, best, False).alias("lower"))


@query(V.sql("SELECT unit, greatest(round_even(greatest(ceil(256 / (1 + unit % 9 * 0.37::DOUBLE)), 1) * (1 + unit % 9 * 0.37::DOUBLE), 0)::BIGINT, 1) AS extent, round(least(512.0 / greatest(bbox_w, bbox_h), 1.0), 9) AS scale, greatest(round_even(bbox_w * (512.0 / greatest(bbox_w, bbox_h)), 0)::BIGINT, 1) AS thumb_w FROM roi", "roi"))
def level_and_thumbnail(spark, d):
    w, h = F.col("bbox_w"), F.col("bbox_h")
    scale = C.thumbnail_scale(w, h, 512)
    return V.rois(spark, d).select("unit", C.level_extent(256, 1 + F.col("unit") % 9 * 0.37).alias("extent"), F.round(scale, 9).alias("scale"), C.thumbnail_side(w, C.thumbnail_scale(w, h, 512, capped=False)).alias("thumb_w"))


_LINEAR = [[0.5, -1.0, 0.25], [-0.5, 0.75, 1.0], [0.1, 0.2, -0.3]]
_LOGITS = ", ".join(f"{b}::DOUBLE + " + " + ".join(f"embedding[{i}]::DOUBLE * {w}::DOUBLE" for i, w in enumerate(r, 1)) + f" AS z{j}" for j, (r, b) in enumerate(zip(_LINEAR, (0.1, -0.2, 0.0), strict=True)))


@query(f"WITH z AS (SELECT vec_id, {_LOGITS} FROM embeddings) SELECT vec_id, " + ", ".join(f"round(exp(z{j} - greatest(z0, z1, z2)) / (exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))), 7) AS p{j}" for j in range(3)) + " FROM z")
def linear_softmax(spark, d):
    x = [F.element_at("embedding", i).cast("double") for i in (1, 2, 3)]
    p = C.softmax(C.linear(x, _LINEAR, [0.1, -0.2, 0.0]))
    return V.table(spark, d, "embeddings").select("vec_id", *[F.round(v, 7).alias(f"p{j}") for j, v in enumerate(p)])


@query("SELECT vec_id, round(len(list_filter(embedding, lambda v: v < 0.05)) / len(embedding), 9) AS tissue_fraction FROM embeddings")
def tissue_share(spark, d):
    return V.table(spark, d, "embeddings").select("vec_id", F.round(C.share_below(F.col("embedding"), 0.05), 9).alias("tissue_fraction"))


# Splits and summaries


@query(V.sql("SELECT count(*) FILTER (split = 'train') AS train_tiles, count(*) FILTER (split = 'val') AS val_tiles, count(*) FILTER (split = 'train' AND NOT contains(tile_path, '/train/')) AS bad_train_paths, count(*) FILTER (split = 'val' AND NOT contains(tile_path, '/val/')) AS bad_val_paths, 2 - count(DISTINCT CASE WHEN split = 'train' THEN target END) AS missing_train_classes, 2 - count(DISTINCT CASE WHEN split = 'val' THEN target END) AS missing_val_classes, count(*) FILTER (target NOT IN (0, 1)) AS other_labels, count(DISTINCT CASE WHEN split = 'train' THEN unit END) AS train_units, count(DISTINCT CASE WHEN split = 'val' THEN unit END) AS val_units, (SELECT count(*) FROM (SELECT unit FROM tm GROUP BY unit HAVING count(DISTINCT split) > 1)) AS leaked_units FROM tm", "tm"))
def fixed_split_checks(spark, d):
    return P.fixed_split_checks(V.tile_manifest(spark, d), "unit", "target")


@query(V.sql(", un AS (SELECT unit, CASE WHEN unit = (SELECT min(unit) FROM tp) THEN 9 ELSE min(target) END AS target FROM tp GROUP BY unit), rn AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('7:' || unit), 1, 8))::BIGINT, unit) AS rn, count(*) OVER () AS n FROM un) SELECT unit, target, CASE WHEN rn <= greatest(1, round_even(n * 0.25, 0)) THEN 'val' ELSE 'train' END AS split FROM rn", "tp"))
def random_fallback_split(spark, d):
    u = V.tile_predictions(spark, d).groupBy("unit").agg(F.min("target").alias("target"))
    first = u.agg(F.min("unit").alias("m"))
    rare = u.join(first, F.col("unit") == F.col("m"), "left").select("unit", F.when(F.col("m").isNotNull(), 9).otherwise(F.col("target")).alias("target"))
    return P.stratified(rare, "unit", "target", 0.25, 7, fallback=True)


@query(V.sql(", un AS (SELECT unit % 2 AS task, unit, arg_min(split, tile) AS split, arg_min(target, tile) AS target FROM tp GROUP BY unit), cc AS (SELECT task, split, '{' || string_agg('\"' || target || '\":' || n, ',' ORDER BY target) || '}' AS j FROM (SELECT task, split, target, count(*) AS n FROM un GROUP BY ALL) GROUP BY ALL) SELECT 'task' || u.task AS task, l.v AS read_level, u.a AS n_analysis_units_total, u.t AS n_analysis_units_train, u.v AS n_analysis_units_val, coalesce(ct.j, '{}') AS class_counts_train, coalesce(cv.j, '{}') AS class_counts_val, (SELECT count(*) FROM tm WHERE unit % 2 = u.task AND level = l.v AND split = 'train') AS n_tiles_train, (SELECT count(*) FROM tm WHERE unit % 2 = u.task AND level = l.v AND split = 'val') AS n_tiles_val FROM (SELECT task, count(*) AS a, count(*) FILTER (split = 'train') AS t, count(*) FILTER (split = 'val') AS v FROM un GROUP BY task) u CROSS JOIN (VALUES (0), (1), (9)) l(v) LEFT JOIN cc ct ON ct.task = u.task AND ct.split = 'train' LEFT JOIN cc cv ON cv.task = u.task AND cv.split = 'val'", "tm"))
def dataset_summary(spark, d):
    t = V.tile_manifest(spark, d).withColumn("task", F.concat(F.lit("task"), F.col("unit") % 2))
    units = t.groupBy("task", "unit").agg(F.min_by("split", "tile").alias("split"), F.min_by("target", "tile").alias("target"))
    return S.task_summary(units, t.withColumnRenamed("level", "read_level"), [0, 1, 9])


@query("WITH v AS (SELECT (o_orderstatus = 'F')::INT AS grp, unnest(['l_quantity', 'l_discount', 'l_tax']) AS variable, unnest([l_quantity, l_discount, l_tax])::DOUBLE AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT variable, count(*) AS n_total, count(*) FILTER (grp = 0) AS n_0, count(*) FILTER (grp = 1) AS n_1, round(median(value) FILTER (grp = 0), 9) AS median_0, round(median(value) FILTER (grp = 1), 9) AS median_1, round(avg(value) FILTER (grp = 0), 7) AS mean_0, round(avg(value) FILTER (grp = 1), 7) AS mean_1, count(DISTINCT value) AS n_unique_scores FROM v GROUP BY variable")
def screen_summary(spark, d):
    found = P.group_summary(_screen(spark, d).withColumn("value", F.col("value").cast("double")))
    return found.select("variable", "n_total", "n_0", "n_1", _r("median_0"), _r("median_1"), _r("mean_0", 7), _r("mean_1", 7), "n_unique_scores")


@query("SELECT variable, string_agg(value || ':' || n, '; ' ORDER BY value) AS score_distribution FROM (SELECT p_brand AS variable, p_size % 5 + 1 AS value, count(*) AS n FROM part GROUP BY ALL) GROUP BY variable")
def score_distribution(spark, d):
    return P.score_text(V.table(spark, d, "part").select(F.col("p_brand").alias("variable"), (F.col("p_size") % 5 + 1).alias("value")))


_KIND = "SELECT p_brand AS variable, round({0}(p_retailprice), 6) AS priority_score FROM part GROUP BY p_brand"


@query(f"SELECT 'ordinal' AS variable_type, variable, priority_score FROM ({_KIND.format('max')}) UNION ALL SELECT 'quantitative', variable, priority_score FROM ({_KIND.format('min')})")
def screen_shortlist(spark, d):
    part = V.table(spark, d, "part").groupBy(F.col("p_brand").alias("variable"))
    tables = {kind: part.agg(F.round(f("p_retailprice"), 6).alias("priority_score")) for kind, f in (("ordinal", F.max), ("quantitative", F.min))}
    return P.shortlist(tables, ["variable", "priority_score"])


from . import raster_queries, source_queries, training_queries  # noqa: E402, F401  they register theirs

__all__ = ["ORACLES", "QUERIES"]
