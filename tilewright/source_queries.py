"""Queries that write a table and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import manifest as M
from .operators import regions as R
from .operators import scores as S
from .plans import settings
from .plans import views as V
from .plans.session import ship
from .plans.storage import shared_folder
from .registry import query
from .sources import manifests, tables


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name || CASE c_custkey % 3 WHEN 0 THEN ', \"a\"' WHEN 1 THEN '; b' ELSE '' END END AS c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal::DOUBLE AS c_acctbal, c_custkey % 2 = 0 AS even, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS c_mktsegment FROM customer")
def manifests_of_three_dialects(spark, d):
    c = V.table(ship(spark), d, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 5 != 0, F.concat("c_name", F.when(k % 3 == 0, ', "a"').when(k % 3 == 1, "; b").otherwise("")))
    rows = c.select("c_custkey", name.alias("c_name"), "c_nationkey", "c_acctbal", (k % 2 == 0).alias("even"), "c_mktsegment")
    root = f"{shared_folder(spark)}/manifests-{uuid.uuid4().hex}"
    for i, sep in enumerate(",;\t"):
        own = rows.filter(k % 3 == i)
        tables.write_csv(own if i == 1 else own.drop("c_mktsegment"), f"{root}/{i}", sep=sep)
    found = manifests.read_manifests(spark, root)
    return found.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "even", "c_mktsegment")


_TREE = ", t AS (SELECT unit, tile_x, tile_y, 'enteritis' AS task, CASE WHEN unit % 4 = 0 THEN 'val' ELSE 'train' END AS split, (unit % 3)::INT AS read_level FROM gr)"


@query(V.sql(_TREE + " SELECT unit, tile_x, tile_y, task, split, read_level, CASE WHEN split = 'val' AND read_level = 1 THEN 'second' ELSE 'first' END AS run FROM t WHERE NOT (split = 'val' AND read_level = 1 AND unit % 8 = 0)", "grid"))
def tile_tree(spark, d):
    """Written whole, then one split of one level again with fewer tiles, and read back."""
    k = F.col("unit")
    tiles = R.grid(V.rois(spark, d), 256, 128).select("unit", "tile_x", "tile_y", F.lit("enteritis").alias("task"), F.when(k % 4 == 0, "val").otherwise("train").alias("split"), (k % 3).cast("int").alias("read_level"), F.lit("first").alias("run"))
    root, keys = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}", ["task", "split", "read_level"]
    manifests.replace_parts(tiles, root, keys)
    again = tiles.filter("split = 'val' AND read_level = 1 AND unit % 8 <> 0").withColumn("run", F.lit("second"))
    manifests.replace_parts(again, root, keys)
    if manifests.parts(spark, root, keys).filter("NOT whole").head(1):
        raise ValueError("a part isn't what was committed")
    return manifests.read_parts(spark, root).select("unit", "tile_x", "tile_y", "task", "split", "read_level", "run")


_EXPORT = ", u AS (SELECT unit, arg_min(target, tile) AS target, count(*) AS n, " + ", ".join(f"avg(prob_class_{i}) AS p{i}" for i in range(1, 6)) + " FROM mp GROUP BY unit), b AS (SELECT *, greatest(p1, p2, p3, p4, p5) AS top FROM u)"


@query(V.sql(_EXPORT + " SELECT unit AS analysis_unit_id, 'all' AS study, target::BIGINT AS human_label, CASE top WHEN p1 THEN 1 WHEN p2 THEN 2 WHEN p3 THEN 3 WHEN p4 THEN 4 ELSE 5 END::BIGINT AS pred_label, round(top, 6) AS confidence, n AS tile_count, round(p1, 6) AS prob_class_1, round(p5, 6) AS prob_class_5 FROM b", "mp"))
def prediction_export(spark, d):
    """Unit predictions with the wanted columns first and a header as people write them, written as text and read back with types."""
    tiles = M.required(V.tile_probs(ship(spark), d), ["unit", "tile", "target"])
    units = S.unit_classes(tiles, M.probabilities(tiles))
    named = units.select(F.col("unit").alias(" Analysis Unit-ID "), M.first_column(units, ["study_id", "study"], "all").alias("Study"), F.col("target").alias("Human Label"), F.col("pred_label").alias("Pred.Label"), "tile_count", F.round("confidence", 6).alias("confidence"), *[F.round(p, 6).alias(p) for p in reversed(M.probabilities(units))])
    path = f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"
    tables.write_csv(M.columns_first(named, ["Study", "confidence"]), path)
    found = M.normal_names(tables.read_csv(spark, path, infer=True))
    return found.select("analysis_unit_id", "study", "human_label", "pred_label", F.col("confidence").cast("double").alias("confidence"), "tile_count", F.col("prob_class_1").cast("double").alias("prob_class_1"), F.col("prob_class_5").cast("double").alias("prob_class_5"))


@query("SELECT label AS label, 'class ' || label AS name, count(*) AS n, 0.25::DOUBLE AS val_share FROM embeddings GROUP BY label")
def run_configuration(spark, d):
    """A run's summary as JSON in its folder, found by listing, read as a configuration, checked, and joined with its counts."""
    counts = {str(r.label): r.n for r in V.table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a class
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    labels = sorted(map(int, counts))
    tables.write_json(spark, {"task": {"label_values": labels, "class_names": [f"class {x}" for x in labels]}, "counts": counts, "tiling": {"train_fraction": 0.75, "tile_size": 256, "stride": 128}}, f"{folder}/summary.JSON")
    path = tables.list_files(spark, folder, ".json").first().path
    config = tables.read_config(spark, path)
    tiling, (values, names) = settings.Tiling(**config["tiling"]), settings.class_labels(config["task"])
    rows = [(v, n, config["counts"][str(v)], 1 - tiling.train_fraction) for v, n in zip(values, names, strict=True)]
    return spark.createDataFrame(rows, "label int, name string, n long, val_share double")
