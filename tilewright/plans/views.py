"""Domain views over the star-schema tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tile_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    return e.select(u.alias("unit"), F.col("event_id").alias("tile"), F.least(F.col("value") / 300, F.lit(1.0)).alias("prob"), (u % 3).alias("study"), F.when(u % 4 == 0, "val").otherwise("train").alias("split"), F.when(u % 5 == 0, 1).otherwise(0).alias("target"), "event_type")


def tile_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tile_predictions(spark, sf_dir)
    return t.withColumns({
        "review_category": F.when(F.col("event_type") == "error", F.when(F.col("tile") % 3 == 0, "\tExclude\n").otherwise(" Exclude")).when(F.col("event_type") == "signup", F.when(F.col("tile") % 3 == 0, "\xa0SUSPECT\u2003").otherwise("SUSPECT ")).otherwise("pass"),
        "task_label": F.when(F.col("tile") % 17 != 0, F.col("target")),
        "level": (F.col("tile") % 7).cast("int"),
        "tile_path": F.concat(F.when(F.col("tile") % 2 == 0, "/data/").otherwise(""), F.lit("tiles/"), "split", F.lit("/"), F.col("event_type"), F.lit("/t"), F.col("tile"), F.lit(".PNG")),
    })


def tile_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    p = C.softmax([F.element_at("embedding", i).cast("double") for i in range(1, 6)])
    base = e.select((F.col("label") * 10 + F.col("vec_id") % 10).cast("long").alias("unit"), F.col("vec_id").alias("tile"), (F.col("label") % 5 + 1).cast("int").alias("target"), *[x.alias(f"prob_class_{i}") for i, x in enumerate(p, 1)])
    return base


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("slide"), F.col("l_extendedprice").alias("area"), F.col("l_partkey").cast("double").alias("cx"), F.col("l_suppkey").cast("double").alias("cy"), F.lit(2000.0).alias("slide_w"), F.lit(100.0).alias("slide_h"), "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate")


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("unit"), (k * 37 % 5000).alias("bbox_x"), (k * 91 % 4000).alias("bbox_y"), (F.col("p_size").cast("long") * 40 + 50).alias("bbox_w"), (k % 20 * 70 + 90).alias("bbox_h"))


def tissue(df: DataFrame) -> DataFrame:
    """A pseudo tissue fraction from the MD5 of a tile's place."""
    return df.withColumn("tissue", F.conv(F.substring(F.md5(F.concat_ws("_", "unit", "tile_x", "tile_y")), 1, 8), 16, 10).cast("double") / 4294967296.0)


#: The same views in SQL.
SQL = {
    "tp": "tp AS (SELECT user_id AS unit, event_id AS tile, least(value / 300, 1.0) AS prob, user_id % 3 AS study, CASE WHEN user_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS target, event_type FROM events)",
    "tm": "tm AS (SELECT *, CASE event_type WHEN 'error' THEN CASE WHEN tile % 3 = 0 THEN chr(9) || 'Exclude' || chr(10) ELSE ' Exclude' END WHEN 'signup' THEN CASE WHEN tile % 3 = 0 THEN chr(160) || 'SUSPECT' || chr(8195) ELSE 'SUSPECT ' END ELSE 'pass' END AS review_category, CASE WHEN tile % 17 <> 0 THEN target END AS task_label, (tile % 7)::INT AS level, (CASE WHEN tile % 2 = 0 THEN '/data/' ELSE '' END) || 'tiles/' || split || '/' || event_type || '/t' || tile || '.PNG' AS tile_path FROM tp)",
    "mp": "mx AS (SELECT *, greatest(embedding[1], embedding[2], embedding[3], embedding[4], embedding[5])::DOUBLE AS m FROM embeddings), me AS (SELECT (label * 10 + vec_id % 10)::BIGINT AS unit, vec_id AS tile, (label % 5 + 1)::INT AS target, " + ", ".join(f"exp(embedding[{i}]::DOUBLE - m) AS e{i}" for i in range(1, 6)) + " FROM mx), mp AS (SELECT unit, tile, target, " + ", ".join(f"e{i} / (e1 + e2 + e3 + e4 + e5) AS prob_class_{i}" for i in range(1, 6)) + " FROM me)",
    "comp": "comp AS (SELECT l_orderkey AS slide, l_extendedprice AS area, l_partkey::DOUBLE AS cx, l_suppkey::DOUBLE AS cy, 2000.0 AS slide_w, 100.0 AS slide_h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_shipdate) AS component_rank FROM lineitem)",
    "roi": "roi AS (SELECT p_partkey AS unit, p_partkey * 37 % 5000 AS bbox_x, p_partkey * 91 % 4000 AS bbox_y, p_size::BIGINT * 40 + 50 AS bbox_w, p_partkey % 20 * 70 + 90 AS bbox_h FROM part)",
    "grid": "gy AS (SELECT *, unnest(generate_series(bbox_y, bbox_y + greatest(bbox_h - 256, 0), 128)) AS tile_y FROM roi), g0 AS (SELECT *, unnest(generate_series(bbox_x, bbox_x + greatest(bbox_w - 256, 0), 128)) AS tile_x FROM gy), gr AS (SELECT *, ('0x' || substr(md5(unit || '_' || tile_x || '_' || tile_y), 1, 8))::BIGINT / 4294967296.0 AS tissue FROM g0)",
    "bins": "bn AS (SELECT *, least(floor(least(greatest((tile_x + 128.0 - bbox_x) / bbox_w, 0.0), 0.999999) * 3), 2)::INT AS bin_x, least(floor(least(greatest((tile_y + 128.0 - bbox_y) / bbox_h, 0.0), 0.999999) * 3), 2)::INT AS bin_y FROM gr), b1 AS (SELECT *, row_number() OVER (PARTITION BY unit, bin_y, bin_x ORDER BY tissue DESC, tile_y, tile_x) AS round FROM bn)",
    "topk": "rk AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY prob DESC, tile) AS rn FROM tp), us AS (SELECT unit, arg_min(study, tile) AS study, arg_min(split, tile) AS split, arg_min(target, tile) AS target, count(*) AS tile_count, avg(prob) FILTER (rn <= 10) AS score, avg(prob) AS mean_score, avg((prob >= 0.5)::INT) AS prop FROM rk GROUP BY unit)",
}


def stripped(text: str) -> str:
    """SQL of a text without white space at its ends."""
    return f"trim({text}, {' || '.join(f'chr({ord(c)})' for c in C.WHITE)})"


def sql(body: str, *views: str) -> str:
    needs = {"tm": ["tp"], "topk": ["tp"], "grid": ["roi"], "bins": ["roi", "grid"]}
    order = [v for v in SQL if any(v == x or v in needs.get(x, []) for x in views)]
    return "WITH " + ", ".join(SQL[v] for v in order) + " " + body
