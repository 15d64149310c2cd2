"""Queries over training and over jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import fanout, training
from .plans import views as V
from .plans.session import ship
from .registry import query

RATE, DECAY, EPOCHS = 0.05, 0.01, 3


def _epochs(train: str) -> str:
    """SQL of the scorer's epochs: w0 to w3 have class, feature, weight and the optimiser's moments; q0 to q3 the probabilities of all rows."""
    out = """WITH x AS (SELECT vec_id, label % 3 AS t, unnest([1, 2, 3, 4, 5]) AS f, unnest([embedding[1], embedding[2], embedding[3], embedding[4], 1.0]::DOUBLE[]) AS x FROM embeddings),
        w0 AS (SELECT k, f, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM range(3) a(k) CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS f))"""
    for e in range(EPOCHS + 1):
        out += f""", z{e} AS (SELECT vec_id, t, k, sum(w * x) AS z FROM x JOIN w{e} USING (f) GROUP BY ALL),
        y{e} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS y FROM z{e}),
        q{e} AS (SELECT vec_id, t, k, y / sum(y) OVER (PARTITION BY vec_id) AS p FROM y{e})"""
        if e < EPOCHS:
            n = e + 1
            out += f""", g{e} AS (SELECT q.k, x.f, sum((p - (q.t = q.k)::INT) * x) / count(*) AS g FROM q{e} q JOIN x USING (vec_id) WHERE {train} GROUP BY ALL),
            u{e} AS (SELECT k, f, w * (1 - {RATE} * {DECAY}) AS w, 0.9 * m + 0.1 * g AS m, 0.999 * v + 0.001 * g * g AS v FROM w{e} JOIN g{e} USING (k, f)),
            w{n} AS (SELECT k, f, w - {RATE} / (1 - pow(0.9, {n})) * m / (sqrt(v) / sqrt(1 - pow(0.999, {n})) + 1e-8) AS w, m, v FROM u{e})"""
    return out


def _trained(spark, d, val):
    rows = V.table(ship(spark), d, "embeddings").withColumn("t", F.col("label") % 3)
    x = F.slice(F.col("embedding").cast("array<double>"), 1, 4)
    settings = training.Settings(classes=3, epochs=EPOCHS, rate=RATE, weight_decay=DECAY)
    if not val:
        return training.train(rows, None, "vec_id", x, F.col("t"), settings)
    return training.train(rows.filter("vec_id % 5 <> 0"), rows.filter("vec_id % 5 = 0"), "vec_id", x, F.col("t"), settings)


@query(_epochs("true") + f" SELECT k AS class, f AS feature, round(w, 7) AS weight FROM w{EPOCHS}")
def softmax_training(spark, d):
    s = _trained(spark, d, False)
    rows = [(k, f + 1, float(w)) for k, own in enumerate(s.weights) for f, w in enumerate(own)]
    return spark.createDataFrame(rows, "class long, feature int, weight double").withColumn("weight", F.round("weight", 7))


@query(_epochs("vec_id % 5 <> 0") + " " + " UNION ALL ".join(f"""SELECT {e + 1}::BIGINT AS epoch,
    round((SELECT avg(-ln(p)) FROM q{e} WHERE k = t AND vec_id % 5 <> 0), 7) AS train_loss,
    round((SELECT avg(-ln(p)) FROM q{e + 1} WHERE k = t AND vec_id % 5 = 0), 7) AS val_loss,
    round((SELECT avg((best = t)::INT) FROM (SELECT t, arg_max(k, p) AS best FROM q{e + 1} WHERE vec_id % 5 = 0 GROUP BY vec_id, t)), 7) AS val_accuracy""" for e in range(EPOCHS)))
def training_history(spark, d):
    found = training.history(spark, _trained(spark, d, True))
    return found.select("epoch", *[F.round(c, 7).alias(c) for c in ("train_loss", "val_loss", "val_accuracy")])


def _survey(row: dict) -> dict:
    """A job: how many tiles a region holds, and how much of it they leave out; regions that are too small or not square enough fail."""
    w, h = row["bbox_w"], row["bbox_h"]
    if w < 256 or h < 256:
        raise ValueError(f"region {row['unit']} is {w} x {h}")
    if w > 5 * h:
        raise ArithmeticError("too wide")
    across, down = (w - 256) // 128 + 1, (h - 256) // 128 + 1
    return {"tiles": across * down, "left_out": w * h - ((across - 1) * 128 + 256) * ((down - 1) * 128 + 256)}


_JOBS = """, j AS (SELECT *, CASE WHEN bbox_w < 256 OR bbox_h < 256 THEN 'ValueError' WHEN bbox_w > 5 * bbox_h THEN 'ArithmeticError' END AS error_type, (bbox_w - 256) // 128 + 1 AS a, (bbox_h - 256) // 128 + 1 AS b FROM roi)
    SELECT unit, error_type IS NULL AS ok, CASE WHEN error_type IS NULL OR error_type = 'ArithmeticError' THEN 1 ELSE 2 END AS attempts, error_type,
        CASE error_type WHEN 'ValueError' THEN 'ValueError(''region ' || unit || ' is ' || bbox_w || ' x ' || bbox_h || ''')' WHEN 'ArithmeticError' THEN 'ArithmeticError(''too wide'')' END AS error,
        CASE WHEN error_type IS NULL THEN a * b END AS tiles,
        CASE WHEN error_type IS NULL THEN bbox_w * bbox_h - ((a - 1) * 128 + 256) * ((b - 1) * 128 + 256) END AS left_out FROM j"""


@query(V.sql(_JOBS, "roi"))
def jobs_with_errors(spark, d):
    regions = V.rois(ship(spark), d)
    done = fanout.run_jobs(regions, _survey, "tiles long, left_out long", tries=2, retry_on=(ValueError,))
    ordered = fanout.in_driving_order(done, regions.select("unit"), "unit", "unit")
    return ordered.select("unit", "ok", "attempts", "error_type", "error", "result.tiles", "result.left_out")
