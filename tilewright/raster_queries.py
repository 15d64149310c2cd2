"""Queries over rasters: a slide a region of ``part``, a cell a tile of its grid, the grey value from the tile's tissue share."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import colours
from .operators import rasters as K
from .operators import regions as R
from .plans import views as V
from .plans.session import ship
from .registry import query


def _cells(spark, d):
    """slide, x, y, grey, saturation, brightness; every 41st grey value is missing."""
    t = V.tissue(R.grid(V.rois(ship(spark), d), 256, 128, by="unit"))
    at = lambda c: ((F.col(f"tile_{c}") - F.col(f"bbox_{c}")) / 128).cast("long").alias(c)
    code = F.floor(F.col("tissue") * 4294967296.0)
    grey = F.when(code % 41 != 0, F.floor(F.col("tissue") * 256)).alias("grey")
    return t.select(F.col("unit").alias("slide"), at("x"), at("y"), grey, (code % 97 % 40).alias("saturation"), (code % 89 + 180).alias("brightness"))


_RASTER = ", rc AS (SELECT unit AS slide, (tile_x - bbox_x) // 128 AS x, (tile_y - bbox_y) // 128 AS y, floor(tissue * 4294967296.0)::BIGINT AS code, floor(tissue * 256)::BIGINT AS g FROM gr), ras AS (SELECT slide, x, y, CASE WHEN code % 41 <> 0 THEN g END AS grey, code % 97 % 40 AS saturation, code % 89 + 180 AS brightness FROM rc)"
_OTSU = """, oh AS (SELECT slide, grey AS v, count(*) AS n FROM ras WHERE grey IS NOT NULL GROUP BY ALL),
    ob AS (SELECT *, sum(n) OVER w AS n0, sum(v * n) OVER w AS s0, sum(n) OVER (PARTITION BY slide) AS total, sum(v * n) OVER (PARTITION BY slide) AS mass FROM oh WINDOW w AS (PARTITION BY slide ORDER BY v)),
    ov AS (SELECT *, CASE WHEN n0 < total THEN (n0 / total) * ((total - n0) / total) * (s0 / n0 - (mass - s0) / (total - n0)) * (s0 / n0 - (mass - s0) / (total - n0)) END AS between_ FROM ob),
    otsu AS (SELECT slide, coalesce(arg_max(v, {'b': between_, 'v': -v}) FILTER (between_ > 0 AND least(n0, total - n0) >= total * 1.1920929e-07), 0)::BIGINT AS threshold FROM ov GROUP BY slide)"""


def _sql(body: str) -> str:
    return V.sql(_RASTER + body, "grid").replace("WITH", "WITH RECURSIVE", 1)


def _pass(name: str, source: str, kernel: K.Kernel, what: str) -> str:
    """SQL of a minimum or maximum over the kernel's places."""
    places = ", ".join(f"({dx}, {dy})" for dy, a, b in kernel.rows for dx in range(a, b + 1))
    return f", {name} AS (SELECT m.slide, m.x, m.y, {what}(n.cell) AS cell FROM {source} m CROSS JOIN (VALUES {places}) k(dx, dy) JOIN {source} n ON n.slide = m.slide AND n.x = m.x + dx AND n.y = m.y + dy GROUP BY ALL)"


def _morph(name: str, source: str, steps: list[tuple[str, K.Kernel]]) -> str:
    passes = [(p, k) for step, k in steps for p in K.PASSES[step]]
    names = [source, *(f"{name}{i}" for i in range(len(passes) - 1)), name]
    return "".join(_pass(names[i + 1], names[i], k, "max" if p == "dilate" else "min") for i, (p, k) in enumerate(passes))


def _labels(name: str, where: str, reach: int) -> str:
    """SQL of the runs of cells that fulfil ``where`` (a table and a condition): name_r, with labels: name_l, and components: name_c."""
    return f""", {name}_i AS (SELECT slide, x, y, x - row_number() OVER (PARTITION BY slide, y ORDER BY x) AS i FROM {where}),
    {name}_r AS (SELECT slide, y, min(x) AS x0, max(x) AS x1 FROM {name}_i GROUP BY slide, y, i),
    {name}_t AS (SELECT a.slide, a.y AS ay, a.x0 AS ax, b.y AS by_, b.x0 AS bx FROM {name}_r a JOIN {name}_r b ON a.slide = b.slide AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + {reach} AND b.x0 <= a.x1 + {reach}),
    {name}_f(slide, y, x0, label) AS (SELECT slide, y, x0, y * 2147483648 + x0 FROM {name}_r UNION SELECT f.slide, by_, bx, label FROM {name}_f f JOIN {name}_t t ON t.slide = f.slide AND ay = f.y AND ax = f.x0),
    {name}_l AS (SELECT r.slide, r.y, r.x0, r.x1, min(label)::BIGINT AS label FROM {name}_r r JOIN {name}_f f USING (slide, y, x0) GROUP BY ALL),
    {name}_c AS (SELECT slide, label, min(x0) AS bbox_x, min(y) AS bbox_y, max(x1) - min(x0) + 1 AS bbox_w, max(y) - min(y) + 1 AS bbox_h, sum((x0 + x1) * (x1 - x0 + 1)) / (2.0 * sum(x1 - x0 + 1)) AS cx, 1.0 * sum(y * (x1 - x0 + 1)) / sum(x1 - x0 + 1) AS cy, sum(x1 - x0 + 1)::BIGINT AS area FROM {name}_l GROUP BY slide, label)"""


_DARK = ", dark AS (SELECT slide, x, y, coalesce(grey < 128, false) AS cell FROM ras)"
_BOXES = "slide, label, bbox_x, bbox_y, bbox_w, bbox_h, round(cx, 9) AS cx, round(cy, 9) AS cy, area"


def _dark(spark, d):
    return _cells(spark, d).withColumn("on", F.col("grey") < 128)


def _boxes(found, *more):
    return found.select("slide", "label", "bbox_x", "bbox_y", "bbox_w", "bbox_h", F.round("cx", 9).alias("cx"), F.round("cy", 9).alias("cy"), "area", *more)


@query(_sql(_OTSU + " SELECT slide, threshold FROM otsu"))
def otsu_threshold(spark, d):
    return K.otsu(_cells(spark, d))


@query(_sql(_DARK + _morph("mask", "dark", [("close", K.rectangle(3)), ("open", K.rectangle(3))]) + " SELECT slide, x, y, cell AS on_ FROM mask"))
def mask_closed_opened(spark, d):
    steps = [("close", K.rectangle(3)), ("open", K.rectangle(3))]
    return K.morphed(_dark(spark, d), steps, block=6).withColumnRenamed("on", "on_")


@query(_sql(_DARK + _morph("mask", "dark", [("erode", K.rectangle(2)), ("dilate", K.ellipse(5))]) + " SELECT slide, x, y, cell AS on_ FROM mask"))
def mask_uneven_kernels(spark, d):
    return K.morphed(_dark(spark, d), [("erode", K.rectangle(2)), ("dilate", K.ellipse(5))], block=4).withColumnRenamed("on", "on_")


@query(_sql(_DARK + _labels("a", "dark WHERE cell", 1) + _labels("b", "dark WHERE cell", 0) + f" SELECT 8 AS connectivity, {_BOXES} FROM a_c UNION ALL SELECT 4, {_BOXES} FROM b_c"))
def mask_components(spark, d):
    found = K.mask_components(_dark(spark, d), (8, 4), block=3)
    return _boxes(found, "connectivity")


@query(_sql(_DARK + _morph("mask", "dark", [("close", K.rectangle(2)), ("open", K.rectangle(2))]) + _labels("a", "mask WHERE cell", 1) + """,
    s AS (SELECT slide, label, greatest(round_even(bbox_w * 128.0::DOUBLE, 0)::BIGINT, 1) AS bbox_w, round_even(area * 16384.0::DOUBLE, 0)::BIGINT AS area, cx * 128 AS cx FROM a_c WHERE area >= 3),
    q AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY area DESC, label) AS component_rank FROM s),
    p AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY cx, component_rank) AS place FROM q WHERE component_rank <= 2)
    SELECT slide, label, bbox_w, area, component_rank, place, CASE place WHEN 1 THEN 'proximal' ELSE 'distal' END AS section_label FROM p"""))
def sections_from_mask(spark, d):
    steps = [("close", K.rectangle(2)), ("open", K.rectangle(2))]
    boxes = R.scaled(K.mask_components(_dark(spark, d), least=3, steps=steps), F.lit(128.0))
    out = R.selected(R.ranked(boxes, [F.asc("label")]), "keep_n_left_to_right", 2, labels=["proximal", "distal"])
    return out.select("slide", "label", "bbox_w", "area", F.col("component_rank").cast("long").alias("component_rank"), F.col("place").cast("long").alias("place"), "section_label")


@query(_sql(_DARK + _labels("a", "dark WHERE cell", 0) + " SELECT slide, y, x0, x1 FROM a_l JOIN a_c USING (slide, label) WHERE area > 2"))
def mask_without_small(spark, d):
    return K.mask_without_small(_dark(spark, d), 2)


#: The cells that become on where holes are filled, then all runs of the mask.
_FILLED = """, e AS (SELECT slide, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS b FROM dark GROUP BY slide),
    small AS (SELECT h_l.* FROM h_l JOIN h_c USING (slide, label) JOIN e USING (slide) WHERE {where}),
    full_ AS (SELECT slide, x, y FROM dark WHERE cell UNION SELECT slide, unnest(generate_series(x0, x1)), y FROM small),
    fi AS (SELECT slide, x, y, x - row_number() OVER (PARTITION BY slide, y ORDER BY x) AS i FROM full_)
    SELECT slide, y, min(x) AS x0, max(x) AS x1 FROM fi GROUP BY slide, y, i"""


@query(_sql(_DARK + _labels("h", "dark WHERE NOT cell", 0) + _FILLED.format(where="area <= 3")))
def mask_filled(spark, d):
    return K.filled(_dark(spark, d), 3)


@query(_sql(_DARK + _labels("h", "dark WHERE NOT cell", 0) + _FILLED.format(where="bbox_x > l AND bbox_y > t AND bbox_x + bbox_w <= r AND bbox_y + bbox_h <= b")))
def mask_enclosed_holes(spark, d):
    return K.filled(_dark(spark, d), enclosed=True)


@query(_sql(_OTSU + ", m0 AS (SELECT slide, x, y, coalesce(grey <= threshold, false) OR (saturation > 18 AND brightness < 245) AS cell FROM ras JOIN otsu USING (slide))"
    + _labels("s", "m0 WHERE cell", 0)
    + ", sm AS (SELECT slide, y, unnest(generate_series(x0, x1)) AS x FROM s_l JOIN s_c USING (slide, label) WHERE area <= 16), m1 AS (SELECT slide, x, y, cell AND (slide, x, y) NOT IN (SELECT slide, x, y FROM sm) AS cell FROM m0)"
    + _labels("h", "m1 WHERE NOT cell", 0)
    + ", hm AS (SELECT slide, y, unnest(generate_series(x0, x1)) AS x FROM h_l JOIN h_c USING (slide, label) WHERE area <= 64), m2 AS (SELECT slide, x, y, cell OR (slide, x, y) IN (SELECT slide, x, y FROM hm) AS cell FROM m1)"
    + _morph("mask", "m2", [("open", K.ellipse(3)), ("close", K.ellipse(3))]) + " SELECT slide, x, y, cell AS on_ FROM mask"))
def tissue_mask_by_otsu(spark, d):
    return K.tissue_mask_by_otsu(_cells(spark, d), least=30, kernel=3).withColumnRenamed("on", "on_")


def _pixels(spark, d):
    """Arrays of red, green and blue from the vectors, three components a pixel; each vector's brightness differs."""
    level = lambda i: F.least(F.greatest(F.floor(F.element_at("embedding", i).cast("double") * 40 + 228 + F.col("vec_id") % 25), F.lit(0)), F.lit(255)).cast("int")
    pixel = lambda k: F.struct(level(3 * k + 1).alias("r"), level(3 * k + 2).alias("g"), level(3 * k + 3).alias("b"))
    return V.table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(20)), pixel).alias("pixels"))


_LEVEL = "least(greatest(floor(embedding[{0}]::DOUBLE * 40 + 228 + vec_id % 25), 0), 255)::INT"
_PIXELS = f"""WITH px AS (SELECT vec_id, {_LEVEL.format('3 * k + 1')} AS r, {_LEVEL.format('3 * k + 2')} AS g, {_LEVEL.format('3 * k + 3')} AS b FROM embeddings CROSS JOIN range(21) t(k)),
    cv AS (SELECT *, (9798 * r + 19235 * g + 3735 * b + 16384) >> 15 AS grey, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS spread FROM px),
    sv AS (SELECT *, (r + g + b) / 3.0 AS mean, CASE WHEN v = 0 THEN 0 ELSE (spread * round_even(1044480 / v::DOUBLE, 0)::BIGINT + 2048) >> 12 END AS s FROM cv)
    SELECT vec_id, avg((mean < 220)::INT) AS mean_grey, avg((grey < 235 OR (s > 20 AND v < 250))::INT) AS colour, avg((mean < 235 OR spread > 12)::INT) AS spread FROM sv GROUP BY vec_id"""


@query(_PIXELS)
def tissue_fractions(spark, d):
    p = F.col("pixels")
    return _pixels(spark, d).select("vec_id", *[colours.tissue_fraction(p, how).alias(how) for how in colours.FRACTIONS])


@query(f"SELECT vec_id, sum(grey)::BIGINT AS grey, sum(s)::BIGINT AS saturation, max(v) AS brightness FROM ({_PIXELS.split('SELECT vec_id, avg')[0]} SELECT * FROM sv) GROUP BY vec_id")
def pixel_channels(spark, d):
    p = F.col("pixels")
    total = lambda f: F.aggregate(F.transform(p, f), F.lit(0).cast("long"), lambda a, x: a + x)
    return _pixels(spark, d).select("vec_id", total(colours.grey).alias("grey"), total(colours.saturation).alias("saturation"), F.array_max(F.transform(p, colours.brightness)).alias("brightness"))

