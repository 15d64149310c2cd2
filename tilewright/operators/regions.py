"""Boxes, component selection, tile grids and spatial sampling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .groups import numbered, tasks

BOX = ["bbox_x", "bbox_y", "bbox_w", "bbox_h"]


def scaled(df: DataFrame, scale: Column) -> DataFrame:
    """A component of a thumbnail in level-0 pixels: box and area rounded, halves to even, sides 1 at least; centroid as it is."""
    side = lambda c: F.greatest(C.half_even(F.col(c) * scale), F.lit(1).cast("long"))
    return df.withColumns({"bbox_x": C.half_even(F.col("bbox_x") * scale), "bbox_y": C.half_even(F.col("bbox_y") * scale), "bbox_w": side("bbox_w"), "bbox_h": side("bbox_h"), "cx": F.col("cx") * scale, "cy": F.col("cy") * scale, "area": C.half_even(F.col("area") * scale * scale)})


def _grown(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, ratio: float, width: Column, height: Column) -> DataFrame:
    """A box from its edges, grown by a share of its sides and cut to the slide; sides are 1 at least."""
    mx, my = C.half_even((x1 - x0) * ratio), C.half_even((y1 - y0) * ratio)
    left, top = F.greatest(x0 - mx, F.lit(0)), F.greatest(y0 - my, F.lit(0))
    one = F.lit(1).cast("long")
    return df.withColumns({"bbox_x": left, "bbox_y": top, "bbox_w": F.greatest(F.least(x1 + mx, width) - left, one), "bbox_h": F.greatest(F.least(y1 + my, height) - top, one)})


def expanded(df: DataFrame, ratio: float, width: Column, height: Column) -> DataFrame:
    """The box grown by a share of its sides at each side, halves to even, within the slide."""
    x, y, w, h = (F.col(c) for c in BOX)
    return _grown(df, x, y, x + w, y + h, ratio, width, height)


def expanded_from_thumbnail(df: DataFrame, scale_x: Column, scale_y: Column, ratio: float, width: Column, height: Column) -> DataFrame:
    """The older rule: a thumbnail's box in level-0 pixels, edges outwards to whole ones, then grown."""
    x, y, w, h = (F.col(c) for c in BOX)
    return _grown(df, F.floor(x * scale_x), F.floor(y * scale_y), F.ceil((x + w) * scale_x), F.ceil((y + h) * scale_y), ratio, width, height)


def on_thumbnail(df: DataFrame, width: Column, height: Column, thumb_w: Column, thumb_h: Column) -> DataFrame:
    """thumb_x, thumb_y, thumb_w, thumb_h: a level-0 box on a thumbnail of a slide; sides are 1 at least."""
    sx, sy, one = thumb_w / width.cast("double"), thumb_h / height.cast("double"), F.lit(1).cast("long")
    x, y, w, h = (F.col(c) for c in BOX)
    return df.withColumns({"thumb_x": C.half_even(x * sx), "thumb_y": C.half_even(y * sy), "thumb_w": F.greatest(C.half_even(w * sx), one), "thumb_h": F.greatest(C.half_even(h * sy), one)})


def ranked(components: DataFrame, by: list[Column]) -> DataFrame:
    """component_rank (from 1): by area, largest first, then by the tie keys."""
    return components.withColumn("component_rank", F.row_number().over(W.partitionBy("slide").orderBy(F.desc("area"), *by)))


#: The rules' names. Orders of the representative among the largest components.
RULES: dict[str, Callable[[], list[Column]]] = {
    "bottom_left": lambda: [F.desc("cy"), F.asc("cx")],
    "top_left": lambda: [F.asc("cy"), F.asc("cx")],
    "center_most": lambda: [F.asc(F.pow(F.col("cx") - F.col("slide_w") / 2, F.lit(2)) + F.pow(F.col("cy") - F.col("slide_h") / 2, F.lit(2)))],
    "largest": lambda: [F.asc("component_rank")],
}


#: Fixed value: the largest components that a representative is chosen from.
POOL = 6


def selected(components: DataFrame, mode: str, n: int | None = None, rule: str = "bottom_left", labels: list[str] | None = None) -> DataFrame:
    """The components kept of each slide, with place (from 1) and section_label. Needs component_rank, cx, cy.

    Without ``n``, as many components as labels (one at least) are kept from
    left to right, and a representative comes from the ``POOL`` largest ones.
    """
    if n is None:
        n = POOL if mode == "keep_representative" else max(1, len(labels or []))
    if mode == "keep_largest":
        pool, order = components.filter("component_rank = 1"), [F.asc("component_rank")]
    elif mode == "keep_n_left_to_right":
        pool, order = components.filter(F.col("component_rank") <= n), [F.asc("cx"), F.asc("component_rank")]
    elif mode == "keep_representative":
        if rule not in RULES:
            raise ValueError(f"unknown rule {rule}")
        pool, order = components.filter(F.col("component_rank") <= n), [*RULES[rule](), F.asc("component_rank")]
    else:
        raise ValueError(f"unknown selection mode {mode}")
    out = pool.withColumn("place", F.row_number().over(W.partitionBy("slide").orderBy(*order)))
    if mode == "keep_representative":
        out = out.filter("place = 1")
    if not labels:
        alone = F.count("*").over(W.partitionBy("slide")) == 1
        return out.withColumn("section_label", F.when(alone, F.lit("whole")).otherwise(F.concat(F.lit("section_"), F.col("place"))))
    names = F.array(*map(F.lit, labels))
    named = F.when(F.col("place") <= len(labels), F.element_at(names, F.least(F.col("place"), F.lit(len(labels)))))
    return out.withColumn("section_label", F.coalesce(named, F.concat(F.lit("section_"), F.col("place"))))


def selection_status(slides: DataFrame, components: DataFrame, mode: str, n: int) -> DataFrame:
    """slide, found, warning, qc_status of every slide by the older rules: ok, warn_... on too few components, fail_no_selected_roi on none."""
    per = components.groupBy("slide").agg(F.count("*").alias("found"))
    out = slides.select("slide").join(per, "slide", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    word = {"keep_n_left_to_right": "_components_found_", "keep_bottom_left_among_major_components": "_major_components_found_", "keep_largest": None}
    if mode not in word:
        raise ValueError(f"unknown selection mode {mode}")
    few = F.lit(None).cast("string") if word[mode] is None else F.when(F.col("found") < n, F.concat(F.lit(f"expected_{n}{word[mode]}"), F.col("found")))
    out = out.withColumn("warning", F.when(F.col("found") == 0, "no_valid_components").otherwise(few))
    return out.withColumn("qc_status", F.when(F.col("found") == 0, "fail_no_selected_roi").when(F.col("warning").isNotNull(), F.concat(F.lit("warn_"), F.col("warning"))).otherwise("ok"))


def labelled(slides: DataFrame, chosen: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each slide and label, in the order of the labels: the chosen component of that place, null boxes where there is none.

    Slides without any component have placeholder rows only.
    """
    names = slides.select("slide").withColumn("at", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(x).alias("section_label")) for i, x in enumerate(labels, 1)]))).select("slide", "at.*")
    return names.join(chosen.drop("section_label"), ["slide", "place"], "left")


#: The three sections' labels, by their place from the left.
SECTIONS = ["L", "C", "R"]


def three_sections(slides: DataFrame, boxes: DataFrame) -> DataFrame:
    """The oldest rule: the three largest boxes of a slide by their left edge, a row for each of the labels; status tells whether there were three.

    Slides whose column ``matched`` is false have rows of the status unmatched_metadata.
    """
    big = F.row_number().over(W.partitionBy("slide").orderBy(F.desc("area"), *BOX))
    kept = boxes.withColumn("rank", big).filter("rank <= 3").withColumn("place", F.row_number().over(W.partitionBy("slide").orderBy("bbox_x", "rank")))
    count = kept.groupBy("slide").agg(F.count("*").alias("n"))
    out = labelled(slides, kept.select("slide", "place", *BOX), SECTIONS).join(slides.select("slide", "matched"), "slide").join(count, "slide", "left")
    status = F.when(~F.col("matched"), "unmatched_metadata").when(F.col("n") == 3, "ok").otherwise("insufficient_components")
    boxes_of = {c: F.when(F.col("matched"), F.col(c)) for c in BOX}
    return out.withColumns(boxes_of | {"status": status}).drop("matched", "n")


def expected_mismatch(slides: DataFrame, found: DataFrame) -> DataFrame:
    """slide, issue_code, message where a slide's expected_sections (null: any number) isn't the number of its rows in ``found``."""
    per = found.groupBy("slide").agg(F.count("*").alias("n"))
    both = slides.select("slide", "expected_sections").join(per, "slide", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = both.filter(F.col("expected_sections") != F.col("n"))
    return wrong.select("slide", F.lit("expected_sections_mismatch").alias("issue_code"), F.concat(F.lit("expected_sections="), F.col("expected_sections"), F.lit(" but selected_outputs="), F.col("n")).alias("message"))


def _steps(start: Column, span: Column, size: int, stride: int, aligned: bool) -> Column:
    last = start + F.greatest(span - size, F.lit(0))
    steps = F.sequence(start, last, F.lit(stride).cast("long"))
    return F.array_distinct(F.concat(steps, F.array(last))) if aligned else steps


def grid(rois: DataFrame, size: int, stride: int, aligned: bool = False, by: str | None = None) -> DataFrame:
    """tile_x, tile_y (and clipped tile_w, tile_h): rows first; if aligned, a last tile flush with the far edge.

    A small table of boxes makes a large one of tiles: the tiles are counted
    first, and the boxes are dealt to as many tasks as these ask for, by the
    column ``by`` where it is given; what groups tiles by it then moves none.
    """
    x, y, w, h = (F.col(c).cast("long") for c in BOX)
    across, down = _steps(x, w, size, stride, aligned), _steps(y, h, size, stride, aligned)
    n = rois.agg(F.sum(F.size(across).cast("long") * F.size(down))).first()[0] or 0
    boxes = rois.repartition(tasks(rois.sparkSession, n), *([by] if by else []))
    out = boxes.withColumn("tile_y", F.explode(down)).withColumn("tile_x", F.explode(across))
    if aligned:
        out = out.withColumns({"tile_w": F.least(F.lit(size), x + w - F.col("tile_x")), "tile_h": F.least(F.lit(size), y + h - F.col("tile_y"))})
    return out


def bins(tiles: DataFrame, size: int, n: int) -> DataFrame:
    """bin_x, bin_y of the tiles' centres in an n x n raster of the box; clipped sides (tile_w, tile_h) count where they are given."""
    x, y = relative(tiles, size)
    bin_of = lambda rel: F.least(F.floor(F.least(F.greatest(rel, F.lit(0.0)), F.lit(0.999999)) * n), F.lit(n - 1)).cast("int")
    return tiles.withColumns({"bin_x": bin_of(x), "bin_y": bin_of(y)})


def relative(tiles: DataFrame, size: int) -> tuple[Column, Column]:
    """The places of the tiles' centres in their box, as shares of its sides."""
    side = lambda c: F.col(c) / 2 if c in tiles.columns else F.lit(size / 2)
    share = lambda t, s, b, w: F.when(F.col(w) > 0, (F.col(t) + side(s) - F.col(b)) / F.col(w)).otherwise(0.0)
    return share("tile_x", "tile_w", "bbox_x", "bbox_w"), share("tile_y", "tile_h", "bbox_y", "bbox_h")


def round_robin(tiles: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` tiles of a unit, a round over the bins at a time, the best tissue of a bin first."""
    inner = F.row_number().over(W.partitionBy("unit", "bin_y", "bin_x").orderBy(F.desc("tissue"), "tile_y", "tile_x"))
    outer = F.row_number().over(W.partitionBy("unit").orderBy("round", "bin_y", "bin_x"))
    return tiles.withColumn("round", inner).withColumn("pick", outer).filter(F.col("pick") <= most)


def seeds(tiles: DataFrame, most: int) -> DataFrame:
    """The best tile of each bin, ordered by tissue, then bin: up to ``most``."""
    return _seeded(tiles).filter((F.col("round") == 1) & (F.col("pick") <= most))


def _seeded(tiles: DataFrame) -> DataFrame:
    """All tiles with ``round`` (1: the best of its bin) and, for those, ``pick``: the place among the best by tissue, then bin."""
    inner = F.row_number().over(W.partitionBy("unit", "bin_y", "bin_x").orderBy(F.desc("tissue"), "tile_y", "tile_x"))
    outer = F.row_number().over(W.partitionBy("unit").orderBy(F.col("round") > 1, F.desc("tissue"), "bin_y", "bin_x"))
    return tiles.withColumn("round", inner).withColumn("pick", outer)


def scan_order(tiles: DataFrame, most: int) -> DataFrame:
    return tiles.withColumn("pick", F.row_number().over(W.partitionBy("unit").orderBy("tile_y", "tile_x"))).filter(F.col("pick") <= most)


def farthest(points: np.ndarray, tissue: np.ndarray, most: int, first: list[int]) -> list[int]:
    """Greedy picks: the point farthest from all picks, ties by tissue, then by order. Squared distances, which order alike."""
    picks, near = [], np.full(len(points), np.inf)
    while len(picks) < min(most, len(points)):
        if len(picks) < len(first):
            i = first[len(picks)]
        else:
            best = np.flatnonzero(near == near.max())
            i = int(best[tissue[best].argmax()])
        picks.append(i)
        near = np.minimum(near, ((points - points[i]) ** 2).sum(axis=1))
        near[picks] = -1
    return picks


def spread(tiles: DataFrame, most: int, size: int, normalised: bool = False, n_bins: int = 4) -> DataFrame:
    """unit, tile_x, tile_y, pick: farthest-point picks of each unit, from the tile with most tissue (or, normalised, from all bins' seeds).

    A unit with at most ``most`` tiles keeps them in scan order. Tiles are sorted
    by unit once; a task goes through its units one after the other, and holds
    one unit's tiles, which its grid bounds.
    """
    if normalised:
        x, y = relative(tiles, size)
        clamp = lambda rel: F.least(F.greatest(rel, F.lit(0.0)), F.lit(1.0))
        seed = F.when((F.col("round") == 1) & (F.col("pick") <= most), F.col("pick"))
        rows = _seeded(bins(tiles, size, n_bins)).withColumns({"px": clamp(x), "py": clamp(y), "seed": seed})
    else:
        rows = tiles.withColumns({"px": F.col("tile_x").cast("double"), "py": F.col("tile_y").cast("double"), "seed": F.lit(None).cast("int")})
    rows = rows.select("unit", "tile_x", "tile_y", "tissue", "px", "py", F.coalesce("seed", F.lit(0)).alias("seed"))
    kind = T.StructType([rows.schema["unit"], *[T.StructField(c, T.LongType()) for c in ("tile_x", "tile_y", "pick")]])

    def picks(held: pa.Table) -> pa.Table:
        n, tissue = held.num_rows, held["tissue"].to_numpy()
        if n <= most:
            order = np.arange(n)
        else:
            seed = held["seed"].to_numpy()
            first = np.flatnonzero(seed)[np.argsort(seed[seed > 0])].tolist() if normalised else [int(tissue.argmax())]
            order = np.array(farthest(np.column_stack([held["px"].to_numpy(), held["py"].to_numpy()]), tissue, most, first))
        return held.select(["unit", "tile_x", "tile_y"]).take(order).append_column("pick", pa.array(np.arange(1, len(order) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            b = b.select(b.schema.names[:-1])
            unit = b.column(0)
            ends = [] if not b.num_rows else [0, *(np.flatnonzero(pc.not_equal(unit[1:], unit[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
            out = []
            for i, j in zip(ends, ends[1:], strict=False):
                if held and held[0].column(0)[0] != unit[i]:
                    out.append(picks(pa.Table.from_batches(held)))
                    held = []
                held.append(b.slice(i, j - i))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
        if held:
            yield from picks(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return numbered(rows.filter("unit IS NOT NULL"), ["unit"], ["tile_y", "tile_x"]).mapInArrow(run, kind)


def without_overlap(boxes: DataFrame) -> DataFrame:
    """Neighbours (left to right) whose boxes overlap in x are cut at the middle of their centroids, one pair after the other.

    The cut is kept inside the pair's outer edges, and both boxes get it as their
    border, which may also widen one. ``failed`` marks a box whose cut with the
    next would leave no width, ``persisted`` one that still overlaps the next
    afterwards, ``corrected`` the slides in which any pair was cut. Each cut
    changes the box that the next comparison reads, so a slide's boxes (a handful
    of sections) are folded in order.
    """
    end = F.col("bbox_x") + F.col("bbox_w")
    box = F.struct("cx", "component_rank", F.col("bbox_x").alias("l"), end.alias("r"), F.col("bbox_y").alias("t"), F.col("bbox_h").alias("h"), F.lit(False).alias("failed"), F.lit(False).alias("cut"))
    ordered = boxes.groupBy("slide").agg(F.sort_array(F.collect_list(box)).alias("g"))
    fields = ordered.schema["g"].dataType.elementType.fields
    kind = T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in fields]))

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        at = F.greatest(last["l"] + 1, F.least(F.rint((last["cx"] + x["cx"]) / 2).cast("long"), x["r"] - 1))
        cut = F.array(last.withField("r", at).withField("cut", F.lit(True)), x.withField("l", at))
        pair = F.when(last["r"] <= x["l"], F.array(last, x)).when(at < x["r"], cut).otherwise(F.array(last.withField("failed", F.lit(True)), x))
        rest = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(F.size(done) == 0, F.array(x)).otherwise(F.concat(rest, pair)).cast(kind)

    fixed = ordered.select("slide", F.aggregate("g", F.array().cast(kind), step).alias("g"))
    following = F.try_element_at("g", F.col("i") + 2)
    x = F.col("x")
    out = fixed.select("slide", "g", F.posexplode("g").alias("i", "x"), F.exists("g", lambda b: b["cut"]).alias("corrected"))
    return out.select("slide", x["component_rank"].alias("component_rank"), x["cx"].alias("cx"), x["l"].alias("bbox_x"), x["t"].alias("bbox_y"), (x["r"] - x["l"]).alias("bbox_w"), x["h"].alias("bbox_h"), "corrected", x["failed"].alias("failed"), F.coalesce(x["r"] > following["l"], F.lit(False)).alias("persisted"))
