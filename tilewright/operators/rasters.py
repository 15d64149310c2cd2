"""Masks over rasters: thresholds, opening and closing, small parts, connected components.

A raster is a table of cells: slide, x, y (whole numbers from 0), each place once,
and a value. A mask has a column ``on``. Runs are the mask's stretches of a
raster row: slide, y, x0, x1 (both ends inside); they are what components are
found from, so the work follows the outlines and not the areas. Everything larger than a
block of a raster is worked on in blocks: the sliding minima and maxima with a rim
of neighbouring cells, the labelling with a merge of labels along the borders. Where
all rasters of a table are small, their labels are found whole in one pass over the cells.

Places that the table doesn't have lie outside the raster: they count for
neither side of a minimum or maximum, and nothing is connected through them. A
null value is off; rows with a null slide or place take no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.storage import written
from .groups import dealt, in_groups, starts, tasks, typed

#: The side of a block.
BLOCK = 512
#: A block has as many times its rim a side, at least: smaller ones would hold more cells of the rim than of their own.
RIMS = 16
#: If all rasters of a table have fewer places than this each way, what labels decide is found for whole rasters; else over bands.
WHOLE = 1024
#: Fixed value: classes with a lesser share of the cells are no class of a threshold.
LEAST_SHARE = 1.1920929e-07
PACK = 1 << 31


# Thresholds


def otsu(cells: DataFrame, value: str = "grey") -> DataFrame:
    """slide, threshold: the value that cuts a slide's cells (up to it, and above) with the largest variance between the two sides.

    From a histogram a slide and its running sums. Of equal cuts the least one
    counts; a slide of one value has the threshold 0; null values don't count.
    """
    bins = cells.filter(F.col("slide").isNotNull() & F.col(value).isNotNull()).groupBy("slide", F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    upto, whole = W.partitionBy("slide").orderBy("v").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("slide")
    mass = F.col("v") * F.col("n")
    s = bins.withColumns({"n0": F.sum("n").over(upto), "s0": F.sum(mass).over(upto), "total": F.sum("n").over(whole), "mass": F.sum(mass).over(whole)})
    n1 = F.col("total") - F.col("n0")
    apart = F.col("s0") / F.col("n0") - F.try_divide(F.col("mass") - F.col("s0"), n1)
    between = (F.col("n0") / F.col("total")) * (n1 / F.col("total")) * apart * apart
    fits = F.least(F.col("n0"), n1) >= F.col("total") * LEAST_SHARE
    best = F.max_by("v", F.when(fits & (between > 0), F.struct(between.alias("b"), -F.col("v"))))
    return s.groupBy("slide").agg(F.coalesce(best, F.lit(0).cast("long")).alias("threshold"))


def below_otsu(cells: DataFrame, value: str = "grey") -> DataFrame:
    """``on``: the cells up to their slide's threshold."""
    return cells.join(otsu(cells, value), "slide").withColumn("on", F.coalesce(F.col(value) <= F.col("threshold"), F.lit(False))).drop("threshold")


# Opening and closing


@dataclass(frozen=True)
class Kernel:
    """Rows of a structuring element: (dy, first dx, last dx)."""

    rows: tuple[tuple[int, int, int], ...]
    rectangular: bool

    @property
    def reach(self) -> int:
        return max(max(abs(dy), abs(a), abs(b)) for dy, a, b in self.rows)


def rectangle(side: int) -> Kernel:
    """A square; of an even side, the larger half comes first."""
    a = side // 2
    return Kernel(tuple((dy, -a, side - 1 - a) for dy in range(-a, side - a)), True)


def ellipse(side: int) -> Kernel:
    """A disc in a square; widths are rounded, halves to even."""
    r = side // 2
    wide = lambda dy: round(r * ((r * r - dy * dy) / max(1, r * r)) ** 0.5)
    return Kernel(tuple((dy, -wide(dy), wide(dy)) for dy in range(-r, r + 1)), False)


def _along(hits: np.ndarray, first: int, last: int) -> np.ndarray:
    """Whether a row has a hit from ``first`` to ``last`` places on, by running counts."""
    w = hits.shape[1]
    counts = np.zeros((hits.shape[0], w + 1), np.int32)
    np.cumsum(hits, axis=1, out=counts[:, 1:])
    x = np.arange(w)
    return counts[:, np.clip(x + last + 1, 0, w)] > counts[:, np.clip(x + first, 0, w)]


def _swept(hits: np.ndarray, kernel: Kernel) -> np.ndarray:
    """Whether the kernel around each place has a hit; a rectangle goes along the rows, then along the columns."""
    if kernel.rectangular:
        _, a, b = kernel.rows[0]
        return _along(_along(hits, a, b).T, kernel.rows[0][0], kernel.rows[-1][0]).T
    out, h = np.zeros_like(hits), hits.shape[0]
    for dy, a, b in kernel.rows:
        row = _along(hits, a, b)
        lo, hi = max(0, -dy), min(h, h - dy)
        if lo < hi:
            out[lo:hi] |= row[lo + dy : hi + dy]
    return out


def _blurred(mask: np.ndarray) -> np.ndarray:
    """Binomial weights of five places each way, mirrored at the raster's edge; on where they make half."""
    inside = mask >= 0
    rows, cols = np.flatnonzero(inside.any(axis=1)), np.flatnonzero(inside.any(axis=0))
    box = np.s_[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
    part = np.maximum(mask[box], 0).astype(np.int32)
    for axis in (0, 1):
        wide = np.take(part, _mirrored(part.shape[axis]), axis=axis)
        n = part.shape[axis]
        part = sum(k * np.take(wide, np.arange(i, i + n), axis=axis) for i, k in enumerate((1, 4, 6, 4, 1)))
    out = mask.copy()
    out[box] = np.where(inside[box], part >= 128, -1)
    return out


def _mirrored(n: int) -> np.ndarray:
    """Places -2 to n + 1 of an axis of n, mirrored at its first and last place."""
    at = np.abs(np.arange(-2, n + 2)) % max(1, 2 * (n - 1))
    return np.where(at > n - 1, 2 * (n - 1) - at, at)


#: The steps that a mask goes through, and the passes of each.
PASSES = {"erode": ("erode",), "dilate": ("dilate",), "open": ("erode", "dilate"), "close": ("dilate", "erode"), "blur": ("blur",)}


#: Places of a sheet on which small blocks are worked on together.
SHEET = 1 << 21


def _sheets(wide: np.ndarray, high: np.ndarray, live: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """The sheet of each block (-1: not live) and its first row there: blocks of like widths lie one below the other, up to ``SHEET`` places; with ``alone`` each has a sheet."""
    sheet, top = np.full(len(wide), -1), np.zeros(len(wide), np.int64)
    if alone:
        sheet[live] = np.arange(live.sum())
        return sheet, top
    step = np.ceil(np.log2(np.maximum(wide, 8))).astype(np.int64)
    order = np.flatnonzero(live)[np.argsort(step[live], kind="stable")]
    above = np.cumsum(high[order]) - high[order]
    full = np.cumsum(high[order] << step[order]) // SHEET
    fresh = np.r_[True, (np.diff(step[order]) != 0) | (np.diff(full) != 0)][: len(order)]
    sheet[order] = np.cumsum(fresh) - 1
    top[order] = above - above[fresh][sheet[order]] if len(order) else 0
    return sheet, top


def _passed(x: np.ndarray, y: np.ndarray, on: np.ndarray, passes: list[tuple[str, Kernel | None]]) -> np.ndarray:
    """The cells of a sheet behind all passes; places without a cell are outside and stay so."""
    mask = np.full((y.max() + 1, x.max() + 1), -1, np.int8)
    mask[y, x] = on
    outside = mask < 0
    for name, kernel in passes:
        if name == "blur":
            mask = _blurred(mask)
        else:
            mask = (_swept(mask == 1, kernel) if name == "dilate" else ~_swept(mask == 0, kernel)).astype(np.int8)
            mask[outside] = -1
    return mask[y, x] == 1


def _passes(steps: list[tuple[str, Kernel | None]]) -> list[tuple[str, Kernel | None]]:
    if unknown := {name for name, _ in steps} - set(PASSES):
        raise ValueError(f"unknown step {', '.join(sorted(unknown))}")
    return [(p, kernel) for name, kernel in steps for p in PASSES[name]]


def _worked(first: np.ndarray, x: np.ndarray, y: np.ndarray, on: np.ndarray, live: np.ndarray, passes: list[tuple[str, Kernel | None]]) -> np.ndarray:
    """``on`` behind all passes, in the ``live`` ones of the blocks that begin at the rows ``first``; many small blocks at once."""
    gap, alone = max([kernel.reach for _, kernel in passes if kernel is not None], default=0), any(kernel is None for _, kernel in passes)
    x0, y0, out = np.minimum.reduceat(x, first), np.minimum.reduceat(y, first), on.copy()
    wide, high = np.maximum.reduceat(x, first) - x0 + 1, np.maximum.reduceat(y, first) - y0 + 1
    sheet, top = _sheets(wide, high + gap, live, alone)
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
    px, py, of = x - x0[group], y - y0[group] + top[group], sheet[group]
    by_sheet = np.argsort(of, kind="stable")
    for at in np.split(by_sheet, np.flatnonzero(np.diff(of[by_sheet])) + 1):
        if of[at[0]] >= 0:
            out[at] = _passed(px[at], py[at], on[at], passes)
    return out


def morphed(cells: DataFrame, steps: list[tuple[str, Kernel | None]], block: int = BLOCK) -> DataFrame:
    """slide, x, y, on behind the steps (erode, dilate, open, close with a kernel; blur with none).

    A block gets a rim as wide as all steps reach, so blocks are worked on apart;
    only the cells of the rim are there twice. ``block`` is the least side: it is
    raised to ``RIMS`` rims. A task works on many small blocks at once.
    """
    passes = _passes(steps)
    rim = sum(2 if kernel is None else kernel.reach for _, kernel in passes)
    block = max(block, RIMS * rim)
    known = cells.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    near = lambda c: F.explode(F.sequence(F.floor((F.greatest(F.col(c) - rim, F.lit(0))) / block), F.floor((F.col(c) + rim) / block)))
    each = known.select("slide", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.coalesce(F.col("on"), F.lit(False)).alias("on"))
    blocks = each.withColumn("by", near("y")).withColumn("bx", near("x"))

    def work(held: pa.Table) -> pa.Table:
        by, bx, x, y, on = (held.column(c).to_numpy() for c in ("by", "bx", "x", "y", "on"))
        first, own, out = starts(held, 3), (x // block == bx) & (y // block == by), on.astype(bool)
        if len(first):
            out = _worked(first, x, y, out, np.logical_or.reduceat(own, first), passes)
        keep = pa.array(np.flatnonzero(own))
        return held.select(["slide", "x", "y"]).take(keep).append_column("on", pa.array(out[own]))

    return in_groups(blocks, ["slide", "by", "bx"], [], work, typed(each, "slide", "x", "y", "on"))


# Runs and components


def runs(mask: DataFrame, on: Column | None = None) -> DataFrame:
    """slide, y, x0, x1: the stretches of a row in which ``on`` (the column of that name, if not given) holds."""
    cells = mask.filter(F.col("on") if on is None else on).filter("slide IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    shift = F.col("x") - F.dense_rank().over(W.partitionBy("slide", "y").orderBy("x"))
    return cells.withColumn("__shift", shift.cast("long")).groupBy("slide", "y", "__shift").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select("slide", F.col("y").cast("long").alias("y"), F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"))


def joined_runs(some: DataFrame) -> DataFrame:
    """Runs that overlap or touch in their row made one."""
    row = W.partitionBy("slide", "y").orderBy("x0", "x1")
    fresh = F.col("x0") > F.coalesce(F.max("x1").over(row.rowsBetween(W.unboundedPreceding, -1)), F.lit(-2)) + 1
    marked = some.withColumn("__fresh", fresh.cast("int")).withColumn("__part", F.sum("__fresh").over(row.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("slide", "y", "__part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("__part")


def _touching(group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of runs of neighbouring rows that meet; the runs are sorted by group, y and x0."""
    same, next_row = group[1:] == group[:-1], y[1:] == y[:-1] + 1
    row = np.r_[0, np.cumsum(np.where(same & (y[1:] == y[:-1]), 0, np.where(same & next_row, 1, 2)))]
    low = x0.min() if len(x0) else 0
    a, b = x0 - low + 2, x1 - low + 2
    width = int(b.max(initial=0)) + 4
    first = np.searchsorted(row * width + b, (row - 1) * width + a - reach, "left")
    behind = np.searchsorted(row * width + a, (row - 1) * width + b + reach, "right")
    n = np.maximum(behind - first, 0)
    own = np.repeat(np.arange(len(y)), n)
    return own, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least item that each of n items is linked with, by any way."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return root


def labelled(some: DataFrame, connectivity: int = 8, block: int = BLOCK) -> DataFrame:
    """slide, y, x0, x1, label: each run with its component's label, which is the place of the first cell of the component (row, then column).

    Runs of a band of ``block`` raster rows are united in one task; then the
    labels that meet along the borders of a slide's bands are, from the runs of
    the border rows alone.
    """
    reach = {4: 0, 8: 1}[connectivity]
    banded = some.select("slide", F.floor(F.col("y") / block).alias("band"), "y", "x0", "x1")

    def within(held: pa.Table) -> pa.Table:
        y, x0, x1 = (held.column(c).to_numpy() for c in ("y", "x0", "x1"))
        first = starts(held, 2)
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(y)]))
        root = _least(len(y), *_touching(group, y, x0, x1, reach))
        return held.select(["slide", "y", "x0", "x1"]).append_column("label", pa.array(y[root] * PACK + x0[root]))

    local = written(in_groups(banded, ["slide", "band"], ["y", "x0"], within, typed(banded, "slide", "y", "x0", "x1", label="long")), "labels")

    def across(held: pa.Table) -> pa.Table:
        y, x0, x1, label = (held.column(c).to_numpy() for c in ("y", "x0", "x1", "label"))
        first = starts(held, 1)
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(y)]))
        by = np.lexsort((label, group))
        new = np.r_[True, (group[by][1:] != group[by][:-1]) | (label[by][1:] != label[by][:-1])]
        node = np.empty(len(y), np.int64)
        node[by] = np.cumsum(new) - 1  # numbered by group and label, so the least node has the least label
        of = by[new]
        a, b = _touching(group, y, x0, x1, reach)
        root = _least(len(of), node[a], node[b])
        moved = np.flatnonzero(root != np.arange(len(of)))
        return held.select(["slide", "label"]).take(pa.array(of[moved])).append_column("root", pa.array(label[of[root[moved]]]))

    n = tasks(local.sparkSession, local.count())
    local = local.repartition(n, "slide")
    rim = local.filter((F.col("y") % block == 0) | (F.col("y") % block == block - 1))
    roots = in_groups(rim, ["slide"], ["y", "x0"], across, typed(local, "slide", "label", root="long")).repartition(n, "slide")
    return local.join(roots, ["slide", "label"], "left").select("slide", "y", "x0", "x1", F.coalesce("root", "label").alias("label"))


def components(labels: DataFrame, least: int = 1) -> DataFrame:
    """slide, label, bbox_x, bbox_y, bbox_w, bbox_h, cx, cy, area of each component of ``least`` cells at least."""
    n = F.col("x1") - F.col("x0") + 1
    found = labels.groupBy("slide", "label").agg(
        F.min("x0").alias("bbox_x"), F.min("y").alias("bbox_y"), (F.max("x1") - F.min("x0") + 1).alias("bbox_w"), (F.max("y") - F.min("y") + 1).alias("bbox_h"),
        (F.sum((F.col("x0") + F.col("x1")) * n) / (2 * F.sum(n))).alias("cx"), (F.sum(F.col("y") * n) / F.sum(n)).alias("cy"), F.sum(n).alias("area"),
    )
    return found.filter(F.col("area") >= least)


def without_small(some: DataFrame, most: int, connectivity: int = 4) -> DataFrame:
    """The runs without those of components of up to ``most`` cells."""
    labels = labelled(some, connectivity)
    small = components(labels).filter(F.col("area") <= most).select("slide", "label")
    return labels.join(small, ["slide", "label"], "left_anti").select("slide", "y", "x0", "x1")


def holes(mask: DataFrame, most: int | None = None, enclosed: bool = False, connectivity: int = 4) -> DataFrame:
    """slide, y, x0, x1, label: the components of what is off, of up to ``most`` cells; with ``enclosed`` only those that don't reach the raster's edge."""
    labels = labelled(runs(mask, ~F.coalesce(F.col("on"), F.lit(False))), connectivity)
    found = components(labels)
    if most is not None:
        found = found.filter(F.col("area") <= most)
    if enclosed:
        edge = mask.groupBy("slide").agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"))
        inside = (F.col("bbox_x") > F.col("left")) & (F.col("bbox_y") > F.col("top")) & (F.col("bbox_x") + F.col("bbox_w") <= F.col("right")) & (F.col("bbox_y") + F.col("bbox_h") <= F.col("bottom"))
        found = found.join(edge, "slide").filter(inside)
    return labels.join(found.select("slide", "label"), ["slide", "label"], "left_semi").select("slide", "y", "x0", "x1", "label")


def filled(mask: DataFrame, most: int | None = None, enclosed: bool = False) -> DataFrame:
    """The runs of the mask with its holes (see ``holes``) filled."""
    if _whole(mask):
        return _filled_whole(mask, most, enclosed)
    return joined_runs(dealt(written(runs(mask).unionByName(holes(mask, most, enclosed).drop("label")), "filled"), "slide"))


# The same for rasters that are worked on whole


def _whole(cells: DataFrame) -> bool:
    """Whether all rasters of a table have fewer than ``WHOLE`` places each way; nothing but the places is read for that."""
    most = cells.agg(F.max("x"), F.max("y")).first()
    return max((int(m) for m in most if m is not None), default=0) < WHOLE


def _in_slides(mask: DataFrame, work: Callable[[pa.Table], pa.Table], *names: str, **more: str) -> DataFrame:
    """``work`` over tables of whole slides: slide, y, x, on, sorted; with the fields that ``typed`` makes of ``names`` and ``more``."""
    known = mask.filter("slide IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    each = known.select("slide", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.coalesce(F.col("on"), F.lit(False)).alias("on"))
    return in_groups(each, ["slide"], ["y", "x"], work, typed(each, *names, **more))


@dataclass(frozen=True)
class _Runs:
    """Runs of whole slides, sorted: the number of the slide in its table, the row of the table at which the run begins, and the run."""

    group: np.ndarray
    at: np.ndarray
    y: np.ndarray
    x0: np.ndarray
    x1: np.ndarray

    def take(self, which: np.ndarray) -> _Runs:
        return _Runs(self.group[which], self.at[which], self.y[which], self.x0[which], self.x1[which])

    def joined(self) -> _Runs:
        """Runs that touch in their row made one."""
        first = np.flatnonzero(np.r_[True, (self.group[1:] != self.group[:-1]) | (self.y[1:] != self.y[:-1]) | (self.x0[1:] > self.x1[:-1] + 1)][: len(self.y)])
        return _Runs(self.group[first], self.at[first], self.y[first], self.x0[first], self.x1[np.r_[first[1:], len(self.y)][: len(first)] - 1])

    def table(self, held: pa.Table) -> pa.Table:
        return pa.table({"slide": held.column("slide").take(pa.array(self.at)), "y": self.y, "x0": self.x0, "x1": self.x1})


def _both(held: pa.Table, on: np.ndarray) -> tuple[_Runs, np.ndarray]:
    """The runs of what is on and of what is off, and which of them are on."""
    y, x, first = held.column("y").to_numpy(), held.column("x").to_numpy(), starts(held, 1)
    group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(y)]))
    at = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (y[1:] != y[:-1]) | (x[1:] > x[:-1] + 1) | (on[1:] != on[:-1])])
    return _Runs(group[at], at, y[at], x[at], x[np.r_[at[1:], len(y)] - 1]), on[at]


def _on(held: pa.Table) -> np.ndarray:
    return held.column("on").to_numpy().astype(bool)


def _parts(some: _Runs, connectivity: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The number of each run's component; of each component its first run and the columns of ``components`` behind slide."""
    y, x0, x1 = some.y, some.x0, some.x1
    root = _least(len(y), *_touching(some.group, y, x0, x1, {4: 0, 8: 1}[connectivity]))
    first, number = np.unique(root, return_inverse=True)
    order = np.argsort(number, kind="stable")
    begins = np.searchsorted(number[order], np.arange(len(first)))
    over = lambda what, values: what.reduceat(values[order], begins) if len(first) else values[:0]
    n = x1 - x0 + 1
    left, right, bottom, area = over(np.minimum, x0), over(np.maximum, x1), over(np.maximum, y), over(np.add, n)
    top = y[first]
    return number, first, {
        "label": top * PACK + x0[first], "bbox_x": left, "bbox_y": top, "bbox_w": right - left + 1, "bbox_h": bottom - top + 1,
        "cx": over(np.add, (x0 + x1) * n) / (2 * area), "cy": over(np.add, y * n) / area, "area": area,
    }


def mask_components(mask: DataFrame, connectivity: tuple[int, ...] = (8,), least: int = 1, block: int = BLOCK, steps: list[tuple[str, Kernel | None]] | None = None) -> DataFrame:
    """``components`` of the mask behind the ``steps`` (see ``morphed``), and by which connectivity of the given ones they are found."""
    passes = _passes(steps or [])
    if not _whole(mask):
        some = runs(dealt(written(morphed(mask, steps) if steps else mask.select("slide", "x", "y", "on"), "mask"), "slide"))
        return reduce(DataFrame.unionByName, [components(labelled(some, c, block), least).withColumn("connectivity", F.lit(c)) for c in connectivity])

    def work(held: pa.Table) -> pa.Table:
        on, made = _on(held), []
        if passes:
            first = starts(held, 1)
            on = _worked(first, held.column("x").to_numpy(), held.column("y").to_numpy(), on, np.ones(len(first), bool), passes)
        some = (both := _both(held, on))[0].take(both[1])
        for c in connectivity:
            _, first, found = _parts(some, c)
            part = pa.table({"slide": held.column("slide").take(pa.array(some.at[first])), **found, "connectivity": np.full(len(first), c, np.int32)})
            made.append(part.filter(pa.array(found["area"] >= least)))
        return pa.concat_tables(made)

    kinds = {c: "double" if c in ("cx", "cy") else "long" for c in ("label", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "cx", "cy", "area")}
    return _in_slides(mask, work, "slide", **kinds, connectivity="int")


def mask_without_small(mask: DataFrame, most: int, connectivity: int = 4) -> DataFrame:
    """The runs of a mask ``without_small`` components."""
    if not _whole(mask):
        return without_small(runs(mask), most, connectivity)

    def work(held: pa.Table) -> pa.Table:
        some = (both := _both(held, _on(held)))[0].take(both[1])
        number, _, found = _parts(some, connectivity)
        return some.take(found["area"][number] > most).table(held)

    return _in_slides(mask, work, "slide", "y", x0="long", x1="long")


def _filled_whole(mask: DataFrame, most: int | None, enclosed: bool, connectivity: int = 4) -> DataFrame:
    """``filled`` for rasters that are worked on whole."""

    def work(held: pa.Table) -> pa.Table:
        both, on = _both(held, _on(held))
        off = both.take(~on)
        number, first, found = _parts(off, connectivity)
        fits = np.ones(len(first), bool) if most is None else found["area"] <= most
        if enclosed:
            cut, of = starts(held, 1), off.group[first]
            x, y = held.column("x").to_numpy(), held.column("y").to_numpy()
            low, high = (lambda v: np.minimum.reduceat(v, cut)[of]), (lambda v: np.maximum.reduceat(v, cut)[of])
            fits &= (found["bbox_x"] > low(x)) & (found["bbox_y"] > low(y)) & (found["bbox_x"] + found["bbox_w"] <= high(x)) & (found["bbox_y"] + found["bbox_h"] <= high(y))
        keep = on.copy()
        keep[~on] = fits[number]
        return both.take(keep).joined().table(held)

    return _in_slides(mask, work, "slide", "y", x0="long", x1="long")


def as_mask(cells: DataFrame, some: DataFrame) -> DataFrame:
    """The cells with ``on`` where a run is."""
    places = some.select("slide", "y", F.explode(F.sequence("x0", "x1")).alias("x")).withColumn("on", F.lit(True))
    return cells.drop("on").join(places, ["slide", "x", "y"], "left").withColumn("on", F.coalesce("on", F.lit(False)))


# The masks of the three generations of the workflow, from grey values, saturation and brightness


def tissue_mask(cells: DataFrame, white: int = 220, kernel: int = 9) -> DataFrame:
    """``on``: darker than white, closed, then opened by a square."""
    dark = cells.withColumn("on", F.col("grey") < white)
    return morphed(dark, [("close", rectangle(kernel)), ("open", rectangle(kernel))])


#: Fixed values of the older rules: saturation above and brightness below which a cell is tissue whatever its grey value.
SATURATION, BRIGHTNESS, OLDEST_SATURATION = 18, 245, 10


def tissue_mask_by_otsu(cells: DataFrame, least: int, kernel: int = 5) -> DataFrame:
    """``on`` by the older rule: up to Otsu's threshold, or coloured and not bright; small objects go, small holes are filled; opened, then closed by a disc."""
    coloured = (F.col("saturation") > SATURATION) & (F.col("brightness") < BRIGHTNESS)
    mask = written(below_otsu(cells).withColumn("on", F.col("on") | F.coalesce(coloured, F.lit(False))).select("slide", "x", "y", "on"), "mask")
    n = tasks(mask.sparkSession, mask.count())  # cells and runs are dealt alike, so what joins them moves neither
    mask = mask.repartition(n, "slide")
    whole = written(as_mask(mask, mask_without_small(mask, max(16, least // 5)).repartition(n, "slide")), "mask").repartition(n, "slide")
    whole = as_mask(whole, filled(whole, max(64, least // 3)).repartition(n, "slide"))
    side = max(3, kernel) | 1
    return morphed(whole, [("open", ellipse(side)), ("close", ellipse(side))])


def tissue_mask_blurred(cells: DataFrame, white: int = 220) -> DataFrame:
    """``on`` by the oldest rule: darker than white or coloured, blurred, opened and closed by a disc of seven."""
    mask = cells.withColumn("on", (F.col("grey") < white) | (F.col("saturation") > OLDEST_SATURATION))
    return morphed(mask, [("blur", None), ("open", ellipse(7)), ("close", ellipse(7))])
