"""Masks, labels and thresholds against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import groups as G
from tilewright.operators import rasters as K
from tilewright.plans.session import ship


def grids(seed, sizes, share=0.5):
    rng = np.random.default_rng(seed)
    return {s: rng.random(size) < share for s, size in enumerate(sizes)}


def table(spark, masks):
    rows = [(s, int(x), int(y), bool(m[y, x])) for s, m in masks.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    return ship(spark).createDataFrame(rows, "slide long, x long, y long, on boolean")


SIZES = [(1, 1), (7, 9), (20, 33), (33, 20), (1, 40), (40, 1), (64, 64)]


def swept(mask, kernel, what):
    out = np.zeros_like(mask)
    for y in range(mask.shape[0]):
        for x in range(mask.shape[1]):
            near = [mask[y + dy, x + dx] for dy, a, b in kernel.rows for dx in range(a, b + 1) if 0 <= y + dy < mask.shape[0] and 0 <= x + dx < mask.shape[1]]
            out[y, x] = any(near) if what == "dilate" else all(near)
    return out


def blurred(mask):
    h, w = mask.shape
    mirror = lambda i, n: 0 if n == 1 else [*range(n), *range(n - 2, 0, -1)][i % (2 * n - 2)]
    weights = (1, 4, 6, 4, 1)
    total = lambda y, x: sum(weights[i] * weights[j] * mask[mirror(y + i - 2, h), mirror(x + j - 2, w)] for i in range(5) for j in range(5))
    return np.array([[total(y, x) >= 128 for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("block", [5, 16, 512])
@pytest.mark.parametrize("steps", [[("close", K.rectangle(3)), ("open", K.rectangle(3))], [("open", K.ellipse(5)), ("close", K.ellipse(3))], [("dilate", K.rectangle(4)), ("erode", K.rectangle(2))]])
def test_opening_and_closing_at_block_borders(spark, block, steps):
    masks = grids(1, SIZES)
    got = {(r.slide, r.x, r.y): r.on for r in K.morphed(table(spark, masks), steps, block).collect()}
    assert len(got) == sum(m.size for m in masks.values())
    for s, m in masks.items():
        for name, kernel in steps:
            for p in K.PASSES[name]:
                m = swept(m, kernel, p)
        assert all(got[s, x, y] == m[y, x] for y in range(m.shape[0]) for x in range(m.shape[1]))


def test_blur_is_mirrored_at_the_edge(spark):
    masks = grids(2, [(1, 1), (2, 7), (9, 12), (30, 31)])
    got = {(r.slide, r.x, r.y): r.on for r in K.morphed(table(spark, masks), [("blur", None)], 8).collect()}
    for s, m in masks.items():
        want = blurred(m)
        assert all(got[s, x, y] == want[y, x] for y in range(m.shape[0]) for x in range(m.shape[1]))


def test_kernels_and_steps_are_checked(spark):
    assert K.ellipse(5).rows == ((-2, 0, 0), (-1, -2, 2), (0, -2, 2), (1, -2, 2), (2, 0, 0))
    assert K.ellipse(7).rows[1] == (-2, -2, 2) and K.rectangle(4).rows[0] == (-2, -2, 1)
    with pytest.raises(ValueError):
        K.morphed(table(spark, grids(1, [(2, 2)])), [("shrink", K.rectangle(3))])


def flooded(mask, connectivity):
    """label -> cells, by a flood fill from each cell in scan order."""
    h, w = mask.shape
    seen, out = np.zeros_like(mask), {}
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not seen[y, x]:
                work, cells = [(y, x)], []
                seen[y, x] = True
                while work:
                    cy, cx = work.pop()
                    cells.append((cy, cx))
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            ny, nx = cy + dy, cx + dx
                            if (connectivity == 8 or not (dy and dx)) and 0 <= ny < h and 0 <= nx < w and mask[ny, nx] and not seen[ny, nx]:
                                seen[ny, nx] = True
                                work.append((ny, nx))
                out[y * K.PACK + x] = cells
    return out


@pytest.mark.parametrize("connectivity, block", [(8, 1), (8, 7), (4, 3), (4, 512)])
def test_labels_are_those_of_a_flood_fill(spark, connectivity, block):
    masks = grids(3, SIZES, 0.45 if connectivity == 8 else 0.6)
    masks[7] = np.zeros((9, 9), bool)
    spiral = np.zeros((41, 41), bool)
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = spiral[k + 2 : 41 - k, k] = True
        spiral[k + 2, k : k + 3] = True
    masks[8] = spiral
    labels = K.labelled(K.runs(table(spark, masks)), connectivity, block)
    got = {(r.slide, r.label): r for r in K.components(labels).collect()}
    want = {(s, label): cells for s, m in masks.items() for label, cells in flooded(m, connectivity).items()}
    assert set(got) == set(want)
    for key, cells in want.items():
        y, x = np.array(cells).T
        r = got[key]
        assert (r.bbox_x, r.bbox_y, r.bbox_w, r.bbox_h, r.area) == (x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1, len(cells))
        assert abs(r.cx - x.mean()) < 1e-9 and abs(r.cy - y.mean()) < 1e-9
    assert K.components(labels, 4).count() == sum(len(c) >= 4 for c in want.values())


def cells_of(runs):
    return {(r.slide, x, r.y) for r in runs.collect() for x in range(r.x0, r.x1 + 1)}


def test_small_parts_go_and_holes_are_filled(spark):
    masks = grids(4, SIZES, 0.55)
    t = table(spark, masks)
    on = {(s, x, y) for s, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)}
    small = {(s, x, y) for s, m in masks.items() for cells in flooded(m, 4).values() if len(cells) <= 3 for y, x in cells}
    assert cells_of(K.without_small(K.runs(t), 3)) == on - small
    holes = {s: flooded(~m, 4).values() for s, m in masks.items()}
    assert cells_of(K.filled(t, 5)) == on | {(s, x, y) for s, all_ in holes.items() for cells in all_ if len(cells) <= 5 for y, x in cells}
    inside = lambda s, cells: all(0 < y < masks[s].shape[0] - 1 and 0 < x < masks[s].shape[1] - 1 for y, x in cells)
    closed = {(s, x, y) for s, all_ in holes.items() for cells in all_ if inside(s, cells) for y, x in cells}
    assert cells_of(K.filled(t, enclosed=True)) == on | closed and closed
    runs = [(r.slide, r.y, r.x0, r.x1) for r in K.filled(t, 5).collect()]
    assert not {(s, y, b + 1) for s, y, _, b in runs} & {(s, y, a) for s, y, a, _ in runs}  # neighbours are one run
    back = K.as_mask(t, K.filled(t, 5))
    assert cells_of(K.runs(back)) == cells_of(K.filled(t, 5)) and back.count() == t.count()


def test_otsu_by_its_definition(spark):
    rng = np.random.default_rng(5)
    slides = {0: rng.integers(0, 256, 500), 1: np.full(40, 7), 2: np.array([3, 9]), 3: np.r_[rng.normal(60, 9, 300), rng.normal(190, 12, 200)].astype(int)}
    rows = [(s, i, 0, int(v)) for s, values in slides.items() for i, v in enumerate(values)] + [(1, 900, 0, None), (4, 0, 0, None)]
    cells = ship(spark).createDataFrame(rows, "slide long, x long, y long, grey int")
    got = {r.slide: r.threshold for r in K.otsu(cells).collect()}
    for s, values in slides.items():
        best, at = 0.0, 0
        for t in range(256):
            low, high = values[values <= t], values[values > t]
            if len(low) and len(high):
                between = len(low) / len(values) * len(high) / len(values) * (low.mean() - high.mean()) ** 2
                if between > best + 1e-9:
                    best, at = between, t
        assert got[s] == at
    assert set(got) == set(slides)
    on = K.below_otsu(cells).filter("on").groupBy("slide").count()
    assert {r.slide: r["count"] for r in on.collect()} == {s: int((v <= got[s]).sum()) for s, v in slides.items() if (v <= got[s]).any()}


def test_masks_of_the_older_rules_run_whole(spark):
    rng = np.random.default_rng(6)
    rows = [(s, x, y, int(rng.integers(0, 256)), int(rng.integers(0, 40)), int(rng.integers(180, 256))) for s in range(2) for y in range(30) for x in range(25)]
    cells = ship(spark).createDataFrame(rows, "slide long, x long, y long, grey int, saturation int, brightness int")
    assert K.tissue_mask_by_otsu(cells, 30).count() == K.tissue_mask(cells, kernel=3).count() == len(rows)
    got = {(r.slide, r.x, r.y): r.on for r in K.tissue_mask_blurred(cells, 128).collect()}
    for s in range(2):
        m = np.zeros((30, 25), bool)
        for t, x, y, g, sat, _ in rows:
            if t == s:
                m[y, x] = g < 128 or sat > 10
        m = blurred(m)
        for p in ("erode", "dilate", "dilate", "erode"):
            m = swept(m, K.ellipse(7), p)
        assert all(got[s, x, y] == m[y, x] for y in range(30) for x in range(25))


def test_empty_rasters_and_null_places(spark):
    none = ship(spark).createDataFrame([], "slide long, x long, y long, on boolean")
    assert K.morphed(none, [("open", K.rectangle(3))]).count() == 0 and K.components(K.labelled(K.runs(none))).count() == 0
    odd = spark.createDataFrame([(None, 0, 0, True), (1, None, 0, True), (1, 0, None, True), (1, 0, 0, None), (1, 1, 0, True)], "slide long, x long, y long, on boolean")
    assert [tuple(r) for r in K.runs(odd).collect()] == [(1, 0, 1, 1)]
    assert K.morphed(odd, [("dilate", K.rectangle(3))]).filter(F.col("on")).count() == 2


@pytest.mark.parametrize("alone", [False, True])
def test_blocks_of_a_sheet_lie_apart(alone):
    rng = np.random.default_rng(8)
    wide, high, live = rng.integers(1, 300, 400), rng.integers(1, 500, 400), rng.random(400) < 0.8
    sheet, top = K._sheets(wide, high, live, alone)
    assert ((sheet >= 0) == live).all() and len(np.unique(sheet[live])) < (401 if alone else 60)
    for s in np.unique(sheet[live]):
        own = np.flatnonzero(sheet == s)
        own = own[np.argsort(top[own])]
        assert top[own[0]] == 0 and (top[own][1:] >= (top + high)[own][:-1]).all() and (alone or wide[own].max() <= max(8, 2 * wide[own].min()))


def test_older_mask_is_the_same_over_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(s, x, y, int(rng.integers(0, 256)), int(rng.integers(0, 40)), int(rng.integers(180, 256))) for s in range(30) for x in range(9 + s % 5) for y in range(7 + s % 3)]
    cells = ship(spark).createDataFrame(rows, "slide long, x long, y long, grey long, saturation long, brightness long")
    mask = lambda: {(r.slide, r.x, r.y): r.on for r in K.tissue_mask_by_otsu(cells, 30, 3).collect()}
    once = mask()
    monkeypatch.setattr(G, "ROWS", 100)
    assert mask() == once and len(once) == len(rows)
    labels = K.labelled(K.runs(cells, F.col("grey") < 128), 8, 3)
    assert labels.rdd.getNumPartitions() > 4


def test_small_blocks_are_raised_to_their_rim(spark, monkeypatch):
    masks, moved = grids(10, [(11, 16)] * 20), []
    plain = K.in_groups
    monkeypatch.setattr(K, "in_groups", lambda rows, *rest: (moved.append(rows.count()), plain(rows, *rest))[1])
    steps = [("erode", K.rectangle(2)), ("dilate", K.ellipse(5))]
    got = lambda: {(r.slide, r.x, r.y): r.on for r in K.morphed(table(spark, masks), steps, block=4).collect()}
    once = got()
    monkeypatch.setattr(K, "RIMS", 0)  # blocks of 4 with their rims
    assert got() == once and len(once) == 20 * 11 * 16
    assert moved[0] <= 1.5 * len(once) < moved[1]


WHOLE = {
    "components": lambda t: K.mask_components(t, (8, 4), block=5),
    "large components behind steps": lambda t: K.mask_components(t, (8,), 3, block=5, steps=[("close", K.rectangle(2)), ("open", K.rectangle(2))]),
    "without small": lambda t: K.mask_without_small(t, 2),
    "filled": lambda t: K.filled(t, 3),
    "enclosed": lambda t: K.filled(t, enclosed=True),
    "small and enclosed": lambda t: K.filled(t, 2, True),
}


@pytest.mark.parametrize("what", sorted(WHOLE))
def test_small_rasters_are_worked_on_in_one_pass(spark, monkeypatch, what):
    masks = grids(11, [*SIZES, (90, 17)], 0.55) | {90: np.zeros((6, 6), bool), 91: np.ones((6, 6), bool)}
    t = table(spark, masks).union(spark.createDataFrame([(None, 0, 0, True), (95, None, 0, True), (95, 0, None, True), (95, 3, 4, None), (95, 4, 4, True), (95, 6, 4, True)], "slide long, x long, y long, on boolean"))
    ordered = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    stored = []
    plain = K.written
    monkeypatch.setattr(K, "written", lambda df, tag: (stored.append(tag), plain(df, tag))[1])
    once = WHOLE[what](t)
    found, types = ordered(once), once.dtypes
    assert found and not stored  # no table on the way, so no shuffle of runs either
    monkeypatch.setattr(K, "WHOLE", 8)
    over = WHOLE[what](t)
    assert ordered(over) == found and over.dtypes == types and stored
