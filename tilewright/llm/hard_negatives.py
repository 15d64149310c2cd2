"""Hard negatives by branch and bound over ball trees.

Vectors are dealt to parts of like ones: cells of a shallow tree that is fitted on
a bounded sample (``SAMPLE`` rows; every row is dealt), cells that hold much in
several parts by the row's id. A task builds the ball tree of a part and streams
the anchors that were sent to it, in batches. A ball with centre c and radius r
holds inner products with q from c.q - r|q| to c.q + r|q| only: a node is pruned
if that lies outside the score window, or strictly beneath the score that the
k-th best has already (ties go to the lesser id, so equal scores are searched).
The same bounds over whole cells, with the k-th best among the sample as a start,
tell which parts an anchor is sent to at all. Two searches follow one another:
positives first, then the negatives in the windows that the positives' scores
give. Each part returns k candidates a window at most.

Every anchor is searched against every row that the bounds can't exclude, so work
grows as anchors times rows where the data give the bounds no hold (random
directions of many dimensions); what is sent is anchors times parts. A tree keeps,
of rows alike in vector and label, the k + 1 least ids: others can't be returned.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part. Equal rows are one row; rows that share an id but not
their contents are rows of their own and never each other's partners. Shorter
vectors count as filled up with zeros. Labels are numbers. Scores are exact: a
ValueError says so if vectors are so long that a score could reach 2^53. An anchor
without a positive, and a positive without a row in its window, has no row of the
result. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import saved

#: Rows that the cells are fitted on, and the fewest sampled rows of a cell.
SAMPLE, LEAST_CELL = 4096, 32
#: Components that a part's tree holds, about (eight bytes each); rows below which a part isn't made for the sake of more tasks.
VALUES, LEAST_PART = 8_000_000, 1_000
LEAF = 256
#: Scores below this are exact in any order of summing.
EXACT = 1 << 53
NONE, MOST = np.int64(-(1 << 62)), np.int64(1 << 62)


def usable(rows: DataFrame, id_col: str, label_col: str | Column, vec_col: str, scale: int) -> DataFrame:
    """vec_id, label, vec (whole numbers) of the rows that take part."""
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & good).withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` numbers, shorter ones filled up."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1], sizes)] = flat
    return out


def _halved(points: np.ndarray) -> np.ndarray | None:
    """Which points lie on the nearer side of the middle, along the line between two far ones; None if all are equal."""
    far = points[np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1))]
    line = points[np.argmax(((points - far) ** 2).sum(axis=1))] - far
    along = points @ line
    cut = np.median(along)
    near = along <= cut
    if near.all():
        near = along < along.max()
    return near if near.any() and not near.all() else None


class Cells:
    """A shallow tree over a sample; a cell is a leaf's number."""

    def __init__(self, sample: np.ndarray, most: int) -> None:
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []
        self.centres: list[np.ndarray] = []
        self.root = self._grow(sample, most)

    def _grow(self, points: np.ndarray, most: int) -> int:
        if most > 1 and len(points) >= 2 * LEAST_CELL:
            far = points[np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1))]
            line = points[np.argmax(((points - far) ** 2).sum(axis=1))] - far
            along = points @ line
            cut = float(np.median(along))
            near = along <= cut
            if near.all():
                cut = float(np.max(along[along < cut], initial=-np.inf))
                near = along <= cut
            if near.any() and not near.all():
                self.nodes.append((line, cut, 0, 0))
                me = len(self.nodes) - 1
                children = self._grow(points[near], most // 2), self._grow(points[~near], most - most // 2)
                self.nodes[me] = (line, cut, *children)
                return me
        self.centres.append(points.mean(axis=0) if len(points) else np.zeros(points.shape[1]))
        return -len(self.centres)

    def of(self, points: np.ndarray) -> np.ndarray:
        cell, stack = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while stack:
            node, idx = stack.pop()
            if node < 0:
                cell[idx] = -1 - node
            elif len(idx):
                line, cut, near, far = self.nodes[node]
                side = points[idx] @ line <= cut
                stack += [(near, idx[side]), (far, idx[~side])]
        return cell


class Asked:
    """A batch of anchors, each with its score windows and what its k-th best has at least."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> None:
        self.ids, self.labels, self.q, self.of, self.high, self.k, self.same = ids, labels, q, of, high, k, same
        self.norm = np.sqrt((q * q).sum(axis=1))
        self.floor = low.copy()  # a score beneath it can't be returned
        self.scores, self.found = np.full((len(of), k), NONE), np.full((len(of), k), MOST)

    def open(self, w: np.ndarray, centre: np.ndarray, radius: float, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of ``w`` that a ball can add to, and the highest score that it can hold for each."""
        a = self.of[w]
        middle, reach = (self.q @ centre)[a], radius * self.norm[a]
        reach = reach + 1e-9 * (reach + np.abs(middle)) + 1e-6  # rounding never prunes
        ok = (middle + reach >= self.floor[w]) & (middle - reach <= self.high[w])
        ok &= (least <= self.labels[a]) & (self.labels[a] <= most) if self.same else ~((self.labels[a] == least) & (least == most))
        return w[ok], (middle + reach)[ok]

    def take(self, w: np.ndarray, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> None:
        """Score the points for the windows ``w`` and keep the best."""
        step = max(1, (1 << 20) // max(1, len(ids)))
        for at in range(0, len(w), step):
            part = w[at : at + step]
            a, place = np.unique(self.of[part], return_inverse=True)
            score = np.rint(self.q[a] @ points.T).astype(np.int64)
            fits = ((labels[None, :] == self.labels[a][:, None]) == self.same) & (ids[None, :] != self.ids[a][:, None])
            score = np.where(fits, score, NONE)[place]
            i, j = np.nonzero((score >= np.maximum(self.floor[part], NONE + 1)[:, None]) & (score <= self.high[part][:, None]))
            if len(i):
                self._merge(part, i, score[i, j], ids[j])

    def _merge(self, part: np.ndarray, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        own, i = np.unique(i, return_inverse=True)
        w, k = part[own], self.k
        i = np.r_[np.repeat(np.arange(len(w)), k), i]
        score, ids = np.r_[self.scores[w].ravel(), score], np.r_[self.found[w].ravel(), ids]
        by = np.lexsort((ids, -score, i))
        i, score, ids = i[by], score[by], ids[by]
        rank = np.arange(len(i)) - np.searchsorted(i, np.arange(len(w)))[i]
        best = rank < k
        self.scores[w[i[best]], rank[best]] = score[best]
        self.found[w[i[best]], rank[best]] = ids[best]
        self.floor[w] = np.maximum(self.floor[w], self.scores[w, k - 1])


class Balls:
    """The ball tree of a part."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, k: int) -> None:
        alike = np.unique(np.ascontiguousarray(points + 0.0).view(f"V{points.shape[1] * 8}").ravel(), return_inverse=True)[1]
        by = np.lexsort((ids, labels, alike))
        ids, labels, alike = ids[by], labels[by], alike[by]
        new = np.r_[True, (alike[1:] != alike[:-1]) | (labels[1:] != labels[:-1])]
        once = new | np.r_[True, ids[1:] != ids[:-1]]
        ids, labels, by, new = ids[once], labels[once], by[once], new[once]
        first = np.flatnonzero(new)
        least = np.arange(len(ids)) - first[np.cumsum(new) - 1] <= k
        self.ids, self.labels, self.points = ids[least], labels[least], points[by[least]]
        self.nodes: list[tuple] = []
        self.order = np.arange(len(self.ids))
        stack = [(0, len(self.ids), -1)]
        while stack:
            lo, hi, parent = stack.pop()
            own = self.order[lo:hi]
            x = self.points[own]
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))
            near = _halved(x) if hi - lo > LEAF else None
            self.nodes.append([lo, hi, centre, radius, int(self.labels[own].min()), int(self.labels[own].max()), near is None, []])
            if parent >= 0:
                self.nodes[parent][7].append(len(self.nodes) - 1)
            if near is not None:
                self.order[lo:hi] = np.r_[own[near], own[~near]]
                mid = lo + int(near.sum())
                stack += [(lo, mid, len(self.nodes) - 1), (mid, hi, len(self.nodes) - 1)]
        self.ids, self.labels, self.points = self.ids[self.order], self.labels[self.order], self.points[self.order]

    def search(self, asked: Asked) -> None:
        stack = [(0, np.arange(len(asked.of)))]
        while stack:
            node, w = stack.pop()
            lo, hi, centre, radius, least, most, leaf, children = self.nodes[node]
            w, _ = asked.open(w, centre, radius, least, most)
            if not len(w):
                continue
            if leaf:
                asked.take(w, self.ids[lo:hi], self.labels[lo:hi], self.points[lo:hi])
            else:  # the child that promises more is searched first
                stack += sorted(((c, w) for c in children), key=lambda x: float((asked.q[asked.of[x[1]]] @ self.nodes[x[0]][2]).sum() + self.nodes[x[0]][3] * asked.norm[asked.of[x[1]]].sum()))


def _windows(ps: pa.Array | None, n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, low, high) of each window: one that holds all without positives' scores."""
    if ps is None or ps.null_count == n:
        return np.arange(n), np.full(n, NONE), np.full(n, MOST)
    offsets, p = ps.offsets.to_numpy(), ps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(n), np.diff(offsets)), -((-low * p) // 100), (high * p) // 100


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "anchor_label", "anchor_hash", "positive_id", "positive_score").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str | Column = "label", vec_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition over vec_id, label. Of each anchor's ``positives`` best
    rows of its label, each one's ``negatives`` best rows of other labels between
    ``low`` and ``high`` hundredths of its score. Components become floor(``scale`` * x).
    """
    spark, own = rows.sparkSession, usable(rows, id_col, label_col, vec_col, scale)
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    n, width, longest = own.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.max(squares), F.lit(0.0))).first()
    if longest >= EXACT:
        raise ValueError(f"a score could reach {longest:.3g}; scores are exact below 2^53")
    width, tasks = max(1, width), int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, min(VALUES // width, max(LEAST_PART, n // tasks)))
    drawn = own.orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label").limit(SAMPLE).toArrow()
    sample = _matrix(drawn["vec"].combine_chunks(), width)
    sample_ids, sample_labels = drawn["vec_id"].to_numpy(), drawn["label"].to_numpy()
    _, alone = np.unique(np.c_[sample_ids, sample_labels, sample], axis=0, return_index=True)
    sample, sample_ids, sample_labels = sample[alone], sample_ids[alone], sample_labels[alone]
    cells = Cells(sample, max(1, n // size))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2), width)
            cell = cells.of(x)
            far = np.sqrt(((x - np.array(cells.centres)[cell]) ** 2).sum(axis=1))
            yield pa.record_batch([*b.columns, pa.array(cell), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    dealt = saved(own.mapInArrow(deal, "vec_id long, label long, vec array<double>, cell long, far double"), "vectors")
    balls = {r.cell: r for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.min("label").alias("least"), F.max("label").alias("most")).collect()}
    parts = [-(-balls[c].n // size) if c in balls else 1 for c in range(len(cells.centres))]
    first = np.cumsum([0, *parts])
    part = F.get(F.array(*(F.lit(int(x)) for x in first[:-1])), F.col("cell").cast("int")) + F.pmod(F.xxhash64("vec_id"), F.get(F.array(*map(F.lit, parts)), F.col("cell").cast("int"))).cast("int")
    kind = "part int, asks boolean, vec_id long, label long, hash long, vec array<double>, ps array<long>, pids array<long>, floors array<long>"
    none = F.lit(None).cast("array<long>")
    points = dealt.select(part.alias("part"), F.lit(False).alias("asks"), "vec_id", "label", F.lit(0).cast("long").alias("hash"), "vec", none.alias("ps"), none.alias("pids"), none.alias("floors"))
    queries = saved(dealt.filter(anchors).select("vec_id", "label", F.xxhash64("vec").alias("hash"), "vec").dropDuplicates(["vec_id", "label", "hash"]), "anchors")

    def search(asking: DataFrame, k: int, same: bool) -> DataFrame:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
                asked = Asked(ids, labels, _matrix(b.column(3), width), *_windows(b.column(4), b.num_rows, low, high), k, same)
                every = np.arange(len(asked.of))
                asked.take(every, sample_ids, sample_labels, sample)
                ends = np.searchsorted(asked.of, np.arange(b.num_rows + 1)).astype(np.int32)
                whole = pa.record_batch([pa.array(np.zeros(b.num_rows, np.int32)), pa.array(np.ones(b.num_rows, bool)), *b.columns, pa.ListArray.from_arrays(ends, pa.array(asked.floor))], names=["part", "asks", "vec_id", "label", "hash", "vec", "ps", "pids", "floors"])
                for c, ball in balls.items():
                    w, _ = asked.open(every, cells.centres[c], ball.radius, ball.least, ball.most)
                    if len(w):
                        some = whole.take(pa.array(np.unique(asked.of[w])))
                        for p in range(first[c], first[c + 1]):
                            yield some.set_column(0, "part", pa.array(np.full(some.num_rows, p, np.int32)))

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, tree = -1, [], None
            for b in batches:
                part, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])])
                for i, j in zip(cuts, np.r_[cuts[1:], len(part)], strict=True):
                    if part[i] != now:
                        now, held, tree = part[i], [], None
                    s = b.slice(i, j - i)
                    if not asks[i]:
                        held.append((s.column(2).to_numpy(), s.column(3).to_numpy(), _matrix(s.column(5), width)))
                        continue
                    if tree is None:
                        tree, held = Balls(*(np.concatenate(x) for x in zip(*held, strict=True)), k), []
                    of, lo, hi = _windows(s.column(6), s.num_rows, low, high)
                    asked = Asked(s.column(2).to_numpy(), s.column(3).to_numpy(), _matrix(s.column(5), width), of, np.maximum(lo, s.column(8).flatten().to_numpy()), hi, k, same)
                    tree.search(asked)
                    w, r = np.nonzero(asked.found < MOST)
                    a, missing = pa.array(of[w]), pa.nulls(len(w), pa.int64())
                    of_pos = [s.column(c).flatten().take(pa.array(w)) if s.column(c).null_count == 0 else missing for c in (7, 6)]
                    yield pa.record_batch([s.column(2).take(a), s.column(3).take(a), s.column(4).take(a), *of_pos, pa.array(asked.found[w, r]), pa.array(asked.scores[w, r])], names=["anchor_id", "anchor_label", "anchor_hash", "positive_id", "positive_score", "other_id", "score"])

        sent = points.unionByName(asking.mapInArrow(send, kind))
        met = sent.repartition(max(1, min(tasks, int(first[-1]))) if first[-1] < tasks else tasks, "part").sortWithinPartitions("part", "asks")
        return met.mapInArrow(answer, "anchor_id long, anchor_label long, anchor_hash long, positive_id long, positive_score long, other_id long, score long")

    near = _best(search(queries.withColumns({"ps": none, "pids": none}), positives, True), positives)
    near = near.groupBy("anchor_id", "anchor_label", "anchor_hash").agg(F.collect_list("score").alias("ps"), F.collect_list("other_id").alias("pids"))
    near = saved(near.withColumnsRenamed({"anchor_id": "vec_id", "anchor_label": "label", "anchor_hash": "hash"}), "positives")
    asking = queries.join(near, ["vec_id", "label", "hash"]).select("vec_id", "label", "hash", "vec", "ps", "pids")
    found = _best(search(asking, negatives, False), negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same rows from all pairs; for tables small enough for that.
PAIRS_SQL = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 100 = 0),
    p AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""
