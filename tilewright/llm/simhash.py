"""Near-duplicate groups by SimHash fingerprints and vantage-point trees.

Fingerprints are grouped first, so that copies are one point. A shallow
vantage-point tree over a bounded sample (``SAMPLE`` fingerprints) splits the
space of 64-bit fingerprints into shards by Hamming distance. Shards that still
hold too many points are split again as deep as their counts ask for, at vantage
points drawn from the shard's number, which need no sample: so a shard doesn't
grow with the data. Each fingerprint goes to its home shard and, by the triangle
bound, visits the shards beyond each boundary that its ball overlaps (only from
the near to the far side: every pair meets in the home shard of one of its two).
A shard's task builds a vantage-point
tree over its home points and runs all points through it at once, pruning
branches by the triangle bound, and returns a spanning forest of the exact links,
so that dense groups never leave as all pairs. The forests' components are found
by star rounds.

Defined results: null or word-less text has fingerprint zero and is linked like
any other. Rows with a null doc_id take part; component_id is the least non-null
doc_id, null if there is none. Repeated rows are equal points. Long texts are
hashed whole, in blocks of shingles. Other columns are ignored.

Cost: two points lie 32 +- 4 bits apart, so at radius 2 a split spares a point
one side in about half the cases, and pair tests grow as the number of different
fingerprints to the power of about 1.55; larger radii lose the pruning. ``verified_copies``
doesn't rely on the radius: prefixes of the texts' shingle sets find the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import clear, mark, saved, saved_at

#: Fingerprints that the shard tree is fitted on; every fingerprint is routed through it.
SAMPLE = 4096
#: Home points that a shard is to have, about; the points, visits included, beyond which it is split again, and the most levels of that.
SHARD, MOST_POINTS, MOST_LEVELS = 8_000, 1_000_000, 24
LEAF = 96
#: Parts that a large group is verified in.
SLOTS = 64
#: One in so many documents (of any number, but 8,000 at least) tells which shingles are frequent; the most frequent ones that are remembered.
SAMPLED, LEAST_SAMPLED, MOST_OFTEN = 8, 8_000, 200_000
#: Ids that are sent to all executors (some 32 bytes each); more of them are joined by a shuffle.
SENT = 1_000_000
#: Pairs a row beyond which rounds join the alike along stars before all rows of a key are compared.
PAIRS = 4
#: Rows beyond which a key is large, and rows of its largest component that others are compared with in a round.
LARGE, HEADS = 32, 4
#: Large keys that a row carries, the first of its own: they tell whether two rows had met earlier, and how many they can share.
EARLY = 32
#: Rows of a key that one part of its comparison has, about.
HOT = 256


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at white space of ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, repeats included; a shorter text is one shingle, a word-less one has none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    view, hash_of = memoryview(joined), xxhash.xxh64_intdigest
    return np.fromiter((hash_of(view[i:j], 42) for i, j in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: str | None, width: int = 3, distinct: bool = False, block: int = 1 << 18) -> int:
    """SimHash of the word shingles (of the distinct ones, if asked): a bit is 1 if over half the XXH64 hashes have it."""
    if distinct and width == 1:
        words = set(words_of(text))
        hashes = np.unique(np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words)))
    else:
        hashes = shingles(text, width)
        if distinct:
            hashes = np.unique(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        ones += np.unpackbits(hashes[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distinct: bool = False, copies: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) per row; copy too, if asked: a hash of the text, which equal texts share."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if copies:
        rows = rows.withColumn("copy", F.xxhash64(F.coalesce("text", F.lit(""))))
    kind = rows.drop("text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, width, distinct) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            kept = [b.column(i) for i in range(b.num_columns) if i != 1]
            yield pa.record_batch([*kept, pa.array(fps.view(np.int64))], names=kind.names)

    return rows.mapInArrow(run, kind)


def shard_tree(sample: np.ndarray, depth: int, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, near, far); a child below zero is leaf -1 - child."""
    rng, nodes, leaves = np.random.default_rng(seed), [], [0]

    def grow(points: np.ndarray, left: int) -> int:
        if left and len(points) > 8:
            for vp in points[rng.permutation(len(points))[:4]]:
                d = np.bitwise_count(points ^ vp)
                if (far := d > (mu := int(np.median(d)))).any():
                    nodes.append((int(vp), mu, 0, 0))
                    me = len(nodes) - 1
                    near_child, far_child = grow(points[~far], left - 1), grow(points[far], left - 1)
                    nodes[me] = (int(vp), mu, near_child, far_child)
                    return me
        leaves[0] += 1
        return -leaves[0]

    grow(sample, depth)
    return nodes


def _drawn(cells: np.ndarray) -> np.ndarray:
    """A vantage point for each cell below a leaf, from its number."""
    x = (cells.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def route(points: np.ndarray, tree: list[tuple[int, int, int, int]], radius: int, deeper: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point index, shard, home): each point's home shard and the shards that it visits.

    ``deeper`` has the levels below a leaf. A shard's number is its leaf, then
    its path of near (0) and far (1) sides behind a leading 1.
    """
    found: list[tuple[np.ndarray, int, bool]] = []
    stack = [(0 if tree else -1, np.arange(len(points)), True)]
    while stack:
        node, idx, home = stack.pop()
        if not len(idx):
            continue
        if node < 0:
            found.append((idx, -1 - node, home))
            continue
        vp, mu, near, far = tree[node]
        d = np.bitwise_count(points[idx] ^ np.uint64(vp)).astype(np.int64)
        if home:
            stack += [(near, idx[d <= mu], True), (far, idx[d > mu], True), (far, idx[(d <= mu) & (d + radius > mu)], False)]
        else:
            stack += [(near, idx[d - radius <= mu], False), (far, idx[d + radius > mu], False)]
    every = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
    for idx, leaf, home in found:
        cell, homes, mu = np.full(len(idx), (leaf << MOST_LEVELS + 1) | 1), np.full(len(idx), home), 31
        for _ in range((deeper or {}).get(leaf, 0)):
            d = np.bitwise_count(points[idx] ^ _drawn(cell)).astype(np.int64)
            path = (cell & ((1 << MOST_LEVELS + 1) - 1)) << 1
            low, high = (leaf << MOST_LEVELS + 1) | path, (leaf << MOST_LEVELS + 1) | path | 1
            near, far = np.where(homes, d <= mu, d - radius <= mu), np.where(homes, d > mu, d + radius > mu)
            visit = homes & (d <= mu) & (d + radius > mu)
            idx, cell, homes = np.concatenate([idx[near], idx[far], idx[visit]]), np.concatenate([low[near], high[far], high[visit]]), np.concatenate([homes[near], homes[far], np.zeros(int(visit.sum()), bool)])
        for held, more in zip(every, (idx, cell, homes), strict=True):
            held.append(more)
    return np.concatenate(every[0]), np.concatenate(every[1]), np.concatenate(every[2])


class Forest:
    """Least labels of linked points; links come in arrays and are not kept."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            if not (differ := x != y).any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def linked(points: np.ndarray, n_home: int, radius: int, seed: int = 7) -> np.ndarray:
    """The least linked point's index for each point. The first ``n_home`` are at home: every pair with one of them is tested or pruned."""
    forest, rng = Forest(len(points)), np.random.default_rng(seed)
    stack = [(np.arange(n_home), np.arange(len(points)))]
    while stack:
        own, asked = stack.pop()
        if not len(own) or not len(asked):
            continue
        if len(own) > LEAF:
            vp = points[own[rng.integers(len(own))]]
            d, dq = np.bitwise_count(points[own] ^ vp).astype(np.int16), np.bitwise_count(points[asked] ^ vp).astype(np.int16)
            mu = int(np.median(d))
            near = d <= mu
            if near.all():
                mu = int(d.max()) - 1
                near = d <= mu
            if near.any() and not near.all():
                stack += [(own[near], asked[dq - radius <= mu]), (own[~near], asked[dq + radius > mu])]
                continue
        step = max(1, (1 << 17) // len(own))
        for at in range(0, len(asked), step):
            q = asked[at : at + step]
            i, j = np.nonzero(np.bitwise_count(points[q][:, None] ^ points[own][None, :]) <= radius)
            a, b = q[i], own[j]
            forest.link(a[a != b], b[a != b])
    return forest.label


def links(points: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: links that join the fingerprints of ``points`` (distinct, long column fp) as all pairs within ``radius`` would."""
    spark = points.sparkSession
    n = points.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / SHARD)))))
    sample = points.orderBy(F.xxhash64(F.lit(1), "fp")).limit(SAMPLE).select("fp").toArrow()["fp"].to_numpy().view(np.uint64) if depth else np.empty(0, np.uint64)
    tree = shard_tree(sample, depth)

    def deal(deeper: dict[int, int]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                idx, shard, home = route(fps.view(np.uint64), tree, radius, deeper)
                for at in range(0, len(idx), 1 << 18):
                    s = slice(at, at + (1 << 18))
                    yield pa.record_batch([pa.array(shard[s]), pa.array(home[s]), pa.array(fps[idx[s]])], names=["shard", "home", "fp"])

        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        spread = points.select("fp").repartition(parts) if depth else points.select("fp")
        return spread.mapInArrow(run, "shard long, home boolean, fp long")

    def search(group: pa.Table) -> pa.Table:
        home, fps = group["home"].to_numpy(), group["fp"].to_numpy()
        fps = np.concatenate([fps[home], fps[~home]])
        root = linked(fps.view(np.uint64), int(home.sum()), radius)
        tied = root != np.arange(len(fps))
        return pa.table({"a": fps[root[tied]], "b": fps[tied]})

    deeper = {}
    if depth:  # a count per leaf of the sampled tree, a few hundred at most
        for r in deal({}).groupBy("shard").count().filter(F.col("count") > MOST_POINTS).collect():  # a level takes off a third of the points or so
            deeper[r.shard >> MOST_LEVELS + 1] = min(MOST_LEVELS, int(np.ceil(2 * np.log2(r["count"] / MOST_POINTS))))
    return deal(deeper).groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, distinct: bool = False, copies: bool = False) -> DataFrame:
    """doc_id, fp, component_id, least (the least doc_id that has the fingerprint), and copy if asked: one row per input row."""
    each = saved(fingerprints(docs, id_col, text_col, width, distinct, copies), "fingerprints")
    points = saved(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points.select("fp"), radius))
    tied = points.join(roots, points["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    tied = saved(tied, "roots")
    names = saved(tied.groupBy("root").agg(F.min("least").alias("component_id")), "names")  # a table, so that Spark may split a giant root's side
    named = tied.join(names, "root").select("fp", "component_id", "least")
    return each.join(named, "fp").select("doc_id", "fp", "component_id", "least", *(["copy"] if copies else []))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets (sorted distinct hashes) have a Jaccard similarity of ``least``; two empty sets have."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared)


def among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows whose doc_id is in the written table ``ids`` (left_semi) or isn't (left_anti). Texts don't move while the ids are few."""
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, "doc_id", how)


def _near(pairs: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """doc_id, leader: the ``pairs`` of these columns whose texts (doc_id, text of ``docs``) have the similarity ``least``.

    A leader's text is dealt to as many of ``SLOTS`` slots as its documents fill.
    """
    pairs = pairs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot"), "leader")
    pairs = saved(pairs, "proposed")
    asked = saved(pairs.select("doc_id").union(pairs.select(F.col("leader").alias("doc_id"))).distinct(), "asked")
    texts = saved(among(docs, asked, "left_semi"), "texts")
    own = pairs.join(texts, "doc_id")
    first = pairs.select("leader", "slot").distinct().join(texts.select(F.col("doc_id").alias("leader"), F.col("text").alias("first")), "leader")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was, of_first = None, np.unique(shingles(None, shingle))
        for b in batches:
            found = []
            for t, f in zip(b.column(2), b.column(3), strict=True):
                if (f := f.as_py()) != was:
                    was, of_first = f, np.unique(shingles(f, shingle))
                found.append(similar(np.unique(shingles(t.as_py(), shingle)), of_first, least))
            yield b.select([0, 1]).filter(pa.array(found, pa.bool_()))

    return own.join(first, ["leader", "slot"]).select("doc_id", "leader", "text", "first").mapInArrow(judge, pairs.select("doc_id", "leader").schema)


def prefix(hashes: np.ndarray, least: float, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first hashes (distinct) by one order for all texts: two sets of the similarity ``least`` share one of theirs.

    ``often`` (sorted hashes, their ranks) puts frequent ones last; any order is right.
    """
    rank = np.zeros(len(hashes), np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], hashes), len(often[0]) - 1)
        rank = np.where(often[0][at] == hashes, often[1][at], 0)
    return hashes[np.lexsort((hashes, rank))[: _prefix_size(len(hashes), least)]]


def _prefix_size(n: int, least: float) -> int:
    return n - int(np.ceil(least * n - 1e-9)) + 1


def _often(docs: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a share of the documents, sorted, and their counts there; they only order the prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(h.view(np.int64)), pa.array(counts.astype(np.int64))], names=["h", "some"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(np.unique(shingles(t, shingle)))
                if len(held) >= 1024:
                    yield flush()
        if held:
            yield flush()

    some = docs.filter(F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(max(1, min(SAMPLED, n // LEAST_SAMPLED)))) == 0).select("text")
    counted = some.mapInArrow(run, "h long, some long").groupBy("h").agg(F.sum("some").alias("count"))
    top = counted.filter("count > 2").orderBy(F.desc("count"), "h").limit(MOST_OFTEN).toArrow()
    hashes, counts = top["h"].to_numpy().view(np.uint64), top["count"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def sharing(texts: DataFrame, often: tuple[np.ndarray, np.ndarray], shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(prefixes, shared): doc_id, n (the text's distinct shingles), keys (its prefix, in order) of each row of doc_id, text; and key,
    doc_id, n, tag (of the prefix), at (its place there) for the keys that several rows have."""
    kind = texts.select("doc_id", F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("keys")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes = [], []
            for t in b.column(1).to_pylist():
                own = np.unique(shingles(t, shingle))
                keys.append(prefix(own, least, often) if len(own) else own)
                sizes.append(len(own))
            ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), lists], names=kind.names)

    prefixes = saved(texts.select("doc_id", "text").mapInArrow(run, kind), "prefixes")
    keys = prefixes.select("doc_id", "n", F.xxhash64("keys").alias("tag"), F.posexplode("keys").alias("at", "key")).select("key", "doc_id", "n", "tag", "at")
    several = saved(keys.groupBy("key").agg(F.count("*").alias("g")).filter("g > 1").select("key"), "several")  # a table, so that Spark may split a hot key's side
    return prefixes, keys.join(several, "key")


def _mixed(shared: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``shared`` with each row's root by ``links``; and key, g (its rows), top, main (its largest component, and how many rows that has) of the keys of several components."""
    roots = saved(components(links.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))), "roots")
    named = saved(shared.join(roots, shared["doc_id"] == roots["node"], "left").select("key", "doc_id", "n", "tag", "at", F.coalesce("root", "doc_id").alias("root")), "named")
    each = named.groupBy("key", "root").agg(F.count("*").alias("c"))
    per = each.groupBy("key").agg(F.sum("c").alias("g"), F.count("*").alias("kinds"), F.max(F.struct("c", (-F.col("root")).alias("least"))).alias("most"))
    return named, saved(per.filter("kinds > 1").select("key", "g", F.col("most.c").alias("top"), (-F.col("most.least")).alias("main")), "mixed")


def _met(named: DataFrame, mixed: DataFrame, more: list[str], least: float) -> DataFrame:
    """Rows (own columns, and others' behind an underscore) that have a key in common and aren't joined; one of them is outside the key's largest component."""
    cut = F.ceil((F.col("g") - F.col("top")) / HOT)
    inside = named.join(mixed, "key").withColumn("in_main", F.col("root") == F.col("main"))
    columns = ["doc_id", "n", "root", *more]
    own = inside.filter("NOT in_main").select("key", *columns, F.pmod(F.xxhash64("doc_id"), cut).alias("part"))
    other = inside.select("key", *[F.col(c).alias(f"_{c}") for c in columns], "in_main", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)).alias("part"))
    alike = (F.least("n", "_n") >= least * F.greatest("n", "_n") - 1e-9) & (F.col("root") != F.col("_root"))
    return own.join(other, ["key", "part"]).filter(alike & (F.col("in_main") | (F.col("_doc_id") < F.col("doc_id"))))


def _enough(shared: Column, least: float) -> Column:
    """Whether texts of n and _n shingles can have the similarity ``least`` if their prefixes share so many."""
    return shared + F.ceil(least * F.greatest("n", "_n") - 1e-9) - 1 >= least / (1 + least) * (F.col("n") + F.col("_n")) - 1e-9


def _by_small_keys(named: DataFrame, mixed: DataFrame, least: float) -> DataFrame:
    """doc_id, leader: pairs that share enough keys, by counting where they meet; right for pairs that share no large key."""
    met = _met(named, mixed.filter(F.col("g") <= LARGE), [], least)
    ordered = met.select(F.greatest("doc_id", "_doc_id").alias("doc_id"), F.least("doc_id", "_doc_id").alias("leader"), F.least("n", "_n").alias("n"), F.greatest("n", "_n").alias("_n"))
    return ordered.groupBy("doc_id", "leader", "n", "_n").count().filter(_enough(F.col("count"), least)).select("doc_id", "leader")


def _in_large_keys(named: DataFrame, large: DataFrame, least: float) -> DataFrame:
    """Rows that meet in large keys (see ``_met``): once, at the first that both have among their first ``EARLY`` (or again behind those), and only if they can share enough keys.

    A row carries its first large keys (``own``), how many more it has (``more``)
    and how many of its keys that other rows have are not large (``rest``). Two rows
    can share no more keys than those in both of ``own``, all of ``more`` and the lesser ``rest``.
    """
    rows = saved(named.join(large.select("key"), "key"), "large")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"])
    first = rows.groupBy("doc_id", "tag").agg(in_order.alias("keys")).select("doc_id", "tag", F.slice("keys", 1, EARLY).alias("own"), F.size("keys").alias("held"))
    first = saved(first, "first")
    texts = first.select("doc_id", "tag")
    every = named.join(F.broadcast(texts) if texts.count() <= SENT else texts, ["doc_id", "tag"], "left_semi").groupBy("doc_id", "tag").agg(F.count("*").alias("every"))
    first = saved(first.join(every, ["doc_id", "tag"]).select("doc_id", "tag", "own", (F.col("held") - F.size("own")).alias("more"), (F.col("every") - F.col("held")).alias("rest")), "first")
    rows = saved(rows.join(first, ["doc_id", "tag"]).select("key", "doc_id", "n", "root", "own", "more", "rest"), "early")
    both = F.array_intersect("own", "_own")  # in the common order
    most = F.col("more") + F.col("_more") + F.least("rest", "_rest")
    can = _enough(F.least(F.size("own"), F.size("_own")) + most, least) & _enough(F.size(both) + most, least)
    return _met(rows, large, ["own", "more", "rest"], least).filter(can & F.coalesce(F.get(both, 0) == F.col("key"), F.lit(True)))


def _by_large_keys(named: DataFrame, mixed: DataFrame, prefixes: DataFrame, least: float) -> DataFrame:
    """doc_id, leader: pairs that share a large key and enough keys in all."""
    met = _in_large_keys(named, mixed.filter(F.col("g") > LARGE), least)
    pairs = met.select(F.greatest("doc_id", "_doc_id").alias("doc_id"), F.least("doc_id", "_doc_id").alias("leader")).distinct()
    both = pairs.join(prefixes, "doc_id").join(prefixes.select(F.col("doc_id").alias("leader"), F.col("n").alias("_n"), F.col("keys").alias("_keys")), "leader")
    return both.filter(_enough(F.size(F.array_intersect("keys", "_keys")), least)).select("doc_id", "leader")


def remaining_links(texts: DataFrame, links: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, leader: more pairs of the similarity ``least``, which with ``links`` (a written table of such pairs) join all documents that any chain of such pairs does.

    Two such texts share a shingle of their prefixes (see ``prefix``). Only rows of
    a key that aren't joined yet need to be compared, and all of them are: each
    row outside the key's largest component with all rows of other components.
    While the keys of over ``LARGE`` rows would make over ``PAIRS`` pairs a row,
    rounds compare such rows with ``HEADS`` rows of the largest component, those
    that most of their keys have, and join the alike, until a round finds none. So a large group of copies is compared along a star,
    and every link to another group is still found, whatever was joined before.
    Two rows meet in large keys once, at the first that both have, and are a pair
    only if they can share enough keys. Shingles outside both
    prefixes can be shared by as many as the longer rest has, so pairs that have
    too few keys in common for that are left out before any text is fetched.
    """
    prefixes, shared = sharing(texts, _often(texts, texts.count(), shingle), shingle, least)
    shared, found = saved(shared, "shared"), []
    alike = F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9
    while True:
        named, mixed = _mixed(shared, links)
        large = F.col("g") > LARGE
        pairs, rows = mixed.agg(F.coalesce(F.sum(F.when(large, (F.col("g") - F.col("top")) * F.col("g"))), F.lit(0)), F.sum("g")).first()
        if not rows or pairs <= PAIRS * rows:
            break
        inside = named.join(mixed.filter(large), "key").withColumn("in_main", F.col("root") == F.col("main"))
        drawn = F.array(F.min(F.struct("doc_id", "n")), *[F.min_by(F.struct("doc_id", "n"), F.xxhash64(F.lit(i), "doc_id")) for i in range(1, HEADS)])  # the same ones for most keys of a group
        heads = inside.filter("in_main").groupBy("key").agg(drawn.alias("heads")).select("key", F.posexplode("heads").alias("at", "head"))
        heads = saved(heads.select("key", "at", F.col("head.doc_id").alias("leader"), F.col("head.n").alias("m")), "heads")
        often = inside.filter("NOT in_main").select("key", "doc_id", "n").join(heads, "key").filter(alike).groupBy("doc_id", "at", "leader").count()
        best = often.groupBy("doc_id", "at").agg(F.max(F.struct("count", "leader")).alias("best")).select("doc_id", F.col("best.leader").alias("leader")).distinct()
        near = saved(_near(best, texts, shingle, least), "near")
        if near.isEmpty():
            break
        found.append(near)
        links = saved(links.union(near), "joined")
    if rows:
        pairs = _by_small_keys(named, mixed, least).union(_by_large_keys(named, mixed, prefixes, least))
        found.append(saved(_near(pairs.distinct(), texts, shingle, least), "near"))
    return reduce(DataFrame.union, found) if found else links.limit(0)


def verified_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1, radius: int = 2, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id of each document of a group but the least one, distinct.

    Documents are linked if their texts are equal or their sets of
    ``shingle``-word shingles have a Jaccard similarity of ``least``; a group is
    what links join, directly or over others. That is the whole definition: all
    documents are compared before any goes, so the result depends neither on
    order nor on sizes. Fingerprints of the set of ``width``-word shingles propose
    groups, whose documents are compared with the group's first one and the first
    one with their fingerprint: true links, which join most copies along stars.
    ``remaining_links`` then finds every link between what isn't joined yet, at
    any distance of the fingerprints. Equal texts are judged once. Rows without
    an id are never in it; rows that share an id are judged together. An empty
    table gives an empty result. What was written on the way is deleted; the ids stay.
    """
    start = mark()
    each = saved(near_duplicates(docs, id_col, text_col, width, radius, True, True).filter("doc_id IS NOT NULL"), "groups")
    firsts = saved(each.groupBy("component_id", "least", "fp", "copy").agg(F.min("doc_id").alias("doc_id")), "firsts")
    leader = F.explode(F.array_distinct(F.array("component_id", "least"))).alias("leader")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    texts = saved(among(texts, saved(firsts.select("doc_id").distinct(), "ids"), "left_semi"), "different")
    links = saved(_near(firsts.select("doc_id", leader).filter("leader <> doc_id").distinct(), texts, shingle, least), "near")
    links = links.union(remaining_links(texts, links, shingle, least))
    roots = saved(components(links.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))), "roots")
    named = saved(firsts.join(roots, firsts["doc_id"] == roots["node"], "left").select("fp", "copy", F.coalesce("root", "doc_id").alias("root")), "named")
    gone = each.join(named, ["fp", "copy"]).filter(F.col("doc_id") != F.col("root")).select("doc_id")
    lost, path = saved_at(gone.distinct(), "copies")
    clear(docs.sparkSession, start, [path])
    return lost
