"""Runs (maximal periodic stretches of words) by the longest-previous-factor array.

Words are symbols of their own document, so the documents of an Arrow batch are
worked on as one array: suffix ranks by doubling (only suffixes that aren't yet
told apart are sorted again), LCP of neighbours in the suffix array, the longest
previous factor of each position from its nearest neighbours that start earlier,
and from those the LZ blocks. Main's extensions find every run that crosses or
touches a block's border: words a period apart are compared to the right and to
the left of the border, for each period that such a run can have (up to the
lengths of the blocks on both sides, so all borders together take linear work).
A run strictly inside a block is a copy of an earlier one; runs are bucketed by
start, and each block, in order, copies those inside its earlier occurrence.

No rows move between tasks and nothing is compared across documents; memory is
that of a batch, or of one document where that is longer: four bytes a word and
doubling. Defined results: null, empty and word-less texts have no run and an
empty collapsed text; rows with a null doc_id and repeated rows are rows like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that are worked on as one array, about; a longer document is one of its own.
WORDS = 200_000
RUNS = "array<struct<start: long, length: long, period: long>>"


class Suffixes:
    """Ranks of the 1-, 2-, 4- ... word stretches at each position, and the suffix array. The symbols end in one that occurs once, as each document does."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable")
        held = symbols[self.order]
        first = np.r_[True, held[1:] != held[:-1]]
        rank = np.empty(n, np.int32)
        rank[self.order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.levels = [rank]
        open_ = np.flatnonzero(~(first & np.r_[first[1:], True]))  # places of the order whose stretch isn't alone
        width = 1
        while len(open_):
            rank, at = self.levels[-1].copy(), self.order[open_]
            key = rank[at].astype(np.int64) * n + self.levels[-1][at + width]
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            first = np.r_[True, key[1:] != key[:-1]]
            self.order[open_] = at
            rank[at] = open_[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            open_ = open_[~(first & np.r_[first[1:], True])]
            self.levels.append(rank)
            width *= 2

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that are the same from ``a`` and from ``b`` on (different positions)."""
        a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = np.where(self.levels[k][a] == self.levels[k][b], 1 << k, 0)
            a, b, length = a + step, b + step, length + step
        return length

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that are the same up to ``a`` and up to ``b``, both included; positions below zero have none."""
        a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a - (1 << k) + 1, b - (1 << k) + 1
            fits = (x >= 0) & (y >= 0)
            step = np.where(fits & (self.levels[k][np.where(fits, x, 0)] == self.levels[k][np.where(fits, y, 1)]), 1 << k, 0)
            a, b, length = a - step, b - step, length + step
        return length


def _nearest_earlier(order: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of ``order``: the nearest place before it with a lesser position, and the least of ``shared`` on the way (zero where nothing is).

    Pointers jump over what their target has skipped, all at once, while they share something.
    """
    to, least = np.arange(-1, len(order) - 1), shared.copy()
    active = np.flatnonzero(least)
    while len(active := active[order[to[active]] > order[active]]):
        via = to[active]
        least[active] = np.minimum(least[active], least[via])
        to[active] = to[via]
        active = active[least[active] > 0]
    return to, least


def previous_factors(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(length, source): the longest stretch from each position that also starts earlier, and one place where it does."""
    order, n = s.order, len(s.order)
    shared = np.zeros(n, np.int64)
    shared[1:] = s.ahead(order[:-1], order[1:])
    up, most_up = _nearest_earlier(order, shared)
    down, most_down = _nearest_earlier(order[::-1], np.r_[0, shared[1:][::-1]])
    down, most_down = n - 1 - down[::-1], most_down[::-1]
    above = most_up >= most_down
    length, source = np.empty(n, np.int64), np.empty(n, np.int64)
    length[order] = np.where(above, most_up, most_down)
    source[order] = order[np.where(above, np.maximum(up, 0), np.minimum(down, n - 1))]
    return length, source


def _border_runs(s: Suffixes, at: np.ndarray, before: np.ndarray, after: np.ndarray, shortest: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs that cross or touch the borders ``at``; ``before`` and ``after`` are the lengths of the blocks there."""
    counts = np.r_[before + after, after]
    border = np.repeat(np.r_[at, at], counts)
    period = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    left = np.repeat(np.r_[np.zeros(len(at)), np.ones(len(at))], counts) == 0  # the period before the border, or behind it
    a, b = np.where(left, border - period, border), np.where(left, border, border + period)
    # such a run shares so many words on one side of the border at least; most pairs are settled by one comparison
    need = max(1, min(max(shortest - p, (exponent - 1) * p) for p in range(1, shortest + 1)))
    level = min(max(0, (-(-need // 2)).bit_length() - 1), len(s.levels) - 1)
    width, ranks, n = 1 << level, s.levels[level], len(s.order)
    fits = (a >= 0) & (b < n)
    a, b, period = a[fits], b[fits], period[fits]
    back = a >= width
    likely = (ranks[a] == ranks[b]) | back & (ranks[np.where(back, a - width, 0)] == ranks[np.where(back, b - width, 1)])
    a, b, period = a[likely], b[likely], period[likely]
    right, behind = s.ahead(a, b), s.behind(a - 1, b - 1)
    length = right + behind + period
    kept = length >= np.maximum(shortest, exponent * period)
    return (a - behind)[kept], length[kept], period[kept]


def _alone(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its least period."""
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    return start[first], length[first], period[first]


def runs_of(texts: list[np.ndarray], shortest: int = 24, exponent: int = 3) -> list[list[tuple[int, int, int]]]:
    """The (start, length, period) of all runs of ``shortest`` words and ``exponent`` periods at least in each list of symbols, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if exponent < 2 or shortest < 1:
        raise ValueError("a run has two periods at least")
    if not any(map(len, texts)):
        return found
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1  # where each document's end symbol stands
    begins = ends - sizes
    symbols, base = np.empty(ends[-1] + 1, np.int64), len(texts)
    symbols[ends] = np.arange(len(texts))
    for t, i in zip(texts, begins.tolist(), strict=True):
        if len(t):
            symbols[i : i + len(t)] = t + base
            base += int(t.max()) + 1
    s = Suffixes(symbols)
    lengths, sources = previous_factors(s)
    steps, sources = lengths.tolist(), sources.tolist()
    starts = []
    for i, stop in zip(begins.tolist(), ends.tolist(), strict=True):
        while i < stop:
            starts.append(i)
            i += steps[i] or 1
        starts.append(stop)
    borders = np.array(starts)
    after = np.maximum(lengths[borders], 1)
    after[np.isin(borders, ends, assume_unique=True)] = 0
    before = np.r_[0, after[:-1]]
    start, length, period = _alone(*_border_runs(s, borders, before, after, shortest, exponent))
    if not len(start):
        return found
    buckets: dict[int, list[tuple[int, int]]] = {}
    for i, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        buckets.setdefault(i, []).append((n, p))
    touched = np.unique(np.searchsorted(ends, start))
    for d in touched.tolist():
        lo, hi = np.searchsorted(borders, (begins[d], ends[d]))
        for k in range(lo, hi):
            i, n = starts[k], int(after[k])
            if n < shortest + 2:
                continue
            source = sources[i]
            for j in range(source + 1, source + n - shortest):
                for m, p in buckets.get(j, ())[:] if j in buckets else ():
                    if j + m < source + n and (m, p) not in (own := buckets.setdefault(j + i - source, [])):
                        own.append((m, p))
        own = ((i - begins[d], m, p) for i in range(begins[d], ends[d]) if i in buckets for m, p in buckets[i])
        found[d] = sorted(((int(i), m, p) for i, m, p in own), key=lambda r: (r[0], r[2]))
    return found


def symbols_of(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one space apart, without those that a run has behind its first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 24, exponent: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start and period), collapsed (the text without repeated periods) per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(RUNS).alias("runs"), F.col("text").alias("collapsed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in b.column(1).to_pylist()]
            cuts, held = [0], 0
            for k, t in enumerate(texts):
                if held and held + len(t) > WORDS:
                    cuts.append(k)
                    held = 0
                held += len(t)
            for i, j in pairwise([*cuts, len(texts)]):
                found = runs_of([symbols_of(t) for t in texts[i:j]], shortest, exponent)
                short = [collapsed(t, r).decode("utf-8", "surrogatepass") for t, r in zip(texts[i:j], found, strict=True)]
                runs = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in found], of_run)
                yield pa.record_batch([b.column(0)[i:j], pa.array(map(len, texts[i:j]), pa.int64()), runs, pa.array(short, b.column(1).type)], names=kind.names)

    return rows.mapInArrow(run, kind)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: one text in ten, told by the id's checksum, goes on from some word with a period of its own words; rows without an id stay as they are."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col(id_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    changed = F.array_join(F.transform(at, lambda i: F.get("w", place(i))), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, and checksums of the runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct((r.length / r.period).alias("x"), (-r.start).alias("s"), (-r.period).alias("p"), r.length.alias("n"))))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n")))))
    rows = found.withColumn("best", best)
    period = -F.col("best.p")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), period.alias("period"),
        F.expr("1000 * best.n div -best.p").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
