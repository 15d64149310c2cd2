"""Shards of equal bytes by histogram sort.

Rows have a key: the order column, then a hash of the text, as one number of 128
bits (192 with a row's number behind them). Splitters are found without moving
rows: probes are laid evenly into the key ranges in which a wanted splitter must
lie, one pass counts the exact bytes and rows below every probe (each task sends
the sums of its buckets, no rows), and the ranges shrink to the probes around the
wanted share, until a splitter is within the tolerance or no other row lies
between its bounds. Then rows are exchanged once, by ranges that are finer than
shards where shards are large: a range's place in its shard is known from the
counts, so slots are numbered in each range alone.

Only key, size and number are read again for a pass (from a written table);
probes are a few thousand numbers, and there are ``MOST_RANGES`` ranges at most.
Equal texts with equal order values are neighbours. Where one key has so many rows that a
splitter must fall among them, the rows are written once with their number,
which then tells them apart.

Defined results: null text has no bytes and hashes like no other; rows without an
order value come first; repeated rows are rows like any other; other columns are
passed through; an empty table gives an empty result. A row larger than a shard's share
can't be cut: shards differ by the largest row at most.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import saved, spare

#: Bytes of a range that one task sorts and numbers, about; the most ranges beside the shards.
RANGE_BYTES, MOST_RANGES = 256 << 20, 1 << 16
#: Probes of a pass, about (four a wanted splitter at least).
PROBES = 2048
#: What a row costs beside its text.
ROW_BYTES = 16
OFFSET = 1 << 63


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _encoded(columns: list[np.ndarray]) -> np.ndarray:
    """Keys as byte strings that sort as the columns of longs do."""
    out = np.empty((len(columns[0]), 8 * len(columns)), np.uint8)
    for i, c in enumerate(columns):
        out[:, 8 * i : 8 * i + 8] = (c.astype(np.int64).view(np.uint64) ^ np.uint64(OFFSET)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view(f"S{8 * len(columns)}").ravel()


def _as_bytes(probes: list[int], width: int) -> np.ndarray:
    most = (1 << 8 * width) - 1
    return np.frombuffer(b"".join(min(p, most).to_bytes(width, "big") for p in probes), f"S{width}")


def counted(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """The exact bytes and rows of ``keys`` (longs, then size) below each of the sorted probes; one pass."""
    width = 8 * (len(keys.columns) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, sums = _as_bytes(probes, width), np.zeros((2, len(probes) + 1), np.int64)
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            at = np.searchsorted(cuts, _encoded(columns[:-1]), "right")
            sums[0] += np.bincount(at, columns[-1], sums.shape[1]).astype(np.int64)
            sums[1] += np.bincount(at, minlength=sums.shape[1])
        some = np.flatnonzero(sums[1])
        yield pa.record_batch([pa.array(some), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["bucket", "bytes", "n"])

    sums = np.zeros((len(probes) + 1, 2), object)
    for r in keys.mapInArrow(run, "bucket long, bytes long, n long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect():
        sums[r.bucket] = r.bytes, r.n
    below = np.cumsum(sums, axis=0)[:-1]
    return [(int(x), int(n)) for x, n in below]


def splitters(keys: DataFrame, targets: list[int], slack: list[float], low: int, high: int, total: tuple[int, int]) -> tuple[list[tuple[int, int]], bool]:
    """(key, rows below it) for each target, in order: the least key whose rows make about so many bytes; and whether all could be told apart.

    A splitter is done when the bytes below it are within the target's slack; or
    when one row lies between its bounds, and then it is the nearer bound (the lower one of two as near).
    """
    known, below = [low, high], {low: (0, 0), high: total}
    chosen, apart = {}, True
    while True:
        sums, wanted = [below[k][0] for k in known], {}
        for i, t in enumerate(targets):
            if i in chosen:
                continue
            at = min(max(bisect.bisect_right(sums, t) - 1, 0), len(known) - 2)
            lo, hi = known[at], known[at + 1]
            near = lo if t - below[lo][0] <= below[hi][0] - t else hi
            rows = below[hi][1] - below[lo][1]
            if abs(below[near][0] - t) <= slack[i] or rows <= 1 or hi - lo <= 1:
                apart &= abs(below[near][0] - t) <= slack[i] or rows <= 1
                chosen[i] = near
            else:
                wanted.setdefault((lo, hi), []).append(i)
        if not wanted:
            return [(chosen[i], below[chosen[i]][1]) for i in range(len(targets))], apart
        each = max(4, PROBES // sum(map(len, wanted.values())))
        probes = sorted(_laid(wanted, each))
        for p, b in zip(probes, counted(keys, probes), strict=True):
            below[p] = b
        known = sorted(below)


def _laid(wanted: dict[tuple[int, int], list[int]], each: int) -> set[int]:
    """Probes laid evenly into each range, ``each`` a wanted splitter."""
    found = set()
    for (lo, hi), own in wanted.items():
        n = each * len(own)
        found.update(p for j in range(1, n + 1) if lo < (p := lo + (hi - lo) * j // (n + 1)) < hi)
    return found


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows with size, shard and slot (named with underscores before where such a column is there): shard sizes are equal within
    ``tolerance`` of a share at each splitter, or as near as whole rows allow."""
    if shards < 1:
        raise ValueError("there is one shard at least")
    one, two, three, size_, range_, offset_ = spare(docs.columns, "order", "hash", "row", "size", "range", "offset")
    shard_, slot_ = spare([*docs.columns, one, two, three, size_, range_, offset_], "shard", "slot")
    text = F.col(text_col)
    keyed = docs.withColumns({one: F.coalesce(F.col(id_col).cast("long"), F.lit(-OFFSET)), two: F.xxhash64(F.isnull(text), text), size_: byte_size(text)})
    names = [one, two]
    while True:
        keys = saved(keyed.select(*names, size_), "keys")
        total = keys.agg(F.coalesce(F.sum(size_), F.lit(0)).alias("bytes"), F.count("*").alias("n"), F.min(one).alias("low"), F.max(one).alias("high")).first()
        if not total.n:
            return keyed.select(*docs.columns, size_, F.lit(0).alias(shard_), F.lit(0).cast("long").alias(slot_))
        bits = 64 * (len(names) - 1)
        low, high = (total.low + OFFSET) << bits, (total.high + OFFSET + 1) << bits
        finer = max(1, -(-min(MOST_RANGES, -(-total.bytes // range_bytes)) // shards))
        share = total.bytes / (shards * finer)
        targets = [round(share * j) for j in range(1, shards * finer)]
        slack = [tolerance * share * finer if j % finer == 0 else share / 4 for j in range(1, shards * finer)]
        found, apart = splitters(keys, targets, slack, low, high, (total.bytes, total.n))
        if apart or three in names:
            break
        keyed = saved(keyed.withColumn(three, F.monotonically_increasing_id()), "numbered")  # from here on a row keeps its number
        names = [one, two, three]
    cuts = [k for k, _ in found]
    firsts = [0, *(n for _, n in found)]  # rows before each range
    width = 8 * len(names)

    @F.arrow_udf("int")
    def range_of(*columns: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(_as_bytes(cuts, width), _encoded([c.to_numpy(zero_copy_only=False) for c in columns]), "right").astype(np.int32))

    keyed = keyed.withColumn(range_, range_of(*names) if cuts else F.lit(0))
    skipped = [firsts[i] - firsts[i - i % finer] for i in range(len(firsts))]
    offset = F.get(F.array(*(F.lit(x).cast("long") for x in skipped)), F.col(range_)) if finer > 1 else F.lit(0).cast("long")
    number = F.row_number().over(Window.partitionBy(range_).orderBy(*names))
    placed = keyed.withColumn(slot_, offset + number.cast("long") - 1).withColumn(shard_, F.floor(F.col(range_) / finer).cast("int"))
    return placed.select(*docs.columns, size_, shard_, slot_)


def write_shards(docs: DataFrame, shards: int, path: str, **how) -> None:
    """A folder a shard with the rows in the order of their slots; an earlier result at ``path`` is replaced as a whole."""
    placed = shard(docs, shards, **how)
    placed.write.mode("overwrite").partitionBy(placed.columns[-2]).parquet(path)
