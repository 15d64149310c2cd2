"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared as lower-case letters and digits, all
else being one blank. An item of m characters may differ from a passage by
e = floor(m * edit_rate) edits; by the q-gram lemma a passage within e edits
shares at least m - q + 1 - q*e of the item's q-grams, at diagonals (text
position less item position) that differ by at most e from one another. Shared
q-grams are counted in diagonal bands of width 2*(e+1) that overlap by half, so
that one band holds all of a passage's. Bands that reach the bound are verified
by a banded alignment of the item, free at both ends of the text.

The items are the query set: their q-gram index is built in blocks of at most
``BLOCK_CHARS`` characters, the only thing that is sent to the executors.

Defined results: null texts and null or empty items match nothing. Items shorter
than q are matched as they are, at word borders. Equal items are reported each.
Rows with a null doc_id take part; repeated rows are reported each. Long texts
are searched whole, in overlapping blocks. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 8_000_000
BLOCK_TEXT = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _folding() -> np.ndarray:
    """Each code point's lower-case form if it is a letter or digit, else a blank."""
    low = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalnum():
            low[i] = ord(c.lower()) if len(c.lower()) == 1 else i
    return low


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The comparable characters, and the place of each in the text."""
    folded = _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    solid = folded != 32
    keep = np.flatnonzero(solid | np.r_[False, solid[:-1]]) if len(folded) else np.empty(0, np.int64)
    if len(keep) and not solid[keep[-1]]:
        keep = keep[:-1]
    return folded[keep], keep


def _hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram (q a power of two)."""
    h, base, width = chars.astype(np.uint64) * _MIX, 0x100000001B3, 1
    while width < q:
        h = h[: len(h) - width] * np.uint64(base) + h[width:] if len(h) > width else h[:0]
        h ^= h >> np.uint64(29)
        base, width = (base * base | 1) & 0xFFFFFFFFFFFFFFFF, 2 * width
    return h


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float, q: int) -> None:
        self.q, self.ids, self.chars, self.edits, self.least = q, [], [], [], []
        hashes, item, place = [], [], []
        self.short: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            chars, _ = normalise(text)
            m = len(chars)
            if m < q:
                if m:
                    self.short.append((item_id, chars))
                continue
            e = min(int(m * edit_rate), (m - q) // q)
            h = _hashes(chars, q)
            hashes.append(h)
            item.append(np.full(len(h), len(self.ids), np.int64))
            place.append(np.arange(len(h)))
            self.ids.append(item_id)
            self.chars.append(chars)
            self.edits.append(e)
            self.least.append(m - q + 1 - q * e)
        self.edits_of, self.least_of = np.array(self.edits, np.int64), np.array(self.least, np.int64)
        if hashes:
            h = np.concatenate(hashes)
            by = np.argsort(h, kind="stable")
            self.item, self.place = np.concatenate(item)[by], np.concatenate(place)[by]
            self.keys, self.first = np.unique(h[by], return_index=True)
            self.stop = np.r_[self.first[1:], len(h)]
            self.bits = max(16, int(np.ceil(np.log2(32 * len(self.keys)))))
            self.seen = np.zeros(1 << self.bits, bool)
            self.seen[self._slot(self.keys)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * _MIX) >> np.uint64(64 - self.bits)

    def hits(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item number, diagonal) of each pair of equal q-grams."""
        h = _hashes(chars, self.q)
        at = np.flatnonzero(self.seen[self._slot(h)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        at, k = at[same], k[same]
        n = self.stop[k] - self.first[k]
        rows = np.repeat(self.first[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(k) else k
        return self.item[rows], np.repeat(at, n) - self.place[rows]

    def regions(self, chars: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item number, first and last diagonal) of the bands that reach their item's bound."""
        if not self.ids or len(chars) < self.q:
            return
        item, diagonal = self.hits(chars)
        enough = np.bincount(item, minlength=len(self.ids)) >= self.least_of
        item, diagonal = item[enough[item]], diagonal[enough[item]]
        if not len(item):
            return
        half = self.edits_of[item] + 1
        low = diagonal // half
        keys = np.concatenate([(item << 40) + low + (1 << 30), (item << 40) + low - 1 + (1 << 30)])
        bands, counts = np.unique(keys, return_counts=True)
        done = -1
        reached = bands[counts >= self.least_of[bands >> 40]].tolist()
        for band, after in zip(reached, [*reached[1:], -1], strict=False):
            if band == done:
                continue
            i, b = band >> 40, (band & ((1 << 40) - 1)) - (1 << 30)
            e, m = int(self.edits_of[i]), len(self.chars[i])
            two = after == band + 1 and 6 * e + 3 < m  # passages of both bands overlap: one alignment finds the best
            done = after if two else -1
            yield i, b * (e + 1), (b + 2 + two) * (e + 1) - 1


def align(item: np.ndarray, text: np.ndarray, first: int, last: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole item within the diagonals, None if it takes too many edits."""
    low, width, far = first - edits, last - first + 1 + 2 * edits, 1 << 20
    cols = np.arange(width)
    reach = low + np.arange(width + len(item) + 1)  # at row i, column c stands for text position reach[c + i]
    inside = (reach >= 0) & (reach < len(text))
    used = np.zeros(len(reach), text.dtype)  # no comparable character is 0
    used[inside] = text[reach[inside]]
    wall = np.where((reach < 0) | (reach > len(text)), far, 0)
    cost, origin = wall[:width].copy(), reach[:width].copy()
    skip, begun = np.full(width, far), np.zeros(width, np.int64)
    for i, c in enumerate(item):
        straight = cost + (used[i : i + width] != c)
        skip[:-1] = cost[1:] + 1  # an item character that the text lacks
        begun[:-1] = origin[1:]
        best = np.minimum(straight, skip) + wall[i + 1 : i + 1 + width]
        begun = np.where(straight <= skip, origin, begun)
        run = np.minimum.accumulate(best - cols) + cols  # text characters that the item lacks
        changed = run < best
        if changed.any():
            begun = begun[np.maximum.accumulate(np.where(changed, 0, cols))]
        cost, origin = run, begun.copy()
    k = int(cost.argmin())
    return (int(cost[k]), max(0, int(origin[k])), low + k + len(item)) if cost[k] <= edits else None


def exact(item: np.ndarray, text: np.ndarray, first: int, last: int) -> int:
    """Where the item stands unchanged on one of the diagonals, -1 if nowhere."""
    first = max(first, 0)
    window, sought, at = text[first : max(first, last + len(item))].tobytes(), item.tobytes(), -1
    while (at := window.find(sought, at + 1)) >= 0:
        if at % item.itemsize == 0:
            return first + at // item.itemsize
    return -1


def matches(index: Index, text: str) -> list[tuple[int, int, int, int]]:
    """(item id, start, end, edits) of a text's passages, in code points; the best of those that overlap."""
    chars, places = normalise(text)
    longest = max(map(len, index.chars), default=0)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for at in range(0, max(1, len(chars)), BLOCK_TEXT):
        block = chars[at : at + BLOCK_TEXT + 2 * longest + 64]
        for i, first, last in index.regions(block):
            e, item = index.edits[i], index.chars[i]
            if (same := exact(item, block, first - e, last + e)) >= 0:
                found.setdefault(i, []).append((0, at + same, at + same + len(item)))
            elif hit := align(item, block, first, last, e):
                found.setdefault(i, []).append((hit[0], at + hit[1], at + hit[2]))
        if at + len(block) >= len(chars):
            break
    out = []
    span = lambda a, b: (int(places[a]), int(places[max(a, b - 1)]) + 1)
    for i, hits in found.items():
        taken: list[tuple[int, int]] = []
        for d, a, b in sorted(set(hits)):
            if b > a and all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((index.ids[i], *span(a, b), d))
    if index.short:
        joined = "\x20" + chars.tobytes().decode("utf-32-le", "surrogatepass") + "\x20"
        for item_id, c in index.short:
            word, pos = "\x20" + c.tobytes().decode("utf-32-le", "surrogatepass") + "\x20", -1
            while (pos := joined.find(word, pos + 1)) >= 0:
                out.append((item_id, *span(pos, pos + len(c)), 0))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one on the driver at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL").toLocalIterator():
        held.append((r.i, r.t))
        size += len(r.t)
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_rate: float = 0.08, q: int = 8) -> DataFrame:
    """doc_id, item_id, start, end, edits: a row for each passage of a document that matches an item."""
    kind = docs.select(F.col(id_col).alias("doc_id")).schema
    kind = kind.add("item_id", benchmark.schema[item_col].dataType)
    for name in ("start", "end", "edits"):
        kind = kind.add(name, "long")
    to_arrow = pa.int64() if kind["item_id"].dataType.typeName() == "long" else None
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    out = texts.sparkSession.createDataFrame([], kind)
    for n, block in enumerate(blocks(benchmark, item_col, item_text_col)):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, edit_rate, q)
            for b in batches:
                rows = [(i, *m) for i, t in enumerate(b.column(1).to_pylist()) for m in matches(index, t)]
                if rows:
                    at, item, *spans = zip(*rows, strict=True)
                    yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array(item, to_arrow), *(pa.array(s, pa.int64()) for s in spans)], names=["doc_id", "item_id", "start", "end", "edits"])

        found = texts.mapInArrow(run, kind)
        out = found if n == 0 else out.union(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_rate: float = 0.08, q: int = 8) -> DataFrame:
    """The rows of ``docs`` without a passage of the benchmark: rows, not ids, are judged, and no column is added."""
    at, out = docs.columns.index(text_col), docs
    for block in blocks(benchmark, item_col, item_text_col):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, edit_rate, q)
            for b in batches:
                clean = [t is None or not matches(index, t) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
