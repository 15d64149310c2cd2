"""Language-model scoring with an Elias-Fano n-gram trie.

Level 1 is the vocabulary: the sorted 64-bit hashes of the training words, Elias-
Fano coded, with exact counts; a word's id is its rank. Level k holds, for each
(k-1)-gram in order, the ids of the words seen after it. Monotone pointers give
each context's range of children. The ids of a range are stored on top of the
last value of the range before, so that a whole level is one increasing Elias-
Fano sequence, no larger than what its contexts use of the vocabulary. A child is
found by a successor search relative to its context: the pointers tell where the
range begins and ends, the value before it is added to the word's id, and the
sum is searched for and must lie inside the range. Each child has an 8-bit code
of its smoothed probability, each context one of its back-off weight.

The model is interpolated Witten-Bell: P(w|h) = (c(hw) + T(h) P(w|h')) / (c(h) + T(h)),
T(h) being the number of different words after h, over the unigram distribution
of the base score. The end token also stands before a text's first word. Levels
are written in shards of the shared folder and memory-mapped by the scorers
(where the folder is no file system of the machine, the shards in use are read
and at most ``MOST_OPEN`` are held); counts reach a shard as sorted, packed
arrays, pre-aggregated by each task. A batch's n-grams are looked up once each.

Defined results: null text is the empty text, one end token. Rows with a null
doc_id train and are scored as if the id were the empty text. Repeated rows
count each. Words are told apart by 64-bit hash. With no training rows the
score is the base score over an empty vocabulary. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh, mapped, put

U64 = np.uint64
#: Training tokens (vocabulary: words) that a shard is to hold, about.
SHARD_TOKENS = 2_500_000
END = xxhash.xxh64_intdigest(b"\n", 0)  # a line feed is never a word
BATCH_CHARS = 1 << 22
#: Shards of a level that a worker keeps open.
MOST_OPEN = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens with an end token after each text, tokens per text). Words up to 16 bytes are hashed as arrays, longer ones one by one."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = b"\n".join([*parts, b""])
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(raw) else np.empty(0, np.int64)
    size = np.flatnonzero(space & np.r_[False, ~space[:-1]]) - starts if len(raw) else np.empty(0, np.int64)
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    key = np.lib.stride_tricks.sliding_window_view(padded, 16)[starts].view("<u8")
    mask = lambda n: np.where(n >= 8, U64(0xFFFFFFFFFFFFFFFF), (U64(1) << (8 * np.clip(n, 0, 7)).astype(U64)) - U64(1))
    low, high = key[:, 0] & mask(size), key[:, 1] & mask(size - 8)
    words = _mixed(_mixed(low + size.astype(U64) * U64(0x9E3779B97F4A7C15)) ^ (high * U64(0xC2B2AE3D27D4EB4F)))
    for i in np.flatnonzero(size > 16).tolist():
        words[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + size[i]], 1)
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64) if parts else np.empty(0, np.int64)
    upto = np.searchsorted(starts, ends)  # words before the end of each text
    return np.insert(words, upto, U64(END)), np.diff(np.r_[0, upto]) + 1


def portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of batches with texts of bounded size in all (one text at least)."""
    for b in batches:
        texts, at = b.column(column).to_pylist(), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= BATCH_CHARS):
                size += len(texts[end] or "")
                end += 1
            yield b.slice(at, end - at), texts[at:end]
            at = end


class EliasFano:
    """A monotone sequence of unsigned numbers: packed low bits, and high bits in unary with a select directory."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.l, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def parts(cls, values: np.ndarray, universe: int) -> tuple[list[int], list[np.ndarray]]:
        n = len(values)
        l = min(56, max(0, int(universe // max(n, 1)).bit_length() - 1))
        values = values.astype(U64)
        start = np.arange(n, dtype=U64) * U64(l)
        low = np.zeros((n * l >> 6) + 2, U64)
        if l and n:
            v, word, off = values & U64((1 << l) - 1), (start >> U64(6)).astype(np.int64), start & U64(63)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low[word[first]] = np.add.reduceat(v << off, first)
            over = np.flatnonzero(off + U64(l) > U64(64))
            low[word[over] + 1] |= v[over] >> (U64(64) - off[over])
        buckets = (int(universe) >> l) + 1
        bits = np.zeros(((n + buckets + 63) // 64 + 1) * 64, bool)
        bits[(values >> U64(l)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view(U64)
        zeros = np.r_[0, np.cumsum(64 - np.bitwise_count(high).astype(np.int64))].astype(np.uint32)
        return [n, l, len(low), len(high), len(zeros)], [low, high, zeros]

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero of the high bits."""
        w = np.searchsorted(self.zeros, k.astype(np.uint32), "right") - 1
        x, r, pos = ~self.high[w], (k - self.zeros[w]).astype(np.int64), w.astype(np.int64) << 6
        for s in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(x & U64((1 << s) - 1)).astype(np.int64)
            over = r >= c
            r -= np.where(over, c, 0)
            x = np.where(over, x >> U64(s), x)
            pos += np.where(over, s, 0)
        return pos

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), U64)
        bit = i.astype(U64) * U64(self.l)
        w, off = (bit >> U64(6)).astype(np.int64), bit & U64(63)
        v = self.low[w] >> off
        over = off + U64(self.l) > U64(64)
        v = np.where(over, v | (self.low[w + 1] << ((U64(64) - off) & U64(63))), v)
        return v & U64((1 << self.l) - 1)

    def find(self, q: np.ndarray) -> np.ndarray:
        """The index of each number in the sequence, -1 where it is absent: successor search by halving its bucket."""
        out = np.full(len(q), -1, np.int64)
        if not self.n or not len(q):
            return out
        h = (q >> U64(self.l)).astype(np.int64)
        todo = np.flatnonzero(h < int(self.zeros[-1]))
        h = h[todo]
        start = np.zeros(len(todo), np.int64)
        later = h > 0
        start[later] = self._select0(h[later] - 1) - (h[later] - 1)
        bit = start + h  # a set bit there: the bucket has an item
        some = np.flatnonzero((start < self.n) & ((self.high[np.minimum(bit >> 6, len(self.high) - 1)] >> (bit & 63).astype(U64)) & U64(1) == 1))
        todo, h, low = todo[some], h[some], start[some]
        high = self._select0(h) - h  # the first item behind the bucket
        target = q[todo] & U64((1 << self.l) - 1)
        while len(todo):
            mid = (low + high) >> 1
            v = self._low(mid)
            hit = v == target
            out[todo[hit]] = mid[hit]
            low, high = np.where(v < target, mid + 1, low), np.where(v < target, high, mid)
            on = ~hit & (low < high)
            todo, low, high, target = todo[on], low[on], high[on], target[on]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        w = np.searchsorted(self._ones(), i, "right") - 1
        x, r, pos = self.high[w], (i - self._ones()[w]).astype(np.int64), w.astype(np.int64) << 6
        for s in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(x & U64((1 << s) - 1)).astype(np.int64)
            over = r >= c
            r -= np.where(over, c, 0)
            x = np.where(over, x >> U64(s), x)
            pos += np.where(over, s, 0)
        return ((pos - i).astype(U64) << U64(self.l)) | self._low(i)

    def _ones(self) -> np.ndarray:
        if not hasattr(self, "_before"):
            self._before = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        return self._before


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8-bit codes, their values): 256 bins of equal width, each with the mean of its values, so no value is off by more than a 256th of the range."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(256)
    edges = np.linspace(x.min(), x.max(), 257)[1:-1]
    code = np.searchsorted(edges, x)
    n = np.bincount(code, minlength=256)
    return code.astype(np.uint8), np.bincount(code, x, 256) / np.maximum(n, 1)


def _blob(head: list[int], arrays: list[np.ndarray]) -> bytes:
    pad = lambda b: b + b"\0" * (-len(b) % 8)
    return np.array([len(head), *head], "<i8").tobytes() + b"".join(pad(np.ascontiguousarray(a).tobytes()) for a in arrays)


class Shard:
    """One memory-mapped file of a level."""

    def __init__(self, uri: str, level: int) -> None:
        data = mapped(uri)
        k = int(np.frombuffer(data, "<i8", 1)[0])
        head = np.frombuffer(data, "<i8", k, 8).tolist()
        at = [8 * (k + 1)]

        def take(kind: type, n: int) -> np.ndarray:
            a = np.frombuffer(data, kind, n, at[0])
            at[0] += -(-a.nbytes // 8) * 8
            return a

        def coded(h: list[int]) -> EliasFano:
            return EliasFano(h[0], h[1], take(U64, h[2]), take(U64, h[3]), take(np.uint32, h[4]))

        if level == 1:
            self.keys = coded(head)
            self.counts = take(np.int64, head[0])
        else:
            self.base, self.n_contexts = head[:2]
            self.pointers, self.keys = coded(head[2:7]), coded(head[7:12])
            self.codes, self.values = take(np.uint8, head[7]), take(np.float64, 256)
            self.back, self.back_values = take(np.uint8, self.n_contexts), take(np.float64, 256)

    def children(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each context's child, -1 where there is none: a successor search inside the context's range."""
        begin, end = self.pointers.get(context), self.pointers.get(context + 1).astype(np.int64)
        before = begin > 0
        base = np.zeros(len(begin), U64)
        base[before] = self.keys.get(begin[before].astype(np.int64) - 1) + U64(1)
        at = self.keys.find(base + word.astype(U64))
        return np.where(at < end, at, -1)

    def parents(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, word) of each child."""
        if not hasattr(self, "_ends"):
            self._ends = self.pointers.get(np.arange(1, self.n_contexts + 1)).astype(np.int64)
        context = np.searchsorted(self._ends, nodes, "right")
        begin = np.where(context > 0, self._ends[context - 1], 0)
        base = np.zeros(len(nodes), U64)
        base[begin > 0] = self.keys.get(begin[begin > 0] - 1) + U64(1)
        return context, (self.keys.get(nodes) - base).astype(np.int64)


def shard_path(folder: str, level: int, number: int) -> str:
    return f"{folder}/level{level}-{number:07d}"


class Level:
    """The shards of a level, by number; ``firsts`` are the smallest hash (level 1) or context of each, ``starts`` the nodes before it."""

    def __init__(self, level: int, folder: str, numbers: list[int], firsts: list[int], starts: list[int], size: int) -> None:
        self.level, self.folder, self.size = level, folder, size
        self.numbers, self.starts = np.array(numbers, np.int32), np.array(starts, np.int64)
        self.firsts = np.array(firsts, U64 if level == 1 else np.int64)
        self.open: dict[int, Shard] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def shard(self, i: int) -> Shard:
        if i not in self.open:
            if len(self.open) >= MOST_OPEN:
                del self.open[next(iter(self.open))]
            self.open[i] = self._opened(i)
        return self.open[i]

    def _opened(self, i: int) -> Shard:
        return Shard(shard_path(self.folder, self.level, int(self.numbers[i])), self.level)

    def by_shard(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, places of the keys that it may hold)."""
        if not len(self.numbers):
            return
        s = np.maximum(np.searchsorted(self.firsts, keys, "right") - 1, 0)
        order = np.argsort(s, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
            if len(part):
                yield int(s[part[0]]), part


class Model:
    """The trie as the scorers see it."""

    def __init__(self, tokens: int, vocabulary: Level, levels: list[Level]) -> None:
        self.tokens, self.vocabulary, self.levels = tokens, vocabulary, levels

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words; -1 and 0 where unknown."""
        each, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(each), -1, np.int64), np.zeros(len(each), np.int64)
        for i, at in self.vocabulary.by_shard(each):
            shard = self.vocabulary.shard(i)
            found = shard.keys.find(each[at])
            known = found >= 0
            ids[at[known]] = found[known] + self.vocabulary.starts[i]
            counts[at[known]] = shard.counts[found[known]]
        return ids[back], counts[back]

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the unigram probabilities."""
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.vocabulary.size + 1)))

    def contexts(self, ids: np.ndarray, sizes: np.ndarray, depth: int, score: np.ndarray | None = None) -> np.ndarray:
        """The trie node of the ``depth``-gram that ends at each token, -1 if there is none; adds up ``score`` on the way."""
        first = np.cumsum(sizes) - sizes
        node = ids
        for level in self.levels[: depth - 1]:
            before = np.r_[np.int64(-1), node[:-1]]
            before[first] = self._end if level.level == 2 else -1
            node = np.full(len(ids), -1, np.int64)
            usable = np.flatnonzero(before >= 0)
            context, word, back = self._pairs(before[usable], ids[usable])
            found, weight, prob = self.step(level, context, word)
            node[usable] = found[back]
            if score is not None:
                hit = found[back] >= 0
                score[usable] += weight[back]
                score[usable[hit]] = prob[back][hit]
        return node

    def _pairs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different (context, word) pairs, and each pair's place among them."""
        v = self.vocabulary.size + 1
        if not len(context) or (int(context.max()) + 1) * v >= 1 << 64:  # the pairs don't fit a number: they stay as they are
            return context, word, np.arange(len(context))
        each, back = np.unique(context.astype(U64) * U64(v) + (word + 1).astype(U64), return_inverse=True)
        return (each // U64(v)).astype(np.int64), (each % U64(v)).astype(np.int64) - 1, back

    def step(self, level: Level, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node or -1, back-off weight, log10 probability where there is a node) of words after contexts of a level."""
        node, weight, prob = np.full(len(word), -1, np.int64), np.zeros(len(word)), np.zeros(len(word))
        for i, at in level.by_shard(context):
            shard = level.shard(i)
            c = context[at] - shard.base
            inside = (c >= 0) & (c < shard.n_contexts)
            at, c = at[inside], c[inside]
            weight[at] = shard.back_values[shard.back[c]]
            known = word[at] >= 0
            at, c = at[known], c[known]
            found = shard.children(c, word[at])
            hit = found >= 0
            node[at[hit]] = found[hit] + level.starts[i]
            prob[at[hit]] = shard.values[shard.codes[found[hit]]]
        return node, weight, prob

    @property
    def _end(self) -> int:
        if not hasattr(self, "_end_id"):
            self._end_id = int(self.ids(np.array([END], U64))[0][0])
        return self._end_id

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        hashes, sizes = hashed(texts)
        ids, counts = self.ids(hashes)
        base = self.base(counts)
        score = base.copy()
        self.contexts(ids, sizes, len(self.levels) + 1, score)
        first = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
        return sizes, add((counts > 0).astype(np.int64)), add(base), add(score)


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, as compressed byte planes of the differences."""
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return zstandard.compress(planes(np.diff(keys, prepend=U64(0))) + planes(counts.astype(np.uint32)), 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    n = len(raw) // 12
    keys = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(U64).ravel()
    return np.cumsum(keys, dtype=U64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _dealt(keys_of, texts: DataFrame) -> DataFrame:
    """shard, packed counts: ``keys_of(texts)`` gives (shard, key inside it) arrays; each task sums what it can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for shard, parts in held.items():
                keys, counts = _summed(np.concatenate([h[0] for h in parts]), np.concatenate([h[1] for h in parts]))
                yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([_packed(keys, counts)], pa.binary())], names=["shard", "counts"])
            held.clear()

        for _, part in portions(batches, 0):
            shards, keys = keys_of(part)
            order = np.argsort(shards, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
                if len(at):
                    u, n = np.unique(keys[at], return_counts=True)
                    held.setdefault(int(shards[at[0]]), []).append((u, n.astype(np.int64)))
                    size += len(u)
            if size > 4_000_000:
                yield from flush()
                size = 0
        yield from flush()

    return texts.mapInArrow(run, "shard int, counts binary")


def _built(dealt: DataFrame, make) -> list:
    """Sum a shard's counts and store it; returns rows of (shard, nodes, tokens), in order."""

    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        parts = [_unpacked(b.as_py()) for b in group["counts"]]
        keys, counts = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        make(shard, keys, counts)
        return pa.table([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["shard", "nodes", "tokens"])

    return sorted(dealt.groupBy("shard").applyInArrow(run, "shard int, nodes long, tokens long").collect())


def train(docs: DataFrame, text_col: str = "text", order: int = 2, out: str | None = None) -> Model:
    """Count all rows of ``docs`` and write the trie."""
    if order < 1:
        raise ValueError("order must be 1 at least")
    spark = docs.sparkSession
    out = out or fresh(spark, "trie")
    texts = docs.select(F.col(text_col).alias("text"))
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    step = (1 << 64) // (int(chars / 6 / SHARD_TOKENS) + 1) + 1

    def words_of(part: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        hashes, _ = hashed(part)
        shards = hashes // U64(step) if step < 1 << 64 else np.zeros(len(hashes), U64)
        return shards.astype(np.int32), hashes - shards * U64(min(step, (1 << 64) - 1))

    def vocabulary_shard(shard: int, keys: np.ndarray, counts: np.ndarray) -> None:
        head, arrays = EliasFano.parts(keys, step)
        put(shard_path(out, 1, shard), _blob(head, [*arrays, counts]))

    rows = _built(_dealt(words_of, texts), vocabulary_shard)
    starts = np.r_[0, np.cumsum([r.nodes for r in rows])].tolist()
    vocabulary = _Vocabulary(1, out, [r.shard for r in rows], [r.shard * step for r in rows], starts[:-1], starts[-1])
    model = Model(sum(r.tokens for r in rows), vocabulary, [])
    for level in range(2, order + 1):
        contexts = starts[-1]
        per = max(1, -(-contexts // max(1, model.tokens // SHARD_TOKENS + 1)))
        rows = _level(model, texts, level, contexts, per, out)
        starts = np.r_[0, np.cumsum([r.nodes for r in rows])].tolist()
        model.levels.append(Level(level, out, [r.shard for r in rows], [r.shard * per for r in rows], starts[:-1], starts[-1]))
    return model


class _Vocabulary(Level):
    """Level 1: keys are hashes less the shard's first."""

    def _opened(self, i: int) -> Shard:
        s = super()._opened(i)
        find, first = s.keys.find, self.firsts[i]
        s.keys.find = lambda q: find(q - first)
        return s


def _level(model: Model, texts: DataFrame, level: int, contexts: int, per: int, out: str) -> list:
    """Count and store the children of the nodes of the level before, ``per`` of them a shard."""
    v = model.vocabulary.size
    if per * v >= 1 << 64:
        raise ValueError("a shard's contexts times the vocabulary must fit 64 bits")

    def keys_of(part: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        hashes, sizes = hashed(part)
        ids, _ = model.ids(hashes)
        node = model.contexts(ids, sizes, level - 1)
        before = np.r_[np.int64(-1), node[:-1]]
        before[np.cumsum(sizes) - sizes] = model._end if level == 2 else -1
        ok = before >= 0
        return (before[ok] // per).astype(np.int32), (before[ok] % per).astype(U64) * U64(v) + ids[ok].astype(U64)

    def make(shard: int, keys: np.ndarray, counts: np.ndarray) -> None:
        base = shard * per
        n_contexts = min(per, contexts - base)
        ctx, word = (keys // U64(v)).astype(np.int64), (keys % U64(v)).astype(np.int64)
        kinds = np.bincount(ctx, minlength=n_contexts)
        total = np.bincount(ctx, counts, n_contexts)
        lower = _lower(model, level, base + ctx, word)
        p = (counts + kinds[ctx] * 10.0**lower) / (total[ctx] + kinds[ctx])
        codes, values = _quantised(np.log10(p))
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(kinds > 0, np.log10(kinds / (total + kinds)), 0.0)
        back, back_values = _quantised(weight)
        ends = np.cumsum(kinds)
        span = np.zeros(n_contexts, np.int64)  # a range needs as many values as its largest id, and one
        span[kinds > 0] = word[ends[kinds > 0] - 1] + 1
        below = np.cumsum(span) - span
        ptr_head, ptr = EliasFano.parts(np.r_[0, ends].astype(U64), len(keys) + 1)
        key_head, key = EliasFano.parts((below[ctx] + word).astype(U64), int(span.sum()) + 1)
        put(shard_path(out, level, shard), _blob([base, n_contexts, *ptr_head, *key_head], [*ptr, *key, codes, values, back, back_values]))

    return _built(_dealt(keys_of, texts), make)


def _lower(model: Model, level: int, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 of the lower order's probability of each child."""
    counts = np.zeros(len(word), np.int64)
    s = np.searchsorted(model.vocabulary.starts, word, "right") - 1
    for i in np.unique(s):
        counts[s == i] = model.vocabulary.shard(int(i)).counts[word[s == i] - model.vocabulary.starts[i]]
    score = model.base(counts)
    if level == 2:
        return score
    tail = _last_words(model, level, ctx)  # the context without its first word, as a node chain from level 1
    node = tail[0]
    for level_of, nxt in zip(model.levels, [*tail[1:], word], strict=True):
        usable = np.flatnonzero(node >= 0)
        found, weight, prob = model.step(level_of, node[usable], nxt[usable])
        if nxt is word:
            hit = found >= 0
            score[usable] += weight
            score[usable[hit]] = prob[hit]
        node = np.full(len(word), -1, np.int64)
        node[usable] = found
    return score


def _last_words(model: Model, level: int, ctx: np.ndarray) -> list[np.ndarray]:
    """The words of each context but its first, oldest first, by walking the trie upwards."""
    words: list[np.ndarray] = []
    node = ctx
    for level_of in reversed(model.levels[: level - 2]):
        up, last = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        s = np.searchsorted(level_of.starts, node, "right") - 1
        for i in np.unique(s):
            at, shard = np.flatnonzero(s == i), level_of.shard(int(i))
            context, last[at] = shard.parents(node[at] - level_of.starts[i])
            up[at] = context + shard.base
        words.insert(0, last)
        node = up
    return words


def score(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.drop("text").schema
    for name, t in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        kind = kind.add(name, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in portions(batches, 2):
            sizes, known, base, total = model.score(texts)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), model.tokens)), pa.array(base), pa.array(total)], names=kind.names)

    return rows.mapInArrow(run, kind)
