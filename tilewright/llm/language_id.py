"""Language identification by rank-order profiles of character n-grams.

For each language the most frequent 1- to 3-grams of all its training texts are
ranked; a document's own most frequent n-grams are ranked likewise, and the
language with the least sum of rank differences (out-of-place distance, with a
fixed penalty for n-grams that a profile lacks) is the prediction. n-grams don't
cross words; a word is a run of letters, padded with one blank at either side.

Defined results: null text, or text without a letter, is ``und`` with score 0.
Ties in a count go to the smaller n-gram, ties in distance to the first language
by name. Training ignores rows whose text or language is null; with no training
rows every text is ``und``. Long texts are counted whole, in blocks. Other
columns are ignored and never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 20
#: n-grams that a task holds at a time while it counts, and those it keeps to count on.
WAITING, HELD = 1_000_000, 250_000


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, as packed code points, and their counts."""
    found, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    at = 0
    while at < len(text):
        end = min(at + BLOCK, len(text))
        while end < len(text) and text[end - 1].isalpha() and end - at > BLOCK - 4096:  # blocks end between words
            end -= 1
        raw = np.frombuffer(text[at:end].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        at = end
        is_letter = letters()[raw]
        c = np.where(is_letter, raw, 32).astype(np.int64)
        c = np.r_[32, c[is_letter | np.r_[True, is_letter[:-1]]], 32]
        one, two, three = c[c != 32], (c[:-1] << 21) | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        two = two[(c[:-1] != 32) | (c[1:] != 32)]
        u, n = np.unique(np.concatenate([one, two, three[c[1:-1] != 32]]), return_counts=True)
        found, counts = (u, n) if not len(found) else _merge([found, u], [counts, n])
    return found, counts


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(inv, np.concatenate(counts), len(u)).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent n-grams, most frequent first."""
    if len(codes) > 4 * k:
        at_least = np.partition(counts, len(counts) - k)[len(counts) - k]
        codes, counts = codes[counts >= at_least], counts[counts >= at_least]
    return codes[np.lexsort((codes, -counts))[:k]]


def gram_counts(docs: DataFrame, lang: Column, text: Column) -> DataFrame:
    """lang, gram, n over all rows whose language and text aren't null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                u, n = _merge([p[0] for p in parts], [p[1] for p in parts])
                yield pa.record_batch([pa.array([name] * len(u), pa.string()), pa.array(u), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(name, []).append(g := grams(t))
                size += len(g[0])
                if size > WAITING:  # pre-aggregate, so that what waits here stays bounded
                    for k, parts in held.items():
                        held[k] = [_merge([p[0] for p in parts], [p[1] for p in parts])]
                    size = sum(len(p[0][0]) for p in held.values())
                    if size > HELD:
                        yield from flush()
                        size = 0
        yield from flush()

    rows = docs.select(lang.alias("lang"), text.alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(counts: DataFrame, size: int = 400) -> dict[str, np.ndarray]:
    """The ``size`` most frequent n-grams of each language, in order. Bounded: languages times ``size``."""
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).orderBy("lang", "rank").collect()
    found: dict[str, list[int]] = {}
    for r in rows:
        found.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.int64) for k, v in found.items()}


class Ranker:
    """Out-of-place distances of texts to a set of profiles."""

    def __init__(self, known: dict[str, np.ndarray], size: int = 400) -> None:
        self.names, self.size = sorted(known), size
        self.codes = np.unique(np.concatenate([np.empty(0, np.int64), *known.values()]))
        self.ranks = np.full((len(self.names), len(self.codes)), -1, np.int64)
        for i, k in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.codes, known[k])] = np.arange(len(known[k]))

    def best(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is 1 less the distance's share of the largest possible one."""
        codes, counts = grams(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0
        own = top(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = np.where(self.codes[at] == own, self.ranks[:, at], -1)
        far = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))), self.size)).sum(axis=1)
        i = int(far.argmin())
        return self.names[i], float(1 - far[i] / (self.size * len(own)))


def identify(docs: DataFrame, known: dict[str, np.ndarray], text_col: str = "text", size: int = 400, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the prediction and its score added under ``names``, which must not be columns of ``docs``."""
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns that exist already: {', '.join(sorted(clash))}")
    schema = T.StructType(list(docs.schema.fields)).add(names[0], "string").add(names[1], "double")
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(known, size)
        for batch in batches:
            best = [ranker.best(t) for t in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array([b[0] for b in best], pa.string()), pa.array([b[1] for b in best], pa.float64())], names=schema.names)

    return docs.mapInArrow(predict, schema)


def recognised(docs: DataFrame, known: dict[str, np.ndarray], least: float, text_col: str = "text", size: int = 400) -> DataFrame:
    """The rows of ``docs`` whose text has a learned language with a score of ``least``; no column is added, so none can clash."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(known, size)
        for batch in batches:
            best = (ranker.best(t) for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([name != "und" and score >= least for name, score in best], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 400, folds: int = 5) -> dict[str, np.ndarray]:
    """Profiles of the rows whose crc32 of the id leaves a remainder; the others are held out."""
    return profiles(gram_counts(docs.filter(~held_out(F.col(id_col), folds)), F.col(lang_col), F.col(text_col)), size)


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0
