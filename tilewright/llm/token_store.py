"""Token-id files: one zstandard frame per document, a shared dictionary and an offset index.

A file holds documents of one doc_id range in ascending order::

    magic | frames | index (Arrow stream: doc_id, frame end, token count) | header (JSON) | header length (uint32) | magic

The header names the dictionary by its SHA-256, and the width of an id. Each
frame is one document's id array, little-endian, compressed by itself with the
shared dictionary, so that one short document is read without its neighbours.
Frames go to the file as they come, and a file is closed at ``FILE_BYTES``, so
neither a task's memory nor a file grows with its range. The dictionary is
trained on the id arrays of a bounded sample (``DICT_DOCS`` documents, a window
of at most ``DICT_CHARS`` characters from anywhere in each); every document is
encoded whole.

Defined results: ids are those of the library's plain ``encode`` without special
tokens added; a special token's own text in a document is that token (as text if
``special_as_text``). Null text is the empty text, stored as the end id alone.
doc_id may have any type that Spark sorts and Arrow stores. Null doc_ids come
first; repeated doc_ids are stored side by side, by a hash of the text. Other
columns are ignored. An empty table makes no file and an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import filesystem, fresh, put, saved

MAGIC = b"TWIDS02\n"
DICT_DOCS, DICT_CHARS, DICT_BYTES = 1000, 65_536, 64 << 10
#: Bytes of frames at which a file is closed.
FILE_BYTES = 128 << 20
#: Bytes of text that are cut and looked up at a time, and pieces whose ids an encoder holds.
WINDOW, HELD = 1 << 20, 400_000

#: Kinds of bytes: 1 ASCII letter, 2 other visible ASCII, 4 blank or line feed, 8 lead byte of a Latin letter of two bytes,
#: 16 and 32 lead bytes of other characters of two and three bytes, none of which is white space (up to U+07FF, U+4000 to U+DFFF).
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[32, 10]] = 4
_KIND[0xC9:0xE0] = 16
_KIND[0xC3:0xC9] = 8
_KIND[0xE4:0xEE] = 32
_MARK = _KIND.copy()
_MARK[48:58] = 0  # digits are visible, but no marks


def cuts(data: np.ndarray) -> np.ndarray:
    """The bytes at which a new piece starts: no token of the byte-level BPE spans such a place.

    Its letters, digits, marks and white space are matched in runs that a blank
    may precede. So a blank or line feed behind a visible character starts a new
    run, and so does a mark behind a letter.
    """
    kind = _KIND[data]
    wide = np.zeros(len(data), bool)  # the last byte of a letter of two bytes
    wide[1:] = kind[:-1] == 8
    wide[1:] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # the signs of times and division
    letter = (kind == 1) | wide
    visible = letter | (kind == 2)
    visible[1:] |= (kind[:-1] == 8) | (kind[:-1] == 16)
    visible[2:] |= kind[:-2] == 32
    before = np.zeros(len(data), bool)
    before[1:] = (letter[:-1] & (_MARK[data[1:]] == 2)) | (visible[:-1] & (kind[1:] == 4))
    return np.flatnonzero(before)


def _visible(c: str) -> bool:
    """What ``cuts`` takes for visible."""
    return "!" <= c <= "~" or "\xc0" <= c <= "\u07ff" or "\u4000" <= c <= "\ud7ff"


class Pieces:
    """The ids of short pieces (16 bytes at most) that were encoded before, in flat arrays."""

    def __init__(self) -> None:
        self.hash, self.low, self.high = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.size, self.start, self.count = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.used, self.ids = np.empty(0, bool), np.empty(0, np.uint32)

    def find(self, h: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 where it isn't held."""
        if not len(self.hash):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        same = (self.hash[at] == h) & (self.low[at] == low) & (self.high[at] == high) & (self.size[at] == size)
        self.used[at[same]] = True
        return np.where(same, at, -1)

    def add(self, h: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Hold pieces that were not held. Beyond ``HELD`` those that weren't used lately go, then all older ones."""
        if len(self.hash) + len(h) > HELD:
            keep = np.flatnonzero(self.used) if self.used.sum() + len(h) <= HELD else np.empty(0, np.int64)
            self.ids = self.ids[spread(self.start[keep], self.count[keep])]
            for name in ("hash", "low", "high", "size", "count"):
                setattr(self, name, getattr(self, name)[keep])
            self.start = np.cumsum(self.count) - self.count
            self.used = np.zeros(len(keep), bool)
        start = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        by = np.argsort(joined := np.concatenate([self.hash, h]), kind="stable")
        self.hash = joined[by]
        for name, more in (("low", low), ("high", high), ("size", size), ("start", start), ("count", count), ("used", np.ones(len(h), bool))):
            setattr(self, name, np.concatenate([getattr(self, name), more])[by])


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run of ``count``, one run after the other."""
    first = np.cumsum(count) - count
    return np.repeat(start - first, count) + np.arange(int(count.sum()))


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    Texts are cut where no token can span the cut; each different piece of a
    window goes through the library once, and what it gave is held, up to a bound.
    """

    def __init__(self, path: str, end_id: int | None = None, special_as_text: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.special = [] if special_as_text else added
        self.end = np.empty(0, np.uint32) if end_id is None else np.array([end_id], np.uint32)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id or 0) <= 1 << 16 else 4
        tokens = (self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size()))
        self.sizes = np.fromiter((len(t or "") for t in tokens), np.int64)  # a byte-level token has a character for each byte
        self.held = Pieces()

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """One uint32 array per text, the end id last."""
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and (not some or size + len(texts[at] or "") < WINDOW):
                some.append((texts[at] or "").encode())
                size += len(some[-1])
                at += 1
            if size > 2 * WINDOW:  # one long text
                yield np.concatenate([*self._long(some[0]), self.end])
                continue
            ends = np.cumsum([len(x) for x in some])
            starts, ids, counts = self._ids(b"".join(some), ends[:-1])
            firsts = np.r_[0, np.cumsum(counts)][np.searchsorted(starts, np.r_[0, ends])]
            for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
                yield np.concatenate([ids[a:b], self.end])

    def _long(self, data: bytes) -> Iterator[np.ndarray]:
        """The ids of a long text, by windows that end where a piece starts."""
        at, size = 0, WINDOW
        reach = max(map(len, self.special), default=0)
        while at < len(data):
            window = data[at : at + size]
            if at + size < len(data):
                places = cuts(np.frombuffer(window, np.uint8))
                for s in self.special:  # no cut inside a special token, nor where one may go on behind the window
                    found, spans = window.find(s), []
                    while found >= 0:
                        spans.append(found)
                        found = window.find(s, found + len(s))
                    for a in spans:
                        places = places[(places <= a) | (places >= a + len(s))]
                places = places[places < size - reach]
                if not len(places):
                    size *= 2
                    continue
                window = window[: int(places[-1])]
            yield self._ids(window, np.empty(0, np.int64))[1]
            at, size = at + len(window), WINDOW

    def _ids(self, data: bytes, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where the pieces start, their ids one after the other, how many each has)."""
        raw = np.frombuffer(data, np.uint8)
        places = cuts(raw)
        for s in self.special:
            a, edges = data.find(s), []
            while a >= 0:
                if not len(borders) or (i := int(np.searchsorted(borders, a, "right"))) == len(borders) or borders[i] >= a + len(s):
                    edges += [a, a + len(s)]
                    a = data.find(s, a + len(s))
                else:  # across two texts
                    a = data.find(s, a + 1)
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                places = places[(places <= a) | (places >= b)]
            borders = np.r_[borders, edges].astype(np.int64)
        starts = np.unique(np.concatenate([[0], borders, places])).astype(np.int64)
        starts = starts[starts < len(raw)]
        size = np.diff(np.r_[starts, len(raw)])
        if not len(starts):
            return starts, np.empty(0, np.uint32), size
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        key = np.lib.stride_tricks.sliding_window_view(padded, 16)[starts].view("<u8")
        mask = lambda n: np.where(n >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.clip(n, 0, 7)).astype(np.uint64)) - np.uint64(1))
        low, high = key[:, 0] & mask(size), key[:, 1] & mask(size - 8)
        h = (low * np.uint64(0x9E3779B97F4A7C15)) ^ ((high + size.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        long = np.flatnonzero(size > 16)
        short = np.flatnonzero(size <= 16)
        by = short[np.argsort(h[short])]
        new = np.r_[True, (h[by[1:]] != h[by[:-1]]) | (low[by[1:]] != low[by[:-1]]) | (high[by[1:]] != high[by[:-1]]) | (size[by[1:]] != size[by[:-1]])] if len(by) else np.empty(0, bool)
        first = by[new]  # one piece of each kind; kinds that share a hash may come more than once
        kind = np.empty(len(starts), np.int64)
        kind[by] = np.cumsum(new) - 1
        at = self.held.find(h[first], low[first], high[first], size[first])
        lacking = np.flatnonzero(at < 0)
        text_of = lambda i: [data[a:b].decode() for a, b in zip(starts[i].tolist(), (starts[i] + size[i]).tolist(), strict=True)]
        names: dict[str, int] = {}
        kind[long] = [len(first) + names.setdefault(t, len(names)) for t in text_of(long)]
        fresh_ids, fresh_counts = self._learned([*text_of(first[lacking]), *names])
        n = len(lacking)
        pool = np.concatenate([self.held.ids, fresh_ids])
        start, count = np.empty(len(first) + len(names), np.int64), np.empty(len(first) + len(names), np.int64)
        have = at >= 0
        start[: len(first)][have], count[: len(first)][have] = self.held.start[at[have]], self.held.count[at[have]]
        places_of = len(self.held.ids) + np.cumsum(fresh_counts) - fresh_counts
        start[lacking], count[lacking] = places_of[:n], fresh_counts[:n]
        start[len(first) :], count[len(first) :] = places_of[n:], fresh_counts[n:]
        ids = pool[spread(start[kind], count[kind])]
        _, once = np.unique(h[first[lacking]], return_index=True)
        keep = np.sort(once)
        held = first[lacking[keep]]
        kept_ids = fresh_ids[spread((np.cumsum(fresh_counts) - fresh_counts)[keep], fresh_counts[keep])]
        if n:
            self.held.add(h[held], low[held], high[held], size[held], fresh_counts[keep], kept_ids)
        return starts, ids, count[kind]

    def _learned(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has).

        Pieces that start with a blank and end in a visible character go through
        the library as one text, as no token spans them; the ids are told apart by
        their bytes.
        """
        found: list[np.ndarray] = [np.empty(0, np.uint32)] * len(pieces)
        joint = [i for i, p in enumerate(pieces) if p[0] in " \n" and _visible(p[-1])]
        rest = sorted(set(range(len(pieces))).difference(joint))
        for at in range(0, len(joint), 4096):
            part = joint[at : at + 4096]
            texts = [pieces[i] for i in part]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(t.encode()) for t in texts])) + 1
            for i, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                found[i] = ids[a:b]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([pieces[i] for i in part], add_special_tokens=False), strict=True):
                found[i] = np.array(e.ids, np.uint32)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return (np.concatenate(found) if found else np.empty(0, np.uint32)), counts


@lru_cache(1)
def encoder_of(path: str, end_id: int | None, special_as_text: bool = False) -> Encoder:
    """The process's encoder: what it holds (``HELD`` pieces at most) serves all tasks of a worker."""
    return Encoder(path, end_id, special_as_text)


def train_dictionary(docs: DataFrame, encoder_path: str, end_id: int, id_col: str, text_col: str) -> bytes:
    """A zstandard dictionary from a bounded sample of the documents, the same at every run."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.xxhash64(F.lit(9), F.col(id_col)).alias("o")
    last = docs.select(order).orderBy("o").limit(DICT_DOCS).agg(F.max("o")).first()[0]
    start = 1 + F.pmod(F.xxhash64(F.lit(10), F.col(id_col)), F.greatest(F.length(text) - DICT_CHARS, F.lit(0)) + 1)
    rows = docs.select(order, F.substr(text, start.cast("int"), F.lit(DICT_CHARS)).alias("text")).filter(F.col("o") <= F.lit(last)).orderBy("o", "text").limit(DICT_DOCS).collect()
    encoder = encoder_of(encoder_path, end_id)
    samples = [ids.astype(f"<u{encoder.width}").tobytes() for ids in encoder.encode([r.text for r in rows])]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 16)), samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their bytes serve as they are
        return b"".join(samples)[-DICT_BYTES:]


def _with(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if len(dictionary) >= 8 else None


class Writer:
    """One file, written under a name of this attempt and moved when it is whole, so that retries and twins are harmless."""

    def __init__(self, uri: str, dictionary: bytes, width: int, kind: pa.DataType, level: int = 3) -> None:
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.attempt = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.attempt, compression=None)
        self.out.write(MAGIC)
        self.squeeze = zstandard.ZstdCompressor(level=level, dict_data=_with(dictionary), write_content_size=True)
        self.width, self.kind, self.sha = width, kind, hashlib.sha256(dictionary).hexdigest()
        self.ids, self.ends, self.counts, self.size, self.tokens = [], [], [], 0, 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        frame = self.squeeze.compress(np.ascontiguousarray(ids, f"<u{self.width}").tobytes())
        self.out.write(frame)
        self.size += len(frame)
        self.tokens += len(ids)
        self.ids.append(doc_id)
        self.ends.append(self.size)
        self.counts.append(len(ids))

    def close(self) -> None:
        index = pa.record_batch([pa.array(self.ids, self.kind), pa.array(self.ends, pa.uint64()), pa.array(self.counts, pa.uint32())], names=["doc_id", "end", "tokens"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_batch(index)
        packed = sink.getvalue()
        header = json.dumps({"docs": len(self.ids), "dictionary": self.sha, "width": self.width, "index": packed.size}).encode()
        for part in (packed, header, struct.pack("<I", len(header)), MAGIC):
            self.out.write(part)
        self.out.close()
        self.fs.move(self.attempt, self.path)


class Reader:
    """One file; documents are read one by one, by the index."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        fs, path = filesystem(uri)
        self.data = fs.open_input_file(path)
        size, tail = self.data.size(), len(MAGIC) + 4
        end = self.data.read_at(tail, size - tail)
        if self.data.read_at(len(MAGIC), 0) != MAGIC or end[4:] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        length = struct.unpack("<I", end[:4])[0]
        self.header = json.loads(self.data.read_at(length, size - tail - length))
        if self.header["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{uri} was written with another dictionary")
        packed = self.header["index"]
        index = pa.ipc.open_stream(self.data.read_buffer(packed) if self.data.seek(size - tail - length - packed) else b"").read_all()
        self.ids = index["doc_id"].combine_chunks()
        self.ends, self.counts = index["end"].to_numpy(), index["tokens"].to_numpy()
        self.expand = zstandard.ZstdDecompressor(dict_data=_with(dictionary))

    def __len__(self) -> int:
        return len(self.ends)

    def tokens(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file, as uint32."""
        a, b = int(self.ends[i - 1]) if i else 0, int(self.ends[i])
        return np.frombuffer(self.expand.decompress(self.data.read_at(b - a, len(MAGIC) + a)), f"<u{self.header['width']}").astype("<u4")

    def find(self, doc_id: object) -> np.ndarray | None:
        """The ids of a document by its id."""
        i = bisect.bisect_left(range(self.ids.null_count, len(self)), doc_id, key=lambda k: self.ids[k].as_py()) + self.ids.null_count
        return self.tokens(i) if i < len(self) and self.ids[i].as_py() == doc_id else None


class Stored(NamedTuple):
    """What ``write_tokens`` made: the folder, and a table of its files: part, seq, path, docs, tokens, start (ids before the file)."""

    folder: str
    files: DataFrame
    n_files: int
    id_type: T.DataType


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, out: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Stored:
    """Write the files, in doc_id order over parts and their files."""
    spark = docs.sparkSession
    out = out or fresh(spark, "tokens")
    dictionary = train_dictionary(docs, tokenizer_path, end_id, id_col, text_col)
    put(f"{out}/dictionary", dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, now = encoder_of(tokenizer_path, end_id), TaskContext.get().partitionId(), 0, None

        def done(w: Writer) -> pa.RecordBatch:
            w.close()
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([uri]), pa.array([len(w.ids)], pa.int64()), pa.array([w.tokens], pa.int64())]
            return pa.record_batch(row, names=["part", "seq", "path", "docs", "tokens"])

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                if now is None:
                    uri = f"{out}/part-{part:06d}-{seq:06d}.ids"
                    now = Writer(uri, dictionary, encoder.width, b.column(0).type)
                now.add(doc_id, ids)
                if now.size >= FILE_BYTES:
                    yield done(now)
                    now, seq = None, seq + 1
        if now is not None:
            yield done(now)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("o", F.xxhash64("text"))
    dealt = rows.repartitionByRange(parts, "doc_id", "o").sortWithinPartitions("doc_id", "o").select("doc_id", "text")
    files = saved(dealt.mapInArrow(run, "part int, seq int, path string, docs long, tokens long"), "files")
    totals = sorted(files.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect())  # a row per task
    starts, at = [], 0
    for r in totals:
        starts.append((r.part, at))
        at += r.tokens
    inside = F.coalesce(F.sum("tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = files.withColumn("inside", inside).join(spark.createDataFrame(starts, "part int, first long"), "part")
    return Stored(out, placed.withColumn("start", F.col("first") + F.col("inside")).drop("first", "inside"), sum(r.n for r in totals), docs.schema[id_col].dataType)


def read_tokens(stored: Stored) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files."""
    kind = T.StructType([T.StructField("doc_id", stored.id_type), *[T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")]])
    dictionary = f"{stored.folder}/dictionary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                known = contents(dictionary) if known is None else known
                reader = Reader(path, known)
                counts = reader.counts.astype(np.int64)
                starts = start + np.cumsum(counts) - counts
                for at in range(0, len(reader), 4096):
                    here = range(at, min(at + 4096, len(reader)))
                    sums = np.fromiter((zlib.crc32(reader.tokens(i).tobytes()) for i in here), np.int64, len(here))
                    yield pa.record_batch([reader.ids.slice(at, len(here)), pa.array(starts[at : at + 4096]), pa.array(counts[at : at + 4096]), pa.array(sums)], names=kind.names)

    return stored.files.select("path", "start").repartition(max(1, min(stored.n_files, 100_000))).mapInArrow(run, kind)


def contents(uri: str) -> bytes:
    """A shared file's bytes."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as source:
        return source.read()
