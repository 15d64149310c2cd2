"""Secret scans with a recursive decoding worklist.

Three kinds of secrets are searched in a text and in every layer that decoding
unwraps: URL escapes, \\u and \\x escapes, base64, gzip, zlib and raw deflate
data, UTF-8 and UTF-16. Escapes are decoded in the whole layer at once, so a
secret may lie half inside them. Each layer
keeps, for each of its characters, the span of the text's own characters that it
came from, so that findings at any depth are reported in the text's own code
points. The worklist runs until no layer is new; layers that were seen before
(cycles, repeats at the same place) are not scanned again.

Defined results: null text is the empty text. Findings come by start, then kind,
then end; equal findings of several layers are one. Bytes that aren't text are
replaced, so what stands between them is scanned; of damaged or cut compressed
data what comes before the damage is, and what follows raw deflate data is no
harm to it. Base64 may be wrapped: lines of it are one stretch, and each line is
tried by itself too. Compressed data is unwrapped to any depth, all members of
it, until data inflates to itself. A layer larger than ``PIECE`` characters goes
through the scan and the worklist in pieces that overlap by ``OVERLAP``; an
encoded stretch across a cut is carried on whole, and one larger than ``STRETCH``
is decoded as it comes, so memory stays bounded and nothing is skipped. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds and their patterns, group that must be long enough, and its least length.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Characters of a piece of a layer, those that two pieces share, and of the largest encoded stretch that is held whole.
PIECE, OVERLAP, STRETCH = 1 << 22, 1 << 16, 1 << 25
#: First bytes that tell how data is read; characters of the least finding.
HEAD, LEAST = 4096, 12

_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}")
#: The least finding has 12 characters, so 16 of base64: shorter stretches can't hold one.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}(?![A-Za-z0-9+/_=-])")
#: What no encoded stretch goes across; what ends one that is decoded as it comes; what isn't data in it.
_BREAK = re.compile(r"[^A-Za-z0-9+/_=\s-]|(?<=\S)[\x20\t]+(?=\S)")
_OTHER, _NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/_=\s-]"), re.compile(r"[^A-Za-z0-9+/]")
_UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})")


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings in one layer."""
    found = []
    for kind, (pattern, group, least) in KINDS.items():
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return found


def _kind(raw: bytes) -> int:
    """The window bits for compressed data that starts so; 0 for other data."""
    return 31 if raw[:2] == b"\x1f\x8b" else 15 if len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0 else 0


def _codes(head: bytes) -> list[str]:
    """The encodings that data may have: UTF-16 where a quarter of its first bytes or more is zero."""
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return ["utf-8", "utf-16"]
    start = head[:256]
    if 4 * start.count(0) < len(start) or len(start) < 2:
        return ["utf-8"]
    return ["utf-8", "utf-16-le" if start[1::2].count(0) >= start[::2].count(0) else "utf-16-be"]


def _stretch(held: str) -> int:
    """Where the encoded stretch that may go on behind the end of ``held`` begins."""
    for low in range((len(held) - 1) // OVERLAP * OVERLAP, -1, -OVERLAP):
        last = None
        for last in _BREAK.finditer(held, low, min(len(held), low + OVERLAP)):
            pass
        if last:
            return last.end()
    return 0


class _Text:
    """Data as text, in overlapping pieces; what isn't text is replaced.

    An encoded stretch that isn't over at a cut is carried on whole. One that
    becomes larger than ``STRETCH`` is decoded as it comes instead, and its texts
    are among the pieces.
    """

    def __init__(self, code: str) -> None:
        self.decoder, self.held, self.fresh = codecs.getincrementaldecoder(code)("replace"), "", False
        self.inside: _Data | None = None

    def feed(self, block: bytes | None) -> Iterator[str]:
        """The pieces that a block completes; None is the end."""
        text = self.decoder.decode(block or b"", block is None)
        if self.inside:
            end = _OTHER.search(text)
            yield from self._through(text[: end.start()] if end else text, bool(end) or block is None)
            text = text[end.start() :] if end else ""
        self.held, self.fresh = self.held + text, self.fresh or bool(text)
        if block is None:
            if self.fresh:
                yield self.held
        elif len(self.held) >= PIECE and not self.inside:
            start = _stretch(self.held)
            if start:
                yield self.held
                self.held, self.fresh = self.held[min(start, len(self.held) - OVERLAP) :], False
            elif len(self.held) > STRETCH:
                part, self.held, self.fresh, self.inside, self.open = self.held, "", False, _Data(), ""
                yield from self._through(part, False)

    def _through(self, part: str, over: bool) -> Iterator[str]:
        self.held += part
        yield self.held  # the stretch itself may hold a finding
        body = self.open + _NOT_BASE64.sub("", part.replace("-", "+").replace("_", "/"))
        whole = len(body) // 4 * 4
        self.held, self.open = self.held[-OVERLAP:], body[whole:]
        yield from self.inside.feed(base64.b64decode(body[:whole]))
        if over:
            if len(self.open) > 1:
                yield from self.inside.feed(base64.b64decode(self.open + "=" * (-len(self.open) % 4)))
            yield from self.inside.feed(None)
            self.inside = None


class _Level:
    """Data at one depth: how it is read, and what inflates it."""

    def __init__(self, seen: set[bytes]) -> None:
        self.seen, self.head, self.readers, self.kind = seen, b"", None, 0

    def given(self, block: bytes | None) -> list[bytes | None]:
        """What can be read now: nothing before the first bytes are there, which tell how."""
        if self.readers is not None:
            return [block]
        self.head += block or b""
        if len(self.head) < HEAD and block is not None:
            return []
        self.readers, mark = [], hashlib.sha256(self.head).digest()
        if self.head and mark not in self.seen:  # else data that inflates to itself
            self.seen.add(mark)
            self.readers = [_Text(code) for code in _codes(self.head)]
            self.kind = next((k for k in (_kind(self.head), -15) if k and self._opens(k)), 0)
            self.inflater, self.rest = zlib.decompressobj(self.kind) if self.kind else None, b""
        return [self.head, *([] if block is not None else [None])]

    def _opens(self, kind: int) -> bool:
        """Whether the first bytes inflate; without a header, to as much as a finding needs."""
        try:
            out = zlib.decompressobj(kind).decompress(self.head, LEAST)
        except zlib.error:
            return False
        return kind != -15 or len(out) == LEAST

    def inflated(self, blocks: list[bytes | None]) -> Iterator[bytes | None]:
        """The data of all members in blocks, None at its end; what follows the last member, or can't be read, is left out."""
        for block in blocks if self.kind else ():
            data, self.rest = self.rest + (block or b""), b""
            try:
                while self.kind and data:
                    if self.inflater.eof:
                        if len(data) < 3 and block is not None and self.kind != -15:
                            self.rest = data
                            break
                        self.kind = _kind(data) if self.kind != -15 else 0
                        if not self.kind:
                            break
                        self.inflater = zlib.decompressobj(self.kind)
                    if out := self.inflater.decompress(data, 1 << 20):
                        yield out
                    data = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
                while self.kind and not self.inflater.eof and (out := self.inflater.decompress(b"", 1 << 20)):
                    yield out
            except zlib.error:
                self.kind = 0
            if block is None or not self.kind:
                self.kind = 0
                yield None
                return


class _Data:
    """Pieces of text of data and of what it inflates to, however deep; a level holds a block at a time."""

    def __init__(self) -> None:
        self.levels, self.seen = [], set()

    def feed(self, block: bytes | None) -> Iterator[str]:
        work: list[Iterator[bytes | None]] = [iter([block])]
        while work:
            if (block := next(work[-1], b"")) == b"":
                work.pop()
                continue
            if len(work) > len(self.levels):
                self.levels.append(_Level(self.seen))
            level = self.levels[len(work) - 1]
            now = level.given(block)
            for data in now:
                for reader in level.readers:
                    yield from reader.feed(data)
            work.append(level.inflated(now))


def _texts(raw: bytes) -> Iterator[str]:
    data = _Data()
    for block in (raw, None):
        yield from data.feed(block)


def _from_base64(s: str) -> Iterator[str]:
    body = "".join(s.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return iter(())
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return iter(())
    return _texts(raw)


def _unescaped(s: str, start: int) -> tuple[str, list[int]]:
    """An escape's characters and the place that each came from."""
    if m := _UNICODE.match(s):
        code = int(m[1] or m[2] or m[3], 16)
        return (chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"), [start]
    raw, i, out, at = bytes.fromhex(s.replace("%", "")), 0, [], []
    while i < len(raw):
        size = 1 if raw[i] < 0x80 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4 if raw[i] >> 3 == 30 else 1
        try:
            out.append(raw[i : i + size].decode("utf-8"))
        except UnicodeDecodeError:
            size = 1
            out.append("\ufffd")
        at.append(start + 3 * i)
        i += size
    return "".join(out), at


def _from_escapes(s: str) -> tuple[str, np.ndarray]:
    """The decoded text and, for each of its characters and the end, the offset in ``s`` that it came from."""
    out, at, last = [], [], 0
    for m in _ESCAPES.finditer(s):
        text, places = _unescaped(m[0], m.start())
        out += [s[last : m.start()], text]
        at += [np.arange(last, m.start()), np.array(places, np.int64)]
        last = m.end()
    out.append(s[last:])
    at.append(np.arange(last, len(s) + 1))
    return "".join(out), np.concatenate(at)


def _line_runs(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """A stretch of base64 lines as a whole, and its runs of lines of one width, without and with the next, shorter line."""
    yield a, b
    lines = [m.span() for m in re.compile(r"[^\s]+").finditer(text, a, b)]
    i = 0
    while i < len(lines):
        j, width = i + 1, lines[i][1] - lines[i][0]
        while j < len(lines) and lines[j][1] - lines[j][0] == width:
            j += 1
        if width >= 16:
            if j > i + 1:
                yield lines[i][0], lines[j - 1][1]
            if j < len(lines) and lines[j][1] - lines[j][0] < width:
                yield lines[i][0], lines[j][1]
        i = j


def _layers(text: str) -> Iterator[tuple[str, int, int, np.ndarray | None]]:
    """(decoded text, start, end, offsets): all encoded stretches of a layer; offsets is None where characters can't be told apart."""
    if ("%" in text or "\\" in text) and _ESCAPES.search(text):
        decoded, at = _from_escapes(text)
        if decoded != text:
            yield decoded, 0, len(text), at
    spans = [m.span() for m in _BASE64.finditer(text)]
    if "\n" in text:
        spans += [span for m in _WRAPPED.finditer(text) for span in _line_runs(text, *m.span())]
    for a, b in dict.fromkeys(spans):
        for decoded in _from_base64(text[a:b]):
            yield decoded, a, b, None


def find_all(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base findings, all findings), each by start, kind and end, in the text's code points."""
    text = text or ""
    by_place = lambda x: (x[1], ORDER[x[0]], x[2])
    base = sorted(scan(text), key=by_place)
    every, seen = set(base), {(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), 0, len(text))}
    work: list[tuple[str, np.ndarray | None, tuple[int, int]]] = [(text, None, (0, len(text)))]
    while work:
        layer, origin, whole = work.pop()
        for decoded, a, b, at in _layers(layer):
            start, end = (a, b) if origin is None else (int(origin[a]), int(origin[b])) if len(origin) else whole
            if (mark := (hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).digest(), start, end)) in seen:
                continue
            seen.add(mark)
            if at is not None and (origin is None or len(origin)):
                places = a + at if origin is None else origin[a + at]
            else:
                places = np.empty(0, np.int64)  # the stretch as a whole
            for kind, i, j in scan(decoded):
                every.add((kind, int(places[i]), int(places[j])) if len(places) else (kind, start, end))
            work.append((decoded, places, (start, end)))
    return base, sorted(every, key=by_place)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_decoded: one row per input row."""
    kind = docs.select(F.col(id_col).alias("doc_id")).schema
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded"]
    for name, t in zip(names[1:], ("long", "long", "long", "string", "string", "long"), strict=True):
        kind = kind.add(name, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for t in b.column(1).to_pylist():
                base, every = find_all(t)
                per = [sum(x[0] == k for x in base) for k in KINDS]
                for c, v in zip(cols, (*per, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)), strict=True):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)
