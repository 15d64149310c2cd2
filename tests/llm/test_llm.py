"""The text operators against brute force, round trips and edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewright.llm import decontamination, exact_dedup, language_id, license_scan, line_dedup, mixing, ngram_trie, queries, secrets, simhash, token_store
from tilewright.plans.session import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tid long, norm string, fp long"
LINE = "A line that is long enough to count."
ODD = [
    (1, None, None, None, None, 1, "x", 1),
    (2, "", "en", "a", 0, None, None, None),
    (None, "the cat sat on the mat", "en", "a", 1, 1, "", 0),
    (4, f"{LINE}\nshort\n\t{LINE.upper()} \n", "en", "a", 1, 1, "", 0),
    (5, f"{LINE}\nmore", "en", "b", 1, 1, "", 0),
    (6, f"x\n{LINE}", "de", "b", 1, 1, "", 0),
    (7, "THE CAT sat on the mat", "en", None, 1, 1, "", 0),
    (7, "THE CAT sat on the mat", "en", None, 1, 1, "", 0),
    (8, "12345 !!! 67", "de", "c", 1, 1, "", 0),
    (9, "der hund und die katze " * 3000, "de", "c", 1, 1, "", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return ship(spark).createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return ship(spark).createDataFrame([], SCHEMA)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup(odd, none):
    got = exact_dedup.exact_dedup(odd).collect()
    groups = Counter(low(r[1]) for r in ODD)
    assert Counter(r.text_sha256 for r in got) == Counter(hashlib.sha256(low(r[1]).encode()).hexdigest() for r in ODD)
    assert {r.doc_id: r.group_size for r in got}[7] == groups["the cat sat on the mat"] == 3
    assert {r.doc_id for r in got if r.kept} == {2, 4, 5, 6, 7, 8, 9}
    assert exact_dedup.exact_dedup(none).count() == 0


def test_chunks_cover_the_text(spark):
    text = "".join(f"Sentence {i} goes on. " for i in range(3000)) + "x" * 20_000
    parts = spark.createDataFrame([(text,)], "t string").select(exact_dedup.chunks(F.col("t"))).first()[0]
    assert "".join(parts) == text and all(len(p) <= 8192 for p in parts)


def test_line_dedup(odd, none):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(odd).collect()}
    assert (got[1].n_lines, got[1].n_dropped, got[1].text) == (1, 0, "")
    assert (got[4].n_lines, got[4].n_dropped, got[4].text) == (4, 2, "short\n")
    assert (got[5].n_dropped, got[5].text, got[6].text) == (1, "more", f"x\n{LINE}")
    assert line_dedup.dedup_lines(none).count() == 0


def test_fingerprint_by_definition():
    for text in ("", "one", "A b C d e f g h", "é ü x " * 50):
        w = low(text).split()
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
        assert simhash.fingerprint(text) == want


@pytest.mark.parametrize("depth, levels", [(0, 0), (3, 0), (0, 3), (2, 3)])
def test_links_by_brute_force(depth, levels):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    near = fps[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 200, dtype=np.uint64))
    fps = np.unique(np.r_[fps, near])
    tree = simhash.shard_tree(fps[::2], depth)
    deeper = {leaf: levels for leaf in range(0, 8, 2)}
    idx, shard, home = simhash.route(fps, tree, 2, deeper)
    assert home.sum() == len(fps)
    forest = simhash.Forest(len(fps))
    for s in np.unique(shard):
        own = np.r_[idx[(shard == s) & home], idx[(shard == s) & ~home]]
        root = simhash.linked(fps[own], int(((shard == s) & home).sum()), 2)
        forest.link(own, own[root])
    want = simhash.Forest(len(fps))
    for a, b in combinations(range(len(fps)), 2):
        if int(fps[a] ^ fps[b]).bit_count() <= 2:
            want.link(np.array([a]), np.array([b]))
    assert (forest.label == want.label).all() and len(set(want.label)) < len(fps)


def test_links_of_many_shards_by_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 40)
    monkeypatch.setattr(simhash, "SAMPLE", 64)
    monkeypatch.setattr(simhash, "MOST_POINTS", 200)
    rng = np.random.default_rng(9)
    fps = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    bit = lambda n: np.uint64(1) << rng.integers(0, 63, n, dtype=np.uint64)
    fps = np.unique(np.r_[fps, fps[:300] ^ bit(300) ^ bit(300), fps[:50] ^ bit(50)])
    points = ship(spark).createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found, forest = simhash.links(points, 2), simhash.Forest(len(fps))
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    for r in found.collect():
        forest.link(np.array([place[r.a]]), np.array([place[r.b]]))
    want = simhash.Forest(len(fps))
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    want.link(a, b)
    assert (forest.label == want.label).all() and len(a) > 300


def test_near_duplicates(odd, none):
    got = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert got[1].fp == 0 and got[1].component_id == got[2].component_id == 1
    assert got[None].component_id == got[7].component_id == 7
    assert simhash.near_duplicates(none).count() == 0


def test_verified_copies_by_brute_force(spark, odd, none):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = rng.choice(words, 120).tolist()
        texts += [base, base, rng.permutation(base).tolist()]  # an equal text, and the same words in another order
        for edits in (1, 2, 3, 8):
            t = list(base)
            for at in rng.choice(120, edits, replace=False):
                t[at] = "x"
            texts.append(t)
    docs = ship(spark).createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = _not_first(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = [r.doc_id for r in simhash.verified_copies(docs).collect()]
    assert sorted(got) == sorted(want) and {7 * g + 1 for g in range(12)} <= want and len(want) < len(texts) * 0.7
    assert {r.doc_id for r in simhash.verified_copies(odd).collect()} == {2}
    assert simhash.verified_copies(none).count() == 0


def _not_first(ids, similar):
    """The items of each group, which similar pairs join by any way, but its least one."""
    root = {i: i for i in ids}
    for a, b in combinations(sorted(ids), 2):
        if root[a] != root[b] and similar(a, b):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return {i for i, r in root.items() if i != r}


def _similar_pairs(texts):
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    return {(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_verified_copies_beyond_the_radius(spark):
    rng = np.random.default_rng(5)
    texts = []
    for size in (120, 400, 700):
        for g in range(6):
            base = [f"w{i}" for i in rng.integers(0, 5000, size)]
            t = list(base)
            at = int(rng.integers(size - size // 16))
            t[at : at + size // 16] = [f"new{g}x{i}" for i in range(size // 16)]  # a passage of other words in one place
            texts += [base, t]
    near = _similar_pairs(texts)
    fps = [simhash.fingerprint(" ".join(t), 1, True) for t in texts]
    assert len(near) == 18 and sum((fps[a] ^ fps[b]).bit_count() > 4 for a, b in near) >= 5
    docs = ship(spark).createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.verified_copies(docs).collect()) == sorted({b for _, b in near})


def test_verified_copies_inside_a_group(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(100)]
        other = rng.permutation(base).tolist()  # of the same words, so of the same group, but unlike its first document
        texts += [base, other, [*other[:-1], "x"], ["y", *other[1:]], [*other, "z"]]
    docs = ship(spark).createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    near = _similar_pairs(texts)
    want = sorted(_not_first(range(len(texts)), lambda a, b: (a, b) in near))
    assert want == [5 * g + i for g in range(4) for i in (2, 3, 4)]
    assert sorted(r.doc_id for r in simhash.verified_copies(docs).collect()) == want
    monkeypatch.setattr(simhash, "PAIRS", 0)  # rounds along stars until none finds a link
    monkeypatch.setattr(simhash, "LARGE", 1)
    monkeypatch.setattr(simhash, "HOT", 2)
    monkeypatch.setattr(simhash, "MOST_OFTEN", 1)  # more frequent shingles than are remembered
    assert sorted(r.doc_id for r in simhash.verified_copies(docs).collect()) == want


def _replaced(words, at, n, tag):
    return [*words[:at], *(f"{tag}{i}" for i in range(n)), *words[at + n :]]


@pytest.mark.parametrize("ids, radius, pairs", [((1, 2, 3), 2, 4), ((1, 3, 2), 64, 4), ((2, 3, 1), 0, 0)])
def test_a_chain_is_one_group_by_every_path(spark, monkeypatch, ids, radius, pairs):
    a = [f"w{i}" for i in range(300)]
    b = _replaced(a, 20, 14, "b")  # a and b, b and c are similar enough, a and c are not
    c = _replaced(_replaced(b, 120, 14, "c"), 200, 10, "d")
    texts = dict(zip(ids, (a, b, c), strict=True)) | {9: [f"v{i}" for i in range(300)]}
    order = sorted(texts)
    near = {(order[i], order[j]) for i, j in _similar_pairs([texts[k] for k in order])}
    chain = {tuple(sorted((ids[0], ids[1]))), tuple(sorted((ids[1], ids[2])))}
    assert near == chain
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "LARGE", 32 if pairs else 1)
    docs = ship(spark).createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.verified_copies(docs, radius=radius).collect()) == [2, 3]


def test_secrets_at_every_layer():
    import base64
    import gzip

    plain = 'x password = "hunter22" y'
    base, every = secrets.find_all(plain)
    assert base == every == [("assign", 2, 22)]
    code = base64.b64encode(gzip.compress(plain.encode())).decode()
    assert secrets.find_all(f"see {code} there")[1] == [("assign", 4, 4 + len(code))]
    escaped = "pass%77ord%3Dhunter22"
    assert ("assign", 2, 2 + len(escaped)) in secrets.find_all("a " + escaped)[1]
    mark = "\\u0073ecret: abcdefghijklmnopqr"
    assert secrets.find_all(mark)[1] == [("assign", 0, len(mark))]
    twice = base64.b64encode(base64.b64encode(plain.encode())).decode()
    assert secrets.find_all(twice)[1] == [("assign", 0, len(twice))]
    assert secrets.find_all("token: abc secret=abcde AKIA12 " + "f" * 23)[1] == []
    assert secrets.find_all(None) == ([], [])


def test_secrets_in_wrapped_and_long_layers(monkeypatch):
    import base64
    import gzip
    import zlib

    rng = np.random.default_rng(8)
    junk = " ".join(f"{i:x}" for i in rng.integers(0, 1 << 30, 60))
    plain = f'{junk} password = "hunter22" y'
    for raw in (plain.encode(), gzip.compress(plain.encode())):
        code = base64.encodebytes(raw).decode()
        for lines in (code, code.replace("\n", "\r\n  ")):
            assert ("assign", 5, 5 + len(lines.rstrip())) in secrets.find_all(f"see:\n{lines}\nthere")[1]
    body = base64.encodebytes((plain + "z" * (-len(plain) % 3)).encode()).decode().strip()
    assert ("assign", 20, 20 + len(body)) in secrets.find_all(f"---BEGIN MESSAGE---\n{body}\n-----END MESSAGE-----")[1]
    for mark in ("\u00a0", "\u200b", "\f"):
        code = base64.b64encode(f"{mark} secret: abcdefgh".encode()).decode()
        assert secrets.find_all(code)[1] == [("assign", 0, len(code))]
    deep = plain.encode()
    for _ in range(20):
        deep = zlib.compress(deep)
    many = gzip.compress(b"nothing here ") + gzip.compress(plain.encode())
    monkeypatch.setattr(secrets, "PIECE", 1 << 18)
    for raw in (deep, many, gzip.compress(b"a few words " * 400_000 + plain.encode())):
        code = base64.b64encode(raw).decode()
        assert secrets.find_all(code)[1] == [("assign", 0, len(code))]


def _wrapped(rng, text, how):
    """The text in one more layer; what is around it isn't part of the layer."""
    import base64
    import gzip

    code = lambda raw: base64.b64encode(raw).decode()
    if how == "url":
        return "".join(f"%{b:02x}" for b in text.encode())
    if how == "some":
        return "".join(f"%{ord(c):02X}" if c.isalnum() and rng.random() < 0.3 and ord(c) < 128 else c for c in text)
    if how == "unicode":
        return "".join(f"\\u{ord(c):04x}" if rng.random() < 0.5 else f"\\x{ord(c):02x}" for c in text)
    if how == "base64":
        return code(text.encode())
    if how == "gzip":
        return code(gzip.compress(text.encode()))
    if how == "zlib":
        return code(zlib.compress(text.encode()))
    if how == "deflate":
        c = zlib.compressobj(wbits=-15)
        return code(c.compress(text.encode() + b" and a little more text") + c.flush())
    return code(text.encode({"utf16": "utf-16-le", "utf16be": "utf-16-be", "bom": "utf-16"}[how]))


def test_secrets_in_any_nesting():
    rng = np.random.default_rng(12)
    kinds = ["url", "some", "unicode", "base64", "gzip", "zlib", "deflate", "utf16", "utf16be", "bom"]
    for depth in (1, 1, 1, 2, 3, 4, 5):
        for _ in range(12):
            text, how = "password=hunter22x", rng.choice(kinds, depth).tolist()
            for h in how:
                text = _wrapped(rng, text, h)
            found = secrets.find_all(f"see: {text} there")[1]
            assert any(k == "assign" and a >= 5 and b <= 5 + len(text) for k, a, b in found), how
    assert secrets.find_all("pass%77ord=hunter" + "z" * 100 + "%2B end")[1] == [("assign", 0, 120)]  # escapes far apart in one secret
    code = _wrapped(rng, "\0password=hunter22x\0", "base64")
    assert secrets.find_all(code)[1] == [("assign", 0, len(code))]


def test_secret_query_by_brute_force(spark):
    """Base columns of all documents by another scanner, written as loops over the contract's rules."""
    import regex

    assign = regex.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", regex.I | regex.A)

    def runs(text, allowed):
        start = None
        for i, c in enumerate(text + "\n"):
            if c in allowed:
                start = i if start is None else start
            elif start is not None:
                yield start, i
                start = None

    def scanned(text):
        found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [("hex", a, b) for a, b in runs(text, set("0123456789abcdef")) if b - a >= 24]
        upper, at = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 0
        while (at := text.find("AKIA", at)) >= 0:
            end = at + 4
            while end < len(text) and text[end] in upper:
                end += 1
            if end - at > 4 and end - at >= 20:
                found.append(("access", at, end))
            at = end if end - at > 4 else at + 1
        return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))

    docs = ship(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = queries.op5_secrets(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 20
    for r in got:
        want = scanned(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w[0] == k for w in want) for k in ("assign", "access", "hex")]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r.spans.split(","))


def test_secret_scan_of_odd_rows(odd, none):
    assert secrets.secret_scan(odd).count() == len(ODD) and secrets.secret_scan(none).count() == 0


def test_decontamination(spark, odd, none):
    item = "Which of the seven rivers of the northern plain reaches the sea without crossing a border of the old kingdom?"
    edited = item.upper().replace("SEVEN", "SEVN").replace("BORDER", "BORDERS")
    docs = ship(spark).createDataFrame([(1, "before " + item + " after"), (2, f"x {edited}!! y"), (3, item[:60]), (4, None), (5, "a clean text of other words " * 40)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, "tiny")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {1, 2} and got[1].edits == 0 and got[2].edits == 2
    assert (got[1].start, got[1].end) == (7, 7 + len(item) - 1)
    assert {r.doc_id for r in decontamination.decontaminated(docs, bench).collect()} == {3, 4, 5}
    assert decontamination.decontaminated(odd, bench).count() == len(ODD) and decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def _least_edits(item, text):
    """Edits of the best alignment of the whole item with any stretch of the text, by the full table."""
    row = np.zeros(len(text) + 1, int)
    t = np.array(list(text))
    for i, c in enumerate(item, 1):
        straight = np.r_[i, np.minimum(row[:-1] + (t != c), row[1:] + 1)]
        row = np.minimum.accumulate(straight - np.arange(len(straight))) + np.arange(len(straight))
    return int(row.min())


def test_decontamination_query_by_brute_force(spark, tmp_path):
    """Every document against every item by full tables, with edits up to the bound and beyond it."""
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(300)]
    items = [" ".join(rng.choice(words, int(rng.integers(4, 25)))) for _ in range(12)]
    plain = lambda t: " ".join(re.findall("[^\\W_]+", t.lower()))
    bound = {i: min(int(len(plain(t)) * 0.08), (len(plain(t)) - 8) // 8) for i, t in enumerate(items)}
    docs = []
    for d in range(90):
        text = list(" ".join(rng.choice(words, int(rng.integers(0, 60)))))
        if d % 3:
            i = int(rng.integers(len(items)))
            passage = list(items[i].upper() if d % 2 else items[i])
            for _ in range(int(rng.integers(0, bound[i] + 3))):
                at, what = int(rng.integers(len(passage))), int(rng.integers(3))
                passage[at : at + (what != 1)] = [] if what == 2 else [str(rng.choice(list("qrs")))]
            at = int(rng.integers(len(text) + 1))
            text[at:at] = [" ", *passage, "! "]
        docs.append((d, "".join(text)))
    ship(spark).createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {(d, i): n for d, t in docs for i, x in enumerate(items) if (n := _least_edits(plain(x), plain(t))) <= bound[i]}
    got = {}
    for r in queries.op6_decontamination(spark, str(tmp_path)).collect():
        got[r.doc_id, r.item_id] = min(got.get((r.doc_id, r.item_id), 99), r.edits)
    assert got == want and 20 < len(want) < 60 and any(want.values())
    kept = decontamination.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_alignment_by_full_table():
    rng = np.random.default_rng(3)
    for _ in range(30):
        item = rng.integers(97, 101, 30).astype(np.uint32)
        text = np.r_[rng.integers(97, 101, 12), np.delete(item, [5]), rng.integers(97, 101, 9)].astype(np.uint32)
        text[20] = 97
        d = np.zeros((31, len(text) + 1), int)
        d[:, 0] = range(31)
        for i in range(1, 31):
            for j in range(1, len(text) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (item[i - 1] != text[j - 1]))
        assert decontamination.align(item, text, 8, 16, 6)[0] == d[-1].min()


def test_language(odd, none):
    known = language_id.train(odd, folds=1000)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(odd, known).collect()}
    assert got[1] == got[2] == got[8] == "und" and got[9] == "de" and got[7] == "en"
    assert language_id.identify(none, language_id.train(none)).count() == 0
    a, b = language_id.grams("ab cd " * 400_000), language_id.grams("ab cd " * 4)
    assert len(a[0]) == len(b[0]) and (a[1] == 100_000 * b[1]).all()


def _ranked(texts, size):
    """The most frequent 1- to 3-grams of texts, by counting strings."""
    grams = Counter()
    for t in texts:
        for word in re.findall("[^\\W\\d_]+", t.lower()):
            padded = f" {word} "
            grams.update(c for c in word)
            grams.update(padded[i : i + 2] for i in range(len(padded) - 1))
            grams.update(padded[i : i + 3] for i in range(len(padded) - 2))
    place = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return sorted(grams, key=lambda g: (-grams[g], place(g)))[:size]


def test_language_query_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(13)
    stems = {"aa": ["lorna", "mistel", "gora", "pelu"], "bb": ["krzt", "wol", "mistel", "schnu"], "cc": ["o\u00e9la", "ui", "pelu", "\u0436\u0438\u0437"]}
    rows = []
    for d in range(60):
        lang = "abc"[d % 3] * 2
        text = " ".join(str(rng.choice(stems[lang])) + str(rng.choice(["", "en", "a", "!", " 12"])) for _ in range(int(rng.integers(1, 40))))
        rows.append((d, text if d % 11 else [None, "", "12 !"][d % 3], lang if d % 7 else None))
    ship(spark).createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _, _ in rows}
    known = {x: _ranked([t for d, t, y in rows if y == x and t is not None and not out[d]], 400) for x in ("aa", "bb", "cc")}
    got = {r.doc_id: r for r in queries.op8_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for d, t, lang in rows:
        own, far = _ranked([t or ""], 400), {}
        for x, profile in known.items():
            rank = {g: i for i, g in enumerate(profile)}
            far[x] = sum(min(abs(rank[g] - i), 400) if g in rank else 400 for i, g in enumerate(own))
        best = min(sorted(far), key=far.get) if own else "und"
        assert (got[d].held_out, got[d].lang_pred) == (out[d], best)
        assert math.isclose(got[d].score, 1 - far[best] / (400 * len(own)) if own else 0.0, abs_tol=1e-12)


def _witten_bell(texts, order):
    """(tokens, vocabulary size, log10 score of a text, known tokens of a text) by counting n-grams in a dictionary."""
    grams, kids, after = Counter(), {}, Counter()
    for t in texts:
        w = [*low(t).split(), "."]
        for k in range(1, order + 1):
            padded = w if k == 1 else [".", *w]  # the end token stands before the first word
            grams.update(zip(*[padded[i:] for i in range(k)], strict=False))
    for g, c in grams.items():
        kids[g[:-1]] = kids.get(g[:-1], 0) + 1
        after[g[:-1]] += c
    n, v = after[()], kids.get((), 0)

    def p(h, w):
        if not h:
            return (grams[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        return (grams[(*h, w)] + kids[h] * p(h[1:], w)) / (after[h] + kids[h]) if h in kids else p(h[1:], w)

    def scored(t):
        w = [*low(t).split(), "."]
        base = sum(math.log10(p((), x)) for x in w)
        score = sum(math.log10(p(tuple([".", *w[:k]][-(order - 1) :]) if order > 1 else (), x)) for k, x in enumerate(w))
        return base, score, len(w), sum(grams[(x,)] > 0 for x in w)

    return n, scored


@pytest.mark.parametrize("order, tokens", [(2, 6_000_000), (3, 6_000_000), (3, 60), (4, 90)])
def test_trie_by_brute_force(spark, monkeypatch, order, tokens):
    monkeypatch.setattr(ngram_trie, "SHARD_TOKENS", tokens)
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "B", "c", "d", "e", "averyveryverylongword"], 12)) for _ in range(60)] + [None, ""]
    docs = ship(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = ngram_trie.train(docs, order=order)
    assert (len(model.levels[-1].numbers) > 3) == (tokens < 1000)
    n, scored = _witten_bell(texts, order)
    asked = ["a b zz c", "", "e d c b a a", "Averyveryverylongword averyveryverylongwordx d"]
    sizes, known, base, score = model.score(asked)
    want = [scored(t) for t in asked]
    assert (model.tokens, sizes.tolist(), known.tolist()) == (n, [w[2] for w in want], [w[3] for w in want])
    assert np.allclose(base, [w[0] for w in want], atol=1e-9)
    assert all(abs(s - w[1]) < 0.02 * w[2] for s, w in zip(score, want, strict=True))


def test_trie_query_by_brute_force(spark, monkeypatch, tmp_path):
    """The query itself, over documents of which it learns nine tenths, with several shards."""
    monkeypatch.setattr(ngram_trie, "SHARD_TOKENS", 400)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(80)], int(rng.integers(0, 60)))) if i % 9 else None) for i in range(150)]
    ship(spark).createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    n, scored = _witten_bell([t for i, t in rows if not out[i]], 2)
    got = {r.doc_id: r for r in queries.op2_ngram_trie(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and any(out.values())
    for i, t in rows:
        r, (base, score, size, known) = got[i], scored(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], size, known, n)
        assert math.isclose(r.base_score, base, abs_tol=1e-7) and abs(r.score - score) < 0.02 * size


def test_children_lie_inside_their_context():
    """Every (context, word) pair against a dictionary: pointers and context-relative values."""
    rng = np.random.default_rng(6)
    pairs = sorted({(int(c), int(w)) for c, w in zip(rng.integers(0, 300, 2000), rng.integers(0, 50, 2000), strict=True) if c % 7})
    context, word = np.array(pairs).T
    kinds = np.bincount(context, minlength=300)
    span = np.zeros(300, np.int64)
    span[kinds > 0] = word[np.cumsum(kinds)[kinds > 0] - 1] + 1
    shard = ngram_trie.Shard.__new__(ngram_trie.Shard)
    shard.base, shard.n_contexts = 0, 300
    coded = lambda x, u: (lambda h, a: ngram_trie.EliasFano(h[0], h[1], *a))(*ngram_trie.EliasFano.parts(x.astype(np.uint64), u))
    shard.pointers = coded(np.r_[0, np.cumsum(kinds)], len(pairs) + 1)
    shard.keys = coded((np.cumsum(span) - span)[context] + word, int(span.sum()) + 1)
    place = {p: i for i, p in enumerate(pairs)}
    c, w = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(60)))
    assert shard.children(c, w).tolist() == [place.get((int(a), int(b)), -1) for a, b in zip(c, w, strict=True)]
    assert [tuple(x) for x in np.column_stack(shard.parents(np.arange(len(pairs)))).tolist()] == pairs


def test_trie_of_odd_rows(odd, none):
    assert ngram_trie.score(odd, ngram_trie.train(odd), F.lit(False)).count() == len(ODD)
    assert ngram_trie.score(odd, ngram_trie.train(none), F.lit(True)).filter("n_known = 0").count() == len(ODD)


def test_token_files(spark, odd, none, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_BYTES", 200)  # several files a part
    stored = token_store.write_tokens(odd, queries.tokenizer_path())
    got = token_store.read_tokens(stored).orderBy("start", "n_tokens").collect()
    plain = Tokenizer.from_file(queries.tokenizer_path())
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [[*plain.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows]
    assert [r.doc_id for r in got] == [r[0] for r in rows] and [r.n_tokens for r in got] == list(map(len, ids))
    assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    dictionary = token_store.contents(f"{stored.folder}/dictionary")
    files = stored.files.orderBy("part", "seq").collect()
    assert sum(f.docs for f in files) == len(ODD) and len(files) == stored.n_files > 1
    readers = [token_store.Reader(f.path, dictionary) for f in files]
    assert [r.find(9).tolist() for r in readers if r.find(9) is not None] == [ids[-1]]
    with pytest.raises(ValueError):
        token_store.Reader(files[0].path, dictionary + b"x")
    named = odd.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    texts = token_store.write_tokens(named, queries.tokenizer_path())
    assert [r.doc_id for r in token_store.read_tokens(texts).orderBy("start", "n_tokens").collect()] == [None, "d1", "d2", "d4", "d5", "d6", "d7", "d7", "d8", "d9"]
    assert token_store.read_tokens(token_store.write_tokens(none, queries.tokenizer_path())).count() == 0


TRICKY = ["  a  b\n\n c  d  x", "there's a 'test' don't!!! 12,3 .. ,a\x85\tb\x00c \x1c d", "", "   ", "a　b c", "é ü× ÷a _b. ", "x <|endoftext|> y", "naïve, (Café)! 3.5\nwords;\nmore...", "<|endoftext|><|endoftext|>a<|endof", "text|>"]


@pytest.mark.parametrize("window", [1 << 20, 64])
def test_ids_are_those_of_the_plain_library(window, monkeypatch):
    monkeypatch.setattr(token_store, "WINDOW", window)
    monkeypatch.setattr(token_store, "HELD", 40)
    plain, e = Tokenizer.from_file(queries.tokenizer_path()), token_store.Encoder(queries.tokenizer_path())
    rng = np.random.default_rng(1)
    marks = [*"abcAB 12  \n\n\t\r.,;'!-_<|>", "<|endoftext|>", "<|endoftext", "|>", "é", "×", "÷", "ß", "ɏ", "ж", "中", "　", "\xa0", "\u0301", "'s", "'ll", "\0", "😀", "ª"]
    texts = TRICKY + ["".join(rng.choice(marks, n)) for n in rng.integers(0, 400, 200)]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    as_text = token_store.Encoder(queries.tokenizer_path(), special_as_text=True)
    assert 50256 in next(e.encode(["x <|endoftext|> y"])) and 50256 not in next(as_text.encode(["x <|endoftext|> y"]))


def test_licences(spark, odd, none):
    mit = next(t for n, k, t in license_scan.TEMPLATES if n == "MIT" and k == "text")
    docs = ship(spark).createDataFrame([(1, "Intro.\nReleased under the MIT License.\nEnd"), (2, "word " * 50 + mit.replace("copy", "kopy") + " word" * 50), (3, "nothing here"), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.license, r.kind): r for r in license_scan.license_scan(docs).collect()}
    assert set(got) == {(1, "MIT", "notice"), (2, "MIT", "text")}
    assert got[1, "MIT", "notice"].dice == 1.0 and 0.8 <= got[2, "MIT", "text"].dice < 1
    assert license_scan.license_scan(odd).count() == 0 and license_scan.license_scan(none).count() == 0


def test_licence_query_by_brute_force(spark, tmp_path):
    """All stretches of short texts against small templates: the best one is found, and every one that reaches the bound meets a finding."""
    rng = np.random.default_rng(17)
    vocabulary = [f"w{i}" for i in range(9)]
    templates = [(f"T{i}", "text", " ".join(rng.choice(vocabulary, n))) for i, n in enumerate((5, 9, 14, 22))]
    rows = []
    for d in range(80):
        text = rng.choice([*vocabulary, "x", "y"], int(rng.integers(0, 25))).tolist()
        for _ in range(int(rng.integers(0, 3))):
            passage = templates[int(rng.integers(4))][2].split()
            if rng.random() < 0.5:
                passage[int(rng.integers(len(passage)))] = "z"
            at = int(rng.integers(len(text) + 1))
            text[at:at] = passage
        rows.append((d, "  ".join(text)))
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string")
    got = license_scan.license_scan(docs, templates=templates).collect()
    bags = {n: Counter(zip(t.split(), t.split()[1:], strict=False)) for n, _, t in templates}
    found = 0
    for d, text in rows:
        w, reach = text.split(), []
        ends = [m.span() for m in re.finditer("[^ ]+", text)]
        for name, bag in bags.items():
            for a in range(len(w) - 1):
                own = Counter()
                for b in range(a + 1, len(w)):
                    own[w[b - 1], w[b]] += 1
                    dice = 2 * (own & bag).total() / (own.total() + bag.total())
                    if dice >= 0.8 - 1e-12:
                        reach.append((dice, name, ends[a][0], ends[b][1]))
        mine = [(r.dice, r.license, r.start, r.end) for r in got if r.doc_id == d]
        assert set(mine) <= set(reach) and (not reach) == (not mine)
        if reach:
            found += 1
            assert math.isclose(max(mine)[0], max(reach)[0])
            assert all(any(a < r[3] and b > r[2] for _, _, a, b in mine) for r in reach)
            assert all(x is y or x[3] <= y[2] or y[3] <= x[2] for x in mine for y in mine)
    assert found > 30


def test_licence_headers_have_their_own_name():
    gpl = next(t for n, k, t in license_scan.TEMPLATES if (n, k) == ("GPL-3.0", "header"))
    known = license_scan.Templates(license_scan.TEMPLATES, 0.8)
    cases = {
        "GPL-3.0": gpl,
        "GPL-2.0": gpl.replace("version 3", "version 2"),
        "AGPL-3.0": gpl.replace("GNU General", "GNU Affero General"),
        "LGPL-3.0": gpl.replace("GNU General", "GNU Lesser General"),
        "LGPL-2.1": gpl.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1").replace("program", "library"),
        "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at\nhttp://www.boost.org/LICENSE_1_0.txt)",
        "EPL-2.0": "are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/ SPDX-License-Identifier: EPL-2.0",
    }
    for name, text in cases.items():
        found = known.find(f"some words before it. {text} and some after")
        assert [known.names[f[0]][0] for f in found] == [name]


def test_mixing(spark, odd, none):
    rows = [(i, "w " * 10, "big" if i < 900 else "small") for i in range(1000)]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string, source string")
    drawn = mixing.mix(docs, max_repeats=2.0).collect()
    tokens = Counter()
    for r in drawn:
        tokens[r.source] += r.tokens
    assert {(r.source, r.budget) for r in drawn} == {("small", 2000), ("big", 8000)} and tokens == {"small": 2000, "big": 8000}
    assert max(r.epoch for r in drawn if r.source == "small") == 1
    assert mixing.mixed_documents(docs, max_repeats=2.0).count() == len(drawn)
    assert mixing.mix(odd).count() > 0 and mixing.mix(none).count() == 0
    for bad in ({"budget_ratio": 6.0, "max_repeats": 2.0}, {"target_entropy": 1.0, "max_repeats": None}):
        with pytest.raises(ValueError):
            mixing.mix(docs, **bad)


def test_mixing_by_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "w " * int(rng.choice([1, 3, 10, 200])), f"s{int(rng.integers(0, 4)) ** 2}") for i in range(1500)]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string, source string")
    size = {i: len(t.split()) for i, t, _ in rows}
    by = Counter()
    for i, _, s in rows:
        by[s] += size[i]
    total = sum(by.values())
    powers = {s: (n / total) ** 0.5 for s, n in by.items()}
    entropy = -sum(p / sum(powers.values()) * math.log(p / sum(powers.values())) for p in powers.values())
    got = mixing.mix(docs, target_entropy=entropy, max_repeats=None, budget_ratio=1.5).collect()
    assert abs(sum({r.source: r.budget for r in got}.values()) - 1.5 * total) <= len(by)
    for s, n in by.items():
        mine = [r for r in got if r.source == s]
        assert abs(mine[0].weight - powers[s] / sum(powers.values())) < 1e-4
        drawn = sum(r.tokens for r in mine)
        assert drawn + mine[0].short == mine[0].budget and 0 <= mine[0].short < 200
        times = Counter(r.doc_id for r in mine)
        full = mine[0].budget // n  # every document once an epoch, and in the last one at most once more
        assert all(full <= times[i] <= full + 1 for i, _, x in rows if x == s)
        slots = {(r.epoch, r.block): r.slot for r in mine}
        assert len(set(slots.values())) == len(slots) and sorted(slots, key=slots.get) == sorted(slots, key=lambda k: (k[0], slots[k]))
    assert Counter(r.doc_id for r in mixing.mixed_documents(docs, target_entropy=entropy, max_repeats=None, budget_ratio=1.5).collect()) == Counter(r.doc_id for r in got)


def test_columns_of_any_name_pass_through(spark, odd):
    names = ["__block", "__ord", "__source", "__lang_pred", "__dirty", "block", "ord", "source_", "cuts", "_block", "lang_pred", "h", "leader"]
    docs = odd.select("*", *[F.lit(700 + i).alias(n) for i, n in enumerate(names)])
    bench = spark.createDataFrame([(1, "a passage that is nowhere in these documents at all")], "item_id long, text string")
    for kept in (mixing.mixed_documents(docs), decontamination.decontaminated(docs, bench), language_id.recognised(docs, language_id.train(docs, folds=1000), 0.1)):
        assert kept.columns == docs.columns and kept.count() > 0
        assert [[r[n] for n in names] for r in kept.select(*names).distinct().collect()] == [list(range(700, 700 + len(names)))]
    with pytest.raises(ValueError):
        language_id.identify(docs, {})


def test_pipeline_of_odd_rows(spark, odd, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "some benchmark passage of a few words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


def test_pipeline_keeps_learned_languages_only(spark):
    import corpus_pipeline

    docs = ship(spark).read.parquet("/root/testdata/sf0.01/documents.parquet")
    noise = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "xqzv kjwp bgtr zzkq wvxj hqpl mnbv qwrt zxcv plkj",
    ]
    rows = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(rows, allowMissingColumns=True), "")
    assert kept.filter("doc_id < 0").count() == 0 and kept.count() == docs.count()


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    """Each stage on its predecessor's rows, against loops over plain Python values."""
    import corpus_pipeline

    rng = np.random.default_rng(31)
    stems = {"aa": [f"lo{c}na" for c in "abcdefghrst"] + ["mistel", "gora"], "bb": [f"kr{c}zt" for c in "aeioubdfgh"] + ["wol", "schnu"]}
    items = [" ".join(rng.choice(stems["aa"], 12)) for _ in range(3)]
    rows = []
    for d in range(70):
        lang = "aa" if d % 2 else "bb"
        if d % 5 == 4:  # a copy of an earlier document, in which up to two words differ
            words = rows[int(rng.integers(len(rows)))][1].split(" ")
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(len(words)))] = str(rng.choice(stems[lang]))
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(stems[lang], int(rng.integers(40, 90))))
        if d % 13 == 5:
            text += " " + items[d % 3].upper() + "!"
        if d % 17 == 3:
            text = " ".join("".join(rng.choice(list("xyqvjw"), 6)) for _ in range(12))  # no learned language
        rows.append((d, text, None if d % 17 == 3 else lang, f"s{d % 3}", len(text)))
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text_of, stage = {d: t for d, t, *_ in rows}, dict(corpus_pipeline.STAGES)
    run = lambda name, given: stage[name](spark, given, str(tmp_path)).collect()
    table = lambda found: spark.createDataFrame(found, docs.schema)

    first = run("language_id", docs)
    known = {x: _ranked([t for d, t, y, *_ in rows if y == x and zlib.crc32(str(d).encode()) % 5], 400) for x in stems}

    def score(t):
        own = _ranked([t], 400)
        far = [sum(min(abs(rank[g] - i), 400) if g in rank else 400 for i, g in enumerate(own)) for rank in ({g: i for i, g in enumerate(p)} for p in known.values())]
        return 1 - min(far) / (400 * len(own))

    assert sorted(r.doc_id for r in first) == [d for d in text_of if score(text_of[d]) >= corpus_pipeline.LEAST_LANGUAGE_SCORE] and 60 < len(first) <= 66

    second = run("near_dedup", table(first))
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in ((d, t.split()) for d, t in text_of.items())}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept, had = {r.doc_id for r in second}, {r.doc_id for r in first}
    assert had - kept == _not_first(had, similar) and len(had - kept) >= 3

    third = run("decontamination", table(second))
    plain = lambda t: " ".join(re.findall("[^\\W_]+", t.lower()))
    dirty = {d for d in kept if any(_least_edits(plain(x), plain(text_of[d])) <= min(int(len(plain(x)) * 0.08), (len(plain(x)) - 8) // 8) for x in items)}
    assert {r.doc_id for r in third} == kept - dirty and len(dirty) >= 3

    fourth = run("mixing", table(third))
    total, by = sum(len(r.text.split()) for r in third), Counter()
    for r in fourth:
        by[r.source] += len(r.text.split())
    assert all(0 <= total / 3 - n < 120 for n in by.values()) and len(by) == 3  # no limit binds: equal budgets, short by less than a document
    assert {tuple(r) for r in fourth} <= {tuple(r) for r in third}

    last = run("token_output", table(fourth))
    encode = Tokenizer.from_file(queries.tokenizer_path()).encode
    ids = {d: [*encode(t, add_special_tokens=False).ids, 2] for d, t in text_of.items()}
    want = sorted((r.doc_id, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes())) for r in fourth)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in last)
    assert [(d, n, c) for d, _, n, c in got] == want and [s for _, s, _, _ in got] == np.cumsum([0, *[n for _, n, _ in want]])[:-1].tolist()
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in whole) == got
