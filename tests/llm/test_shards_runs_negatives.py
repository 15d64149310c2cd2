"""Shards, runs and hard negatives against brute force, on odd rows, and their queries on small tables."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import hard_negatives, periodic, queries, sharding
from tilewright.plans.session import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, slot long, row long"
ODD = [
    (5, None, None, None, None, 1, 1, 1, 1),
    (None, "", "en", "a", 0, None, None, None, None),
    (None, "ä ö ü", "en", "a", 0, None, None, None, None),
    (7, "the same row", "en", "a", 1, 2, 3, 4, 5),
    (7, "the same row", "en", "a", 1, 2, 3, 4, 5),
    (-3, "x" * 50_000, "de", "c", 1, 1, 1, 1, 1),
    (8, "one\ttwo\n three", "de", "c", 1, 1, 1, 1, 1),
    (9, "a b " * 400, "de", "c", 1, 1, 1, 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return ship(spark).createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return ship(spark).createDataFrame([], DOCS)


# Sharding


def _check_shards(rows, n):
    """rows: (key, size, shard, slot). Slots are gapless and in the order of the keys; each border is as near to its share as whole rows allow."""
    by = {}
    for key, size, shard, slot in rows:
        by.setdefault(shard, []).append((slot, key, size))
    assert set(by) <= set(range(n))
    order = []
    for s in sorted(by):
        own = sorted(by[s])
        assert [x[0] for x in own] == list(range(len(own)))
        order += [x[1] for x in own]
    assert order == sorted(order)
    total, largest = sum(r[1] for r in rows), max(r[1] for r in rows)
    ends = np.cumsum([sum(x[2] for x in by.get(s, [])) for s in range(n)])
    assert all(abs(e - total * (s + 1) / n) <= largest / 2 + 1 for s, e in enumerate(ends))


@pytest.mark.parametrize("n, range_bytes", [(1, 1 << 20), (7, 1 << 20), (7, 2_000), (40, 1 << 20)])
def test_shards_are_equal_and_in_order(spark, n, range_bytes):
    rng = random.Random(n)
    ids = [*{rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)}, *range(300)]
    docs = ship(spark).createDataFrame([(i, "é" * rng.randrange(60)) for i in ids], "doc_id long, text string")
    got = sharding.shard(docs, n, tolerance=0.0, range_bytes=range_bytes).collect()
    assert all(r["size"] == len(r.text.encode()) + 16 for r in got) and len(got) == len(ids)
    _check_shards([(r.doc_id, r["size"], r.shard, r.slot) for r in got], n)


def test_a_third_of_all_rows_with_one_key_is_split(spark):
    rows = [(None, "the same")] * 150 + [(1, "the same")] * 50 + [(i, f"text {i}") for i in range(2, 200)]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(docs, 10, tolerance=0.0).collect()
    assert sorted(r.slot for r in got if r.shard == 0) == list(range(sum(r.shard == 0 for r in got)))
    _check_shards([(-1 if r.doc_id is None else r.doc_id, r["size"], r.shard, r.slot) for r in got], 10)


def test_tolerance_bounds_the_borders(spark):
    docs = ship(spark).createDataFrame([(i * i, "x" * (i % 9)) for i in range(3000)], "doc_id long, text string")
    got = sharding.shard(docs, 5, tolerance=0.05).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    share = sum(r.n for r in got) / 5
    ends = np.cumsum([r.n for r in sorted(got)])
    assert all(abs(e - share * (s + 1)) <= 0.05 * share + 25 for s, e in enumerate(ends))


def test_shards_of_odd_rows(odd, none):
    got = sharding.shard(odd, 3)
    assert got.columns == [*odd.columns, "_size", "_shard", "_slot"]
    rows = got.collect()
    assert sorted(map(repr, (tuple(r)[:9] for r in rows))) == sorted(map(repr, ODD))
    assert {r.doc_id: r._size for r in rows}[5] == 16
    assert sharding.shard(none, 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(odd, 0)


def test_written_shards_come_back(spark, odd, tmp_path):
    sharding.write_shards(odd.select("doc_id", "text"), 3, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD) and {r.shard for r in back.collect()} <= {0, 1, 2}


def test_sharding_query_by_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i * 3, None if i % 50 == 0 else " ".join(rng.choices("ab é word".split(" "), k=rng.randrange(90)))) for i in range(700)]
    ship(spark).createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_sharding(spark, str(tmp_path)).collect()
    text = dict(rows)
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    assert {r.shard for r in got} == set(range(40))
    _check_shards([(r.doc_id, r["size"], r.shard, r.slot) for r in got], 40)


# Runs


def _brute_runs(words, shortest, exponent):
    n, out = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i:
                if j - i + p >= max(shortest, exponent * p):
                    out.setdefault((i, j - i + p), p)
                i = j
            else:
                i += 1
    return sorted(((i, n, p) for (i, n), p in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            kinds, n = rng.choice([1, 2, 2, 3, 5, 40]), rng.choice([0, 1, 5, 20, 60, 120])
            d = [rng.randrange(kinds) for _ in range(n)]
            if rng.random() < 0.6 and n > 4:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 2))
                d = [d[i] if i < a else d[a + (i - a) % p] for i in range(n)]
                if rng.random() < 0.5:
                    d = [*d, rng.randrange(kinds), *d]
            docs.append(d)
        shortest, exponent = rng.choice([(1, 2), (4, 2), (6, 3), (24, 3), (10, 2), (2, 3)])
        assert periodic.runs_of([np.array(d, np.int64) for d in docs], shortest, exponent) == [_brute_runs(d, shortest, exponent) for d in docs]


def test_longest_previous_factors_by_definition():
    rng = random.Random(4)
    for _ in range(60):
        d = [rng.randrange(rng.choice([1, 2, 4])) + 5 for _ in range(rng.randrange(1, 40))]
        lengths, sources = periodic.previous_factors(periodic.Suffixes(np.array([*d, 0])))
        same = lambda i, j, d=d: next((k for k in range(len(d) - j) if d[i + k] != d[j + k]), len(d) - j)
        for j in range(len(d)):
            assert lengths[j] == max((same(i, j) for i in range(j)), default=0)
            assert not lengths[j] or sources[j] < j and same(sources[j], j) == lengths[j]


def test_runs_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in periodic.find_runs(odd).collect()}
    assert (got[5].n_words, got[5].runs, got[5].collapsed) == (0, [], "")
    assert [tuple(x) for x in got[9].runs] == [(0, 800, 2)] and got[9].collapsed == "a b"
    assert got[8].collapsed == "one two three" and got[None].runs == []
    assert periodic.find_runs(odd).count() == len(ODD) and periodic.find_runs(none).count() == 0
    assert periodic.digest(periodic.find_runs(periodic.planted(odd))).count() == len(ODD)


def test_a_long_document_is_worked_on_whole():
    rng = np.random.default_rng(1)
    d = np.r_[rng.integers(0, 50, 150_000), np.tile(rng.integers(0, 50, 5_000), 30), rng.integers(0, 50, 1000)]
    assert any(p == 5_000 and n >= 150_000 for _, n, p in periodic.runs_of([d])[0])


def test_periodic_query_by_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, None if i % 40 == 0 else " \n".join(rng.choices(["a", "b", "Ä", "Ab,"][: rng.randint(1, 4)], k=rng.randrange(140)))) for i in range(260)]
    ship(spark).createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op12_periodic(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    changed = 0
    for d, text in rows:
        w = (text or "").split()
        h, n = zlib.crc32(str(d).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = _brute_runs(w, 24, 3)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want = (d, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4))
        digests = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        assert tuple(got[d]) == (*want, *digests)
    assert changed > 10 and sum(r.n_runs > 0 for r in got.values()) > 40


# Hard negatives

VECTORS = "vec_id long, label int, embedding array<double>, part int, rank int, score long"


def _brute_negatives(rows, anchors, positives=5, negatives=10):
    rows = {(i, y, tuple(int(np.floor(256 * x)) for x in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, y, v in rows:
        if not anchors(i):
            continue
        score = lambda w, v=v: sum(a * b for a, b in zip(v, w, strict=False))
        near = sorted((-score(w), j) for j, x, w in rows if x == y and j != i)[:positives]
        other = sorted((-score(w), j) for j, x, w in rows if x != y and j != i)
        for s, p in near:
            fits = [(-n, j) for n, j in other if 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out += [(i, p, k, j, -s, n) for k, (n, j) in enumerate(fits, 1)]
    return sorted(out)


def _vectors(seed, n, width, like=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    x = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, width))
    x[rng.random(n) < like] = x[0]  # one very common vector
    return [(int(i), int(rng.integers(0, 4)), [float(a) for a in v]) for i, v in zip(rng.permutation(n), np.round(x, 3), strict=True)]


@pytest.mark.parametrize("like, leaf, part, sample", [(0.0, 256, 1000, 4096), (0.4, 8, 50, 64), (0.0, 4, 40, 100), (0.9, 4, 40, 100)])
def test_hard_negatives_by_brute_force(spark, monkeypatch, like, leaf, part, sample):
    for name, value in (("LEAF", leaf), ("LEAST_PART", part), ("SAMPLE", sample), ("LEAST_CELL", 8)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = _vectors(11, 400, 5, like)
    table = ship(spark).createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, hard_negatives.hard_negatives(table, F.col("vec_id") % 9 == 0).collect()))
    assert got == _brute_negatives(rows, lambda i: i % 9 == 0) and len(got) > 300


def test_hard_negatives_of_odd_rows(spark):
    rows = _vectors(12, 60, 3)
    odd = [(None, 1, [1.0, 1.0, 1.0]), (200, None, [1.0, 1.0, 1.0]), (201, 1, None), (202, 1, [1.0, None, 1.0]), (203, 2, [1.0, float("nan"), 0.0]), (204, 2, [float("inf"), 1.0, 0.0]), (205, 1, []), (206, 2, [2.0]), rows[0], rows[0], (rows[1][0], 3, rows[5][2])]
    every = [*rows, *odd]
    table = ship(spark).createDataFrame([(i, y, v, 1, 2, 3) for i, y, v in every], VECTORS)
    got = sorted(map(tuple, hard_negatives.hard_negatives(table, F.col("vec_id") % 5 == 0).collect()))
    assert got == _brute_negatives(every, lambda i: i % 5 == 0) and got
    assert hard_negatives.hard_negatives(table.filter("vec_id < 0"), F.lit(True)).count() == 0
    assert hard_negatives.hard_negatives(table.limit(1), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(1, 1, [1e300])], "vec_id long, label int, embedding array<double>"), F.lit(True))


def test_the_tree_prunes():
    """Points far from an anchor's window aren't scored."""
    rng = np.random.default_rng(3)
    points = np.floor(np.r_[rng.normal(0, 2, (2000, 4)) + [500, 0, 0, 0], rng.normal(0, 2, (2000, 4)) - [500, 0, 0, 0]])
    tree = hard_negatives.Balls(np.arange(4000), np.arange(4000) % 3, points, 5)
    seen = []

    class Counting(hard_negatives.Asked):
        def take(self, w, ids, labels, points):
            seen.append(len(ids))
            super().take(w, ids, labels, points)

    asked = Counting(np.array([-1]), np.array([0]), np.array([[10.0, 0, 0, 0]]), np.array([0]), np.array([hard_negatives.NONE]), np.array([hard_negatives.MOST]), 5, True)
    tree.search(asked)
    scores = sorted(((points[i] * [10, 0, 0, 0]).sum(), -i) for i in range(0, 4000, 3))[::-1][:5]
    assert [(-j, s) for s, j in scores] == list(zip(asked.found[0], asked.scores[0], strict=True)) and sum(seen) < 2000
