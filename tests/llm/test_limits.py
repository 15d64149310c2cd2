"""Limits that are refused, templates from a table, and recall of the pipeline's near-duplicate stage."""

from itertools import combinations

import numpy as np
import pytest

from tilewright.llm import license_scan, mixing, simhash
from tilewright.plans.session import ship


def test_a_tiny_source_isnt_repeated_without_end(spark):
    docs = ship(spark).createDataFrame([(0, "one", "tiny"), *((i, "w " * 400, "large") for i in range(1, 1001))], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="tiny"):
        mixing.mix(docs, target_entropy=0.69, max_repeats=None)
    got = mixing.mix(docs, target_entropy=0.05, max_repeats=None, most_epochs=1 << 40)
    assert got.filter("source = 'tiny'").count() > 1000


def test_notices_that_match_prose_need_a_licence_word(spark):
    rows = [(1, "The archive was released into the public domain after the war."), (2, "License: released into the public domain."), (3, "Released under the MIT License"), (4, "licensed under CC BY 4.0")]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.license) for r in license_scan.license_scan(docs).collect()} == {(2, "Unlicense"), (3, "MIT"), (4, "CC-BY-4.0")}


def test_templates_from_a_table(spark, monkeypatch):
    text = " ".join(f"clause{i}" for i in range(60))
    table = ship(spark).createDataFrame([("House-1.0", "text", text), (None, "text", "x"), ("Other", "text", " ".join(f"other{i}" for i in range(60)))], "name string, kind string, text string")
    docs = spark.createDataFrame([(1, f"before {text} behind"), (2, "nothing")], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in license_scan.license_scan(docs, templates=table).collect()] == [(1, "House-1.0")]
    monkeypatch.setattr(license_scan, "MOST_TEMPLATES", 100)
    with pytest.raises(ValueError):
        license_scan.license_scan(docs, templates=table)


def test_near_duplicates_of_the_test_tables_by_all_pairs(spark):
    """Every pair of different texts with a similarity of 0.8 is in one group, and no group holds more than such pairs join."""
    docs = ship(spark).read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    first: dict[str, int] = {}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    for d, t in rows:
        first.setdefault(t, d)
    sets = {d: np.unique(simhash.shingles(t, 5)) for t, d in first.items()}
    root = {d: d for d in sets}
    by: dict[int, list[int]] = {}
    for d, s in sets.items():
        for h in s.tolist() or [-1]:
            by.setdefault(h, []).append(d)
    for a, b in {(min(p), max(p)) for own in by.values() if len(own) < 60 for p in combinations(own, 2)}:
        if root[a] != root[b] and simhash.similar(sets[a], sets[b], 0.8):
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    want = {d for d, t in rows if root[first[t]] != d}
    assert {r.doc_id for r in simhash.verified_copies(docs).collect()} == want and len(want) > 20


@pytest.mark.parametrize("early", [4, 32])
def test_rows_of_large_keys_are_pairs_only_if_they_can_share_enough(spark, monkeypatch, early):
    monkeypatch.setattr(simhash, "EARLY", early)
    monkeypatch.setattr(simhash, "LARGE", 12)
    rng = np.random.default_rng(12)
    n, size, least = 146, simhash._prefix_size(146, 0.8), 0.8
    sets = {d: sorted(np.flatnonzero(rng.random(36) < (0.55 if d < 60 else 0.4)).tolist())[:size] for d in range(110)}
    for d in range(0, 110, 9):
        sets[d] = sorted({*sets[d], *range(36, 36 + d % 4)})[:size]  # small keys, too
    root = {d: 0 if d < 60 else d for d in sets}
    rows = [(k, d, n, d + 1000, size - len(keys) + i, root[d]) for d, keys in sets.items() for i, k in enumerate(keys)]  # keys that nobody else has come first
    named = ship(spark).createDataFrame(rows, "key long, doc_id long, n long, tag long, at int, root long")
    prefixes = spark.createDataFrame([(d, n, [1000 * (d + 1) + i for i in range(size - len(keys))] + keys) for d, keys in sets.items()], "doc_id long, n long, keys array<long>")
    holders = {k: [d for d in sets if k in sets[d]] for k in range(40)}
    large = {k: sum(root[d] == 0 for d in ds) for k, ds in holders.items() if len(ds) > simhash.LARGE}
    mixed = spark.createDataFrame([(k, len(holders[k]), top, 0) for k, top in large.items()], "key long, g long, top long, main long")
    met = [(a, b) for b in sets for a in sets if a < b and root[a] != root[b] and any(k in large for k in {*sets[a]} & {*sets[b]})]
    need = np.ceil(least / (1 + least) * 2 * n - 1e-9) - np.ceil(least * n - 1e-9) + 1
    want = {(b, a) for a, b in met if len({*sets[a]} & {*sets[b]}) >= need}
    got = [tuple(r) for r in simhash._by_large_keys(named, mixed, prefixes, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    tried = simhash._in_large_keys(named, mixed, least).count()
    assert len(want) <= tried and (tried < 0.2 * len(met) or early < 32)
