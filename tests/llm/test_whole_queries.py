"""Registered queries, as they are, on whole small tables against brute force."""

import glob
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from tokenizers import Tokenizer

from tilewright.llm import hard_negatives, license_scan, queries, simhash
from tilewright.plans.session import ship

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [tuple(r) for r in ship(spark).read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


def test_op1_draws_what_the_weights_ask_for(spark):
    rows = documents(spark)
    size, source = {d: len((t or "").split()) for d, t, _ in rows}, {d: s or "" for d, _, s in rows}
    by = Counter()
    for d, n in size.items():
        by[source[d]] += n
    total = sum(by.values())
    by = {s: n for s, n in by.items() if n}
    repeats = lambda a: max((n / total) ** (a - 1) for n in by.values()) / sum((n / total) ** a for n in by.values())
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if repeats(mid) <= 4 else (mid, high)
    alpha = 0.0 if repeats(0.0) <= 4 else high
    z = sum((n / total) ** alpha for n in by.values())
    got = queries.op1_mixing(spark, SF).collect()
    assert {r.source for r in got} == set(by)
    for s, n in by.items():
        own = [r for r in got if r.source == s]
        assert abs(own[0].weight - (n / total) ** alpha / z) < 1e-6 and abs(own[0].budget - own[0].weight * total) <= 1
        assert sum(r.tokens for r in own) + own[0].short == own[0].budget and own[0].short >= 0
        times, full = Counter(r.doc_id for r in own), own[0].budget // n
        assert all(full <= times[d] <= full + 1 for d in size if source[d] == s and size[d])


def test_op3_groups_are_those_of_all_pairs(spark):
    fps = {d: simhash.fingerprint(t) for d, t, _ in documents(spark)}
    root = {d: d for d in fps}
    for a, b in combinations(sorted(fps), 2):
        if root[a] != root[b] and (fps[a] ^ fps[b]).bit_count() <= 2:
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    got = {r.doc_id: r for r in queries.op3_simhash(spark, SF).collect()}
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{f:016x}", root[d]) for d, f in fps.items()}
    assert len(set(root.values())) < len(root)


def test_op9_reads_back_the_plain_library_s_ids(spark):
    encode, start = Tokenizer.from_file(queries.tokenizer_path()).encode, 0
    got = {r.doc_id: r for r in queries.op9_token_store(spark, SF).collect()}
    rows = sorted(documents(spark))
    for d, t, _ in rows:
        ids = [*encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(got[d])[:4] == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_op10_finds_what_its_templates_reach(spark, tmp_path):
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    rng = np.random.default_rng(3)
    picked = [x for x in license_scan.TEMPLATES if 5 < len(words(x[2])) < 60]
    rows = []
    for d, (_, _, text) in enumerate(picked):
        w = text.split(" ")
        if d % 2:
            w[int(rng.integers(len(w)))] = "zzz"
        rows.append((d, " ".join(["some", "prose", "before", *w, "and", "more", "behind"])))
    rows += [(900, "nothing of the kind in these few words"), (901, None)]
    ship(spark).createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_license_scan(spark, str(tmp_path)).collect()
    bags = [(n, Counter(zip(words(t), words(t)[1:], strict=False))) for n, _, t in license_scan.TEMPLATES]
    for d, text in rows:
        w, best = words(text or ""), 0.0
        for _, bag in bags:
            for a in range(len(w)):
                own = Counter()
                for b in range(a + 1, len(w)):
                    own[w[b - 1], w[b]] += 1
                    if own.total() * 2 > 3 * bag.total():
                        break
                    best = max(best, 2 * (own & bag).total() / (own.total() + bag.total()))
        mine = [r for r in got if r.doc_id == d]
        assert bool(mine) == (best >= 0.8 - 1e-12) and (not mine or math.isclose(max(r.dice for r in mine), best))


def test_op13_equals_all_pairs_in_sql(spark):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/embeddings.parquet"):
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{p}'")
    want = con.execute(hard_negatives.PAIRS_SQL).fetchall()
    got = queries.op13_hard_negatives(spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
