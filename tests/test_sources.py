"""Manifests of several dialects and workbooks, tables replaced part by part, p-values, and odd columns."""

import itertools
import zipfile

import pytest
from pyspark.sql import functions as F

from tilewright.functions import columns as C
from tilewright.functions import statistics
from tilewright.operators import manifest, splits
from tilewright.plans.session import ship
from tilewright.sources import manifests


def workbook(path, sheets):
    """A workbook with shared and inline strings, numbers, truth values and gaps."""
    words, parts = [], []
    for rows in sheets.values():
        body = ""
        for i, row in enumerate(rows, 1):
            cells = ""
            for j, v in enumerate(row):
                ref = f"{chr(65 + j)}{i}"
                if v is None:
                    continue
                if isinstance(v, bool):
                    cells += f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
                elif isinstance(v, str) and v.startswith("in:"):
                    cells += f'<c r="{ref}" t="inlineStr"><is><t>{v[3:]}</t></is></c>'
                elif isinstance(v, str):
                    words.append(v)
                    cells += f'<c r="{ref}" t="s"><v>{len(words) - 1}</v></c>'
                else:
                    cells += f'<c r="{ref}"><v>{v}</v></c>'
            body += f'<row r="{i}">{cells}</row>'
        parts.append(f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{w}</t></si>" for w in words) + "</sst>")
        for i, p in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", p)


def test_dialects_with_quoted_delimiters():
    assert manifests.dialect('id;name\n1;"a, b, c, d"\n2;"e, f, g, h"\n') == ";"
    assert manifests.dialect("id\tnote\n1\tx, y\n2\tz, w\n") == "\t"
    assert manifests.dialect("alone\nvalue\n") == ","
    with pytest.raises(manifests.csv.Error):
        manifests.dialect("alone\n\n", strict=True)


def test_a_folder_of_dialects_and_workbooks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name,score\n1,\"x, y\",1.5\n2,,2\n".encode())
    (tmp_path / "b.csv").write_text('id;name;flag\n3;"semi; colon";TRUE\n4;b;false\n')
    (tmp_path / "c.CSV").write_text("name\tid\ntab\t5\n")
    (tmp_path / "d.csv").write_text("id,name,score\n6,same,3\n")
    (tmp_path / "e.txt").write_text("not a manifest")
    (tmp_path / "f.csv").write_text("")
    workbook(tmp_path / "g.xlsx", {"first": [[None, None], ["id", "name", None, "score"], [7, "in:inline", None, 0.25], [None, None, None, None], [8, "shared"]], "second": [["id"], [99]]})
    ship(spark)
    got = manifests.read_manifests(spark, str(tmp_path))
    assert {f.name: f.dataType.simpleString() for f in got.schema.fields} == {"id": "bigint", "name": "string", "score": "double", "flag": "boolean", "unnamed_2": "string"}
    rows = {r.id: (r.name, r.score, r.flag) for r in got.collect()}
    assert rows == {1: ("x, y", 1.5, None), 2: (None, 2.0, None), 3: ("semi; colon", None, True), 4: ("b", None, False), 5: ("tab", None, None), 6: ("same", 3.0, None), 7: ("inline", 0.25, None), 8: ("shared", None, None)}
    assert [r.id for r in manifests.read_manifests(spark, str(tmp_path / "g.xlsx"), sheet="second").collect()] == [99]
    for bad in ("e.txt", "f.csv"):
        with pytest.raises(ValueError):
            manifests.read_manifests(spark, str(tmp_path / bad))
    text = manifests.read_manifests(spark, str(tmp_path / "a.csv"), infer=False)
    assert [f.dataType.simpleString() for f in text.schema.fields] == ["string"] * 3


def test_headers_that_are_long_quoted_or_repeated(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",".join(f"column_{i:04d}" for i in range(900)) + "\n" + ",".join(map(str, range(900))) + "\n")
    wide = manifests.read_manifests(spark, str(tmp_path / "a.csv"))
    assert len(wide.columns) == 900 and wide.first().column_0899 == 899
    (tmp_path / "b.csv").write_text('"two\nlines",x,x,\n1,2,3,4\n')
    assert manifests.read_manifests(spark, str(tmp_path / "b.csv"), multi_line=True).columns == ["two\nlines", "x", "x.1", "unnamed_3"]


def test_types_of_odd_columns(spark):
    df = spark.createDataFrame([(" 1 ", "1", "x", None, "1e3", "9" * 25), ("NaN", "true", "y", None, "-.5", "1")], "a string, b string, c string, d string, e string, f string")
    got = manifests.inferred(df)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "string", "string", "string", "double", "double"]
    assert got.collect()[1].a is None and manifests.inferred(df.limit(0)).count() == 0


def test_a_part_replaces_itself_only(spark, tmp_path):
    root, keys = f"{tmp_path}/tree", ["split", "level"]
    rows = ship(spark).createDataFrame([(i, "val" if i % 3 == 0 else "train", i % 2, 1) for i in range(60)], "k long, split string, level int, run int")
    with pytest.raises(ValueError):
        manifests.parts(spark, root, keys)
    manifests.replace_parts(rows, root, keys, "first")
    manifests.replace_parts(rows.filter("split = 'val' AND level = 1 AND k < 30").withColumn("run", F.lit(2)), root, keys, "second")
    got = manifests.read_parts(spark, root).collect()
    assert len(got) == 60 - 5 and {r.k for r in got if r.run == 2} == {3, 9, 15, 21, 27} and all(r.run == 1 for r in got if (r.split, r.level) != ("val", 1))
    state = {r.part: r for r in manifests.parts(spark, root, keys).collect()}
    assert len(state) == 4 and all(r.whole for r in state.values()) and state['{"split":"val","level":"1"}'].run == "second"
    manifests.read_parts(spark, root).filter("split = 'train' AND level = 0 AND k < 20").write.mode("overwrite").parquet(f"{root}/data/split=train/level=0x")
    with pytest.raises(ValueError):
        manifests.replace_parts(rows.drop("level"), root, keys)


def test_a_run_that_died_before_its_commit_is_told(spark, tmp_path):
    root, keys = f"{tmp_path}/tree", ["split"]
    rows = spark.createDataFrame([(i, "val" if i % 3 == 0 else "train") for i in range(30)], "k long, split string")
    manifests.replace_parts(rows, root, keys)
    rows.filter("split = 'val' AND k < 9").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(f"{root}/data")
    assert {r.part: r.whole for r in manifests.parts(spark, root, keys).collect()} == {'{"split":"val"}': False, '{"split":"train"}': True}


# p-values


def test_u_by_enumeration():
    for m, n in itertools.product(range(1, 6), repeat=2):
        counts = [0] * (m * n + 1)
        for own in itertools.combinations(range(m + n), m):
            counts[sum(j < i for i in own for j in set(range(m + n)) - set(own))] += 1
        assert statistics.u_counts(m, n) == tuple(counts)
        for u in range(m * n + 1):
            extreme = sum(c for v, c in enumerate(counts) if v >= max(u, m * n - u))
            assert abs(statistics.mann_whitney_p(u, m, n, 0) - min(1, 2 * extreme / sum(counts))) < 1e-12


def test_tails_by_integration():
    def area(density, low, high, steps=200_000):
        h = (high - low) / steps
        return sum((1 if i in (0, steps) else 4 if i % 2 else 2) * density(low + i * h) for i in range(steps + 1)) * h / 3

    from math import exp, lgamma, log1p, pi, sqrt

    for rho, n in ((0.3, 12), (0.05, 900), (-0.7, 6), (0.01, 40_000)):
        df = n - 2
        t = abs(rho) * sqrt(df / (1 - rho * rho))
        density = lambda x, df=df: exp(lgamma((df + 1) / 2) - lgamma(df / 2) - (df + 1) / 2 * log1p(x * x / df)) / sqrt(df * pi)
        assert abs(statistics.correlation_p(rho, n) - (1 - 2 * area(density, 0, t))) < 1e-9
    assert statistics.correlation_p(1.0, 9) == 0 and statistics.correlation_p(0.0, 9) == 1 and statistics.correlation_p(0.5, 2) is None


def test_published_p_of_published_rho():
    published = [(0.7285860920645361, 2.1291957781443115e-31), (0.37492370936551617, 1.841890321470303e-07), (0.026701663922772425, 0.7204877324291363)]
    for rho, p in published:
        assert abs(statistics.correlation_p(rho, 182) / p - 1) < 1e-10


def test_screening_of_small_groups_and_ties(spark):
    rows = [("small", g, float(v)) for g, v in ((0, 1), (0, 4), (0, 2), (1, 3), (1, 5), (1, 9), (1, 7))] + [("tied", g, 1.0) for g in (0, 1, 0, 1)] + [("alone", 0, 1.0), ("small", 0, None)]
    got = {r.variable: r for r in splits.mann_whitney(ship(spark).createDataFrame(rows, "variable string, grp int, value double")).collect()}
    assert (got["small"].n0, got["small"].n1, got["small"].u) == (3, 4, 1.0) and abs(got["small"].p - 2 * 2 / 35) < 1e-12
    assert got["tied"].p == 1.0 and got["alone"].p is None
    pairs = spark.createDataFrame([("v", 1.0, 2.0), ("v", 2.0, 1.0), ("v", 3.0, 5.0), ("v", 4.0, 4.0), ("v", None, 4.0)], "variable string, x double, y double")
    r = splits.spearman_test(pairs).first()
    assert (round(r.rho, 12), r.n) == (0.6, 4) and abs(r.p - 0.4) < 1e-12


# White space and column names


def test_all_white_space_is_stripped(spark):
    rows = [("\tYes\n",), ("\xa0 yes\x1f",), ("\t",), ("　",), ("a b",), (None,)]
    got = spark.createDataFrame(rows, "c string").select(C.truthy(F.col("c")).alias("t"), C.filled(F.col("c")).alias("f"), C.normal(F.col("c")).alias("n")).collect()
    assert [r.t for r in got] == [True, True, False, False, False, False]
    assert [r.f for r in got] == ["Yes", "yes", None, None, "a b", None] and all(r.n == (v or "").strip().lower() for r, (v,) in zip(got, rows, strict=True))


def test_columns_of_reserved_names_stay(spark):
    rows = spark.createDataFrame([("s1", 1, 2, 3)], "name string, __key int, key int, __rn int")
    files = spark.createDataFrame([("/x/S1.svs",)], "path string")
    assert manifest.match_files(rows, "name", files).first().asDict() == {"name": "s1", "__key": 1, "key": 2, "__rn": 3, "match": "/x/S1.svs", "tier": 1}
    assert manifest.keep_first(rows, ["name"], [F.col("key")]).columns == rows.columns


def test_a_large_part_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from tilewright.operators import groups
    from tilewright.sources import manifests

    monkeypatch.setattr(groups, "ROWS", 100)
    rows = spark.range(1000).select(F.when(F.col("id") < 900, F.lit("a")).when(F.col("id") < 950, F.lit("b")).alias("split"), "id")
    manifests.replace_parts(rows, str(tmp_path / "t"), ["split"])
    back = manifests.read_parts(spark, str(tmp_path / "t"))
    files = {r.split: (r.files, r.n) for r in back.withColumn("file", F.input_file_name()).groupBy("split").agg(F.count_distinct("file").alias("files"), F.count_distinct("id").alias("n")).collect()}
    assert back.count() == 1000 and files["a"][0] > 3 and files["a"][1] == 900 and files["b"] == (1, 50) and files[None] == (1, 50)
