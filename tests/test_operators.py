"""Published figures, brute force and edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import columns as C
from tilewright.operators import groups as G
from tilewright.operators import manifest as M
from tilewright.operators import regions as R
from tilewright.operators import scores as S
from tilewright.operators import splits as P
from tilewright.plans import views as V


def pairs(spark, matrix):
    rows = [(i + 1, j + 1) for i, r in enumerate(matrix) for j, n in enumerate(r) for _ in range(n)]
    return spark.createDataFrame(rows, "target int, pred_label int")


@pytest.mark.parametrize("tn,fp,fn,tp,f1,spec", [(1850, 919, 97, 577, 0.5317972350, None), (22, 15, 0, 9, 0.5454545455, 0.5945945946), (16, 26, 0, 4, 0.2352941176, 0.3809523810)])
def test_binary_metrics(spark, tn, fp, fn, tp, f1, spec):
    df = spark.createDataFrame([(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp, "target int, pred_label int").withColumn("g", F.lit(1))
    r = S.binary_metrics(df, ["g"]).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (tn, fp, fn, tp)
    assert math.isclose(r.f1, f1, abs_tol=1e-9) and (spec is None or math.isclose(r.specificity, spec, abs_tol=1e-9))


def test_multiclass_over_labels_that_occur(spark):
    df = pairs(spark, [[17, 15, 0, 0, 0], [1, 10, 0, 0, 0], [0, 2, 0, 0, 0], [0, 0, 0, 0, 0], [0, 1, 0, 0, 0]])
    r = S.multiclass_metrics(df, [1, 2, 3, 4, 5]).first()
    assert np.allclose(list(r), [0.5869565217, 0.2982051282, 0.5956744705], atol=1e-9)
    assert math.isclose(S.quadratic_kappa(df).first().kappa, 0.3545918367, abs_tol=1e-9)


def test_one_class_has_no_ranking(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "target int, score double").withColumn("g", F.lit(1))
    assert S.ranking_metrics(df, ["g"]).first().auroc is None


def test_screening(spark):
    r = P.effect(spark.createDataFrame([("v", 145, 37, 412.0)], "variable string, n0 long, n1 long, u double")).first()
    assert math.isclose(r.delta, 0.8464119292, abs_tol=1e-9) and r.magnitude == "large"


def test_grid_of_the_template_box(spark):
    box = spark.createDataFrame([(1, 12000, 0, 24000, 256)], "unit long, bbox_x long, bbox_y long, bbox_w long, bbox_h long")
    x = [r.tile_x for r in R.grid(box, 256, 128).collect()]
    assert (len(x), max(x)) == (186, 35680)
    assert max(r.tile_x for r in R.grid(box, 256, 128, aligned=True).collect()) == 35744


def test_farthest_picks_by_brute_force():
    rng = np.random.default_rng(0)
    xy, tissue = rng.integers(0, 50, (40, 2)).astype(float), rng.random(40)
    got, want = R.farthest(xy, tissue, 8, [int(tissue.argmax())]), [int(tissue.argmax())]
    while len(want) < 8:
        rest = [i for i in range(40) if i not in want]
        want.append(max(rest, key=lambda i: (min(((xy[i] - xy[j]) ** 2).sum() for j in want), tissue[i], -i)))
    assert got == want


def test_cleaning(spark):
    df = spark.createDataFrame([(" 3 ",), ("2.0",), ("x",), ("nan",), (None,)], "s string")
    got = df.select(C.number(F.col("s")).alias("n"), C.whole(F.col("s"), 0).alias("w"), C.token(F.col("s")).alias("t")).collect()
    assert [tuple(r) for r in got] == [(3.0, 3, "3"), (2.0, 2, "2_0"), (None, 0, "x"), (None, 0, "nan"), (None, 0, "unknown")]


def test_bad_settings_are_refused(spark):
    df = spark.createDataFrame([(1, 1, 0.5)], "unit int, tile int, prob double")
    for bad in (lambda: S.unit_scores(df, top_k=0), lambda: S.unit_scores(df, "median"), lambda: R.selected(df, "other"), lambda: M.required(df, ["nope"])):
        with pytest.raises(ValueError):
            bad()


def test_split_of_a_class_with_one_unit(spark):
    with pytest.raises(ValueError):
        P.stratified(spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "unit int, target int"), "unit", "target", 0.5, 1)


def test_plateau_and_stopping_with_nan(spark):
    h = spark.createDataFrame([(1, e, m) for e, m in enumerate([0.5, 0.6, float("nan"), 0.6, 0.59, 0.7])], "run int, epoch long, metric double")
    assert [r.waited for r in P.early_stopping(h, "run", 3).orderBy("epoch").collect()] == [0, 0, 1, 2, 3, 0]
    assert P.plateau(h, "run", 1.0, 0.5, 1).first().lr == 0.5


def test_overlaps_by_the_rule(spark):
    """Cuts compare x only, stay inside the pair's outer edges, and may widen a box; brute force over random rows of boxes."""
    rng = np.random.default_rng(11)
    rows = [(1, 1, 10.0, 0, 0, 30, 10), (1, 2, 20.0, 20, 500, 10, 10)]
    for s in range(2, 60):
        cx = np.sort(rng.integers(0, 100, int(rng.integers(1, 6))))
        rows += [(s, i + 1, float(c) + 0.5, int(c) - int(rng.integers(0, 40)), int(rng.integers(0, 90)), int(rng.integers(1, 70)), 10) for i, c in enumerate(cx)]
    df = spark.createDataFrame(rows, "slide long, component_rank int, cx double, bbox_x long, bbox_y long, bbox_w long, bbox_h long")
    got = {(r.slide, r.component_rank): (r.bbox_x, r.bbox_x + r.bbox_w, r.failed, r.persisted, r.corrected) for r in R.without_overlap(df).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == s], key=lambda r: (r[2], r[1]))
        edges, failed, any_cut = [[r[3], r[3] + r[5]] for r in mine], [False] * len(mine), False
        for i in range(len(mine) - 1):
            (a, b), (c, d) = edges[i], edges[i + 1]
            if b > c:
                middle = max(a + 1, min(round((mine[i][2] + mine[i + 1][2]) / 2), d - 1))
                if middle < d:
                    edges[i][1] = edges[i + 1][0] = middle
                    any_cut = True
                else:
                    failed[i] = True
        for i, r in enumerate(mine):
            want[s, r[1]] = (*edges[i], failed[i], i + 1 < len(mine) and edges[i][1] > edges[i + 1][0], any_cut)
    assert got == want and got[1, 1][:2] == (0, 15) and got[1, 2][:2] == (15, 30)
    assert any(v[2] for v in want.values()) and any(v[3] for v in want.values())


def test_normalised_picks_take_all_seeds(spark):
    rng = np.random.default_rng(3)
    rows = [(u, int(x), int(y), float(rng.random()), 0, 0, 400, 400) for u in (1, 2) for x, y in {(int(a), int(b)) for a, b in rng.integers(0, 300, (60, 2))}]
    rows += [(3, 5, 5, 0.5, 0, 0, 400, 400)]
    tiles = spark.createDataFrame(rows, "unit long, tile_x long, tile_y long, tissue double, bbox_x long, bbox_y long, bbox_w long, bbox_h long")
    got = {u: [(r.tile_x, r.tile_y) for r in sorted(R.spread(tiles, 12, 100, True, 3).collect(), key=lambda r: r.pick) if r.unit == u] for u in (1, 2, 3)}
    for u in (1, 2):
        mine = sorted([r for r in rows if r[0] == u], key=lambda r: (r[2], r[1]))
        centre = {(r[1], r[2]): (min((r[1] + 50) / 400, 1.0), min((r[2] + 50) / 400, 1.0)) for r in mine}
        tissue = {(r[1], r[2]): r[3] for r in mine}
        best = {}
        for p, (x, y) in centre.items():
            key = (min(int(min(y, 0.999999) * 3), 2), min(int(min(x, 0.999999) * 3), 2))
            if key not in best or (-tissue[p], p[1], p[0]) < (-tissue[best[key]], best[key][1], best[key][0]):
                best[key] = p
        want = [best[k] for k in sorted(best, key=lambda k: (-tissue[best[k]], k))][:12]
        assert len(want) == 9  # every bin has a seed, more than half of the budget
        while len(want) < 12:
            rest = [p for p in centre if p not in want]
            want.append(max(rest, key=lambda p: (min((centre[p][0] - centre[q][0]) ** 2 + (centre[p][1] - centre[q][1]) ** 2 for q in want), tissue[p])))
        assert got[u] == want
    assert got[3] == [(5, 5)]


def test_boxes_off_the_slide(spark):
    box = spark.createDataFrame([(1, 990, 5, 40, 10), (2, 2000, 5, 40, 10)], "unit long, bbox_x long, bbox_y long, bbox_w long, bbox_h long")
    got = {r.unit: (r.bbox_x, r.bbox_w) for r in R.expanded(box, 0.1, F.lit(1000), F.lit(100)).collect()}
    assert got == {1: (986, 14), 2: (1996, 1)}


def test_plateau_needs_a_relative_gain(spark):
    h = spark.createDataFrame([(1, e, m) for e, m in enumerate([0.5, 0.50001, 0.50002, 0.6])], "run int, epoch long, metric double")
    assert P.plateau(h, "run", 1.0, 0.5, 1).first().lr == 0.5 and P.plateau(h, "run", 1.0, 0.5, 1, gain=0.0).first().lr == 1.0


def test_running_sums_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(v), int(rng.integers(0, 9))) for g in ("a", "b", None) for v in np.unique(rng.integers(0, 500, 300))]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    got = {(r.g, r.v): (r.below, r.all) for r in S.running(df, ["g"], "v", {"below": "n"}, {"all": "n"}, parts=7).collect()}
    assert got == {(g, v): (sum(n for h, w, n in rows if h == g and w < v), sum(n for h, w, n in rows if h == g)) for g, v, _ in rows}
    assert S.running(df.limit(0), ["g"], "v", {"below": "n"}).count() == 0


def test_curve_areas(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (1, 0.4), (0, 0.3), (0, 0.3)]
    df = spark.createDataFrame(rows, "target int, score double").withColumn("g", F.lit(1))
    r = S.curve_areas(df, ["g"]).first()
    assert math.isclose(r.auroc_curve, (3 + 2.5 + 2) / 9) and math.isclose(r.auroc_curve, S.ranking_metrics(df, ["g"]).first().auroc)
    assert math.isclose(r.auprc_curve, 1 / 3 + (1 + 2 / 3) / 2 / 3 + (2 / 3 + 3 / 4) / 2 / 3)
    points = S.curve_points(df, ends=True).filter("cut IS NULL").first()
    assert (points.tpr, points.fpr, points.precision, points.recall) == (0.0, 0.0, 1.0, 0.0)


def test_published_screening_text(spark):
    rows = [("m", v) for v, n in ((1, 126), (2, 42), (3, 9), (4, 2), (5, 3)) for _ in range(n)]
    df = spark.createDataFrame(rows, "variable string, value int")
    assert P.score_text(df).first().score_distribution == "1:126; 2:42; 3:9; 4:2; 5:3"
    groups = df.withColumn("grp", (F.col("value") > 1).cast("int"))
    r = P.group_summary(groups).first()
    assert (r.n_total, r.n_0, r.n_1, r.median_0, r.median_1, r.n_unique_scores) == (182, 126, 56, 1.0, 2.0, 5)
    assert P.group_summary(spark.createDataFrame([("v", 0, 1.0), ("v", 0, 4.0), ("v", 1, 7.0)], "variable string, grp int, value double")).first().median_0 == 2.5


def test_master_metadata_is_refused(spark):
    ok = spark.createDataFrame([("a", "1", "x"), ("b", "2.5", "3")], "analysis_unit_id string, bbox_x string, is_evaluable string")
    assert [tuple(r) for r in M.master_metadata(ok, ["bbox_x"]).orderBy("analysis_unit_id").collect()] == [("a", 1.0, None), ("b", 2.5, 3.0)]
    for bad in (ok.union(ok), ok.union(spark.createDataFrame([(None, "1", "1")], ok.schema)), ok.drop("bbox_x")):
        with pytest.raises(ValueError):
            M.master_metadata(bad, ["bbox_x"])


def test_fixed_split_is_refused(spark):
    good = [(1, "train", 0, "t/train/a"), (2, "train", 1, "t/train/b"), (3, "val", 0, "t/val/c"), (4, "val", 1, "t/val/d")]
    make = lambda rows: spark.createDataFrame(rows, "unit int, split string, target int, tile_path string")
    train, val = P.fixed_split(make(good), "unit", "target")
    assert (train.count(), val.count()) == (2, 2)
    for bad in (good[:2], good[:3], [*good, (1, "val", 0, "t/val/e")], [*good, (5, "val", 0, "t/train/e")], [*good, (5, "train", 3, "t/train/e")]):
        with pytest.raises(ValueError):
            P.fixed_split(make(bad), "unit", "target")


def test_settings_and_rules(spark, tmp_path):
    from tilewright.plans import settings
    from tilewright.sources import tables

    assert settings.Tiling().tile_size == 256
    for bad in ({"train_fraction": 1.0}, {"tile_size": 0}, {"stride": -1}, {"min_tissue": 1.5}, {"most_tiles": 0}, {"read_levels": (0, -1)}, {"bins": (0, 4)}, {"sampling": "other"}):
        with pytest.raises(ValueError):
            settings.Tiling(**bad)
    assert settings.class_labels({"num_classes": 3}) == ([0, 1, 2], ["0", "1", "2"]) and settings.class_labels({"label_values": ["1", 2], "class_names": ["a", "b"]}) == ([1, 2], ["a", "b"])
    pytest.importorskip("yaml")
    (tmp_path / "rules.yaml").write_text("s1:\n  selection_mode: keep_largest\n  naming_mode: no_suffix\n  output_labels: [whole]\ns2:\n  selection_mode: keep_n_left_to_right\n  naming_mode: suffix_labels\n  output_labels: [a, b]\n  expected_n: 2\n")
    config = tables.read_config(spark, str(tmp_path / "rules.yaml"))
    assert [tuple(r) for r in settings.rules(spark, config).orderBy("study_id").collect()] == [("s1", "keep_largest", ["whole"], "no_suffix", None, None), ("s2", "keep_n_left_to_right", ["a", "b"], "suffix_labels", 2, None)]
    with pytest.raises(ValueError):
        settings.rules(spark, {"s": {"selection_mode": "other", "naming_mode": "no_suffix", "output_labels": ["x"]}})
    (tmp_path / "list.yaml").write_text("- a\n")
    with pytest.raises(ValueError):
        tables.read_config(spark, str(tmp_path / "list.yaml"))


def test_sources_and_sinks(spark, tmp_path):
    import json

    from tilewright.sources import tables

    (tmp_path / "a.csv").write_text('﻿id;name\n1;"x;y"\n2;\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["id", "name"] and [tuple(r) for r in rows.collect()] == [("1", "x;y"), ("2", None)]
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv"), schema="id int, name string").collect()] == [(1, "x;y"), (2, None)]
    (tmp_path / "b.csv").write_text('id,note\n1,"two\nlines"\n')
    assert tables.read_csv(spark, str(tmp_path / "b.csv"), multi_line=True).first().note == "two\nlines"
    assert [tables.sniff(h) for h in ("a\tb", "a;b;c,d", "a")] == ["\t", ";", ","]
    tables.write_csv(rows.limit(0), str(tmp_path / "empty"))
    assert tables.read_csv(spark, str(tmp_path / "empty")).columns == ["id", "name"]
    tables.write_csv(rows, str(tmp_path / "full"))
    assert tables.read_csv(spark, str(tmp_path / "full")).count() == 2
    tables.write_json(spark, {"b": 1, "a": [2]}, str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text()) == {"a": [2], "b": 1} and (tmp_path / "out.json").read_text().index('"a"') < (tmp_path / "out.json").read_text().index('"b"')
    for name in ("z.SVS", "y.svs", "x.txt"):
        (tmp_path / name).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in tables.list_files(spark, str(tmp_path), ".svs").collect()] == ["y.svs", "z.SVS"]
    path = spark.range(1).select(tables.tile_path(F.lit("t"), F.lit("val"), F.lit(0), F.lit(" a/b "), F.lit("n.png")).alias("p")).first().p
    assert path == "tiles/t/val/level_0/a_b/n.png"


def test_columns_of_manifests(spark):
    df = spark.createDataFrame([(1, 2.0, 0.1, 0.2)], "`Sample ID` int, b double, prob_class_10 double, prob_class_2 double")
    assert M.columns_first(df, ["x", "b"]).columns == ["x", "b", "Sample ID", "prob_class_10", "prob_class_2"]
    assert M.normal_names(df).columns[0] == "sample_id" and M.normal_names(df.withColumnRenamed("b", "a (µm)")).columns[1] == "a__µm"
    assert M.normal_names(df.withColumnRenamed("b", "A b-c"), strict=False).columns[1] == "a_b-c"
    with pytest.raises(ValueError):
        M.normal_names(df.withColumn("sample.id", F.lit(1)))
    assert M.probabilities(df) == ["prob_class_2", "prob_class_10"]
    first = lambda names: df.select(M.first_column(df, names, "none").alias("x")).first().x
    assert first(["nope", "b"]) == 2.0 and first(["nope"]) == "none"
    assert M.conditions(df, {"b": F.col("b") > 5, "nope": F.lit(False)}).count() == 0 and M.conditions(df, {"nope": F.lit(False)}).count() == 1
    with pytest.raises(ValueError):
        M.check_all(df, F.col("b") > 5, "too small")
    with pytest.raises(FileNotFoundError):
        M.with_files(df.select(F.lit("a").alias("p")), "p", spark.createDataFrame([("b",)], "path string"), drop=False)


def test_output_order(spark):
    rows = [("t", "val", "a", 0, 1, 2, "p"), ("t", None, "b", None, 1, 2, "p"), ("t", None, "b", 0, 1, None, "p"), ("t", "train", "a", 0, 1, 2, "p")]
    df = spark.createDataFrame(rows, "task string, split string, analysis_unit_id string, read_level int, tile_y_level0 int, tile_x_level0 int, tile_path string")
    assert [tuple(r) for r in M.output_order(df, M.TILE_ORDER).collect()] == [rows[1], rows[2], rows[3], rows[0]]
    assert M.output_order(df.drop("split"), M.EXTRACTION_ORDER).first().analysis_unit_id == "a"


def test_slide_paths_that_lack_all(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(None, None)], "p string, n string")
    assert df.select(C.slide_path(F.col("p"), F.col("n"), "/r").alias("x")).first().x is None
    with pytest.raises(PySparkException):
        df.select(C.slide_path(F.col("p"), F.col("n"), "/r", strict=True)).collect()


def test_random_fallback(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "unit int, target int")
    assert P.stratified(df, "unit", "target", 0.5, 1, fallback=True).filter("split = 'val'").count() == 2


def test_boxes_are_dealt_by_their_tiles_and_units_stay_in_their_task(spark, monkeypatch):
    monkeypatch.setattr(G, "ROWS", 50)
    boxes = spark.createDataFrame([(i, 10 * i, 0, 128 * 9, 128 * 10) for i in range(40)], "unit long, bbox_x long, bbox_y long, bbox_w long, bbox_h long").coalesce(1)
    tiles = V.tissue(R.grid(boxes, 256, 128, by="unit"))
    per = tiles.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("unit").alias("u")).collect()
    assert sum(r.n for r in per) == 40 * 72 and sum(r.u for r in per) == 40 and len(per) > 16  # 58 tasks
    assert R.grid(boxes, 256, 128).rdd.getNumPartitions() == 58
    for picked in (R.seeds(R.bins(tiles, 256, 3), 5), R.round_robin(R.bins(tiles, 256, 3), 5), R.scan_order(tiles, 5)):
        assert len(picked.select(F.spark_partition_id().alias("p")).distinct().collect()) == len(per)
    seeds = {(r.unit, r.tile_x, r.tile_y) for r in R.seeds(R.bins(tiles, 256, 3), 5).collect()}
    far = R.spread(tiles, 8, 256, normalised=True, n_bins=3).collect()
    assert len(far) == 320 and seeds == {(r.unit, r.tile_x, r.tile_y) for r in far if r.pick <= 5}


def test_files_are_matched_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(G, "ROWS", 200)
    files = spark.createDataFrame([(f"d/case-{i:04d}.svs",) for i in range(60)] + [("d/case-0007.svs",), ("d/ab.svs",)], "path string").coalesce(1)
    rows = spark.createDataFrame([("case-0003",), ("e-0007",), ("-00",), ("xx-AB-y",), ("x-case-0007-b",), ("none",), ("",), (None,)], "key string")
    out = M.match_files(rows, "key", files)
    got = {r.key: (r.match, r.tier) for r in out.collect()}
    assert got == {"case-0003": ("d/case-0003.svs", 1), "e-0007": ("d/case-0007.svs", 2), "-00": (None, None), "xx-AB-y": ("d/ab.svs", 3), "x-case-0007-b": (None, None), "none": (None, None), "": (None, None), None: (None, None)}
    assert G.tasks(spark, 2000) == 10 and "RoundRobinPartitioning" in out._jdf.queryExecution().toString()
