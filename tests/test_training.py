"""Training against plain numpy, checkpoints, jobs, and running sums by both ways."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import fanout, scores, splits, training
from tilewright.plans.session import ship


def data(n=600, width=5, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    t = (x @ rng.normal(size=(width, classes)) + rng.normal(size=(n, classes))).argmax(axis=1)
    return x, t


def frame(spark, x, t):
    return ship(spark).createDataFrame([(i, [float(a) for a in v], int(c)) for i, (v, c) in enumerate(zip(x, t, strict=True))], "k long, x array<double>, t int").repartition(5)


def fitted(spark, rows, settings, **how):
    return training.train(rows, how.pop("val", None), "k", F.col("x"), F.col("t"), settings, **how)


def plain(x, t, s):
    """The same ten epochs over all rows at once."""
    w = np.zeros((s.classes, x.shape[1] + 1))
    m, v, x1, cw = w.copy(), w.copy(), np.c_[x, np.ones(len(x))], np.array(s.class_weights or [1.0] * s.classes)[t]
    losses = []
    for step in range(1, s.epochs + 1):
        z = x1 @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        own, y = p[np.arange(len(t)), t], np.eye(s.classes)[t]
        if s.gamma is None:
            losses.append((-cw * np.log(own)).sum() / cw.sum())
            d = (p - y) * cw[:, None] / cw.sum()
        else:
            losses.append((-cw * (1 - own) ** s.gamma * np.log(own)).mean())
            slope = -cw * ((1 - own) ** s.gamma / own - s.gamma * (1 - own) ** (s.gamma - 1) * np.log(own))  # of the loss by the probability
            d = (slope * own)[:, None] * (y - p) / len(t)
        g = d.T @ x1
        w = w * (1 - s.rate * s.weight_decay)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - s.rate / (1 - 0.9**step) * m / (np.sqrt(v) / np.sqrt(1 - 0.999**step) + 1e-8)
    return w, losses


@pytest.mark.parametrize("gamma, weights", [(None, None), (None, (1.0, 2.0, 0.5)), (2.0, (1.0, 2.0, 0.5))])
def test_ten_epochs_equal_numpy(spark, monkeypatch, gamma, weights):
    monkeypatch.setattr(training, "VALUES", 300)  # ten blocks
    monkeypatch.setattr(training, "FAN_IN", 4)
    x, t = data()
    s = training.Settings(classes=3, epochs=10, rate=0.05, weight_decay=0.01, gamma=gamma, class_weights=weights, monitor="train_loss", stop_after=99, patience=99)
    got = fitted(spark, frame(spark, x, t), s)
    w, losses = plain(x, t, s)
    assert np.allclose(got.weights, w, atol=1e-9) and np.allclose([r["train_loss"] for r in got.history], losses, atol=1e-9)
    assert losses[-1] < losses[0]


def test_a_stopped_run_resumes_in_the_same_bits(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(training, "VALUES", 500)
    x, t = data(seed=2)
    rows, val = frame(spark, x[:500], t[:500]), frame(spark, x[500:], t[500:])
    how = dict(classes=3, rate=0.3, batches=2, patience=0, factor=0.5, stop_after=50)
    whole = fitted(spark, rows, training.Settings(epochs=6, **how), val=val)
    folder = f"file://{tmp_path}/run"
    fitted(spark, rows, training.Settings(epochs=2, **how), val=val, folder=folder)
    rest = fitted(spark, rows.repartition(2), training.Settings(epochs=6, **how), val=val, folder=folder, resume=True)
    assert (whole.weights == rest.weights).all() and (whole.v == rest.v).all() and repr(whole.history) == repr(rest.history)
    assert (whole.rate, whole.bad, whole.waited) == (rest.rate, rest.bad, rest.waited)
    last = training.load_checkpoint(spark, f"{folder}/last.json")
    assert last["epoch"] == 6 and set(training.load_checkpoint(spark, f"{folder}/last.json", "auto")) == {"weights"}
    assert training.load_checkpoint(spark, f"{folder}/best.json", "best_metric_value") == min(r["val_loss"] for r in whole.history)
    with pytest.raises(KeyError):
        training.load_checkpoint(spark, f"{folder}/last.json", "weights")
    training.save_checkpoint(spark, {"a": 1}, f"{folder}/bare.json")
    assert training.load_checkpoint(spark, f"{folder}/bare.json", "auto") == {"a": 1}
    assert training.history(spark, whole).count() == 6


def test_training_stops_and_cuts_the_rate(spark):
    x, t = data(80, seed=3)
    flat = frame(spark, x * 0, t)  # nothing to learn but the classes' shares
    s = fitted(spark, flat, training.Settings(classes=3, epochs=40, rate=5.0, patience=1, stop_after=4), val=frame(spark, x * 0, (t + 1) % 3))
    assert s.waited == 4 and s.epoch < 40 and s.rate < 5.0
    with pytest.raises(ValueError):
        fitted(spark, flat.filter("k < 0"), training.Settings(classes=3))
    with pytest.raises(ValueError):
        training.Settings(classes=1)
    with pytest.raises(ValueError):
        fitted(spark, spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 1)], "k long, x array<double>, t int"), training.Settings(classes=2))


def test_rows_that_cant_be_learned_from_take_no_part(spark):
    x, t = data(50, seed=4)
    rows = frame(spark, x, t)
    odd = spark.createDataFrame([(None, [0.0] * 5, 1), (900, [0.0] * 5, None), (901, None, 1), (902, [0.0, None, 0.0, 0.0, 0.0], 1)], rows.schema)
    s = training.Settings(classes=3, epochs=2)
    assert (fitted(spark, rows.union(odd), s).weights == fitted(spark, rows, s).weights).all()


# Jobs


def test_jobs_that_fail_are_rows(spark, tmp_path):
    rows = ship(spark).createDataFrame([(i, float(i), None if i == 4 else f"n{i}") for i in range(12)], "k long, v double, result string")
    marks = str(tmp_path)

    def job(row):
        import pathlib

        k = row["k"]
        tries = pathlib.Path(marks) / f"{k}-{len(list(pathlib.Path(marks).glob(f'{k}-*')))}"
        tries.touch()
        if k == 1:
            raise KeyError("no such level")
        if k == 2 and not tries.name.endswith("-2"):
            raise OSError("busy")  # the third try does it
        if k == 3:
            return {"unknown": 1}
        if k == 5:
            return {"n": "not a number"}
        return None if k == 6 else {"n": int(row["v"] * 2), "name": row["result"]}

    done = fanout.run_jobs(rows, job, "n long, name string", tries=3, retry_on=(OSError,), tasks=3)
    assert done.columns == ["k", "v", "result", "_result", *fanout.OUTCOME]
    got = {r.k: r for r in done.collect()}
    assert len(got) == 12 and {k for k, r in got.items() if not r.ok} == {1, 3, 5}
    assert (got[1].error_type, got[1].error, got[1].attempts) == ("KeyError", "KeyError('no such level')", 1) and "no such level" in got[1].trace
    assert (got[2].attempts, got[2]._result.n) == (3, 4) and got[3].error_type == "KeyError" and got[5].error_type.startswith("Arrow")
    assert got[6]._result.n is None and got[6].ok and got[4]._result.name is None and got[7]._result.name == "n7"


def test_the_driving_order_comes_back(spark):
    rows = ship(spark).createDataFrame([(i, i * 7 % 10) for i in range(10)], "k long, place long")
    done = fanout.run_jobs(rows.filter("k <> 8"), lambda r: {"n": 10 // (r["k"] - 3)}, "n long")
    out = fanout.in_driving_order(done, rows, "k", "place").collect()
    assert [r.place for r in out] == list(range(10))
    assert {r.k: r.error_type for r in out if not r.ok} == {3: "ZeroDivisionError", 8: "Missing"}
    assert fanout.succeeded(done, "k").count() == 8
    assert [tuple(r) for r in fanout.issues(done, "k", "failed", "tiles").collect()] == [(3, "tiles", "failed", "ZeroDivisionError('integer division or modulo by zero')")]
    with pytest.raises(ValueError):
        fanout.run_jobs(rows, lambda r: None, "n long", tries=0)


# Running sums, ranks and splits on odd rows


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_running_sums_by_both_ways(spark, monkeypatch, few):
    monkeypatch.setattr(scores, "FEW", few)
    rng = np.random.default_rng(8)
    rows = [(g, float(o), int(rng.integers(9)), o) for g in ("a", "b", None) for o in rng.permutation(200)]
    df = ship(spark).createDataFrame([(g, o, n, int(k)) for g, o, n, k in rows], "g string, o double, n long, __key long")
    got = scores.running(df, ["g"], "o", {"before": "n"}, {"all": "n"})
    assert got.columns == [*df.columns, "before", "all"]
    for r in got.collect():
        assert r.before == sum(n for g, o, n, _ in rows if g == r.g and o < r.o) and r["all"] == sum(n for g, _, n, _ in rows if g == r.g)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_ranks_keep_rows_without_a_value(spark, monkeypatch, few):
    monkeypatch.setattr(scores, "FEW", few)
    rows = [("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), (None, 5.0), (None, 4.0)]
    got = splits.average_ranks(ship(spark).createDataFrame(rows, "v string, x double"), ["v"], "x", "r").collect()
    assert sorted((str(r.v), str(r.x), str(r.r)) for r in got) == sorted([("a", "1.0", "1.5")] * 2 + [("a", "3.0", "3.0"), ("a", "None", "None"), ("None", "5.0", "2.0"), ("None", "4.0", "1.0")])


def test_units_without_a_label_are_refused(spark):
    table = ship(spark).createDataFrame([(i, None if i == 3 else i % 2) for i in range(12)], "unit long, y int")
    for split in (lambda t: splits.stratified(t, "unit", "y", 0.3, 1), lambda t: splits.stratified(t, "unit", "y", 0.3, 1, fallback=True), lambda t: splits.folds(t, "unit", "y", 2, 1)):
        with pytest.raises(ValueError):
            split(table)
        assert split(table.filter("unit <> 3")).count() == 11


def test_histograms_of_odd_columns(spark):
    rows = ship(spark).createDataFrame([(0.5, 2.0), (None, 2.0), (float("nan"), None), (0.75, 2.0), (1.0, 2.0)], "a double, b double")
    got = lambda c: {r.bin: r.n for r in scores.histogram(rows, c, 20).collect() if r.n}
    assert got("a") == {0: 1, 10: 1, 19: 1} and got("b") == {10: 4}
    assert scores.histogram(rows.limit(0), "a").count() == 20
