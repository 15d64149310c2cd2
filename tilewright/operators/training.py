"""Training of a linear softmax scorer: gradients by blocks of rows, decoupled weight decay, checkpoints.

Rows are packed once into blocks (a row of a written table each, sorted by key),
by a hash of their key. A step is one narrow pass: a task returns the sums of its
blocks, which are added in the order of the blocks, 256 at a time. So
a step's result doesn't depend on partitions, executors or retries, and a run
that is resumed from a checkpoint ends in the same bits as one that never stopped.
Only sums come to the driver: a row per 256 blocks, each as large as the model.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import written
from .groups import in_groups, starts
from .splits import GAIN

#: Numbers that a block's features are, about; the blocks that are added in one row.
VALUES, FAN_IN = 1_000_000, 256


@dataclass(frozen=True)
class Settings:
    """``gamma``: of the focal loss; cross entropy without. ``batches``: steps an epoch, each on as large a share of the blocks."""

    classes: int
    epochs: int = 20
    rate: float = 1e-3
    weight_decay: float = 1e-4
    gamma: float | None = None
    class_weights: tuple[float, ...] | None = None
    batches: int = 1
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    monitor: str = "val_loss"
    maximise: bool = False
    factor: float = 0.5
    patience: int = 2
    stop_after: int = 5

    def __post_init__(self) -> None:
        if self.classes < 2 or self.batches < 1 or self.monitor not in ("val_loss", "val_accuracy", "train_loss"):
            raise ValueError("two classes and one batch at least; monitor is val_loss, val_accuracy or train_loss")
        if self.class_weights is not None and len(self.class_weights) != self.classes:
            raise ValueError("a weight for each class")


@dataclass
class State:
    """All that an epoch starts from. Weights are rows of features and a bias, one a class."""

    weights: np.ndarray
    m: np.ndarray
    v: np.ndarray
    rate: float
    epoch: int = 0
    step: int = 0
    plateau_best: float = math.nan
    bad: int = 0
    best: float = math.nan
    waited: int = 0
    history: list[dict] = field(default_factory=list)

    def payload(self) -> dict:
        arrays = {"optimizer_state_dict": {"m": self.m.tolist(), "v": self.v.tolist(), "step": self.step, "lr": self.rate}, "model_state_dict": {"weights": self.weights.tolist()}}
        return arrays | {"epoch": self.epoch, "scheduler_state_dict": {"best": self.plateau_best, "bad": self.bad}, "best_metric_value": self.best, "epochs_without_improvement": self.waited, "history": self.history}

    @classmethod
    def of(cls, p: dict) -> State:
        o, s = p["optimizer_state_dict"], p["scheduler_state_dict"]
        return cls(np.array(p["model_state_dict"]["weights"]), np.array(o["m"]), np.array(o["v"]), o["lr"], p["epoch"], o["step"], s["best"], s["bad"], p["best_metric_value"], p["epochs_without_improvement"], p["history"])


# Checkpoints


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save_checkpoint(spark: SparkSession, payload: dict, path: str) -> None:
    """Written whole beside its place, then moved there."""
    fs, at = _path(spark, path)
    beside = _path(spark, f"{path}.part")[1]
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(payload).encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(beside, at)


def load_checkpoint(spark: SparkSession, path: str, key: str = "none") -> dict:
    """A checkpoint's part: ``auto`` its model or, where it has none, all of it; ``none`` all of it; else what is under the key, a KeyError if nothing is."""
    payload = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    if not isinstance(payload, dict):
        raise ValueError(f"{path} holds no mapping")
    if key == "auto":
        return payload.get("model_state_dict", payload)
    if key == "none":
        return payload
    if key not in payload:
        raise KeyError(f"{path} has no key {key}")
    return payload[key]


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


# Steps


def packed(rows: DataFrame, key: str, features: Column, target: Column) -> DataFrame:
    """block, n, x (the features of its rows, one after the other), t (their classes from 0), by key.

    Rows with a null key or class, or a null among the features, take no part.
    """
    own = rows.select(F.col(key).alias("key"), features.cast("array<double>").alias("x"), target.cast("long").alias("t"))
    own = own.filter(F.col("key").isNotNull() & F.col("t").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    n, least, most = own.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("no rows to learn from")
    if least != most:
        raise ValueError("rows have different numbers of features")
    blocks = max(1, -(-n * most // VALUES))
    dealt = own.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key", "x", "t")

    def work(held: pa.Table) -> pa.Table:
        first = starts(held, 1)
        ends = np.r_[first, held.num_rows].astype(np.int32)
        x, t = held["x"].combine_chunks(), held["t"].combine_chunks()
        wide = pa.ListArray.from_arrays(pa.array(ends * np.int32(most)), x.flatten())
        return pa.table({"block": held["block"].take(pa.array(first)), "n": pa.array(np.diff(ends).astype(np.int64)), "x": wide, "t": pa.ListArray.from_arrays(pa.array(ends), t)})

    return written(in_groups(dealt, ["block"], ["key"], work, "block int, n long, x array<double>, t array<long>"), "blocks")


def probabilities(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = x @ weights[:, :-1].T + weights[:, -1]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(weights: np.ndarray, x: np.ndarray, t: np.ndarray, class_weights: np.ndarray, gamma: float | None) -> tuple[np.ndarray, float, float, int]:
    """(gradient of the summed loss, summed loss, what it is divided by, right decisions) of rows."""
    p = probabilities(weights, x)
    own, w = np.maximum(p[np.arange(len(t)), t], 1e-12), class_weights[t]
    if gamma is None:
        loss, over, slope = -w * np.log(own), float(w.sum()), w
    else:
        loss, over = -w * (1 - own) ** gamma * np.log(own), float(len(t))
        slope = w * ((1 - own) ** gamma - gamma * own * (1 - own) ** max(gamma - 1, 0) * np.log(own) if gamma else 1)
    d = p * slope[:, None]
    d[np.arange(len(t)), t] -= slope
    return np.c_[d.T @ x, d.sum(axis=0)], float(loss.sum()), over, int((p.argmax(axis=1) == t).sum())


def summed(blocks: DataFrame, weights: np.ndarray, class_weights: np.ndarray, gamma: float | None) -> tuple[np.ndarray, float, float, int, int]:
    """(gradient, loss, divisor, hits, rows) of all blocks, added in their order."""
    k, f = weights.shape[0], weights.shape[1] - 1
    kind = "top int, block int, n long, hits long, loss double, over double, grad array<double>"

    def one(batches):
        for b in batches:
            out = []
            for block, n, x, t in zip(*(b.column(i) for i in range(4)), strict=True):
                g, loss, over, hits = gradient(weights, x.values.to_numpy().reshape(-1, f), t.values.to_numpy(), class_weights, gamma)
                out.append((block.as_py() // FAN_IN, block.as_py(), n.as_py(), hits, loss, over, g.ravel().tolist()))
            if out:
                yield pa.record_batch(list(map(pa.array, zip(*out, strict=True))), schema=schema)

    def added(held: pa.Table) -> pa.Table:
        first = starts(held, 1)
        out = []
        for i, j in zip(first.tolist(), [*first[1:].tolist(), held.num_rows], strict=True):
            part = held.slice(i, j - i)
            out.append((part["top"][0].as_py(), part["block"][0].as_py(), *_added(part)))
        return pa.table(list(map(pa.array, zip(*out, strict=True))), schema=schema)

    schema = pa.schema([("top", pa.int32()), ("block", pa.int32()), ("n", pa.int64()), ("hits", pa.int64()), ("loss", pa.float64()), ("over", pa.float64()), ("grad", pa.list_(pa.float64()))])
    each = blocks.mapInArrow(one, kind)
    table = in_groups(each, ["top"], ["block"], added, kind).toArrow().sort_by("top")
    if not table.num_rows:
        raise ValueError("no rows to learn from")
    n, hits, loss, over, grad = _added(table)
    return np.array(grad).reshape(k, f + 1), loss, over, hits, n


def _added(part: pa.Table) -> tuple[int, int, float, float, list[float]]:
    """n, hits, loss, over, grad of the rows, one after the other."""
    grad, loss, over = np.zeros(len(part["grad"][0])), 0.0, 0.0
    for g, a, b in zip(part["grad"], part["loss"].to_pylist(), part["over"].to_pylist(), strict=True):
        grad, loss, over = grad + g.values.to_numpy(), loss + a, over + b
    return sum(part["n"].to_pylist()), sum(part["hits"].to_pylist()), loss, over, grad.tolist()


def _updated(s: State, grad: np.ndarray, settings: Settings) -> None:
    a, b = settings.betas
    s.step += 1
    s.weights = s.weights * (1 - s.rate * settings.weight_decay)
    s.m, s.v = a * s.m + (1 - a) * grad, b * s.v + (1 - b) * grad * grad
    size = s.rate / (1 - a**s.step)
    s.weights = s.weights - size * s.m / (np.sqrt(s.v) / math.sqrt(1 - b**s.step) + settings.eps)


def _scheduled(s: State, metric: float, settings: Settings) -> None:
    """The rate is cut when the metric hasn't beaten its best by a share for longer than the patience; NaN is passed over."""
    if math.isnan(metric):
        return
    better = math.isnan(s.plateau_best) or (metric > s.plateau_best * (1 + GAIN) if settings.maximise else metric < s.plateau_best * (1 - GAIN))
    s.plateau_best, s.bad = (metric, 0) if better else (s.plateau_best, s.bad + 1)
    if s.bad > settings.patience:
        s.rate, s.bad = s.rate * settings.factor, 0


def train(train_rows: DataFrame, val_rows: DataFrame | None, key: str, features: Column, target: Column, settings: Settings, folder: str | None = None, resume: bool = False) -> State:
    """Epochs until ``settings.epochs``, or until the monitored metric hasn't improved for ``stop_after`` of them.

    With a folder, each epoch leaves ``last.json`` and, if it is the best so far,
    ``best.json`` there; ``resume`` goes on from the last one, if there is one.
    """
    spark = train_rows.sparkSession
    blocks = packed(train_rows, key, features, target)
    held = packed(val_rows, key, features, target) if val_rows is not None else None
    of_class = np.array(settings.class_weights or [1.0] * settings.classes)
    if resume and folder and exists(spark, f"{folder}/last.json"):
        s = State.of(load_checkpoint(spark, f"{folder}/last.json"))
    else:
        width = blocks.select((F.size("x") / F.col("n")).cast("int").alias("f")).first().f
        zero = np.zeros((settings.classes, width + 1))
        s = State(zero, zero, zero, settings.rate)
    while s.epoch < settings.epochs and s.waited < settings.stop_after:
        total, seen = 0.0, 0
        for batch in range(settings.batches):
            share = blocks if settings.batches == 1 else blocks.filter(F.pmod(F.xxhash64("block", F.lit(s.epoch)), F.lit(settings.batches)) == batch)
            if settings.batches > 1 and share.isEmpty():
                continue
            grad, loss, over, _, n = summed(share, s.weights, of_class, settings.gamma)
            _updated(s, grad / over, settings)
            total, seen = total + loss / over * n, seen + n
        row = {"epoch": s.epoch + 1, "train_loss": total / max(1, seen), "val_loss": math.nan, "val_accuracy": math.nan}
        if held is not None:
            _, loss, over, hits, n = summed(held, s.weights, of_class, settings.gamma)
            row |= {"val_loss": loss / over, "val_accuracy": hits / n}
        metric = row[settings.monitor]
        _scheduled(s, metric, settings)
        better = not math.isnan(metric) and (math.isnan(s.best) or (metric > s.best if settings.maximise else metric < s.best))
        s.best, s.waited = (metric, 0) if better else (s.best, s.waited + 1)
        s.epoch += 1
        s.history.append(row | {"lr": s.rate, "epochs_without_improvement": s.waited})
        if folder:
            save_checkpoint(spark, s.payload(), f"{folder}/last.json")
            if better:
                save_checkpoint(spark, s.payload(), f"{folder}/best.json")
    return s


def history(spark: SparkSession, s: State) -> DataFrame:
    """A row an epoch: epoch, train_loss, val_loss, val_accuracy, lr, epochs_without_improvement."""
    rows = [(r["epoch"], r["train_loss"], r["val_loss"], r["val_accuracy"], r["lr"], r["epochs_without_improvement"]) for r in s.history]
    return spark.createDataFrame(rows, "epoch long, train_loss double, val_loss double, val_accuracy double, lr double, epochs_without_improvement long")
