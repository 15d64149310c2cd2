"""Settings that are checked when they are made, and rule tables from configurations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Selection modes of rules, naming modes, strategies of tile sampling.
SELECTION = ("keep_n_left_to_right", "keep_largest", "keep_bottom_left_among_major_components", "keep_representative")
NAMING = ("suffix_labels", "no_suffix")
SAMPLING = ("scan_order", "spatial_bins", "spatial_farthest")


@dataclass(frozen=True)
class Tiling:
    """How units are split and tiled; a value out of range is a ValueError."""

    train_fraction: float = 0.8
    tile_size: int = 256
    stride: int = 256
    min_tissue: float = 0.3
    most_tiles: int = 100
    read_levels: tuple[int, ...] = (0,)
    bins: tuple[int, int] = (4, 4)
    sampling: str = "spatial_farthest"

    def __post_init__(self) -> None:
        checks = {
            "train_fraction must be between 0 and 1": 0.0 < self.train_fraction < 1.0,
            "tile_size must be positive": self.tile_size > 0,
            "stride must be positive": self.stride > 0,
            "min_tissue must be from 0 to 1": 0.0 <= self.min_tissue <= 1.0,
            "most_tiles must be positive": self.most_tiles > 0,
            "read_levels must not be negative": all(x >= 0 for x in self.read_levels),
            "bins must be positive": min(self.bins) > 0,
            f"sampling must be one of {SAMPLING}": self.sampling in SAMPLING,
        }
        if bad := [message for message, holds in checks.items() if not holds]:
            raise ValueError("; ".join(bad))


def class_labels(task: Mapping) -> tuple[list[int], list[str]]:
    """(labels, names) of a task: as given, else 0 to num_classes - 1, and the labels as names."""
    labels = [int(x) for x in task.get("label_values") or range(int(task["num_classes"]))]
    return labels, [str(x) for x in task.get("class_names") or labels]


def rules(spark: SparkSession, config: Mapping) -> DataFrame:
    """A row per study: study_id, selection_mode, output_labels, naming_mode, expected_n, expected_n_major; unknown values are errors."""
    rows = []
    for study, rule in config.items():
        if not isinstance(rule, Mapping):
            raise ValueError(f"the rule of {study} must be a mapping")
        mode, naming, labels = str(rule.get("selection_mode", "")).strip(), str(rule.get("naming_mode", "")).strip(), list(rule.get("output_labels", []))
        if mode not in SELECTION or naming not in NAMING or not labels:
            raise ValueError(f"the rule of {study} needs a known selection_mode, a known naming_mode and output_labels")
        numbers = [None if rule.get(k) is None else int(rule[k]) for k in ("expected_n", "expected_n_major")]
        rows.append((str(study), mode, [str(x) for x in labels], naming, *numbers))
    return spark.createDataFrame(rows, "study_id string, selection_mode string, output_labels array<string>, naming_mode string, expected_n int, expected_n_major int")
