"""Frozen settings of each pipeline. The published defaults that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ClusterConfig:
    total_strings: int = 10_000
    prototype_count: int = 25
    min_length: int = 32
    max_length: int = 64
    shingle: int = 4
    min_shared: int = 3
    top_neighbours: int = 30
    max_sample: int = 20
    quantile: float = 0.90
    padding: float = 0.05
    max_threshold: float = 0.85
    jump_warmup: int = 30
    jump_window: int = 20
    jump_factor: float = 1.75
    jump_delta: float = 0.10
    plot_sample: int = 2_500
    seed: int = 42
    partitions: int = 16


@dataclass(frozen=True)
class SeriesConfig:
    lags: int = 15
    min_dimension: int = 5
    max_iter: int = 40
    reg_param: float = 0.01


@dataclass(frozen=True)
class RatingConfig:
    pool: int = 25
    neighbours: tuple[int, ...] = (5, 10, 15, 20, 25)
    min_common: int = 2
