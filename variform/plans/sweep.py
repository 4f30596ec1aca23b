"""Sweep of methods, sizes and seeds: draw everything, score everything, summarise."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from variform.operators import metrics, sampling
from variform.plans.methods import Inputs, draw

ALL_METHODS = ("maxsum", "maxmin", "convenience", "random", "random_family", "random_genus")


def sizes(start: int, end: int, step: int) -> list[int]:
    return [start] if start == end else list(range(start, end + 1, step))


def sweep_samples(inputs: Inputs, ks: Iterable[int], runs: int, methods: Iterable[str] = ALL_METHODS) -> DataFrame:
    """All samples of the sweep in one table; deterministic methods run once, to the largest size."""
    return draw(inputs, methods, sampling.draws_for(list(ks), runs))


def sweep(
    inputs: Inputs,
    ks: Iterable[int],
    runs: int,
    methods: Iterable[str] = ALL_METHODS,
    distance_range: tuple[float, float] | None = None,
    **options,
) -> DataFrame:
    """Metrics of every sample of the sweep, distances normalised by the range over all items."""
    samples = sweep_samples(inputs, ks, runs, methods)
    if distance_range is None:
        distance_range = inputs.distance_range()
    return metrics.evaluate(samples, inputs.items, distance_range, **options)
