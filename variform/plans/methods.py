"""Sampling methods by name."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame

from variform.operators import distance, diverse, pairwise, sampling, sets
from variform.operators.greedy import MAXMIN, MAXSUM
from variform.operators.sampling import Draw

log = logging.getLogger(__name__)


@dataclass
class Inputs:
    """What the methods choose from: ``items(id, x)``, an optional ``frame(id, pos)``, and per method its own table."""

    items: DataFrame
    frame: DataFrame | None = None
    families: DataFrame | None = None  # (id, group)
    genera: DataFrame | None = None  # (id, group)
    counts: DataFrame | None = None  # (id, n)
    copies: bool = False
    _candidates: diverse.Candidates | None = field(default=None, repr=False)
    _unique: bool = field(default=False, repr=False)

    def assert_unique(self) -> None:
        """An id that the items or the frame hold twice is an error, as its members would count twice; checked once."""
        if not self._unique:
            for table in (self.items, self.frame):
                if table is not None:
                    sets.assert_unique(table)
            self._unique = True

    def candidates(self, k: int) -> diverse.Candidates:
        """Prepared once and shared by the greedy methods."""
        if self._candidates is None or self._candidates.k != k:
            self._candidates = diverse.Candidates(self.items, k, self.frame, copies=self.copies)
        return self._candidates

    def distance_range(self) -> tuple[float, float]:
        """Smallest and largest distance over all pairs of the frame."""
        if self.copies and self._candidates is not None:
            row = pairwise.pair_extremes(self._candidates.vectors).first()
            return row["min_d"], row["max_d"]
        return distance.distance_range(self.framed(self.items))

    def framed(self, table: DataFrame) -> DataFrame:
        """Rows of the frame; without one, of the items, as an item without features cannot be scored."""
        known = self.items if self.frame is None else self.frame
        return table if table is self.items and self.frame is None else table.join(known.select("id").hint("merge"), "id", "left_semi")


SamplingMethod = Callable[[Inputs, list[Draw]], DataFrame]


def _greedy(objective: str) -> SamplingMethod:
    def run(inputs: Inputs, draws: list[Draw]) -> DataFrame:
        ks = [d.k for d in draws]
        return diverse.prefixes(inputs.candidates(max(ks)).pick(objective), objective, ks)

    return run


def _random(inputs: Inputs, draws: list[Draw]) -> DataFrame:
    return sampling.random_draws(inputs.framed(inputs.items).select("id"), draws)


def _family(inputs: Inputs, draws: list[Draw]) -> DataFrame:
    return sampling.stratified_draws(inputs.framed(inputs.families), "group", draws, "random_family")


def _genus(inputs: Inputs, draws: list[Draw]) -> DataFrame:
    return sampling.stratified_draws(inputs.framed(inputs.genera), "group", draws, "random_genus")


def _convenience(inputs: Inputs, draws: list[Draw]) -> DataFrame:
    frame = inputs.items.select("id") if inputs.frame is None else inputs.frame
    return sampling.convenience_draws(frame, inputs.counts, draws)


METHODS: dict[str, SamplingMethod] = {
    "random": _random,
    "random_family": _family,
    "random_genus": _genus,
    "maxsum": _greedy(MAXSUM),
    "maxmin": _greedy(MAXMIN),
    "convenience": _convenience,
}


def register(name: str, method: SamplingMethod) -> None:
    """Make a method of one's own available by name."""
    METHODS[name] = method


def draw(inputs: Inputs, methods: Iterable[str], draws: list[Draw]) -> DataFrame:
    """``samples(method, run, k, id)`` of all named methods; unknown names are skipped with a message."""
    inputs.assert_unique()
    parts = []
    for name in methods:
        if name not in METHODS:
            log.warning("Skipping unknown method %s", name)
            continue
        parts.append(METHODS[name](inputs, draws))
    if not parts:
        raise ValueError("Invalid value, no known sampling method was named")
    return reduce(lambda a, b: a.unionByName(b), parts)
