"""Whole jobs from input files to output files."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variform.operators import cleaning, codes, corpus, distance, diverse, metrics, sampling, sets
from variform.operators.profiles import collapse, members
from variform.plans.methods import METHODS, Inputs
from variform.sources import readers, writers
from variform.session import stage

log = logging.getLogger(__name__)


def prepare(
    spark: SparkSession,
    features_path: str,
    out: str,
    features: Sequence[str] | None = None,
    items: DataFrame | None = None,
    multi_value: Sequence[str] | None = cleaning.MULTI_VALUE_FEATURES,
    taxonomy: DataFrame | None = None,
    min_coverage: float | None = None,
    inclusive: bool = False,
    normalize: bool = True,
) -> DataFrame:
    """Clean a raw feature file and write the features and the distances between distinct vectors.

    An id that the file holds twice is an error. Writes ``features`` (CSV), ``members(id, profile)`` and ``distances(a, b, d, n_a, n_b)`` under
    ``out`` and returns ``(id, x)`` of the items.
    """
    wide = cleaning.prepare_features(
        readers.read_features(spark, features_path), features, items, multi_value, taxonomy, min_coverage, inclusive
    )
    kept = sets.assert_unique(stage(wide))
    writers.write_features(kept, f"{out}/features")
    vectors = cleaning.to_vector(kept, cleaning.feature_columns(kept))
    profiles = stage(collapse(vectors))
    members(vectors, profiles).write.parquet(f"{out}/members")
    relation = stage(distance.all_pairs(vectors))
    writers.write_distances(distance.normalize(relation) if normalize else relation, f"{out}/distances")
    return vectors


def draw_to_files(
    inputs: Inputs, methods: Iterable[str], k: int, seed: int, folder: str, frame_name: str = "frame", dist_name: str = "dists"
) -> dict[str, str]:
    """One sample per method as a text file named after how it was drawn; returns the paths by method."""
    paths = {}
    for name in methods:
        if name not in METHODS:
            log.warning("Skipping unknown method %s", name)
            continue
        drawn = METHODS[name](inputs, [sampling.Draw(0, k, seed)])
        paths[name] = writers.write_sample(drawn, folder, name, frame_name, k, dist_name, seed)
    return paths


def expand_dataset(
    items: DataFrame, dataset: DataFrame, n: int, taxonomy: DataFrame | None = None, candidates: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The ``n`` next best items for a dataset, and the metrics before and after.

    ``dataset(id)`` is cut to the items with features. With ``candidates(id)`` only those may be
    added. Returns ``(pick_order, id[, name])`` and the metrics of ``before`` and ``after``.
    """
    current = stage(sets.intersect(dataset, items))
    frame = None
    if candidates is not None:
        allowed = sets.union(sets.intersect(candidates, items), current)
        frame = allowed.withColumn("pos", F.col("id"))
    added = diverse.expand_sample(items, current, n, frame)
    samples = current.select(F.lit("before").alias("method"), "id").unionByName(
        sets.union(current, added.select("id")).select(F.lit("after").alias("method"), "id")
    )
    samples = samples.select("method", F.lit(0).alias("run"), F.lit(n).alias("k"), "id")
    scores = metrics.evaluate(samples, items, distance.distance_range(items), with_members=False)
    return (added if taxonomy is None else codes.names(added, taxonomy)), scores


def select_parallel_text(verses: DataFrame, c: int, n: int, seed: int = 0) -> DataFrame:
    """``(lang, verse_id, text)``: ``n`` random verses of the ``c`` most common, for languages that hold all ``c``.

    Each language is represented by its largest edition.
    """
    chosen = stage(corpus.chosen_editions(verses, corpus.largest_edition(verses)))
    common = corpus.most_common_units(chosen, c)
    languages = corpus.fully_covering(chosen, common)
    test = sampling.random_split(common.select("verse_id"), n, seed).withColumnRenamed("id", "verse_id")
    return corpus.selected_units(chosen, test, languages)


def token_costs(
    units: DataFrame, taxonomy: DataFrame, count: Callable[[str], Column] | None = None, order: str = "id"
) -> DataFrame:
    """``(verses, avg_subwords, glottocode)`` of ``units(code, path, text)``, one row per text file.

    ``count`` makes a token-count column, see ``corpus.token_counter``. Codes are translated to the
    first taxonomy id; files whose code has none are left out.
    """
    averages = corpus.avg_tokens(units, ["path", "code"], count("text") if count else None)
    mapping = codes.dedupe_codes(taxonomy, "iso639P3code", "id", order)
    mapped = codes.map_codes(averages, "code", mapping, "inner")
    return mapped.select(F.col("path").alias("verses"), "avg_subwords", F.col("target").alias("glottocode"))
