"""From raw documents to a training mixture, stage by stage, each over all that the one before it kept.

Languages that cannot be told, exact copies, near copies and documents with benchmark passages go; what is left is
mixed by source. Every stage is written as Parquet and read again, so a lost executor costs one stage's tasks.

Defined cases: null and empty texts have no language and go in the first stage, as do texts without letters; of equal
texts the longest original stays, then the smallest id; of near copies the smallest id; rows of one id with different
texts are different documents, repeated rows are one and share its fate; null ids come last among ties and a null source
is a source of its own; very long texts are read whole; further columns, whatever their names, are carried along;
an empty table gives an empty mixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variform.llm import decontaminate, exact, langid, mixing, simhash
from variform.llm.common import held_out, stage, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are clearly in one language."""
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return langid.accepted(langid.predict(docs, model)).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked."""
    return simhash.deduplicate(docs, shingle=SHINGLE, limit=NEAR_BITS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws of the mixture; a document comes once for each epoch that takes it."""
    return mixing.mix(docs, max_repeats=MAX_REPEATS)


#: Words in a shingle of a fingerprint, and differing bits up to which two fingerprints are linked.
SHINGLE = 3
NEAR_BITS = 2

#: No source is repeated more often than this.
MAX_REPEATS = 1.25

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("leaks", drop_leaks),
    ("mix", mix_sources),
]

#: SQL has no language model, XXH64 or components.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES[:-1]:
        docs = stage(stage_of(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
