"""Choosing parallel text: editions, common units, languages that cover them, token cost.

A corpus is ``verses(lang, edition, verse_id, text[, line])``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variform.functions.columns import words
from variform.session import stage

# tokens that tokenizers add around a text (fixed values)
SPECIAL_TOKENS = ("[SEP]", "[CLS]")


def units(verses: DataFrame) -> DataFrame:
    """Distinct ``(lang, edition, verse_id)``; combines on the map side, so repeats do not travel."""
    return verses.select("lang", "edition", "verse_id").distinct()


def edition_sizes(verses: DataFrame) -> DataFrame:
    return units(verses).groupBy("lang", "edition").agg(F.count(F.lit(1)).alias("n_verses"))


def largest_edition(verses: DataFrame) -> DataFrame:
    """``(lang, edition, n_verses)``: per language the edition of most distinct verses, ties to the first name."""
    best = F.min_by(F.struct("edition", "n_verses"), F.struct(-F.col("n_verses"), F.col("edition")))
    return edition_sizes(verses).groupBy("lang").agg(best.alias("best")).select("lang", "best.edition", "best.n_verses")


def unit_frequency(verses: DataFrame) -> DataFrame:
    """``(verse_id, n_editions)``: how many editions hold each verse."""
    return units(verses).groupBy("verse_id").agg(F.count(F.lit(1)).alias("n_editions"))


def most_common_units(verses: DataFrame, c: int) -> DataFrame:
    """The ``c`` verses held by most editions, ties to the smallest id."""
    return stage(unit_frequency(verses).orderBy(F.desc("n_editions"), "verse_id").limit(c))


def fully_covering(verses: DataFrame, selected: DataFrame) -> DataFrame:
    """``(lang)``: languages that hold every selected verse."""
    wanted = selected.select("verse_id").distinct()
    c = wanted.count()
    held = verses.join(wanted, "verse_id", "left_semi").select("lang", "verse_id").distinct()
    return held.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == c).select("lang")


def chosen_editions(verses: DataFrame, editions: DataFrame) -> DataFrame:
    return verses.join(editions.select("lang", "edition"), ["lang", "edition"], "left_semi")


def selected_units(verses: DataFrame, selected: DataFrame, languages: DataFrame) -> DataFrame:
    """``(lang, verse_id, text)`` of the selected verses of the kept languages; a repeated verse keeps its last line."""
    kept = verses.join(selected.select("verse_id"), "verse_id", "left_semi").join(languages.select("lang"), "lang", "left_semi")
    return kept.groupBy("lang", "verse_id").agg(F.max_by("text", "line").alias("text"))


def avg_tokens(texts: DataFrame, by: str | list[str], n_tokens: Column | None = None) -> DataFrame:
    """``(by.., avg_subwords, n_units)``: mean token count over the texts that have any token.

    ``n_tokens`` is a column of token counts; by default whitespace-separated words.
    """
    by = [by] if isinstance(by, str) else by
    n = words("text") if n_tokens is None else n_tokens
    # empty units become NULL inside the aggregate: a filter would count the tokens of every text twice
    held = F.nullif(n, F.lit(0))
    counted = texts.groupBy(*by).agg(F.avg(held).alias("avg_subwords"), F.count(held).alias("n_units"))
    return counted.where(F.col("n_units") > 0)


def text_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of each text, trailing whitespace removed, with its line number."""
    lines = df.select("*", F.posexplode(F.split(F.col(text), "\n")).alias("line", "_line"))
    return lines.withColumn(text, F.rtrim("_line", F.lit(" \t\r"))).drop("_line")


def token_counter(load: Callable[[], Callable[[list[str]], list[list[str]]]]) -> Callable[[Column | str], Column]:
    """A token-count column from any tokenizer.

    ``load`` builds, once per task, a function from texts to token lists. Special tokens do not count.
    """
    special = frozenset(SPECIAL_TOKENS)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            tokens = encode(texts.fillna("").tolist())
            yield pd.Series([sum(t not in special for t in row) for row in tokens], dtype="int32")

    return count


def cost_of_members(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """Score of every member of every sample."""
    return samples.join(scores.select("id", "score"), "id")
