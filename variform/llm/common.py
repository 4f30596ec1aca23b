"""Helpers the operators share: table access, words, staging and row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variform.session import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# everything that is no digit, no lower-case ASCII letter and no character beyond ASCII parts two words
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: White space that the contracts name: space and the characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"

__all__ = ["BETWEEN_WORDS", "LOWER", "SPACES", "UPPER", "ascii_lower", "held_out", "spare", "spread_join", "stage", "table", "without", "words"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null stays null."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words of a text; null and empty texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def spare(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores in front as make it none of ``columns``, in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id and xxhash64 of the text are a row of ``lost(doc_id, print)``."""
    doc_id, print_ = spare(docs.columns, "_llm_id", "_llm_print")
    lost = lost.select(F.col("doc_id").alias(doc_id), F.col("print").alias(print_))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(print_))
    return docs.join(lost, same, "left_anti")


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, weight: str, row_id: str, shares: int = 200) -> DataFrame:
    """``rows`` with the columns of ``keyed``, a staged table of one row per key with the key's number of rows in ``weight``.

    Keys with more than one of ``shares`` parts of all rows, of which there are fewer than ``shares``, are dealt to as
    many tasks as they have such parts; the list of them is broadcast.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 1
    parts = F.ceil(F.col(weight) * shares / F.lit(total)).cast("int")
    hot = F.broadcast(keyed.where(F.col(weight) * shares > total).select(key, parts.alias("_parts")))
    n = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(row_id), n).cast("int")).drop("_parts")
    right = keyed.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    return left.join(right, [key, "_salt"]).drop("_salt")
