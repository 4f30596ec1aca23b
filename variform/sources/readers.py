"""Readers for the file formats of the domain. Nothing is inferred: keys are strings, values cast after reading."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variform.functions.columns import clean_number
from variform.operators.distance import from_wide

# columns of an item metadata file (fixed values)
ITEM_SCHEMA = (
    "ID STRING, Name STRING, Macroarea STRING, Latitude DOUBLE, Longitude DOUBLE, Glottocode STRING, "
    "ISO639P3code STRING, provenance STRING, Family_name STRING, Family_level_ID STRING, "
    "Language_level_ID STRING, level STRING, lineage STRING"
)
# lines before the verses of an edition (fixed value)
HEADER_LINES = 11
# how columns without a header text come out of common tools (fixed values)
UNNAMED = re.compile(r"Unnamed: [0-9]+|_c[0-9]+")

# one entry of a JSON object of counts, with what may stand around the first and the last
_COUNT = r'^\s*\{?\s*"((?:[^"\\]|\\.)*)"\s*:\s*(-?[0-9]+)\s*\}?\s*$'


def _found(path: str, read) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"Cannot find {path}") from error
        raise


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: str | None = None) -> DataFrame:
    # a quote inside a value is doubled, as common tools write it
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"')
    reader = reader.schema(schema) if schema else reader
    return _found(path, reader.csv)


def _rename_index(df: DataFrame, id_name: str) -> DataFrame:
    """A file saved with an unnamed index has an empty first header."""
    first = df.columns[0]
    return df if id_name in df.columns else df.withColumnRenamed(first, id_name)


def read_features(spark: SparkSession, path: str, id_name: str = "Lang_ID", drop_unnamed: bool = True) -> DataFrame:
    """Wide feature table of raw strings with the key column first, named ``id``."""
    df = _rename_index(read_csv(spark, path), id_name)
    extra = [c for c in df.columns if UNNAMED.fullmatch(c)] if drop_unnamed else []
    rest = [c for c in df.columns if c != id_name and c not in extra]
    return df.select(F.col(id_name).alias("id"), *[F.col(f"`{c}`") for c in rest])


def read_distances(spark: SparkSession, path: str, id_name: str = "Lang_ID") -> DataFrame:
    """Long relation ``(a, b, d)`` of a wide square file."""
    return from_wide(_rename_index(read_csv(spark, path), id_name), id_name).withColumn("d", clean_number("d"))


def read_item_metadata(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schema=ITEM_SCHEMA)


def read_group_metadata(spark: SparkSession, path: str, id_col: str = "Glottocode", group_col: str = "Genus") -> DataFrame:
    """``(id, group)`` of a grouping file."""
    return read_csv(spark, path).select(F.col(id_col).alias("id"), F.col(group_col).alias("group"))


def read_counts(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """``(id, n, pos)`` of a JSON object id -> count; ``pos`` keeps the file's order.

    The file is split at commas, so an object of any size is read by many tasks. An id that holds a comma is an error;
    ``whole`` reads such a file as one text.
    """
    if whole:
        text = _found(path, lambda p: spark.read.text(p, wholetext=True))
        return text.select(F.posexplode(F.from_json("value", "map<string,bigint>")).alias("pos", "id", "n")).select("id", "n", "pos")
    pieces = _found(path, spark.read.option("lineSep", ",").text).select("value", F.monotonically_increasing_id().alias("pos"))
    pieces = pieces.where(~F.col("value").rlike(r"^[\s{}]*$"))
    name, number = (F.regexp_extract("value", _COUNT, k) for k in (1, 2))
    wrong = F.raise_error(F.concat(F.lit("no count of a JSON object, or an id with a comma (whole=True reads it): "), "value"))
    return pieces.select(
        # escapes in a name are those of JSON
        F.when(F.col("value").rlike(_COUNT), F.from_json(F.concat(F.lit('["'), name, F.lit('"]')), "array<string>")[0]).otherwise(wrong.cast("string")).alias("id"),
        number.cast("bigint").alias("n"),
        "pos",
    )


def read_frame(spark: SparkSession, path: str, sort: bool = False) -> DataFrame:
    """``(id, pos)`` of a file with one id per line; blank lines are dropped.

    ``pos`` follows the file, or the ids themselves with ``sort``.
    """
    # rows of one file come in order, whatever its splits
    lines = _found(path, spark.read.text).select(F.trim("value").alias("id"), F.monotonically_increasing_id().alias("pos"))
    lines = lines.where(F.col("id") != "")
    return lines.withColumn("pos", F.col("id")) if sort else lines


def frame_of_relation(dist: DataFrame) -> DataFrame:
    """The default frame: every id of the distance relation, in sorted order."""
    return dist.select(F.col("a").alias("id")).distinct().withColumn("pos", F.col("id"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path)
    return df.withColumn("child_language_count", F.col("child_language_count").try_cast("int"))


def read_semicolon_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, sep=";")


def _corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(edition, block, row, header_line, value)`` of all lines of a folder of editions.

    Files are split like any text, so an edition of any size is read by many tasks. Rows of a split
    are numbered in order; in the first split of a file the number counts from its first line, which
    is all that finding the header takes. ``header_line`` is NULL beyond that split.
    """
    lines = _found(path, spark.read.option("recursiveFileLookup", True).text).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("edition"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    starts = lines.where("block = 0").groupBy("file").agg(F.min("row").alias("_start"))
    number = F.when(F.col("block") == 0, F.col("row") - F.col("_start"))
    return lines.join(starts, "file").select("edition", "block", "row", number.alias("header_line"), "value")


def read_parallel_corpus(spark: SparkSession, path: str, codes: DataFrame | None = None) -> DataFrame:
    """``verses(lang, edition, verse_id, text, line)`` of a folder with one file per edition.

    The language is the start of the file name. After the header each line holds a verse id and
    its text; ``#`` is removed from ids and blank lines are skipped. ``line`` orders the lines of
    an edition.
    """
    lines = _corpus_lines(spark, path)
    squeezed = F.trim(F.regexp_replace("value", r"\s+", " "))
    body = (F.col("header_line").isNull() | (F.col("header_line") >= HEADER_LINES)) & (squeezed != "")
    tokens = F.split(squeezed, " ")
    verses = lines.where(body).select(
        F.substring("edition", 1, 3).alias("lang"),
        "edition",
        F.replace(tokens[0], F.lit("#"), F.lit("")).alias("verse_id"),
        F.array_join(F.slice(tokens, 2, F.size(tokens)), " ").alias("text"),
        F.struct("block", "row").alias("line"),
    )
    return verses if codes is None else verses.join(codes.select(F.col(codes.columns[0]).alias("lang")), "lang", "left_semi")


def read_corpus_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(edition, code, script)`` from the second and third header line of each edition."""
    lines = _corpus_lines(spark, path).where(F.col("header_line").isin(1, 2))
    value = F.rtrim("value")
    return lines.groupBy("edition").agg(
        F.max(F.when(F.col("header_line") == 1, F.right(value, F.lit(3)))).alias("code"),
        F.max(F.when(F.col("header_line") == 2, F.right(value, F.lit(4)))).alias("script"),
    )


def read_text_units(spark: SparkSession, path: str) -> DataFrame:
    """``(code, path, text)``: one text per line; the code is the file's name end before its extension."""
    lines = _found(path, spark.read.text).select(F.col("_metadata.file_path").alias("path"), F.rtrim("value").alias("text"))
    return lines.select(F.substring(F.right("path", F.lit(7)), 1, 3).alias("code"), "path", "text")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``(id, x)`` of a parquet table of vectors."""
    return _found(path, spark.read.parquet).select("id", F.col("x").cast("array<double>").alias("x"))
