"""Sinks. Tables go out in parallel; single text files are for results of a bounded size."""

from __future__ import annotations

from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variform.operators.cleaning import feature_columns, integral_columns
from variform.operators.distance import to_wide

#: Files that common tools read: a header, and quotes inside a value doubled.
CSV = {"header": True, "escape": '"'}


def write_ids(ids: DataFrame, path: str, order: str = "id", one_file: bool = False) -> None:
    """One id per line, in order over the files; ``one_file`` is for lists of a bounded size."""
    lines = ids.orderBy(order).select(F.col(ids.columns[0]).cast("string"))
    (lines.coalesce(1) if one_file else lines).write.text(path)


def sample_name(method: str, frame: str, k: int, dist: str, seed: int) -> str:
    return f"{method}-{frame}-{k}-{dist}-{seed}"


def write_named_texts(lines: DataFrame, folder: str, order: list[str], end: str = ".txt") -> None:
    """``lines(name, text, ..)`` as one file per name, its lines in the given order.

    Each name is written by one task, which streams its sorted lines; then the files get their names, through the file
    system of the folder, whichever that is.
    """
    spark, root = lines.sparkSession, folder.rstrip("/")
    parts = f"{root}/_parts-{uuid4().hex}"
    placed = lines.repartition("name").sortWithinPartitions("name", *order)
    placed.select("name", "text").write.partitionBy("name").text(parts)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    for made in files.listStatus(path_of(parts)):
        name = made.getPath().getName()
        if made.isDirectory():
            written = [f.getPath() for f in files.listStatus(made.getPath()) if f.getPath().getName().startswith("part-")]
            if len(written) != 1 or not files.rename(written[0], path_of(f"{root}/{unquote(name.removeprefix('name='))}{end}")):
                raise OSError(f"cannot name the text of {name} in {root}")
    files.delete(path_of(parts), True)


def write_sample(ids: DataFrame, folder: str, method: str, frame: str, k: int, dist: str, seed: int) -> str:
    """A sample of ``k`` ids as one text file under a name that tells how it was drawn."""
    name = sample_name(method, frame, k, dist, seed)
    write_named_texts(ids.select(F.lit(name).alias("name"), F.col("id").cast("string").alias("text"), "id"), folder, ["id"])
    return f"{folder.rstrip('/')}/{name}.txt"


def write_sample_files(samples: DataFrame, folder: str, frame: str, dist: str, seed: str = "run + k") -> None:
    """Every sample of ``samples(method, run, k, id)`` as a text file of its own, by the same names."""
    name = F.concat_ws("-", "method", F.lit(frame), F.col("k"), F.lit(dist), F.expr(seed))
    write_named_texts(samples.select(name.alias("name"), F.col("id").cast("string").alias("text"), "id"), folder, ["id"])


def write_counts(counts: DataFrame, folder: str, name: str) -> str:
    """``counts(id, n)`` as one JSON object, ids in order."""
    key = F.to_json(F.array(F.col("id").cast("string")))
    entry = F.concat(F.expr("substring({0}, 2, length({0}) - 2)".format("_key")), F.lit(": "), F.col("n").cast("string"))
    entries = counts.withColumn("_key", key).select(F.lit(1).alias("at"), F.col("id").alias("id"), entry.alias("text"))
    first = counts.agg(F.min("id")).first()[0]
    entries = entries.withColumn("text", F.when(F.col("id") == F.lit(first), F.col("text")).otherwise(F.concat(F.lit(","), "text")))
    ends = counts.sparkSession.createDataFrame([(0, "{"), (2, "}")], "at int, text string").withColumn("id", F.lit(None).cast(counts.schema["id"].dataType))
    lines = entries.unionByName(ends).withColumn("name", F.lit(name))
    write_named_texts(lines, folder, ["at", "id"], ".json")
    return f"{folder.rstrip('/')}/{name}.json"


def write_samples(samples: DataFrame, path: str) -> None:
    """All samples of a sweep as one table, partitioned by how they were drawn."""
    # one task writes a sample's folder, so there are as many files as samples
    samples.repartition("method", "k", "run").write.partitionBy("method", "k", "run").parquet(path)


def write_results(results: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = results.write
    writer.options(**CSV).csv(path) if fmt == "csv" else writer.parquet(path)


def write_features(features: DataFrame, path: str, id_col: str = "id", id_name: str = "Lang_ID") -> None:
    """Processed features; columns of whole numbers are written as integers, missing values empty."""
    whole = integral_columns(features, feature_columns(features, id_col))
    whole.withColumnRenamed(id_col, id_name).write.options(**CSV).csv(path)


def write_distances(dist: DataFrame, path: str) -> None:
    """The long relation, clustered by its first end so that a step of a greedy sampler reads few files."""
    dist.repartitionByRange("a").sortWithinPartitions("a", "b").write.parquet(path)


def write_wide_distances(dist: DataFrame, ids: list, path: str, id_name: str = "Lang_ID") -> None:
    """The square CSV of a small frame."""
    to_wide(dist, ids, id_name).orderBy(id_name).write.options(**CSV).csv(path)


def append_costs(costs: DataFrame, path: str) -> None:
    """Add rows ``verses;avg_subwords;glottocode``."""
    costs.select("verses", "avg_subwords", "glottocode").write.mode("append").options(**CSV, sep=";").csv(path)


def write_language_texts(verses: DataFrame, path: str) -> None:
    """One text file per language, its lines in the order of the verses, the same for all languages."""
    write_named_texts(verses.select(F.col("lang").alias("name"), "verse_id", "text"), path, ["verse_id"])
