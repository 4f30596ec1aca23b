"""Queries that write a table in a file format of the domain, in the shared folder, and read it again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variform.operators import cleaning, corpus, distance, metrics, sampling
from variform.plans.bindings import BINARY_FEATURES
from variform.plans.catalogue import DRAWS, _place_relation, query, rounded
from variform.session import new_folder
from variform.sources import readers, writers

#: Languages and header lines of the corpus that is written.
LANGUAGES = 40
SCRIPTS = ("Latn", "Cyrl", "Arab")


@query
def file_features(t):
    """Processed features as integers in CSV, read as raw text and cleaned."""
    path = new_folder(t.spark)
    writers.write_features(t.binary_features(), path)
    back = readers.read_features(t.spark, path)
    return cleaning.clean_missing(back, BINARY_FEATURES).withColumn("id", F.col("id").cast("bigint"))


def _square(t) -> tuple[DataFrame, list]:
    relation = _place_relation(t)
    ends = relation.select(F.col("a").alias("id")).distinct()
    ids = [r["id"] for r in ends.orderBy("id").limit(distance.PIVOT_LIMIT + 1).collect()]
    return relation.unionByName(ends.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d"))), ids


@query
def file_distances(t):
    """The square CSV of all places; places are few whatever the number of customers."""
    square, ids = _square(t)
    path = new_folder(t.spark)
    writers.write_wide_distances(square, ids, path)
    return rounded(readers.read_distances(t.spark, path), "d").withColumn("a", F.col("a").cast("bigint"))


@query
def file_default_frame(t):
    """The frame that a distance relation has by itself, from the long file."""
    path = new_folder(t.spark)
    writers.write_distances(_place_relation(t), path)
    return readers.frame_of_relation(t.spark.read.parquet(path)).select("id")


@query
def file_frame(t):
    """Ids as lines, read in the order of the file."""
    path = new_folder(t.spark)
    writers.write_ids(t.taxed_parts(), path)
    frame = readers.read_frame(t.spark, path, sort=True)
    return frame.select(F.col("id").cast("bigint").alias("id"), F.col("pos").cast("bigint").alias("pos"))


@query
def file_item_metadata(t):
    """Customers as items with their places and lineage."""
    place = t.places().select("id", F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"))
    code = F.concat(F.lit("cust"), F.col("c_custkey").cast("string"))
    nation = F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))
    given = {
        "ID": F.col("c_custkey").cast("string"),
        "Name": F.col("c_name"),
        "Macroarea": F.col("c_mktsegment"),
        "Latitude": F.col("Latitude"),
        "Longitude": F.col("Longitude"),
        "Glottocode": code,
        "ISO639P3code": F.lit(None).cast("string"),
        "provenance": F.lit("orders, and \"quoted\""),
        "Family_name": F.when(F.col("c_nationkey") != 7, nation),
        "Family_level_ID": nation,
        "Language_level_ID": code,
        "level": F.lit("language"),
        "lineage": F.concat_ws("/", nation, code),
    }
    path = new_folder(t.spark)
    items = t.customer.join(place, F.col("c_custkey") == F.col("id")).select(*[c.alias(name) for name, c in given.items()])
    items.write.option("header", True).option("escape", '"').csv(path)
    return rounded(readers.read_item_metadata(t.spark, path), "Latitude", "Longitude")


@query
def file_groups(t):
    path = new_folder(t.spark)
    t.genera().select(F.col("id").alias("Glottocode"), F.col("group").alias("Genus"), F.lit(1).alias("other")).write.option("header", True).csv(path)
    return readers.read_group_metadata(t.spark, path).withColumn("id", F.col("id").cast("bigint"))


@query
def file_counts(t):
    """Uses of every part as one JSON object, read by many tasks."""
    path = writers.write_counts(t.counts(), new_folder(t.spark), "counts")
    return readers.read_counts(t.spark, path).select(F.col("id").cast("bigint").alias("id"), "n")


@query
def file_taxonomy(t):
    path = new_folder(t.spark)
    t.taxonomy().write.option("header", True).csv(path)
    return readers.read_taxonomy(t.spark, path).select(F.col("id").cast("bigint").alias("id"), "child_language_count")


@query
def file_token_costs(t):
    """Token costs of documents by language, then those of conversations by role added to the same file."""
    path = new_folder(t.spark)
    by_lang = corpus.avg_tokens(corpus.text_lines(t.documents), "lang").withColumn("code", F.col("lang"))
    by_role = corpus.avg_tokens(t.conversations, "role").withColumn("code", F.col("role"))
    for costs in (by_lang, by_role):
        writers.append_costs(costs.select(F.concat(F.lit("verses/"), "code").alias("verses"), "avg_subwords", F.col("code").alias("glottocode")), path)
    back = readers.read_semicolon_csv(t.spark, path)
    return rounded(back.withColumn("avg_subwords", F.col("avg_subwords").cast("double")), "avg_subwords")


def _corpus(t) -> str:
    """Events as a folder of editions, each a header and its verses in order."""
    events = t.events
    language = F.col("user_id") % LANGUAGES
    name = F.concat(F.lit("l"), F.lpad(language.cast("string"), 2, "0"), F.lit("-week"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("string"))
    verses = events.select(name.alias("name"), F.col("event_id").alias("at"), F.concat(F.lit("#"), F.col("event_id").cast("string"), F.lit(" "), "event_type", F.lit("  "), "props").alias("text"))
    editions = events.select(name.alias("name"), language.alias("language")).distinct()
    code = F.concat(F.lit("c"), F.lpad(F.col("language").cast("string"), 2, "0"))
    script = F.element_at(F.array(*map(F.lit, SCRIPTS)), (F.col("language") % len(SCRIPTS) + 1).cast("int"))
    head = F.array(F.lit("# an edition"), F.concat(F.lit("# code: "), code), F.concat(F.lit("# script: "), script), *[F.lit(f"# line {k}") for k in range(3, readers.HEADER_LINES)])
    header = editions.select("name", F.posexplode(head).alias("at", "text")).withColumn("at", F.col("at").cast("bigint") - readers.HEADER_LINES)
    path = new_folder(t.spark)
    writers.write_named_texts(header.unionByName(verses), path, ["at"])
    return path


@query
def file_corpus(t):
    return readers.read_parallel_corpus(t.spark, _corpus(t)).select("lang", "edition", "verse_id", "text")


@query
def file_corpus_headers(t):
    return readers.read_corpus_headers(t.spark, _corpus(t))


@query
def file_language_texts(t):
    """One ordered file of verses per language, read as text units with the code from its name."""
    verses = t.events.select(
        F.concat(F.lit("l"), F.lpad((F.col("user_id") % LANGUAGES).cast("string"), 2, "0")).alias("lang"),
        F.col("event_id").alias("verse_id"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
    )
    path = new_folder(t.spark)
    writers.write_language_texts(verses, path)
    return readers.read_text_units(t.spark, path).select("code", "text")


@query
def file_points(t):
    path = new_folder(t.spark)
    t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")).write.parquet(path)
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return rounded(readers.read_points(t.spark, path).select("id", F.size("x").alias("width"), F.col("x")[0].alias("first"), total.alias("total")), "first", "total")


@query
def file_samples(t):
    path = new_folder(t.spark)
    writers.write_samples(sampling.random_draws(t.items().select("id"), DRAWS), path)
    return t.spark.read.parquet(path).select("method", "run", "k", "id")


@query
def file_sample_lists(t):
    """Every sample as a file of its own, named by how it was drawn."""
    path = new_folder(t.spark)
    writers.write_sample_files(sampling.random_draws(t.items().select("id"), DRAWS), path, "parts", "dists")
    lines = t.spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"[.]txt$", "").alias("name"), F.col("value").cast("bigint").alias("id"))
    return lines.select("name", "id")


@query
def file_results(t):
    samples = sampling.random_draws(t.items().select("id"), DRAWS)
    path = new_folder(t.spark)
    writers.write_results(metrics.evaluate(samples, t.items(), distance.distance_range(t.items())), path, "csv")
    back = readers.read_csv(t.spark, path)
    numbers = {c: F.col(c).cast("int") for c in ("run", "k")} | {c: F.col(c).cast("double") for c in metrics.METRICS}
    return rounded(back.withColumns(numbers), *metrics.METRICS)
