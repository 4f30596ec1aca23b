"""The given tables seen as the data model: items with features, groups, counts, places, texts.

Every binding covers its whole table. Part features take few values each, so the number of distinct
feature vectors stays below 700 however many parts there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variform.operators import cleaning

FEATURES = ("GB001", "GB024", "GB030", "GB065", "GB074")
MULTI_VALUE = ("GB024", "GB065")
BINARY_FEATURES = ("GB001", "GB030", "GB074", "GB024_1", "GB024_2", "GB065_1", "GB065_2")


class Tables:
    """Lazy readers of one scale directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- categorical items: parts -------------------------------------------------------------

    def raw_features(self) -> DataFrame:
        """Wide table of raw strings with the tokens ``?`` and ``no_cov`` for missing values."""
        brand_no = F.substring("p_brand", 7, 10).cast("int")
        values = (
            F.col("p_type").isin("LARGE", "PROMO", "STANDARD").cast("int"),
            brand_no % 4,
            (F.col("p_size") > 25).cast("int"),
            F.floor((F.col("p_retailprice") - 900) / 25).cast("int"),
            F.col("p_size") % 2,
        )
        columns = []
        for j, (name, value) in enumerate(zip(FEATURES, values), 1):
            key = F.col("p_partkey") + j
            missing = F.when(key % 11 == 0, "no_cov").when(key % 7 == 0, "?")
            columns.append(missing.otherwise(value.cast("string")).alias(name))
        return self.part.select(F.col("p_partkey").alias("id"), *columns)

    def gappy_features(self) -> DataFrame:
        """Raw features with empty cells, and without the parts of one type and one brand, whose groups stay."""
        gone = self.part.where("p_type = 'PROMO' OR p_brand = 'Brand#11'").select(F.col("p_partkey").alias("id"))
        gap = F.when(F.col("id") % 13 != 0, F.col("GB024"))
        return self.raw_features().withColumn("GB024", gap).join(gone, "id", "left_anti")

    def clean_features(self) -> DataFrame:
        return cleaning.clean_missing(self.raw_features(), FEATURES)

    def binary_features(self) -> DataFrame:
        return cleaning.binarize(self.clean_features(), MULTI_VALUE)

    def items(self) -> DataFrame:
        """``(id, x)``: every part with its binarized feature vector."""
        return cleaning.to_vector(self.binary_features(), BINARY_FEATURES)

    def families(self) -> DataFrame:
        """``(id, group)`` with some items in no group."""
        return self.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") != 13, F.col("p_type")).alias("group"))

    def genera(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") != 7, F.col("p_brand")).alias("group"))

    def counts(self) -> DataFrame:
        """``(id, n)``: how often each part is ordered."""
        return self.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))

    def taxonomy(self) -> DataFrame:
        """``(id, child_language_count)`` of every ordered part."""
        heavy = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
        return self.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count_if(heavy).alias("child_language_count"))

    def taxed_parts(self) -> DataFrame:
        """``(id)`` of parts ever sold at a tax of 8 percent and a quantity of 40 or more."""
        sold = self.lineitem.where((F.col("l_tax") >= 0.08) & (F.col("l_quantity") >= 40))
        return sold.select(F.col("l_partkey").alias("id")).distinct()

    def neighbours_in_orders(self) -> DataFrame:
        """``(a, b)``: parts on consecutive lines of an order, smaller first, each pair once."""
        line = self.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p"))
        following = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p").alias("q"))
        pairs = line.join(following, ["l_orderkey", "l_linenumber"]).where("p <> q")
        return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()

    # --- dense items: embeddings --------------------------------------------------------------

    def points(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))

    def point_labels(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("group"))

    # --- places: customers, by nation and market ----------------------------------------------

    def places(self) -> DataFrame:
        """``(id, latitude, longitude)``: customers live at one of 125 places, one nation has no coordinates."""
        nation, market = F.col("c_nationkey"), F.ascii("c_mktsegment")
        known = nation != 24
        return self.customer.select(
            F.col("c_custkey").alias("id"),
            F.when(known, nation * 6.5 - 72.25 + (market % 5) * 0.75).alias("latitude"),
            F.when(known, (nation * 47) % 360 - 180 + market * 0.31).alias("longitude"),
        )

    def code_rows(self) -> DataFrame:
        """Customers with a code of another system; some codes have no counterpart."""
        return self.customer.select(F.col("c_custkey").alias("item"), F.concat(F.lit("c"), F.col("c_nationkey") + 3).alias("code"))

    def code_taxonomy(self) -> DataFrame:
        """``(id, name, code, row)``: nations, two codes of which occur twice."""
        key = F.col("n_nationkey")
        return self.nation.select(
            F.col("n_nationkey").cast("string").alias("id"),
            F.col("n_name").alias("name"),
            F.concat(F.lit("c"), F.when(key.isin(20, 21), key - 10).otherwise(key)).alias("code"),
            key.alias("row"),
        )

    # --- text -----------------------------------------------------------------------------------

    def document_features(self) -> DataFrame:
        """``(id, quality, toxic, length, lines, lang, source)``: raw strings, unlabelled documents have ``?``."""
        labels = self.labels.select("doc_id", "quality", "toxic")
        label = [F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in ("quality", "toxic")]
        return self.documents.join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("id"),
            *label,
            (F.col("n_chars") > 500).cast("int").cast("string").alias("length"),
            (F.length("text") - F.length(F.regexp_replace("text", "\n", ""))).cast("string").alias("lines"),
            "lang",
            "source",
        )

    def verses(self) -> DataFrame:
        """Events as a parallel corpus: user = language, week = edition, event type and tens of k = verse."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            F.col("user_id").alias("lang"),
            F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("edition"),
            F.concat_ws("/", F.col("event_type"), F.floor(k / 10).cast("string")).alias("verse_id"),
            F.concat_ws(" ", F.col("props"), F.col("value").cast("string")).alias("text"),
            F.col("event_id").alias("line"),
        )
