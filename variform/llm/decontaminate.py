"""Benchmark decontamination: a broadcast hash set of normalised benchmark word windows meets every document's windows.

Texts are lower-cased (A-Z) and cut into words. A benchmark item gives its windows of ``size`` consecutive words, or
one window of all its words if it has fewer. Each document hashes its own windows in one pass, in stretches of
``STRETCH`` words, so the work grows with the length of a text and not with its square; the hashes probe a broadcast table of the benchmark windows and the words themselves are compared inside the join, so a clash of hashes
never counts. The benchmark goes out in blocks of at most ``block`` windows, however large it is.

Defined cases: a null or empty text has no words and no hits; items without words have no windows; an item without an
id still hits but is not listed; equal rows give equal rows of the result, one each; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variform.llm.common import BETWEEN_WORDS, ascii_lower, spare, without, words

WINDOW = 10
#: Windows in one broadcast: about 300 bytes each with their words, so some 60 MB at most.
BLOCK = 200_000
#: Words of a text that are probed together.
STRETCH = 128


def _window_hash(hashes: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(size)))


def _runs(size: int) -> Column:
    """Hashes of the windows that begin at each word; those that run over the end match nothing."""
    return F.transform("hashes", lambda _, i: _window_hash(F.col("hashes"), i, size))


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(length, w, items)``: distinct windows with the ids, as text, of the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("all"))
    items = items.where(F.size("all") > 0).withColumn("length", F.least(F.size("all"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("all") - F.col("length") + 1)
    each = items.select("item", "all", "length", F.explode(starts).alias("at"))
    each = each.select("item", "length", F.slice("all", F.col("at"), F.col("length")).alias("w"))
    return each.groupBy("length", "w").agg(F.collect_set("item").alias("items"))


def _probe(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows of hits ``(key, at, length, items)`` and one row for each document, without ``at``, to count its words.

    A text is first cut in stretches that overlap by a window less a word, so what a probe carries to be compared is a
    stretch and not the text, however long that is.
    """
    source = docs.select("doc_id", F.xxhash64("text").alias("print"), words(F.col("text")).alias("all"))
    n = F.size("all")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(STRETCH))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("all", s + 1, F.lit(STRETCH + max(lengths) - 1)).alias("words")))
    source = source.select("doc_id", "print", n.alias("n"), F.explode(cut).alias("cut")).select("doc_id", "print", "n", "cut.start", "cut.words")
    source = source.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    runs = F.concat(*[_runs(n) for n in lengths])
    # windows of every length one after the other, and in the first stretch an entry at the end that stands for the document
    probed = F.when(F.col("start") == 0, F.array_append(runs, F.lit(None))).otherwise(runs)
    probes = source.select("doc_id", "print", "words", "n", "start", F.size("words").alias("here"), F.posexplode(probed).alias("pos", "h"))
    which = F.floor(F.col("pos") / F.greatest("here", F.lit(1))) + 1
    at = F.col("pos") % F.greatest("here", F.lit(1)) + 1
    keyed = reduce(
        lambda a, b: a.unionByName(b),
        [
            windows.where(F.col("length") == n).select(
                "w", "items", F.lit(n).alias("length"), _window_hash(F.transform("w", lambda x: F.xxhash64(x)), F.lit(0), n).alias("wh")
            )
            for n in lengths
        ],
    )
    same = (
        (F.col("h") == F.col("wh"))
        & (F.get(F.array(*map(F.lit, lengths)), (which - 1).cast("int")) == F.col("length"))
        & (F.slice("words", at.cast("int"), F.col("length")) == F.col("w"))
    )
    found = probes.join(F.broadcast(keyed), same, "left")
    whole = F.col("pos") == F.col("here") * len(lengths)
    return found.where(whole | F.col("wh").isNotNull()).select(
        "doc_id", "print", "n", whole.alias("whole"), F.when(~whole, (F.col("start") + at).cast("int")).alias("at"), F.when(~whole, F.col("length")).alias("length"), "items"
    )


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_words, n_hit, hits, items, print)`` for each document.

    ``hits`` holds the (start, length) of every benchmark window in words, ``items`` the ids sorted as text.
    """
    windows = benchmark_windows(benchmark, size)
    per_length = {r["length"]: r["count"] for r in windows.groupBy("length").count().collect()}  # at most ``size`` rows
    lengths, blocks = sorted(per_length) or [size], -(-sum(per_length.values()) // block) or 1
    parts = [windows.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == b) for b in range(blocks)] if blocks > 1 else [windows]
    probed = reduce(lambda a, b: a.unionByName(b), [_probe(docs, part, lengths) for part in parts])
    per_doc = probed.groupBy("doc_id", "print").agg(
        F.max("n").cast("long").alias("n_words"),
        (F.sum(F.col("whole").cast("long")) / blocks).cast("int").alias("copies"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.struct("at", "length")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["to"], x["at"] + x["length"]).alias("to"),
            (s["n"] + F.greatest(F.lit(0), x["at"] + x["length"] - F.greatest(s["to"], x["at"]))).alias("n"),
        ),
        lambda s: s["n"].cast("long"),
    )
    return per_doc.select("doc_id", "n_words", covered.alias("n_hit"), "hits", "items", "print", F.explode(F.expr("array_repeat(0, copies)")).alias("_")).drop("_")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words cut out of their texts (``remove="spans"``).

    The columns stay as they are; clean documents come back untouched.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    bad = scan(docs, benchmark, size).where("n_hit > 0").select("doc_id", "print", "hits")
    if remove == "documents":
        return without(docs, bad)
    doc_id, print_, hits = spare(docs.columns, "_llm_id", "_llm_print", "_llm_hits")
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(print_))
    joined = docs.join(bad.dropDuplicates(["doc_id", "print"]).toDF(doc_id, print_, hits), same, "left")
    return joined.withColumn("text", F.when(F.col(hits).isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col(hits)))).select(*docs.columns)


def _without(text: Column, hits: Column) -> Column:
    """The text without the words that the windows cover; what stands between words stays."""
    a_word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    gaps, inside = F.split(text, a_word, -1), F.regexp_extract_all(text, F.lit(f"({a_word})"), F.lit(1))
    hit = F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["at"] - 1, x["at"] + x["length"] - 2))))
    kept = F.transform(inside, lambda w, i: F.when(F.array_contains(hit, i), F.lit("")).otherwise(w))
    return F.array_join(F.zip_with(gaps, kept, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``scan`` by its contract."""
    return scan(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, w[i:i + least(len(w), {WINDOW}) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (win, n)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
  sha256(coalesce(its.items, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""
