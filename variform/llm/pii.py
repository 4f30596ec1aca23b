"""Personal data: four base kinds by pattern, and more of them by bootstrapped contexts.

Base matches are leftmost and not overlapping, with positions in code points from the pieces between matches. They seed
the bootstrap: the words around a seed are lexical patterns (the word before, the two words before, the word after, each
with the kind). Identifier-like tokens that are no base match are candidates. Patterns and instances form a graph that
Spark scores in rounds: a pattern's confidence is the share of its occurrences that are distinct known instances of its
kind, shrunk by support; an instance's score combines the patterns it stands in; candidates over the bar join the
instances and support patterns in the next round. What is found so becomes spans of the pattern's kind; base spans stay.

Everything is DataFrame functions. Patterns and instances are aggregated before they meet, and joins are on the pattern
or the instance with only confident patterns left on one side, so a very common word before a number costs its counts.

Defined cases: null text is empty; texts without digits or @ have no matches; repeated rows give equal rows each (copies
of a text count once as evidence); very long texts are whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variform.llm.common import stage

# The base patterns with possessive runs and look-behinds that only skip starts which cannot match: the same matches, in
# linear time. An address may begin right where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: A token that may be an identifier: it has a digit, and ends with a letter, a digit or a bracket.
CANDIDATE = r"(?<![A-Za-z0-9._%+@:/()-])(?=[A-Za-z._%+@:/()-]*+[0-9])[A-Za-z0-9._%+@:/()-]*[A-Za-z0-9)]"

#: Characters to either side of a match in which its context is read.
REACH = 64
ROUNDS = 3
#: A pattern needs as many distinct instances, and this confidence; an instance this score.
SUPPORT = 5
CONFIDENCE = 0.8
SCORE = 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the last digit on, every second one doubles and drops nine if that makes two digits."""
    turned = F.reverse(digits)

    def value(i: Column) -> Column:
        n = F.substr(turned, i, F.lit(1)).try_cast("int")
        return F.when(i % 2 == 1, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(value))
        return n.between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, start, stop, value) of the valid matches, from the lengths of matches and of what lies between."""
    one = "struct<kind: string, start: int, stop: int, value: string>"
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.char_length(x["gap"])
        stop = start + F.char_length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), x["hit"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(s["spans"], F.array(span)).alias("spans"))

    both = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("spans"))
    return F.filter(F.aggregate(both, begin, step, lambda s: s["spans"]), lambda s: _valid(kind, s["value"]))


def _none() -> Column:
    return F.array().cast("array<struct<kind: string, start: int, stop: int, value: string>>")


def with_base(docs: DataFrame) -> DataFrame:
    """``(doc_id, print, text, base)``; ``base`` has the spans by kind, then start."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text, digit = F.col("text"), F.col("digit")
    rows = rows.withColumn("digit", text.rlike("[0-9]"))
    parts = [
        F.when(text.contains("@"), _spans(text, EMAIL, "email")).otherwise(_none()),
        F.when(digit & text.rlike(r"[0-9]\.[0-9]"), _spans(text, IP, "ip")).otherwise(_none()),
        F.when(digit, _spans(text, CARD, "card")).otherwise(_none()),
        F.when(digit & text.contains("+"), _spans(text, PHONE, "phone")).otherwise(_none()),
    ]
    return rows.select("doc_id", F.xxhash64("text").alias("print"), "text", F.concat(*parts).alias("base"))


def _occurrences(based: DataFrame) -> DataFrame:
    """``(doc_id, print, kind, start, stop, value, patterns)``: base matches, and candidates with a null kind."""
    text = F.col("text")
    free = F.filter(
        F.when(text.rlike("[0-9]"), _spans(text, CANDIDATE, "candidate")).otherwise(_none()),
        lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])),
    )
    found = based.withColumn("free", free).where((F.size("base") > 0) | (F.size("free") > 0))
    each = found.select("doc_id", "print", "text", F.explode(F.concat("base", "free")).alias("x")).select("doc_id", "print", "text", "x.*")
    left = F.lower(F.substring(text, F.greatest(F.lit(1), F.col("start") + 1 - REACH), F.least(F.col("start"), F.lit(REACH))))
    right = F.lower(F.substring(text, F.col("stop") + 1, F.lit(REACH)))
    one = F.regexp_extract(left, r"(\S+)\s*$", 1)
    two = F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1)
    after = F.regexp_extract(right, r"^\s*(\S+)", 1)
    patterns = F.array(*(F.when(x != "", F.concat(F.lit(tag), x)) for tag, x in (("1:", one), ("2:", two), ("+:", after))))
    return each.select(
        "doc_id",
        "print",
        F.when(F.col("kind") != "candidate", F.col("kind")).alias("kind"),
        "start",
        "stop",
        "value",
        F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"),
    )


def _shape(kind: Column, value: Column) -> Column:
    """Whether a candidate can be of a kind at all."""
    digits = F.length(_digits(value))
    return (
        F.when(kind == "email", value.contains("@"))
        .when(kind == "ip", digits.between(4, 15) & value.rlike("^[0-9.:]+$"))
        .when(kind == "card", digits.between(12, 19) & ~value.rlike("[A-Za-z]"))
        .otherwise(digits.between(7, 19) & ~value.rlike("[A-Za-z]"))
    )


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, score: float = SCORE) -> DataFrame:
    """``(value, kind, score)`` of the candidates that contexts tell to be of a kind."""
    edges = stage(
        occurrences.select("value", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    )
    known = edges.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("score", F.lit(1.0))
    found = None
    for _ in range(rounds):
        marked = edges.select("pattern", "value").join(known, "value", "left")
        # distinct instances in all, and the scores of the known ones by kind: sums before any pairing
        sums = marked.groupBy("pattern").agg(
            F.count_distinct("value").alias("n"), *(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in KINDS)
        )
        best = F.greatest(*KINDS)
        kind = reduce(lambda c, k: F.when(F.col(k) == best, k).otherwise(c), reversed(KINDS), F.lit(None).cast("string"))
        good = sums.select("pattern", kind.alias("kind"), best.alias("hits"), (best / (F.col("n") + 0.5)).alias("confidence"))
        good = good.where((F.col("hits") >= support) & (F.col("confidence") >= confidence))
        told = edges.where("kind IS NULL").join(good.select("pattern", F.col("kind").alias("as"), "confidence"), "pattern")
        told = told.where(_shape(F.col("as"), F.col("value"))).groupBy("value", "as")
        told = told.agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("confidence"))))).alias("score"))
        best_kind = told.groupBy("value").agg(F.max(F.struct("score", F.col("as"))).alias("x"))
        new = stage(best_kind.select("value", F.col("x.as").alias("kind"), "x.score").where(F.col("score") >= score))
        if found is not None and new.count() == found.count():
            return new
        found = new
        known = edges.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("score", F.lit(1.0)).unionByName(found)
    return found


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)``: arrays of (kind, start, stop, value), by kind as listed, then start; one row per row."""
    based = with_base(docs)
    occurrences = stage(_occurrences(based).dropDuplicates(["doc_id", "print", "start", "kind"]))
    told = bootstrap(occurrences)
    extra = occurrences.where("kind IS NULL").drop("kind").join(told.select("value", "kind"), "value")
    extra = extra.groupBy("doc_id", "print").agg(F.collect_list(F.struct("kind", "start", "stop", "value")).alias("extra"))
    extra = extra.select(F.col("doc_id").alias("_llm_id"), F.col("print").alias("_llm_print"), "extra")
    slim = based.select("doc_id", "print", "base")
    joined = slim.join(extra, F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (F.col("print") == F.col("_llm_print")), "left")
    order = F.array(*map(F.lit, KINDS))
    ranked = F.transform(
        F.concat("base", F.coalesce("extra", _none())),
        lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value")),
    )
    spans = F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))
    return joined.select("doc_id", "base", F.when(F.col("extra").isNull(), F.col("base")).otherwise(spans).alias("spans"))


def _told(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    return find(docs).select(
        "doc_id", *(_count(k) for k in KINDS), F.sha2(_told("base"), 256).alias("base_sha256"), _told("spans").alias("spans")
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
