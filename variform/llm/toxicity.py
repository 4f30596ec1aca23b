"""Toxicity from a lexicon that tolerates misspellings, weighed by context.

The lexicon holds words that mark toxic documents among the labelled ones, with their log odds. A word of a text meets
it through Levenshtein automata intersected with the lexicon's trie, so misspelled terms count too, with less weight per
edit; words that the labels show to be harmless are exempt. Each match is weighed by its window: the log odds of the
words around terms, and whether it stands between two quotation marks of one sentence; marks between letters are
apostrophes. A logistic regression over a document's match features
gives the score.

Learning reads at most about ``sample`` labelled documents (a documented bound), chosen by the hash of their text, equal
texts once with their highest label. Scoring reads every whole text.

Defined cases: null and empty texts have no match and get the score of such documents; null labels teach nothing; if
either label is missing all scores are the share of toxic labels (0 without any); an id with several labels takes the
highest; repeated rows are scored alike, each; extra columns are left alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variform.llm.automaton import Lexicon
from variform.llm.common import stage

SAMPLE = 30_000
TASKS = 24
#: Terms and context words that a model may hold.
TOP = 5_000
#: Share of the toxic documents that must hold a term, at least three of them, and its least log odds.
SUPPORT = 0.003
MIN_ODDS = 2.5
#: Words to either side of a match that count as its context.
WINDOW = 4
#: Factor per edit.
EDIT_WEIGHT = 0.6
#: Words a worker remembers before it starts over.
MEMO = 400_000
QUOTES = "\"“”„«»‘’"
REPORTING = frozenset("said says wrote quoted called quote dit écrit sagte schrieb dijo escribió".split())

_LETTERS = re.compile(r"[^\W\d_]+")
# a mark with a letter to either side is an apostrophe
_TOKENS = re.compile(rf"[^\W\d_]+|(?<![^\W\d_])[{QUOTES}]|[{QUOTES}](?![^\W\d_])|[.!?\n]")
FEATURES = 6


def _quoted(found: list[str]) -> tuple[list[str], list[bool]]:
    """Words and marks without the ends of sentences, and which of them stand between two marks of one sentence."""
    tokens: list[str] = []
    inside: list[bool] = []
    marks: list[int] = []
    for t in (*found, "."):
        if t in ".!?\n":
            for first, last in zip(marks[::2], marks[1::2]):
                inside[first:last] = [True] * (last - first)
            marks.clear()
            continue
        if t in QUOTES:
            marks.append(len(tokens))
        tokens.append(t)
        inside.append(False)
    return tokens, inside


class Model:
    def __init__(self, terms: dict[str, float], harmless: set[str], context: dict[str, float], weights: np.ndarray):
        self.terms, self.harmless, self.context, self.weights = terms, harmless, context, weights
        self.lexicon = Lexicon(terms)
        self.memo: dict[str, tuple[int, str] | None] = {}

    def parts(self) -> tuple:
        return self.terms, self.harmless, self.context, self.weights

    def hits(self, words: set[str]) -> dict[str, tuple[int, str]]:
        memo, match = self.memo, self.lexicon.match
        if len(memo) > MEMO:
            memo.clear()
        found = {}
        for word in words:
            if word in memo:
                hit = memo[word]
            else:
                hit = memo[word] = None if word in self.harmless else match(word)
            if hit is not None:
                found[word] = hit
        return found

    def features(self, text: str | None) -> list[float]:
        """Weights of plain and of quoted matches, the strongest match, matches per hundred words, context, presence."""
        lowered = text.lower() if text else ""
        words = _LETTERS.findall(lowered)
        found = self.hits(set(words))
        if not found:
            return [0.0] * FEATURES
        tokens, inside = _quoted(_TOKENS.findall(lowered))
        plain = quoted = strongest = around = 0.0
        n = 0
        for i, t in enumerate(tokens):
            hit = found.get(t)
            if hit is None:
                continue
            window = [w for w in tokens[max(0, i - WINDOW) : i + WINDOW + 1] if w not in QUOTES]
            weight = self.terms[hit[1]] * EDIT_WEIGHT ** hit[0]
            context = sum(self.context.get(w, 0.0) for w in window)
            n += 1
            around += context
            if inside[i] or any(w in REPORTING for w in window):
                quoted += weight
            else:
                plain += weight
                strongest = max(strongest, weight)
        return [math.log1p(plain), math.log1p(quoted), strongest, min(10.0, 100 * n / len(words)), around / n, 1.0]

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + np.dot(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many documents of either label each word stands."""
    for batch in batches:
        seen = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch["text"], batch["toxic"]):
            seen[toxic].update(set(_LETTERS.findall(text.lower())))
        yield _table(seen)


def _table(seen: dict[int, Counter]) -> pd.DataFrame:
    words = list(seen[0].keys() | seen[1].keys())
    return pd.DataFrame({"word": pd.Series(words, dtype=object), "calm": [seen[0][w] for w in words], "toxic": [seen[1][w] for w in words]})


def _exempt(terms: dict[str, float]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(terms)
        for batch in batches:
            near = [w for w in batch["word"] if w not in terms and lexicon.match(w) is not None]
            yield pd.DataFrame({"word": pd.Series(near, dtype=object)})

    return work


def _windows(terms: dict[str, float], harmless: set[str]):
    """Words around matches, by the label of their document."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(terms, harmless, {}, np.zeros(1 + FEATURES))
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = _LETTERS.findall(text.lower())
                found = model.hits(set(words))
                near = set()
                for i, w in enumerate(words) if found else ():
                    if w in found:
                        near.update(x for x in words[max(0, i - WINDOW) : i + WINDOW + 1] if x not in found)
                seen[toxic].update(near)
            yield _table(seen)

    return work


def _features(parts: tuple):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*parts)
        for batch in batches:
            yield pd.DataFrame({"x": pd.Series([model.features(t) for t in batch["text"]], dtype=object), "toxic": list(batch["toxic"])})

    return work


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps on the penalised likelihood; the intercept is free."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame, sample: int = SAMPLE, top: int = TOP) -> Model:
    """A model from rows of ``(text, toxic)``."""
    known = labelled.where("text IS NOT NULL AND toxic IN (0, 1)").select("text", F.col("toxic").cast("int"))
    total = known.count()
    share = min(1.0, sample / max(total, 1))
    rows = known.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    # equal texts combine before they travel; the sample is then dealt evenly
    rows = stage(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(TASKS))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    calm, toxic = sizes.get(0, 0), sizes.get(1, 0)
    none = Model({}, set(), {}, np.zeros(1 + FEATURES))
    if not calm or not toxic:
        none.weights[0] = 30.0 if toxic else -30.0
        return none

    def odds(word: str = "toxic", least: float = 0.5):
        return F.log((F.col(word) + least) / (toxic + 1)) - F.log((F.col("calm") + least) / (calm + 1))

    schema = "word string, calm bigint, toxic bigint"
    counts = stage(rows.mapInPandas(_count, schema).groupBy("word").agg(F.sum("calm").alias("calm"), F.sum("toxic").alias("toxic")))
    support = max(3, math.ceil(SUPPORT * toxic))
    strong = counts.withColumn("odds", odds()).where((F.col("toxic") >= support) & (F.col("odds") >= MIN_ODDS))
    terms = {r["word"]: r["odds"] for r in strong.orderBy(F.desc("odds"), "word").limit(top).collect()}
    mild = counts.withColumn("odds", odds()).where("odds < 1 AND calm >= 2").select("word").mapInPandas(_exempt(terms), "word string")
    harmless = {r["word"] for r in mild.collect()}  # near a term, so bounded by the terms' neighbourhoods in the sample
    around = rows.mapInPandas(_windows(terms, harmless), schema).groupBy("word").agg(F.sum("calm").alias("calm"), F.sum("toxic").alias("toxic"))
    # against the same number of each, so that the many calm documents without a match do not count
    base = around.agg(F.sum("calm").alias("c"), F.sum("toxic").alias("t")).first()
    told = around.where("calm + toxic >= 10").withColumn(
        "odds", F.log((F.col("toxic") + 5) / ((base["t"] or 0) + 5)) - F.log((F.col("calm") + 5) / ((base["c"] or 0) + 5))
    )
    context = {r["word"]: r["odds"] for r in told.orderBy(F.desc(F.abs("odds")), "word").limit(top).collect()} if base["c"] else {}
    features = rows.mapInPandas(_features((terms, harmless, context, none.weights)), "x array<double>, toxic int").toPandas()
    weights = _logistic(np.array(features["x"].tolist(), dtype=float), features["toxic"].to_numpy(dtype=float))
    return Model(terms, harmless, context, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 up)."""
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        local = Model(*sent.value)
        for texts in batches:
            yield pd.Series([local.score(t) for t in texts], dtype=float)

    others = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*others, toxicity("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, toxic)`` of the documents that have a label."""
    per_id = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(per_id, "doc_id")
