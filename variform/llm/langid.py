"""Language ID by words first, then shorter and shorter character n-grams.

The model holds, per language, log frequencies of frequent words and of character n-grams of lengths 5 to 1. A word of
a text that the word list knows is scored by it; an unseen word is scored by the n-grams of the longest length of which
the model knows at least one, so length 5 falls back to 4, 3, 2 and 1. The language with the highest sum, prior
included, wins; the score is its share among all languages.

``fit`` learns from about ``sample`` labelled documents of each language (the bound is this parameter; documents are
chosen by the hash of their text, so that any table size gives the same kind of sample), but counts the prior over all.
The model it returns is bounded by ``top`` entries of each kind and language.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with a null language teach nothing;
with no labelled rows at all everything is ``und``; repeated rows are scored alike, each; very long texts are read
whole; extra columns are left alone. Ties go to the language that sorts first.
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

from variform.llm.common import stage

UND = "und"
SAMPLE = 1_500
TOP = 20_000
LENGTHS = (5, 4, 3, 2, 1)
#: The sample is bounded, so it is counted in a fixed number of tasks.
TASKS = 12
#: Scores below this are not taken as a language by ``accepted``.
MIN_SCORE = 0.5
#: Weight of a letter run found by words, and of one found by n-grams of each length.
WEIGHTS = {0: 1.0, 5: 0.7, 4: 0.6, 3: 0.5, 2: 0.3, 1: 0.1}
#: Words a worker remembers before it starts over.
MEMO = 200_000

_LETTERS = re.compile(r"[^\W\d_]+")


def _grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and n-grams of a task's texts with their counts, by language."""
    for batch in batches:
        by_lang: dict[str, Counter] = {}
        for lang, text in zip(batch["lang"], batch["text"]):
            by_lang.setdefault(lang, Counter()).update(_LETTERS.findall(text.lower()))
        rows = []
        for lang, seen in by_lang.items():
            grams = {n: Counter() for n in LENGTHS}
            for word, k in seen.items():
                for n in LENGTHS:
                    for g in _grams(word, n):
                        grams[n][g] += k
            rows += [(lang, 0, w, k) for w, k in seen.items()]
            rows += [(lang, n, g, k) for n in LENGTHS for g, k in grams[n].items()]
        lang, kind, term, n = zip(*rows) if rows else ((), (), (), ())
        yield pd.DataFrame({"lang": pd.Series(lang, dtype=object), "kind": pd.Series(kind, dtype="int32"), "term": pd.Series(term, dtype=object), "n": pd.Series(n, dtype="int64")})


class Model:
    """Log frequencies by kind (0: word, else the n-gram length) and the languages they speak of."""

    def __init__(self, langs: list[str], prior: np.ndarray, tables: dict[int, dict[str, tuple[float, ...]]]):
        self.langs, self.prior, self.tables = langs, prior, tables
        self.index = {w: k for k, w in enumerate(tables[0])}
        self.known = len(self.index)
        # rows of the known words, then those of unseen words that were scored before
        self.rows = np.zeros((self.known + MEMO, len(langs)))
        if self.known:
            self.rows[: self.known] = WEIGHTS[0] * np.array(list(tables[0].values()))

    def unseen(self, word: str) -> list[float]:
        for n in LENGTHS:
            get = self.tables[n].get
            found = [x for g in _grams(word, n) if (x := get(g)) is not None]
            if found:
                return [WEIGHTS[n] / len(found) * sum(column) for column in zip(*found)]
        return [0.0] * len(self.langs)

    def _remember(self, word: str) -> int:
        k = len(self.index)
        self.rows[k] = self.unseen(word)
        self.index[word] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _LETTERS.findall(text.lower()) if text else []
        # a run may hold nothing but number signs, which are no letters
        if not self.langs or not any(any(map(str.isalpha, w)) for w in words):
            return UND, 0.0
        total = self.prior.copy()
        for start in range(0, len(words), 4096):  # rows of a stretch are summed before the memo may start over
            part = words[start : start + 4096]
            if len(self.index) + len(part) > len(self.rows):
                self.index = {w: k for k, w in enumerate(self.tables[0])}
            get, remember = self.index.get, self._remember
            at = [k if (k := get(w)) is not None else remember(w) for w in part]
            total += self.rows[at].sum(axis=0)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def fit(labelled: DataFrame, sample: int = SAMPLE, top: int = TOP) -> Model:
    """A model from rows of ``(text, lang)``."""
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0), {n: {} for n in (0, *LENGTHS)})
    share = F.when(F.lit(False), 0.0)
    for lang in langs:
        share = share.when(F.col("lang") == lang, min(1.0, sample / sizes[lang]))
    chosen = known.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    # equal texts of a language count once, so a text of many rows does not outweigh the sample
    counts = chosen.select("lang", "text").distinct().repartition(TASKS).mapInPandas(_count, "lang string, kind int, term string, n bigint")
    # languages stay values until their counts are numbered, so any text is a name
    each = counts.groupBy("kind", "term", "lang").agg(F.sum("n").alias("n"))
    found = F.map_from_entries(F.collect_list(F.struct("lang", "n")))
    per_term = each.groupBy("kind", "term").agg(F.sum("n").alias("total"), found.alias("of"))
    numbered = F.transform(F.array(*map(F.lit, langs)), lambda lang: F.coalesce(F.element_at("of", lang), F.lit(0)))
    terms = stage(per_term.select("kind", "term", "total", numbered.alias("counts")))
    strong = terms.where("total > 1")
    # the most frequent entries of each kind; counts are thresholds, so one count goes in whole or not at all
    per_count = strong.groupBy("kind", "total").count().collect()  # bounded: distinct counts of a bounded sample
    floors = {}
    for kind in (0, *LENGTHS):
        room, floors[kind] = top * len(langs), 2
        for r in sorted((r for r in per_count if r["kind"] == kind), key=lambda r: -r["total"]):
            room -= r["count"]
            if room < 0:
                floors[kind] = r["total"] + 1
                break
    floor = F.when(F.lit(False), 0)
    for kind, least in floors.items():
        floor = floor.when(F.col("kind") == kind, least)
    rows = strong.where(F.col("total") >= floor).drop("total").collect()
    masses: dict[int, list[int]] = {n: [0] * len(langs) for n in (0, *LENGTHS)}
    for r in terms.select("kind", F.posexplode("counts").alias("at", "n")).groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        masses[r["kind"]][r["at"]] = r["n"]
    tables: dict[int, dict[str, tuple[float, ...]]] = {n: {} for n in (0, *LENGTHS)}
    for r in rows:
        mass = masses[r["kind"]]
        tables[r["kind"]][r["term"]] = tuple(math.log((n + 0.5) / (m + 1.0)) for n, m in zip(r["counts"], mass))
    # only differences between languages matter, so the mean of each entry goes
    for entries in tables.values():
        for term, logs in entries.items():
            mean = sum(logs) / len(logs)
            entries[term] = tuple(x - mean for x in logs)
    prior = np.log(np.array([sizes[lang] for lang in langs], dtype=float) / sum(sizes.values()))
    return Model(langs, prior, tables)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which replace columns of those names."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, model.tables))

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        local = Model(*sent.value)
        for texts in batches:
            found = [local.predict(t) for t in texts]
            yield pd.DataFrame({"lang_pred": pd.Series([f[0] for f in found], dtype=object), "score": [f[1] for f in found]}, index=texts.index)

    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    told = docs.select(*others, language("text").alias("_llm_language"))
    return told.select(*others, "_llm_language.lang_pred", "_llm_language.score")


def accepted(predicted: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows that are clearly in one language."""
    return predicted.where((F.col("lang_pred") != UND) & (F.col("score") >= min_score))
