"""The operators' queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variform.llm import chat, decontaminate, exact, langid, mixing, pieces, pii, prefixtrie, recount, repair, simhash, toxicity, webtext
from variform.llm.common import held_out, table


#: No source is repeated more often than this in the query's mixture.
MAX_REPEATS = 1.25
#: A public rank file; it is read where it lies and is no part of this repository.
VOCABULARY = os.environ.get("VARIFORM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: A public SentencePiece model, read on the driver.
PIECES = os.environ.get("VARIFORM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.with_probe(spark, table(spark, sf_dir, "conversations")))


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"), MAX_REPEATS)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webtext.report(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = toxicity.labelled(docs.where(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, toxicity.fit(known))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = recount.provenance_edits(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return recount.recount(docs, VOCABULARY).drop("source")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.report(table(spark, sf_dir, "conversations"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(PIECES, "rb") as model:
        return pieces.report(table(spark, sf_dir, "documents"), model.read())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_language,
        op3_chat,
        op4_exact,
        op5_pii,
        op6_mixing,
        op7_html,
        op8_simhash,
        op9_toxicity,
        op10_recount,
        op11_prefix_trie,
        op12_repair,
        op13_sentencepiece,
    )
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_chat": chat.ORACLE,
    "op4_exact": exact.ORACLE,
    "op11_prefix_trie": prefixtrie.ORACLE,
    "op12_repair": repair.ORACLE,
}
