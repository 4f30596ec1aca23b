import os
import random

import pytest
from pyspark.sql import functions as F

from variform.llm import recount as R
from variform.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
SCHEMA = f"doc_id bigint, text string, edits {R.EDITS}, n_edits string, source string"
PIECES = ["a", "b", " ", "  ", "\n", "'", "'l", "'ll", "1", "é", ".", "!?", "the", " and", "\t", "xxxxx", "²"]


@pytest.fixture(scope="module")
def counter():
    return R.Counter(VOCABULARY)


def full(counter, text):
    return len(counter.encoding.encode_ordinary(text))


def test_edits_equal_counting_anew(counter):
    rng = random.Random(1)
    for _ in range(1500):
        doc = R.Document("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 150))), counter)
        assert doc.total == full(counter, doc.text)
        for _ in range(rng.randint(1, 5)):
            start = rng.randint(-1, len(doc.text) + 2)
            doc.edit(start, start + rng.randint(-1, 12), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6))))
            assert doc.total == full(counter, doc.text)
            assert sum(map(sum, doc.lengths)) == len(doc.text)


def test_only_the_neighbourhood_is_read_again(counter):
    doc = R.Document("some words in a row " * 5_000, counter)
    doc.edit(50_000, 50_004, "changed")
    assert doc.reread < 60 and doc.total == full(counter, doc.text)


def test_table(spark, counter):
    rows = [
        (1, "mail a@b.c now", [(5, 10, "[X]"), (0, 0, "head\n")], "x", "s"),
        (1, "mail a@b.c now", [(5, 10, "[X]"), (0, 0, "head\n")], "x", "s"),
        (2, None, None, None, None),
        (3, "", [(0, 0, "new"), None, (1, 99, None)], "x", "s"),
        (4, "long text " * 20_000, [], "x", "s"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = R.recount(df, VOCABULARY, keep=True)
    assert got.columns == ["doc_id", "source", "tokens_before", "tokens_after", "n_edits", "reread_chars", "edited", "leaves"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["edited"] == "head\nmail [X] now" and by[2]["edited"] is None and by[3]["edited"] == "n"
    for r in by.values():
        assert r["tokens_after"] == full(counter, r["edited"] or "") == sum(x["tokens"] for x in r["leaves"])
    assert by[2]["tokens_before"] == 0 and got.count() == 5
    assert R.recount(df.limit(0), VOCABULARY).collect() == []


def test_provenance_edits(spark, counter):
    text = "write to a.b@c.de or x@y.z. End"
    df = spark.createDataFrame([(1, text, "web"), (2, None, None)], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in R.recount(R.provenance_edits(df), VOCABULARY, keep=True).collect()}
    assert got[1]["edited"] == "source: web\nwrite to [EMAIL] or [EMAIL]. End"
    assert got[1]["n_edits"] == 3 and got[1]["tokens_after"] == full(counter, got[1]["edited"])
    assert got[2]["tokens_after"] == full(counter, "source: unknown\n")


def test_query_equals_counting_anew(spark, counter):
    from variform.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    docs = R.provenance_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    edited = {r["doc_id"]: r["edited"] for r in R.recount(docs, VOCABULARY, keep=True).collect()}
    for r in queries.op10_recount(spark, sf_dir).select("doc_id", "tokens_after", F.col("n_edits")).collect():
        assert r["tokens_after"] == full(counter, edited[r["doc_id"]]) and r["n_edits"] >= 1
