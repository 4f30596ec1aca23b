import hashlib
import os
import random

import numpy as np
import pytest
import sentencepiece

from variform.llm import pieces as P
from variform.llm.queries import PIECES, op13_sentencepiece

pytestmark = pytest.mark.skipif(not os.path.exists(PIECES), reason="no model file")
PARTS = ["a", "b", " ", "  ", "\n", "▁", "é", "e\u0301", "ﬁ", "\u3000", "中", "x1", "the", " and", "\t", "😀", "\0", "<s>", "</s>", "\u200b", "   ", ".", "\u2047"]


@pytest.fixture(scope="module")
def model():
    with open(PIECES, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def texts(rng, n, longest=25):
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_chunks_give_the_ids_of_the_whole_text(model, library):
    sp = P.load(model)
    for text in texts(random.Random(1), 5000):
        assert "".join(P.chunks_of(text)) == (P.marked(text) if text else "")
        found = P.segment(sp, P.chunks_of(text)) if text else []
        assert sum(found, []) == library.encode(text)
        assert " ".join(library.decode(found) if found else []) == library.decode(library.encode(text))


def test_chunks_of_any_ids_decode_like_the_whole(model, library):
    cut, rng = P._id_chunks(P.load(model)), random.Random(2)
    pool = [0, 1, 2, 3 + 0xC3, 3 + 0xA9, 68, 264, 28705, 259, 2287, 28726, 523, 28747, 29351]
    for _ in range(5000):
        ids = [rng.choice(pool) for _ in range(rng.randint(0, 8))]
        parts = [np.frombuffer(c, "<i4").tolist() for c in cut(ids)]
        assert sum(parts, []) == ids and " ".join(library.decode(parts) if parts else []) == library.decode(ids)


def test_table(spark, model, library):
    rng = random.Random(3)
    given = [*texts(rng, 300), "", None, None, "word " * 60_000, "x" * 50_000, " " * 70, *texts(rng, 3, 4000)]
    rows = [(None if k % 50 == 7 else k // 2, t, "x", 1) for k, t in enumerate(given)]  # lacking and repeated ids
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, block int").repartition(3)
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, *_ in rows), key=str)
    for run_chars in (200, P.RUN_CHARS):  # many runs and few
        encoded = P.encode(docs, model, run_chars)
        assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in encoded.collect()), key=str) == want
        back = P.decode(encoded, model, run_chars)
        assert sorted(((r["doc_id"], r["decoded"]) for r in back.collect()), key=str) == sorted(((i, d) for i, _, d in want), key=str)


def test_each_chunk_is_converted_once_until_the_table_starts_over(library, monkeypatch):
    asked = []

    def convert(chunks):
        asked.extend(chunks)
        return [P.pa.array(P.segment(library, chunks), P._IDS)]

    table = P.Table(convert, [P._IDS])
    for text in ("a b a", "b c", "a b c"):
        codes = [table.code(P.chunks_of(text))]
        assert P._joined_ids(table.settle()[0], codes).to_pylist() == [library.encode(text)]
    assert asked == ["▁a", "▁b", "▁c"] and not table.full()
    monkeypatch.setattr(P, "TABLE_CHUNKS", 3)
    assert table.full()


def test_many_chunks(spark, model, library, monkeypatch):
    text = " ".join(f"w{k:x}" for k in range(70_000))
    monkeypatch.setattr(P, "TABLE_CHARS", 1000)
    rows = P.encode(spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string").coalesce(1), model, 10).collect()
    assert [(r["ids"], r["decoded"]) for r in rows] == [(library.encode(text), text)] * 2


def test_empty_table_and_nulls(spark, model):
    assert P.encode(spark.createDataFrame([], "doc_id bigint, text string"), model).collect() == []
    rows = spark.createDataFrame([(1, None), (2, [None, 264]), (3, [])], "doc_id bigint, ids array<int>")
    assert sorted(map(tuple, P.decode(rows, model).collect())) == [(1, ""), (2, "a"), (3, "")]


def test_query_equals_the_library(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r["text"] or "")
        want[r["doc_id"]] = (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))))
    got = op13_sentencepiece(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)
