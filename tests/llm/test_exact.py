import hashlib
import random
import re

import pytest

from variform.llm import exact as X

SCHEMA = "doc_id bigint, text string, digest string, kept int"


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub("[ \t\n\x0b\x0c\r]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for content, members in groups.items():
        keep = min(members)[3]
        digest = hashlib.sha256(content.encode()).hexdigest()
        out += [(m[3], keep, len(members), m[3] == keep, digest) for m in members]
    return sorted(out, key=str)


def ours(spark, rows, **more):
    df = X.members(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **more)
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["a", "b", " ", "\t", "é", " "]) for _ in range(rng.randint(0, 4)))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (5, rows[5][1]), (None, "only"), (None, "a"), (1003, "long " * 50_000), (1004, "long" * 50_000)]
    assert ours(spark, rows) == brute(rows)


def test_full_tables_send_records_to_the_next_level(spark):
    rows = [(k, f"text {k % 70} " * 20) for k in range(210)]
    assert ours(spark, rows, table_bytes=600) == brute(rows)


def test_empty_table(spark):
    assert ours(spark, []) == []


def test_deduplicate_keeps_columns_and_first_of_ties(spark):
    docs = spark.createDataFrame([(3, "a b", "x", 1), (2, "ab ", "y", 2), (1, "ab", "z", 3), (None, "q", "w", 4)], SCHEMA)
    kept = X.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["2", "None"]


def test_table_compares_contents_and_grows():
    table = X.Table(slots=2)
    for k in range(50):
        content = b"%d" % (k % 20)
        assert table.add(hashlib.sha256(content).digest(), content, 1, k, k, 1 << 20)
    assert len(table.rows) == 20 and sum(r[0] for r in table.rows) == 50
    with pytest.raises(ValueError, match="digest"):
        table.add(hashlib.sha256(b"1").digest(), b"other", 1, 1, 1, 1 << 20)


def test_deduplicate_parts_rows_of_one_id_by_their_texts(spark):
    rows = [(1, "a"), (None, "a"), (None, "alone"), (2, "b"), (3, "b"), (3, "c"), (None, "d e"), (None, "de"), (None, "d e"), (4, "f"), (4, "f")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = [(r["doc_id"], r["text"]) for r in X.deduplicate(docs).collect()]
    want = [(1, "a"), (None, "alone"), (2, "b"), (3, "c"), (None, "d e"), (4, "f"), (4, "f")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_deduplicate_with_clashing_names(spark):
    names = "_llm_id int, _llm_print int, _llm_class int, _LLM_NTH int"
    docs = spark.createDataFrame([(1, "a", 1, 2, 3, 4), (2, "a", 1, 2, 3, 4), (None, "b", 1, 2, 3, 4), (None, "b ", 1, 2, 3, 4)], f"doc_id bigint, text string, {names}")
    kept = X.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=str) == [(1, "a"), (None, "b ")]
