import random
import re

import pytest
from pyspark.sql import functions as F

from variform.llm import decontaminate as D

DOCS = "doc_id bigint, text string, items string, hits int"
ITEMS = "item_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for window, ids in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= ids - {"None"}
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def scanned(spark, docs, items, **more):
    df = D.scan(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()), key=str)


def random_case(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("a b C é Ä x1".split()) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    items = [(k, " ".join(rng.choice("a b C é x1".split()) for _ in range(n))) for k, n in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 0])]
    items += [(100, texts[3]), (None, texts[4]), (7, None), (101, items[5][1])]
    docs = [(k, t, "extra", 1) for k, t in enumerate(texts)] + [(3, texts[3], "extra", 1), (90, None, None, None), (91, "", "", 0), (None, texts[5], "", 0)]
    return docs, items


def test_equals_brute_force_with_short_items_nulls_and_repeats(spark):
    docs, items = random_case(1)
    assert scanned(spark, docs, items) == brute(docs, items)


def test_blocks_of_windows_give_the_same(spark):
    docs, items = random_case(2)
    docs = [d for d in docs if len((d[1] or "").split()) < 25]
    assert scanned(spark, docs, items, block=7) == brute(docs, items)


def test_long_text(spark):
    text = "lorem ipsum " * 20_000
    items = [(1, "ipsum lorem " * 6)]
    assert scanned(spark, [(1, text, "", 0)], items) == brute([(1, text)], items)


def test_empty_tables(spark):
    assert scanned(spark, [], [(1, "a")]) == []
    assert scanned(spark, [(1, "a b", "", 0)], []) == [(1, 2, 0, [])]
    assert scanned(spark, [(1, "a b", "", 0)], [(1, None), (2, "--")]) == [(1, 2, 0, [])]


def test_removal_of_documents_and_spans(spark):
    docs = spark.createDataFrame([(1, "One, two THREE four! five", "x", 1), (2, "clean -- text", "y", 2), (3, None, None, None), (2, "clean -- text", "y", 2)], DOCS)
    items = spark.createDataFrame([(5, "two three four")], ITEMS)
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 2, 3]
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, items, remove="spans").collect()}
    assert cut == {1: "One,   ! five", 2: "clean -- text", 3: None}
    with pytest.raises(ValueError, match="remove"):
        D.decontaminate(docs, items, remove="words")


def test_one_probe_joins_by_broadcast_without_python(spark):
    docs, items = random_case(3)
    df = D.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).where(F.col("contaminated"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Arrow" not in plan


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7), (2, "c", 5, 6, 7)], "doc_id bigint, text string, _llm_id int, _LLM_PRINT int, _llm_hits int")
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    assert [tuple(r) for r in D.decontaminate(docs, items).collect()] == [(2, "c", 5, 6, 7)]
    cut = D.decontaminate(docs, items, remove="spans")
    assert cut.columns == docs.columns and sorted(tuple(r) for r in cut.collect()) == [(1, " ", 5, 6, 7), (2, "c", 5, 6, 7)]


@pytest.mark.parametrize("stretch", [1, 3, 12])
def test_windows_over_the_ends_of_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(D, "STRETCH", stretch)
    for seed in (11, 12):
        docs, items = random_case(seed)
        assert scanned(spark, docs, items) == brute(docs, items)


def test_time_grows_with_the_length_of_a_text(spark):
    import time

    words = [f"w{k % 5000}" for k in range(160_000)]
    items = [(1, " ".join(words[100:112]))]
    seconds = []
    for n in (2_000, 160_000, 2_000, 160_000):
        texts = [(k, " ".join(words[k : k + n]), "x", 1) for k in range(0, len(words), n)]
        begin = time.perf_counter()
        scanned(spark, texts, items)
        seconds.append(time.perf_counter() - begin)
    assert seconds[3] < 4 * seconds[2] + 2  # one task instead of several, but no square
