import random
from collections import Counter

import pytest

import corpus_pipeline as P
from test_decontaminate import brute as leaks
from test_exact import brute as copies
from test_mixing import check as check_mix
from test_simhash import classes, slow_fingerprint
from variform.llm import mixing

VOCABULARY = {"en": "the of and house river stone walk green", "de": "der die und haus fluss stein gehen gruen"}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents():
    rng = random.Random(4)
    stems = {lang: [f"{a}{b}" for a in words.split() for b in words.split()] + 6 * words.split() for lang, words in VOCABULARY.items()}
    rows = []

    def add(text, lang, source="web"):
        rows.append((len(rows), text, lang, source, None if text is None else len(text)))

    for k in range(80):
        lang = "en" if k % 3 else "de"
        add(" ".join(rng.choice(stems[lang]) for _ in range(rng.randint(150, 300))), lang, rng.choice(["web", "web", "books", "wiki", None]))
    for k in (3, 4, 5):
        add(rows[k][1].replace(" ", "\n "), "en")  # exact copies but for white space
    for k in (10, 11, 12, 13):
        for at in range(10, 150, 7):  # some of them move two bits at most
            words = rows[k][1].split()
            words[at] = "changed"
            add(" ".join(words), "en")
    passage = " ".join(f"question{c}" for c in "abcdefghijkl")
    add(rows[20][1] + " " + passage.upper() + " " + rows[21][1][:300], "en")
    for text in (None, "", "12 34 56 --"):
        add(text, "en")
    return rows, [(1, passage), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = documents()
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_stages_do_what_their_brute_force_versions_do(spark, folder):
    path, rows, items = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {r[0]: r for r in rows}
    for name, build in P.STAGES:
        out = P.stage(build(spark, docs, path))
        got = out.collect()
        if name == "language":
            want = {i for i, r in kept.items() if any(c.isalpha() for c in r[1] or "")}
        elif name == "exact":
            want = {i for i, _, _, stays, _ in copies([(i, r[1]) for i, r in kept.items()]) if stays}
            assert len(kept) - len(want) == 3
        elif name == "near":
            label = classes([slow_fingerprint(r[1]) for r in kept.values()])
            first = {}
            for i in sorted(kept):
                first.setdefault(label[slow_fingerprint(kept[i][1])], i)
            want = set(first.values())
            assert len(want) < len(kept)  # changed copies go
        elif name == "leaks":
            want = {i for i, _, hit, _ in leaks([(i, r[1]) for i, r in kept.items()], items) if not hit}
            assert len(kept) - len(want) == 1
        if name == "mix":
            sizes = Counter()
            for r in kept.values():
                sizes[r[3]] += len(r[1].split())
            budget = sum(sizes.values())
            exponent = mixing.find_exponent(list(sizes.values()), budget, max_repeats=P.MAX_REPEATS)
            check_mix([(i, r[1], r[3]) for i, r in kept.items()], got, exponent, budget)
        else:
            assert out.columns == docs.columns
            assert {r["doc_id"] for r in got} == want and len(got) == len(want), name
            kept = {i: kept[i] for i in want}
        docs = out


def test_run_applies_the_stages(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, build in P.STAGES:
        docs = P.stage(build(spark, docs, path))
    key = lambda df: sorted((r["doc_id"], r["epoch"], r["mix_tie"]) for r in df.collect())
    assert key(P.run(spark, path)) == key(docs)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
