import random

from pyspark.sql import functions as F

from variform.llm import langid as L

SCHEMA = "doc_id bigint, text string, lang string, source string"
WORDS = {"xx": "alpha beta gamma the of".split(), "yy": "omega psi chi der und".split()}


def corpus(n=60):
    rng = random.Random(1)
    return [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(12)), lang, "s") for k in range(n) for lang in [rng.choice(list(WORDS))]]


def test_words_then_shorter_grams(spark):
    model = L.fit(spark.createDataFrame(corpus(), SCHEMA))
    assert model.langs == ["xx", "yy"]
    assert model.predict("alpha beta")[0] == "xx" and model.predict("Omega, PSI!")[0] == "yy"
    assert "alphas" not in model.tables[0] and model.predict("alphas")[0] == "xx"  # unseen, by its n-grams
    assert model.unseen("zzzzz") == [0.0, 0.0] or model.predict("gamm")[0] == "xx"
    lang, score = model.predict("alpha " * 30_000)
    assert lang == "xx" and 0.99 < score <= 1


def test_defined_cases(spark):
    model = L.fit(spark.createDataFrame(corpus() + [(900, None, "xx", ""), (901, "noise", None, "")], SCHEMA))
    rows = [(1, None, None, None), (2, "", "", ""), (3, "123 --", "xx", "s"), (4, "alpha of", None, "s"), (4, "alpha of", None, "s")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = L.predict(df, model)
    assert got.columns == [*df.columns, "lang_pred", "score"]
    assert sorted((r["doc_id"], r["lang_pred"]) for r in got.collect()) == [(1, "und"), (2, "und"), (3, "und"), (4, "xx"), (4, "xx")]
    clash = df.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    assert L.predict(clash, model).columns == [*df.columns, "lang_pred", "score"]
    assert model.predict("² ½") == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert [r["doc_id"] for r in L.accepted(got).collect()] == [4, 4]


def test_no_labels_and_no_rows(spark):
    model = L.fit(spark.createDataFrame([(1, "text", None, "")], SCHEMA))
    assert model.predict("text") == ("und", 0.0)
    assert L.predict(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_a_full_memo_starts_over(spark, monkeypatch):
    monkeypatch.setattr(L, "MEMO", 5_000)
    model = L.fit(spark.createDataFrame(corpus(), SCHEMA))
    many = " ".join(f"{a}{b}{c}alpha" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop" for c in "abcdefghijklmnopqrstuvwxyz"[:24])
    first, again = model.predict(many), model.predict(many)
    assert first == again and first[0] == "xx" and len(model.index) <= len(model.rows)


def test_held_out_accuracy(spark):
    from variform.llm import queries

    sf_dir = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = queries.op2_language(spark, sf_dir).join(truth, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_equal_texts_of_the_sample_count_once(spark):
    rows = [(f"house river w{k % 7} stone", "en") for k in range(30)] + [(f"haus fluss v{k % 7} stein", "de") for k in range(30)]
    once = L.fit(spark.createDataFrame(sorted(set(rows)), "text string, lang string"))
    many = L.fit(spark.createDataFrame(rows + 200 * [rows[0]], "text string, lang string"))
    assert once.tables == many.tables and list(once.prior) != list(many.prior)


def test_languages_of_any_name(spark):
    names = ["en", "EN", "term", "kind", "total", "n", "a`b", "x.y", ""]
    rows = [(f"{chr(97 + k) * 5} {chr(97 + k) * 4} w{chr(97 + k)}", name) for k, name in enumerate(names) for _ in range(2)]
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == sorted(names)
    docs = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in L.predict(docs, model).collect()}
    assert [got[k] for k in range(len(rows))] == [r[1] for r in rows]
