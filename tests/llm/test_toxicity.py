import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from variform.llm import toxicity as T
from variform.llm.automaton import Lexicon, max_edits

SCHEMA = "doc_id bigint, text string, toxic int, score string, predicted string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distances():
    rng = random.Random(1)
    terms = ["idiot", "scum", "worthless", "moronic", "idle", "disgusting", "ab"]
    lexicon = Lexicon(terms)
    words = terms + ["".join(rng.choice("idotscumwrhlen") for _ in range(rng.randint(0, 11))) for _ in range(300)]
    for _ in range(1500):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            rng.choice([lambda: w.insert(k, "x"), lambda: w.pop(k % len(w)) if w else None, lambda: w.__setitem__(slice(k, k + 1), ["z"])])()
        words.append("".join(w))
    for word in words:
        want = min(((d, t) for t in terms if (d := distance(word, t)) <= max_edits(t)), default=None)
        assert lexicon.match(word) == want, word


def test_states_start_over_when_there_are_many():
    lexicon = Lexicon(["worthless", "disgusting"], states=20)
    assert [lexicon.match(w) for w in ("worthles", "disgustin", "something", "wortless")] == [(1, "worthless"), (1, "disgusting"), None, (1, "worthless")]


def rows(n=400):
    rng = random.Random(2)
    calm = [f"plain{chr(97 + k)}" for k in range(20)]
    out = []
    for k in range(n):
        words = [rng.choice(calm) for _ in range(30)]
        toxic = k % 4 == 0
        for _ in range(rng.randint(2, 4)) if toxic else ():
            words.insert(rng.randrange(30), rng.choice(["worthless", "imbecile", "vermin"]))
        if k % 80 == 5:
            words[3:3] = ["he", "said", '"worthless"']
        out.append((k, " ".join(words), int(toxic), "x", "y"))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return T.fit(spark.createDataFrame(rows(), SCHEMA))


def test_learns_terms_and_catches_misspellings(model):
    assert {"worthless", "imbecile", "vermin"} <= set(model.terms)
    plain = "plaina plainb plainc plaind " * 5
    assert model.score(plain + "imbecile vermin imbecile") > 0.5 > model.score(plain)
    assert model.score(plain + "imbecyle vermim imbecile") > model.score(plain)
    assert model.features("you imbecyle")[5] == 1.0 and model.features("plaina")[5] == 0.0


def test_quotation_counts_apart(model):
    quoted, plain = model.features('he said "imbecile" once'), model.features("you are imbecile again")
    assert quoted[1] > 0 == quoted[0] and plain[0] > 0 == plain[1]


def test_defined_cases(spark, model):
    df = spark.createDataFrame([(1, None, 0, "x", "y"), (2, "", 1, "x", "y"), (3, "vermin imbecile " * 20_000, 1, "x", "y"), (3, "vermin", None, "x", "y")], SCHEMA)
    got = T.score(df, model)
    assert got.columns == ["doc_id", "text", "toxic", "score", "predicted"]
    out = [(r["doc_id"], 0 <= r["score"] <= 1, r["predicted"] == int(r["score"] >= 0.5)) for r in got.collect()]
    assert len(out) == 4 and all(a and b for _, a, b in out)
    assert T.score(df.limit(0), model).collect() == []


def test_one_label_only(spark):
    calm = T.fit(spark.createDataFrame([(1, "a", 0, "", ""), (2, None, 1, "", ""), (3, "b", None, "", "")], SCHEMA))
    assert calm.score("a") < 1e-6
    assert T.fit(spark.createDataFrame([(1, "a", 1, "", "")], SCHEMA)).score("z") > 1 - 1e-6
    assert T.fit(spark.createDataFrame([], SCHEMA)).score(None) < 1e-6


def test_labels_of_one_id_take_the_highest(spark):
    docs = spark.createDataFrame([(1, "a", 0, "", ""), (2, "b", 0, "", "")], SCHEMA)
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1)], "doc_id bigint, toxic int")
    assert [tuple(r) for r in T.labelled(docs, labels).collect()] == [(1, "a", 1)]


def test_logistic_regression_separates():
    x = np.array([[0.0], [0.1], [0.9], [1.0]] * 20)
    w = T._logistic(x, (x[:, 0] > 0.5).astype(float), ridge=0.01)
    assert w[0] < 0 < w[1]


def test_held_out_accuracy(spark):
    from variform.llm import queries

    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = queries.op9_toxicity(spark, sf_dir)
    r = got.join(labels, "doc_id").where("held_out").agg(
        F.avg((F.col("toxic") == F.col("predicted")).cast("int")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted")))
    ).first()
    assert r[0] > 0.97 and r[1] > 0.85
    some = got.select("doc_id", "held_out").limit(50).collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in some)


def test_apostrophes_and_stray_marks_quote_nothing():
    def words(text):
        tokens, inside = T._quoted(T._TOKENS.findall(text))
        return [t for t, quoted in zip(tokens, inside) if quoted and t not in T.QUOTES]

    assert words("i don’t care you are a scumbag and can’t hide") == []
    assert words("he said “you are a scumbag” and left") == "you are a scumbag".split()
    assert words('one " stray mark. then "quoted words" and more') == ["quoted", "words"]
    assert words("she called him ‘a fool’, didn’t she") == ["a", "fool"]
    assert words("«ab» cd \"ef\n gh\" ij") == ["ab"]
