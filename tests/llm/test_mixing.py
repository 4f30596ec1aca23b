import math
import random
from collections import Counter

import pytest

from variform.llm import mixing as M

SCHEMA = "doc_id bigint, text string, source string, epoch int, mix_at string"


def corpus():
    rng = random.Random(1)
    sizes = {"big": 400, "mid": 120, "small": 40, None: 25}
    return [(i, " ".join(["w"] * rng.randint(0, 30)), s, 5, "x") for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]


def draws(spark, rows, **more):
    return M.mix(spark.createDataFrame(rows, SCHEMA), block=10, **more).collect()


def check(rows, got, exponent, budget):
    tokens = {r[0]: len((r[1] or "").split()) for r in rows}
    total = Counter()
    for r in rows:
        total[r[2]] += tokens[r[0]]
    names = [s for s, n in total.items() if n]
    shares = dict(zip(names, M.weights([total[s] for s in names], exponent)))
    longest = max(tokens.values())
    for s in names:
        mine = [r for r in got if r["source"] == s]
        want, taken = round(shares[s] * budget), sum(tokens[r["doc_id"]] for r in mine)
        assert want <= taken < want + longest
        times = Counter(r["doc_id"] for r in mine)
        whole = want // total[s]
        own = [r[0] for r in rows if r[2] == s]
        assert all(times[i] in (whole, whole + 1) for i in own)  # no document is left behind or drawn too often
        assert len({(r["doc_id"], r["epoch"]) for r in mine}) == len(mine)


def test_repetition_limit(spark):
    rows = corpus()
    budget = sum(len(r[1].split()) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(r[1].split())
    exponent = M.find_exponent(list(sizes.values()), budget, max_repeats=2.5)
    assert 0 < exponent < 1
    at = M.weights(list(sizes.values()), exponent)
    assert max(w * budget / n for w, n in zip(at, sizes.values())) == pytest.approx(2.5)
    check(rows, draws(spark, rows, max_repeats=2.5), exponent, budget)


def test_target_entropy_and_budget(spark):
    rows = corpus()
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(r[1].split())
    goal = 0.9 * math.log(4)
    exponent = M.find_exponent(list(sizes.values()), 3_000, target_entropy=goal)
    assert M.entropy(M.weights(list(sizes.values()), exponent)) == pytest.approx(goal)
    check(rows, draws(spark, rows, target_entropy=goal, budget=3_000), exponent, 3_000)


def test_order_and_seed(spark):
    rows = corpus()
    one, two, other = (draws(spark, rows, max_repeats=2.0, seed=s) for s in (1, 1, 2))
    key = lambda got: sorted((r["mix_at"], r["mix_tie"], r["doc_id"]) for r in got)
    assert key(one) == key(two) != key(other)
    assert all(0 <= r["mix_at"] < 1 for r in one)


def test_extremes():
    assert M.find_exponent([], 10, max_repeats=2) == 1.0
    assert M.find_exponent([5, 5], 10, target_entropy=9.0) == 0.0
    assert M.find_exponent([90, 10], 1_000, max_repeats=2) == 1.0
    assert M.find_exponent([90, 10], 100, max_repeats=50) == 0.0
    assert M.weights([0, 4], 0.0) == [0.0, 1.0]
    with pytest.raises(ValueError, match="either"):
        M.find_exponent([1], 1)


def test_nulls_empties_and_columns(spark):
    rows = [(1, None, "a", 1, "x"), (2, "", None, 1, "x"), (None, "w w", "a", 1, "x"), (3, "w " * 30_000, "b", 1, "x"), (3, "w " * 30_000, "b", 1, "x")]
    df = M.mix(spark.createDataFrame(rows, SCHEMA), target_entropy=0.0)
    assert df.columns == ["doc_id", "text", "source", "epoch", "mix_at", "mix_tie"]
    got = Counter((r["doc_id"], r["source"]) for r in df.collect())
    assert got[3, "b"] == 2 and got[None, "a"] == 1 and (2, None) not in got
    assert M.mix(spark.createDataFrame([], SCHEMA), max_repeats=2).collect() == []


def test_rows_without_ids_go_by_their_texts(spark):
    rows = [(None, f"w{k} " * 4, "a", 5, "x") for k in range(400)] + [(k, "w w w w", "b", 5, "x") for k in range(100)]
    got = [r for r in draws(spark, rows, budget=1000, max_repeats=5.0) if r["source"] == "a"]
    taken = sum(len(r["text"].split()) for r in got)
    assert taken < 1600 and len({r["text"] for r in got}) == len(got) > 100  # less than one document beyond the budget


def test_working_names_in_the_input(spark):
    rows = [(k, "w w", "a", 7, "b7", 8) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _mix_key int, _MIX_block string, _mix_cut int")
    got = M.mix(docs, max_repeats=1.0)
    assert got.columns == [*docs.columns, "epoch", "mix_at", "mix_tie"]
    assert sorted(tuple(r)[:6] for r in got.collect()) == rows
