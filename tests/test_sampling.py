import pytest
from pyspark.sql import functions as F

from variform.operators import ranks, sampling
from variform.operators.sampling import Draw


@pytest.fixture(scope="module")
def families(spark):
    """100 items in 35 families of uneven size, 6 of them in none."""
    rows = [(f"id{i:03d}", None if i >= 94 else f"family {i % 35 if i < 60 else 0}") for i in range(100)]
    return spark.createDataFrame(rows, "id string, `group` string").repartition(4).cache()


@pytest.fixture(scope="module")
def genera(spark):
    """58 items in 46 genera."""
    return spark.createDataFrame([(f"id{i:03d}", f"genus {i % 46}") for i in range(58)], "id string, `group` string").cache()


def drawn(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["run"], r["k"]), []).append(r["id"])
    return out


@pytest.mark.parametrize("table,ks", [("families", [1, 34, 35, 36, 80, 100]), ("genera", [34, 46, 55, 58])])
def test_stratified_sizes(request, table, ks):
    items = request.getfixturevalue(table)
    known = {r["id"]: r["group"] for r in items.collect()}
    groups = {g for g in known.values() if g}
    draws = [Draw(run, k, 1000 * run + k) for k in ks for run in range(3)]
    found = drawn(sampling.stratified_draws(items, "group", draws))
    assert set(found) == {(d.run, d.k) for d in draws}
    n_groups = len(groups) + any(g is None for g in known.values())
    for (_, k), ids in found.items():
        assert len(ids) == len(set(ids)) == k and set(ids) <= set(known)
        per_group = {g: sum(known[i] == g for i in ids) for g in groups}
        if k <= len(groups):
            assert max(per_group.values()) == 1 and all(known[i] for i in ids)
        else:
            sizes = {g: sum(v == g for v in known.values()) for g in groups}
            assert all(per_group[g] >= min(sizes[g], k // n_groups) for g in groups)


def test_groups_are_chosen_evenly(spark):
    """A group of a thousand items is drawn no more often than a group of one."""
    rows = [(i, "large") for i in range(1000)] + [(1000 + i, f"small {i}") for i in range(9)]
    items = spark.createDataFrame(rows, "id int, `group` string")
    draws = [Draw(run, 3, run) for run in range(200)]
    found = drawn(sampling.stratified_draws(items, "group", draws))
    share = sum(any(i < 1000 for i in ids) for ids in found.values()) / len(draws)
    assert 0.15 < share < 0.45


def test_filling_is_even_over_what_is_left(spark):
    rows = [(i, "large") for i in range(300)] + [(300, None)]
    items = spark.createDataFrame(rows, "id int, `group` string")
    draws = [Draw(run, 150, run) for run in range(60)]
    found = drawn(sampling.stratified_draws(items, "group", draws))
    share = sum(300 in ids for ids in found.values()) / len(draws)
    assert 0.15 < share < 0.55


def test_random_draws_follow_the_seed_only(families):
    draws = [Draw(0, 10, 5), Draw(1, 10, 6), Draw(2, 20, 5)]
    found = drawn(sampling.random_draws(families, draws))
    again = drawn(sampling.random_draws(families.repartition(7).orderBy(F.desc("id")), draws))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in again.items()}
    assert sorted(found[0, 10]) != sorted(found[1, 10])
    assert set(found[0, 10]) < set(found[2, 20])


@pytest.mark.parametrize("rows", [4096, 3, 0.01])  # whole keys ranked, one level of ranges, three levels
def test_lowest_keys_by_counted_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(ranks, "RANGE_ROWS", rows)
    keyed = spark.range(3000).withColumns({"g": F.col("id") % 7, "s": F.lit(1)})
    keyed = keyed.withColumn("h", F.md5(F.concat_ws("|", "s", F.col("id").cast("string")))).withColumn("need", F.col("g") * 100)
    found = {}
    for r in ranks.lowest(keyed.drop("s"), ["g"], 700).collect():
        found.setdefault(r["g"], set()).add(r["id"])
    want = {}
    for r in sorted(keyed.collect(), key=lambda r: (r["h"], r["id"])):
        own = want.setdefault(r["g"], set())
        if len(own) < r["need"]:
            own.add(r["id"])
    assert found == {g: ids for g, ids in want.items() if ids}


@pytest.mark.parametrize("rows", [1, 0.05])
def test_draws_are_the_same_by_any_number_of_ranges(spark, families, monkeypatch, rows):
    draws = [Draw(run, k, run + k) for k in (3, 35, 60, 90) for run in range(2)]
    counts = families.select("id", (F.crc32("id") % 4).alias("n"))
    makers = (
        lambda: sampling.random_draws(families, draws),
        lambda: sampling.stratified_draws(families, "group", draws),
        lambda: sampling.convenience_draws(families, counts, draws),
    )
    plain = [{k: sorted(v) for k, v in drawn(make()).items()} for make in makers]
    monkeypatch.setattr(ranks, "RANGE_ROWS", rows)
    assert plain == [{k: sorted(v) for k, v in drawn(make()).items()} for make in makers]


def test_convenience_takes_most_used_first_and_shuffles_ties(spark, families):
    counts = spark.createDataFrame([(f"id{i:03d}", 5 if i < 3 else 1) for i in range(90)] + [("elsewhere", 99)], "id string, n int")
    draws = [Draw(0, 40, 1), Draw(1, 40, 2)]
    found = drawn(sampling.convenience_draws(families, counts, draws))
    for ids in found.values():
        assert len(ids) == 40 and {"id000", "id001", "id002"} <= set(ids) and "elsewhere" not in ids
    assert sorted(found[0, 40]) != sorted(found[1, 40])


@pytest.mark.parametrize("k", [0, 101])
def test_invalid_sizes(spark, families, k):
    counts = families.select("id", F.lit(1).alias("n"))
    for make in (
        lambda d: sampling.random_draws(families, d),
        lambda d: sampling.stratified_draws(families, "group", d),
        lambda d: sampling.convenience_draws(families, counts, d),
    ):
        with pytest.raises(ValueError, match="Invalid value"):
            make([Draw(0, k, 1)])


def test_seed_of_a_run():
    assert sampling.draws_for([4, 8], 2) == [Draw(0, 4, 4), Draw(1, 4, 5), Draw(0, 8, 8), Draw(1, 8, 9)]


def test_large_limits_cut_hot_keys_in_salted_parts(spark):
    rows = spark.range(500).withColumn("key", F.col("id") % 2)
    plain = sorted(map(tuple, ranks.first_per_key(rows, ["key"], [F.col("id")], 80).collect()))
    spark.conf.set(ranks.GROUP_LIMIT, "1")
    try:
        assert sorted(map(tuple, ranks.first_per_key(rows, ["key"], [F.col("id")], 80).collect())) == plain
    finally:
        spark.conf.unset(ranks.GROUP_LIMIT)


def test_rank_filter_reaches_below_the_shuffle(spark):
    rows = spark.range(100).withColumn("key", F.col("id") % 3)
    plan = ranks.first_per_key(rows, ["key"], [F.col("id")], 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_rows_of_draws_are_never_broadcast(spark, monkeypatch):
    """Only the cuts of the draws may go to every task, or nothing where there are too many."""
    monkeypatch.setattr(ranks, "RANGE_ROWS", 0.05)
    items = spark.range(400).select("id", F.concat(F.lit("g"), (F.col("id") % 5).cast("string")).alias("group"))
    draws = [Draw(run, k, run + k) for k in (3, 35) for run in range(2)]
    makers = (lambda: sampling.random_draws(items, draws), lambda: sampling.stratified_draws(items, "group", draws))
    plain = [{k: sorted(v) for k, v in drawn(make()).items()} for make in makers]
    plan = makers[0]()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan
    monkeypatch.setattr(ranks, "FEW_KEYS", 0)
    assert "BroadcastHashJoin" not in makers[0]()._jdf.queryExecution().executedPlan().toString()
    assert plain == [{k: sorted(v) for k, v in drawn(make()).items()} for make in makers]
