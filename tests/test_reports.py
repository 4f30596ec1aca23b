import numpy as np
import pytest
from pyspark.sql import functions as F

from variform.functions.columns import geodesic, words
from variform.functions import kernels
from variform.operators import codes, corpus, geo, groups, reports, sets


@pytest.mark.parametrize("range_rows,ranges", [(65_536, 256), (100, 8), (3, 4)])
def test_quartiles_are_exact_for_skewed_groups(spark, monkeypatch, range_rows, ranges):
    monkeypatch.setattr(reports, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(reports, "RANGES", ranges)
    rng = np.random.default_rng(3)
    values = {"hot": np.round(rng.lognormal(size=3000), 2), "one": np.array([4.0]), "flat": np.full(50, 2.5), "two": np.array([-1.0, 1e6])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("hot", None)]
    found = reports.distribution_summary(spark.createDataFrame(rows, "g string, score double"), "g").collect()
    assert {r["g"] for r in found} == set(values)
    for r in found:
        expected = np.quantile(values[r["g"]], reports.QUARTILES)
        assert [r[c] for c in ("q0", "q25", "q50", "q75", "q100")] == pytest.approx(list(expected), rel=1e-12)
        assert r["n"] == len(values[r["g"]])


def test_relabel_slice_explode(spark):
    rows = [("maxsum", 0, 4, "a,b"), ("random", 0, 4, "c"), ("random", 1, 4, "d"), ("odd", 1, 8, "e")]
    results = spark.createDataFrame(rows, "method string, run int, k int, sample string")
    labels = {r["Method"] for r in reports.relabel(results).collect()}
    assert labels == {"MaxSum", "Random*", None}
    kept = reports.slice_results(results, ks=[4], methods=["maxsum"], run=0)
    assert [r["id"] for r in reports.explode_sample(kept).orderBy("id").collect()] == ["a", "b", "c"]
    assert reports.slice_results(results).count() == 4


def test_group_overlap_equals_the_mean_over_pairs(spark):
    rows = [("a", "g", "1", "?"), ("b", "g", "1", "?"), ("c", "g", "2", "0"), ("d", "alone", "1", "1"), ("e", None, "1", "1")]
    items = spark.createDataFrame(rows, "id string, fam string, f string, h string")
    found = {r["group"]: r for r in groups.group_feature_overlap(items, ["f", "h"], "fam", "family").collect()}
    assert set(found) == {"g", "alone"}
    assert found["g"]["avg_overlap"] == pytest.approx((1 + 0 + 0) / 3) and found["g"]["n_members"] == 3
    assert found["alone"]["avg_overlap"] == 0.0
    histogram = reports.overlap_histogram(groups.group_feature_overlap(items, ["f", "h"], "fam", "family"), 0.1)
    assert [tuple(r) for r in histogram.collect()] == [("family", 3, 1)]


def test_top_groups_are_first_by_name_then_sorted(spark):
    rows = [("family", c, v, 2) for c, v in (("c", 0.9), ("a", 0.2), ("b", 0.5), ("d", 0.8), ("z", 0.0))] + [("genus", "a", 1.0, 2)]
    table = spark.createDataFrame(rows, "method string, `group` string, avg_overlap double, n_members int")
    assert [r["group"] for r in reports.top_groups(table, "family", 3).collect()] == ["c", "b", "a"]


def test_sets(spark):
    a, b, c = (spark.createDataFrame([(i,) for i in s], "id string") for s in ("abcd", "bcd", "cdex"))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(sets.intersect(a, b, c)) == ["c", "d"]
    assert ids(sets.difference(a, b)) == ["a"]
    assert ids(sets.union(a, c)) == list("abcdex")
    assert sets.union_tagged("t", x=a, y=c).groupBy("t").count().count() == 2
    assert tuple(sets.dataset_coverage(a.union(a), c).first()) == (4, 2)
    with pytest.raises(ValueError, match="duplicate"):
        sets.assert_unique(a.union(b))
    assert sets.assert_unique(a) is a


def test_codes_first_or_last(spark):
    taxonomy = spark.createDataFrame(
        [("x1", "X", "xxx", 0), ("x2", "X2", "xxx", 1), ("y1", "Y", "yyy", 2), ("n", "N", None, 3)], "id string, name string, iso string, row int"
    )
    rows = spark.createDataFrame([("xxx",), ("zzz",), (None,)], "iso string")
    for keep, target in (("first", "x1"), ("last", "x2")):
        mapping = codes.dedupe_codes(taxonomy, "iso", "id", "row", keep)
        mapped = {r["iso"]: r["target"] for r in codes.map_codes(rows, "iso", mapping).collect()}
        assert mapped == {"xxx": target, "zzz": None, None: None}
        assert [tuple(r) for r in codes.unmapped_codes(rows, "iso", mapping).collect()] == [("zzz", 1)]
    assert codes.names(spark.createDataFrame([("y1",)], "id string"), taxonomy).first()["name"] == "Y"


def test_corpus_selection(spark):
    rows = [
        ("eng", "e1", "1", "a", 0), ("eng", "e1", "2", "b", 1), ("eng", "e1", "2", "c", 2), ("eng", "e2", "1", "d", 0), ("eng", "e2", "3", "e", 1),
        ("deu", "d1", "1", "f", 0), ("deu", "d1", "2", "g", 1), ("rus", "r1", "3", "h", 0),
    ]
    verses = spark.createDataFrame(rows, "lang string, edition string, verse_id string, text string, line int")
    best = {r["lang"]: (r["edition"], r["n_verses"]) for r in corpus.largest_edition(verses).collect()}
    assert best == {"eng": ("e1", 2), "deu": ("d1", 2), "rus": ("r1", 1)}
    chosen = corpus.chosen_editions(verses, corpus.largest_edition(verses))
    common = corpus.most_common_units(chosen, 2)
    assert [(r["verse_id"], r["n_editions"]) for r in common.collect()] == [("1", 2), ("2", 2)]
    covering = corpus.fully_covering(chosen, common)
    assert sorted(r["lang"] for r in covering.collect()) == ["deu", "eng"]
    texts = {(r["lang"], r["verse_id"]): r["text"] for r in corpus.selected_units(chosen, common, covering).collect()}
    assert texts == {("eng", "1"): "a", ("eng", "2"): "c", ("deu", "1"): "f", ("deu", "2"): "g"}


def test_token_cost_with_words_and_with_a_tokenizer(spark):
    texts = spark.createDataFrame([("en", "a bb  ccc\n"), ("en", " \t "), ("en", "x"), ("de", "")], "lang string, text string")
    found = [tuple(r) for r in corpus.avg_tokens(texts, "lang").collect()]
    assert found == [("en", 2.0, 2)]

    def load():
        return lambda batch: [["[CLS]", *text.replace(" ", ""), "[SEP]"] if text.strip() else [] for text in batch]

    counted = corpus.avg_tokens(texts, "lang", corpus.token_counter(load)("text")).collect()
    assert [tuple(r) for r in counted] == [("en", (7 + 1) / 2, 2)]
    assert texts.select(words("text").alias("n")).agg(F.sum("n")).first()[0] == 4
    lines = corpus.text_lines(spark.createDataFrame([("one \ntwo\r\n",)], "text string")).orderBy("line").collect()
    assert [r["text"] for r in lines] == ["one", "two", ""]


def test_geodesic_column_equals_the_block_kernel(spark):
    points = [(0.0, 0.0), (41.5, -71.3), (-33.9, 151.2), (None, 5.0), (0.0, 180.0), (89.9, 10.0)]
    items = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, latitude double, longitude double")
    pairs = spark.createDataFrame([(a, b) for a in range(6) for b in range(6)], "a int, b int")
    x = np.array([[np.nan if v is None else v for v in p] for p in points])
    expected = kernels.geodesic_block(x, x)
    for r in geo.pair_kilometres(pairs, items).collect():
        assert r["d"] == pytest.approx(expected[r["a"], r["b"]], abs=1e-6)
    null = spark.range(1).select(geodesic(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("d")).first()
    assert null["d"] is None
    for r in geo.geo_distances(items).collect():
        assert r["d"] == pytest.approx(expected[r["a"], r["b"]], abs=1e-6)
