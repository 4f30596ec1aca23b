import json

import pytest
from pyspark.sql import functions as F

from data import EXAMPLE_RESULTS, distance_matrix, example, items_table, random_vectors
from variform.operators import distance, diverse
from variform.operators.corpus import token_counter
from variform.plans import sweep, workflows
from variform.plans.methods import Inputs
from variform.sources import readers, writers


def test_from_raw_file_to_samples_on_disk(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    rows = [",".join(["Lang_ID", *[f"f{i}" for i in range(1, 6)]])]
    rows += [",".join([i, *["?" if v is None else str(int(v)) for v in x]]) for i, x in example().items()]
    raw.write_text("\n".join(rows) + "\n")
    vectors = workflows.prepare(spark, str(raw), str(tmp_path / "out"))
    assert {r["id"]: r["x"] for r in vectors.collect()} == example()
    back = readers.read_features(spark, str(tmp_path / "out" / "features"))
    assert back.count() == 20
    dist = spark.read.parquet(str(tmp_path / "out" / "distances"))
    held = spark.read.parquet(str(tmp_path / "out" / "members"))
    assert held.count() == 20 and dist.agg(F.max("d")).first()[0] == pytest.approx(1.0)
    inputs = Inputs(vectors, counts=vectors.select("id", F.lit(1).alias("n")))
    paths = workflows.draw_to_files(inputs, ["maxsum", "maxmin", "nothing", "random", "convenience"], 5, 123, str(tmp_path))
    assert set(paths) == {"maxsum", "maxmin", "random", "convenience"}
    for method in ("maxsum", "maxmin"):
        ids = [r["id"] for r in readers.read_frame(spark, paths[method]).orderBy("pos").collect()]
        assert ",".join(ids) == next(r[-1] for r in EXAMPLE_RESULTS if r[0] == method)


def test_doubled_ids_are_an_error(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text("Lang_ID,f1\naaaa1234,1\nbbbb1234,0\naaaa1234,1\n")
    with pytest.raises(ValueError, match="aaaa1234"):
        workflows.prepare(spark, str(raw), str(tmp_path / "out"))
    items = spark.createDataFrame([("a", [1.0]), ("b", [0.0]), ("c", [2.0])], "id string, x array<double>")
    twice = spark.createDataFrame([("a", 0), ("b", 1), ("b", 2)], "id string, pos int")
    for inputs in (Inputs(items.union(items)), Inputs(items, twice)):
        with pytest.raises(ValueError, match="duplicate ids"):
            sweep.sweep_samples(inputs, [2], 1, ["random"])


def test_square_file_of_a_small_frame(spark, tmp_path):
    vectors = example()
    ids, expected = list(vectors), distance_matrix(example())
    relation = distance.normalize(distance.item_relation(items_table(spark, vectors)))
    writers.write_wide_distances(relation, sorted(ids), str(tmp_path / "wide"))
    back = readers.read_distances(spark, str(tmp_path / "wide")).collect()
    assert len(back) == 400
    for r in back:
        assert r["d"] == pytest.approx(expected[ids.index(r["a"]), ids.index(r["b"])] / expected.max(), abs=1e-12)
    frame = spark.createDataFrame([(i, p) for p, i in enumerate(ids)], "id string, pos int")
    loaded = readers.read_distances(spark, str(tmp_path / "wide"))
    for method in ("maxsum", "maxmin"):
        picks = [r["id"] for r in diverse.sample_from_distances(loaded, 5, method, frame).collect()]
        assert ",".join(sorted(picks)) == next(r[-1] for r in EXAMPLE_RESULTS if r[0] == method)


def test_dataset_expansion(spark):
    vectors = random_vectors(40, 6, 3, 0.1, 21)
    items = items_table(spark, vectors)
    dataset = spark.createDataFrame([(i,) for i in (1, 2, 3, 999)], "id bigint")
    taxonomy = spark.createDataFrame([(i, f"name {i}") for i in range(40)], "id bigint, name string")
    added, scores = workflows.expand_dataset(items, dataset, 2, taxonomy)
    rows = added.collect()
    assert len(rows) == 2 and all(r["name"] == f"name {r['id']}" for r in rows)
    by = {r["method"]: r for r in scores.collect()}
    assert by["after"]["mpd"] > by["before"]["mpd"]
    only = spark.createDataFrame([(7,), (8,), (2,)], "id bigint")
    assert {r["id"] for r in workflows.expand_dataset(items, dataset, 2, candidates=only)[0].collect()} == {7, 8}


def test_parallel_text_and_its_cost(spark, tmp_path):
    head = "\n".join(["# name", "# eng", "# Latn"] + ["#"] * 8)
    for lang, verses in (("eng", 6), ("deu", 6), ("rus", 2)):
        body = "\n".join(f"{v} word{v} and more" for v in range(verses))
        (tmp_path / f"{lang}-a.txt").write_text(f"{head}\n{body}\n")
    (tmp_path / "eng-b.txt").write_text(f"{head}\n0 only one\n")
    verses = readers.read_parallel_corpus(spark, str(tmp_path))
    text = workflows.select_parallel_text(verses, 5, 3).collect()
    assert {r["lang"] for r in text} == {"eng", "deu"} and len(text) == 6
    assert all(r["text"] == f"word{r['verse_id']} and more" for r in text)
    units = tmp_path / "units"
    units.mkdir()
    (units / "eng.txt").write_text("one two\n\nthree\n")
    (units / "zzz.txt").write_text("lost\n")
    taxonomy = spark.createDataFrame([("stan1293", "eng"), ("zz", None)], "id string, iso639P3code string")
    costs = workflows.token_costs(readers.read_text_units(spark, str(units)), taxonomy)
    assert [(r["avg_subwords"], r["glottocode"]) for r in costs.collect()] == [(1.5, "stan1293")]
    counter = token_counter(lambda: lambda batch: [list(t) for t in batch])
    costs = workflows.token_costs(readers.read_text_units(spark, str(units)), taxonomy, counter)
    assert costs.first()["avg_subwords"] == 6.0


def test_sweep_over_all_methods(spark):
    vectors = random_vectors(60, 5, 3, 0.2, 30)
    items = items_table(spark, vectors)
    groups = items.select("id", (F.col("id") % 7).cast("string").alias("group"))
    counts = items.select("id", (F.col("id") % 4).alias("n"))
    for copies in (False, True):
        inputs = Inputs(items, families=groups, genera=groups, counts=counts, copies=copies)
        rows = sweep.sweep(inputs, sweep.sizes(3, 9, 3), 2).collect()
        assert len(rows) == 3 * (2 + 4 * 2)
        for r in rows:
            assert len(set(r["sample"].split(","))) == r["k"] and 0 < r["mpd"] <= 1
    small = items.where("id < 30").select("id", F.col("id").alias("pos"))
    framed = Inputs(items, small, families=groups, genera=groups, counts=counts)
    for r in sweep.sweep(framed, [4], 1).collect():
        assert all(int(i) < 30 for i in json.loads(f"[{r['sample']}]"))
