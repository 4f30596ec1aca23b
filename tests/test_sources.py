import json

import pytest
from pyspark.sql import functions as F

from data import example, items_table
from variform.operators import cleaning, corpus, distance
from variform.sources import readers, writers


def lines(path):
    return [line for f in sorted(path.glob("part-*")) for line in f.read_text().splitlines()]


def test_features_round_trip_as_integers(spark, tmp_path):
    vectors = example()
    features = [f"feature_{i}" for i in range(1, 6)]
    wide = items_table(spark, vectors).select("id", *[F.col("x")[i].alias(f) for i, f in enumerate(features)])
    writers.write_features(wide, str(tmp_path / "features"))
    back = readers.read_features(spark, str(tmp_path / "features"))
    assert back.columns == ["id", *features]
    found = {r["id"]: r["x"] for r in cleaning.to_vector(cleaning.clean_missing(back, features), features).collect()}
    assert found == vectors
    assert "arap1274,1,1,1,1,1" in lines(tmp_path / "features")


def test_features_with_an_unnamed_index(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("Unnamed: 0,Lang_ID,GB001\n0,aaaa1234,?\n1,bbbb1234,1\n")
    df = readers.read_features(spark, str(path))
    assert df.columns == ["id", "GB001"]
    path.write_text(",GB001\naaaa1234,?\n")
    assert readers.read_features(spark, str(path)).columns == ["id", "GB001"]


def test_distances_round_trip_wide_and_long(spark, tmp_path):
    items = items_table(spark, example())
    profiles = items.groupBy("x").agg(F.min("id").alias("id"))
    relation = distance.symmetrize(distance.all_pairs(items), profiles).cache()
    ids = sorted(r["id"] for r in profiles.collect())
    writers.write_wide_distances(relation, ids, str(tmp_path / "wide"))
    expected = {(r["a"], r["b"]): r["d"] for r in relation.collect()}
    back = {(r["a"], r["b"]): r["d"] for r in readers.read_distances(spark, str(tmp_path / "wide")).collect()}
    assert back == expected
    writers.write_distances(relation, str(tmp_path / "long"))
    assert spark.read.parquet(str(tmp_path / "long")).exceptAll(relation).isEmpty()
    legacy = tmp_path / "legacy.csv"
    legacy.write_text(",a,b\na,0.0,0.5\nb,0.5,\n")
    found = {(r["a"], r["b"]): r["d"] for r in readers.read_distances(spark, str(legacy)).collect()}
    assert found == {("a", "a"): 0.0, ("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "b"): None}
    assert [r["id"] for r in readers.frame_of_relation(relation).orderBy("pos").collect()] == ids


def test_wide_table_has_a_limit(spark):
    with pytest.raises(ValueError):
        distance.to_wide(spark.createDataFrame([(1, 1, 0.0)], "a int, b int, d double"), list(range(10_001)))


def test_frames_counts_metadata(spark, tmp_path):
    frame = tmp_path / "frame.txt"
    frame.write_text("zulu1234\n  abkh1244 \n\nmand1415\n")
    assert [r["id"] for r in readers.read_frame(spark, str(frame)).orderBy("pos").collect()] == ["zulu1234", "abkh1244", "mand1415"]
    assert [r["id"] for r in readers.read_frame(spark, str(frame), sort=True).orderBy("pos").collect()][0] == "abkh1244"
    counts = tmp_path / "counts.json"
    counts.write_text(json.dumps({"b": 1, "a": 3, "c": 1}, indent=1))
    rows = readers.read_counts(spark, str(counts)).orderBy(F.desc("n"), "pos").collect()
    assert [(r["id"], r["n"]) for r in rows] == [("a", 3), ("b", 1), ("c", 1)]
    odd = {'a"b': 1, "é\\\\": -2, "c d": 3}
    counts.write_text(json.dumps(odd))
    assert {r["id"]: r["n"] for r in readers.read_counts(spark, str(counts)).collect()} == odd
    counts.write_text(json.dumps({"a,b": 1, "c": 2}))
    assert {r["id"]: r["n"] for r in readers.read_counts(spark, str(counts), whole=True).collect()} == {"a,b": 1, "c": 2}
    with pytest.raises(Exception, match="whole=True"):
        readers.read_counts(spark, str(counts)).collect()
    counts.write_text("{}")
    assert readers.read_counts(spark, str(counts)).collect() == []
    many = spark.createDataFrame([(f'k"{i}', i) for i in range(300)], "id string, n int")
    path = writers.write_counts(many, str(tmp_path / "made"), "counts")
    assert json.loads(open(path).read()) == {f'k"{i}': i for i in range(300)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        again = readers.read_counts(spark, path)
        assert again.rdd.getNumPartitions() > 3
        assert [r["n"] for r in again.orderBy("pos").collect()] == [n for _, n in sorted((f'k"{i}', i) for i in range(300))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    meta = tmp_path / "meta.csv"
    meta.write_text(readers.ITEM_SCHEMA.replace(" STRING", "").replace(" DOUBLE", "").replace(" ", "") + "\n"
                    "x,Name,Africa,1.5,,x,,,Fam,fam1,x,language,a/b\n")
    row = readers.read_item_metadata(spark, str(meta)).first()
    assert (row["Latitude"], row["Longitude"], row["Family_name"]) == (1.5, None, "Fam")
    genus = tmp_path / "genus.csv"
    genus.write_text("Glottocode,Genus,other\nx,Semitic,1\ny,,2\n")
    assert [tuple(r) for r in readers.read_group_metadata(spark, str(genus)).collect()] == [("x", "Semitic"), ("y", None)]
    codes = tmp_path / "codes.csv"
    codes.write_text("name;glottocode\nArabic;arab1234\n")
    assert tuple(readers.read_semicolon_csv(spark, str(codes)).first()) == ("Arabic", "arab1234")
    taxonomy = tmp_path / "taxonomy.csv"
    taxonomy.write_text("id,name,iso639P3code,child_language_count\nx,X,xxx,0\ny,Y,,?\n")
    assert [r["child_language_count"] for r in readers.read_taxonomy(spark, str(taxonomy)).collect()] == [0, None]


@pytest.mark.parametrize("reader", [readers.read_features, readers.read_distances, readers.read_frame, readers.read_counts, readers.read_points])
def test_missing_input_is_named(spark, tmp_path, reader):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        reader(spark, str(tmp_path / "nowhere"))


def edition(code: str, script: str, verses: list[str]) -> str:
    head = ["# name", f"# code: {code}", f"# script: {script}"] + [f"# h{i}" for i in range(8)]
    return "\n".join(head + verses) + "\n"


@pytest.mark.parametrize("split_bytes", ["128m", "1000b"])
def test_parallel_corpus_however_it_is_split(spark, tmp_path, split_bytes):
    (tmp_path / "sub").mkdir()
    (tmp_path / "fra-long.txt").write_text(edition("fra", "Latn", [f"{i} verset {i}" for i in range(500)]))
    (tmp_path / "eng-one.txt").write_text(edition("eng", "Latn", ["#1 In  the\tbeginning", "2 second", "", "2 second again"]))
    (tmp_path / "sub" / "deu-x.txt").write_text(edition("deu", "Latn", ["1 Am Anfang"]))
    (tmp_path / "rus-x.txt").write_text(edition("rus", "Cyrl", ["1 V nachale", "3"]))
    headers = {tuple(r) for r in readers.read_corpus_headers(spark, str(tmp_path)).collect()}
    assert headers == {("eng-one.txt", "eng", "Latn"), ("deu-x.txt", "deu", "Latn"), ("rus-x.txt", "rus", "Cyrl"), ("fra-long.txt", "fra", "Latn")}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        verses = readers.read_parallel_corpus(spark, str(tmp_path)).cache()
        if split_bytes != "128m":
            assert verses.where("lang = 'fra'").select("line.block").distinct().count() > 5
        rows = {(r["lang"], r["edition"], r["verse_id"], r["text"]) for r in verses.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    long = {r for r in rows if r[0] == "fra"}
    assert long == {("fra", "fra-long.txt", str(i), f"verset {i}") for i in range(500)}
    assert rows - long == {
        ("eng", "eng-one.txt", "1", "In the beginning"),
        ("eng", "eng-one.txt", "2", "second"),
        ("eng", "eng-one.txt", "2", "second again"),
        ("deu", "deu-x.txt", "1", "Am Anfang"),
        ("rus", "rus-x.txt", "1", "V nachale"),
        ("rus", "rus-x.txt", "3", ""),
    }
    kept = spark.createDataFrame([("eng",), ("rus",)], "lang string")
    two = spark.createDataFrame([("2",)], "verse_id string")
    last = corpus.selected_units(verses, two, kept).collect()
    assert [tuple(r) for r in last] == [("eng", "2", "second again")]


def test_samples_results_costs_and_texts(spark, tmp_path):
    ids = spark.createDataFrame([("b",), ("a",)], "id string")
    path = writers.write_sample(ids, str(tmp_path), "maxsum", "frame", 2, "dists", 123)
    assert path.endswith("maxsum-frame-2-dists-123.txt") and (tmp_path / "maxsum-frame-2-dists-123.txt").read_text() == "a\nb\n"
    samples = spark.createDataFrame([("random", 0, 2, "a"), ("random", 1, 2, "b")], "method string, run int, k int, id string")
    writers.write_samples(samples, str(tmp_path / "samples"))
    assert spark.read.parquet(str(tmp_path / "samples")).where("run = 1").first()["id"] == "b"
    for fmt in ("parquet", "csv"):
        writers.write_results(samples, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    costs = spark.createDataFrame([("verses/eng.txt", 12.5, "stan1293")], "verses string, avg_subwords double, glottocode string")
    for _ in range(2):
        writers.append_costs(costs, str(tmp_path / "costs"))
    again = readers.read_semicolon_csv(spark, str(tmp_path / "costs"))
    assert again.count() == 2 and again.columns == ["verses", "avg_subwords", "glottocode"]
    writers.write_language_texts(spark.createDataFrame([("eng", "v2", "there"), ("eng", "v1", "hello"), ("deu", "v1", "hallo")], "lang string, verse_id string, text string"), str(tmp_path / "texts"))
    assert {f.name: f.read_text() for f in (tmp_path / "texts").glob("*.txt")} == {"eng.txt": "hello\nthere\n", "deu.txt": "hallo\n"}
    writers.write_sample_files(samples, str(tmp_path / "each"), "frame", "d")
    assert {f.name: f.read_text() for f in (tmp_path / "each").glob("*.txt")} == {"random-frame-2-d-2.txt": "a\n", "random-frame-2-d-3.txt": "b\n"}
    (tmp_path / "verses").mkdir()
    (tmp_path / "verses" / "eng.txt").write_text("hello there  \n\nyou\n")
    units = readers.read_text_units(spark, str(tmp_path / "verses"))
    assert [(r["code"], r["text"]) for r in units.collect()] == [("eng", "hello there"), ("eng", ""), ("eng", "you")]
    spark.createDataFrame([(1, [0.5, 1.0])], "id int, x array<float>").write.parquet(str(tmp_path / "points"))
    assert readers.read_points(spark, str(tmp_path / "points")).first()["x"] == [0.5, 1.0]
