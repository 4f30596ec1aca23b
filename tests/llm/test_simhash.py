import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from variform.llm import simhash as S

SCHEMA = "doc_id bigint, text string, fp string, component_id int"


def slow_fingerprint(text, k=3):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, limit=2):
    """Least member of the component of each value, by comparing all."""
    u = np.array(sorted(set(values)), dtype=np.uint64)
    label = np.arange(len(u))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= limit
    while True:
        low = np.where(near, label[None, :], len(u)).min(axis=1)
        if (low == label).all():
            return {int(v): int(label[i]) for i, v in enumerate(u)}
        label = low


def test_fingerprints_equal_the_definition(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("The a É cat dog\tX".split(" ")) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "One", "one  two\n", "word " * 30_000]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["fp"] for r in S.fingerprints(df).collect()}
    assert {k: v & (2**64 - 1) for k, v in got.items()} == {k: slow_fingerprint(t) for k, t in enumerate(texts)}


def planted(rng, n=300):
    """Random values, chains of near ones, and a dense ball."""
    out = [rng.getrandbits(64) for _ in range(n)] + [0, (1 << 64) - 1]
    for _ in range(15):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(2, 8)):
            out.append(v)
            v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    out += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)]
    return out


def check_links(spark, values, **more):
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in set(values)], "fp bigint")
    links = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in S.near_links(fps, **more).collect()]
    want = classes(values, more.get("limit", 2))
    parent = {v: v for v in want}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        parent[find(a)] = find(b)
    groups = {}
    for v in want:
        groups.setdefault(find(v), set()).add(v)
    expected = {}
    for v, c in want.items():
        expected.setdefault(c, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    return links


def test_links_connect_what_comparing_all_connects(spark):
    check_links(spark, planted(random.Random(5)))


def test_large_buckets_leave_for_further_levels(spark):
    links = check_links(spark, planted(random.Random(6)), bucket=16)
    assert len(links) < 20_000


@pytest.mark.parametrize("tail", [1, 3, 8, 9])
def test_the_tail_of_a_large_bucket_follows_it(tail):
    rng = random.Random(tail)
    fps = np.array([rng.getrandbits(64) for _ in range(40 + tail)], dtype=np.uint64).view(np.int64)
    paths = np.array([5] * len(fps) + [9] * 3)
    fps = np.r_[fps, [1, 2, 3]]
    columns = [pa.array(paths), pa.array(np.full(len(fps), -1)), pa.array(fps)]
    table = pa.RecordBatch.from_arrays(columns, names=["path", "free", "fp"])
    out = list(S._compare(2, 16)(iter([table.slice(0, 40), table.slice(40)])))
    left = [a for b in out for a, tied in zip(b.column("a").to_pylist(), b.column("b").to_pylist()) if tied is None]
    assert sorted(left) == sorted(3 * fps[:-3].tolist())  # every member, once for each part of its free bits


def test_large_buckets_over_several_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in (17, 23):
            spark.conf.set(name, size)
            check_links(spark, planted(random.Random(size), 100), bucket=16)
    finally:
        spark.conf.set(name, before)


def test_other_limits(spark):
    check_links(spark, planted(random.Random(7), 100), limit=3)
    check_links(spark, planted(random.Random(8), 100), limit=1)


def test_components_of_documents(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(5, base), (4, base.upper()), (9, "something else"), (2, None), (3, ""), (3, ""), (None, base), (7, "one"), (8, "one two")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(df).collect()), key=str)
    fps = {i: slow_fingerprint(t) for i, t in rows}
    label = classes(fps.values())
    least = {}
    for i, t in rows:
        if i is not None:
            least[label[slow_fingerprint(t)]] = min(least.get(label[slow_fingerprint(t)], 99), i)
    assert got == sorted(((i, least[label[slow_fingerprint(t)]]) for i, t in rows), key=str)
    kept = S.deduplicate(df)
    assert kept.columns == df.columns and 5 not in {r["doc_id"] for r in kept.collect()}


def test_deduplicate_with_lacking_and_repeated_ids_and_clashing_names(spark):
    base = " ".join(f"w{k}" for k in range(400))
    rows = [(5, base), (5, base), (5, base.upper()), (None, base), (9, base + " "), (None, "alone"), (None, "ALONE"), (7, "one"), (7, "two")]
    docs = spark.createDataFrame([(*r, k, k) for k, r in enumerate(rows)], "doc_id bigint, text string, _llm_id int, _LLM_PRINT int")
    kept = S.deduplicate(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()]
    assert sorted(got, key=str) in (
        sorted([(5, base)] * n + [(None, "alone"), (7, "one"), (7, "two")], key=str) for n in (1, 2)  # the text that stays has one row or two
    )


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_dynamic_program_takes_the_cheapest_sum():
    assert S.allot([[0, 1, 5], [0, 9, 9], [0, 1, 3]], -1) == (2.0, [0, -1, 0])
    parts = S.group_bits(10, np.eye(64) * 5, 3)
    assert sorted(b for p in parts for b in p) == list(range(64)) and {len(p) for p in parts} <= {21, 22}
