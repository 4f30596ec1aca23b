import random
import re

from variform.llm import pii as P

SCHEMA = "doc_id bigint, text string, kind string, base int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def found(spark, texts, field="base"):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    return {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r[field]] for r in P.find(df).collect()}


def test_base_equals_brute_force(spark):
    rng = random.Random(1)
    bits = ["a@b.c", "@", ".", "_", "-", " ", "1", "22", "255", "256", "4111 1111 1111 1111", "+1 (234) 567-8901", "é", "x", "(", ")", "+", "\n", "0", "378282246310005"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    texts += [None, "", "x" * 20_000 + "@", "7" * 30_000, "1.2.3.4 " * 1_000, "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "00255.1.1.1", "4222222222222 " * 3]
    got = found(spark, texts)
    assert {k: v for k, v in got.items()} == {k: brute(t) for k, t in enumerate(texts)}


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + k)}x" for k in range(26)]
    texts = [f"{rng.choice(words)} call hotline +1 (555) 0{k:02d}-4{k:03d} {rng.choice(words)}" for k in range(12)]
    texts += ["wax call hotline 555.0199.4471 waz", "wax room 5550199447 waz", "built 2024 of 77"]
    got = found(spark, texts, "spans")
    assert got[12] == [("phone", 17, 30)]
    assert got[13] == [] and got[14] == []
    assert all(len(got[k]) == 1 for k in range(12))


def test_rare_or_mixed_contexts_find_nothing(spark):
    texts = [f"call hotline +1 (555) 0{k:02d}-4{k:03d}" for k in range(4)] + ["call hotline 555.0199.4471"]
    assert found(spark, texts, "spans")[4] == []
    texts = [f"id +1 (555) 0{k:02d}-4{k:03d}" for k in range(9)] + [f"id 555.0199.44{k:02d}" for k in range(30)]
    assert found(spark, texts, "spans")[12] == []


def test_repeats_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a@b.c", "x", 1), (1, "a@b.c", "x", 1), (None, None, None, None)], SCHEMA)
    got = sorted(((str(r["doc_id"]), r["n_email"], r["spans"]) for r in P.report(df).collect()))
    assert got == [("1", 1, "email:0:5"), ("1", 1, "email:0:5"), ("None", 0, "")]
    assert P.report(spark.createDataFrame([], SCHEMA)).collect() == []
