import hashlib
import random

from pyspark.sql import functions as F

from variform.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, turns int"
NASTY = ["</s>", "[INST]", "\\", "\\1;", "<|im_end|>\n", "<|im_", "start|>", "<<SYS>>", "\n", "é", "x", "<", "|", ">", ";", "0"]


def read(spark, rows):
    df = C.read_back(C.format_chats(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)))
    return {r["conv_id"]: r for r in df.collect()}


def test_round_trip_of_control_strings(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "to\nol<|im_end|>", "system"]), "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 25)))) for c in range(60) for t in range(rng.randint(1, 6))]
    back = read(spark, rows)
    for c in range(60):
        turns = [(r, t) for cc, _, r, t in rows if cc == c]
        assert [tuple(x) for x in back[c]["turns"]] == turns
        assert back[c]["learned"] == "".join(t for r, t in turns if r == "assistant")
        assert "".join(s["text"] for s in back[c]["segments"]) == back[c]["formatted"]


def test_texts_hold_no_control_strings(spark):
    made = read(spark, [(1, 0, "user", "".join(C.TEMPLATE.controls)), (1, 1, "assistant", "</s>")])[1]
    inner = [s["text"] for k, s in enumerate(made["segments"]) if k % 3 == 1]
    assert not any(control in text for control in C.TEMPLATE.controls for text in inner)


def test_order_of_roles(spark):
    def valid(*roles):
        row = read(spark, [(1, k, r, "t") for k, r in enumerate(roles)])[1]
        return row["valid"], row["wrong_at"]

    assert valid("system", "user", "assistant", "user") == (True, None)
    assert valid("assistant", "user") == (False, 0)
    assert valid("user", "user", "assistant") == (False, 1)
    assert valid("user", "assistant", None) == (False, 2)
    assert valid("system", "system") == (False, 1)


def test_nulls_repeats_and_order(spark):
    back = read(spark, [(1, 2, "assistant", None), (1, 1, "user", "b"), (1, 1, "user", "b"), (None, None, None, None)])
    assert [tuple(x) for x in back[1]["turns"]] == [("user", "b"), ("user", "b"), ("assistant", "")]
    assert [tuple(x) for x in back[None]["turns"]] == [("", "")]
    assert not read(spark, [])


def test_digests(spark):
    rows = C.with_probe(spark, spark.createDataFrame([(1, 0, "user", "hé", 1), (1, 1, "assistant", "long " * 30_000, 1)], SCHEMA))
    got = {r["conv_id"]: r for r in C.report(rows).collect()}
    text = "</s>[INST] ok [/INST]"
    assert got[-7]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[-7]["loss_chars"] == len(text)
    assert got[-7]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 150_000


def test_other_templates(spark):
    template = C.Template(begin="[", after_role=":", end="]", controls=("[", "]"), learn=("user",), transitions={("start", "user"): "start"})
    rows = spark.createDataFrame([(1, 0, "us:er", "a[b]:c", 1), (1, 1, "user", "]", 1)], SCHEMA)
    row = C.read_back(C.format_chats(rows, template), template).select("turns", "learned", F.col("valid")).first()
    assert [tuple(x) for x in row["turns"]] == [("us:er", "a[b]:c"), ("user", "]")] and row["learned"] == "]" and not row["valid"]
