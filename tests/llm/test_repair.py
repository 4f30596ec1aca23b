import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from variform.llm import repair as R

SCHEMA = "conv_id bigint, turn bigint, role string, text string, gone int, piece string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit) of ``turns(initial, must go, truncated)``, by trying every edit from the end."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(k, last, inserts):
        found = [(0, "")] if k == len(turns) and last in ("", "a") else []
        if inserts < 3:
            found.append(add(2, "I", best(k, follow[last], inserts + 1)))
        if k < len(turns):
            initial, go, cut = turns[k]
            found.append(add(3, "D", best(k + 1, last, 0)))
            if not go:
                found.append(add(2 + cut, "R", best(k + 1, follow[last], 0)))
                if initial == follow[last] or last == "" and initial == "s":
                    found.append(add(cut, "K", best(k + 1, initial, 0)))
        return min(found, default=(10**9, "~"))

    def add(cost, letter, rest):
        return rest[0] + cost, letter + rest[1]

    return best(0, "", 0)


def brute(rows):
    rows_after = damaged(rows)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows_after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults, turns = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in own:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            turns.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        cost, audit = cheapest(turns)
        lines, at, last = [], 0, ""
        for letter in audit:
            if letter in "IR":
                last = "a" if last == "u" else "u"
                lines.append({"u": "user", "a": "assistant"}[last] + ":" + ("" if letter == "I" else own[at][2]))
            elif letter == "K":
                last = turns[at][0]
                lines.append(f"{own[at][1]}:{own[at][2]}")
            at += letter != "I"
        numbers = [r[0] for r in own if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        assert re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in lines))
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def cases(seed, conversations=60, longest=14):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", None, "a", "unknown"])
            text = rng.choice(["Yes.", "No!", "Why?", "well", "a. b ", "é…", " ", "", None, "\t\n", "long " * 30 + ".", f"t{turn}. "])
            rows.append((rng.choice([None, conv * 7] + [conv * 7] * 200), rng.choice([turn, turn, turn * 3, None]), role, text))
            rows += rows[-1:] * (rng.random() < 0.05)
    rows += [(900, t, "user", "Only users.") for t in range(40)] + [(901, t, "tool", f"{t}.") for t in range(40)]
    return rows


def ours(spark, rows, **more):
    df = R.report(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3), **more)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = cases(seed)
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("held", [{"held_rows": 3}, {"held_rows": 7}, {"held_rows": 5, "held_chars": 30}, {"held_rows": 1}])
def test_long_conversations_in_pieces(spark, held):
    rows = cases(3, 25, 30)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 4)  # conversations run over batches
        assert ours(spark, rows, **held) == brute(rows)
    finally:
        spark.conf.set(name, before)


def test_profiles_are_few():
    program, rng = R.Program(), random.Random(4)
    profile = program.start
    for _ in range(20_000):
        profile, _, _ = program.step(profile, rng.randrange(4), rng.random() < 0.2, rng.random() < 0.2)
    assert len({key[0] for key in program.steps}) < 300


def test_edits_of_long_runs():
    program = R.Program()
    for turns in ([(2, False, False)] * 30, [(0, False, True)] * 31, [(3, False, False), (2, False, False)] * 20, [(2, True, False)] * 9):
        profile, cost, back = program.start, 0, []
        for turn in turns:
            profile, grown, pointers = program.step(profile, *turn)
            cost += grown
            back.append(pointers)
        more, last = program.end(profile)
        edits = R.backtrack(back, last)[0] + "I" * R.TO_END[last]
        assert (cost + more, edits) == cheapest([(" sua"[t[0]], t[1], int(t[2])) for t in turns])


def test_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (2, 0, "assistant", "Lost."), (3, 5, "system", "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    want = {1: [("user", "Hi."), ("assistant", "There?")], 2: [("user", ""), ("assistant", "Lost.")]}
    for held in (1, 100):
        found = R.repair(df, held_rows=held).turns().orderBy("conv_id", "piece", "no").collect()
        assert {c: [(r["role"], r["text"]) for r in found if r["conv_id"] == c] for c in {r["conv_id"] for r in found}} == want


def test_empty_table(spark):
    assert R.report(spark.createDataFrame([], SCHEMA)).collect() == []
