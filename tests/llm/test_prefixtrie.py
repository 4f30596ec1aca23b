import hashlib
import math
import random
import zlib

import pytest

from variform.llm import prefixtrie as T

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id int, n string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [r[2:] for r in sorted(found)] for c, found in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:])
    return nodes(built)


def nodes(built):
    members, children = {}, {}
    for c, sequence in built.items():
        for d in range(len(sequence) + 1):
            members.setdefault(sequence[:d], []).append(c)
            if d:
                children.setdefault(sequence[: d - 1], set()).add(sequence[:d])

    def below(node):
        inside = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in inside if n)
        return sum(n not in children for n in inside), saved

    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children.get(node, ())), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def cases(seed, conversations=80):
    """Few texts, so that openings are shared; copies; lacking turns, roles, texts and ids; repeated rows; one long text."""
    rng, rows = random.Random(seed), []
    for conv in rng.sample(range(-20, 200), conversations):
        for turn in range(rng.randint(1, 12)):
            say = (rng.choice(["user", "assistant", "", None]), rng.choice(["a", "bé", "c", "", None, "long " * 50]))
            rows.append((conv if rng.random() < 0.99 else None, rng.choice([turn, turn, turn, None]), *(say if turn > 1 else ("user", "hello"))))
            rows += rows[-1:] * (rng.random() < 0.05)
    rows += [(1000 + 5 * k, t, "user", f"t{t}") for k in range(30) for t in range(3)]  # copies
    rows += [(2001, 0, "user", "x")]  # no conversation to begin like
    return rows


def ours(spark, rows, **more):
    df = T.report(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3), **more)
    assert df.columns == T._COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_brute_force(spark):
    rows = cases(1)
    assert ours(spark, rows) == brute(rows)


@pytest.mark.parametrize("run, group", [(1, 2), (6, 2), (25, 3)])
def test_many_runs_and_levels_of_merging(spark, run, group):
    rows = cases(run, 40)
    assert ours(spark, rows, run=run, group=group) == brute(rows)


def test_long_conversation(spark):
    rows = [(c, t, "user", f"{t % 7}") for c in (1, 6) for t in range(600 + c)]
    assert ours(spark, rows, run=50, group=2) == brute(rows)


def test_trie_of_any_conversations(spark):
    rows = [(c, t, "user", f"{c % 3}{t if t < 2 else c % 4}") for c in range(24) for t in range(4)]
    turns = T.stage(T.numbered(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)))
    built = {c: tuple((b"user", r[3].encode()) for r in rows if r[0] == c) for c in range(24)}
    assert sorted(map(tuple, T.trie(T.sequences(turns)).collect()), key=str) == nodes(built)


def test_empty_table(spark):
    assert ours(spark, []) == [] and ours(spark, [(None, 1, "user", "x")]) == []


def test_siblings_are_balanced():
    tree, n = T.Tree(), 1000
    assert sorted(T.median_first(n)) == list(range(n))
    for k in T.median_first(n):
        tree.insert([k], [1], [k])

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.below[0]) == 10 and tree.totals(set())[1][0] == n
