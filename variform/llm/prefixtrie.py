"""Prefix trie of conversations: which openings they share, and what storing each only once would save.

Turns are encoded by a dictionary of distinct (role, text), so a conversation is a sequence of numbers. Sequences are
sorted over range shards, equal ones by id. A task reads its shard in runs of about ``RUN`` numbers and builds a ternary
search tree of each: a node holds one number, smaller and larger siblings hang to its sides and the next turn below it.
Sequences go in median first, so the siblings of any node are balanced. An iterative traversal adds up members, leaves
and savings from below.

As runs are cut from one sorted order, only nodes on the path of a run's first or last sequence can stand in other runs.
All others are done. These boundary nodes leave with what they know, in order of the traversal, and are merged by
walking along neighbouring runs with a stack of the open path: a node that closes inside a group of runs is done, the
group's own first and last paths go on to the next level, where a group is what a run was. Levels grow with the
logarithm of the number of runs, and no task holds more than a run or a path. Texts stay behind the dictionary; a hot
turn is spread over tasks in the join with it, and conversations that say the same are cut like any others.

Defined cases: a null role or text is empty; turns come by turn, nulls first, ties by role and text; repeated rows are
repeated turns; rows without a conversation id belong to no conversation and are left out; conversations without turns
end at the root; very long texts are only hashed and measured, and a very long conversation is one sequence of numbers;
an empty table gives no nodes; extra columns are ignored. Two turns are taken as equal by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variform.llm.common import spread_join, stage

#: Numbers in a run (a conversation counts one more than its turns), and runs merged by one task.
RUN = 250_000
GROUP = 512

NODE, BOUNDARY, ENDS = range(3)
_FOUND = (
    "kind int, run bigint, no bigint, key binary, parent_key binary, depth bigint, first boolean, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends_sha256 string, ends string"
)
_NAMES = [c.strip().split(" ")[0] for c in _FOUND.split(",")]
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
EMPTY = hashlib.sha256(b"").hexdigest()


# --- sequences ----------------------------------------------------------------------------------


def numbered(rows: DataFrame) -> DataFrame:
    """``(conv_id, n, digest, size)``: turns in order from 1, named by a digest of role and text, with the text's bytes."""
    blank = F.lit("")
    rows = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    )
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("conv_id", n.cast("bigint").alias("n"), digest.alias("digest"), F.octet_length("text").cast("bigint").alias("size"))


def grafted(turns: DataFrame) -> DataFrame:
    """Conversations that begin like others: staged ``turns`` with the first h turns of conversation c replaced by those
    of conversation c - c % 5, where h is crc32(c) % 9. Each conversation also has a row with n = 0."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h")
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), h)
    own = turns.where(F.col("n") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9)
    heads = turns.where("n <= 8").withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").where("n <= h").select("conv_id", "n", "digest", "size")
    marks = convs.select("conv_id", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("size"))
    return own.unionByName(heads).unionByName(marks)


def sequences(turns: DataFrame) -> DataFrame:
    """Staged ``(conv_id, ids, sizes)`` of staged ``turns(conv_id, n, digest, size)``; rows with n = 0 only name a conversation."""
    said = turns.where("n > 0")
    dictionary = said.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("id", F.monotonically_increasing_id())
    coded = spread_join(said, stage(dictionary), "digest", "n_rows", "conv_id").select("conv_id", "n", "id", "size")
    none = F.lit(0).cast("bigint")
    all_of = coded.unionByName(turns.where("n = 0").select("conv_id", "n", none.alias("id"), "size"))
    each = F.filter(F.array_sort(F.collect_list(F.struct("n", "id", "size"))), lambda t: t["n"] > 0)
    made = all_of.groupBy("conv_id").agg(each.alias("t"))
    return stage(made.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes")))


# --- the ternary search tree --------------------------------------------------------------------


class Tree:
    """Nodes by number; 0 is the root, whose ``low`` and ``high`` are not used."""

    def __init__(self):
        self.id, self.low, self.below, self.high = [0], [-1], [-1], [-1]
        self.parent, self.depth, self.size = [-1], [0], [0]
        self.members, self.least, self.children, self.ends = [0], [None], [0], [[]]

    def _new(self, parent: int, key: int, size: int) -> int:
        node = len(self.id)
        for column, value in zip(
            (self.id, self.low, self.below, self.high, self.parent, self.depth, self.size, self.members, self.least, self.children, self.ends),
            (key, -1, -1, -1, parent, self.depth[parent] + 1, size, 0, None, 0, []),
        ):
            column.append(value)
        self.children[parent] += 1
        return node

    def child(self, parent: int, key: int, size: int = 0, make: bool = True) -> int:
        at = self.below[parent]
        if at < 0:
            if make:
                self.below[parent] = at = self._new(parent, key, size)
            return at
        while key != self.id[at]:
            side = self.low if key < self.id[at] else self.high
            if side[at] < 0:
                if make:
                    side[at] = self._new(parent, key, size)
                return side[at]
            at = side[at]
        return at

    def insert(self, ids: list[int], sizes: list[int], convs: list[int]) -> None:
        node = 0
        self._count(node, convs)
        for key, size in zip(ids, sizes):
            node = self.child(node, key, size)
            self._count(node, convs)
        self.ends[node] = convs

    def _count(self, node: int, convs: list[int]) -> None:
        self.members[node] += len(convs)
        if self.least[node] is None or convs[0] < self.least[node]:
            self.least[node] = convs[0]

    def path(self, ids: list[int]) -> list[int]:
        nodes = [0]
        for key in ids:
            nodes.append(self.child(nodes[-1], key, make=False))
        return nodes

    def totals(self, apart: set[int]) -> tuple[list[int], list[int], list[int]]:
        """Children, leaves and savings of the subtrees. Nodes ``apart`` give nothing to their parents and count, of
        themselves, only what the others below them gave."""
        children, leaves, saved = [0] * len(self.id), [0] * len(self.id), [0] * len(self.id)
        # siblings and levels from a stack, parents before children
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += [n for n in (self.low[node], self.below[node], self.high[node]) if n >= 0]
        order.sort(key=self.depth.__getitem__)
        for node in reversed(order):
            if node in apart:
                continue
            leaves[node] += not self.children[node]
            saved[node] += (self.members[node] - 1) * self.size[node]
            parent = self.parent[node]
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
        return children, leaves, saved


def median_first(n: int) -> Iterator[int]:
    """The numbers below ``n``, the middle one first, then those of the halves."""
    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            stack += [(middle + 1, high), (low, middle)]


def _sha(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()


def _run(run: int, distinct: list[tuple[list[int], list[int], list[int]]]) -> Iterator[dict]:
    """Rows of a run of sorted distinct sequences ``(ids, sizes, conv_ids)``."""
    tree = Tree()
    for k in median_first(len(distinct)):
        tree.insert(*distinct[k])
    first, last = tree.path(distinct[0][0]), tree.path(distinct[-1][0])
    boundary = [*first, *(n for n in last if n not in set(first))]
    keys = {0: b""}
    for node in boundary[1:]:
        keys[node] = hashlib.sha256(keys[tree.parent[node]] + tree.id[node].to_bytes(8, "little")).digest()
    children, leaves, saved = tree.totals(set(boundary))
    for no, node in enumerate(boundary):
        row = {"kind": BOUNDARY, "run": run, "no": no, "key": keys[node], "parent_key": keys.get(tree.parent[node]), "depth": tree.depth[node]}
        row |= {"first": no < len(first), "conv_id": tree.least[node], "n_convs": tree.members[node], "size": tree.size[node]}
        yield row | {"n_children": children[node], "n_leaves": leaves[node], "saved_tokens": saved[node]}
        if tree.ends[node]:
            yield {"kind": ENDS, "run": run, "key": keys[node], "ends": ",".join(map(str, tree.ends[node]))}
    for node in range(1, len(tree.id)):
        if node not in keys:
            parent = tree.parent[node]
            row = {"kind": NODE, "run": run, "depth": tree.depth[node], "conv_id": tree.least[node], "n_convs": tree.members[node]}
            row |= {"parent_key": keys[parent]} if parent in keys else {"parent_conv_id": tree.least[parent]}
            row |= {"n_children": children[node], "n_leaves": leaves[node], "saved_tokens": saved[node]}
            yield row | {"ends_sha256": _sha(tree.ends[node]) if tree.ends[node] else EMPTY}


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    types = [_TYPES[c.strip().split(" ")[1]] for c in _FOUND.split(",")]
    held: list[dict] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in held], kind) for name, kind in zip(_NAMES, types)], names=_NAMES)

    for row in rows:
        held.append(row)
        if len(held) == 20_000:
            yield batch()
            held = []
    if held:
        yield batch()


def _shards(run_size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            run = TaskContext.get().partitionId() << 32
            distinct: list[tuple] = []
            held = 0
            for batch in batches:
                for conv_id, ids, sizes in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "ids", "sizes"))):
                    if distinct and distinct[-1][0] == ids:
                        distinct[-1][2].append(conv_id)
                        held += 1
                    else:
                        distinct.append((ids, sizes, [conv_id]))
                        held += len(ids) + 1
                    if held >= run_size:
                        yield from _run(run, distinct)
                        run, distinct, held = run + 1, [], 0
            if distinct:
                yield from _run(run, distinct)

        yield from _batches(rows())

    return work


# --- merging runs -------------------------------------------------------------------------------

_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")


def _merge(last_level: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boundary nodes of neighbouring runs in order: what closes is done, first and last paths go on."""

        def rows() -> Iterator[dict]:
            run, first_run, no = TaskContext.get().partitionId(), None, 0
            path: list[dict] = []
            closed_first: list[dict] = []

            def close() -> Iterator[dict]:
                node = path.pop()
                if node["first"] and not last_level:
                    closed_first.append(node)
                    return
                node["n_leaves"] += not node["n_children"]
                node["saved_tokens"] += (node["n_convs"] - 1) * node["size"]
                if path:
                    path[-1]["n_children"] += 1
                    path[-1]["n_leaves"] += node["n_leaves"]
                    path[-1]["saved_tokens"] += node["saved_tokens"]
                yield node | {"kind": NODE, "run": None}

            for batch in batches:
                for node in batch.to_pylist():
                    first_run = node["run"] if first_run is None else first_run
                    depth = node["depth"]
                    if depth < len(path) and path[depth]["key"] == node["key"]:
                        same = path[depth]
                        same["conv_id"] = min(same["conv_id"], node["conv_id"])
                        for name in _SUMS:
                            same[name] += node[name]
                        continue
                    while len(path) > depth:
                        yield from close()
                    node["first"] = node["first"] and node["run"] == first_run
                    path.append(node)
            if last_level:
                while path:
                    yield from close()
                return
            on_first = sorted([*closed_first, *(n for n in path if n["first"])], key=lambda n: n["depth"])
            for no, node in enumerate([*on_first, *(n for n in path if not n["first"])]):
                yield node | {"run": run, "no": no}

        yield from _batches(rows())

    return work


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the ids that end at each node, fed run by run."""
    at, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "digest"])

    for batch in batches:
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if digest is None or key != at:
                if digest is not None:
                    yield row()
                at, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ends.encode())
    if digest is not None:
        yield row()


def trie(sequences: DataFrame, run: int = RUN, group: int = GROUP) -> DataFrame:
    """Nodes of staged ``sequences(conv_id, ids, sizes)``, one row each.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, and ends_sha256 of the
    members that end there, ascending and comma-joined.
    """
    order = ["ids", "conv_id"]
    found = stage(sequences.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shards(run), _FOUND))
    edge = found.where(F.col("kind") == BOUNDARY)
    merged = None
    while True:
        runs = edge.select("run").distinct().count()
        parts = -(-runs // group) or 1
        step = edge.repartitionByRange(parts, "run") if parts > 1 else edge.coalesce(1)
        step = stage(step.sortWithinPartitions("run", "no").mapInArrow(_merge(parts == 1), _FOUND))
        done = step.where(F.col("kind") == NODE)
        merged = done if merged is None else merged.unionByName(done)
        if parts == 1:
            break
        edge = step.where(F.col("kind") == BOUNDARY)
    merged = stage(merged.select("key", "parent_key", *(c for c in _COLUMNS if c not in ("parent_conv_id", "ends_sha256"))))
    pieces = found.where(F.col("kind") == ENDS).select("key", "run", "ends")
    ends = pieces.repartition("key").sortWithinPartitions("key", "run").select("key", "ends").mapInArrow(_ends, "key binary, digest string")
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    shared = merged.join(names, "parent_key", "left").join(ends, "key", "left")
    shared = shared.withColumn("ends_sha256", F.coalesce("digest", F.lit(EMPTY))).select(*_COLUMNS)
    # nodes below a boundary node find it among those of their own run, so the root's many children stay spread
    inner = found.where(F.col("kind") == NODE)
    known = found.where(F.col("kind") == BOUNDARY).select("run", F.col("key").alias("parent_key")).join(names, "parent_key")
    below = inner.where("parent_key IS NOT NULL").drop("parent_conv_id").join(known, ["run", "parent_key"])
    return inner.where("parent_key IS NULL").select(*_COLUMNS).unionByName(below.select(*_COLUMNS)).unionByName(shared)


def report(rows: DataFrame, run: int = RUN, group: int = GROUP) -> DataFrame:
    """The trie of grafted conversations by its contract."""
    return trie(sequences(stage(grafted(stage(numbered(rows))))), run, group)


ORACLE = """
WITH tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), tab),
o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
    sha256(concat(strlen(coalesce(role, '')), ':', role, text)) AS token, strlen(coalesce(text, '')) AS size
  FROM conversations),
r AS (
  SELECT c.conv_id, o.n, token, size FROM c JOIN o ON o.conv_id = c.base AND o.n <= c.h
  UNION ALL SELECT c.conv_id, o.n, token, size FROM c JOIN o ON o.conv_id = c.conv_id AND o.n > c.h),
s AS (
  SELECT c.conv_id, list(token ORDER BY n) FILTER (WHERE n IS NOT NULL) AS tokens, list(size ORDER BY n) FILTER (WHERE n IS NOT NULL) AS sizes
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (
  SELECT conv_id, d, coalesce(len(tokens), 0) AS turns, coalesce(array_to_string(list_slice(tokens, 1, d), ''), '') AS path, sizes[d] AS size
  FROM (SELECT *, unnest(range(coalesce(len(tokens), 0) + 1)) AS d FROM s)),
n AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce((count(*) - 1) * max(size), 0) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE turns = d), '')) AS ends_sha256
  FROM p GROUP BY path, d),
k AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
t AS (
  SELECT a.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.saved) AS saved_tokens
  FROM l a JOIN l b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
FROM l JOIN t USING (path) LEFT JOIN l u ON l.depth > 0 AND u.path = left(l.path, length(l.path) - 64)
"""
