"""Nearest neighbours, ties included, without meeting blocks that are too far away.

Items are parted into blocks around centres, which come from a bounded sample, parted in two again and again. Centres
decide only how well blocks keep together; every item is placed, with the centre nearest by the features that it has. A
block is compared with itself first, which gives each item an upper bound, the distance of the best neighbour found so far.
The item then travels to another block only if the block may hold something as near.

What a block may hold follows from its box: per feature the least and the largest value present, whether some and
whether all of its items have the feature, and how many features an item has at least. The distance of two items is the
root of width times the mean squared difference over the features that both have. So it is at least the root of width
times the least mean, over all sets of features the two could share, of the squared gaps between item and box. Such a
set holds the features that the item and all of the block have; of those that some of the block have it may lack as many
as an item of the block lacks at most, and the least mean lacks the largest gaps. That needs no triangle inequality,
which missing values break, and for complete vectors it is the usual box bound.

Blocks are bounded, and so is the table of their boxes, by a budget of bytes: larger tables get larger blocks. An item
without any neighbour in its own block travels to all blocks that share a feature with it. A block that many travel to
is dealt to several tasks. On data without any structure boxes do not part, and the work is that of comparing all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from variform.functions import kernels
from variform.operators import pairwise
from variform.session import small_table, stage

#: Rows that a block is planned for, as long as the boxes fit their budget; one may hold four times as many.
BLOCK_ROWS = 2048
#: Rows that the tree is grown from, and bytes that the boxes of all blocks may take.
SAMPLE_ROWS = 65_536
BOX_BYTES = 32 << 20
#: Travelling rows that a task compares with one block.
ROUTE_ROWS = 65_536
TILE_ROWS = 512
# distances are rounded to nine digits
SLACK = 2e-9


@dataclass
class Box:
    low: np.ndarray
    high: np.ndarray
    some: np.ndarray
    full: np.ndarray
    #: Features that an item has at least.
    held: int

    @classmethod
    def of(cls, x: np.ndarray) -> Box:
        present = ~np.isnan(x)
        low = np.where(present, x, np.inf).min(axis=0)
        high = np.where(present, x, -np.inf).max(axis=0)
        return cls(low, high, present.any(axis=0), present.all(axis=0), int(present.sum(axis=1).min()))

    def around(self, other: Box) -> Box:
        return Box(np.minimum(self.low, other.low), np.maximum(self.high, other.high), self.some | other.some, self.full & other.full, min(self.held, other.held))

    def bound(self, x: np.ndarray) -> np.ndarray:
        """What the distance of each row of ``x`` to any item in the box is at least, if it is positive."""
        width = x.shape[1]
        present = ~np.isnan(x)
        with np.errstate(invalid="ignore"):
            gaps = np.maximum(np.maximum(self.low - x, x - self.high), 0.0) ** 2
        sure, maybe = present & self.full, present & self.some & ~self.full
        total, count = np.where(sure, gaps, 0.0).sum(axis=1), sure.sum(axis=1)
        # of the features in question an item lacks so many at most, and the set has so many at least
        lacks = int(self.some.sum()) - self.held
        needed = np.maximum(maybe.sum(axis=1) - lacks, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where((count > 0) & (needed == 0), total / count, np.inf)
        if maybe.any():
            rest = np.sort(np.where(maybe, gaps, np.inf), axis=1)
            sizes = np.arange(1, width + 1)
            means = (total[:, None] + np.cumsum(rest, axis=1)) / (count[:, None] + sizes)
            least = np.minimum(least, np.where(sizes >= needed[:, None], means, np.inf).min(axis=1))
        return np.sqrt(width * least)


# --- the tree -----------------------------------------------------------------------------------


@dataclass
class Node:
    children: tuple = ()
    leaf: int = -1
    blocks: tuple = ()  # numbers of a leaf's blocks
    box: Box | None = None


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of least mean squared difference over the features that a row has."""
    out = np.zeros(len(x), np.int32)
    for start in range(0, len(x), TILE_ROWS):
        part = x[start : start + TILE_ROWS]
        out[start : start + TILE_ROWS] = np.argmin((~np.isnan(part)) @ (centres**2).T - 2.0 * np.nan_to_num(part) @ centres.T, axis=1)
    return out


def _whole(x: np.ndarray) -> np.ndarray:
    """Rows with the means in place of what is missing."""
    present = ~np.isnan(x)
    return np.where(present, x, np.where(present, x, 0.0).sum(axis=0) / np.maximum(present.sum(axis=0), 1))


def _halves(x: np.ndarray) -> np.ndarray | None:
    """Side of each row after a few rounds of two-means from rows far apart; None if nothing parts them."""
    whole = _whole(x)
    far = whole[np.argmax(((whole - whole.mean(axis=0)) ** 2).sum(axis=1))]
    centres = np.stack([far, whole[np.argmax(((whole - far) ** 2).sum(axis=1))]])
    for _ in range(4):
        side = nearest_centre(x, centres)
        if side.all() or not side.any():
            return None
        centres = np.stack([whole[side == k].mean(axis=0) for k in (0, 1)])
    return side


def grow(sample: np.ndarray, leaves: int) -> tuple[Node, list[Node], np.ndarray]:
    """A tree over the sample, its leaves and their centres; the largest part is halved next."""
    root, found, centres = Node(), [], []
    parts = [(-len(sample), 0, root, sample)]
    made = 1
    while parts:
        _, _, node, x = heapq.heappop(parts)
        side = _halves(x) if len(x) > 1 and len(found) + len(parts) + 1 < leaves else None
        if side is None:
            node.leaf = len(found)
            found.append(node)
            centres.append(_whole(x).mean(axis=0))
            continue
        node.children = (Node(), Node())
        for k, child in enumerate(node.children):
            part = x[side == k]
            heapq.heappush(parts, (-len(part), made, child, part))
            made += 1
    return root, found, _settled(sample, np.array(centres))


def _settled(sample: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centres moved to the means of the rows that are nearest to them, twice."""
    present = ~np.isnan(sample)
    for _ in range(2):
        at = nearest_centre(sample, centres)
        sums, counts = np.zeros(centres.shape), np.zeros(centres.shape)
        np.add.at(sums, at, np.where(present, sample, 0.0))
        np.add.at(counts, at, present)
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def _enclose(node: Node, boxes: dict[int, Box]) -> Box | None:
    """Boxes of the nodes from those of the blocks, parts without items left out."""
    inside = [_enclose(child, boxes) for child in node.children] if node.children else [boxes.get(b) for b in node.blocks]
    for box in inside:
        if box is not None:
            node.box = box if node.box is None else node.box.around(box)
    return node.box


def routes(root: Node, boxes: dict[int, Box], x: np.ndarray, limit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, block)``: the other blocks that may hold something as near as ``limit``."""
    found_rows, found_blocks = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    stack = [(root, np.arange(len(x)))]

    def near(box: Box, rows: np.ndarray) -> np.ndarray:
        bound = box.bound(x[rows])
        # what shares no feature is bounded by infinity and never a neighbour
        return rows[np.isfinite(bound) & (bound * (1 - 1e-9) <= limit[rows] + SLACK)]

    while stack:
        node, rows = stack.pop()
        if node.box is None:
            continue
        rows = near(node.box, rows)
        if not len(rows):
            continue
        stack += [(child, rows) for child in node.children]
        for block in node.blocks:
            if block in boxes:
                some = near(boxes[block], rows) if len(node.blocks) > 1 else rows
                some = some[own[some] != block]
                found_rows.append(some)
                found_blocks.append(np.full(len(some), block, np.int32))
    return np.concatenate(found_rows), np.concatenate(found_blocks)


# --- the search ---------------------------------------------------------------------------------

EDGE, ITEM, BOX = range(3)


def _nearest(x: np.ndarray, others: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row of ``x`` the least positive distance to ``others``, infinite if there is none, and the pairs that have it."""
    least, rows, columns, found = [], [], [], []
    for start in range(0, len(x), TILE_ROWS):
        d = np.round(kernels.euclidean_block(x[start : start + TILE_ROWS], others), pairwise.ROUND)
        if same:
            d[np.arange(len(d)), start + np.arange(len(d))] = np.inf
        d[d <= 0] = np.inf
        low = d.min(axis=1) if d.shape[1] else np.full(len(d), np.inf)
        i, j = np.nonzero((d == low[:, None]) & np.isfinite(d))
        least.append(low)
        rows.append(i + start)
        columns.append(j)
        found.append(d[i, j])
    return tuple(np.concatenate(part) if part else np.empty(0) for part in (least, rows, columns, found))


@dataclass
class Search:
    #: (a, b, d): each profile's nearest profiles at positive distance, ties included.
    edges: DataFrame
    blocks: int
    #: Pairs of rows that were compared.
    pairs: int


def search(profiles: DataFrame, block_rows: int = BLOCK_ROWS, route_rows: int = ROUTE_ROWS) -> Search:
    """Exact nearest neighbours of the staged distinct vectors ``profiles(id, x)`` by the missing-aware distance."""
    spark, n = profiles.sparkSession, profiles.count()
    id_type, vector = profiles.schema["id"].dataType, T.ArrayType(T.DoubleType())
    rows = profiles.select("id", F.col("x").cast(vector).alias("x"))
    if n <= block_rows:
        root = leaves = None
        placed = rows.withColumn("block", F.lit(0))
    else:
        sample = np.array([r["x"] for r in rows.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select("x").collect()], dtype=float)
        most = max(2, BOX_BYTES // (18 * sample.shape[1]))
        root, leaves, centres = grow(sample, min(most // 2, -(-n // block_rows)))
        placed, blocks = _placed(rows, centres, max(4 * block_rows, -(-n // most)))
    schema = T.StructType(
        [T.StructField("kind", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("a", id_type), T.StructField("b", id_type)]
        + [T.StructField("d", T.DoubleType()), T.StructField("n", T.LongType())]
        + [T.StructField(c, vector) for c in ("x", "low", "high", "some", "full")]
    )
    arrow = to_arrow_schema(schema)
    alone = root is None

    def within(table: pa.Table) -> pa.Table:
        x, ids = kernels.matrix(table.column("x")), table.column("id")
        block = table.column("block")[0].as_py()
        least, i, j, d = _nearest(x, x, True)
        parts = [{"kind": EDGE, "a": ids.take(pa.array(i, pa.int64())), "b": ids.take(pa.array(j, pa.int64())), "d": d}]
        if not alone:
            box = Box.of(x)
            parts.append({"kind": ITEM, "a": ids, "d": least, "x": table.column("x")})
            parts.append({"kind": BOX, "n": [len(x)], "low": [box.low], "high": [box.high], "some": [box.some.astype(float)], "full": [box.full.astype(float)], "d": [float(box.held)]})
        return pa.concat_tables([_table(arrow, block, part) for part in parts])

    found = stage(placed.groupBy("block").applyInArrow(within, schema))
    edges = found.where(F.col("kind") == EDGE).select("a", "b", "d")
    if alone:
        return Search(edges, 1, n * n)
    boxes, sizes = {}, {}
    for r in found.where(F.col("kind") == BOX).select("block", "n", "d", "low", "high", "some", "full").collect():  # within BOX_BYTES
        low, high, some, full = (np.array(r[c], dtype=float) for c in ("low", "high", "some", "full"))
        boxes[r["block"]] = Box(low, high, some > 0, full > 0, int(r["d"]))
        sizes[r["block"]] = r["n"]
    for leaf in leaves:
        leaf.blocks = blocks.get(leaf.leaf, ())
    _enclose(root, boxes)
    travelling = stage(_travelling(found, root, boxes))
    counts = {r["block"]: r["count"] for r in travelling.groupBy("block").count().collect()}  # a row per block
    pairs = sum(s * s for s in sizes.values()) + sum(c * sizes[b] for b, c in counts.items())
    if counts:
        members = found.where(F.col("kind") == ITEM).select("block", F.col("a").alias("id"), "x")
        met = _meet(members, travelling, counts, route_rows, id_type)
        edges = edges.unionByName(met)
    edges = stage(edges) if counts else edges
    best = edges.groupBy("a").agg(F.min("d").alias("_least"))
    return Search(edges.join(best, "a").where(F.col("d") == F.col("_least")).select("a", "b", "d"), len(boxes), pairs)


def _table(schema: pa.Schema, block: int, part: dict) -> pa.Table:
    n = len(next(v for k, v in part.items() if k != "kind"))
    full = {"block": pa.array([block] * n, pa.int32()), **part, "kind": pa.array([part["kind"]] * n, pa.int32())}
    columns = []
    for f in schema:
        value = full.get(f.name)
        if value is None:
            columns.append(pa.nulls(n, f.type))
        else:
            columns.append(value.cast(f.type) if isinstance(value, pa.ChunkedArray | pa.Array) else pa.array(value, f.type))
    return pa.Table.from_arrays(columns, schema=schema)


def _placed(rows: DataFrame, centres: np.ndarray, most: int) -> tuple[DataFrame, dict[int, tuple]]:
    """Rows with their block, and the blocks of each leaf: more than one where it holds more than ``most`` rows."""
    schema = T.StructType([*rows.schema.fields, T.StructField("leaf", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("leaf", pa.array(nearest_centre(kernels.matrix(batch.column("x")), centres), pa.int32()))

    leafed = stage(rows.mapInArrow(place, schema))
    blocks, first = {}, 0
    for r in leafed.groupBy("leaf").count().orderBy("leaf").collect():  # a row per leaf
        parts = -(-r["count"] // most)
        blocks[r["leaf"]] = tuple(range(first, first + parts))
        first += parts
    table = T.StructType([T.StructField(c, T.IntegerType()) for c in ("leaf", "first", "parts")])
    columns = {"leaf": list(blocks), "first": [b[0] for b in blocks.values()], "parts": [len(b) for b in blocks.values()]}
    joined = leafed.join(small_table(rows.sparkSession, table, columns), "leaf")
    block = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    return joined.select("id", "x", block.alias("block")), blocks


def _travelling(found: DataFrame, root: Node, boxes: dict[int, Box]) -> DataFrame:
    """``(block, id, x, d)``: items and the other blocks that may hold something as near as ``d``."""
    items = found.where(F.col("kind") == ITEM).select("block", F.col("a").alias("id"), "x", "d")
    schema = items.schema

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, limit, own = kernels.matrix(batch.column("x")), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("d", "block"))
            rows, blocks = routes(root, boxes, x, limit, own)
            for start in range(0, len(rows), 10_000):
                part = batch.take(pa.array(rows[start : start + 10_000]))
                yield part.set_column(0, "block", pa.array(blocks[start : start + 10_000], pa.int32()))

    return items.mapInArrow(route, schema)


def _meet(members: DataFrame, travelling: DataFrame, counts: dict[int, int], route_rows: int, id_type: T.DataType) -> DataFrame:
    """``(a, b, d)``: the nearest members of the blocks that items travelled to, if they are as near as their own bound."""
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("block", "parts")])
    table = small_table(members.sparkSession, schema, {"block": list(counts), "parts": [-(-c // route_rows) for c in counts.values()]})
    # a member goes to every part of its block, a traveller to one
    held = members.join(table, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "id", "x", F.lit(None).cast("double").alias("d"))
    came = travelling.join(table, "block").select("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "id", "x", "d")
    out = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("d", T.DoubleType())])
    arrow = to_arrow_schema(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ids, x = None, [], None, None
        for batch in batches:
            block, part, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "side"))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(block)]):
                if start == end:
                    continue
                rows = batch.slice(start, end - start)
                if (block[start], part[start]) != key:
                    key, parts, ids, x = (block[start], part[start]), [], None, None
                if side[start] == 0:
                    parts.append(rows)
                    continue
                if x is None:
                    whole = pa.Table.from_batches(parts)
                    ids, x = whole.column("id").combine_chunks(), kernels.matrix(whole.column("x"))
                _, i, j, d = _nearest(kernels.matrix(rows.column("x")), x, False)
                as_near = d <= rows.column("d").to_numpy(zero_copy_only=False)[i]
                i, j = pa.array(i[as_near], pa.int64()), pa.array(j[as_near], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("id").take(i), ids.take(j), pa.array(d[as_near])], schema=arrow)

    both = held.unionByName(came).repartition("block", "part").sortWithinPartitions("block", "part", "side")
    return both.mapInArrow(compare, out)


def nearest_edges(profiles: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``(a, b, d)``: for each staged distinct vector its nearest ones at positive distance, ties included.

    Kilometres have no box bound here: all pairs of blocks are met.
    """
    return search(profiles).edges if metric == "euclidean" else pairwise.nearest_edges(profiles, metric)
