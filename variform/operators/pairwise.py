"""Exact all-pairs reductions without an item-by-item join.

Items are hashed into blocks of bounded size; each pair of blocks is one group whose kernel
returns sums, row sums, extremes or nearest neighbours. Pairs are never rows, a group never holds
more than two blocks, and a group key (a sample, say) of any size is spread over many block pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from variform.functions import kernels
from variform.functions.columns import exact_sum
from variform.session import stage

TILE_ROWS = 1024
#: Memory of a block's vectors; a task holds two blocks, as they came and as numbers.
BLOCK_BYTES = 32 << 20
#: Blocks that a table is cut in before blocks grow, for enough pairs of them to keep a cluster busy.
LEAST_BLOCKS = 64
ROUND = 9


def n_blocks(rows: Column, width: Column, block_rows: int | None) -> Column:
    """Blocks for so many rows of vectors of this width.

    Each row travels once per block, so larger tables get larger blocks, up to the memory for one.
    """
    if block_rows is None:
        most = F.floor(F.lit(BLOCK_BYTES) / (8 * TILE_ROWS * F.greatest(width, F.lit(1))))
        tiles = F.least(most, F.ceil(rows / (LEAST_BLOCKS * TILE_ROWS)))
        per_block = F.greatest(tiles, F.lit(1)) * TILE_ROWS
    else:
        per_block = F.lit(block_rows)
    return F.greatest(F.lit(1), F.ceil(rows / per_block)).cast("int")


def _block_of(n: Column) -> Column:
    return F.pmod(F.xxhash64("id"), n).cast("int")


def _block_count(items: DataFrame, block_rows: int | None) -> Column:
    shape = items.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    return n_blocks(F.lit(shape["n"]), F.lit(shape["width"] or 1), block_rows)


def pair_blocks(items: DataFrame, group: str | None, block_rows: int | None) -> DataFrame:
    """Place each item in every unordered pair of blocks that holds its own block.

    Adds ``_g, _lo, _hi, _right``; an item lands in as many pairs as its group has blocks.
    """
    if group is None:
        placed = items.withColumn("_g", F.lit(0)).withColumn("_n", _block_count(items, block_rows))
    else:
        sizes = items.groupBy(group).agg(n_blocks(F.count(F.lit(1)), F.max(F.size("x")), block_rows).alias("_n"))
        placed = items.join(sizes, group).withColumn("_g", F.col(group))
    placed = placed.withColumn("_b", _block_of(F.col("_n")))
    placed = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return placed.select(
        "_g",
        F.least("_b", "_o").alias("_lo"),
        F.greatest("_b", "_o").alias("_hi"),
        (F.col("_b") > F.col("_o")).alias("_right"),
        "id",
        "x",
        F.col("w").cast("double").alias("w"),
    )


def cross_blocks(items: DataFrame, others: DataFrame, block_rows: int | None) -> DataFrame:
    """As :func:`pair_blocks` for two different tables: every block of one against every block of the other."""
    n_left, n_right = (_block_count(df, block_rows) for df in (items, others))

    def place(df: DataFrame, own: str, n_own: Column, other: str, n_other: Column, right: bool) -> DataFrame:
        return df.select(
            F.lit(0).alias("_g"),
            _block_of(n_own).alias(own),
            F.explode(F.sequence(F.lit(0), n_other - 1)).alias(other),
            F.lit(right).alias("_right"),
            "id",
            "x",
            F.lit(1.0).alias("w"),
        )

    left = place(items, "_lo", n_left, "_hi", n_right, False)
    return left.unionByName(place(others, "_hi", n_right, "_lo", n_left, True))


class _Block:
    """One side of a block pair, or a tile of it."""

    def __init__(self, ids: pa.ChunkedArray, x: np.ndarray, w: np.ndarray):
        self.ids, self.x, self.w = ids, x, w

    @classmethod
    def of(cls, table: pa.Table) -> _Block:
        return cls(table.column("id"), kernels.matrix(table.column("x")), table.column("w").to_numpy())

    def tiles(self) -> list[_Block]:
        starts = range(0, len(self.w), TILE_ROWS)
        return [_Block(self.ids.slice(s, TILE_ROWS), self.x[s : s + TILE_ROWS], self.w[s : s + TILE_ROWS]) for s in starts]


def _tile_pairs(table: pa.Table, one_table: bool):
    """``(left, right, diagonal)`` tiles of a block pair; ``diagonal`` marks a tile met with itself.

    Equal block numbers mean the same block only when both sides come from one table.
    """
    if one_table and table.column("_lo")[0] == table.column("_hi")[0]:
        tiles = _Block.of(table).tiles()
        for i, left in enumerate(tiles):
            for right in tiles[i:]:
                yield left, right, left is right
        return
    right_side = table.column("_right")
    left_rows, right_rows = table.filter(pc.invert(right_side)), table.filter(right_side)
    if left_rows.num_rows and right_rows.num_rows:
        rights = _Block.of(right_rows).tiles()
        for left in _Block.of(left_rows).tiles():
            for right in rights:
                yield left, right, False


def _per_pair(placed: DataFrame, schema: T.StructType, body: Callable, one_table: bool = True) -> DataFrame:
    """Run ``body(g, left, right, diagonal) -> dict of columns`` on every pair of tiles.

    Tiles bound the memory of a kernel whatever the block size. Rows come to them in the order of their ids, so that
    sums over a tile do not depend on how the table was partitioned.
    """
    arrow_schema = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        g = table.column("_g")[0]
        table = table.take(pc.sort_indices(table.column("id")))
        parts = [pa.table(body(g, *tiles)).select(arrow_schema.names).cast(arrow_schema) for tiles in _tile_pairs(table, one_table)]
        return pa.concat_tables(parts) if parts else arrow_schema.empty_table()

    return placed.groupBy("_g", "_lo", "_hi").applyInArrow(run, schema)


def _schema(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """Fields are (name, type); the type ``id`` or ``_g`` means that column's own type."""
    types = {"double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "whole": T.DecimalType(38, 0)}
    types |= {c: df.schema[c].dataType for c in ("id", "_g")}
    return T.StructType([T.StructField(name, types[kind]) for name, kind in fields])


def _pair_weights(left: _Block, right: _Block, diagonal: bool) -> np.ndarray:
    """Item pairs behind each cell; on the diagonal each unordered pair once, copies included."""
    weights = np.outer(left.w, right.w)
    if diagonal:
        weights = np.triu(weights, 1)
        np.fill_diagonal(weights, left.w * (left.w - 1) / 2)
    return weights


def _distances(left: _Block, right: _Block, diagonal: bool, block: Callable) -> np.ndarray:
    d = block(left.x, right.x)
    if diagonal:
        np.fill_diagonal(d, 0.0)
    return d


def pair_statistics(
    profiles: DataFrame,
    group: str | None = None,
    stats: tuple[str, ...] = ("distance", "overlap"),
    metric: str = "euclidean",
    block_rows: int | None = None,
) -> DataFrame:
    """``(group, stat, total, n, mean)`` over all unordered pairs of items within each group.

    ``distance`` sums distances over pairs; ``overlap`` gives one row per way of averaging the running value overlap,
    with the sum and the number of ratios. Counts are added as whole numbers and distances as decimals, so results are
    equal bit for bit however the table is partitioned; a mean overlap is the double next to the exact value.
    """
    block = kernels.BLOCK_METRICS[metric]
    placed = pair_blocks(profiles, group, block_rows)

    def body(g, left, right, diagonal):
        found = []
        parts = kernels.weight_parts(left.w, right.w, diagonal)
        if "distance" in stats:
            weights = _pair_weights(left, right, diagonal)
            n = sum(int(part.sum()) << shift for shift, part in parts)
            found.append(("distance", 0, (weights * _distances(left, right, diagonal, block)).sum(), 0, n))
        if "overlap" in stats:
            found += [(mode, shared, 0.0, equal, n) for mode, shared, equal, n in kernels.overlap_counts(left.x, right.x, parts)]
        stat, shared, d, equal, n = zip(*found) if found else [()] * 5
        return {
            "_g": pa.array([g.as_py()] * len(found), g.type),
            "stat": pa.array(stat, pa.string()),
            "shared": pa.array(shared, pa.int32()),
            "d": pa.array(d, pa.float64()),
            "equal": pa.array(map(Decimal, equal), pa.decimal128(38, 0)),
            "n": pa.array(map(Decimal, n), pa.decimal128(38, 0)),
        }

    fields = (("_g", "_g"), ("stat", "string"), ("shared", "int"), ("d", "double"), ("equal", "whole"), ("n", "whole"))
    parts = _per_pair(placed, _schema(placed, *fields), body)
    sums = parts.groupBy("_g", "stat", "shared").agg(exact_sum("d").alias("d"), F.sum("equal").alias("equal"), F.sum("n").alias("n"))
    # at most as many terms as there are features
    terms = sums.groupBy("_g", "stat").agg(F.max("d").alias("d"), F.collect_list(F.struct("shared", "equal", "n")).alias("terms"))
    out = _schema(placed, ("_g", "_g"), ("stat", "string"), ("total", "double"), ("n", "double"), ("mean", "double"))
    totals = terms.mapInArrow(_means, out)
    return totals.withColumnRenamed("_g", group) if group else totals.drop("_g")


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum, number and mean of ratios, given as whole numerators by denominator; a distance has its sum already."""
    for batch in batches:
        total, count, mean = [], [], []
        for stat, d, terms in zip(*(batch.column(c).to_pylist() for c in ("stat", "d", "terms"))):
            n = sum(int(t["n"]) for t in terms)
            whole = Fraction(d) if stat == "distance" else sum((Fraction(int(t["equal"]), t["shared"]) for t in terms), Fraction(0))
            total.append(float(whole))
            count.append(float(n))
            mean.append(float(whole / n) if n else None)
        columns = [batch.column("_g"), batch.column("stat"), *(pa.array(c, pa.float64()) for c in (total, count, mean))]
        yield pa.RecordBatch.from_arrays(columns, names=["_g", "stat", "total", "n", "mean"])


def pair_extremes(profiles: DataFrame, metric: str = "euclidean", block_rows: int | None = None) -> DataFrame:
    """One row ``(min_d, max_d)`` over the full matrix of all items, diagonal included."""
    block = kernels.BLOCK_METRICS[metric]
    placed = pair_blocks(profiles, None, block_rows)

    def body(g, left, right, diagonal):
        d = _distances(left, right, diagonal, block)
        return {"lo": [float(d.min())], "hi": [float(d.max())]}

    parts = _per_pair(placed, _schema(placed, ("lo", "double"), ("hi", "double")), body)
    return parts.agg(F.min("lo").alias("min_d"), F.max("hi").alias("max_d"))


def row_sums(profiles: DataFrame, metric: str = "euclidean", block_rows: int | None = None) -> DataFrame:
    """``(id, sum_d)``: summed distance of each profile to every item."""
    block = kernels.BLOCK_METRICS[metric]
    placed = pair_blocks(profiles, None, block_rows)

    def body(g, left, right, diagonal):
        d = _distances(left, right, diagonal, block)
        ids, sums = left.ids, d @ right.w
        if not diagonal:
            ids = pa.chunked_array([*left.ids.chunks, *right.ids.chunks])
            sums = np.concatenate([sums, left.w @ d])
        return {"id": ids, "s": sums}

    parts = _per_pair(placed, _schema(placed, ("id", "id"), ("s", "double")), body)
    return parts.groupBy("id").agg(exact_sum("s").alias("sum_d"))


def pair_relation(profiles: DataFrame, metric: str = "euclidean", block_rows: int | None = None) -> DataFrame:
    """``(a, b, d, n_a, n_b)`` for every unordered pair of distinct profiles, ``a < b``.

    The relation is quadratic in the number of *distinct vectors* by definition; for reductions
    over it use the other functions here, which never build it.
    """
    block = kernels.BLOCK_METRICS[metric]
    placed = pair_blocks(profiles, None, block_rows)

    def body(g, left, right, diagonal):
        d = _distances(left, right, diagonal, block)
        i, j = np.triu_indices(len(left.w), 1) if diagonal else (m.ravel() for m in np.indices(d.shape))
        return {
            "p": left.ids.take(pa.array(i)),
            "q": right.ids.take(pa.array(j)),
            "d": d[i, j],
            "n_p": left.w[i].astype(np.int64),
            "n_q": right.w[j].astype(np.int64),
        }

    fields = (("p", "id"), ("q", "id"), ("d", "double"), ("n_p", "long"), ("n_q", "long"))
    pairs = _per_pair(placed, _schema(placed, *fields), body)
    ordered = F.col("p") < F.col("q")
    return pairs.select(
        F.least("p", "q").alias("a"),
        F.greatest("p", "q").alias("b"),
        "d",
        F.when(ordered, F.col("n_p")).otherwise(F.col("n_q")).alias("n_a"),
        F.when(ordered, F.col("n_q")).otherwise(F.col("n_p")).alias("n_b"),
    )


def nearest_edges(profiles: DataFrame, metric: str = "euclidean", block_rows: int | None = None) -> DataFrame:
    """``(a, b, d)``: for each profile its nearest profiles at positive distance, ties included.

    Every block pair keeps only its own nearest edges; the global minimum then filters them.
    """
    block = kernels.BLOCK_METRICS[metric]
    placed = pair_blocks(profiles, None, block_rows)

    def body(g, left, right, diagonal):
        d = np.round(_distances(left, right, diagonal, block), ROUND)
        d[d <= 0] = np.inf
        i, j = np.nonzero((d == d.min(axis=1, keepdims=True)) & np.isfinite(d))
        edges = [(left.ids.take(pa.array(i)), right.ids.take(pa.array(j)), d[i, j])]
        if not diagonal:
            i, j = np.nonzero((d == d.min(axis=0, keepdims=True)) & np.isfinite(d))
            edges.append((right.ids.take(pa.array(j)), left.ids.take(pa.array(i)), d[i, j]))
        a, b = (pa.chunked_array([c for e in edges for c in e[side].chunks]) for side in (0, 1))
        return {"a": a, "b": b, "d": np.concatenate([e[2] for e in edges])}

    # staged, as it is read twice and the kernel is the costly part
    local = stage(_per_pair(placed, _schema(placed, ("a", "id"), ("b", "id"), ("d", "double")), body))
    best = local.groupBy("a").agg(F.min("d").alias("_min"))
    return local.join(best, "a").where(F.col("d") == F.col("_min")).select("a", "b", "d")


def score_against(
    items: DataFrame, chosen: DataFrame, how: str, metric: str = "euclidean", limit: int = 1024, block_rows: int | None = None
) -> DataFrame:
    """``items`` with ``score``: summed (``how='sum'``) or smallest (``'min'``) distance to the chosen items.

    Up to ``limit`` chosen vectors travel to the tasks with the function; a larger set is met in
    block pairs. The check reads at most ``limit + 1`` rows.
    """
    head = chosen.select("id", "x").orderBy("id").limit(limit + 1).collect()
    schema = T.StructType([*items.schema.fields, T.StructField("score", T.DoubleType())])
    if len(head) <= limit:
        point = kernels.POINT_METRICS[metric]
        points = np.array([row["x"] for row in head], dtype=float)

        def score(batches):
            for batch in batches:
                x = kernels.matrix(batch.column("x"))
                total = np.zeros(len(x)) if how == "sum" else np.full(len(x), np.inf)
                for p in points if len(x) else ():
                    total = total + point(x, p) if how == "sum" else np.minimum(total, point(x, p))
                yield batch.append_column("score", pa.array(total))

        return items.mapInArrow(score, schema)
    block = kernels.BLOCK_METRICS[metric]
    placed = cross_blocks(items, chosen, block_rows)

    def body(g, left, right, diagonal):
        d = block(left.x, right.x)
        return {"id": left.ids, "score": d.sum(axis=1) if how == "sum" else d.min(axis=1)}

    parts = _per_pair(placed, _schema(placed, ("id", "id"), ("score", "double")), body, one_table=False)
    scores = parts.groupBy("id").agg((exact_sum if how == "sum" else F.min)("score").alias("score"))
    return items.join(scores, "id").select(*items.columns, "score")
