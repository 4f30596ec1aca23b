"""Greedy max-sum and max-min selection over vectors of any number of items.

Each pass over the items scores them against the picks so far and returns the best one. A pass
also checks a short chain of guessed further picks: where the guess was right, one pass settles
several picks. Guesses only save passes; every pick is verified against all items that could win.

Scores run: after every ``RESTAGE`` picks the items are written with their score so far, so a pass
computes distances to the picks since then only, and the cost of k picks grows with k. The written
scores also say who cannot win. By max-min a score never grows, by max-sum it grows by at most the
longest possible distance a pick; the guesses are items like any other, so the best scores are at
least theirs, and what cannot reach that is left out of the pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variform.functions import kernels
from variform.operators import pairwise
from variform.session import stage

MAXSUM, MAXMIN = "maxsum", "maxmin"
SCORE_DIGITS = 9
# sums closer than this share of the largest are equal but for the order of their additions
TIE = 1e-12
POOL = 512
MIN_CHAIN, MAX_CHAIN = 4, 32
# picks after which the items are written anew with their running scores
RESTAGE = 64
# candidates that a pass keeps at least, to guess from
KEEP = 64
# items of the first band of the first pick, and of the largest
FIRST_BAND, LARGEST_BAND = 256, 4096
# widest vectors whose moments of second order are kept, three numbers for each two positions
SECOND_ORDER = 512
# classes of items by how many features they have, each with moments of its own; those with all of them are one more
CLASSES = 8
# widest vectors whose moments of third order are kept, a third of the cube of the width
THIRD_ORDER = 128
# rows that moments of third order are added up over, and applied to, at a time
THIRD_ROWS = 2048
# points of cubic bounds, as shares of the mean square
TOUCHING = (0.7, 0.8, 0.9, 0.95, 1.0, 1.05, 1.1, 1.2, 1.4)
# rounding of sums over any number of rows, as a share of their largest term
ROUNDING = 1e-10


@dataclass
class Pick:
    id: object
    pos: object
    x: np.ndarray
    base: float = 0.0  # score against the picks before ``since``
    score: float | None = None
    since: int = 0


@dataclass
class _Scorer:
    """Running scores of a set of vectors against a growing list of picks."""

    objective: str
    metric: str
    x: np.ndarray
    base: np.ndarray
    total: np.ndarray = field(init=False)

    def __post_init__(self):
        self.total = self.base.copy()

    def add(self, point: np.ndarray) -> None:
        d = kernels.POINT_METRICS[self.metric](self.x, point)
        self.total = self.total + d if self.objective == MAXSUM else np.minimum(self.total, d)

    def ranked(self) -> np.ndarray:
        return np.round(self.total, SCORE_DIGITS)


def _base_default(objective: str) -> float:
    return 0.0 if objective == MAXSUM else float("inf")


def _best_first(score: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    """Positions of the ``n`` best scores; equal scores keep frame order; -inf is out."""
    usable = np.flatnonzero(score > -np.inf)
    if len(usable) > 4 * n:
        # everything that could tie with the n-th best stays in
        bar = np.partition(score[usable], len(usable) - n)[len(usable) - n]
        usable = usable[score[usable] >= bar]
    return usable[np.lexsort((pos[usable], -score[usable]))[:n]]


def _sortable(column: pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


class _Merge:
    """Best rows per step over the batches of one task."""

    def __init__(self):
        self.rows: dict[int, list[tuple]] = {}

    def add(self, step: int, score, pos, batch: pa.RecordBatch, base, keep: int) -> None:
        best = _best_first(score, pos, keep)
        picked = batch.take(pa.array(best))
        found = zip(
            score[best], pos[best], picked.column("id").to_pylist(), picked.column("pos").to_pylist(),
            picked.column("x").to_pylist(), base[best],
        )
        rows = self.rows.setdefault(step, [])
        rows.extend(found)
        rows.sort(key=lambda r: (-r[0], r[1]))
        del rows[keep:]

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        flat = [(step, *row) for step, rows in self.rows.items() for row in rows]
        step, score, _, ids, pos, x, base = zip(*flat) if flat else [()] * 7
        columns = dict(step=step, score=score, id=ids, pos=pos, x=x, base=base)
        return pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _result_schema(items: DataFrame) -> T.StructType:
    return T.StructType(
        [T.StructField("step", T.IntegerType()), T.StructField("score", T.DoubleType())]
        + [items.schema[c] for c in ("id", "pos", "x", "base")]
    )


def _pass(items: DataFrame, objective: str, metric: str, fresh: list[Pick], chain: list[Pick], pool: int, since: int):
    """One scan: the best item after ``fresh + chain[:j]`` for each ``j``, and a pool after the last.

    ``items`` holds scores against the picks before ``since``; the picks ``fresh`` came after.
    """
    schema = _result_schema(items)
    arrow_schema = pairwise.to_arrow_schema(schema)
    # guesses come from the best few of every task; the winners are exact whatever the pool
    keep = max(8, pool // items.rdd.getNumPartitions())
    settled = [(p.id, p.x) for p in fresh]
    guessed = [(p.id, p.x) for p in chain]

    def scan(batches):
        merge = _Merge()
        for batch in batches:
            if not batch.num_rows:
                continue
            pos = _sortable(batch.column("pos"))
            base = batch.column("base").to_numpy(zero_copy_only=False)
            scorer = _Scorer(objective, metric, kernels.matrix(batch.column("x")), base)
            taken = pc.is_in(batch.column("id"), pa.array([i for i, _ in settled], batch.column("id").type))
            out = taken.to_numpy(zero_copy_only=False)
            for _, x in settled:
                scorer.add(x)
            for step in range(len(guessed) + 1):
                score = np.where(out, -np.inf, scorer.ranked())
                merge.add(step, score, pos, batch, base, keep if step == len(guessed) else 1)
                if step < len(guessed):
                    guess, x = guessed[step]
                    scorer.add(x)
                    same = pc.equal(batch.column("id"), pa.scalar(guess, batch.column("id").type))
                    out = out | same.to_numpy(zero_copy_only=False)
        yield merge.batch(arrow_schema)

    found = items.select("id", "pos", "x", "base").mapInArrow(scan, schema)
    best = Window.partitionBy("step").orderBy(F.desc("score"), F.asc("pos"))
    wanted = F.when(F.col("step") == len(chain), pool).otherwise(1)
    found = found.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= pool) & (F.col("rank") <= wanted))
    steps: list[list[Pick]] = [[] for _ in range(len(chain) + 1)]
    for row in sorted(found.collect(), key=lambda r: (r["step"], r["rank"])):
        vector = np.array(row["x"], dtype=float)
        steps[row["step"]].append(Pick(row["id"], row["pos"], vector, row["base"], row["score"], since))
    return steps


def _guess(pool: dict, picks: list[Pick], objective: str, metric: str, length: int) -> tuple[list[Pick], list[float]]:
    """The next picks if only the pool existed, and what the best score is at least before each of them and after all."""
    taken = {p.id for p in picks}
    rest = [p for i, p in pool.items() if i not in taken]
    if not rest or length < 1:
        return [], []
    x, pos = np.stack([p.x for p in rest]), np.array([p.pos for p in rest])
    scorer = _Scorer(objective, metric, x, _running(rest, picks, objective, metric))
    alive = np.ones(len(rest), dtype=bool)
    chain, least = [], []
    for _ in range(min(length, len(rest))):
        score = np.where(alive, scorer.ranked(), -np.inf)
        best = _best_first(score, pos, 1)[0]
        alive[best] = False
        chain.append(rest[best])
        least.append(score[best])
        scorer.add(rest[best].x)
    left = np.sort(scorer.ranked()[alive])[::-1]
    # room for a pool to guess from next time
    least.append(left[KEEP - 1] if len(left) >= KEEP else -np.inf)
    return chain, least


def _running(pool: list[Pick], picks: list[Pick], objective: str, metric: str) -> np.ndarray:
    """Scores of the pool against all picks, those before an item's ``since`` being in its base."""
    total = np.array([p.base for p in pool])
    since = np.array([p.since for p in pool])
    for start in sorted(set(since)):
        at = since == start
        scorer = _Scorer(objective, metric, np.stack([p.x for p, here in zip(pool, at) if here]), total[at])
        for p in picks[start:]:
            scorer.add(p.x)
        total[at] = scorer.total
    return total


def _longest(items: DataFrame) -> float:
    """No distance is longer: the mean squared difference is at most the square of the widest range of a feature."""

    def scan(batches):
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = kernels.matrix(batch.column("x"))
                ends = np.where(np.isnan(x), np.inf, x).min(axis=0), np.where(np.isnan(x), -np.inf, x).max(axis=0)
                low, high = ends if low is None else (np.minimum(low, ends[0]), np.maximum(high, ends[1]))
        if low is not None:
            yield pa.record_batch({"i": np.arange(len(low)), "low": low, "high": high})

    ranges = items.select("x").mapInArrow(scan, "i long, low double, high double").groupBy("i").agg((F.max("high") - F.min("low")).alias("r"))
    row = ranges.agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).first()
    return float(np.sqrt(row["n"]) * max(row["r"] or 0.0, 0.0))


def _restaged(items: DataFrame, fresh: list[Pick], objective: str, metric: str) -> DataFrame:
    """``items`` without the picks ``fresh``, scored against them too."""
    id_type = pairwise.to_arrow_schema(T.StructType([items.schema["id"]]))[0].type
    points, ids = [p.x for p in fresh], [p.id for p in fresh]

    def score(batches):
        for batch in batches:
            batch = batch.filter(pc.invert(pc.is_in(batch.column("id"), pa.array(ids, id_type))))
            if batch.num_rows:
                scorer = _Scorer(objective, metric, kernels.matrix(batch.column("x")), batch.column("base").to_numpy(zero_copy_only=False))
                for x in points:
                    scorer.add(x)
                yield batch.set_column(batch.schema.get_field_index("base"), "base", pa.array(scorer.total))

    columns = items.select("id", "pos", "x", "base")
    return stage(columns.mapInArrow(score, columns.schema))


def greedy(items: DataFrame, k: int, objective: str, metric: str = "euclidean", first: Pick | None = None) -> list[Pick]:
    """Pick ``k`` items from ``items(id, pos, x[, base])`` in greedy order.

    After the ``first`` pick each next one maximises its summed or smallest distance to the picks.
    Without a first pick the column ``base`` holds the score of each item against an existing
    sample. Ties go to the smallest ``pos``.
    """
    if k < 1:
        raise ValueError(f"Invalid value {k=}, make sure k > 0")
    if "base" not in items.columns:
        items = items.withColumn("base", F.lit(_base_default(objective)))
    picks = [] if first is None else [first]
    pool: dict = {}
    length = 2 * MIN_CHAIN
    since, longest = 0, None
    while len(picks) < k:
        if len(picks) - since >= RESTAGE:
            if objective == MAXSUM and metric == "euclidean" and longest is None:
                longest = _longest(items)
            items = _restaged(items, picks[since:], objective, metric)
            since = len(picks)
            for p, total in zip(pool.values(), _running(list(pool.values()), picks, objective, metric)):
                p.base, p.since = total, since
        fresh = picks[since:]
        chain, least = _guess(pool, picks, objective, metric, min(length, k - len(picks) - 1))
        steps = _pass(_possible(items, least, objective, len(fresh), longest), objective, metric, fresh, chain, POOL, since)
        if not steps[0]:
            raise ValueError(f"Invalid value {k=}, there are only {len(picks)} items to sample from")
        right = 0
        for j, found in enumerate(steps):
            if not found or len(picks) == k:
                break
            picks.append(found[0])
            if j < len(chain):
                if found[0].id != chain[j].id:
                    break
                right += 1
        length = min(MAX_CHAIN, 2 * length) if right == len(chain) else max(MIN_CHAIN, 2 * right)
        # the pool only feeds guesses; keep the recent candidates
        seen = {p.id: p for found in steps for p in found}
        pool = dict(list({**pool, **seen}.items())[-4 * POOL :])
    return picks


def _possible(items: DataFrame, least: list[float], objective: str, fresh: int, longest: float | None) -> DataFrame:
    """Items whose written score lets them be best in some step, by what the best scores are at least."""
    if objective == MAXMIN:
        bars = least
    else:
        bars = [score - (fresh + j) * longest for j, score in enumerate(least)] if longest is not None else []
    bar = min(bars, default=-np.inf)
    # scores are compared with nine digits
    return items.where(F.col("base") >= float(bar) - 2e-9 * max(1.0, abs(bar))) if bar > -np.inf else items


def first_of_ties(scored: DataFrame, score: str, pos: str):
    """The row of the largest score, the smallest ``pos`` among equal ones; one rule for vectors and relations."""
    largest = scored.agg(F.max(score)).first()[0]
    return None if largest is None else scored.where(F.col(score) >= largest - abs(largest) * TIE).orderBy(pos).first()


# --- first pick -------------------------------------------------------------------------------


@dataclass
class _Moments:
    """Sums over a class of items, by weight: per position, and per two positions ``j, k`` over items that have ``k``."""

    weight: float
    fewest: int  # features of an item
    most: int
    ones: np.ndarray
    first: np.ndarray
    second: np.ndarray

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Upper bound of each row's mean distance to the items, whatever is missing where.

        The mean of roots is at most the root of the mean, so it is enough to bound the sum of q / m over the items,
        with q the sum of squared differences over the m shared positions. Of an item with a features m lies between
        low = a + fewest - width, one at least, and high = min(a, most), where 1 / m is at most the chord
        (low + high - m) / (low * high). So the sum is at most ((low + high) * sum of q - sum of q * m) / (low * high),
        and both sums follow from the moments. Of items that have all features m is a, and of wide vectors, which have no
        moments of two positions, 1 / low is taken.
        """
        width = x.shape[1]
        present = ~np.isnan(x)
        p, x0 = present.astype(float), np.where(present, x, 0.0)
        held = p.sum(axis=1)
        low = np.maximum(held + self.fewest - width, 1.0)
        high = np.maximum(np.minimum(held, self.most), low)
        if self.ones.ndim == 1:
            q = (x0 * x0) @ self.ones - 2.0 * x0 @ self.first + p @ self.second
            parts = q / low
        else:
            q = (x0 * x0) @ np.diag(self.ones) - 2.0 * x0 @ np.diag(self.first) + p @ np.diag(self.second)
            shared = (((x0 * x0) @ self.ones - 2.0 * x0 @ self.first + p @ self.second) * p).sum(axis=1)
            parts = ((low + high) * q - shared) / (low * high)
        # a little more than the rounding of the sums
        return np.sqrt(np.maximum(parts, 0.0) * width / self.weight) * (1 + 1e-9) + 1e-9


def _moments(vectors: DataFrame) -> list[_Moments]:
    """Moments of each class, in one scan; a task sends numbers per position, or per two positions, whatever its rows."""
    fields = "c int, j int, ones array<double>, first array<double>, second array<double>, weight double, fewest long, most long"
    names = ["c", "j", "ones", "first", "second", "weight", "fewest", "most"]

    def scan(batches):
        found: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = kernels.matrix(batch.column("x")), batch.column("w").to_numpy(zero_copy_only=False).astype(float)
            present = ~np.isnan(x)
            p, x0, held = present.astype(float), np.where(present, x, 0.0), present.sum(axis=1)
            kind = np.where(held == x.shape[1], CLASSES, held * CLASSES // (x.shape[1] + 1))
            for c in np.unique(kind).tolist():
                at = kind == c
                # where nothing is missing, sums over items that have k are sums over all
                single = c == CLASSES or x.shape[1] > SECOND_ORDER
                sides = [w[at, None] * v[at] for v in (p, x0, x0 * x0)]
                part = np.stack([side.sum(axis=0)[:, None] if single else side.T @ p[at] for side in sides])
                old = found.get(c, [0.0, 0.0, held.max(), 0])
                found[c] = [old[0] + part, old[1] + w[at].sum(), min(old[2], held[at].min()), max(old[3], held[at].max())]
        for c, (sums, weight, fewest, most) in found.items():
            n = sums.shape[1]
            ends = [pa.array([weight] * n), pa.array([int(fewest)] * n), pa.array([int(most)] * n)]
            yield pa.record_batch([pa.array([c] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), *(pa.array(list(s)) for s in sums), *ends], names=names)

    def add(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).slice(0, 1) for c in ("c", "j")}
        columns |= {c: [np.stack(table.column(c).to_pylist()).sum(axis=0)] for c in ("ones", "first", "second")}
        weight, fewest, most = pc.sum(table.column("weight")), pc.min(table.column("fewest")), pc.max(table.column("most"))
        return pa.table({**columns, "weight": [weight.as_py()], "fewest": [fewest.as_py()], "most": [most.as_py()]})

    rows = vectors.select("x", "w").mapInArrow(scan, fields).groupBy("c", "j").applyInArrow(add, fields).collect()
    out = []
    for c in sorted({r["c"] for r in rows}):
        own = sorted((r for r in rows if r["c"] == c), key=lambda r: r["j"])
        ones, first, second = (np.array([r[m] for r in own], dtype=float) for m in ("ones", "first", "second"))
        if ones.shape[1] == 1:
            ones, first, second = ones[:, 0], first[:, 0], second[:, 0]
        out.append(_Moments(own[0]["weight"], own[0]["fewest"], own[0]["most"], ones, first, second))
    return out


@dataclass
class _Cubic:
    """Mean products of up to three coordinates of ``z = (y - centre, |y - centre|^2 - spread)`` over complete items ``y``.

    ``third[j]`` is over ``z[j] * z[k] * z[l]`` for ``k, l >= j``, as many times as there are orders of the three, shared
    by ``k, l`` and ``l, k``. Any centre and spread are right; those of the items keep the sums small.
    """

    centre: np.ndarray
    spread: float
    reach: float  # longest distance from the centre
    first: np.ndarray
    second: np.ndarray
    third: list[np.ndarray]

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Upper bound of the mean distance of complete rows to the items.

        A root has negative derivatives of fourth order, so about any point its cubic Taylor polynomial lies above it
        everywhere. The squared distance of x and y is linear in z, so the mean of such a polynomial of it follows from
        the products; the least over some points is taken. The gap is of fourth order in the relative spread of the
        squares, that of the root of their mean is of second.
        """
        if len(x) > THIRD_ROWS:
            return np.concatenate([self.bound(x[start : start + THIRD_ROWS]) for start in range(0, len(x), THIRD_ROWS)])
        y = x - self.centre
        far = (y * y).sum(axis=1)
        # the squared distance is usual + b @ z; positions are rows, so that each starts a run of memory
        usual, b = far + self.spread, np.vstack([-2.0 * y.T, np.ones(len(y))])
        first, second = self.first @ b, ((self.second @ b) * b).sum(axis=0)
        third = sum(b[j] * ((part @ b[j:]) * b[j:]).sum(axis=0) for j, part in enumerate(self.third))
        least = np.full(len(y), np.inf)
        with np.errstate(all="ignore"):
            for share in TOUCHING:
                q, e = usual * share, usual * (1.0 - share)
                u = (first + e) / q
                uu = (second + 2.0 * e * first + e * e) / q**2
                uuu = (third + 3.0 * e * second + 3.0 * e * e * first + e**3) / q**3
                largest = ((np.sqrt(far) + self.reach) ** 2 + self.spread) / q
                slack = ROUNDING * (1.0 + largest + largest**2 + largest**3)
                found = np.sqrt(q) * (1.0 + u / 2.0 - uu / 8.0 + uuu / 16.0 + slack)
                least = np.where(np.isfinite(found), np.minimum(least, found), least)
        return least


def _cubic(vectors: DataFrame, whole: _Moments) -> _Cubic:
    """Products over the complete items, whose moments are ``whole``, in one scan; a task sends their sums."""
    centre = whole.first / whole.weight
    spread = max(float(whole.second.sum() / whole.weight - centre @ centre), 0.0)
    size = len(centre) + 2

    def scan(batches):
        parts, reach = [np.zeros((size - j, size - j)) for j in range(size)], 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = kernels.matrix(batch.column("x")), batch.column("w").to_numpy(zero_copy_only=False).astype(float)
            at = ~np.isnan(x).any(axis=1)
            x, w = x[at] - centre, w[at]
            for start in range(0, len(x), THIRD_ROWS):
                y, v = x[start : start + THIRD_ROWS], w[start : start + THIRD_ROWS]
                far = (y * y).sum(axis=1)
                reach = max(reach, float(np.sqrt(far.max())))
                z = np.ascontiguousarray(np.column_stack([np.ones(len(y)), y, far - spread]).T)
                for j in range(size):
                    parts[j] += (z[j:] * (v * z[j])) @ z[j:].T
        names = ["j", "sums", "reach"]
        yield pa.record_batch([pa.array(np.arange(size), pa.int32()), pa.array([p.ravel() for p in parts]), pa.array([reach] * size)], names=names)

    def add(table: pa.Table) -> pa.Table:
        sums = np.zeros(len(table.column("sums")[0]))
        for part in table.column("sums"):
            sums += part.values.to_numpy()
        return pa.table({"j": table.column("j").slice(0, 1), "sums": [sums], "reach": [pc.max(table.column("reach")).as_py()]})

    fields = "j int, sums array<double>, reach double"
    rows = sorted(vectors.select("x", "w").mapInArrow(scan, fields).groupBy("j").applyInArrow(add, fields).collect(), key=lambda r: r["j"])
    pairs, *third = (np.array(r["sums"]).reshape(size - r["j"], -1) / whole.weight for r in rows)
    for part in third:
        part[1:, 1:] *= 3.0
        part[0, 1:] *= 1.5
        part[1:, 0] *= 1.5
    return _Cubic(centre, spread, rows[0]["reach"], pairs[0, 1:], pairs[1:, 1:], third)


def _mean_bound(moments: list[_Moments], x: np.ndarray, cubic: _Cubic | None = None, least: float = -np.inf) -> np.ndarray:
    """Upper bound of each row's mean distance to all items.

    ``cubic`` is of the last class, that of complete items, and sharpens bounds of ``least`` or more.
    """
    bounds, weights = [m.bound(x) for m in moments], [m.weight for m in moments]
    bound = sum(w * b for w, b in zip(weights, bounds)) / sum(weights)
    if cubic is not None:
        at = np.flatnonzero(~np.isnan(x).any(axis=1) & (bound >= least))
        bounds[-1][at] = np.minimum(bounds[-1][at], cubic.bound(x[at]))
        bound[at] = sum(w * b[at] for w, b in zip(weights, bounds)) / sum(weights)
    return bound


def _bounded(vectors: DataFrame, moments: list[_Moments], cubic: _Cubic | None = None, least: float = -np.inf) -> DataFrame:
    """``(pos, h, bound)``, staged: bounds of mean distances that are ``least`` or more, ``h`` being a hash of the vector."""
    hashed = vectors.select("pos", F.xxhash64("x").alias("h"), "x")
    schema = T.StructType([*hashed.schema.fields[:2], T.StructField("bound", T.DoubleType())])

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                bound = _mean_bound(moments, kernels.matrix(batch.column("x")), cubic, least)
                yield batch.select(["pos", "h"]).append_column("bound", pa.array(bound)).filter(pa.array(~(bound < least)))

    return stage(hashed.mapInArrow(scan, schema))


def _mean_distances(vectors: DataFrame, band: list[Pick], metric: str) -> np.ndarray:
    """Exact mean distance of each band item to all items, in one scan."""
    points = np.stack([p.x for p in band])
    block = kernels.BLOCK_METRICS[metric]

    def scan(batches):
        sums, mass = np.zeros(len(points)), 0.0
        for batch in batches:
            if batch.num_rows:
                w = batch.column("w").to_numpy(zero_copy_only=False).astype(float)
                x = kernels.matrix(batch.column("x"))
                # tiles of two megabytes
                for start in range(0, len(x), 512):
                    for first in range(0, len(points), 512):
                        d = block(x[start : start + 512], points[first : first + 512])
                        sums[first : first + 512] += w[start : start + 512] @ d
                mass += w.sum()
        yield pa.record_batch({"i": np.arange(len(points)), "s": sums, "w": np.full(len(points), mass)})

    rows = (
        vectors.select("x", "w")
        .mapInArrow(scan, "i long, s double, w double")
        .groupBy("i")
        .agg((F.sum("s") / F.sum("w")).alias("mean"))
        .collect()
    )
    means = np.zeros(len(points))
    for row in rows:
        means[row["i"]] = row["mean"]
    return means


def _band_end(rest: DataFrame, size: int):
    """``(n, last)``: how many rows the band of the ``size`` highest bounds has, and bound and place of its last one.

    Tasks find the end of the band without the vectors and among themselves, so the driver gets a row whatever their
    number.
    """
    head = rest.select("bound", "pos").orderBy(F.desc("bound"), "pos").limit(size)
    falling = F.struct((-F.col("bound")).alias("falling"), "pos")
    return head.agg(F.count(F.lit(1)).alias("n"), F.max(falling).alias("last")).first()


def _costs_more(rest: DataFrame, moments: list[_Moments]) -> bool:
    """Whether exact sums of ``rest`` cost more than the scan for its cubic bounds, which some items must have."""
    width = len(moments[-1].ones)
    least = max(LARGEST_BAND, width * width)
    if moments[-1].fewest < width or width > THIRD_ORDER or sum(m.weight for m in moments) <= least:
        return False
    return rest.count() > least


def first_pick(vectors: DataFrame, metric: str = "euclidean") -> Pick:
    """The item of largest summed distance to all items, ties to the smallest ``pos``.

    ``vectors(id, pos, x, w)`` holds the distinct vectors and how many items stand behind each. A bound that costs two
    scans ranks them, and exact sums are computed for the items of highest bound, twice as many each time, until no
    other bound reaches the largest sum. Where the first band leaves so many items that their sums would cost more, a
    sharper bound, two scans again, ranks those anew. Kilometres have no such bounds; they are summed in block pairs.
    """
    if metric != "euclidean":
        sums = stage(vectors.join(pairwise.row_sums(vectors, metric), "id"))
        row = first_of_ties(sums, "sum_d", "pos")
        if row is None:
            raise ValueError("Invalid value, there are no items to sample from")
        return Pick(row["id"], row["pos"], np.array(row["x"], dtype=float))
    moments = _moments(vectors)
    if not moments:
        raise ValueError("Invalid value, there are no items to sample from")
    ranked = _bounded(vectors, moments)
    best: list[tuple[float, Pick]] = []  # the largest means so far, all that may be equal
    rest, size, sharp = ranked, FIRST_BAND, False
    while (end := _band_end(rest, size))["n"]:
        bound, last = -end["last"]["falling"], F.lit(end["last"]["pos"])
        placed = F.coalesce(F.col("pos") <= last, F.col("pos").isNull())
        inside = (F.col("bound") > bound) | ((F.col("bound") == bound) & placed)
        # a hash that several vectors share only makes the band longer
        hashes = (rest.where(inside) if end["n"] == size else rest).select("h")
        rows = vectors.select("id", "pos", "x").join(F.broadcast(hashes), F.xxhash64("x") == F.col("h"), "left_semi").collect()
        band = [Pick(r["id"], r["pos"], np.array(r["x"], dtype=float)) for r in rows]
        means = _mean_distances(vectors, band, metric)
        best += zip(means.tolist(), band)
        top = max(mean for mean, _ in best)
        best = [(mean, p) for mean, p in best if mean >= top * (1 - TIE)]
        if end["n"] < size:
            break
        least = top * (1 - 2 * TIE)
        rest = ranked.where(~inside & (F.col("bound") >= least))
        size = min(2 * size, LARGEST_BAND)
        if not sharp and _costs_more(rest, moments):
            ranked = rest = _bounded(vectors, moments, _cubic(vectors, moments[-1]), least)
            size, sharp = FIRST_BAND, True
    return min((p for _, p in best), key=lambda p: p.pos)
