"""SimHash near-duplicates with generalised pigeonhole search.

Fingerprints: each bit says whether more than half of a text's word shingles have it set in their XXH64. Rows collapse
to distinct fingerprints first, so copies never meet.

Search: correlated bits are grouped into partitions; the generalised pigeonhole principle allots each partition i a
threshold t_i (-1: unused) with sum(t_i) = limit - m + 1, and every pair within the limit is within t_i in some
partition. The thresholds, and the number of partitions, come from a dynamic program over estimated candidate counts:
exact numbers of pairs that agree on a partition, carried on to larger thresholds by the bits' frequencies. A
fingerprint is filed under its partition value with every choice of t_i bits cleared; two fingerprints within t_i share
such a key. Buckets are sorted runs, compared in numpy and tied to their least member, so a bucket gives fewer links
than it has members. A bucket over ``BUCKET`` leaves for the next level, where its remaining bits are cut in limit + 1
parts and one of them must agree; with few bits left a bucket is bounded and is compared whole. No link is lost.

Defined cases: null and empty texts have fingerprint zero, linked like any other; texts of fewer words than a shingle
are one shingle; null ids never name a component unless all its ids are null; repeated rows share a component; very
long texts are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variform.llm.common import spread_join, stage, without
from variform.llm.links import components

BITS = 64
SHINGLE = 3
LIMIT = 2
SEED = 42
#: Members of a bucket that one task compares, in strips of ``STRIP`` rows (512 x 8,192 words are 32 MB).
BUCKET = 8192
STRIP = 512
#: With so few bits left a bucket has at most 2**13 members.
LAST_BITS = 13
#: Cost of verifying a candidate against that of filing a key, for the dynamic program.
VERIFY_COST = 0.002


# --- fingerprints -------------------------------------------------------------------------------


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint; bytes.lower and bytes.split know A-Z and the six ASCII spaces only."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=len(shingles))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` per row."""
    return _fingerprints(docs.select(F.col("doc_id").cast("bigint"), "text"), shingle)


def _fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """The ids of ``rows(.., text)``, all bigint, with ``fp`` in place of the text."""
    ids = [c for c in rows.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(v.as_py(), shingle) for v in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ids), pa.array(fps, pa.int64())], names=[*ids, "fp"])

    return rows.mapInArrow(work, ", ".join(f"{c} bigint" for c in [*ids, "fp"]))


# --- the plan: partitions and thresholds --------------------------------------------------------


def _co_occurrence(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(float)
            n += len(values)
        rows = np.repeat(np.arange(BITS), BITS), np.tile(np.arange(BITS), BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*rows[0], BITS], pa.int32()), pa.array([*rows[1], BITS], pa.int32()), pa.array([*total.ravel().astype(np.int64), n], pa.int64())],
            names=["i", "j", "n"],
        )

    counts = fps.select("fp").mapInArrow(work, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, size = np.zeros((BITS, BITS)), 0
    for r in counts:  # 4,097 rows
        if r["i"] == BITS:
            size = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return size, both


def group_bits(size: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of about equal width, each bit going where its correlation is highest."""
    p = both.diagonal() / max(size, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(size, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    rest, parts = set(range(BITS)), []
    for k in range(m):
        width = len(rest) // (m - k)
        part = [max(rest, key=lambda b: (corr[b, sorted(rest)].sum(), -b))]
        rest.remove(part[0])
        while len(part) < width:
            best = max(rest, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            rest.remove(best)
        parts.append(sorted(part))
    return parts


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one per partition, that sum to ``total`` at the least cost. ``costs[i][t + 1]``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                entry = (cost + c, [*chosen, t])
                if spent + t not in nxt or entry < nxt[spent + t]:
                    nxt[spent + t] = entry
        best = nxt
    return best[total]


def plan(fps: DataFrame, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions in use."""
    size, both = _co_occurrence(fps)
    p = both.diagonal() / max(size, 1)
    agree = p * p + (1 - p) * (1 - p)
    choices = {m: group_bits(size, both, m) for m in range(max(1, limit), limit + 3)}
    keyed = fps.select(
        F.explode(F.array(*(F.struct(F.lit(100 * m + i).alias("at"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(bits)))).alias("v")) for m, parts in choices.items() for i, bits in enumerate(parts))))
    ).select("col.*")
    per_value = keyed.groupBy("at", "v").count()
    pairs = {r["at"]: float(r["n"]) for r in per_value.groupBy("at").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("n")).collect()}
    best = (math.inf, [], [])
    for m, parts in choices.items():
        costs = []
        for i, bits in enumerate(parts):
            odds = (1 - agree[bits]) / np.maximum(agree[bits], 1e-9)
            near, row, wider = 1.0, [0.0], 1.0
            for t in range(limit + 1):
                if t:
                    wider *= odds.sum() / t
                    near += wider
                row.append(size * math.comb(len(bits), t) + VERIFY_COST * pairs.get(100 * m + i, 0.0) * near)
            costs.append(row)
        cost, thresholds = allot(costs, limit - m + 1)
        best = min(best, (cost, parts, thresholds), key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(best[1], best[2]) if t >= 0]


# --- probing and verifying ----------------------------------------------------------------------


def _file(fps: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """``(path, free, fp)``: a key per partition and choice of cleared bits; ``free`` has the bits not known to agree."""
    keys = []
    for i, (bits, t) in enumerate(partitions):
        for cleared in combinations(bits, t):
            fixed = _mask(bits) & ~_mask(cleared)
            tag = F.lit(f"{i}:{cleared}")
            value = F.col("fp").bitwiseAND(F.lit(_signed(fixed)))
            keys.append(F.struct(F.xxhash64(tag, value).alias("path"), F.lit(_signed(~fixed & ((1 << BITS) - 1))).alias("free")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.path", "key.free", "fp")


def _ties(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket: members that have a smaller one in their component, and the least of that component.

    Strips of the comparison are made anew in each round instead of kept, so memory stays bounded.
    """

    def near(rows: np.ndarray, start: int) -> np.ndarray:
        return np.bitwise_count(rows[start : start + STRIP, None] ^ rows[None, :]) <= limit

    paired = np.concatenate([near(fps, k).sum(axis=1) > 1 for k in range(0, len(fps), STRIP)])
    fps = fps[paired]
    label = np.arange(len(fps))
    while len(fps):
        low = np.concatenate([np.where(near(fps, k), label[None, :], len(fps)).min(axis=1) for k in range(0, len(fps), STRIP)])
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _next_keys(fps: np.ndarray, path: int, free: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of a large bucket's members on the next level: its free bits in limit + 1 parts, one of which must agree."""
    bits = [b for b in range(BITS) if free >> b & 1]
    for k in range(limit + 1):
        part = _mask(bits[k :: limit + 1])
        keys = [xxhash.xxh64_intdigest(b"%d:%d:%d" % (path, k, v)) for v in (fps & np.uint64(part)).tolist()]
        yield np.array(keys, np.uint64).view(np.int64), np.full(len(fps), _signed(free & ~part)), fps


def _compare(limit: int, bucket: int):
    schema = ["a", "b", "path", "free"]

    def rows(a, b, path=None, free=None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), none if b is None else pa.array(b.view(np.int64)), none if path is None else pa.array(path), none if free is None else pa.array(free)],
            names=schema,
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by path, so buckets are runs; the last run of a batch waits for the next one."""
        held = None
        deferring = None  # path of a bucket that is too large

        def defer(path, free, fps):
            for keys, rest, members in _next_keys(fps, path, free & ((1 << BITS) - 1), limit):
                yield rows(members, None, keys, rest)

        def settle(path, free, fps):
            nonlocal deferring
            # what is left of a bucket that was handed on follows it, however little it is
            late = path == deferring if deferring is not None else np.zeros(len(path), bool)
            if late.any():
                at = int(np.argmax(late))
                yield from defer(int(path[at]), int(free[at]), fps[late])
                path, free, fps = path[~late], free[~late], fps[~late]
            if not len(path):
                return
            cuts = np.flatnonzero(np.diff(path)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(path)]
            sizes = ends - starts
            # runs of up to 8 at once, by comparing each member with the next ones
            run = np.repeat(sizes, sizes)
            for lag in range(1, min(8, len(fps))):
                hit = np.flatnonzero((path[lag:] == path[:-lag]) & (run[lag:] <= 8))
                hit = hit[np.bitwise_count(fps[hit] ^ fps[hit + lag]) <= limit]
                if len(hit):
                    yield rows(np.ascontiguousarray(fps[hit + lag]), np.ascontiguousarray(fps[hit]))
            for k in np.flatnonzero(sizes > 8):
                s, e = starts[k], ends[k]
                few_left = int(free[s]) & ((1 << BITS) - 1)
                if e - s > bucket and few_left.bit_count() > LAST_BITS:
                    deferring = path[s]
                    yield from defer(int(path[s]), int(free[s]), fps[s:e])
                else:
                    a, b = _ties(fps[s:e], limit)
                    if len(a):
                        yield rows(a, b)

        for batch in batches:
            path, free, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fps = np.ascontiguousarray(fps).view(np.uint64)
            if held is not None:
                path, free, fps = (np.concatenate(x) for x in zip(held, (path, free, fps)))
            if not len(path):
                continue
            last = int(np.searchsorted(path, path[-1], "left"))
            if path[-1] == deferring or (last == 0 and len(path) > bucket and (int(free[0]) & ((1 << BITS) - 1)).bit_count() > LAST_BITS):
                # one bucket fills what is held: hand it on without keeping it
                deferring = path[-1]
                last = len(path)
            if last:
                yield from settle(path[:last], free[:last], fps[:last])
            held = (path[last:], free[last:], fps[last:])
        if held is not None and len(held[0]):
            yield from settle(*held)

    return work


def near_links(fps: DataFrame, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links that connect exactly the distinct fingerprints ``fps(fp)`` within the limit of each other."""
    keys = _file(fps, plan(fps, limit))
    links = None
    while True:
        out = stage(keys.repartition("path").sortWithinPartitions("path").mapInArrow(_compare(limit, bucket), "a bigint, b bigint, path bigint, free bigint"))
        found = out.where("b IS NOT NULL").select("a", "b")
        links = found if links is None else links.unionByName(found)
        keys = out.where("b IS NULL").select("path", "free", F.col("a").alias("fp"))
        if keys.isEmpty():
            return links


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fp, component_id)``: the smallest id that a chain of near fingerprints reaches, itself included."""
    return _named(stage(fingerprints(docs, shingle)), F.col("doc_id"), limit, bucket).select("doc_id", "fp", F.col("first").alias("component_id"))


def _named(rows: DataFrame, name: Column, limit: int, bucket: int = BUCKET) -> DataFrame:
    """Staged ``rows(doc_id, .., fp)`` with ``first``, the least ``name`` of the component."""
    distinct = stage(rows.groupBy("fp").agg(F.min(name).alias("rep"), F.count(F.lit(1)).alias("n")))
    roots = components(near_links(distinct.select("fp"), limit, bucket)).withColumnRenamed("a", "fp")
    # the least fingerprint of a component is no row of ``roots``
    tied = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    named = tied.join(distinct, "fp").groupBy("root").agg(F.min("rep").alias("least"))
    least = tied.join(named, "root").select("fp", "least")
    per_fp = stage(distinct.join(least, "fp", "left").select("fp", F.coalesce("least", "rep").alias("first"), "n"))
    return spread_join(rows, per_fp, "fp", "n", "doc_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """``docs`` with one document, the one of the smallest id, of each component.

    Rows of one id and one text are one document and share its fate; of several texts under the smallest id, or of a
    component without any id, the one with the least hash stays.
    """
    prints = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("print"), "text")
    # null ids come last
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    named = _named(stage(_fingerprints(prints, shingle)), name, limit)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("print") == F.col("first.print"))
    return without(docs, named.where(~stays).select("doc_id", "print").distinct())


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
