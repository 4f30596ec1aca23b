"""Exact duplicates by Grace hashing.

Records are dealt to buckets by a digest of their normalised text; a task works through one bucket with an
open-addressing table that compares complete contents. Copies inside a task's input collapse before they travel, so a
text held by a third of all rows arrives once per task. A table takes contents up to a byte budget; what finds it full
leaves for the next level, where other bits of the digest deal it to more buckets, until every bucket has fitted. Each
level is a table in the shared folder, so a lost executor costs its tasks only.

Texts are equal when they are after deleting white space (space and characters 9 to 13). Of equal texts the one with
the most code points stays, then the smallest id. The digest (SHA-256 of the normalised text) names a class; should two
contents ever share one, the job stops with an error instead of merging them.

Defined cases: null counts as empty; rows of one id and one normalised text are one document and share its fate, each
row of the result for itself; null ids come last among ties, and of a class without ids ``deduplicate`` keeps one row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variform.llm.common import SPACES, spare, spread_join, stage, without

#: Bytes of distinct contents that one table may hold.
TABLE_BYTES = 96 << 20
#: Bytes after which the table that collapses copies before the shuffle hands its records on.
LOCAL_BYTES = 24 << 20

_DROP = SPACES.encode()
_RECORD = "digest binary, content binary, n bigint, points bigint, doc_id bigint"


def _normal(texts: pa.Array) -> Iterator[bytes]:
    for value in texts.cast(pa.binary()):
        yield (value.as_py() or b"").translate(None, _DROP)


class Table:
    """Open addressing with linear probing; slots hold an entry number, entries hold complete contents."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = np.full(slots, -1, dtype=np.int64)
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.rows: list[list] = []  # n, points, doc_id
        self.bytes = 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[:8], "little") & mask
        while (entry := self.slots[at]) >= 0:
            if self.digests[entry] == digest:
                if self.contents[entry] == content:
                    break
                raise ValueError(f"two contents share the digest {digest.hex()}")
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, content: bytes, n: int, points: int, doc_id: int | None, room: int) -> bool:
        """Merges a record; False if its content is new and does not fit into ``room`` bytes."""
        at = self._slot(digest, content)
        if (entry := self.slots[at]) >= 0:
            row = self.rows[entry]
            row[0] += n
            if _rank(points, doc_id) < _rank(row[1], row[2]):
                row[1], row[2] = points, doc_id
            return True
        if self.rows and self.bytes + len(content) > room:
            return False
        self.slots[at] = len(self.rows)
        self.digests.append(digest)
        self.contents.append(content)
        self.rows.append([n, points, doc_id])
        self.bytes += len(content) + 200
        if 2 * len(self.rows) > len(self.slots):
            self._grow()
        return True

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = np.full(mask + 1, -1, dtype=np.int64)
        for entry, digest in enumerate(self.digests):
            at = int.from_bytes(digest[:8], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _rank(points: int, doc_id: int | None) -> tuple:
    return -points, doc_id is None, doc_id or 0


def _record_batches(digests, contents, rows) -> Iterator[pa.RecordBatch]:
    start = size = 0
    for end, content in enumerate(contents, 1):
        size += len(content or b"")
        if size > 8 << 20 or end == len(contents):
            part = rows[start:end]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests[start:end], pa.binary()), pa.array(contents[start:end], pa.binary())]
                + [pa.array([r[k] for r in part], pa.int64()) for k in range(3)],
                names=["digest", "content", "n", "points", "doc_id"],
            )
            start, size = end, 0


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of documents, copies in the task's input merged while they fit."""
    table = Table()
    for batch in batches:
        texts = batch.column("text")
        points = pa.compute.utf8_length(texts).to_pylist()
        for doc_id, content, n in zip(batch.column("doc_id").to_pylist(), _normal(texts), points):
            digest = hashlib.sha256(content).digest()
            if not table.add(digest, content, 1, n or 0, doc_id, LOCAL_BYTES):
                yield from _record_batches(table.digests, table.contents, table.rows)
                table = Table()
                table.add(digest, content, 1, n or 0, doc_id, LOCAL_BYTES)
    yield from _record_batches(table.digests, table.contents, table.rows)


def _bucket(room: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes (content null) of what fits the table; the other records as they came."""
        table = Table()
        for batch in batches:
            left: tuple[list, list, list] = ([], [], [])
            for digest, content, n, points, doc_id in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not table.add(digest, content, n, points, doc_id, room):
                    left[0].append(digest)
                    left[1].append(content)
                    left[2].append([n, points, doc_id])
            yield from _record_batches(*left)
        yield from _record_batches(table.digests, [None] * len(table.rows), table.rows)

    return work


def classes(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``(digest, keep_id, group_size)``: one row per distinct normalised text."""
    records = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_collapse, _RECORD)
    done = None
    level = 0
    while True:
        deal = [F.xxhash64("digest", F.lit(level))]
        if level:  # more buckets than before, whatever the session's number of partitions
            buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4**level
            dealt = records.repartition(buckets, *deal)
        else:
            dealt = records.repartition(*deal)
        out = stage(dealt.mapInArrow(_bucket(table_bytes), _RECORD))
        settled = out.where("content IS NULL").select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
        done = settled if done is None else done.unionByName(settled)
        records = out.where("content IS NOT NULL")
        if records.isEmpty():
            return done
        level += 1


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(content).digest() for content in _normal(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), pa.array(digests, pa.binary())], names=["doc_id", "print", "digest"])


def members(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``(doc_id, digest, keep_id, group_size, kept)``, one row per row of ``docs``."""
    return _members(docs, table_bytes).drop("print")


def _members(docs: DataFrame, table_bytes: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("print"), "text")
    rows = rows.mapInArrow(_digests, "doc_id bigint, print bigint, digest binary")
    joined = spread_join(rows, classes(docs, table_bytes), "digest", "group_size", "doc_id")
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicate(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` without the documents whose text another one stands for."""
    lost = _members(docs, table_bytes).where("NOT kept").select("doc_id", "print")
    kept = without(docs, stage(lost.distinct()))  # read by both parts below
    # rows without an id that are left are all of their class, of which one stays
    content = F.translate(F.coalesce("text", F.lit("")), SPACES, "")
    kind, nth = spare(docs.columns, "_llm_class", "_llm_nth")
    longest = Window.partitionBy(kind).orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))), "text")
    single = kept.where("doc_id IS NULL").withColumn(kind, F.sha2(content, 256)).withColumn(nth, F.row_number().over(longest))
    return kept.where("doc_id IS NOT NULL").unionByName(single.where(F.col(nth) == 1).select(*docs.columns))


def report(docs: DataFrame) -> DataFrame:
    return members(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM d WINDOW w AS (PARTITION BY content ORDER BY points DESC, doc_id)
"""
