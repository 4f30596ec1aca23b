"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds a whitespace marker after another character (checked when it is loaded), so no merge crosses
the start of a run of markers: a text falls into chunks, each a run of markers and what follows up to the next run, and
its ids are those of its chunks one after the other. The same holds for decoding, where a chunk begins at a piece that
begins with a marker.

A task keeps a table of the distinct chunks it has met, numbered. Of a run of documents it writes down each text as the
numbers of its chunks by position, segments (or decodes) the chunks that are new to the table, each once and all in one
call, and joins the results back to the documents by position. A table that holds ``TABLE_CHUNKS`` chunks or
``TABLE_CHARS`` characters starts over, so memory stays bounded whatever the corpus; nothing is shuffled, and a lost
task costs its own documents. One table for the whole corpus would save little more and cost a shuffle of three times
the input (README).

The model is read where the query starts and travels with the tasks.

Defined cases: null counts as empty and has no ids, and no ids decode to the empty text; repeated rows and ids are
encoded alike, one row for each; null ids stay null; very long texts are whole, and
texts without any white space are one chunk; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Distinct chunks, and characters of them, after which a task's table starts over.
TABLE_CHUNKS = 400_000
TABLE_CHARS = 16 << 20
#: Characters (or ids) of the documents that are joined at once. A document stays whole.
RUN_CHARS = 4 << 20

_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


# --- the model ----------------------------------------------------------------------------------


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    """The processor of a serialized model; an error if its texts do not fall into chunks."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for k in range(sp.get_piece_size()):
        piece = sp.id_to_piece(k)
        if re.search(f"[^{MARK}]{MARK}", piece):
            raise ValueError(f"piece {k} crosses a whitespace marker: {piece!r}")
    probe = "  a  ﬁ ½　x\tÉ "
    if sp.normalize(probe) != marked(probe):
        raise ValueError("the model does more to a text than to mark its spaces and to put a marker in front")
    return sp


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def chunks_of(text: str | None) -> list[str]:
    return _CHUNKS.findall(marked(text)) if text else []


def segment(sp: sentencepiece.SentencePieceProcessor, chunks: list[str]) -> list[list[int]]:
    """Ids of each chunk. The library puts a chunk's first marker in front itself, but not of an empty text."""
    alone = [sp.piece_to_id(MARK)]
    return [ids or alone for ids in sp.encode([c[1:] for c in chunks], num_threads=1)]


def _id_chunks(sp: sentencepiece.SentencePieceProcessor) -> Callable[[list[int] | None], list[bytes]]:
    starts = np.array([sp.id_to_piece(k).startswith(MARK) for k in range(sp.get_piece_size())])
    silent = np.array([sp.is_control(k) for k in range(sp.get_piece_size())])

    def cut(ids: list[int] | None) -> list[bytes]:
        ids = np.asarray(ids or [], "<i4")
        if not len(ids):
            return []
        # control pieces at the front are no beginning of the text yet
        begun = int(np.argmin(silent[ids])) if not silent[ids].all() else len(ids)
        at = np.flatnonzero(starts[ids])
        at = at[at > begun]
        return [part.tobytes() for part in np.split(ids, at)]

    return cut


# --- through the table of chunks ----------------------------------------------------------------


class _Numbers(dict):
    def __missing__(self, chunk):
        self[chunk] = n = len(self)
        return n


class Table:
    """Distinct chunks by number, and what ``convert`` makes of each: columns of results, one entry per chunk."""

    def __init__(self, convert: Callable[[list], list[pa.Array]], kinds: list[pa.DataType]):
        self.convert, self.kinds = convert, kinds
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.chars = 0
        self.results = [pa.array([], kind) for kind in self.kinds]

    def code(self, chunks: list) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, chunks), np.int64, len(chunks))

    def settle(self) -> list[pa.Array]:
        """Results of all chunks, the new ones converted."""
        known = len(self.results[0])
        new = list(islice(self.numbers, known, None))
        if new:
            self.chars += sum(map(len, new))
            self.results = [pa.concat_arrays([old, made.cast(old.type)]) for old, made in zip(self.results, self.convert(new))]
        return self.results

    def full(self) -> bool:
        return len(self.numbers) >= TABLE_CHUNKS or self.chars >= TABLE_CHARS


def _through(
    rows: DataFrame,
    split: Callable[[], Callable],
    convert: Callable[[], Callable[[list], list[pa.Array]]],
    results: dict[str, tuple[str, pa.DataType]],
    joined: dict[str, Callable[[pa.Array, list[np.ndarray]], pa.Array]],
    run_chars: int,
) -> DataFrame:
    """``(doc_id, results..)`` of ``rows(doc_id, value)``, results of a value's chunks joined by position."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, table = split(), Table(convert(), [kind for _, kind in results.values()])

        def join(ids: list, codes: list[np.ndarray]) -> pa.RecordBatch:
            found = table.settle()
            columns = [joined[name](of, codes) for name, of in zip(results, found)]
            if table.full():
                table.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["doc_id", *results])

        for batch in batches:
            ids, codes, size = [], [], 0
            for doc_id, value in zip(batch.column(0), batch.column(1)):
                value = value.as_py()
                ids.append(doc_id.as_py())
                codes.append(table.code(cut(value)))
                size += len(value or ())
                if size >= run_chars:
                    yield join(ids, codes)
                    ids, codes, size = [], [], 0
            if ids:
                yield join(ids, codes)

    made = ", ".join(f"{name} {kind}" for name, (kind, _) in results.items())
    return rows.mapInArrow(work, f"doc_id bigint, {made}")


def _joined_ids(of: pa.ListArray, codes: list[np.ndarray]) -> pa.Array:
    lengths = np.diff(of.offsets.to_numpy())
    ends = np.cumsum([0, *(int(lengths[c].sum()) for c in codes)])
    flat = of.take(pa.array(np.concatenate(codes))).flatten()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _joined_text(of: pa.Array, codes: list[np.ndarray]) -> pa.Array:
    """What one chunk's text lost is the marker it begins with; the first one's is the marker put in front of the whole."""
    used, place = np.unique(np.concatenate(codes), return_inverse=True)
    texts = of.take(pa.array(used)).to_pylist()
    ends = np.cumsum([len(c) for c in codes])
    return pa.array([" ".join(map(texts.__getitem__, c.tolist())) for c in np.split(place, ends[:-1])], pa.string())


_IDS, _TEXT = pa.list_(pa.int32()), pa.string()


def encode(docs: DataFrame, model: bytes, run_chars: int = RUN_CHARS) -> DataFrame:
    """``(doc_id, ids, decoded)`` per row of ``docs(doc_id, text)``: the ids of the text, and the text that they decode to."""
    load(model)

    def split():
        return chunks_of

    def convert():
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)

        def of(chunks: list[str]) -> list[pa.Array]:
            ids = segment(sp, chunks)
            return [pa.array(ids, _IDS), pa.array(sp.decode(ids, num_threads=1), _TEXT)]

        return of

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    results = {"ids": ("array<int>", _IDS), "decoded": ("string", _TEXT)}
    return _through(rows, split, convert, results, {"ids": _joined_ids, "decoded": _joined_text}, run_chars)


def decode(rows: DataFrame, model: bytes, run_chars: int = RUN_CHARS) -> DataFrame:
    """``(doc_id, decoded)`` per row of ``rows(doc_id, ids)``, whatever made the ids; null elements are left out."""
    load(model)

    def split():
        return _id_chunks(sentencepiece.SentencePieceProcessor(model_proto=model))

    def convert():
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda chunks: [pa.array(sp.decode([np.frombuffer(c, "<i4").tolist() for c in chunks], num_threads=1), _TEXT)]

    ids = rows.select(F.col("doc_id").cast("bigint"), F.array_compact(F.col("ids").cast("array<int>")).alias("ids"))
    return _through(ids, split, convert, {"decoded": ("string", _TEXT)}, {"decoded": _joined_text}, run_chars)


def report(docs: DataFrame, model: bytes) -> DataFrame:
    """The digests of ``encode`` by its contract."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encode(docs, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
