"""Token counts that follow edits.

A document is cut into pre-tokens, which a byte-level BPE vocabulary encodes independently, so its count is a sum over
them. A segment tree over leaves of consecutive pre-tokens keeps sums of characters and tokens. An edit finds its place
by descending the tree, re-reads pre-tokens from just before the change (a pre-token ends by what follows within two
characters) until a boundary meets an old one behind the change, and updates the sums of the leaves it touched.

``recount`` works on rows with a column ``edits``, an array of (start, stop, text) in code points, applied in order, each
to the text as the ones before left it. It returns the counts before and after, how many characters were read again,
and, on request, the edited text with its leaves.

Defined cases: null text is empty and stays null; null or no edits change nothing; positions beyond the text mean its
end, reversed ones are empty ranges; a null replacement deletes; repeated rows are counted alike; very long texts are
whole; an empty table gives no rows; extra columns are left alone, those named as results are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: the pre-token pattern of the public vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens in a leaf as it is built.
LEAF = 32
#: How far behind its end a pre-token looks to know that it ends.
BEHIND = 2
#: Pre-tokens a worker remembers before it starts over.
MEMO = 400_000

EDITS = "array<struct<start: int, stop: int, text: string>>"
_RESULTS = "tokens_before bigint, tokens_after bigint, n_edits bigint, reread_chars bigint"


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("pretokens", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.memo: dict[str, int] = {}

    def count(self, pieces: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for piece in pieces:
            n = memo.get(piece)
            if n is None:
                n = len(self.encoding.encode_ordinary(piece))
                if len(piece) <= 64:
                    memo[piece] = n
            out.append(n)
        return out


class Document:
    """A text and its segment tree. Leaf k holds lists of the lengths and the token counts of its pre-tokens."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.reread = text, counter, 0
        pieces = counter.pattern.findall(text)
        lengths, tokens = list(map(len, pieces)), counter.count(pieces)
        self.lengths = [lengths[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self.tokens = [tokens[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self.total = sum(tokens)
        self.width = 0  # of the tree; built by the first edit

    def _build(self) -> None:
        self.width = 1
        while self.width < len(self.lengths):
            self.width *= 2
        self.chars, self.sums = [0] * 2 * self.width, [0] * 2 * self.width
        for k in range(len(self.lengths)):
            self.chars[self.width + k], self.sums[self.width + k] = sum(self.lengths[k]), sum(self.tokens[k])
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf with the character ``at`` and where the leaf starts; the last filled leaf for the end of the text."""
        node, start = 1, 0
        at = min(at, max(self.chars[1] - 1, 0))
        while node < self.width:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def _put(self, leaf: int, lengths: list[int], tokens: list[int]) -> None:
        self.lengths[leaf], self.tokens[leaf] = lengths, tokens
        node = self.width + leaf
        self.chars[node], self.sums[node] = sum(lengths), sum(tokens)
        while node > 1:
            node //= 2
            self._sum(node)

    def edit(self, start: int, stop: int, text: str) -> None:
        if not self.width:
            self._build()
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        leaf, at = self._leaf(max(start - BEHIND, 0))
        if leaf >= len(self.lengths):
            leaf, at = 0, 0
        # the first pre-token that may depend on the change
        k = 0
        while k < len(self.lengths[leaf]) and at + self.lengths[leaf][k] + BEHIND <= start:
            at += self.lengths[leaf][k]
            k += 1
        first, kept = leaf, (self.lengths[leaf][:k], self.tokens[leaf][:k])
        self.text = self.text[:start] + text + self.text[stop:]
        grown = len(text) - (stop - start)
        old, new, pieces = at, at, []
        for found in self.counter.pattern.finditer(self.text, at):
            # walk the old boundaries up to the new one
            while old + grown < new or old < stop:
                if k < len(self.lengths[leaf]):
                    old += self.lengths[leaf][k]
                    k += 1
                elif leaf + 1 < len(self.lengths):
                    leaf, k = leaf + 1, 0
                else:
                    break
            if old >= stop and old + grown == new:
                break
            pieces.append(found[0])
            new = found.end()
        else:
            leaf = len(self.lengths) - 1
            k = len(self.lengths[leaf])
        self.reread += new - at
        rest = self.lengths[leaf][k:], self.tokens[leaf][k:]
        added = list(map(len, pieces)), self.counter.count(pieces)
        for between in range(first + 1, leaf + 1):
            self._put(between, [], [])
        if leaf == first:
            added = added[0] + rest[0], added[1] + rest[1]
        else:
            self._put(leaf, *rest)
        self._put(first, kept[0] + added[0], kept[1] + added[1])
        self.total = self.sums[1]


def recount(docs: DataFrame, vocabulary: str, keep: bool = False) -> DataFrame:
    """``docs(.., text, edits)`` with token counts before and after; ``keep`` adds ``edited`` and its ``leaves``.

    ``vocabulary`` is the path, on every machine, of a public rank file. ``leaves`` holds (characters, tokens) per leaf.
    """
    schema = _RESULTS + (", edited string, leaves array<struct<chars: int, tokens: int>>" if keep else "")
    names = ["tokens_before", "tokens_after", "n_edits", "reread_chars"] + (["edited", "leaves"] if keep else [])
    docs = docs.select([c for c in docs.columns if c not in names])
    carried = [c for c in docs.columns if c not in ("text", "edits")]
    sent = docs.select(*carried, "text", "edits")
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.select(*carried).schema), schema])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for text, edits in zip(batch.column("text"), batch.column("edits")):
                text, edits = text.as_py(), edits.as_py() or []
                doc = Document(text or "", counter)
                before = doc.total
                for e in edits:
                    if e is not None:
                        doc.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                made = [before, doc.total, len(edits), doc.reread]
                if keep:
                    leaves = [{"chars": sum(a), "tokens": sum(b)} for a, b in zip(doc.lengths, doc.tokens) if a]
                    made += [None if text is None else doc.text, leaves]
                for column, value in zip(rows, made):
                    column.append(value)
            types = [pa.int64()] * 4 + ([pa.string(), pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))] if keep else [])
            made = [pa.array(column, kind) for column, kind in zip(rows, types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *made], names=[*carried, *names])

    return sent.mapInArrow(work, out_schema)


def provenance_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with the edits of a usual last step before tokenising: e-mail addresses become a mark, and a line that
    names the source goes in front."""
    text = F.coalesce("text", F.lit(""))

    def spans(pattern: str, mark: str):
        gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(EDITS).alias("edits"))
        # from the first to the last; what an earlier mark has grown or shrunk shifts the later ones
        walk = F.aggregate(
            F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")),
            start,
            lambda s, x: F.struct(
                (s["at"] + F.char_length(x["gap"]) + len(mark)).alias("at"),
                F.concat(
                    s["edits"],
                    F.array(
                        F.struct(
                            (s["at"] + F.char_length(x["gap"])).alias("start"),
                            (s["at"] + F.char_length(x["gap"]) + F.char_length(x["hit"])).alias("stop"),
                            F.lit(mark).alias("text"),
                        )
                    ),
                ).alias("edits"),
            ),
            lambda s: s["edits"],
        )
        return walk

    email = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
    masked = F.when(text.contains("@"), spans(email, "[EMAIL]")).otherwise(F.array().cast(EDITS))
    head = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.concat(F.lit("source: "), F.coalesce("source", F.lit("unknown")), F.lit("\n")).alias("text")))
    return docs.withColumn("edits", F.concat(masked, head).cast(EDITS))
