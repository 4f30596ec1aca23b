"""Repair of a conversation's structure by cheapest edits, streamed over its turns.

A conversation is right when the initials of its roles are ``(s?(ua)+)?``: an optional system turn, then user and
assistant by turns, or nothing. Keeping a turn costs 0, giving it the role user or assistant 2, deleting it 3, inserting
an empty user or assistant turn 2. Blank and repeated turns must go, and a truncated one that stays costs 1 more. Of the
cheapest edits those are taken whose initials (``K R D I``, in order) come first in ASCII.

Turns are dealt by conversation and sorted by turn within the partition, and a dynamic program runs along them. Its
state after a turn is small whatever came before: for each of the four last roles (none yet, s, u, a) the cost over the
least one, and the order of the four edit strings; a role that can no longer win is left out. So there are few states,
each step is looked up in a table of (state, kind of turn), and a batch only hands the state on to the next. Each turn leaves a backpointer of four bytes: for each last role the role
before, the number of insertions and the edit.

A conversation of up to ``HELD_ROWS`` turns and ``HELD_CHARS`` characters waits in the task until its end is known. A
longer one lets go of its texts and spills its backpointers, in pieces, as rows of the written result, which lies in the
shared folder and not on the executor; then a second pass reads the pieces from the last to the first and finds the
edits of each, and a third one, dealt by (conversation, piece), applies them to the turns. Apart from the edits of a
conversation as one string, which is a result, no task holds more than a piece.

``damage`` breaks well-formed conversations reproducibly, to try the repair on.

Defined cases: a null role or text is one space, so such a text is blank; turns come by turn, nulls first, ties by role
and text; rows that say the same are repeated turns, of which the first stays; a role's initial is its first character,
and one that is not s, u or a, or an empty role, never stays as it is; null ids make one conversation; an empty table
gives no rows; extra columns are ignored. A conversation without turns is right and empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variform.llm.common import SPACES, stage

#: Turns and characters of a conversation that a task holds, and turns in a piece of a longer one.
HELD_ROWS = 16_384
HELD_CHARS = 8 << 20

# last role: none yet, system, user, assistant
NONE, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
#: The role that an insertion or a new role gives after each last role, and the roles that may stay after it.
NEXT = (USER, USER, ASSISTANT, USER)
MAY_FOLLOW = ((SYSTEM, USER), (USER,), (ASSISTANT,), (USER,))
ROLES = (None, None, "user", "assistant")
#: Insertions that lead from each last role to the end of a right conversation.
TO_END = (0, 2, 1, 0)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What it costs at most to do from the second role all that can be done from the first: an insertion to get to the same
#: next role, a deletion for a system turn that could have stayed, a closing pair.
INSTEAD = {
    NONE: {SYSTEM: 4, USER: 5, ASSISTANT: 3},
    SYSTEM: {NONE: 0, USER: 2, ASSISTANT: 0},
    USER: {NONE: 2, SYSTEM: 2, ASSISTANT: 2},
    ASSISTANT: {NONE: 0, SYSTEM: 4, USER: 2},
}
EDITS = "DKR"
UNREACHED = 255

_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# --- the dynamic program ------------------------------------------------------------------------


def _walk(last: int, inserts: int) -> int:
    for _ in range(inserts):
        last = NEXT[last]
    return last


class Program:
    """Steps of the dynamic program. A profile has, for each last role, (cost over the least, place in ASCII order)."""

    def __init__(self):
        self.start = ((0, 0), None, None, None)
        self.steps: dict[tuple, tuple] = {}

    def step(self, profile: tuple, initial: int, must_go: bool, truncated: bool) -> tuple[tuple, int, int]:
        """The profile after a turn, what the least cost grew by, and the backpointers in four bytes."""
        key = (profile, initial, must_go, truncated)
        if (known := self.steps.get(key)) is None:
            known = self.steps[key] = self._step(*key)
        return known

    def _step(self, profile, initial, must_go, truncated):
        best: list[tuple | None] = [None] * 4
        for before, entry in enumerate(profile):
            for inserts in range(3) if entry else ():  # two lead to every role that can follow
                at, cost = _walk(before, inserts), entry[0] + INSERT * inserts
                options = [("D", at, cost + DELETE)]
                if not must_go:
                    cost += TRUNCATED * truncated
                    options.append(("R", NEXT[at], cost + REROLE))
                    if initial in MAY_FOLLOW[at]:
                        options.append(("K", initial, cost))
                for edit, last, spent in options:
                    # strings that end with the same number of turns differ before either ends
                    found = (spent, entry[1], "I" * inserts + edit, before)
                    if best[last] is None or found < best[last]:
                        best[last] = found
        # no cheapest edits come from a role that another one beats at any end; so profiles are few
        lost = [bool(b) and any(best[q] and b[0] > best[q][0] + more for q, more in INSTEAD[last].items()) for last, b in enumerate(best)]
        best = [None if gone else b for b, gone in zip(best, lost)]
        least = min(b[0] for b in best if b)
        order = sorted((b[1], b[2]) for b in best if b)
        after = tuple(b and (b[0] - least, order.index((b[1], b[2]))) for b in best)
        back = [b[3] | (len(b[2]) - 1) << 2 | EDITS.index(b[2][-1]) << 4 if b else UNREACHED for b in best]
        return after, least, int.from_bytes(bytes(back), "little")

    @staticmethod
    def end(profile: tuple) -> tuple[int, int]:
        """Cost over the least one up to here, and the last role of the best edits before the closing insertions."""
        cost, _, last = min((e[0] + INSERT * TO_END[last], e[1], last) for last, e in enumerate(profile) if e)
        return cost, last


def backtrack(back: list[int] | np.ndarray, last: int) -> tuple[str, int]:
    """Edits of a run of turns that ends with the role ``last``, and the role it began after."""
    edits = []
    for pointers in reversed(back):
        pointer = int(pointers) >> 8 * last & 255
        last = pointer & 3
        edits.append("I" * (pointer >> 2 & 3) + EDITS[pointer >> 4])
    return "".join(reversed(edits)), last


def apply(edits: str, last: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str], int]:
    """Roles and texts as edited from the role ``last`` on, and the last role then."""
    out_roles, out_texts, at = [], [], 0
    for edit in edits:
        if edit != "D":
            role, text = "", ""
            if edit == "K":
                role, text = roles[at], texts[at]
                last = INITIALS.index(role[0]) + 1
            else:
                last = NEXT[last]
                role, text = ROLES[last], texts[at] if edit == "R" else ""
            out_roles.append(role)
            out_texts.append(text)
        at += edit != "I"
    return out_roles, out_texts, last


# --- streaming ----------------------------------------------------------------------------------

_FOUND = (
    "kind int, conv_id bigint, piece bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, roles array<string>, texts array<string>, pointers binary, last int"
)
WHOLE, PIECE, GIANT = range(3)


class _Conversation:
    """What a task carries from turn to turn and from batch to batch."""

    def __init__(self, conv_id, program: Program, rows: int, chars: int):
        self.conv_id, self.program, self.rows, self.chars = conv_id, program, rows, chars
        self.profile, self.cost = program.start, 0
        self.back: list[int] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.held, self.pieces, self.giant = 0, 0, False
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def add(self, turn, role, text, blank, again, cut) -> Iterator[dict]:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = INITIALS.find(role[0]) + 1 if role else 0
        if self.before is not None:
            self.illegal += initial not in ((), (USER,), (ASSISTANT,), (USER,))[self.before]
        self.before = initial
        # the first fault counts
        again = again and not blank
        cut = cut and not blank and not again
        self.blank += blank
        self.duplicate += again
        self.truncated += cut
        self.profile, grown, pointers = self.program.step(self.profile, initial, blank or again, cut)
        self.cost += grown
        self.back.append(pointers)
        if not self.giant:
            self.roles.append(role)
            self.texts.append(text)
            self.held += len(text) + len(role)
            if len(self.back) > self.rows or self.held > self.chars:
                self.giant = True
                self.roles, self.texts = [], []
        if self.giant:
            yield from self._spill(self.rows)

    def _spill(self, least: int) -> Iterator[dict]:
        while len(self.back) >= least:
            part, self.back = self.back[: self.rows], self.back[self.rows :]
            yield {"kind": PIECE, "conv_id": self.conv_id, "piece": self.pieces, "pointers": np.array(part, "<u4").tobytes()}
            self.pieces += 1

    def end(self) -> Iterator[dict]:
        more, last = self.program.end(self.profile)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        found = dict(zip(_COUNTS, (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + more)))
        if self.giant:
            yield from self._spill(1)
            yield {"kind": GIANT, "conv_id": self.conv_id, "piece": self.pieces, "last": last, **found}
            return
        audit = backtrack(self.back, last)[0] + "I" * TO_END[last]
        roles, texts, _ = apply(audit, NONE, self.roles, self.texts)
        yield {"kind": WHOLE, "conv_id": self.conv_id, "piece": 0, "audit": audit, "roles": roles, "texts": texts, **found}


def _frames(rows: Iterator[dict], schema: str) -> Iterator[pd.DataFrame]:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(map(len, row.get("texts") or ())) + len(row.get("pointers") or b"")
        if size > 8 << 20:
            yield _frame(held, names)
            held, size = [], 0
    if held:
        yield _frame(held, names)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series([row.get(name) for row in rows], dtype=object) for name in names})


def _stream(rows: int, chars: int):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program = Program()

        def found() -> Iterator[dict]:
            at: _Conversation | None = None
            for frame in frames:
                columns = [frame[c].tolist() for c in ("conv_id", "turn", "role", "text", "blank", "nth", "cut")]
                for conv_id, turn, role, text, blank, nth, cut in zip(*columns):
                    conv_id, turn = _number(conv_id), _number(turn)
                    if at is None or at.conv_id != conv_id:
                        if at is not None:
                            yield from at.end()
                        at = _Conversation(conv_id, program, rows, chars)
                    if nth:
                        yield from at.add(turn, role, text, blank, nth > 1, cut)
            if at is not None:
                yield from at.end()

        yield from _frames(found(), _FOUND)

    return work


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _as_text(*names: str) -> dict[str, Column]:
    """Numbers that may be null, for pandas, which would make them floating."""
    return {name: F.col(name).cast("string") for name in names}


def _backwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of each piece, from the last piece to the first; the row of the conversation itself comes before them."""

    def found() -> Iterator[dict]:
        last = NONE
        for frame in frames:
            for kind, conv_id, piece, pointers, end in zip(*(frame[c].tolist() for c in ("kind", "conv_id", "piece", "pointers", "last"))):
                if kind == GIANT:
                    last = int(end)
                    yield {"conv_id": _number(conv_id), "piece": piece, "edits": "I" * TO_END[last], "start": last}
                else:
                    edits, last = backtrack(np.frombuffer(pointers, "<u4"), last)
                    yield {"conv_id": _number(conv_id), "piece": piece, "edits": edits, "start": last}

    yield from _frames(found(), _EDITED)


_EDITED = "conv_id bigint, piece bigint, edits string, start int"
_TURNS = "conv_id bigint, piece bigint, no bigint, role string, text string"


def _apply_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns sorted by piece, each piece's edits in front of them."""

    def found() -> Iterator[dict]:
        edits, at, last, no, conv_id, piece = "", 0, NONE, 0, None, None

        def made(role, text):
            nonlocal no
            no += 1
            return {"conv_id": conv_id, "piece": piece, "no": no - 1, "role": role, "text": text, "texts": (text,)}

        for frame in frames:
            for c, p, given, start, role, text in zip(*(frame[c].tolist() for c in ("conv_id", "piece", "edits", "start", "role", "text"))):
                if given is not None:
                    edits, at, last, no, conv_id, piece = given, 0, int(start), 0, _number(c), p
                    if "K" in edits or "R" in edits or "D" in edits:
                        continue
                while at < len(edits):  # insertions, and the edit of this turn
                    edit = edits[at]
                    at += 1
                    roles, texts, last = apply(edit, last, [role], [text])
                    for r, t in zip(roles, texts):
                        yield made(r, t)
                    if edit != "I":
                        break

    yield from _frames(found(), _TURNS)


# --- over tables --------------------------------------------------------------------------------


def _prepared(rows: DataFrame, gone: str | None = None) -> DataFrame:
    """Turns with the marks that the program reads; ``nth`` numbers those that say the same in one conversation.

    Rows true in the column ``gone`` have number 0 and only keep their conversation in the result.
    """
    space = F.lit(" ")
    no_turn = F.col(gone) if gone else F.lit(False)
    rows = rows.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.when(~no_turn, F.coalesce("role", space)).alias("role"),
        F.when(~no_turn, F.coalesce("text", space)).alias("text"),
        no_turn.alias("gone"),
    )
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    # one exchange: the window's keys begin with the key that rows are dealt by
    dealt = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")
    nth = F.when(F.col("gone"), 0).otherwise(F.row_number().over(same))
    return dealt.select("conv_id", "turn", "role", "text", (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"), nth.alias("nth"))


@dataclass
class Repaired:
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts: conversations that a task could hold.
    whole: DataFrame
    #: The same without roles and texts for longer ones, and their turns: conv_id, piece, no, role, text. None if there are none.
    long: tuple[DataFrame, DataFrame] | None

    def audits(self) -> DataFrame:
        """One row per conversation, without its turns."""
        short = self.whole.drop("roles", "texts")
        return short if self.long is None else short.unionByName(self.long[0])

    def turns(self) -> DataFrame:
        """``(conv_id, piece, no, role, text)``: every turn of the repaired conversations, in the order of piece and no."""
        each = self.whole.select("conv_id", F.lit(0).cast("bigint").alias("piece"), F.posexplode(F.arrays_zip("roles", "texts")).alias("no", "t"))
        each = each.select("conv_id", "piece", F.col("no").cast("bigint").alias("no"), F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))
        return each if self.long is None else each.unionByName(self.long[1])


def repair(rows: DataFrame, gone: str | None = None, held_rows: int = HELD_ROWS, held_chars: int = HELD_CHARS) -> Repaired:
    """Faults, cheapest edits and repaired turns of ``rows(conv_id, turn, role, text)``.

    ``gone`` names a boolean column, without nulls, of rows that are no turns but keep their conversation in the result.
    """
    order = ["conv_id", "turn", "role", "text", "nth"]
    sorted_turns = _prepared(rows, gone).sortWithinPartitions(*order).withColumns(_as_text("conv_id", "turn"))
    found = stage(sorted_turns.mapInPandas(_stream(held_rows, held_chars), _FOUND))
    whole = found.where(F.col("kind") == WHOLE).select("conv_id", *_COUNTS, "audit", "roles", "texts")
    giants = found.where(F.col("kind") == GIANT).select("conv_id", *_COUNTS)
    if giants.isEmpty():
        return Repaired(whole, None)
    pieces = found.where(F.col("kind") != WHOLE).select("kind", "conv_id", "piece", "pointers", "last")
    last_first = pieces.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece")).withColumns(_as_text("conv_id"))
    edits = stage(last_first.mapInPandas(_backwards, _EDITED))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "edits"))), lambda p: p["edits"]), "")
    of = edits.groupBy(F.col("conv_id").alias("of")).agg(joined.alias("audit"))
    audits = giants.join(of, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    # turns of the long conversations, numbered as the stream met them
    ids = giants.select(F.col("conv_id").alias("of"))
    turns = _prepared(rows.join(ids, F.col("conv_id").cast("bigint").eqNullSafe(ids["of"]), "left_semi"), gone).where("nth > 0")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order[1:])) - 1
    turns = turns.withColumn("at", number.cast("bigint")).withColumn("piece", F.floor(F.col("at") / held_rows))
    none = F.lit(None)
    given = edits.select("conv_id", "piece", F.lit(-1).cast("bigint").alias("at"), "edits", "start", none.cast("string").alias("role"), none.cast("string").alias("text"))
    both = given.unionByName(turns.select("conv_id", "piece", "at", none.cast("string").alias("edits"), none.cast("int").alias("start"), "role", "text"))
    by_piece = both.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "at").withColumns(_as_text("conv_id"))
    return Repaired(whole, (audits, stage(by_piece.mapInPandas(_apply_pieces, _TURNS))))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` broken by crc32(``conv_id:turn``) % 20, nulls one space: 0 is marked ``gone``, 1 empties the text, 2 takes
    its full stops, exclamation and question marks, 3 repeats the row, 4 makes its role user."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation's lines, fed turn by turn."""
    at, digest, names = None, None, ["of", "repaired_sha256"]
    for frame in frames:
        for conv_id, role, text in zip(*(frame[c].tolist() for c in ("conv_id", "role", "text"))):
            conv_id = _number(conv_id)
            if digest is None or conv_id != at:
                if digest is not None:
                    yield _frame([dict(zip(names, (at, digest.hexdigest())))], names)
                at, digest = conv_id, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if digest is not None:
        yield _frame([dict(zip(names, (at, digest.hexdigest())))], names)


def report(rows: DataFrame, held_rows: int = HELD_ROWS, held_chars: int = HELD_CHARS) -> DataFrame:
    """The repair of damaged ``rows`` by its contract: audits, and the digest of the repaired ``role:text`` lines."""

    def line(role: Column, text: Column) -> Column:
        return F.concat(role, F.lit(":"), text)

    done = repair(damage(rows), "gone", held_rows, held_chars)
    digest = F.sha2(F.array_join(F.zip_with("roles", "texts", line), "\n"), 256).alias("repaired_sha256")
    short = done.whole.select("conv_id", *_COUNTS, "audit", digest)
    if done.long is None:
        return short
    audits, turns = done.long
    sorted_turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "no").withColumns(_as_text("conv_id"))
    named = sorted_turns.mapInPandas(_hashes, "of bigint, repaired_sha256 string")
    # a conversation of which nothing stays has no turns
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    long = audits.join(named, F.col("conv_id").eqNullSafe(F.col("of")), "left").select("conv_id", *_COUNTS, "audit", digest)
    return short.unionByName(long)


ORACLE = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
h AS (
  SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, tab),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (
  SELECT *, regexp_replace(text, '[ 	-
]+$', '') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
    substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM o),
x AS (
  SELECT conv_id, turn, i, role, text, initial, previous, body = '' AS blank, body <> '' AND nth > 1 AS duplicate,
    body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM f),
walk(st, j, mid, ins) AS (VALUES
  ('', 0, '', ''), ('', 1, 'u', 'user:' || chr(10)), ('', 2, 'a', 'user:' || chr(10) || 'assistant:' || chr(10)),
  ('s', 0, 's', ''), ('s', 1, 'u', 'user:' || chr(10)), ('s', 2, 'a', 'user:' || chr(10) || 'assistant:' || chr(10)),
  ('u', 0, 'u', ''), ('u', 1, 'a', 'assistant:' || chr(10)), ('u', 2, 'u', 'assistant:' || chr(10) || 'user:' || chr(10)),
  ('a', 0, 'a', ''), ('a', 1, 'u', 'user:' || chr(10)), ('a', 2, 'a', 'user:' || chr(10) || 'assistant:' || chr(10))),
ops(op) AS (VALUES ('D'), ('R'), ('K')),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, st, cost, audit, lines FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) AS best FROM (
      SELECT dp.conv_id, x.i,
        CASE op WHEN 'D' THEN mid WHEN 'K' THEN initial ELSE CASE WHEN mid = 'u' THEN 'a' ELSE 'u' END END AS st,
        dp.cost + 2 * j + CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN op <> 'D' AND truncated THEN 1 ELSE 0 END AS cost,
        audit || repeat('I', j) || op AS audit,
        lines || ins || CASE op WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10)
          ELSE CASE WHEN mid = 'u' THEN 'assistant' ELSE 'user' END || ':' || text || chr(10) END AS lines
      FROM dp JOIN x ON x.conv_id = dp.conv_id AND x.i = dp.i + 1 JOIN walk ON walk.st = dp.st CROSS JOIN ops
      WHERE op = 'D' OR (NOT blank AND NOT duplicate AND (op = 'R' OR (initial = 's' AND mid = '') OR (initial = 'u' AND mid IN ('', 's', 'a')) OR (initial = 'a' AND mid = 'u')))))
  WHERE best = 1),
n AS (
  SELECT c.conv_id, count(x.i) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
    count(*) FILTER (WHERE previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN x USING (conv_id) GROUP BY c.conv_id),
e AS (
  SELECT n.conv_id, n.gaps, n.blank, n.duplicate, n.truncated, n.illegal,
    cost + CASE st WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS total, audit || CASE st WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS edits,
    lines || CASE st WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 'u' THEN 'assistant:' || chr(10) ELSE '' END AS lines
  FROM n JOIN dp ON dp.conv_id = n.conv_id AND dp.i = n.n)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(total AS BIGINT) AS cost, edits AS audit,
  sha256(CASE WHEN lines = '' THEN '' ELSE left(lines, length(lines) - 1) END) AS repaired_sha256
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY total, edits) AS best FROM e) WHERE best = 1
"""
