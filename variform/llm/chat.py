"""Chat formatting from a declarative template.

A template names, for each role, the marks around a turn and whether its text is trained on, the transitions of the
finite-state machine that says which role may follow which, and the control strings that may not occur in a text.
``format_chats`` folds the machine over the roles of a conversation, escapes control strings reversibly and returns
the segments with their loss flags; ``read_back`` recovers the turns from the formatted text alone.

Everything is DataFrame functions. A conversation is one text, so its turns meet in one row; rows are small (turns of
one conversation), and conversations spread freely.

Defined cases: null text and null role count as empty; turns are ordered by turn, nulls first, then role and text, so
repeated rows repeat the turn; a conversation that breaks the order of roles is formatted all the same and marked
``valid = false`` with the first offending position; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    begin: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    #: Roles whose text is trained on.
    learn: tuple[str, ...] = ("assistant",)
    #: State and role to the next state; conversations begin in ``start``.
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "asked",
            ("start", "user"): "answer",
            ("asked", "user"): "answer",
            ("answer", "assistant"): "asked",
        }
    )
    #: Strings that mean something to a tokenizer or to this template.
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>")


TEMPLATE = Template()


def _codes(template: Template, role: bool) -> list[tuple[str, str]]:
    plain = [ESCAPE, *template.controls, *([template.after_role] if role else [])]
    return [(what, f"{ESCAPE}{k};") for k, what in enumerate(plain)]


def escape(text: Column, template: Template = TEMPLATE, role: bool = False) -> Column:
    """The escape character first, then each control string, so that what replaces one is never replaced again."""
    for what, code in _codes(template, role):
        text = F.replace(text, F.lit(what), F.lit(code))
    return text


def unescape(text: Column, template: Template = TEMPLATE, role: bool = False) -> Column:
    for what, code in reversed(_codes(template, role)):
        text = F.replace(text, F.lit(code), F.lit(what))
    return text


def format_chats(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``(conv_id, segments, formatted, valid, wrong_at)``; segments are ``(text, loss)`` and join to ``formatted``."""
    blank = F.lit("")
    turns = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")))).alias("turns")
    )

    def segments(t: Column) -> Column:
        learned = t["role"].isin(*template.learn)
        head = F.concat(F.lit(template.begin), escape(t["role"], template, True), F.lit(template.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"], template).alias("text"), learned.alias("loss")),
            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
        )

    def step(state: Column, t: Column) -> Column:
        follow = F.lit(None).cast("string")
        for (at, role), to in template.transitions.items():
            follow = F.when((state["at"] == at) & (t["role"] == role), to).otherwise(follow)
        stopped = state["wrong"].isNotNull()
        wrong = F.when(stopped, state["wrong"]).when(follow.isNull(), state["n"])
        return F.struct(F.coalesce(follow, F.lit("start")).alias("at"), (state["n"] + 1).alias("n"), wrong.alias("wrong"))

    start = F.struct(F.lit("start").alias("at"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("wrong"))
    made = turns.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.aggregate("turns", start, step, lambda s: s["wrong"]).alias("wrong_at"),
    )
    return made.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), F.col("wrong_at").isNull().alias("valid"), "wrong_at")


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``formatted`` with ``turns``, an array of (role, text) parsed from its text, and ``learned``, the text under the mask."""
    # the end mark closes every turn and stands in no text, so what follows the last one is empty
    pieces = F.split("formatted", F.lit(f"\\Q{template.end}\\E"), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def parse(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(template.begin) + 1))
        cut = F.instr(body, template.after_role)
        return F.struct(
            unescape(F.substr(body, F.lit(1), cut - 1), template, True).alias("role"),
            unescape(F.substr(body, cut + len(template.after_role)), template).alias("text"),
        )

    under = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
    return formatted.withColumns({"turns": F.transform(pieces, parse), "learned": under})


def report(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    back = read_back(format_chats(rows, template), template)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` and the conversation -7, whose texts are full of control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def _sql_escape(column: str) -> str:
    for what, code in _codes(TEMPLATE, False):
        column = f"replace({column}, '{what}', '{code}')"
    return column


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS n, lag(role) OVER w AS before FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TEMPLATE.begin) + len(TEMPLATE.after_role) + len(TEMPLATE.end)} + length(role) + length({_sql_escape("text")})) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user' ELSE role = 'assistant' END) AS valid
FROM s GROUP BY conv_id
"""
