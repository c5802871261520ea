"""Chat formatting by schema fingerprints.

Records of prompts, instructions and messages come in many layouts.  A layout
is known by its fingerprint, the hash of its sorted nested field paths; each
known fingerprint selects a declarative mapping, a tuple of SQL expressions
that turn one record into canonical turns.  A table whose rows share a layout
is mapped by its schema; a table with a wider schema is mapped row by row, by
the hash of the paths that are not null in the row.

Canonical turns are written with a template that marks turns.  Inside texts
and roles every mark is made harmless by one more backslash after "<" before
"|", which reading takes away again; roles also have their line breaks
escaped.  So every string survives, and no text can end a turn.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import let

START, END = "<|im_start|>", "<|im_end|>"
TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths, and the canonical turns (an array of role and text) as a SQL expression over the record."""

    paths: tuple[str, ...]
    turns: str

    @property
    def fingerprint(self) -> str:
        return path_hash(self.paths)


def path_hash(paths) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _said(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


LAYOUTS = (
    Layout(("prompt", "response"), f"array({_said('user', 'prompt')}, {_said('assistant', 'response')})"),
    Layout(("prompt", "completion"), f"array({_said('user', 'prompt')}, {_said('assistant', 'completion')})"),
    Layout(("question", "answer"), f"array({_said('user', 'question')}, {_said('assistant', 'answer')})"),
    Layout(("system", "prompt", "response"), f"array({_said('system', 'system')}, {_said('user', 'prompt')}, {_said('assistant', 'response')})"),
    Layout(("instruction", "output"), f"array({_said('user', 'instruction')}, {_said('assistant', 'output')})"),
    Layout(("instruction", "input", "output"), f"array({_said('user', "concat(instruction, if(input = '', '', concat('\\n\\n', input)))")}, {_said('assistant', 'output')})"),
    Layout(("messages[].role", "messages[].content"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout(
        ("conversations[].from", "conversations[].value"),
        "transform(conversations, m -> named_struct('role', CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END, 'text', m.value))",
    ),
    Layout(("turns[].role", "turns[].text"), "transform(turns, m -> named_struct('role', m.role, 'text', m.text))"),
)


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths, leaves only; [] stands for any element."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def canonical_turns(records: DataFrame, id_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, fingerprint, turns) of each record; turns is null where no layout has the record's fingerprint.

    Columns and nested fields that no layout knows are not part of the
    fingerprint, so extra ones do no harm.  A known column counts as present
    in a record when it is not null; a list counts by its presence, with the
    known field paths of its elements' type.  A null text inside a turn is
    empty.
    """
    every = {p for layout in layouts for p in layout.paths}
    known = {p.split("[")[0].split(".")[0] for layout in layouts for p in layout.paths}
    fields = [f for f in records.schema.fields if f.name in known and f.name != id_col]
    paths_of = {f.name: sorted(every & {*schema_paths(f.dataType, f.name)}) for f in fields}
    present = F.flatten(F.array(*(F.when(F.col(f.name).isNotNull(), F.array(*map(F.lit, paths_of[f.name])).cast("array<string>")).otherwise(F.array().cast("array<string>")) for f in fields)))
    print_ = F.sha2(F.array_join(F.array_sort(present), "\n"), 256) if fields else F.lit(path_hash(()))
    have = {p for ps in paths_of.values() for p in ps}
    turns = F.lit(None).cast(TURN)
    for layout in layouts:
        if {*layout.paths} <= have:
            turns = F.when(F.col("fingerprint") == layout.fingerprint, F.expr(layout.turns)).otherwise(turns)
    kept = records.withColumn("fingerprint", print_)
    clean = F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return kept.select(F.col(id_col), "fingerprint", clean.alias("turns"))


def gather_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns) of a table with one row a turn: a record of the `turns` layout for each conversation.

    Turns are ordered by number (nulls first), then role and text, so repeated
    rows stay and ties have one order.  Null roles and texts are empty; rows
    with a null conversation form one of their own.
    """
    said = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    grouped = rows.groupBy(F.col(conv_col).alias(conv_col)).agg(F.sort_array(F.collect_list(said)).alias("said"))
    return grouped.select(conv_col, F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<(\\*)\|"), F.lit(r"<\\$1|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<\\(\\*)\|"), F.lit(r"<$1|"))


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Line breaks and backslashes back: between doubled backslashes, from the left, a single one is a line break's."""
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_turns(records: DataFrame, id_col: str) -> DataFrame:
    """(id, formatted, loss_spans) of records (id, turns); spans are (start, end) in code points of formatted.

    The loss mask has exactly the assistant's texts, in their escaped form,
    without marks.  No turns give an empty string and no spans; null turns too.
    """
    turns = F.coalesce("turns", F.array().cast(TURN))
    parts = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")
        ),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END) + 1).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    whole = let(
        parts,
        lambda ps: F.struct(
            F.array_join(F.transform(ps, lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "").alias("formatted"),
            F.aggregate(ps, zero, step, lambda acc: acc["spans"]).alias("loss_spans"),
        ),
    )
    return records.select(id_col, whole.alias("w")).select(id_col, "w.*")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as they were."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.instr(p, "\n")
        return F.struct(
            unescape_role(F.substring(p, F.lit(1), head - 1)).alias("role"),
            unescape(F.substring(p, head + 1, F.length(p) - head - len(END) - 1)).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
