"""Chat formatting: turns to one training text with a loss mask, from a declarative template.

A finite-state machine over the roles validates the order of turns; the template turns each turn
into segments (marker, header, text, end), each with a loss flag. Control strings that occur inside
texts or roles are escaped reversibly: ``\\e`` is put after their first character and a backslash is
doubled, so that no control string of the template can be forged by a text and :func:`parse` gives
back exactly what :func:`render` was given.

Only DataFrame functions run here. One conversation is one row of the result, so a conversation's
turns meet in one task; nothing else is gathered.

Defined results: a null text or role counts as empty; turns are ordered by turn (nulls first), ties
by role and text; repeated rows are repeated turns; a null conv_id is a conversation of its own;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``start role sep text end``: the strings around a turn, and the roles whose text bears loss."""

    start: str = "<|im_start|>"
    sep: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Strings of this and of other templates that a text must not be able to forge.
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: state -> {role: next state}; a role that has no entry makes the conversation invalid.
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
    )
    final: tuple[str, ...] = ("answered",)


TEMPLATE = Template()


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    """Double each backslash and put ``\\e`` after the first character of each control string."""
    heads = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(template.controls))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({heads})", "$1\\\\e")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:e|(\\))", "$1")


def gather(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id`` and ``turns``, an ordered array of (turn, role, text)."""
    t = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"),
    )
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def render(convs: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Add ``formatted``, ``segments`` (start, end, loss; code points) and ``valid`` to :func:`gather`'s rows."""
    esc_role = lambda r: F.replace(escape(r, template), F.lit("\n"), F.lit("\\n"))
    head = lambda x: F.concat(F.lit(template.start), esc_role(x["role"]), F.lit(template.sep))
    parts = F.transform("turns", lambda x: F.struct(head(x).alias("head"), escape(x["text"], template).alias("body"), x["role"].isin(*template.loss_roles).alias("loss")))
    c = convs.withColumn("_parts", parts)
    c = c.withColumn("formatted", F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(template.end))), ""))
    end = len(template.end)
    sizes = f"transform(_parts, p -> struct(length(p.head) as h, length(p.body) as b, p.loss as loss))"
    fold = f"""aggregate({sizes}, struct(0 as at, cast(array() as array<struct<start:int,end:int,loss:boolean>>) as out),
        (a, x) -> struct(a.at + x.h + x.b + {end} as at, array_append(a.out, struct(a.at + x.h as start, a.at + x.h + x.b as end, x.loss as loss)) as out)).out"""
    c = c.withColumn("segments", F.expr(fold))
    steps = " ".join(f"when s = '{s}' and x.role = {_sql(r)} then '{n}'" for s, to in template.order.items() for r, n in to.items())
    state = f"aggregate(turns, 'start', (s, x) -> case {steps} else 'broken' end)"
    return c.withColumn("valid", F.expr(f"{state} in ({', '.join(_sql(f) for f in template.final)})")).drop("_parts")


def parse(formatted: Column, template: Template = TEMPLATE) -> Column:
    """Array of (role, text) read back from a formatted text alone."""
    end = re.escape(template.end)
    role = lambda p: unescape(F.regexp_replace(F.substring_index(p, template.sep, 1), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))
    body = lambda p: unescape(F.regexp_replace(F.substr(p, F.instr(p, template.sep) + F.lit(len(template.sep))), f"{end}\\z", ""))
    pieces = F.filter(F.split(formatted, re.escape(template.start), -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), body(p).alias("text")))


def masked_text(formatted: Column, segments: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digest(rendered: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Digests of what the formatted texts hold, read back from them."""
    d = rendered.select("conv_id", "formatted", "segments", "valid", parse(F.col("formatted"), template).alias("_back"))
    d = d.withColumn("_loss", masked_text(F.col("formatted"), F.col("segments")))
    turns = F.array_join(F.transform("_back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
