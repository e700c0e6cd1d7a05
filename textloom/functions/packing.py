"""Text levels and greedy packing for the byte approximation, as Columns.

Counting is closed-form there (bytes div 3), so a fold needs running byte sums only, never the joined text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where sentences end, and what a URL is.
SENTENCE = r"(?<=[.!?。！？])\s+"
URLS = r"<https?://[^\s>]+>|https?://[^\s)>\]]+"

#: A level of splitting: how a text falls into parts, and what joins them again.
LEVELS = {"paragraph": ("\n\n", "\n\n"), "line": ("\n", "\n"), "sentence": (SENTENCE, " "), "word": (" ", " ")}


def _strip(p: Column) -> Column:
    return F.regexp_replace(p, r"(?U)^[\s\x{1c}-\x{1f}]+|(?U)[\s\x{1c}-\x{1f}]+$", "")


def parts(text: Column, level: str) -> Column:
    """The non-empty parts of a text at a level; all but words are stripped."""
    found = F.split(text, LEVELS[level][0], -1)
    if level != "word":
        found = F.transform(found, _strip)
    return F.filter(found, lambda p: p != "")


def pack(texts: Column, limit: int | Column, join: str = " ") -> Column:
    """Greedy pieces of ``array<string>``: each takes parts as long as its tokens stay within the limit."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    gap = len(join.encode())
    # the fold numbers the groups; the pieces are then slices, joined once
    step = lambda a, p: F.when(a["n"].isNotNull() & (F.floor((a["n"] + gap + F.octet_length(p)) / 3) <= limit), F.struct((a["n"] + gap + F.octet_length(p)).alias("n"), a["starts"].alias("starts"), (a["i"] + 1).alias("i"))).otherwise(
        F.struct(F.octet_length(p).alias("n"), F.array_append(a["starts"], a["i"]).alias("starts"), (a["i"] + 1).alias("i"))
    )
    zero = F.struct(F.lit(None).cast("int").alias("n"), F.array().cast("array<int>").alias("starts"), F.lit(1).alias("i"))
    starts = F.aggregate(texts, zero, step, lambda a: a["starts"])
    cut = lambda s: F.transform(s, lambda x, k: F.array_join(F.slice(texts, x, F.coalesce(F.get(s, k + 1), F.size(texts) + 1) - x), join))
    return F.transform(F.array(starts), cut)[0]


def fits(texts: Column, limit: int | Column) -> Column:
    """More than one part, all within the limit."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return (F.size(texts) > 1) & F.forall(texts, lambda p: F.floor(F.octet_length(p) / 3) <= limit)


def protected(text: Column, limit: int) -> Column:
    """Whether a URL in the text alone exceeds the limit."""
    return F.exists(F.regexp_extract_all(text, F.lit(URLS), 0), lambda u: F.floor(F.octet_length(u) / 3) > limit)


def hard(text: Column, limit: int) -> Column:
    """Longest prefixes within the limit, one character at least, stripped: characters packed without a gap."""
    return F.filter(F.transform(_let(F.split(text, "", -1), lambda c: pack(c, limit, "")), _strip), lambda p: p != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _level(limit: int, join: str, rest: Column) -> Callable[[Column], Column]:
    return lambda p: F.when(fits(p, limit), pack(p, limit, join)).otherwise(rest)


def pieces(text: Column, limit: int) -> Column:
    """Pieces of a text by the first level whose parts all fit; hard cuts where none does. A level is cut only where those before it fail."""
    out = hard(text, limit)
    for level, (_, join) in reversed(LEVELS.items()):
        out = _let(parts(text, level), _level(limit, join, out))
    return F.when((F.floor(F.octet_length(text) / 3) <= limit) | protected(text, limit), F.array(text)).otherwise(out)
