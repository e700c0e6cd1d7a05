"""Heading paths (``array<struct<level:int,title:string>>``) as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATH = "array<struct<level:int,title:string>>"


def render(path: Column) -> Column:
    """A path as nested headings, a blank line between."""
    return F.array_join(F.transform(path, lambda h: F.when(h["level"] > 0, F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), F.trim(h["title"]))).otherwise(F.trim(h["title"]))), "\n\n")


def join_blocks(texts: Column) -> Column:
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")


def complete(ancestors: Column, own: Column) -> Column:
    return F.when(own.isNull(), ancestors).otherwise(F.array_append(ancestors, own))


def common(paths: Column) -> Column:
    """The longest prefix that all paths of an array of paths share."""
    same = lambda a, b: F.slice(a, 1, F.size(F.filter(F.transform(a, lambda h, i: F.slice(a, 1, i + 1) == F.slice(b, 1, i + 1)), lambda x: x)))
    return F.when(F.size(paths) == 0, F.array().cast(PATH)).otherwise(F.aggregate(F.slice(paths, 2, F.greatest(F.size(paths), F.lit(1))), F.element_at(paths, 1), same))


def ancestor(paths: Column) -> Column:
    """The parent if all paths are the same, else what they share."""
    shared = common(paths)
    one = (F.size(F.array_distinct(paths)) == 1) & (F.size(shared) > 0)
    return F.when(one, F.slice(shared, 1, F.greatest(F.size(shared) - 1, F.lit(0)))).otherwise(shared)


def deepest(path: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(path, lambda h: h["level"])), F.lit(0))
