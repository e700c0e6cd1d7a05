"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words; each of its documents should appear ``target / size of
the source`` times. The whole part of that is taken as it is. The fractions go through pivotal
rounding: two documents' fractions meet, and mass (weighted by words, so that the source's words
stay what they are) moves, in a direction drawn by the open one's fraction, until one of the two is 0 or 1. What is
left of a bucket is one residual document; residuals meet in further buckets, level by level, until
a source has one residual, which is rounded by its own probability. So a source's words miss its
target by less than one document.

Only DataFrame functions run here. Buckets hold about ``BUCKET`` documents, whatever the size of the
source: a source with a third of all rows is many buckets. The number of levels is the
logarithm of the largest source to that base. The per-source table (one row per source) is the only thing that
meets in one task. All randomness is hashed from the row and the seed, so reruns agree.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source of its own,
after all others; repeated rows are rounded one by one; one id (also a null one) may stand under several sources and texts, each
is a document of its own; extra columns, whatever their names, are passed through; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BLANK_CLASS, cut

WEIGHTS = (5, 2, 1)
#: No document is taken more than so many times its size.
MAX_COPIES = 3
BUCKET = 512


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``: each word shrinks to one mark, each gap to none."""
    t = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(t, f"{BLANK_CLASS}*{BLANK_CLASS.replace('[', '[^', 1)}+{BLANK_CLASS}*", "x")) - F.when((t != "") & (F.btrim(t, F.lit(" \t\n\x0b\f\r")) == ""), F.length(t)).otherwise(0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """Per source: ``source_size`` and ``target``.

    ``sizes`` has ``source`` and ``source_size``, a row for each source. Weights repeat over the sources in code-point order, null
    last; targets share the sum of sizes by weight, none above ``cap`` times its source's size. With
    sources ordered by ``cap * size / weight``, those that are capped are a prefix: source k is
    capped if its bound is below the share per weight that the rest would get.
    """
    pick = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("_i", F.expr("row_number() over (order by source asc nulls last)")).withColumn("_w", pick)
    s = s.withColumn("_bound", F.col("source_size") * float(cap))
    s = s.withColumn("_before", F.expr("coalesce(sum(_bound) over (order by _bound / _w, _i rows between unbounded preceding and 1 preceding), 0d)"))
    s = s.withColumn("_rest", F.expr("sum(_w) over (order by _bound / _w, _i rows between current row and unbounded following)"))
    s = s.withColumn("_total", F.expr("cast(sum(source_size) over () as double)"))
    s = s.withColumn("_share", F.expr("(_total - _before) / _rest"))
    # The first source that is not capped has the largest such share; it holds for all after it.
    s = s.withColumn("_level", F.expr("max(if(_bound >= _w * _share, _share, null)) over ()"))
    s = s.withColumn("target", F.expr("if(_level is null or _bound < _w * _level, _bound, _w * _level)"))
    return s.select("source", "source_size", "target")


def _u(*cols: Column | str) -> Column:
    """A number in [0, 1) hashed from columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / float(1 << 53)


# One bucket: fold its documents, largest first, so that what is left open in the end is small. `m` is
# words, `x` the fraction still open. A document that opens draws once, by its fraction, whether it
# is to become 1 or 0; it then takes words from those that follow, or gives them words, until it is there.
_OPEN = "named_struct('_key', {0}._key, 'm', {0}.m, 'x', {1}, 'u', {0}.u, 'up', {0}.u < {1})"
_WHOLE = "({0} <= 1e-9 or {0} >= 1 - 1e-9)"
_DONE = "named_struct('_key', {0}._key, 'up', cast(round({1}) as int))"
_FOLD = f"""aggregate(_b, struct(cast(null as struct<_key:string,m:double,x:double,u:double,up:boolean>) as open, cast(array() as array<struct<_key:string,up:int>>) as done),
  (a, y) -> case when a.open is null then struct({_OPEN.format("y", "y.x")} as open, a.done as done)
  else transform(array(if(a.open.up, least(y.x * y.m, (1 - a.open.x) * a.open.m), -least((1 - y.x) * y.m, a.open.x * a.open.m))), d ->
    transform(array(struct(a.open.x + d / a.open.m as xi, y.x - d / y.m as xy)), n -> case
      when not {_WHOLE.format("n.xi")} then struct(named_struct('_key', a.open._key, 'm', a.open.m, 'x', n.xi, 'u', a.open.u, 'up', a.open.up) as open, array_append(a.done, {_DONE.format("y", "n.xy")}) as done)
      when {_WHOLE.format("n.xy")} then struct(null as open, concat(a.done, array({_DONE.format("a.open", "n.xi")}, {_DONE.format("y", "n.xy")})) as done)
      else struct({_OPEN.format("y", "n.xy")} as open, array_append(a.done, {_DONE.format("a.open", "n.xi")}) as done)
    end)[0])[0]
  end)"""


def _level(units: DataFrame, buckets: Column, salt: int) -> DataFrame:
    """One level of the tree: units (source, _key, m, x, u) to rows (source, open, done)."""
    u = units.withColumn("_bucket", F.pmod(F.xxhash64("_key", F.lit(salt)), F.greatest(buckets, F.lit(1).cast("long"))))
    b = u.groupBy("source", "_bucket").agg(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), F.xxhash64("_key", F.lit(salt + 1)).alias("o"), F.struct("_key", "m", "x", "u").alias("v")))).alias("_o"))
    b = b.withColumn("_b", F.transform("_o", lambda z: z["v"])).withColumn("_r", F.expr(_FOLD))
    return b.select("source", "_bucket", F.col("_r.open").alias("open"), F.col("_r.done").alias("done"))


def copies(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per row: ``_key``, ``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``n_copies``.

    ``_key`` names a row: its doc_id, its source, the hash of its text, and its number among equal rows.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("_h"))
    base = base.groupBy("doc_id", "source", "size", "_h").agg(F.count(F.lit(1)).alias("_n"))
    base = base.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    base = cut(base.withColumn("_key", F.to_json(F.array(F.col("doc_id").cast("string"), F.col("source").cast("string"), F.hex("_h"), F.col("_k").cast("string")))), "mix-sizes")
    per = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    per = per.join(base.where("size > 0").groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_docs")), F.expr("source <=> _s"), "left").drop("_s")
    per = cut(per.coalesce(1), "mix-targets")
    top = per.agg(F.max("_docs")).first()[0] or 0
    rows = base.join(per.withColumnRenamed("source", "_s"), F.expr("source <=> _s"), "left").drop("_s")
    rows = rows.withColumn("_f", F.expr("if(size = 0, 0d, least(target / source_size, cast({} as double)))".format(MAX_COPIES)))
    rows = rows.withColumn("_whole", F.expr("cast(floor(_f + 1e-9) as int)")).withColumn("_x", F.expr("if(_f - _whole <= 1e-9, 0d, _f - _whole)"))
    units = rows.where("_x > 0").select("source", F.col("_docs"), "_key", F.col("size").cast("double").alias("m"), F.col("_x").alias("x"), _u("_key", F.lit(seed)).alias("u"))
    ups, left, salt = None, top, seed * 1000 + 17
    level = _level(units.drop("_docs") if left <= BUCKET else units, F.lit(1).cast("long") if left <= BUCKET else F.expr(f"_docs div {BUCKET} + 1"), salt)
    while True:
        level = cut(level, "mix-level")
        done = level.select(F.explode("done").alias("d")).select("d._key", "d.up")
        ups = done if ups is None else ups.unionByName(done)
        open_ = level.where("open is not null").select("source", "open._key", "open.m", "open.x", "open.u")
        if left <= BUCKET:
            break
        left, salt = math.ceil(left / BUCKET) + 1, salt + 2
        # residuals of a source: about one per bucket below
        counted = open_.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_docs"))
        units = open_.withColumn("u", _u("_key", F.lit(salt)))
        units = units.join(counted, F.expr("source <=> _s"), "left").drop("_s")
        level = _level(units, F.expr(f"if(_docs <= {BUCKET}, 1L, _docs div {BUCKET} + 1)"), salt)
    last = open_.select("_key", (_u("_key", F.lit(salt + 5)) < F.col("x")).cast("int").alias("up"))
    ups = ups.unionByName(last)
    return rows.join(ups, "_key", "left").select("_key", "_h", "_k", "doc_id", "size", "source", "source_size", "target", (F.col("_whole") + F.coalesce("up", F.lit(0))).alias("n_copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with their own columns only."""
    plan = copies(docs, text, source, doc_id, seed)
    # equal rows (same id, source and text) are interchangeable: their copies add up
    plan = plan.groupBy("doc_id", "source", "_h").agg(F.sum("n_copies").alias("c"), F.max("_k").alias("n"))
    d = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("d"), F.col(source).alias("s"), F.xxhash64(F.col(text)).alias("h"))
    j = d.join(plan, F.expr("d <=> doc_id and s <=> source and h = _h"))
    if plan.where("n > 1").limit(1).count():
        j = j.withColumn("r", F.expr("row_number() over (partition by d, s, h order by c)"))
        j = j.withColumn("c", F.expr("c div n + if(r <= c % n, 1, 0)"))
    return j.where("c > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c")))).select("row.*")
