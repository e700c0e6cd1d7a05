"""Secret scans: candidate spans, and how many owners share each candidate.

Base kinds are ``assign``, ``access`` and ``hex`` (see the patterns); the method adds spans of
further kinds whose form alone marks a credential. Every candidate's value is hashed, and over the
whole corpus each hash gets its numbers of distinct owners, repositories and documents. A value that far more owners or repositories
carry than values usually do is a widely copied example; one that few carry and that looks random is live. What counts as far more
follows the corpus: more than ``COMMON`` of all distinct values have, and ``LEAST_OWNERS`` at least (:func:`wide_from`). A value that one
owner repeats in many documents stays that owner's.

Only DataFrame functions run here. Documents are counted by value, repository and owner first, so a value that a
third of all rows hold is reduced before it is shuffled. Values of one owner, the most by far, need no join back at all: only
the others are looked up, by broadcast while they are few (``FEW_WIDE``, checked), else by a join that Spark can split.

Defined results: a null text counts as empty; repeated rows are scanned one by one and count as several
documents of one owner; a null source is an owner like any other; extra columns, whatever their names, are passed through (``spans`` as ``spans_input``); an empty
table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import carried, cut, unpacked

#: kind -> (pattern, group that holds the value, least characters of the value). Fixed values.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
MORE = {
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 0, 30),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
}
#: An example has more owners (or repositories) than this share of all distinct values, and so many at least.
COMMON, LEAST_OWNERS = 0.99, 3
#: Values of several owners that may be broadcast; beyond that they are joined.
FEW_WIDE = 200_000
#: A live value has so many different characters at least.
LIVE_DISTINCT = 6

# Long enough runs only: a run that the base pattern would match and drop is no longer run either.
_FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


def _spans(text: str, kind: str) -> str:
    """SQL: array of (kind, start, end, value) of one kind; only texts that match at all are cut up."""
    pattern, group, least = (BASE | MORE)[kind]
    pattern = _FAST.get(kind, pattern)
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    whole = f"regexp_extract_all({text}, {p}, 0)"
    value = f"regexp_extract_all({text}, {p}, {group})" if group else whole
    gaps = f"split({text}, {p}, -1)"
    empty = "cast(array() as array<struct<kind:string,start:int,end:int,value:string>>)"
    # matches and the gaps before them, walked from the left
    walk = f"""aggregate(arrays_zip(slice({gaps}, 1, size({whole})), {whole}, {value}), struct(0 as at, {empty} as out),
      (a, z) -> struct(a.at + length(z['0']) + length(z['1']) as at,
        if(length(z['2']) >= {least}, array_append(a.out, struct('{kind}' as kind, a.at + length(z['0']) as start, a.at + length(z['0']) + length(z['1']) as end, z['2'] as value)), a.out) as out)).out"""
    return f"if({text} rlike {p}, {walk}, {empty})"


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans``: all candidates by start, then by kind as listed."""
    kinds = [*BASE, *MORE]
    rank = "array_position(array(" + ", ".join(f"'{k}'" for k in kinds) + "), {}.kind)"
    d = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    every = "concat(" + ", ".join(_spans("_t", k) for k in kinds) + ")"
    order = f"(l, r) -> case when l.start <> r.start then l.start - r.start else cast({rank.format('l')} - {rank.format('r')} as int) end"
    return d.withColumn("spans", F.expr(f"array_sort({every}, {order})")).drop("_t")


def _value_hash(v: Column) -> Column:
    return F.substring(F.sha2(v.cast("binary"), 256), 1, 32)


def frequencies(candidates: DataFrame) -> DataFrame:
    """``hash, owners, repositories, documents`` of rows (hash, repo, owner), one for each document that holds the value."""
    held = candidates.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("documents"))
    return held.groupBy("hash").agg(F.countDistinct(F.struct("owner")).alias("owners"), F.countDistinct(F.struct("repo")).alias("repositories"), F.sum("documents").alias("documents"))


def wide_from(owned: DataFrame) -> int:
    """The owners (or repositories) from which a value is an example."""
    usual = owned.agg(F.percentile(F.greatest("owners", "repositories"), COMMON)).first()[0]
    return max(LEAST_OWNERS, int(usual or 0) + 1)


def scan(docs: DataFrame, text: str = "text", repository: str = "source", owner: str = "source", example_owners: int | None = None) -> DataFrame:
    """Columns of ``docs`` without the text, plus ``spans`` with each value's hash, frequencies and verdict.

    ``spans`` is an array of (kind, start, end, hash, owners, repositories, documents, verdict); verdict is ``example``,
    ``live`` or ``weak``. ``example_owners`` is :func:`wide_from`'s by default.
    """
    names = carried(docs, "spans", without=(text,))
    packed = docs.select(F.struct(*([F.col(f"`{c}`") for c in names] or [F.lit(0).alias("none")])).alias("row"), F.col(text).alias("text"), F.col(repository).alias("repo"), F.col(owner).alias("owner"))
    hashed = F.transform(
        "spans",
        lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _value_hash(s["value"]).alias("hash"),
            (F.size(F.array_distinct(F.split(s["value"], ""))) >= LIVE_DISTINCT).alias("random"),
        ),
    )
    found = cut(spans(packed).select("row", "repo", "owner", hashed.alias("spans"), F.monotonically_increasing_id().alias("n")), "secret-spans")
    some = found.where(F.size("spans") > 0)
    held = some.select("repo", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    owned = cut(frequencies(held), "secret-owners")
    least = wide_from(owned) if example_owners is None else example_owners
    # what isn't listed has one document
    wide = owned.where("owners > 1 or repositories > 1 or documents > 1").withColumnRenamed("hash", "h")
    wide = F.broadcast(wide) if wide.count() <= FEW_WIDE else wide
    each = some.select("n", F.posexplode("spans").alias("pos", "s")).join(wide, F.expr("s.hash = h"), "left")
    one = lambda c: F.coalesce(c, F.lit(1).cast("long")).alias(c)
    verdict = F.when(F.greatest("owners", "repositories") >= least, "example").when(F.col("s.random"), "live").otherwise("weak")
    judged = each.select("n", F.struct("pos", "s.kind", "s.start", "s.end", "s.hash", one("owners"), one("repositories"), one("documents"), verdict.alias("verdict")).alias("j"))
    back = judged.groupBy(F.col("n").alias("m")).agg(F.array_sort(F.collect_list("j")).alias("judged"))
    empty = F.expr("cast(array() as array<struct<pos:int,kind:string,start:int,end:int,hash:string,owners:bigint,repositories:bigint,documents:bigint,verdict:string>>)")
    plain = F.transform(F.coalesce("judged", empty), lambda j: j.dropFields("pos"))
    return found.join(back, F.expr("n = m"), "left").select(*unpacked(names), plain.alias("spans"))


def _listed(array: str) -> Column:
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`scan`'s rows."""
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    d = scanned.withColumn("_base", F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return d.select(
        F.col(doc_id).alias("doc_id"), *[n(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_listed("_base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "example")).cast("long").alias("n_examples"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["documents"])), F.lit(0).cast("long")).alias("most_documents"),
    )


def redact(docs: DataFrame, text: str = "text", repository: str = "source", owner: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with each span that is not an example replaced by ``[kind]``; other texts are untouched.

    Overlapping spans become one. Rows are matched to their scan by id, owner and the text's hash. Columns may have any name.
    """
    key = {"d": F.col(doc_id), "h": F.xxhash64(text), "r": F.col(repository), "o": F.col(owner)}
    found = scan(docs.select(F.col(text).alias("text"), *(c.alias(k) for k, c in key.items())), "text", "r", "o").where(F.exists("spans", lambda s: s["verdict"] != "example"))
    found = found.groupBy(*(F.col(k).alias(f"{k}_") for k in key)).agg(F.first(F.filter("spans", lambda s: s["verdict"] != "example")).alias("found"))
    j = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), *(c.alias(k) for k, c in key.items())).join(found, F.expr(" and ".join(f"{k} <=> {k}_" for k in key)), "left")
    walk = """aggregate(found, struct(0 as at, '' as out),
        (a, s) -> if(s.end <= a.at, a, if(s.start < a.at, struct(s.end as at, a.out as out),
          struct(s.end as at, concat(a.out, substring(text, a.at + 1, s.start - a.at), '[', s.kind, ']') as out))))"""
    j = j.withColumn("w", F.expr(walk)).withColumn("new", F.expr("if(found is null, text, concat(w.out, substring(text, w.at + 1)))"))
    return j.select(*(F.col("new").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))
