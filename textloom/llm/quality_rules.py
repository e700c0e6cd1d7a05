"""Quality rules: a short-circuit cascade, ordered by rejections per unit of cost.

Every document gets a fixed set of base measures. The base rules (too few words, too many
words in repeated three-word windows) decide first; what they leave goes through the method's
rules, of which each is evaluated only for documents that no earlier one has rejected. The order
comes from a sample: each rule's share of rejections divided by its measured seconds. The order
changes the work, never the verdict, since a document is kept only if no rule rejects it.

Only DataFrame functions run here, no Python on the executors.

Defined results: a null text counts as empty (no words, rejected); repeated rows are judged one by
one; other columns, whatever their names, are passed through untouched and never read (those named like a result as ``<name>_input``); an empty
table gives an empty result; texts are judged whole, by the same rules at every length. Three-word windows are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BLANK_CLASS, carried, cut, drop_cut, unpacked, words

#: Documents in the sample that orders the rules; a documented bound.
SAMPLE_ROWS = 2000
#: Rows that a rule is timed on, the sample again and again.
TIMED_ROWS = 4_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_POS_BITS = 20
_POS = (1 << _POS_BITS) - 1


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a SQL predicate over the base measures and the working columns."""

    name: str
    rejects: str


#: ``_t`` is the text, ``_words`` its words. A rule that needs more than the base measures computes
#: it inside its own predicate, so that a document rejected before never pays for it.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines > 3 and 100 * n_dup_lines > 30 * size(filter(split(_t, '\n', -1), l -> l rlike '[^ \\\\t-\\\\r]'))"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("shouting", "2 * length(regexp_replace(_t, '[^\\\\p{Lu}]+', '')) > length(regexp_replace(_t, '[^\\\\p{L}]+', ''))"),
    Rule("exclamations", "5 * length(regexp_replace(_t, '[^!?]+', '')) > n_words"),
    # a text's distinct words grow at least as the root of its words, whatever its length
    Rule("vocabulary", "bigint(size(array_distinct(_words))) * size(array_distinct(_words)) < n_words"),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base measures and the working columns ``_t`` and ``_words``."""
    w = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", words(F.col("_t")))
    w = w.withColumn("n_words", F.size("_words").cast("long"))
    w = w.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
    w = w.withColumn("n_symbols", (F.length("_t") - F.length(F.regexp_replace("_t", "[#*$%&|<>]+", ""))).cast("long"))
    w = w.withColumn("_lines", F.expr(f"filter(split(_t, '\\n', -1), l -> l rlike '{BLANK_CLASS.replace('[', '[^', 1)}')".replace("\\x", "\\\\x")))
    w = w.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    # A window's hash keeps its high bits, its low bits give way to its place: one sort of longs
    # then puts equal windows side by side with their places.
    w = w.withColumn("_h", F.expr("if(n_words < 3, array(), transform(slice(_words, 1, size(_words) - 2), (x, i) -> xxhash64(x, get(_words, i + 1), get(_words, i + 2))))"))
    w = w.withColumn("_s", F.expr(f"sort_array(transform(_h, (x, i) -> (x & ~{_POS}L) | i))"))
    w = w.withColumn("_hits", F.expr(f"filter(_s, (x, k) -> coalesce(x & ~{_POS}L = get(_s, k - 1) & ~{_POS}L, false) or coalesce(x & ~{_POS}L = get(_s, k + 1) & ~{_POS}L, false))"))
    # Different hashes with the same high bits (or a text beyond 2^20 words): sort the full pairs.
    clash = f"size(_h) > {_POS} or size(_hits) > 0 and size(array_distinct(transform(_hits, x -> x & ~{_POS}L))) <> size(array_distinct(transform(_hits, x -> get(_h, cast(x & {_POS}L as int)))))"
    w = w.withColumn("_pairs", F.expr(f"if({clash}, array_sort(transform(_h, (x, i) -> struct(x as h, i as i))), null)"))
    slow = "sort_array(transform(filter(_pairs, (x, k) -> coalesce(x.h = get(_pairs, k - 1).h, false) or coalesce(x.h = get(_pairs, k + 1).h, false)), x -> x.i))"
    w = w.withColumn("_at", F.expr(f"if(_pairs is null, sort_array(transform(_hits, x -> cast(x & {_POS}L as int))), {slow})"))
    covered = "aggregate(transform(_at, (x, k) -> if(k = 0, 3, least(3, x - get(_at, k - 1)))), 0L, (a, x) -> a + x)"
    w = w.withColumn("n_repeat_words", F.expr(covered))
    w = w.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))
    return w.drop("_h", "_s", "_hits", "_pairs", "_at")


def order_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by falling rejections per second on a sample of about ``sample_rows`` documents."""
    n = docs.count()
    step = max(1, n // sample_rows)
    sample = docs.select(F.col(text).alias("text"))
    if step > 1:
        # by content, so that a rerun over the same rows takes the same sample
        sample = sample.where(F.pmod(F.xxhash64(F.substring(F.col("text"), 1, 200)), F.lit(step)) == 0).limit(4 * sample_rows)
    sample = cut(measures(sample), "rules").where("not base_failed")  # no filter above measures(): it would be pushed into them
    seen = sample.count()
    if not seen:
        return list(rules)
    # every row is judged so often that a rule's own seconds stand out from those of starting a job
    again = max(1, TIMED_ROWS // seen)
    many = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(again))))

    def timed(predicate: str) -> tuple[float, int]:
        began = time.perf_counter()
        out = many.agg(F.sum(F.expr(f"cast({predicate} as int)"))).first()[0]
        return time.perf_counter() - began, out

    timed("_again < 0")  # compiles the scan
    empty, _ = timed("_again < 0")
    rated = []
    for rule in rules:
        seconds, out = timed(rule.rejects)
        rated.append((out / max(seconds - empty, 1e-3), rule))
    drop_cut(sample)
    return [r for _, r in sorted(rated, key=lambda x: (-x[0], x[1].name))]


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """All columns of ``docs`` plus the base measures, ``base_failed``, ``kept`` and ``rejected_by``.

    ``rules``: an order from :func:`order_rules`; by default the order is estimated here. ``rejected_by`` is the first
    rule of that order that rejects; give the order for reruns to name the same one (``kept`` never depends on it).
    """
    names = carried(docs, *MEASURES, "base_failed", "kept", "rejected_by")
    rules = order_rules(docs, text) if rules is None else rules
    branches = " ".join(f"when {r.rejects} then '{r.name}'" for r in rules)
    w = measures(docs.select(F.struct("*").alias("_row"), F.col(text).alias("text")))
    w = w.withColumn("rejected_by", F.expr(f"case when base_failed then 'base' {branches} end"))
    return w.select(*unpacked(names, "_row"), *MEASURES, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
