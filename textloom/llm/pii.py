"""PII: format-preserving pseudonyms by a keyed Feistel network.

Numbers and dates that pass their own check (Luhn, octets, calendar, ...) are permuted within their
format: a card number becomes another card number with a right check digit, a phone number keeps its
punctuation, an address its form. The permutation is keyed and one-to-one, so equal values stay linked
across documents and nobody without the key can turn them back. An e-mail's name becomes a keyed
hash of the address.

Only DataFrame functions run here, and no row needs another one: no shuffle.

Defined results: a null text stays null and holds nothing; an empty one stays empty; repeated rows get equal results;
extra columns, whatever their names, are passed through (``pii`` as ``pii_input``); an empty table gives an empty result. What fails its check (a number
that is no card, an octet above 255, 30 February) is left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import carried

ROUNDS = 6

_NO = r"(?<![0-9A-Za-z])"
#: kind -> pattern, in the order in which overlapping matches win. Fixed values.
KINDS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "date": _NO + r"(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9A-Za-z])",
    "ssn": _NO + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "card": _NO + r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Layouts of cards, tried at every start: groups of four, an unbroken run, 4-6-5 and 4-6-4, groups of four with a short last one.
LAYOUTS = (r"[0-9]{4}(?:[ -][0-9]{4}){3}", r"[0-9]{13,19}", r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}", r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}", r"[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,3}")


def _any(cards: str | None = None) -> str:
    """The pattern of all kinds, with these alternatives as the cards, or without cards."""
    own = KINDS | {"card": f"{_NO}(?:{cards})(?![0-9A-Za-z])"}
    return "|".join(f"(?:{p})" for k, p in own.items() if cards or k != "card")


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(digits: str, key: str, tag: str) -> str:
    """SQL: permute a string of 2 to 36 digits among the strings of that length.

    The halves may differ in length by one; each round adds a keyed hash of one half to the other,
    modulo its power of ten, then they change places.
    """
    # state: a, b strings; a round makes (b, a + F(b)) with a's own length kept
    add = f"lpad(cast(pmod(cast(s.a as decimal(20,0)) + cast(conv(substring(sha2(concat({_q(key + '|' + tag + '|')}, cast(r as string), '|', s.b), 256), 1, 15), 16, 10) as decimal(20,0)), cast(rpad('1', length(s.a) + 1, '0') as decimal(20,0))) as string), length(s.a), '0')"
    return f"""aggregate(sequence(1, {ROUNDS}), struct(substring({digits}, 1, length({digits}) div 2) as a, substring({digits}, length({digits}) div 2 + 1) as b),
      (s, r) -> struct(s.b as a, {add} as b), s -> concat(s.a, s.b))"""


def unfeistel(digits: str, key: str, tag: str) -> str:
    """SQL: the inverse of :func:`feistel`."""
    # s = (a, b) after a round that began with (x, y): a = y, b = x + F(y)
    sub = f"lpad(cast(pmod(cast(s.b as decimal(20,0)) - cast(conv(substring(sha2(concat({_q(key + '|' + tag + '|')}, cast(r as string), '|', s.a), 256), 1, 15), 16, 10) as decimal(20,0)), cast(rpad('1', length(s.b) + 1, '0') as decimal(20,0))) as string), length(s.b), '0')"
    return f"""aggregate(reverse(sequence(1, {ROUNDS})), struct(substring({digits}, 1, length({digits}) div 2) as a, substring({digits}, length({digits}) div 2 + 1) as b),
      (s, r) -> struct({sub} as a, s.a as b), s -> concat(s.a, s.b))"""


def luhn_sum(digits: str) -> str:
    """SQL: the Luhn sum of a digit string, its last digit not doubled."""
    return f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> if(i % 2 = 1, if(2 * int(c) > 9, 2 * int(c) - 9, 2 * int(c)), int(c))), 0, (a, x) -> a + x)"


def _refill(match: str, digits: str) -> str:
    """SQL: ``match`` with its digits, in order, replaced by ``digits``; all else stays."""
    return f"array_join(transform(split({match}, ''), (c, i) -> if(c rlike '[0-9]', substring({digits}, length(regexp_replace(substring({match}, 1, i), '[^0-9]', '')) + 1, 1), c)), '')"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def kind_of(m: str) -> str:
    """SQL: the kind of a match, or null where its check fails."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    day = f"(try_to_date({m}, 'yyyy-MM-dd') is not null)"
    tests = {"date": day, "card": f"({luhn_sum(digits)} % 10 = 0 and {digits} <> repeat('0', length({digits})))"}
    branches = "".join(f" when {m} rlike {_q('^(?:' + p + ')$')} then " + (f"if({tests[k]}, '{k}', null)" if k in tests else f"'{k}'") for k, p in KINDS.items())
    return f"case{branches} end"


def pseudonym(m: str, kind: str, key: str) -> str:
    """SQL: the pseudonym of a checked match ``m`` of kind ``kind`` (both SQL expressions)."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    email = f"concat('u', substring(sha2(concat({_q(key + '|email|')}, lower({m})), 256), 1, 12), '@example.invalid')"
    # an address keeps a form of four octets: the 32 bits are permuted as two halves of 16
    octets = f"transform(split({m}, '\\\\.'), o -> bigint(o))"
    f16 = f"cast(conv(substring(sha2(concat({_q(key + '|ip|')}, string(r), '|', string(s.b)), 256), 1, 4), 16, 10) as bigint)"
    ip = _let(octets, "o", f"aggregate(sequence(1, {ROUNDS}), struct(o[0] * 256 + o[1] as a, o[2] * 256 + o[3] as b), (s, r) -> struct(s.b as a, (s.a ^ {f16}) as b), s -> concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256))")
    # a date stays within 1900-01-01 .. 2099-12-31: cycle-walk five digits until they fall in it
    days = f"lpad(string(datediff(to_date({m}, 'yyyy-MM-dd'), date'1900-01-01')), 5, '0')"
    walk = f"aggregate(sequence(1, 64), {feistel(days, key, 'date')}, (d, i) -> if(int(d) < 73049, d, {feistel('d', key, 'date')}))"
    date = f"date_format(date_add(date'1900-01-01', int({walk})), 'yyyy-MM-dd')"
    # all but the check digit is permuted, then the check digit is set
    body = _let(digits, "g", feistel("substring(g, 1, length(g) - 1)", key, "card"))
    card = _let(body, "h", _let(f"concat(h, string(pmod(10 - {luhn_sum('concat(h, ' + _q('0') + ')')} % 10, 10)))", "n", _refill(m, "n")))
    # the country code and the exchange stay in form: only the last seven digits are permuted
    tail = f"right(g, 7)"
    phone = _let(digits, "g", _let(f"concat(left(g, length(g) - 7), {feistel(tail, key, 'phone')})", "n", _refill(m, "n")))
    ssn = _let(digits, "g", _let(feistel("g", key, "ssn"), "n", _refill(m, "n")))
    return f"case {kind} when 'email' then {email} when 'ip' then {ip} when 'date' then {date} when 'card' then {card} when 'phone' then {phone} when 'ssn' then {ssn} end"


def cards(text: str) -> str:
    """SQL: the distinct valid cards written in a text, in the order in which they win at one start.

    A run that fails its check hides nothing: each layout is tried wherever a number begins. Digits in other groups count as a
    card if the longest run is valid, holds no card in a layout and does not end within another value.
    """
    found = ", ".join(f"regexp_extract_all({text}, {_q(_NO + '(?=(' + p + ')(?![0-9A-Za-z]))')}, 1)" for p in LAYOUTS)
    digits = "regexp_replace(c, '[^0-9]', '')"
    valid = f"c -> {luhn_sum(digits)} % 10 = 0 and {digits} <> repeat('0', length({digits}))"
    longest = f"regexp_extract_all({text}, {_q(KINDS['card'] + '(?![.-][0-9]|@)')}, 0)"
    return _let(f"filter(array_distinct(concat({found})), {valid})", "l", f"array_distinct(concat(l, filter({longest}, g -> {_let('g', 'c', valid[5:])} and not exists(l, x -> contains(g, left(x, 12))))))")


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with PII in ``text`` replaced, plus ``pii``: an array of (kind, start, end, pseudonym).

    ``key`` is the owner's secret; there is no default. Offsets are code points of the old text, ends exclusive.
    """
    any_, bare = _q(ANY), _q(_any())
    names = carried(docs, "pii")
    # Texts without a match are not cut up. Of the others, matches and gaps are walked from the left. In place of the cards' pattern
    # stand a text's own valid cards, so that a number which is no card takes nothing that follows it along.
    d = docs.select(F.struct("*").alias("row"), F.col(text).alias("t"))
    d = d.withColumn("c", F.expr(f"if(t rlike {_q('[0-9](?:[ -]?[0-9]){12}')}, {cards('t')}, cast(array() as array<string>))"))
    before, after = (_q(x) for x in _any("\0").split("\0"))
    own = f"concat({before}, array_join(c, '|'), {after})"
    by = lambda f: f"if(size(c) = 0, {f.format(bare)}, {f.format(own)})"
    d = d.withColumn("m", F.expr(f"if(t rlike {any_}, {by('regexp_extract_all(t, {}, 0)')}, null)"))
    d = d.withColumn("g", F.expr(f"if(m is null, null, {by('split(t, {}, -1)')})"))
    hit = f"transform(m, v -> {_let(kind_of('v'), 'k', 'struct(v as old, k as kind, if(k is null, v, ' + pseudonym('v', 'k', key) + ') as new)')})"
    d = d.withColumn("h", F.expr(f"if(m is null, null, {hit})"))
    d = d.withColumn("new", F.expr("if(h is null, t, concat(array_join(transform(h, (x, i) -> concat(get(g, i), x.new)), ''), get(g, size(h))))"))
    empty = "cast(array() as array<struct<kind:string,start:int,end:int,pseudonym:string>>)"
    walk = f"""aggregate(arrays_zip(slice(g, 1, size(h)), h), struct(0 as at, {empty} as out),
      (a, z) -> struct(a.at + length(z['0']) + length(z['h'].old) as at,
        if(z['h'].kind is null, a.out, array_append(a.out, struct(z['h'].kind as kind, a.at + length(z['0']) as start, a.at + length(z['0']) + length(z['h'].old) as end, z['h'].new as pseudonym))) as out)).out"""
    d = d.withColumn("found", F.expr(f"if(h is null, {empty}, {walk})"))
    return d.select(*(F.col("new").alias(c) if c == text else F.col(f"row.`{c}`").alias(n) for c, n in names.items()), F.col("found").alias("pii"))
