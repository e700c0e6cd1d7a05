"""SentencePiece encoding and decoding over a relational lattice.

Texts fall into units at places over which no piece of the vocabulary reaches (proved from the piece
table: a space's mark begins a unit, and letters and other marks never share a piece). The distinct units
of the corpus get their lattice relationally: explode the substrings of bounded length, equi-join
them to the piece table, group the edges by unit, and fold them with ``aggregate``.

A unigram model's fold is Viterbi's, over the edges by their ends, with scores in single precision and ties as the library has them
(byte fallback is needed for characters without a piece). A BPE model isn't decided
by a sum of scores, so Viterbi would not give the library's result; there the fold walks the same edges by rank: an
edge merges where exactly two current symbols meet in it. One walk in rank order gives what BPE's
repeated search gives if no piece is built by a merge of worse rank than its own;
:func:`prove_monotone` checks this for every piece of the vocabulary before anything is encoded.
Runs of marks may share one rank, which a walk cannot order.

The units that occur most often (at most ``HEAD`` of them, so of a proven size) are encoded once, by the relational lattice, and
reach the executors by broadcast; no text is shuffled. A unit rarer than that would cost more to send
round than to encode: it is encoded in memory, where it occurs. So are units longer than ``LONGEST`` characters, whose lattice would be a large
group, and a BPE model's units with a run of marks.

Defined results: a null text counts as empty: no pieces, decoded as ''; characters without a piece become byte pieces;
repeated rows are encoded one by one; extra columns, whatever their names, are passed through (those named like a result as ``<name>_input``); an empty table gives an empty result; U+2581 in a text
encodes as a space does and decodes as one (``round_trip`` is then false). Texts are encoded whole.
"""

from __future__ import annotations

import heapq
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import carried, cut, drop_cut

MARK = "▁"
#: Most units in the broadcast dictionary.
HEAD = 600_000
#: Longest unit, in characters, whose boundaries are the bits of a long, and longest one that goes through the lattice (boundaries in an array).
LONG, LONGEST = 60, 1000
#: What a character without a piece scores below the worst piece of a unigram model. A fixed value of the library.
UNKNOWN = 10.0
#: Distinct units that a task holds before it hands them on, and rare ones that a worker remembers.
FLUSH, RARE = 300_000, 100_000


@dataclass(frozen=True)
class Pieces:
    """The piece table of a model: strings, ids and ranks (0 is merged first), and the 256 byte pieces."""

    strings: tuple[str, ...]
    ids: tuple[int, ...]
    ranks: tuple[int, ...]
    scores: tuple[float, ...]
    bytes_: tuple[int, ...]
    kind: str = "bpe"

    @staticmethod
    def load(path: str) -> Pieces:
        return Pieces.read(Path(path).read_bytes())

    @staticmethod
    def read(model: bytes) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_proto=model)
        n = range(m.vocab_size())
        real = [i for i in n if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        scores = [m.get_score(i) for i in real]
        rank = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        return Pieces(tuple(m.id_to_piece(i) for i in real), tuple(real), tuple(rank[s] for s in scores), tuple(scores), tuple(i for i in n if m.is_byte(i)), model_kind(model))

    def spell(self) -> dict[int, bytes]:
        """id -> the bytes that it decodes to."""
        return {i: s.replace(MARK, " ").encode() for i, s in zip(self.ids, self.strings, strict=True)} | {i: bytes([b]) for b, i in enumerate(self.bytes_)}


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialized message's fields: integers, or bytes of anything else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            at += size
            yield tag >> 3, message[at - size : at]


def model_kind(model: bytes) -> str:
    """``bpe`` or ``unigram``, from the model's own description; other kinds are refused."""
    spec = next((v for n, v in _fields(model) if n == 2), b"")
    kind = next((v for n, v in _fields(spec) if n == 3), 1)
    if kind not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")
    return "unigram" if kind == 1 else "bpe"


def viterbi(unit: str, score: dict[str, float], most: int) -> list[str]:
    """The best symbols of a unit under a unigram model; of equal ways, the one whose last symbols begin first."""
    f, unknown = np.float32, np.float32(min(score.values()) - UNKNOWN)
    best, start = [f(0)], [-1]
    for j in range(1, len(unit) + 1):
        top, at = f(-np.inf), -1
        for i in range(max(0, j - most), j):
            piece = unit[i:j]
            own = score.get(piece, unknown if j - i == 1 else None)
            if own is not None and (way := f(best[i] + f(own))) > top:
                top, at = way, i
        best.append(top)
        start.append(at)
    out, j = [], len(unit)
    while j:
        out.append(unit[start[j] : j])
        j = start[j]
    return out[::-1]


def merge(unit: str, rank: dict[str, int]) -> tuple[list[str], list[int]]:
    """BPE by repeated search for the best pair, leftmost first: (symbols, ranks in order of merging)."""
    sym, nxt, prv = list(unit), list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
    heap = [(r, i, unit[i : i + 2]) for i in range(len(unit) - 1) if (r := rank.get(unit[i : i + 2])) is not None]
    heapq.heapify(heap)
    order = []
    while heap:
        r, i, s = heapq.heappop(heap)
        j = nxt[i] if sym[i] else len(sym)
        if j >= len(sym) or sym[i] + sym[j] != s:
            continue
        order.append(r)
        sym[i], sym[j] = s, ""
        nxt[i] = nxt[j]
        if nxt[j] < len(sym):
            prv[nxt[j]] = i
        for a, b in ((prv[i], i), (i, nxt[i])):
            if a >= 0 and b < len(sym) and (q := rank.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (q, a, sym[a] + sym[b]))
    return [s for s in sym if s], order


def merge_short(unit: str, rank: dict[str, int]) -> list[str]:
    """:func:`merge`'s symbols for a short unit, by plain lists."""
    none, get = 1 << 60, rank.get
    sym = list(unit)
    pairs = [get(a + b, none) for a, b in zip(sym, sym[1:], strict=False)]
    while pairs and (r := min(pairs)) < none:
        i = pairs.index(r)
        sym[i : i + 2] = [sym[i] + sym[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(sym[i] + sym[i + 1], none)
        if i:
            pairs[i - 1] = get(sym[i - 1] + sym[i], none)
    return sym


def prove_monotone(pieces: Pieces) -> None:
    """Raise unless every piece, alone, becomes one symbol by merges of rising rank."""
    rank = dict(zip(pieces.strings, pieces.ranks, strict=True))
    for s in pieces.strings:
        got, order = merge(s, rank)
        if got != [s] or order != sorted(order):
            raise ValueError(f"piece {s!r} is not built by merges of rising rank; one walk would not be exact")
    tied = {r for r, n in Counter(pieces.ranks).items() if n > 1}
    if any(r in tied and s.strip(MARK) for s, r in zip(pieces.strings, pieces.ranks, strict=True)):
        raise ValueError("pieces other than runs of marks share a rank; one walk would not be exact")


def unit_pattern(pieces: Pieces) -> str:
    """A pattern whose matches cover any marked text and over whose ends no piece reaches."""
    if any(MARK in s.lstrip(MARK) for s in pieces.strings):
        raise ValueError("a piece holds a space's mark after another character; units can't be cut there")
    odd: set[str] = set()  # letters that share a piece with other marks count as such marks
    while True:
        letter = re.compile(f"[^\\W_{re.escape(''.join(sorted(odd)))}]")
        new = set()
        for s in pieces.strings:
            flags = [bool(letter.match(c)) for c in s.lstrip(MARK)]
            if len(set(flags)) == 2:
                new |= {c for c, f in zip(s.lstrip(MARK), flags, strict=True) if f}
        if not new:
            break
        odd |= new
    cls = f"\\W_{re.escape(''.join(sorted(odd)))}"
    return f"{MARK}*(?:[^{cls}{MARK}]+|(?:(?!{MARK})[{cls}])+)|{MARK}+"


def direct(unit: str, kind: str = "bpe") -> bool:
    """Whether a unit is encoded where it occurs, not in the lattice."""
    return len(unit) > LONGEST or kind == "bpe" and unit.startswith(MARK + MARK)


def mark(text: str | None) -> str:
    """The text as the model sees it: a mark before it and for each space."""
    return MARK + text.replace(" ", MARK) if text else ""


def count_units(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """``unit, n``: the distinct units of all texts with their numbers of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = re.compile(pattern).findall, Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["unit", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                seen.update(find(mark(t.as_py())))
                if len(seen) >= FLUSH:
                    yield flush()
        yield flush()

    return docs.select(text).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """``unit, mask, cuts`` by the relational lattice: where symbols begin, and the last one ends.

    Bit k of ``mask`` is set for character k; a unit longer than ``LONG`` has an array ``cuts`` instead. Units for :func:`direct` are left out.
    """
    spark = units.sparkSession
    table = pa.table({"piece": pa.array(pieces.strings), "rank": pa.array(pieces.ranks, pa.int64()), "score": pa.array(pieces.scores, pa.float32())})
    table = F.broadcast(spark.createDataFrame(table.to_pandas()))  # the vocabulary: of fixed size
    most = max(map(len, pieces.strings))
    own = units.where(F.length("unit") <= LONGEST)
    own = own.where(~F.col("unit").startswith(MARK + MARK)) if pieces.kind == "bpe" else own
    e = own.selectExpr("unit", "explode(sequence(1, length(unit))) as s").selectExpr("unit", "s", f"explode(sequence(1, least({most}, length(unit) - s + 1))) as l")
    if pieces.kind == "bpe":
        e = e.where("l > 1 or s = 1")  # single characters are symbols already; the first keeps a unit without an edge
        e = e.selectExpr("unit", "s", "l", "substring(unit, s, l) as piece").join(table, "piece", "left").where("rank is not null or l = 1")
        # one long an edge: rank, start (0-based), length; sorting longs sorts the edges
        packed = e.selectExpr("unit", "if(l = 1, null, shiftleft(rank, 24) | shiftleft(cast(s - 1 as bigint), 12) | l) as edge")
        g = packed.groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
        at, ln = "cast(shiftright(x, 12) & 4095 as int)", "cast(x & 4095 as int)"
        ends = f"(shiftleft(1L, {at}) | shiftleft(1L, {at} + {ln}))"
        inner = f"(shiftleft(1L, {at} + {ln}) - shiftleft(2L, {at}))"
        mask = f"aggregate(edges, shiftleft(1L, length(unit) + 1) - 1, (m, x) -> if(bit_count(m & {inner}) = 1 and m & {ends} = {ends}, m & ~{inner}, m))"
        met = f"array_contains(m, {at}) and array_contains(m, {at} + {ln}) and size(filter(m, k -> k > {at} and k < {at} + {ln})) = 1"
        cuts = f"aggregate(edges, sequence(0, length(unit)), (m, x) -> if({met}, filter(m, k -> k <= {at} or k >= {at} + {ln}), m))"
        return g.selectExpr("unit", f"if(length(unit) <= {LONG}, {mask}, null) as mask", f"if(length(unit) > {LONG}, {cuts}, null) as cuts")
    unknown = float(np.float32(min(pieces.scores) - UNKNOWN))
    e = e.selectExpr("unit", "s", "l", "substring(unit, s, l) as piece").join(table, "piece", "left").where("score is not null or l = 1")
    e = e.select("unit", (F.col("s") + F.col("l") - 1).alias("e"), (F.col("s") - 1).alias("s"), F.coalesce("score", F.lit(unknown)).cast("float").alias("score"))
    g = e.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("e", "s", "score"))).alias("edges"))
    # best[j]: (score, start) of the best way to the first j characters; edges come by their end, so one walk fills it
    step = "named_struct('score', a[x.s].score + x.score, 's', x.s)"
    put = f"if(size(a) = x.e, array_append(a, {step}), if(a[x.s].score + x.score > a[x.e].score, array_append(slice(a, 1, x.e), {step}), a))"
    g = g.withColumn("best", F.expr(f"aggregate(edges, cast(array(named_struct('score', 0, 's', -1)) as array<struct<score:float,s:int>>), (a, x) -> {put})"))
    back = "reverse(aggregate(sequence(1, length(unit)), struct(length(unit) as j, array(length(unit)) as c), (a, i) -> if(a.j = 0, a, struct(best[a.j].s as j, array_append(a.c, best[a.j].s) as c))).c)"
    return g.select("unit", F.lit(None).cast("long").alias("mask"), F.expr(back).alias("cuts"))


def walk(unit: str, rank: dict[str, int], most: int) -> int:
    """The same lattice and walk for one unit, in memory: its mask. For tests of the relational form."""
    n = len(unit)
    edges = sorted((r, s, ln) for s in range(n - 1) for ln in range(2, min(most, n - s) + 1) if (r := rank.get(unit[s : s + ln])) is not None)
    m = (1 << (n + 1)) - 1
    for _, s, ln in edges:
        ends, inner = 1 << s | 1 << (s + ln), (1 << (s + ln)) - (2 << s)
        if (m & inner).bit_count() == 1 and m & ends == ends:
            m &= ~inner
    return m


def symbols(unit: str, mask: int | None, cuts: list[int] | None = None) -> list[str]:
    cuts = [k for k in range(len(unit) + 1) if mask >> k & 1] if cuts is None else cuts
    return [unit[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Coder:
    """Encodes texts with a dictionary of ready units; what is not in it is merged here."""

    def __init__(self, pieces: Pieces, ready: dict[str, bytes], pattern: str) -> None:
        self.pieces, self.ready = pieces, ready
        self.find = re.compile(pattern).findall
        self.rank = dict(zip(pieces.strings, pieces.ranks, strict=True))
        self.number = dict(zip(pieces.strings, pieces.ids, strict=True))
        self.score = dict(zip(pieces.strings, pieces.scores, strict=True))
        self.most = max(map(len, pieces.strings))
        coder = self

        class Rare(dict):
            def __missing__(self, u: str) -> bytes:
                code = coder.ids(coder.symbols(u))
                if len(self) >= len(ready) + RARE:
                    self.clear()
                    self.update(coder.ready)
                if len(u) <= LONG:
                    self[u] = code
                return code

        self.known = Rare(ready)

    def symbols(self, unit: str) -> list[str]:
        if self.pieces.kind == "unigram":
            return viterbi(unit, self.score, self.most)
        return merge(unit, self.rank)[0] if len(unit) > LONG else merge_short(unit, self.rank)

    def ids(self, symbols: list[str]) -> bytes:
        out: list[int] = []
        for s in symbols:
            i = self.number.get(s)
            out += [i] if i is not None else [self.pieces.bytes_[x] for x in s.encode()]
        return array("i", out).tobytes()

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.known.__getitem__, self.find(mark(text))))


def frequent_units(units: DataFrame, limit: int) -> DataFrame:
    """The units from a least count on, ``limit`` at most."""
    steps = units.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).orderBy(F.desc("b")).collect()
    least, total = 1 << 62, 0
    for r in steps:  # a few hundred rows at most
        if total + r.k > limit:
            break
        least, total = r.n, total + r.k
    return units.where(F.col("n") >= least)


def ready_units(docs: DataFrame, pieces: Pieces, text: str = "text", head: int = HEAD) -> pa.Table:
    """``unit, mask, cuts`` of the most frequent units of the corpus, by the relational lattice."""
    spark = docs.sparkSession
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    old = spark.conf.get(name)
    counted = cut(count_units(docs, unit_pattern(pieces), text), "units")
    # Edges arrive unit by unit; small hash maps save a sort of all edges. Beyond it Spark sorts and spills.
    spark.conf.set(name, "60000")
    try:
        return encode_units(frequent_units(counted, head).repartition("unit"), pieces).toArrow()
    finally:
        spark.conf.set(name, old)
        drop_cut(counted)


_CODERS: dict[str, Coder] = {}


def encode(docs: DataFrame, path: str, text: str = "text", head: int = HEAD, pieces: Pieces | None = None) -> DataFrame:
    """``docs`` plus ``ids`` (array of int), ``n_pieces`` and ``round_trip`` (the ids decode to the text)."""
    spark = docs.sparkSession
    pieces = pieces or Pieces.load(path)
    if pieces.kind == "bpe":
        prove_monotone(pieces)
    if len(pieces.bytes_) != 256:
        raise ValueError("the model has no byte pieces for characters without a piece")
    pattern = unit_pattern(pieces)
    sink = pa.BufferOutputStream()
    ready = ready_units(docs, pieces, text, head)
    coded = Coder(pieces, {}, pattern)
    ready = pa.table({"unit": ready["unit"], "ids": pa.array((coded.ids(symbols(*x)) for x in zip(*(ready[c].to_pylist() for c in ("unit", "mask", "cuts")), strict=True)), pa.binary())})
    with pa.ipc.new_stream(sink, ready.schema) as w:
        w.write_table(ready)
    key = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast((pieces, sink.getvalue().to_pybytes()))
    names = carried(docs, "ids", "n_pieces", "round_trip")
    schema = T.StructType([*(T.StructField(names[f.name], f.dataType) for f in docs.schema), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    at = docs.columns.index(text)

    def coder() -> Coder:
        """Built once for each Python worker."""
        if key not in _CODERS:
            _CODERS.clear()
            pieces, stream = shared.value
            t = pa.ipc.open_stream(stream).read_all()
            _CODERS[key] = Coder(pieces, dict(zip(t["unit"].to_pylist(), t["ids"].to_pylist(), strict=True)), pattern)
        return _CODERS[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder()
        spell = c.pieces.spell()
        table = [spell.get(i, b"") for i in range(max(spell) + 1)]
        for b in batches:
            codes, trips = [], []
            for t in b.column(at):
                s = t.as_py()
                code = c.text(s)
                codes.append(code)
                trips.append(decode_ids(np.frombuffer(code, np.int32), table) == (s or ""))
            sizes = np.array([len(x) // 4 for x in codes], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(codes), np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(sizes), pa.array(trips, pa.bool_())], names=schema.names)

    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).mapInArrow(run, schema)


def decode_ids(ids: np.ndarray, table: list[bytes]) -> str:
    """The text of a sequence of ids; the mark before the text goes."""
    raw = b"".join(map(table.__getitem__, ids.tolist()))
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")
