"""N-gram Jaccard join: an exact size-aware heavy-light self-join of shingle sets, and its components.

A document's set is its distinct five-word shingles, as 64-bit hashes. Documents with equal sets form a class
first, so copies cost one row each. Between classes, two ways find every pair of similarity 3/4 or more:

* light sets (at most ``boundary`` shingles) enumerate, for each size that a partner may have, all
  subsets of the size that the overlap must reach. Sharing one proves the link; nothing is verified.
* heavy sets scan inverted lists. A set is listed under its rarest shingles only (the prefix filter: a
  quarter of them when it is the larger of a pair, a seventh when it is the smaller). Lists also hold the light sets that a heavy
  one can match.

The boundary is chosen by cost: rows of subsets against rows of lists and their share of verifications, over the sizes in a sample.

Lists never emit all their pairs. A short list (``SHORT`` rows) pairs a row with those before it, and bitmaps drop pairs that merely share a
passage. A longer one hands its members, once each, to its pivot: the member with the smallest share of private shingles, which near copies of one
text agree on, so the hundred lists that they share become one ball around one pivot. Every pair that a long list holds lies in
the ball of its pivot. A ball is read in one pass: the pivot is compared with all, then each member that isn't yet in the
largest component, until all pairs lie within a component or are known to be apart; only a spanning forest is emitted. So rows grow with
members, while comparisons inside a ball grow with its members times those that stay outside of its largest component.

A ball of more than ``BLOCK`` shingles is dealt into blocks, and each pair of blocks is a ball of its own; memory is bounded by two blocks
(and by the longest text), and a row is sent as often as its ball has blocks.

The order of shingles (rarest first) has three levels; any order gives the same links. Last come shingles that a bounded sample holds often, by
their count there. Before them come crowded ones, those that two documents of a fixed share of the corpus have in common: so lists stay short whatever the
size of the corpus, except those of near copies. They are known by a bit filter of fixed size; a wrong bit costs nothing but order. Lists of shingles that are
frequent in the bounded sample are never windowed: their pivots are partial minima, joined back where a skewed join can be split.

Defined results: a null or blank text has no shingles and is its own component; fewer than five words make
one shingle; repeated rows are copies; a null doc_id takes no part and gets a null component; extra
columns are ignored, whatever their names; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SMALL_BATCHES, cut, drop_cut, settings
from textloom.llm.components import components

WIDTH = 5
#: The similarity as a fraction: 4 * common >= 3 * union.
NUM, DEN = 3, 4
#: Documents in the sample that orders the shingles and sets the boundary, and least sample count of a frequent shingle.
SAMPLE_DOCS, FREQUENT = 8192, 3
#: Lists of so many rows pair all of them.
SHORT = 8
#: Shingles of a block of a ball; a member counts as ``LEAST_MEMBER`` shingles at least.
BLOCK, LEAST_MEMBER = 1 << 20, 256
#: Members of a ball that are compared with all others before its largest component is chosen.
FIRST = 8
#: Every so many documents are searched for crowded shingles, those that two of them share; bits of the filter that holds these.
CROWD_STEP, CROWD_BITS = 8, 1 << 26
#: Bits of the filter that keeps uninvolved texts out of a shuffle.
FILTER_BITS = 1 << 24
MAX_BOUNDARY = 10
#: Cost of a verification in rows.
VERIFY_COST = 40

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    w = (text or "").encode().translate(_LOWER).split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    with np.errstate(over="ignore"):
        k = min(WIDTH, len(w))
        s = np.full(len(w) - k + 1, 0 if k == WIDTH else k, np.uint64)
        for i in range(k):
            x = h[i : len(h) - k + 1 + i] * _C[i]
            s = (s ^ (x ^ (x >> np.uint64(31)))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(s ^ (s >> np.uint64(29)))


def least_overlap(a: int, b: int) -> int:
    """Fewest common shingles of linked sets of sizes a and b."""
    return -(-NUM * (a + b) // (NUM + DEN))


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle, by its low bits, in a power of two of bits: two to four for each."""
    width = 1 << max(6, (2 * len(s) - 1).bit_length())
    at = (s & np.uint64(width - 1)).astype(np.int64)
    bits = np.zeros(width, bool)
    bits[at] = True
    return np.packbits(bits).tobytes()


def overlap_bound(a: bytes, na: int, b: bytes, nb: int) -> int:
    """No fewer than the common shingles of two sets: a differing bit is a shingle that only one of them has."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):  # the wider one folds to the other's width
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    differ = int(np.bitwise_count(x ^ y).sum())
    return min(na, nb, (na + nb - differ) // 2)


def partner_sizes(n: int) -> range:
    return range(-(-NUM * n // DEN), DEN * n // NUM + 1)


def subset_rows(n: int) -> int:
    return sum(comb(n, c) for m in partner_sizes(n) if (c := least_overlap(n, m)) <= n)


def prefix_rows(n: int) -> int:
    return n // DEN + 1


def choose_boundary(sizes: np.ndarray, hits: float) -> int:
    """Largest size of light sets: where the rows of subsets cost least against lists and their verifications.

    ``hits``: verifications that a row of a list leads to, on average.
    """
    cost = {x: sum(subset_rows(int(n)) if n <= x else prefix_rows(int(n)) * (1 + hits * VERIFY_COST) for n in sizes) for x in range(MAX_BOUNDARY + 1)}
    return min(cost, key=lambda x: (cost[x], x))


def subset_keys(s: np.ndarray) -> list[int]:
    """Hashes of (two sizes, subset); the low bit is set where the sizes differ, as then only sets of different sizes link."""
    out, n = [], len(s)
    for m in partner_sizes(n):
        c = least_overlap(n, m)
        if c <= min(n, m):
            tag = b"%d,%d," % (min(n, m), max(n, m))
            keys = (int.from_bytes(hashlib.blake2b(tag + np.array(x, np.uint64).tobytes(), digest_size=8).digest(), "little", signed=True) for x in combinations(s.tolist(), c))
            out += [k & ~1 | (n != m) for k in keys]
    return out


def _ordered(s: np.ndarray, frequent: np.ndarray, counts: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A set, rarest first; which of it is frequent; how many are neither frequent nor crowded."""
    level = _bit(crowded, s, CROWD_BITS).astype(np.int64)
    hot = np.zeros(len(s), bool)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        hot = frequent[at] == s
        level[hot] = 1 + counts[at][hot]
    o = np.lexsort((s, level))
    return s[o], hot[o], int((level == 0).sum())


def _bit(table: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    at = h & np.uint64(bits - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit filter of a column of hashes, made where the rows are; ``bits / 64`` words at most reach the driver."""
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = hashes.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits"))
    got = words.toArrow()
    table = np.zeros(bits // 64, np.int64)
    if got.num_rows:
        table[got["w"].to_numpy()] = got["bits"].to_numpy()
    return table.view(np.uint64)


def _crowded(docs: DataFrame) -> np.ndarray:
    """The bit filter of shingles that two documents of each ``CROWD_STEP``-th have in common."""
    rows = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(CROWD_STEP)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(sets) if sets else np.empty(0, np.uint64)).view(np.int64))], names=["s"])

    return _filter(rows.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") > 1), "s", CROWD_BITS)


def _sample(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequent shingles of the sample, sorted, with their counts; and the boundary."""
    step = max(1, docs.count() // SAMPLE_DOCS)
    rows = docs.select("text").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(step)) == 0).limit(2 * SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["fp", "s"])

    sets = rows.mapInArrow(run, "fp binary, s array<long>").dropDuplicates(["fp"])
    counted = cut(sets, "sample")
    sizes = np.array([r[0] for r in counted.select(F.size("s")).where("size(s) > 0").collect()])
    top = counted.select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT).toArrow()
    drop_cut(counted)
    keys = top["s"].to_numpy().view(np.uint64) if top.num_rows else np.empty(0, np.uint64)
    n = top["count"].to_numpy() if top.num_rows else np.empty(0, np.int64)
    o = np.argsort(keys)
    hits = float(n.sum()) / max(1, int(sizes.sum()))
    return keys[o], n[o], choose_boundary(sizes, hits)


def signatures(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray, boundary: int, crowded: np.ndarray) -> DataFrame:
    """A row per document: size, set's fingerprint; for the first of a set in a task its list keys as well."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((frequent, counts, crowded))  # of bounded sizes
    arrays = ["cold", "hot", "subsets"]
    schema = "doc_id long, th long, n int, f1 long, f2 long, sid long, own int, bits binary, " + ", ".join(f"{a} array<long>" for a in arrays)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, crowded = shared.value
        seen, serial = set(), TaskContext.get().partitionId() << 33
        least = -(-NUM * (boundary + 1) // DEN)
        for b in batches:
            n, fps, sids, own, bits, cols = [], [], [], [], [], {a: [] for a in arrays}
            for doc, t in zip(b.column("doc_id"), b.column("text"), strict=True):
                s = shingles(t.as_py())
                fp = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                n.append(len(s))
                fps.append(np.frombuffer(fp, np.int64))
                # a row without an id takes no part, so it cannot speak for its set
                first = len(s) > 0 and doc.is_valid and fp not in seen
                if first:
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(fp)
                    serial += 1
                sids.append(serial if first else None)
                bits.append(bitmap(s) if first else None)
                lists: dict[str, object] = dict.fromkeys(arrays)
                private = 0
                if first and len(s) >= least:
                    o, hot, private = _ordered(s, frequent, counts, crowded)
                    o, hot = o[: prefix_rows(len(s))].view(np.int64), hot[: prefix_rows(len(s))]
                    lists |= {"cold": o[~hot], "hot": o[hot]}  # hot ones come last
                own.append(255 * private // max(len(s), 1))
                if first and len(s) <= boundary:
                    lists["subsets"] = subset_keys(s)
                for a in arrays:
                    cols[a].append(lists[a])
            f = np.array(fps, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(n, pa.int32()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(sids, pa.int64()), pa.array(own, pa.int32()), pa.array(bits, pa.binary()), *(pa.array(cols[a], pa.list_(pa.int64())) for a in arrays)],
                names=["doc_id", "th", "n", "f1", "f2", "sid", "own", "bits", *arrays],
            )

    return docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text").mapInArrow(run, schema)


_LINKED = f"{NUM + DEN} * i >= {NUM} * (na + nb)"
_FITS = f"{DEN} * least({{0}}, {{1}}) >= {NUM} * greatest({{0}}, {{1}})"
#: n and place of a list's row, packed in one long with the share of private shingles above them.
_N, _AT = "cast(shiftright({0}, 24) & 2147483647 as int)", "cast({0} & 16777215 as int)"


def _listed(speak: DataFrame, column: str, before: str) -> DataFrame:
    """``tok, sid, m``: a row for each listed shingle; ``m`` packs (share of private shingles, n, place)."""
    rows = speak.select("sid", F.expr(f"shiftleft(cast(own as bigint), 55) | shiftleft(cast(n as bigint), 24) as m"), F.expr(before).alias("k"), F.posexplode(column).alias("i", "tok"))
    return rows.select("tok", "sid", F.expr("m | least(k + i, 16777215)").alias("m"))


def _short_pairs(rows: DataFrame, boundary: int) -> DataFrame:
    """All pairs of lists of ``SHORT`` rows at most that the list's places allow to be linked: each row with those before it."""
    p = rows.withColumn("_p", F.expr(f"collect_list(struct(sid, m)) over (partition by tok order by sid rows between {SHORT - 1} preceding and 1 preceding)"))
    p = p.select("sid", "m", F.explode("_p").alias("o")).selectExpr("o.sid as a", "sid as b", *(f"{x.format(c)} as {name}" for x, c, name in ((_N, "o.m", "na"), (_N, "m", "nb"), (_AT, "o.m", "ia"), (_AT, "m", "ib"))))
    # at the first shingle that a linked pair shares, both sets have the least overlap still before them
    need = f"({NUM} * (na + nb) + {NUM + DEN - 1}) div {NUM + DEN}"
    return p.where(F.expr(f"{_FITS.format('na', 'nb')} and greatest(na, nb) > {boundary} and ia + {need} <= na and ib + {need} <= nb")).select("a", "b").distinct()


def _bounded(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """``a, b, na, nb`` of those pairs whose bitmaps allow a link."""
    w = pairs.join(heads.selectExpr("sid as a", "n as na", "bits as ba"), "a").join(heads.selectExpr("sid as b", "n as nb", "bits as bb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            i = np.array([overlap_bound(*x) for x in zip(b.column("ba").to_pylist(), na.tolist(), b.column("bb").to_pylist(), nb.tolist(), strict=True)], np.int64)
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array((NUM + DEN) * i >= NUM * (na.astype(np.int64) + nb)))

    return w.select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long, na int, nb int")


def _balls(rows: DataFrame) -> DataFrame:
    """``p, sid, n``: the members of long lists by their pivot, which is a member itself."""
    pivots = rows.groupBy("tok").agg(F.min(F.struct(F.shiftright("m", 55).alias("own"), "sid")).alias("v"))
    return rows.join(pivots, "tok").selectExpr("v.sid as p", "sid", f"{_N.format('m')} as n").distinct()


def _units(balls: DataFrame) -> DataFrame:
    """``p, i, j, sid``: balls, those of several blocks as pairs of blocks (i < j), each with the pivot."""
    nb = cut(balls.groupBy("p").agg(F.expr(f"sum(greatest(n, {LEAST_MEMBER})) div {BLOCK} + 1").alias("nb"), F.count(F.lit(1)).alias("c")), "blocks")
    u = balls.join(nb.where("c > 1").drop("c"), "p").withColumn("b", F.expr("pmod(xxhash64(sid), nb)"))
    one = u.where("nb = 1").selectExpr("p", "0L as i", "0L as j", "sid")
    if not nb.where("nb > 1").limit(1).count():
        return one
    many = u.where("nb > 1").withColumn("o", F.explode(F.expr("sequence(0L, nb - 1)"))).where("b <> o").selectExpr("p", "least(b, o) as i", "greatest(b, o) as j", "sid")
    pivot = nb.where("nb > 1").select("p", F.explode(F.expr("sequence(0L, nb - 2)")).alias("i"), "nb").select("p", "i", F.explode(F.expr("sequence(i + 1, nb - 1)")).alias("j"), F.col("p").alias("sid"))
    return one.unionByName(many.unionByName(pivot).distinct())


def _texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``sid, z``: compressed texts of the sets in ``asked`` (sid, doc_id, th); a fixed-size bit filter keeps most others out of the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(asked, "th", FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, table = zstandard.ZstdCompressor(level=3), shared.value
        for b in batches:
            own = b.filter(pa.array(_bit(table, b.column("th").to_numpy().view(np.uint64), FILTER_BITS)))
            packed = [z.compress((t.as_py() or "").encode()) for t in own.column("text")]
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("th"), pa.array(packed, pa.binary())], names=["doc_id", "th", "z"])

    found = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, th long, z binary")
    return asked.join(found, ["doc_id", "th"]).select("sid", "z").dropDuplicates(["sid"])


def forest(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the place of one set of its component: every pair is compared, or lies within a component.

    The first ``FIRST`` sets are compared with all; then those that are not in the largest component.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    lab = np.arange(m)
    if m == 2:
        if (NUM + DEN) * len(np.intersect1d(sets[0], sets[1], assume_unique=True)) >= NUM * n.sum():
            lab[1] = 0
        return lab
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.concatenate([[0], np.cumsum(n)])
    shared = times[number] > 1  # only shingles that two sets have count
    at = np.concatenate([[0], np.cumsum(shared)])[ends]
    flat = (np.cumsum(times > 1) - 1)[number[shared]].astype(np.int32)
    mask = np.zeros(int((times > 1).sum()) + 1, np.uint8)
    largest = -1
    for i in range(m):
        if i == FIRST:
            largest = int(np.flatnonzero(lab == np.bincount(lab).argmax())[0])
        if largest >= 0 and lab[i] == lab[largest]:
            continue
        own = flat[at[i] : at[i + 1]]
        mask[own] = 1
        met = np.concatenate([[0], np.cumsum(mask[flat], dtype=np.int64)])[at]
        mask[own] = 0
        linked = (NUM + DEN) * np.diff(met) >= NUM * (n + n[i])
        linked[i] = True
        joined = np.unique(lab[linked])
        if len(joined) > 1:
            lab[np.isin(lab, joined)] = joined[0]
    return lab


def _links(units: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: a spanning forest of each unit's links."""
    spark = units.sparkSession
    rows = units.join(texts, "sid").select("p", "i", "j", "sid", "z")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p", "i", "j").sortWithinPartitions("p", "i", "j", F.expr("sid <> p"), "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdDecompressor()
        now, sids, sets = None, [], []
        out: tuple[list[int], list[int]] = ([], [])

        def close() -> None:
            if len(sids) > 1:
                lab = forest(sets)
                own = np.array(sids, np.int64)
                moved = np.flatnonzero(lab != np.arange(len(own)))
                out[0].extend(own[lab[moved]].tolist())
                out[1].extend(own[moved].tolist())
            sids.clear()
            sets.clear()

        for b in batches:
            for key, sid, packed in zip(zip(*(b.column(k).to_pylist() for k in "pij"), strict=True), b.column("sid").to_pylist(), b.column("z"), strict=True):
                if key != now:
                    close()
                    now = key
                sids.append(sid)
                sets.append(shingles(z.decompress(packed.as_py()).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])
            out = ([], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signatures, roots): all signatures, and (node, root) for sets that are not the smallest of their component."""
    with settings(docs.sparkSession, **SMALL_BATCHES):
        frequent, counts, boundary = _sample(docs)
        sig = cut(signatures(docs, frequent, counts, boundary, _crowded(docs)), "signatures")
        known = sig.where("sid is not null and doc_id is not null")
        # one set of each fingerprint speaks for its copies
        first = known.groupBy("f1", "f2").agg(F.min("sid").alias("sid")).select("sid")
        heads = cut(known.select("sid", "doc_id", "th", "n", "bits").join(first, "sid", "left_semi"), "heads")
        speak = known.select("sid", "n", "own", "cold", "hot", "subsets").join(heads.select("sid"), "sid", "left_semi")
        # light with light
        light = speak.where("subsets is not null").select("sid", "n", F.explode("subsets").alias("k"))
        star = light.groupBy("k").agg(F.min("sid").alias("m"), F.count(F.lit(1)).alias("c"), (F.min("n") < F.max("n")).alias("mixed")).where("c > 1 and (k & 1 = 0 or mixed)")
        light_links = light.join(star, "k").where("sid <> m").select(F.col("m").alias("a"), F.col("sid").alias("b")).distinct()
        # heavy with all
        cold = cut(_listed(speak, "cold", "0").withColumn("c", F.expr("count(1) over (partition by tok)")).where("c > 1"), "lists")
        near = cut(_bounded(_short_pairs(cold.where(F.col("c") <= SHORT), boundary), heads), "near")
        balls = _balls(cold.where(F.col("c") > SHORT).drop("c").unionByName(_listed(speak.where("size(hot) > 0"), "hot", "size(cold)")))
        pairs = near.select(F.col("a").alias("p"), F.explode(F.expr("array(struct(a as sid, na as n), struct(b as sid, nb as n))")).alias("o")).select("p", "o.sid", "o.n")
        balls = cut(balls.unionByName(pairs).distinct(), "balls")
        units = cut(_units(balls), "units")
        asked = cut(heads.select("sid", "doc_id", "th").join(units.select("sid").distinct(), "sid", "left_semi"), "asked")
        found = cut(_links(units, _texts(docs, asked)), "links")
        root = components(light_links.unionByName(found))
        for x in (heads, cold, near, balls, units, asked, found):
            drop_cut(x)
        return sig, root


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sig, root = links(d)
    known = sig.where("n > 0 and doc_id is not null")
    sets = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("low"), F.min("sid").alias("sid"))
    sets = sets.join(root, sets["sid"] == root["node"], "left").select("f1", "f2", "low", F.coalesce("root", "sid").alias("root"))
    low = sets.groupBy("root").agg(F.min("low").alias("component_id"))
    per = sets.join(low, "root").select("f1", "f2", "component_id")
    joined = sig.join(per, ["f1", "f2"], "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: of the smallest (doc_id, hash of the text); of equal rows any one.

    Blank texts stay, one for each id. A row with a null doc_id has no component: it stays unless its text is that of a row
    with an id or of another row without one. All columns of ``docs``, whatever their names, come back as they were.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"))
    sig, root = links(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    own = sig.where("doc_id is not null")
    # components are told apart by their sets: ones whose smallest ids are equal stay apart
    sets = own.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "th")).alias("low"), F.min("sid").alias("sid"))
    sets = sets.join(root, sets["sid"] == root["node"], "left").select("low", F.coalesce("root", "sid").alias("root"))
    best = sets.groupBy("root").agg(F.min("low").alias("low")).select("low.doc_id", "low.th")
    blank = own.where("n = 0").groupBy("doc_id").agg(F.min("th").alias("th"))
    null = sig.where("doc_id is null").select("doc_id", "th").distinct().join(own.where("n > 0").select("th"), "th", "left_anti").select("doc_id", "th")
    count = sig.groupBy(F.col("doc_id").alias("id"), F.col("th").alias("h")).agg(F.count(F.lit(1)).alias("copies"))
    chosen = best.unionByName(blank).unionByName(null)
    kept = cut(chosen.join(count, F.expr("doc_id <=> id and th = h")).select("doc_id", "th", "copies"), "kept")

    def rows(where: str) -> DataFrame:
        return packed.join(kept.where(where), F.expr("id <=> doc_id and h = th"), "left_semi")

    one = rows("copies = 1")
    if kept.where("copies > 1").limit(1).count():
        one = one.unionByName(rows("copies > 1").dropDuplicates(["id", "h"]))
    return one.select("row.*")
