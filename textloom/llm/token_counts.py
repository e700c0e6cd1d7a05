"""Token counts with a byte-level BPE vocabulary: the whole-token shortcut.

On the driver it is proved once, for each vocabulary string, whether it is a single pre-token that
the tokenizer encodes alone as one token. On the executors a text is cut into pre-tokens; those
in the proven set count 1 without any merging, and only the rest goes through the merges. Counts of
short stretches of text (a run of white space with the word after it, where a pre-token can never reach
over the edges) are remembered, in a dictionary of bounded size, so the same stretch is cut up and merged once a worker.

Strings of added special tokens inside texts count as the library counts them by default: one token each.

Defined results: null counts as empty, 0 tokens; repeated rows are counted one by one; extra columns, whatever their names, are
passed through by :func:`count_tokens` (those named like a result as ``<name>_input``); an empty table gives an empty result; a text
of any length is counted whole, in memory proportional to that one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import carried

#: Unicode White_Space, as the tokenizer's pattern sees it. A fixed value.
SPACE = r"\t-\r \x85\xa0  -     　"
#: The pre-tokenizer's pattern with white space spelt out. A fixed value.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: No pre-token reaches over the end of such a stretch.
STRETCH = rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
#: Entries of a worker's dictionary, and the longest stretch that it keeps.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
OVER = 512


def whole_tokens(model: bytes) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token, proved by encoding them."""
    import regex
    from tokenizers import Tokenizer

    tok = Tokenizer.from_buffer(model)
    pattern = regex.compile(PATTERN)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    strings = {tok.decode([i], skip_special_tokens=False) for i in range(tok.get_vocab_size())}
    strings = sorted(s for s in strings if s and "�" not in s and s not in special and pattern.fullmatch(s) and pattern.findall(s) == [s])
    codes = tok.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, c in zip(strings, codes, strict=True) if len(c.ids) == 1)


class Counter:
    """Counts the tokens of texts; one for each Python worker."""

    def __init__(self, model: bytes, whole: frozenset[str]) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_buffer(model)
        self.whole = whole
        special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.stretches = re.compile(STRETCH).findall
        merges = self.tok.model
        # the model alone, on a pre-token in its byte alphabet: merges and nothing else
        self.merge = lambda p: len(merges.tokenize(p.encode().decode("latin-1").translate(_BYTES)))
        counter = self

        class Memo(dict):
            def __missing__(self, s: str) -> int:
                n = counter.stretch(s)
                if len(s) <= MEMO_CHARS:
                    if len(self) >= MEMO_ENTRIES:
                        self.clear()
                    self[s] = n
                return n

        self.memo = Memo()

    def stretch(self, s: str) -> int:
        return sum(1 if p in self.whole else self.merge(p) for p in self.pieces(s))

    def count(self, text: str) -> int:
        n, parts = 0, [text]
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            n = len(parts) - 1
        get = self.memo.__getitem__
        return n + sum(sum(map(get, self.stretches(p))) for p in parts)


def _byte_alphabet() -> dict[int, int]:
    """Byte-level BPE writes each byte as one character: printable Latin-1 as itself, the others, in order, from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(others)}


_BYTES = _byte_alphabet()


def count_tokens(docs: DataFrame, path: str, text: str = "text", over: int = OVER) -> DataFrame:
    """Columns of ``docs`` without ``text``, plus ``n_bytes``, ``n_tokens``, ``over_limit``."""
    model = Path(path).read_bytes()  # of fixed size; executors need not see the driver's files
    shared = docs.sparkSession.sparkContext.broadcast((model, whole_tokens(model)))
    names = carried(docs, "n_bytes", "n_tokens", "over_limit", without=(text,))
    fields = {f.name: f for f in docs.schema}
    schema = T.StructType([T.StructField(new, fields[old].dataType) for old, new in names.items()] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for b in batches:
            sizes, counts = [], []
            for t in b.column(len(names)):
                s = t.as_py() or ""
                sizes.append(len(s.encode()))
                counts.append(counter.count(s))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > over for c in counts], pa.bool_())], names=schema.names)

    return docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col(text).alias("text")).mapInArrow(run, schema)
