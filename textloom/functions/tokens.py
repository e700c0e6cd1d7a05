"""Token counts: the byte approximation as a Column, others as Python counters for executors."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def approx_tokens(text: Column) -> Column:
    """UTF-8 bytes div 3."""
    return F.floor(F.octet_length(text) / 3).cast("int")


class Approx:
    name = "approx"
    native = True

    def count(self, text: str) -> int:
        return (len(text) if text.isascii() else len(text.encode())) // 3

    def encode(self, text: str) -> tuple[int, ...]:
        return tuple(text.encode())


class Characters:
    """One character, one token."""

    name = "characters"
    native = False

    def count(self, text: str) -> int:
        return len(text)

    def encode(self, text: str) -> tuple[int, ...]:
        return tuple(map(ord, text))


class _Cached:
    native = False

    def __init__(self) -> None:
        self._count = lru_cache(1000)(lambda t: len(self.encode(t)))

    def count(self, text: str) -> int:
        return self._count(text)

    def clear_cache(self) -> None:
        self._count.cache_clear()


class RankFile(_Cached):
    """tiktoken over a local rank file, or a named encoding where that can be loaded."""

    name = "tiktoken"

    def __init__(self, model: str = "gpt-4o-mini", rank_file: str | None = None, pattern: str | None = None) -> None:
        super().__init__()
        try:
            import tiktoken
        except ImportError as e:
            raise ImportError("this tokenizer needs the package tiktoken") from e
        if rank_file is None:
            self._encoding = tiktoken.encoding_for_model(model)
        else:
            import base64

            with open(rank_file, "rb") as f:
                ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
            self._encoding = tiktoken.Encoding("local", pat_str=pattern or r"\s?\S+|\s+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> tuple[int, ...]:
        return tuple(self._encoding.encode(text, disallowed_special=()))


class TokenizerFile(_Cached):
    """A ``tokenizer.json`` file; counts include the special tokens that its template adds."""

    name = "transformers"

    def __init__(self, path: str) -> None:
        super().__init__()
        try:
            from tokenizers import Tokenizer
        except ImportError as e:
            raise ImportError("this tokenizer needs the package tokenizers") from e
        self._tok = Tokenizer.from_file(path)

    def encode(self, text: str) -> tuple[int, ...]:
        return tuple(self._tok.encode(text).ids)


class Custom(_Cached):
    """Any function from a text to its number of tokens."""

    name = "custom"

    def __init__(self, count: Callable[[str], int]) -> None:
        super().__init__()
        self._count = lru_cache(1000)(count)

    def encode(self, text: str) -> tuple[int, ...]:
        return tuple(range(self.count(text)))


REGISTRY: dict[str, Callable[..., object]] = {"approx": Approx, "characters": Characters, "tiktoken": RankFile, "transformers": TokenizerFile, "custom": Custom}


@lru_cache(16)
def tokenizer(name: str = "approx", *args) -> object:
    """A tokenizer by name, built once for each Python worker and argument list."""
    if name not in REGISTRY:
        raise ValueError(f"Unsupported tokenizer: {name}")
    return REGISTRY[name](*args)
