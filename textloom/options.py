"""Options of splitting, validated on the driver."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields

#: The block kinds that parsers emit, and those that a table config may take.
BLOCK_KINDS = ("paragraph", "blockquote", "list", "list_item", "table", "html_table", "code_block", "code_fence", "html_block", "front_matter", "math_block", "math_block_eqno")
TABLES = ("table", "html_table")
TOPOLOGIES = ("section", "subtree", "sibling")
FORMATS = ("auto", "markdown", "html", "docx")


@dataclass(frozen=True)
class BlockOption:
    """How blocks of one kind are treated: alone in a chunk, split when too large, with a budget of their own."""

    kind: str
    isolated: bool = False
    split: bool = True
    max_tokens: int | None = None
    repeat_header: bool = True

    def __post_init__(self) -> None:
        if not isinstance(self.kind, str) or not self.kind.strip():
            raise ValueError("a block option needs a kind")
        object.__setattr__(self, "kind", self.kind.strip().lower())
        for name in ("isolated", "split", "repeat_header"):
            if not isinstance(getattr(self, name), bool):
                raise TypeError(f"{name} must be a bool")
        if self.max_tokens is not None:
            if isinstance(self.max_tokens, bool) or not isinstance(self.max_tokens, int):
                raise TypeError("max_tokens must be an int")
            if self.max_tokens <= 0:
                raise ValueError("max_tokens must be positive")
        if not self.repeat_header and self.kind not in TABLES:
            raise ValueError("repeat_header is for tables only")


def options_by_kind(options: Iterable[BlockOption] | None) -> dict[str, BlockOption]:
    if isinstance(options, Mapping):
        raise TypeError("block options are a sequence, not a mapping")
    found: dict[str, BlockOption] = {}
    for o in options or ():
        if not isinstance(o, BlockOption):
            raise TypeError(f"not a block option: {o!r}")
        if o.kind in found:
            raise ValueError(f"two options for block kind {o.kind!r}")
        found[o.kind] = o
    return found


def from_mapping(raw: Mapping[str, Mapping[str, object]] | None) -> list[BlockOption] | None:
    if raw is None:
        return None
    known = {f.name for f in fields(BlockOption)} - {"kind"}
    out = []
    for kind, config in raw.items():
        if not isinstance(config, Mapping):
            raise TypeError(f"options of {kind!r} must be an object")
        allowed = known if kind.strip().lower() in TABLES else known - {"repeat_header"}
        if unknown := set(config) - allowed:
            raise ValueError(f"unknown option(s) for {kind!r}: {', '.join(sorted(unknown))}; valid: {', '.join(sorted(allowed))}")
        out.append(BlockOption(kind, **config))
    return out


def from_json(raw: str | None) -> list[BlockOption] | None:
    """Options from a JSON object of objects by kind; nothing from nothing."""
    text = (raw or "").strip()
    return from_mapping(_object(text)) if text else None


def _object(text: str) -> Mapping:
    try:
        found = json.loads(text)
    except ValueError:
        raise ValueError("block options are not valid JSON") from None
    if isinstance(found, Mapping):
        return found
    raise TypeError("block options must be a JSON object")


def from_short(entries: Iterable[str], raw_json: str = "", kinds: Iterable[str] = BLOCK_KINDS) -> list[BlockOption]:
    """``KIND[:isolated][:nosplit][:TOKENS]`` entries; JSON entries of the same kind win."""
    found: dict[str, BlockOption] = {}
    kinds = set(kinds)
    for entry in entries:
        kind, *flags = (p.strip().lower() for p in entry.split(":"))
        if kind not in kinds:
            raise ValueError(f"unknown block kind {kind!r}; valid: {', '.join(sorted(kinds))}")
        config: dict[str, object] = {}
        for flag in filter(None, flags):
            if flag == "isolated":
                config["isolated"] = True
            elif flag == "nosplit":
                config["split"] = False
            elif flag.lstrip("+-").isdigit():
                config["max_tokens"] = int(flag)
            else:
                raise ValueError(f"unknown block option {flag!r}")
        found[kind] = BlockOption(kind, **config)
    found |= {o.kind: o for o in from_json(raw_json) or ()}
    return list(found.values())


@dataclass(frozen=True)
class SplitOptions:
    """All options of one splitting job."""

    topology: str = "section"
    exact: bool = False
    max_tokens: int = 1200
    ideal_ratio: float = 0.8
    merge_below_ratio: float = 0.125
    skip_empty: bool = True
    heading_sensitive: bool = True
    max_heading_level: int | None = None
    blocks: tuple[BlockOption, ...] = ()

    def __post_init__(self) -> None:
        if self.topology not in TOPOLOGIES:
            raise ValueError(f"Unsupported splitter: {self.topology}")
        if self.max_tokens <= 0:
            raise ValueError("max_tokens must be positive")
        if not 0 < self.ideal_ratio <= 1:
            raise ValueError("ideal_ratio must be in (0, 1]")
        if not 0 <= self.merge_below_ratio < 1:
            raise ValueError("merge_below_ratio must be in [0, 1)")
        if self.max_heading_level is not None and self.max_heading_level < 0:
            raise ValueError("max_heading_level must not be negative")
        options_by_kind(self.blocks)

    @staticmethod
    def named(name: str = "section", **options) -> SplitOptions:
        """From a splitter's public name: ``section``, ``exact-sibling``, ``incremental-subtree``, ..."""
        mode, _, topology = name.rpartition("-")
        if mode not in ("", "exact", "incremental"):
            raise ValueError(f"Unsupported splitter: {name}")
        return SplitOptions(topology=topology, exact=mode == "exact", **options)

    @property
    def ideal(self) -> int:
        return max(1, int(self.max_tokens * self.ideal_ratio))

    @property
    def merge_below(self) -> int:
        return int(self.max_tokens * self.merge_below_ratio)
