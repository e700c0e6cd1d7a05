"""Front matter of quoted pairs is read without YAML, and as YAML reads it."""

import itertools

import pytest
import yaml

from textloom.operators import markdown

KEYS = "title brand _ a1 yes No TRUE off null Null y n nulls on_ k".split() + ["k" * 100, "k" * 101, "k" * 1100]
VALUES = ["''", '""', "'a'", '" a: b # c "', "'yes'", "'12'", "'2020-01-01'", "' [x] {y} & * ! | > % @ ` '", "'a\"b'", '"it\'s"', "'~'"]


def _yaml(lines):
    try:
        found = yaml.load("\n".join(lines), yaml.SafeLoader)
    except Exception:
        found = None
    return found if isinstance(found, dict) else None


@pytest.mark.parametrize("key", KEYS, ids=lambda k: k[:8] + str(len(k)))
def test_as_yaml_reads_it(key):
    odd = ["'it''s'", r'"a\tb"', "'a' # b", "'a' ", "'ä'", "'open", "plain", "12", "true"]
    for v, more in itertools.product(VALUES + odd, ([], ["z: 'w'"], [f"{key}: 'again'"], ["z: 1"])):
        lines = [f"{key}: {v}", *more]
        found = markdown._front_matter(["---", *lines, "---", "text"])
        assert found == (len(lines) + 2, _yaml(lines))
        assert found[1] is None or {(type(k), type(x)) for k, x in found[1].items()} == {(type(k), type(x)) for k, x in _yaml(lines).items()}


def test_quoted_pairs_need_no_yaml(monkeypatch):
    monkeypatch.setattr(yaml, "load", lambda *_: pytest.fail("YAML was loaded"))
    t = markdown.parse("---\ntitle: 'x y'\nbrand: \"Brand#12\"\n---\n\n# h")
    assert (t.title, t.metadata) == ("x y", {"title": "x y", "brand": "Brand#12"})
