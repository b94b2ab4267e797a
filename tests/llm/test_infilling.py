"""Operator 13 against plain slicing of code points, words and lines."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from strataloom.llm import infilling as op

ALPHABET = "ab <>PSM\n\té漢😀́"


def plain(i, text, pieces):
    """The contract in words: slices of a list of units."""
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[k * 8 : k * 8 + 8], 16) for k in range(4)]
    n = len(pieces)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in op.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (pieces[:a], pieces[a:b], pieces[b:]))
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def units(text, unit):
    """Units with what follows them up to the next; the first takes what comes before it too."""
    if unit == "char" or not text:
        return list(text)
    at = {"word": [x.start() for x in re.finditer(r"[^ \t\n\v\f\r]+", text)], "line": [x.end() for x in re.finditer("\n", text[:-1])]}[unit]
    at = sorted({0, *at})
    return [text[x:y] for x, y in zip(at, [*at[1:], len(text)], strict=True)]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_like_slices(spark, table, hard, unit):
    r = random.Random(3)
    rows = [*hard, *[(100 + i, "".join(r.choice(ALPHABET) for _ in range(r.randrange(80)))) for i in range(300)], (9, "漢" * 70_000 + "\n" + "b" * 90_000), (11, "tail <M>")]
    got = op.transform(table(rows, extra=["doc", "draws", "n", "a``b"]), unit).withColumn("back", op.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(x.doc_id), x.n, x.form, x.prefix_units, x.middle_units, x.output) for x in got) == sorted((str(i), *plain(i, t or "", units(t or "", unit))) for i, t in rows)
    assert all(x.back == (x.text or "") and x["a`b"] == "x" for x in got)
    assert {x.form for x in got} == {"plain", "psm", "spm"}


def test_select_finds_each_bit():
    r = random.Random(1)
    for size in (1, 2, 3, 64, 65, 1000):
        bits = r.getrandbits(size) | 1 << (size - 1)
        places = [i for i in range(size) if bits >> i & 1]
        assert [op.select(bits, k) for k in range(len(places))] == places


def test_empty_table_and_very_long_text(spark, table):
    assert op.transform(table([])).count() == 0
    text = "é漢a " * 4_000_000
    raw = text.encode()
    n, a, b, x, y = op.cut(raw, 5_000_001, 16_000_000)
    assert (n, a, b) == (16_000_000, 5_000_001, 10_999_999) and raw[:x].decode() == text[:5_000_001] and raw[y:] == text[16_000_000:].encode()
