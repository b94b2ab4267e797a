"""Operator 2 against brute force, in blocks and by window hashes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from strataloom.llm import suffixes


def brute(rows):
    counts = Counter()
    for _, t in rows:
        b = (t or "").encode()
        counts.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if counts[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("block", [20_000, 8])
def test_like_brute_force(table, hard, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    random.seed(1)
    word = lambda n: "".join(random.choice("abcdé ") for _ in range(n))
    base = word(1500)
    rows = [*hard, (50, "ab" * 300), (51, "a" * 200), (52, "a" * 199), (53, "xyz " * 60)]
    for i in range(40):
        a, n = random.randrange(900), random.choice([150, 199, 200, 201, 230, 600])
        rows.append((100 + i, word(random.randrange(150)) + base[a : a + n] + word(random.randrange(150))))
    got = suffixes.remove_repeats(table(rows, extra=["place", "gram"])).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_case_matters(table):
    t = "Abcdefghij" * 30
    rows = suffixes.remove_repeats(table([(1, "Q" + t[:205]), (2, "r" + t[:205].lower())])).collect()
    assert all(r.n_removed == dict((i, n) for i, _, n, _, _ in brute([(1, "Q" + t[:205]), (2, "r" + t[:205].lower())]))[r.doc_id] for r in rows)


def test_cover():
    cover = suffixes.difference_cover()
    assert {(a - b) % 32 for a in cover for b in cover} == set(range(32))
    assert max(b - a for a, b in zip(cover, [*cover[1:], cover[0] + 32], strict=True)) <= 8


def test_empty_table(table):
    assert suffixes.remove_repeats(table([])).count() == 0
