"""Operator 11 against pairs compared one by one."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strataloom.llm import spelling as op


def near(a, b):
    """Whether one code point was inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            count[low if h % 31 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    others = {w: sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: others[w][0] if others[w] and n[others[w][0]] >= 10 * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, str(form[w]), root(w), n[w], len(others[w]), str(n.get(form[w]))) for w in n)


def got(frame):
    return sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in frame.collect())


@pytest.mark.parametrize("held", [1 << 21, 40])
def test_like_pairs(table, hard, monkeypatch, held):
    monkeypatch.setattr(op, "HELD", held)
    r = random.Random(4)
    base = ["".join(r.choice("abcdé×ÿ") for _ in range(r.choice((7, 8, 9, 30)))) for _ in range(12)]

    def typo(w):
        for _ in range(r.randrange(3)):
            i = r.randrange(len(w))
            w = r.choice((w[:i] + w[i + 1 :], w[:i] + r.choice("abz") + w[i:], w[:i] + r.choice("éb") + w[i + 1 :], w[:i] + w[i] + w[i:]))
        return w.upper() if r.random() < 0.1 and w.isascii() else w

    rows = [(i, " ".join(typo(r.choice(base[: 1 + i % 12])) for _ in range(60)) + r.choice((".", "漢", "_1 "))) for i in range(120)]
    # A chain of forms: each a hundred times as common as the one before.
    rows += [(1000, "chainaa " * 2 + "chainab " * 30 + "chainbb " * 400 + "chaincb " * 5000), (None, None), (1001, ""), (1001, "Zz" * 600 + " " + "zz" * 600)]
    docs = table([*hard, *rows], extra=["word", "n", "run"])
    assert got(op.variants(docs)) == plain([*hard, *rows])


def test_chain_has_one_root(table):
    rows = [(1, " ".join(["wordaaa"] * 2 + ["wordaab"] * 30 + ["wordabb"] * 400 + ["wordbbb"] * 5000))]
    found = {r.word: r.root for r in op.variants(table(rows), drop=10**9).collect()}
    assert found == dict.fromkeys(("wordaaa", "wordaab", "wordabb", "wordbbb"), "wordbbb")


def test_all_distinct_neighbours_are_made():
    r = random.Random(2)
    letters = "abc"
    alphabet = np.array([ord(c) + 1 for c in letters], dtype=np.uint64)
    for _ in range(20):
        word = "".join(r.choice(letters) for _ in range(r.randrange(1, 8)))
        matrix = np.frombuffer(word.encode(), np.uint8).reshape(1, -1).astype(np.uint64) + np.uint64(1)
        made = [word[:i] + (chr(c - 1) if c else "") + word[i + out :] for _, i, out, c in op.neighbours(matrix, alphabet, lambda h: np.ones(h.shape, dtype=bool))]
        want = {word[:i] + c + word[i + o :] for i in range(len(word) + 1) for c in ("", *letters) for o in (0, 1) if i + o <= len(word)} - {word}
        assert len(made) == len(set(made)) and set(made) == want


def test_hashes_of_neighbours_are_those_of_the_words():
    word = "aàbcca"
    letters = np.frombuffer(word.encode("latin-1"), np.uint8).reshape(1, -1).astype(np.uint64) + np.uint64(1)
    alphabet = np.array([ord(c) + 1 for c in "abcà"], dtype=np.uint64)
    seen = []
    everything = list(op.neighbours(letters, alphabet, lambda h: (seen.append(h.ravel()), np.ones(h.shape, dtype=bool))[1]))
    hashes = set(np.concatenate(seen).tolist())
    for _, i, out, c in everything:
        near = word[:i] + (chr(c - 1) if c else "") + word[i + out :]
        own = np.frombuffer(near.encode("latin-1"), np.uint8).reshape(1, -1).astype(np.uint64) + np.uint64(1)
        assert int(op._sums(own)[0, -1]) in hashes


def test_empty_table(table):
    assert op.variants(table([])).count() == 0
    assert op.variants(table([(1, None), (2, "short words")])).count() == 0
