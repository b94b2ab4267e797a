"""Operator 5 against all pairs, on one bucket block and on many."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strataloom.llm import near_dedup


def words(text):
    import re

    return [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def classes(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return sorted(((k is None, k or 0), (min((x for x in g if x is not None), default=None), len(g))) for g in groups.values() for k in g)


@pytest.mark.parametrize("block", [1000, 3])
def test_like_all_pairs(table, hard, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    random.seed(4)
    base = [f"w{random.randrange(500)}" for _ in range(150)]
    rows = [r for r in hard if r[0] is not None] + [(90, None), (91, "Word!")]
    for i in range(60):
        w = list(base)
        for _ in range(random.choice([1, 2, 3, 6, 12])):
            w[random.randrange(len(w))] = f"n{random.randrange(9999)}"
        rows.append((100 + i, " ".join(w)))
    got = near_dedup.near_classes(table(rows, extra=["key", "band", "root"])).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), (r.class_id, r.class_size)) for r in got) == classes(rows)
    assert sum(r.kept for r in got) == len({(r.class_id, r.class_size) if r.class_size > 1 else (r.doc_id, r["__row"]) for r in got})


def test_repeated_lines_in_other_counts(table):
    """Pairs of equal or similar sets in which a line stands another number of times."""
    rng = random.Random(9)
    rows = []
    for i in range(16):
        intro = [f"p{i}x{rng.randrange(9999)}" for _ in range(15)]
        line = [f"l{i}x{k}" for k in range(5)]
        rows += [(10 * i, " ".join(intro + line * 2)), (10 * i + 1, " ".join(intro[i % 4 :] + line * 200))]
    got = near_dedup.near_classes(table(rows)).collect()
    assert sorted(((False, r.doc_id), (r.class_id, r.class_size)) for r in got) == classes(rows)
    assert {r.class_size for r in got} == {2}


def test_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64)
    value, text = np.concatenate([a, a, b]), np.repeat([0, 1, 1], [400, 400, 100])
    sig = near_dedup.signatures(value, text, np.ones(900), 2)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12
    assert (near_dedup.signatures(a, np.zeros(400, int), np.full(400, 7.0), 1) == near_dedup.signatures(a, np.zeros(400, int), np.ones(400), 1)).all()


def test_empty_table(table):
    assert near_dedup.kept_rows(table([])).count() == 0
