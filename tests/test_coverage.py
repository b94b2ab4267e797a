"""The order of passages against the greedy loop written out."""

from __future__ import annotations

import random

import pytest

from strataloom.operators.coverage import covering_order

ROW = "item string, source_id string, ordinal long, score double, rank long, topics array<string>"


def greedy(rows, topics, adjacent):
    """rows: (item, source, ordinal, score, rank, topics)."""
    at = {(r[1], r[2]): r for r in rows}
    seen, covered, out, turn = set(), set(), [], 0
    while len(seen) < len(rows):
        best = min((r for r in rows if r[0] not in seen), key=lambda r: (-len((set(topics) - covered) & set(r[5])), -r[3], r[4]))
        group = [(best, 0)]
        for step in range(1, adjacent + 1):
            if (best[1], best[2] + step) not in at:
                break
            group.append((at[best[1], best[2] + step], step))
        for row, step in group:
            if row[0] not in seen:
                seen.add(row[0])
                covered |= set(topics) & set(row[5])
                out.append((row[0], best[0] if step else None))
        turn += 1
    return out


def got(frame):
    rows = frame.collect()
    assert len({(r.turn, r.step) for r in rows}) == len(rows)
    return [(r.item, r.anchor) for r in sorted(rows, key=lambda r: (r.turn, r.step))]


@pytest.mark.parametrize("seed,adjacent", [(1, 1), (2, 2), (3, 3)])
def test_like_the_greedy_loop(spark, seed, adjacent):
    r = random.Random(seed)
    rows = []
    for source in "abcd":
        for ordinal in r.sample(range(40), 25):
            rows.append([f"{source}{ordinal}", source, ordinal, float(r.randrange(4)), 0, r.sample(["x", "y", "z", "other"], r.choice((0, 0, 0, 1, 2)))])
    for rank, row in zip(r.sample(range(len(rows)), len(rows)), rows, strict=True):
        row[4] = rank
    rows = [tuple(x) for x in rows]
    assert got(covering_order(spark.createDataFrame(rows, ROW), ["x", "y", "z", "never"], adjacent)) == greedy(rows, ["x", "y", "z", "never"], adjacent)


def test_definitions_follow_their_introduction(spark):
    """An introduction, definitions after it and a passage on the second topic: each topic is met early."""
    rows = [("intro", "book", 0, 3.0, 0, ["exponents"]), ("universality", "book", 7, 1.0, 1, ["universality"]), ("definitions", "book", 1, 0.0, 2, []), ("more", "other", 0, 2.0, 3, ["exponents"])]
    order = got(covering_order(spark.createDataFrame(rows, ROW), ["exponents", "universality"], 2))
    assert order == [("intro", None), ("definitions", "intro"), ("universality", None), ("more", None)]


def test_no_rows_and_no_topics(spark):
    assert covering_order(spark.createDataFrame([], ROW), ["x"], 2).count() == 0
    rows = [("b", "s", 2, 1.0, 0, []), ("a", "s", 1, 1.0, 1, []), ("c", "s", 3, 1.0, 2, [])]
    assert got(covering_order(spark.createDataFrame(rows, ROW), [], 1)) == greedy(rows, [], 1)
