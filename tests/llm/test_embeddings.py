"""Operator 12 against all pairs."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from harness import same

from strataloom.llm import embeddings as op


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = (np.array(x, dtype=np.float64) / max(map(abs, x)) for x in (a, b))
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def plain(rows, least=0.98):
    linked = {i: set() for i in range(len(rows))}
    for (i, (_, u, a)), (j, (_, v, b)) in itertools.combinations(enumerate(rows), 2):
        if a is not None and a == b and good(u) and good(v) and len(u) == len(v) and cosine(u, v) >= least:
            linked[i].add(j)
            linked[j].add(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((vec_id, len(linked[i]), component := min(ids, default=None), vec_id == component))
    return sorted(map(str, out))


def got(frame):
    return sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in frame.collect())


def around(rng, centre, like):
    """A vector at so large a cosine to the centre."""
    noise = rng.normal(size=len(centre))
    noise -= (noise @ centre) * centre / (centre @ centre)
    noise *= math.sqrt(1 / like**2 - 1) * np.linalg.norm(centre) / np.linalg.norm(noise)
    return [float(x) for x in (centre + noise) * rng.uniform(0.1, 9)]


@pytest.fixture
def frame(spark, tmp_path):
    number = itertools.count()

    def make(rows, element="float"):
        path = str(tmp_path / f"v{next(number)}")
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{element}>, label int").selectExpr("*", "'x' as node", "'y' as `list`", "1 as n")
        df.repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.mark.parametrize("block,small", [(1024, 64), (5, 64), (7, 2)])
def test_like_all_pairs(frame, monkeypatch, block, small):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "SMALL", small)
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=16).tolist(), int(rng.integers(3))) for k in range(150)]
    for c in range(6):
        centre = rng.normal(size=16)
        rows += [(1000 + 40 * c + k, around(rng, centre, rng.uniform(0.985, 0.999)), c % 3 if k % 9 else None) for k in range(1 + 6 * c)]
    for start in (0.0, 1.0):  # a chain: neighbours are near, ends are not
        rows += [(2000 + k + int(start) * 50, [math.cos(start + k / 6), math.sin(start + k / 6), *[0.0] * 14], 1) for k in range(9)]
    rows = [(i, [float(np.float32(x)) for x in v], l) for i, v, l in rows]
    rows += [(3000 + k, rows[160][1], rows[160][2]) for k in range(20)] + [rows[3], rows[3]]
    nan, inf = float("nan"), float("inf")
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * 16, 1), (4003, [-0.0] * 16, 1), (4004, [nan] * 16, 1), (4005, [inf, *[1.0] * 15], 1), (4006, [1.0, None, *[1.0] * 14], 1), (4006, [1.0, None, *[1.0] * 14], 1)]
    rows += [(4010, [1.0, 0.0], 1), (4011, [1.0, 0.0, 0.0], 1), (4012, [2.0, -0.0], 1), (None, [3.0, 0.0], 1), (None, None, 1), (None, [3.0, 0.0], None)]
    assert got(op.near_vectors(frame(rows))) == plain(rows)


def test_doubles_of_any_size(frame):
    rows = [(1, [1e300, 1e300], 1), (2, [1e-300, 1e-300], 1), (3, [5e-324, 0.0], 1), (4, [1e300, 0.0], 1), (5, [-1e300, 0.0], 1)]
    assert got(op.near_vectors(frame(rows, "double"))) == plain(rows)


def test_few_vectors_and_none(frame):
    assert op.near_vectors(frame([])).count() == 0
    assert got(op.near_vectors(frame([(1, [1.0, 2.0], 1)]))) == plain([(1, [1.0, 2.0], 1)])
    assert got(op.near_vectors(frame([(1, None, 1), (2, [1.0], None)]))) == plain([(1, None, 1), (2, [1.0], None)])


def test_recall_at_the_threshold(frame):
    """Pairs just above the threshold, which share the fewest reference points."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        centre = rng.normal(size=64)
        rows += [(2 * k, [float(x) for x in centre], 0), (2 * k + 1, around(rng, centre, 0.9801), 0)]
    found = sum(r.n_links for r in op.near_vectors(frame(rows)).collect())
    assert found >= 2 * 1498


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_same_as_all_pairs_of_the_tables(spark, folder):
    same(spark, op.op12_embedding_dedup, op.SQL["op12_embedding_dedup"], f"/root/testdata/{folder}")
