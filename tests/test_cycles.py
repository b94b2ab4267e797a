"""Strong components and shortest cycles against plain graph searches."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import pytest

from strataloom.operators import cycles


def table(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def reached(pairs, start):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    depth, todo = {}, deque((b, 1) for b in out[start])
    while todo:
        node, d = todo.popleft()
        if node not in depth:
            depth[node] = d
            todo.extend((b, d + 1) for b in out[node])
    return depth


def plain(pairs):
    nodes = sorted({n for p in pairs for n in p})
    reach = {n: reached(pairs, n) for n in nodes}
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes if n in reach[n]}


def found(frame):
    rows = [(r.node, r.scc) for r in frame.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


@pytest.mark.parametrize("seed,nodes,edges", [(2, 40, 55), (4, 60, 70)])
def test_like_searches(spark, seed, nodes, edges):
    r = random.Random(seed)
    pairs = [(r.randrange(nodes), r.randrange(nodes)) for _ in range(edges)]
    strong = cycles.strong_components(table(spark, pairs))
    want = plain(pairs)
    assert found(strong) == want
    ways = defaultdict(dict)
    for w in cycles.witnesses(table(spark, pairs), strong).collect():
        assert w.step not in ways[w.scc]
        ways[w.scc][w.step] = w.node
    assert set(ways) == set(want.values())
    for scc, way in ways.items():
        ring = [way[i] for i in range(len(way))]
        assert ring[0] == scc and len(ring) == reached(pairs, scc)[scc] and len(set(ring)) == len(ring)
        assert all(p in set(pairs) for p in zip(ring, [*ring[1:], scc], strict=True))


def test_long_ring_and_many_rings(spark):
    """As many rounds as the length has bits, not as it has nodes."""
    ring = [(i, (i + 1) % 1000) for i in range(1000)]
    small = [(2000 + 5 * k + i, 2000 + 5 * k + (i + 1) % 5) for k in range(200) for i in range(5)]
    tails = [(5000 + i, i) for i in range(20)] + [(i, 6000 + i) for i in range(20)] + [(7000 + i, 7001 + i) for i in range(50)]
    pairs = ring + small + tails
    strong = cycles.strong_components(table(spark, pairs))
    assert found(strong) == {i: 0 for i in range(1000)} | {2000 + 5 * k + i: 2000 + 5 * k for k in range(200) for i in range(5)}
    ways = sorted((w.scc, w.step, w.node) for w in cycles.witnesses(table(spark, pairs), strong).collect())
    assert ways == sorted([(0, i, i) for i in range(1000)] + [(2000 + 5 * k, i, 2000 + 5 * k + i) for k in range(200) for i in range(5)])


def test_no_cycles_and_loops(spark):
    assert found(cycles.strong_components(table(spark, []))) == {}
    assert found(cycles.strong_components(table(spark, [(1, 2), (2, 3), (1, 3)]))) == {}
    strong = cycles.strong_components(table(spark, [(1, 1), (1, 2), (2, 1), (3, 3), (3, 4)]))
    assert found(strong) == {1: 1, 2: 1, 3: 3}
    assert sorted((w.scc, w.step, w.node) for w in cycles.witnesses(table(spark, [(1, 1), (1, 2), (2, 1), (3, 3), (3, 4)]), strong).collect()) == [(1, 0, 1), (3, 0, 3)]


def test_star_has_no_cycle_until_it_comes_back(spark):
    star = [(0, i) for i in range(1, 1100)]
    assert found(cycles.strong_components(table(spark, star))) == {}
    assert found(cycles.strong_components(table(spark, [*star, (700, 0), (3, 0)]))) == {0: 0, 3: 0, 700: 0}


def test_witnesses_of_at_most_so_many_edges(spark):
    """A ring and a ring with a chord, each longer and shorter than the limit."""
    ring = lambda a, n: [(a + i, a + (i + 1) % n) for i in range(n)]
    pairs = ring(0, 5) + ring(100, 4) + ring(200, 7) + [(204, 206)] + ring(300, 6) + [(302, 300)]
    strong = cycles.strong_components(table(spark, pairs))
    length = lambda most: {r.scc: r["count"] for r in cycles.witnesses(table(spark, pairs), strong, most).groupBy("scc").count().collect()}
    assert length(4) == {100: 4, 300: 3}
    assert length(6) == {0: 5, 100: 4, 200: 6, 300: 3}
    assert length(None) == length(6)
