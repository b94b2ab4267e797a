"""The budgeted search against the same rules as nested loops, link by link."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from strataloom.operators.frontier import FREE, Budget, record, scored, search

LINK = "source string, target string, relation string, direction int, kind int"


def loops(links, known, seeds, b):
    """Nested loops: (order of discovery with parents and paths, edges examined, limited, hop limited)."""
    big = 1 << 60
    cap, most, nodes, results = (big if x is None else x for x in (b.neighbours, b.edges, b.nodes, b.results))
    out = defaultdict(list)
    for link in links:
        out[link[0]].append(link)
    for k in out:
        out[k].sort(key=lambda x: (x[4] == FREE, x[4], x[1], x[2], x[3]))
    seen, rows, frontier = set(seeds), [(k, None, (k,)) for k in seeds], [(k, (k,)) for k in seeds]
    held, examined, limited = sum(known[k] for k in seeds), 0, False
    for _ in range(b.hops):
        following = []
        for key, path in frontier:
            if b.stop and (examined >= most or len(seen) >= nodes or held >= results):
                limited = True
                break
            typed, free = [x for x in out[key] if x[4] != FREE], [x for x in out[key] if x[4] == FREE]
            limited |= len(typed) > cap
            for _, target, _, _, _ in typed[:cap] + free:
                if examined >= most or (b.stop and (len(seen) >= nodes or held >= results)):
                    limited = True
                    break
                examined += 1
                if target in seen or target not in known:
                    continue
                if len(seen) >= nodes or (known[target] and held >= results):
                    limited = True
                    continue
                seen.add(target)
                held += known[target]
                rows.append((target, key, (*path, target)))
                following.append((target, (*path, target)))
        frontier = following
        if not frontier:
            break
    ahead = bool(frontier) if b.stop else any(x[1] not in seen for k, _ in frontier for x in out[k])
    return rows, examined, limited, ahead


def run(spark, links, known, seeds, b):
    frame = spark.createDataFrame(links, LINK)
    nodes = spark.createDataFrame(list(known.items()), "node string, result boolean")
    return search(frame, nodes, spark.createDataFrame([(k, i) for i, k in enumerate(seeds)], "node string, place long"), b)


def check(spark, links, known, seeds, b):
    found = run(spark, links, known, seeds, b)
    rows, examined, limited, ahead = loops(links, known, seeds, b)
    got = [(r.node, r.parent, tuple(r.path)) for r in sorted(found.visited.collect(), key=lambda r: r.place)]
    assert (got, found.examined, found.limited, found.hop_limited, found.nodes) == (rows, examined, limited, ahead, len(rows)), b


BUDGETS = [Budget(3), Budget(4, 3, 25, 18, 7), Budget(4, 3, 25, 18, 7, stop=True), Budget(3, 2, 9, None, None, stop=True), Budget(3, None, None, 11, None), Budget(5, 2, 40, 200, 3), Budget(3, None, None, 4, None, stop=True)]


@pytest.mark.parametrize("b", BUDGETS, ids=str)
def test_like_nested_loops(spark, b):
    r = random.Random(f"{b}")
    names = [f"n{i}" for i in range(40)]
    known = {n: r.random() < 0.5 for n in names[:36]}  # links to the others lead nowhere
    links = [(r.choice(names[:36]), r.choice(names), r.choice("ab"), r.randrange(2), r.choice((0, 0, 1, FREE))) for _ in range(110)]
    check(spark, links, known, ["n3", "n17", "n5"], b)


def test_chain_diamond_and_two_seeds(spark):
    chain = [(f"a{i}", f"a{i + 1}", "x", 0, 0) for i in range(5)]
    diamond = [("s", "l", "x", 0, 0), ("s", "r", "x", 0, 0), ("l", "t", "x", 0, 0), ("r", "t", "x", 0, 0)]
    known = {n: True for link in chain + diamond for n in link[:2]}
    found = run(spark, chain + diamond, known, ["s", "a0"], Budget(5))
    paths = {r.node: (tuple(r.path), r.score) for r in scored(found).collect()}
    assert paths["t"] == (("s", "l", "t"), 1 / 3) and paths["a5"] == (("a0", "a1", "a2", "a3", "a4", "a5"), 1 / 6) and paths["s"] == (("s",), None)
    # Both seeds reach m in one step: the first seed's path stands.
    two = run(spark, [("z", "m", "x", 0, 0), ("b", "m", "x", 0, 0)], {"z": True, "b": True, "m": True}, ["z", "b"], Budget(2))
    assert {r.node: tuple(r.path) for r in scored(two).collect()}["m"] == ("z", "m")


def test_hub_keeps_its_first_links(spark):
    links = [("hub", f"t{i:04d}", "x", 0, 0) for i in range(3000)]
    known = {"hub": False} | {f"t{i:04d}": True for i in range(3000)}
    found = run(spark, links, known, ["hub"], Budget(1, neighbours=5))
    assert [r.node for r in sorted(found.visited.collect(), key=lambda r: r.place)] == ["hub", *[f"t{i:04d}" for i in range(5)]] and found.limited


def test_nothing_to_look_at(spark):
    found = run(spark, [("a", "b", "x", 0, 0)], {"a": True, "b": True}, ["b"], Budget(3))
    assert (found.nodes, found.examined, found.limited, found.hop_limited) == (1, 0, False, False)
    indexed = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert record(found, indexed, Budget(3), 1).first().asDict() == {"visited_nodes": 1, "examined_edges": 0, "limited": False, "hop_limited": False, "selected": 1, "omitted_count": 2, "omitted": "a"}
