"""Strongly connected components by trimming, contraction and colouring, and what follows from them.

1. Trimming: nodes without incoming or outgoing edges lie on no cycle. A few rounds are enough, as dead ends
   are contracted too.
2. Contraction: a node with one outgoing edge lies on no other cycles than the node it leads to. Chains of
   such nodes are followed by pointer doubling, in as many rounds as a chain's length has bits, either to
   the node in which they end or around a ring, which is a component. Edges into a chain then lead to its
   end. The contracted graph is turned around, so that nodes with one incoming edge go next, and so on
   until few nodes go.
3. Colouring: in what is left every node takes the greatest node that reaches it; the nodes that reach
   back to their colour are its component. They are taken out, and the rest is trimmed and coloured anew.

Contracted nodes then join their end's component if an edge from it enters their chain at or before them.
No pair of nodes is ever written but the edges and one row for each node and round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .graph import gathered, on_cycles, sided, turns

#: Contraction goes on while it takes at least this share of the edges away; what is left is coloured.
WORTH = 0.25
#: Rounds of trimming before each contraction.
TRIM = 2


@dataclass(frozen=True)
class _Jumps:
    """Steps of 1, 2, 4, ... along single outgoing edges: for each power a table of node, to."""

    steps: list[DataFrame]
    ends: DataFrame  # node, end: the first node that hasn't one outgoing edge; null on the way into a ring
    rings: DataFrame  # node, scc


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").filter("src <> dst").distinct()


def _chains(edges: DataFrame) -> _Jumps:
    """Follows the nodes with one outgoing edge. edges: distinct, without loops."""
    single = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to")).filter("n = 1").select(F.col("src").alias("node"), "to")
    # low: the least node met; on a ring, after enough steps, the ring's least node.
    now = written(single.join(sided(single.select(F.col("node").alias("to"), F.lit(True).alias("on"))), "to", "left").select("node", "to", F.coalesce("on", F.lit(False)).alias("on"), F.least("node", "to").alias("low")), "chain")
    steps, length, most = [now.filter("on").select("node", "to")], 1, now.count()
    done = now.filter("not on").select("node", F.col("to").alias("end"))
    live = now.filter("on").select("node", "to", "low")
    turn = 0
    while length < most and not live.isEmpty():
        turn += 1
        end = done.select(F.col("node").alias("to"), "end")
        ahead = live.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("low").alias("least"))
        both = live.join(sided(end), "to", "left").join(sided(ahead), "to", "left")
        now = written(both.select("node", "end", F.col("further").alias("to"), F.least("low", "least").alias("low")), "chain")
        live = now.filter("end is null").select("node", "to", "low")
        done = gathered(done, now.filter("end is not null").select("node", "end"), turn)
        steps.append(live.select("node", "to"))
        length *= 2
    # What is left after as many steps as there are nodes leads into a ring; the nodes stepped on are rings.
    on_ring = live.select(F.col("to").alias("node")).distinct()
    rings = live.join(sided(on_ring), "node", "left_semi").select("node", F.col("low").alias("scc"))
    lost = live.join(sided(on_ring), "node", "left_anti").select("node", F.lit(None).cast(edges.schema["src"].dataType).alias("end"))
    return _Jumps(steps, done.unionByName(lost).unionByName(rings.select("node", F.lit(None).cast(edges.schema["src"].dataType).alias("end"))), rings)


def _joined(chains: _Jumps, edges: DataFrame, inner: DataFrame) -> DataFrame:
    """Chain nodes that lie in the component of their end. inner: node, scc of the contracted graph's nodes on cycles."""
    ended = chains.ends.filter("end is not null").select(F.col("node").alias("dst"), "end")
    a, b = (inner.select(F.col("node").alias(n), F.col("scc").alias(s)) for n, s in (("src", "from"), ("end", "scc")))
    mark = written(edges.join(sided(a), "src").join(sided(ended), "dst").join(sided(b), "end").filter(F.col("from") == F.col("scc")).select(F.col("dst").alias("node"), "scc").distinct(), "mark")
    for step in chains.steps:
        moved = mark.join(sided(step), "node").select(F.col("to").alias("node"), "scc")
        mark = written(mark.unionByName(moved).distinct(), "mark")
    return mark


def _coloured(edges: DataFrame) -> DataFrame:
    """node, scc of all nodes on cycles of trimmed edges."""
    found = None
    left = edges
    for turn in turns(None):
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colour = written(nodes.withColumn("colour", F.col("node")), "colour")
        new = colour
        for _ in turns(None):  # only what changed in the last round is handed on
            offer = left.join(sided(new), left["src"] == new["node"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("offer"))
            now = written(colour.join(sided(offer), "node", "left").select("node", F.greatest("colour", F.coalesce("offer", "colour")).alias("colour"), (F.coalesce("offer", "colour") > F.col("colour")).alias("moved")), "colour")
            colour, new = now.select("node", "colour"), now.filter("moved").select("node", "colour")
            if new.isEmpty():
                break
        a, b = (colour.select(F.col("node").alias(n), F.col("colour").alias(c)) for n, c in (("src", "c"), ("dst", "d")))
        inside = written(left.join(sided(a), "src").join(sided(b), "dst").filter("c = d").select("src", "dst", "c"), "inside")
        back = step = written(colour.filter("node = colour").select("node", F.col("colour").alias("scc")), "back")
        for depth in turns(None):
            found_now = inside.join(sided(step.select(F.col("node").alias("dst"), F.col("scc").alias("c"))), ["dst", "c"]).select(F.col("src").alias("node"), F.col("c").alias("scc")).distinct()
            step = written(found_now.join(sided(back.select("node")), "node", "left_anti"), "back")
            if step.isEmpty():
                break
            back = gathered(back, step, depth)
        size = back.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
        whole = back.join(sided(size.filter("n > 1")), "scc").select("node", "scc")
        found = whole if found is None else gathered(found, whole, turn)
        gone = written(back.select("node"), "gone")
        rest = left.join(sided(gone.select(F.col("node").alias("src"))), "src", "left_anti").join(sided(gone.select(F.col("node").alias("dst"))), "dst", "left_anti")
        left = on_cycles(rest.select("src", "dst"))
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([], f"node {kind}, scc {kind}") if found is None else written(found, "coloured")


def _components(edges: DataFrame, before: tuple[int, ...] = ()) -> DataFrame:
    """node, scc (some name of it) for nodes on cycles of more than one node. before: edges at the levels above."""
    trimmed = on_cycles(edges, TRIM)
    count = trimmed.count()
    # One level follows single outgoing edges, the next one single incoming ones.
    if not count or (len(before) > 1 and count > (1 - WORTH) * before[-2]):
        return _coloured(on_cycles(trimmed))
    chains = _chains(trimmed)
    ends = written(chains.ends, "ends")
    short = trimmed.join(sided(ends.select(F.col("node").alias("src"))), "src", "left_anti").join(sided(ends.select(F.col("node").alias("dst"), F.lit(True).alias("in"), "end")), "dst", "left")
    # Edges into a ring, or on the way to one, lead nowhere else.
    contracted = written(short.filter("in is null or end is not null").select(F.col("src").alias("dst"), F.coalesce("end", "dst").alias("src")).distinct(), "contracted")
    inner = _components(contracted.filter("src <> dst"), (*before, count))
    # A loop of the contracted graph is a cycle of its node and a chain.
    loops = contracted.filter("src = dst").select(F.col("src").alias("node")).join(sided(inner.select("node")), "node", "left_anti")
    inner = written(inner.select("node", "scc").unionByName(loops.select("node", F.col("node").alias("scc"))), "inner")
    return written(inner.unionByName(_joined(chains, trimmed, inner)).unionByName(chains.rings), "scc")


def strong_components(edges: DataFrame) -> DataFrame:
    """node, scc: for each node on a cycle the least node that reaches it and that it reaches. Loops count."""
    found = _components(written(_pairs(edges), "pairs"))
    least = written(found.groupBy("scc").agg(F.min("node").alias("least")), "least")
    named = found.join(sided(least), "scc").select("node", F.col("least").alias("scc"))
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct().join(sided(found.select("node")), "node", "left_anti")
    return named.unionByName(loops.select("node", F.col("node").alias("scc")))


def inner_edges(edges: DataFrame, strong: DataFrame) -> DataFrame:
    """src, dst, scc: edges within a component. Every cycle consists of these."""
    a, b = (strong.select(F.col("node").alias(n), F.col("scc").alias(s)) for n, s in (("src", "scc"), ("dst", "other")))
    return edges.select("src", "dst").distinct().join(sided(a), "src").join(sided(b), "dst").filter(F.col("scc") == F.col("other")).select("src", "dst", "scc")


def witnesses(edges: DataFrame, strong: DataFrame, most: int | None = None) -> DataFrame:
    """scc, step, node: a shortest cycle through each component's least node, step 0; of equal ones the one whose nodes come first from its end.

    Searches run in all components at once. A component that is a ring is its own witness: its order comes
    by doubling, not step by step. With most, only cycles of at most so many edges are asked for.
    """
    inner = written(inner_edges(edges, strong), "inner")
    size = strong.groupBy("scc").agg(F.count(F.lit(1)).alias("nodes"))
    plain = inner.filter("src <> dst").groupBy("scc").agg(F.count(F.lit(1)).alias("edges"))
    shape = written(size.join(sided(plain), "scc", "left").select("scc", (F.col("edges") == F.col("nodes")).alias("ring"), F.col("edges").isNull().alias("loop")), "shape")
    # A loop at the least node is its shortest cycle.
    looped = inner.filter("src = dst and src = scc").select("scc").distinct()
    out = [looped.select("scc", F.lit(0).alias("step"), F.col("scc").alias("node"))]
    todo = written(shape.join(sided(looped), "scc", "left_anti").filter("not loop"), "todo")
    ring = inner.join(sided(todo.filter("ring").select("scc")), "scc", "left_semi").filter("src <> dst")
    # away: steps to the least node along the ring, as far as they have been doubled.
    order = written(ring.select("scc", F.col("src").alias("node"), F.when(F.col("dst") == F.col("scc"), F.lit(None)).otherwise(F.col("dst")).alias("to"), F.lit(1).cast("long").alias("away")), "ring")
    for _ in turns(None):
        if order.filter("to is not null").isEmpty():
            break
        ahead = order.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("away").alias("more"))
        order = written(order.join(sided(ahead), "to", "left").select("scc", "node", F.col("further").alias("to"), (F.col("away") + F.coalesce("more", F.lit(0))).alias("away")), "ring")
    length = order.filter("node = scc").select("scc", F.col("away").alias("length")).filter(F.lit(most is None) | (F.col("length") <= F.lit(most)))
    out.append(order.join(sided(length), "scc").select("scc", (F.col("length") - F.col("away")).cast("int").alias("step"), "node"))
    # Others: breadth first from the least node, until an edge leads back to it.
    rest = written(inner.join(sided(todo.filter("not ring").select("scc")), "scc", "left_semi"), "rest")
    seen = step = written(rest.select("scc").distinct().select("scc", F.col("scc").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast(inner.schema["src"].dataType).alias("parent")), "walk")
    back = None
    for depth in turns(most):
        if step.isEmpty():
            break
        met = written(step.select("scc", F.col("node").alias("src")).join(sided(rest), ["scc", "src"]).groupBy("scc", F.col("dst").alias("node")).agg(F.min("src").alias("parent")), "met")
        closed = met.filter("node = scc").select("scc", F.col("parent").alias("node"), F.lit(depth - 1).alias("depth"))
        back = closed if back is None else gathered(back, closed, depth)
        new = met.join(sided(seen.select("scc", "node")), ["scc", "node"], "left_anti").join(sided(closed.select("scc")), "scc", "left_anti")
        step = written(new.select("scc", "node", F.lit(depth).alias("depth"), "parent"), "walk")
        seen = gathered(seen, step, depth)
    if back is None:
        return out[0].unionByName(out[1])
    # The way back from where the cycle closes, one step of each witness a round.
    at = written(back, "way")
    way = at.select("scc", F.col("depth").alias("step"), "node")
    for turn in turns(None):
        at = written(at.filter("depth > 0").join(sided(seen.select("scc", "node", "parent")), ["scc", "node"]).select("scc", F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")), "way")
        if at.isEmpty():
            break
        way = gathered(way, at.select("scc", F.col("depth").alias("step"), "node"), turn)
    return out[0].unionByName(out[1]).unionByName(way)


def condensed(edges: DataFrame, strong: DataFrame) -> DataFrame:
    """Edges between components; a node on no cycle is a component of its own."""
    a, b = (strong.select(F.col("node").alias(n), F.col("scc").alias(s)) for n, s in (("src", "a"), ("dst", "b")))
    both = edges.select("src", "dst").join(sided(a), "src", "left").join(sided(b), "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    return both.filter("src <> dst").distinct()


def short_cycles(edges: DataFrame, strong: DataFrame, most: int) -> DataFrame:
    """cycle: every simple cycle of at most so many edges, from its least node on.

    A cycle is followed from its least node only, over greater nodes of its component.
    """
    inner = written(inner_edges(edges, strong), "inner")
    live = inner.filter("dst >= src").select(F.array("src").alias("path"), "dst", "scc")
    out = None
    for length in range(1, most + 1):
        live = written(live, "cycles")
        closed = live.filter(F.col("dst") == F.col("path")[0]).select(F.col("path").alias("cycle"))
        out = closed if out is None else gathered(out, closed, length)
        if length == most or live.isEmpty():
            break
        grown = live.filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), "scc")
        step = inner.select(F.col("src").alias("tail"), "dst", F.col("scc").alias("of"))
        live = grown.join(sided(step), (F.element_at("path", -1) == F.col("tail")) & (F.col("scc") == F.col("of")) & (F.col("dst") >= F.col("path")[0])).select("path", "dst", "scc")
    return out
