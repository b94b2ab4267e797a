"""Label expansion against its rules written out as loops."""

from __future__ import annotations

import random
import re

import pytest

from strataloom.operators.references import expand


def loops(regions, selected, hops, most, chars):
    """regions: (id, document, ordinal, text)."""
    big = 1 << 60
    most, chars = big if most is None else most, big if chars is None else chars
    text = {r[0]: re.sub(r"(?<!\\)%[^\n]*", "", r[3]) for r in regions}
    size, where, at = {r[0]: len(r[3]) for r in regions}, {r[0]: r[1:3] for r in regions}, {r[1:3]: r[0] for r in regions}
    labels = {}
    for r in regions:
        for label in re.findall(r"\\label\s*\{([^{}]+)\}", text[r[0]]):
            labels.setdefault((r[1], label.strip()), set()).add(r[0])
    seen, taken, used, out, lost, left = set(selected), 0, 0, [], set(), set()

    def beside(target):
        d, o = where[target]
        return [at[d, o + step] for step in (0, -1, 1) if (d, o + step) in at]

    def take(candidates, hop):
        nonlocal taken, used
        new = []
        for candidate in candidates:
            if candidate in seen:
                continue
            if taken >= most or used + size[candidate] > chars:
                left.add(candidate)
                continue
            seen.add(candidate)
            new.append(candidate)
            out.append((candidate, hop))
            taken += 1
            used += size[candidate]
        return new

    docs = {where[s][0] for s in selected}
    defined = sorted((where[r[0]], r[0]) for r in regions if r[1] in docs and re.search(r"\\begin\s*\{definition\*?\}", text[r[0]]))
    frontier = [*selected, *take([c for _, d in defined for c in beside(d)], 0)]
    for hop in range(1, hops + 1):
        asked = []
        for r in frontier:
            for group in re.findall(r"\\(?:[cC]ref|[cC]pageref|eqref|ref|autoref)\*?\s*\{([^{}]+)\}", text[r]):
                for label in (x.strip() for x in group.split(",")):
                    found = labels.get((where[r][0], label), set())
                    if len(found) != 1:
                        lost.add((r, label, "ambiguous" if found else "missing"))
                    else:
                        asked += beside(next(iter(found)))
        frontier = take(asked, hop)
        if not frontier:
            break
    return out, lost, left - seen, bool(frontier)


@pytest.mark.parametrize("seed,hops,most,chars", [(1, 3, None, None), (2, 3, 12, None), (3, 3, 24, 700), (4, 1, None, 300), (5, 2, 0, None)])
def test_like_loops(spark, seed, hops, most, chars):
    r = random.Random(seed)
    regions = []
    for document in "ab":
        for ordinal in range(40):
            parts = ["x" * r.randrange(60)]
            parts += [rf"\label{{L{ordinal}}}"] * (r.random() < 0.6) + [r"\label{ dup }"] * (r.random() < 0.1) + [r"\begin{definition*}"] * (r.random() < 0.05)
            parts += [rf"\{r.choice(['ref', 'eqref', 'cref*', 'Cpageref'])} {{L{r.randrange(45)}, L{r.randrange(45)}}}" for _ in range(r.choice((0, 0, 1, 2)))]
            parts += [r"\ref{dup}"] * (r.random() < 0.1) + ["\n% \\ref{L1} \\label{L2}\n", r"50\% \ref{L3}"] * (r.random() < 0.2)
            regions.append((f"{document}{ordinal:02}", document, ordinal, " ".join(parts)))
    selected = ["a05", "b30", "a20"]
    frame = spark.createDataFrame(regions, "region_id string, document string, ordinal long, text string")
    got = expand(frame, spark.createDataFrame([(x, i) for i, x in enumerate(selected)], "region_id string, place long"), hops, most, chars)
    out, lost, left, ahead = loops(regions, selected, hops, most, chars)
    rows = sorted(got.included.collect(), key=lambda x: x.place)
    assert sorted((x.region_id, x.hop) for x in rows) == sorted(out) and {tuple(x) for x in got.unresolved.collect()} == lost
    assert {x.region_id for x in got.omitted.collect()} == left and got.hop_limited == ahead
    if most is not None or chars is not None:
        assert [x.region_id for x in rows] == [x for x, _ in out]
