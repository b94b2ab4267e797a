"""Page breaks: few rows of a block are followed from block to block."""

from __future__ import annotations

from strataloom.operators import documents


def greedy(sizes, budget, limit):
    out, start = [], 0
    while start < len(sizes):
        end, used = start + 1, sizes[start]
        while end < len(sizes) and end - start < limit and used + sizes[end] <= budget:
            used, end = used + sizes[end], end + 1
        out.append((start, end))
        start = end
    return out


def test_like_one_page_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(documents, "TOGETHER", 16)
    rows = [(g, g * 1000 + i, i * 37 % 11) for g, n in ((0, 100), (1, 16), (2, 1), (3, 33), (4, 64)) for i in range(n)]
    made, keep = [], documents.written
    monkeypatch.setattr(documents, "written", lambda df, name: made.append((name, t := keep(df, name))) or t)
    got = documents.budget_pages(spark.createDataFrame(rows, "g long, k long, size long"), "g", "k", "size", 20, 5, 7).collect()
    want = set()
    for g in range(5):
        mine = [r for r in rows if r[0] == g]
        pages = greedy([r[2] for r in mine], 20, 5)
        want |= {(g, mine[i][1], p, a, b < len(mine)) for p, (a, b) in enumerate(pages) for i in range(a, b)}
    assert {(r.g, r.k, r.page, r.offset, r.cursor is not None) for r in got} == want and len(got) == len(rows)
    assert next(t for name, t in made if name == "jump").count() < len(rows) / 2
