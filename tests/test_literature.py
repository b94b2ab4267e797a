"""Feeds, replies and search pages as hits, and hits merged into candidates, on hand-made input."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from strataloom.functions import text as fn
from strataloom.operators import literature as op

HEAD = '<?xml version="1.0"?>\n<feed xmlns="http://www.w3.org/2005/Atom">'


def entry(key="http://arxiv.org/abs/2401.00001v2", title=" A &amp; B ", summary="text"):
    return f"<entry><id>{key}</id><title>{title}</title><summary>{summary}</summary></entry>"


FEEDS = {
    "ok": HEAD + entry() + entry("http://arxiv.org/abs/hep-th/0101001") + "</feed>",
    "empty": HEAD + "</feed>",
    "doctype": "<!doctype x>" + HEAD + entry() + "</feed>",
    "root": "<rss>" + entry() + "</rss>",
    "cut": HEAD + entry() + "<entry>",
    "error": HEAD + entry("http://arxiv.org/api/errors#x") + "</feed>",
    "blank": HEAD + entry(title=" ") + "</feed>",
    "lacking": HEAD + "<entry><id>http://arxiv.org/abs/2401.00001</id><title>t</title></entry></feed>",
    "many": HEAD + "".join(entry(f"http://arxiv.org/abs/2401.0000{i}") for i in range(6)) + "</feed>",
    "twice": HEAD + entry() * 2 + "</feed>",
    "null": None,
    "nothing": "",
    "big": HEAD + entry(summary="x" * 2_000_000) + "</feed>",
}
ISSUES = {"ok": "ok", "empty": "ok", "doctype": "unsafe", "root": "not_a_feed", "cut": "malformed", "error": "identifier", "blank": "incomplete", "lacking": "incomplete", "many": "count", "twice": "count", "null": "malformed", "nothing": "malformed", "big": "unsafe"}


def test_atom(spark):
    found = {r.feed_id: r for r in op.atom(spark.createDataFrame(list(FEEDS.items()), "feed_id string, xml string")).collect()}
    assert {k: r.issue for k, r in found.items()} == ISSUES
    assert [(h.provider_id, h.arxiv_id, h.title, h.abstract, h.urls) for h in found["ok"].hits] == [
        ("2401.00001v2", "2401.00001", "A & B", "text", ["https://arxiv.org/pdf/2401.00001v2"]),
        ("hep-th/0101001", "hep-th/0101001", "A & B", "text", ["https://arxiv.org/pdf/hep-th/0101001"]),
    ]
    assert found["empty"].hits == [] and found["many"].hits is None


OPEN = {"id": "W1", "title": "T", "doi": "https://doi.org/10.1000/AbC", "publication_year": 2020, "best_oa_location": {"pdf_url": "https://h/a.pdf", "license": "cc"}, "locations": [{"pdf_url": "https://h/a.pdf", "is_oa": True}, {"pdf_url": "https://h/b.pdf", "is_oa": False}, {"pdf_url": "ftp://h/c", "is_oa": True}, {"pdf_url": "http://u:p@h/d", "is_oa": True}]}
SCHOLAR = {"paperId": "s1", "title": "U", "year": None, "abstract": None, "externalIds": {"DOI": "10.1000/abc", "ArXiv": "2401.00001v3"}, "openAccessPdf": None}
CROSS = {"DOI": "10.5/x", "title": ["V", "W"], "published": {"date-parts": [[2019, 3]]}, "link": [{"URL": "http://x/1", "content-type": "application/pdf"}, {"URL": "http://x/2", "content-type": "image/png"}]}


def test_replies(spark):
    rows = [
        (1, "openalex", json.dumps({"results": [OPEN]})), (2, "semantic_scholar", json.dumps({"data": [SCHOLAR], "total": 1})), (3, "crossref", json.dumps({"message": {"items": [CROSS]}})),
        (4, "openalex", json.dumps({"results": [OPEN] * 6})), (5, "openalex", "{"), (6, "other", "{}"), (7, "crossref", json.dumps({"message": {"items": [{**CROSS, "title": []}]}})),
        (8, "openalex", json.dumps({"results": []})), (9, None, None), (10, "crossref", None), (11, "semantic_scholar", json.dumps({"results": [OPEN]})),
    ]
    found = {r.reply_id: r for r in op.replies(spark.createDataFrame(rows, "reply_id long, provider string, json string")).collect()}
    assert {k: r.issue for k, r in found.items()} == {1: "ok", 2: "ok", 3: "ok", 4: "count", 5: "malformed", 6: "provider", 7: "incomplete", 8: "ok", 9: "provider", 10: "malformed", 11: "malformed"}
    one, two, three = (found[i].hits[0] for i in (1, 2, 3))
    assert (one.doi, one.year, one.urls, one.license, one.abstract) == ("10.1000/abc", 2020, ["https://h/a.pdf"], "cc", "")
    assert (two.doi, two.arxiv_id, two.year, two.urls) == ("10.1000/abc", "2401.00001", None, [])
    assert (three.doi, three.title, three.year, three.urls) == (None, "V", 2019, ["http://x/1"])
    assert found[8].hits == [] and found[5].hits is None


def item(key, title, abstract="about graphs", host="https://arxiv.org/abs/"):
    return f'<li class="x arxiv-result"><p class="list-title is-inline"><a href="{host}{key}">arXiv</a></p><p class="title is-5">\n <b>{title}</b>\n</p><span class="abstract-short">{abstract}</span></li>'


def test_search_pages(spark):
    page = "<ol>" + item("2401.00002", "Other &amp; thing") + item("2401.00001v2", "Graph query") + item("2401.00001", "again") + item("2401.00003", "x", host="https://evil.org/abs/") + item("2401.00004", " ") + "<li>none</li></ol>"
    rows = op.search_pages(spark.createDataFrame([(1, page), (2, None), (3, "<p>no"), (4, "<li class='q'>" + item("bad", "t"))], "page_id long, html string"), "Graphs and the QUERY", 5).collect()
    assert [(r.page_id, r.place, r.arxiv_id, r.title, r.score) for r in rows] == [(1, 0, "2401.00001", "Graph query", 2), (1, 1, "2401.00002", "Other & thing", 1)]
    many = spark.createDataFrame([(1, "".join(item(f"2401.{i:05d}", "t") for i in range(60, 0, -1)))], "page_id long, html string")
    assert [r.arxiv_id for r in op.search_pages(many, "", 3).orderBy("place").collect()] == ["2401.00011", "2401.00012", "2401.00013"]


HIT = "hit_id long, provider string, provider_id string, title string, doi string, arxiv_id string, year int, abstract string, urls array<string>, license string"


def identified(h):
    return {f"{h[1]}:{h[2]}"} | ({"doi:" + h[4]} if h[4] else set()) | ({"arxiv:" + h[5]} if h[5] else set())


def one_by_one(hits):
    """Candidates as a loop over hits in order makes them: name, names, hits."""
    found = {}
    for h in hits:
        names = identified(h)
        same = [k for k, (a, _) in found.items() if a & names]
        key = same[0] if same else "paper-" + hashlib.sha256(json.dumps(sorted(names), separators=(",", ":")).encode()).hexdigest()[:24]
        held = found.setdefault(key, (set(), set()))
        for other in same[1:]:
            a, b = found.pop(other)
            held[0].update(a), held[1].update(b)
        held[0].update(names), held[1].add(h[0])
    return found


@pytest.mark.parametrize("seed", range(3))
def test_candidates_as_one_by_one(spark, seed):
    r = random.Random(seed)
    doi, arx = lambda: r.choice([None, f"10.1000/d{r.randrange(25)}"]), lambda: r.choice([None, f"2401.000{r.randrange(10, 35)}"])
    hits = [(i, r.choice("ab"), f"k{r.randrange(60)}", r.choice(["graph", "tree"]), doi(), arx(), None, None, r.choice([[], ["http://h/x"], ["http://h/x", "http://h/y"]]), None) for i in range(80)]
    got = op.candidates(op.merged(spark.createDataFrame(hits, HIT)), "Graph graph").collect()
    want = one_by_one(hits)
    links = {k: len({u for i in v[1] for u in hits[i][8]}) for k, v in want.items()}
    conflict = {k: any(sum(a.startswith(p) for a in v[0]) > 1 for p in ("doi:", "arxiv:")) for k, v in want.items()}
    overlap = {k: int(any(hits[i][3] == "graph" for i in v[1])) for k, v in want.items()}
    seen = {k: len({hits[i][1:6] + (tuple(hits[i][8]),) for i in v[1]}) for k, v in want.items()}
    assert {c.candidate_id: (c.hits, c.aliases, c.urls, c.conflict, c.overlap, c.observations) for c in got} == {k: (len(v[1]), len(v[0]), links[k], conflict[k], overlap[k], seen[k]) for k, v in want.items()}
    best = sorted((k for k in want if links[k] and not conflict[k]), key=lambda k: (-overlap[k], -len(want[k][0]), k))[:5]
    assert [c.candidate_id for c in op.ranked(op.merged(spark.createDataFrame(hits, HIT)), "graph", 5).collect()] == best


def test_many_hits_of_one_name(spark):
    hits = spark.range(3000).select(F.col("id").alias("hit_id"), F.lit("a").alias("provider"), F.col("id").cast("string").alias("provider_id"), F.lit("t").alias("title"), F.lit("10.1000/x").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.lit(None).cast("int").alias("year"), F.lit("").alias("abstract"), F.array().cast("array<string>").alias("urls"), F.lit(None).cast("string").alias("license"))
    assert op.merged(hits).agg(F.max("root"), F.count(F.lit(1))).first() == (0, 3000)
    assert op.candidates(op.merged(hits.limit(0))).count() == 0


def test_identifiers_and_addresses(spark):
    ids = {"2401.12345v2": "2401.12345", "https://arxiv.org/pdf/2401.12345v1.pdf": "2401.12345", "http://www.arxiv.org/abs/math.AG/0601001": "math.AG/0601001", "hep-th/0101001v3": "hep-th/0101001", "2401.1": None, "x2401.12345": None, "": None, None: None}
    got = spark.createDataFrame([(k,) for k in ids], "v string").select("v", fn.arxiv(F.col("v")).alias("a")).collect()
    assert {r.v: r.a for r in got} == ids
    links = ["http://h", "http://h", "HTTPS://h:80/p?q", "ftp://h", "https://u@h/", "http://:80/", "http://[::1]/x", "http:///p", None, "http://h?x@y", "http://" + "h" * 8190, *[f"http://n/{i}" for i in range(9)]]
    row = spark.createDataFrame([(links, []), (None, [])], "u array<string>, e array<string>").select(fn.addresses(F.col("u")).alias("u"), fn.addresses(F.col("e")).alias("e")).collect()
    assert row[0].u == ["http://h", "HTTPS://h:80/p?q", "http://[::1]/x", "http://h?x@y", *[f"http://n/{i}" for i in range(4)]] and row[0].e == [] and row[1].u is None


def test_preferred(spark):
    rows = [
        (["https://h/a", "https://arxiv.org/pdf/2401.00001v2.pdf", "https://www.arxiv.org/abs/2401.00002"], ["2401.00009"]),
        (["https://h/a", "http://arxiv.org/pdf/2401.00001", "https://u:p@arxiv.org/pdf/2401.00001"], ["bad", "2401.00009v1", "2401.00008"]),
        (["https://arxiv.org/html/2401.00001", "https://arxiv.org/pdf/nothing"], []),
    ]
    got = [r.p for r in spark.createDataFrame(rows, "u array<string>, a array<string>").select(op.preferred(F.col("u"), F.col("a")).alias("p")).collect()]
    assert got == [
        ["https://arxiv.org/html/2401.00001v2", "https://arxiv.org/html/2401.00002", *rows[0][0]],
        ["https://arxiv.org/html/2401.00009v1", *rows[1][0]],
        rows[2][0],
    ]
