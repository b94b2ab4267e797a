"""Metadata of papers: Atom feeds, providers' JSON replies and search pages as hits; hits merged into candidates.

A hit has provider, provider_id, title, doi, arxiv_id, year, abstract, urls and license. A feed or reply with one
bad entry gives no hits, only its issue: half a reply says nothing about what was found. Everything here is
DataFrame functions; parsing needs no shuffle. Null or empty input is malformed; nothing raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.shared import written
from .graph import components
from .validate import first_failure

#: Most bytes of a feed, entries of a feed or reply, characters of titles and abstracts, items and words of a search page.
FEED_BYTES, ENTRIES, ITEMS, LEAST_WORD = 2_000_000, 5, 50, 4
ATOM_TITLE, ATOM_ABSTRACT, TITLE, ABSTRACT = 1000, 3000, 2000, 6000
#: What an entry's identifier may look like, the root of a feed, and the media types of full texts.
VERSIONED = r"^(\d{4}\.\d{4,5}|[a-z-]+(\.[A-Z]{2})?/\d{7})(v[1-9]\d*)?$"
FEED_ROOT = r"""(?s)^\s*(<\?xml[^>]*\?>\s*)?(<!--.*?-->\s*)*<feed\b[^>]*\sxmlns=["']http://www\.w3\.org/2005/Atom["']"""
FULL_TEXT = ("application/pdf", "text/plain", "text/html")

FEED = "entry array<struct<id string, title string, summary string>>, broken string"
#: What is read of each provider's reply.
REPLIES = {
    "openalex": "results array<struct<id string, title string, doi string, publication_year int, best_oa_location struct<pdf_url string, license string>, locations array<struct<pdf_url string, is_oa boolean>>>>",
    "semantic_scholar": "data array<struct<paperId string, title string, year int, abstract string, externalIds struct<DOI string, ArXiv string>, openAccessPdf struct<url string, license string>>>",
    "crossref": "message struct<items array<struct<DOI string, title array<string>, published struct<`date-parts` array<array<int>>>, abstract string, link array<struct<URL string, `content-type` string>>>>>",
}


def atom(feeds: DataFrame) -> DataFrame:
    """Feeds (feed_id, xml) with their issue (or ok) and their hits: unsafe, malformed, not_a_feed, identifier, incomplete, count."""
    upper, blank = F.upper("xml"), lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    safe = (F.octet_length("xml") <= FEED_BYTES) & ~upper.contains("<!DOCTYPE") & ~upper.contains("<!ENTITY")
    read = F.from_xml(F.when(safe, F.col("xml")), FEED, {"columnNameOfCorruptRecord": "broken", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "true"})
    entries = F.coalesce(F.col("read.entry"), F.array().cast("array<struct<id string, title string, summary string>>"))
    known = F.transform(entries, lambda e: F.struct(
        F.regexp_replace(F.coalesce(e["id"], F.lit("")), r"(?s)^.*?/abs/", "").alias("id"), F.trim(e["title"]).alias("title"), F.trim(e["summary"]).alias("summary")))
    issue = first_failure([
        ("malformed", F.coalesce(F.trim("xml"), F.lit("")) == ""),
        ("unsafe", ~safe),
        ("not_a_feed", ~F.col("xml").rlike(FEED_ROOT)),
        ("malformed", F.col("read").isNull() | F.col("read.broken").isNotNull()),
        ("identifier", F.exists("known", lambda e: ~e["id"].rlike(VERSIONED))),
        ("incomplete", F.exists("known", lambda e: blank(e["title"]) | blank(e["summary"]))),
        ("count", (F.size("known") > ENTRIES) | (F.size(F.array_distinct(F.transform("known", lambda e: e["id"]))) < F.size("known"))),
    ])
    hits = F.transform("known", lambda e: hit(
        F.lit("arxiv"), e["id"], F.substring(e["title"], 1, ATOM_TITLE), None, fn.arxiv(e["id"]), None, F.substring(e["summary"], 1, ATOM_ABSTRACT),
        F.array(F.concat(F.lit("https://arxiv.org/pdf/"), e["id"])), None))
    return _judged(feeds.withColumn("read", read).withColumn("known", known).withColumn("issue", issue), "feed_id", hits)


def hit(provider: Column, key: Column, title: Column, doi: Column | None, arxiv: Column | None, year: Column | None, abstract: Column | None, urls: Column, license: Column | None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(
        provider.alias("provider"), text(key).alias("provider_id"), F.substring(title, 1, TITLE).alias("title"), text(doi).alias("doi"), text(arxiv).alias("arxiv_id"),
        (F.lit(None) if year is None else year).cast("int").alias("year"), F.substring(F.coalesce(text(abstract), F.lit("")), 1, ABSTRACT).alias("abstract"),
        fn.addresses(urls).alias("urls"), text(license).alias("license"),
    )


def _openalex(r: Column) -> Column:
    best, open_access = r["best_oa_location"], F.filter(r["locations"], lambda v: v["is_oa"])
    links = F.concat(F.array(best["pdf_url"]), F.coalesce(F.transform(open_access, lambda v: v["pdf_url"]), F.array().cast("array<string>")))
    return hit(F.lit("openalex"), r["id"], r["title"], fn.doi(r["doi"]), None, r["publication_year"], None, links, best["license"])


def _semantic_scholar(r: Column) -> Column:
    ids, copy = r["externalIds"], r["openAccessPdf"]
    return hit(F.lit("semantic_scholar"), r["paperId"], r["title"], fn.doi(ids["DOI"]), fn.arxiv(ids["ArXiv"]), r["year"], r["abstract"], F.array(copy["url"]), copy["license"])


def _crossref(r: Column) -> Column:
    links = F.transform(F.filter(r["link"], lambda v: v["content-type"].isin(*FULL_TEXT)), lambda v: v["URL"])
    year = F.get(F.get(r["published"]["date-parts"], F.lit(0)), F.lit(0))
    return hit(F.lit("crossref"), r["DOI"], F.get(r["title"], F.lit(0)), fn.doi(r["DOI"]), None, year, r["abstract"], F.coalesce(links, F.array().cast("array<string>")), None)


def replies(raw: DataFrame) -> DataFrame:
    """Replies (reply_id, provider, json) with their issue (or ok) and their hits: provider, malformed, count, incomplete."""
    read = {p: F.from_json(F.when(F.col("provider") == p, F.col("json")), schema) for p, schema in REPLIES.items()}
    whole = raw.select("*", *[r.alias(p) for p, r in read.items()])
    rows = {"openalex": F.col("openalex.results"), "semantic_scholar": F.col("semantic_scholar.data"), "crossref": F.col("crossref.message.items")}
    shape = {"openalex": _openalex, "semantic_scholar": _semantic_scholar, "crossref": _crossref}
    known = F.coalesce(*[F.transform(rows[p], shape[p]) for p in REPLIES])
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    issue = first_failure([
        ("provider", F.coalesce(~F.col("provider").isin(*REPLIES), F.lit(True))),
        ("malformed", F.col("known").isNull()),
        ("count", F.size("known") > ENTRIES),
        ("incomplete", F.exists("known", lambda h: blank(h["title"]) | blank(h["provider_id"]))),
    ])
    return _judged(whole.withColumn("known", known).withColumn("issue", issue), "reply_id", F.col("known"))


def _judged(rows: DataFrame, key: str, hits: Column) -> DataFrame:
    return rows.select(key, "issue", F.when(F.col("issue") == "ok", hits).alias("hits"))


def exploded(judged: DataFrame, key: str) -> DataFrame:
    """A row a hit, with its place in its feed or reply."""
    return judged.select(key, F.posexplode("hits").alias("place", "hit")).select(key, "place", "hit.*")


def _bare(html: Column) -> Column:
    """The text pieces of marked-up text, each trimmed, with single spaces between them."""
    pieces = F.filter(F.transform(F.split(html, r"<[^>]*>"), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")
    plain = F.array_join(pieces, " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def search_pages(pages: DataFrame, query: str, most: int = ENTRIES) -> DataFrame:
    """The hits of result pages (page_id, html): page_id, place, arxiv_id, title, abstract, score (query words in them).

    Of a page's first 50 items those count that have an arXiv address and a title, each identifier once; the best by
    (score, address) stay. A page without items has no rows.
    """
    words = sorted(set(_query_words(query)))
    tagged = lambda t, tag, name: F.regexp_extract(t, rf'(?is)<{tag}\b[^>]*\bclass="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</{tag}>', 1)
    items = F.filter(F.split("html", r"(?i)<li\b"), lambda t: t.rlike(r'(?is)^[^>]*\bclass="(?:[^"]*\s)?arxiv-result(?:\s[^"]*)?"'))
    address = lambda t: F.regexp_extract(tagged(t, "p", "list-title"), r'(?is)<a\b[^>]*\bhref="([^"]*/abs/[^"]*)"', 1)
    read = F.transform(F.slice(items, 1, ITEMS), lambda t: F.struct(
        F.when(address(t).rlike(r"^https://arxiv\.org/"), fn.arxiv(address(t))).alias("arxiv_id"), _bare(tagged(t, "p", "title")).alias("title"),
        F.substring(_bare(F.coalesce(F.nullif(tagged(t, "span", "abstract-full"), F.lit("")), tagged(t, "span", "abstract-short"))), 1, ABSTRACT).alias("abstract")))
    rows = pages.select("page_id", F.posexplode(read).alias("at", "i")).filter("i.arxiv_id is not null and i.title <> ''")
    first = rows.groupBy("page_id", "i.arxiv_id").agg(F.min_by("i", "at").alias("i"))
    low = F.lower(F.concat_ws(" ", "i.title", "i.abstract"))
    score = sum((low.contains(w).cast("long") for w in words), F.lit(0).cast("long"))
    # at most ITEMS hits a page are gathered here
    best = first.groupBy("page_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-score).alias("order"), F.col("i.arxiv_id").alias("arxiv_id"), "i.title", "i.abstract"))), 1, most).alias("best"))
    return best.select("page_id", F.posexplode("best").alias("place", "b")).select("page_id", "place", "b.arxiv_id", "b.title", "b.abstract", (-F.col("b.order")).alias("score"))


def _query_words(query: str) -> list[str]:
    import re

    return re.findall(rf"[a-z0-9]{{{LEAST_WORD},}}", query.casefold())


def named(hits: DataFrame, *more: str) -> DataFrame:
    """hit_id, more of its columns, and each name that identifies its paper: provider's id, DOI, arXiv id. Titles identify nothing."""
    names = F.array(F.concat_ws(":", "provider", "provider_id"), F.concat(F.lit("doi:"), fn.doi(F.col("doi"))), F.concat(F.lit("arxiv:"), fn.arxiv(F.col("arxiv_id"))))
    return hits.select("hit_id", *more, F.explode(F.array_compact(F.array_distinct(names))).alias("alias"))


def merged(hits: DataFrame) -> DataFrame:
    """Each hit with the least hit of its candidate (root): hits that share a name, directly or through others, are one paper.

    A name links its hits to its least one, so a name that many hits share makes no pairs. Hits are written once, so
    that what they are parsed from is read once, and so are the members, which candidates read for several sums.
    """
    hits = written(hits, "hits")
    names = named(hits)
    least = names.groupBy("alias").agg(F.min("hit_id").alias("v"))
    links = names.join(least, "alias").filter("hit_id <> v").select(F.col("hit_id").alias("u"), "v").distinct()
    roots = components(links)
    return written(hits.join(roots, F.col("hit_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "hit_id")).drop("node"), "members")


def candidates(found: DataFrame, query: str = "") -> DataFrame:
    """The candidates of merged hits: their name, how many names and distinct observations they have, whether two DOIs or
    two arXiv ids contradict each other, how many addresses, and how many words of the query their texts hold.

    The name comes from the names of the least hit, so later hits don't change it.
    """
    words = sorted(set(_query_words(query)))
    low = F.lower(F.concat_ws(" ", "title", "abstract"))
    fields = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in ("provider", "provider_id", "title", "doi", "arxiv_id", "year", "abstract", "license")], F.to_json(F.struct("urls")).alias("urls"))
    texts = found.groupBy("root").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct(F.sha2(F.to_json(fields), 256)).alias("observations"),
        sum((F.max(low.contains(w)).cast("long") for w in words), F.lit(0).cast("long")).alias("overlap"),
    )
    links = found.select("root", F.explode("urls").alias("url")).groupBy("root").agg(F.count_distinct("url").alias("urls"))
    names = named(found, "root").groupBy("root", "alias").agg((F.min("hit_id") == F.col("root")).alias("own"))
    kind = lambda p: F.count_if(F.col("alias").startswith(p))
    # own names are at most three
    known = names.groupBy("root").agg(
        F.count(F.lit(1)).alias("aliases"), ((kind("doi:") > 1) | (kind("arxiv:") > 1)).alias("conflict"),
        F.sort_array(F.collect_list(F.when(F.col("own"), F.col("alias")))).alias("own"),
    )
    name = F.concat(F.lit("paper-"), F.substring(F.sha2(F.to_json("own"), 256), 1, 24))
    return texts.join(known, "root").join(links, "root", "left").select("root", name.alias("candidate_id"), "hits", "observations", "aliases", "conflict", F.coalesce("urls", F.lit(0)).alias("urls"), "overlap")


def ranked(found: DataFrame, query: str, most: int) -> DataFrame:
    """The best candidates that have an address and no conflict: by words of the query, names, then the candidate's name."""
    order = [F.desc("overlap"), F.desc("aliases"), F.col("candidate_id")]
    return candidates(found, query).filter("urls > 0 and not conflict").orderBy(*order).limit(most)


def preferred(urls: Column, arxiv_ids: Sequence[Column] | Column) -> Column:
    """Addresses in the order they should be tried: arXiv's HTML of the same version first, then all as given."""
    secure = F.filter(urls, lambda u: u.rlike(r"^(?i:https)://(?i:(www\.)?arxiv\.org)(:\d*)?/(pdf|abs|html)/") & fn.arxiv(_paper(u)).isNotNull())
    pages = F.transform(secure, _paper)
    ids = arxiv_ids if isinstance(arxiv_ids, Column) else F.array(*arxiv_ids)
    observed = F.slice(F.filter(ids, lambda a: fn.arxiv(a).isNotNull()), 1, 1)
    html = F.transform(F.when(F.size(pages) > 0, pages).otherwise(observed), lambda a: F.concat(F.lit("https://arxiv.org/html/"), a))
    return F.array_distinct(F.concat(html, urls))


def _paper(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:]+://[^/]+/(?:pdf|abs|html)/([^?#]+?)(?:\.pdf)?(?:[?#].*)?$", 1)
