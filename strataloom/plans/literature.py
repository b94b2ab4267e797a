"""Feeds, replies and result pages made of the pages' titles and addresses, read back, merged and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import literature as op
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


#: What the pages are asked for.
ASKED = "that with mente schen example"


def titled(s, d) -> DataFrame:
    """page_id, url, title (as the page spells it) and a paper's number, 0 to 9,999,999, of each page."""
    p = table(s, d, "pages").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), F.lit("")).alias("title"))
    return p.withColumn("paper", F.lpad((F.col("page_id") % 10_000_000).cast("string"), 7, "0"))


TITLED = r"""p as (select *, lpad((page_id % 10000000)::varchar, 7, '0') as paper from
  (select page_id::bigint as page_id, coalesce(url, '') as url, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as title from pages))"""


def feeds(s, d) -> DataFrame:
    """A feed a page with the page's entry and its successor's, and a fault in six of eleven."""
    clean = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    fault = F.col("page_id") % 11
    one = lambda key, text: F.concat(F.lit("<entry><id>http://arxiv.org/abs/"), key, F.lit("</id><title> "), clean(F.col("title")), F.lit("\n</title>"), text, F.lit("</entry>"))
    text = F.concat(F.lit("<summary>"), clean(F.col("url")), F.lit("</summary>"))
    first = one(F.when(fault == 4, "error").otherwise(F.concat(F.lit("math/"), "paper")), F.when(fault == 2, "").otherwise(text))
    second = one(F.when(fault == 3, F.concat(F.lit("math/"), "paper")).otherwise(F.concat(F.lit("math.AG/"), "paper", F.lit("v2"))), text)
    tag = F.when(fault == 5, "rss").otherwise("feed")
    xml = F.concat(F.when(fault == 1, "<!DOCTYPE feed>\n").otherwise(""), F.lit("<"), tag, F.lit(' xmlns="http://www.w3.org/2005/Atom"><title>q</title>'), first, second, F.when(fault != 6, F.concat(F.lit("</"), tag, F.lit(">"))).otherwise(""))
    return titled(s, d).select(F.col("page_id").alias("feed_id"), xml.alias("xml"))


ATOM_ISSUE = """case page_id % 11 when 1 then 'unsafe' when 5 then 'not_a_feed' when 6 then 'malformed' when 4 then 'identifier' else
  case when page_id % 11 = 2 or trim(title) = '' or trim(url) = '' then 'incomplete' when page_id % 11 = 3 then 'count' else 'ok' end end"""
ATOM = f"""a as (select page_id, k as place, case k when 0 then 'math/' || paper else 'math.AG/' || paper || 'v2' end as provider_id, case k when 0 then 'math/' else 'math.AG/' end || paper as arxiv_id,
  left(trim(title), 1000) as title, left(trim(url), 3000) as abstract from p, (values (0), (1)) k(k) where {ATOM_ISSUE} = 'ok')"""
query("s22_atom_issues", lambda s, d: op.atom(feeds(s, d)).select("feed_id", "issue"), f"with {TITLED} select page_id as feed_id, {ATOM_ISSUE} as issue from p")
query(
    "s22_atom_hits",
    lambda s, d: op.exploded(op.atom(feeds(s, d)), "feed_id").select("feed_id", F.col("place").cast("long").alias("place"), "provider_id", "arxiv_id", "title", "abstract", F.get("urls", F.lit(0)).alias("url")),
    f"with {TITLED}, {ATOM} select page_id as feed_id, place::bigint as place, provider_id, arxiv_id, title, abstract, 'https://arxiv.org/pdf/' || provider_id as url from a",
)


def sent(s, d) -> DataFrame:
    """A reply a page, of one of three providers in turn: its paper has the DOI of its neighbour's; every 13th is cut off, every 17th untitled."""
    doi = F.concat(F.lit("10.1000/P"), F.expr("page_id div 2"))
    title = F.when(F.col("page_id") % 17 != 0, F.col("title"))
    text = lambda c: F.lit(c)
    best, other = F.struct(F.col("url").alias("pdf_url"), text("cc-by").alias("license")), F.struct(F.concat("url", F.lit("#2")).alias("pdf_url"), (F.col("page_id") % 2 == 0).alias("is_oa"))
    alex = F.struct(F.array(F.struct(F.concat(F.lit("W"), "page_id").alias("id"), title.alias("title"), F.concat(F.lit("https://doi.org/"), doi).alias("doi"), (F.col("page_id") % 30 + 1990).alias("publication_year"), best.alias("best_oa_location"), F.array(other).alias("locations"))).alias("results"))
    ids = F.struct(doi.alias("DOI"), F.concat(F.lit("math/"), "paper", F.lit("v1")).alias("ArXiv"))
    scholar = F.struct(F.array(F.struct(F.concat(F.lit("s"), "page_id").alias("paperId"), title.alias("title"), F.col("url").alias("abstract"), ids.alias("externalIds"), F.struct(F.lit("ftp://none/").alias("url")).alias("openAccessPdf"))).alias("data"))
    dates = F.struct(F.array(F.array(F.col("page_id") % 30 + 1990, F.lit(1))).alias("date-parts"))
    links = F.array(F.struct(F.col("url").alias("URL"), text("text/html").alias("content-type")), F.struct(F.concat("url", F.lit("#3")).alias("URL"), text("image/png").alias("content-type")))
    cross = F.struct(F.struct(F.array(F.struct(doi.alias("DOI"), F.array_compact(F.array(title)).alias("title"), dates.alias("published"), links.alias("link"))).alias("items")).alias("message"))
    turn = F.col("page_id") % 3
    json = F.when(turn == 0, F.to_json(alex)).when(turn == 1, F.to_json(scholar)).otherwise(F.to_json(cross))
    return titled(s, d).select(
        F.col("page_id").alias("reply_id"), F.when(turn == 0, "openalex").when(turn == 1, "semantic_scholar").otherwise("crossref").alias("provider"),
        F.when(F.col("page_id") % 13 == 0, F.substring(json, 1, 20)).otherwise(json).alias("json"),
    )


REPLY_ISSUE = "case when page_id % 13 = 0 then 'malformed' when page_id % 17 = 0 or title = '' then 'incomplete' else 'ok' end"
GOOD = r"regexp_matches({u}, '^(?i)https?://[^/?#@:\s]+(:\d*)?([/?#]\S*)?$')"
REPLIED = f"""e as (select page_id, ['openalex', 'semantic_scholar', 'crossref'][page_id % 3 + 1] as provider, ['W' || page_id, 's' || page_id, '10.1000/P' || (page_id // 2)][page_id % 3 + 1] as provider_id,
  left(title, 2000) as title, '10.1000/p' || (page_id // 2) as doi, case when page_id % 3 = 1 then 'math/' || paper end as arxiv_id, case when page_id % 3 <> 1 then (page_id % 30 + 1990)::int end as year,
  case when page_id % 3 = 1 then left(url, 6000) else '' end as abstract, case when page_id % 3 <> 1 and {GOOD.format(u='url')} then 1 + (page_id % 6 = 0)::int else 0 end as links from p where {REPLY_ISSUE} = 'ok')"""
query("s22_reply_issues", lambda s, d: op.replies(sent(s, d)).select("reply_id", "issue"), f"with {TITLED} select page_id as reply_id, {REPLY_ISSUE} as issue from p")
query(
    "s22_reply_hits",
    lambda s, d: op.exploded(op.replies(sent(s, d)), "reply_id").select("reply_id", "provider", "provider_id", "title", "doi", "arxiv_id", "year", "abstract", F.size("urls").cast("long").alias("links")),
    f"with {TITLED}, {REPLIED} select page_id as reply_id, provider, provider_id, title, doi, arxiv_id, year, abstract, links::bigint as links from e",
)


def result_pages(s, d) -> DataFrame:
    """Each page as a page of results: itself, a copy of its identifier, one at another host, one more paper."""

    def item(host, key, title, text):
        link = F.concat(F.lit('<p class="list-title"><a href="'), F.lit(host), key, F.lit('">arXiv</a></p>'))
        return F.concat(F.lit('<li class="arxiv-result">'), link, F.lit('<p class="title is-5 mathjax">\n<b>'), title, F.lit('</b>\n</p><span class="abstract-full">'), text, F.lit("</span></li>\n"))

    abs_, paper, title = "https://arxiv.org/abs/", F.concat(F.lit("math/"), "paper"), F.col("title")
    items = item(abs_, paper, title, F.col("url")), item(abs_, F.concat(paper, F.lit("v3")), F.lit("again"), F.lit("")), item("https://other.org/abs/", paper, title, F.lit("")), item(abs_, F.concat(F.lit("hep-th/"), "paper"), F.lit("with <i>that</i>"), title)
    return titled(s, d).select("page_id", F.concat(F.lit("<ol>"), *items, F.lit("</ol>")).alias("html"))


PLAIN = r"regexp_replace(replace(replace(replace(replace(replace({t}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '^\s+|\s+$', '', 'g')"
SCORED = " + ".join(f"contains(lower(title || ' ' || abstract), '{w}')::bigint" for w in sorted(set(ASKED.split())))
query(
    "s22_search_hits",
    lambda s, d: op.search_pages(result_pages(s, d), ASKED).select("page_id", F.col("place").cast("long").alias("place"), "arxiv_id", "title", "abstract", "score"),
    f"""with {TITLED}, i as (select page_id, 'math/' || paper as arxiv_id, {PLAIN.format(t='title')} as title, {PLAIN.format(t='url')} as abstract from p where trim(title) <> ''
        union all select page_id, 'math/' || paper, 'again', '' from p where trim(title) = '' union all select page_id, 'hep-th/' || paper, 'with that', {PLAIN.format(t='title')} from p), c as (select *, {SCORED} as score from i)
      select page_id, row_number() over (partition by page_id order by score desc, arxiv_id) - 1 as place, arxiv_id, title, abstract, score from c""",
)


def all_hits(s, d) -> DataFrame:
    """The hits of feeds and replies, numbered by page and place."""
    a = op.exploded(op.atom(feeds(s, d)), "feed_id").withColumn("hit_id", F.col("feed_id") * 4 + F.col("place")).drop("feed_id", "place")
    r = op.exploded(op.replies(sent(s, d)), "reply_id").withColumn("hit_id", F.col("reply_id") * 4 + 2 + F.col("place")).drop("reply_id", "place")
    return a.unionByName(r)


PAPERS = f"""{TITLED}, {ATOM}, {REPLIED}, h as (select page_id * 4 + place as hit_id, 'arxiv' as provider, provider_id, title, null::varchar as doi, arxiv_id, abstract, 1 as links, 'https://arxiv.org/pdf/' || provider_id as url from a
    union all select page_id * 4 + 2, provider, provider_id, title, doi, arxiv_id, abstract, links, p.url from e join p using (page_id, title)),
  n as (select distinct hit_id, unnest(list_filter([provider || ':' || provider_id, 'doi:' || doi, 'arxiv:' || arxiv_id], lambda x: x is not null)) as alias from h),
  l as (select distinct x.hit_id as u, y.hit_id as v from n x join n y using (alias)), cc as (select hit_id as node, hit_id as root from h union select v, root from cc join l on u = node), r as (select node as hit_id, min(root) as root from cc group by 1)"""
query("q16_paper_members", lambda s, d: op.merged(all_hits(s, d)).select("hit_id", "root"), f"with recursive {PAPERS} select hit_id, root from r")
CANDIDATES = f"""{PAPERS}, own as (select root, 'paper-' || left(sha256(to_json(list_sort(list(distinct alias)))::varchar), 24) as candidate_id from n join r using (hit_id) where hit_id = root group by root),
  k as (select root, count(distinct alias) as aliases, count(distinct alias) filter (alias like 'doi:%') > 1 or count(distinct alias) filter (alias like 'arxiv:%') > 1 as conflict from n join r using (hit_id) group by root),
  t as (select root, count(*) as hits, {' + '.join(f"max(contains(lower(title || ' ' || abstract), '{w}')::bigint)" for w in sorted(set(ASKED.split())))} as overlap from h join r using (hit_id) group by root),
  w as (select root, count(distinct u) as urls from (select root, url as u from h join r using (hit_id) where links > 0 union all select root, url || '#2' from h join r using (hit_id) where links > 1) group by root),
  c as (select root, candidate_id, hits, aliases, conflict, coalesce(urls, 0) as urls, overlap from t join own using (root) join k using (root) left join w using (root))"""
query("q16_paper_candidates", lambda s, d: op.candidates(op.merged(all_hits(s, d)), ASKED).drop("observations"), f"with recursive {CANDIDATES} select * from c")
query(
    "q16_ranked_papers",
    lambda s, d: op.ranked(op.merged(all_hits(s, d)), ASKED, 20).select("candidate_id", "aliases", "overlap"),
    f"with recursive {CANDIDATES} select candidate_id, aliases, overlap from c where urls > 0 and not conflict order by overlap desc, aliases desc, candidate_id limit 20",
)

query(
    "c07_arxiv",
    lambda s, d: titled(s, d).select("page_id", F.explode(F.array(F.concat(F.lit("https://arxiv.org/pdf/math.AG/"), "paper", F.lit("v12.pdf")), F.concat(F.lit("2401."), "page_id"), F.col("url"))).alias("v")).select("page_id", "v", fn.arxiv(F.col("v")).alias("arxiv_id")),
    rf"""with {TITLED}, c as (select page_id, unnest(['https://arxiv.org/pdf/math.AG/' || paper || 'v12.pdf', '2401.' || page_id, url]) as v from p),
      b as (select *, regexp_replace(regexp_replace(regexp_replace(v, '^https?://(www\.)?arxiv\.org/(abs|pdf)/', ''), '\.pdf$', ''), 'v\d+$', '') as b from c)
      select page_id, v, case when regexp_full_match(b, '\d{{4}}\.\d{{4,5}}|[a-z-]+(\.[A-Z]{{2}})?/\d{{7}}') then b end as arxiv_id from b""",
)
query(
    "c09_preferred_fulltext",
    lambda s, d: titled(s, d).select("page_id", F.posexplode(op.preferred(F.array(F.col("url"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://arxiv.org/pdf/math/"), "paper", F.lit("v1.pdf"))).otherwise(F.concat(F.lit("http://arxiv.org/abs/math/"), "paper"))), F.array(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("math/"), "paper")).otherwise("none")))).alias("at", "address")).select("page_id", F.col("at").cast("long").alias("at"), "address"),
    f"""with {TITLED}, o as (select page_id, list_filter([case when page_id % 2 = 0 then 'https://arxiv.org/html/math/' || paper || 'v1' when page_id % 3 = 0 then 'https://arxiv.org/html/math/' || paper end, url,
        case when page_id % 2 = 0 then 'https://arxiv.org/pdf/math/' || paper || 'v1.pdf' else 'http://arxiv.org/abs/math/' || paper end], lambda x: x is not null) as o from p)
      select page_id, unnest(o) as address, unnest(range(len(o)))::bigint as at from o""",
)
