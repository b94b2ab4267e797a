"""Queries over texts and vectors: index, rankings, fusion, budgets, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import retrieve as op
from ..sources.tables import history, ordered_regions, regions, sql, table, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}
TERMS = ["the", "eaux", "der", "ción", "and"]
IN_TERMS = ", ".join(f"'{t}'" for t in TERMS)
#: The same tokens in DuckDB's regex dialect.
TOKENS = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_\p{M}][\p{L}\p{N}_\p{M}''’-]*')"
INDEX = f"idx as (select token, region_id, count(*) as tf from (select region_id, unnest({TOKENS}) as token from regions) group by all)"
LEX = f"lex as (select region_id, len(list_intersect(list_distinct({TOKENS}), [{IN_TERMS}]))::bigint as matched from regions)"
VEC = "vec as (select region_id, round(list_cosine_similarity(vector, (select vector from vectors order by region_id limit 1)), 6) as score from vectors)"


def query(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


def first_vector(s, d):
    return vectors(s, d).orderBy("region_id").limit(1).first()["vector"]


query("k02_lexical_rank", lambda s, d: op.lexical_rank(regions(s, d), TERMS), sql(f"with {LEX} select region_id, matched, matched / {len(TERMS)} as score from lex where matched > 0", "regions"))
query("a03_inverted_index", lambda s, d: op.inverted_index(regions(s, d)), sql(f"with {INDEX} select * from idx", "regions"))
query("a04_document_frequency", lambda s, d: op.document_frequency(op.inverted_index(regions(s, d))), sql(f"with {INDEX} select token, count(*) as df, sum(tf)::bigint as occurrences from idx group by token", "regions"))
query("a02_graph_summary", lambda s, d: regions(s, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("regions"), F.sum(F.size(fn.tokens(F.col("text")))).cast("long").alias("tokens")), sql(f"select source_id, count(*) as regions, sum(len({TOKENS}))::bigint as tokens from regions group by source_id", "regions"))
query("a05_repeated_line_signature", lambda s, d: op.repeated_lines(regions(s, d)), sql(r"select signature, count(*) as n from (select trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\s+', ' ', 'g')) as signature from regions) where len(string_split(signature, ' ')) >= 4 group by 1 having count(*) > 1", "regions"))
query("a16_omitted_sample", lambda s, d: regions(s, d).join(vectors(s, d).select("region_id"), "region_id", "left_anti").groupBy("source_id").agg(F.count(F.lit(1)).alias("omitted"), F.min("region_id").alias("first")), sql("select source_id, count(*) as omitted, min(region_id) as first from regions where region_id not in (select region_id from vectors) group by source_id", "regions", "vectors"))
query("a17_index_preflight", lambda s, d: regions(s, d).agg(F.count(F.lit(1)).alias("regions"), F.sum(F.size(fn.tokens(F.col("text")))).cast("long").alias("tokens"), F.count_distinct("source_id").alias("sources"), F.max("end").alias("longest")), sql(f'select count(*) as regions, sum(len({TOKENS}))::bigint as tokens, count(distinct source_id) as sources, max("end") as longest from regions', "regions"))
query("a13_alias_groups", lambda s, d: regions(s, d).select("region_id", F.sha2(fn.normal_statement(F.col("text")), 256).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("region_id").alias("first")).filter("n > 1"), sql(r"select sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) as key, count(*) as n, min(region_id) as first from regions group by 1 having count(*) > 1", "regions"))
query("k01_vector_topk", lambda s, d: op.top(op.vector_rank(vectors(s, d), first_vector(s, d)), 20), sql(f"with {VEC} select * from vec order by score desc, region_id limit 20", "vectors"))
query("c10_cosine", lambda s, d: op.vector_rank(vectors(s, d), first_vector(s, d)), sql(f"with {VEC} select * from vec", "vectors"))
query("w01_rrf_rank", lambda s, d: op.fused([op.lexical_rank(regions(s, d), TERMS).select("region_id", "score"), op.vector_rank(vectors(s, d), first_vector(s, d))], 50), sql(f"with {LEX}, {VEC}, l as (select region_id, row_number() over (order by matched desc, region_id) as rank from lex where matched > 0 qualify rank <= 50), v as (select region_id, row_number() over (order by score desc, region_id) as rank from vec qualify rank <= 50) select region_id, round(sum(1.0::double / (60 + rank)), 9) as score from (select * from l union all select * from v) group by region_id", "regions", "vectors"))
query("q01_hybrid_retrieval", lambda s, d: (lambda r: op.top(op.fused([op.lexical_rank(r, TERMS).select("region_id", "score"), op.vector_rank(vectors(s, d).join(r.select("region_id"), "region_id", "left_semi"), first_vector(s, d))], 40), 24).join(r.select("region_id", "source_id", "ordinal"), "region_id"))(ordered_regions(s, d).filter("project_id is null or project_id = 'p1'")), sql(f"with scoped as (select * from regions where project_id is null or project_id = 'p1'), {LEX.replace('from regions', 'from scoped')}, {VEC.replace('from vectors)', 'from vectors where region_id in (select region_id from scoped))')}, l as (select region_id, row_number() over (order by matched desc, region_id) as rank from lex where matched > 0 qualify rank <= 40), v as (select region_id, row_number() over (order by score desc, region_id) as rank from vec qualify rank <= 40), f as (select region_id, round(sum(1.0::double / (60 + rank)), 9) as score from (select * from l union all select * from v) group by region_id order by score desc, region_id limit 24) select region_id, score, source_id, ordinal from f join scoped using (region_id)", "regions", "vectors"))
query("f08_vector_valid", lambda s, d: vectors(s, d).select("region_id", ((F.size("vector") == 64) & F.forall("vector", lambda x: ~F.isnan(x)) & (F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x) > 0)).alias("valid")), sql("select region_id, len(vector) = 64 and not list_bool_or([isnan(x) for x in vector]) and list_sum([x * x for x in vector]) > 0 as valid from vectors", "vectors"))
query("k09_chat_order", lambda s, d: op.idf_rank(regions(s, d), TERMS), sql(f"with {INDEX}, i as (select * from idx where token in ({IN_TERMS})), f as (select token, count(*) as df from i group by token) select region_id, round(sum(ln(1 + (select count(*) from regions) / (1 + df)) * least(3, tf)), 6) as score from i join f using (token) group by region_id", "regions"))
WORDS = ["the", "tion", "eau"]
COUNT = " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in WORDS)
query("k03_ranked_candidates", lambda s, d: regions(s, d).select("region_id", sum((F.contains(F.lower("text"), F.lit(w)).cast("long") for w in WORDS), F.lit(0).cast("long")).alias("overlap"), "end").filter("overlap > 0"), sql(f'select region_id, ({" + ".join(f"contains(lower(text), {chr(39)}{w}{chr(39)})::bigint" for w in WORDS)})::bigint as overlap, "end" from regions where overlap > 0', "regions"))
SPANS = "spans as (select region_id, i * 400 as begin, substring(text, i * 400 + 1, 400) as t from (select region_id, text, unnest(range(0, greatest(1, (length(text) + 399) // 400))) as i from regions))"
query("k04_passage_spans", lambda s, d: regions(s, d).select("region_id", F.explode(fn.spans(F.col("text"), 400, 80)).alias("x")).select("region_id", F.col("x.begin").cast("long").alias("begin"), op.substring_score(F.lower("x.span"), WORDS).alias("score")), sql(f"with {SPANS} select region_id, begin, ({COUNT.replace('(t)', '(lower(t))').replace('replace(t,', 'replace(lower(t),')})::bigint as score from spans where length(t) >= 80", "regions"))
query("c24_fixed_window_spans", lambda s, d: regions(s, d).select("region_id", F.explode(fn.spans(F.col("text"), 400, 1)).alias("x")).select("region_id", F.col("x.begin").cast("long").alias("begin"), F.length("x.span").cast("long").alias("chars")), sql(f"with {SPANS} select region_id, begin, length(t)::bigint as chars from spans where length(t) >= 1", "regions"))
query("k05_vocabulary_relevance", lambda s, d: table(s, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.size(F.array_intersect(fn.tokens(F.concat_ws(" ", "p_name", "p_type")), F.array(*map(F.lit, ["steel", "brushed", "small", "red"])))).cast("long").alias("overlap")).filter("overlap > 0"), "select p_partkey::bigint as id, len(list_intersect(list_distinct(" + TOKENS.replace("text", "p_name || ' ' || p_type") + "), ['steel', 'brushed', 'small', 'red']))::bigint as overlap from part where overlap > 0")
query("k07_region_evidence_rank", lambda s, d: regions(s, d).select("region_id", "source_id", op.substring_score(F.lower("text"), WORDS).alias("score")).withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "region_id"))).filter("place <= 3").select("region_id", "source_id", "score", F.col("place").cast("long").alias("place")), sql(f"with c as (select region_id, source_id, lower(text) as t from regions) select region_id, source_id, ({COUNT})::bigint as score, row_number() over (partition by source_id order by ({COUNT}) desc, region_id) as place from c qualify place <= 3", "regions"))
query("w04_bounded_history", lambda s, d: op.newest_within(history(s, d), 400, 100).select("conv_id", "turn", F.col("used").cast("long").alias("used")), sql("select conv_id, turn, sum(size) over (partition by conv_id order by turn desc rows unbounded preceding)::bigint as used from history qualify used <= 400 and row_number() over (partition by conv_id order by turn desc) <= 100", "history"))
query("w05_first_fit_budget", lambda s, d: op.first_fit(history(s, d).withColumn("item", F.col("turn")), "conv_id", "size", 300, [F.col("turn")]))
query("c26_evidence_cards", lambda s, d: history(s, d).select("conv_id", "turn", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).alias("card")), sql("select conv_id, turn, 'S' || row_number() over (partition by conv_id order by turn) as card from history", "history"))
query("c27_citations", lambda s, d: history(s, d).select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" [S1] [G"), "turn", F.lit("] [X2]")).alias("t")).select("conv_id", "turn", F.array_join(F.regexp_extract_all("t", F.lit(r"\[([SG]\d+)\]"), F.lit(1)), ",").alias("cited"), F.array_join(F.array_except(F.regexp_extract_all("t", F.lit(r"\[([SG]\d+)\]"), F.lit(1)), F.array(F.lit("S1"), F.lit("G0"))), ",").alias("unknown")), sql("select conv_id, turn, 'S1,G' || turn as cited, case when turn = 0 then '' else 'G' || turn end as unknown from history", "history"))
query("c11_token_estimate", lambda s, d: regions(s, d).select("region_id", fn.token_estimate(F.col("text")).alias("tokens")), sql("select region_id, ceil(octet_length(encode(text)) / 2)::bigint as tokens from regions", "regions"))
query("c03_tokenize", lambda s, d: regions(s, d).select("region_id", F.array_join(fn.tokens(F.col("text")), " ").alias("tokens")), sql(f"select region_id, array_to_string({TOKENS}, ' ') as tokens from regions", "regions"))
query("c04_word_regexes", lambda s, d: regions(s, d).select("region_id", F.array_join(F.transform(fn.plain_words(F.col("text")), fn.singular), " ").alias("words")), sql("select region_id, array_to_string([regexp_replace(x, 's$', '') for x in regexp_extract_all(lower(text), '[a-z0-9]{4,}')], ' ') as words from regions", "regions"))
query("c05_stop_words", lambda s, d: regions(s, d).select("region_id", F.size(F.array_except(fn.tokens(F.col("text")), F.array(*map(F.lit, ["the", "of", "and", "de", "la", "der", "die"])))).cast("long").alias("n")), sql(f"select region_id, len([x for x in list_distinct({TOKENS}) if x not in ('the', 'of', 'and', 'de', 'la', 'der', 'die')])::bigint as n from regions", "regions"))
query("c06_normalize_statement", lambda s, d: regions(s, d).select("region_id", fn.normal_statement(F.col("text")).alias("statement")), sql(r"select region_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as statement from regions", "regions"))
query("c07_doi", lambda s, d: table(s, d, "pages").select(F.col("page_id").cast("long").alias("id"), F.explode(F.array(F.concat(F.lit("https://doi.org/10.1234/AB."), "page_id"), F.concat(F.lit("doi: 10.5555/x"), "page_id"), F.col("url"))).alias("v")).select("id", "v", fn.doi(F.col("v")).alias("doi")), r"select page_id::bigint as id, v, case when regexp_matches(b, '^10\.\d{4,9}/\S+$') then b end as doi from (select page_id, v, lower(regexp_replace(trim(v), '^(https?://(dx\.)?doi\.org/|doi:\s*)', '')) as b from (select page_id, unnest(['https://doi.org/10.1234/AB.' || page_id, 'doi: 10.5555/x' || page_id, url]) as v from pages))")
query("c08_url_filter", lambda s, d: table(s, d, "pages").select(F.col("page_id").cast("long").alias("id"), F.explode(F.array(F.col("url"), F.concat(F.lit("ftp://h/"), "page_id"), F.concat(F.lit("https://u:p@h/"), "page_id"))).alias("v")).select("id", fn.safe_url(F.col("v")).alias("url")).filter("url is not null").distinct(), r"select distinct page_id::bigint as id, v as url from (select page_id, unnest([url, 'ftp://h/' || page_id, 'https://u:p@h/' || page_id]) as v from pages) where regexp_matches(v, '^https?://[^/\s@]+(/\S*)?$')")
query("c09_preferred_url", lambda s, d: table(s, d, "pages").select(F.col("page_id").cast("long").alias("id"), F.array_join(F.array_distinct(F.array(F.regexp_replace("url", "^http:", "https:"), F.regexp_replace("url", r"\?.*$", ""), F.col("url"))), " ").alias("urls")), r"select page_id::bigint as id, a || case when b <> a then ' ' || b else '' end || case when url <> a and url <> b then ' ' || url else '' end as urls from (select page_id, url, regexp_replace(url, '^http:', 'https:') as a, regexp_replace(url, '\?.*$', '') as b from pages)")
query("c25_display_math", lambda s, d: history(s, d).select("conv_id", "turn", fn.display_math(F.concat(F.lit(r"\["), F.coalesce("text", F.lit("")), F.lit(r"\] and \(x\) ```\[as it is\]```"))).alias("t")), sql(r"select conv_id, turn, '$$' || replace(replace(coalesce(text, ''), '\[', '$$'), '\]', '$$') || '$$ and \(x\) ```\[as it is\]```' as t from history", "history"))
query("j11_exact_statement_dup", lambda s, d: (lambda r: r.join(r.groupBy("digest").agg(F.min("region_id").alias("original")), "digest").filter("original < region_id").select("region_id", "original").distinct())(regions(s, d).select("region_id", F.unhex(F.sha2(fn.normal_statement(F.col("text")), 256)).alias("digest"))), sql(r"with n as (select region_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as statement from regions) select b.region_id, min(a.region_id) as original from n a join n b on a.statement = b.statement and a.region_id < b.region_id group by 1", "regions"))
query("q08_rebuild_projection", lambda s, d: op.projection(op.inverted_index(regions(s, d))), sql(f"with {INDEX} select token, count(*) as df, min(region_id) as first, max(tf) as most from idx group by token having count(*) > 1", "regions"))
query("f10_rejected_domain_filter", lambda s, d: table(s, d, "pages").select(F.col("page_id").cast("long").alias("id"), fn.safe_url(F.col("url")).alias("u"), (F.col("page_id") % 7 == 0).alias("conflict")).filter("u is not null and not conflict").select("id", "u"), r"select page_id::bigint as id, url as u from pages where regexp_matches(url, '^https?://[^/\s@]+(/\S*)?$') and page_id % 7 <> 0")
