"""Operator 7: held-out accuracy, and defined results."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from strataloom.llm import quality

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    out = quality.classified(docs, labels.filter(~held)).join(labels.filter(held).select(F.col("doc_id").alias("l"), "quality", F.col("toxic").alias("t")), F.col("doc_id") == F.col("l"))
    row = out.agg(F.avg(((F.col("bad") > 0.5) == (F.col("quality") == 0)).cast("int")).alias("bad"), F.avg(((F.col("toxic") > 0.5) == (F.col("t") == 1)).cast("int")).alias("toxic")).first()
    assert row["bad"] > 0.97 and row["toxic"] > 0.96


def test_hard_rows(spark, table, hard):
    docs = table([*hard, (20, "text", None)], extra=["host", "bad"])
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality.classified(docs, labels).collect()
    assert len(out) == len(hard) + 1 and all(0 <= r.bad <= 1 and 0 <= r.toxic <= 1 for r in out)
    assert quality.kept_rows(docs, labels).columns == docs.columns
    assert quality.kept_rows(docs, labels.limit(0)).count() == len(hard) + 1  # nothing is rejected without labels
    assert quality.kept_rows(table([]), labels).count() == 0


def posterior(rows, rate):
    """Sites by brute force. rows: (host, path, answer). Returns mean and strength of each path's prior, n and sum."""

    def strength(sites, means):
        n = sum(map(len, sites.values()))
        within = sum(sum(a * a for a in x) - sum(x) ** 2 / len(x) for x in sites.values())
        away = sum(len(x) * (sum(x) / len(x) - means[k]) ** 2 for k, x in sites.items())
        spread = (away - len(sites) * max(within, 0) / max(n - len(sites), 1)) / n
        return min(max(rate * (1 - rate) / spread - 1 if spread > 0 else 1e4, 1.0), 1e4)

    hosts, paths = {}, {}
    for h, p, a in rows:
        hosts.setdefault(h, []).append(a)
        paths.setdefault((h, p), []).append(a)
    k = strength(hosts, dict.fromkeys(hosts, rate))
    mean = {h: (sum(x) + k * rate) / (len(x) + k) for h, x in hosts.items()}
    own = strength(paths, {hp: mean[hp[0]] for hp in paths})
    return {hp: (len(x), sum(x), mean[hp[0]], own) for hp, x in paths.items()}


def test_sites_like_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"h{h}", f"p{rng.randrange(3)}", min(1.0, max(0.0, rng.gauss(0.1 * h, 0.2)))) for h in range(6) for _ in range(rng.choice([1, 5, 60]))]
    answers = spark.createDataFrame(rows, "host string, path string, a_bad double")
    want = posterior(rows, 0.2)
    got = {(r.s_host, r.s_path): (r.n_bad, r.s_bad, r.m_bad, r.k_bad) for r in quality.site_rates(answers, "bad", 0.2).collect()}
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 1e-6 * max(1, abs(y)) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_documents_combine_evidence_and_sites(spark, table):
    """Sites of the whole result by brute force, from the evidence it reports and the labels."""
    rng = random.Random(8)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(bad if i % 3 == 0 else good) for _ in range(30)), f"http://site{i % 5}.example/{'x' if i % 2 else 'y'}/{i}") for i in range(240)]
    labels = [(i, int(i % 3 != 0), 0) for i in range(0, 240, 2)]
    told = {i: 1 - q for i, q, _ in labels}
    out = quality.classified(table(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), section_col=None).collect()
    assert {r.host for r in out} == {f"site{i}.example" for i in range(5)} and {r.path for r in out} == {"x", "y"}
    rate = (sum(told.values()) + 0.5) / (len(told) + 1)
    answer = {r.doc_id: told.get(r.doc_id, r.p_bad) for r in out}
    sites = posterior([(r.host, r.path, answer[r.doc_id]) for r in out], rate)
    odds = lambda p: p / (1 - p)
    for r in out:
        n, s, mean, k = sites[r.host, r.path]
        others = min(max((s - answer[r.doc_id] + k * mean) / (n - 1 + k), 0.001), 0.999)
        joint = odds(min(max(r.p_bad, 1e-9), 1 - 1e-9)) / odds(rate) * odds(others)
        assert abs(r.bad - joint / (1 + joint)) < 1e-6
    assert sum(r.kept == (r.doc_id % 3 != 0) for r in out) > 230


def test_hosts_and_paths(spark):
    rows = [("https://a.b/c/d?e", "a.b", "c"), ("a.b/c", "a.b", "c"), ("a.b", "a.b", ""), (None, "", ""), ("http://a.b?x=/y", "a.b", ""), ("http://a.b/?x", "a.b", "")]
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(r[0],) for r in rows], "u string").select(quality.host_of(F.col("u")).alias("h"), quality.path_of(F.col("u")).alias("p")).collect()
    assert [(r.h, r.p) for r in got] == [(h, p) for _, h, p in rows]
