"""Operator 7: quality classifier by hierarchical empirical Bayes.

Two questions are asked of each document: is it of bad quality, and is it toxic. For each:

1. Evidence. Features (words, and buckets of style measures) are counted over the labelled documents by
   grouped aggregation; beyond SAMPLE labelled rows over so many of them, which bounds the broadcast of
   labels to their documents. A feature's log likelihood ratio is shrunk towards 0 by its own uncertainty, and
   the strongest FEATURES of them are the model, which bounds the broadcast. A document's sum is
   calibrated to a probability under the global base rate by a logistic fit on binned labelled sums.
2. Sites. Hosts and their paths get Beta posteriors from their documents' answers: the label where there
   is one (all labels count here), the classifier's probability elsewhere. The host's prior is the global
   rate, the path's prior is its host's posterior. Each prior's strength is fitted by moments, from the
   spread between sites beyond what the spread inside sites explains, so sparse sites stay near the level
   above and no site outweighs its evidence.
3. Combination. A document's odds are its likelihood ratio times the odds of its path, from which its
   own contribution is left out.

A document is kept if both probabilities are below one half.

Defined results: a null text counts as empty, without words; a null source or section is a site of its own, that of the empty name; labels
with null answers or several labels for one id count as what they say, on average for its site; without
labels of both kinds the evidence is 0 and nothing is rejected; repeated rows give repeated results; an
empty table gives an empty result. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as tn
from .common import ROW, column, documents, numbered, without, written

QUESTIONS = ("bad", "toxic")
#: Features of a model, the most that are broadcast, and the least documents a feature must be in.
FEATURES, LEAST = 1 << 16, 4
#: Labelled rows that the model and the calibration are fitted on, at most: those of the least hash.
SAMPLE = 20_000
#: A shrunk log likelihood ratio is the ratio less so many standard errors.
CAUTION = 2.5
#: Documents' figures are binned in steps of 1 / BINS up to EDGE for the calibration.
BINS, EDGE = 2, 16
FIGURES = ("style", "peak", "words")
_U = np.uint64

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"]] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, dtype=np.int64)
_LETTER[65:91] = _LETTER[97:123] = 1
_LINE = np.zeros(256, dtype=np.int64)
_LINE[10] = 1


def style(texts: pa.Array, word: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Bucketed style measures of each text: shares of symbols, capitals, repeats, new words; lengths."""
    raw, at = tn.data(texts)
    total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[at])
    size, words = np.maximum(np.diff(at), 1), np.diff(bounds)
    owner = np.repeat(np.arange(len(words)), words)
    again = np.zeros(len(word), dtype=np.int64)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    _, distinct_text, _ = tn.distinct_in_text(word, owner)
    n = np.maximum(words, 1)
    share = lambda x, of: np.floor(np.log2(np.maximum(x / np.maximum(of, 1), 2.0**-10)) * 2).astype(np.int64)
    return [
        share(total(_SYMBOL[raw]), size),
        share(total(_UPPER[raw]), total(_LETTER[raw])),
        share(np.bincount(owner, weights=again, minlength=len(words)), n),
        np.floor(np.bincount(distinct_text, minlength=len(words)) / n * 20).astype(np.int64),
        np.floor(np.log2(n)).astype(np.int64),
        np.minimum(size // n, 30),
        share(total(_LINE[raw]), n),
    ]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text: their hashes, the text of each, and which are of style."""
    word, bounds = tn.words(texts)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    value, text, _ = tn.distinct_in_text(word, owner)
    buckets = [tn.mix((b + 1000).astype(np.uint64) * _U(64) + _U(k) + _U(1 << 40)) for k, b in enumerate(style(texts, word, bounds))]
    everyone = np.arange(len(bounds) - 1)
    return np.concatenate([value, *buckets]), np.concatenate([text, *([everyone] * len(buckets))]), np.arange(len(value) + len(buckets) * len(everyone)) >= len(value)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of labelled texts with their number of documents for each pair of answers."""
    for batch in batches:
        column = tn.as_text(batch.column("text"))
        for a, b in tn.slices(column):
            value, text, _ = features(column.slice(a, b - a))
            answers = [np.nan_to_num(batch.column(q).slice(a, b - a).cast(pa.float64()).to_numpy(zero_copy_only=False), nan=-1)[text] for q in QUESTIONS]
            distinct, at = np.unique(value, return_inverse=True)
            columns = [np.bincount(at, weights=x == y, minlength=len(distinct)).astype(np.int64) for x in answers for y in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), *map(pa.array, columns)], names=["feature", *[f"{q}{y}" for q in QUESTIONS for y in (0, 1)]])


def _evidence(model):
    """Each text's figures for each question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = model.value
        for batch in batches:
            column = tn.as_text(batch.column("text"))
            for a, b in tn.slices(column):
                value, text, of_style = features(column.slice(a, b - a))
                at = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
                hit = known[at] == value if len(known) else np.zeros(len(value), bool)
                styled, words = hit & of_style, hit & ~of_style
                root = np.sqrt(1 + np.bincount(text[words], minlength=b - a))
                sums = []
                for w in weights:
                    peak = np.zeros(b - a)
                    np.maximum.at(peak, text[words], w[at[words]])
                    sums += [np.bincount(text[styled], weights=w[at[styled]], minlength=b - a), peak, np.bincount(text[words], weights=w[at[words]], minlength=b - a) / root]
                rest = batch.slice(a, b - a).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, *[pa.array(x.astype(float)) for x in sums]], names=[*rest.schema.names, *[f"{q}_{f}" for q in QUESTIONS for f in FIGURES]])

    return run


def fit_evidence(texts: DataFrame, labels: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """The model: feature hashes in order, and each question's weights."""
    asked = labels.select(F.col("doc_id").alias("l_id"), (1 - F.col("quality").cast("int")).alias("bad"), F.col("toxic").cast("int").alias("toxic"))
    known = texts.join(asked, texts["doc_id"] == asked["l_id"]).select("text", *QUESTIONS)
    names = [f"{q}{y}" for q in QUESTIONS for y in (0, 1)]
    counts = written(known.mapInArrow(_counted, "feature long, " + ", ".join(f"{n} long" for n in names)).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]), "features")
    totals = known.agg(*[F.sum((F.col(q) == y).cast("long")).alias(f"{q}{y}") for q in QUESTIONS for y in (0, 1)]).first()
    scored = counts
    for q in QUESTIONS:
        good, bad = totals[f"{q}0"] or 0, totals[f"{q}1"] or 0
        if good and bad:
            p, n = (F.col(f"{q}1") + 0.5) / (bad + 1.0), (F.col(f"{q}0") + 0.5) / (good + 1.0)
            ratio = F.log(p / n)
            error = F.sqrt(1 / (F.col(f"{q}1") + 0.5) + 1 / (F.col(f"{q}0") + 0.5))
            scored = scored.withColumn(f"w_{q}", F.signum(ratio) * F.greatest(F.abs(ratio) - CAUTION * error, F.lit(0.0)))
        else:
            scored = scored.withColumn(f"w_{q}", F.lit(0.0))
    strength = F.greatest(*[F.abs(f"w_{q}") for q in QUESTIONS])
    strong = scored.filter(F.greatest(F.col(names[0]) + F.col(names[1]), F.col(names[2]) + F.col(names[3])) >= LEAST).withColumn("strength", strength).filter("strength > 0")
    table = strong.orderBy(F.desc("strength"), "feature").limit(FEATURES).select("feature", *[f"w_{q}" for q in QUESTIONS]).toArrow()
    hashed = table.column("feature").to_numpy().view(np.uint64)
    order = np.argsort(hashed)
    return hashed[order], [table.column(f"w_{q}").to_numpy().astype(float)[order] for q in QUESTIONS]


def fit_logistic(bins: list[tuple[tuple[float, ...], int, int]]) -> tuple[list[float], float]:
    """Slopes and offset of a logistic surface through binned (figures, answers 0, answers 1)."""
    if not any(b[1] for b in bins) or not any(b[2] for b in bins):
        return [0.0] * len(FIGURES), -20.0
    x = np.array([[*b[0], 1.0] for b in bins])
    n0, n1 = np.array([b[1] for b in bins], dtype=float), np.array([b[2] for b in bins], dtype=float)
    ridge = np.array([0.1] * len(FIGURES) + [1e-6])
    w = np.zeros(len(FIGURES) + 1)
    w[-1] = np.log((n1.sum() + 0.5) / (n0.sum() + 0.5))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * ((n0 + n1) * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (n1 - (n0 + n1) * p) - ridge * w)
        w += np.clip(step, -1, 1)
    return w[:-1].tolist(), float(w[-1])


def odds(p: Column) -> Column:
    return p / (1 - p)


def host_of(source: Column) -> Column:
    """The host of an address, or a source up to its first slash."""
    return F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), "^(?:[a-z]+://)?([^/?#]*)", 1)


def path_of(source: Column) -> Column:
    """The first part of an address after its host; empty if there is none."""
    return F.substring_index(F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), r"^(?:[a-z]+://)?[^/?#]*/([^?#]*)", 1), "/", 1)


def strength(level: DataFrame, n: str, s: str, squares: str, mean: Column, rate: float) -> float:
    """Strength of the Beta prior above a level of sites: rate (1 - rate) over the true spread of their means, less 1.

    level: a row a site with its number of documents, the sum and the sum of squares of their answers.
    """
    away, within = F.col(n) * F.pow(F.col(s) / F.col(n) - mean, 2), F.col(squares) - F.col(s) * F.col(s) / F.col(n)
    row = level.agg(F.sum(away).alias("away"), F.sum(within).alias("within"), F.count(F.lit(1)).alias("sites"), F.sum(n).alias("n")).first()
    if not row["n"]:
        return 1.0
    inside = max(row["within"], 0.0) / max(row["n"] - row["sites"], 1)
    spread = (row["away"] - row["sites"] * inside) / row["n"]
    return float(min(max(rate * (1 - rate) / spread - 1 if spread > 0 else 1e4, 1.0), 1e4))


def site_rates(answers: DataFrame, question: str, rate: float) -> DataFrame:
    """Each (host, path) with its number n of documents, sum s of their answers, prior mean m and prior strength k.

    answers: host, path and a_<question>, the answer between 0 and 1.
    """
    a = F.col(f"a_{question}")
    path = answers.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("s"), F.sum(a * a).alias("squares"))
    host = path.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("squares").alias("host_squares"))
    above = strength(host, "host_n", "host_s", "host_squares", F.lit(rate), rate)
    host = host.select(F.col("host").alias("h"), ((F.col("host_s") + above * rate) / (F.col("host_n") + above)).alias("mean"))
    both = written(path.join(host, F.col("host") == F.col("h")).drop("h"), "sites")
    own = strength(both, "n", "s", "squares", F.col("mean"), rate)
    return both.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), F.col("n").alias(f"n_{question}"), F.col("s").alias(f"s_{question}"), F.col("mean").alias(f"m_{question}"), F.lit(own).alias(f"k_{question}"))


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", section_col: str | None = "lang") -> DataFrame:
    """A row for each row of docs: doc_id, host, path, p_bad and p_toxic (evidence alone), bad and toxic (with sites), kept.

    site_col holds a source or an address, of which the host is taken; section_col the path in it, or
    None for the address's own first part.
    """
    section = column(section_col) if section_col else path_of(column(site_col))
    texts = docs.select(F.lit(None).cast("long").alias(ROW), column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"), *sites_of(column(site_col), section))
    return _classified(texts, labels).drop(ROW)


def sites_of(site: Column, section: Column) -> list[Column]:
    return [host_of(site).alias("host"), F.coalesce(section.cast("string"), F.lit("")).alias("path")]


def _classified(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """texts: __row, doc_id, text, host, path; the same without text but with the figures."""
    spark = texts.sparkSession
    sample = F.broadcast(labels.orderBy(F.xxhash64("doc_id", "quality", "toxic")).limit(SAMPLE))
    model = spark.sparkContext.broadcast(fit_evidence(texts, sample))
    kind = texts.schema["doc_id"].dataType.simpleString()
    sums = written(texts.mapInArrow(_evidence(model), f"{ROW} long, doc_id {kind}, host string, path string, " + ", ".join(f"{q}_{f} double" for q in QUESTIONS for f in FIGURES)), "evidence")
    asked = sample.select(F.col("doc_id").alias("l_id"), (1 - F.col("quality").cast("int")).alias("l_bad"), F.col("toxic").cast("int").alias("l_toxic"))
    known = sums.join(asked, sums["doc_id"] == asked["l_id"])
    scored, rates = sums, {}
    for q in QUESTIONS:
        clipped = [F.greatest(F.least(F.col(f"{q}_{f}"), F.lit(float(EDGE))), F.lit(-float(EDGE))) for f in FIGURES]
        steps = [(F.floor(c * BINS) / BINS).alias(f) for c, f in zip(clipped, FIGURES, strict=True)]
        answers = [F.sum((F.col(f"l_{q}") == y).cast("long")).alias(f"n{y}") for y in (0, 1)]
        # At most (2 * EDGE * BINS + 1) ** 2 * (EDGE * BINS + 1) rows, whatever the input.
        bins = sorted((tuple(float(r[f]) for f in FIGURES), r["n0"], r["n1"]) for r in known.filter(F.col(f"l_{q}").isNotNull()).groupBy(*steps).agg(*answers).collect())
        slopes, offset = fit_logistic(bins)
        n0, n1 = sum(b[1] for b in bins), sum(b[2] for b in bins)
        rates[q] = (n1 + 0.5) / (n0 + n1 + 1.0)
        scored = scored.withColumn(f"p_{q}", 1 / (1 + F.exp(-sum((c * k for c, k in zip(clipped, slopes, strict=True)), F.lit(offset)))))
    # A row an id: several labels of one document are their mean.
    told = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.avg(1 - F.col("quality").cast("int")).alias("l_bad"), F.avg(F.col("toxic").cast("int")).alias("l_toxic"))
    answered = scored.drop(*[f"{q}_{f}" for q in QUESTIONS for f in FIGURES]).join(told, scored["doc_id"] == told["l_id"], "left")
    answered = answered.withColumns({f"a_{q}": F.coalesce(f"l_{q}", f"p_{q}") for q in QUESTIONS}).drop("l_id", *[f"l_{q}" for q in QUESTIONS])
    out = answered = written(answered, "scored")
    for q in QUESTIONS:
        sites = site_rates(answered, q, rates[q])
        out = out.join(sites, (F.col("host") == F.col("s_host")) & (F.col("path") == F.col("s_path"))).drop("s_host", "s_path")
        out = out.withColumn(q, combined(F.col(f"p_{q}"), F.col(f"a_{q}"), rates[q], *[F.col(f"{x}_{q}") for x in "nsmk"])).drop(*[f"{x}_{q}" for x in "nsmka"])
    return out.withColumn("kept", (F.col("bad") < 0.5) & (F.col("toxic") < 0.5))


def combined(p: Column, own: Column, rate: float, n: Column, s: Column, mean: Column, k: Column) -> Column:
    """A document's probability: its likelihood ratio times the odds of its path without its own answer."""
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    others = F.greatest(F.least((s - own + k * mean) / (n - 1 + k), F.lit(0.999)), F.lit(0.001))
    joint = odds(p) / (rate / (1 - rate)) * odds(others)
    return joint / (1 + joint)


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns of docs."""
    rows, doc = numbered(docs), F.col("doc")
    texts = rows.select(ROW, doc["doc_id"].alias("doc_id"), doc["text"].cast("string").alias("text"), *sites_of(doc["source"], doc["lang"]))
    return without(rows, _classified(texts, labels).filter("not kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "host", "path", *[F.round(c, 6).alias(c) for c in ("p_bad", "p_toxic", "bad", "toxic")], "kept")


QUERIES = {"op7_quality": op7_quality}
SQL: dict[str, str] = {}
