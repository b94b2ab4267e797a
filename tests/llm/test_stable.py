"""What must not change results: how files are split, names of other columns, structure of texts."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strataloom.llm import exact_dedup, mixing, near_dedup, quality, sentencepieces, suffixes, textnum, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["__row", "__size", "__md5", "__sha", "__norm", "__text", "doc", "norm", "place", "row", "gone", "source_size", "host", "kept", "band", "a`b", "a.b"]


@pytest.fixture
def groups(spark, tmp_path):
    """A table of several files and many row groups, with copies and near copies."""
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    base = [line(60) for _ in range(150)]
    rows = [(i, base[i % 150] if i % 3 else base[i % 150] + " tail" + str(i), "en", f"s{i % 4}", i) for i in range(900)]
    path = str(tmp_path / "groups")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.option("parquet.block.size", 16384).parquet(path)
    spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return spark.read.parquet(path), str(tmp_path)


def test_splits_may_change_between_jobs(spark, groups):
    docs, folder = groups
    runs = {"suffixes": lambda: suffixes.remove_repeats(docs), **{name: lambda stage=stage: stage(spark, docs, folder) for name, stage in corpus_pipeline.STAGES[:4]}}
    settings = {"spark.sql.leafNodeDefaultParallelism": "12", "spark.sql.files.openCostInBytes": "1000"}
    for name, run in runs.items():
        want = Counter(map(str, run().collect()))
        late = run()
        try:
            for key, value in settings.items():
                spark.conf.set(key, value)
            assert Counter(map(str, late.collect())) == want, name
        finally:
            for key in settings:
                spark.conf.unset(key)


def test_columns_of_any_name_pass(spark, table, hard):
    docs = table(hard)
    docs = docs.selectExpr("*", *[f"cast(doc_id as string) || '{n.replace('`', '')}' as `{n.replace('`', '``')}`" for n in NAMES])
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    outs = {"exact": exact_dedup.kept_rows(docs), "near": near_dedup.kept_rows(docs), "quality": quality.kept_rows(docs, labels), "mix": mixing.mix(docs)}
    outs["encode"] = sentencepieces.encoded(docs, PIECES).drop("n_tokens", "ids", "decoded")
    for name, out in outs.items():
        rows = out.collect()
        assert out.columns == docs.columns and rows, name
        assert all(r[n] == (None if r.doc_id is None else f"{r.doc_id}{n.replace('`', '')}") for r in rows for n in NAMES), name
    assert token_counts.token_counts(docs, BPE).count() == len(hard) and suffixes.remove_repeats(docs).count() == len(hard)


def thue_morse(n: int, letters: str) -> str:
    return "".join(letters[bin(i).count("1") % 2] for i in range(1 << n))


def test_structured_texts_have_hashes_of_their_own(table):
    """Thue-Morse words and their complements: polynomial hashes modulo a power of two take them for equal."""
    texts = [(2 * n + k, thue_morse(n, x)) for n in (10, 12) for k, x in enumerate(("ab", "ba"))]
    library = Tokenizer.from_file(BPE)
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(table(texts), BPE).collect()} == want
    assert {r.class_size for r in near_dedup.near_classes(table(texts)).collect()} == {1}
    spaced = [(i, " ".join(t)) for i, t in texts]
    from test_suffixes import brute

    rows = texts + [(100 + i, t) for i, t in spaced]
    assert sorted(map(tuple, suffixes.remove_repeats(table(rows)).collect())) == sorted(brute(rows))


def test_long_and_short_strings_hash_apart():
    import numpy as np

    raw = np.frombuffer(b"ab" * 3000 + b"a" * 20, np.uint8)
    start = np.array([0, 2, 0, 1, 0, 0, 6000, 6001])
    end = np.array([600, 602, 598, 599, 0, 1, 6008, 6008])
    h = textnum.hashed(raw, start, end)
    assert h[0] == h[1] and len(set(h.tolist())) == 7 and (textnum.hashed(raw, start, end, seed=1) != h).all()
