"""Operators 6 and 10 against the libraries."""

from __future__ import annotations

import random

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from strataloom.llm import sentencepieces, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def fuzz(alphabet, n, seed):
    r = random.Random(seed)
    return [(1000 + i, "".join(r.choice(alphabet) for _ in range(r.randrange(60)))) for i in range(n)]


def test_counts_like_library(spark, table, hard, monkeypatch):
    rows = [*hard, *fuzz("abst'mdrel vle  \n\t\r12.,!é中\xa0 \x1c\x85́😀ß’½Ⅷ٣", 400, 1), (40, "<|endoftext|> 's<|endof"), (41, "word " * 1500)]
    for common in (400_000, 3):
        monkeypatch.setattr(token_counts, "BROADCAST", common)
        monkeypatch.setattr(token_counts.common_tokens, "__defaults__", (common,))
        got = token_counts.token_counts(table(rows, extra=["token", "rest", "n"]), BPE).collect()
        want = Tokenizer.from_file(BPE)
        expected = sorted((str(i), len((t or "").encode()), n := len(want.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == expected


def test_ids_like_library(spark, table, hard):
    rows = [*hard, *fuzz("abcthe ning  \n\t▁<s>é中😀\x00́.", 400, 2), (40, "<s></s><unk><0x0A>"), (41, " lead"), (42, "trail  ")]
    library = SentencePieceProcessor(model_file=PIECES)
    got = sentencepieces.encoded(table(rows, extra=["__text2"]).select("doc_id", "text", "n_chars"), PIECES).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert memoryview(r.ids).cast("I").tolist() == want and r.decoded == library.decode(want) and r.n_tokens == len(want)


def test_empty_tables(table):
    assert token_counts.token_counts(table([]), BPE).count() == 0
    assert sentencepieces.digests(table([]), PIECES).count() == 0
