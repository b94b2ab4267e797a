"""Operator 10: token counts from piece counts of distinct pre-tokens.

Texts are cut into pre-tokens by the byte-level pattern of the tokenizer file, and around its special
strings, which count as one token each, as the library does by default. Three jobs follow:

1. distinct pre-tokens of the corpus with their frequency, combined in tasks before the shuffle;
2. the tokenizers library counts the pieces of each distinct pre-token, once;
3. each text's pre-token frequencies meet those counts and are summed; no ids are made. The commonest
   pre-tokens (at most BROADCAST of them, of at most BYTES bytes) meet them in the task, from a
   broadcast table of that proven size; all others through a shuffled join.

A pre-token is known in tasks by two 64-bit hashes of its bytes, in joins by the string itself.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated results;
an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as tn
from .common import ROW, column, documents, written

LIMIT = 1024
BROADCAST, BYTES = 400_000, 48
SLICE = 4 << 20
_U = np.uint64
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The contractions that the byte-level pattern cuts off.
ONE, TWO = "stmd", ("re", "ve", "ll")


@cache
def classes() -> np.ndarray:
    """The class of each code point, by the regex module; where the library's pattern knows older tables, by the library."""
    from tokenizers.pre_tokenizers import ByteLevel

    cuts = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    points = np.array([p for p in range(0x110000) if not 0xD800 <= p < 0xE000], dtype=np.uint32)
    everything = points.tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            out[points[m.start() : m.end()]] = kind
    for kind, like in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
        of_kind = points[out[points] == kind]
        for run in np.split(of_kind, np.flatnonzero(np.diff(of_kind) > 1) + 1):
            if len(run) and len(cuts(like + run.tobytes().decode("utf-32-le"))) > 1:
                for p in run.tolist():
                    out[p] = next(k for k, c in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cuts(c + chr(p))) == 1)
    return out


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def starts(point: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Which code points begin a pre-token. cut: which begin a text or follow a special string."""
    n = len(point)
    kind = classes()[point]
    first = cut[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    last = np.ones(n, dtype=bool)  # the last of its run
    last[:-1] = first[1:]
    end = np.ones(n, dtype=bool)  # the last of its text
    end[:-1] = cut[1:n]
    space = kind == SPACE
    begin = first | (space & last & ~end)
    # One plain space before other characters belongs to them.
    joined = np.zeros(n, dtype=bool)
    joined[1:] = (point[:-1] == 32) & ~space[1:] & ~cut[1:n]
    begin &= ~joined
    # Contractions: a lone apostrophe that no space precedes, and the letters after it.
    lone = np.flatnonzero((point == 39) & begin & last & ~end)
    if len(lone):
        padded = np.concatenate([point, np.zeros(2, point.dtype)])
        letters = np.concatenate([kind == LETTER, np.zeros(2, bool)])
        fresh = np.concatenate([first, np.ones(2, bool)])
        c1, c2 = padded[lone + 1], padded[lone + 2]
        one = np.isin(c1, [ord(c) for c in ONE]) & letters[lone + 1]
        two = np.zeros(len(lone), dtype=bool)
        for a, b in TWO:
            two |= (c1 == ord(a)) & (c2 == ord(b)) & ~fresh[lone + 2]
        begin[lone[one | two] + 1] = False
        for at in (lone[one] + 2, lone[two] + 3):
            begin[at[at < n]] = True
    return begin


def pre_tokens(texts: pa.Array, special: tuple[str, ...]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one string; start, end and text of each pre-token in it; special strings in each text."""
    raw, at = tn.data(texts)
    joined = raw.tobytes().decode("utf-8")
    point = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at] if len(raw) else np.zeros(len(at), np.int64)
    cut = np.zeros(len(point) + 1, dtype=bool)
    cut[chars] = True
    found = np.zeros(len(at) - 1, dtype=np.int64)
    skipped = []
    if len(point) and any(s in joined for s in special):
        for m in regex.finditer("|".join(map(regex.escape, sorted(special, key=len, reverse=True))), joined):
            text = np.searchsorted(chars, m.start(), side="right") - 1
            if m.end() <= chars[text + 1]:  # not over the border of two texts
                found[text] += 1
                cut[[m.start(), m.end()]] = True
                skipped.append((m.start(), m.end()))
    if not len(point):
        return joined, *(np.zeros(0, np.int64),) * 3, found
    begin = np.flatnonzero(starts(point, cut))
    end = np.append(begin[1:], len(point))
    if skipped:
        inside = np.zeros(len(point), dtype=bool)
        for a, b in skipped:
            inside[a:b] = True
        keep = ~inside[begin]
        begin, end = begin[keep], end[keep]
    return joined, begin, end, np.searchsorted(chars, begin, side="right") - 1, found


def hashes(texts: pa.Array, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run of code points of the texts: equal in both is equal."""
    raw, _ = tn.data(texts)
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    return tn.hashed(raw, at[begin], at[end]), tn.hashed(raw, at[begin], at[end], seed=1)


def distinct(keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places of one of each distinct row of the keys, in order of the last, then the others, and how often each occurs."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def _frequencies(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tn.as_text(batch.column("text"))
            for a, b in tn.slices(column, SLICE):
                part = column.slice(a, b - a)
                joined, begin, end, _, _ = pre_tokens(part, specials(path))
                first, second = hashes(part, begin, end)
                _, at, same, n = np.unique(first, return_index=True, return_inverse=True, return_counts=True)
                if (second != second[at][same]).any():  # two strings in one hash
                    at, n = distinct((second, first))
                yield pa.RecordBatch.from_arrays([pa.array([joined[i:j] for i, j in zip(begin[at].tolist(), end[at].tolist(), strict=True)], pa.string()), pa.array(n, pa.int64())], names=["token", "n"])

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoded = tokenizer(path).encode_batch(batch.column("token").to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(e.ids) for e in encoded], pa.int64())], names=[*batch.schema.names, "pieces"])

    return run


def _summed(path: str, common):
    """Rows, bytes, tokens of common pre-tokens, and the other pre-tokens with their frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, check, pieces = common.value
        for batch in batches:
            column = tn.as_text(batch.column("text"))
            for a, b in tn.slices(column, SLICE):
                part = column.slice(a, b - a)
                joined, begin, end, text, found = pre_tokens(part, specials(path))
                first, second = hashes(part, begin, end)
                at = np.minimum(np.searchsorted(known, first), max(len(known) - 1, 0))
                hit = (known[at] == first) & (check[at] == second) if len(known) else np.zeros(len(first), bool)
                total = found + np.bincount(text[hit], weights=pieces[at[hit]], minlength=b - a).astype(np.int64)
                rest = np.flatnonzero(~hit)
                one, times = distinct((second[rest], first[rest], text[rest]))
                one = rest[one]
                tokens = pa.array([joined[i:j] for i, j in zip(begin[one].tolist(), end[one].tolist(), strict=True)], pa.string())
                counts = pa.array(times, pa.int64())
                bounds = pa.array(np.searchsorted(text[one], np.arange(b - a + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([tokens, counts], names=["token", "n"]))
                yield pa.RecordBatch.from_arrays([batch.column(ROW).slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(np.diff(tn.offsets(part)), pa.int64()), pa.array(total, pa.int64()), lists], names=[ROW, "doc_id", "n_bytes", "known", "rest"])

    return run


def common_tokens(counted: DataFrame, most: int = BROADCAST):
    """The commonest pre-tokens for a broadcast, at most so many: those of at least a power of two of occurrences."""
    short = counted.filter(F.octet_length("token") <= BYTES)
    sizes = sorted(((r["k"], r["c"]) for r in short.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    held, least = 0, None
    for k, c in sizes:
        if held + c > most:
            break
        held, least = held + c, k
    table = short.filter(F.lit(least is not None) & (F.floor(F.log2("n")) >= (least or 0))).select("token", "pieces").toArrow()
    tokens = table.column("token").combine_chunks().cast(pa.large_string())
    points = np.concatenate([[0], np.cumsum([len(t) for t in tokens.to_pylist()], dtype=np.int64)])
    first, second = hashes(tokens, points[:-1], points[1:]) if len(tokens) else (np.zeros(0, np.uint64),) * 2
    order = np.argsort(first, kind="stable")
    return first[order], second[order], table.column("pieces").to_numpy()[order]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens, over_limit."""
    # The row's number is written with the sums and read from there, so any numbering will do.
    texts = docs.select(F.monotonically_increasing_id().alias(ROW), column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    found = texts.select("text").mapInArrow(_frequencies(path), "token string, n long")
    counted = written(found.groupBy("token").agg(F.sum("n").alias("n")).mapInArrow(_pieces(path), "token string, n long, pieces long"), "pieces")
    common = docs.sparkSession.sparkContext.broadcast(common_tokens(counted))
    kind = texts.schema["doc_id"].dataType.simpleString()
    summed = written(texts.mapInArrow(_summed(path, common), f"{ROW} long, doc_id {kind}, n_bytes long, known long, rest array<struct<token:string,n:bigint>>"), "sums")
    rest = summed.select(ROW, F.explode("rest").alias("r")).select(ROW, "r.token", F.col("r.n").alias("times"))
    more = rest.join(counted.select("token", "pieces"), "token").groupBy(ROW).agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    total = F.col("known") + F.coalesce("more", F.lit(0))
    return summed.drop("rest").join(more, ROW, "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
