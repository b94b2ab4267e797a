"""Operator 11: spelling variants by full neighbourhood generation and a hash join.

Every word of the vocabulary emits all distinct deletions, replacements and insertions of one code point
over the alphabet that the vocabulary uses. A neighbour that is a word itself is found by an equality
join with the vocabulary, so no distance is ever computed. Each neighbour is made once: a letter is
deleted only where it differs from the one before it, replaced only by another one, and inserted only
where it differs from the one before it.

About 2 x length x alphabet strings a word would be shuffled for that join, nearly all in vain. So tasks
first look them up in a bitmap of the vocabulary's hashes (FILTER_BITS bits, whatever the input's size),
by a rolling hash that is worked out for all neighbours of many words at once, and only make strings of
those that are found in it. The bitmap has false hits but no false misses; the join decides.

Words are runs of letters (ASCII and U+00C0 to U+00FF), A-Z lower-cased. Of one run in DROP, by the crc32
of "<doc_id>:<run>", a letter is left out: variants that are known to be there. The form of a word is its
commonest near word if that is at least RATIO times as common; roots follow forms, along which counts
grow RATIO-fold, so their chains are short and have no cycles.

Defined results: a null text has no words; a null id counts as an empty string; repeated rows count again;
of equally common near words the first in code-point order is the form; a word without near words has
n_near 0, no form and is its own root. An empty table gives an empty result. Only the id and the text are
read, so other columns may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as tn
from .common import column, documents, text_of, written

LETTERS = "[A-Za-zÀ-ÿ]"
LENGTH, COUNT, RATIO, DROP = 7, 2, 10, 31
#: Bits of the vocabulary's bitmap: 16 MB. It is gathered from pieces of PIECE bits.
FILTER_BITS, PIECE = 1 << 27, 1 << 15
#: Words a task takes, and neighbours that it holds at a time.
WORDS, HELD = 5000, 1 << 21

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BACK = _U(pow(_BASE, -1, 1 << 64))


def vocabulary(docs: DataFrame, length: int = LENGTH, count: int = COUNT, drop: int = DROP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The distinct words of at least so many code points and occurrences: word, n. Counted before the shuffle."""
    # A run that is too short stays too short, so only long ones are taken out of the text.
    runs = F.explode(F.regexp_extract_all(text_of(text_col), F.lit(f"{LETTERS}{{{length},}}"), F.lit(0)))
    low = docs.select(F.coalesce(column(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run")).withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    hashed = low.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % drop == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time: which they are, and their letters as a matrix of numbers from 1 on."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        step = max(1, HELD // int(size))
        for a in range(0, len(which), step):
            part = which[a : a + step]
            letters = np.frombuffer("".join([words[i] for i in part]).encode("latin-1"), dtype=np.uint8)
            yield part, letters.reshape(len(part), size).astype(np.uint64) + _U(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _sums(letters: np.ndarray) -> np.ndarray:
    """Rolling hashes of all prefixes of each word; the last is the word's own."""
    out = np.zeros((len(letters), letters.shape[1] + 1), dtype=np.uint64)
    np.cumsum(letters * _powers(letters.shape[1]), axis=1, out=out[:, 1:])
    return out


def _place(hashes: np.ndarray) -> np.ndarray:
    return (tn.mix(hashes) & _U(FILTER_BITS - 1)).astype(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit of each word."""
    for batch in batches:
        for _, letters in _by_length(batch.column("word").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(_place(_sums(letters)[:, -1]))], names=["place"])


def bitmap(words: DataFrame) -> np.ndarray:
    """The vocabulary's bits, FILTER_BITS in all, gathered from pieces that Spark puts together."""
    places = words.select("word").mapInArrow(_places, "place long")
    pieces = places.groupBy((F.col("place") / PIECE).cast("int").alias("piece")).agg(F.bitmap_construct_agg(F.col("place") % PIECE).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in pieces.toLocalIterator():  # at most FILTER_BITS / PIECE rows of PIECE / 8 bytes
        out[row.piece * PIECE // 8 : (row.piece + 1) * PIECE // 8] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return out


def neighbours(letters: np.ndarray, alphabet: np.ndarray, found: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    """(word, place, letters left out, letter put in or 0) of all distinct neighbours whose hash is found.

    letters: words of one length, a row each. Positions are taken in ranges, so that HELD hashes are held at a time.
    """
    count, size = letters.shape
    power, sums = _powers(size + 1), _sums(letters)
    whole = sums[:, -1:]
    before = np.concatenate([np.zeros((count, 1), np.uint64), letters], axis=1)
    step = max(1, HELD // (count * len(alphabet)))
    for a in range(0, size + 1, step):
        b, end = min(a + step, size), min(a + step, size + 1)
        here = letters[:, a:b]
        less = sums[:, a:b] + (whole - sums[:, a + 1 : b + 1]) * _BACK
        kept = found(less) & (here != before[:, a:b])
        yield from ((int(w), a + int(i), 1, 0) for w, i in np.argwhere(kept))
        other = (whole - here * power[a:b])[:, :, None] + alphabet * power[a:b, None]
        kept = found(other) & (here[:, :, None] != alphabet)
        yield from ((int(w), a + int(i), 1, int(alphabet[c])) for w, i, c in np.argwhere(kept))
        more = (sums[:, a:end] + (whole - sums[:, a:end]) * _U(_BASE))[:, :, None] + alphabet * power[a:end, None]
        kept = found(more) & (before[:, a:end, None] != alphabet)
        yield from ((int(w), a + int(i), 0, int(alphabet[c])) for w, i, c in np.argwhere(kept))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of near words of a written vocabulary, each in both directions: word, n, near, near_n."""
    spark = words.sparkSession
    # At most as many rows as LETTERS has signs.
    seen = sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").distinct().collect())
    alphabet = np.array([ord(c) + 1 for c in seen], dtype=np.uint64)
    bits = spark.sparkContext.broadcast(bitmap(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value

        def found(hashes: np.ndarray) -> np.ndarray:
            place = _place(hashes)
            return (held[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)

        for batch in batches:
            own, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for which, letters in _by_length(own):
                step = max(1, HELD // (letters.shape[1] * max(1, len(alphabet))))
                for a in range(0, len(which), step):
                    made: list[tuple[str, str, int]] = []
                    for w, i, out, c in neighbours(letters[a : a + step], alphabet, found):
                        at = int(which[a + w])
                        word = own[at]
                        made.append((word[:i] + (chr(c - 1) if c else "") + word[i + out :], word, int(n[at])))
                    near, word, of = zip(*made, strict=True) if made else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(near, pa.string()), pa.array(word, pa.string()), pa.array(of, pa.int64())], names=["near", "word", "n"])

    tasks = words.count() // WORDS + 1
    made = words.repartition(tasks, "word").mapInArrow(run, "near string, word string, n long")
    return made.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words that have a form; forms: word, form. Each turn doubles the steps that are taken."""
    held = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = written(held.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("on")), "roots")
        held = moved.select("word", "root")
        if moved.filter("on").isEmpty():
            return held


def variants(docs: DataFrame, length: int = LENGTH, count: int = COUNT, ratio: int = RATIO, drop: int = DROP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each word: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs, length, count, drop, id_col, text_col), "words")
    best: Column = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    grouped = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    common = -F.col("best.minus") >= ratio * F.col("n")
    judged = written(grouped.select("word", "n_near", F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.minus")).alias("form_n")), "judged")
    ends = roots(judged.filter("form is not null"))
    return (
        words.join(judged, "word", "left").join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


QUERIES = {"op11_spelling": op11_spelling}
#: Words that agree but for one place are near, and so is a word with one of its letters left out. CRC-32 by a table of 256 remainders.
SQL = {
    "op11_spelling": r"""
    with recursive bits as (select b, b as v, 0 as i from range(256) t(b) union all select b, case when v & 1 = 1 then xor(3988292384, v >> 1) else v >> 1 end, i + 1 from bits where i < 8),
    remainders as (select list(v order by b) as tab from bits where i = 8),
    runs as (select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
    counted as (select id, run, count(*) as c from runs group by all),
    hashed as (select run, c, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda x: ('0x' || x)::bigint), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::bigint)) as h
               from counted, remainders),
    cut as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from hashed),
    words as (select word, sum(c)::bigint as n from cut where length(word) >= 7 group by word having sum(c) >= 2),
    gaps as (select word, n, i, substr(word, 1, i) as p, substr(word, i + 2) as s from (select word, n, unnest(range(length(word))) as i from words)),
    less as (select distinct word, n, p || s as rest from gaps),
    near as (select a.word, b.word as other, b.n as other_n from gaps a join gaps b on a.i = b.i and a.p = b.p and a.s = b.s and a.word <> b.word
             union all select l.word, w.word, w.n from less l join words w on l.rest = w.word union all select w.word, l.word, l.n from less l join words w on l.rest = w.word),
    best as (select word, other, other_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by other_n desc, other) as r from near),
    forms as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.other_n >= 10 * w.n then b.other end as form, case when b.other_n >= 10 * w.n then b.other_n end as form_n
              from words w left join best b on w.word = b.word and b.r = 1),
    chain as (select word, word as at from forms union all select c.word, f.form from chain c join forms f on c.at = f.word where f.form is not null)
    select f.word, f.form, c.at as root, f.n, f.n_near::bigint as n_near, f.form_n::bigint as form_n
    from forms f join chain c on c.word = f.word join forms e on e.word = c.at and e.form is null
    """
}
