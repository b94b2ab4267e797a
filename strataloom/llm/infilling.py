"""Operator 13: fill-in-the-middle texts, cut at units that bit-parallel masks mark.

A text's UTF-8 bytes are mapped to class masks, one bit a byte, by bytes.translate: a big integer holds
the whole text. Shifted boolean operations turn class masks into the mask of bytes where a unit starts
(a code point, a word or a line), bit_count says how many units there are, and the byte at which the
k-th one starts is found by halving the mask: count the low half's bits, go on in the half that holds
the k-th. All steps are linear in the text, and a mask takes an eighth of it.

Draws come from the sha256 of "1:" and the id, so they depend on nothing but the record. A text is cut
in prefix, middle and suffix; its form is plain (left as it is), psm or spm, with sentinels before the
parts. A text that holds a sentinel stays plain, so that `restored` finds each part of the others.

Defined results: a null text counts as empty and stays plain; a null id draws as an empty string;
repeated rows give equal results; plain texts have null prefix_units and middle_units. Columns named
like the results are replaced by them, all others pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, documents, text_of

SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 draws: those from PLAIN on leave the text as it is; below SPM the suffix goes first.
PLAIN, SPM = 90, 20
OUT = "n long, form string, prefix_units long, middle_units long, output string"


def _class(members: bytes) -> bytes:
    """A table for bytes.translate that makes the digit 1 of members and the digit 0 of other bytes."""
    return bytes(0x31 if b in members else 0x30 for b in range(256))


ALL = _class(bytes(range(256)))
#: unit: (bytes that may start one, bytes after which they don't).
UNITS = {
    "char": (_class(bytes(b for b in range(256) if b & 0xC0 != 0x80)), _class(b"")),
    "word": (_class(bytes(b for b in range(256) if b not in b" \t\n\v\f\r")),) * 2,
    "line": (ALL, _class(bytes(b for b in range(256) if b != 10))),
}


def mask(raw: bytes, table: bytes) -> int:
    """Bit i tells whether byte i is in the table's class."""
    return int(raw.translate(table)[::-1], 2) if raw else 0


def starts(raw: bytes, unit: str = "char") -> int:
    """Bit i tells whether a unit starts at byte i; the first one starts at byte 0."""
    own, same = UNITS[unit]
    return mask(raw, own) & ~(mask(raw, same) << 1) | 1 if raw else 0


def select(bits: int, k: int) -> int:
    """The place of the bit that k set bits precede."""
    place, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            bits, width = low, half
        else:
            bits, k, place, width = bits >> half, k - below, place + half, width - half
    return place


def cut(raw: bytes, first: int, second: int, unit: str = "char") -> tuple[int, int, int, int, int]:
    """(units, units of the prefix, of the middle, bytes up to the prefix's end, up to the middle's end) by two draws."""
    bits = starts(raw, unit)
    n = bits.bit_count()
    a, b = sorted((first % (n + 1), second % (n + 1)))
    at = [select(bits, k) if k < n else len(raw) for k in (a, b)]
    return n, a, b - a, at[0], at[1]


def draws(id_col: Column, count: int = 4) -> Column:
    """The first 8-digit groups of sha256("1:" and the id) as numbers."""
    digest = F.sha2(F.encode(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))), "UTF-8"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def transform(docs: DataFrame, unit: str = "char", plain: int = PLAIN, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns n (units of the text), form, prefix_units, middle_units and output (the text to train on)."""
    p, s, m = (x.encode() for x in sentinels)

    def shaped(raw: bytes, h: list[int]) -> tuple:
        n, a, b, x, y = cut(raw, h[0], h[1], unit)
        if not raw or h[2] % 100 >= plain or p in raw or s in raw or m in raw:
            return n, "plain", None, None, raw
        head, middle, tail = raw[:x], raw[x:y], raw[y:]
        if h[3] % 100 < spm:
            return n, "spm", a, b, b"".join((s, tail, p, head, m, middle))
        return n, "psm", a, b, b"".join((p, head, s, tail, m, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [shaped(raw.as_py(), h.as_py()) for raw, h in zip(part.column("text").cast(pa.large_binary()), part.column("draws"), strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                made = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), *made[:4], made[4].cast(pa.string())], names=["doc", "n", "form", "prefix_units", "middle_units", "output"])

    names = StructType.fromDDL(OUT).names
    kept = [column(c) for c in docs.columns if c not in names]
    carried = docs.select(F.struct(*kept).alias("doc"), text_of(text_col).alias("text"), draws(column(id_col)).alias("draws"))
    schema = StructType([carried.schema["doc"], *StructType.fromDDL(OUT).fields])
    return carried.mapInArrow(run, schema).select("doc.*", *names)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that was transformed, from output and form alone: its parts in their order."""
    p, s, m = sentinels

    def between(first: str, last: str | None) -> Column:
        begin = F.locate(first, output) + len(first)
        return F.substring(output, begin, (F.locate(last, output) if last else F.char_length(output) + 1) - begin)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    return F.when(form == "psm", psm).when(form == "spm", F.concat(between(p, m), between(m, None), between(s, p))).otherwise(output)


def op13_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode(restored(F.col("output"), F.col("form")), "UTF-8"), 256).alias("restored_sha256"),
    )


QUERIES = {"op13_infilling": op13_infilling}
SQL = {
    "op13_infilling": """
    with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
    g as (select doc_id, t, length(t) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
    c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                 case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from g)
    select doc_id, n::bigint as n, form, case when form <> 'plain' then a end::bigint as prefix_chars, case when form <> 'plain' then b - a end::bigint as middle_chars,
           sha256(case form when 'plain' then t when 'psm' then '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                  else '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) end) as output_sha256, sha256(t) as restored_sha256
    from c
    """
}
