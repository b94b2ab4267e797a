"""Column functions over texts: tokens, normal forms, identifiers, addresses, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words of Unicode letters, digits, apostrophes and hyphens.
TOKEN = r"(?U)[\w][\w'’-]*"


def tokens(text: Column) -> Column:
    """Case-folded tokens in order."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(TOKEN), F.lit(0))


def plain_words(text: Column, least: int = 4) -> Column:
    """Lower-case runs of ASCII letters and digits of at least so many characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))


def singular(word: Column) -> Column:
    return F.regexp_replace(word, "s$", "")


def normal_statement(text: Column) -> Column:
    """Case-folded text with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def token_estimate(text: Column) -> Column:
    """Half the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 2).cast("long")


#: Prefixes of DOIs and of arXiv addresses, and the two shapes of arXiv identifiers.
ARXIV_PREFIX, ARXIV_ID = r"^https?://(www\.)?arxiv\.org/(abs|pdf)/", r"^(\d{4}\.\d{4,5}|[a-z-]+(\.[A-Z]{2})?/\d{7})$"


def arxiv(value: Column) -> Column:
    """An arXiv identifier without its address, file ending and version; null if it isn't one."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, ARXIV_PREFIX, ""), r"\.pdf$", ""), r"v\d+$", "")
    return F.when(bare.rlike(ARXIV_ID), bare)


def addresses(values: Column, most: int = 8, longest: int = 8192) -> Column:
    """The first distinct http(s) addresses of an array that have a host, no credentials and no white space."""
    good = r"^(?i)https?://(:?@)?(\[[0-9a-f:.]+\]|[^/?#@:\s\[\]]+)(:\d*)?([/?#]\S*)?$"
    return F.slice(F.array_distinct(F.filter(values, lambda u: F.coalesce(u.rlike(good) & (F.length(u) <= longest), F.lit(False)))), 1, most)


def doi(value: Column) -> Column:
    """A DOI without its address or prefix, lower case; null if it isn't one."""
    bare = F.lower(F.regexp_replace(F.trim(value), r"^(?i)(https?://(dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def safe_url(value: Column) -> Column:
    """http(s) addresses with a host and without credentials; null otherwise."""
    return F.when(value.rlike(r"^https?://[^/\s@]+(/\S*)?$"), value)


def occurrences(text: Column, word: Column) -> Column:
    """How often a word stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("long")


def spans(text: Column, width: int, least: int) -> Column:
    """Windows of fixed width, each with its place; a last one that is too short drops."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(width))
    cut = F.transform(starts, lambda a: F.struct(a.alias("begin"), F.substring(text, a + 1, F.lit(width)).alias("span")))
    return F.filter(cut, lambda x: F.length(x["span"]) >= least)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def display_math(text: Column) -> Column:
    """TeX display delimiters as double dollars, but for those inside code fences."""
    dollars = lambda part: F.regexp_replace(part, r"\\[\[\]]", r"\$\$")
    return F.array_join(F.transform(F.split(text, "```"), lambda part, i: F.when(i % 2 == 0, dollars(part)).otherwise(part)), "```")
