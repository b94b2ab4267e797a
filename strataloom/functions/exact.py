"""Exact rational arithmetic over columns of postfix expressions, in Arrow batches.

A value has any number of digits up to DIGITS. What has no exact rational value is an error of its row:
a zero denominator, a root of a negative or of what is no square, a binomial outside 0 to 1000.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame

DIGITS = 4096
#: How many values an operation takes.
ARITY = {"add": 2, "sub": 2, "mul": 2, "div": 2, "choose": 2, "sqrt": 1, "floor": 1}


def root(x: Fraction) -> Fraction:
    if x < 0:
        raise ValueError("negative radicand")
    top, below = math.isqrt(x.numerator), math.isqrt(x.denominator)
    if top * top != x.numerator or below * below != x.denominator:
        raise ValueError("irrational root")
    return Fraction(top, below)


def choose(n: Fraction, k: Fraction) -> Fraction:
    if n.denominator != 1 or k.denominator != 1 or not (0 <= n <= 1000 and 0 <= k <= 1000):
        raise ValueError("unsupported binomial domain")
    return Fraction(math.comb(n.numerator, k.numerator))


def quotient(a: Fraction, b: Fraction) -> Fraction:
    if not b:
        raise ValueError("zero denominator")
    return a / b


DO = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": quotient, "choose": choose, "sqrt": root, "floor": lambda a: Fraction(math.floor(a))}


def evaluate(expression: str | None) -> tuple[str | None, str | None]:
    """(value as n or n/d, null) of words in postfix order, or (null, what is wrong). Null in, null out."""
    if expression is None:
        return None, None
    held: list[Fraction] = []
    try:
        for word in expression.split():
            if word in ARITY:
                if len(held) < ARITY[word]:
                    raise ValueError("missing operand")
                operands = held[-ARITY[word] :]
                held[-ARITY[word] :] = [DO[word](*operands)]
            else:
                held.append(Fraction(int(word)))
            if max(held[-1].numerator.bit_length(), held[-1].denominator.bit_length()) > DIGITS * 10 // 3:
                raise ValueError("result exceeds bounds")
        if len(held) != 1:
            raise ValueError("not one value")
    except ValueError as e:
        return None, "not a whole number" if "invalid literal" in str(e) else str(e)
    return str(held[0]), None


def evaluated(rows: DataFrame, expression: str = "expression", key: str = "id") -> DataFrame:
    """key, value (text) and error of each row's expression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evaluate(x) for x in batch.column("expression").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([v for v, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["key", "value", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.selectExpr(f"`{key}` as key", f"`{expression}` as expression").mapInArrow(run, f"key {kind}, value string, error string").withColumnRenamed("key", key)
