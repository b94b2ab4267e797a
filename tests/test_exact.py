"""Exact arithmetic by hand-made cases and against fractions."""

from __future__ import annotations

import math
import random
from fractions import Fraction

from strataloom.functions import exact


def test_values_and_errors():
    cases = {
        "1 3 div 1 6 div add": ("1/2", None), "7 2 div floor": ("3", None), "-7 2 div floor": ("-4", None), "4 9 div sqrt": ("2/3", None), "2 sqrt": (None, "irrational root"), "-1 sqrt": (None, "negative radicand"),
        "1 0 div": (None, "zero denominator"), "5 7 choose": ("0", None), "1001 2 choose": (None, "unsupported binomial domain"), "1 2 div 2 choose": (None, "unsupported binomial domain"), "1 add": (None, "missing operand"),
        "1 2": (None, "not one value"), "": (None, "not one value"), "x": (None, "not a whole number"), None: (None, None),
    }
    assert {k: exact.evaluate(k) for k in cases} == cases


def test_more_than_38_digits(spark):
    rows = spark.createDataFrame([(1, "1000 500 choose 999 499 choose div"), (2, "1000 500 choose"), (3, None)], "id long, expression string")
    got = {r.id: (r.value, r.error) for r in exact.evaluated(rows).collect()}
    assert got == {1: ("2", None), 2: (str(math.comb(1000, 500)), None), 3: (None, None)}


def test_like_fractions():
    r = random.Random(6)
    for _ in range(200):
        words, value = [str(r.randrange(-9, 9))], None
        value = Fraction(words[0])
        for _ in range(r.randrange(30)):
            n, op = r.randrange(1, 9), r.choice(("add", "sub", "mul", "div"))
            words += [str(n), op]
            value = {"add": value + n, "sub": value - n, "mul": value * n, "div": value / n}[op]
        assert exact.evaluate(" ".join(words)) == (str(value), None)
