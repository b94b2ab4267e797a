"""Exact decisions: probabilities are integer counts, sums stay integers, division comes last.

A model's rows: action, outcome, num and den (probability num / den), utility (whole number), cost.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def expected_utility(outcomes: DataFrame) -> DataFrame:
    """EU of each action as the integer fraction eu_num / den; null if any probability or utility is unknown.

    Outcomes of an action share a denominator, as counts of one total do.
    """
    known = F.bool_and(F.col("num").isNotNull() & F.col("utility").isNotNull())
    total = F.sum(F.col("num") * F.col("utility"))
    return outcomes.groupBy("action").agg(known.alias("known"), total.alias("total"), F.max("den").alias("den"), F.max("cost").alias("cost")).select("action", F.when(F.col("known"), F.col("total") - F.col("cost") * F.col("den")).alias("eu_num"), "den")


def winners(utilities: DataFrame) -> DataFrame:
    """Actions of the greatest EU, ties included. Fractions compare by cross products in decimals."""
    known = utilities.filter("eu_num is not null").withColumn("value", F.col("eu_num").cast("decimal(38,12)") / F.col("den").cast("decimal(20,0)"))
    best = known.agg(F.max("value").alias("value"))
    return known.join(F.broadcast(best), "value").select("action", "eu_num", "den")


def information_value(baseline: DataFrame, observed: DataFrame) -> DataFrame:
    """What an observation is worth to each action: sum of p * best EU after it, less the best EU before it and the cost.

    baseline: action, decision, eu_num, den, cost; observed: action, observation, decision, eu_num, where eu_num
    is the probability of the observation times the EU of the decision after it, over the same den. The value is the
    integer fraction value_num / den; null if any EU is unknown, as then no best one is known.
    """
    best = lambda df, *by: df.groupBy(*by).agg(F.when(F.bool_and(F.col("eu_num").isNotNull()), F.max("eu_num")).alias("best"))
    after = best(observed, "action", "observation").groupBy("action").agg(F.when(F.bool_and(F.col("best").isNotNull()), F.sum("best")).alias("after"))
    before = best(baseline, "action", "den", "cost")
    return before.join(after, "action").select("action", (F.col("after") - F.col("best") - F.col("cost") * F.col("den")).alias("value_num"), "den")


def brier(outcomes: DataFrame, observed: Column) -> DataFrame:
    """Sum over outcomes of (p - 1[observed])^2, as the integer score_num over den squared."""
    diff = F.col("num") - F.when(observed, F.col("den")).otherwise(0)
    return outcomes.groupBy("action").agg(F.sum(diff * diff).alias("score_num"), F.max("den").alias("den"))


@dataclass(frozen=True)
class Expr:
    """An integer polynomial: op is add, sub, mul, neg, const or var."""

    op: str
    value: int = 0
    name: str = ""
    args: tuple[Expr, ...] = ()


def var(name: str) -> Expr:
    return Expr("var", name=name)


def const(value: int) -> Expr:
    return Expr("const", value=value)


def add(*args: Expr) -> Expr:
    return Expr("add", args=args)


def mul(*args: Expr) -> Expr:
    return Expr("mul", args=args)


def compiled(e: Expr) -> Column:
    """The expression as a column of exact decimals: 38 digits, an error beyond."""
    if e.op == "const":
        return F.lit(e.value).cast("decimal(38,0)")
    if e.op == "var":
        return F.col(e.name).cast("decimal(38,0)")
    args = [compiled(a) for a in e.args]
    if e.op == "neg":
        return -args[0]
    return reduce({"add": lambda a, b: (a + b).cast("decimal(38,0)"), "sub": lambda a, b: (a - b).cast("decimal(38,0)"), "mul": lambda a, b: (a * b).cast("decimal(38,0)")}[e.op], args)


RELATIONS = {"eq": lambda a, b: a == b, "le": lambda a, b: a <= b, "lt": lambda a, b: a < b}


def box(spark: SparkSession, names: Sequence[str], lower: int, upper: int) -> DataFrame:
    """All assignments of a box, with their place in lexicographic order. One range, digits by division."""
    side = upper - lower + 1
    df = spark.range(side ** len(names)).withColumnRenamed("id", "place")
    return df.select("place", *[(F.expr(f"place div {side ** (len(names) - 1 - i)}") % side + lower).alias(n) for i, n in enumerate(names)])


def violations(assignments: DataFrame, left: Expr, relation: str, right: Expr) -> DataFrame:
    return assignments.filter(~RELATIONS[relation](compiled(left), compiled(right)))


def first_witness(found: DataFrame, names: Sequence[str], size: int, budget: int) -> DataFrame:
    """The first violation within the budget, the evaluations until then and how the search ended: one row."""
    least = found.filter(F.col("place") < budget).agg(F.min(F.struct("place", *names)).alias("w"))
    end = F.when(F.col("w").isNotNull(), "witness").when(F.lit(size <= budget), "exhausted").otherwise("truncated")
    return least.select(*[F.col(f"w.{n}").alias(n) for n in names], F.coalesce(F.col("w.place") + 1, F.lit(min(size, budget)).cast("long")).alias("evaluations"), end.alias("end"))
