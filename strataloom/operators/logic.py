"""Horn rules over fact tables: closure with supports, contradictions and taint.

Facts: pred, neg, a, b (unary facts have a null b). A rule compiles to a chain of equi-joins on its
shared variables; Catalyst picks their order and kind. The closure is semi-naive: each round joins
only bodies with at least one fact of the last round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .graph import counted, gathered, sided, turns


@dataclass(frozen=True)
class Atom:
    """A predicate over variables (capital first) or constants."""

    pred: str
    args: tuple[str, ...]
    neg: bool = False


@dataclass(frozen=True)
class Rule:
    name: str
    head: Atom
    body: tuple[Atom, ...]


def key(pred: str = "pred", neg: str = "neg", a: str = "a", b: str = "b"):
    """A fact's identity as text."""
    return F.concat(F.when(F.col(neg), "!").otherwise(""), F.col(pred), F.lit("("), F.col(a), F.coalesce(F.concat(F.lit(","), F.col(b)), F.lit("")), F.lit(")"))


def matched(atom: Atom, facts: DataFrame, place: int) -> DataFrame:
    """The facts of an atom as columns named by its variables, and the fact's identity."""
    df = facts.filter((F.col("pred") == atom.pred) & (F.col("neg") == F.lit(atom.neg)))
    columns: dict[str, str] = {}
    for arg, column in zip(atom.args, ("a", "b"), strict=False):
        if not arg[0].isupper():
            df = df.filter(F.col(column) == arg)
        elif arg in columns:
            df = df.filter(F.col(column) == F.col(columns[arg]))  # P(X, X)
        else:
            columns[arg] = column
    return df.select(*[F.col(c).alias(v) for v, c in columns.items()], key().alias(f"_p{place}"))


def derive(rule: Rule, facts: DataFrame, new: DataFrame | None = None, count: int | None = None) -> DataFrame:
    """All supports of a rule: conclusion and premises. With new (of count facts), only those with a premise in new."""
    bodies = []
    for turn in range(len(rule.body) if new is not None else 1):
        parts = [matched(atom, new if new is not None and i == turn else facts, i) for i, atom in enumerate(rule.body)]
        parts = [sided(p, count if new is not None and i == turn else None) for i, p in enumerate(parts)]
        joined = parts[0]
        for p in parts[1:]:
            shared = [c for c in p.columns if c in joined.columns]
            joined = joined.join(p, shared) if shared else joined.crossJoin(p)
        bodies.append(joined.select(*[F.col(v) for v in sorted({a for atom in rule.body for a in atom.args if a[0].isupper()})], F.array(*[f"_p{i}" for i in range(len(rule.body))]).alias("premises")))
    both = reduce(DataFrame.unionByName, bodies)
    value = lambda arg: F.col(arg) if arg[0].isupper() else F.lit(arg)
    args = [*map(value, rule.head.args), *[F.lit(None).cast("string")] * (2 - len(rule.head.args))]
    return both.select(F.lit(rule.head.pred).alias("pred"), F.lit(rule.head.neg).alias("neg"), args[0].alias("a"), args[1].alias("b"), F.lit(rule.name).alias("rule"), "premises").distinct()


FACT = ["pred", "neg", "a", "b"]


def closure(facts: DataFrame, rules: Sequence[Rule], most: int | None = None) -> tuple[DataFrame, bool]:
    """All facts that follow, with their round (0: given), and whether the fixed point was met.

    Only a given number of rounds at most can end it before the fixed point.
    """
    new, count = counted(facts.select(*FACT).distinct().withColumn("round", F.lit(0)), "facts")
    seen, heads = new, F.col("pred").isin(sorted({r.head.pred for r in rules}))
    for turn in turns(most):
        found = reduce(DataFrame.unionByName, [derive(r, seen, new if turn > 1 else None, count).select(*FACT) for r in rules]).distinct()
        fresh = found.alias("f").join(sided(seen.filter(heads)).alias("s"), (F.col("f.pred") == F.col("s.pred")) & (F.col("f.neg") == F.col("s.neg")) & (F.col("f.a") == F.col("s.a")) & F.col("f.b").eqNullSafe(F.col("s.b")), "left_anti")
        new, count = counted(fresh.withColumn("round", F.lit(turn)), "facts")
        if not count:
            return seen, True
        seen = gathered(seen, new, turn)
    return seen, False


def supports(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every distinct (conclusion, rule, premises) among a closure's facts."""
    return reduce(DataFrame.unionByName, [derive(r, facts) for r in rules])


def contradictions(facts: DataFrame) -> DataFrame:
    """Facts whose negation is there too."""
    other = facts.select(F.col("pred").alias("p"), (~F.col("neg")).alias("n"), F.col("a").alias("x"), F.col("b").alias("y"))
    return facts.join(other, (F.col("pred") == F.col("p")) & (F.col("neg") == F.col("n")) & (F.col("a") == F.col("x")) & F.col("b").eqNullSafe(F.col("y")), "left_semi")


def clean(seeds: DataFrame, blocked: DataFrame, supported: DataFrame) -> DataFrame:
    """Fact identities that rest on clean premises: seeds that aren't blocked, and conclusions of which
    some support has only clean premises. Columns: fact."""
    bad = blocked.select(key().alias("fact"))
    known = written(seeds.select(key().alias("fact")).distinct().join(sided(bad), "fact", "left_anti"), "clean")
    each = supported.withColumn("fact", key()).join(sided(bad), "fact", "left_anti").withColumn("id", F.xxhash64("fact", "rule", "premises")).select("fact", "id", F.explode("premises").alias("premise"), F.size("premises").alias("n"))
    each = written(each, "supports")
    for turn in turns(None):
        met = each.join(sided(known.withColumnRenamed("fact", "premise")), "premise", "left_semi").groupBy("fact", "id").agg(F.count(F.lit(1)).alias("held"), F.first("n").alias("n")).filter("held = n").select("fact").distinct()
        new, count = counted(met.join(sided(known), "fact", "left_anti"), "clean")
        if not count:
            return known
        known = gathered(known, new, turn)
    raise AssertionError
