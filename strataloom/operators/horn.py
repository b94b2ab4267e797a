"""Horn rules over facts with any number of arguments: closure, supports, and a bound on products.

Facts: pred, neg, args (array of strings). An atom compiles to comparisons of array elements, a body to
equality joins: of all pairs that share a variable the one comes next that should make fewest rows, by the
number of facts and of distinct arguments. Parts of a body that share no variable are never crossed as they are:
of each part only the variables that the head names are kept, once each, and a part that the head names
nothing of is a mere condition. If several parts are left their product is the result itself; it is made
only up to `product` rows, and an error beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .graph import gathered, turns
from .logic import Atom, Rule

FACT = ["pred", "neg", "args"]
PRODUCT = 1_000_000
#: Facts of an atom that are few enough to be handed to every task.
FEW = 100_000


def fact(pred: str, *args: Column, neg: bool = False) -> list[Column]:
    """Columns of a fact table."""
    return [F.lit(pred).alias("pred"), F.lit(neg).alias("neg"), F.array(*[a.cast("string") for a in args]).alias("args")]


def named(pred: str = "pred", neg: str = "neg", args: str = "args") -> Column:
    return F.concat(F.when(F.col(neg), "!").otherwise(""), F.col(pred), F.lit("("), F.array_join(args, ","), F.lit(")"))


def variables(*atoms: Atom) -> list[str]:
    return list(dict.fromkeys(a for atom in atoms for a in atom.args if a[0].isupper()))


def checked(rules: Sequence[Rule]) -> None:
    for rule in rules:
        if missing := set(variables(rule.head)) - set(variables(*rule.body)):
            raise ValueError(f"{rule.name}: the head names {sorted(missing)}, which no premise binds")


def matched(atom: Atom, facts: DataFrame, place: int) -> DataFrame:
    """The facts of an atom: a column for each of its variables, and the fact's name."""
    df = facts.filter((F.col("pred") == atom.pred) & (F.col("neg") == F.lit(atom.neg)) & (F.size("args") == len(atom.args)))
    first: dict[str, int] = {}
    for i, arg in enumerate(atom.args):
        if not arg[0].isupper():
            df = df.filter(F.get("args", F.lit(i)) == arg)
        elif arg in first:
            df = df.filter(F.get("args", F.lit(i)) == F.get("args", F.lit(first[arg])))
        else:
            first[arg] = i
    return df.select(*[F.get("args", F.lit(i)).alias(v) for v, i in first.items()], F.lit(True).alias(f"_f{place}"))


def premise(atom: Atom) -> Column:
    """The name of the fact that an atom was matched with, from the columns of its variables."""
    args = [F.col(a) if a[0].isupper() else F.lit(a) for a in atom.args]
    return F.concat(F.lit(f"{'!' if atom.neg else ''}{atom.pred}("), F.array_join(F.array(*args).cast("array<string>"), ","), F.lit(")"))


def counts(facts: DataFrame) -> dict[tuple[str, bool, int], int]:
    """How many facts each predicate has: a row for each predicate."""
    rows = facts.groupBy("pred", "neg", F.size("args").alias("n")).count().collect()
    return {(r["pred"], r["neg"], r["n"]): r["count"] for r in rows}


@dataclass(frozen=True)
class Sizes:
    """How many facts each predicate has, and about how many distinct values each of its arguments."""

    facts: dict[tuple[str, bool, int], int]
    values: dict[tuple[str, bool, int], list[int]]

    def of(self, atom: Atom) -> tuple[float, dict[str, float]]:
        """An atom's facts and its variables' values; a constant leaves one of its argument's values."""
        place = (atom.pred, atom.neg, len(atom.args))
        rows, known = float(self.facts.get(place, 0)), self.values.get(place) or [self.facts.get(place, 0)] * len(atom.args)
        for arg, n in zip(atom.args, known, strict=True):
            rows /= 1 if arg[0].isupper() else max(n, 1)
        return rows, {a: max(min(n, rows), 1.0) for a, n in zip(atom.args, known, strict=True) if a[0].isupper()}

    def plus(self, new: Sizes) -> Sizes:
        facts = {k: self.facts.get(k, 0) + new.facts.get(k, 0) for k in self.facts | new.facts}
        both = lambda a, b: [x + y for x, y in zip(a, b, strict=True)] if a and b else a or b
        return Sizes(facts, {k: both(self.values.get(k), new.values.get(k)) for k in facts})


def sizes(facts: DataFrame, rules: Sequence[Rule]) -> Sizes:
    """Sizes of the facts' predicates: a row for each predicate."""
    longest = max([len(atom.args) for rule in rules for atom in (rule.head, *rule.body)], default=0)
    values = [F.approx_count_distinct(F.get("args", F.lit(i))).alias(f"v{i}") for i in range(longest)]
    rows = facts.groupBy("pred", "neg", F.size("args").alias("n")).agg(F.count(F.lit(1)).alias("count"), *values).collect()
    place = lambda r: (r["pred"], r["neg"], r["n"])
    return Sizes({place(r): r["count"] for r in rows}, {place(r): [r[f"v{i}"] for i in range(r["n"])] for r in rows if r["n"] <= longest})


def ordered(body: Sequence[Atom], size: dict) -> list[list[int]]:
    """The body's atoms as parts that share no variable, each in the order of its joins."""
    weight = lambda i: (size.get((body[i].pred, body[i].neg, len(body[i].args)), 0), i)
    left, parts = set(range(len(body))), []
    while left:
        part = [min(left, key=weight)]
        left -= set(part)
        while near := [i for i in left if set(variables(body[i])) & set(variables(*[body[j] for j in part]))]:
            part.append(min(near, key=weight))
            left.remove(part[-1])
        parts.append(part)
    return parts


def _met(a: tuple[float, dict], b: tuple[float, dict]) -> tuple[float, dict]:
    """Rows and values that a join of two sides should have."""
    rows = a[0] * b[0]
    for v in a[1].keys() & b[1].keys():
        rows /= max(a[1][v], b[1][v])
    return rows, {v: max(min(a[1].get(v, b[1].get(v)), b[1].get(v, a[1].get(v)), rows), 1.0) for v in a[1] | b[1]}


def _joined(part: list[int], tables: dict[int, DataFrame], known: dict[int, tuple[float, dict]], few: set[int]) -> DataFrame:
    """The atoms of a part: again and again those two sides that should make fewest rows together, of equal ones the smaller sides.

    Sides that aren't few are sorted, as what fits a broadcast by the size of its files may not fit the driver.
    """
    sides = [(known[i], F.broadcast(tables[i]) if i in few else tables[i].hint("merge")) for i in part]
    while len(sides) > 1:
        near = [(a, b) for a, b in combinations(sides, 2) if a[0][1].keys() & b[0][1].keys()]
        a, b = min(near, key=lambda x: (_met(x[0][0], x[1][0])[0], x[0][0][0] + x[1][0][0]))
        a, b = sorted((a, b), key=lambda x: -x[0][0])
        sides = [s for s in sides if s is not a and s is not b] + [(_met(a[0], b[0]), a[1].join(b[1], sorted(a[0][1].keys() & b[0][1].keys())).hint("merge"))]
    return sides[0][1]


def _product(parts: list[DataFrame], product: int) -> DataFrame:
    """All combinations of parts that have been written, up to product rows."""
    total = 1
    for p in parts:
        total *= p.count()
    if total > product:
        raise ValueError(f"parts of a rule that share no variable would make {total} rows; at most {product} are made")
    return reduce(lambda a, b: a.crossJoin(b), parts)


def derive(rule: Rule, facts: DataFrame, new: DataFrame | None = None, size: Sizes | None = None, fresh: Sizes | None = None, product: int = PRODUCT, keep: bool = False) -> DataFrame:
    """Conclusions of a rule: pred, neg, args; with keep also rule and premises (names, in the body's order), a row for each support.

    With new, only those with a premise in new. size and fresh: sizes of facts and new. Where an atom has no facts nothing is read.
    """
    size = sizes(facts, [rule]) if size is None else size
    fresh = sizes(new, [rule]) if fresh is None and new is not None else fresh
    head = variables(rule.head)
    bodies = []
    for turn in range(len(rule.body) if new is not None else 1):
        sized = {i: fresh if new is not None and i == turn else size for i in range(len(rule.body))}
        known = {i: sized[i].of(atom) for i, atom in enumerate(rule.body)}
        few = {i for i, atom in enumerate(rule.body) if sized[i].facts.get((atom.pred, atom.neg, len(atom.args)), 0) <= FEW}
        if not all(rows for rows, _ in known.values()):
            continue
        tables = {i: matched(atom, new if new is not None and i == turn else facts, i) for i, atom in enumerate(rule.body)}
        parts = []
        for part in ordered(rule.body, size.facts):
            rows = _joined(part, tables, known, few)
            if not keep:
                asked = [v for v in variables(*[rule.body[i] for i in part]) if v in head]
                rows = rows.select(*asked).distinct() if asked else rows.select(F.lit(True).alias(f"_c{part[0]}")).limit(1)
            parts.append(rows)
        bodies.append(parts[0] if len(parts) == 1 else _product([written(p, "part") for p in parts], product))
    value = lambda arg: F.col(arg) if arg[0].isupper() else F.lit(arg)
    more = [F.lit(rule.name).alias("rule"), F.array(*map(premise, rule.body)).alias("premises")] if keep else []
    if not bodies:
        kind = "pred string, neg boolean, args array<string>" + (", rule string, premises array<string>" if keep else "")
        return facts.sparkSession.createDataFrame([], kind)
    out = [b.select(F.lit(rule.head.pred).alias("pred"), F.lit(rule.head.neg).alias("neg"), F.array(*map(value, rule.head.args)).cast("array<string>").alias("args"), *more) for b in bodies]
    return reduce(DataFrame.unionByName, out).distinct()


def closure(facts: DataFrame, rules: Sequence[Rule], most: int | None = None, product: int = PRODUCT) -> tuple[DataFrame, bool]:
    """All facts that follow, with their round (0: given), and whether the fixed point was met; only most can end it before.

    Given facts are read where a rule asks for them, not written again; only what follows is.
    """
    checked(rules)
    given, made, new = facts.select(*FACT), None, None
    size, fresh = sizes(given, rules), None
    heads = F.concat("pred", F.lit("/"), "neg").isin(sorted({f"{r.head.pred}/{str(r.head.neg).lower()}" for r in rules}))
    whole = lambda: given.distinct().withColumn("round", F.lit(0)) if made is None else given.distinct().withColumn("round", F.lit(0)).unionByName(made)
    for turn in turns(most):
        seen = given if made is None else given.unionByName(made.select(*FACT))
        found = reduce(DataFrame.unionByName, [derive(r, seen, new, size, fresh, product) for r in rules]).distinct()
        new = written(found.join(seen.filter(heads).hint("merge"), FACT, "left_anti").withColumn("round", F.lit(turn)), "facts")
        fresh = sizes(new, rules)
        if not fresh.facts:
            return whole(), True
        size, made = size.plus(fresh), new if made is None else gathered(made, new, turn)
    return whole(), False


def supports(facts: DataFrame, rules: Sequence[Rule], product: int = PRODUCT) -> DataFrame:
    """Every distinct (conclusion, rule, premises) among a closure's facts."""
    size = sizes(facts, rules)
    return reduce(DataFrame.unionByName, [derive(r, facts, None, size, None, product, keep=True) for r in rules])
