"""Rules over facts of any arity against all assignments tried one by one."""

from __future__ import annotations

import itertools

import pytest

from strataloom.operators import horn
from strataloom.operators.logic import Atom, Rule

FACTS = "pred string, neg boolean, args array<string>"


def brute(facts, rules):
    """The closure: every choice of facts for a body's atoms, until nothing is new."""
    seen = set(facts)
    while True:
        new = set()
        for rule in rules:
            for chosen in itertools.product(*[[f for f in seen if f[0] == a.pred and f[1] == a.neg and len(f[2]) == len(a.args)] for a in rule.body]):
                bound: dict[str, str] = {}
                if all(v == bound.setdefault(k, v) if k[0].isupper() else k == v for a, f in zip(rule.body, chosen, strict=True) for k, v in zip(a.args, f[2], strict=True)):
                    new.add((rule.head.pred, rule.head.neg, tuple(bound.get(k, k) for k in rule.head.args)))
        if new <= seen:
            return seen
        seen |= new


def table(spark, facts):
    return spark.createDataFrame([(p, n, list(a)) for p, n, a in facts], FACTS)


def got(frame):
    return {(r.pred, r.neg, tuple(r.args)) for r in frame.collect()}


def test_like_all_assignments(spark):
    facts = [("E", False, (a, b, str(i % 2))) for i, (a, b) in enumerate(["xy", "yz", "zx", "xx", "zw", "wv"])] + [("M", False, ("y",)), ("M", False, ("w",)), ("N", True, ("w", "w", "k", "v")), ("Z", False, ())]
    rules = [
        Rule("step", Atom("R", ("X", "Y")), (Atom("E", ("X", "Y", "C")),)),
        Rule("more", Atom("R", ("X", "Z")), (Atom("R", ("X", "Y")), Atom("E", ("Y", "Z", "1")))),
        Rule("loop", Atom("L", ("X", "X", "here")), (Atom("R", ("X", "X")),)),
        Rule("not", Atom("R", ("X", "V"), True), (Atom("N", ("X", "X", "k", "V"), True), Atom("M", ("X",)))),
        Rule("flag", Atom("F", ()), (Atom("Z", ()), Atom("M", ("X",)))),
        Rule("apart", Atom("P", ("X", "Y")), (Atom("M", ("X",)), Atom("L", ("Y", "Z", "here")), Atom("N", ("A", "B", "C", "D"), True))),
    ]
    found, complete = horn.closure(table(spark, facts), rules)
    assert complete and got(found) == brute(facts, rules)


def test_a_dense_join_makes_only_its_matches(spark):
    facts = [("Depends", False, (f"a{i}", f"b{j}")) for i in range(48) for j in range(12)] + [("Open", False, (f"b{j}",)) for j in range(12)]
    rule = Rule("open", Atom("HasOpen", ("X",)), (Atom("Depends", ("X", "Y")), Atom("Open", ("Y",))))
    assert horn.supports(table(spark, facts), [rule]).count() == 576
    assert got(horn.derive(rule, table(spark, facts))) == {("HasOpen", False, (f"a{i}",)) for i in range(48)}
    assert horn.ordered(rule.body, horn.counts(table(spark, facts))) == [[1, 0]]


def test_products_are_bounded(spark):
    facts = table(spark, [("Mark", False, (str(i),)) for i in range(20)])
    rule = Rule("all", Atom("Pair", ("X", "Y")), (Atom("Mark", ("X",)), Atom("Mark", ("Y",))))
    assert horn.derive(rule, facts).count() == 400
    with pytest.raises(ValueError, match="400 rows"):
        horn.derive(rule, facts, product=399)
    # A part that the head names nothing of is a condition, whatever its size.
    assert horn.derive(Rule("any", Atom("Some", ("X",)), rule.body), facts, product=20).count() == 20


def test_unsafe_rules_and_no_facts(spark):
    with pytest.raises(ValueError, match="no premise binds"):
        horn.closure(table(spark, []), [Rule("bad", Atom("P", ("X",)), (Atom("Q", ("Y",)),))])
    found, complete = horn.closure(table(spark, []), [Rule("r", Atom("P", ("X",)), (Atom("Q", ("X",)),))])
    assert complete and found.count() == 0


def test_a_limit_of_rounds_says_so(spark):
    chain = [("E", False, (str(i), str(i + 1))) for i in range(9)] + [("S", False, ("0",))]
    rules = [Rule("go", Atom("S", ("Y",)), (Atom("S", ("X",)), Atom("E", ("X", "Y"))))]
    found, complete = horn.closure(table(spark, chain), rules, most=3)
    assert not complete and len([f for f in got(found) if f[0] == "S"]) == 4
