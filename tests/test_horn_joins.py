"""The order of joins, and what a closure reads and writes."""

from __future__ import annotations

from strataloom.operators import horn
from strataloom.operators.logic import Atom, Rule
from strataloom.plans.horn import LEAD, SHIPS
from strataloom.sources import shared


def trade(n: int) -> list:
    """n orders of a line, n / 4 customers and n / 10 suppliers of two nations."""
    lines = [("Sold", False, [str(i), "1", str(i % 7), str(i % (n // 10))]) for i in range(n)] + [("Placed", False, [str(i), str(i % (n // 4))]) for i in range(n)]
    return lines + [("Lives", False, [str(i), str(i % 2)]) for i in range(n // 4)] + [("Seat", False, [str(i), str(i % 2)]) for i in range(n // 10)]


def test_a_variable_of_few_values_is_no_way_to_join_two_large_predicates(spark, monkeypatch):
    facts = spark.createDataFrame(trade(400), "pred string, neg boolean, args array<string>")
    monkeypatch.setattr(horn, "FEW", 10)
    made, met = [], horn._met
    monkeypatch.setattr(horn, "_met", lambda a, b: made.append(met(a, b)) or made[-1])
    size = horn.sizes(facts, [LEAD])
    known = {i: size.of(a) for i, a in enumerate(LEAD.body)}
    lives, seat = known[2], known[3]
    assert met(lives, seat)[0] == 100 * 40 / 2  # by nation alone
    rows = horn.supports(facts, [LEAD])
    joins = [x for x in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 3 and all("(N#" not in x or " AND " in x for x in joins)
    assert {tuple(r.args) for r in rows.collect()} == {(str(i % 40), str(i % 7)) for i in range(400) if i % 100 % 2 == i % 40 % 2}


def test_given_facts_are_not_written_and_rules_without_new_facts_not_joined(spark, monkeypatch):
    facts = spark.createDataFrame(trade(40) + trade(40)[:5], "pred string, neg boolean, args array<string>")
    written, asked = [], []
    keep = lambda df, name: written.append(t := shared.written(df, name)) or t
    monkeypatch.setattr(horn, "written", keep)
    match = horn.matched
    monkeypatch.setattr(horn, "matched", lambda atom, df, place: asked.append(atom.pred) or match(atom, df, place))
    home = Rule("home", Atom("Home", ("S",)), (Atom("Ships", ("S", "N", "N")),))
    found, complete = horn.closure(facts, [SHIPS, home])
    assert complete and asked == ["Sold", "Placed", "Lives", "Seat", "Ships"]
    assert [t.filter("pred in ('Sold', 'Placed', 'Lives', 'Seat')").count() for t in written] == [0, 0, 0]
    assert found.filter("round = 0").count() == len(trade(40))
    assert horn.sizes(found, [home]).of(Atom("Ships", ("S", "N", "0")))[0] > 0
