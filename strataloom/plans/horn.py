"""Rules over facts of one to four arguments, made of the order tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cycles
from ..operators import horn as op
from ..operators.logic import Atom, Rule
from ..sources.tables import sql, table
from .graph import DISPOSED, STRONG, recorded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


def trade(s, d) -> DataFrame:
    """Sold(order, line, part, supplier), Placed(order, customer), Lives(customer, nation), Seat(supplier, nation), Near(nation, nation) of one region."""
    line, nation = table(s, d, "lineitem"), table(s, d, "nation")
    near = nation.alias("a").join(nation.alias("b"), F.col("a.n_regionkey") == F.col("b.n_regionkey")).filter("a.n_nationkey <> b.n_nationkey")
    return reduce(DataFrame.unionByName, [
        line.select(*op.fact("Sold", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))),
        table(s, d, "orders").select(*op.fact("Placed", F.col("o_orderkey"), F.col("o_custkey"))),
        table(s, d, "customer").select(*op.fact("Lives", F.col("c_custkey"), F.col("c_nationkey"))),
        table(s, d, "supplier").select(*op.fact("Seat", F.col("s_suppkey"), F.col("s_nationkey"))),
        near.select(*op.fact("Near", F.col("a.n_nationkey"), F.col("b.n_nationkey"))),
    ])


SHIPS = Rule("ships", Atom("Ships", ("S", "M", "N")), (Atom("Sold", ("O", "L", "P", "S")), Atom("Placed", ("O", "C")), Atom("Lives", ("C", "N")), Atom("Seat", ("S", "M"))))
HOME = Rule("home", Atom("Home", ("S", "N")), (Atom("Ships", ("S", "N", "N")),))
#: Who ships to a nation ships to its neighbours in the end; a first line of an order is its lead.
SPREAD = Rule("spread", Atom("Serves", ("S", "B")), (Atom("Serves", ("S", "A")), Atom("Near", ("A", "B"))))
SERVES = Rule("serves", Atom("Serves", ("S", "N")), (Atom("Home", ("S", "N")),))
LEAD = Rule("lead", Atom("Lead", ("S", "P")), (Atom("Sold", ("O", "1", "P", "S")), Atom("Placed", ("O", "C")), Atom("Lives", ("C", "N")), Atom("Seat", ("S", "N"))))
SHIPPED = "ships as (select distinct l_suppkey as s, s_nationkey as m, c_nationkey as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)"
JOINED = "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey"


query(
    "j01_wide_rule_join",
    lambda s, d: op.derive(SHIPS, trade(s, d)).select(F.array_join("args", ",").alias("args")),
    f"with {SHIPPED} select s || ',' || m || ',' || n as args from ships",
)


def wide_closure(s, d):
    found, _ = op.closure(trade(s, d), [SHIPS, HOME, SERVES, SPREAD, LEAD])
    return found.filter(F.col("pred").isin("Home", "Serves", "Lead")).select("pred", F.array_join("args", ",").alias("args"))


query(
    "l01_wide_closure",
    wide_closure,
    f"""with recursive {SHIPPED}, home as (select s, n from ships where m = n),
      serves as (select s, n from home union select s, b.n_nationkey from serves join nation a on a.n_nationkey = n join nation b on b.n_regionkey = a.n_regionkey and b.n_nationkey <> a.n_nationkey)
    select 'Home' as pred, s || ',' || n as args from home union all select 'Serves', s || ',' || n from serves
    union all select distinct 'Lead', l_suppkey || ',' || l_partkey from {JOINED} where l_linenumber = 1 and s_nationkey = c_nationkey""",
)
query(
    "l03_wide_supports",
    lambda s, d: op.supports(trade(s, d), [LEAD]).select("rule", F.array_join("args", ",").alias("args"), F.array_join("premises", " ").alias("premises")),
    f"""select distinct 'lead' as rule, l_suppkey || ',' || l_partkey as args, 'Sold(' || l_orderkey || ',1,' || l_partkey || ',' || l_suppkey || ') Placed(' || l_orderkey || ',' || o_custkey || ') Lives(' || o_custkey || ',' || c_nationkey || ') Seat(' || l_suppkey || ',' || s_nationkey || ')' as premises
    from {JOINED} where l_linenumber = 1 and s_nationkey = c_nationkey""",
)
#: The rule DependencyCycle(x) :- Reachable(x, x) without the pairs of Reachable: what lies on a cycle of recorded dependencies.
query(
    "l02_dependency_cycle",
    lambda s, d: cycles.strong_components(recorded(s, d)).select(F.lit("DependencyCycle").alias("pred"), F.col("node").cast("string").alias("a")),
    sql(f"with {DISPOSED}, rec as (select src, dst from disposed where disposition = 'recorded'), {STRONG.format(e='rec')} select 'DependencyCycle' as pred, node::varchar as a from strong", "nodes", "edges", recursive=True),
)
