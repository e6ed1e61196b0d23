"""Query language: parser, builder, virtual tables, validation."""

import datetime as dt
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom import queries_engine
from ledgerloom.functions import scalar
from ledgerloom.operators import hierarchy
from ledgerloom.operators import virtual_tables as vt
from ledgerloom.plans import ast
from ledgerloom.plans.builder import Engine, PlanProblem, explain, like_regex
from ledgerloom.plans.catalog import Catalog, TableDef, sample_catalog
from ledgerloom.plans.lexer import SyntaxProblem
from ledgerloom.plans.parser import parse
from ledgerloom.plans.validator import choose_template, fill_template, validate

T = dt.datetime


@pytest.fixture(scope="module")
def engine(spark, data):
    return Engine(spark, sample_catalog(spark, data))


def test_bilingual_and_comments():
    ru = parse("ВЫБРАТЬ РАЗЛИЧНЫЕ Т.А КАК А ИЗ Справочник.Х КАК Т ГДЕ Т.А МЕЖДУ 1 И 2 // конец\n УПОРЯДОЧИТЬ ПО А УБЫВ")
    en = parse("select distinct Т.А as А from Справочник.Х as Т /* x */ where Т.А between 1 and 2 {ГДЕ} order by А desc;")
    assert ru == en


def test_precedence():
    e = parse("SELECT 1 AS x FROM Catalog.X AS X WHERE X.a = 1 OR NOT X.b = 2 AND X.c + 2 * 3 > 4")[0].branches[0][1].where
    assert e.op == "OR" and e.right.op == "AND" and e.right.left.op == "NOT" and e.right.right.left.right.op == "*"


def test_multi_line_strings_and_escapes():
    e = parse('SELECT "a ""b""\n\t|c" AS s')[0].branches[0][1].fields[0].expr
    assert e.value == 'a "b"\nc'


@pytest.mark.parametrize("bad", ["SELECT", "SELECT a FROM", "SELECT a AS FROM b", "ВЫБРАТЬ (1", "SELECT 1 x y z FROM t", "SELECT ^"])
def test_syntax_errors(bad):
    with pytest.raises(SyntaxProblem):
        parse(bad)


names = st.sampled_from(["а", "Б", "x1", "Сумма_2"])
exprs = st.recursive(
    st.one_of(st.integers(0, 99).map(ast.Lit), names.map(lambda n: ast.Name(["Т", n])), names.map(ast.Param)),
    lambda c: st.one_of(st.tuples(st.sampled_from(["+", "-", "*", "/"]), c, c).map(lambda t: ast.Binary(*t)), c.map(lambda x: ast.Call("ISNULL", [x, ast.Lit(0)]))),
    max_leaves=8,
)


def show(e):
    if isinstance(e, ast.Lit):
        return str(e.value)
    if isinstance(e, ast.Name):
        return ".".join(e.parts)
    if isinstance(e, ast.Param):
        return "&" + e.name
    if isinstance(e, ast.Call):
        return f"ЕСТЬNULL({show(e.args[0])}, {show(e.args[1])})"
    return f"({show(e.left)} {e.op} {show(e.right)})"


@settings(max_examples=150, deadline=None)
@given(exprs)
def test_round_trip(e):
    assert parse(f"ВЫБРАТЬ {show(e)} КАК к ИЗ Справочник.Х КАК Т")[0].branches[0][1].fields[0].expr == e


def test_like_regex():
    import re

    assert re.match(like_regex("a%[0-9]_", None), "axx7z") and not re.match(like_regex("a%[0-9]_", None), "axxz") and re.match(like_regex("5#%", "#"), "5%")


def test_problems(engine):
    for text, code in [("SELECT X.A AS a FROM Catalog.Nothing AS X", "TABLE_NOT_FOUND"), ("SELECT R.zzz AS a FROM Catalog.Regions AS R", "FIELD_NOT_FOUND"), ("SELECT R.Description.x AS a FROM Catalog.Regions AS R", "FIELD_CHAIN_INVALID"), ("SELECT &p AS a FROM Catalog.Regions AS R", "PARAMETER_NOT_SET"), ("DROP t", "TABLE_NOT_FOUND")]:
        with pytest.raises(PlanProblem) as e:
            engine.run(text)
        assert e.value.code == code


def test_validation_codes(engine):
    codes = lambda t: {f.code for f in validate(t, engine.catalog)}
    assert codes("") == {"EMPTY_QUERY"} and codes("SELECT (") == {"PARSE_ERROR"} and codes("SELECT R.Ref AS a FROM Catalog.Regions AS R") == set()
    assert codes("SELECT 1 AS a FROM Catalog.Zzz AS X") == {"TABLE_NOT_FOUND"} and codes("SELECT 1 AS a FROM Document.Regions AS X") == {"TABLE_TYPE_MISMATCH"}
    assert codes("SELECT 1 AS a FROM AccumulationRegister.Stock.Foo() AS X") == {"UNKNOWN_VIRTUAL_TABLE"} and codes("SELECT 1 AS a FROM AccumulationRegister.Stock.SliceLast() AS X") == {"VIRTUAL_TABLE_NOT_AVAILABLE"}
    assert codes("SELECT 1 AS a FROM AccumulationRegister.Sales.Balance() AS X") == {"VIRTUAL_TABLE_NOT_AVAILABLE"}
    assert codes("SELECT R.zz AS a FROM Catalog.Regions AS R") == {"FIELD_NOT_FOUND"} and codes("SELECT Q.Ref AS a FROM Catalog.Regions AS R") == {"UNKNOWN_TABLE_ALIAS"}
    assert codes("SELECT R.Ref + 1 FROM Catalog.Regions AS R") == {"FIELD_WITHOUT_ALIAS"} and codes("SELECT N.Region.Ref.q AS a FROM Catalog.Nations AS N") == {"FIELD_CHAIN_INVALID"}
    assert codes("SELECT SUM(R.Description) AS a FROM Catalog.Regions AS R") == {"AGGREGATE_TYPE_MISMATCH"}
    assert codes("SELECT R.Ref AS a INTO T FROM Catalog.Regions AS R; SELECT T.a AS b FROM T AS T; DROP T") == set()


def test_explain():
    x = explain("ВЫБРАТЬ О.Товар КАК т, СУММА(О.Количество) КАК к ПОМЕСТИТЬ ВТ ИЗ РегистрНакопления.Запасы.Остатки(&П) КАК О ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Товары КАК С ПО О.Товар = С.Ссылка СГРУППИРОВАТЬ ПО О.Товар; УНИЧТОЖИТЬ ВТ")
    assert x["virtual_tables"] == ["Остатки"] and x["joins"] == ["left"] and x["aggregates"] == ["SUM"] and x["parameters"] == ["П"] and x["temp_tables"] == ["ВТ"] and x["statements"] == 2


def test_templates():
    assert choose_template("покажи остатки на складе") == "balance"
    assert "Остатки(" in fill_template("balance", group="Товар", resource="Количество", table="РегистрНакопления.Запасы")
    with pytest.raises(ValueError):
        fill_template("balance")


def test_shared_dereference(engine):
    df = engine.run("SELECT O.Customer.Description AS a, O.Customer.Segment AS b FROM Document.Orders AS O WHERE O.Customer.Balance > 0")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_or_join_is_no_nested_loop(engine):
    plan = engine.run("SELECT C.Ref AS c FROM Catalog.Customers AS C JOIN Catalog.Suppliers AS S ON C.Ref = S.Ref OR C.Nation = S.Nation")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_not_in_with_null(spark):
    c = Catalog()
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (None,)], "k int")
    c.add(TableDef("Catalog.A", a, {"k": "k"}))
    c.add(TableDef("Catalog.B", b, {"k": "k"}))
    run = Engine(spark, c).run
    assert run("SELECT A.k AS k FROM Catalog.A AS A WHERE A.k NOT IN (SELECT B.k FROM Catalog.B AS B)").count() == 0
    assert run("SELECT A.k AS k FROM Catalog.A AS A WHERE A.k NOT IN (SELECT B.k FROM Catalog.B AS B WHERE NOT B.k IS NULL)").collect()[0].k == 2
    assert run("SELECT A.k AS k FROM Catalog.A AS A WHERE A.k = 2 OR A.k IN (SELECT B.k FROM Catalog.B AS B)").count() == 2
    assert run("SELECT A.k AS k, RECORDAUTONUMBER() AS n FROM Catalog.A AS A ORDER BY k").count() == 3


def test_not_in_is_no_broadcast_of_the_subquery(spark):
    """Beyond the broadcast threshold a NOT IN is a sort-merge anti join, and nulls on either side count in every column."""
    c = Catalog()
    rows = [(1, 1), (1, None), (None, 2), (2, 3), (None, None)]
    c.add(TableDef("Catalog.A", spark.createDataFrame(rows + [(9, 9)], "k int, m int"), {"k": "k", "m": "m"}))
    c.add(TableDef("Catalog.B", spark.createDataFrame(rows, "k int, m int"), {"k": "k", "m": "m"}))
    run = Engine(spark, c).run
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = run("SELECT A.k AS k FROM Catalog.A AS A WHERE A.k NOT IN (SELECT B.k FROM Catalog.B AS B WHERE NOT B.k IS NULL)")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "BroadcastHashJoin" not in plan and [r.k for r in df.collect()] == [9]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    text = "SELECT A.k AS k, A.m AS m FROM Catalog.A AS A WHERE NOT (A.k, A.m) IN (SELECT B.k, B.m FROM Catalog.B AS B WHERE {})"
    pairs = lambda cond: {(r.k, r.m) for r in run(text.format(cond)).collect()}
    maybe = lambda x, y: all(a is None or b is None or a == b for a, b in zip(x, y))
    tests = {"B.k = B.k AND B.m = B.m": lambda r: None not in r, "B.k IS NULL AND NOT B.m IS NULL": lambda r: r[0] is None and r[1] is not None, "B.k IS NULL AND B.m IS NULL": lambda r: r == (None, None), "B.k = 77": lambda r: False}
    for cond, keep in tests.items():
        inside = [r for r in rows if keep(r)]
        assert pairs(cond) == {x for x in [*rows, (9, 9)] if not any(maybe(x, y) for y in inside)}, cond


def test_totals_of_two_hierarchies(spark):
    """Each group climbs the table its own column refers to; levels above the first hierarchical group count rows once."""
    c = Catalog()
    goods = spark.createDataFrame([("g", None), ("g1", "g"), ("g2", "g")], "ref string, up string")
    shops = spark.createDataFrame([("s", None), ("s1", "s")], "ref string, up string")
    moves = spark.createDataFrame([("s1", "g1", 1), ("s1", "g2", 2), ("s", "g1", 4)], "shop string, good string, n int")
    for name, df in (("Catalog.Shops", shops), ("Catalog.Goods", goods)):
        c.add(TableDef(name, df, {"ref": "ref", "up": "up"}, "ref", "ref", {"up": name}, "up"))
    c.add(TableDef("InformationRegister.Moves", moves, {"shop": "shop", "good": "good", "n": "n"}, refs={"shop": "Catalog.Shops", "good": "Catalog.Goods"}))
    run = lambda by: {(r.good, r.totals_level): r.n for r in Engine(spark, c).run(f"SELECT M.good AS good, M.n AS n FROM InformationRegister.Moves AS M TOTALS SUM(n) BY {by}").collect() if r.totals_level is not None}
    assert run("OVERALL, good HIERARCHY") == {(None, 0): 7, ("g", 1): 7, ("g1", 1): 5, ("g2", 1): 2}
    assert run("OVERALL, good ONLY HIERARCHY") == {(None, 0): 7, ("g", 1): 7}
    both = Engine(spark, c).run("SELECT M.shop AS shop, M.good AS good, M.n AS n FROM InformationRegister.Moves AS M TOTALS SUM(n) BY shop HIERARCHY, good HIERARCHY")
    got = {(r.shop, r.good, r.totals_level): r.n for r in both.collect() if r.totals_level is not None}
    assert got == {("s", None, 1): 7, ("s1", None, 1): 3, ("s", "g", 2): 7, ("s", "g1", 2): 5, ("s", "g2", 2): 2, ("s1", "g", 2): 3, ("s1", "g1", 2): 1, ("s1", "g2", 2): 2}


def test_record_numbers_follow_the_order(spark):
    c = Catalog()
    c.add(TableDef("Catalog.A", spark.range(5000).selectExpr("id AS k", "id % 7 AS m").repartition(7), {"k": "k", "m": "m"}))
    got = Engine(spark, c).run("SELECT A.k AS k, RECORDAUTONUMBER() AS n FROM Catalog.A AS A ORDER BY A.m DESC, k DESC").collect()
    want = sorted(range(5000), key=lambda k: (-(k % 7), -k))
    assert [r.k for r in got] == want and [r.n for r in got] == list(range(5000))
    assert {r.k: r.n for r in Engine(spark, c).run("SELECT A.k AS k, RECORDAUTONUMBER() AS n FROM Catalog.A AS A").collect()} == {i: i for i in range(5000)}


def test_composite_fields_and_restriction_texts(engine, data):
    """A field of several types: whole, by type, behind CAST, and in a row-level restriction given as text."""
    n = engine.run("SELECT COUNT(*) AS n FROM InformationRegister.Contacts AS C").first().n
    by = {r.kind: r.n for r in engine.run("SELECT VALUETYPE(C.Owner) AS kind, COUNT(*) AS n FROM InformationRegister.Contacts AS C GROUP BY VALUETYPE(C.Owner)").collect()}
    assert sum(by.values()) == n and set(by) == {"CATALOG.CUSTOMERS", "CATALOG.SUPPLIERS"}
    assert engine.run("SELECT C.Contact AS c FROM InformationRegister.Contacts AS C WHERE C.Owner REFS Catalog.Customers").count() == by["CATALOG.CUSTOMERS"]
    assert engine.run("SELECT C.Contact AS c FROM InformationRegister.Contacts AS C WHERE C.Owner REFS Catalog.Regions").count() == 0
    assert engine.run("SELECT C.Contact AS c FROM InformationRegister.Contacts AS C WHERE C.Owner.Description = C.Contact").count() == n
    rich = engine.run("SELECT ALLOWED C.Contact AS c FROM InformationRegister.Contacts AS C", {"Порог": 0})
    assert 0 < rich.count() < n
    with pytest.raises(PlanProblem):
        engine.run("SELECT C.Owner.Segment AS s FROM InformationRegister.Contacts AS C")  # suppliers have no segment


def test_long_parent_chain(spark):
    n = 100
    df = spark.range(n).selectExpr("id AS k", "IF(id > 0, id - 1, NULL) AS p")
    assert hierarchy.closure(df, "k", "p").count() == n * (n + 1) // 2
    assert sorted(r.key for r in hierarchy.below(df, "k", "p", spark.createDataFrame([(75,)], "key long")).collect()) == list(range(75, n))
    ring = spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "y")], "k string, p string")
    assert {r.key for r in hierarchy.below(ring, "k", "p", spark.createDataFrame([("x",), (None,)], "key string")).collect()} == {"x", "y", "z"}


def test_tables_as_parameters(spark, engine):
    df = spark.createDataFrame([(1, "x"), (3, "y")], "id int, mark string")
    got = engine.run("SELECT P.mark AS mark, R.Description AS d FROM &T AS P INNER JOIN Catalog.Regions AS R ON P.id = R.Ref", {"T": df})
    assert got.count() == 2


def test_empty_table_and_union_names(engine):
    assert engine.run("SELECT 1 AS a, EMPTYTABLE(x, y) AS t").first().t == []
    assert engine.run("SELECT 1 AS a UNION ALL SELECT 2 AS b").columns == ["a"]


# -- virtual tables
moves = [(1, T(2024, 1, 5), "+", 10), (1, T(2024, 1, 20), "-", 4), (1, T(2024, 3, 1), "+", 1), (2, T(2024, 1, 7), "+", 5), (2, T(2024, 2, 7), "-", 5), (3, T(2023, 12, 1), "+", 2)]


def test_balance_identity(spark):
    df = spark.createDataFrame(moves, "k int, at timestamp_ntz, kind string, q int")
    plus = F.col("kind") == "+"
    b = {r.k: r.q_balance for r in vt.balance(df, ["k"], ["q"], "at", plus, F.lit(T(2024, 2, 1)).cast("timestamp_ntz")).collect()}
    assert b == {1: 6, 2: 5, 3: 2}
    assert {r.k for r in vt.balance(df, ["k"], ["q"], "at", plus).collect()} == {1, 3}  # zero balances are left out
    rows = vt.balance_and_turnovers(df, ["k"], ["q"], "at", plus, F.lit(T(2024, 1, 1)).cast("timestamp_ntz"), None, "MONTH").collect()
    assert all(r.q_opening + r.q_turnover == r.q_closing and r.q_receipt - r.q_expense == r.q_turnover for r in rows)
    whole = {r.k: (r.q_opening, r.q_closing) for r in vt.balance_and_turnovers(df, ["k"], ["q"], "at", plus, F.lit(T(2024, 1, 1)).cast("timestamp_ntz")).collect()}
    assert whole == {1: (0, 7), 2: (0, 0), 3: (2, 2)}


def test_slices_and_boundaries(spark):
    df = spark.createDataFrame([(1, T(2024, 1, 1), 1, "a"), (1, T(2024, 1, 2), 1, "b"), (1, T(2024, 1, 2), 2, "c"), (2, T(2024, 1, 3), 1, None)], "k int, at timestamp_ntz, n int, v string")
    at = F.lit(T(2024, 1, 2)).cast("timestamp_ntz")
    assert [(r.k, r.v) for r in vt.slice_last(df, ["k"], "at", at, ["n"]).collect()] == [(1, "c")]
    assert sorted((r.k, r.v) for r in vt.slice_first(df, ["k"], "at", at, ["n"]).collect()) == [(1, "b"), (2, None)]
    assert vt.boundaries(df, ["k"], "at").count() == 2


def test_action_periods(spark):
    df = spark.createDataFrame([("e", T(2024, 1, 1), T(2024, 1, 31), 1), ("e", T(2024, 1, 10), T(2024, 1, 20), 2)], "e string, b timestamp_ntz, t timestamp_ntz, p int")
    got = sorted((r.p, r.b.day, r.t.day) for r in vt.actual_action_period(df, ["e"], "b", "t", "p").collect())
    assert got == [(1, 1, 10), (1, 20, 31), (2, 10, 20)]


def test_schedule_and_tasks(spark):
    rows = spark.createDataFrame([("a", T(2024, 1, 2), T(2024, 1, 3)), ("a", T(2024, 2, 1), T(2024, 2, 2))], "k string, b timestamp_ntz, t timestamp_ntz")
    plan = spark.createDataFrame([("a", T(2024, 1, d), 8.0) for d in range(1, 6)], "k string, day timestamp_ntz, hours double")
    assert [r.hours for r in vt.schedule_data(rows, plan, ["k"], "b", "t", "day", "hours").orderBy("b").collect()] == [16.0, 0.0]
    tasks = spark.createDataFrame([(1, "sales"), (2, "stock")], "id int, role string")
    who = spark.createDataFrame([("sales", "ann"), (None, "bob")], "role string, performer string")
    assert Counter(r.performer for r in vt.tasks_by_performer(tasks, who, ["role"], "performer").collect()) == {"ann": 1, "bob": 2}
    post = spark.createDataFrame([(1, "x", None)], "n int, d1 string, d2 string")
    ext = vt.ext_dimensions(post, ["n"], ["d1", "d2"])
    assert ext.count() == 1 and vt.records_with_ext_dimensions(post.select("n"), ext, ["n"], ["d1", "d2"]).first().d1 == "x"


def test_hierarchy_with_cycle(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x")], "k string, p string")
    pairs = {(r.ancestor, r.descendant): r.depth for r in hierarchy.closure(df, "k", "p").collect()}
    assert pairs[("a", "d")] == 3 and pairs[("x", "y")] == 1 and ("x", "x") in pairs and len([p for p in pairs if p[1] == "d"]) == 4


def test_periods(spark):
    one = spark.range(1).select(F.lit(T(2024, 2, 29, 13, 5)).cast("timestamp_ntz").alias("d"))
    row = one.select(*[scalar.begin_of_period(F.col("d"), u).alias(f"b{u}") for u in ("TENDAYS", "HALFYEAR", "WEEK", "QUARTER")], *[scalar.end_of_period(F.col("d"), u).alias(f"e{u}") for u in ("TENDAYS", "MONTH")]).first()
    assert (row.bTENDAYS, row.bHALFYEAR, row.bWEEK, row.bQUARTER) == (T(2024, 2, 21), T(2024, 1, 1), T(2024, 2, 26), T(2024, 1, 1))
    assert row.eTENDAYS == row.eMONTH == T(2024, 2, 29, 23, 59, 59)


@pytest.mark.parametrize("name", ["vt_balance", "vt_turnovers_monthly", "vt_balance_and_turnovers", "vt_drcr_turnovers"])
def test_register_views_over_the_whole_register(spark, data, name):
    """The views, which have no key condition, give what their SQL gives."""
    duckdb = pytest.importorskip("duckdb")
    data = data.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{data}/lineitem.parquet'")
    got = sorted(map(repr, (tuple(r) for r in queries_engine.QUERIES[name](spark, data).collect())))
    want = sorted(map(repr, con.execute(queries_engine.SQL[name]).fetchall()))
    assert got == want and len(got) > 5000


def test_whole_hierarchy(spark, data):
    """The hierarchy queries reach every node, customers included, and the null-safe join pairs the null parents."""
    nodes = spark.read.parquet(f"{data}/customer.parquet").select("c_custkey", "c_nationkey").collect()
    run = lambda name: queries_engine.QUERIES[name](spark, data).collect()
    order = [r.ref for r in run("hier_order")]
    assert len(order) == len(set(order)) == 30 + len(nodes)
    at = {r: i for i, r in enumerate(order)}
    assert all(at[f"C{r.c_custkey}"] > at[f"N{r.c_nationkey}"] for r in nodes)
    totals = {r.ref: r.n for r in run("agg_totals_hierarchy") if r.totals_level == 1}
    assert len(totals) == len(order) and sum(totals[f"R{i}"] for i in range(5)) == len(order)
    joined = {r.ref: r.siblings for r in run("rel_null_safe_join")}
    assert joined.keys() == set(order) and {joined[f"R{i}"] for i in range(5)} == {5}
