"""Rules of the semantic layer: errors before any job, paths, roles, lineage, inference, parsing, streams."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera import errors, infer
from tessera.engine import Engine
from tessera.expr import Binary, Col, Lit, expression, parse
from tessera.fixtures import model
from tessera.graph import JoinGraph, affected, build_order, required_sources
from tessera.lineage import LineageGraph
from tessera.model import Model, count, pk, sum_
from tessera.operators import build
from tessera.operators.relational import rel
from tessera.plans.query import Query, Report, agg, derived, m, ytd
from tessera.types import joinable, parse_type


@pytest.fixture(scope="module")
def small(spark):
    data = {
        "orders": spark.createDataFrame([(1, 1, 10, "F"), (2, 1, 20, "O"), (3, 2, 5, "F"), (4, None, 7, "F")], "order_id long, customer_id long, amount long, status string"),
        "customers": spark.createDataFrame([(1, "a", "north"), (2, "b", None), (3, "c", "south")], "customer_id long, name string, region string"),
        "returns": spark.createDataFrame([(1, 3, 4), (2, 1, 1)], "return_id long, customer_id long, amount long"),
        "notes": spark.createDataFrame([("1", "x")], "order_id string, note string"),
    }
    made = Model()
    made.source("orders").columns(order_id=pk("int64"), customer_id="int64", amount="int64")
    made.source("customers").columns(customer_id=pk("int64"), name="string", region="string")
    made.source("returns").columns(return_id=pk("int64"), customer_id="int64")
    made.source("notes").columns(order_id="string", note="string")
    made.fact("sales").grain("orders.order_id").measure("revenue", sum_("amount")).measure("n", count())
    made.fact("back").grain("returns.return_id").measure("returned", sum_("amount")).measure("n", count())
    made.many_to_one("orders.customer_id", "customers.customer_id").many_to_one("returns.customer_id", "customers.customer_id")
    made.many_to_one("orders.order_id", "notes.order_id")
    return Engine(made, data.get)


def test_null_keys_meet(small):
    got = {tuple(r) for r in small.execute(Query(["customers.region"], [m("sales.revenue"), m("back.returned")])).collect()}
    assert got == {("north", 30, 1), (None, 5, 0), ("south", 0, 4)}
    got = {tuple(r) for r in small.execute(Report(["sales.revenue", "back.returned"], ["customers.region"])).collect()}
    assert got == {("north", 30, 1), (None, 5, None), ("south", None, 4)}


@pytest.mark.parametrize(
    ("query", "error"),
    [
        (Query(["customers.region"], []), errors.NoAnchor),
        (Query(["customers.nothing"], [m("sales.revenue")]), errors.UnknownField),
        (Query(["nowhere.x"], [m("sales.revenue")]), errors.UnknownEntity),
        (Query([], [m("sales.nothing")]), errors.UnknownMeasure),
        (Query([], [m("n")]), errors.AmbiguousField),
        (Query([], [m("sales.revenue")], ["sales.revenue > 5"]), errors.InvalidReference),
        (Query(["orders.status"], [m("sales.n").as_("a"), m("back.n").as_("b")]), errors.DimensionNotShared),
        (Query(["notes.note"], [m("sales.revenue")]), errors.TypeMismatch),
        (Query(["customers.region"], [derived("x", ytd(m("sales.revenue")))]), errors.InvalidReference),
        (Query(["customers.region", ("customers.name", "region")], [m("sales.revenue")]), errors.AmbiguousField),
        (Report(["sales.revenue", "back.returned"]), errors.QueryPlanError),
        (Query([], [agg("sum", "customers.customer_id")], from_=None), errors.NoAnchor),
    ],
)
def test_errors(small, query, error):
    with pytest.raises(error):
        small.execute(query)


def test_fan_out_is_an_error():
    made = Model()
    made.source("a").columns(id=pk("int64"))
    made.source("b").columns(id=pk("int64"), a_id="int64")
    made.many_to_one("b.a_id", "a.id")
    graph = JoinGraph(made)
    assert [e.end for e in graph.join_tree("b", ["a"])] == ["a"]
    with pytest.raises(errors.UnsafeJoinPath, match="a -> b"):
        graph.join_tree("a", ["b"])
    assert graph.grain_of(["a", "b"]) == "b" and len(graph.fan_out_warnings("a")) == 1


def test_roles_and_paths():
    graph = JoinGraph(model())
    with pytest.raises(errors.AmbiguousDimensionRole, match="order_day"):
        graph.path("orders", "calendar")
    assert [e.end for e in graph.path("lines", "order_day")] == ["orders", "order_day"]
    assert graph.is_ambiguous("customer", "region") is False
    assert {p[0].end for p in graph.all_paths("lineitem", "nation", 3)} >= {"orders", "supplier"}
    with pytest.raises(errors.UnknownEntity):
        graph.path("orders", "nothing")
    assert "region" in graph.reachable("sales")


def test_build_order():
    made = Model()
    made.source("raw")
    made.table("clean").from_("raw")
    made.table("wide").from_("clean").join("raw", "clean.id = raw.id")
    assert build_order(made) == ["raw", "clean", "wide"]
    assert required_sources(made, "wide") == ["raw"] and affected(made, "raw") == ["clean", "wide"]
    made.tables["clean"].from_("wide")
    with pytest.raises(errors.CyclicDependency):
        build_order(made)


def test_lineage():
    made = model()
    made.table("t").from_("orders").columns(price="o_totalprice * 2").filter("o_orderstatus = 'F'")
    graph = LineageGraph(made)
    graph.check()
    assert ("orders", "o_totalprice") in graph.upstream("t", "price")
    assert "sales" in graph.impact("orders", "o_totalprice")
    assert ("orders", "o_totalprice", "t", "price", "transform") in graph.rows()
    assert ("orders", "o_orderstatus", "t", "price", "filter") in graph.rows()
    loop = Model()
    loop.table("a").from_("b").columns(x="y")
    loop.table("b").from_("a").columns(y="x")
    with pytest.raises(errors.ColumnLineageCycle):
        LineageGraph(loop).check()


def test_types():
    assert parse_type("decimal(10, 2)").simpleString() == "decimal(10,2)" and parse_type("NVARCHAR(40)").simpleString() == "string"
    assert joinable(parse_type("int"), parse_type("double")) and not joinable(parse_type("int"), parse_type("text"))
    assert joinable(parse_type("timestamp"), parse_type("timestamptz")) and not joinable(parse_type("date"), parse_type("timestamp"))
    with pytest.raises(errors.InvalidModel):
        parse_type("thing")


def test_grouping_is_kept():
    assert parse("(a - b) / c") == Binary("/", Binary("-", Col("a"), Col("b")), Col("c"))
    assert parse("t.a or b and not c in (1, 2)").left == Col("a", "t")
    for bad in ("a +", "select 1", "(a", "sum(a) over w", "a b", "sum(a) over (order by a rows between x preceding and current row)"):
        with pytest.raises((errors.InvalidReference, ValueError)):
            parse(bad)


numbers = st.integers(-50, 50)


@settings(max_examples=60, deadline=None)
@given(st.recursive(numbers.map(str), lambda x: st.tuples(x, st.sampled_from("+-*"), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=8))
def test_arithmetic_text(text):
    def value(e):
        match e:
            case Lit(v):
                return v
            case Binary(op, a, b):
                return {"+": value(a) + value(b), "-": value(a) - value(b), "*": value(a) * value(b)}[op]
        return -value(e.operand)

    assert value(expression(text)) == eval(text)  # noqa: S307


def test_relations(spark):
    with pytest.raises(ValueError):
        rel(spark.range(3)).select(x="sum(id) over (partition by id rows between 1 preceding and current row)")
    empty, some = spark.range(0), spark.createDataFrame([(1,), (None,)], "id long")
    assert rel(some).where_not_in("id", rel(empty)).frame().count() == 2
    assert rel(some).where_not_in("id", rel(some)).frame().count() == 0


def test_merge_order(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    s = spark.createDataFrame([(2, "x"), (3, None), (4, "y"), (5, None)], "id int, v string")
    out = build.Merge(t, s, ["id"]).when_matched_delete("s.v is null").when_matched_update({"v": "s.v || t.v"}).when_not_matched_insert(condition="s.v is not null").frame()
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a"), (2, "xb"), (4, "y")]


def test_inference(spark):
    assert infer.singular("categories") == "category" and infer.plural("box") == "boxes" and infer.base_name("dim_customers") == "customer"
    tables = {"customers": spark.createDataFrame([(1, "a")], "customer_id long, name string"), "orders": spark.createDataFrame([(1, 1, 0)], "order_id long, customer_id long, is_open int")}
    found = infer.candidates(tables, {"customers": "customer_id", "orders": "order_id"})
    assert [(c.from_table, c.from_column, c.to_table) for c in found] == [("orders", "customer_id", "customers")]
    refined = infer.refine(found, tables.get)
    assert refined[0][1] == "one_to_one" and refined[0][0].score > found[0].score
    assert infer.suggested_aggregation("margin_pct") == "avg"


def test_stream(spark, tmp_path):
    from tessera.streaming import upsert_stream

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(source)
    stream = lambda: spark.readStream.schema("id int, v string").parquet(source)
    upsert_stream(stream(), target, ["id"], str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string").write.mode("append").parquet(source)
    upsert_stream(stream(), target, ["id"], str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{target}/version=1").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_named_queries(small):
    small.model.query("top", Query(["customers.region"], [m("sales.revenue")], order_by=["revenue desc"], limit=1))
    assert small.list_queries() == ["top"] and small.with_lineage().execute_named("top").collect()[0]["revenue"] == 30
    with pytest.raises(errors.UnknownQuery):
        small.execute_named("nothing")


def test_what_is_refused(spark):
    from tessera import errors
    from tessera.operators import build
    from tessera.operators.relational import rel
    from tessera.sources.store import Store, check, foreign_key, primary_key, seconds

    two = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (9, "z")], "k int, v string")
    with pytest.raises(Exception, match="several rows"):
        rel(two).with_scalar("x", rel(twice)).frame().collect()
    assert [r["x"] for r in rel(two).with_scalar("x", rel(twice.limit(0))).frame().collect()] == [None, None]
    with pytest.raises(Exception, match="several source rows"):
        build.update_from(two, twice, ["k"], {"v": "s.v"}).collect()
    # no clause changes the row, so nothing is ambiguous
    assert build.Merge(two, twice, ["k"]).when_matched_delete("t.v = 'q'").frame().count() == 3
    assert seconds("4 hours") == 14_400 and seconds("2 weeks") == 1_209_600
    import tempfile

    store = Store(spark, "file://" + tempfile.mkdtemp())
    store.create_table("t", as_=two, constraints=[primary_key("k"), check("k < 9")])
    store.create_table("u", {"k": "int"}, [foreign_key(["k"], "t", ["k"])])
    for rows in (twice, spark.createDataFrame([(10, "q")], "k int, v string"), spark.createDataFrame([(None, "q")], "k int, v string")):
        with pytest.raises(errors.ConstraintViolation):
            store.insert("t", rows)
    with pytest.raises(errors.ConstraintViolation):
        store.insert("u", spark.createDataFrame([(5,)], "k int"))
    store.insert("u", spark.createDataFrame([(1,), (None,)], "k int"))
    assert store.read("t").count() == 2 and store.read("u").count() == 2
