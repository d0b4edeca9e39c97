"""Expressions and models written as text, raw SQL, time ranges, formats, models that use others."""

import pytest

from tessera import emit, errors
from tessera.expr import compile, parse, raw
from tessera.fixtures import model
from tessera.model import Model, column, count, pk, sum_
from tessera.plans.query import Pivot, Report, formatted

TEXTS = [
    "a + b * -c - 2.5 / (d % 3)", "a = 'it''s' or not b <> 1 and t.c >= 2", "x like 'a!%' escape '!' and y not like 'b' or z ilike 'C%'", "a in (1, 2) and b not in ('x') and c between 1 and 2 + 3",
    "a is null or b is not null", "case when a > 1 then 'x' when b then 'y' else null end", "case a when 1 then 2 end", "cast(a as decimal(10, 2)) + try_cast(b as int)", "d - interval '3 month' > date '2024-01-01'",
    "count(distinct a) filter (where b > 1)", "sum(a) over (partition by b, c order by d desc nulls last, e rows between 2 preceding and current row)", "max(a) over (order by b range between unbounded preceding and 1 following)",
    "first_value(a) over (order by b groups 1 preceding)", "true and coalesce(a, false, null) || \"odd name\"", "count(*)",
]


@pytest.mark.parametrize("text", TEXTS)
def test_expressions_read_back(text):
    tree = parse(text)
    assert parse(emit.sql(tree)) == tree


def declared(text: str) -> Model:
    space: dict = {}
    exec(text, space)
    return space["model"]


def parts(made: Model) -> dict:
    return {k: {n: vars(e) for n, e in getattr(made, k).items()} for k in ("sources", "dimensions", "facts", "tables")} | {"links": made.relationships}


def test_models_read_back():
    own = Model()
    own.source("a b").from_("x").columns(id=pk("int64"), v=column("decimal(9,2)", description="it's \"v\"")).filter("v > 0").dedup(["id"], ["v desc"]).change_tracking("cdc", "t", "op").tags("p", "q")
    own.dimension("d").from_("a b").columns("id", up="upper(v)").columns("last").primary_key("id").scd(2).target("dim_d").materialized()
    own.table("t").from_("a b", "x", all=True).join("d", "t.id = d.id", "left").columns(n="count(*)", r=raw("hash({id})")).window_columns(k="row_number() over (order by id)").group_by("id").primary_key("id")
    own.fact("f").grain("t.id").include("d", ["up"], prefix="d_").column("w", "v * 2").measure("s", sum_("w").where("w > 1")).measure("n", count()).incremental(["id"], "v", 3).date_config(year="d.y").description("f's")
    own.link_as("f.id", "d.id", "r")
    for made in (own, model()):
        assert parts(declared(emit.python(made))) == parts(made)
    with pytest.raises(errors.InvalidModel):
        Model().use(own).use(own)
    assert parts(Model().use(own)) == parts(own)


def test_raw_sql(spark):
    df = spark.createDataFrame([("ab", 1), ("b", 2)], "s string, `odd name` int")
    out = lambda e: [r[0] for r in df.select(compile(e, lambda c: df[f"`{c.name}`"])).collect()]
    assert out(raw("{s} rlike '^a'")) == [True, False]
    assert raw("{t.s} = {n} and x = '{}'").references == (parse("t.s"), parse("n"))
    assert [c.name for c in parse("a = 1 and b").columns()] == ["a", "b"]


def test_time_ranges_and_formats(spark):
    assert Report([]).period() == []
    for wrong in (Report([], time_range="last_days", time_column="d"), Report([], time_range="last_2_days")):
        with pytest.raises(errors.QueryPlanError):
            wrong.period()
    at = lambda r: [x.d.isoformat() for x in spark.sql("SELECT explode(sequence(date '2024-02-01', date '2024-03-05')) AS d").where(" AND ".join(emit.sql(e) for e in r.period())).collect()]
    assert at(Report([], time_range="last_3_days", time_column="d", as_of="2024-03-01")) == ["2024-02-28", "2024-02-29", "2024-03-01"]
    df = spark.createDataFrame([(1234.5,), (-0.25,), (None,)], "x double")
    got = {p: [r[0] for r in df.select(formatted(df.x, p)).collect()] for p in ("currency", "percent", "%.1f")}
    assert got == {"currency": ["$1,234.50", "-$0.25", None], "percent": ["123450.0%", "-25.0%", None], "%.1f": ["1234.5", "-0.3", None]}
    assert Pivot(["a"], "b", ["c"]).formats == {}
