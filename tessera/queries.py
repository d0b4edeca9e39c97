"""Queries over the test tables, one for each operator, with the same in DuckDB's SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expr import compile, expression, parse, raw
from .fixtures import engine, model, reader
from .infer import candidates, classify, inferred, join_factor, suggests_foreign_key
from .lineage import LineageGraph
from .model import Model, Source, Table, sum_
from .operators import build
from .operators.build import Merge
from .operators.relational import recursive, rel
from .plans.query import Pivot, Query, Report, agg, delta, derived, growth, m, mtd, prior_period, prior_quarter, prior_year, qtd, rolling_avg, rolling_sum, ytd
from .sources.store import ColumnDef, Sinks, Store, check, foreign_key, primary_key, unique
from .sources.catalog import ParquetFolder, column_stats, execute, value_overlap

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to two digits: their sums depend on the order of rows."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), 2).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema])


def semantic(name: str, query, sql: str) -> None:
    add(name, lambda spark, d: rounded(engine(spark, d).execute(query)), sql)


# --- semantic queries -------------------------------------------------------------------------------------------------

OC = "orders JOIN customer ON o_custkey = c_custkey"
OCN = f"{OC} JOIN nation ON c_nationkey = n_nationkey"
OCNR = f"{OCN} JOIN region ON n_regionkey = r_regionkey"
REV, N = "round(sum(o_totalprice), 2)", "count(*)"

semantic("sem_revenue_by_segment", Query(["customer.c_mktsegment"], [m("sales.revenue"), m("sales.order_count")], ["orders.o_orderdate >= timestamp '1995-01-01'"], order_by=["revenue desc"], limit=10),
         f"SELECT c_mktsegment, {REV} AS revenue, {N} AS order_count FROM {OC} WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1 ORDER BY 2 DESC LIMIT 10")
semantic("sem_simple_agg", Query(["sales.o_orderstatus"], [m("revenue"), m("order_count")], from_="sales"), f"SELECT o_orderstatus, {REV} AS revenue, {N} AS order_count FROM orders GROUP BY 1")
semantic("sem_join_dim", Query(["customer.c_mktsegment"], [m("sales.revenue")]), f"SELECT c_mktsegment, {REV} AS revenue FROM {OC} GROUP BY 1")
semantic("sem_snowflake_2hop", Query(["region.r_name", "nation.n_name"], [m("sales.revenue"), m("sales.customers")]), f"SELECT r_name, n_name, {REV} AS revenue, count(DISTINCT o_custkey) AS customers FROM {OCNR} GROUP BY 1, 2")
semantic("sem_global_agg", Query([], [m("sales.revenue"), m("sales.order_count")]), f"SELECT {REV} AS revenue, {N} AS order_count FROM orders")
semantic("sem_measures_all_aggs", Query(["customer.c_mktsegment"], [m(f"sales.{x}") for x in ("revenue", "order_count", "customers", "avg_price", "min_price", "max_price")]),
         f"SELECT c_mktsegment, {REV} AS revenue, {N} AS order_count, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 2) AS avg_price, round(min(o_totalprice), 2) AS min_price, round(max(o_totalprice), 2) AS max_price FROM {OC} GROUP BY 1")
semantic("sem_count_distinct", Query(["nation.n_name"], [m("sales.customers")]), f"SELECT n_name, count(DISTINCT o_custkey) AS customers FROM {OCN} GROUP BY 1")
semantic("sem_inline_agg", Query(["customer.c_mktsegment"], [agg("max", "sales.o_totalprice").as_("top"), agg("count", "*").as_("n"), agg("sum", "sales.o_totalprice", "o_orderstatus = 'F'").as_("done")], from_="sales"),
         f"SELECT c_mktsegment, round(max(o_totalprice), 2) AS top, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS done FROM {OC} GROUP BY 1")
for _name, _spark, _duck in [
    ("eq", "customer.c_mktsegment = 'BUILDING'", "c_mktsegment = 'BUILDING'"),
    ("ne", expression("customer.c_mktsegment").ne("BUILDING"), "c_mktsegment <> 'BUILDING'"),
    ("range", "orders.o_totalprice >= 1000 and orders.o_totalprice < 150000", "o_totalprice >= 1000 AND o_totalprice < 150000"),
    ("like", "orders.o_orderpriority like '%HIGH'", "o_orderpriority LIKE '%HIGH'"),
    ("in", "customer.c_mktsegment in ('BUILDING', 'MACHINERY')", "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("in_empty", expression("customer.c_mktsegment").is_in([]), "false"),
    ("not_in", expression("customer.c_mktsegment").not_in(["BUILDING", "MACHINERY"]), "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ("between", "orders.o_totalprice between 1000 and 90000", "o_totalprice BETWEEN 1000 AND 90000"),
    ("null", "nullif(orders.o_orderstatus, 'F') is null", "nullif(o_orderstatus, 'F') IS NULL"),
    ("sql_string", "year(orders.o_orderdate) >= 1997 and (orders.o_orderstatus = 'O' or customer.c_acctbal > 5000)", "year(o_orderdate) >= 1997 AND (o_orderstatus = 'O' OR c_acctbal > 5000)"),
]:
    semantic(f"sem_filter_{_name}", Query(["orders.o_orderstatus"], [m("sales.order_count"), m("sales.revenue")], [_spark]), f"SELECT o_orderstatus, {N} AS order_count, {REV} AS revenue FROM {OC} WHERE {_duck} GROUP BY 1")
URGENT = "CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END"
semantic("sem_filtered_measure_def", Query(["customer.c_mktsegment"], [m("sales.urgent")]), f"SELECT c_mktsegment, round(sum({URGENT}), 2) AS urgent FROM {OC} GROUP BY 1")
semantic("sem_filtered_measure_query", Query(["customer.c_mktsegment"], [m("sales.revenue").where("customer.c_acctbal > 0").as_("positive"), m("sales.urgent").where("o_orderstatus = 'F'").as_("replaced")]),
         f"SELECT c_mktsegment, round(sum(CASE WHEN c_acctbal > 0 THEN o_totalprice END), 2) AS positive, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS replaced FROM {OC} GROUP BY 1")
semantic("sem_filtered_count", Query(["nation.n_name"], [m("sales.urgent_count")]), f"SELECT n_name, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_count FROM {OCN} GROUP BY 1")
semantic("sem_derived_arith", Query(["customer.c_mktsegment"], [derived("per_order", m("sales.revenue") / m("sales.order_count")), derived("mixed", (m("sales.revenue") - m("sales.urgent")) * 2 + 1)]),
         f"SELECT c_mktsegment, round(sum(o_totalprice) / count(*), 2) AS per_order, round((sum(o_totalprice) - sum({URGENT})) * 2 + 1, 2) AS mixed FROM {OC} GROUP BY 1")
semantic("sem_derived_negate", Query(["customer.c_mktsegment"], [derived("minus", -m("sales.order_count"))]), f"SELECT c_mktsegment, -count(*) AS minus FROM {OC} GROUP BY 1")
semantic("sem_delta", Query(["customer.c_mktsegment"], [derived("gap", delta(m("sales.max_price"), m("sales.min_price")))]), f"SELECT c_mktsegment, round(max(o_totalprice) - min(o_totalprice), 2) AS gap FROM {OC} GROUP BY 1")
semantic("sem_growth", Query(["order_day.year"], [derived("change", growth(m("sales.revenue"), prior_period(m("sales.revenue"))))]),
         "SELECT CAST(y AS INTEGER) AS year, round((r - lag(r) OVER (ORDER BY y)) / nullif(lag(r) OVER (ORDER BY y), 0) * 100, 2) AS change FROM (SELECT year(o_orderdate) AS y, sum(o_totalprice) AS r FROM orders GROUP BY 1)")
MONTHLY = "WITH t AS (SELECT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(month(o_orderdate) AS INTEGER) AS month, sum(o_totalprice) AS r FROM " + OC + " GROUP BY ALL)"
TIME = ["customer.c_mktsegment", "order_day.year", "order_day.quarter", "order_day.month"]
SERIES = "PARTITION BY c_mktsegment ORDER BY year, quarter, month"
for _name, _calc, _over in [
    ("ytd", ytd(m("sales.revenue")), "sum(r) OVER (PARTITION BY c_mktsegment, year ORDER BY quarter, month ROWS UNBOUNDED PRECEDING)"),
    ("qtd", qtd(m("sales.revenue")), "sum(r) OVER (PARTITION BY c_mktsegment, year, quarter ORDER BY month ROWS UNBOUNDED PRECEDING)"),
    ("prior_period", prior_period(m("sales.revenue"), 2), f"lag(r, 2) OVER ({SERIES})"),
    ("prior_quarter", prior_quarter(m("sales.revenue")), f"lag(r, 3) OVER ({SERIES})"),
    ("prior_year", prior_year(m("sales.revenue")), f"lag(r, 12) OVER ({SERIES})"),
    ("rolling_sum", rolling_sum(m("sales.revenue"), 3), f"sum(r) OVER ({SERIES} ROWS 2 PRECEDING)"),
    ("rolling_avg", rolling_avg(m("sales.revenue"), 3), f"avg(r) OVER ({SERIES} ROWS 2 PRECEDING)"),
]:
    semantic(f"sem_{_name}", Query(TIME, [m("sales.revenue"), derived("v", _calc)]), f"{MONTHLY} SELECT c_mktsegment, year, quarter, month, round(r, 2) AS revenue, round({_over}, 2) AS v FROM t")
semantic("sem_mtd", Query(["order_day.year", "order_day.month", "order_day.day"], [derived("v", mtd(m("sales.order_count")))]),
         "SELECT CAST(y AS INTEGER) AS year, CAST(mo AS INTEGER) AS month, CAST(d AS INTEGER) AS day, CAST(sum(n) OVER (PARTITION BY y, mo ORDER BY d ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM (SELECT year(o_orderdate) AS y, month(o_orderdate) AS mo, day(o_orderdate) AS d, count(*) AS n FROM orders GROUP BY ALL)")
semantic("sem_topk", Query(["nation.n_name"], [m("sales.revenue")], order_by=["revenue desc", "n_name"], limit=5), f"SELECT n_name, {REV} AS revenue FROM {OCN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
semantic("sem_offset", Query(["nation.n_name"], [m("sales.order_count")], order_by=["n_name"], limit=5, offset=3), f"SELECT n_name, {N} AS order_count FROM {OCN} GROUP BY 1 ORDER BY 1 LIMIT 5 OFFSET 3")
semantic("sem_having", Query(["nation.n_name"], [m("sales.order_count")], having=["order_count > 600"]), f"SELECT n_name, {N} AS order_count FROM {OCN} GROUP BY 1 HAVING count(*) > 600")
FOLD = """WITH s AS (SELECT c_mktsegment AS k, n_name AS j, c_nationkey AS i, sum(o_totalprice) AS revenue, count(*) AS order_count FROM {ocn} GROUP BY 1, 2, 3),
e AS (SELECT c_mktsegment AS k, n_name AS j, c_nationkey AS i, count(*) AS event_count FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
l AS (SELECT c_mktsegment AS k, n_name AS j, c_nationkey AS i, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)""".format(ocn=OCN)
semantic("sem_multi_fact", Query(["customer.c_mktsegment", "nation.n_name"], [m("sales.revenue"), m("activity.event_count")]),
         f"{FOLD} SELECT coalesce(s.k, e.k) AS c_mktsegment, coalesce(s.j, e.j) AS n_name, round(coalesce(revenue, 0), 2) AS revenue, coalesce(event_count, 0) AS event_count FROM s FULL OUTER JOIN e ON s.k = e.k AND s.j = e.j")
semantic("sem_multi_fact_3", Query(["customer.c_mktsegment", "customer.c_nationkey"], [m("sales.order_count"), m("activity.event_count"), m("lines.quantity"), derived("per_order", m("lines.quantity") / m("sales.order_count"))]),
         f"{FOLD} SELECT coalesce(s.k, e.k, l.k) AS c_mktsegment, coalesce(s.i, e.i, l.i) AS c_nationkey, coalesce(order_count, 0) AS order_count, coalesce(event_count, 0) AS event_count, round(coalesce(quantity, 0), 2) AS quantity, round(coalesce(quantity, 0) / nullif(coalesce(order_count, 0), 0), 2) AS per_order FROM s FULL OUTER JOIN e ON s.k = e.k AND s.i = e.i FULL OUTER JOIN l ON l.k = coalesce(s.k, e.k) AND l.i = coalesce(s.i, e.i)")
semantic("sem_multi_fact_global", Query([], [m("sales.order_count"), m("activity.event_count"), m("lines.line_count")]), "SELECT (SELECT count(*) FROM orders) AS order_count, (SELECT count(*) FROM events) AS event_count, (SELECT count(*) FROM lineitem) AS line_count")
semantic("sem_multi_fact_filter", Query(["region.r_name"], [m("sales.order_count"), m("activity.event_count")], ["customer.c_acctbal > 4000"]),
         "WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 4000), s AS (SELECT r_name, count(*) AS order_count FROM orders JOIN c ON o_custkey = c_custkey GROUP BY 1), e AS (SELECT r_name, count(*) AS event_count FROM events JOIN c ON user_id = c_custkey GROUP BY 1) SELECT coalesce(s.r_name, e.r_name) AS r_name, coalesce(order_count, 0) AS order_count, coalesce(event_count, 0) AS event_count FROM s FULL OUTER JOIN e ON s.r_name = e.r_name")
semantic("sem_role_playing", Query([("order_day.year", "order_year"), ("ship_day.year", "ship_year")], [m("lines.line_count")], order_by=["order_year", "ship_year"]),
         "SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS line_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
semantic("sem_virtual_fact", Query(["enriched.price_band", "enriched.cust_c_mktsegment"], [m("enriched.orders_n"), m("enriched.total")], ["enriched.customer_order = 1"]),
         f"SELECT CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS price_band, c_mktsegment AS cust_c_mktsegment, count(*) AS orders_n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM {OC}) WHERE rn = 1 GROUP BY 1, 2")
semantic("sem_virtual_dim", Query(["segments.segment", "segments.rich"], [m("sales.order_count")]), f"SELECT upper(c_mktsegment) AS segment, CASE WHEN c_acctbal > 5000 THEN 'yes' ELSE 'no' END AS rich, count(*) AS order_count FROM {OC} GROUP BY 1, 2")
semantic("sem_computed_dim", Query([("date_trunc('month', orders.o_orderdate)", "month_start")], [m("sales.order_count")]), "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, count(*) AS order_count FROM orders GROUP BY 1")
semantic("sem_expression_measure", Query(["part.p_brand"], [m("lines.amount"), m("lines.quantity")]), "SELECT p_brand, round(sum(l_extendedprice * (1 - l_discount)), 2) AS amount, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
semantic("sem_dims_only", Query(["nation.n_name", "customer.c_mktsegment"], from_="sales"), f"SELECT DISTINCT n_name, c_mktsegment FROM {OCN}")
semantic("sem_source_filter", Query([], [agg("count", "*").as_("n")], from_="big_orders"), "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000")
semantic("report_single", Report(["sales.revenue", "sales.order_count"], ["nation.n_name"], order_by=["n_name"]), f"SELECT n_name, {REV} AS sales_revenue, {N} AS sales_order_count FROM {OCN} GROUP BY 1")
semantic("report_multi", Report(["sales.revenue", "activity.event_count"], ["customer.c_mktsegment", "nation.n_name"]),
         f"{FOLD} SELECT coalesce(s.k, e.k) AS c_mktsegment, coalesce(s.j, e.j) AS n_name, round(revenue, 2) AS sales_revenue, event_count AS activity_event_count FROM s FULL OUTER JOIN e ON s.k = e.k AND s.j = e.j")
semantic("report_filter_routing", Report(["sales.order_count", "activity.event_count"], ["customer.c_mktsegment"], ["o_orderstatus = 'F'", "customer.c_acctbal > 0"]),
         "WITH s AS (SELECT c_mktsegment AS k, count(*) AS a FROM " + OC + " WHERE o_orderstatus = 'F' AND c_acctbal > 0 GROUP BY 1), e AS (SELECT c_mktsegment AS k, count(*) AS b FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0 GROUP BY 1) SELECT coalesce(s.k, e.k) AS c_mktsegment, a AS sales_order_count, b AS activity_event_count FROM s FULL OUTER JOIN e ON s.k = e.k")
PIV = ", ".join(f"round(sum(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 2) AS \"{s}_revenue\"" for s in "FOP")
semantic("pivot_explicit", Pivot(["customer.c_mktsegment"], "sales.o_orderstatus", ["sales.revenue"], ["F", "O", "P"]), f"SELECT c_mktsegment, {PIV} FROM {OC} GROUP BY 1")
semantic("pivot_dynamic", Pivot(["nation.n_name"], "sales.o_orderstatus", ["sales.revenue"]), f"SELECT n_name, {PIV} FROM {OCN} GROUP BY 1")
PIVN = ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}_order_count\"" for s in "FO")
PIVA = ", ".join(f"round(avg(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2) AS \"{s}_avg_price\"" for s in "FO")
PIVD = ", ".join(f"count(DISTINCT CASE WHEN o_orderstatus = '{s}' THEN o_custkey END) AS \"{s}_customers\"" for s in "FO")
semantic("pivot_multi_measure", Pivot(["customer.c_mktsegment"], "sales.o_orderstatus", ["sales.order_count", "sales.avg_price", "sales.customers"], ["F", "O"]), f"SELECT c_mktsegment, {PIVN}, {PIVA}, {PIVD} FROM {OC} GROUP BY 1")
_TOT = f"{PIVN}, {PIVA}, count(*) AS \"Total_order_count\", round(avg(o_totalprice), 2) AS \"Total_avg_price\""
semantic("pivot_totals", Pivot(["customer.c_mktsegment"], "sales.o_orderstatus", ["sales.order_count", "sales.avg_price"], ["F", "O"], totals=("rows", "columns", "grand"), sort=("sales.order_count", True)),
         f"SELECT c_mktsegment, {_TOT}, false AS is_total FROM {OC} GROUP BY 1 UNION ALL SELECT NULL, {_TOT}, true FROM {OC}")
semantic("report_time_range", Report(["sales.revenue", "sales.order_count"], ["nation.n_name"], time_range="last_6_months", time_column="sales.order_date", as_of="1996-06-30"),
         f"SELECT n_name, {REV} AS sales_revenue, {N} AS sales_order_count FROM {OCN} WHERE CAST(o_orderdate AS date) > DATE '1995-12-30' AND CAST(o_orderdate AS date) <= DATE '1996-06-30' GROUP BY 1")
semantic("pivot_formats", Pivot(["customer.c_mktsegment"], "sales.o_orderstatus", ["sales.order_count", "sales.customers"], ["F", "O"], totals=("rows",), formats={"sales.order_count": "currency", "sales.customers": "%05d"}),
         "SELECT c_mktsegment, " + ", ".join(f"'$' || format('{{:,}}', count(*) {f}) || '.00' AS \"{s}_order_count\", lpad(CAST(count(DISTINCT o_custkey) {f} AS varchar), 5, '0') AS \"{s}_customers\"" for s, f in (("F", "FILTER (WHERE o_orderstatus = 'F')"), ("O", "FILTER (WHERE o_orderstatus = 'O')"), ("Total", ""))) + f" FROM {OC} GROUP BY 1")
semantic("sem_raw_filter", Query(["customer.c_mktsegment"], [m("sales.order_count")], [raw("{customer.c_name} rlike '[02468]$' AND {sales.o_totalprice} > 1000")]),
         f"SELECT c_mktsegment, {N} AS order_count FROM {OC} WHERE regexp_matches(c_name, '[02468]$') AND o_totalprice > 1000 GROUP BY 1")


# --- relational builder -------------------------------------------------------------------------------------------------


def relational(name: str, run, sql: str) -> None:
    """run gets a function from a table's name to its relation, aliased by that name."""
    add(name, lambda spark, d: run(lambda t: rel(ParquetFolder(spark, d).read(t), t)).frame(), sql)


relational("join_inner", lambda t: t("nation").join(t("region"), "nation.n_regionkey = region.r_regionkey").select("nation.n_name", "region.r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
relational("join_left", lambda t: t("documents").join(t("labels"), "documents.doc_id = labels.doc_id", "left").select("documents.doc_id", "labels.quality"), "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
relational("join_right", lambda t: t("events").join(t("customer"), "events.user_id = customer.c_custkey", "right").group_by("customer.c_custkey", n="count(events.event_id)"), "SELECT c_custkey, count(event_id) AS n FROM events RIGHT JOIN customer ON user_id = c_custkey GROUP BY 1")
relational("join_full", lambda t: t("customer").where("c_custkey < 300").join(t("events").where("user_id > 100"), "customer.c_custkey = events.user_id", "full").select("customer.c_custkey", "events.event_id"),
           "SELECT c_custkey, event_id FROM (SELECT * FROM customer WHERE c_custkey < 300) FULL OUTER JOIN (SELECT * FROM events WHERE user_id > 100) ON c_custkey = user_id")
relational("join_cross", lambda t: t("nation").join(t("region"), how="cross").select("n_name", "r_name"), "SELECT n_name, r_name FROM nation CROSS JOIN region")
relational("join_theta", lambda t: t("nation").join(t("region"), "nation.n_regionkey < region.r_regionkey and nation.n_nationkey > 3").select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey AND n_nationkey > 3")
relational("join_semi", lambda t: t("customer").join(t("events"), "customer.c_custkey = events.user_id", "semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
relational("join_anti", lambda t: t("customer").join(t("events"), "customer.c_custkey = events.user_id", "anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
relational("in_subquery", lambda t: t("orders").where_in("o_custkey", t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
relational("not_in_subquery", lambda t: t("customer").where_not_in("c_custkey", t("events").select("user_id")).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
relational("not_in_subquery_null", lambda t: t("customer").where_not_in("c_custkey", t("events").select(u="nullif(user_id, 1)")).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(user_id, 1) FROM events)")
relational("scalar_subquery", lambda t: t("orders").with_scalar("mean", t("orders").group_by(mean="avg(o_totalprice)")).where("o_totalprice > mean * 1.5").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * 1.5")
_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey < 12"
for _name, _op, _sql in [("union", "union", "UNION"), ("union_all", "union_all", "UNION ALL"), ("intersect", "intersect", "INTERSECT"), ("intersect_all", "intersect_all", "INTERSECT ALL"), ("except", "except_", "EXCEPT"), ("except_all", "except_all", "EXCEPT ALL")]:
    relational(f"set_{_name}", lambda t, op=_op: getattr(t("customer").select(k="c_nationkey"), op)(t("supplier").where("s_nationkey < 12").select(k="s_nationkey")), f"{_A} {_sql} {_B}")
relational("set_chain", lambda t: t("customer").select(k="c_nationkey").union(t("nation").select(k="n_nationkey + 20")).except_(t("supplier").where("s_nationkey < 12").select(k="s_nationkey")), f"({_A} UNION SELECT n_nationkey + 20 FROM nation) EXCEPT {_B}")
relational("cte", lambda t: t("orders").group_by("o_custkey", n="count(*)").where("n > 12").select("o_custkey", "n"), "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n FROM c WHERE n > 12")
_DAYS = ("SELECT 1 AS i, CAST(1 AS BIGINT) AS f", "SELECT i + 1, f * 2 FROM r WHERE i < 20")
add("cte_recursive", lambda spark, d: recursive(spark, *_DAYS, ["i", "f"], "SELECT i, f FROM r"), f"WITH RECURSIVE r(i, f) AS ({_DAYS[0]} UNION ALL {_DAYS[1]}) SELECT i, f FROM r")
relational("distinct", lambda t: t("part").select("p_brand", "p_size").distinct(), "SELECT DISTINCT p_brand, p_size FROM part")
relational("having", lambda t: t("part").group_by("p_brand", n="count(*)", having="n > 75"), "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 75")
relational("rollup", lambda t: t("orders").grouping_sets(["o_orderstatus", "o_orderpriority"], "rollup", n="count(*)"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
relational("cube", lambda t: t("orders").grouping_sets(["o_orderstatus", "o_orderpriority"], "cube", n="count(*)"), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
relational("case_searched", lambda t: t("part").select("p_partkey", size="case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end"), "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size FROM part")
relational("case_simple", lambda t: t("orders").select("o_orderkey", s="case o_orderstatus when 'F' then 1 when 'O' then 2 end"), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS s FROM orders")
relational("like_escape", lambda t: t("documents").where("text like '%!%%' escape '!'").select("doc_id"), "SELECT doc_id FROM documents WHERE text LIKE '%!%%' ESCAPE '!'")
relational("ilike", lambda t: t("customer").where("c_mktsegment ilike 'build%'").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%'")
relational("order_nulls", lambda t: t("orders").select("o_orderkey", s="nullif(o_orderstatus, 'F')").order_by("s desc nulls first", "o_orderkey").limit(20, 5), "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 5")
relational("top_per_group", lambda t: t("orders").top_per_group(3, ["o_custkey"], ["o_totalprice desc", "o_orderkey"]).select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")

W = "over (partition by o_custkey order by o_orderdate, o_orderkey)"
for _name, _f, _cast in [
    ("row_number", "row_number()", "INTEGER"), ("rank", "rank()", "INTEGER"), ("dense_rank", "dense_rank()", "INTEGER"), ("ntile", "ntile(4)", "INTEGER"), ("percent_rank", "percent_rank()", "DOUBLE"), ("cume_dist", "cume_dist()", "DOUBLE"),
    ("lag", "lag(o_totalprice)", "DOUBLE"), ("lag_default", "lag(o_totalprice, 2, 0.0)", "DOUBLE"), ("lead", "lead(o_totalprice, 2)", "DOUBLE"), ("first_value", "first_value(o_totalprice)", "DOUBLE"), ("last_value", "last_value(o_totalprice)", "DOUBLE"), ("nth_value", "nth_value(o_totalprice, 2)", "DOUBLE"),
]:
    relational(f"win_{_name}", lambda t, f=_f: t("orders").select("o_orderkey", v=f"{f} {W}"), f"SELECT o_orderkey, CAST({_f} {W} AS {_cast}) AS v FROM orders")
relational("win_aggs", lambda t: t("orders").select("o_orderkey", n=f"count(*) {W}", hi=f"max(o_totalprice) {W}", lo=f"min(o_totalprice) {W}", s=f"round(sum(o_totalprice) {W}, 2)", a=f"round(avg(o_custkey) {W}, 6)"),
           f"SELECT o_orderkey, count(*) {W} AS n, max(o_totalprice) {W} AS hi, min(o_totalprice) {W} AS lo, round(sum(o_totalprice) {W}, 2) AS s, round(avg(o_custkey) {W}, 6) AS a FROM orders")
for _name, _w in [("rows", "over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and 1 following)"), ("range", "over (partition by o_orderstatus order by o_custkey range between 3 preceding and current row)"), ("groups", "over (partition by o_orderstatus order by o_custkey groups between 1 preceding and 1 following)")]:
    relational(f"frame_{_name}", lambda t, w=_w: t("orders").select("o_orderkey", n=f"count(*) {w}", hi=f"max(o_totalprice) {w}"), f"SELECT o_orderkey, count(*) {_w} AS n, max(o_totalprice) {_w} AS hi FROM orders")


# --- functions --------------------------------------------------------------------------------------------------------


def functions(name: str, table: str, key: str, pairs: dict[str, tuple[str, str]]) -> None:
    """{output: (our text, DuckDB's text)}."""
    relational(name, lambda t: t(table).select(key, **{k: a for k, (a, _) in pairs.items()}), f"SELECT {key}, {', '.join(f'{b} AS {k}' for k, (_, b) in pairs.items())} FROM {table}")


same = lambda *texts: {f"v{i}": (t, t) for i, t in enumerate(texts)}
functions("fn_string", "customer", "c_custkey", {
    **same("upper(c_name)", "lower(c_name)", "trim(c_name)", "ltrim(c_name)", "rtrim(c_name)", "left(c_name, 4)", "right(c_name, 3)", "substring(c_name, 2, 5)", "replace(c_name, '0', 'z')", "concat(c_name, '-', c_mktsegment)", "c_name || '/' || c_mktsegment", "split_part(c_name, '#', 2)"),
    "n": ("length(c_name)", "CAST(length(c_name) AS INTEGER)"), "p": ("position('0', c_name)", "CAST(position('0' IN c_name) AS INTEGER)"),
    "i": ("initcap(c_mktsegment)", "upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2))")})
functions("fn_regexp", "part", "p_partkey", {"a": ("regexp_replace(p_type, '[AEIOU]', '_')", "regexp_replace(p_type, '[AEIOU]', '_', 'g')"), "b": ("regexp_extract(p_brand, '[0-9]+')", "regexp_extract(p_brand, '[0-9]+')")})
functions("fn_null", "orders", "o_orderkey", same("coalesce(nullif(o_orderstatus, 'F'), 'none')", "ifnull(nullif(o_orderstatus, 'O'), 'x')", "nullif(o_orderpriority, '5-LOW')"))
functions("fn_date_parts", "orders", "o_orderkey", {f"v{i}": (f"{a}(o_orderdate)", f"CAST({b}(o_orderdate) AS INTEGER)") for i, (a, b) in enumerate([(x, x) for x in ("year", "month", "day", "hour", "minute", "second", "quarter", "dayofyear")] + [("weekofyear", "weekofyear"), ("dayofweek", "1 + dayofweek")])} | {"e": ("extract(month from o_orderdate)", "CAST(month(o_orderdate) AS INTEGER)"), "l": ("last_day(o_orderdate)", "last_day(o_orderdate)")})
functions("fn_date_arith", "orders", "o_orderkey", {
    "a": ("date_add(o_orderdate, 3, month)", "o_orderdate + INTERVAL 3 MONTH"), "b": ("date_sub(o_orderdate, 5, day)", "o_orderdate - INTERVAL 5 DAY"), "c": ("o_orderdate + interval 2 hour", "o_orderdate + INTERVAL 2 HOUR"),
    "d": ("date_diff(month, timestamp '1995-01-31', o_orderdate)", "date_diff('month', TIMESTAMP '1995-01-31', o_orderdate)"), "e": ("date_diff(day, timestamp '1995-01-31', o_orderdate)", "date_diff('day', TIMESTAMP '1995-01-31', o_orderdate)"),
    "f": ("date_diff(year, timestamp '1995-12-31', o_orderdate)", "date_diff('year', TIMESTAMP '1995-12-31', o_orderdate)"), "g": ("make_date(year(o_orderdate), 1, 15)", "make_date(year(o_orderdate), 1, 15)"), "h": ("to_date(o_orderdate)", "CAST(o_orderdate AS DATE)"),
    "i": ("make_timestamp(year(o_orderdate), 2, 3, 4, 5, 6)", "make_timestamp(year(o_orderdate), 2, 3, 4, 5, 6)"), "j": ("to_char(o_orderdate, 'yyyy-MM')", "strftime(o_orderdate, '%Y-%m')")})
functions("fn_date_trunc", "orders", "o_orderkey", {u: (f"date_trunc('{u}', o_orderdate)", f"CAST(date_trunc('{u}', o_orderdate) AS {'TIMESTAMP' if u == 'hour' else 'DATE'})") for u in ("year", "quarter", "month", "week", "day", "hour")})
functions("fn_numeric", "customer", "c_custkey", {
    **same("round(c_acctbal, 1)", "abs(c_acctbal)", "greatest(c_acctbal, 0.0)", "least(c_acctbal, 0.0)", "mod(c_custkey, 7)"),
    "f": ("floor(c_acctbal)", "CAST(floor(c_acctbal) AS BIGINT)"), "c": ("ceil(c_acctbal)", "CAST(ceil(c_acctbal) AS BIGINT)"), "s": ("sign(c_acctbal)", "CAST(sign(c_acctbal) AS DOUBLE)"), "t": ("truncate(c_acctbal, 0)", "CAST(trunc(c_acctbal) AS DOUBLE)"),
    "p": ("round(power(c_custkey, 2), 3)", "round(power(c_custkey, 2), 3)"), "q": ("round(sqrt(abs(c_acctbal)), 6)", "round(sqrt(abs(c_acctbal)), 6)"), "e": ("round(exp(c_custkey / 1000), 6)", "round(exp(c_custkey / 1000), 6)"),
    "l": ("round(ln(c_custkey + 1), 6)", "round(ln(c_custkey + 1), 6)"), "g": ("round(log10(c_custkey + 1), 6)", "round(log10(c_custkey + 1), 6)"), "h": ("round(log(2, c_custkey + 1), 6)", "round(ln(c_custkey + 1) / ln(2), 6)"), "z": ("c_acctbal / 0", "c_acctbal / nullif(0, 0)"), "m": ("c_custkey % 5", "c_custkey % 5")})
functions("fn_conditional", "customer", "c_custkey", {"a": ("if(c_acctbal > 0, 'plus', 'minus')", "CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END"), "b": ("iff(c_mktsegment = 'BUILDING', 1, 0)", "CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END")})
functions("fn_cast", "customer", "c_custkey", {"a": ("cast(c_custkey as string)", "CAST(c_custkey AS VARCHAR)"), "b": ("try_cast(c_name as int)", "TRY_CAST(c_name AS INTEGER)"), "c": ("cast(c_nationkey as double)", "CAST(c_nationkey AS DOUBLE)"), "d": ("to_number(split_part(c_name, '#', 2))", "TRY_CAST(split_part(c_name, '#', 2) AS DOUBLE)"), "e": ("cast('1995-02-03' as date)", "CAST('1995-02-03' AS DATE)")})
functions("fn_hash", "customer", "c_custkey", {"a": ("md5(c_name)", "md5(c_name)"), "b": ("sha256(c_name)", "sha256(c_name)"), "c": ("sha1(c_name)", "sha1(c_name)")})
functions("fn_json", "events", "event_id", {"a": ("json_extract(props, 'k')", "json_extract_string(props, '$.k')"), "b": ("props ->> 'k'", "props ->> 'k'"), "n": ("json_array_length('[1, 2, 3]')", "CAST(json_array_length('[1, 2, 3]') AS INTEGER)")})
relational("fn_string_agg", lambda t: t("nation").group_by("n_regionkey", names="string_agg(n_name, '|')"), "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1")
relational("fn_array_agg", lambda t: t("nation").group_by("n_regionkey", a="array_agg(n_name)").select("n_regionkey", n="array_length(a)", s="array_join(array_sort(a), ',')"), "SELECT n_regionkey, CAST(count(*) AS INTEGER) AS n, string_agg(n_name, ',' ORDER BY n_name) AS s FROM nation GROUP BY 1")
relational("fn_agg_filter", lambda t: t("orders").group_by("o_orderstatus", n="count(*) filter (where o_totalprice > 100000)", d="count(distinct o_custkey)"), "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS n, count(DISTINCT o_custkey) AS d FROM orders GROUP BY 1")
add("fn_now_random", lambda spark, d: spark.range(5).select("id", *[compile(parse(t), lambda c: F.col(c.name)).alias(n) for t, n in (("current_date() is not null", "a"), ("now() is not null", "b"), ("random() < 1", "c"))]),
    "SELECT i AS id, true AS a, true AS b, true AS c FROM range(5) t(i)")


# --- build layer --------------------------------------------------------------------------------------------------------

LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
add("src_filter", lambda spark, d: build.source_frame(Source("o").from_("orders").filter("o_totalprice > 250000"), reader(spark, d)).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000")
for _keep, _way in (("first", ""), ("last", " DESC")):
    add(f"src_dedup_{_keep}", lambda spark, d, keep=_keep: build.source_frame(Source("l").from_("lineitem").dedup(["l_orderkey", "l_linenumber"], LINE, keep), ParquetFolder(spark, d).read),
        f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + _way for c in LINE)}) AS n FROM lineitem) WHERE n = 1")
add("src_changes", lambda spark, d: build.changes(ParquetFolder(spark, d).read("orders"), Source("orders").change_tracking("append_only", "o_orderdate"), "2000-06-01").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01'")
add("src_cdc", lambda spark, d: build.changes(ParquetFolder(spark, d).read("events").withColumn("op", F.when(F.col("event_type") == "click", "delete").otherwise("update")), Source("e").columns(user_id=build_pk()).change_tracking("cdc", "event_id", "op")).select("user_id", "event_id"),
    "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'click'")


def build_pk():
    from .model import pk

    return pk("int64")


def table(name: str, made: Table, sql: str) -> None:
    add(name, lambda spark, d: rounded(build.table_frame(made, ParquetFolder(spark, d).read)), sql)


add("table_union", lambda spark, d: build.table_frame(Table("u").from_("a", "b"), {"a": ParquetFolder(spark, d).read("customer").select(F.col("c_nationkey").alias("k")), "b": ParquetFolder(spark, d).read("supplier").select(F.col("s_nationkey").alias("k"))}.get), f"{_A} UNION SELECT s_nationkey FROM supplier")
add("table_union_all", lambda spark, d: build.table_frame(Table("u").from_("a", "b", all=True), {"a": ParquetFolder(spark, d).read("customer").select(F.col("c_nationkey").alias("k")), "b": ParquetFolder(spark, d).read("supplier").select(F.col("s_nationkey").alias("k"))}.get), f"{_A} UNION ALL SELECT s_nationkey FROM supplier")
table("table_computed", Table("t").from_("orders").filter("o_totalprice > 1000").columns("o_orderkey", price="round(o_totalprice * 2, 2)", year="year(o_orderdate)").window_columns(n="row_number() over (partition by year order by o_orderkey)"),
      "SELECT o_orderkey, round(o_totalprice * 2, 2) AS price, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS INTEGER) AS n FROM orders WHERE o_totalprice > 1000")
table("table_joins", Table("t").from_("orders").join("customer", "orders.o_custkey = customer.c_custkey", "left").columns(k="orders.o_orderkey", seg="customer.c_mktsegment"), "SELECT o_orderkey AS k, c_mktsegment AS seg FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
table("table_group_by", Table("t").from_("lineitem").group_by("l_returnflag", "l_linestatus").columns(qty="sum(l_quantity)", n="count(*)", price="avg(l_extendedprice)"), "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n, round(avg(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1, 2")
add("fact_includes", lambda spark, d: engine(spark, d).planner.frame("enriched").select("o_orderkey", "cust_c_mktsegment", "cust_c_acctbal", "price_band"), f"SELECT o_orderkey, c_mktsegment AS cust_c_mktsegment, c_acctbal AS cust_c_acctbal, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS price_band FROM {OC}")
add("fact_window_cols", lambda spark, d: engine(spark, d).planner.frame("enriched").select("o_orderkey", "customer_order"), "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS customer_order FROM orders")


def snapshots(spark, d) -> DataFrame:
    """Three states of the customers; the second moves every third one to another segment, the third every fifth."""
    c = ParquetFolder(spark, d).read("customer").select("c_custkey", "c_mktsegment")
    moved = lambda n, name: F.when(F.col("c_custkey") % n == 0, name).otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    return c.withColumn("at", F.lit(1)).union(c.select("c_custkey", moved(3, "MOVED"), F.lit(2))).union(c.select("c_custkey", moved(5, "AGAIN"), F.lit(3)))


SNAP = "s AS (SELECT c_custkey, c_mktsegment, 1 AS snap FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END, 2 FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'AGAIN' ELSE c_mktsegment END, 3 FROM customer), v AS (SELECT * FROM (SELECT *, lag(c_mktsegment) OVER w AS p, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY c_custkey ORDER BY snap)) WHERE n = 1 OR p IS DISTINCT FROM c_mktsegment)"
VERSIONS = f"WITH {SNAP} SELECT c_custkey, c_mktsegment, snap AS effective_from, lead(snap) OVER w AS effective_to, lead(snap) OVER w IS NULL AS is_current"
add("scd2", lambda spark, d: build.scd2(snapshots(spark, d), ["c_custkey"], ["c_mktsegment"], "at"), f"{VERSIONS} FROM v WINDOW w AS (PARTITION BY c_custkey ORDER BY snap)")
add("scd6", lambda spark, d: build.scd6(snapshots(spark, d), ["c_custkey"], ["c_mktsegment"], "at"),
    f"{VERSIONS}, lag(c_mktsegment) OVER w AS previous_c_mktsegment, last_value(c_mktsegment) OVER (PARTITION BY c_custkey ORDER BY snap ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS current_c_mktsegment FROM v WINDOW w AS (PARTITION BY c_custkey ORDER BY snap)")
_state = lambda spark, d, at: snapshots(spark, d).where(F.col("at") == at).drop("at")
add("scd2_merge", lambda spark, d: build.scd2_merge(build.scd2(snapshots(spark, d).where("at < 3"), ["c_custkey"], ["c_mktsegment"], "at"), _state(spark, d, 3), ["c_custkey"], ["c_mktsegment"], 3), f"{VERSIONS} FROM v WINDOW w AS (PARTITION BY c_custkey ORDER BY snap)")
add("scd3", lambda spark, d: build.scd3(_state(spark, d, 1), _state(spark, d, 2), ["c_custkey"], ["c_mktsegment"]), "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS previous_c_mktsegment FROM customer")
add("scd0", lambda spark, d: build.scd0(_state(spark, d, 1).where("c_custkey < 700"), _state(spark, d, 2), ["c_custkey"]), "SELECT c_custkey, CASE WHEN c_custkey >= 700 AND c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
add("scd1", lambda spark, d: build.scd1(_state(spark, d, 1), _state(spark, d, 2).where("c_custkey < 700"), ["c_custkey"]), "SELECT c_custkey, CASE WHEN c_custkey < 700 AND c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
_small = lambda spark, d: ParquetFolder(spark, d).read("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
add("incremental_merge", lambda spark, d: build.incremental(_small(spark, d).where("o_orderdate < timestamp_ntz '1998-01-01'"), _small(spark, d).withColumn("o_totalprice", F.lit(1.0)), ["o_orderkey"], "o_orderdate", "30 days"),
    "WITH t AS (SELECT max(o_orderdate) - INTERVAL 30 DAY AS hi FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate > hi THEN 1.0::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders, t")
_snap = lambda spark, d, at: _state(spark, d, at).withColumn("at", F.when(F.col("c_custkey") % 3 == 0, at).otherwise(1))
add("snapshot", lambda spark, d: build.snapshot(build.snapshot(None, _snap(spark, d, 1), ["c_custkey"], "at"), _snap(spark, d, 2), ["c_custkey"], "at"),
    "SELECT c_custkey, c_mktsegment, 1 AS at, 1 AS valid_from, CASE WHEN c_custkey % 3 = 0 THEN 2 END AS valid_to FROM customer UNION ALL SELECT c_custkey, 'MOVED', 2, 2, NULL FROM customer WHERE c_custkey % 3 = 0")
_nation = lambda spark, d: ParquetFolder(spark, d).read("nation")
_newer = lambda spark, d: _nation(spark, d).where("n_nationkey > 20").select((F.col("n_nationkey") + 2).alias("n_nationkey"), F.lower("n_name").alias("n_name"), "n_regionkey")
NEWER = "s AS (SELECT n_nationkey + 2 AS n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation WHERE n_nationkey > 20)"
add("dml_insert", lambda spark, d: build.insert(_nation(spark, d), _newer(spark, d), "nothing", ["n_nationkey"]), f"WITH {NEWER} SELECT * FROM nation UNION ALL SELECT * FROM s WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
add("dml_upsert", lambda spark, d: build.insert(_nation(spark, d), _newer(spark, d), "update", ["n_nationkey"]), f"WITH {NEWER} SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM s) UNION ALL SELECT * FROM s")
add("dml_update", lambda spark, d: build.update(_nation(spark, d), {"n_name": "upper(n_name) || '!'"}, "n_regionkey = 1"), "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation")
add("dml_delete", lambda spark, d: build.delete(_nation(spark, d), "n_regionkey = 2"), "SELECT * FROM nation WHERE n_regionkey <> 2")
add("dml_merge", lambda spark, d: Merge(_nation(spark, d), _newer(spark, d), ["n_nationkey"]).when_matched_delete("t.n_regionkey = s.n_regionkey").when_matched_update({"n_name": "s.n_name"}).when_not_matched_insert().frame(),
    f"WITH {NEWER} SELECT t.n_nationkey, coalesce(s.n_name, t.n_name) AS n_name, t.n_regionkey FROM nation t LEFT JOIN s ON t.n_nationkey = s.n_nationkey WHERE s.n_nationkey IS NULL OR t.n_regionkey <> s.n_regionkey UNION ALL SELECT * FROM s WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")


# --- metadata ---------------------------------------------------------------------------------------------------------

add("meta_column_stats", lambda spark, d: column_stats(ParquetFolder(spark, d).read("orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"))),
    " UNION ALL ".join(f"SELECT '{n}' AS column_name, count(*) AS total_count, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count, count({c}) > 0 AND count(DISTINCT {c}) = count({c}) AS is_unique FROM orders" for n, c in (("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("status", "nullif(o_orderstatus, 'F')"))))
add("meta_value_overlap", lambda spark, d: value_overlap(ParquetFolder(spark, d).read("customer"), "c_custkey", ParquetFolder(spark, d).read("events"), "user_id"),
    "WITH v AS (SELECT DISTINCT c_custkey AS v FROM customer ORDER BY 1 LIMIT 1000), r AS (SELECT count(*) AS sampled, count(*) FILTER (WHERE v IN (SELECT user_id FROM events)) AS matched FROM v) SELECT sampled, matched, round(100.0::DOUBLE * matched / sampled, 4) AS overlap_pct, sampled = matched AS right_is_superset, (SELECT count(user_id) = count(DISTINCT user_id) FROM events) AS right_unique FROM r")
add("meta_sample_rows", lambda spark, d: ParquetFolder(spark, d).read("region").orderBy("r_regionkey").limit(3), "SELECT * FROM region ORDER BY r_regionkey LIMIT 3")


def lineage_model() -> Model:
    """A model of which every edge can be told by hand."""
    made = Model()
    made.source("orders").columns(o_orderkey=build_pk(), o_totalprice="double", o_orderstatus="string")
    made.table("big").from_("orders").filter("o_totalprice > 10").columns("o_orderkey", price="o_totalprice * 2")
    made.fact("sales").grain("orders.o_orderkey").measure("revenue", sum_("o_totalprice"))
    return made.report("r", Report(["sales.revenue"], ["orders.o_orderstatus"])).query("q", Query([("orders.o_orderkey", "k")], [m("sales.revenue")], ["orders.o_orderstatus = 'F'"]))


add("lineage_edges", lambda spark, d: spark.createDataFrame(LineageGraph(lineage_model()).rows(), "from_entity string, from_column string, to_entity string, to_column string, kind string"),
    """SELECT * FROM (VALUES ('orders', 'o_orderkey', 'big', 'o_orderkey', 'pass_through'), ('orders', 'o_totalprice', 'big', 'price', 'transform'), ('orders', 'o_totalprice', 'big', 'o_orderkey', 'filter'),
    ('orders', 'o_totalprice', 'big', 'price', 'filter'), ('orders', 'o_orderkey', 'sales', 'o_orderkey', 'pass_through'), ('orders', 'o_totalprice', 'sales', 'revenue', 'aggregate'),
    ('sales', 'revenue', 'r', 'revenue', 'pass_through'), ('orders', 'o_orderstatus', 'r', 'o_orderstatus', 'pass_through'), ('orders', 'o_orderstatus', 'r', 'revenue', 'group_by'),
    ('sales', 'revenue', 'q', 'revenue', 'pass_through'), ('orders', 'o_orderkey', 'q', 'o_orderkey', 'pass_through'), ('orders', 'o_orderkey', 'q', 'revenue', 'group_by'), ('orders', 'o_orderstatus', 'q', 'revenue', 'filter'))
    AS t(from_entity, from_column, to_entity, to_column, kind)""")
add("lineage_upstream", lambda spark, d: spark.createDataFrame(LineageGraph(lineage_model()).upstream("q", "revenue"), "entity string, column_name string"),
    "SELECT * FROM (VALUES ('sales', 'revenue'), ('orders', 'o_totalprice'), ('orders', 'o_orderkey'), ('orders', 'o_orderstatus')) AS t(entity, column_name)")
add("lineage_impact", lambda spark, d: spark.createDataFrame([(e,) for e in LineageGraph(lineage_model()).impact("orders", "o_totalprice")], "entity string"), "SELECT * FROM (VALUES ('big'), ('sales'), ('r'), ('q')) AS t(entity)")
add("meta_execute", lambda spark, d: _executed(spark, d), "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 3 GROUP BY 1")
add("meta_row_count", lambda spark, d: spark.createDataFrame([(t, ParquetFolder(spark, d).row_count(t)) for t in ("region", "nation", "orders")], "name string, n long"), " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "orders")))
add("meta_tables", lambda spark, d: spark.createDataFrame([(t, *c[:2]) for t in ParquetFolder(spark, d).tables() if t in ("region", "nation") for c in ParquetFolder(spark, d).columns(t)], "name string, column_name string, type string"),
    "SELECT * FROM (VALUES ('nation', 'n_nationkey', 'int'), ('nation', 'n_name', 'string'), ('nation', 'n_regionkey', 'int'), ('region', 'r_regionkey', 'int'), ('region', 'r_name', 'string')) AS t(name, column_name, type)")


def _executed(spark, d) -> DataFrame:
    ParquetFolder(spark, d).read("nation").createOrReplaceTempView("tessera_nation")
    return execute(spark, "SELECT n_regionkey, count(*) AS n FROM tessera_nation WHERE n_nationkey > ? GROUP BY 1", [3])


def renamed(spark, d) -> dict[str, DataFrame]:
    read = ParquetFolder(spark, d).read
    return {"customers": read("customer").toDF("customer_id", "name", "nation_id", "acct_amount", "segment"), "orders": read("orders").toDF("order_id", "customer_id", "status", "total_amount", "created_at", "priority"), "nations": read("nation").toDF("nation_id", "name", "region_id")}


def _inferred(spark, d) -> DataFrame:
    from .infer import refine

    tables = renamed(spark, d)
    found = refine(candidates(tables, {"customers": "customer_id", "orders": "order_id", "nations": "nation_id"}), tables.get)
    return spark.createDataFrame([(c.from_table, c.from_column, c.to_table, c.to_column, c.rule, c.score, kind) for c, kind in found], "from_table string, from_column string, to_table string, to_column string, rule string, score double, cardinality string")


add("infer_relationships", _inferred,
    """SELECT 'orders' AS from_table, 'customer_id' AS from_column, 'customers' AS to_table, 'customer_id' AS to_column, 'pk_match' AS rule, 0.8::DOUBLE AS score, 'many_to_one' AS cardinality WHERE (SELECT count(*) FROM orders) > 0
    UNION ALL SELECT 'customers', 'nation_id', 'nations', 'nation_id', 'pk_match', 0.8, 'many_to_one'""")


def _weighed(spark, d, preset: str) -> DataFrame:
    read = ParquetFolder(spark, d).read
    tables = {**renamed(spark, d), "dim_regions": read("region").toDF("region_id", "title"), "notes": read("region").toDF("ref_customer", "order_count")}
    tables["notes"] = tables["notes"].select(F.col("ref_customer").cast("int"), F.col("ref_customer").alias("order_count"))
    found = inferred(tables, {"customers": "customer_id", "orders": "order_id", "nations": "nation_id", "dim_regions": "region_id"}, foreign_keys=[("orders", "status", "customers", "segment")], preset=preset)
    return spark.createDataFrame([(c.from_table, c.from_column, c.to_table, c.to_column, c.rule, round(c.score, 3)) for c in found], "from_table string, from_column string, to_table string, to_column string, rule string, score double")


def _weighed_sql(naming: float, least: float, most: float) -> str:
    """The formula of the signals in SQL: names and types weighed, less what counts against a name."""
    rows = [("orders", "customer_id", "customers", "customer_id", "pk_match", 0.65, 1.0, 1.0, 0.0), ("customers", "nation_id", "nations", "nation_id", "pk_match", 0.65, 1.0, 1.0, 0.0), ("nations", "region_id", "dim_regions", "region_id", "suffix_id_dim", 0.82, 1.0, 1.0, 0.0), ("notes", "ref_customer", "customers", "customer_id", "semantic_ref", 0.70, None, 0.9, 0.0), ("notes", "order_count", "orders", "order_id", "table_embed", 0.60, None, 0.9, 0.85)]
    values = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in rows)
    score = f"greatest(0, (name * {naming} + coalesce(same, 0) * {naming} + type * 0.75) / (CASE WHEN same IS NULL THEN {naming} ELSE 2 * {naming} END + 0.75) - least({most}, against * 0.9))"
    return f"SELECT from_table, from_column, to_table, to_column, rule, round({score}, 3)::DOUBLE AS score FROM (VALUES {values}) AS t(from_table, from_column, to_table, to_column, rule, name, same, type, against) WHERE {score} >= {least} UNION ALL SELECT 'orders', 'status', 'customers', 'segment', 'foreign_key', 1.0"


for _preset, _given in (("default", (0.85, 0.5, 0.8)), ("high_precision", (0.75, 0.7, 0.9)), ("high_recall", (0.90, 0.4, 0.6))):
    add(f"infer_weighed_{_preset}", lambda spark, d, preset=_preset: _weighed(spark, d, preset), _weighed_sql(*_given))
add("infer_verdict", lambda spark, d: _verdict(spark, d),
    """WITH v AS (SELECT DISTINCT user_id AS k, 'events' AS from_table FROM events UNION ALL SELECT k, 'shifted' FROM (SELECT DISTINCT c_custkey + 100 AS k FROM customer ORDER BY 1 LIMIT 1000)),
    s AS (SELECT from_table, count(*) AS sampled, count(*) FILTER (WHERE k IN (SELECT c_custkey FROM customer)) AS matched FROM v GROUP BY 1)
    SELECT from_table, round(100.0 * matched / sampled, 4)::DOUBLE AS pct, matched = sampled AS foreign_key, round(round(100.0 * matched / sampled, 4) / 100, 6)::DOUBLE AS join_factor FROM s""")


def _verdict(spark, d) -> DataFrame:
    read, out = ParquetFolder(spark, d).read, []
    for name, df in (("events", read("events").select(F.col("user_id").alias("k"))), ("shifted", read("customer").select((F.col("c_custkey") + 100).alias("k")))):
        r = value_overlap(df, "k", read("customer"), "c_custkey").collect()[0]
        out.append((name, r["overlap_pct"], suggests_foreign_key(r["overlap_pct"], r["right_is_superset"], r["right_unique"]), round(join_factor(r["overlap_pct"], 1, False, r["right_unique"]), 6)))
    return spark.createDataFrame(out, "from_table string, pct double, foreign_key boolean, join_factor double")


def _classified(spark, d) -> DataFrame:
    """The foreign keys that classify counts are the inferred ones."""
    tables, keys = renamed(spark, d), {"customers": "customer_id", "orders": "order_id", "nations": "nation_id"}
    links = {(c.from_table, c.from_column) for c in candidates(tables, keys)}
    return spark.createDataFrame([(n, classify(df, sum(t == n for t, _ in links), n in keys)) for n, df in tables.items()], "table_name string, kind string")


add("classify_tables", _classified, "SELECT * FROM (VALUES ('orders', 'fact'), ('customers', 'fact'), ('nations', 'dimension')) AS t(table_name, kind)")


# --- store: definitions, changes, sinks -----------------------------------------------------------------------------------


def new_store(spark, d) -> Store:
    """An empty store in the shared folder; in local mode, where none is set, in a temporary one. It goes with the process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tessera-store-")
    return Store(spark, f"{shared.rstrip('/')}/tessera-store/{spark.sparkContext.applicationId}/{uuid.uuid4().hex[:12]}")


def stored(name: str, run, sql: str) -> None:
    """run(store, read) -> DataFrame."""
    add(name, lambda spark, d: run(new_store(spark, d), ParquetFolder(spark, d).read), sql)


def _nations(store: Store, read) -> Store:
    store.create_table("nations", {"n_nationkey": ColumnDef("int", nullable=False), "n_name": "string", "n_regionkey": "int"}, [primary_key("n_nationkey"), unique("n_name"), check("n_regionkey >= 0", "region_check")], as_=read("nation"))
    return store


def _after(change):
    def run(store: Store, read) -> DataFrame:
        change(_nations(store, read))
        return store.read("nations")

    return run


def _create_defaults(store: Store, read) -> DataFrame:
    store.create_table("t", {"n_name": "string", "code": ColumnDef("int", default="7"), "label": ColumnDef("string", default="upper(n_name)")})
    store.create_table("t", {"n_name": "string"}, if_not_exists=True)
    store.insert("t", read("nation").select("n_name"))
    return store.read("t")


def _violated(store: Store, read) -> DataFrame:
    store.create_table("regions", as_=read("region").where("r_regionkey > 0"))
    rules = [primary_key("n_regionkey"), unique("n_name"), check("n_nationkey < 20", "few"), foreign_key(["n_regionkey"], "regions", ["r_regionkey"], "fk")]
    store._commit("t", read("nation"), {n: ColumnDef("int" if n != "n_name" else "string") for n in read("nation").columns}, rules)
    return store.violations("t")


def _views(store: Store, read) -> DataFrame:
    _nations(store, read)
    store.create_view("v", lambda: store.read("nations").where("n_regionkey = 1").select("n_nationkey"))
    refresh = store.create_materialized_view("mv", lambda: store.read("nations").groupBy("n_regionkey").agg(F.count("*").alias("n")))
    before = store.read("mv").withColumn("at", F.lit("before")).collect()
    store.delete("nations", "n_nationkey < 5")
    refresh()
    old = store.spark.createDataFrame(before, "n_regionkey int, n long, at string")
    view = store.read("v").select(F.col("n_nationkey").alias("n_regionkey"), F.lit(None).cast("long").alias("n"), F.lit("view").alias("at"))
    return old.unionByName(store.read("mv").withColumn("at", F.lit("after"))).unionByName(view)


def _identity(store: Store, read) -> DataFrame:
    store.create_table("t", {"id": ColumnDef("long", identity=True), "n_name": "string"})
    store.insert("t", read("nation").select("n_name"))
    store.insert("t", read("region").select(F.col("r_name").alias("n_name")))
    return store.read("t").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), (F.min("id") > 0).alias("positive"))


def _dropped(store: Store, read) -> DataFrame:
    _nations(store, read).create_table("gone", as_=read("region"))
    store.drop_table("gone")
    store.drop_table("gone", if_exists=True)
    return store.spark.createDataFrame([(t,) for t in store.tables()], "name string")


_N = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
stored("ddl_create_as", _after(lambda s: None), _N)
stored("ddl_create_defaults", _create_defaults, "SELECT n_name, CAST(7 AS INTEGER) AS code, upper(n_name) AS label FROM nation")
stored("ddl_identity", _identity, "SELECT 25 + 5 AS n, 30 AS ids, true AS positive")
stored("ddl_constraints", _violated, "SELECT 'pk' AS \"constraint\", count(*) - count(DISTINCT n_regionkey) AS violations FROM nation UNION ALL SELECT 'unique_n_name', count(*) - count(DISTINCT n_name) FROM nation UNION ALL SELECT 'few', count(*) FILTER (WHERE n_nationkey >= 20) FROM nation UNION ALL SELECT 'fk', count(*) FILTER (WHERE n_regionkey = 0) FROM nation UNION ALL SELECT 'pk: n_regionkey not null', 0")
stored("ddl_add_column", _after(lambda s: s.add_column("nations", "twice", ColumnDef("int", default="n_nationkey * 2"))), "SELECT *, CAST(n_nationkey * 2 AS INTEGER) AS twice FROM nation")
stored("ddl_drop_column", _after(lambda s: (s.drop_constraint("nations", "unique_n_name"), s.drop_column("nations", "n_name"))), "SELECT n_nationkey, n_regionkey FROM nation")
stored("ddl_rename_column", _after(lambda s: s.rename_column("nations", "n_name", "title")), "SELECT n_nationkey, n_name AS title, n_regionkey FROM nation")
stored("ddl_alter_type", _after(lambda s: s.alter_type("nations", "n_regionkey", "long")), "SELECT n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
stored("ddl_truncate", _after(lambda s: s.truncate("nations")), f"{_N} WHERE false")
stored("ddl_drop_table", _dropped, "SELECT 'nations' AS name")
stored("ddl_views", _views, "SELECT n_regionkey, count(*) AS n, 'before' AS at FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, count(*), 'after' FROM nation WHERE n_nationkey >= 5 GROUP BY 1 UNION ALL SELECT n_nationkey, NULL, 'view' FROM nation WHERE n_regionkey = 1 AND n_nationkey >= 5")
stored("dml_returning_update", lambda s, read: _nations(s, read).update("nations", {"n_name": "lower(n_name)"}, "n_regionkey = 2"), "SELECT n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
stored("dml_returning_delete", lambda s, read: _nations(s, read).delete("nations", "n_nationkey > 20"), f"{_N} WHERE n_nationkey > 20")
stored("dml_returning_insert", lambda s, read: _nations(s, read).insert("nations", read("nation").select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.concat("n_name", F.lit("2")).alias("n_name"), "n_regionkey"), "nothing", ["n_nationkey"]), "SELECT CAST(n_nationkey + 20 AS INTEGER) AS n_nationkey, n_name || '2' AS n_name, n_regionkey FROM nation WHERE n_nationkey >= 5")
add("dml_update_from", lambda spark, d: build.update_from(_nation(spark, d), _newer(spark, d), ["n_nationkey"], {"n_name": "s.n_name || t.n_name"}), f"WITH {NEWER} SELECT t.n_nationkey, coalesce(s.n_name || t.n_name, t.n_name) AS n_name, t.n_regionkey FROM nation t LEFT JOIN s ON t.n_nationkey = s.n_nationkey")
_feed = lambda spark, d: ParquetFolder(spark, d).read("events").select("user_id", "event_id", "value", F.when(F.col("event_type") == "click", "delete").otherwise("update").alias("op"))
_cdc = lambda: Source("e").columns(user_id=build_pk()).change_tracking("cdc", "event_id", "op")
add("src_cdc_applied", lambda spark, d: build.apply_changes(_feed(spark, d).where("event_id < 200").groupBy("user_id").agg(F.max("event_id").alias("event_id")).withColumn("value", F.lit(0.0)), _feed(spark, d), _cdc(), 100),
    "WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id > 100) WHERE n = 1) SELECT user_id, max(event_id) AS event_id, 0.0::DOUBLE AS value FROM events WHERE event_id < 200 AND user_id NOT IN (SELECT user_id FROM last) GROUP BY 1 UNION ALL SELECT user_id, event_id, value FROM last WHERE event_type <> 'click'")
add("src_cdc_deletions", lambda spark, d: build.deletions(_feed(spark, d), _cdc()), "SELECT user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type = 'click'")
add("frame_groups_star", lambda spark, d: rel(ParquetFolder(spark, d).read("nation")).select("*", x="sum(n_nationkey) over (order by n_regionkey groups between 1 preceding and current row)").frame(), "SELECT *, CAST(sum(n_nationkey) OVER (ORDER BY n_regionkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS x FROM nation")
add("grouping_sets", lambda spark, d: rel(ParquetFolder(spark, d).read("lineitem")).grouping_sets(["l_returnflag", "l_linestatus"], [["l_returnflag", "l_linestatus"], ["l_returnflag"], []], n="count(*)", g="grouping(l_linestatus)").frame(),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")


def _sink_model() -> Model:
    made = Model()
    made.source("orders").columns(o_orderkey=build_pk(), o_totalprice="double", o_orderdate="timestamp")
    made.table("recent").from_("orders").filter("year(o_orderdate) >= 1998").columns("o_orderkey", "o_totalprice", "o_orderdate")
    made.tables["recent"].strategy = {"unique_key": ["o_orderkey"], "incremental_key": "o_orderdate", "lookback": "30 days", "updated_at": "o_orderdate"}
    return made


def _sink(kind: str):
    """The table is built from the older half of the orders first, then from all, with their prices as they are now."""

    def run(store: Store, read) -> DataFrame:
        made, state = _sink_model(), {"rows": read("orders").where("o_orderdate < timestamp_ntz '2000-01-01'").withColumn("o_totalprice", F.lit(0.0))}
        sinks = Sinks(made, lambda name: build.table_frame(made.tables[name], lambda _: state["rows"]), store)
        sinks.build("recent", kind)
        state["rows"] = read("orders") if kind != "snapshot" else read("orders").withColumn("o_orderdate", F.expr("o_orderdate + interval 1 day"))
        return sinks.build("recent", kind)

    return run


_R = "FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"
for _kind in ("view", "table"):
    stored(f"sink_{_kind}", _sink(_kind), f"SELECT o_orderkey, o_totalprice, o_orderdate {_R}")
stored("sink_incremental", _sink("incremental"), f"WITH t AS (SELECT max(o_orderdate) - INTERVAL 30 DAY AS hi FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01') SELECT o_orderkey, CASE WHEN o_orderdate > hi THEN o_totalprice ELSE 0.0::DOUBLE END AS o_totalprice, o_orderdate {_R.replace('orders', 'orders, t')}")
stored("sink_snapshot", _sink("snapshot"),
    f"SELECT o_orderkey, 0.0::DOUBLE AS o_totalprice, o_orderdate, o_orderdate AS valid_from, o_orderdate + INTERVAL 1 DAY AS valid_to {_R} AND o_orderdate < TIMESTAMP '2000-01-01' UNION ALL SELECT o_orderkey, o_totalprice, o_orderdate + INTERVAL 1 DAY, o_orderdate + INTERVAL 1 DAY, NULL FROM orders WHERE o_orderdate + INTERVAL 1 DAY >= TIMESTAMP '1998-01-01'")


def _report_table(store: Store, read) -> DataFrame:
    """Made, taken as it is within the four hours, and made anew after them."""
    rows = [lambda n=n: read("nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).withColumn("run", F.lit(n)) for n in range(3)]
    sinks, out = Sinks(Model(), None, store), []
    for made, at in zip(rows, (0.0, 14_399.0, 14_400.0), strict=True):
        df, fresh = sinks.report("by_region", made, "4 hours", 1_000.0 + at)
        out.append(store.spark.createDataFrame(df.withColumn("fresh", F.lit(fresh)).collect(), "n_regionkey int, n long, run int, fresh boolean"))
    return out[0].unionByName(out[1]).unionByName(out[2])


stored("report_table_refresh", _report_table, "SELECT n_regionkey, count(*) AS n, r.run, r.fresh FROM nation, (VALUES (0, true), (0, false), (2, true)) AS r(run, fresh) GROUP BY 1, 3, 4")
