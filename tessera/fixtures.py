"""The semantic model over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, parquet_reader
from .model import Model, avg, count, count_distinct, max_, min_, pk, sum_


def reader(spark: SparkSession, folder: str):
    read = parquet_reader(spark, folder)

    def with_calendar(name: str) -> DataFrame:
        if name == "calendar":  # every day of the orders' and shipments' years; its size doesn't follow the data
            days = spark.range(0, 366 * 12).select(F.date_add(F.lit("1994-01-01").cast("date"), F.col("id").cast("int")).alias("date_id"))
            return days.select("date_id", F.year("date_id").alias("year"), F.quarter("date_id").alias("quarter"), F.month("date_id").alias("month"), F.dayofmonth("date_id").alias("day"))
        df = read(name)
        if name == "orders":
            return df.withColumn("order_date", F.to_date("o_orderdate"))
        return df.withColumn("ship_date", F.to_date("l_shipdate")) if name == "lineitem" else df

    return with_calendar


def model() -> Model:
    m = Model()
    m.source("region").columns(r_regionkey=pk("int"), r_name="string")
    m.source("nation").columns(n_nationkey=pk("int"), n_name="string", n_regionkey="int")
    m.source("customer").columns(c_custkey=pk("int64"), c_name="string", c_nationkey="int", c_acctbal="double", c_mktsegment="string")
    m.source("supplier").columns(s_suppkey=pk("int64"), s_nationkey="int")
    m.source("part").columns(p_partkey=pk("int64"), p_brand="string", p_type="string", p_size="int")
    m.source("orders").columns(o_orderkey=pk("int64"), o_custkey="int64", o_totalprice="double", o_orderdate="timestamp")
    m.source("lineitem").columns("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    m.source("events").columns(event_id=pk("int64"), user_id="int64", value="double")
    m.source("calendar").columns(date_id=pk("date"), year="int", quarter="int", month="int", day="int")
    m.source("big_orders").from_("orders").filter("o_totalprice > 200000")
    m.many_to_one("orders.o_custkey", "customer.c_custkey").many_to_one("customer.c_nationkey", "nation.n_nationkey")
    m.many_to_one("supplier.s_nationkey", "nation.n_nationkey").many_to_one("nation.n_regionkey", "region.r_regionkey")
    m.many_to_one("lineitem.l_orderkey", "orders.o_orderkey").many_to_one("lineitem.l_partkey", "part.p_partkey")
    m.many_to_one("lineitem.l_suppkey", "supplier.s_suppkey").many_to_one("events.user_id", "customer.c_custkey")
    m.link_as("orders.order_date", "calendar.date_id", "order_day").link_as("lineitem.ship_date", "calendar.date_id", "ship_day")
    m.link_as("lineitem.ship_date", "calendar.date_id", "calendar_of_lines").link_as("orders.order_date", "calendar.date_id", "calendar_of_orders")
    m.dimension("segments").from_("customer").columns(c_custkey="c_custkey", segment="upper(c_mktsegment)", rich="case when c_acctbal > 5000 then 'yes' else 'no' end").primary_key("c_custkey")
    m.many_to_one("orders.o_custkey", "segments.c_custkey")
    m.fact("sales").grain("orders.o_orderkey").measure("revenue", sum_("o_totalprice")).measure("order_count", count()).measure("customers", count_distinct("o_custkey")).measure(
        "avg_price", avg("o_totalprice")
    ).measure("min_price", min_("o_totalprice")).measure("max_price", max_("o_totalprice")).measure("urgent", sum_("o_totalprice").where("o_orderpriority = '1-URGENT'")).measure(
        "urgent_count", count().where("o_orderpriority = '1-URGENT'")
    )
    m.fact("lines").from_("lineitem").measure("quantity", sum_("l_quantity")).measure("amount", sum_("l_extendedprice * (1 - l_discount)")).measure("line_count", count())
    m.fact("activity").from_("events").measure("event_count", count()).measure("total_value", sum_("value"))
    m.fact("enriched").from_("orders").include("customer", ["c_mktsegment", "c_acctbal"], prefix="cust_").column("price_band", "case when o_totalprice > 100000 then 'high' else 'low' end").window_column(
        "customer_order", "row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)"
    ).measure("orders_n", count()).measure("total", sum_("o_totalprice"))
    return m


def engine(spark: SparkSession, folder: str) -> Engine:
    return Engine(model(), reader(spark, folder))
