"""The entry point: a model, a way to read its tables, and queries by value or by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .errors import UnknownQuery
from .lineage import LineageGraph
from .model import Model
from .plans.query import Pivot, Planner, Query, Report, plan_pivot, plan_report

#: Rows of a preview.
PREVIEW_ROWS = 10_000


def parquet_reader(spark: SparkSession, folder: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


def table_reader(spark: SparkSession, schema: str = "default") -> Callable[[str], DataFrame]:
    return lambda name: spark.table(name if "." in name else f"{schema}.{name}")


class Engine:
    def __init__(self, model: Model, read: Callable[[str], DataFrame]):
        self.model, self.planner = model, Planner(model, read)

    def with_lineage(self) -> Engine:
        """Checks first that no column depends on itself."""
        LineageGraph(self.model).check()
        return self

    def execute(self, query: Query | Report | Pivot) -> DataFrame:
        if isinstance(query, Report):
            return plan_report(self.planner, query)
        return plan_pivot(self.planner, query) if isinstance(query, Pivot) else self.planner.plan(query)

    def execute_named(self, name: str) -> DataFrame:
        for kind in (self.model.queries, self.model.reports, self.model.pivots):
            if name in kind:
                return self.execute(kind[name])
        raise UnknownQuery(f"no such query: {name}")

    def list_queries(self) -> list[str]:
        return [*self.model.queries, *self.model.reports, *self.model.pivots]

    def explain(self, query: Query | Report | Pivot) -> str:
        return self.execute(query)._jdf.queryExecution().toString()

    def preview(self, query: Query | Report | Pivot, rows: int = PREVIEW_ROWS) -> list:
        """At most so many rows, on the driver."""
        return self.execute(query).limit(rows).collect()
