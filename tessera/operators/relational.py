"""A relational builder over DataFrames: projection, filters, joins, grouping, windows, set operations, subqueries.

    rel(orders, "o").join(rel(customer, "c"), "o.o_custkey = c.c_custkey").where("c.c_acctbal > 0").select("o.o_orderkey")

Text is SQL of the expression language; each call returns a new relation, and frame() is the DataFrame.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..expr import Col, Expr, Over, compile, expression, sorted_by
from .windows import Sliced

HOWS = {"inner": "inner", "left": "left", "right": "right", "full": "full_outer", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


class Relation:
    def __init__(self, df: DataFrame):
        self.df = df

    def _resolve(self, c: Col) -> Column:
        return F.col(f"{c.entity}.`{c.name}`" if c.entity else f"`{c.name}`")

    def column(self, e: str | Expr) -> Column:
        made = expression(e)
        column = compile(made, self._resolve)
        return column.alias(made.name) if isinstance(made, Col) else column

    def frame(self) -> DataFrame:
        return self.df

    def alias(self, name: str) -> Relation:
        return Relation(self.df.alias(name))

    def select(self, *columns: str | Expr, **named: str | Expr) -> Relation:
        """Columns, "*" or "t.*", and name=expression."""
        plain = [F.col(c) if isinstance(c, str) and c.endswith("*") else self.column(c) for c in columns]
        if any(isinstance(expression(e), Over) and expression(e).frame and expression(e).frame[0] == "groups" for e in named.values()):
            return self._with_groups(plain, named)
        return Relation(self.df.select(*plain, *[compile(expression(e), self._resolve).alias(n) for n, e in named.items()]))

    def _with_groups(self, plain: list[Column], named: dict) -> Relation:
        """GROUPS frames: rows of equal order are one step, so the frame is a range over their dense rank. Large tables are
        cut into slices; with a frame that has no end on a side, a partition stays in one task."""
        df, out, windows = self.df, [], {}
        for i, (n, e) in enumerate(named.items()):
            made = expression(e)
            if isinstance(made, Over) and made.frame and made.frame[0] == "groups":
                windows.setdefault((made.partition, made.order, made.frame[1:]), {})[f"_frame_{i}"] = made.call
                out.append(F.col(f"_frame_{i}").alias(n))
            else:
                out.append(compile(made, self._resolve).alias(n))
        for (partition, order, frame), calls in windows.items():
            by, keys = [compile(p, self._resolve) for p in partition], [(compile(x, self._resolve), down, first) for x, down, first in order]
            sliced = Sliced(self.df, by, keys) if None not in frame and order else None
            sort = [sorted_by(*k) for k in keys]
            if sliced and sliced.bounds:
                df, within = sliced.copied(df, *frame, sort), (Col("_frame_slice"), *partition)
            else:
                df, within = df.withColumn("_frame_rank", F.dense_rank().over(Window.partitionBy(*by).orderBy(*sort))), partition
            df = df.select("*", *[compile(Over(call, within, ((Col("_frame_rank"), False, None),), ("range", *frame)), self._resolve).alias(n) for n, call in calls.items()])
            df = df.where("_frame_own").drop("_frame_own", "_frame_slice", "_frame_rank") if sliced and sliced.bounds else df.drop("_frame_rank")
        return Relation(df.select(*plain, *out).drop(*(set(df.columns) - set(self.df.columns))))

    def where(self, *conditions: str | Expr) -> Relation:
        return Relation(reduce(lambda df, c: df.where(compile(expression(c), self._resolve)), conditions, self.df))

    def join(self, other: Relation, on: str | Expr | None = None, how: str = "inner") -> Relation:
        if how == "cross":
            return Relation(self.df.crossJoin(other.df))
        return Relation(self.df.join(other.df, compile(expression(on), self._resolve), HOWS[how]))

    def group_by(self, *keys: str | Expr, having: str | Expr | None = None, **aggregates: str | Expr) -> Relation:
        grouped = self.df.groupBy(*[self.column(k) for k in keys])
        out = Relation(grouped.agg(*[compile(expression(e), self._resolve).alias(n) for n, e in aggregates.items()]))
        return out.where(having) if having is not None else out

    def grouping_sets(self, keys: list[str], kind: str | list[list[str]], **aggregates: str) -> Relation:
        """kind: "rollup", "cube", or the sets themselves; grouping(key) among the aggregates tells whether a key is left out
        of a row's set (1) or not (0)."""
        flags = {n: m[1] for n, e in aggregates.items() if isinstance(e, str) and (m := re.fullmatch(r"\s*grouping\((\w+)\)\s*", e, re.IGNORECASE))}
        sums = [F.grouping(flags[n]).cast("long").alias(n) if n in flags else compile(expression(e), self._resolve).alias(n) for n, e in aggregates.items()]
        if isinstance(kind, str):
            return Relation(getattr(self.df, kind)(*keys).agg(*sums))
        return Relation(self.df.groupingSets([[F.col(k) for k in s] for s in kind], *[F.col(k) for k in keys]).agg(*sums).select(*keys, *aggregates))

    def order_by(self, *keys: str) -> Relation:
        """"x", "x desc", "x desc nulls first"; nulls are last unless said otherwise."""
        out = []
        for k in keys:
            words = k.split()
            out.append(sorted_by(self.column(words[0]), "desc" in words[1:], "first" in words[1:]))
        return Relation(self.df.orderBy(*out))

    def limit(self, n: int, offset: int = 0) -> Relation:
        return Relation((self.df.offset(offset) if offset else self.df).limit(n))

    def distinct(self) -> Relation:
        return Relation(self.df.distinct())

    def top_per_group(self, n: int, partition: list[str], order: list[str]) -> Relation:
        """QUALIFY row_number() <= n; Spark keeps only n rows of each key before it shuffles."""
        w = Window.partitionBy(*[self.column(p) for p in partition]).orderBy(*[sorted_by(self.column(o.split()[0]), "desc" in o.split()[1:]) for o in order])
        return Relation(self.df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n"))

    def union(self, other: Relation) -> Relation:
        return Relation(self.df.union(other.df).distinct())

    def union_all(self, other: Relation) -> Relation:
        return Relation(self.df.union(other.df))

    def intersect(self, other: Relation) -> Relation:
        return Relation(self.df.intersect(other.df))

    def intersect_all(self, other: Relation) -> Relation:
        return Relation(self.df.intersectAll(other.df))

    def except_(self, other: Relation) -> Relation:
        return Relation(self.df.subtract(other.df))

    def except_all(self, other: Relation) -> Relation:
        return Relation(self.df.exceptAll(other.df))

    def where_in(self, column: str, other: Relation) -> Relation:
        """column IN (SELECT the only column of other)."""
        key = other.df.columns[0]
        return Relation(self.df.join(other.df.select(F.col(key).alias("_in")).distinct(), self.column(column) == F.col("_in"), "left_semi"))

    def where_not_in(self, column: str, other: Relation) -> Relation:
        """column NOT IN (...): no rows at all if the other has a null, none with a null column unless the other is empty.
        The nulls are counted beside an ordinary anti join, which runs as a hash or sort join where NOT IN would not."""
        key = other.df.columns[0]
        few = other.df.agg(F.count("*").alias("_all"), F.count(key).alias("_some"))
        rest = self.df.join(other.df.select(F.col(key).alias("_in")).distinct(), self.column(column) == F.col("_in"), "left_anti").crossJoin(F.broadcast(few))
        keep = (F.col("_all") == 0) | ((F.col("_all") == F.col("_some")) & self.column(column).isNotNull())
        return Relation(rest.where(keep).drop("_all", "_some"))

    def with_scalar(self, name: str, other: Relation) -> Relation:
        """A scalar subquery's value as a column: null if the other has no row, an error if it has several. The other is
        aggregated to one row, which is what is broadcast."""
        key = other.df.columns[0]
        one = other.df.agg(F.first(key).alias("_value"), F.count("*").alias("_n"))
        several = F.raise_error(F.lit("a scalar subquery gave several rows")).cast(other.df.schema[key].dataType)
        return Relation(self.df.crossJoin(F.broadcast(one.select(F.when(F.col("_n") > 1, several).otherwise(F.col("_value")).alias(name)))))


def rel(df: DataFrame, alias: str | None = None) -> Relation:
    return Relation(df.alias(alias) if alias else df)


def recursive(spark, start: str, step: str, columns: list[str], final: str) -> DataFrame:
    """WITH RECURSIVE r(columns) AS (start UNION ALL step) final; all three are Spark SQL that may name r."""
    return spark.sql(f"WITH RECURSIVE r({', '.join(columns)}) AS ({start} UNION ALL {step}) {final}")
