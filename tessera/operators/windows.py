"""Windows whose partitions may be large: GROUPS frames by slices of rows.

A window puts a partition's rows into one task. Here rows are cut into slices at bounds of (partition, order) that a sample
gives; the sample only says where to cut, all rows are read. A slice holds whole steps (rows of equal order). Steps before it
in its partition make the local dense rank a rank in the partition, and the steps that a frame reaches beyond a slice are
copied to it, so the frame is a range over ranks within the slice.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a slice, and sampled rows for each. Fewer rows than a slice aren't cut.
SLICE_ROWS, SAMPLED = 500_000, 100
_NAN = float("nan")
_AS_THEY_ARE = {"string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double"}


def _coded(column: Column, kind: str) -> Column | None:
    """As a value that passes unchanged through Python; equal only for equal values, and in their order."""
    if kind in _AS_THEY_ARE or kind.startswith("decimal"):
        return column
    return {"date": F.unix_date, "timestamp": F.unix_micros}.get(kind, lambda c: None)(column)


def _slice(keys: list[tuple[Column, bool, bool]], bounds: list[tuple], at: int = 0) -> Column:
    """The number of bounds at or before the keys, (column, descending, nulls first), by bisection of one key after another."""
    if not bounds:
        return F.lit(at)
    (c, down, first), v = keys[0], bounds[len(bounds) // 2][0]
    low = next(i for i, b in enumerate(bounds) if b[0] is v or b[0] == v)
    high = low + sum(1 for b in bounds[low:] if b[0] is v or b[0] == v)
    if v is None:
        before = F.lit(False) if first else c.isNotNull()
    else:
        before = F.coalesce(c > F.lit(v) if down else c < F.lit(v), F.lit(first))
    found = F.when(before, _slice(keys, bounds[:low], at))
    if keys[1:]:
        found = found.when(c.eqNullSafe(F.lit(v)), _slice(keys[1:], [b[1:] for b in bounds[low:high]], at + low))
    return found.otherwise(_slice(keys, bounds[high:], at + high))


def _needless(cells: list[tuple[tuple, list[tuple[int, int]]]], reach: int) -> set[int]:
    """Places of the bounds that would leave a slice with fewer of its partition's steps than a frame reaches."""
    gone = set()
    for _, slices in cells:
        steps = 0
        for (_, n), (after, _) in zip(slices, slices[1:]):
            steps += n
            if steps < reach:
                gone.add(after - 1)
            else:
                steps = 0
    return gone


def _reached(slices: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """For the slices (number, steps) of a partition: number, steps before it, and the slices whose frames reach its steps
    (number, from rank, to rank)."""
    ranks, before = [], 0
    for s, n in slices:
        ranks.append((s, before + 1, before + n))
        before += n
    return [(s, a - 1, [(t, max(a, x + start), min(z, y + end)) for t, x, y in ranks if t != s and max(a, x + start) <= min(z, y + end)]) for s, a, z in ranks]


class Sliced:
    """The slices of df by partition and order, (column, descending, nulls first) as given to sorted_by."""

    def __init__(self, df: DataFrame, partition: list[Column], order: list[tuple[Column, bool, bool | None]], most: int | None = None):
        self.df, self.partition, self.order, self.bounds = df, partition, order, []
        most = SLICE_ROWS if most is None else most
        kinds = [f.dataType.simpleString() for f in df.select(*[c.alias(f"_{i}") for i, c in enumerate([*partition, *[c for c, _, _ in order]])]).schema]
        self.by = [c.cast("string") if k == "timestamp_ntz" else _coded(c, k) for c, k in zip(partition, kinds)]
        self.keys = [(c, False, True) for c in self.by]
        for (c, down, first), kind in zip(order, kinds[len(partition) :]):
            # times without zone are cut by days, and nothing after them
            coded = F.unix_date(c.cast("date")) if kind == "timestamp_ntz" else _coded(c, kind)
            if coded is None:
                break
            self.keys.append((coded, bool(down), bool(first)))
            if kind == "timestamp_ntz":
                break
        if any(c is None for c in self.by) or not df._jdf.queryExecution().analyzed().deterministic():
            return
        rows = df.count()
        if rows <= most:
            return
        cuts = -(-rows // most)
        names = [f"_{i}" for i in range(len(self.keys))]
        sample = df.select(*[c.alias(n) for n, (c, _, _) in zip(names, self.keys)]).orderBy(F.rand(1)).limit(cuts * SAMPLED)
        found = sample.orderBy(*[getattr(F.col(n), f"{'desc' if down else 'asc'}_nulls_{'first' if first else 'last'}")() for n, (_, down, first) in zip(names, self.keys)]).collect()
        # one object for NaN, which Python finds equal only to itself as an object, and Spark to every NaN
        self.bounds = [b for b, _ in groupby(tuple(_NAN if x != x else x for x in found[i * len(found) // cuts]) for i in range(1, cuts))]

    def cells(self) -> list[tuple[tuple, list[tuple[int, int]]]]:
        """Partitions that lie in several slices, with their steps in each; there are fewer of them than slices."""
        by = [f"_frame_by_{i}" for i in range(len(self.by))]
        steps = self.df.select(*[c.alias(n) for n, c in zip(by, self.by)], _slice(self.keys, self.bounds).alias("_frame_slice"), *[c.alias(f"_frame_order_{i}") for i, (c, _, _) in enumerate(self.order)])
        # within slices, so that a task holds the steps of a slice and not those of whatever it reads
        counted = steps.repartition(len(self.bounds) + 1, "_frame_slice").distinct().groupBy(*by, "_frame_slice").agg(F.count("*").alias("_frame_n"))
        cut = counted.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_frame_slice", "_frame_n"))).alias("_frame_in")).where(F.size("_frame_in") > 1)
        return [(tuple(r[:-1]), [tuple(x) for x in r[-1]]) for r in cut.collect()]

    def copied(self, df: DataFrame, start: int, end: int, sort: list[Column]) -> DataFrame:
        """df, which has the rows of the slices, with _frame_slice, _frame_rank and _frame_own: each row in its slice and,
        not as its own, in those whose frames reach it."""
        cells = self.cells()
        gone = _needless(cells, max(0, -start) + max(0, end))
        bounds = [b for i, b in enumerate(self.bounds) if i not in gone]
        now = [i - sum(g < i for g in gone) for i in range(len(self.bounds) + 1)]
        rows = []
        for key, slices in cells:
            merged = [(s, sum(n for _, n in x)) for s, x in groupby(((now[s], n) for s, n in slices), key=lambda x: x[0])]
            rows += [(*key, *r) for r in _reached(merged, start, end)]
        by = [f"_frame_by_{i}" for i in range(len(self.by))]
        kinds = [f.dataType for f in self.df.select(*[c.alias(n) for n, c in zip(by, self.by)]).schema]
        to = T.ArrayType(T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
        schema = T.StructType([*[T.StructField(n, k) for n, k in zip(by, kinds)], T.StructField("_frame_in", T.IntegerType()), T.StructField("_frame_before", T.LongType()), T.StructField("_frame_to", to)])
        reached = F.broadcast(df.sparkSession.createDataFrame(rows, schema))
        on = F.col("_frame_from") == F.col("_frame_in")
        for n, c in zip(by, self.by):
            on = on & c.eqNullSafe(F.col(n))
        count = len(bounds) + 1
        df = df.withColumn("_frame_from", _slice(self.keys, bounds)).repartition(count, "_frame_from")
        df = df.withColumn("_frame_local", F.dense_rank().over(Window.partitionBy("_frame_from", *self.partition).orderBy(*sort))).join(reached, on, "left")
        df = df.withColumn("_frame_rank", F.col("_frame_local") + F.coalesce("_frame_before", F.lit(0)))
        others = F.transform(F.filter(F.col("_frame_to"), lambda x: F.col("_frame_rank").between(x["low"], x["high"])), lambda x: x["slice"])
        df = df.withColumn("_frame_slice", F.explode(F.concat(F.array("_frame_from"), F.coalesce(others, F.array().cast("array<int>")))))
        return df.withColumn("_frame_own", F.col("_frame_slice") == F.col("_frame_from")).drop("_frame_from", "_frame_local", "_frame_in", "_frame_before", "_frame_to", *by).repartition(count, "_frame_slice")
