"""Where tables come from, and what is known of them: listing, sampling, column statistics, value overlap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a query returns, of a sample, sample values of a column, distinct values of an overlap.
MAX_ROWS, SAMPLE_ROWS, SAMPLE_VALUES, OVERLAP_VALUES = 10_000, 10, 5, 1_000


class Provider:
    """A place with tables. Subclasses say how one is read and which there are."""

    def read(self, name: str) -> DataFrame:
        raise NotImplementedError

    def tables(self) -> list[str]:
        raise NotImplementedError

    def columns(self, name: str) -> list[tuple[str, str, bool]]:
        """(name, type, nullable)."""
        return [(f.name, f.dataType.simpleString(), f.nullable) for f in self.read(name).schema]

    def row_count(self, name: str) -> int:
        return self.read(name).count()

    def sample(self, name: str, rows: int = SAMPLE_ROWS) -> list:
        return self.read(name).limit(rows).collect()


class ParquetFolder(Provider):
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tables(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(f.getPath().getName()[:-8] for f in found if f.getPath().getName().endswith(".parquet"))


class SessionCatalog(Provider):
    def __init__(self, spark: SparkSession, schema: str = "default"):
        self.spark, self.schema = spark, schema

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name if "." in name else f"{self.schema}.{name}")

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.schema))


class Jdbc(Provider):
    """Tables of a database; partition_column, with its bounds, deals a read out to several connections."""

    def __init__(self, spark: SparkSession, url: str, names: list[str] | None = None, **options):
        self.spark, self.url, self.names, self.options = spark, url, names or [], options

    def read(self, name: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options).load()

    def tables(self) -> list[str]:
        return list(self.names)


PROVIDERS = {"parquet": ParquetFolder, "catalog": SessionCatalog, "jdbc": Jdbc}


def execute(spark: SparkSession, sql: str, args: list | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """A query with positional arguments (?), cut at max_rows."""
    return spark.sql(sql, args=args or []).limit(max_rows)


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, total_count, distinct_count, null_count, is_unique, of each column, in one pass over the table.

    is_unique: there are values, and as many different ones as values."""
    names = columns or df.columns
    sums = [F.count("*").alias("total")]
    for i, c in enumerate(names):
        sums += [F.countDistinct(F.col(f"`{c}`")).alias(f"d{i}"), F.count(F.col(f"`{c}`")).alias(f"n{i}")]
    one = df.select(*[F.col(f"`{c}`") for c in names]).agg(*sums)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("total").alias("total_count"), F.col(f"d{i}").alias("distinct_count"), (F.col("total") - F.col(f"n{i}")).alias("null_count"), ((F.col(f"d{i}") == F.col(f"n{i}")) & (F.col(f"n{i}") > 0)).alias("is_unique")) for i, c in enumerate(names)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def sample_values(df: DataFrame, column: str, n: int = SAMPLE_VALUES) -> list:
    return [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(n).collect()]


@dataclass
class Overlap:
    """Of the left column's sampled values, how many the right column has."""

    sampled: int
    matched: int
    right_unique: bool
    right_is_superset: bool

    @property
    def share(self) -> float:
        return self.matched / self.sampled if self.sampled else 0.0


def value_overlap(left: DataFrame, left_column: str, right: DataFrame, right_column: str, n: int = OVERLAP_VALUES) -> DataFrame:
    """sampled, matched, overlap_pct, right_is_superset, right_unique: the first n distinct values of the left column in
    order, looked up in the right one."""
    some = left.select(F.col(left_column).alias("v")).where("v is not null").distinct().orderBy("v").limit(n)
    there = right.select(F.col(right_column).alias("w")).where("w is not null")
    met = some.join(there.distinct(), F.col("v") == F.col("w"), "left").agg(F.count("*").alias("sampled"), F.count("w").alias("matched"))
    unique = there.agg((F.count("w") == F.countDistinct("w")).alias("right_unique"))
    share = F.when(F.col("sampled") > 0, F.round(100.0 * F.col("matched") / F.col("sampled"), 4)).otherwise(0.0)
    return met.crossJoin(unique).select("sampled", "matched", share.alias("overlap_pct"), (F.col("sampled") == F.col("matched")).alias("right_is_superset"), "right_unique")


def overlap(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> Overlap:
    r = value_overlap(left, left_column, right, right_column).collect()[0]
    return Overlap(r["sampled"], r["matched"], r["right_unique"], r["right_is_superset"])
