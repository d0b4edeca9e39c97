"""A store of tables under one folder: definitions, constraints, views, changes, and the sinks of a model's entities.

Each change of a table writes a new version, a Parquet folder of its own, and then its definition (one JSON file), which
makes the version count. So a table can be read while it is rewritten, a lost job leaves the old version in force, and of
two writers of one version the second fails. The version before the present one is kept for those who still read it.

Parquet enforces no constraint: rows are checked by aggregates when they are written, all constraints of a table in as few
passes as there are keys and references.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, InvalidModel, UnknownEntity
from ..expr import compile, expression
from ..model import Dimension, Fact, Model, Table
from ..operators import build
from .catalog import Provider

#: Seconds of the units of a refresh interval.
UNITS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400, "week": 604_800}


def seconds(interval: str) -> int:
    """"4 hours", "1 day", "90 seconds"."""
    found = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", interval.lower())
    if not found or found[2] not in UNITS:
        raise InvalidModel(f"no interval: {interval}")
    return int(found[1]) * UNITS[found[2]]


@dataclass
class ColumnDef:
    """type, as in Spark SQL; default: an expression; identity: numbered on insert, after the greatest there is."""

    type: str
    nullable: bool = True
    default: str | None = None
    identity: bool = False


@dataclass
class Constraint:
    """kind: "primary_key", "unique", "check", "foreign_key" or "not_null". Nulls break a primary key, meet a check, and are
    equal to nothing in a unique or foreign key."""

    name: str
    kind: str
    columns: list[str] = field(default_factory=list)
    condition: str | None = None
    table: str | None = None
    references: list[str] = field(default_factory=list)


def primary_key(*columns: str, name: str = "pk") -> Constraint:
    return Constraint(name, "primary_key", list(columns))


def unique(*columns: str, name: str | None = None) -> Constraint:
    return Constraint(name or "unique_" + "_".join(columns), "unique", list(columns))


def check(condition: str, name: str = "check") -> Constraint:
    return Constraint(name, "check", condition=condition)


def foreign_key(columns: list[str], table: str, references: list[str], name: str | None = None) -> Constraint:
    return Constraint(name or "fk_" + "_".join(columns), "foreign_key", columns, None, table, references)


class Store(Provider):
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.views = spark, folder.rstrip("/"), {}

    # --- files ----------------------------------------------------------------------------------------------------------

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._path(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _version(self, name: str) -> int:
        return max((int(n[1:-5]) for n in self._names(name) if re.fullmatch(r"v\d+\.json", n)), default=0)

    def definition(self, name: str) -> dict:
        version = self._version(name)
        if not version:
            raise UnknownEntity(f"no such table: {name}")
        fs, path = self._path(name, f"v{version}.json")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        made = json.loads(text)
        made["columns"] = {n: ColumnDef(**c) for n, c in made["columns"].items()}
        made["constraints"] = [Constraint(**c) for c in made["constraints"]]
        return made

    def _commit(self, name: str, df: DataFrame, columns: dict, constraints: list, **more) -> None:
        version = self._version(name) + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v{version}")
        text = json.dumps({"columns": {n: asdict(c) for n, c in columns.items()}, "constraints": [asdict(c) for c in constraints], **more})
        fs, path = self._path(name, f"v{version}.json")
        stream = fs.create(path, False)
        stream.write(text.encode())
        stream.close()
        for old in self._names(name):
            if int(re.match(r"v(\d+)", old)[1]) < version - 1:
                fs, path = self._path(name, old)
                fs.delete(path, True)

    # --- Provider -------------------------------------------------------------------------------------------------------

    def read(self, name: str) -> DataFrame:
        if name in self.views:
            return self.views[name]()
        schema = ", ".join(f"`{n}` {c.type}" for n, c in self.definition(name)["columns"].items())
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v{self._version(name)}")

    def tables(self) -> list[str]:
        return sorted({*(n for n in self._names() if self._version(n)), *self.views})

    def constraints(self, name: str) -> list[Constraint]:
        return self.definition(name)["constraints"]

    # --- definitions ----------------------------------------------------------------------------------------------------

    def create_table(self, name: str, columns: dict[str, ColumnDef | str] | None = None, constraints: list[Constraint] | None = None, as_: DataFrame | None = None, if_not_exists: bool = False) -> None:
        """With columns, with rows (as_), or both: then rows are cast to the columns' types."""
        if self._version(name):
            if if_not_exists:
                return
            raise InvalidModel(f"there is a table {name}")
        made = {n: ColumnDef(c) if isinstance(c, str) else c for n, c in (columns or {f.name: f.dataType.simpleString() for f in as_.schema}).items()}
        empty = self.spark.createDataFrame([], ", ".join(f"`{n}` {c.type}" for n, c in made.items()))
        rows = empty if as_ is None else self._shaped(as_, made, empty)
        self._write(name, rows, made, constraints or [])

    def _shaped(self, rows: DataFrame, columns: dict[str, ColumnDef], there: DataFrame) -> DataFrame:
        """Rows with all columns, in order, cast; missing ones take their default or are numbered."""
        out = []
        for n, c in columns.items():
            if n in rows.columns:
                value = F.col(f"`{n}`")
            elif c.identity:
                # each task numbers its rows in a range of its own: ascending and distinct, with gaps
                value = F.lit((there.agg(F.max(n)).collect()[0][0] or 0) + 1) + F.monotonically_increasing_id()
            else:
                value = compile(expression(c.default), build.by_name(rows)) if c.default is not None else F.lit(None)
            out.append(value.cast(c.type).alias(n))
        return rows.select(*out)

    def _write(self, name: str, rows: DataFrame, columns: dict, constraints: list, **more) -> None:
        self._check(name, rows, columns, constraints)
        self._commit(name, rows, columns, constraints, **more)

    def _check(self, name: str, rows: DataFrame, columns: dict, constraints: list) -> None:
        broken = self._violations(name, rows, columns, constraints).where("violations > 0").collect()
        if broken:
            raise ConstraintViolation(f"{name}: " + ", ".join(f"{r['constraint']} ({r['violations']} rows)" for r in broken))

    def _violations(self, name: str, rows: DataFrame, columns: dict, constraints: list) -> DataFrame:
        """(constraint, violations): one pass for nulls and checks, and one for each key and reference."""
        missing = [(f"{n} not null", F.col(f"`{n}`").isNull()) for n, c in columns.items() if not c.nullable]
        parts = []
        for c in constraints:
            if c.kind == "check":
                missing.append((c.name, ~F.coalesce(compile(expression(c.condition), build.by_name(rows)), F.lit(True))))
            elif c.kind == "not_null":
                missing += [(c.name, F.col(f"`{n}`").isNull()) for n in c.columns]
            elif c.kind == "foreign_key":
                there = rows if c.table == name else self.read(c.table)
                there = there.select(*[F.col(f"`{r}`").alias(k) for r, k in zip(c.references, c.columns, strict=True)]).distinct()
                parts.append(rows.select(*c.columns).dropna("any").join(there, c.columns, "left_anti").agg(F.count("*").alias("n")).select(F.lit(c.name).alias("constraint"), F.col("n").alias("violations")))
            else:
                keyed = rows.select(*c.columns).dropna("any").groupBy(*c.columns).agg(F.count("*").alias("n"))
                parts.append(keyed.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit(c.name).alias("constraint"), F.col("n").alias("violations")))
                if c.kind == "primary_key":
                    missing += [(f"{c.name}: {n} not null", F.col(f"`{n}`").isNull()) for n in c.columns]
        if missing:
            one = rows.agg(*[F.count(F.when(bad, 1)).alias(f"n{i}") for i, (_, bad) in enumerate(missing)])
            named = F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(f"n{i}").alias("violations")) for i, (n, _) in enumerate(missing)])
            parts.append(one.select(F.explode(named).alias("r")).select("r.*"))
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else self.spark.createDataFrame([], "constraint string, violations long")

    def violations(self, name: str) -> DataFrame:
        made = self.definition(name)
        return self._violations(name, self.read(name), made["columns"], made["constraints"])

    def add_column(self, name: str, column: str, definition: ColumnDef | str) -> None:
        made = self.definition(name)
        columns = {**made["columns"], column: ColumnDef(definition) if isinstance(definition, str) else definition}
        rows = self.read(name)
        self._write(name, self._shaped(rows, columns, rows), columns, made["constraints"])

    def drop_column(self, name: str, column: str) -> None:
        made = self.definition(name)
        if used := [c.name for c in made["constraints"] if column in c.columns]:
            raise InvalidModel(f"{column} is part of {', '.join(used)}")
        columns = {n: c for n, c in made["columns"].items() if n != column}
        self._write(name, self.read(name).drop(column), columns, made["constraints"])

    def rename_column(self, name: str, column: str, to: str) -> None:
        made, new = self.definition(name), lambda n: to if n == column else n
        constraints = [Constraint(c.name, c.kind, [new(n) for n in c.columns], c.condition, c.table, c.references) for c in made["constraints"]]
        self._write(name, self.read(name).withColumnRenamed(column, to), {new(n): c for n, c in made["columns"].items()}, constraints)

    def alter_type(self, name: str, column: str, to: str) -> None:
        made = self.definition(name)
        old = made["columns"][column]
        columns = {**made["columns"], column: ColumnDef(to, old.nullable, old.default, old.identity)}
        self._write(name, self._shaped(self.read(name), columns, self.read(name)), columns, made["constraints"])

    def add_constraint(self, name: str, constraint: Constraint) -> None:
        """The rows must meet it."""
        made = self.definition(name)
        self._write(name, self.read(name), made["columns"], [*made["constraints"], constraint])

    def drop_constraint(self, name: str, constraint: str) -> None:
        made = self.definition(name)
        self._commit(name, self.read(name), made["columns"], [c for c in made["constraints"] if c.name != constraint])

    def truncate(self, name: str) -> None:
        made = self.definition(name)
        self._commit(name, self.read(name).limit(0), made["columns"], made["constraints"])

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if not self._version(name):
            if if_exists:
                return
            raise UnknownEntity(f"no such table: {name}")
        fs, path = self._path(name)
        fs.delete(path, True)

    def create_view(self, name: str, of: Callable[[], DataFrame], replace: bool = False) -> None:
        """of makes the view's rows anew at each read, and so follows the tables that it reads."""
        if name in self.views and not replace:
            raise InvalidModel(f"there is a view {name}")
        self.views[name] = of

    def create_materialized_view(self, name: str, of: Callable[[], DataFrame]) -> Callable[[], None]:
        """A table of the view's rows; what comes back refreshes it."""

        def refresh() -> None:
            rows = of()
            self._commit(name, rows, {f.name: ColumnDef(f.dataType.simpleString()) for f in rows.schema}, [])

        refresh()
        return refresh

    def drop_view(self, name: str) -> None:
        if self.views.pop(name, None) is None:
            raise UnknownEntity(f"no such view: {name}")

    # --- changes --------------------------------------------------------------------------------------------------------

    def _replace(self, name: str, rows: DataFrame) -> None:
        made = self.definition(name)
        self._write(name, rows.select(*made["columns"]), made["columns"], made["constraints"])

    def insert(self, name: str, rows: DataFrame, on_conflict: str | None = None, key: list[str] | None = None) -> DataFrame:
        """The rows as they came in (RETURNING): with defaults, and with on_conflict "nothing" only the new ones."""
        there, made = self.read(name), self.definition(name)
        rows = self._shaped(rows, made["columns"], there)
        came = rows.join(there.select(*key), key, "left_anti").select(*made["columns"]) if on_conflict == "nothing" else rows
        self._replace(name, build.insert(there, rows, on_conflict, key))
        return came

    def update(self, name: str, values: dict[str, str], where: str | None = None) -> DataFrame:
        """The changed rows, as they are now."""
        there = self.read(name)
        hit = there.where(compile(expression(where), build.by_name(there))) if where else there
        self._replace(name, build.update(there, values, where))
        return build.update(hit, values)

    def delete(self, name: str, where: str | None = None) -> DataFrame:
        """The rows that went."""
        there = self.read(name)
        hit = there.where(compile(expression(where), build.by_name(there))) if where else there
        self._replace(name, build.delete(there, where) if where else there.limit(0))
        return hit

    def merge(self, name: str, source: DataFrame, on: list[str], clauses: Callable[[build.Merge], build.Merge]) -> None:
        self._replace(name, clauses(build.Merge(self.read(name), source, on)).frame())


class Sinks:
    """Writes a model's entities and reports to a store, as each says: a view, a table written anew, an incremental load, or
    a snapshot with history."""

    def __init__(self, model: Model, frame: Callable[[str], DataFrame], store: Store):
        self.model, self.frame, self.store = model, frame, store

    def build(self, name: str, kind: str | None = None) -> DataFrame:
        """kind: "view", "table", "incremental" or "snapshot"; without, what the entity declares: its strategy, or a table if
        it is materialised, else a view."""
        entity = self.model.entity(name)
        if not isinstance(entity, Fact | Dimension | Table):
            raise InvalidModel(f"{name} is no fact, dimension or table")
        strategy = getattr(entity, "strategy", {}) or {}
        kind = kind or strategy.get("kind") or ("table" if getattr(entity, "is_materialized", True) else "view")
        target = getattr(entity, "target_table_name", None) or getattr(entity, "target_table", None)
        target = target if isinstance(target, str) else name
        if kind == "view":
            self.store.create_view(target, lambda: self.frame(name), replace=True)
            return self.store.read(target)
        rows = self.frame(name)
        there = self.store.read(target) if self.store._version(target) else None
        if kind == "incremental" and there is not None:
            rows = build.incremental(there, rows, strategy["unique_key"], strategy["incremental_key"], strategy.get("lookback", 0))
        elif kind == "snapshot":
            rows = build.snapshot(there, rows, strategy["unique_key"], strategy["updated_at"])
        elif kind not in ("table", "incremental"):
            raise InvalidModel(f"{name}: no such sink: {kind}")
        self.store._commit(target, rows, {f.name: ColumnDef(f.dataType.simpleString()) for f in rows.schema}, [])
        return self.store.read(target)

    def report(self, name: str, rows: Callable[[], DataFrame], refresh: str, now: float | None = None) -> tuple[DataFrame, bool]:
        """A report's table, and whether it was made now: it is made anew once ``refresh`` ("4 hours") has passed."""
        now = time.time() if now is None else now
        if self.store._version(name) and now - self.store.definition(name).get("built_at", 0) < seconds(refresh):
            return self.store.read(name), False
        made = rows()
        self.store._commit(name, made, {f.name: ColumnDef(f.dataType.simpleString()) for f in made.schema}, [], built_at=now)
        return self.store.read(name), True
