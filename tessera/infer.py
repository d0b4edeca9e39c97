"""Relationship inference: signals of names, types, keys and declared constraints, weighed together; statistics from Spark; and
table classification."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .model import Relationship
from .sources.catalog import column_stats, overlap
from .types import joinable

# Fixed values: (rule, pattern of the column with the entity's name as group 1, score).
RULES = [
    ("fk_prefix", r"fk_(\w+)_id", 0.92),
    ("fk_simple_prefix", r"fk_(\w+)", 0.88),
    ("suffix_id", r"(\w+)_id", 0.85),
    ("suffix_key", r"(\w+)_key", 0.80),
    ("suffix_code", r"(\w+)_code", 0.75),
    ("suffix_ref", r"(\w+)_ref", 0.75),
    ("suffix_num", r"(\w+)_num", 0.70),
    ("suffix_no", r"(\w+)_no", 0.70),
    ("semantic_ref", r"ref_(\w+)", 0.70),
]
# The same for tables named dim_*, whose key has the column's own name.
DIM_RULES = [("suffix_id_dim", r"(\w+)_id", 0.82), ("suffix_key_dim", r"(\w+)_key", 0.78)]
# Weights of the kinds of signals, of unknown kinds, the least confidence, the greatest penalty; and presets.
WEIGHTS = {"fk": 1.0, "naming": 0.85, "type": 0.75, "stats": 0.65, "unique": 0.70, "overlap": 0.80, "negative": 0.90, "convention": 0.60, "learned": 0.55}
OTHER_WEIGHT, LEAST_CONFIDENCE, MOST_PENALTY = 0.5, 0.5, 0.8
PRESETS = {
    "default": (WEIGHTS, LEAST_CONFIDENCE, MOST_PENALTY),
    "high_precision": (WEIGHTS | {"naming": 0.75, "stats": 0.55}, 0.7, 0.9),
    "high_recall": (WEIGHTS | {"naming": 0.90, "stats": 0.75}, 0.4, 0.6),
}
# Integer types by width, with the score of a narrower target; other scores of type pairs.
INTEGERS = {"tinyint": (1, 0.5), "smallint": (2, 0.7), "int": (3, 0.6), "bigint": (4, 0.5)}
WIDENED, MISMATCH, DEFINITE = 0.9, 0.3, 0.9
# An overlap that suggests a foreign key, in percent; the greatest join factor of a density, the one of many to many; scores of a column
# that has the name of another table's primary key, unique or key-like column.
VERDICT_PCT, MOST_FACTOR, MANY_FACTOR, SAME_NAME = 90.0, 10.0, 2.0, {"primary": 1.8, "unique": 1.6, "named": 1.5}
# Fixed values: (pattern of a column's name, penalty).
NEGATIVE = [
    (r"(created|updated|modified|deleted)(_at)?", 0.95), (r"(is|has)_\w+", 0.95), (r"\w+_at", 0.9), (r"\w+_timestamp", 0.9), (r"\w+_hash", 0.9),
    (r"checksum", 0.9), (r"etag", 0.9), (r"\w+_flag", 0.9), (r"(enabled|disabled|active|inactive)", 0.85), (r"(version|revision)", 0.85),
    (r"\w+_count", 0.85), (r"\w+_time", 0.8), (r"sequence", 0.8), (r"\w+_date", 0.7), (r"row_id", 0.7), (r"\w+_(amount|total)", 0.7),
    (r"\w+_by", 0.6), (r"(status|state|type)", 0.5),
]
# Shares of overlapping values, and what they add to a score.
OVERLAP_STEPS = [(0.95, 0.15), (0.80, 0.10), (0.50, 0.05), (0.30, 0.0), (0.10, -0.10), (0.0, -0.30)]
MINIMUM, CAP = 0.50, 0.95


def singular(name: str) -> str:
    for end, instead in (("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh")):
        if name.endswith(end) and len(name) > len(end) + 1:
            return name[: -len(end)] + instead
    return name[:-1] if name.endswith("s") and not name.endswith(("ss", "us", "is")) else name


def plural(name: str) -> str:
    if name.endswith("y") and name[-2:-1] not in "aeiou":
        return name[:-1] + "ies"
    return name + ("es" if name.endswith(("s", "x", "ch", "sh")) else "s")


def base_name(table: str) -> str:
    return singular(re.sub(r"^(dim|fact|fct|stg|src|tbl)_", "", table.lower()))


def penalty(column: str) -> float:
    return max((p for pattern, p in NEGATIVE if re.fullmatch(pattern, column.lower())), default=0.0)


@dataclass
class Candidate:
    from_table: str
    from_column: str
    to_table: str
    to_column: str
    rule: str
    score: float

    def relationship(self, cardinality: str = "many_to_one") -> Relationship:
        return Relationship(self.from_table, self.from_column, self.to_table, self.to_column, cardinality, None, f"inferred:{self.rule}", self.score)


@dataclass(frozen=True)
class Signal:
    """kind: a key of WEIGHTS. A negative score is a penalty. Scores count up to 1."""

    kind: str
    score: float
    weight: float = 1.0


def aggregate(signals: list[Signal], preset: str = "default") -> float:
    """Confidence: a definite foreign key's own; else the weighted mean of the positive scores less the weighted sum of the
    negative ones, as far as the greatest penalty, within 0 and 1."""
    weights, _, most = PRESETS[preset]
    definite = [x.score for x in signals if x.kind == "fk" and x.score > DEFINITE]
    if definite:
        return min(1.0, definite[0])
    weight = lambda x: x.weight * weights.get(x.kind, OTHER_WEIGHT)
    good, bad = [x for x in signals if x.score > 0], [x for x in signals if x.score < 0]
    mean = sum(min(1.0, x.score) * weight(x) for x in good) / sum(map(weight, good)) if good else 0.0
    return max(0.0, min(1.0, mean - min(most, sum(-x.score * weight(x) for x in bad))))


def type_score(start, end) -> float:
    """How well a column's Spark type fits its target's; 0: not at all."""
    a, b = start.simpleString(), end.simpleString()
    if a == b:
        return 1.0
    if a in INTEGERS and b in INTEGERS:
        return WIDENED if INTEGERS[b][0] > INTEGERS[a][0] else INTEGERS[a][1]
    decimals = [x.startswith("decimal") for x in (a, b)]
    if all(decimals):
        return 0.9 if start.scale == end.scale else 0.7
    if any(decimals):
        other = b if decimals[0] else a
        return (0.5 if decimals[0] else 0.6) if other in INTEGERS else 0.4 if other in ("float", "double") else 0.0
    text = sorted(x.partition("(")[0] for x in (a, b))
    if set(text) <= {"string", "varchar", "char"}:
        return {("char", "char"): 0.9, ("char", "string"): 0.85, ("char", "varchar"): 0.8}.get(tuple(text), 0.95)
    return {("float", "double"): 0.9, ("double", "float"): 0.7, ("timestamp", "timestamp_ntz"): 0.8, ("timestamp_ntz", "timestamp"): 0.8}.get((a, b), 0.0)


def type_signal(start, end) -> Signal:
    score = type_score(start, end)
    return Signal("type", score or -MISMATCH)


def _named(name: str, column: str, other: str, key: str) -> tuple[str, float] | None:
    """The rule, and its score, by which a column's name leads to the key of another table (or of its own)."""
    column, target = column.lower(), base_name(other)
    if other == name:
        return ("parent_pattern", 0.75) if re.fullmatch(r"parent_\w+", column) else None
    if other.lower().startswith("dim_") and column == key.lower():
        for rule, pattern, score in DIM_RULES:
            if (m := re.fullmatch(pattern, column)) and singular(m[1]) == target:
                return rule, score
    if column == key.lower():
        return "pk_match", 0.65
    for rule, pattern, score in RULES:
        if (m := re.fullmatch(pattern, column)) and singular(m[1]) == target:
            return rule, score
    return ("table_embed", 0.60) if target in column.split("_") and column != target else None


def candidates(tables: dict[str, DataFrame], keys: dict[str, str]) -> list[Candidate]:
    """By names and types alone: column of one table to the key of another. keys: each table's key column. The best rule's
    score less half of the name's penalty at most; see inferred for all signals weighed together."""
    out = []
    for name, df in tables.items():
        for column in df.schema:
            if column.name == keys.get(name):
                continue
            for other, key in keys.items():
                if not joinable(column.dataType, tables[other].schema[key].dataType):
                    continue
                if found := _named(name, column.name, other, key):
                    score = max(0.0, min(CAP, found[1]) - min(penalty(column.name), 0.5) * (found[0] not in ("suffix_id", "fk_prefix")))
                    if score >= MINIMUM:
                        out.append(Candidate(name, column.name, other, key, found[0], round(score, 4)))
    return sorted(out, key=lambda c: (-c.score, c.from_table, c.from_column, c.to_table))


def inferred(
    tables: dict[str, DataFrame], keys: dict[str, str], uniques: dict[str, list[str]] | None = None, foreign_keys: list[tuple[str, str, str, str]] = (), preset: str = "default"
) -> list[Candidate]:
    """All signals of each pair of columns, aggregated: declared foreign keys, names, types, names that count against, and
    columns of the same name that are key or unique in the other table. uniques: unique columns by table."""
    out = []
    for name, df in tables.items():
        for column in df.schema:
            for other, target in tables.items():
                for end in target.schema:
                    if (name, column.name) == (other, end.name):
                        continue
                    declared = (name, column.name, other, end.name) in foreign_keys
                    is_key, is_unique = keys.get(other) == end.name, end.name in (uniques or {}).get(other, ())
                    named = _named(name, column.name, other, end.name) if is_key and keys.get(name) != column.name else None
                    same = other != name and column.name.lower() == end.name.lower() and keys.get(name) != column.name
                    kind = "primary" if is_key else "unique" if is_unique else None
                    if not declared and named is None and not (same and kind):
                        continue
                    found = [type_signal(column.dataType, end.dataType)]
                    if declared:
                        found.append(Signal("fk", 1.0))
                    if named:
                        found.append(Signal("naming", named[1]))
                    if same and kind:
                        found.append(Signal("naming", SAME_NAME[kind]))
                    if against := penalty(column.name):
                        found.append(Signal("negative", -against))
                    score = aggregate(found, preset)
                    if score >= PRESETS[preset][1]:
                        rule = "foreign_key" if declared else named[0] if named else "same_name"
                        out.append(Candidate(name, column.name, other, end.name, rule, round(score, 4)))
    return sorted(out, key=lambda c: (-c.score, c.from_table, c.from_column, c.to_table))


def suggests_foreign_key(overlap_pct: float, superset: bool, unique: bool) -> bool:
    return overlap_pct >= VERDICT_PCT and superset and unique


def join_factor(overlap_pct: float, right_distinct: int, left_unique: bool, right_unique: bool) -> float:
    """By what a join multiplies the left side's rows: the share that matches, times the right side's values (MOST_FACTOR at
    most) where only the left is unique, times MANY_FACTOR where neither is."""
    if not right_distinct:
        return 0.0
    share = overlap_pct / 100.0
    if right_unique:
        return share
    return share * (min(float(right_distinct), MOST_FACTOR) if left_unique else MANY_FACTOR)


def refine(found: list[Candidate], read: Callable[[str], DataFrame]) -> list[tuple[Candidate, str]]:
    """With statistics: the share of values that overlap moves the score; uniqueness gives the cardinality."""
    out = []
    for c in found:
        o = overlap(read(c.from_table), c.from_column, read(c.to_table), c.to_column)
        step = next(add for least, add in OVERLAP_STEPS if o.share >= least)
        score = round(max(0.0, min(CAP, c.score + step)), 4)
        own = column_stats(read(c.from_table), [c.from_column]).collect()[0]["is_unique"]
        kind = ("one" if own else "many") + "_to_" + ("one" if o.right_unique else "many")
        if score >= MINIMUM:
            out.append((Candidate(c.from_table, c.from_column, c.to_table, c.to_column, c.rule, score), kind))
    return out


def classify(df: DataFrame, n_foreign_keys: int, has_key: bool) -> str:
    """bridge: little but foreign keys; fact: foreign keys and measures; dimension: a key and descriptions; else source."""
    numbers = [f for f in df.schema if f.dataType.typeName() in ("double", "float", "decimal") or f.name.lower().endswith(("_amount", "_total", "_qty", "_quantity", "_price"))]
    if n_foreign_keys >= 2 and len(df.columns) <= n_foreign_keys + 1:
        return "bridge"
    if n_foreign_keys >= 1 and numbers:
        return "fact"
    return "dimension" if has_key else "source"


def suggested_aggregation(column: str) -> str:
    return "avg" if column.lower().endswith(("_rate", "_pct", "_percent", "_avg", "_average")) else "sum"
