"""Integrity rules: violations as a DataFrame (rule, key, detail), and a raising form.

`violations` unions rules lazily; `require` runs them and raises on the first few findings.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = "rule string, key string, detail string"


class IntegrityError(ValueError):
    """Data breaks a rule."""


def _key(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def _rows(df: DataFrame, rule: str, keys: Sequence[str], detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), _key(keys).alias("key"), detail.cast("string").alias("detail"))


def unique_key(df: DataFrame, keys: Sequence[str], rule: str = "duplicate_key") -> DataFrame:
    """One row for each key that more rows than one have, with their number."""
    many = df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
    return _rows(many, rule, keys, F.col("rows"))


def not_null(df: DataFrame, columns: Sequence[str], keys: Sequence[str], rule: str = "missing_value") -> DataFrame:
    """One row for each null in columns."""
    named = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return _rows(df.withColumn("_missing", F.explode(named)), rule, keys, F.col("_missing"))


def check(df: DataFrame, good: Column, keys: Sequence[str], rule: str, detail: Column | None = None) -> DataFrame:
    """One row for each row where good is not true."""
    return _rows(df.where(~F.coalesce(good, F.lit(False))), rule, keys, F.lit("") if detail is None else detail)


def foreign_key(child: DataFrame, parent: DataFrame, on: Sequence[str], rule: str = "missing_parent") -> DataFrame:
    """One row for each child key that parent lacks."""
    lost = child.select(*on).distinct().join(parent.select(*on).distinct(), list(on), "left_anti")
    return _rows(lost, rule, on, F.lit(""))


def agreement(child: DataFrame, parent: DataFrame, on: Sequence[str], attributes: Sequence[str], rule: str = "attribute_mismatch") -> DataFrame:
    """One row for each attribute of a child that differs from its parent's, nulls compared as values."""
    p = parent.select(*on, *[F.col(a).alias(f"_p_{a}") for a in attributes])
    both = child.join(p, list(on))
    wrong = F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(f"_p_{a}")), F.lit(a)) for a in attributes]))
    return _rows(both.withColumn("_wrong", F.explode(wrong)), rule, on, F.col("_wrong"))


def non_empty(df: DataFrame, rule: str = "empty") -> DataFrame:
    """One row if df has none."""
    n = df.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    return n.select(F.lit(rule).alias("rule"), F.lit("").alias("key"), F.lit("no rows").alias("detail"))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df itself; raises if columns lack."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise IntegrityError(f"missing columns: {', '.join(missing)}")
    return df


def violations(*found: DataFrame) -> DataFrame:
    """All rules' findings."""
    return reduce(DataFrame.unionByName, found)


def require(*found: DataFrame, show: int = 5) -> None:
    """Raise IntegrityError if any rule has findings; names the first few."""
    rows = violations(*found).limit(show).collect()
    if rows:
        raise IntegrityError("; ".join(f"{r.rule}[{r.key}] {r.detail}".rstrip() for r in rows))


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, problem: missing (in left only), extra (in right only), duplicate_left, duplicate_right."""
    sides = []
    for df, other, lone, twice in ((left, right, "missing", "duplicate_left"), (right, left, "extra", "duplicate_right")):
        sides.append(df.select(key).distinct().join(other.select(key).distinct(), key, "left_anti").select(key, F.lit(lone).alias("problem")))
        sides.append(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit(twice).alias("problem")))
    return reduce(DataFrame.unionByName, sides)


def field_differences(actual: DataFrame, expected: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """key columns, field, actual, expected: values that differ, nulls compared as values, both as text."""
    e = expected.select(*key, *[F.col(f).alias(f"_e_{f}") for f in fields])
    both = actual.join(e, list(key))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("actual"), F.col(f"_e_{f}").cast("string").alias("expected")) for f in fields])
    each = both.select(*key, F.explode(pairs).alias("p")).select(*key, "p.field", "p.actual", "p.expected")
    return each.where(~F.col("actual").eqNullSafe(F.col("expected")))


def named_failures(rules: dict[str, Column]) -> Column:
    """Names of the failed rules, sorted, each once, joined by ; (a rule fails unless it is true)."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))), ";")


def notes(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in the order given, joined by ;."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), F.lit(name)) for name, on in rules.items()])), ";")
