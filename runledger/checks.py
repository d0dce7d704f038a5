"""Invariants and schema conformance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raises with some of the keys that have several rows; one aggregate."""
    twice = df.groupBy(*keys).count().where("count > 1").take(3)
    if twice:
        raise ValueError(f"several rows for a key: {[r.asDict() for r in twice]}")


def require_equal_groups(df: DataFrame, keys: Sequence[str]) -> None:
    """All groups must have as many rows."""
    sizes = df.groupBy(*keys).count().agg(F.min("count"), F.max("count")).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"groups of {sizes[0]} to {sizes[1]} rows")


def consistent(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Keys that have several values of a column, with their number."""
    return df.groupBy(*keys).agg(F.count_distinct(column).alias("values")).where("values > 1")


def _broken(df: DataFrame, schema: T.StructType, allowed: Mapping[str, Sequence[str]], cast: str) -> dict[str, Column]:
    """Rule -> whether a row breaks it; columns named <cast><name> hold the values as the schema has them."""
    rules = {}
    for f in schema.fields:
        given, value = F.col(f.name), F.col(f"{cast}{f.name}")
        rules[f"{f.name}_type"] = given.isNotNull() & value.isNull()
        if not f.nullable:
            rules[f"{f.name}_null"] = value.isNull()
        if f.name in allowed:
            rules[f"{f.name}_value"] = value.isNotNull() & ~value.isin(list(allowed[f.name]))
    return rules


def conform(df: DataFrame, schema: T.StructType, allowed: Mapping[str, Sequence[str]] | None = None, strict: str = "filter", violations: Observation | None = None) -> DataFrame:
    """The columns of the schema, cast; strict 'filter' drops rows that break a rule, 'mark' adds valid, 'raise' fails.

    A row breaks a rule with a null in a column that has none, or a value outside an allowed list. A value that has not the
    column's type becomes null. violations observes the rows that break each rule, in the pass that reads or writes them:
    <column>_null, <column>_value, and <column>_type for values that became null.
    """
    require_columns(df, schema.fieldNames())
    cast = df.select(*schema.fieldNames(), *[F.col(f.name).try_cast(f.dataType).alias(f"_as_{f.name}") for f in schema.fields])
    rules = _broken(cast, schema, allowed or {}, "_as_")
    if violations is not None:
        cast = cast.observe(violations, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in rules.items()])
    valid = F.lit(True)
    for name, broken in rules.items():
        if not name.endswith("_type"):
            valid = valid & ~F.coalesce(broken, F.lit(False))
    marked = cast.withColumn("valid", valid).select(*[F.col(f"_as_{n}").alias(n) for n in schema.fieldNames()], "valid")
    if strict == "mark":
        return marked
    if strict == "raise":
        bad = marked.where("not valid").take(3)
        if bad:
            raise ValueError(f"rows that break the schema: {[r.asDict() for r in bad]}")
    return marked.where("valid").drop("valid")
