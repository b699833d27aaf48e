"""Ordered decision lists, feature votes and validation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first rule that holds; order matters."""
    found = F.lit(otherwise)
    for condition, label in reversed(rules):
        found = F.when(condition, label).otherwise(found)
    return found


def count_true(*conditions: Column) -> Column:
    total = F.lit(0)
    for c in conditions:
        total = total + F.coalesce(c, F.lit(False)).cast("int")
    return total


def violations(df: DataFrame, row: str, rules: dict[str, Column]) -> DataFrame:
    """row, problem for every rule that a row breaks; one pass over df."""
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(row, F.explode(found).alias("problem"))
