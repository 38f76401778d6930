"""Folds that can be cut anywhere: partial results of parts of a log, merged in any order.

What a fold knows of an entity is one small row: for the latest or first value its log_seq and the
value, for the rest a number or a flag. Merging two such rows is associative and commutative, so the
fold of a log is the merge of the folds of its parts, however it is cut.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One column of a fold: how a part of the log gives it, and how two parts are merged."""

    part: Callable[[], Column]
    merge: Callable[[str], Column]
    value: Callable[[str], Column]


def _valued(pick: Callable[..., Column], value: Callable[[], Column], when: Callable[[], Column] | None) -> Field:
    seq = F.col("log_seq") if when is None else None
    order = lambda: F.when(when(), F.col("log_seq")) if when is not None else seq
    return Field(lambda: pick(F.struct(F.col("log_seq").alias("seq"), value().alias("value")), order()), lambda c: pick(F.col(c), F.col(c)["seq"]), lambda c: F.col(c)["value"])


def last_of(value: Callable[[], Column], when: Callable[[], Column] | None = None) -> Field:
    """The value at the latest event for which ``when`` holds."""
    return _valued(F.max_by, value, when)


def first_of(value: Callable[[], Column], when: Callable[[], Column] | None = None) -> Field:
    return _valued(F.min_by, value, when)


def any_of(when: Callable[[], Column]) -> Field:
    return Field(lambda: F.bool_or(when()), lambda c: F.bool_or(c), F.col)


def count_of(when: Callable[[], Column]) -> Field:
    return Field(lambda: F.count_if(when()), lambda c: F.sum(c), F.col)


def most_of(value: Callable[[], Column]) -> Field:
    return Field(lambda: F.max(value()), lambda c: F.max(c), F.col)


def fold_part(log: DataFrame, key: str, fields: dict[str, Field]) -> DataFrame:
    """The partial fold of a part of a log; events without a key are left out."""
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(*[f.part().alias(n) for n, f in fields.items()])


def merge_parts(parts: DataFrame, key: str, fields: dict[str, Field]) -> DataFrame:
    """One partial fold out of several, that lie in one frame."""
    return parts.groupBy(key).agg(*[f.merge(n).alias(n) for n, f in fields.items()])


def values_of(parts: DataFrame, key: str, fields: dict[str, Field]) -> DataFrame:
    """The columns that a merged fold stands for."""
    return parts.select(key, *[f.value(n).alias(n) for n, f in fields.items()])
