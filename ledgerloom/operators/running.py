"""Running sums in groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Whole numbers of the order that make a block.
BLOCK = 1 << 16


def with_earlier_blocks(df: DataFrame, key: str, order: str, amount: Column, block: int = BLOCK) -> DataFrame:
    """``df`` with ``block`` and ``before``, the sum of ``amount`` over all earlier blocks of its key.

    ``order`` is a whole number; a block holds ``block`` of its values, so what is left to do needs a
    window over (key, block) only, and a key with very many rows is spread over many tasks. Null keys
    are a group, null orders the first block.
    """
    rows = df.withColumn("block", F.expr(f"`{order}` DIV {block}"))
    sums = rows.groupBy(F.col(key).alias("__key"), F.col("block").alias("__block")).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("__n"))
    earlier = F.sum("__n").over(W.partitionBy("__key").orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("__key", "__block", F.coalesce(earlier, F.lit(0)).alias("before"))
    met = rows.join(sums, F.col(key).eqNullSafe(F.col("__key")) & F.col("block").eqNullSafe(F.col("__block")))
    return met.drop("__key", "__block")


def with_previous(df: DataFrame, key: str, order: str, value: str, name: str, default: str, block: int = BLOCK) -> DataFrame:
    """(key, order, value) of ``df`` with ``name``: ``value`` of the row before of the same key, ``default`` for the first.

    Rows are moved once, to lists of one block of one key, at most ``block`` long; the last value of
    each block is carried to the next, so no task sorts a whole key. Null keys are a group.
    """
    # In a struct null keys are equal to each other, to grouping and join alike.
    rows = df.select(F.struct(key).alias("__key"), order, value, F.expr(f"`{order}` DIV {block}").alias("__block"))
    lists = rows.groupBy("__key", "__block").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("__rows"))
    ends = lists.select("__key", "__block", F.element_at("__rows", -1)["v"].alias("__end"))
    carried = ends.select("__key", "__block", F.lag("__end").over(W.partitionBy("__key").orderBy("__block")).alias("__carried"))
    met = lists.join(carried, ["__key", "__block"])
    before = lambda i: F.when(i > 0, F.get("__rows", i - 1)["v"]).otherwise(F.coalesce("__carried", F.lit(default)))
    paired = F.transform("__rows", lambda r, i: F.struct(r.o.alias(order), r.v.alias(value), before(i).alias(name)))
    return met.select(F.col(f"__key.{key}").alias(key), F.inline(paired))


def with_place(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``place``, which counts the rows of each key from 0 in an order of any kind.

    Rows are sorted in ranges, so a key with very many rows, equal ones included, is spread over many
    tasks; a range counts its own rows, and adds those of the key in ranges before. Null keys are keys.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.asc(k) for k in keys], *order]
    ordered = df.repartitionByRange(parts, *by, F.monotonically_increasing_id()).sortWithinPartitions(*by)
    # The number of a range is in the upper bits, that of a row within it in the lower ones.
    rows = settled(ordered.withColumn("__row", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__row", 33)))
    spans = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__r")).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*[f"__{k}" for k in keys]).orderBy("__r").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("__before", F.coalesce(before, F.lit(0)))
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    place = (F.col("__row") - F.col("__first") + F.col("__before")).alias("place")
    return rows.join(spans, same).select(*[F.col(f"`{c}`") for c in df.columns], place)
