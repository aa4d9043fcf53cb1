"""Places and running sums over rows in a global order, without bringing all rows, or all rows of a key, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: Columns that in_order() adds: the range part of a row, and its place, which grows through all parts.
PART, AT = "__part", "__at"


def in_order(df: DataFrame, *keys: Column) -> DataFrame:
    """df with PART and AT in the order of the keys: range partitions, each sorted, staged so that places stay as they are.

    AT grows with the keys but leaves gaps between parts. Rows with equal keys are dealt over parts
    by a hash of their own, so that one key may hold most rows; their order among themselves is any.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())
    ordered = df.withColumn("__tie", tie).repartitionByRange(*keys, F.col("__tie")).sortWithinPartitions(*keys, F.col("__tie"))
    placed = staged(ordered.drop("__tie").withColumn(AT, F.monotonically_increasing_id()), "order")
    return placed.withColumn(PART, F.shiftright(AT, 33))


def running(ordered: DataFrame, group: list[str], **values: Column) -> DataFrame:
    """ordered, from in_order(), with one inclusive running sum for each of the values, inside each group or over all rows.

    A part sums its own rows; what stood in earlier parts comes from one row for each group and part.
    """
    sums = list(values)
    rows = ordered.select("*", *[v.alias(f"__v_{k}") for k, v in values.items()])
    own = Window.partitionBy(*group, PART).orderBy(AT)
    inside = rows.select("*", *[F.sum(f"__v_{k}").over(own).alias(f"__own_{k}") for k in sums])
    totals = rows.groupBy(*group, PART).agg(*[F.sum(f"__v_{k}").alias(f"__v_{k}") for k in sums])
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*group, PART, *[F.coalesce(F.sum(f"__v_{k}").over(earlier), F.lit(0)).alias(f"__before_{k}") for k in sums])
    joined = inside.join(before, [*group, PART])
    return joined.select(*ordered.columns, *[(F.col(f"__own_{k}") + F.col(f"__before_{k}")).alias(k) for k in sums])
