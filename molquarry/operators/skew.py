"""Work on all rows that no single task may do: hot join keys, running sums in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molquarry.session import materialise


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before a row in ``order`` (0 for the first).

    Rows are split by ranges of the order and written once; a window then runs within each range only,
    and the totals of earlier ranges (one row a range) are added. Rows of equal order may fall on either
    side of each other, so the order should be total.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).withColumn("__value", value), "ranged")
    sizes = ranged.groupBy("__range").agg(F.sum("__value").alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inner = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("__within", F.coalesce(F.sum("__value").over(inner), F.lit(0))).join(F.broadcast(offsets), "__range")
    return summed.withColumn(name, F.col("__within") + F.col("__offset")).drop("__range", "__value", "__within", "__offset")


#: A key is hot from this share of all rows on, so that at most as many heads as its inverse are broadcast.
HOT_SHARE = 1e-3


def attach_heads(rows: DataFrame, heads: DataFrame, keys: list[str], size_col: str, hot_rows: int = 200_000) -> DataFrame:
    """Inner join of ``rows`` with ``heads`` (one row per key, ``size_col`` = rows of that key).

    Keys of at least ``hot_rows`` rows, and of HOT_SHARE of all, are broadcast: there are at most
    1 / HOT_SHARE of them, whatever the data. The others are joined by shuffle, where no task then gets
    more than that of one key. Null keys never match, as in any equi join. Nothing is dropped.
    """
    total = heads.agg(F.sum(size_col)).first()[0] or 0
    hot_rows = max(hot_rows, int(total * HOT_SHARE))
    hot = heads.filter(F.col(size_col) >= hot_rows)
    cold = heads.filter(F.col(size_col) < hot_rows)
    hot_keys = F.broadcast(hot.select(*keys))
    by_broadcast = rows.join(F.broadcast(hot), keys, "inner")
    by_shuffle = rows.join(hot_keys, keys, "left_anti").join(cold, keys, "inner")
    return by_broadcast.unionByName(by_shuffle)
