"""Batches padded to common lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molquarry.functions import scalar


def numbered_batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch_id = order div size; for dense integer orders, without a shuffle."""
    return rows.withColumn("batch_id", F.floor(F.col(order) / F.lit(size)))


def padded(rows: DataFrame, column: str, value: float, shift: float = 0.0) -> DataFrame:
    """``column`` padded to the longest of its batch and shifted; also ``mask`` (length + 1 of longest + 1)."""
    w = Window.partitionBy("batch_id")
    x = rows.withColumn("longest", F.max(F.size(column)).over(w))
    p = scalar.pad(F.col(column), F.col("longest"), value)
    mask = scalar.attention_mask(F.size(column), F.col("longest"))
    return x.withColumn("mask", mask).withColumn(column, F.transform(p, lambda v: v + F.lit(shift)) if shift else p)


def padded_square(rows: DataFrame, column: str, value: float) -> DataFrame:
    """A square array of arrays padded in both directions to the longest of its batch."""
    x = rows.withColumn("longest", F.max(F.size(column)).over(Window.partitionBy("batch_id")))
    wide = F.transform(column, lambda r: scalar.pad(r, F.col("longest"), value))
    empty = F.array_repeat(F.array_repeat(F.lit(value), F.col("longest").cast("int")), F.greatest(F.col("longest") - F.size(column), F.lit(0)).cast("int"))
    return x.withColumn(column, F.concat(wide, empty))


def padded_rows(rows: DataFrame, column: str, width: int) -> DataFrame:
    """A list of index rows of ``width`` padded with zero rows to the longest of its batch."""
    x = rows.withColumn("longest", F.max(F.size(column)).over(Window.partitionBy("batch_id")))
    zero = F.array_repeat(F.lit(0), width)
    return x.withColumn(column, F.concat(column, F.array_repeat(zero, (F.col("longest") - F.size(column)).cast("int"))))


def typed(rows: DataFrame, whole: set[str], floats: set[str], plain: set[str]) -> DataFrame:
    """The named columns only, as 64-bit integers, 32-bit floats, or as they are; others aren't read."""
    kinds = {**{c: "long" for c in whole}, **{c: "float" for c in floats}}
    return rows.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in rows.columns if c in kinds or c in plain])
