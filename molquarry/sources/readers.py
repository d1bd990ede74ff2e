"""Readers and writers of molecule lists, labelled tables, split files and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.functions import scalar
from molquarry.operators.skew import running_sum

FALLBACK_TARGETS = ("labels", "label", "y")


def resolve_target(columns: list[str], wanted: str | None) -> str:
    """The target column: the wanted one, else labels, label or y; otherwise an error."""
    for c in (wanted, *FALLBACK_TARGETS):
        if c and c in columns:
            return c
    raise ValueError(f"no target column among {columns}")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """A CSV with explicit schema; without one, all columns are strings (nothing is scanned to infer types)."""
    r = spark.read.option("header", header).option("escape", '"').option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r).csv(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): first column of a headerless list by extension: .txt (stripped lines), .csv, .parquet."""
    if path.endswith(".txt"):
        return spark.read.text(path).select(F.trim("value").alias("value"))
    if path.endswith(".csv"):
        df = spark.read.option("header", False).csv(path)
        return df.select(F.col(df.columns[0]).alias("value"))
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(F.col(df.columns[0]).alias("value"))
    raise ValueError(f"unknown kind of file: {path}")


def labelled(df: DataFrame, smiles: str, targets: list[str]) -> DataFrame:
    """(smiles, labels): several targets as an array, missing ones -1."""
    return df.select(F.col(smiles).alias("smiles"), F.array(*[scalar.impute(F.col(t).cast("double")) for t in targets]).alias("labels"))


def cliff_rows(df: DataFrame, mode: str) -> DataFrame:
    """(smiles, y, cliff_mol) of one split."""
    return df.filter(F.col("split") == mode).select("smiles", "y", "cliff_mol")


def keep_processed(df: DataFrame, processed: DataFrame, column: str) -> DataFrame:
    """Rows whose value is among the processed ones."""
    return df.join(processed.select(column).distinct(), column, "left_semi")


def in_blocks(df: DataFrame, row_id: str, size: int = 100_000) -> DataFrame:
    """Adds ``block`` = row_id div size for dense ids."""
    return df.withColumn("block", F.floor(F.col(row_id) / F.lit(size)))


def write_blocks(df: DataFrame, path: str, row_id: str, size: int = 100_000) -> None:
    """One folder for each block; the merge of blocks is a read of the path."""
    in_blocks(df, row_id, size).repartition("block").write.mode("overwrite").partitionBy("block").parquet(path)


def merge_blocks(spark: SparkSession, blocks: str, path: str, row_id: str) -> tuple[DataFrame, int]:
    """(the merged table, blocks left): blocks written in order of ``row_id`` to one table, then deleted."""
    spark.read.parquet(blocks).drop("block").repartitionByRange(row_id).sortWithinPartitions(row_id).write.mode("overwrite").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(blocks)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(where, True)
    return spark.read.parquet(path), int(fs.exists(where))


def join_by_place(left: DataFrame, left_order: list[Column], right: DataFrame, right_order: list[Column]) -> DataFrame:
    """Rows of two lists side by side by their place in each one's order; places only one list has are left out."""
    a = running_sum(left, left_order, F.lit(1), "__place")
    b = running_sum(right, right_order, F.lit(1), "__place")
    return a.join(b, "__place").drop("__place")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; nested arrays and structs stay nested."""
    df.write.mode("overwrite").json(path)


def subset(df: DataFrame, splits: DataFrame, row_id: str, split: str) -> DataFrame:
    """Rows of one split by a table (row_id, split)."""
    return df.join(splits.filter(F.col("split") == split).select(row_id), row_id, "left_semi")


def replace_oversized(rows: DataFrame, row_id: str, size: str, most: int = 120, pool: int = 100, seed: int = 0) -> DataFrame:
    """(row_id, used_id): each row itself, or one of ``pool`` rows of at most ``most``, by hash, if it is larger.

    The pool is the first ``pool`` fitting rows by id, so it is small by definition. An empty pool leaves null.
    """
    from pyspark.sql import Window

    safe = rows.filter(F.col(size) <= most).select(F.col(row_id).alias("safe")).orderBy("safe").limit(pool)
    safe = safe.withColumn("slot", F.row_number().over(Window.orderBy("safe")) - 1)
    n = F.broadcast(safe.agg(F.count(F.lit(1)).alias("n")))
    asked = rows.select(F.col(row_id), (F.coalesce(F.col(size), F.lit(0)) > most).alias("big")).crossJoin(n)
    slot = F.when(F.col("big") & (F.col("n") > 0), F.conv(F.substring(F.md5(F.concat_ws(":", row_id, F.lit(seed))), 1, 8), 16, 10).cast("long") % F.col("n"))
    got = asked.withColumn("slot", slot).join(F.broadcast(safe), "slot", "left")
    return got.select(row_id, F.when(F.col("big"), F.col("safe")).otherwise(F.col(row_id)).alias("used_id"))
