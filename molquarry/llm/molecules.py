"""The molecules of freesolv and esol as one table of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.session import table


def molecule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(origin, row_id, smiles, source, split) of both tables; only these columns are scanned."""
    a = table(spark, sf_dir, "freesolv").select(F.lit("freesolv").alias("origin"), "row_id", "smiles", "source", "split")
    b = table(spark, sf_dir, "esol").select(F.lit("esol").alias("origin"), "row_id", F.col("c0").alias("smiles"), "source", "split")
    return a.unionByName(b)
