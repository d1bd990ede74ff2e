"""The registered queries of the training-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.llm import clusters, copies, group_splits, mixing, neighbours, overlap, packing, residue, tokens
from molquarry.llm.molecules import molecule_rows
from molquarry.session import table

Query = Callable[[SparkSession, str], DataFrame]

#: The configuration of core_c whose num_centers bounds the clusters of p2_clusters.
CLUSTER_CONFIG = "full"
FIELDS = {"morgan2048_fp": ("bits", 2048), "text_name_embedding": ("units", 64)}


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = {r["field_name"]: int(r["capacity"]) for r in table(spark, sf_dir, "pack_capacity").collect()}
    return packing.packed_fields(table(spark, sf_dir, "data_collator"), "mol_id", caps)


def _most(spark: SparkSession, sf_dir: str) -> int:
    row = table(spark, sf_dir, "core_c").filter(f"config_id = '{CLUSTER_CONFIG}' and modality = 'fingerprint'").first()
    return int(row["num_centers"])


def _near(spark: SparkSession, sf_dir: str, least: float = 0.0) -> dict[str, neighbours.Neighbours]:
    return neighbours.neighbours_of_fields(table(spark, sf_dir, "data_collator"), "mol_id", FIELDS, least=least)


def p1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_packed(spark, sf_dir), table(spark, sf_dir, "pack_capacity"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.Clusters(table(spark, sf_dir, "data_collator")).found()


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.Clusters(table(spark, sf_dir, "data_collator")).describe(_most(spark, sf_dir))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.Clusters(table(spark, sf_dir, "data_collator")).members(_most(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for field, near in _near(spark, sf_dir, 0.9).items():
        one = near.found(0.9).select(F.lit(field).alias("field"), "id_a", "id_b")
        out = one if out is None else out.unionByName(one)
    return out


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for field, near in _near(spark, sf_dir).items():
        one = near.rows.select(F.lit(field).alias("field"), F.col("id").alias("mol_id"), "rank", "neighbour_id", F.round("similarity", 6).alias("similarity"))
        out = one if out is None else out.unionByName(one)
    return out


def _collapsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return copies.collapse_formatting(molecule_rows(spark, sf_dir), "origin", "row_id", "smiles")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir)[1]


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir)[0].select(F.col("scope").alias("origin"), F.col("canon").alias("smiles"), "copies", "first_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.Overlap(molecule_rows(spark, sf_dir)).pairs()


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.Overlap(molecule_rows(spark, sf_dir)).rows()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.Overlap(molecule_rows(spark, sf_dir)).report()


def _splits(spark: SparkSession, sf_dir: str) -> group_splits.GroupedSplit:
    return group_splits.GroupedSplit(table(spark, sf_dir, "freesolv"), table(spark, sf_dir, "split_targets"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir).sets()


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir).rows.select("row_id", "component", "split")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir).report()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact round trip: text of each document from its ids; "" for null texts too."""
    back = tokens.decode_documents(tokens.encode_documents(table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.decode("bytes", "utf-8").alias("text"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).drawn


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.Residue(table(spark, sf_dir, "documents")).found


def p10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.Residue(table(spark, sf_dir, "documents")).templates.filter("verdict != 'content'").select("template", "n", "verdict")


def queries() -> dict[str, Query]:
    named = (
        p1_batches, p1_report, p2_found, p2_clusters, p2_members, p3_found, p3_neighbours, p4_found, p4_records, p5_found, p5_rows, p5_report,
        p6_found, p6_splits, p6_report, p8_ids, p8_decoded, p9_draws, p9_report, p10_found, p10_templates,
    )
    return {f.__name__: f for f in named}
