"""Mutation labels of variants and of their peptides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import mutation_string, peptide_mutation_string, vr_slice
from .checks import unique_keys


def inferred_wt(library: DataFrame, region: tuple[int, int]) -> DataFrame:
    """One row: wt_vr, the most frequent variable region; of equals the smallest."""
    regions = library.select(vr_slice(F.col("aa_sequence"), *region).alias("vr"))
    counts = regions.groupBy("vr").agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("vr", F.struct((-F.col("n")).alias("n"), "vr")).alias("wt_vr"))


def variant_labels(library: DataFrame, region: tuple[int, int], wt_vr: str | None = None) -> DataFrame:
    """(variant_id, VR_sequence, VR_mutation) of each distinct variant. wt_vr None takes inferred_wt."""
    labels = library.select("variant_id", vr_slice(F.col("aa_sequence"), *region).alias("VR_sequence")).distinct()
    if wt_vr is not None:
        return labels.withColumn("VR_mutation", mutation_string(F.col("VR_sequence"), F.lit(wt_vr)))
    wt = F.broadcast(inferred_wt(library, region))  # one row
    return labels.join(wt).withColumn("VR_mutation", mutation_string(F.col("VR_sequence"), F.col("wt_vr"))).drop("wt_vr")


def labelled(library: DataFrame, region: tuple[int, int], wt_vr: str | None = None) -> DataFrame:
    """The library with VR_sequence and VR_mutation as metadata, which its windows then carry: no join later on."""
    vr = vr_slice(F.col("aa_sequence"), *region)
    if wt_vr is not None:
        return library.withColumns({"VR_sequence": vr, "VR_mutation": mutation_string(vr, F.lit(wt_vr))})
    wt = F.broadcast(inferred_wt(library, region))  # one row
    return library.join(wt).withColumns({"VR_sequence": vr, "VR_mutation": mutation_string(vr, F.col("wt_vr"))}).drop("wt_vr")


def peptide_labels(rows: DataFrame, region: tuple[int, int]) -> DataFrame:
    """rows(start, end, VR_mutation, ...) with peptide_mutation; without a mutation it is WT."""
    return rows.withColumn("peptide_mutation", peptide_mutation_string(F.col("VR_mutation"), F.col("start"), F.col("end"), region[0]))


def annotate(rows: DataFrame, library: DataFrame, region: tuple[int, int], wt_vr: str | None = None, validate: bool = False) -> DataFrame:
    """rows(variant_id, start, end, ...) with VR_sequence, VR_mutation and peptide_mutation; rows without a library
    entry keep null labels and the peptide label WT. The library side is broadcast where Spark finds it small."""
    labels = variant_labels(library, region, wt_vr)
    if validate:
        unique_keys(labels, ["variant_id"], "library")
    out = peptide_labels(rows.join(labels, "variant_id", "left"), region)
    return out.select(*rows.columns, "VR_sequence", "VR_mutation", "peptide_mutation")
