"""Sinks: every write replaces what an earlier run left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import safe_label
from ..operators.predictions import peptide_allele_pairs
from .settled import released

#: Rows of a compressed text file, which one task reads.
FILE_ROWS = 1_000_000


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), sort: Sequence[str] = (), compressed: bool = False) -> None:
    """Parquet, or tab-separated text with a header; sorted globally, nulls last, only if asked. Text that is to be read
    by Spark alone can be compressed (a tenth or less of the disk), in files of a bounded number of rows.

    Spark sorts a task's rows by folder. So rows are rebalanced by folder first: a task gets those of few folders, of
    adaptive execution's advisory size, whatever the table's."""
    df = df.orderBy(*[F.asc_nulls_last(c) for c in sort]) if sort else df
    df = df.hint("rebalance", *[F.col(c) for c in partition_by]) if partition_by and not sort else df
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    if fmt not in ("parquet", "tsv"):
        raise ValueError(f"unknown format {fmt!r}")
    if compressed and fmt == "tsv":
        writer = writer.options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": FILE_ROWS})
    with released(df.sparkSession):
        writer.parquet(path) if fmt == "parquet" else writer.option("header", True).option("sep", "\t").csv(path)


def write_fragment_tables(fragments: DataFrame, peptides: DataFrame, mapping: DataFrame, path: str, fmt: str = "parquet") -> None:
    for name, df in (("all_fragments", fragments), ("unique_peptides", peptides), ("peptide_map", mapping)):
        write_table(df, f"{path}/{name}", fmt)


def write_pair_input(peptides: DataFrame, alleles: Sequence[str], path: str) -> None:
    """A predictor's input: allele and peptide of every pair."""
    peptide_allele_pairs(peptides, alleles).select("allele", "peptide").write.mode("overwrite").option("header", True).csv(path)


def write_peptide_lists(peptides: DataFrame, path: str) -> None:
    """A predictor's input: one peptide a line, a folder for each k."""
    rows = peptides.select(F.trim("peptide").alias("peptide"), "k").where("peptide <> ''").distinct()
    rows.repartition("k").write.mode("overwrite").partitionBy("k").text(path)


def write_by_allele(scores: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder an allele, named so that any file system takes it; the allele stays a column too."""
    labelled = scores.withColumn("allele_label", safe_label(F.col("allele")))
    write_table(labelled, path, fmt, ["allele_label"])


def write_models(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Model tables by name; those with an allele and an outcome get a folder for each."""
    for name, df in tables.items():
        by = [c for c in ("allele", "outcome") if c in df.columns] if {"allele", "outcome"} <= set(df.columns) else []
        for c in by:
            df = df.withColumn(f"{c}_label", safe_label(F.col(c)))
        write_table(df, f"{path}/{name}", fmt, [f"{c}_label" for c in by])
