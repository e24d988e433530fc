"""Inputs derived from the driver's tables by hashing keys, in Spark and, as text, in DuckDB SQL.

The tables hold no proteins, so a library is derived; it has no biological meaning and only exercises the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotate import inferred_wt
from ..sources.settled import settle

LEFT, VR, RIGHT = "MAADGYLPDWLEDTLSEGIR", "SHKEGEDRFFPLSGSLI", "QWWKLKPGPPPPKPAERHKD"
REGION = (21, 37)
WT = LEFT + VR + RIGHT
ALLELES = ["H2-D*b", "H2-K*b"]
MORE_ALLELES = [*ALLELES, "H2-L*d", "H2-D*d", "H2-K*d"]
ALLELES_2 = ["H2-I*Ab", "H2-I*Ad"]
OUTCOME_NAMES = ["o1", "o2"]
#: The nations of the supplier table as alleles.
NATION_ALLELES = [f"a{n}" for n in range(25)]


def mutated(key: Column) -> Column:
    """Every VR position changes with probability 1/8 to one of A, D, K, L."""
    def residue(p: Column) -> Column:
        h = F.md5(F.concat(key.cast("string"), F.lit(":"), p.cast("string")))
        new = F.translate(F.substring(h, 2, 1), "0123456789abcdef", "ADKLADKLADKLADKL")
        return F.when(F.substring(h, 1, 1).isin("0", "1"), new).otherwise(F.substring(F.lit(VR), p, F.lit(1)))

    return F.concat(F.lit(LEFT), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(len(VR))), residue), ""), F.lit(RIGHT))


def library(spark: SparkSession, sf_dir: str, table: str = "customer", key: str = "c_custkey", metadata: str | None = "c_mktsegment") -> DataFrame:
    """variant_id, aa_sequence, criteria. Every fiftieth variant has a stop codon at the region's start.

    Keys are dealt first, as a table of few row groups is read by few tasks. The library is settled: else its sequences
    would be derived anew for each expression that uses one, and by each reading.
    """
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, *[metadata] * bool(metadata))
    rows = rows.repartition(2 * spark.sparkContext.defaultParallelism, key)
    sequence = mutated(F.col(key))
    stopped = F.concat(F.lit(LEFT + "*"), F.substring(sequence, len(LEFT) + 2, len(WT)))
    return settle(rows.select(
        F.col(key).cast("string").alias("variant_id"), F.when(F.col(key) % 50 == 0, stopped).otherwise(sequence).alias("aa_sequence"),
        (F.col(metadata) if metadata else F.lit("")).alias("criteria"),
    ))


def wt_library(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("WT").alias("variant_id"), F.lit(WT).alias("aa_sequence"), F.lit("wt").alias("criteria"))


def inferred_wt_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wild type as the library shows it: its most frequent variable region between the flanks."""
    return inferred_wt(library(spark, sf_dir), REGION).select(
        F.lit("WT").alias("variant_id"), F.concat(F.lit(LEFT), "wt_vr", F.lit(RIGHT)).alias("aa_sequence"), F.lit("wt").alias("criteria")
    )


def hashed_score(salt: str, allele: Column, peptide: Column) -> Column:
    """0.00 to 99.99 by md5; null where the seventh digit is f."""
    h = F.md5(F.concat(F.lit(salt), allele, F.lit("|"), peptide))
    value = F.conv(F.substring(h, 1, 6), 16, 10).cast("bigint") % 10000 / F.lit(100.0)
    return F.when(F.substring(h, 7, 1) != "f", value)


def net_predictions(pairs: DataFrame) -> DataFrame:
    a, p = F.col("allele"), F.col("peptide")
    return pairs.select("allele", "peptide", hashed_score("ns", a, p).alias("netMHCpan_EL_score"), hashed_score("nr", a, p).alias("netMHCpan_EL_rank"))


def flurry_predictions(pairs: DataFrame) -> DataFrame:
    a, p = F.col("allele"), F.col("peptide")
    return pairs.select("allele", "peptide", hashed_score("fa", a, p).alias("MHCflurry_affinity_percentile"), hashed_score("fp", a, p).alias("MHCflurry_presentation_percentile"))


def mhcii_predictions(pairs: DataFrame) -> DataFrame:
    a, p = F.col("allele"), F.col("peptide")
    return pairs.select(
        "allele", "peptide", F.substring("peptide", 4, 9).alias("netMHCIIpan_core"), F.lit(0.0).alias("netMHCIIpan_inverted"),
        hashed_score("2s", a, p).alias("netMHCIIpan_EL_score"), hashed_score("2r", a, p).alias("netMHCIIpan_EL_rank"),
    )


def duck_library(table: str = "customer", key: str = "c_custkey", metadata: str = "c_mktsegment") -> str:
    one = (
        f"CASE WHEN substr(md5({key}||':'||p),1,1) IN ('0','1') THEN translate(substr(md5({key}||':'||p),2,1),'0123456789abcdef','ADKLADKLADKLADKL') "
        f"ELSE substr('{VR}',p::int,1) END"
    )
    seq = f"'{LEFT}' || list_aggregate(list_transform(range(1,{len(VR) + 1}), lambda p: {one}),'string_agg','') || '{RIGHT}'"
    return (
        f"SELECT {key}::varchar AS variant_id, CASE WHEN {key} % 50 = 0 THEN '{LEFT}*' || substr(s, {len(LEFT) + 2}) ELSE s END AS aa_sequence, {metadata} AS criteria "
        f"FROM (SELECT *, {seq} AS s FROM {table})"
    )


def duck_score(salt: str, allele: str = "allele", peptide: str = "peptide") -> str:
    h = f"md5('{salt}'||{allele}||'|'||{peptide})"
    return f"CASE WHEN substr({h},7,1) <> 'f' THEN ('0x'||substr({h},1,6))::bigint % 10000 / 100.0 END::double"


def duck_alleles(names: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{a}')" for a in names) + ") AS a(allele)"
