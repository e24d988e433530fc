"""Two predictors' mapped predictions side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import int_of, normalised_allele, passes
from .checks import unique_keys
from .watch import Watch

KEYS = ["allele", "peptide", "variant_id", "start", "end", "k"]
NET = ["netMHCpan_EL_score", "netMHCpan_EL_rank", "netMHCpan_EL_rank_pass"]
FLURRY = ["MHCflurry_affinity_percentile", "MHCflurry_presentation_percentile", "MHCflurry_affinity_percentile_pass"]
SHARED = ["peptide_id", "length", "occurrence_count"]


def combine_predictions(net: DataFrame, flurry: DataFrame, metadata: Sequence[str] = (), partitions: int | None = None, validate: bool = False) -> DataFrame:
    """Full outer join on allele, peptide, variant and window, with `merge_status` both, left_only or right_only.

    Null keys match each other. Columns that both sides have are taken from the left first. Alleles are spelt alike
    before. It is one union and one aggregate, dealt by (allele, variant_id): scoring by the same keys needs no
    further shuffle.
    """
    shared = [*SHARED, *metadata]
    rows = None
    for tag, df, own in (("l", net, NET), ("r", flurry, FLURRY)):
        own = own + [c for c in df.columns if tag == "l" and c in ("netMHCpan_BA_score", "netMHCpan_BA_rank")]
        keys = [normalised_allele(F.col("allele")).alias("allele"), "peptide", "variant_id", *[int_of(df, c) for c in ("start", "end", "k")]]
        kept = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in shared]
        part = df.select(*keys, F.lit(tag).alias("_side"), F.struct(*kept).alias("_shared"), F.struct(*own).alias(f"_{tag}"))
        if validate:
            unique_keys(part, KEYS, "mapped predictions")
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rows = rows.repartition(partitions, "allele", "variant_id") if partitions else rows.repartition("allele", "variant_id")
    sides = {t: F.first(F.when(F.col("_side") == t, F.col("_shared")), ignorenulls=True).alias(f"_s{t}") for t in "lr"}
    # groups of structs are sorted by their keys in this order: a variant's id tells more rows apart than an allele's name
    out = rows.groupBy("variant_id", "start", "allele", "end", "k", "peptide").agg(
        F.first("_l", ignorenulls=True).alias("_l"), F.first("_r", ignorenulls=True).alias("_r"), *sides.values(),
        F.max(F.col("_side") == "l").alias("_in_l"), F.max(F.col("_side") == "r").alias("_in_r"),
    )
    status = F.when(F.col("_in_l") & F.col("_in_r"), "both").when(F.col("_in_l"), "left_only").otherwise("right_only")
    names = {t: rows.schema[f"_{t}"].dataType.names for t in "lr"}
    return out.select(
        *KEYS, *[F.coalesce(f"_sl.{c}", f"_sr.{c}").alias(c) for c in shared],
        *[f"_l.{c}" for c in names["l"]], *[f"_r.{c}" for c in names["r"]], status.alias("merge_status"),
    )


def combine_scores(net: DataFrame, flurry: DataFrame, net_threshold: float, flurry_threshold: float, watch: Watch | None = None) -> DataFrame:
    """combine_predictions before the predictions are mapped: a row for each (allele, peptide, k) with both
    predictors' columns, pass flags (null where a predictor lacks the pair) and merge_status.

    Both predictors are spread over the same occurrences, so combining peptides and spreading them once gives what
    combining two spread tables does. Of several rows of the first predictor the one of the lowest rank counts, null
    last. A watch forbids repeated rows of the second, and reports merged: how many pairs have each merge_status.
    """
    rows, names = None, {}
    for tag, df, own in (("l", net, NET), ("r", flurry, FLURRY)):
        own = [c for c in own if not c.endswith("_pass")] + [c for c in df.columns if tag == "l" and c in ("netMHCpan_BA_score", "netMHCpan_BA_rank")]
        names[tag] = own
        k = F.col("k").cast("int") if "k" in df.columns else F.length("peptide")
        part = df.select(normalised_allele(F.col("allele")).alias("allele"), "peptide", k.alias("k"), F.struct(*own).alias(f"_{tag}"))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rank = F.col("_l.netMHCpan_EL_rank")
    out = rows.groupBy("allele", "peptide", "k").agg(
        F.min_by("_l", F.when(F.col("_l").isNotNull(), F.struct(rank.isNull(), rank))).alias("_l"), F.first("_r", ignorenulls=True).alias("_r"),
        *([F.count("_r").alias("_n")] if watch else []),
    )
    if watch:
        out = watch.forbid(out, F.col("_n") > 1, "second predictor's table has duplicate keys", ["allele", "peptide", "k"])
    has = {t: F.col(f"_{t}").isNotNull() for t in "lr"}
    status = F.when(has["l"] & has["r"], "both").when(has["l"], "left_only").otherwise("right_only")
    if watch:
        both = {"both": has["l"] & has["r"], "left_only": ~has["r"], "right_only": ~has["l"]}
        out = watch.count(out, "merged", **{k: F.count_if(c) for k, c in both.items()})
    return out.select(
        "allele", "peptide", "k", *[f"_l.{c}" for c in names["l"][:2]], F.when(has["l"], passes(rank, net_threshold)).alias(NET[2]), *[f"_l.{c}" for c in names["l"][2:]],
        *[f"_r.{c}" for c in names["r"]], F.when(has["r"], passes(F.col(f"_r.{FLURRY[0]}"), flurry_threshold)).alias(FLURRY[2]), status.alias("merge_status"),
    )


def merge_report(combined: DataFrame) -> DataFrame:
    return combined.groupBy("merge_status").agg(F.count("*").alias("n_rows"))
