"""Peptide rows to one row for each allele and variant: absolute, or relative to the wild type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import count_mutations, decoded_boolean, filled_mutation, int_of, lenient_double
from ..sources.settled import pinned
from .checks import all_matched, forbid, one_mutation, require_columns, unique_keys
from .predictions import AFFINITY, EL_RANK, EL_RANK_2
from .watch import Watch

GROUPS = ["allele", "variant_id"]
WINDOW = ["allele", "start", "end", "k"]
NET_PASS, FLURRY_PASS, BINDER = "netMHCpan_EL_rank_pass", "MHCflurry_affinity_percentile_pass", "netMHCIIpan_EL_rank_binder"


def _text(name: str) -> Column:
    return F.trim(F.col(name).cast("string")).alias(name)


def _double(df: DataFrame, c: str) -> Column:
    """lenient_double, without the way over text where the column is a number already."""
    is_double = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return (F.when(~F.isnan(c), F.col(c).cast("double")) if is_double else lenient_double(F.col(c))).alias(c)


def _flag(df: DataFrame, c: str) -> Column:
    is_boolean = isinstance(df.schema[c].dataType, T.BooleanType)
    return (F.coalesce(c, F.lit(False)) if is_boolean else decoded_boolean(F.col(c))).alias(c)


def _both(df: DataFrame) -> DataFrame:
    return df.withColumn("both_pass", F.col(NET_PASS) & F.col(FLURRY_PASS)).withColumn("either_pass", F.col(NET_PASS) | F.col(FLURRY_PASS))


def _one_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by `order`. Rows are sorted once, by keys that begin with the variant, which tells
    more of them apart than an allele's name; the least of structs would sort them too, and build a struct of each row."""
    place = F.row_number().over(W.partitionBy("variant_id", *[c for c in keys if c != "variant_id"]).orderBy(*order))
    return df.withColumn("_n", place).where("_n = 1").drop("_n")


def prepare_absolute(combined: DataFrame, validate: bool = False) -> DataFrame:
    """Cleaned rows, one for each allele, variant and peptide_id (the first by start and end). Rows without allele or
    variant go. Missing or blank mutations read WT, missing flags false, scores that are no numbers null."""
    require_columns(combined, [*GROUPS, "peptide_id", "VR_mutation", EL_RANK, NET_PASS, AFFINITY, FLURRY_PASS], "combined table")
    # from text tables too, places are ordered as numbers
    placed = [int_of(combined, c) if c in combined.columns else F.lit(None).cast("int").alias(c) for c in ("start", "end")]
    rows = combined.where("allele IS NOT NULL AND variant_id IS NOT NULL").select(
        *map(_text, [*GROUPS, "peptide_id"]), filled_mutation(F.col("VR_mutation")).alias("VR_mutation"), *placed,
        _double(combined, EL_RANK), _flag(combined, NET_PASS), _double(combined, AFFINITY), _flag(combined, FLURRY_PASS),
    )
    if validate:
        one_mutation(rows, GROUPS)
    # dealt once: what follows is all by allele and variant, and groups of a row or two gain nothing by combining early
    return _both(_one_of(rows.repartition(*GROUPS), [*GROUPS, "peptide_id"], ["start", "end", EL_RANK, AFFINITY]))


def mean_smallest(c: str, n: int = 3, require: bool = False) -> Column:
    """Mean of the n smallest values of a group; null for none, or for fewer than n if they are required."""
    low = F.slice(F.sort_array(F.collect_list(c)), 1, n)
    mean = F.aggregate(low, F.lit(0.0), lambda a, x: a + x) / F.size(low)
    return F.when(F.size(low) >= (n if require else 1), mean)


def _others(watch: Watch | None) -> list[Column]:
    return [F.max("VR_mutation").alias("_other")] if watch else []


def _same_mutation(watch: Watch | None, scores: DataFrame) -> DataFrame:
    """Drops _other, the last of a group's annotations, once watched: it must be the first one too."""
    if watch:
        scores = watch.forbid(scores, F.col("VR_mutation") != F.col("_other"), "groups with several VR_mutation annotations", [*GROUPS, "VR_mutation", "_other"])
    return scores.drop("_other")


def absolute_scores(combined: DataFrame, require_three: bool = False, validate: bool = False, watch: Watch | None = None) -> DataFrame:
    """One row for each allele and variant: counts of passing peptides, best score and mean of the three best.

    validate raises for groups with several annotations, by a job of its own; a watch finds them in the same pass.
    """
    rows = prepare_absolute(combined, validate)
    scores = [
        x for name, c in (("netMHCpan", EL_RANK), ("MHCflurry", AFFINITY))
        for x in (F.min(c).alias(f"{name}_top_score"), mean_smallest(c, 3, require_three).alias(f"{name}_mean_top3"))
    ]
    flags = {"netMHCpan": NET_PASS, "MHCflurry": FLURRY_PASS, "both": "both_pass", "either": "either_pass"}
    out = rows.groupBy(*GROUPS).agg(
        F.min("VR_mutation").alias("VR_mutation"), F.count("peptide_id").alias("total_epitope_count"),
        *[F.count_if(F.col(f)).alias(f"{n}_passed_count") for n, f in flags.items()], *scores, *_others(watch),
    )
    out = _same_mutation(watch, out)
    return out.withColumn("mutation_count", count_mutations(F.col("VR_mutation")).cast("long"))


def prepare_windows(combined: DataFrame, validate: bool = False) -> DataFrame:
    """Cleaned rows for window scoring, one for each allele, variant and window."""
    require_columns(combined, [*GROUPS, "peptide_id", "peptide", "start", "end", "k", "VR_mutation", EL_RANK, NET_PASS, AFFINITY, FLURRY_PASS], "combined table")
    rows = combined.where("allele IS NOT NULL AND variant_id IS NOT NULL").select(
        *map(_text, [*GROUPS, "peptide_id", "peptide"]), *[int_of(combined, c) for c in ("start", "end", "k")],
        filled_mutation(F.col("VR_mutation")).alias("VR_mutation"),
        _double(combined, EL_RANK), _flag(combined, NET_PASS), _double(combined, AFFINITY), _flag(combined, FLURRY_PASS),
    )
    if validate:
        one_mutation(rows, GROUPS)
    return _both(_one_of(rows.repartition(*GROUPS), ["allele", "variant_id", "start", "end", "k"], ["peptide", "peptide_id", EL_RANK, AFFINITY]))


def wt_reference(wt_windows: DataFrame) -> DataFrame:
    """The wild type's windows, one row each: smallest scores, flags that any row has."""
    return wt_windows.groupBy(*WINDOW).agg(
        F.min("peptide_id").alias("wt_peptide_id"), F.min("peptide").alias("wt_peptide"), F.min("variant_id").alias("wt_variant_id"),
        F.min(EL_RANK).alias(f"wt_{EL_RANK}"), F.bool_or(NET_PASS).alias(f"wt_{NET_PASS}"),
        F.min(AFFINITY).alias(f"wt_{AFFINITY}"), F.bool_or(FLURRY_PASS).alias(f"wt_{FLURRY_PASS}"),
        F.bool_or("both_pass").alias("wt_both_pass"), F.bool_or("either_pass").alias("wt_either_pass"),
    )


def with_expected(reference: DataFrame) -> DataFrame:
    """The reference with expected_window_count, the windows of each allele."""
    return reference.join(reference.groupBy("allele").agg(F.count("*").alias("expected_window_count")), "allele")


#: Windows of a wild type and its alleles, mostly hundreds, that are broadcast; beyond this many the join is shuffled.
BROADCAST_WINDOWS = 50_000


def _match(rows: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their WT window, the expected windows of each allele as allele and expected_window_count).

    A whole screen of the wild type stands behind the reference: it is computed once and both uses start from that."""
    whole, small = pinned(with_expected(reference), BROADCAST_WINDOWS)
    expected = whole.groupBy("allele").agg(F.first("expected_window_count").alias("expected_window_count"))
    own = whole.drop("expected_window_count")
    return rows.join(F.broadcast(own) if small else own, WINDOW, "left"), F.broadcast(expected) if small else expected


def _improvement(wt: str, own: str) -> Column:
    """WT minus variant: positive is stronger than WT; an unchanged window is 0 even without scores."""
    return F.when(F.col("wt_peptide").isNotNull() & ~F.col("changed_window"), F.lit(0.0)).otherwise(F.col(wt) - F.col(own))


def _changes(name: str, flag: str) -> dict[str, Column]:
    own, wt = F.col(flag), F.coalesce(F.col(f"wt_{flag}"), F.lit(False))
    return {f"{name}_new_pass_vs_WT": own & ~wt, f"{name}_lost_pass_vs_WT": ~own & wt, f"{name}_pass_change_vs_WT": own.cast("int") - wt.cast("int")}


def wt_relative_windows(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Prepared windows with their WT match, improvements and pass changes. Windows without a match stay, with null
    improvements and no WT pass."""
    out, expected = _match(rows, reference)
    out = out.join(expected, "allele", "left")
    out = out.withColumn("changed_window", F.coalesce(F.col("peptide") != F.col("wt_peptide"), F.lit(False)))
    added = {"netMHCpan_window_improvement": _improvement(f"wt_{EL_RANK}", EL_RANK), "MHCflurry_window_improvement": _improvement(f"wt_{AFFINITY}", AFFINITY)}
    for name, flag in (("netMHCpan", NET_PASS), ("MHCflurry", FLURRY_PASS), ("both", "both_pass"), ("either", "either_pass")):
        added |= _changes(name, flag)
    return out.withColumns(added)


def wt_scores_mhci(variants: DataFrame, wt: DataFrame, validate: bool = False, watch: Watch | None = None) -> DataFrame:
    """One row for each allele and variant: window counts, gained and lost passes, mean improvement over WT.

    validate raises if an allele has no WT windows, or if a variant lacks some of them, by jobs of its own; a watch
    finds the same, and groups with several annotations, in the pass that makes the scores.
    """
    rows, reference = prepare_windows(variants, validate), wt_reference(prepare_windows(wt, validate))
    if validate:
        all_matched(rows.select("allele").distinct(), reference, ["allele"], "alleles without wild-type windows")
    windows = wt_relative_windows(rows, reference)
    names = ("netMHCpan", "MHCflurry", "both")
    out = _summed(
        windows, "wt_peptide_id",
        {f"{n}_{to}_passed_count": f"{n}_{to}_pass_vs_WT" for n in names for to in ("new", "lost")}, {f"{n}_net_pass_change": f"{n}_pass_change_vs_WT" for n in names},
        {f"{n}_mean_window_improvement": f"{n}_window_improvement" for n in ("netMHCpan", "MHCflurry")}, watch,
    )
    changes = [f"{n}_{c}" for n in names for c in ("new_passed_count", "lost_passed_count", "net_pass_change")]
    out = out.select(*out.columns[:6], *changes, *[c for c in out.columns[6:] if c not in changes])
    if watch:
        out = watch.forbid(out, F.col("expected_window_count") == 0, "alleles without wild-type windows", ["allele"])
    return _complete(out, validate, watch)


def _summed(windows: DataFrame, matched: str, counts: dict[str, str], sums: dict[str, str], means: dict[str, str], watch: Watch | None) -> DataFrame:
    """One row for each allele and variant: VR_mutation, counts of windows, and of what is named {result: column}.

    Windows are added up by label first, as the least of texts is found by sorting, and all else by hashing: what is
    then sorted is a row for each allele and variant, not for each window."""
    of_label = windows.groupBy(*GROUPS, "VR_mutation").agg(
        F.count(matched).alias("matched_window_count"), F.first("expected_window_count", ignorenulls=True).alias("expected_window_count"), F.count_if("changed_window").alias("changed_window_count"),
        *[F.count_if(c).alias(n) for n, c in counts.items()], *[F.sum(F.col(c).cast("long")).alias(n) for n, c in sums.items()],
        *[x for n, c in means.items() for x in (F.sum(c).alias(n), F.count(c).alias(f"_n_{n}"))],
    )
    total = lambda c: F.sum(c).alias(c)
    mean = lambda c: F.when(F.sum(f"_n_{c}") > 0, F.sum(c) / F.sum(f"_n_{c}")).alias(c)
    return of_label.groupBy(*GROUPS).agg(
        F.min("VR_mutation").alias("VR_mutation"), total("matched_window_count"), F.coalesce(F.first("expected_window_count", ignorenulls=True), F.lit(0)).alias("expected_window_count"),
        total("changed_window_count"), *map(total, [*counts, *sums]), *map(mean, means), *_others(watch),
    )


def _complete(scores: DataFrame, validate: bool, watch: Watch | None = None) -> DataFrame:
    scores = _same_mutation(watch, scores).withColumn("mutation_count", count_mutations(F.col("VR_mutation")).cast("long"))
    shown = [*GROUPS, "matched_window_count", "expected_window_count"]
    if watch:
        scores = watch.forbid(scores, F.col("matched_window_count") != F.col("expected_window_count"), "variants without all wild-type windows", shown)
    if validate:
        forbid(scores, F.col("matched_window_count") != F.col("expected_window_count"), "variants without all wild-type windows", shown)
    return scores


def prepare_mhcii(annotated: DataFrame, validate: bool = False) -> DataFrame:
    """Annotated MHC-II rows with strict whole numbers for the window (a text that is none raises)."""
    columns = [*GROUPS, "peptide_id", "peptide", "start", "end", "k", "VR_mutation", EL_RANK_2, BINDER]
    rows = require_columns(annotated, columns, "annotated table").where("allele IS NOT NULL AND variant_id IS NOT NULL").select(
        *GROUPS, "peptide_id", "peptide", *[F.col(c).cast("int").alias(c) for c in ("start", "end", "k")],
        filled_mutation(F.col("VR_mutation"), blank_too=False).alias("VR_mutation"),
        _double(annotated, EL_RANK_2), _flag(annotated, BINDER),
    )
    if validate:
        unique_keys(rows, ["allele", "variant_id", "start", "end", "k"], "annotated table")
        one_mutation(rows, GROUPS)
    return rows


def wt_scores_mhcii(variants: DataFrame, wt: DataFrame, validate: bool = False, watch: Watch | None = None) -> DataFrame:
    """The MHC-II twin. validate raises where a window has no WT match, where WT repeats one, or where some lack; a
    watch finds windows without a match, or with several annotations, and variants that lack some, in the same pass."""
    rows = prepare_mhcii(variants, validate)
    reference = prepare_mhcii(wt, validate).select(
        *WINDOW, F.col("peptide").alias("wt_peptide"), F.col(EL_RANK_2).alias(f"wt_{EL_RANK_2}"), F.col(BINDER).alias(f"wt_{BINDER}")
    )
    if validate:
        unique_keys(reference, WINDOW, "wild-type windows")
        all_matched(rows, reference, WINDOW, "windows without a wild-type match")
    windows, expected = _match(rows, reference)
    if watch:
        windows = watch.forbid(windows, F.col("wt_peptide").isNull(), "windows without a wild-type match", [*GROUPS, "start", "end", "k"])
    windows = windows.join(expected, "allele", "left").withColumn("changed_window", F.coalesce(F.col("peptide") != F.col("wt_peptide"), F.lit(False)))
    windows = windows.withColumns(_changes("b", BINDER) | {"improvement": _improvement(f"wt_{EL_RANK_2}", EL_RANK_2)})
    out = _summed(
        windows, "wt_peptide", {f"netMHCIIpan_{to}_binder_count": f"b_{to}_pass_vs_WT" for to in ("new", "lost")}, {"netMHCIIpan_net_binder_change": "b_pass_change_vs_WT"},
        {"netMHCIIpan_mean_window_improvement": "improvement"}, watch,
    )
    return _complete(out, validate, watch)
