"""MHC-I and MHC-II screens as one lazy plan each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import normalised_allele
from ..operators.annotate import labelled, peptide_labels, variant_labels
from ..operators.checks import all_matched, check_alleles, unique_keys
from ..operators.combine import KEYS, SHARED, combine_scores
from ..operators.fragments import drop_stops, fragment, unique_peptides
from ..operators.predictions import EL_RANK_2, map_predictions
from ..operators.watch import Watch


def _fragments(library: DataFrame, kmers: Sequence[int], region: tuple[int, int], mode: str | None, stops: bool) -> DataFrame:
    return fragment(drop_stops(library, region) if stops else library, kmers, region, mode)


def screen_mhci(library: DataFrame, net: DataFrame, flurry: DataFrame, kmers: Sequence[int], region: tuple[int, int], mode: str | None = "overlap", drop_stop_codons: bool = True,
                wt_vr: str | None = None, net_threshold: float = 2.0, flurry_threshold: float = 2.0, alleles: Sequence[str] | None = None,
                fragments: DataFrame | None = None, validate: bool = False, watch: Watch | None = None) -> DataFrame:
    """library(variant_id, aa_sequence, metadata...) and two predictors' tables to one annotated row for each allele,
    peptide, variant and window. A stage that has run before is skipped by passing its table (fragments).

    alleles, if given with validate, must be those of the first predictor, and hold all of the second. validate runs
    jobs of its own before the screen; a watch (watch.py) finds predicted peptides that the library lacks and repeated
    rows of the second predictor in the pass itself, and reports merged and mapped.
    """
    if validate and alleles:
        check_alleles(net, alleles)
        check_alleles(flurry, alleles, missing=False)
    if validate:
        unique_keys(variant_labels(library, region, wt_vr), ["variant_id"], "library")
        unique_keys(with_k(flurry), ["allele", "peptide", "k"], "second predictor's table")
    labels = ["VR_sequence", "VR_mutation"]
    if fragments is None:
        fragments = _fragments(labelled(library, region, wt_vr), kmers, region, mode, drop_stop_codons)
    else:
        fragments = fragments.drop(*labels).join(variant_labels(library, region, wt_vr), "variant_id", "left")
    peptides = unique_peptides(fragments)
    if validate:
        all_matched(with_k(net).unionByName(with_k(flurry)), peptides, ["peptide", "k"], "predicted peptides that are not in the library")
    scored = combine_scores(net, flurry, net_threshold, flurry_threshold, watch)
    rows = peptide_labels(map_predictions(scored, peptides, fragments, {}, watch=watch), region)
    last = [c for c in scored.columns if c not in ("allele", "peptide", "k")]
    first = [*KEYS, *SHARED, *[c for c in rows.columns if c not in {*KEYS, *SHARED, *last, *labels, "peptide_mutation"}]]
    return rows.select(*first, *last, *labels, "peptide_mutation")


def with_k(predictions: DataFrame) -> DataFrame:
    k = F.col("k").cast("int") if "k" in predictions.columns else F.length("peptide")
    return predictions.select(normalised_allele(F.col("allele")).alias("allele"), "peptide", k.alias("k"))


def screen_mhcii(library: DataFrame, predictions: DataFrame, kmers: Sequence[int], region: tuple[int, int], mode: str | None = "overlap", drop_stop_codons: bool = True,
                 wt_vr: str | None = None, threshold: float = 5.0, alleles: Sequence[str] | None = None, fragments: DataFrame | None = None, validate: bool = False) -> DataFrame:
    """The MHC-II screen: one annotated row for each allele, peptide, variant and window that was scored."""
    if validate and alleles:
        check_alleles(predictions, alleles)
    if validate:
        unique_keys(variant_labels(library, region, wt_vr), ["variant_id"], "library")
    labels = ["VR_sequence", "VR_mutation"]
    if fragments is None:
        fragments = _fragments(labelled(library, region, wt_vr), kmers, region, mode, drop_stop_codons)
    else:
        fragments = fragments.drop(*labels).join(variant_labels(library, region, wt_vr), "variant_id", "left")
    flags = {f"{EL_RANK_2}_binder": (EL_RANK_2, threshold)}
    mapped = peptide_labels(map_predictions(predictions, unique_peptides(fragments), fragments, flags, how="inner", validate=validate), region)
    return mapped.select(*[c for c in mapped.columns if c not in (*labels, "peptide_mutation")], *labels, "peptide_mutation")


def wt_vr_of(sequence: str, region: tuple[int, int]) -> str:
    """The variable region of a known wild-type sequence."""
    return sequence[max(region[0], 1) - 1 : region[1]]


