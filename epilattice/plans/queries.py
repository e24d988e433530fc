"""The registered screening queries over the derived library, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import count_mutations, mutation_list, mutation_string, normalised_allele, peptide_mutation_string, vr_slice
from ..operators import annotate as an
from ..operators import mutations as mu
from ..operators import scores as sc
from ..operators.chemistry import physicochemical_models
from ..operators.combine import combine_predictions, merge_report
from ..operators.fragments import count_stops, counted_peptides, drop_stops, fragment, numbered_peptides, peptide_map, unique_peptides
from ..operators.predictions import keep_lowest, map_predictions, map_stored, pass_report, peptide_allele_pairs, score_peptides
from ..sources.readers import clean_library
from ..sources.score_store import ScoreStore
from ..sources.settled import shared_dir
from ..sources.stored import store
from . import files
from . import fixtures as fx
from .oracles import build
from .screens import screen_mhci, screen_mhcii

K, K2 = 9, 15

def kept_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_stops(fx.library(spark, sf_dir), fx.REGION)


def windows_of(library: DataFrame, k: int = K) -> DataFrame:
    return fragment(drop_stops(library, fx.REGION), [k], fx.REGION, "overlap")


def fragments(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    return windows_of(fx.library(spark, sf_dir), k)


def library_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("id"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("seq"), "c_mktsegment")
    return clean_library(raw, "id", "seq", ["c_mktsegment"])


def fragment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments(spark, sf_dir)


def fragment_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment(kept_library(spark, sf_dir), [K], fx.REGION, "contained")


def fragment_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment(fx.library(spark, sf_dir), [K])


def fragment_multi_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment(kept_library(spark, sf_dir), [8, 9, 10], fx.REGION, "overlap")


def stop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_stops(fx.library(spark, sf_dir), fx.REGION)


def document_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long, uneven texts as sequences: how often each 6-mer of the documents occurs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("variant_id"), F.col("text").alias("aa_sequence"))
    return counted_peptides(docs, [6])


def unique_peptides_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_peptides(fragments(spark, sf_dir))


def numbered_peptides_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept_library(spark, sf_dir).withColumn("_row", F.col("variant_id").cast("long"))
    return numbered_peptides(fragment(rows, [K], fx.REGION, "overlap"), ["_row"], [K])


def peptide_map_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fragments(spark, sf_dir)
    ids = unique_peptides(own).withColumn("peptide_id", F.concat(F.lit("pep_"), "peptide"))
    return peptide_map(own, ids)


def peptide_allele_pairs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peptide_allele_pairs(unique_peptides(fragments(spark, sf_dir)), fx.ALLELES)


def allele_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/customer.parquet")
    raw = F.concat(F.when(F.col("c_custkey") % 3 == 0, " H-2-D").when(F.col("c_custkey") % 3 == 1, "HLA-A*0").otherwise("H-2-K"), F.substring("c_mktsegment", 1, 2))
    return own.select(raw.alias("raw"), normalised_allele(raw).alias("allele")).groupBy("raw", "allele").agg(F.count("*").alias("n"))


def _mapped(spark: SparkSession, sf_dir: str, predict, flag: str, score: str, threshold: float, k: int = K, alleles=None, how: str = "left", source=None) -> DataFrame:
    own = source if source is not None else fragments(spark, sf_dir, k)
    peptides = unique_peptides(own)
    return map_predictions(predict(peptide_allele_pairs(peptides, alleles or fx.ALLELES)), peptides, own, {flag: (score, threshold)}, how)


def mapped_net(spark: SparkSession, sf_dir: str, source=None) -> DataFrame:
    return _mapped(spark, sf_dir, fx.net_predictions, sc.NET_PASS, "netMHCpan_EL_rank", 2.0, source=source)


def mapped_flurry(spark: SparkSession, sf_dir: str, source=None) -> DataFrame:
    return _mapped(spark, sf_dir, fx.flurry_predictions, sc.FLURRY_PASS, "MHCflurry_affinity_percentile", 2.0, source=source)


def mapped_mhcii(spark: SparkSession, sf_dir: str, source=None) -> DataFrame:
    return _mapped(spark, sf_dir, fx.mhcii_predictions, sc.BINDER, "netMHCIIpan_EL_rank", 5.0, K2, fx.ALLELES_2, "inner", source)


def stored_score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_map_mhci_wide over stored tables: both are in buckets by peptide, and their join shuffles neither."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = store(fragments(spark, sf_dir), buckets)
    scored = fx.net_predictions(peptide_allele_pairs(own.peptides(), fx.ALLELES)).withColumn("k", F.lit(K))
    return map_stored(store(scored, buckets, hot=own.hot), own, {sc.NET_PASS: ("netMHCpan_EL_rank", 2.0)})


def incremental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of scores filled twice: for the wild type that the library shows, then for the whole library, of which
    only what is new is scored. A pair's version tells which run scored it."""
    store = ScoreStore(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", "netMHCpan_EL_score double, netMHCpan_EL_rank double")
    wild = fragment(fx.inferred_wt_library(spark, sf_dir), [K], fx.REGION, "overlap")
    for own in (wild, fragments(spark, sf_dir)):
        store.update(peptide_allele_pairs(unique_peptides(own), fx.ALLELES), fx.net_predictions, fx.ALLELES)
    return store.read()


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table scorer: the pairs joined with a score table that lacks every peptide that begins with D."""
    pairs = peptide_allele_pairs(unique_peptides(fragments(spark, sf_dir)), fx.ALLELES)
    return score_peptides(pairs, fx.net_predictions(pairs.where("NOT startswith(peptide, 'D')")))


def dedup_lowest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row twice, the second with a rank that is worse by one or missing."""
    rank = F.col("netMHCpan_EL_rank")
    worse = F.when(F.col("start") % 2 == 0, rank + 1)
    # both rows come from one mapping, not from one each
    twice = mapped_net(spark, sf_dir).withColumn("netMHCpan_EL_rank", F.explode(F.array(rank, worse)))
    kept = keep_lowest(twice, "netMHCpan_EL_rank")
    return kept.select("allele", "variant_id", "start", "peptide", "netMHCpan_EL_rank")


def pass_report_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pass_report(mapped_net(spark, sf_dir), [sc.NET_PASS])


def _one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both predictors' whole tables, mapped and combined. Each lacks what the derived tables give it no score for
    (hashes of allele and peptide, others for each predictor), as a predictor lacks peptides it can't score."""
    own = fragments(spark, sf_dir)
    net = mapped_net(spark, sf_dir, own).where("netMHCpan_EL_rank IS NOT NULL")
    flurry = mapped_flurry(spark, sf_dir, own).where("MHCflurry_affinity_percentile IS NOT NULL")
    return combine_predictions(net, flurry, ["criteria"])


def combine_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_sided(spark, sf_dir).drop("peptide_id", "length")


def merge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_report(_one_sided(spark, sf_dir))


def vr_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vr = vr_slice(F.col("aa_sequence"), *fx.REGION)
    return fx.library(spark, sf_dir).select("variant_id", vr.alias("VR_sequence"), mutation_string(vr, F.lit(fx.VR)).alias("VR_mutation"))


def infer_wt_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.inferred_wt(fx.library(spark, sf_dir), fx.REGION)


def peptide_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants are labelled before they are cut, so that windows carry the labels and are joined with nothing."""
    rows = an.peptide_labels(windows_of(an.labelled(fx.library(spark, sf_dir), fx.REGION, fx.VR)), fx.REGION)
    return rows.select("variant_id", "start", "VR_mutation", "peptide_mutation")


def mutation_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("VR_mutation")
    return vr_mutation(spark, sf_dir).select("variant_id", count_mutations(m).cast("long").alias("n"), F.array_join(F.sort_array(mutation_list(m)), ",").alias("labels"))


def combined(spark: SparkSession, sf_dir: str, wt: bool = False) -> DataFrame:
    return _screened(fx.wt_library(spark) if wt else fx.library(spark, sf_dir))


def _screened(library: DataFrame, alleles: list[str] = fx.ALLELES) -> DataFrame:
    pairs = peptide_allele_pairs(unique_peptides(windows_of(library)), alleles)
    rows = screen_mhci(library, fx.net_predictions(pairs), fx.flurry_predictions(pairs), [K], fx.REGION, wt_vr=fx.VR)
    return rows.withColumn("peptide_id", F.col("peptide"))


def screen_mhci_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = fx.library(spark, sf_dir)
    pairs = peptide_allele_pairs(unique_peptides(windows_of(library)), fx.ALLELES)
    out = screen_mhci(library, fx.net_predictions(pairs), fx.flurry_predictions(pairs), [K], fx.REGION, wt_vr=fx.VR)
    return out.groupBy("allele", "VR_mutation").agg(F.count("*").alias("n_rows"), F.count_if(sc.NET_PASS).alias("n_net"), F.count_if(sc.FLURRY_PASS).alias("n_flurry"), F.count_if(F.col("peptide_mutation") != "WT").alias("n_changed"))


def screen_mhcii_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = fx.library(spark, sf_dir)
    pairs = peptide_allele_pairs(unique_peptides(windows_of(library, K2)), fx.ALLELES_2)
    out = screen_mhcii(library, fx.mhcii_predictions(pairs), [K2], fx.REGION, wt_vr=fx.VR)
    return out.groupBy("allele", "VR_mutation").agg(F.count("*").alias("n_rows"), F.count_if(sc.BINDER).alias("n_binder"), F.count_if(F.col("peptide_mutation") != "WT").alias("n_changed"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """To six places, and without a sign at zero, which sums of differences can have either way."""
    return df.withColumns({c: F.when(F.round(c, 6) == 0, F.lit(0.0)).otherwise(F.round(c, 6)) for c in names})


def abs_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sc.absolute_scores(combined(spark, sf_dir)), "netMHCpan_mean_top3", "MHCflurry_mean_top3")


def wt_reference_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the wild type that the library itself shows: its most frequent variable region."""
    return sc.with_expected(sc.wt_reference(sc.prepare_windows(_screened(fx.inferred_wt_library(spark, sf_dir)))))


def wt_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.wt_relative_windows(sc.prepare_windows(combined(spark, sf_dir)), sc.wt_reference(sc.prepare_windows(combined(spark, sf_dir, True))))
    out = out.select("allele", "variant_id", "start", "changed_window", "netMHCpan_window_improvement", "MHCflurry_window_improvement", "both_pass_change_vs_WT", "either_pass_change_vs_WT")
    return _rounded(out, "netMHCpan_window_improvement", "MHCflurry_window_improvement")


def mhci_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.wt_scores_mhci(combined(spark, sf_dir), combined(spark, sf_dir, True))


def large_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the benchmark: a hundred times the variants, one for each order, and five alleles."""
    library = fx.library(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    return sc.wt_scores_mhci(_screened(library, fx.MORE_ALLELES), _screened(fx.wt_library(spark), fx.MORE_ALLELES))


def wt_scores_mhci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mhci_scores(spark, sf_dir), "netMHCpan_mean_window_improvement", "MHCflurry_mean_window_improvement")


def wt_scores_mhcii(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = fx.library(spark, sf_dir)
    rows = an.annotate(mapped_mhcii(spark, sf_dir, windows_of(library, K2)), library, fx.REGION, fx.VR)
    wt = mapped_mhcii(spark, sf_dir, fragment(fx.wt_library(spark), [K2], fx.REGION, "overlap"))
    out = sc.wt_scores_mhcii(rows, an.annotate(wt, fx.wt_library(spark), fx.REGION, fx.VR))
    return _rounded(out, "netMHCIIpan_mean_window_improvement")


def mutation_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mu.recurrent_mutations(mhci_scores(spark, sf_dir), 5)


def mutation_gram_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mu.mutation_gram(mhci_scores(spark, sf_dir), mu.OUTCOMES, 5), "xty")


def mutation_ols_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mu.mutation_ols(mhci_scores(spark, sf_dir), min_count=5)[0]


def mutation_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mu.mutation_ols(mhci_scores(spark, sf_dir), min_count=5)[1]


def mutation_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' normal equations, which SQL can say: sums of residuals are 0."""
    return _rounded(mu.model_residuals(mhci_scores(spark, sf_dir), min_count=5)[0], "residual")


def mutation_fit_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the fits: sizes, sums of squares, and that r_squared is the residuals'."""
    out = mu.model_residuals(mhci_scores(spark, sf_dir), min_count=5)[1]
    return _rounded(out, "tss", "gap").select("allele", "outcome", "n_variants", "n_mutations", "design_columns", "tss", "gap")


def bootstrap_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the 500 replicates draws as many variants as there are."""
    return mu.bootstrap_totals(mhci_scores(spark, sf_dir)).drop("n_left_out")


def mutation_coefficients_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mu.mutation_coefficients(mhci_scores(spark, sf_dir), fx.VR, fx.REGION[0] - 1, min_count=5)[0]


def derived_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coefficient for each (supplier nation as allele, outcome, mutation seen in the library), by hashing."""
    labels = vr_mutation(spark, sf_dir).select(F.explode(mutation_list(F.col("VR_mutation"))).alias("mutation")).distinct()
    alleles = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("a"), F.col("s_nationkey").cast("string")).alias("allele")).distinct()
    keys = labels.withColumn("o", F.explode(F.array(*map(F.lit, fx.OUTCOME_NAMES)))).join(F.broadcast(alleles))  # at most 25 nations
    out = keys.select("allele", F.col("o").alias("outcome"), "mutation", (fx.hashed_score("co", F.concat("allele", "o"), F.col("mutation")) - F.lit(50.0)).alias("full_data_coefficient"))
    stable = F.coalesce(fx.hashed_score("st", F.concat("allele", "outcome"), F.col("mutation")) / F.lit(100.0), F.lit(0.0))
    return mu.parsed_mutations(out.withColumn("sign_stability", stable).where("full_data_coefficient IS NOT NULL"), fx.VR, fx.REGION[0] - 1)


def parsed_mutations_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = vr_mutation(spark, sf_dir).select(F.explode(mutation_list(F.col("VR_mutation"))).alias("mutation")).distinct()
    out = mu.parsed_mutations(labels, fx.VR, fx.REGION[0] - 1)
    return _rounded(out, "hydrophobicity_change", "volume_change", "charge_change")


def allele_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mu.allele_summary(derived_coefficients(spark, sf_dir)), "median_coefficient", "q1", "q3", "allele_iqr", "sign_agreement")


def top_iqr_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mu.top_iqr(allele_iqr(spark, sf_dir))


def allele_correlation_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(mu.allele_correlation(derived_coefficients(spark, sf_dir)), "pearson_r")


def allele_pivot_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mu.allele_pivot(derived_coefficients(spark, sf_dir), fx.NATION_ALLELES)


def mutation_effects_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mu.mutation_effects(derived_coefficients(spark, sf_dir), 0.5)
    return _rounded(out, "median_allele_coefficient", "q1", "q3", "allele_iqr", "support_fraction").drop("hydrophobicity_change", "volume_change", "charge_change")


def heatmap_cells_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mu.heatmap_cells(derived_coefficients(spark, sf_dir), 0.5)


def _physchem(part: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return physicochemical_models(mu.mutation_effects(derived_coefficients(spark, sf_dir), 0.5))[part]

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wt_scores_mhci(spark, sf_dir)


QUERIES = {
    "library_clean": library_clean,
    "fragment_k9_overlap": fragment_overlap,
    "fragment_contained": fragment_contained,
    "fragment_all": fragment_all,
    "fragment_multi_k": fragment_multi_k,
    "stop_filter": stop_filter,
    "document_kmers": document_kmers,
    "unique_peptides": unique_peptides_q,
    "numbered_peptides": numbered_peptides_q,
    "peptide_map": peptide_map_q,
    "peptide_allele_pairs": peptide_allele_pairs_q,
    "allele_spelling": allele_spelling,
    "incremental_scores": incremental_scores,
    "score_table": score_table,
    "score_map_mhci_wide": mapped_net,
    "stored_score_map": stored_score_map,
    "score_map_mhci_long": mapped_flurry,
    "score_map_mhcii": mapped_mhcii,
    "dedup_lowest_rank": dedup_lowest_rank,
    "pass_report": pass_report_q,
    "combine_outer": combine_outer,
    "merge_status": merge_status,
    "vr_mutation": vr_mutation,
    "infer_wt_mode": infer_wt_mode,
    "peptide_mutation": peptide_mutation,
    "mutation_count": mutation_count,
    "screen_mhci": screen_mhci_q,
    "screen_mhcii": screen_mhcii_q,
    "abs_scores": abs_scores,
    "wt_reference": wt_reference_q,
    "wt_windows": wt_windows,
    "wt_scores_mhci": wt_scores_mhci,
    "wt_scores_mhcii": wt_scores_mhcii,
    "mutation_recurrence": mutation_recurrence,
    "mutation_gram": mutation_gram_q,
    "mutation_ols": mutation_ols_q,
    "mutation_fits": mutation_fits,
    "mutation_coefficients": mutation_coefficients_q,
    "mutation_residuals": mutation_residuals,
    "mutation_fit_sums": mutation_fit_sums,
    "bootstrap_draws": bootstrap_draws,
    "parsed_mutations": parsed_mutations_q,
    "allele_iqr": allele_iqr,
    "top_iqr": top_iqr_q,
    "allele_correlation": allele_correlation_q,
    "allele_pivot": allele_pivot_q,
    "mutation_effects": mutation_effects_q,
    "heatmap_cells": heatmap_cells_q,
    "physchem_models": _physchem("models"),
    "physchem_coefficients": _physchem("coefficients"),
    "physchem_partial_r2": _physchem("partial_r_squared"),
    "physchem_positions": _physchem("positions"),
}

QUERIES |= files.QUERIES
ORACLES = build(mu.HYDROPHOBICITY, mu.VOLUME, {x: mu.side_chain_charge(x) for x in mu.HYDROPHOBICITY}) | files.ORACLES
