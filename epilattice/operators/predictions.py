"""Unique peptides to scores, and scores back to all variants that carry the peptide."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import passes
from ..sources.settled import pinned
from ..sources.stored import BROADCAST_ROWS, Stored
from .checks import all_matched, require_columns, unique_keys
from .skew import hot_keys, planned_by_default, salted_join
from .watch import Watch

EL_RANK, AFFINITY, EL_RANK_2 = "netMHCpan_EL_rank", "MHCflurry_affinity_percentile", "netMHCIIpan_EL_rank"


def ordered_distinct(values: Sequence) -> list:
    """Parameters without repeats, in the order given."""
    return list(dict.fromkeys(values))


def peptides_of(peptides: DataFrame, k: int) -> DataFrame:
    """The distinct, non-blank peptides of one length."""
    return peptides.where(F.col("k") == k).select(F.trim("peptide").alias("peptide")).where("peptide <> ''").distinct()


def peptide_allele_pairs(peptides: DataFrame, alleles: Sequence[str]) -> DataFrame:
    """Every distinct peptide with every allele. The alleles are a literal array, so nothing is shuffled for them."""
    distinct = peptides.select(F.trim("peptide").alias("peptide")).where("peptide <> ''").distinct()
    return distinct.select("peptide", F.explode(F.array(*map(F.lit, ordered_distinct(alleles)))).alias("allele"))


def score_peptides(pairs: DataFrame, scorer: DataFrame | Callable, schema: str | None = None, partitions: int | None = None) -> DataFrame:
    """Scores for (peptide, allele) pairs.

    scorer is a table with those two columns and scores, joined to the pairs; or a function from an iterator of pandas
    frames to another one, for a predictor that runs in the workers, with the schema of its rows.
    """
    if isinstance(scorer, DataFrame):
        return pairs.join(require_columns(scorer, ["peptide", "allele"], "score table"), ["peptide", "allele"])
    if schema is None:
        raise ValueError("a scorer function needs a schema")
    dealt = pairs.repartition(partitions, "allele", "peptide") if partitions else pairs.repartition("allele", "peptide")
    return dealt.mapInPandas(scorer, schema)


def map_predictions(predictions: DataFrame, peptides: DataFrame, fragments: DataFrame, flags: dict[str, tuple[str, float]], how: str = "left",
                    lowest: str | None = None, validate: bool = False, hot: Mapping[str, int] | None = None, watch: Watch | None = None) -> DataFrame:
    """predictions(allele, peptide, scores...) on every occurrence: one row for each allele, variant and window.

    flags names pass columns: {flag: (score column, threshold)}; missing scores do not pass. how is `left` (MHC-I: a
    prediction without an occurrence stays) or `inner` (MHC-II). lowest keeps, of rows that agree in allele, peptide,
    variant and window, the one of the lowest score in that column, null last. peptides may carry peptide_id, else
    that column is null. The joins go on (peptide, k), so surrogate ids are not needed.

    hot has the peptides that are in so many variants that they are to be cut (skew.hot_keys of the fragments). If it is
    not given, they are looked for where adaptive execution would not split them: one pass over the fragments.

    validate raises for predictions that occur twice or not at all, by jobs of its own; a watch finds predictions that
    the library lacks in the same pass, and reports mapped: n_rows and n_<flag> of the rows that come out.
    """
    if hot is None:
        hot = hot_keys(fragments, "peptide") if planned_by_default(fragments.sparkSession) else {}
    predictions = predictions.withColumn("k", F.length("peptide")) if "k" not in predictions.columns else predictions
    ids = peptides if "peptide_id" in peptides.columns else peptides.withColumn("peptide_id", F.lit(None).cast("string"))
    if validate:
        unique_keys(predictions, ["allele", "peptide"], "predictions")
        all_matched(predictions, ids, ["peptide", "k"], "predicted peptides that are not in the library")
    scores = [c for c in predictions.columns if c not in ("allele", "peptide", "k")]
    scored = predictions.join(ids.select("peptide", "k", "peptide_id", "occurrence_count"), ["peptide", "k"], "left" if watch else how)
    if watch:
        scored = watch.forbid(scored, F.col("occurrence_count").isNull(), "predicted peptides that are not in the library", ["allele", "peptide"])
        scored = scored if how == "left" else scored.where("occurrence_count IS NOT NULL")
    scored = _passed(scored, flags)
    # a peptide of the wild type is in most variants: an inner join can be split by its hot keys, which an outer one
    # can't; predictions without an occurrence are added apart
    out = salted_join(scored, fragments, ["peptide", "k"], hot, ["variant_id", "start"])
    if how == "left":
        alone = scored.join(fragments.select("peptide", "k").distinct(), ["peptide", "k"], "left_anti")
        out = out.unionByName(alone, allowMissingColumns=True)
    out = _spread(out, fragments, scores, flags)
    out = keep_lowest(out, lowest) if lowest else out
    return watch.count(out, "mapped", n_rows=F.count(F.lit(1)), **{f"n_{f}": F.count_if(F.col(f)) for f in flags}) if watch else out


def _passed(scored: DataFrame, flags: dict[str, tuple[str, float]]) -> DataFrame:
    for flag, (score, threshold) in flags.items():
        scored = scored.withColumn(flag, passes(F.col(score), threshold))
    return scored


def _spread(out: DataFrame, fragments: DataFrame, scores: Sequence[str], flags: dict) -> DataFrame:
    metadata = [c for c in fragments.columns if c not in ("variant_id", "k", "peptide", "start", "end")]
    return out.select(
        "allele", "peptide_id", "peptide", "k", "variant_id", "start", "end", F.length("peptide").alias("length"), "occurrence_count",
        *metadata, *scores, *flags,
    )


def map_stored(predictions: Stored, fragments: Stored, flags: dict[str, tuple[str, float]], how: str = "left") -> DataFrame:
    """map_predictions over stored tables of as many buckets, predictions(allele, peptide, k, scores...) being stored with
    the fragments' hot peptides: bucket meets bucket without a shuffle, and hot peptides' occurrences stay where they are
    and meet their few predictions by broadcast."""
    if predictions.buckets != fragments.buckets or predictions.hot != fragments.hot:
        raise ValueError("the tables are stored in different ways")
    scores = [c for c in predictions.rows.columns if c not in ("allele", "peptide", "k")]
    cold = _passed(predictions.rows.join(fragments.rows.groupBy("peptide", "k").agg(F.count("*").alias("occurrence_count")), ["peptide", "k"], how), flags)
    out = cold.join(fragments.rows, ["peptide", "k"])
    counts, _ = pinned(fragments.hot_rows.groupBy("peptide", "k").agg(F.count("*").alias("occurrence_count")), BROADCAST_ROWS)
    few, small = pinned(_passed(predictions.hot_rows.join(F.broadcast(counts), ["peptide", "k"], how), flags), BROADCAST_ROWS)
    out = out.unionByName((F.broadcast(few) if small else few).join(fragments.hot_rows, ["peptide", "k"]))
    if how == "left":
        alone = cold.join(fragments.rows.select("peptide", "k"), ["peptide", "k"], "left_anti").unionByName(few.where("occurrence_count IS NULL"))
        out = out.unionByName(alone, allowMissingColumns=True)
    return _spread(out.withColumn("peptide_id", F.lit(None).cast("string")), fragments.rows, scores, flags)


def keep_lowest(df: DataFrame, score: str) -> DataFrame:
    """One row for each allele, peptide, variant and window: that of the lowest score, null last.

    Rows are dealt by the whole key first: else they would be sorted where a join by peptide left them, in the memory of
    its sorts and a hot peptide's in one task. A variant's id comes first, as it tells more rows apart than an allele's name."""
    keys = ["variant_id", "start", "allele", "end", "k", "peptide"]
    return keep_lowest_ranked(df.repartition(*keys), score, keys)


def keep_lowest_ranked(df: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    """The same for any keys, by a window with a group limit; columns that nothing reads later on are not sorted."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.asc_nulls_last(score)))
    return df.withColumn("_n", place).where("_n = 1").drop("_n")


def pass_report(mapped: DataFrame, flags: Sequence[str]) -> DataFrame:
    """One row for each allele: how many rows, and how many pass each flag."""
    return mapped.groupBy("allele").agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])


def rename_alleles(df: DataFrame, crosswalk: DataFrame, spelling: str) -> DataFrame:
    """A predictor's allele spelling into the common name, by a crosswalk(name, spellings...); unknown ones stay.

    A crosswalk has a row for each allele of a run, mostly tens; beyond 100,000 the join is shuffled.
    """
    names = crosswalk.select(F.col(spelling).alias("allele"), F.col("name").alias("_name"))
    small = names.limit(100_001).count() <= 100_000
    return df.join(F.broadcast(names) if small else names, "allele", "left").withColumn("allele", F.coalesce("_name", "allele")).drop("_name").select(*df.columns)
