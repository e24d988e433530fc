"""Registered queries over files: derived tables are written in each format and read back by its reader."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import mutation_string, vr_slice
from ..operators.checks import check_alleles
from ..operators.fragments import drop_stops, fragment, peptide_map, unique_peptides
from ..operators.predictions import peptide_allele_pairs, rename_alleles
from ..operators.scores import FLURRY_PASS, NET_PASS, absolute_scores, prepare_windows, wt_scores_mhci
from ..sources.predictor_files import register_sources
from ..sources.readers import read_fasta, read_library, read_long_predictions, read_peptide_map, read_scores, read_table, read_unique_peptides, read_wide_mhci, read_wide_mhcii, tidy_scores
from ..sources.settled import settle, shared_dir
from ..sources.writers import write_by_allele, write_fragment_tables, write_models, write_pair_input, write_peptide_lists, write_table
from . import fixtures as fx
from . import oracles as o
from .screens import screen_mhci


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _source(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    register_sources(spark)
    return spark.read.format(kind).options(path=path, **options).load()


def _pairs(spark: SparkSession, sf_dir: str, k: int, alleles: list[str]) -> DataFrame:
    own = fragment(drop_stops(fx.library(spark, sf_dir), fx.REGION), [k], fx.REGION, "overlap")
    return peptide_allele_pairs(unique_peptides(own), alleles)


def _with_header(lines: DataFrame, header: list[str]) -> DataFrame:
    """lines(value) with the header lines in front of each partition, and so of each file."""

    def run(batches):
        yield pa.RecordBatch.from_pydict({"value": header})
        for batch in batches:  # under the same schema, in which nulls are allowed
            yield pa.RecordBatch.from_pydict({"value": batch.column("value")})

    return lines.mapInArrow(run, "value string")


def _wide(predictions: DataFrame, alleles: list[str], before: list[str], cells: list[str]) -> DataFrame:
    """A line for each peptide: number, peptide, further columns, and a block of cells for each allele."""
    text = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in cells])
    by = predictions.groupBy("peptide").agg(*[F.max(F.when(F.col("allele") == a, text)).alias(f"_{i}") for i, a in enumerate(alleles)])
    return by.select(F.concat_ws("\t", F.lit("0"), "peptide", *map(F.lit, before), *[f"_{i}" for i in range(len(alleles))]).alias("value"))


def _written_fasta(spark: SparkSession, sf_dir: str) -> str:
    lines = F.concat(F.lit(">"), "variant_id", F.lit(" customer "), "criteria", F.lit("\n"), F.substring("aa_sequence", 1, 30), F.lit("\n"), F.substring("aa_sequence", 31, 1000))
    fx.library(spark, sf_dir).select(lines.alias("value")).write.text(path := _folder(spark, "fasta"))
    return path


def file_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_fasta(spark, _written_fasta(spark, sf_dir))


def source_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, "fasta", _written_fasta(spark, sf_dir))


def file_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.library(spark, sf_dir).select(F.concat(F.lit(" "), "variant_id").alias("gene_id"), F.concat(F.substring("aa_sequence", 1, 9), F.lit(" "), F.substring("aa_sequence", 10, 1000)).alias("seq"), "criteria")
    raw.write.option("header", True).csv(path := _folder(spark, "library"))
    return read_library(spark, path, "gene_id", "seq", ["criteria"])


def file_long_mhci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.flurry_predictions(_pairs(spark, sf_dir, 9, fx.ALLELES))
    names = {c: c.replace("MHCflurry", "mhcflurry") for c in rows.columns}
    rows.withColumnsRenamed(names).write.option("header", True).csv(path := _folder(spark, "long"))
    return read_long_predictions(spark, path)


def _written_mhci(spark: SparkSession, sf_dir: str) -> str:
    alleles = ["H-2-Db", "H-2-Kb"]
    rows = fx.net_predictions(_pairs(spark, sf_dir, 9, alleles)).withColumns({"core": F.lit("c"), "icore": F.lit("i")})
    head = "\t".join(["Pos", "Peptide", "ID", *["core", "icore", "EL_score", "EL_rank"] * 2])
    lines = _wide(rows, alleles, ["P"], ["core", "icore", "netMHCpan_EL_score", "netMHCpan_EL_rank"])
    _with_header(lines, ["# written by a test", "\t\t\tH-2-Db\t\t\t\tH-2-Kb", head]).write.text(path := _folder(spark, "wide"))
    return path


def file_wide_mhci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_wide_mhci(spark, _written_mhci(spark, sf_dir)).drop("netMHCpan_BA_score", "netMHCpan_BA_rank")


def source_wide_mhci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, "wide_mhci", _written_mhci(spark, sf_dir)).drop("netMHCpan_BA_score", "netMHCpan_BA_rank")


def source_one_allele(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One allele's scores: the filter reaches the source, which parses only that allele's cells."""
    return source_wide_mhci(spark, sf_dir).where("allele = 'H-2-Kb'")


def _written_mhcii(spark: SparkSession, sf_dir: str) -> str:
    alleles = ["H-2-IAb", "H-2-IAd"]
    rows = fx.mhcii_predictions(_pairs(spark, sf_dir, 15, alleles))
    head = "\t".join(["Pos", "Peptide", "ID", "Target", *["Core", "Inverted", "Score_EL", "Rank_EL"] * 2])
    lines = _wide(rows, alleles, ["P", "NA"], ["netMHCIIpan_core", "netMHCIIpan_inverted", "netMHCIIpan_EL_score", "netMHCIIpan_EL_rank"])
    _with_header(lines, ["\t\t\t\tH-2-IAb\t\t\t\tH-2-IAd", head]).write.text(path := _folder(spark, "wide2"))
    return path


def file_wide_mhcii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_wide_mhcii(spark, _written_mhcii(spark, sf_dir))


def source_wide_mhcii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, "wide_mhcii", _written_mhcii(spark, sf_dir))


def file_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique peptides and their occurrences, written as text tables, read and joined again."""
    own = fragment(drop_stops(fx.library(spark, sf_dir), fx.REGION), [9], fx.REGION, "overlap")
    ids = settle(unique_peptides(own).withColumn("peptide_id", F.concat(F.lit("pep_"), "peptide")))  # read twice
    write_fragment_tables(own, ids, peptide_map(own, ids), path := _folder(spark, "fragments"), "tsv")
    peptides, places = read_unique_peptides(spark, f"{path}/unique_peptides", True), read_peptide_map(spark, f"{path}/peptide_map", True)
    return places.join(peptides, "peptide_id").select("peptide_id", "peptide", "k", "occurrence_count", "variant_id", "start", "end", "criteria")


def _written_scores(spark: SparkSession, sf_dir: str) -> str:
    """Score tables of single alleles whose columns stand in different orders, one of them without an outcome."""
    vr = vr_slice(F.col("aa_sequence"), *fx.REGION)
    rows = fx.library(spark, sf_dir).select("variant_id", mutation_string(vr, F.lit(fx.VR)).alias("VR_mutation"))
    path = _folder(spark, "scores")
    for allele, columns in (("A", ["allele", "variant_id", "VR_mutation", "o1", "o2"]), ("B", ["o2", "o1", "VR_mutation", "allele", "variant_id"]), ("C", ["VR_mutation", "allele", "o2", "variant_id"])):
        own = rows.withColumn("allele", F.lit(allele)).withColumns({c: fx.hashed_score(c, F.col("allele"), F.col("variant_id")) for c in ("o1", "o2")})
        write_table(own.select(*columns).repartition(1), f"{path}/run_{allele}", "tsv")  # a run leaves one file for an allele; its rows are derived in parallel
    return path


def file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_scores(spark, [_written_scores(spark, sf_dir)], ["o1", "o2"], "part-*")


def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_scores(_source(spark, "allele_scores", _written_scores(spark, sf_dir), outcomes="o1,o2", pathGlobFilter="part-*"), ["o1", "o2"])


def _as_text(rows: DataFrame) -> DataFrame:
    """Rows as a tool may leave them: flags spelt in several ways, window numbers with a point."""
    one = lambda c, words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("peptide", F.lit(c)), F.lit(len(words))) + 1).cast("int"))
    flags = {c: F.when(F.col(c), one(c, ["True", "1", "true", "TRUE"])).otherwise(one(c, ["False", "0", "no", ""])) for c in (NET_PASS, FLURRY_PASS)}
    return rows.withColumns(flags | {c: F.concat(F.col(c).cast("string"), F.lit(".0")) for c in ("start", "end")})


def _screened(spark: SparkSession, sf_dir: str, library: DataFrame) -> DataFrame:
    own = fragment(drop_stops(library, fx.REGION), [9], fx.REGION, "overlap")
    pairs = peptide_allele_pairs(unique_peptides(own), fx.ALLELES)
    rows = screen_mhci(library, fx.net_predictions(pairs), fx.flurry_predictions(pairs), [9], fx.REGION, wt_vr=fx.VR)
    return rows.withColumn("peptide_id", F.col("peptide"))


def _with_again(rows: DataFrame, **others: Column) -> DataFrame:
    """Every row, and every row again with other values; both are made by one screen."""
    twice = rows.withColumn("_again", F.explode(F.array(F.lit(False), F.lit(True))))
    return twice.withColumns({c: F.when(F.col("_again"), x).otherwise(F.col(c)) for c, x in others.items()}).drop("_again")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.when(F.round(c, 6) == 0, F.lit(0.0)).otherwise(F.round(c, 6)) for c in names})


def file_abs_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """abs_scores from a text table in which every row comes again, later in the sequence and with better scores."""
    rows = _screened(spark, sf_dir, fx.library(spark, sf_dir))
    better = {"netMHCpan_EL_rank": F.lit(0.001), "MHCflurry_affinity_percentile": F.lit(0.001), NET_PASS: F.lit(True), FLURRY_PASS: F.lit(True)}
    write_table(_as_text(_with_again(rows, start=F.col("start") + 100, **better)), path := _folder(spark, "combined"), "tsv", compressed=True)
    return _rounded(absolute_scores(read_table(spark, path)), "netMHCpan_mean_top3", "MHCflurry_mean_top3")


def file_wt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wt_scores_mhci from text tables in which every window comes again, with a peptide that sorts later."""
    tables = []
    for name, library in (("variants", fx.library(spark, sf_dir)), ("wild", fx.wt_library(spark))):
        rows = _screened(spark, sf_dir, library)
        again = {"peptide": F.concat(F.lit("z"), "peptide"), "netMHCpan_EL_rank": F.lit(0.001), NET_PASS: F.lit(True)}
        write_table(_as_text(_with_again(rows, **again)), path := _folder(spark, name), "tsv", compressed=True)
        tables.append(read_table(spark, path))
    # the wild type's reference takes any row's flag, so its own windows are settled first
    wild = prepare_windows(tables[1])
    return _rounded(wt_scores_mhci(tables[0], wild), "netMHCpan_mean_window_improvement", "MHCflurry_mean_window_improvement")


def _written_repeated(spark: SparkSession, sf_dir: str) -> str:
    """Score tables in which each variant comes again, with labels that sort later."""
    vr = vr_slice(F.col("aa_sequence"), *fx.REGION)
    rows = fx.library(spark, sf_dir).select("variant_id", mutation_string(vr, F.lit(fx.VR)).alias("VR_mutation"))
    path = _folder(spark, "scores")
    for allele in "ABC":
        own = rows.withColumn("allele", F.lit(allele)).withColumns({c: fx.hashed_score(c, F.col("allele"), F.col("variant_id")) for c in ("o1", "o2")})
        again = own.withColumns({"VR_mutation": F.concat(F.lit("~"), "VR_mutation"), "o1": F.lit(-1.0), "o2": F.lit(-1.0)})
        write_table(own.unionByName(again).repartition(1), f"{path}/run_{allele}", "tsv")  # a run leaves one file for an allele; its rows are derived in parallel
    return path


def file_scores_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_scores(spark, [_written_repeated(spark, sf_dir)], ["o1", "o2"], "part-*")


def source_scores_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy_scores(_source(spark, "allele_scores", _written_repeated(spark, sf_dir), outcomes="o1,o2", pathGlobFilter="part-*"), ["o1", "o2"])


def sink_pair_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor's pairs, written and read back."""
    own = fragment(drop_stops(fx.library(spark, sf_dir), fx.REGION), [9], fx.REGION, "overlap")
    write_pair_input(unique_peptides(own), fx.ALLELES, path := _folder(spark, "pairs"))
    return spark.read.option("header", True).csv(path)


def sink_peptide_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor's peptide lists, a folder for each k, written and read back."""
    own = fragment(drop_stops(fx.library(spark, sf_dir), fx.REGION), [8, 9, 10], fx.REGION, "overlap")
    write_peptide_lists(unique_peptides(own), path := _folder(spark, "lists"))
    return spark.read.text(path).select(F.col("value").alias("peptide"), F.col("k").cast("int").alias("k"))


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of each library variant for the suppliers' nations, whose names any file system takes only once changed."""
    own = fx.library(spark, sf_dir).select("variant_id")
    alleles = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("HLA-A*"), F.col("s_nationkey").cast("string"), F.lit(":01")).alias("allele")).distinct()
    return own.join(F.broadcast(alleles)).withColumn("score", fx.hashed_score("by", F.col("allele"), F.col("variant_id")))  # at most 25 nations


def sink_by_allele(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in a folder for each allele; partition folders give the label back."""
    write_by_allele(_derived(spark, sf_dir), path := _folder(spark, "alleles"))
    return spark.read.parquet(path)


def sink_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model tables in a folder for each allele and outcome."""
    rows = _derived(spark, sf_dir).withColumn("outcome", F.concat(F.lit("net change "), F.substring("variant_id", 1, 1)))
    write_models({"coefficients": rows, "summary": rows.groupBy("outcome").agg(F.count("*").alias("n"))}, path := _folder(spark, "models"))
    return spark.read.parquet(f"{path}/coefficients").join(spark.read.parquet(f"{path}/summary"), "outcome")


def sink_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A globally sorted table, and the place of each row by file and row within it."""
    own = fragment(drop_stops(fx.library(spark, sf_dir), fx.REGION), [9], fx.REGION, "overlap")
    write_table(unique_peptides(own), path := _folder(spark, "sorted"), sort=["occurrence_count", "peptide"])
    rows = spark.read.parquet(path).withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    return rows.join(F.broadcast(sizes.withColumn("_before", before)), "_file").select("peptide", "k", "occurrence_count", (F.col("_before") + F.col("_row") + 1).alias("place"))


def allele_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nation keys as a predictor's spelling, into the nations' names; the crosswalk lacks one region's.
    The names are then checked against those asked for."""
    spelling = lambda c: F.concat(F.lit("n-"), F.col(c).cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(spelling("s_nationkey").alias("allele"), "s_suppkey")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey > 0")
    renamed = rename_alleles(rows, nations.select(F.col("n_name").alias("name"), spelling("n_nationkey").alias("spelt")), "spelt")
    check_alleles(renamed, [r[0] for r in nations.select("n_name").collect()], missing=False, unexpected=False)
    return renamed.groupBy("allele").agg(F.count("*").alias("n_rows"), F.sum("s_suppkey").alias("keys"))


QUERIES = {
    "file_abs_scores": file_abs_scores,
    "file_wt_scores": file_wt_scores,
    "file_scores_repeated": file_scores_repeated,
    "sink_pair_input": sink_pair_input,
    "sink_peptide_lists": sink_peptide_lists,
    "sink_by_allele": sink_by_allele,
    "sink_models": sink_models,
    "sink_sorted": sink_sorted,
    "allele_crosswalk": allele_crosswalk,
    "file_fasta": file_fasta,
    "file_library": file_library,
    "file_long_mhci": file_long_mhci,
    "file_wide_mhci": file_wide_mhci,
    "file_wide_mhcii": file_wide_mhcii,
    "file_fragments": file_fragments,
    "file_scores": file_scores,
    "source_fasta": source_fasta,
    "source_wide_mhci": source_wide_mhci,
    "source_one_allele": source_one_allele,
    "source_wide_mhcii": source_wide_mhcii,
    "source_scores": source_scores,
    "source_scores_repeated": source_scores_repeated,
}

UNIQUE = f"WITH {o.FRAG}, u AS (SELECT DISTINCT peptide FROM frag)"
DERIVED = f"""{o.LIBRARY}, derived AS (SELECT variant_id, allele, {fx.duck_score('by', 'allele', 'variant_id')} AS score
FROM library, (SELECT DISTINCT 'HLA-A*' || s_nationkey || ':01' AS allele FROM supplier))"""
LABEL = "regexp_replace(regexp_replace({}, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g')"
SCORES_SQL = f"""WITH {o.LIBRARY}, {o.LABELS} SELECT allele, variant_id, VR_mutation, {fx.duck_score('o1', 'allele', 'variant_id')} AS o1, {fx.duck_score('o2', 'allele', 'variant_id')} AS o2
FROM labels, {fx.duck_alleles(['A', 'B', 'C'])}"""
ORACLES = {
    "file_abs_scores": o.ABS_SCORES,
    "file_wt_scores": o.WT_SCORES,
    "file_scores_repeated": SCORES_SQL,
    "sink_pair_input": f"WITH {o.FRAG} SELECT DISTINCT allele, peptide FROM frag, {fx.duck_alleles(fx.ALLELES)}",
    "sink_peptide_lists": f"WITH {o.LIBRARY} SELECT DISTINCT peptide, k::int AS k FROM (" + " UNION ALL ".join(f"SELECT peptide, k FROM ({o.windows('kept', k, o.OVERLAP)})" for k in (8, 9, 10)) + ")",
    "sink_by_allele": f"WITH {DERIVED} SELECT *, {LABEL.format('allele')} AS allele_label FROM derived",
    "sink_models": f"""WITH {DERIVED}, m AS (SELECT *, 'net change ' || substr(variant_id, 1, 1) AS outcome FROM derived)
SELECT *, {LABEL.format('allele')} AS allele_label, {LABEL.format('outcome')} AS outcome_label FROM m JOIN (SELECT outcome, count(*) AS n FROM m GROUP BY 1) USING (outcome)""",
    "sink_sorted": f"WITH {o.FRAG}, u AS (SELECT peptide, k, count(*) AS occurrence_count FROM frag GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY occurrence_count, peptide) AS place FROM u",
    "allele_crosswalk": """SELECT coalesce(n_name, 'n-' || s_nationkey) AS allele, count(*) AS n_rows, sum(s_suppkey)::bigint AS keys
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 0) ON n_nationkey = s_nationkey GROUP BY 1""",
    "file_fasta": f"WITH {o.LIBRARY} SELECT variant_id, variant_id || ' customer ' || criteria AS record_desc, aa_sequence FROM library",
    "file_library": f"WITH {o.LIBRARY} SELECT * FROM library",
    "file_long_mhci": f"{UNIQUE} SELECT peptide, allele, {fx.duck_score('fa')} AS MHCflurry_affinity_percentile, {fx.duck_score('fp')} AS MHCflurry_presentation_percentile, 9::int AS k FROM u, {fx.duck_alleles(fx.ALLELES)}",
    "file_wide_mhci": f"{UNIQUE} SELECT peptide, 9::int AS k, allele, {fx.duck_score('ns')} AS netMHCpan_EL_score, {fx.duck_score('nr')} AS netMHCpan_EL_rank FROM u, {fx.duck_alleles(['H-2-Db', 'H-2-Kb'])}",
    "file_wide_mhcii": f"""WITH {o.FRAG2}, u AS (SELECT DISTINCT peptide FROM frag) SELECT peptide, allele, substr(peptide, 4, 9) AS netMHCIIpan_core, 0.0::double AS netMHCIIpan_inverted,
{fx.duck_score('2s')} AS netMHCIIpan_EL_score, {fx.duck_score('2r')} AS netMHCIIpan_EL_rank FROM u, {fx.duck_alleles(['H-2-IAb', 'H-2-IAd'])}""",
    "file_fragments": f"""WITH {o.FRAG}, u AS (SELECT peptide, count(*) AS occurrence_count FROM frag GROUP BY 1)
SELECT 'pep_' || peptide AS peptide_id, peptide, k, occurrence_count, variant_id, start, "end", criteria FROM frag JOIN u USING (peptide)""",
    "file_scores": f"""WITH {o.LIBRARY}, {o.LABELS} SELECT allele, variant_id, VR_mutation, CASE WHEN allele <> 'C' THEN {fx.duck_score('o1', 'allele', 'variant_id')} END AS o1, {fx.duck_score('o2', 'allele', 'variant_id')} AS o2
FROM labels, {fx.duck_alleles(['A', 'B', 'C'])}""",
}
# the data sources give what the readers give
ORACLES |= {f"source_{name}": ORACLES[f"file_{name}"] for name in ("fasta", "wide_mhci", "wide_mhcii", "scores", "scores_repeated")}
ORACLES["source_one_allele"] = f"SELECT * FROM ({ORACLES['file_wide_mhci']}) WHERE allele = 'H-2-Kb'"
