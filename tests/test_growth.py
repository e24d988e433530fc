"""That work and memory don't grow faster than the tables."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from epilattice.operators import fragments as fr
from epilattice.operators import mutations as mu
from epilattice.operators import scores as sc
from epilattice.operators.combine import FLURRY, KEYS, NET, combine_predictions
from epilattice.plans import files, queries
from epilattice.sources import writers
from epilattice.sources.readers import read_table
from epilattice.sources.settled import CLEANUP, settle
from epilattice.sources.writers import write_by_allele, write_models


def _counted(spark, n):
    """Scores of n variants, and how often a row of them was made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        made.add(1)
        return float(x)

    scores = spark.range(n, numPartitions=1).select(F.lit("a").alias("allele"), F.col("id").cast("string").alias("variant_id"), F.lit("A1C").alias("VR_mutation"), value("id").alias("o"))
    return scores, made


def test_gram_makes_scores_once(spark):
    scores, made = _counted(spark, 50)
    assert mu.mutation_gram(scores, ["o"], 1).count() == 4 and made.value == 50


def test_bootstrap_makes_scores_once(spark):
    scores, made = _counted(spark, 50)
    assert mu.bootstrap_totals(scores, ["o"], 3).count() == 3 and made.value == 50


def test_numbering_hashes_windows(spark, monkeypatch):
    plans, settle = [], fr.settle
    monkeypatch.setattr(fr, "settle", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or settle(df))
    rows = spark.createDataFrame([(2, "2", "ABAB"), (1, "1", "BAC"), (None, "0", "CAB")], "row int, variant_id string, aa_sequence string")
    out = fr.numbered_peptides(fr.fragment(rows, [2]), ["row"], [2])
    assert {(r.peptide_id, r.peptide, r.occurrence_count) for r in out.collect()} == {("pep_000001", "CA", 1), ("pep_000002", "AB", 3), ("pep_000003", "BA", 2), ("pep_000004", "AC", 1)}
    windows = plans[0].index("Generate")
    assert plans[0].rindex("HashAggregate", 0, windows) > plans[0].rindex("SortAggregate", 0, windows)


def _files(path):
    return sorted(f.parent.name for f in path.rglob("*.parquet"))


def test_folders_are_dealt_to_tasks(spark, tmp_path):
    rows = spark.range(400, numPartitions=4).select(F.concat(F.lit("a"), F.col("id") % 3).alias("allele"), F.lit("o").alias("outcome"), "id")
    write_by_allele(rows, str(tmp_path / "by"))
    write_models({"m": rows}, str(tmp_path / "models"))
    assert _files(tmp_path / "by") == ["allele_label=a0", "allele_label=a1", "allele_label=a2"] and len(_files(tmp_path / "models")) == 3
    assert spark.read.parquet(str(tmp_path / "by")).count() == 400


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_whole_numbers_go_no_way_over_text(spark):
    rows = spark.createDataFrame([("H-2-Db", "ABC", "v", 1, 3, 3, 0.5, 1.5, True)], f"allele string, peptide string, variant_id string, start int, `end` int, k int, {NET[0]} double, {NET[1]} double, {NET[2]} boolean")
    other = rows.select(*KEYS, *[F.col(a).alias(b) for a, b in zip(NET, FLURRY, strict=True)])
    out = combine_predictions(rows, other)
    assert "RLIKE" not in _plan(out) and out.first().allele == "H2-D*b" and out.first().start == 1


def test_windows_are_summed_by_hashing(spark):
    columns = "allele string, variant_id string, peptide_id string, peptide string, start int, `end` int, k int, VR_mutation string, netMHCpan_EL_rank double, netMHCpan_EL_rank_pass boolean, MHCflurry_affinity_percentile double, MHCflurry_affinity_percentile_pass boolean"
    row = lambda v, p, at, m, x: ("a", v, p, p, at, at + 2, 3, m, x, x < 2, x, x < 2)
    variants = spark.createDataFrame([row("v", "ACD", 1, "B2C", 1.0), row("v", "ACE", 1, "B2C", 9.0), row("v", "CDE", 2, "Z", 3.0), row("u", "ABD", 1, None, 1.0)], columns)
    out = sc.wt_scores_mhci(variants, spark.createDataFrame([row("w", "ABD", 1, None, 4.0), row("w", "BDE", 2, None, 1.0)], columns))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    windows = plan.index("Window ")
    # what stands on the windows themselves sums by hashing; texts are compared where a variant's rows are one a label
    assert plan.rindex("HashAggregate", 0, windows) > plan.rindex("SortAggregate", 0, windows) and "min_by" not in plan
    found = {r.variant_id: (r.VR_mutation, r.matched_window_count, r.changed_window_count, r.netMHCpan_new_passed_count, r.netMHCpan_lost_passed_count, r.netMHCpan_mean_window_improvement) for r in out.collect()}
    assert found == {"v": ("B2C", 2, 2, 1, 1, 0.5), "u": ("WT", 1, 0, 1, 0, 0.0)}


def test_models_share_one_design(spark, monkeypatch):
    made, design = [], mu.design_rows
    monkeypatch.setattr(mu, "design_rows", lambda *a: made.append(a) or design(*a))
    scores = spark.createDataFrame([("a", str(i), ["A1C", "A1D;C2E", None][i % 3], float(i)) for i in range(9)], "allele string, variant_id string, VR_mutation string, o double")
    assert {round(r.residual, 9) + 0.0 for r in mu.model_residuals(scores, ["o"], 1)[0].collect()} == {0.0} and len(made) == 1
    assert mu.mutation_coefficients(scores, "AC", 0, ["o"], 1, 5)[0].count() == 3 and len(made) == 2


def test_windows_carry_their_labels(spark, tmp_path):
    spark.range(1, 40).selectExpr("id AS c_custkey", "'x' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    assert "Join" not in _plan(queries.peptide_mutation(spark, str(tmp_path)))


def test_written_peptides_are_counted_once(spark, tmp_path, monkeypatch):
    kept, settle = [], files.settle
    monkeypatch.setattr(files, "settle", lambda df: kept.append(df.columns) or settle(df))
    spark.range(1, 40).selectExpr("id AS c_custkey", "'x' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    assert files.file_fragments(spark, str(tmp_path)).count() == 39 * 25 and len(kept) == 1


def test_lowest_is_found_apart_from_the_join(spark, tmp_path):
    spark.range(1, 40).selectExpr("id AS c_custkey", "'x' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    out = queries.dedup_lowest_rank(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the rows are dealt between the join and the sort that tells them apart, and mapped once for both copies
    assert "Exchange" in plan[plan.index("Window ") : plan.index("Join")] and plan.count("LeftAnti") == 1 and out.count() == 39 * 25 * 2


def test_text_tables_are_compressed(spark, tmp_path, monkeypatch):
    plans, paths, write = [], [], files.write_table
    monkeypatch.setattr(files, "write_table", lambda df, path, *a, **k: (plans.append(_plan(df)), paths.append(path), write(df, path, *a, **k)))
    spark.range(1, 40).selectExpr("id AS c_custkey", "'x' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    for query, tables in ((files.file_abs_scores, 1), (files.file_wt_scores, 2)):
        plans.clear(), paths.clear()
        assert query(spark, str(tmp_path)).count() == 2 * 39 and len(paths) == tables
        # a row that comes again isn't screened again
        assert all(p.count("LeftAnti") == 1 for p in plans)
        assert all(f.name.endswith(".gz") for p in paths for f in Path(p.removeprefix("file:")).glob("part-*"))


def test_compressed_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "FILE_ROWS", 30)
    writers.write_table(spark.range(100, numPartitions=1), str(tmp_path / "t"), "tsv", compressed=True)
    assert len(list((tmp_path / "t").glob("part-*"))) == 4
    assert sorted(int(r.id) for r in read_table(spark, str(tmp_path / "t")).collect()) == list(range(100))


def test_settling_leaves_no_shuffle(spark):
    names = lambda: {n for n in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}
    before, mode = names(), spark.conf.get(CLEANUP)
    kept = settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition("count"))
    end = time.time() + 30
    while names() - before and time.time() < end:  # they go in the background
        time.sleep(0.5)
    assert not names() - before and spark.conf.get(CLEANUP) == mode and kept.count() == 7
