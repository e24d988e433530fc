import pytest
from pyspark.sql import functions as F

from epilattice.functions.labels import count_mutations, decoded_boolean, lenient_double, lenient_int, mutation_list, mutation_string, normalised_allele, passes, peptide_mutation_string, safe_label, vr_slice
from epilattice.operators.annotate import annotate, inferred_wt
from epilattice.operators.checks import check_alleles
from epilattice.operators.combine import combine_predictions, combine_scores, merge_report
from epilattice.operators.fragments import fragment, peptide_map, unique_peptides
from epilattice.operators.predictions import keep_lowest, keep_lowest_ranked, map_predictions, pass_report, rename_alleles, score_peptides
from epilattice.plans import fixtures as fx
from epilattice.sources.readers import read_long_predictions, read_wide_mhci, read_wide_mhcii


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_labels(spark):
    lit = F.lit
    assert one(spark, mutation_string(lit("ABXD"), lit("ABCD"))) == "C3X"
    assert one(spark, mutation_string(lit("ABCD"), lit("ABCD"))) == "WT"
    assert one(spark, mutation_string(lit(""), lit("ABCD"))) == "WT"
    assert one(spark, mutation_string(lit("AX"), lit("ABCD"))) == "B2X"
    assert one(spark, mutation_string(lit(None).cast("string"), lit("ABCD"))) is None
    assert one(spark, peptide_mutation_string(lit("A1V;C3X"), lit(3), lit(4), 2)) == "C3X"
    assert one(spark, peptide_mutation_string(lit("A1V; c3x;bad"), lit(9), lit(9), 2)) == "WT"
    assert one(spark, peptide_mutation_string(lit(None).cast("string"), lit(1), lit(9), 2)) == "WT"
    assert one(spark, count_mutations(lit("A1V; ;C3X"))) == 2 and one(spark, count_mutations(lit(" wt "))) == 0
    assert one(spark, mutation_list(lit("A1V;A1V; C3X"))) == ["A1V", "C3X"] and one(spark, mutation_list(lit("nan"))) == []
    assert one(spark, vr_slice(lit("XXABCDYY"), 3, 6)) == "ABCD" and one(spark, vr_slice(lit("AB"), 0, 1)) == "A"


@pytest.mark.parametrize("text,value", [(" 1.5 ", 1.5), ("1d", None), ("nan", None), ("", None), ("1e3", 1000.0), (".5", 0.5), ("inf", None), (None, None)])
def test_lenient_numbers(spark, text, value):
    assert one(spark, lenient_double(F.lit(text).cast("string"))) == value


def test_other_readings(spark):
    assert one(spark, lenient_int(F.lit("9.0"))) == 9 and one(spark, lenient_int(F.lit("9.5"))) is None
    assert [one(spark, decoded_boolean(F.lit(x).cast("string"))) for x in ("TRUE ", "1", "0", "yes", None)] == [True, True, False, False, False]
    assert [one(spark, normalised_allele(F.lit(x))) for x in (" H-2-Db", "HLA-A*02", "H-2-IAb")] == ["H2-D*b", "HLA-A*02", "H2-I*Ab"]
    assert one(spark, passes(F.lit(2.0), 2.0)) is False and one(spark, passes(F.lit(None).cast("double"), 2.0)) is False
    assert one(spark, safe_label(F.lit("H2-D*b/x"))) == "H2-D_b_x"


def test_wide_mhci(spark, tmp_path):
    head = "\t\t\tH-2-Db\t\t\t\tH-2-Kb\nPos\tPeptide\tID\tcore\ticore\tEL_score\tEL_rank\tcore\ticore\tEL_score\tEL_rank\n"
    (tmp_path / "a.xls").write_text("# made by x\n" + head + "0\tABCDEFGHI\tP\tc\ti\t0.9\t1.2\tc\ti\tx\t3\n\n# end\n0\tSHORT\tP\tc\n1\tBCDEFGHIK\tP\tc\ti\t0.1\t9\tc\ti\n")
    out = sorted((r.peptide, r.allele, r.k, r.netMHCpan_EL_score, r.netMHCpan_EL_rank, r.netMHCpan_BA_rank) for r in read_wide_mhci(spark, str(tmp_path)).collect())
    assert out == [("ABCDEFGHI", "H-2-Db", 9, 0.9, 1.2, None), ("ABCDEFGHI", "H-2-Kb", 9, None, 3.0, None), ("BCDEFGHIK", "H-2-Db", 9, 0.1, 9.0, None)]
    (tmp_path / "b.xls").write_text("\t\t\tHLA-A\nPos\tPeptide\tID\tcore\ticore\tEL_score\tEL_rank\tBA_score\tBA_rank\n0\tABCDEFGHI\tP\tc\ti\t1\t2\t3\t4\n")
    assert {r.netMHCpan_BA_rank for r in read_wide_mhci(spark, str(tmp_path / "b.xls")).collect()} == {4.0}
    (tmp_path / "c.xls").write_text("no header\n")
    with pytest.raises(ValueError):
        read_wide_mhci(spark, str(tmp_path))


def test_wide_mhcii(spark, tmp_path):
    head = "\t\t\t\tIAb\nPos\tPeptide\tID\tTarget\tCore\tInverted\tScore_EL\tRank_EL\n"
    (tmp_path / "a.xls").write_text(head + "1\tABCDEFGHIKLMNPQ\tP\tNA\tDEFGHIKLM\t0\t0.3\t4.2\n1\tABC\tP\tNA\tx\n")
    rows = read_wide_mhcii(spark, str(tmp_path / "a.xls")).collect()
    assert [(r.peptide, r.allele, r.netMHCIIpan_EL_rank) for r in rows] == [("ABCDEFGHIKLMNPQ", "IAb", 4.2)]
    (tmp_path / "b.xls").write_text(head)
    with pytest.raises(ValueError):
        read_wide_mhcii(spark, str(tmp_path / "b.xls"))


def mapped(spark, tmp_path):
    (tmp_path / "l.csv").write_text("peptide,allele,mhcflurry_affinity_percentile,mhcflurry_presentation_percentile\nABC ,H-2-Db,1.0,0.5\n")
    own = fragment(spark.createDataFrame([("v1", "ABCD", "keep")], "variant_id string, aa_sequence string, criteria string"), [3])
    p = unique_peptides(own)
    long = map_predictions(read_long_predictions(spark, str(tmp_path / "l.csv")), p, own, {"MHCflurry_affinity_percentile_pass": ("MHCflurry_affinity_percentile", 2.0)}, validate=True)
    net = spark.createDataFrame([("ABC", "H2-D*b", 0.5, 1.5), ("BCD", "H2-D*b", 0.5, 2.0)], "peptide string, allele string, netMHCpan_EL_score double, netMHCpan_EL_rank double")
    return map_predictions(net, p, own, {"netMHCpan_EL_rank_pass": ("netMHCpan_EL_rank", 2.0)}, lowest="netMHCpan_EL_rank"), long


def test_map_and_combine(spark, tmp_path):
    net, long = mapped(spark, tmp_path)
    rows = {r.peptide: r for r in combine_predictions(net, long, ["criteria"], validate=True).collect()}
    assert rows["ABC"].merge_status == "both" and rows["ABC"].allele == "H2-D*b" and rows["ABC"].criteria == "keep"
    assert rows["ABC"].netMHCpan_EL_rank_pass and rows["ABC"].MHCflurry_affinity_percentile_pass
    assert rows["BCD"].merge_status == "left_only" and rows["BCD"].MHCflurry_affinity_percentile is None and not rows["BCD"].netMHCpan_EL_rank_pass
    assert {r.merge_status: r.n_rows for r in merge_report(combine_predictions(net, long)).collect()} == {"both": 1, "left_only": 1}
    with pytest.raises(ValueError, match="duplicate"):
        combine_predictions(net.union(net), long, validate=True)
    assert pass_report(net, ["netMHCpan_EL_rank_pass"]).first().n_netMHCpan_EL_rank_pass == 1


def test_combining_before_mapping_is_the_same(spark):
    """Scores combined by peptide and spread once, against two spread tables that are joined in full."""
    library = spark.createDataFrame([(f"v{i}", "ABCDE" * 2 + "FGHIJ"[i % 5] * (i % 3), "m") for i in range(6)], "variant_id string, aa_sequence string, note string")
    own = fragment(library, [4])
    ids = unique_peptides(own)
    net = spark.createDataFrame(
        [("H-2-Db", "ABCD", 0.1, 3.0), ("H-2-Db", "ABCD", 0.2, 1.0), ("H-2-Db", "BCDE", 0.3, None), ("H-2-Kb", "ABCD", 0.4, 5.0), ("H-2-Db", "ZZZZ", 0.5, 0.5)],
        "allele string, peptide string, netMHCpan_EL_score double, netMHCpan_EL_rank double")
    flurry = spark.createDataFrame(
        [("H2-D*b", "ABCD", 1.0, 2.0), ("H2-D*b", "CDEA", None, 3.0), ("H2-K*b", "ABCD", 9.0, 9.0), ("H2-D*b", "YYYY", 0.5, 0.5)],
        "allele string, peptide string, MHCflurry_affinity_percentile double, MHCflurry_presentation_percentile double")
    two = combine_predictions(
        map_predictions(net, ids, own, {"netMHCpan_EL_rank_pass": ("netMHCpan_EL_rank", 2.0)}, lowest="netMHCpan_EL_rank"),
        map_predictions(flurry, ids, own, {"MHCflurry_affinity_percentile_pass": ("MHCflurry_affinity_percentile", 2.0)}), ["note"])
    one = map_predictions(combine_scores(net, flurry, 2.0, 2.0), ids, own, {}).select(*two.columns)
    assert {r.merge_status for r in one.collect()} == {"both", "left_only", "right_only"} and one.count() > 30
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_null_keys_meet(spark, tmp_path):
    net, long = mapped(spark, tmp_path)
    none = [d.withColumn("start", F.lit(None).cast("int")).withColumn("allele", F.lit("a")).where("peptide = 'ABC'") for d in (net, long)]
    assert combine_predictions(*none).first().merge_status == "both"


def test_lowest(spark):
    rows = spark.createDataFrame([("a", "P", 1, "v", 1, 1, None), ("a", "P", 1, "v", 1, 1, 3.0), ("a", "P", 1, "v", 1, 1, 2.0)], "allele string, peptide string, k int, variant_id string, start int, `end` int, s double")
    assert [r.s for r in keep_lowest(rows, "s").collect()] == [2.0]
    assert [r.s for r in keep_lowest_ranked(rows, "s", ["allele"]).collect()] == [2.0]


def test_scorers_and_alleles(spark):
    pairs = spark.createDataFrame([("ABC", "x"), ("BCD", "x")], "peptide string, allele string")
    assert score_peptides(pairs, pairs.where("peptide = 'ABC'").withColumn("s", F.lit(1))).count() == 1
    run = lambda frames: (f.assign(s=f["peptide"].str.len().astype(float)) for f in frames)
    assert {r.s for r in score_peptides(pairs, run, "peptide string, allele string, s double").collect()} == {3.0}
    check_alleles(pairs, ["x"])
    check_alleles(pairs, ["x", "y"], missing=False)
    for wanted in (["x", "y"], []):
        with pytest.raises(ValueError):
            check_alleles(pairs, wanted)
    names = spark.createDataFrame([("common", "x")], "name string, own string")
    assert {r.allele for r in rename_alleles(pairs, names, "own").collect()} == {"common"}


def test_annotate(spark):
    library = spark.createDataFrame([("wt", "XXABCDYY"), ("mut", "XXABXDYY")], "variant_id string, aa_sequence string")
    rows = spark.createDataFrame([("wt", 3, 6), ("mut", 3, 6), ("none", 3, 6)], "variant_id string, start int, `end` int")
    out = {r.variant_id: (r.VR_mutation, r.peptide_mutation) for r in annotate(rows, library, (3, 6), "ABCD").collect()}
    assert out == {"wt": ("WT", "WT"), "mut": ("C3X", "C3X"), "none": (None, "WT")}
    assert inferred_wt(library, (3, 6)).first().wt_vr == "ABCD"  # a tie goes to the smallest
    with pytest.raises(ValueError):
        annotate(rows, library.union(spark.createDataFrame([("wt", "XXABXXYY")], library.schema)), (3, 6), "ABCD", validate=True)


def test_many_alleles(spark):
    many = spark.range(100_050).selectExpr("concat('a', id) AS allele", "concat('n', id) AS name")
    assert rename_alleles(many.select("allele"), many.withColumnRenamed("allele", "own"), "own").where("allele LIKE 'n%'").count() == 100_050
    some = many.where("substring(allele, 2)::int < 10050")
    check_alleles(some, [f"a{i}" for i in range(10_050)])
    with pytest.raises(ValueError, match="unexpected"):
        check_alleles(some, [f"a{i}" for i in range(10_049)])


def test_windows_are_not_broadcast(spark):
    # windows are generated, so Spark reckons them as small as the sequences
    own = fragment(spark.createDataFrame([("v", "ACDEFGHIKL")], "variant_id string, aa_sequence string"), [3])
    predictions = spark.createDataFrame([("a", "ACD", 1.0)], "allele string, peptide string, score double")
    out = map_predictions(predictions, unique_peptides(own), own, {}, how="inner")
    assert "SortMergeJoin" in out._jdf.queryExecution().sparkPlan().toString() and out.count() == 1
    ids = unique_peptides(own).withColumn("peptide_id", F.col("peptide"))
    assert "SortMergeJoin" in peptide_map(own, ids)._jdf.queryExecution().sparkPlan().toString()


def test_library_is_derived_once_and_dealt(spark, tmp_path):
    spark.range(1, 400).selectExpr("id AS c_custkey", "'x' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    own = fx.library(spark, str(tmp_path))
    assert "md5" not in own._jdf.queryExecution().optimizedPlan().toString() and len(own.inputFiles()) > 1 and own.count() == 399
