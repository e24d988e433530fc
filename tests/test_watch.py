"""Guards in the same pass: no job before the action, examples after it."""

import pytest
from pyspark.sql import functions as F

from epilattice.operators import scores as sc
from epilattice.operators.fragments import fragment, unique_peptides
from epilattice.operators.watch import Watch
from epilattice.plans import fixtures as fx
from epilattice.plans.screens import screen_mhci
from test_scores import variants, wild


def jobs(spark, tag, work):
    """What work returns, and the jobs that it started."""
    spark.sparkContext.setJobGroup(tag, tag)
    out = work()
    found = spark.sparkContext.statusTracker().getJobIdsForGroup(tag)
    spark.sparkContext.setJobGroup("other", "other")
    return out, len(found)


def library(spark):
    return spark.createDataFrame([(f"v{i}", fx.LEFT + fx.VR[:i] + "A" + fx.VR[i + 1 :] + fx.RIGHT) for i in range(6)], "variant_id string, aa_sequence string")


def predictions(spark):
    own = unique_peptides(fragment(library(spark), [9], fx.REGION, "overlap"))
    each = own.select("peptide", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("allele"))
    net = each.select("allele", "peptide", F.lit(0.5).alias("netMHCpan_EL_score"), F.lit(1.0).alias("netMHCpan_EL_rank"))
    return net, each.where("NOT startswith(peptide, 'D')").select("allele", "peptide", F.lit(3.0).alias("MHCflurry_affinity_percentile"), F.lit(1.0).alias("MHCflurry_presentation_percentile"))


def test_a_watched_screen_starts_no_job(spark):
    net, flurry = predictions(spark)
    watch = Watch()
    out, n = jobs(spark, "plan", lambda: screen_mhci(library(spark), net, flurry, [9], fx.REGION, wt_vr=fx.VR, watch=watch))
    assert n == 0
    rows = out.count()
    watch.judge()
    merged, mapped = watch.report("merged"), watch.report("mapped")
    assert merged["both"] == flurry.count() and merged["left_only"] == net.count() - flurry.count() > 0 and merged["right_only"] == 0
    assert mapped["n_rows"] == rows == screen_mhci(library(spark), net, flurry, [9], fx.REGION, wt_vr=fx.VR).count()
    watch = Watch()
    other = spark.createDataFrame([("A", "NOTTHERE1", 0.1, 0.2)], net.schema)
    out, n = jobs(spark, "plan 2", lambda: screen_mhci(library(spark), net.union(other), flurry.union(flurry.limit(1)), [9], fx.REGION, wt_vr=fx.VR, watch=watch))
    assert n == 0
    out.write.format("noop").mode("overwrite").save()
    with pytest.raises(ValueError, match="1 rows, such as.*NOTTHERE1") as found:
        watch.judge()
    assert "duplicate keys" in str(found.value)


def test_watched_scores(spark):
    watch = Watch()
    out = sc.wt_scores_mhci(variants(spark), wild(spark), watch=watch)
    assert out.columns == sc.wt_scores_mhci(variants(spark), wild(spark)).columns and out.count() == 1
    watch.judge()
    extra = variants(spark, ("A", "p9", "3", "11", "9", "1", "true", "1", "true", "NOMATCHXX", "v1", "S1A"), ("B", "p1", "1", "9", "9", "1", "1", "1", "1", "P", "v1", "S1A"),
                     ("A", "p1", "1", "9", "9", "1", "1", "1", "1", "P", "v2", "S1A"), ("A", "p2", "2", "10", "9", "1", "1", "1", "1", "P", "v2", "S1K"))
    watch = Watch()
    sc.wt_scores_mhci(extra, wild(spark), watch=watch).collect()
    with pytest.raises(ValueError) as found:
        watch.judge()
    said = str(found.value)
    assert "alleles without wild-type windows: 1 rows, such as ['B']" in said and "A, v2, S1A, S1K" in said
    watch = Watch()
    few = variants(spark).where("start = '1'")
    sc.wt_scores_mhci(few, wild(spark), watch=watch).collect()
    with pytest.raises(ValueError, match="without all wild-type windows: 1 rows.*A, v1, 1, 2"):
        watch.judge()
    watch = Watch()
    sc.absolute_scores(variants(spark, ("A", "p3", "1", "9", "9", "1", "1", "1", "1", "X", "v1", "T2A")), watch=watch).collect()
    with pytest.raises(ValueError, match="several VR_mutation"):
        watch.judge()


def test_examples_are_bounded(spark):
    watch = Watch()
    df = watch.forbid(spark.range(10_000).withColumn("x", F.lit("y")), F.col("id") >= 100, "large ids", ["id", "x"])
    df = watch.count(df, "ids", n=F.count("*"), top=F.max("id"))
    df.write.format("noop").mode("overwrite").save()
    with pytest.raises(ValueError, match="large ids: 9900 rows") as found:
        watch.judge()
    assert str(found.value).count(", y") == 10 and watch.report("ids") == {"n": 10_000, "top": 9_999}
