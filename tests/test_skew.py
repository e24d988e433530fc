"""Hot keys found beforehand: none missed, joins the same, tasks even."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from epilattice.operators import skew
from epilattice.operators.predictions import map_predictions


@pytest.fixture
def static(spark):
    """Nothing is split or broadcast at run time."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def occurrences(spark, n=60_000):
    """One peptide in 87 % of the variants, one in 4 %, the others in one each."""
    peptide = F.when(F.col("id") % 100 < 87, "HOTHOTHOT").when(F.col("id") % 100 < 91, "WARMWARMW").otherwise(F.concat(F.lit("p"), F.col("id").cast("string")))
    return spark.range(n).select(F.col("id").cast("string").alias("variant_id"), F.lit(9).alias("k"), peptide.alias("peptide"), F.lit(1).alias("start"), F.lit(9).alias("end"))


def scored(spark, own):
    return own.select("peptide", "k").distinct().select("*", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("allele"), F.length("peptide").alias("score"))


def test_hot_keys_are_found(spark):
    own = occurrences(spark)
    got = skew.hot_keys(own, "peptide", 16)
    # a piece has at most an eighth of a sixteenth of the rows
    assert set(got) == {"HOTHOTHOT", "WARMWARMW"} and got["HOTHOTHOT"] >= 0.87 * 128 and got["WARMWARMW"] >= 0.04 * 128
    assert all(n <= 1.3 * share * 128 + 1 for n, share in ((got["HOTHOTHOT"], 0.87), (got["WARMWARMW"], 0.04)))
    even = spark.range(5_000).selectExpr("concat('x', id % 1000) AS peptide")
    assert skew.hot_keys(even, "peptide", 16) == {}
    many = spark.range(20_000).selectExpr("concat('x', CAST(sqrt(id) AS int)) AS peptide")
    exact = Counter(r.peptide for r in many.collect())
    assert {k for k, n in exact.items() if n > 20_000 / 16} <= set(skew.hot_keys(many, "peptide", 2))
    assert skew.hot_keys(even.where("false"), "peptide") == {} and skew.hot_keys(even.selectExpr("CAST(NULL AS string) AS peptide"), "peptide") == {}


def test_salted_join_is_the_join(spark):
    own = occurrences(spark, 2_000).unionByName(spark.createDataFrame([("v", None, None, 1, 9), ("w", 8, "HOTHOTHOT", 2, 9)], "variant_id string, k int, peptide string, start int, `end` int"))
    small = scored(spark, own).unionByName(spark.createDataFrame([("NEVER", 9, "A", 5), (None, 9, "A", 5)], "peptide string, k int, allele string, score int"))
    plain = small.join(own, ["peptide", "k"])
    salted = skew.salted_join(small, own, ["peptide", "k"], {"HOTHOTHOT": 7, "NEVER": 3, "WARMWARMW": 1}, ["variant_id", "start"])
    assert sorted(salted.columns) == sorted(plain.columns)
    assert Counter(map(tuple, salted.select(plain.columns).collect())) == Counter(map(tuple, plain.collect()))


def test_tasks_are_even(static):
    own = occurrences(static)
    small = scored(static, own)
    rows = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    hot = skew.hot_keys(own, "peptide")
    counts = rows(skew.salted_join(small, own, ["peptide", "k"], hot, ["variant_id", "start"]))
    assert sum(counts) == 120_000 and len(counts) == 16 and counts[-1] < 3 * counts[8]
    counts = rows(small.join(own, ["peptide", "k"]))
    assert counts[-1] > 30 * counts[8]  # what the plain join does


def test_predictions_are_mapped_evenly_where_nothing_else_splits_them(static):
    assert skew.planned_by_default(static)
    own = occurrences(static, 30_000)
    peptides = own.groupBy("peptide", "k").agg(F.count("*").alias("occurrence_count"))
    missing = static.createDataFrame([("A", "NEVERSEEN", 9)], "allele string, peptide string, score int")
    predictions = scored(static, own).select("allele", "peptide", "score").unionByName(missing)
    out = map_predictions(predictions, peptides, own, {"pass": ("score", 9.0)})
    assert "_piece" in out._jdf.queryExecution().optimizedPlan().toString()
    plain = map_predictions(predictions, peptides, own, {"pass": ("score", 9.0)}, hot={})
    assert "_piece" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == plain.count() == 60_001 and out.exceptAll(plain).count() == 0
    static.conf.set("spark.sql.adaptive.enabled", "true")
    assert not skew.planned_by_default(static)
