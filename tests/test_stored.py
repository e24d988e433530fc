"""Stored tables: joined without a shuffle, the same rows as from tables that lie anywhere."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from epilattice.operators.predictions import map_predictions, map_stored
from epilattice.sources.stored import store


def tables(spark, n=4_000):
    peptide = F.when(F.col("id") % 10 < 7, "HOTHOTHOT").otherwise(F.concat(F.lit("p"), (F.col("id") % 900).cast("string")))
    own = spark.range(n).select(F.col("id").cast("string").alias("variant_id"), F.lit("c").alias("criteria"), F.lit(9).alias("k"), peptide.alias("peptide"), F.lit(1).alias("start"), F.lit(9).alias("end"))
    scores = own.select("peptide").distinct().unionByName(spark.createDataFrame([("NEVERSEEN",)], "peptide string"))
    scores = scores.select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("allele"), "peptide", F.lit(9).alias("k"), F.length("peptide").cast("double").alias("score"))
    return own, scores


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_the_join_of_stored_tables_shuffles_nothing(no_broadcast, how):
    spark = no_broadcast
    own, scores = tables(spark)
    fragments = store(own, 6)
    predictions = store(scores, 6, hot=fragments.hot)
    assert fragments.hot == ("HOTHOTHOT",) and fragments.rows.where("peptide = 'HOTHOTHOT'").isEmpty()
    flags = {"pass": ("score", 5.0)}
    out = map_stored(predictions, fragments, flags, how)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not re.search("Exchange (hash|range|Round|Single)", plan)
    plain = map_predictions(scores, own.groupBy("peptide", "k").agg(F.count("*").alias("occurrence_count")), own, flags, how)
    assert Counter(map(tuple, out.select(plain.columns).collect())) == Counter(map(tuple, plain.collect()))
    counted = fragments.peptides()
    assert {(r.peptide, r.occurrence_count) for r in counted.collect()} == {(r.peptide, r["count"]) for r in own.groupBy("peptide").count().collect()}
    assert "Exchange" not in fragments.rows.groupBy("peptide", "k").count()._jdf.queryExecution().executedPlan().toString()
    for table in (fragments, predictions):
        table.drop()
    assert not spark.catalog.tableExists(fragments.name)


def test_tables_stored_in_different_ways(spark):
    own, scores = tables(spark, 300)
    fragments = store(own, 4, hot=["HOTHOTHOT"])
    for other in (store(scores, 5, hot=fragments.hot), store(scores, 4, hot=[])):
        with pytest.raises(ValueError, match="different"):
            map_stored(other, fragments, {})
        other.drop()
    empty = store(own.where("false"), 4)
    assert empty.hot == () and empty.peptides().count() == 0
    assert map_stored(store(scores, 4, hot=()), empty, {"pass": ("score", 5.0)}).count() == scores.count()
