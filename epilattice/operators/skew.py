"""Joins whose hot keys are found beforehand and dealt over several tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A hot key is cut into pieces of an eighth of a task's fair share: pieces fall where their hashes do, and small ones
#: even out.
PIECES = 8


def planned_by_default(spark: SparkSession) -> bool:
    """Whether nothing at run time would split a skewed join."""
    on = lambda key: spark.conf.get(key, "true").lower() == "true"
    return not (on("spark.sql.adaptive.enabled") and on("spark.sql.adaptive.skewJoin.enabled"))


def hot_keys(df: DataFrame, key: str, parts: int | None = None) -> dict[str, int]:
    """Keys with more than an eighth of a task's fair share of the rows, and into how many pieces each is to be cut.

    One pass with a mergeable summary of frequent items: tasks keep a bounded number of counters (Space-Saving), which
    are merged on the way; no row is shuffled. It tracks so many items that its error is below half of what makes a key
    hot, so none is missed; counts are rounded up. At most 16 keys a task reach the driver.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = 2 * PIECES * parts
    # the summary's error is at most 3.5 of the rows for each counter
    tracked = 1 << (7 * PIECES * parts).bit_length()
    own = df.where(F.col(key).isNotNull())
    r = own.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {tracked})").alias("top")).first()
    if not r.n:
        return {}
    least = r.n / (PIECES * parts)
    return {x["item"]: -int(-x["count"] // least) for x in r.top if x["count"] > least}


def _pieces(hot: Mapping[str, int], key: Column) -> Column:
    """How many pieces a key has: 1 if it isn't hot."""
    if not hot:
        return F.lit(1)
    table = F.create_map(*[F.lit(v) for kv in hot.items() for v in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(1))


def salted_join(small: DataFrame, large: DataFrame, on: Sequence[str], hot: Mapping[str, int], spread: Sequence[str]) -> DataFrame:
    """Inner join on `on`, the first of which is the key that `hot` tells of. A hot key's rows of the large side are
    dealt by the hash of `spread`, and its rows of the small side are repeated for each piece; all others are joined as
    they are.

    Spark reckons windows as small as the sequences from which they are generated, and would collect them for a
    broadcast: hence the hint. The large side streams, so what is buffered for a key are the small side's few rows."""
    large = large.hint("merge")
    if not hot:
        return large.join(small, list(on))
    pieces = _pieces(hot, F.col(on[0]))
    dealt = large.withColumn("_piece", F.when(pieces > 1, F.pmod(F.xxhash64(*spread), pieces)).otherwise(0).cast("int"))
    repeated = small.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return dealt.join(repeated, [*on, "_piece"]).drop("_piece")
