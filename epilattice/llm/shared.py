"""What the operators share: settled tables, row keys, hashed sketches merged by Spark, and components."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.settled import discard, settle


#: Ids that are broadcast, 8 to 16 bytes each; more of them are shuffled.
BROADCAST_IDS = 1_000_000


#: Bytes of an Arrow batch between Spark and a worker: a worker holds a few of them at a time, whatever the rows' length.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches by bytes, not only by rows (by default 10,000 rows or 64 MB)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Rows that agree in id and text get the same result, so both together are the key: _id, _th."""
    return [F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th")]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as keep them apart from df's columns in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}") in taken:
            pass
        out.append(name)
    return out


def told_apart(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Ids that name things by a 64-bit hash, made safe by a second hash, id2.

    df(id, id2, ...) holds all of them. Returns a function that drops id2 from a table (id, id2, ...) and gives those
    that share an id with something else, all but the ones with the smallest id2, an id made from both hashes.
    """
    clash = settle(df.groupBy("id").agg(F.min("id2").alias("_a"), F.max("id2").alias("_b")).where("_a <> _b").select("id", "_a"))
    n = clash.count()
    if not n:
        discard(clash)
        return lambda t: t.drop("id2")
    few = F.broadcast(clash) if n <= BROADCAST_IDS else clash

    def apart(t: DataFrame) -> DataFrame:
        own = F.when(F.col("_a").isNull() | (F.col("_a") == F.col("id2")), F.col("id")).otherwise(F.xxhash64("id", "id2"))
        return t.join(few, "id", "left").withColumn("id", own).drop("_a", "id2")

    return apart


#: Edges that a task's union-find holds at a time; beyond it, it hands on its trees and starts afresh.
FOREST = 1 << 18


def _forests(size: int):
    def run(batches):
        root: dict[int, int] = {}
        held = 0

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def trees():
            pairs = [(x, top(x)) for x in root]
            u, v = zip(*((x, t) for x, t in pairs if x != t), strict=True)
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = top(u), top(v)
                if a != b:
                    root[max(a, b)] = min(a, b)
                held += 1
                if held >= size:
                    yield trees()
                    held = 0
        if held:
            yield trees()

    return run


def components(edges: DataFrame, forest: int = FOREST) -> DataFrame:
    """Connected components of edges(u long, v long): rows (id, component), component being the smallest id.

    Distributed union-find in rounds. A round first turns each task's edges, `forest` at a time, into trees of depth
    one; then every vertex moves to the first of itself and its neighbours, and the next round has the graph of where
    they are. First is the smallest id in round one, which ends stars at once, and the smallest hash later, a new one
    each round: on a path in any order about half of the vertices are left after each, so rounds grow with the
    logarithm of a component's diameter. Aggregates and joins of settled tables, so that hubs are combined early and
    split when joined; nothing but the number of edges left reaches the driver. No edges give no rows; loops and
    repeats are ignored.
    """
    now = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    moves: list[DataFrame] = []
    while n := now.count():
        # no more tasks than there are forests: the fewer they are, the fewer rounds are left
        trees = settle(now.coalesce(-(-n // forest)).mapInArrow(_forests(forest), "u long, v long"))
        rank = (lambda c: F.col(c)) if not moves else (lambda c, k=len(moves): F.xxhash64(F.lit(k), c))
        near = trees.union(trees.select("v", "u")).groupBy("u").agg(F.min_by("v", rank("v")).alias("v"))
        moved = settle(near.select(F.col("u").alias("id"), F.when(rank("v") < rank("u"), F.col("v")).otherwise(F.col("u")).alias("m")))
        after = trees.join(moved.select(F.col("id").alias("u"), F.col("m").alias("a")), "u").join(moved.select(F.col("id").alias("v"), F.col("m").alias("b")), "v")
        after = settle(after.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        discard(now, trees)
        now = after
        moves.append(moved)
    if not moves:
        none = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        none._settled = now._settled
        return none
    # a vertex goes where the one it moved to goes
    found = moves[-1].withColumnRenamed("m", "component")
    for moved in moves[-2::-1]:
        onward = found.select(F.col("id").alias("m"), F.col("component").alias("_c"))
        found = moved.join(onward, "m", "left").select("id", F.coalesce("_c", "m").alias("component"))
    if len(moves) > 1:
        # after the first round what is left need not be the smallest
        ends = settle(found)
        moves.append(ends)
        least = ends.groupBy("component").agg(F.min("id").alias("_least"))
        found = ends.join(least, "component").select("id", F.col("_least").alias("component"))
    found = settle(found)
    discard(now, *moves)
    return found
