"""Bootstrap replicates of n out of n rows, drawn exactly and alike on any partitioning.

A replicate's n draws are split down a binary tree over the hashes of the rows: a node hands on binomially many to its
left half, by the share of rows there, until a bucket of some thousand rows is reached; inside it each draw falls on any
row alike. Every node and bucket has a generator of its own, seeded by its place, so a bucket can find its draws by
walking its own path. Together these conditional draws are one multinomial draw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tall import default_slots, merge_tree

KEYS = ["allele", "outcome"]
#: Rows of a bucket, about: buckets are halved until the mean is no more.
BUCKET_ROWS = 4096
#: Replicates whose sums travel together, and rows from which another task pays.
REPLICATES, TASK_ROWS = 25, 4 * BUCKET_ROWS
#: Where a bucket's own generator stands among those of the tree's levels.
INSIDE = 1000


def bucketed(rows: DataFrame, bucket_rows: int = BUCKET_ROWS, slots: int | None = None) -> tuple[DataFrame, int]:
    """(table, partitions): rows(allele, outcome, variant_id, y, at, p) by bucket, each bucket together and headed by a
    row with its path.

    Ranges of buckets are dealt to the tasks, so that a task meets few groups, and a group of any size lies on as many
    tasks as it fills. y is centred in each group.
    """
    spark = rows.sparkSession
    totals = rows.groupBy(*KEYS).agg(F.count("*").alias("_all"), F.avg("y").alias("_mean"))
    depth = F.greatest(F.ceil(F.log2(F.col("_all") / F.lit(bucket_rows))), F.lit(0)).cast("int")
    h = F.xxhash64(*KEYS, "variant_id")
    placed = rows.join(totals, KEYS).withColumns({"_h": h, "_l": depth, "y": F.col("y") - F.col("_mean")})
    placed = placed.withColumn("bucket", F.expr("IF(_l = 0, 0L, shiftrightunsigned(_h, 64 - _l))"))
    counts = placed.groupBy(*KEYS, "_l", "_all", "bucket").agg(F.count("*").alias("_n"))
    steps = counts.where("_l > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_l") - 1))).withColumns({
        "prefix": F.expr("shiftrightunsigned(bucket, _l - level)"), "left": F.expr("shiftrightunsigned(bucket, _l - level - 1) % 2 = 0"),
    })
    splits = steps.groupBy(*KEYS, "level", "prefix").agg(F.sum("_n").alias("rows"), F.sum(F.when(F.col("left"), F.col("_n")).otherwise(0)).alias("rows_left"))
    node = F.struct("level", "prefix", "left", "rows_left", "rows")
    paths = steps.join(splits, [*KEYS, "level", "prefix"]).groupBy(*KEYS, "bucket").agg(F.sort_array(F.collect_list(node)).alias("path"))
    heads = counts.join(paths, [*KEYS, "bucket"], "left").select(*KEYS, "bucket", F.col("_all").alias("head"), F.xxhash64(*KEYS).alias("seed"), "path")
    body = placed.select(*KEYS, "bucket", "_h", "variant_id", "y", "at", "p")
    every = body.unionByName(heads, allowMissingColumns=True)
    n = rows.count()
    tasks = max(1, min(slots or default_slots(spark), -(-n // TASK_ROWS)))
    order = [*KEYS, "bucket", F.asc_nulls_first("_h"), "variant_id"]
    return every.repartitionByRange(tasks, *KEYS, "bucket").sortWithinPartitions(*order).drop("_h", "variant_id"), tasks


def _buckets(batches) -> Iterator[tuple[dict, pa.RecordBatch]]:
    """(head, rows) of each bucket; a bucket may lie over several batches."""
    head, parts = None, []
    for batch in batches:
        starts = np.flatnonzero(~batch.column("head").is_null().to_numpy(zero_copy_only=False)).tolist()
        if not starts or starts[0] > 0:
            parts.append(batch.slice(0, starts[0] if starts else len(batch)))
        for s, e in zip(starts, [*starts[1:], len(batch)]):
            if head:
                yield head, pa.Table.from_batches(parts).combine_chunks()
            head = {c: batch.column(c)[s].as_py() for c in (*KEYS, "bucket", "head", "seed", "path")}
            parts = [batch.slice(s + 1, e - s - 1)]
    if head:
        yield head, pa.Table.from_batches(parts).combine_chunks()


def shares(head: dict, bootstraps: int, seed: int) -> np.ndarray:
    """How many of each replicate's draws fall into this bucket."""
    own = np.full(bootstraps, head["head"], np.int64)
    for node in head["path"] or []:
        rng = np.random.default_rng([seed, head["seed"] % 2**63, node["level"], node["prefix"]])
        left = rng.binomial(own, node["rows_left"] / node["rows"])
        own = left if node["left"] else own - left
    return own


def weights(head: dict, rows: int, bootstraps: int, seed: int) -> np.ndarray:
    """(replicates, rows): how often each replicate draws each row of the bucket."""
    own = shares(head, bootstraps, seed)
    rng = np.random.default_rng([seed, head["seed"] % 2**63, INSIDE, head["bucket"]])
    fallen = rng.integers(0, rows, own.sum())
    return np.bincount(np.repeat(np.arange(bootstraps) * rows, own) + fallen, minlength=bootstraps * rows).reshape(bootstraps, rows)


def _entries(at: np.ndarray, lengths: np.ndarray, p: int):
    """(rows, codes) of the unordered pairs of each row's columns, the constant, 0, among them; and of its columns."""
    pair_rows, pair_codes, one_rows, one_codes = [], [], [], []
    first = np.cumsum(lengths) - lengths
    for k in np.unique(lengths):
        own = np.flatnonzero(lengths == k)
        columns = np.zeros((len(own), k + 1), np.int64)
        columns[:, 1:] = np.sort(at[first[own][:, None] + np.arange(k)], axis=1)
        i, j = np.triu_indices(k + 1)
        a, b = columns[:, i], columns[:, j]
        pair_rows.append(np.repeat(own, len(i)))
        pair_codes.append((a * p - a * (a - 1) // 2 + b - a).reshape(-1))
        one_rows.append(np.repeat(own, k + 1))
        one_codes.append(columns.reshape(-1))
    return [tuple(np.concatenate(x) for x in pair) for pair in ((pair_rows, pair_codes), (one_rows, one_codes))]


def _add(into: np.ndarray, values: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> None:
    """into[:, code] += sums of values[:, row] over the entries."""
    order = np.argsort(codes, kind="stable")
    rows, codes = rows[order], codes[order]
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    for f in range(0, len(values), REPLICATES):
        into[f : f + REPLICATES, codes[at]] += np.add.reduceat(values[f : f + REPLICATES][:, rows], at, axis=1)


def replicate_sums(rows: DataFrame, bootstraps: int, seed: int, bucket_rows: int = BUCKET_ROWS, slots: int | None = None) -> DataFrame:
    """(allele, outcome, first, p, g binary, r binary): each replicate's normal equations, for REPLICATES of them from
    `first` on: X'WX as the upper triangle, row by row, and X'Wy of the centred values.

    A task keeps one accumulator and hands it on when it comes to the next group: what is shuffled grows with tasks and
    groups, not with rows, and is merged in a tree.
    """
    table, tasks = bucketed(rows, bucket_rows, slots)

    def run(batches):
        slot = TaskContext.get().partitionId() % tasks
        key, p, g, r = None, 0, None, None

        def out():
            for f in range(0, bootstraps, REPLICATES):
                yield pa.RecordBatch.from_pydict({
                    "allele": [key[0]], "outcome": [key[1]], "first": pa.array([f], pa.int32()), "slot": pa.array([slot], pa.int32()), "p": pa.array([p], pa.int32()),
                    "g": [g[f : f + REPLICATES].tobytes()], "r": [r[f : f + REPLICATES].tobytes()],
                }, schema=wanted)

        for head, own in _buckets(batches):
            if (head["allele"], head["outcome"]) != key:
                if key:
                    yield from out()
                key, p = (head["allele"], head["outcome"]), own.column("p")[0].as_py()
                g, r = np.zeros((bootstraps, p * (p + 1) // 2)), np.zeros((bootstraps, p))
            w = weights(head, len(own), bootstraps, seed).astype(float)
            at = own.column("at").combine_chunks()
            pairs, ones = _entries(at.flatten().to_numpy(), at.value_lengths().to_numpy(zero_copy_only=False), p)
            _add(g, w, *pairs)
            _add(r, w * own.column("y").to_numpy(), *ones)
        if key:
            yield from out()

    schema = "allele string, outcome string, first int, slot int, p int, g binary, r binary"
    wanted = pa.schema([("allele", pa.string()), ("outcome", pa.string()), ("first", pa.int32()), ("slot", pa.int32()), ("p", pa.int32()), ("g", pa.binary()), ("r", pa.binary())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        total = {c: sum(np.frombuffer(x) for x in pdf[c]).tobytes() for c in ("g", "r")}
        return pd.DataFrame({"p": pdf["p"].iloc[:1].to_numpy(), "g": [total["g"]], "r": [total["r"]]})

    return merge_tree(table.mapInArrow(run, schema), [*KEYS, "first"], fold, tasks)


def replicate_totals(rows: DataFrame, bootstraps: int, seed: int, bucket_rows: int = BUCKET_ROWS, slots: int | None = None) -> DataFrame:
    """(allele, outcome, replicate, n_rows, n_drawn, n_left_out) of each replicate: rows there are, draws made, and
    rows that none of them fell on."""
    table, _ = bucketed(rows, bucket_rows, slots)

    def run(batches):
        for head, own in _buckets(batches):
            w = weights(head, len(own), bootstraps, seed)
            yield pa.RecordBatch.from_pydict({
                "allele": [head["allele"]] * bootstraps, "outcome": [head["outcome"]] * bootstraps, "replicate": pa.array(np.arange(bootstraps), pa.int32()),
                "n_rows": pa.array(np.full(bootstraps, len(own)), pa.int64()), "n_drawn": pa.array(w.sum(1), pa.int64()), "n_left_out": pa.array((w == 0).sum(1), pa.int64()),
            })

    each = table.mapInArrow(run, "allele string, outcome string, replicate int, n_rows long, n_drawn long, n_left_out long")
    return each.groupBy(*KEYS, "replicate").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_drawn", "n_left_out")])
