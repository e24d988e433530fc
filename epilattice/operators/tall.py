"""Least squares of tall tables: a triangular factor for each task, and trees that merge what tasks have summed up."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partial results that one task of a tree's round merges.
FAN = 8
#: Bytes of factors that a task holds; beyond it, it hands them on and starts afresh.
HELD = 64 << 20


def default_slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def merge_tree(parts: DataFrame, keys: Sequence[str], fold: Callable[[pd.DataFrame], pd.DataFrame], slots: int) -> DataFrame:
    """parts(keys..., slot int below slots, payload...) merged to one row for each key, by rounds of FAN rows at most.

    fold makes one row, payload columns alone, of some rows of a key. Each round is a shuffle of what is left; the rounds
    grow with the logarithm of the slots, and a task holds FAN rows of a key and no more (those that one task has
    handed on early apart).
    """
    payload = [c for c in parts.columns if c not in (*keys, "slot")]

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 1:
            return pdf
        one = fold(pdf)
        for c in (*keys, "slot"):
            one[c] = pdf[c].iloc[0]
        return one[[*keys, "slot", *payload]]

    parts = parts.select(*keys, "slot", *payload)
    while True:
        slots = -(-slots // FAN)
        parts = parts.withColumn("slot", F.floor(F.col("slot") / FAN).cast("int"))
        parts = parts.groupBy(*keys, "slot").applyInPandas(merged, parts.schema)
        if slots <= 1:
            return parts.drop("slot")


def dense(at: pa.ListArray, x: pa.ListArray, y: np.ndarray, own: np.ndarray, p: int) -> np.ndarray:
    """[X | y] of the rows `own`: at holds the columns of a row that aren't zero, x their values."""
    at, x = at.take(pa.array(own)), x.take(pa.array(own))
    out = np.zeros((len(own), p + 1))
    out[np.repeat(np.arange(len(own)), at.value_lengths().to_numpy(zero_copy_only=False)), at.flatten().to_numpy()] = x.flatten().to_numpy()
    out[:, p] = y[own]
    return out


def triangular(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of [X | y], square."""
    r = np.linalg.qr(rows, mode="r")
    out = np.zeros((rows.shape[1], rows.shape[1]))
    out[: len(r)] = r
    return out


def qr_factors(rows: DataFrame, keys: Sequence[str], slots: int | None = None) -> DataFrame:
    """(keys..., p, n, factor binary) for each key of rows(keys..., at array<int>, x array<double>, p int, y double).

    A row of the design has the values x in its columns `at`, and p columns in all. Tasks keep one factor a key, whatever
    their rows; factors are merged pairwise by another factorisation, in a tree. Nothing is squared, so the condition of
    the design isn't either. Rows may lie anywhere: nothing but factors is shuffled.
    """
    slots = slots or default_slots(rows.sparkSession)

    def run(batches):
        slot = TaskContext.get().partitionId() % slots
        held: dict[tuple, tuple[int, int, np.ndarray]] = {}

        def out():
            columns = [[k[i] for k in held] for i in range(len(keys))]
            frame = pd.DataFrame(dict(zip(keys, columns, strict=True)))
            frame["slot"] = slot
            frame["p"], frame["n"], frame["factor"] = zip(*((p, n, r.tobytes()) for p, n, r in held.values()), strict=True)
            held.clear()
            return pa.RecordBatch.from_pandas(frame.astype({"slot": "int32", "p": "int32"}), schema=wanted, preserve_index=False)

        for batch in batches:
            table = batch.select([*keys, "p", "y"]).to_pandas()
            at, x, y = batch.column("at"), batch.column("x"), table["y"].to_numpy(float)
            for key, where in table.groupby(list(keys), sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                p = int(table["p"].iloc[where[0]])
                block = dense(at, x, y, where, p)
                before = held.get(key)
                held[key] = (p, len(where) + (before[1] if before else 0), triangular(np.vstack([before[2], block]) if before else block))
            if sum(r.nbytes for _, _, r in held.values()) > HELD:
                yield out()
        if held:
            yield out()

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", slot int, p int, n long, factor binary"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = to_arrow_schema(_parse_datatype_string(schema))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        p = int(pdf["p"].iloc[0])
        stack = np.vstack([np.frombuffer(f).reshape(p + 1, p + 1) for f in pdf["factor"]])
        return pd.DataFrame({"p": [p], "n": [pdf["n"].sum()], "factor": [triangular(stack).tobytes()]}).astype({"p": "int32"})

    return merge_tree(rows.select(*keys, "at", "x", "p", "y").mapInArrow(run, schema), keys, fold, slots)


def solved(factor: bytes, p: int, n: int) -> tuple[np.ndarray, int, float]:
    """(coefficients of least norm, rank, sum of squared residuals) from a factor of [X | y] with n rows."""
    r = np.frombuffer(factor).reshape(p + 1, p + 1)
    a, b = r[:p, :p], r[:p, p]
    u, s, vt = np.linalg.svd(a)
    keep = s > s.max(initial=0.0) * max(n, p) * np.finfo(float).eps
    beta = vt[keep].T @ ((u.T @ b)[keep] / s[keep])
    return beta, int(keep.sum()), float(np.sum((a @ beta - b) ** 2) + r[p, p] ** 2)


def least_squares(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n, p, rank, rss, coefficients array<double>) for each key of rows as in qr_factors."""
    kinds = dict(rows.dtypes)

    def solve(frames):
        for pdf in frames:
            found = [solved(f, int(p), int(n)) for f, p, n in zip(pdf["factor"], pdf["p"], pdf["n"], strict=True)]
            out = pdf[[*keys, "n", "p"]].copy()
            out["rank"], out["rss"], out["coefficients"] = ([f[i] for f in found] for i in (1, 2, 0))
            yield out

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, p int, rank int, rss double, coefficients array<double>"
    return qr_factors(rows, keys).select(*keys, "n", "p", "factor").mapInPandas(solve, schema)
