"""Product codes of vectors in whole numbers: nearest entries by a Walsh-Hadamard transform with early elimination.

Parts and entries are padded with zeros to a power of two and transformed by additions and subtractions alone. The
transform keeps squared distances up to a factor, the padded length, so they are summed coefficient by coefficient, those
of few sign changes first; an entry goes as soon as its sum passes the whole distance of another one.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose sums are broadcast; with more of them rows and sums are joined by label and salt.
FEW_LABELS, SALTS = 10_000, 32
#: Vectors of one numpy step.
STEP = 4096


def sequency(m: int) -> np.ndarray:
    """The natural indexes of m Walsh functions, in order of their sign changes."""
    rows = walsh(np.eye(m, dtype=np.int64)).T
    return np.argsort((np.diff(rows, axis=1) != 0).sum(1), kind="stable")


def walsh(x: np.ndarray) -> np.ndarray:
    """The unscaled transform of the last axis, a power of two, in natural order."""
    m, half = x.shape[-1], 1
    while half < m:
        pairs = x.reshape(*x.shape[:-1], m // (2 * half), 2, half)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(x.shape)
        half *= 2
    return x


def transformed(x: np.ndarray) -> np.ndarray:
    """Rows of whole numbers, padded, transformed and put in sequency order."""
    m = 1 << max(0, x.shape[1] - 1).bit_length()
    wide = np.zeros((len(x), m), x.dtype)
    wide[:, : x.shape[1]] = x
    return walsh(wide)[:, sequency(m)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance times the length) of each row's nearest entry, ties to the lower index. Both are
    transformed."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, x.dtype)
    so_far = (x[:, :1] - book[:, 0]) ** 2
    rival = book[so_far.argmin(1)]
    bound = ((x - rival) ** 2).sum(1)
    row, entry = np.nonzero(so_far <= bound[:, None])
    total = so_far[row, entry]
    for j in range(1, x.shape[1]):
        total = total + (x[row, j] - book[entry, j]) ** 2
        keep = total <= bound[row]
        row, entry, total = row[keep], entry[keep], total[keep]
    # what is left has its whole distance, row by row in order of entries; each row has its rival at least
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(total, at)
    best = np.flatnonzero(total == least[row])
    first = best[np.r_[True, row[best][1:] != row[best][:-1]]]
    return entry[first], least


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit where squared sums of the transform's differences stay below 2^62, else Python's integers."""
    most = float(np.abs(values).max(initial=0.0))
    if most * SCALE * 2 * max(1, 1 << max(0, values.shape[1] - 1).bit_length()) < 1 << 31:
        return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= 1 << 53 else math.floor(v * SCALE) for v in values.reshape(-1).tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


@dataclass(frozen=True)
class Codebooks:
    """entries[part][entry] is a list of whole numbers; length is that of the vectors."""

    length: int
    entries: list[list[list[int]]]

    def text(self) -> str:
        return ",".join(str(v) for part in self.entries for entry in part for v in entry)

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def kept(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there, not empty, and all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)


def _split(values: np.ndarray) -> np.ndarray:
    """(rows, parts, width): zeros at the end make up for a length that PARTS doesn't divide."""
    width = -(-values.shape[1] // PARTS)
    wide = np.zeros((len(values), PARTS * width), values.dtype)
    wide[:, : values.shape[1]] = values
    return wide.reshape(len(values), PARTS, width)


def _steps(column: pa.Array, length: int):
    """(first row, rows, values of the rows of this length) of at most STEP rows of a list column."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for at in range(0, len(column), STEP):
        fits = sizes[at : at + STEP] == length
        own = column.slice(at, STEP).filter(pa.array(fits))
        yield at, fits, own.flatten().to_numpy().reshape(-1, length)


def _assigned(values: np.ndarray, book: Codebooks):
    """(whole numbers by part, code of each row and part, distance of each row)."""
    x = _split(whole(values))
    entries = [np.array(part, dtype=object) for part in book.entries]
    width = x.shape[2]
    m = 1 << max(0, width - 1).bit_length()
    small = max((abs(v) for part in book.entries for entry in part for v in entry), default=0) * 2 * m < 1 << 31
    kind = np.int64 if small and x.dtype == np.int64 else object
    codes, errors = np.zeros((len(x), PARTS), np.int64), np.zeros(len(x), object)
    for p in range(PARTS):
        codes[:, p], scaled = nearest(transformed(x[:, p].astype(kind)), transformed(entries[p].astype(kind)))
        errors = errors + (scaled // m).astype(object)
    return x, codes, errors


def fit(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """Codebooks of the kept rows after ROUNDS rounds over all of them; None if there are none.

    The vectors' length is that of the smallest id; others take no part. Entries start as the parts of the ENTRIES
    smallest ids (of equal ids, the smaller vectors; null ids last), fewer if there are fewer rows. Each round is a job
    that starts from the table; a task sends the sums and counts of its entries, which Spark adds up, exactly.
    """
    order = [F.asc_nulls_last(id_col), F.asc(vector)]
    rows = kept(df, vector).select(id_col, vector)
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return None
    length = len(first[0][vector])
    rows = rows.where(F.size(vector) == length)
    start = np.array([r[vector] for r in rows.orderBy(*order).limit(ENTRIES).collect()], np.float64)
    book = Codebooks(length, [[[int(v) for v in entry] for entry in part] for part in _split(whole(start)).swapaxes(0, 1)])

    for _ in range(ROUNDS):

        def sums(batches, book=book):
            n = np.zeros((PARTS, ENTRIES), np.int64)
            total = np.zeros((PARTS, ENTRIES, -(-length // PARTS)), object)
            for batch in batches:
                for _, _, values in _steps(batch.column(0), length):
                    x, codes, _ = _assigned(values, book)
                    for p in range(PARTS):
                        n[p] += np.bincount(codes[:, p], minlength=ENTRIES)
                        for e in np.unique(codes[:, p]):
                            total[p, e] += x[codes[:, p] == e, p].sum(0)
            p, e = np.nonzero(n)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e], pa.int64()),
                "total": pa.array([[str(v) for v in total[i, j]] for i, j in zip(p, e, strict=True)], pa.list_(pa.string())),
            })

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            total = [str(sum(map(int, column))) for column in zip(*pdf["total"], strict=True)]
            return pdf[["part", "entry"]].head(1).assign(n=[pdf["n"].sum()], total=[total])

        schema = "part int, entry int, n long, total array<string>"
        # PARTS x ENTRIES rows reach the driver, whatever the table
        found = rows.select(vector).mapInArrow(sums, schema).groupBy("part", "entry").applyInPandas(added, schema).collect()
        entries = [list(part) for part in book.entries]
        for r in found:
            entries[r.part][r.entry] = [int(v) // r.n for v in r.total]
        book = Codebooks(length, entries)
    return book


def encode(df: DataFrame, book: Codebooks, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, code, error, label_error) of every kept row; ids and labels may be null or repeated.

    code has two hex digits a part; error is the row's squared distance to its entries; label_error is its sum over the
    rows that share the label, null included. A vector of another length than the codebooks' has no code and no error.
    An error that 64 bits can't hold is null, and so is its label's sum.
    """
    kinds = dict(df.dtypes)

    def coded(batches):
        for batch in batches:
            for at, fits, values in _steps(batch.column(2), book.length):
                _, codes, errors = _assigned(values, book)
                code, error = np.full(len(fits), None, object), np.full(len(fits), None, object)
                code[fits] = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                error[fits] = [e if e < 1 << 63 else None for e in errors]
                large = np.array([c is not None and e is None for c, e in zip(code, error, strict=True)], bool)
                part = batch.slice(at, len(fits))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64()), pa.array(large)], names=["_id", "_label", "code", "error", "_large"])

    rows = kept(df, vector).select(F.col(id_col).alias("_id"), F.col(label).alias("_label"), vector)
    out = rows.mapInArrow(coded, f"_id {kinds[id_col]}, _label {kinds[label]}, code string, error long, _large boolean")
    sums = out.groupBy("_label").agg(F.when(~F.bool_or("_large"), F.try_sum("error")).alias("label_error")).withColumnRenamed("_label", "_of")
    few = sums.limit(FEW_LABELS + 1).collect()
    if len(few) <= FEW_LABELS:
        small = df.sparkSession.createDataFrame(few, sums.schema)
        joined = out.join(F.broadcast(small), F.col("_label").eqNullSafe(F.col("_of")))
    else:
        salted = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = out.withColumn("_own", F.pmod(F.xxhash64("_id", "code"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_own") == F.col("_salt")))
    return joined.select(F.col("_id").alias(id_col), F.col("_label").alias(label), "code", "error", "label_error")
