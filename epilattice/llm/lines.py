"""Line dedup: of the lines that are alike, in all documents together, one is kept.

Lines get a MinHash signature of their character shingles, signatures are cut into bands, lines that share a band are
compared exactly (Jaccard of the shingle sets), links are joined by distributed union-find, and the first line of each
component stays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .linking import link_components
from .shared import BROADCAST_IDS, discard, settle, told_apart
from .textops import BASES, hashed, mix, prefix, release, sorted_sets, steps

#: Shingles of five characters: longer ones tell apart short lines that differ in one word. 20 bands of 6: a pair of
#: similarity 0.8 shares a band with probability 0.998, one of 0.3, as unrelated lines of one language have, with 0.014.
SHINGLE, BANDS, PER_BAND = 5, 20, 6
#: Documents whose lines tell which bands are frequent.
SAMPLE = 5_000


def char_shingles(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` characters (code points), line by line, with each one's line. Shorter: all as one."""
    if (data < 0x80).all():
        points = data.astype(np.uint64)
    else:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        offs = heads[offs]
    points += np.uint64(1)
    counts = np.diff(offs)
    n = np.maximum(counts - size + 1, 0)
    # polynomials of runs twice as long from shorter ones; what crosses a line's end is not taken
    h, have = points, 1
    while have < size:
        step = min(have, size - have)
        h = h[: len(h) - step] * np.uint64(pow(BASES[0], step, 2**64)) + (h if step == have else _runs(points, step))[have:][: len(h) - step]
        have += step
    starts = np.zeros(len(h) + 1, np.int8)
    full = np.flatnonzero(n)
    np.add.at(starts, offs[:-1][full], 1)
    np.add.at(starts, offs[:-1][full] + n[full], -1)
    h = mix(h[np.cumsum(starts[:-1], dtype=np.int8) > 0])
    line = np.repeat(np.arange(len(n)), n)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        # one shingle each, of its own length
        pre = prefix(points, BASES[0])
        h = np.concatenate([h, hashed(offs[:-1][short], offs[1:][short], pre, BASES[0])])
        line = np.concatenate([line, short])
    return h, line


def _runs(points: np.ndarray, size: int) -> np.ndarray:
    h = points[: len(points) - size + 1]
    for k in range(1, size):
        h = h * np.uint64(BASES[0]) + points[k : len(points) - size + 1 + k]
    return h


_orders: dict[int, np.ndarray] = {}


def _order(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the others for a value, the same for every line: (attempt, bin)."""
    if bins not in _orders:
        _orders[bins] = np.random.default_rng(bins).permuted(np.tile(np.arange(bins)[:, None], bins), axis=0)
    return _orders[bins]


def signatures(h: np.ndarray, line: np.ndarray, n_lines: int, bins: int) -> np.ndarray:
    """One-permutation MinHash: the smallest hash in each bin; an empty bin borrows from the first full one in an order
    of its own, so that lines with like sets borrow alike."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n_lines * bins, empty, np.uint64)
    place = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, line * bins + place, h * np.uint64(BASES[1]))
    order, full = _order(bins), sig != empty
    values = full.reshape(n_lines, bins).sum(axis=1)
    filled = sig.copy()
    # nearly full lines need a few attempts; what has few values is settled line by line
    few = values < bins // 4
    at = np.flatnonzero(~full & ~np.repeat(few, bins))
    column, attempt = at % bins, 0
    start = at - column
    while len(at):
        source = start + order[attempt].take(column)
        got = full.take(source)
        hit = np.flatnonzero(got)
        sig[at.take(hit)] = mix(filled.take(source.take(hit)) + np.uint64(attempt + 1))
        left = np.flatnonzero(~got)
        at, column, start = at.take(left), column.take(left), start.take(left)
        attempt += 1
    turn, every = np.argsort(order, axis=0), np.arange(bins)  # (source, bin): the attempt at which the bin asks it
    for k in np.flatnonzero(few & (values > 0)).tolist():
        own = slice(k * bins, (k + 1) * bins)
        have = np.flatnonzero(full[own])
        asked = turn.take(have, axis=0)
        best = asked.argmin(axis=0)
        value = mix(filled[own].take(have.take(best)) + (asked[best, every] + 1).astype(np.uint64))
        sig[own] = np.where(full[own], filled[own], value)
    return sig.reshape(n_lines, bins)


def line_bands(size: int, bands: int, per_band: int):
    def run(batches):
        for batch in batches:
            # equal lines of a batch need one signature
            batch = batch.take(pa.array(np.unique(batch.column("id").to_numpy(), return_index=True)[1]))
            for row, data, offs in steps(batch.column("line")):
                n = len(offs) - 1
                h, line = char_shingles(data, offs, size)
                sig = signatures(h, line, n, bands * per_band).reshape(n, bands, per_band)
                key = np.zeros((n, bands), np.uint64)
                for k in range(per_band):
                    key = mix(key + sig[:, :, k])
                key = mix(key + np.arange(bands, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(row, n), pa.FixedSizeListArray.from_arrays(pa.array(key.reshape(-1).view(np.int64)), bands).cast(pa.list_(pa.int64()))],
                    names=["id", "bands"],
                )

    return run


def line_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each line, sorted, and where each line's begin."""
    h, line = char_shingles(data, offs, size)
    if len(line) and (line[1:] < line[:-1]).any():  # lines shorter than a shingle come last
        order = np.argsort(line, kind="stable")
        h, line = h[order], line[order]
    return sorted_sets(h, np.searchsorted(line, np.arange(len(offs))))


def dedup_lines(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, per_band: int = PER_BAND, identity: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): row (the input row as a struct), doc_id, n_lines, n_kept and
    kept (the text with the lines left, joined by a line break).

    Lines end at \\n. Lines are alike from a Jaccard similarity of 0.8 of their character shingles, upper and lower
    case apart; equal lines always are. Of each component the first line stays, in order of doc_id (null last), text
    hash and place; repeated rows all keep what the first of them keeps. Blank lines (spaces or nothing) are not
    compared and stay. Null text: no lines, a null `kept`; an empty one is a blank line. Lines are named by two 64-bit
    hashes; identity may replace the first.
    """
    docs = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("text").alias("_th"))

    def broken(docs: DataFrame) -> DataFrame:
        out = docs.select("doc_id", "_th", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.trim("line") != "")
        return out.withColumn("id", identity(F.col("line"))).withColumn("id2", F.xxhash64(F.lit(1), "line"))

    def postings(docs: DataFrame) -> DataFrame:
        signed = named(broken(docs).select("id", "id2", "line")).mapInArrow(line_bands(size, bands, per_band), "id long, bands array<long>")
        return signed.select(F.explode("bands").alias("key"), "id")

    lines = settle(broken(docs).drop("line"))
    named = told_apart(lines.select("id", "id2"))
    some = max(1, docs.count() // SAMPLE)

    def fetch(ids: DataFrame, kept) -> DataFrame:
        ids = kept(ids)
        small = ids.count() <= BROADCAST_IDS
        own = named(broken(docs).select("id", "id2", F.col("line").alias("text")))
        return own.join(F.broadcast(ids) if small else ids, "id").dropDuplicates(["id"])

    sample = settle(postings(docs.where(F.pmod("_th", F.lit(some)) == 0)))
    groups = link_components(postings(docs), sample, fetch, lambda data, offs: line_sets(data, offs, size), sign=False)
    joined = named(lines).join(groups, "id", "left").withColumn("_g", F.coalesce("component", "id")).drop("component", "id")
    place = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_th", "no")
    first = joined.groupBy("_g").agg(F.min(place).alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f._th").alias("_t"), F.col("f.no").alias("no"))
    kept = settle(first.groupBy("_id", "_t").agg(F.collect_list("no").alias("_stay")))
    discard(lines, sample, groups)
    out = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_t")), "left").select("row", "_stay")
    schema = StructType([out.schema["row"], *(StructField(c, LongType()) for c in ("n_lines", "n_kept")), StructField("kept", StringType())])
    return out.mapInArrow(left_lines, schema).select("row", "row.doc_id", "n_lines", "n_kept", "kept")


def left_lines(batches):
    """Rows with the lines whose places stay, and blank ones."""
    for batch in batches:
        out = []
        for t, stay in zip(batch.column("row").field("text").to_pylist(), batch.column("_stay").to_pylist(), strict=True):
            if t is None:
                out.append((0, 0, None))
                continue
            own, stay = t.split("\n"), set(stay or ())
            left = [x for i, x in enumerate(own) if i in stay or not x.strip(" ")]
            out.append((len(own), len(left), "\n".join(left)))
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", "n_lines", "n_kept", "kept"])
        release()


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with only the lines that stay as text. Documents that had lines and keep none go, all others stay."""
    out = dedup_lines(docs).where("NOT (n_lines > 0 AND trim(kept) = '' AND trim(row.text) <> '')")
    return out.select("row.*", "kept").withColumn("text", F.col("kept")).select(*docs.columns)
