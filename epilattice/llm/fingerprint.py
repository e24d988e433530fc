"""Document fingerprints by prefix polynomial hashes.

The modular prefix array of a text answers whether any two spans are equal, wherever they stand, and finds how far two
texts agree from given places by binary search. A fingerprint keeps the array at corners that the text itself chooses
(where the hash of a short window has enough trailing zeros), so an insertion moves corners along with the text. Two
fingerprints can answer the same questions down to a block: their likeness is the share of the longer text that lies in
common extensions, at whatever places.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .textops import mix

#: Two moduli and bases: 62 bits a hash, and every product fits 64 bits.
MODULI = (2147483647, 2147483629)
ROOTS = (1299709, 15485863)
INVERSES = tuple(pow(root, -1, m) for root, m in zip(ROOTS, MODULI, strict=True))
#: Blocks of a fingerprint, about; the mean block is a power of two of characters. Corners stand where a window of so
#: many characters says so, and after so many mean blocks without one.
BLOCKS, WINDOW, LONGEST = 64, 12, 8
#: Trailing zeros of a corner that stands at every level.
FORCED = 63
#: A corner as it is written: place, trailing zeros of the window's hash, both hashes of the prefix.
CORNER = np.dtype([("place", ">u4"), ("zeros", "u1"), ("a", ">u4"), ("b", ">u4")])
#: Rows of a bucket.
BUCKET = 50_000
_tables: dict[tuple, list[np.ndarray]] = {}


def root_powers(n: int, roots: tuple = ROOTS) -> list[np.ndarray]:
    """Powers of both bases up to n, by doubling."""
    have = _tables.get(roots)
    if have is None or len(have[0]) <= n:
        have = []
        for root, m in zip(roots, MODULI, strict=True):
            p = np.ones(1, np.uint64)
            while len(p) <= n:
                p = np.concatenate([p, p * np.uint64(pow(root, len(p), m)) % np.uint64(m)])
            have.append(p)
        _tables[roots] = have
    return have


class PrefixHashes:
    """The prefix arrays of one text: entry i of each is the sum of code point j times root^j over j < i."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for p, m in zip(root_powers(self.n), MODULI, strict=True):
            out = np.zeros(self.n + 1, np.uint64)
            # sums stay below 2^64 for texts of up to 2^33 characters, as every term is below 2^31
            np.cumsum((points.astype(np.uint64) + np.uint64(1)) * p[: self.n] % np.uint64(m), out=out[1:])
            self.sums.append(out % np.uint64(m))

    @classmethod
    def of(cls, text: str | None) -> PrefixHashes:
        return cls(np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32))

    def equal(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        """Whether self[i:i + length] and other[j:j + length] are the same."""
        if i + length > self.n or j + length > other.n:
            return False
        for p, m, a, b in zip(root_powers(max(i, j)), MODULI, self.sums, other.sums, strict=True):
            x = (int(a[i + length]) - int(a[i])) * int(p[max(i, j) - i])
            y = (int(b[j + length]) - int(b[j])) * int(p[max(i, j) - j])
            if (x - y) % m:
                return False
        return True

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """The longest length for which self[i:] and other[j:] agree, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low

    def corners(self) -> tuple[int, np.ndarray]:
        """(mean block, corners): all places where the window before has so many trailing zeros, so those of a longer
        mean block are among those of a shorter one. Texts that repeat themselves have forced ones instead."""
        level = mean = 1 << max(0, (self.n - 1) // BLOCKS).bit_length() if self.n else 1
        m, sums = np.uint64(MODULI[0]), self.sums[0]
        width = min(WINDOW, self.n)
        window = mix((sums[width:] + m - sums[: self.n + 1 - width]) % m * root_powers(self.n, INVERSES)[0][: self.n + 1 - width] % m)[:-1]
        at = np.flatnonzero(window & np.uint64(level - 1) == 0)
        while len(at) > 4 * BLOCKS:
            level *= 2
            at = at[window[at] & np.uint64(level - 1) == 0]
        own = window[at] | np.uint64(1 << 40)
        zeros = np.log2((own & (~own + np.uint64(1))).astype(float)).astype(np.uint8)
        place = at + width
        ends = np.concatenate([[0], place, [self.n]])
        wide = np.flatnonzero(np.diff(ends) > LONGEST * mean)
        forced = [np.arange(ends[k] + LONGEST * mean, ends[k + 1], LONGEST * mean) for k in wide]
        out = np.zeros(len(place) + sum(map(len, forced)) + 1, CORNER)
        out["place"] = np.concatenate([place, *forced, [self.n]])
        out["zeros"] = np.concatenate([zeros, np.full(len(out) - len(zeros), FORCED, np.uint8)])
        return level, out[np.argsort(out["place"], kind="stable")]

    def fingerprint(self) -> str:
        """length:mean block:corners in hexadecimal; the last corner is the whole text's."""
        level, out = self.corners()
        out["a"], out["b"] = (x[out["place"]] for x in self.sums)
        return f"{self.n:x}:{level:x}:{out.tobytes().hex()}"


class Blocks:
    """A fingerprint read back: corners, and hashes of the spans between them that don't depend on their places."""

    def __init__(self, fingerprint: str, least: int = 1):
        n, _, corners = fingerprint.split(":")
        found = np.frombuffer(bytes.fromhex(corners), CORNER)
        found = np.concatenate([np.zeros(1, CORNER), found[found["zeros"] >= least.bit_length() - 1]])
        self.n = int(n, 16)
        place = found["place"].astype(np.int64)
        self.at, self.sums, steps = place.tolist(), [], [np.diff(place).tolist()]
        self.back = [p[place].tolist() for p in root_powers(self.n, INVERSES)]
        for c, m, back in zip("ab", MODULI, root_powers(self.n, INVERSES), strict=True):
            total = found[c].astype(np.uint64)
            self.sums.append(total.tolist())
            steps.append(((total[1:] + np.uint64(m) - total[:-1]) % np.uint64(m) * back[place[:-1]] % np.uint64(m)).tolist())
        #: Of each block its length and both hashes.
        self.steps = list(zip(*steps, strict=True))

    def span(self, i: int, j: int) -> tuple[int, int, int]:
        """Length and both hashes of the text between two corners."""
        return self.at[j] - self.at[i], *((s[j] - s[i]) * back[i] % m for s, back, m in zip(self.sums, self.back, MODULI, strict=True))


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints; else the part of the longer text in runs of blocks that both texts have, in the same
    order. A block of the first is looked up among the second's blocks that are left, and from there the common run
    is extended by binary search, as prefix differences tell whether any two spans are equal."""
    if a == b:
        return 1.0
    least = max(int(x.split(":", 2)[1], 16) for x in (a, b))
    one, two = Blocks(a, least), Blocks(b, least)
    places: dict[tuple, list[int]] = {}
    for j, step in enumerate(two.steps):
        places.setdefault(step, []).append(j)
    i, j, same = 0, 0, 0
    while i < len(one.steps):
        own = places.get(one.steps[i], ())
        k = bisect_left(own, j)
        if k == len(own):
            i += 1
            continue
        j = own[k]
        low, high = 1, min(len(one.at) - i, len(two.at) - j) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if one.span(i, i + mid) == two.span(j, j + mid) else (low, mid - 1)
        same += one.at[i + low] - one.at[i]
        i, j = i + low, j + low
    return same / max(one.n, two.n)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) characters replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(doc_id, text) in buckets by doc_id, each bucket followed by the first rows of the next one, the last by
    those of the first: columns doc_id, text, _b, _tail; rows sorted within each partition by _b, _tail, doc_id, text.

    Bucket bounds are quantiles of the ids; only bounds and each bucket's smallest id reach the driver.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [1.0], 10_000)).first()[0] or []
    cuts = np.array(sorted({int(c) for c in cuts if c is not None}), np.int64)

    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(cuts, ids[known].to_numpy().astype(np.int64), "left")
        return pd.Series(out)

    dealt = docs.select("doc_id", "text", F.pandas_udf(bucket, "int")("doc_id").alias("_b"))
    # a null id sorts first
    found = dealt.groupBy("_b").agg(F.count_if(F.col("doc_id").isNull()).alias("none"), F.min("doc_id").alias("low")).orderBy("_b").collect()
    rows = dealt.withColumn("_tail", F.lit(False))
    if found:
        # (bucket, its smallest id or null, the bucket before): one row a bucket
        heads = [(r._b, None if r.none else r.low, found[i - 1]._b) for i, r in enumerate(found)]
        heads = F.broadcast(docs.sparkSession.createDataFrame(heads, "_h int, low long, before int"))
        firsts = dealt.join(heads, (F.col("_b") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("low")))
        # of the rows that tie as a bucket's first, the one with the smallest text follows the bucket before
        firsts = firsts.groupBy("before").agg(F.min(F.struct("doc_id", "text")).alias("f"))
        rows = rows.unionByName(firsts.select("f.doc_id", "f.text", F.col("before").alias("_b"), F.lit(True).alias("_tail")))
    return rows.repartition(buckets, "_b").sortWithinPartitions("_b", "_tail", "doc_id", "text")


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint,
    near_edited, near_next.

    The next document is the one that follows in order of doc_id (null first), then text (null first); after the last
    comes the first, which may be the document itself. Null text is the empty text. Equal texts have equal
    fingerprints. likeness() gives near_edited and near_next. doc_id is a whole number; the order is cut into buckets
    of some BUCKET rows, whose tasks run apart.
    """
    docs = docs.select("doc_id", "text")
    if buckets is None:
        buckets = max(8, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // BUCKET)

    def run(batches):
        waiting = None
        out: list[tuple] = []

        def finish(doc_id, text, prints, following, next_prints):
            changed = edited(text, following)
            new = PrefixHashes.of(changed).fingerprint() if changed != text else prints
            return (doc_id, len(text), prints, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), new, likeness(prints, new), likeness(prints, next_prints))

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "text", "_b", "_tail")]
            for doc_id, text, b, tail in zip(*cols, strict=True):
                text = text or ""
                prints = PrefixHashes.of(text).fingerprint()
                if waiting is not None and waiting[3] == b:
                    out.append(finish(*waiting[:3], text, prints))
                waiting = None if tail else (doc_id, text, prints, b)
            if out:
                yield pack(out)
                out = []

    id_field = docs.schema["doc_id"].dataType
    schema = f"doc_id {id_field.simpleString()}, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [to_arrow_type(id_field), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return in_order(docs, buckets).mapInArrow(run, schema)
