"""Substring dedup: words in a run of `width` words that also starts anywhere else are removed.

Three passes over the text. The first counts anchors in a count-min sketch: the anchor of a window is its smallest
hashed run of eight words, so equal windows have equal anchors at equal places, while a text has far fewer anchors
than windows. The tasks' sketches are summed by Spark. The sketch never underestimates, so a window whose anchor is
estimated once is unique. The second pass groups the other windows exactly, by 128 bits of hash, and keeps those that
turn out to be unique after all; the third removes what the first suspected and the second did not clear.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle
from .textops import BASES, hashed, merged_sketch, mix, powers, prefix, sketch_cells, sketch_rows, steps, windows, words

WIDTH, ANCHOR = 35, 8
#: Two rows of 2^26 one-byte cells while counting; 16 MB of bits when broadcast. Fixed, whatever the input.
ROWS, BITS = 2, 26


def anchors(h: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that start at `at`: the position of the anchor of each, and the anchors' hash by position."""
    k = min(ANCHOR, width)
    n = len(h) - k + 1
    first = np.arange(n)
    runs = hashed(first, first + k, prefix(h, BASES[0]), BASES[0])
    # the leftmost smallest run: the hash above, the position below
    low = (runs & np.uint64(0xFFFFFFFF00000000)) | first.astype(np.uint64)
    span, have = width - k + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    return (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), runs


def count_anchors(width: int, bits: int):
    def run(batches):
        counts = np.zeros((ROWS, 1 << bits), np.uint8)
        for batch in batches:
            for _, data, offs in steps(batch.column("text")):
                _, _, h, first = words(data, offs)
                at, _ = windows(h, first, width)
                if not len(at):
                    continue
                place, runs = anchors(h, at, width)
                place = place[np.concatenate([[True], place[1:] != place[:-1]])]
                for r, cells in enumerate(sketch_cells(runs[place], ROWS, bits)):
                    cells, n = np.unique(cells, return_counts=True)
                    counts[r, cells] = np.minimum(counts[r, cells] + np.minimum(n, 2), 2)
        yield from sketch_rows(counts)

    return run


def suspects(h: np.ndarray, first: np.ndarray, width: int, bits: list[np.ndarray]):
    """Windows whose anchor is estimated twice or more: (index of the first word, hash)."""
    at, code = windows(h, first, width)
    if not len(at):
        return at, code
    place, runs = anchors(h, at, width)
    change = np.concatenate([[True], place[1:] != place[:-1]])
    hot = np.ones(int(change.sum()), bool)
    for row, cells in zip(bits, sketch_cells(runs[place[change]], ROWS, (8 * len(bits[0])).bit_length() - 1), strict=True):
        hot &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
    keep = hot[np.cumsum(change) - 1]
    return at[keep], code[keep]


def second_hash(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    other = mix(h ^ np.uint64(0x5851F42D4C957F2D))
    return hashed(at, at + width, prefix(other, BASES[0]), BASES[0])


def same_windows(at: np.ndarray, code: np.ndarray, pos: pa.Array, found: pa.Array) -> np.ndarray:
    """Which of a text's windows, at ascending places with these hashes, are among (pos, found)."""
    out = np.zeros(len(at), bool)
    if len(at):
        pos, found = pos.to_numpy(), found.to_numpy().view(np.uint64)
        near = np.minimum(np.searchsorted(at, pos), len(at) - 1)
        out[near[(at[near] == pos) & (code[near] == found)]] = True
    return out


def row_name() -> Column:
    """A row's name between passes. Rows of one name get each other's cleared windows, which are told by their hashes."""
    return F.xxhash64("doc_id", "text")


def dedup_substrings(docs: DataFrame, width: int = WIDTH, cell_bits: int = BITS) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words, n_removed, kept (the words left, one space apart).

    Words are [^\\x20\\x09-\\x0D]+, unchanged. Null or empty text: no words and an empty `kept`. Texts shorter than
    `width` words lose nothing. A run that overlaps its own copy counts as repeated. Repeated rows repeat each other,
    whatever their doc_id, null included. Other columns are ignored; an empty table gives an empty one. cell_bits sets
    the sketch's size: a small one only suspects more windows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", row_name().alias("_rk"))
    parts = docs.select("text").mapInArrow(count_anchors(width, cell_bits), "block int, cells binary")
    bits = spark.sparkContext.broadcast(np.packbits(merged_sketch(parts, ROWS, cell_bits, 2) >= 2, axis=1))

    def emit(batches):
        for batch in batches:
            rk = batch.column("_rk").to_numpy(zero_copy_only=False)
            for row, data, offs in steps(batch.column("text")):
                _, _, h, first = words(data, offs)
                at, code = suspects(h, first, width, bits.value)
                if len(at):
                    doc = np.searchsorted(first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (code.view(np.int64), second_hash(h, at, width).view(np.int64), rk[row + doc], (at - first[doc]).astype(np.int32))],
                        names=["a", "b", "_rk", "pos"],
                    )

    cleared = (
        docs.select("_rk", "text").mapInArrow(emit, "a long, b long, _rk long, pos int")
        .groupBy("a", "b").agg(F.count("*").alias("n"), F.min("_rk").alias("_rk"), F.min("pos").alias("pos"))
        .where("n = 1").groupBy("_rk").agg(F.collect_list(F.struct("pos", "a")).alias("cleared"))
    )
    cleared = settle(cleared)

    def remove(batches):
        for batch in batches:
            texts, free = batch.column("text"), batch.column("cleared")
            ids, n_words, n_removed, kept = batch.column("doc_id"), [], [], []
            for row, data, offs in steps(texts):
                starts, ends, h, first = words(data, offs)
                at, code = suspects(h, first, width, bits.value)
                mark = np.zeros(len(h) + 1, np.int32)
                repeated = np.ones(len(at), bool)
                for i in range(len(first) - 1):
                    if free[row + i].is_valid:
                        own = slice(*np.searchsorted(at, first[i : i + 2]))
                        repeated[own] = ~same_windows(at[own] - first[i], code[own], *free[row + i].values.flatten())
                at = at[repeated]
                np.add.at(mark, at, 1)
                np.add.at(mark, at + width, -1)
                stay = np.cumsum(mark[:-1]) == 0
                raw = data.tobytes()
                for i in range(len(first) - 1):
                    own = raw[offs[i] : offs[i + 1]].split()
                    keep = stay[first[i] : first[i + 1]]
                    n_words.append(len(own))
                    n_removed.append(len(own) - int(keep.sum()))
                    kept.append(b" ".join(compress(own, keep.tolist())))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(cleared, "_rk", "left").select("doc_id", "text", "cleared").mapInArrow(remove, f"doc_id {id_type}, n_words long, n_removed long, kept string")
