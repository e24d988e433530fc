"""Language identification by n-gram filters that answer with a bitmask of languages.

Training counts character n-grams (by 64-bit hashes) in each language over all training texts. An n-gram belongs to
the languages in which it is frequent against the language of its highest rate, however rare it is. The model is a Bloom
filter of these members kept bit-sliced: each cell holds one bit for each language, and the AND of an n-gram's cells is
the set of all languages that contain it. Spark builds its cells and keeps them as a table. A text is decided by how many
of its n-grams each language contains, less what false positives, measured by how full each language's bits are, add.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructType

from .shared import discard, settle, unused
from .textops import BASES, hashed, mix, prefix, steps

#: Bytes of an n-gram, without letters' case; white space bounds words and is part of it.
NGRAM = 5
#: The n-grams of a language: those whose rate in it is at least this part of the highest one.
SHARE = 0.5
#: The filter has this many cells for each member, and looks at two cells for each n-gram.
CELLS_PER_MEMBER, PROBES = 6, 2
#: Bytes of the part of a filter that a task holds at a time, and cells of the blocks that Spark builds it from.
SLICE_BYTES, BLOCK_BITS = 64 << 20, 16
#: Distinct n-grams that a task gathers before it hands them on, and bytes of text that it looks at in one step.
GATHERED, STEP = 1 << 19, 1 << 18
UNKNOWN = "und"

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
FOLD = np.full(256, 32, np.uint8)
FOLD[65:91] = np.arange(97, 123)
FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def ngrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams with a letter in the middle: (hash, text). ASCII letters are folded to lower case, bytes
    beyond ASCII stay, all else is one kind of space, which also surrounds every text."""
    pad = NGRAM - 1
    n = len(offs) - 1
    # every text between two runs of spaces, so that no n-gram crosses from one text into another
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * pad, np.diff(offs))
    flat = np.full(len(data) + (n + 1) * pad, 32, np.uint8)
    flat[at] = FOLD[data]
    starts = np.arange(len(flat) - pad)
    text = np.minimum(np.searchsorted(offs[:-1] + np.arange(n) * pad, starts, "right") - 1, n - 1)
    centre = flat[starts + NGRAM // 2] != 32  # an n-gram belongs to the letter in its middle
    starts, text = starts[centre], text[centre]
    return hashed(starts, starts + NGRAM, prefix(flat.astype(np.uint64), BASES[0]), BASES[0]), text


def centres(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many n-grams each text has: one for every byte that isn't folded to a space."""
    total = np.concatenate([[0], np.cumsum(FOLD[data] != 32)])
    return total[offs[1:]] - total[offs[:-1]]


def without_letters(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has no letter. Only texts without an ASCII letter are looked at character by character."""
    total = np.concatenate([[0], np.cumsum(LETTER[data])])
    none = total[offs[1:]] == total[offs[:-1]]
    for i in np.flatnonzero(none):
        none[i] = not any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
    return none


class LanguageFilter:
    """A Bloom filter that answers with all languages of an n-gram, kept as a settled table of blocks of cells.

    A cell has a bit for each language. The filter is as large as its members ask for; it is cut into slices of at most
    SLICE_BYTES, all cells of an n-gram being in one of them, so that a text is answered slice by slice, whatever the
    filter's size. false_rate: how often each language's bits answer for an n-gram that it lacks, by their fill.
    """

    def __init__(self, languages: list[str], members: DataFrame):
        """members: n-grams as (h, masks), their languages' bits in 64-bit words."""
        self.languages = languages
        width = self.width = max(1, -(-len(languages) // 8))  # bytes of a cell
        bits = self.bits = max(6, (CELLS_PER_MEMBER * members.count() - 1).bit_length())
        slice_bits = self.slice_bits = min(bits, max(6, (SLICE_BYTES // width).bit_length() - 1))
        block_bits = self.block_bits = min(self.slice_bits, BLOCK_BITS)

        def placed(batches):
            for batch in batches:
                h = batch.column("h").to_numpy().view(np.uint64)
                masks = batch.column("masks").flatten().to_numpy().reshape(len(h), -1).view(np.uint8)[:, :width]
                for at in filter_cells(mix(h), PROBES, bits, slice_bits):
                    packed = pa.Array.from_buffers(pa.binary(width), len(h), [None, pa.py_buffer(masks.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(at >> block_bits), pa.array((at & ((1 << block_bits) - 1)).astype(np.int32)), packed.cast(pa.binary())], names=["block", "cell", "mask"])

        def built(table: pa.Table) -> pa.Table:
            cells = np.zeros((1 << block_bits, width), np.uint8)
            masks = np.frombuffer(b"".join(table.column("mask").to_pylist()), np.uint8).reshape(-1, width)
            np.bitwise_or.at(cells, table.column("cell").to_numpy(), masks)
            filled = [int(_bit(cells, k).sum()) for k in range(len(languages))]
            return pa.table({"block": table.column("block")[:1], "cells": pa.array([cells.tobytes()], pa.binary()), "filled": pa.array([filled], pa.list_(pa.int64()))})

        # hashes deal members evenly: a block has about as many as any other one
        blocks = members.mapInArrow(placed, "block long, cell int, mask binary").groupBy("block").applyInArrow(built, "block long, cells binary, filled array<long>")
        self.blocks = settle(blocks)
        filled = dict(self.blocks.select(F.posexplode("filled").alias("k", "n")).groupBy("k").agg(F.sum("n")).collect())  # a row for each language
        self.false_rate = np.array([filled.get(k, 0) / (1 << bits) for k in range(len(languages))]) ** PROBES

    @property
    def slices(self) -> int:
        return 1 << (self.bits - self.slice_bits)

    def slice(self, i: int) -> np.ndarray:
        """The cells of one slice, SLICE_BYTES at most."""
        each = 1 << (self.slice_bits - self.block_bits)
        cells = np.zeros((each, 1 << self.block_bits, self.width), np.uint8)
        for r in self.blocks.where(F.col("block").between(i * each, (i + 1) * each - 1)).select("block", "cells").toLocalIterator():
            cells[r.block - i * each] = np.frombuffer(r.cells, np.uint8).reshape(-1, self.width)
        return cells.reshape(-1, self.width)


def _bit(masks: np.ndarray, k: int) -> np.ndarray:
    return (masks[:, k // 8] >> (k % 8)) & 1


def filter_cells(h: np.ndarray, probes: int, bits: int, slice_bits: int) -> list[np.ndarray]:
    """The cells of each hash in a filter of 2^bits cells, all of them in one slice of 2^slice_bits."""
    first = (mix(h) >> np.uint64(64 - bits)).astype(np.int64)
    inside = (1 << slice_bits) - 1
    return [first, *((first & ~inside) | (mix(h + np.uint64(r * BASES[0] % 2**64)).astype(np.int64) & inside) for r in range(1, probes))]


def masks_of(cells: np.ndarray, grams: np.ndarray, bits: int, i: int = 0) -> np.ndarray:
    """All languages that contain each n-gram, as bits, from slice i of a filter of 2^bits cells; none for n-grams of
    other slices."""
    slice_bits = len(cells).bit_length() - 1
    first, *rest = filter_cells(mix(grams), PROBES, bits, slice_bits)
    own = first >> slice_bits == i
    out = cells[first & (len(cells) - 1)]
    for at in rest:
        out &= cells[at & (len(cells) - 1)]
    out[~own] = 0
    return out


def count_ngrams(batches):
    """Each n-gram that a task has seen in a language, with how often: (h, lang, n)."""
    held: dict[str, list] = {}
    size = 0

    def merged(parts):
        h, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        return h, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def handed_on():
        for lang, parts in held.items():
            h, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([lang] * len(h), pa.string()), pa.array(n)], names=["h", "lang", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        for row, data, offs in steps(batch.column("text"), STEP):
            h, text = ngrams(data, offs)
            own = langs[row : row + len(offs) - 1]
            for lang in set(own.tolist()):
                grams, n = np.unique(h[(own == lang)[text]], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((grams, n))
                if len(parts) > 8:
                    held[lang] = [merged(parts)]
            size = sum(len(h) for parts in held.values() for h, _ in parts)
            if size >= GATHERED:
                yield from handed_on()
    yield from handed_on()


def language_members(training: DataFrame) -> tuple[list[str], DataFrame]:
    """(languages, members): every n-gram of some language as (h, masks), masks holding its languages' bits, a word
    for each 64 languages."""
    training = training.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    # gathered in tasks first, so that what is dealt grows with distinct n-grams; then dealt once, by n-gram
    counts = training.mapInArrow(count_ngrams, "h long, lang string, n long").repartition("h").groupBy("h", "lang").agg(F.sum("n").alias("n"))
    counts = settle(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r.lang for r in totals.collect())  # a row for each language
    number = counts.sparkSession.createDataFrame(list(enumerate(languages)), "k int, lang string")
    rated = counts.join(F.broadcast(totals.join(number, "lang")), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = F.max("rate").over(W.partitionBy("h"))
    rated = rated.withColumn("best", best).where(F.col("rate") >= SHARE * F.col("best"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k") % 64)
    word = lambda w: F.coalesce(F.bit_or(F.when(F.floor(F.col("k") / 64) == w, bit)), F.lit(0).cast("long"))
    members = settle(rated.groupBy("h").agg(F.array(*[word(w) for w in range(max(1, -(-len(languages) // 64)))]).alias("masks")))
    discard(counts)
    return languages, members


def fit(training: DataFrame) -> LanguageFilter:
    """A filter from training(text, lang). Null texts and languages teach nothing; no rows give a filter without
    languages, which answers `und`. Neither members nor the whole filter reach the driver."""
    languages, members = language_members(training)
    model = LanguageFilter(languages, members)
    discard(members)
    return model


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """docs(text, ...) with lang_pred and score (0 to 1, the corrected share of n-grams that the language contains).

    `und` and 0 if text is null or has no letter, or if the model has no language. Ties go to the language that
    sorts first. All columns and rows stay; columns of these two names are replaced.
    """
    docs, predict, hits = _predictor(docs.drop("lang_pred", "score"), model)

    def run(batches):
        for batch in batches:
            names, scores = predict(batch)
            rest = [(c, batch.column(c)) for c in batch.schema.names if c != hits]
            rest += [("lang_pred", pa.array(names, pa.string())), ("score", pa.array(scores, pa.float64()))]
            yield pa.RecordBatch.from_arrays([x for _, x in rest], names=[c for c, _ in rest])

    kept = docs.drop(hits)
    return docs.mapInArrow(run, StructType(list(kept.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType()))


def _predictor(docs: DataFrame, model: LanguageFilter):
    """(docs, predict, hits): predict turns a batch of docs into (names, scores).

    A model of one slice is asked in that pass. A larger one is asked slice by slice before, one pass over docs for each
    but the last: what a text has hit so far is carried along in a column `hits` and settled, so that a task never
    holds more than one slice.
    """
    (hits,) = unused(docs, "hits")
    spark, languages, bits, rates = docs.sparkSession, model.languages, model.bits, model.false_rate

    def counter(i: int):
        shared = spark.sparkContext.broadcast(model.slice(i))

        def count(batch: pa.RecordBatch) -> np.ndarray:
            """For each text and language the n-grams that slices up to i answer for."""
            out = np.zeros((batch.num_rows, len(languages)), np.int64)
            for row, data, offs in steps(batch.column("text"), STEP):
                n = len(offs) - 1
                h, text = ngrams(data, offs)
                masks = masks_of(shared.value, h, bits, i)
                for k in range(len(languages)):
                    out[row : row + n, k] = np.bincount(text[_bit(masks, k) == 1], minlength=n)
            if i:
                out += np.frombuffer(b"".join(batch.column(hits).to_pylist()), np.int64).reshape(out.shape)
            return out

        return count

    last, before = model.slices - 1, None
    for i in range(last):
        def carry(batches, count=counter(i)):
            for batch in batches:
                rest = [(c, batch.column(c)) for c in batch.schema.names if c != hits]
                rest.append((hits, pa.array([x.tobytes() for x in count(batch)], pa.binary())))
                yield pa.RecordBatch.from_arrays([x for _, x in rest], names=[c for c, _ in rest])

        docs = settle(docs.mapInArrow(carry, StructType(list(docs.drop(hits).schema.fields)).add(hits, BinaryType())))
        if before is not None:
            discard(before)
        before = docs
    count = counter(last)

    def predict(batch: pa.RecordBatch) -> tuple[list[str], list[float]]:
        if not languages:
            return [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
        total, none = np.zeros(batch.num_rows, np.int64), np.ones(batch.num_rows, bool)
        for row, data, offs in steps(batch.column("text"), STEP):
            n = len(offs) - 1
            total[row : row + n], none[row : row + n] = centres(data, offs), without_letters(data, offs)
        share = count(batch) / np.maximum(total, 1)[:, None]
        scores = np.clip((share - rates) / np.maximum(1 - rates, 1e-9), 0, 1)
        names = [UNKNOWN if x else languages[b] for b, x in zip(scores.argmax(axis=1), none, strict=True)]
        return names, np.where(none, 0.0, scores.max(axis=1)).tolist()

    return docs, predict, hits


def held_out(doc_id: str = "doc_id"):
    """Whether a row is held out of training: crc32 of the id as text, modulo 3, is 1. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_known(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """docs without the rows whose language is undetermined or whose score is below `least`; columns stay."""
    schema = docs.schema
    model = fit(docs.where(~held_out()))
    docs, predict, hits = _predictor(docs, model)
    discard(model.blocks)  # the tasks have its slices

    def run(batches):
        for batch in batches:
            names, scores = predict(batch)
            kept = batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(names, scores, strict=True)], pa.bool_()))
            yield kept.drop_columns([hits]) if hits in kept.schema.names else kept

    return docs.mapInArrow(run, schema)
