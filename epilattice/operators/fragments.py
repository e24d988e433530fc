"""Sequences into overlapping k-mer windows around a variable region."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.settled import settle

MODES = ("overlap", "contained")
#: Windows are cut from pieces of this many starts: substring() walks from the front, so a long text cut window by
#: window would cost its length squared.
PIECE = 64


def _check_region(region: tuple[int, int] | None, mode: str | None) -> None:
    if mode is None:
        return
    if mode not in MODES:
        raise ValueError(f"unknown window mode {mode!r}; one of {MODES} or None")
    if region is None or None in region:
        raise ValueError("a window mode needs the region's start and end")
    if region[0] > region[1]:
        raise ValueError("the region ends before it starts")


def drop_stops(library: DataFrame, region: tuple[int, int]) -> DataFrame:
    """Without the sequences that have a stop codon (*) inside the region."""
    start, end = region
    return library.where(~F.substring("aa_sequence", start, end - start + 1).contains("*"))


def count_stops(library: DataFrame, region: tuple[int, int]) -> DataFrame:
    """One row: n_sequences, n_with_stop, n_kept."""
    start, end = region
    stop = F.substring("aa_sequence", start, end - start + 1).contains("*")
    return library.agg(
        F.count("*").alias("n_sequences"), F.count_if(stop).alias("n_with_stop"), F.count_if(~stop).alias("n_kept")
    )


def fragment(library: DataFrame, kmers: Sequence[int], region: tuple[int, int] | None = None, mode: str | None = None) -> DataFrame:
    """library(variant_id, aa_sequence, metadata...) as windows: variant_id, metadata..., k, peptide, start, end.

    Coordinates are 1-based and inclusive. mode `overlap` keeps the windows that touch the region, `contained` those
    inside it, None all. Only windows that are kept are generated: the region bounds the generator, so no filter
    stands above it. A k that is listed twice counts twice. Sequences that are missing or shorter than k
    have no windows.
    """
    if not kmers or any(k <= 0 for k in kmers):
        raise ValueError("k must be positive")
    _check_region(region, mode)
    metadata = [c for c in library.columns if c not in ("variant_id", "aa_sequence")]
    rows = library.select("*", F.explode(F.array(*map(F.lit, kmers))).alias("k")) if len(kmers) > 1 else library.withColumn("k", F.lit(kmers[0]))
    last = F.length("aa_sequence") - F.col("k") + 1
    low = F.lit(1)
    if mode == "overlap":
        low, last = F.greatest(F.lit(region[0]) - F.col("k") + 1, low), F.least(last, F.lit(region[1]))
    elif mode == "contained":
        low, last = F.lit(max(region[0], 1)), F.least(last, F.lit(region[1]) - F.col("k") + 1)
    # sequence() counts down when its end lies below its start
    pieces = F.when(F.col("aa_sequence").isNotNull() & (last >= low), F.sequence(low, last, F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
    # cut inside the array: a projection below a generator would be moved above it and evaluated for every window
    texts = F.transform(pieces, lambda i: F.substring(F.col("aa_sequence"), i, F.col("k") + (PIECE - 1)))
    rows = rows.select("variant_id", *metadata, "k", low.alias("_low"), last.alias("_last"), F.posexplode(texts).alias("_i", "_text"))
    begin = F.col("_low") + F.col("_i") * PIECE
    rows = rows.select("variant_id", *metadata, "k", begin.alias("_from"), "_text", F.explode(F.sequence(begin, F.least(F.col("_last"), begin + (PIECE - 1)))).alias("start"))
    return rows.select(
        "variant_id", *metadata, F.col("k").cast("int").alias("k"), F.substring(F.col("_text"), F.col("start") - F.col("_from") + 1, F.col("k")).alias("peptide"),
        F.col("start").cast("int").alias("start"), (F.col("start") + F.col("k") - 1).cast("int").alias("end"),
    )


def unique_peptides(fragments: DataFrame) -> DataFrame:
    """Each (peptide, k) once with its occurrence_count; combined map-side before the shuffle."""
    return fragments.groupBy("peptide", "k").agg(F.count("*").alias("occurrence_count"))


#: Distinct windows that a task counts before it hands them on.
COUNTED = 1 << 20


def counted_peptides(library: DataFrame, kmers: Sequence[int], region: tuple[int, int] | None = None, mode: str | None = None) -> DataFrame:
    """unique_peptides(fragment(library, kmers, region, mode)), for long texts: windows are counted in the task that reads
    them, so that no row is made for each, and only distinct ones are shuffled, once a task."""
    if not kmers or any(k <= 0 for k in kmers):
        raise ValueError("k must be positive")
    _check_region(region, mode)

    def bounds(n: int, k: int) -> tuple[int, int]:
        """First and last start, from 1."""
        if mode == "overlap":
            return max(region[0] - k + 1, 1), min(n - k + 1, region[1])
        if mode == "contained":
            return max(region[0], 1), min(n - k + 1, region[1] - k + 1)
        return 1, n - k + 1

    def run(batches):
        counts: dict[int, Counter] = {k: Counter() for k in set(kmers)}

        def out():
            for k, own in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.string()), pa.array([k] * len(own), pa.int32()), pa.array(own.values(), pa.int64())], names=["peptide", "k", "n"])
                own.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for k in kmers:
                    first, last = bounds(len(text or ""), k)
                    for at in range(first - 1, last, COUNTED):
                        counts[k].update(text[i : i + k] for i in range(at, min(last, at + COUNTED)))
                        if len(counts[k]) >= COUNTED:
                            yield from out()
        yield from out()

    return library.select("aa_sequence").mapInArrow(run, "peptide string, k int, n long").groupBy("peptide", "k").agg(F.sum("n").alias("occurrence_count"))


def numbered_peptides(fragments: DataFrame, order: Sequence[str], kmers: Sequence[int]) -> DataFrame:
    """unique_peptides with ids pep_000001, ... by first appearance.

    order names columns that fix the order of the library's rows; within a row the ks go as listed and windows by
    start. Ranks are dealt by range: only the number of peptides of each range reaches the driver.

    The least of structs takes a sort of all windows. If one number orders the rows, its least at each start is found
    first, by hashing, and only those are compared as structs.
    """
    turn = F.array_position(F.array(*map(F.lit, kmers)), F.col("k"))
    windows = fragments.withColumn("_one", F.lit(1).cast("long"))
    if len(order) == 1 and isinstance(fragments.schema[order[0]].dataType, T.IntegralType):
        windows = windows.groupBy("peptide", "k", "start").agg(F.sum("_one").alias("_one"), F.count_if(F.col(order[0]).isNull()).alias("_null"), F.min(order[0]).alias(order[0]))
        # null comes first
        windows = windows.withColumn(order[0], F.when(F.col("_null") == 0, F.col(order[0])))
    seen = windows.groupBy("peptide", "k").agg(F.sum("_one").alias("occurrence_count"), F.min(F.struct(*order, turn.alias("_k"), "start")).alias("_at"))
    spark = fragments.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # range partitions are settled before they are counted, so both readings see the same ones
    dealt = settle(seen.repartitionByRange(parts, "_at").withColumn("_part", F.spark_partition_id()))
    counts = sorted((r._part, r["count"]) for r in dealt.groupBy("_part").count().collect())
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    offsets = spark.createDataFrame(offsets, "_part int, _before long")
    place = F.row_number().over(W.partitionBy("_part").orderBy("_at"))
    numbered = dealt.join(F.broadcast(offsets), "_part").withColumn("_n", F.col("_before") + place)
    return numbered.select(F.format_string("pep_%06d", "_n").alias("peptide_id"), "peptide", "k", "occurrence_count")


def peptide_map(fragments: DataFrame, peptides: DataFrame) -> DataFrame:
    """Every occurrence with its peptide_id: peptide_id, variant_id, start, end, metadata..."""
    metadata = [c for c in fragments.columns if c not in ("variant_id", "k", "peptide", "start", "end")]
    # windows are reckoned as small as their sequences, and would be collected for a broadcast
    joined = fragments.hint("merge").join(peptides.select("peptide_id", "peptide", "k"), ["peptide", "k"])
    return joined.select("peptide_id", "variant_id", "start", "end", *metadata)
