"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations alone.

An item's windows are the sets to find; their tokens are short word shingles. Shingles are ordered by how rare they
are over all documents. As a window counts only if it is contained whole, one prefix token is necessary and enough
to find it: its rarest. Documents' shingles join those prefixes, bounds on position and length discard matches that
cannot hold the window, and the rest are compared word by word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_IDS, discard, row_key, settle, unused

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Item windows up to this number are broadcast (below 100 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000
#: Stands for "this document" among its shingles, so that documents without a match keep a row.
PRESENT = 0


def words(text: Column) -> Column:
    """Lower-cases A-Z only, then takes runs of digits, letters and all beyond ASCII; null has no words."""
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), 0), F.array().cast("array<string>"))


def _shingles(words: str, length: int) -> Column:
    w = F.col(words)
    at = lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(length)))
    return F.when(F.size(w) >= length, F.transform(F.sequence(F.lit(0), F.size(w) - length), at)).otherwise(F.array().cast("array<long>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows, owners): each distinct window once as (window_id, w_words, w_len), and (window_id, item_id)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_w") - window + 1, F.lit(1))),
        lambda i: F.slice(F.col("_w"), i, F.lit(window)),
    )
    all_windows = items.select("item_id", F.explode(cut).alias("w_words")).withColumn("window_id", F.sha2(F.array_join("w_words", " "), 256))
    all_windows = settle(all_windows.distinct())
    windows = all_windows.select("window_id", "w_words", F.size("w_words").alias("w_len")).dropDuplicates(["window_id"])
    return windows, all_windows.select("window_id", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words, n_hit (words inside any occurrence of a window),
    n_items, items_sha256, contaminated, and the key _th = xxhash64(text).

    Null or empty text, or text without words: zeros. Items without words are ignored. Repeated rows each get their
    row; rows that share a doc_id but not the text are judged apart; a null doc_id is an id like any other. Other
    columns of docs are ignored. An empty benchmark leaves every document clean.
    """
    windows, owners = item_windows(benchmark, window)
    small = windows.count() <= broadcast_windows
    plain = lambda df: df
    hint = F.broadcast if small else plain
    # an item can have as many windows as words, and a window many items: their pairs are counted on their own
    hint_owners = F.broadcast if small and owners.limit(broadcast_windows + 1).count() <= broadcast_windows else plain
    key = ["_id", "_th"]
    keyed = docs.select(*row_key(), "text")
    # counted below the generator, so that words aren't carried along with each of their shingles
    texts = keyed.select(*key, words(F.col("text")).alias("_words")).withColumn("n_words", F.size("_words"))

    # one look at all documents: where any token of a window stands, and a mark for each row
    lengths = sorted(r[0] for r in windows.select(F.least("w_len", F.lit(shingle))).distinct().collect())  # at most `shingle` values
    tokens, seen = {}, None
    for length in lengths or [shingle]:
        first = seen is None
        tokens[length] = windows.where(F.least("w_len", F.lit(shingle)) == length).select("window_id", "w_len", F.posexplode(_shingles("w_words", length)).alias("off", "_h"))
        asked = tokens[length].select("_h").distinct()
        marks = _shingles("_words", length)
        if first:
            marks, asked = F.concat(marks, F.array(F.lit(PRESENT).cast("long"))), asked.union(asked.sparkSession.range(1).select(F.lit(PRESENT).cast("long").alias("_h")))
        own = texts.select(*key, "n_words", F.posexplode(marks).alias("_p", "_h")).join(hint(asked), "_h")
        own = own.select(*key, "n_words", F.lit(length).alias("_length"), "_p", "_h")
        seen = own if first else seen.unionByName(own)
    seen = settle(seen)

    # each window's rarest token; a window with a token that no document has cannot occur
    rows, prefixes = seen.where(F.col("_h") != PRESENT), None
    often = rows.groupBy("_length", "_h").agg(F.count("*").alias("_n"))
    for length, own in tokens.items():
        rare = (
            own.join(often.where(F.col("_length") == length), "_h")
            .groupBy("window_id").agg(F.count("*").alias("_of"), F.min(F.struct("_n", "_h", "off")).alias("_r"))
        )
        own = windows.join(rare, "window_id").where(F.col("_of") == F.col("w_len") - length + 1)
        own = own.select("window_id", "w_words", "w_len", F.col("_r._h").alias("_h"), F.col("_r.off").alias("off"), F.lit(length).alias("_length"))
        prefixes = own if prefixes is None else prefixes.unionByName(own)
    prefixes = settle(prefixes)

    # bounds on position and length, then word by word in the documents that are left
    near = rows.join(hint(prefixes.drop("w_words")), ["_length", "_h"]).where("_p >= off AND _p - off + w_len <= n_words")
    near = settle(near.select(*key, "window_id", "w_len", (F.col("_p") - F.col("off")).alias("_from")).distinct())
    where = settle(near.select(*key).distinct().withColumnsRenamed({"_id": "_id2", "_th": "_th2"}))
    few = F.broadcast if where.count() <= BROADCAST_IDS else plain
    held = keyed.join(few(where), F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2"))).dropDuplicates(key)
    held = held.select("_id2", "_th2", words(F.col("text")).alias("_words"))
    hits = near.join(held, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2"))).join(hint(prefixes.select("window_id", "w_words")), "window_id")
    hits = hits.where(F.slice("_words", F.col("_from") + 1, F.col("w_len")) == F.col("w_words")).select(*key, "window_id", "_from", "w_len")
    marked = seen.where(F.col("_h") == PRESENT).select(*key, "n_words", F.lit(None).cast("string").alias("window_id"), F.lit(0).alias("_from"), F.lit(0).alias("w_len"))

    found = settle(marked.unionByName(hits, allowMissingColumns=True))
    discard(seen, prefixes, near, where)
    # repeated rows are counted by their marks; spans are distinct, at most one for each word and window length
    per_doc = found.groupBy(*key).agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("window_id").isNull()).alias("_copies"),
        F.array_sort(F.collect_set(F.when(F.col("window_id").isNotNull(), F.struct("_from", "w_len")))).alias("_spans"),
    )
    covered = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["_from"] + s["w_len"] - F.greatest(s["_from"], a["to"]))).alias("n"),
            F.greatest(a["to"], s["_from"] + s["w_len"]).alias("to"),
        ),
    )
    items = (
        found.where("window_id IS NOT NULL").select(*key, "window_id").distinct()
        .join(hint_owners(owners), "window_id").select(*key, F.col("item_id").cast("string").alias("_item")).distinct()
        .groupBy(*key).agg(F.array_sort(F.collect_list("_item")).alias("_items"))
        .withColumnsRenamed({"_id": "_id2", "_th": "_th2"})
    )
    out = per_doc.join(items, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")), "left")
    names = F.coalesce("_items", F.array().cast("array<string>"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(
        F.col("_id").alias("doc_id"), "n_words", covered["n"].cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"), "_th",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark window; all columns stay as they are."""
    i, th, key = unused(docs, "id", "th", "key")
    bad = decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(i), F.col("_th").alias(th)).distinct()
    d = docs.withColumn(key, F.xxhash64("text"))
    return d.join(bad, d["doc_id"].eqNullSafe(bad[i]) & (d[key] == bad[th]), "left_anti").drop(key)
