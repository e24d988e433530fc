"""Quality classifier: importance resampling towards labelled good text.

Two generative models over hashed word n-grams, one of the target (labelled good) and one of all raw text, give each
document a log importance weight; a Gumbel draw for each document turns the weights into a sample without
replacement: the k largest sums of weight and draw.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle
from .textops import merged_sketch, mix, sketch_rows, steps, windows, words

#: Hash buckets of the unigrams and bigrams, together.
BUCKETS = 16
#: Labelled rows that the target model is fitted on, at most; their ids are broadcast.
TARGET_ROWS = 20_000
SEED = 17
#: Equal rows that one array of draws counts.
COPIES = 4096
BINS = 1024


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams, and the text of each."""
    _, _, h, first = words(data, offs, lower=True)
    at, pair = windows(h, first, 2)
    code = np.concatenate([h, mix(pair + np.uint64(1))])
    text = np.concatenate([np.repeat(np.arange(len(offs) - 1), np.diff(first)), np.searchsorted(first, at, "right") - 1])
    return (code >> np.uint64(64 - BUCKETS)).astype(np.int64), text


def count(batches):
    counts = np.zeros((2, 1 << BUCKETS), np.uint64)
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False)
        for row, data, offs in steps(batch.column("text")):
            code, text = features(data, offs)
            counts[0] += np.bincount(code, minlength=1 << BUCKETS).astype(np.uint64)
            counts[1] += np.bincount(code[good[row + text]], minlength=1 << BUCKETS).astype(np.uint64)
    yield from sketch_rows(counts)


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a settled table's column, by histograms: the driver sees BINS rows a round."""
    lo, hi, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while lo < hi:
        width = (hi - lo) / BINS
        bin_of = F.least(F.floor((F.col(column) - lo) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        rows = (
            values.where(F.col(column).between(lo, hi)).groupBy(bin_of.alias("b"))
            .agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()
        )
        for r in rows:
            if k <= r.n:
                break
            k -= r.n
        if len(rows) == 1 and (r.lo, r.hi) == (lo, hi):
            # neighbouring doubles: the larger one if it is frequent enough
            return hi if values.where(F.col(column) == hi).count() >= k else lo
        lo, hi = r.lo, r.hi
    return hi


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, seed: int = SEED, target_rows: int = TARGET_ROWS,
             per_ngrams: float | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, log_weight, gumbel_score, selected.

    log_weight is the log of the ratio of the two models' likelihoods of the text: the sum over all its n-grams, or,
    with per_ngrams, as if every text had that many, so that long ones weigh no more than short ones. gumbel_score adds
    the row's draw.

    The target model is fitted on at most target_rows documents labelled quality = 1, chosen by the hash of their id;
    the raw model on all documents. A doc_id with several labels is good if one of them is 1; labels without id or
    quality are ignored. `fraction` of the rows is selected; None takes the share of good ones among the labelled ids.
    Draws depend on seed, doc_id, text and, of rows that agree in those, their number, so each row has its own. Null,
    empty and wordless texts have no evidence of quality: their weight is null and they are never selected. Rows that
    tie with the last one selected are selected too. Without a good label all weights are 0.
    """
    spark = docs.sparkSession
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    target = settle(labels.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows))
    if fraction is None:
        fraction = labels.agg(F.avg(F.col("good").cast("int"))).first()[0] or 0.0
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    marked = docs.join(F.broadcast(target), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = merged_sketch(marked.mapInArrow(count, "block int, cells binary"), 2, BUCKETS, 2**63 - 1).astype(float)
    log_rate = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + (1 << BUCKETS)))
    ratio = log_rate[1] - log_rate[0] if counts[1].any() else np.zeros(1 << BUCKETS)
    model = spark.sparkContext.broadcast(ratio)

    def weigh(batches):
        for batch in batches:
            for row, data, offs in steps(batch.column("text")):
                n = len(offs) - 1
                code, text = features(data, offs)
                total = np.bincount(text, minlength=n)
                weight = np.bincount(text, weights=model.value[code], minlength=n)
                if per_ngrams is not None:
                    weight *= per_ngrams / np.maximum(total, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(row, n) for c in ("doc_id", "_th")), pa.array(weight, mask=total == 0)],
                    names=["doc_id", "_th", "log_weight"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.mapInArrow(weigh, f"doc_id {id_type}, _th long, log_weight double").groupBy("doc_id", "_th", "log_weight").agg(F.count("*").alias("n"))
    # a number for each of the rows that agree; in two steps, so that no array grows with them
    scored = scored.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    scored = scored.withColumn("_copy", F.explode(F.sequence("_from", F.least(F.col("n") - 1, F.col("_from") + (COPIES - 1)))))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "_th", "_copy"), 11) + 0.5) / float(1 << 53)
    scored = settle(scored.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(uniform))).alias("gumbel_score")))
    n = scored.count()
    last = kth_largest(scored, "gumbel_score", round(fraction * n))
    chosen = F.lit(False) if last is None else F.coalesce(F.col("gumbel_score") >= last, F.lit(False))
    return scored.select("doc_id", "log_weight", "gumbel_score", chosen.alias("selected"))
