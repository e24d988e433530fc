"""Two tokenizers' tokens of the same text, aligned by their bytes, and how often each pair of tokens meets."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import settle
from .textops import release

# Fixed value: the public pattern by which byte-level BPE cuts a text.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of text that are aligned at a time; a longer text is aligned alone.
STEP = 1 << 18
#: Links that are written out at a time, and pairs whose counts a task holds.
LINKS, HELD = 1 << 20, 1 << 21
#: Pairs, the most frequent ones, whose counts go to every task: 17 bytes each. The others are joined by a shuffle.
FREQUENT = 1 << 20


def byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others
    for 256 and so on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Side:
    """A tokenizer: encode takes a text, pieces[id] are the bytes of a token."""

    encode: object
    pieces: list[bytes]

    def __post_init__(self):
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)


def byte_bpe(content: str) -> Side:
    """A byte-level BPE of a tokenizers file, without special tokens. Where the ids follow the merges' order, as in
    public vocabularies, the merges are done by the faster of two libraries with the same result."""
    spec = json.loads(content)
    vocabulary, back = spec["model"]["vocab"], byte_level()
    special = {t["content"] for t in spec["added_tokens"]}
    pieces = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]))
    for token, i in vocabulary.items():
        if token not in special:
            pieces[i] = bytes(back[c] for c in token)
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
    first = {i for t, i in vocabulary.items() if len(t) == 1}
    ranked = [vocabulary[m] for m in merged] == list(range(256, 256 + len(merged))) and first == set(range(256))
    cut = spec["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec["normalizer"]
    if ranked and plain and not spec["model"].get("ignore_merges"):
        import tiktoken

        ranks = {p: i for i, p in enumerate(pieces) if p}
        return Side(tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, pieces)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.encode_special_tokens = True
    return Side(lambda text: tokenizer.encode(text, add_special_tokens=False).ids, pieces)


def sentencepiece(content: bytes) -> Side:
    """A SentencePiece model; its control pieces hold no bytes, the mark for a space is one."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=content)
    pieces = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            pieces.append(bytes([int(piece[1:-1], 16)]))
        else:
            pieces.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    return Side(model.encode, pieces)


def _tokens(text: str | None, a: Side, b: Side) -> tuple[list[int], list[int]]:
    """Both sides' ids; none where the tokens' bytes aren't the text's."""
    if not text:
        return [], []
    spaced = " " + text
    ids_a, ids_b, want = a.encode(spaced), b.encode(text), spaced.encode()
    same = b"".join(map(a.pieces.__getitem__, ids_a)) == want and b"".join(map(b.pieces.__getitem__, ids_b)) == want
    return (ids_a, ids_b) if same else ([], [])


@dataclass
class Aligned:
    """Tokens of several texts, in order: ids, text, place of the first byte and behind the last, and group. Places and
    groups are counted on from text to text."""

    a: pd.DataFrame
    b: pd.DataFrame
    overlaps: np.ndarray
    cuts: np.ndarray


def _frame(ids: list[list[int]], sizes: np.ndarray) -> pd.DataFrame:
    flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
    end = np.cumsum(sizes[flat])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), [len(own) for own in ids]), "at": end - sizes[flat], "end": end, "id": flat, "token": np.arange(len(flat))})


def _once(ordered: np.ndarray) -> np.ndarray:
    """Without repeats."""
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered


def aligned(ids_a: list[list[int]], ids_b: list[list[int]], a: Side, b: Side) -> Aligned:
    """Every token's start finds the other side's token that covers it; both directions together are all overlaps.
    Where two overlapping tokens end together a group ends."""
    x, y = _frame(ids_a, a.sizes), _frame(ids_b, b.sizes)
    own, other = x[["doc", "at", "token"]], y[["doc", "at", "token"]]
    ab = pd.merge_asof(own, other, on="at", by="doc", suffixes=("_a", "_b"))
    ba = pd.merge_asof(other, own, on="at", by="doc", suffixes=("_b", "_a"))
    n = max(1, len(y))
    overlaps = np.concatenate([m["token_a"].to_numpy(np.int64) * n + m["token_b"].to_numpy(np.int64) for m in (ab, ba)])
    overlaps.sort(kind="stable")  # two runs that are in order
    overlaps = _once(overlaps)
    ends = x["end"].to_numpy()[overlaps // n]
    cuts = _once(ends[ends == y["end"].to_numpy()[overlaps % n]])
    for side in (x, y):
        side["group"] = np.searchsorted(cuts, side["at"].to_numpy(), "right")
    return Aligned(x, y, np.stack([overlaps // n, overlaps % n], 1), cuts)


def _reduced(side: pd.DataFrame) -> pd.DataFrame:
    """One row for each group and id, with its number."""
    return side.groupby(["doc", "group", "id"], sort=True).size().rename("n").reset_index()


def _products(x: pd.DataFrame, y: pd.DataFrame, n_x: np.ndarray, n_y: np.ndarray):
    """All pairs of rows in one group: (doc, pair, number). Rows are ordered by group."""
    g_y = y["group"].to_numpy()
    first, last = np.searchsorted(g_y, x["group"], "left"), np.searchsorted(g_y, x["group"], "right")
    times = last - first
    i = np.repeat(np.arange(len(x)), times)
    j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    return x["doc"].to_numpy()[i], x["id"].to_numpy()[i] << 32 | y["id"].to_numpy()[j], n_x[i] * n_y[j]


def _distinct(doc: np.ndarray, pair: np.ndarray, n: np.ndarray):
    order = np.lexsort((pair, doc))
    doc, pair, n = doc[order], pair[order], n[order]
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[at], pair[at], np.add.reduceat(n, at) if len(at) else n


def links(found: Aligned):
    """Yields (doc, pair, number of links), each pair of each text once, about LINKS links or pairs at a time. A group
    of many tokens is counted by distinct ids before its pairs are formed, id by id of the first side."""
    x, y = found.a, found.b
    size_y = np.bincount(y["group"], minlength=len(found.cuts) + 1)
    if size_y[x["group"]].sum() <= LINKS:
        yield _distinct(*_products(x, y, np.ones(len(x), np.int64), np.ones(len(y), np.int64)))
        return
    x, y = _reduced(x), _reduced(y)
    x["pairs"] = np.bincount(y["group"], minlength=len(found.cuts) + 1)[x["group"]]
    x = x.sort_values(["doc", "id", "group"], kind="stable")
    # a text's id stays in one piece, so that no pair comes twice
    pieces = x.groupby(["doc", "id"], sort=False)["pairs"].transform("sum").where(~x.duplicated(["doc", "id"]), 0).cumsum() // LINKS
    for _, own in x.groupby(pieces.to_numpy(), sort=True):
        own = own.sort_values("group", kind="stable")
        yield _distinct(*_products(own, y, own["n"].to_numpy(), y["n"].to_numpy()))


def _texts(found: Aligned, names: list[np.ndarray], docs: int) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each text. names: a's ids before a comma and a bar, b's before a comma and a semicolon."""
    said, key, doc = [], [], []
    for k, side in enumerate((found.a, found.b)):
        group = side["group"].to_numpy()
        last = np.r_[group[1:] != group[:-1], True] if len(group) else np.zeros(0, bool)
        said.append(np.where(last, names[2 * k + 1][side["id"]], names[2 * k][side["id"]]))
        key.append(group * 2 + k)
        doc.append(side["doc"].to_numpy())
    order = np.argsort(np.concatenate(key), kind="stable")
    said, doc = np.concatenate(said)[order], np.concatenate(doc)[order]
    at = np.searchsorted(doc, np.arange(docs + 1))
    return ["".join(said[s:e].tolist())[:-1] for s, e in zip(at[:-1], at[1:], strict=True)]


def _lists(values: np.ndarray, at: np.ndarray, kind=None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind or pa.int64()))


DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
SPANS = "a_ids array<int>, a_ends array<long>, b_ids array<int>, b_ends array<long>, group_ends array<long>, overlaps array<struct<a:int,b:int>>"


def _slices(texts: list[str | None]):
    at = size = 0
    for i, text in enumerate(texts):
        more = len(text or "")
        if i > at and size + more > STEP:
            yield at, texts[at:i]
            at, size = i, 0
        size += more
    if at < len(texts):
        yield at, texts[at:]


def _worker(load_a: bytes, load_b: bytes, emit):
    """A mapInArrow function over (keys..., text) that hands each slice's alignment to emit."""

    def run(batches):
        a, b = byte_bpe(load_a.decode()), sentencepiece(load_b)
        for batch in batches:
            keys, texts = batch.columns[:-1], batch.columns[-1].to_pylist()
            for at, own in _slices(texts):
                pairs = [_tokens(t, a, b) for t in own]
                found = aligned([p[0] for p in pairs], [p[1] for p in pairs], a, b)
                yield from emit([k.slice(at, len(own)) for k in keys], found, len(own), a, b)
            release()

    return run


def _counts(found: Aligned, docs: int):
    """(tokens of a, of b, groups, links) of each text."""
    n_a, n_b = (np.bincount(s["doc"], minlength=docs) for s in (found.a, found.b))
    groups = len(found.cuts) + 1
    doc_of = np.zeros(groups, np.int64)
    doc_of[found.a["group"]] = found.a["doc"]
    size = [np.bincount(s["group"], minlength=groups) for s in (found.a, found.b)]
    n_links = np.zeros(docs, np.int64)
    np.add.at(n_links, doc_of, size[0] * size[1])
    return n_a, n_b, np.bincount(doc_of[size[0] > 0], minlength=docs), n_links


def _files(spark: SparkSession, *paths: str) -> list[bytes]:
    """Two vocabulary files' bytes, a few MB in all, read on the driver and sent along with the tasks."""
    out = []
    for path in paths:
        with open(path, "rb") as f:
            out.append(f.read())
    return out


def align(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's tokens and how they lie: ids and ends of both sides (bytes of space + text), ends of the groups, and
    the numbers of tokens that overlap. A row for each row of docs: (id, a_ids, a_ends, b_ids, b_ends, group_ends,
    overlaps); empty lists for a null or empty text and where the tokens' bytes aren't the text's."""
    kind = dict(docs.dtypes)[id_col]

    def emit(keys, found, n, a, b):
        columns = []
        base = np.zeros(n + 1, np.int64)  # where each text begins
        base[1:] = np.cumsum(np.bincount(found.a["doc"], weights=found.a["end"] - found.a["at"], minlength=n).astype(np.int64))
        starts = {}
        for name, side in (("a", found.a), ("b", found.b)):
            starts[name] = np.searchsorted(side["doc"], np.arange(n + 1))
            columns += [_lists(side["id"].to_numpy(), starts[name], pa.int32()), _lists(side["end"].to_numpy() - base[side["doc"]], starts[name])]
        doc = np.searchsorted(base[1:], found.cuts, "left")
        columns.append(_lists(found.cuts - base[doc], np.searchsorted(doc, np.arange(n + 1))))
        doc = found.a["doc"].to_numpy()[found.overlaps[:, 0]]
        both = [pa.array(found.overlaps[:, k] - starts[name][doc], pa.int32()) for k, name in enumerate("ab")]
        pairs = pa.StructArray.from_arrays(both, names=["a", "b"])
        columns.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pairs))
        names = ["_id", "a_ids", "a_ends", "b_ids", "b_ends", "group_ends", "overlaps"]
        yield pa.RecordBatch.from_arrays([keys[0], *columns], names=names)

    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    out = rows.mapInArrow(_worker(*_files(docs.sparkSession, file_a, file_b), emit), f"_id {kind}, {SPANS}")
    return out.withColumnRenamed("_id", id_col)


def linked(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, _id, DIGEST, pairs, times): a row with the digest for each row of docs, its pairs in one or, of many,
    several rows of which only the first has the digest. A pair is a's id << 32 | b's id; each comes once in a row of
    docs, times being its links. _row tells rows of docs apart."""
    kind = dict(docs.dtypes)[id_col]

    def emit(keys, found, n, a, b):
        if not hasattr(a, "names"):
            text = [[str(i) for i in range(len(s.pieces))] for s in (a, b)]
            a.names = [np.array([t + end for t in text[k]], object) for k, ends in enumerate((",|", ",;")) for end in ends]
        said = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in _texts(found, a.names, n)]
        digest = [pa.array(c, pa.int64()) for c in _counts(found, n)]
        for k, (doc, pair, times) in enumerate(links(found)):
            at = np.searchsorted(doc, np.arange(n + 1))
            own = [_lists(pair, at), _lists(times, at)]
            if not k:
                yield pa.RecordBatch.from_arrays([*keys, *digest, pa.array(said), *own], names=NAMES)
            else:
                only = pa.array(at[1:] > at[:-1])
                nulls = [pa.nulls(n, c.type) for c in digest] + [pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays([*keys, *nulls, *own], names=NAMES).filter(only)

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return rows.mapInArrow(_worker(*_files(docs.sparkSession, file_a, file_b), emit), f"_row long, _id {kind}, {DIGEST}, pairs array<long>, times array<long>")


NAMES = ["_row", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def _counted(batches):
    """How many rows hold each pair: added up in the task, handed on beyond HELD pairs."""
    pair, n, fresh = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add():
        nonlocal pair, n, fresh
        new, times = np.unique(np.concatenate(fresh), return_counts=True)
        fresh = []
        both = np.concatenate([pair, new])
        pair, where = np.unique(both, return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([n, times]), minlength=len(pair)).astype(np.int64)

    for batch in batches:
        values = batch.column(0).flatten().to_numpy()
        fresh.append(values)
        if sum(map(len, fresh)) >= HELD:
            add()
        if len(pair) >= HELD:
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
            pair, n = pair[:0], n[:0]
    if fresh:
        add()
    if len(pair):
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): how many documents of linked() hold each pair."""
    return found.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignment_scores(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row for each row of docs: (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    Null and empty texts, and those that either side's tokens don't give back byte by byte, have zeros and an empty
    digest. Repeated rows count each; an empty table gives no rows; other columns play no part.

    Tokens are aligned once and each text's distinct pairs written down. The counts of the `frequent` most frequent
    pairs go to the tasks as sorted arrays, which settles nearly all links; what is left meets the other counts in a
    join whose keys are rare by construction.
    """
    spark = docs.sparkSession
    found = settle(linked(docs, file_a, file_b, id_col, text_col))
    counts = settle(pair_counts(found))
    # one row for each id of a's vocabulary
    tops = counts.groupBy(F.shiftrightunsigned("pair", 32).alias("_a")).agg(F.max("n").alias("_top"))
    pairs = counts.join(F.broadcast(tops), F.shiftrightunsigned("pair", 32) == F.col("_a")).select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))
    # the least count of a frequent pair: levels of an eighth of an octave, some hundreds at most
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r.level, r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    least = total = 0
    for at, size in sizes:
        if total + size > frequent:
            break
        least, total = at, total + size
    whole = total == sum(size for _, size in sizes)
    top = pairs.where(level >= least).toArrow() if total else None
    order = np.argsort(top["pair"].to_numpy(), kind="stable") if total else None
    known = spark.sparkContext.broadcast(tuple(top[c].to_numpy()[order] for c in ("pair", "n", "best")) if total else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),))
    del top, order

    def looked_up(batch):
        key, n, best = known.value
        pair, times = (batch.column(c).flatten().to_numpy() for c in ("pairs", "times"))
        where = np.minimum(np.searchsorted(key, pair), max(0, len(key) - 1))
        hit = key[where] == pair if len(key) else np.zeros(len(pair), bool)
        return pair, times, where, hit, np.r_[0, np.cumsum(batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False))]

    def sums(batches):
        _, n, best = known.value
        for batch in batches:
            pair, times, where, hit, at = looked_up(batch)
            value = [np.where(hit, times * c[where], 0) if len(n) else np.zeros(len(pair), np.int64) for c in (n, best)]
            total = [np.diff(np.r_[0, np.cumsum(v)][at]) for v in value]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(total[0], pa.int64()), pa.array(total[1], pa.int64())], names=[*NAMES[:-2], "count_sum", "n_best"])

    def misses(batches):
        for batch in batches:
            pair, times, _, hit, at = looked_up(batch)
            row = np.repeat(batch.column("_row").to_numpy(), np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(row[~hit]), pa.array(pair[~hit]), pa.array(times[~hit])], names=["_row", "pair", "_times"])

    kind = dict(docs.dtypes)[id_col]
    out = found.mapInArrow(sums, f"_row long, _id {kind}, {DIGEST}, count_sum long, n_best long")
    parts = [out]
    if not whole:
        rest = found.select("_row", "pairs", "times").mapInArrow(misses, "_row long, pair long, _times long")
        rest = rest.join(pairs.where(level < least) if total else pairs, "pair").groupBy("_row").agg(F.sum(F.col("_times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("n_best"))
        parts.append(rest)
    # a text's pairs may stand in several rows
    one = parts[0].unionByName(parts[1], allowMissingColumns=True) if len(parts) > 1 else parts[0]
    digest = [c.split()[0] for c in DIGEST.split(", ")]
    out = one.groupBy("_row").agg(F.any_value("_id", True).alias(id_col), *[F.max(c).alias(c) for c in digest], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select(id_col, *digest[:-1], "n_best", "count_sum", "groups_sha256")
