"""Links between similar sets: blocks around shared keys, and signature trees inside each block."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import components, discard, settle
from .textops import STEP, steps

#: Two sets link when 100 * intersection >= LIKE * union.
LIKE = 80
#: Sets that one task compares at once; larger blocks are cut into chunks and all of their pairs still considered.
CHUNK = 1024
LEAF = 8
#: A signature has about eight bits for each token, within these bounds: the bitmap of a leaf of unlike sets is not full yet.
TOKEN_BITS, LEAST_BITS, MOST_BITS = 8, 256, 1 << 18
#: Those that are dealt to blocks have about two: a set goes to many blocks, and pairs of unlike sets still fall far short.
DEALT_BITS = 2
#: Pairs of bitmaps that are held against each other in one step, in words.
WORDS = 1 << 20
#: A key that this share of the sampled sets has is dealt to so many tasks.
HOT, DEALS = 1 / 2000, 64


def signature(n: np.ndarray, code: np.ndarray, at: np.ndarray, bits: int = TOKEN_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps of the sets code[at[i]:at[i + 1]], sorted and of n tokens each, of about `bits` a token: (all words, where
    each begins, smallest token of each)."""
    width = np.clip(1 << np.ceil(np.log2(np.maximum(bits * n, 2))).astype(np.int64), LEAST_BITS, MOST_BITS)
    base = np.concatenate([[0], np.cumsum(width // 64)])
    flat = np.zeros(base[-1], np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    bit = (code & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_or.at(flat, base[owner] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    low = np.zeros(len(n), np.int64)
    low[n > 0] = code.view(np.int64)[at[:-1][n > 0]]
    return flat, base, low


class Sets:
    """Sizes, bitmaps and smallest tokens of many sets."""

    def __init__(self, size: np.ndarray, flat: np.ndarray, base: np.ndarray, low: np.ndarray):
        self.size, self.flat, self.base, self.low = size, flat, base, low
        self.width = np.diff(base)

    @staticmethod
    def of(code: np.ndarray, at: np.ndarray) -> Sets:
        n = np.diff(at)
        return Sets(n, *signature(n, code, at))

    def bitmaps(self, which: np.ndarray, words: int) -> np.ndarray:
        """One row each of sets that have `words` words or, folded, twice as many."""
        m = self.flat[self.base[which][:, None] + np.arange(self.width[which[0]])]
        return m if m.shape[1] == words else m[:, :words] | m[:, words:]

    def possible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs neither their sizes nor their bitmaps rule out.

        Sizes that allow a link have widths that differ by a factor of two at most; the wider bitmap is folded. Two
        sets share at most their common bits and as many tokens as share a bit with another one on the poorer side.
        """
        ok = 100 * np.minimum(self.size[x], self.size[y]) >= LIKE * np.maximum(self.size[x], self.size[y])
        at = np.flatnonzero(ok)
        kind = self.width[x[at]] * (1 << 20) + self.width[y[at]]
        for k in np.unique(kind):
            own = at[kind == k]
            words = int(min(k >> 20, k & ((1 << 20) - 1)))
            for part in np.array_split(own, max(1, len(own) * words // WORDS)):
                if len(part):
                    a, b = self.bitmaps(x[part], words), self.bitmaps(y[part], words)
                    na, nb = self.size[x[part]], self.size[y[part]]
                    spare = np.minimum(na - np.bitwise_count(a).sum(axis=1), nb - np.bitwise_count(b).sum(axis=1))
                    most = np.bitwise_count(a & b).sum(axis=1, dtype=np.int64) + spare
                    ok[part] = (100 + LIKE) * most >= LIKE * (na + nb)
        return ok


class Tree:
    """A signature tree: leaves hold LEAF sets side by side, each node the OR of its sets' bitmaps and their size range.

    The smallest token of a set is a min-hash: ordered by it, similar sets come to lie together.
    """

    def __init__(self, members: np.ndarray, sets: Sets, words: int):
        order = np.lexsort((sets.size[members], sets.low[members]))
        self.members = members[order]
        bits, size = sets.bitmaps(self.members, words), sets.size[self.members]
        spare = size - np.bitwise_count(bits).sum(axis=1)  # tokens that share a bit with another one
        self.levels = [(bits, size, size, spare)]
        while len(self.levels) == 1 or len(self.levels[-1][1]) > 1:
            self._lift()

    def _lift(self) -> None:
        bits, low, high, spare = self.levels[-1]
        cut = np.arange(0, len(low), LEAF)
        self.levels.append((np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(spare, cut)))

    def raise_to(self, levels: int) -> None:
        while len(self.levels) < levels:
            self._lift()

    def below(self, level: int, node: int) -> slice:
        return slice(node * LEAF, min(node * LEAF + LEAF, len(self.levels[level - 1][1])))


def traverse(a: Tree, b: Tree, done, visit) -> int:
    """Dual traversal: visit(x, y) for the members that no bound rules out; done(rows of a, rows of b) prunes leaves.
    Returns how many pairs of sets it looked at, those that it visited or that a leaf's bounds ruled out."""
    top = max(len(a.levels), len(b.levels))
    a.raise_to(top), b.raise_to(top)
    todo, seen = [(top - 1, 0, 0)], 0
    while todo:
        level, i, j = todo.pop()
        p, q = a.below(level, i), b.below(level, j)
        if level == 1 and done(a.members[p], b.members[q]):
            continue
        # all pairs of children at once: sizes compatible, and overlap not bounded below what the similarity needs
        (bits_a, low_a, high_a, spare_a), (bits_b, low_b, high_b, spare_b) = ([x[k] for x in t.levels[level - 1]] for t, k in ((a, p), (b, q)))
        ok = (100 * high_a[:, None] >= LIKE * low_b[None, :]) & (100 * high_b[None, :] >= LIKE * low_a[:, None])
        most = np.bitwise_count(bits_a[:, None, :] & bits_b[None, :, :]).sum(axis=2, dtype=np.int64) + np.minimum(spare_a[:, None], spare_b[None, :])
        ok &= (100 + LIKE) * most >= LIKE * (low_a[:, None] + low_b[None, :])
        x, y = np.nonzero(ok)
        x, y = x + p.start, y + q.start
        if a is b:
            keep = x < y if level == 1 else x <= y
            x, y = x[keep], y[keep]
        if level > 1:
            # pairs near the diagonal come first: they settle what most others hold
            near = np.argsort(-np.abs(x - y), kind="stable")
            todo.extend((level - 1, int(m), int(n)) for m, n in zip(x[near], y[near], strict=True))
        else:
            seen += ok.size
            for m, n in zip(x.tolist(), y.tolist(), strict=True):
                visit(a.members[m], b.members[n])
    return seen


def trees(sets: Sets, left: np.ndarray, right: np.ndarray | None = None):
    """Pairs of trees, one for each width of bitmaps, that cover all pairs whose sizes allow a link."""
    one = right is None
    right = left if one else right
    wide, other = sets.width[left], sets.width[right]
    for w in np.unique(np.concatenate([wide, other])).tolist():
        here, there = left[wide == w], right[other == w]
        if len(here) and len(there):
            t = Tree(here, sets, w)
            yield t, (t if one else Tree(there, sets, w))
        for x, y, swap in ((here, right[other == 2 * w], False), *([] if one else [(there, left[wide == 2 * w], True)])):
            if len(x) and len(y):
                p, q = Tree(x, sets, w), Tree(y, sets, w)
                yield (q, p) if swap else (p, q)


def leaf_pairs(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside each group that fits a single leaf: what the traversal of such a tree comes down to."""
    starts, n = cuts[:-1], np.diff(cuts)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for s in range(2, LEAF + 1):
        own = starts[n == s][:, None]
        if len(own):
            i, j = np.triu_indices(s, 1)
            found.append(((own + i).reshape(-1), (own + j).reshape(-1)))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def promising(sets: Sets, cuts: np.ndarray) -> np.ndarray:
    """Which sets have a partner in their group that their signatures do not rule out."""
    found = np.zeros(len(sets.size), bool)
    x, y = leaf_pairs(cuts)
    ok = sets.possible(x, y)
    found[x[ok]] = found[y[ok]] = True

    def visit(x, y):
        found[x] = found[y] = True

    for s, e in pairwise(cuts.tolist()):
        if e - s > LEAF:
            for a, b in trees(sets, np.arange(s, e)):
                traverse(a, b, lambda p, q: found[p].all() and found[q].all(), visit)
    return found


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    merged = np.concatenate([a, b])
    merged.sort()
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 100 * both >= LIKE * (len(a) + len(b) - both)


def links(code: np.ndarray, at: np.ndarray, cuts: np.ndarray, side: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inside each group, links among side 0 and between side 0 and side 1 that, with the components already known,
    connect all that link. A pair that is connected already is not compared again. Returns, of each set, the first
    set of its component in its group, and which sets have found a link."""
    sets = Sets.of(code, at)
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    # sets of one known component in a group start connected
    order = np.lexsort((known, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (known[order][1:] != known[order][:-1])
    root = np.zeros(len(order), np.int64)
    root[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1] if len(order) else 0
    linked = np.zeros(len(order), bool)

    def compare(x: int, y: int, start: int, end: int) -> None:
        if root[x] != root[y] and similar(code[at[x] : at[x + 1]], code[at[y] : at[y + 1]]):
            linked[x] = linked[y] = True
            own = root[start:end]
            keep, gone = min(root[x], root[y]), max(root[x], root[y])
            own[own == gone] = keep

    x, y = leaf_pairs(cuts)
    may = (side[x] == 0) | (side[y] == 0)
    x, y = x[may], y[may]
    ok = sets.possible(x, y)
    for m, n in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
        compare(m, n, cuts[group[m]], cuts[group[m] + 1])

    for s, e in pairwise(cuts.tolist()):
        if e - s <= LEAF:
            continue

        def done(p, q):
            first = root[p[0]]
            return bool((root[p] == first).all() and (root[q] == first).all())

        left, right = (np.arange(s, e)[side[s:e] == k] for k in (0, 1))
        for others in (None, right):
            if len(left) and (others is None or len(others)):
                for a, b in trees(sets, left, others):
                    traverse(a, b, done, lambda m, n: compare(m, n, s, e))  # noqa: B023
    return root, linked


def parts_of(batch: pa.RecordBatch, cuts: np.ndarray, column: str):
    """A batch of whole groups in parts of about STEP bytes of the column, each of whole groups too."""
    size = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(column)).to_numpy())])[cuts]
    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(size, size[at] + STEP, "right")) - 1)
        yield batch.slice(cuts[at], cuts[to] - cuts[at]), cuts[at : to + 1] - cuts[at]
        at = to


def groups(batches, keys: list[str]):
    """Sorted Arrow batches as (batch of whole groups, where each group begins, and the end)."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        rest = batch.slice(cuts[-1])  # the last group may go on in the next batch
        if len(cuts) > 1:
            yield batch.slice(0, cuts[-1]), cuts
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def block_members(postings: DataFrame, sample: DataFrame) -> DataFrame:
    """(centre, id) for every id that shares a key with a smaller one, centre being the smallest id of the key.

    Keys are dealt once. A key that a large share of the sampled sets has (sample: postings of
    some sets; no more than keys-per-set / HOT keys can be that frequent, so their list is bounded) would make one task
    too long. Its sets are dealt to DEALS tasks, each of which names a centre of its own, and the smallest of these,
    a row for each such key, is joined by broadcast. Which keys are dealt so does not change the result.
    """
    n = sample.select("id").distinct().count()
    often = sample.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= max(16, HOT * n)).select("key", F.lit(True).alias("often"))
    often = settle(often)
    dealt = postings.join(F.broadcast(often), "key", "left")
    deal = F.when(F.col("often"), F.pmod(F.xxhash64("id"), F.lit(DEALS))).otherwise(-1).cast("int")
    # both the centres and their members are read from this one exchange
    dealt = dealt.select("key", deal.alias("deal"), "id").repartition("key", "deal")
    centres = dealt.groupBy("key", "deal").agg(F.min("id").alias("centre"), F.count("*").alias("_n")).where("_n > 1 OR deal >= 0").drop("_n")
    runs = dealt.join(centres.hint("shuffle_hash"), ["key", "deal"]).where("id <> centre OR deal >= 0")
    runs = settle(runs.select("centre", "id", F.when(F.col("deal") >= 0, F.col("key")).alias("crowded")).distinct())
    first = runs.where("crowded IS NOT NULL").groupBy("crowded").agg(F.min("centre").alias("first"))
    crowded = runs.where("crowded IS NOT NULL").join(F.broadcast(first), "crowded").select(F.col("first").alias("centre"), "id").where("id <> centre")
    out = settle(runs.where("crowded IS NULL").select("centre", "id").union(crowded).distinct())
    discard(often, runs)
    return out


def like_sized(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """members(centre, id, ...) without the sets whose size, by sizes(id, n), allows a link with no other one of their block.
    Sizes of a block stand in order, so if the next smaller and the next larger one rule a link out, all do."""
    at = W.partitionBy("centre").orderBy("n")
    sized = members.join(sizes, "id").withColumns({"_less": F.lag("n").over(at), "_more": F.lead("n").over(at)})
    return sized.where((100 * F.col("_less") >= LIKE * F.col("n")) | (100 * F.col("n") >= LIKE * F.col("_more"))).select(*members.columns)


def _signed(sets_of):
    def run(batches):
        for batch in batches:
            for row, data, offs in steps(batch.column("text")):
                code, at = sets_of(data, offs)
                n = np.diff(at)
                flat, base, low = signature(n, code, at, DEALT_BITS)
                bits = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(base * 8), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(row, len(n)), pa.array(n, pa.int64()), pa.array(low), bits.cast(pa.binary())], names=["id", "n", "low", "bits"]
                )

    return run


def _keep_promising(batches):
    for batch, cuts in (part for whole, all_cuts in groups(batches, ["centre", "part"]) for part in parts_of(whole, all_cuts, "bits")):
        bits = batch.column("bits").cast(pa.large_binary())
        _, offs, data = bits.buffers()
        offs = np.frombuffer(offs, np.int64)[bits.offset : bits.offset + len(bits) + 1] // 8
        flat = np.frombuffer(data, np.uint64, offs[-1])
        keep = promising(Sets(batch.column("n").to_numpy(), flat, offs, batch.column("low").to_numpy()), cuts)
        if keep.any():
            yield batch.select(["centre", "part", "id"]).filter(pa.array(keep))


def _link(keys: list[str], sets_of):
    def run(batches):
        for batch, cuts in (part for whole, all_cuts in groups(batches, keys) for part in parts_of(whole, all_cuts, "text")):
            ids, side, comp = (batch.column(c).to_numpy() for c in ("id", "side", "comp"))
            parts = [sets_of(data, offs) for _, data, offs in steps(batch.column("text"))]
            code = np.concatenate([c for c, _ in parts])
            at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))])
            root, linked = links(code, at, cuts, side, comp)
            # a star for each component found here, so that the graph of all tasks has short paths
            own = np.flatnonzero(linked)
            if len(own):
                own = own[np.lexsort((ids[own], root[own]))]
                new = np.ones(len(own), bool)
                new[1:] = root[own][1:] != root[own][:-1]
                low = ids[own][np.flatnonzero(new)][np.cumsum(new) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(ids[own][~new]), pa.array(low[~new])], names=["u", "v"])

    return run


def link_components(postings: DataFrame, sample: DataFrame, fetch, sets_of, chunk: int = CHUNK, sign: bool = True, sizes: DataFrame | None = None) -> DataFrame:
    """(id, component) of all sets that link with another one; component is the smallest id of its group.

    postings(key long, id long): sets that can link share a key; sample: the postings of some of the sets, which tell
    which keys are frequent. fetch(ids, kept) gives (id, text), asked only for what is needed (tables that it settles by
    kept() are removed in the end), and sets_of(bytes, offsets)
    the sorted token sets of texts: texts are smaller than their sets, so it is texts that are dealt, and sets are made
    where they are compared.

    A key's sets go to the block of the smallest id among them, so every pair that shares a key meets in a block,
    once for many keys. In a block, signature trees find the pairs that may link. With sign, signatures alone first
    tell which sets of a block have a possible partner at all, and only the texts of those are dealt; where keys are so
    selective that most have one, that is not worth a pass. Where sizes(id, n) are given, a row for each set, only those
    that have one of a like size in their block are signed or dealt at all. A block beyond `chunk` sets is cut: first each chunk is
    compared with itself and the block's centre; then what is not connected to the block's largest component is
    compared, chunk by chunk, with everything else in the block. Tables written on the way are removed at the end.
    """
    spent: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        spent.append(settle(df))
        return spent[-1]

    blocks = block_members(postings, sample)
    spent.append(blocks)

    def cut_up(blocks: DataFrame) -> DataFrame:
        """(centre, part, id): each block's members dealt to its chunks, the centre being in all of them."""
        counts = blocks.groupBy("centre").agg((F.count("*") + 1).alias("members"))
        parts = F.ceil(F.col("members") / chunk).cast("int")
        dealt = blocks.join(counts, "centre").select("centre", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "members")
        centres = counts.select("centre", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("centre").alias("id"), "members")
        return dealt.unionByName(centres)

    def sorted_groups(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys)

    members = kept(cut_up(blocks))
    large = members.where(F.col("members") > chunk)
    if sizes is not None:
        # whole blocks, as below
        members = kept(like_sized(members.where(F.col("members") <= chunk), sizes).union(large))
    if sign:
        signatures = kept(fetch(members.select("id").distinct(), kept).mapInArrow(_signed(sets_of), "id long, n long, low long, bits binary"))
        # a set whose partners are all in other chunks of a large block must stay, so only whole blocks are thinned out
        whole = members.where(F.col("members") <= chunk)
        thin = sorted_groups(whole.join(signatures, "id").select("centre", "part", "id", "n", "low", "bits"), ["centre", "part"])
        thin = thin.mapInArrow(_keep_promising, "centre long, part int, id long")
        members = kept(thin.union(large.select("centre", "part", "id")))
    large = large.select("centre", "id").distinct()
    texts = kept(fetch(members.select("id").distinct(), kept))

    def compare(df: DataFrame, keys: list[str]) -> DataFrame:
        rows = df.join(texts, "id").select(*keys, "id", "side", "comp", "text")
        return kept(sorted_groups(rows, keys).mapInArrow(_link(keys, sets_of), "u long, v long"))

    first = compare(members.select("centre", "part", "id", F.lit(0).alias("side"), F.col("id").alias("comp")), ["centre", "part"])
    found = components(first)
    if large.isEmpty():
        discard(*spent)
        return found

    # large blocks: the components in each, the largest of them, and all others against everything
    spent.append(found)
    large = kept(large.join(found, "id", "left").select("centre", "id", F.coalesce("component", "id").alias("comp")))
    weight = large.groupBy("centre", "comp").agg(F.count("*").alias("w"))
    main = weight.groupBy("centre").agg(F.max_by("comp", F.struct("w", "comp")).alias("main"), F.sum("w").alias("all"), F.max("w").alias("of_main"))
    main = main.where("of_main < all").withColumn("a_parts", F.ceil((F.col("all") - F.col("of_main")) / chunk).cast("int")).withColumn("b_parts", F.ceil(F.col("of_main") / chunk).cast("int"))
    large = large.join(main, "centre")
    rest = large.where("comp <> main").withColumn("own", F.pmod(F.xxhash64("id"), "a_parts").cast("int"))
    bulk = large.where("comp = main").withColumn("own", F.pmod(F.xxhash64("id"), "b_parts").cast("int"))
    # group (x, y), x <= y: chunks x and y of the rest; group (x, -1 - y): chunk x of the rest, chunk y of the bulk
    deals = (
        (rest, "transform(sequence(own, a_parts - 1), y -> struct(own AS x, y AS y, 0 AS side))"),
        (rest.where("own > 0"), "transform(sequence(0, own - 1), x -> struct(x AS x, own AS y, 1 AS side))"),
        (rest, "transform(sequence(0, b_parts - 1), y -> struct(own AS x, -1 - y AS y, 0 AS side))"),
        (bulk, "transform(sequence(0, a_parts - 1), x -> struct(x AS x, -1 - own AS y, 1 AS side))"),
    )
    pairs = None
    for df, deal in deals:
        own = df.select("centre", "id", "comp", F.explode(F.expr(deal)).alias("g")).select("centre", "id", "comp", "g.x", "g.y", "g.side")
        pairs = own if pairs is None else pairs.unionByName(own)
    out = components(first.union(compare(pairs, ["centre", "x", "y"])))
    discard(*spent)
    return out
