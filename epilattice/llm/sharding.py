"""Shards by a weighted hash tree of regions, racks and shards. DataFrame operations alone.

A row descends the tree by its id: at each level every child draws -ln(u) / weight, u being hashed from id and child, and
the least draw wins, so a child gets its weight's share of the rows. A child's draw doesn't depend on its siblings: where
weights change, rows go into or out of the subtrees whose weights changed, and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight. A rack weighs what its shards weigh, a region what its racks weigh.
Tree = dict[str, dict[str, dict[int, float]]]

#: Buckets of each shard in which rows get their places, by hash (three hex digits).
BUCKETS = 16**3
#: Copies of one row that get their places together; more of them are dealt over several buckets.
COPIES = 1 << 16


def layout(shards: int, per_rack: int = 4, racks: int = 2) -> Tree:
    """Shards 0 to shards - 1 of weight 1, per_rack of them in a rack, so many racks in a region."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // per_rack
        region = rack // racks
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own: no other subtree's weight changes, so that rows move into
    the new shard only, from every other one by the same share."""
    shards = [s for racks in tree.values() for rack in racks.values() for s in rack]
    shard = max(shards, default=-1) + 1
    return tree | {f"region+{shard}": {f"rack+{shard}": {shard: weight}}}


def _numbered(tree: Tree) -> tuple[list[list[tuple[int, str, float]]], dict[int, tuple[str, str, int]]]:
    """(children of each node as (node, path, weight), place of each shard's node). The root is node 0; weights of 0 are
    left out."""
    children: list[list[tuple[int, str, float]]] = [[]]
    places: dict[int, tuple[str, str, int]] = {}

    def add(parent: int, path: str, weight: float) -> int:
        children.append([])
        children[parent].append((len(children) - 1, path, float(weight)))
        return len(children) - 1

    for region, racks in tree.items():
        if any(w < 0 for rack in racks.values() for w in rack.values()):
            raise ValueError("weights can't be negative")
        total = sum(sum(rack.values()) for rack in racks.values())
        if not total:
            continue
        at = add(0, region, total)
        for rack, shards in racks.items():
            if not sum(shards.values()):
                continue
            below = add(at, f"{region}/{rack}", sum(shards.values()))
            for number, weight in shards.items():
                if weight:
                    places[add(below, f"{region}/{rack}/{number}", weight)] = (region, rack, number)
    if not places:
        raise ValueError("the tree has no shard with a weight")
    return children, places


def _descend(key: Column, node: Column, children: Column) -> Column:
    """The child with the least draw; of equal draws the first one."""

    def draw(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), child["path"])), 1, 13), 16, 10).cast("double")
        return F.struct((-F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / child["weight"]).alias("draw"), child["node"].alias("node"))

    return F.array_min(F.transform(F.element_at(children, node + 1), draw))["node"]


def place(docs: DataFrame, tree: Tree, id_col: str = "doc_id", into: str = "place") -> DataFrame:
    """docs with one more column, struct<region string, rack string, shard int>, named by `into` (a column of that
    name is replaced). A projection: nothing is shuffled. A null id counts as the empty text; equal ids share a place."""
    numbered, places = _numbered(tree)
    child = lambda c: F.struct(F.lit(c[0]).alias("node"), F.lit(c[1]).alias("path"), F.lit(c[2]).alias("weight"))
    none = "array<struct<node:int,path:string,weight:double>>"
    children = F.array(*[F.array(*map(child, own)).cast(none) for own in numbered])
    node, key = F.lit(0), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    for _ in range(3):
        node = _descend(key, node, children)
    kind = "struct<region:string,rack:string,shard:int>"
    found = F.array(*[F.struct(*map(F.lit, places[i])).cast(kind) if i in places else F.lit(None).cast(kind) for i in range(len(numbered))])
    return docs.withColumn(into, F.element_at(found, node + 1))


def shard(docs: DataFrame, tree: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id, size, text_crc32, region, rack, shard, slot, grown_shard).

    size is the text's UTF-8 bytes plus 1, text_crc32 its checksum (null text: 1 and 0); grown_shard is the shard with one
    more; slot counts each shard's rows from 0 without gaps, by (hash, id, size, checksum). Id and tree alone decide the
    shard: rows that share an id share it, equal texts need not. Repeated rows get slots of their own, an empty table
    gives no rows, other columns play no part.

    Rows that agree in all of this are counted first, then places are summed inside hashed buckets of each shard, and
    the sizes of the buckets before are added: no task sorts a whole shard, whatever one id or one text holds.
    """
    text = F.col(f"`{text_col}`")
    thin = docs.select(
        F.col(f"`{id_col}`").alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    alike = thin.groupBy("_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    # copies in parts, each of which has a bucket
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) DIV {COPIES}"))).alias("_part")
    parts = alike.select("_id", "size", "text_crc32", part, F.col("_n").alias("_all"))
    parts = parts.withColumn("_n", F.least(F.lit(COPIES).cast("long"), F.col("_all") - F.col("_part") * COPIES)).drop("_all")
    named = F.concat_ws("|", F.coalesce(F.col("_id").cast("string"), F.lit("")), "size", "text_crc32", "_part")
    parts = place(place(parts, tree, "_id", "_at"), grown(tree), "_id", "_then").select(
        "_id", "size", "text_crc32", "_part", "_n", "_at.region", "_at.rack", F.coalesce("_at.shard", F.lit(-1)).alias("shard"), F.col("_then.shard").alias("grown_shard"),
        F.coalesce(F.substring(F.md5(named), 1, 3), F.lit("")).alias("_bucket"),  # never null, and neither is shard: the join needs no filter for it
    )
    sizes = parts.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_rows"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_rows")
    upto = F.sum("_n").over(W.partitionBy("shard", "_bucket").orderBy("_id", "size", "text_crc32", "_part").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = parts.withColumn("_upto", upto).join(before, ["shard", "_bucket"])
    end = F.col("_before") + F.col("_upto")
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", "region", "rack", "shard", F.explode(F.sequence(end - F.col("_n"), end - 1)).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, tree: Tree, path: str, id_col: str = "doc_id", salt: int = 16) -> None:
    """All columns of docs as Parquet in path/shard=N, up to `salt` files a shard and writing task: rows are dealt by
    shard and by a hash of the whole row, so that no task holds a shard. A column named shard is replaced."""
    rows = place(docs, tree, id_col, "_place").withColumn("shard", F.col("_place.shard")).drop("_place")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]), F.lit(salt))
    rows.repartition("shard", spread).write.partitionBy("shard").parquet(path)
