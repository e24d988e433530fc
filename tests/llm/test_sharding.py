"""The weighted hash tree against a descent by hand, and what may move when it changes."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from epilattice.llm import queries as q
from epilattice.llm import sharding as sh

SCHEMA = "doc_id long, text string, shard string, slot long, _id int, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 9, 1, None) for i, t in rows], SCHEMA)


def by_hand(key, tree):
    """(region, rack, shard) of an id."""

    def draw(children):
        def least(child):
            u = (int(hashlib.md5(f"{key}|{child[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / child[1]

        return min((c for c in children if c[1] > 0), key=least)[0]

    weigh = lambda rack: sum(rack.values())
    region = draw([(r, sum(map(weigh, v.values()))) for r, v in tree.items()])
    rack = draw([(f"{region}/{k}", weigh(v)) for k, v in tree[region].items()])
    shard = draw([(f"{rack}/{s}", w) for s, w in tree[region][rack.split("/")[1]].items()])
    return region, rack.split("/")[1], int(shard.split("/")[2])


UNEVEN = {"a": {"r": {0: 1.0, 1: 3.0}, "s": {2: 2.0}}, "b": {"r": {3: 4.0, 4: 0.0}}, "c": {"t": {5: 0.0}}}


@pytest.mark.parametrize("tree", [sh.layout(16), sh.layout(5), UNEVEN], ids=["even", "short", "uneven"])
def test_descent(spark, tree):
    rows = spark.range(400).selectExpr("IF(id = 7, NULL, id) AS doc_id", "'own' AS place")
    got = {r.doc_id: tuple(r.place) for r in sh.place(rows, tree).collect()}
    assert got == {i: by_hand("" if i is None else i, tree) for i in got} and len(got) == 400


def moved(spark, before, after, n=20_000):
    rows = sh.place(sh.place(spark.range(n).withColumnRenamed("id", "doc_id"), before, into="a"), after, into="b")
    return Counter((r.a, r.b) for r in rows.select("a", "b").collect())


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = sh.layout(16)
    for _ in range(2):
        more = sh.grown(tree)
        new = max(s for racks in more.values() for rack in racks.values() for s in rack)
        moves = moved(spark, tree, more)
        assert all(a == b or b.shard == new for a, b in moves)
        taken = sum(n for (a, b), n in moves.items() if b.shard == new)
        assert abs(taken - 20_000 / (new + 1)) < 5 * math.sqrt(20_000 / (new + 1)) and len({a.shard for a, b in moves if b.shard == new}) == new
        tree = more


@pytest.mark.parametrize("weight", [0.25, 3.0, 0.0])
def test_movement_stays_in_subtrees_whose_weights_change(spark, weight):
    before = sh.layout(16)
    after = {r: {k: dict(v) for k, v in racks.items()} for r, racks in before.items()}
    after["region1"]["rack2"][8] = weight
    moves = moved(spark, before, after)
    for (a, b), _ in moves.items():
        if "region1" not in (a.region, b.region) or (a.region == b.region and "rack2" not in (a.rack, b.rack)):
            assert a == b
        if a.rack == b.rack and 8 not in (a.shard, b.shard):
            assert a == b
    share = Counter()
    for (_, b), n in moves.items():
        share[b.shard] += n
    want = 20_000 * weight / (15 + weight)
    assert abs(share[8] - want) <= 5 * math.sqrt(want)


def test_weights_give_shares(spark):
    got = Counter(r.place.shard for r in sh.place(spark.range(20_000).withColumnRenamed("id", "doc_id"), UNEVEN).collect())
    assert set(got) == {0, 1, 2, 3}
    for shard, w in ((0, 1), (1, 3), (2, 2), (3, 4)):
        assert abs(got[shard] - 2000 * w) < 5 * math.sqrt(2000 * w)
    with pytest.raises(ValueError):
        sh.place(spark.range(1), {"a": {"r": {0: 0.0}}}, "id")
    with pytest.raises(ValueError):
        sh.place(spark.range(1), {"a": {"r": {0: 2.0, 1: -1.0}}}, "id")


ROWS = [(1, "abc"), (1, "abc"), (1, "abd"), (2, None), (None, "äöü\u0000"), (None, None), (3, ""), (4, "x" * 100_000)] + [(7, "same")] * 11 + [(i, "same") for i in range(100, 160)]


@pytest.mark.parametrize("copies", [4, 1 << 16])
def test_shards_and_slots(spark, copies, monkeypatch):
    monkeypatch.setattr(sh, "COPIES", copies)
    got = sh.shard(frame(spark, ROWS), sh.layout(16)).collect()
    utf8 = [(i, (t or "").encode()) for i, t in ROWS]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in utf8)
    slots = defaultdict(list)
    for r in got:
        key = "" if r.doc_id is None else r.doc_id
        assert (r.region, r.rack, r.shard) == by_hand(key, sh.layout(16)) and r.grown_shard == by_hand(key, sh.grown(sh.layout(16)))[2]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sh.shard(frame(spark, []), sh.layout(16)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = frame(spark, ROWS)
    sh.write_shards(docs, sh.layout(16), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert all(r.shard == by_hand("" if r.doc_id is None else r.doc_id, sh.layout(16))[2] for r in back.collect())


@pytest.mark.parametrize("name, key", [("op11_sharding", "doc_id"), ("op12_codes", "vec_id")])
def test_query_equals_sql(spark, name, key):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = q.QUERIES[name](spark, folder)
    found = con.execute(q.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(found.fetchall())
    assert got.where(F.col(key).isNull()).count() == 0


def test_native(spark):
    plan = sh.shard(frame(spark, ROWS), sh.layout(16))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
