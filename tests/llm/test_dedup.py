"""Matching and deduplication against brute force, with the awkward cases of each."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from epilattice.llm import jaccard, linking, lines, shared, substrings
from epilattice.llm.decontaminate import decontaminate, drop_contaminated
from epilattice.llm.shared import components
from epilattice.llm.textops import merged_sketch, sketch_rows

SCHEMA = "doc_id long, text string, _th string, id long, extra int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def prose(r, n, vocabulary=40):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 8), (8, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("order", ["up", "down", "shuffled"])
def test_components_of_a_long_path(spark, order, monkeypatch):
    """A thousand vertices in a row, with a few edges to a task's tree: rounds grow with the logarithm."""
    ids = list(range(1000))
    if order != "up":
        ids = ids[::-1] if order == "down" else random.Random(9).sample(ids, 1000)
    rounds = []
    monkeypatch.setattr(shared, "settle", lambda df, settle=shared.settle: rounds.append(1) or settle(df))
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(2001, 2000), (2001, 2002)], "u long, v long")
    got = {x.id: x.component for x in components(edges, forest=4).collect()}
    assert got == {**dict.fromkeys(range(1000), 0), 2000: 2000, 2001: 2000, 2002: 2000}
    assert 5 < len(rounds) < 3 * 16


def hits(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for item, t in items:
        w = low(t)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, t in rows:
        w, hit, found = low(t), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        names = sorted(found)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [200_000, 0])  # broadcast, and shuffled
def test_decontaminate(spark, bound):
    r = random.Random(2)
    items = [(i, prose(r, 14, 400)) for i in range(10)] + [(2, "short One"), (3, "x"), (4, ""), (5, None), (10, prose(r, 12, 3)), (10, prose(r, 12, 3))]
    rows = [(i, prose(r, 60, 400)) for i in range(30)]
    rows += [(40 + i, f"{prose(r, 9, 400)} {t} {prose(r, 9, 400)}") for i, (_, t) in enumerate(items)] + [(60, items[0][1].upper()), (61, " ".join(items[1][1].split()[:9]))]
    rows += [(70, None), (71, ""), (72, "..."), (None, "a short one"), (73, "SHORTÉ one"), (74, "short.one x"), (75, prose(r, 4000, 400) + " " + items[2][1])]
    rows += [rows[40], rows[40], (40, "other text of the same id")]
    got = decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=bound)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.select(names).collect()), key=str) == hits(rows, items)


def test_decontaminate_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate(frame(spark, [(1, "a b"), (2, None)]), bench).collect()
    assert sorted((r.doc_id, r.n_words, r.contaminated) for r in rows) == [(1, 2, False), (2, 0, False)]
    assert decontaminate(frame(spark, []), bench).count() == 0
    docs = frame(spark, [(1, "one two three"), (1, "clean"), (None, "two three"), (2, None)])
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    out = drop_contaminated(docs, bench)
    assert out.columns == docs.columns and sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "clean"), (2, None)]


def jaccard_truth(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted([(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)], key=str)


def near_copies(r, n):
    rows = []
    for g in range(n):
        base = prose(r, r.choice([6, 40, 120, 300]), 500).split()
        for _ in range(r.choice([1, 2, 6])):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 3])):
                own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    return rows


def test_jaccard_join(spark):
    r = random.Random(3)
    rows = near_copies(r, 25) + [(2000, None), (2001, ""), (2002, " \t"), (2003, "One two"), (2004, "one TWO"), (None, "one two"), (None, "alone here"), (2005, "A b C d E"), (2006, "a b c d e")]
    rows += [rows[0], rows[0], (rows[0][0], "another text")]
    got = jaccard.jaccard_join(frame(spark, rows))
    assert sorted([(x.doc_id, x.n_shingles, x.component_id) for x in got.collect()], key=str) == jaccard_truth(rows)
    assert jaccard.jaccard_join(frame(spark, [])).count() == 0


def test_large_blocks_lose_no_link(spark):
    """Chunks of three sets: most links lie between chunks."""
    r = random.Random(4)
    base = prose(r, 200, 5000).split()
    texts = []
    for i in range(24):
        own = list(base)
        for k in range(i * 2):  # neighbours are alike, the ends are not
            own[k * 4] = f"e{k}"
        texts.append(" ".join(own))
    texts += [prose(r, 60, 5000) for _ in range(4)]
    rows = list(enumerate(texts))
    from epilattice.llm.textops import steps
    import pyarrow as pa

    docs = spark.createDataFrame(rows, "id long, text string")
    sets = lambda data, offs: jaccard.shingle_sets(data, offs, 5)
    (_, data, offs), = steps(pa.array(texts))
    code, at = sets(data, offs)
    posts = [(int(x), i) for i in range(len(texts)) for x in code[at[i] : at[i + 1]].view(np.int64)]
    postings = spark.createDataFrame(posts, "key long, id long")
    want = {i: c for (i, n, c) in jaccard_truth(rows)}
    for sign in (True, False):
        found = linking.link_components(postings, postings, lambda ids, kept: docs.join(ids, "id"), sets, chunk=3, sign=sign)
        got = {x.id: x.component for x in found.collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_little_is_dealt_to_blocks(spark, monkeypatch):
    """Sets whose sizes rule out a link with all others of their block aren't signed, and what is signed is narrow."""
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 5), (3, 6), (3, 7)], "centre long, id long")
    sizes = spark.createDataFrame([(1, 10), (2, 100), (3, 8), (4, 126), (5, 125), (6, 4), (7, 6)], "id long, n long")
    assert sorted(map(tuple, linking.like_sized(members, sizes).collect())) == [(1, 1), (1, 3), (2, 2), (2, 5)]
    asked = []
    code = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000)).astype(np.uint64)
    wide, narrow = (linking.signature(np.array([1000]), code, np.array([0, 1000]), *b)[1][-1] for b in ((), (linking.DEALT_BITS,)))
    assert wide == 4 * narrow
    r = random.Random(5)
    base = prose(r, 100, 5000)
    # one shingle is common to all; only the first two are of like sizes
    rows = [(0, base), (1, base + " more"), (2, base + " " + prose(r, 300, 5000)), (3, " ".join(base.split()[:8]))]
    link = jaccard.link_components
    monkeypatch.setattr(jaccard, "link_components", lambda postings, sample, fetch, *a, **k: link(postings, sample, lambda ids, kept: asked.append(ids.count()) or fetch(ids, kept), *a, **k))
    assert sorted((x.doc_id, x.component_id) for x in jaccard.jaccard_join(frame(spark, rows)).collect()) == [(0, 0), (1, 0), (2, 2), (3, 3)]
    assert max(asked) == 2


def test_keys_that_meet_by_chance_link_nothing(spark, monkeypatch):
    """With four bits of a key nearly all sets meet, and results are the same."""
    monkeypatch.setattr(jaccard, "KEY_BITS", 4)
    rows = near_copies(random.Random(6), 10)
    got = jaccard.jaccard_join(frame(spark, rows))
    assert sorted([(x.doc_id, x.n_shingles, x.component_id) for x in got.collect()], key=str) == jaccard_truth(rows)


def test_trees_prune(spark):
    """Clusters of near copies in one tree: the traversal finds all links and looks at few of the pairs."""
    r = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = r.integers(0, 2**63, 120).astype(np.uint64)
        for _ in range(10):
            own = base.copy()
            own[r.integers(0, 120, 5)] = r.integers(0, 2**63, 5)
            sets.append(np.unique(own))
    code, at = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    own, seen, looked = linking.Sets.of(code, at), set(), 0
    for a, b in linking.trees(own, np.arange(len(sets))):
        looked += linking.traverse(a, b, lambda p, q: False, lambda x, y: seen.add((min(x, y), max(x, y))))
    alike = {(x, y) for x, y in combinations(range(len(sets)), 2) if linking.similar(sets[x], sets[y])}
    assert len(alike) == 60 * 45 and alike <= seen and len(seen) < 2 * len(alike)
    assert looked < len(sets) ** 2 / 8
    # and the same groups by way of the whole search, in groups of one leaf and of many
    cuts = np.array([0, 10, 12, 16, 24, 24 + 16, len(sets)])
    root, linked = linking.links(code, at, cuts, np.zeros(len(sets), int), np.arange(len(sets)))
    for s, e in zip(cuts[:-1], cuts[1:]):
        want = list(range(s, e))
        for x, y in alike:
            if s <= x < e and s <= y < e:
                a, b = sorted((want[x - s], want[y - s]))
                want = [a if w == b else w for w in want]
        assert [want[x - s] for x in range(s, e)] == root[s:e].tolist()


def test_blocks_of_frequent_keys(spark):
    """A key that most ids have, dealt to many tasks, gives the same members as keys that few have."""
    r = random.Random(23)
    posts = [(1, i) for i in range(500)] + [(2, i) for i in range(100, 300)] + [(k, r.randrange(500)) for k in range(3, 90) for _ in range(3)]
    want = set()
    for k in {k for k, _ in posts}:
        own = {i for x, i in posts if x == k}
        want |= {(min(own), i) for i in own} - {(min(own), min(own))}
    df = spark.createDataFrame(posts, "key long, id long").repartition(6)
    for sample in (df, df.where("false")):
        got = [(x.centre, x.id) for x in linking.block_members(df, sample).collect()]
        assert len(got) == len(want) and set(got) == want


def test_keep_one(spark):
    r = random.Random(5)
    rows = near_copies(r, 10) + [(3000, None), (3001, "")]
    docs = frame(spark, rows)
    out = jaccard.keep_one(docs)
    firsts = {c for _, n, c in jaccard_truth(rows) if n}
    assert out.columns == docs.columns and {x.doc_id for x in out.collect()} == firsts | {3000, 3001}


def test_keep_one_without_own_ids(spark):
    """Null ids and a shared id do not make unrelated texts one group."""
    r = random.Random(15)
    alone, base = [prose(r, 40, 500) for _ in range(5)], prose(r, 100, 500)
    rows = [(None, alone[0]), (None, alone[1]), (7, alone[2]), (7, alone[3]), (8, alone[4]), (None, base), (None, base + " end"), (None, base)]
    out = [(x.doc_id, x.text) for x in jaccard.keep_one(frame(spark, rows)).collect()]
    assert len(out) == 6 and set(out) >= set(rows[:5]) and {t for _, t in out} & {base, base + " end"}


def repeats(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {p for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for p in range(i, i + width)}
        out.append((d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def test_keep_one_keeps_all_rows_without_words(spark):
    """Repeated rows without words, rows that differ only in other columns, and columns named like those inside."""
    alike = " ".join(f"w{i}" for i in range(30))
    schema = "doc_id long, text string, _key string, _th int, _id string, _n array<int>, key map<string,int>"
    row = lambda i, t, k: (i, t, k, 1, "x", [1, 2], {"a": 1})
    rows = [row(1, "", "a"), row(1, "", "a"), row(1, "", "b"), row(None, None, "a"), row(None, None, "a"), row(None, " \t", "a"), row(2, None, None)]
    rows += [row(7, alike, "b"), row(7, alike, "a"), row(7, alike, "c"), row(8, alike, "a"), row(7, alike, "a")]
    kept = []
    for order in (rows, rows[::-1]):
        out = jaccard.keep_one(spark.createDataFrame(order, schema).repartition(3))
        assert out.columns == ["doc_id", "text", "_key", "_th", "_id", "_n", "key"]
        kept.append(sorted(map(repr, map(tuple, out.collect()))))
    assert kept[0] == kept[1] and len(kept[0]) == 8
    assert Counter(k for k in kept[0] if alike not in k) == Counter(map(repr, rows[:7]))


def test_many_wordless_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COPIES", 3)
    assert jaccard.keep_one(frame(spark, [(None, " ")] * 10 + [(1, "")] * 3 + [(2, None)])).count() == 14


def test_contaminated_rows_go_whatever_the_columns_are_called(spark):
    text = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, text, "k", 1), (2, "clean", "k", 1), (None, None, None, 1)], "doc_id long, text string, _key string, _th int")
    out = drop_contaminated(docs, spark.createDataFrame([("a", text)], "item_id string, text string"))
    assert out.columns == docs.columns and sorted(x.doc_id or 0 for x in out.collect()) == [0, 2]


@pytest.mark.parametrize("most, kind, want", [(2, np.uint8, 2), (2**32 - 1, np.uint32, 2**32 - 1), (2**63 - 1, np.uint64, 6_000_000_000)])
def test_merged_sketches_do_not_wrap(spark, most, kind, want):
    part = np.zeros(16, kind)
    part[3] = min(3_000_000_000, most)
    part[5] = 1
    rows = [(0, bytes(b.column("cells")[0].as_py())) for b in sketch_rows(part) for _ in range(2)]
    got = merged_sketch(spark.createDataFrame(rows, "block int, cells binary"), 1, 4, most)
    assert got.dtype == kind and got[0, 3] == want and got[0, 5] == 2 and got.sum() == want + 2


@pytest.mark.parametrize("width", [35, 3])
def test_substrings(spark, width):
    r = random.Random(6)
    passage = prose(r, 50, 900)
    rows = [(i, prose(r, r.choice([5, 34, 35, 90, 400]), 900)) for i in range(40)]
    rows += [(50 + i, f"{prose(r, 30, 900)}\n{passage}\t{prose(r, 20, 900)}") for i in range(3)] + [(60, "a " * 80), (61, None), (62, ""), (63, "é" * 3), (None, "x y")]
    rows += [(64, passage + " " + passage), rows[0], rows[3], rows[3]]
    got = substrings.dedup_substrings(frame(spark, rows), width, 12)  # a crowded sketch: most windows are suspected, few are repeated
    assert sorted([tuple(x) for x in got.collect()], key=str) == repeats(rows, width)
    assert substrings.dedup_substrings(frame(spark, []), width, 12).count() == 0


def test_substrings_of_rows_with_one_name(spark, monkeypatch):
    """Rows whose names collide clear only windows of their own."""
    r = random.Random(4)
    passage = [f"p{i}" for i in range(12)]
    rows = []
    for i in range(40):
        own = [f"w{i}x{r.randint(0, 9)}{j}" for j in range(r.randint(0, 40))]
        at = r.randint(0, len(own))
        rows.append((i, " ".join(own[:at] + passage + own[at:] if i % 3 == 0 else own)))
    rows += [(50, None), (51, ""), (52, rows[1][1])]
    plain = sorted(map(tuple, substrings.dedup_substrings(frame(spark, rows), 6, 6).collect()))
    assert sum(x[2] for x in plain) >= 12 * 14
    monkeypatch.setattr(substrings, "row_name", lambda: F.lit(7).cast("long"))
    assert sorted(map(tuple, substrings.dedup_substrings(frame(spark, rows), 6, 6).collect())) == plain


def line_truth(rows):
    keys = sorted({x for _, t in rows if t for x in t.split("\n") if x.strip(" ")})
    sets = [{k[i : i + 5] for i in range(max(1, len(k) - 4))} for k in keys]
    root = list(range(len(keys)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in combinations(range(len(keys)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    group = {k: find(i) for i, k in enumerate(keys)}
    seen, out = set(), []
    for d, t in sorted(rows):
        own, left = ([] if t is None else t.split("\n")), []
        for x in own:
            if not x.strip(" ") or group[x] not in seen:
                left.append(x)
                if x.strip(" "):
                    seen.add(group[x])
        out.append((d, len(own), len(left), None if t is None else "\n".join(left)))
    return out


def test_lines(spark):
    r = random.Random(7)
    pool = [prose(r, 30, 2000) for _ in range(20)] + ["short", "é à", "x"]
    rows = []
    for i in range(40):
        own = []
        for _ in range(r.randrange(6)):
            x = r.choice(pool)
            own.append(x.replace("w1", "w2", 1) if r.random() < 0.3 else x)
        rows.append((i, "\n".join([*own, prose(r, 25, 2000), ""][: r.randrange(1, 8)])))
    rows += [(90, None), (91, ""), (92, "  \n\n"), (93, prose(r, 20000, 2000))]
    got = lines.dedup_lines(frame(spark, rows))
    assert sorted(((x.doc_id, x.n_lines, x.n_kept, x.kept) for x in got.collect()), key=lambda x: x[0]) == line_truth(rows)


def test_lines_whose_ids_clash(spark):
    """Lines that share the first hash are told apart by the second one."""
    rows = [(i, "\n".join(f"line {i} {k} " + "abcdefgh"[k] * 9 for k in range(4)) + "\nshared by all of them") for i in range(12)]
    got = lines.dedup_lines(frame(spark, rows), identity=lambda c: F.pmod(F.xxhash64(c), F.lit(5)))
    assert sorted((x.doc_id, x.n_lines, x.n_kept, x.kept) for x in got.collect()) == line_truth(rows)


def test_recall_of_lines(spark):
    """Pairs just above the similarity, short lines among them: one in a hundred may be missed."""
    r = random.Random(17)
    rows, linked = [], 0
    shingles = lambda x: {x[i : i + 5] for i in range(max(1, len(x) - 4))}
    while linked < 300:
        a = prose(r, r.choice([8, 12, 20, 40]), 5000)
        own = a.split()
        own[r.randrange(len(own))] = f"w{r.randrange(5000)}"
        b = " ".join(own)
        s, t = shingles(a), shingles(b)
        if a != b and 0.8 <= len(s & t) / len(s | t) < 0.9:
            linked += 1
            rows.append((linked, f"{a}\n{b}"))
    assert sum(x.n_lines - x.n_kept for x in lines.dedup_lines(frame(spark, rows)).collect()) >= 297


def test_lines_of_repeated_rows_and_stage(spark):
    rows = [(1, "same line of text here\nown line one two"), (1, "same line of text here\nown line one two"), (None, "same line of text here"), (2, "same line of text here\nown"), (3, None), (4, "")]
    docs = frame(spark, rows)
    got = sorted(((x.doc_id, x.kept) for x in lines.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (1, rows[0][1]), (None, ""), (2, "own"), (3, None), (4, "")], key=str)
    out = lines.drop_repeated_lines(docs)
    assert out.columns == docs.columns and sorted((x.doc_id for x in out.collect())) == [1, 1, 2, 3, 4]
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_one_word_of_a_line_of_eighty_characters(spark):
    base = "the quick brown fox jumps over the lazy dog while seven green birds sing a tune in May"
    rows = [(1, base), (2, base.replace("birds", "frogs")), (3, "an unrelated line of about the same length stands here and shares no words with that one")]
    assert [x.n_kept for x in lines.dedup_lines(frame(spark, rows)).sort("doc_id").collect()] == [1, 0, 1]
