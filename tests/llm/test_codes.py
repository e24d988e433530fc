"""Vector codes against the contract's arithmetic in Python's own integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from epilattice.llm import queries as q
from epilattice.llm import walsh_codes as wc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error int, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1, "y") for i, v, c in rows], SCHEMA)


def by_hand(rows, rounds=6, k=16, parts=8):
    """(vec_id, label, code, error, label_error) of kept rows, and the codebooks' text."""
    kept = [(i, v, c) for i, v, c in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    width = -(-length // parts)
    exact = lambda x: int(x) * 4096 if abs(x) >= 2**53 else math.floor(x * 4096)
    cut = lambda v: [[exact(x) for x in (*v, *[0.0] * (parts * width - length))][p * width : (p + 1) * width] for p in range(parts)]
    own = [(i, cut(v), c) for i, v, c in kept if len(v) == length]
    book = [[v[p] for _, v, _ in own[:k]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(v, p):
        return min(range(len(book[p])), key=lambda e: (far(v[p], book[p][e]), e))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = {}
            for _, v, _ in own:
                members.setdefault(nearest(v, p), []).append(v[p])
            new.append([[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else book[p][e] for e in range(len(book[p]))])
        book = new
    out = []
    for i, v, c in own:
        code = [nearest(v, p) for p in range(parts)]
        out.append((i, c, bytes(code).hex(), sum(far(v[p], book[p][code[p]]) for p in range(parts))))
    by_label = {}
    for _, c, _, e in out:
        by_label[c] = by_label.get(c, 0) + e
    out = [(*r, by_label[r[1]]) for r in out]
    out += [(i, c, None, None, by_label.get(c)) for i, v, c in kept if len(v) != length]
    return out, ",".join(str(x) for part in book for e in part for x in e)


def vectors(n, length, seed=3, scale=1.0):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(0, scale), 2) for _ in range(length)], r.choice([None, 1, 1, 1, 2])) for i in r.sample(range(10 * n), n)]
    rows += [(5, None, 1), (None, [0.5] * length, 2), (6, [math.nan] * length, 1), (7, [math.inf] + [0.0] * (length - 1), None), (8, [None] * length, 1), (9, [], 3)]
    return rows + [rows[0], rows[0], (rows[1][0], rows[2][1], 4)]


def compare(spark, rows):
    book = wc.fit(frame(spark, rows))
    want, text = by_hand(rows)
    assert book.text() == text and book.sha256() == hashlib.sha256(text.encode()).hexdigest()
    got = wc.encode(frame(spark, rows), book).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("n, length", [(300, 32), (200, 24), (120, 13), (10, 16), (40, 3)], ids=["32", "24", "not divided", "few rows", "shorter than its parts"])
def test_codes(spark, n, length):
    compare(spark, vectors(n, length))


def test_other_lengths_and_ties(spark):
    compare(spark, vectors(60, 16) + [(100_000, [1.0] * 15, 1), (100_001, [1.0] * 17, 9)])
    compare(spark, [(i, [float(i % 3)] * 8, i % 2) for i in range(50)])


def test_large_values_are_exact(spark):
    r = random.Random(8)
    rows = [(i, [r.choice([1e6, -3e6, 1e9, 2**55 + 8.0, 0.25]) * r.random() for _ in range(16)], None) for i in range(60)]
    book = wc.fit(frame(spark, rows))
    want, text = by_hand(rows)
    assert book.text() == text
    got = {x.vec_id: x for x in wc.encode(frame(spark, rows), book).collect()}
    large = False
    for i, _, code, error, _ in want:
        assert got[i].code == code and got[i].error == (error if error < 2**63 else None)
        large |= error >= 2**63
    assert large and {x.label_error for x in got.values()} == {None}


def test_no_rows(spark, tmp_path):
    assert wc.fit(frame(spark, [])) is None and wc.fit(frame(spark, [(1, None, 1)])) is None
    frame(spark, [(1, None, 1)]).select("vec_id", "embedding", "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = q.op12_codes(spark, str(tmp_path))
    assert out.count() == 0 and {"vec_id", "code", "error", "label_error", "codebooks_sha256"} <= set(out.columns)


def test_many_labels_are_joined_with_salt(spark, monkeypatch):
    rows = [(i, v, i if i % 3 else None) for i, v, _ in vectors(80, 16) if i is not None]
    monkeypatch.setattr(wc, "FEW_LABELS", 5)
    compare(spark, rows)


@pytest.mark.parametrize("kind", [np.int64, object])
def test_early_elimination_finds_the_nearest(kind):
    rng = np.random.default_rng(1)
    for width in (1, 2, 5, 8, 16):
        x, book = rng.integers(-9, 10, (400, width)).astype(kind), rng.integers(-9, 10, (16, width)).astype(kind)
        book[7] = book[3]
        index, scaled = wc.nearest(wc.transformed(x), wc.transformed(book))
        full = ((x[:, None] - book) ** 2).sum(2)
        m = wc.transformed(x).shape[1]
        assert (index == full.argmin(1)).all() and (scaled == full.min(1) * m).all()


def test_sequency():
    for m in (1, 2, 8, 32):
        rows = wc.walsh(np.eye(m, dtype=np.int64))[:, wc.sequency(m)].T
        assert [(np.diff(r) != 0).sum() for r in rows] == list(range(m)) and (rows @ rows.T == m * np.eye(m)).all()
