"""Tall least squares and the bootstrap's exact draws, against numpy on the whole design."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epilattice.operators import bootstrap as bs
from epilattice.operators import mutations as mu
from epilattice.operators import tall

from test_scores import LABELS, model_scores

ROWS = "g string, at array<int>, x array<double>, p int, y double"


def design(spark, groups):
    """groups: name -> (X, y); zeros are left out."""
    rows = []
    for g, (x, y) in groups.items():
        for v, t in zip(x, y, strict=True):
            at = np.flatnonzero(v)
            rows.append((g, at.tolist(), v[at].tolist(), x.shape[1], float(t)))
    return spark.createDataFrame(rows, ROWS)


def ill_conditioned(rng, n, p, condition):
    q, _ = np.linalg.qr(rng.normal(size=(n, p)))
    w, _ = np.linalg.qr(rng.normal(size=(p, p)))
    return q * np.logspace(0, -np.log10(condition), p) @ w


@pytest.mark.parametrize("parts, slots", [(1, 1), (5, 3), (40, 40)])
def test_qr_keeps_the_condition(spark, parts, slots, monkeypatch):
    rng = np.random.default_rng(2)
    groups = {}
    for g in "ab":
        x = ill_conditioned(rng, 900, 8, 1e7)
        groups[g] = (x, x @ rng.normal(size=8) + 1e-9 * rng.normal(size=900))
    monkeypatch.setattr(tall, "default_slots", lambda _: slots)
    got = {r.g: r for r in tall.least_squares(design(spark, groups).repartition(parts), ["g"]).collect()}
    for g, (x, y) in groups.items():
        want, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        gram = np.linalg.pinv(x.T @ x, rcond=1e-12, hermitian=True) @ (x.T @ y)
        assert got[g].coefficients == pytest.approx(want.tolist(), rel=1e-9, abs=1e-9) and (got[g].rank, got[g].n) == (rank, 900) == (8, 900)
        assert got[g].rss == pytest.approx(np.sum((y - x @ want) ** 2), rel=1e-6)
        assert np.abs(gram - want).max() > 1e-4  # what squaring costs


def test_qr_of_deficient_and_short_designs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    x[:, 4] = x[:, 1] + x[:, 2]
    groups = {"deficient": (x, rng.normal(size=200)), "short": (rng.normal(size=(3, 6)), rng.normal(size=3)), "one": (np.ones((1, 1)), np.array([4.0])), "zero": (np.zeros((4, 2)), np.ones(4))}
    got = {r.g: r for r in tall.least_squares(design(spark, groups).repartition(7), ["g"]).collect()}
    for g, (x, y) in groups.items():
        want, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        assert got[g].coefficients == pytest.approx(want.tolist(), abs=1e-9) and got[g].rank == rank and got[g].rss == pytest.approx(np.sum((y - x @ want) ** 2), abs=1e-9)
    assert tall.least_squares(spark.createDataFrame([], ROWS), ["g"]).count() == 0


def test_trees_merge_everything(spark):
    """Sums over many slots, with keys on a few of them and several rows of one slot; rounds of FAN rows."""
    rows = [(k, s, float(s + 1)) for k in "abc" for s in range(100) if k != "c" or s % 37 == 0] + [("a", 5, 0.5), ("a", 5, 0.25)]
    parts = spark.createDataFrame(rows, "k string, slot int, v double")
    out = tall.merge_tree(parts, ["k"], lambda pdf: pd.DataFrame({"v": [pdf["v"].sum()]}), 100)
    want = {}
    for k, _, v in rows:
        want[k] = want.get(k, 0) + v
    found = [tuple(r) for r in out.collect()]
    assert dict(found) == want and len(found) == 3
    assert out._jdf.queryExecution().logical().toString().count("FlatMapGroupsInPandas") == 3  # 100, 13, 2, 1


def test_sums_in_a_task_are_handed_on(spark, monkeypatch):
    rng = np.random.default_rng(4)
    groups = {f"g{i}": (rng.normal(size=(6, 3)), rng.normal(size=6)) for i in range(30)}
    got = {r.g: r.coefficients for r in tall.least_squares(design(spark, groups).coalesce(1), ["g"]).collect()}
    assert all(got[g] == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0].tolist()) for g, (x, y) in groups.items())


def drawn(spark, scores, slots, bucket_rows=16, bootstraps=30, seed=1):
    """All weights, by variant, through the table that the models use."""
    rows, _ = mu.design_rows(scores, ["o1", "o2"], 1)
    # the variant's number travels as its value
    rows = rows.withColumn("y", F.regexp_extract("variant_id", "[0-9]+", 0).cast("double"))
    table, _ = bs.bucketed(rows, bucket_rows, slots)
    found = {}
    whole = table.toArrow().combine_chunks().to_batches()
    means = {(r.allele, r.outcome): r.m for r in rows.groupBy("allele", "outcome").agg(F.avg("y").alias("m")).collect()}
    for head, own in bs._buckets(whole):
        w = bs.weights(head, len(own), bootstraps, seed)
        for i, y in enumerate(own.column("y").to_pylist()):
            found[head["allele"], head["outcome"], round(y + means[head["allele"], head["outcome"]])] = w[:, i]
    return found


def test_draws_are_the_same_on_any_partitioning(spark):
    scores, _ = model_scores(spark)
    one, many = drawn(spark, scores.coalesce(1), 1), drawn(spark, scores.repartition(9), 8)
    assert one.keys() == many.keys() and all((one[k] == many[k]).all() for k in one) and len(one) == 3 * (180 + 179)
    for allele in "ABC":
        for outcome, n in (("o1", 180), ("o2", 179)):
            assert (sum(w for k, w in one.items() if k[:2] == (allele, outcome)) == n).all()
    other = drawn(spark, scores, 4, seed=2)
    assert any((one[k] != other[k]).any() for k in one)


def test_draws_are_multinomial():
    """Mean, variance and covariance of the draws of a split tree, against those of one multinomial draw."""
    sizes, n, b = [3, 5, 1, 7], 16, 40_000
    heads = []
    for k in range(4):
        level1 = {"level": 0, "prefix": 0, "left": k < 2, "rows_left": sizes[0] + sizes[1], "rows": n}
        own = sizes[:2] if k < 2 else sizes[2:]
        heads.append({"head": n, "seed": -5, "bucket": k, "path": [level1, {"level": 1, "prefix": k // 2, "left": k % 2 == 0, "rows_left": own[0], "rows": sum(own)}]})
    w = np.concatenate([bs.weights(h, s, b, 3) for h, s in zip(heads, sizes, strict=True)], axis=1)
    assert w.shape == (b, n) and (w.sum(1) == n).all()
    plain = np.random.default_rng(0).multinomial(n, [1 / n] * n, b)
    for own in (w, plain):
        c = np.cov(own.T)
        assert own.mean(0) == pytest.approx(np.ones(n), abs=0.03)
        assert np.diag(c) == pytest.approx(np.full(n, 1 - 1 / n), abs=0.05) and np.abs(c - np.diag(np.diag(c)) + (1 - np.eye(n)) / n).max() < 0.03
    # how often a row is drawn k times
    for k in range(4):
        assert (w == k).mean() == pytest.approx((plain == k).mean(), abs=0.005)


def test_replicates_are_refits_on_the_drawn_rows(spark):
    scores, rows = model_scores(spark)
    got = {}
    for r in mu.mutation_bootstrap(scores, ["o1"], 1, bootstraps=30).collect():
        got.setdefault((r.allele, r.replicate), {})[r.mutation] = r.coefficient
    found = drawn(spark, scores, 3, bs.BUCKET_ROWS)
    assert len(got) == 90
    for allele in "ABC":
        own = [r for r in rows if r[0] == allele]
        x = np.array([[1.0, *(m in r[2].split(";") for m in LABELS)] for r in own])
        y = np.array([r[3] for r in own])
        w = np.array([found[allele, "o1", int(r[1][1:])] for r in own])
        for k in range(30):
            again = np.repeat(np.arange(len(own)), w[:, k])
            assert len(again) == 180
            beta = np.linalg.lstsq(x[again], y[again], rcond=None)[0]
            assert [got[allele, k][m] for m in LABELS] == pytest.approx(beta[1:].tolist(), abs=1e-7)


def test_replicates_do_not_depend_on_tasks(spark, monkeypatch):
    scores, _ = model_scores(spark)
    draws = lambda df: {(x.allele, x.outcome, x.mutation, x.replicate): x.coefficient for x in mu.mutation_bootstrap(df, ["o1", "o2"], 1, bootstraps=60).collect()}
    one = draws(scores.coalesce(1))
    monkeypatch.setattr(bs, "TASK_ROWS", 50)
    many = draws(scores.repartition(5))
    assert {k[3] for k in one} == set(range(60)) and one.keys() == many.keys() and all(many[k] == pytest.approx(v, abs=1e-8) for k, v in one.items())


def test_totals(spark):
    scores, _ = model_scores(spark)
    got = mu.bootstrap_totals(scores, ["o1", "o2"], 20).collect()
    assert len(got) == 3 * 2 * 20 and all(r.n_rows == r.n_drawn == (180 if r.outcome == "o1" else 179) and 40 < r.n_left_out < 90 for r in got)
    none = scores.where("false")
    assert mu.bootstrap_totals(none, ["o1"], 20).count() == 0 and mu.mutation_bootstrap(none, ["o1"], 1, 20).count() == 0


def test_constant_and_residuals(spark):
    """The normal equations hold at the solution: residuals are orthogonal to every column."""
    scores, rows = model_scores(spark)
    coefficients, _ = mu.mutation_ols(scores, ["o1"], 1, constant=True)
    got = {(r.allele, r.mutation): r.full_data_coefficient for r in coefficients.collect()}
    assert len(got) == 3 * 13
    for allele in "ABC":
        own = [r for r in rows if r[0] == allele]
        left = [r[3] - got[allele, ""] - sum(got[allele, m] for m in r[2].split(";") if m != "WT") for r in own]
        assert sum(left) == pytest.approx(0, abs=1e-8) and all(sum(e for e, r in zip(left, own) if m in r[2].split(";")) == pytest.approx(0, abs=1e-8) for m in LABELS)


@pytest.mark.parametrize("rows", [1 << 14, 20])
def test_bitmaps_give_the_normal_equations(spark, rows, monkeypatch):
    """Against products of the dense design, with one bitmap an allele and with several; scores that are missing or no
    numbers, repeated rows, mutations below the least count."""
    monkeypatch.setattr(mu, "BITMAP_ROWS", rows)
    scores, data = model_scores(spark)
    twice = ("A", "z1", "A1D;C2A", float("nan"), 2.0)
    more = [twice, twice, ("A", "z2", "E4L;Q9Q", 1.0, None), ("D", "d", "WT", 3.0, None)]
    got = {}
    for r in mu.mutation_gram(scores.union(spark.createDataFrame(more, scores.schema)), ["o1", "o2"], 5).collect():
        assert (r.allele, r.outcome, r.a, r.b) not in got and (r.xty is None) == (r.b != "")
        got[r.allele, r.outcome, r.a, r.b] = (r.xtx, r.xty)
    want = {}
    for row in dict.fromkeys((*data, *more)):
        allele, _, labels, *values = row
        own = ["", *(m for m in labels.split(";") if m not in ("WT", "Q9Q"))]
        for outcome, v in zip(("o1", "o2"), values, strict=True):
            if v is not None and v == v:
                for a in own:
                    for b in own:
                        n, t = want.get((allele, outcome, a, b), (0, 0.0))
                        want[allele, outcome, a, b] = n + 1, t + v
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and (k[3] or got[k][1] == pytest.approx(t)) for k, (n, t) in want.items())
    bitmaps = mu.mutation_bitmaps(scores, ["o1", "o2"]).collect()
    assert len({(r.allele, r.bucket) for r in bitmaps}) == (3 if rows > 180 else 27)


@pytest.mark.parametrize("alleles, mutations", [(128, 2048), (4, 3)])
def test_correlation_by_blocks(spark, alleles, mutations, monkeypatch):
    """Against pandas over common mutations, in one block and in many; what is missing, alone, constant or repeated."""
    monkeypatch.setattr(mu, "ALLELE_BLOCK", alleles)
    monkeypatch.setattr(mu, "MUTATION_BLOCK", mutations)
    rng = np.random.default_rng(6)
    rows = [(o, f"a{i}", f"m{k}", float(v)) for o in ("o1", "o2") for i in range(9) for k in range(10) if rng.random() < 0.7 for v in [rng.normal() + 1000]]
    rows += [("o1", "flat", f"m{k}", 5.0) for k in range(6)] + [("o1", "few", "m1", 1.0), ("o2", "few", "other", 1.0), ("o1", "a0", "m0", None)]
    schema = "outcome string, allele string, mutation string, full_data_coefficient double"
    out = mu.allele_correlation(spark.createDataFrame(rows + rows[:3], schema))
    got = {(r.outcome, r.allele_a, r.allele_b): (r.n_common, r.pearson_r) for r in out.collect()}
    table = pd.DataFrame(rows, columns=["o", "a", "m", "x"]).dropna()
    want = {}
    for o, own in table.groupby("o"):
        wide = own.pivot_table(index="m", columns="a", values="x")
        for a in wide:
            for b in wide:
                both = wide[[a]].join(wide[[b]], rsuffix="_").dropna() if a != b else wide[[a, a]].dropna()
                if len(both):
                    x, y = both.iloc[:, 0].to_numpy(), both.iloc[:, 1].to_numpy()
                    want[o, a, b] = (len(both), np.corrcoef(x, y)[0, 1] if len(both) >= 3 and x.std() > 0 and y.std() > 0 else None)
    assert got.keys() == want.keys()
    for k, (n, r) in want.items():
        assert got[k][0] == n and (got[k][1] is None) == (r is None) and (r is None or got[k][1] == pytest.approx(r, abs=1e-6))
    assert mu.allele_correlation(spark.createDataFrame([], schema)).count() == 0
