import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from epilattice.operators import chemistry as ch
from epilattice.operators import mutations as mu
from epilattice.operators import scores as sc
from epilattice.plans import queries
from epilattice.sources.readers import read_scores, read_table
from epilattice.sources.writers import write_by_allele, write_models, write_table

COLUMNS = (
    "allele string, peptide_id string, start string, `end` string, k string, netMHCpan_EL_rank string, netMHCpan_EL_rank_pass string, "
    "MHCflurry_affinity_percentile string, MHCflurry_affinity_percentile_pass string, peptide string, variant_id string, VR_mutation string"
)


def combined(spark, *rows):
    return spark.createDataFrame(rows, COLUMNS)


def variants(spark, *more):
    return combined(
        spark,
        ("A", "p1", "1", "9", "9", "0.5", "True", "0.5", "true", "PEPTIDEXX", "v1", "S1A"),
        ("A", "p2", "2", "10", "9", "5", "False", "6", "0", "SAMEWINDO", "v1", "S1A"),
        *more,
    )


def wild(spark):
    return combined(
        spark,
        ("A", "w1", "1", "9", "9", "1.0", "true", "3", "false", "PEPTIDEYY", "WT", ""),
        ("A", "p2", "2", "10", "9", "5", "false", "6", "false", "SAMEWINDO", "WT", None),
    )


def test_absolute(spark):
    r = sc.absolute_scores(variants(spark, ("A", "p1", "5", "13", "9", "0.1", "true", "x", "true", "PEPTIDEXX", "v1", "S1A")), validate=True).first()
    assert (r.total_epitope_count, r.netMHCpan_passed_count, r.both_passed_count, r.either_passed_count, r.mutation_count) == (2, 1, 1, 1, 1)
    assert r.netMHCpan_top_score == 0.5 and r.netMHCpan_mean_top3 == pytest.approx(2.75)
    assert sc.absolute_scores(variants(spark), require_three=True).first().MHCflurry_mean_top3 is None
    with pytest.raises(ValueError, match="VR_mutation"):
        sc.absolute_scores(variants(spark, ("A", "p3", "1", "9", "9", "1", "1", "1", "1", "X", "v1", "T2A")), validate=True)
    assert sc.absolute_scores(variants(spark).withColumn("allele", F.lit(None).cast("string"))).count() == 0


def test_relative_to_wild_type(spark):
    r = sc.wt_scores_mhci(variants(spark), wild(spark), validate=True).first()
    assert (r.matched_window_count, r.expected_window_count, r.changed_window_count) == (2, 2, 1)
    assert r.netMHCpan_mean_window_improvement == pytest.approx(0.25) and r.MHCflurry_mean_window_improvement == pytest.approx(1.25)
    assert (r.netMHCpan_net_pass_change, r.MHCflurry_new_passed_count, r.both_net_pass_change) == (0, 1, 1)


def test_unmatched_windows(spark):
    extra = variants(spark, ("A", "p9", "3", "11", "9", "1", "true", "1", "true", "NOMATCHXX", "v1", "S1A"), ("B", "p1", "1", "9", "9", "1", "1", "1", "1", "P", "v1", "S1A"))
    rows = {x.allele: x for x in sc.wt_scores_mhci(extra, wild(spark)).collect()}
    assert rows["A"].matched_window_count == 2 and rows["A"].netMHCpan_new_passed_count == 1
    assert rows["B"].expected_window_count == 0 and rows["B"].netMHCpan_mean_window_improvement is None
    with pytest.raises(ValueError):
        sc.wt_scores_mhci(extra, wild(spark), validate=True)
    few = variants(spark).where("start = '1'")
    with pytest.raises(ValueError, match="without all"):
        sc.wt_scores_mhci(few, wild(spark), validate=True)


def test_mhcii(spark):
    schema = "allele string, peptide_id string, start string, `end` string, k string, netMHCIIpan_EL_rank string, netMHCIIpan_EL_rank_binder string, peptide string, variant_id string, VR_mutation string"
    v = spark.createDataFrame([("A", "p", "1", "15", "15", "2", "true", "X", "v", "S1A"), ("A", "q", "2", "16", "15", "9", "false", "Y", "v", "S1A")], schema)
    w = spark.createDataFrame([("A", "p", "1", "15", "15", "4", "true", "Z", "WT", None), ("A", "q", "2", "16", "15", "9", "false", "Y", "WT", None)], schema)
    r = sc.wt_scores_mhcii(v, w, validate=True).first()
    assert r.netMHCIIpan_mean_window_improvement == pytest.approx(1.0) and r.changed_window_count == 1 and r.netMHCIIpan_net_binder_change == 0
    for bad in ((v, w.limit(1)), (v, w.union(w)), (v.union(v), w)):
        with pytest.raises(ValueError):
            sc.wt_scores_mhcii(*bad, validate=True)
    with pytest.raises(Exception, match="CAST"):
        sc.wt_scores_mhcii(v.withColumn("start", F.lit("x")), w).collect()


WT = "ACDE"
LABELS = ["A1D", "A1K", "A1L", "C2A", "C2K", "C2L", "D3A", "D3K", "D3L", "E4A", "E4K", "E4L"]


def model_scores(spark, n=180):
    rng = np.random.default_rng(7)
    effect = dict(zip(LABELS, rng.normal(size=12), strict=True))
    rows = []
    for allele in "ABC":
        for i in range(n):
            own = sorted(rng.choice(LABELS, size=rng.integers(0, 3), replace=False), key=lambda m: m[1])
            y = float(sum(effect[m] for m in own) + rng.normal() * 0.1)
            rows.append((allele, f"v{i}", ";".join(own) or "WT", y, None if i == 0 else 2 * y))
    return spark.createDataFrame(rows, "allele string, variant_id string, VR_mutation string, o1 double, o2 double"), rows


def solved(rows, allele, column):
    data = [r for r in rows if r[0] == allele and r[column] is not None]
    x = np.array([[1.0, *(m in r[2].split(";") for m in LABELS)] for r in data])
    y = np.array([r[column] for r in data])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return beta[1:], 1 - np.sum((y - x @ beta) ** 2) / np.sum((y - y.mean()) ** 2), len(y)


def test_least_squares(spark):
    scores, rows = model_scores(spark)
    coefficients, fits = mu.mutation_ols(scores, ["o1", "o2"], 1)
    got = {(r.allele, r.outcome, r.mutation): r.full_data_coefficient for r in coefficients.collect()}
    fit = {(r.allele, r.outcome): r for r in fits.collect()}
    assert len(got) == 72
    for allele in "ABC":
        for column, outcome in ((3, "o1"), (4, "o2")):
            beta, r2, n = solved(rows, allele, column)
            assert [got[allele, outcome, m] for m in LABELS] == pytest.approx(beta.tolist(), abs=1e-8)
            assert (fit[allele, outcome].n_variants, fit[allele, outcome].rank) == (n, 13) and fit[allele, outcome].r_squared == pytest.approx(r2)


def test_collinear_mutations_share_their_effect(spark):
    rows = [("A", f"v{i}", "A1D;C2A" if i % 2 else "WT", float(i % 2), 0.0) for i in range(10)]
    scores = spark.createDataFrame(rows, "allele string, variant_id string, VR_mutation string, o1 double, o2 double")
    coefficients, fits = mu.mutation_ols(scores, ["o1"], 1)
    assert [r.full_data_coefficient for r in coefficients.collect()] == pytest.approx([0.5, 0.5])
    assert fits.first().rank == 2 and fits.first().design_columns == 3


def test_expected_windows_of_many_alleles(spark):
    wt = spark.range(10_050).selectExpr("concat('a', id) AS allele", *(f"CAST({v} AS string) AS `{c}`" for c, v in zip(
        ["peptide_id", "start", "end", "k", sc.EL_RANK, sc.NET_PASS, sc.AFFINITY, sc.FLURRY_PASS, "peptide", "variant_id", "VR_mutation"],
        ["'p'", 1, 9, 9, 0.5, "true", 0.5, "true", "'PEPTIDEXX'", "'v'", "'WT'"], strict=True)))
    out = sc.wt_scores_mhci(wt, wt)
    assert out.where("expected_window_count = 1").count() == 10_050


def test_physchem_takes_all_nations(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("needs the test tables")
    seen = []
    monkeypatch.setattr(queries, "physicochemical_models", lambda effects: seen.append(effects) or {"models": effects})
    queries.QUERIES["physchem_models"](spark, folder)
    nations = spark.read.parquet(f"{folder}/supplier.parquet").select("s_nationkey").distinct().count()
    assert seen[0].agg(F.max("n_alleles")).first()[0] == nations == 25


def test_query_takes_all_replicates(spark, monkeypatch):
    drawn = []
    real = mu.mutation_bootstrap
    monkeypatch.setattr(mu, "mutation_bootstrap", lambda *a: (drawn.append(a[3]), real(*a))[1])
    monkeypatch.setattr(queries, "mhci_scores", lambda s, d: spark.createDataFrame([], "allele string, variant_id string, VR_mutation string, " + ", ".join(f"{x} double" for x in mu.OUTCOMES)))
    queries.mutation_coefficients_q(spark, "")
    assert drawn == [500]


def test_bootstrap_and_models(spark):
    scores, rows = model_scores(spark)
    c, _ = mu.mutation_coefficients(scores, WT, 100, ["o1", "o2"], 1, bootstraps=40, validate=True)
    c = c.cache()
    out = c.collect()
    assert len(out) == 72 and {r.position_absolute - r.position_relative for r in out} == {100}
    for r in out:
        assert r.ci_low <= r.bootstrap_mean_coefficient <= r.ci_high and abs(r.bootstrap_mean_coefficient - r.full_data_coefficient) < 0.1 and 0.3 <= r.sign_stability <= 1
    effects = mu.mutation_effects(c, 0.9).cache()
    assert effects.count() == 24
    summary = mu.allele_summary(c)
    assert all(0.3 <= r.sign_agreement <= 1 and r.n_alleles == 3 for r in summary.collect())
    assert mu.top_iqr(summary).count() == 10 and mu.allele_pivot(c, ["A", "B", "C"]).count() == 24 and mu.heatmap_cells(c).count() == 72
    r = {(x.allele_a, x.allele_b): x.pearson_r for x in mu.allele_correlation(c.where("outcome = 'o1'")).collect()}
    values = {a: [x.full_data_coefficient for x in sorted(out, key=lambda x: x.mutation) if x.allele == a and x.outcome == "o1"] for a in "AB"}
    assert r["A", "A"] == pytest.approx(1) and r["A", "B"] == pytest.approx(np.corrcoef(values["A"], values["B"])[0, 1])
    few = mu.allele_correlation(c.where("mutation IN ('A1D', 'A1K')"))
    assert {x.pearson_r for x in few.collect()} == {None}
    models = ch.physicochemical_models(effects)
    assert models["models"].count() == 2 and models["coefficients"].count() == 14 and models["partial_r_squared"].count() == 8 and models["positions"].count() == 8
    assert abs(sum(x.adjusted_position_effect for x in models["positions"].where("outcome = 'o1'").collect())) < 1e-9
    group = effects.where("outcome = 'o1'").toPandas()
    x, y, _, _, _ = ch.design(group)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    got = {r.term: r for r in models["coefficients"].where("outcome = 'o1'").collect()}
    assert got["const"].coefficient == pytest.approx(beta[0])
    with pytest.raises(Exception, match="more mutations"):
        ch.physicochemical_models(effects.limit(4))["models"].collect()


def test_chemistry_against_another_way(spark):
    """Standard errors by QR, tail areas by integrating the density, information criteria and partial R squared by refits."""
    rng = np.random.default_rng(5)
    labels = [f"{w}{k + 1}{m}" for k, w in enumerate("ACDEFG") for m in "KLRSTV"]
    base = mu.parsed_mutations(spark.createDataFrame([(m,) for m in labels], "mutation string"), "ACDEFG", 10).toPandas()
    base["outcome"], base["median_allele_coefficient"] = "o", rng.normal(size=len(base)) + 0.3 * base["hydrophobicity_change"]
    models = ch.physicochemical_models(spark.createDataFrame(base))
    data = base.sort_values("mutation")
    place = data["position_relative"].to_numpy(int)
    full = {"const": np.ones(36), **{c: data[c].to_numpy(float) for c in ch.CONTINUOUS}, **{f"position_{k}": (place == k) * 1.0 for k in range(2, 7)}}
    x, y = np.column_stack(list(full.values())), data["median_allele_coefficient"].to_numpy()

    def sse(x):
        return float(np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2))

    n, p = x.shape
    q, r = np.linalg.qr(x)
    beta, inverse = np.linalg.solve(r, q.T @ y), np.linalg.inv(r)
    se = np.sqrt(np.sum(inverse**2, axis=1) * sse(x) / (n - p))
    t = np.linspace(0, 60, 600_001)
    density = (1 + t**2 / (n - p)) ** (-(n - p + 1) / 2)
    area = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    two_sided = lambda v: 1 - np.interp(abs(v), t, area / area[-1])
    half = np.interp(0.95, area / area[-1], t)
    got = {r.term: r for r in models["coefficients"].collect()}
    for k, name in enumerate(full):
        own = got[name]
        assert (own.coefficient, own.standard_error) == pytest.approx((beta[k], se[k]), rel=1e-8)
        assert own.p_value == pytest.approx(two_sided(beta[k] / se[k]), abs=1e-5) and (own.ci_low, own.ci_high) == pytest.approx((beta[k] - half * se[k], beta[k] + half * se[k]), abs=1e-4)
    m, tss = models["models"].first(), float(np.sum((y - y.mean()) ** 2))
    likelihood = np.sum(-0.5 * np.log(2 * np.pi * sse(x) / n) - (y - x @ beta) ** 2 / (2 * sse(x) / n))
    assert (m.n_mutations, m.n_positions) == (36, 6) and (m.aic, m.bic) == pytest.approx((2 * p - 2 * likelihood, np.log(n) * p - 2 * likelihood))
    assert (m.r_squared, m.adjusted_r_squared) == pytest.approx((1 - sse(x) / tss, 1 - (sse(x) / (n - p)) / (tss / (n - 1))))
    for r in models["partial_r_squared"].collect():
        out = [name for name in full if (name.startswith("position_") if r.predictor == "Position" else ch.PREDICTORS.get(name) == r.predictor)]
        reduced = sse(np.column_stack([v for name, v in full.items() if name not in out]))
        assert r.partial_r_squared == pytest.approx(1 - sse(x) / reduced) and r.degrees_of_freedom == len(out) and r.reduced_model_sse == pytest.approx(reduced)
    effects = np.array([0, *beta[4:]])
    assert [r.adjusted_position_effect for r in models["positions"].sort("position_relative").collect()] == pytest.approx((effects - effects.mean()).tolist())


def test_models_of_the_derived_library(spark):
    """The registered models on whole tables, against least squares of the whole design."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("needs the test tables")
    scores = queries.mhci_scores(spark, folder).toPandas()
    found = queries.QUERIES["mutation_ols"](spark, folder).toPandas()
    fits = queries.QUERIES["mutation_fits"](spark, folder).toPandas()
    for (allele, outcome), own in found.groupby(["allele", "outcome"]):
        data = scores[(scores["allele"] == allele) & scores[outcome].notna()]
        sets = data["VR_mutation"].map(lambda m: set() if m == "WT" else set(m.split(";")))
        names = own["mutation"].tolist()
        x = np.column_stack([np.ones(len(data)), *(sets.map(lambda s, m=m: m in s).to_numpy(float) for m in names)])
        y = data[outcome].to_numpy(float)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        assert own["full_data_coefficient"].tolist() == pytest.approx(beta[1:].tolist(), abs=1e-7)
        fit = fits[(fits["allele"] == allele) & (fits["outcome"] == outcome)].iloc[0]
        assert fit["r_squared"] == pytest.approx(1 - np.sum((y - x @ beta) ** 2) / np.sum((y - y.mean()) ** 2)) and fit["n_variants"] == len(y)
    assert len(found.groupby(["allele", "outcome"])) == 8


def test_mutations_must_fit(spark):
    ok = mu.parsed_mutations(spark.createDataFrame([("A1V",), ("v1A",), ("C2*",), ("A9V",), ("x",)], "mutation string"), WT)
    assert [r.position_relative for r in ok.collect()] == [1, None, None, None, None]
    for bad in ("V1A", "A1B", "A9V", "A1*"):
        with pytest.raises(ValueError):
            mu.parsed_mutations(spark.createDataFrame([(bad,)], "mutation string"), WT, validate=True)
    with pytest.raises(ValueError):
        mu.recurrent_mutations(model_scores(spark, 5)[0], 100, validate=True)


def test_student_t():
    # published quantiles and tail areas
    for df, q in ((1, 12.706205), (5, 2.570582), (10, 2.228139), (30, 2.042272)):
        assert ch.t_quantile(0.975, df) == pytest.approx(q, abs=1e-5) and ch.t_p_value(q, df) == pytest.approx(0.05, abs=1e-6)
    assert mu.side_chain_charge("K") == pytest.approx(0.99749, abs=1e-4) and mu.side_chain_charge("A") == 0
    assert mu.side_chain_charge("D") == pytest.approx(-0.99955, abs=1e-4)


def test_score_files_are_matched_by_name(spark, tmp_path):
    """Files with their columns in different orders, one without an outcome, one with quotes and a wider header."""
    for name, text in {
        "a/scores.tsv": "allele\tvariant_id\tVR_mutation\to1\to2\nA\tv1\tA1D\t1\t10\n",
        "b/deep/scores.tsv": "o2\tVR_mutation\tallele\to1\tvariant_id\n20\t\tB\t2\tv1\n21\tA1K\tB\tx\tv2\n",
        "c/scores.tsv": "allele\tvariant_id\tVR_mutation\to2\nC\tv1\tWT\t30\n",
        "d_combined/scores.tsv": "allele\tvariant_id\tVR_mutation\to2\nD\tv1\tWT\t40\n",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(r.allele, r.variant_id): (r.VR_mutation, r.o1, r.o2) for r in read_scores(spark, [str(tmp_path)], ["o1", "o2"], "scores.tsv").collect()}
    assert got == {("A", "v1"): ("A1D", 1.0, 10.0), ("B", "v1"): ("WT", 2.0, 20.0), ("B", "v2"): ("A1K", None, 21.0), ("C", "v1"): ("WT", None, 30.0)}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.csv").write_text('a,b\n1,"two, ""three"""\n')
    (tmp_path / "t/y.csv").write_text("b,a\nfour,5\n")
    assert sorted((r.a, r.b) for r in read_table(spark, str(tmp_path / "t"), ["a"], ",").collect()) == [("1", 'two, "three"'), ("5", "four")]
    with pytest.raises(ValueError, match="no files"):
        read_scores(spark, [str(tmp_path)], ["o1"], "none.tsv")


def test_score_files(spark, tmp_path):
    scores, _ = model_scores(spark, 6)
    for a in "AB":
        write_table(scores.where(F.col("allele") == a).coalesce(1), str(tmp_path / f"run_{a}"), "tsv")
    back = read_scores(spark, [str(tmp_path)], ["o1", "o2", "o3"], "part-*")
    assert back.count() == 12 and back.where("o3 IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        read_scores(spark, [str(tmp_path)], ["o9"], "part-*")
    write_table(scores.where("allele = 'A'").coalesce(1), str(tmp_path / "again"), "tsv")
    with pytest.raises(ValueError, match="several"):
        read_scores(spark, [str(tmp_path)], ["o1"], "part-*")
    write_by_allele(scores, str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by/allele_label=A")).count() == 6
    write_models({"c": scores.withColumn("outcome", F.lit("o 1")), "s": scores}, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/c/allele_label=B/outcome_label=o_1")).count() == 6
