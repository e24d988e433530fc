"""Effects of mutations on scores: recurrence, least squares with bootstrap, summaries over alleles, chemistry."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import filled_mutation, mutation_list
from ..sources.settled import settle
from .bootstrap import replicate_sums, replicate_totals
from .checks import forbid, require_columns
from .tall import least_squares

OUTCOMES = ["netMHCpan_net_pass_change", "MHCflurry_net_pass_change", "netMHCpan_mean_window_improvement", "MHCflurry_mean_window_improvement"]

#: Variants that must have a mutation for it to be modelled.
MIN_COUNT = 20

# Kyte-Doolittle hydrophobicity, residue volumes in cubic angstroms (Zamyatnin), pKa of side chains (Bjellqvist).
HYDROPHOBICITY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
VOLUME = {
    "A": 88.6, "C": 108.5, "D": 111.1, "E": 138.4, "F": 189.9, "G": 60.1, "H": 153.2, "I": 166.7, "K": 168.6, "L": 166.7,
    "M": 162.9, "N": 114.1, "P": 112.7, "Q": 143.8, "R": 173.4, "S": 89.0, "T": 116.1, "V": 140.0, "W": 227.8, "Y": 193.6,
}
POSITIVE_PKA = {"H": 5.98, "K": 10.0, "R": 12.0}
NEGATIVE_PKA = {"C": 9.0, "D": 4.05, "E": 4.45, "Y": 10.0}
PH = 7.4


def side_chain_charge(residue: str) -> float:
    """Henderson-Hasselbalch charge at pH 7.4."""
    if residue in POSITIVE_PKA:
        return 1 / (1 + 10 ** (PH - POSITIVE_PKA[residue]))
    if residue in NEGATIVE_PKA:
        return -1 / (1 + 10 ** (NEGATIVE_PKA[residue] - PH))
    return 0.0


def _scale(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def unpivot_outcomes(scores: DataFrame, outcomes: Sequence[str] = OUTCOMES) -> DataFrame:
    """(allele, variant_id, VR_mutation, outcome, value); the first row of each allele and variant counts."""
    require_columns(scores, ["allele", "variant_id", "VR_mutation", *outcomes], "score table")
    first = scores.groupBy("allele", "variant_id").agg(F.min(F.struct("VR_mutation", *outcomes)).alias("r")).select("allele", "variant_id", "r.*")
    values = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("value")) for o in outcomes])
    rows = first.select("allele", "variant_id", filled_mutation(F.col("VR_mutation")).alias("VR_mutation"), F.explode(values).alias("o"))
    return rows.select("allele", "variant_id", "VR_mutation", "o.outcome", F.when(~F.isnan("o.value"), F.col("o.value")).alias("value"))


def mutation_rows(scores: DataFrame) -> DataFrame:
    """(allele, variant_id, mutation): the one-hot design in long form."""
    first = scores.groupBy("allele", "variant_id").agg(F.min("VR_mutation").alias("VR_mutation"))
    return first.select("allele", "variant_id", F.explode(mutation_list(F.col("VR_mutation"))).alias("mutation"))


def recurrent_mutations(scores: DataFrame, min_count: int = MIN_COUNT, validate: bool = False) -> DataFrame:
    """(allele, mutation, n_variants_with_mutation) for mutations in at least min_count variants, whatever their scores."""
    out = mutation_rows(scores).groupBy("allele", "mutation").agg(F.count("*").alias("n_variants_with_mutation")).where(F.col("n_variants_with_mutation") >= min_count)
    if validate and out.isEmpty():
        raise ValueError(f"no mutation occurs in {min_count} variants")
    return out


def parsed_mutations(df: DataFrame, wt_sequence: str, offset: int = 0, validate: bool = False) -> DataFrame:
    """df(mutation, ...) with wt_aa, mutant_aa, position_relative, position_absolute and the three property changes.

    validate raises for labels that are malformed, outside the sequence, in conflict with it, or of a mutant that is
    no standard residue; without it their columns are null.
    """
    label = F.upper("mutation")
    part = lambda k: F.regexp_extract(label, r"^([A-Z])([0-9]+)([A-Z*])$", k)
    position = part(2).try_cast("int")
    inside = position.between(1, len(wt_sequence))
    ok = inside & (F.substring(F.lit(wt_sequence), F.coalesce(position, F.lit(1)), F.lit(1)) == part(1)) & part(3).isin(*HYDROPHOBICITY)
    ok = F.coalesce(ok, F.lit(False))
    if validate:
        forbid(df, ~ok, f"mutations that do not fit {wt_sequence}", ["mutation"])
    change = lambda scale: F.when(ok, _scale(scale)[part(3)] - _scale(scale)[part(1)])
    charge = {x: side_chain_charge(x) for x in HYDROPHOBICITY}
    return df.withColumns({
        "wt_aa": F.when(ok, part(1)), "mutant_aa": F.when(ok, part(3)), "position_relative": F.when(ok, position), "position_absolute": F.when(ok, position + offset),
        "hydrophobicity_change": change(HYDROPHOBICITY), "volume_change": change(VOLUME), "charge_change": change(charge),
    })


#: Variants of one bitmap, about; a bitmap holds 32,768.
BITMAP_ROWS = 1 << 14


def mutation_bitmaps(scores: DataFrame, outcomes: Sequence[str] = OUTCOMES) -> DataFrame:
    """(allele, bucket, kind, name, bits): the one-hot design by columns. bits is a bitmap over the variants of a bucket;
    kind m is a mutation's, '' being all variants, kind o that of the variants that have a score of an outcome.

    Variants are numbered inside hashed buckets, so a number needs no pass over the whole table, and an allele's
    bitmaps are as dense as its mutations are frequent.
    """
    first = scores.groupBy("allele", "variant_id").agg(F.min(F.struct("VR_mutation", *outcomes)).alias("r")).select("allele", "variant_id", "r.*")
    sizes = first.groupBy("allele").agg(F.ceil(F.count("*") / F.lit(BITMAP_ROWS)).cast("int").alias("_buckets"))
    placed = first.join(sizes, "allele").withColumn("bucket", F.pmod(F.xxhash64("variant_id"), F.col("_buckets")).cast("int"))
    place = F.row_number().over(W.partitionBy("allele", "bucket").orderBy("variant_id"))
    has = lambda o: F.col(o).isNotNull() & ~F.isnan(F.col(o).cast("double"))
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    columns = F.transform(F.concat(F.array(F.lit("")), mutation_list(F.col("VR_mutation"))), lambda m: entry("m", m))
    masks = F.filter(F.array(*[F.when(has(o), entry("o", F.lit(o))) for o in outcomes]), lambda e: e.isNotNull())
    # numbered first: beside a generator, a window would number what is generated
    each = placed.withColumn("_at", place - 1).select("allele", "bucket", "_at", F.explode(F.concat(columns, masks)).alias("e"))
    return each.groupBy("allele", "bucket", "e.kind", "e.name").agg(F.bitmap_construct_agg("_at").alias("bits"))


def mutation_gram(scores: DataFrame, outcomes: Sequence[str] = OUTCOMES, min_count: int = MIN_COUNT) -> DataFrame:
    """Normal equations of score ~ 1 + mutations, in long form: (allele, outcome, a, b, xtx, xty).

    a and b run over the recurrent mutations and '' for the constant; a row holds the sum of both indicators'
    product over variants with a score, and, where b is '', that of a's indicator and the score. Pairs that no variant
    has are left out. Products are counts of the bits that two mutations' bitmaps and the outcome's have in common, so
    the rows grow with the mutations squared for each bitmap of some thousand variants, not with the variants' pairs.
    """
    scores = _settled(scores, outcomes)
    bitmaps = settle(mutation_bitmaps(scores, outcomes))
    counts = bitmaps.where("kind = 'm'").groupBy("allele", "name").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    keep = counts.where((F.col("n") >= min_count) | (F.col("name") == "")).select("allele", "name")
    used = bitmaps.where("kind = 'm'").join(keep, ["allele", "name"]).unionByName(bitmaps.where("kind = 'o'"))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        names, bits = {}, {}
        for kind, own in pdf.groupby("kind"):
            names[kind] = own["name"].to_numpy(object)
            bits[kind] = np.frombuffer(b"".join(own["bits"]), np.uint64).reshape(len(own), -1)
        out = []
        for outcome, mask in zip(names.get("o", []), bits.get("o", []), strict=True):
            masked = bits["m"] & mask
            i, j = np.triu_indices(len(masked))
            n = np.concatenate([np.bitwise_count(masked[k] & masked[k:]).sum(1, dtype=np.int64) for k in range(len(masked))])
            i, j, n = i[n > 0], j[n > 0], n[n > 0]
            off = i != j
            both = [np.r_[i, j[off]], np.r_[j, i[off]], np.r_[n, n[off]]]
            out.append(pd.DataFrame({"outcome": outcome, "a": names["m"][both[0]], "b": names["m"][both[1]], "xtx": both[2]}))
        out = pd.concat(out) if out else pd.DataFrame({"outcome": [], "a": [], "b": [], "xtx": []})
        out.insert(0, "allele", pdf["allele"].iloc[0])
        return out

    each = used.groupBy("allele", "bucket").applyInPandas(products, "allele string, outcome string, a string, b string, xtx long")
    xtx = each.groupBy("allele", "outcome", "a", "b").agg(F.sum("xtx").alias("xtx"))
    y = unpivot_outcomes(scores, outcomes).where("value IS NOT NULL")
    own = F.explode(F.concat(F.array(F.lit("")), mutation_list(F.col("VR_mutation")))).alias("a")
    xty = y.select("allele", "outcome", "value", own).groupBy("allele", "outcome", "a").agg(F.sum("value").alias("xty"))
    return xtx.join(xty, ["allele", "outcome", "a"], "left").select("allele", "outcome", "a", "b", "xtx", F.when(F.col("b") == "", F.col("xty")).alias("xty"))


def _solve(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Least-norm solutions of stacked normal equations."""
    return (np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ rhs[..., None])[..., 0]


def design_rows(scores: DataFrame, outcomes: Sequence[str] = OUTCOMES, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(rows, names) of the models: rows(allele, outcome, variant_id, y, at, p) for each score that is there, `at`
    being the numbers, from 1, of the recurrent mutations that the variant has, and p their number in all plus 1 for the
    constant; names(allele, names) has the mutations of an allele in order.

    Both are settled, a row for each variant: models read them several times."""
    require_columns(scores, ["allele", "variant_id", "VR_mutation", *outcomes], "score table")
    names = settle(recurrent_mutations(scores, min_count).groupBy("allele").agg(F.sort_array(F.collect_list("mutation")).alias("names")))
    numbers = names.select("allele", F.posexplode("names").alias("_i", "mutation"))
    # a row for each variant, as of unpivot_outcomes and of mutation_rows: numbers meet it before outcomes repeat it
    first = scores.groupBy("allele", "variant_id").agg(F.min("VR_mutation").alias("_m"), F.min(F.struct("VR_mutation", *outcomes)).alias("r"))
    labels = first.select("allele", "variant_id", F.explode(mutation_list(F.col("_m"))).alias("mutation"))
    own = labels.join(numbers, ["allele", "mutation"]).groupBy("allele", "variant_id").agg(F.sort_array(F.collect_list(F.col("_i") + 1)).alias("at"))
    values = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"r.{o}").cast("double").alias("value")) for o in outcomes])
    wide = first.select("allele", "variant_id", values.alias("values")).join(own, ["allele", "variant_id"], "left").join(names.select("allele", (F.size("names") + 1).alias("p")), "allele", "left")
    rows = settle(wide).select("allele", "variant_id", "at", "p", F.explode("values").alias("o")).where("o.value IS NOT NULL AND NOT isnan(o.value)")
    return rows.select(
        "allele", "o.outcome", "variant_id", F.col("o.value").alias("y"), F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("p", F.lit(1)).alias("p")
    ), names


def _settled(scores: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """The scores of a whole screen stand behind a model: they are written once and read several times."""
    columns = ["allele", "variant_id", "VR_mutation", *outcomes]
    return settle(require_columns(scores, columns, "score table").select(*columns))


def mutation_ols(scores: DataFrame, outcomes: Sequence[str] = OUTCOMES, min_count: int = MIN_COUNT, constant: bool = False) -> tuple[DataFrame, DataFrame]:
    """(coefficients, fits) of score ~ 1 + mutations for each allele and outcome, of least norm where mutations are
    collinear; `constant` adds the constant's row, with '' as mutation.

    Each task factorises its own rows and the factors are merged in a tree, so only matrices of mutations by mutations
    are shuffled, and rank and solution have the precision of the design itself."""
    return _ols(*design_rows(_settled(scores, outcomes), outcomes, min_count), constant)


def _ols(rows: DataFrame, names: DataFrame, constant: bool = False) -> tuple[DataFrame, DataFrame]:
    totals = rows.groupBy("allele", "outcome").agg((F.var_pop("y") * F.count("*")).alias("tss"))
    at = F.concat(F.array(F.lit(0)), F.col("at"))
    found = least_squares(rows.select("allele", "outcome", at.alias("at"), F.transform(at, lambda _: F.lit(1.0)).alias("x"), "p", "y"), ["allele", "outcome"])
    found = settle(found.join(totals, ["allele", "outcome"]).join(names, "allele", "left"))
    labels = F.concat(F.array(F.lit("")), F.coalesce("names", F.array().cast("array<string>")))
    each = found.select("allele", "outcome", F.explode(F.arrays_zip(labels.alias("mutation"), F.col("coefficients").alias("c"))).alias("e"))
    coefficients = each.select("allele", "outcome", "e.mutation", F.col("e.c").alias("full_data_coefficient"))
    fits = found.select(
        "allele", "outcome", F.col("n").alias("n_variants"), (F.col("p") - 1).cast("long").alias("n_mutations"), F.col("rank").cast("long").alias("rank"),
        F.col("p").cast("long").alias("design_columns"), F.when(F.col("tss") > 0, 1 - F.col("rss") / F.col("tss")).otherwise(F.lit(float("nan"))).alias("r_squared"),
    )
    return coefficients if constant else coefficients.where("mutation <> ''"), fits


def model_residuals(scores: DataFrame, outcomes: Sequence[str] = OUTCOMES, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(equations, fits): whether the models are least squares. equations(allele, outcome, mutation, n_variants, residual)
    has the sum of the residuals of the variants with a mutation, '' being all; at the least squares each is 0.
    fits is that of mutation_ols with tss, rss (of the residuals themselves) and gap, rss less what r_squared says."""
    rows, names = design_rows(_settled(scores, outcomes), outcomes, min_count)
    coefficients, fits = _ols(rows, names, constant=True)
    columns = rows.withColumn("at", F.concat(F.array(F.lit(0)), "at"))
    numbered = names.select("allele", F.posexplode(F.concat(F.array(F.lit("")), "names")).alias("_i", "mutation"))
    # alleles without recurrent mutations have the constant alone
    beta = coefficients.join(numbered, ["allele", "mutation"], "left").groupBy("allele", "outcome").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_i", F.lit(0)).alias("i"), F.col("full_data_coefficient").alias("c"), "mutation"))).alias("b"))
    fitted = F.aggregate("at", F.lit(0.0), lambda a, i: a + F.element_at("b", i + 1)["c"])
    left = columns.join(beta, ["allele", "outcome"]).withColumn("_e", F.col("y") - fitted)
    equations = left.select("allele", "outcome", "_e", F.explode(F.transform("at", lambda i: F.element_at("b", i + 1)["mutation"])).alias("mutation"))
    equations = equations.groupBy("allele", "outcome", "mutation").agg(F.count("*").alias("n_variants"), F.sum("_e").alias("residual"))
    sums = left.groupBy("allele", "outcome").agg((F.var_pop("y") * F.count("*")).alias("tss"), F.sum(F.col("_e") * F.col("_e")).alias("rss"))
    return equations, fits.join(sums, ["allele", "outcome"]).withColumn("gap", F.col("rss") - (1 - F.col("r_squared")) * F.col("tss"))


def mutation_bootstrap(scores: DataFrame, outcomes: Sequence[str] = OUTCOMES, min_count: int = MIN_COUNT, bootstraps: int = 500, seed: int = 1,
                       design: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(allele, outcome, mutation, replicate, coefficient): refits on as many variants as there are, drawn with
    replacement, the same on any partitioning (up to the order of floating-point sums). A mutation that a replicate
    didn't draw has 0. design is what design_rows gave for the same scores, if that is there already."""
    rows, names = design or design_rows(_settled(scores, outcomes), outcomes, min_count)
    sums = replicate_sums(rows, bootstraps, seed).join(names, "allele")

    def solve(frames):
        for pdf in frames:
            for one in pdf.itertuples():
                p = one.p
                i, j = np.triu_indices(p)
                packed = np.frombuffer(one.g).reshape(-1, len(i))
                gram = np.zeros((len(packed), p, p))
                gram[:, i, j] = gram[:, j, i] = packed
                beta = _solve(gram, np.frombuffer(one.r).reshape(-1, p))[:, 1:]
                yield pd.DataFrame({
                    "allele": one.allele, "outcome": one.outcome, "mutation": list(one.names) * len(beta),
                    "replicate": np.repeat(np.arange(len(beta)) + one.first, p - 1), "coefficient": beta.reshape(-1),
                })

    return sums.mapInPandas(solve, "allele string, outcome string, mutation string, replicate int, coefficient double")


def bootstrap_totals(scores: DataFrame, outcomes: Sequence[str] = OUTCOMES, bootstraps: int = 500, seed: int = 1) -> DataFrame:
    """(allele, outcome, replicate, n_rows, n_drawn, n_left_out) of the bootstrap's replicates."""
    y = unpivot_outcomes(_settled(scores, outcomes), outcomes).where("value IS NOT NULL")
    rows = y.select("allele", "outcome", "variant_id", F.col("value").alias("y"), F.array().cast("array<int>").alias("at"), F.lit(1).alias("p"))
    return replicate_totals(rows, bootstraps, seed)


def mutation_coefficients(scores: DataFrame, wt_sequence: str, offset: int = 0, outcomes: Sequence[str] = OUTCOMES, min_count: int = MIN_COUNT, bootstraps: int = 500,
                          seed: int = 1, validate: bool = False) -> tuple[DataFrame, DataFrame]:
    """(coefficients, fits): each mutation's effect with bootstrap mean, 95 % interval and sign stability."""
    scores = _settled(scores, outcomes)
    counts = parsed_mutations(recurrent_mutations(scores, min_count, validate), wt_sequence, offset, validate)
    design = design_rows(scores, outcomes, min_count)
    full, fits = _ols(*design)
    draws = mutation_bootstrap(scores, outcomes, min_count, bootstraps, seed, design)
    mean = F.avg("coefficient")
    summary = draws.groupBy("allele", "outcome", "mutation").agg(
        mean.alias("bootstrap_mean_coefficient"), F.percentile("coefficient", 0.025).alias("ci_low"), F.percentile("coefficient", 0.975).alias("ci_high"),
        F.avg((F.col("coefficient") > 0).cast("int")).alias("_up"), F.avg((F.col("coefficient") < 0).cast("int")).alias("_down"),
    ).withColumn("sign_stability", F.when(F.col("bootstrap_mean_coefficient") >= 0, F.col("_up")).otherwise(F.col("_down"))).drop("_up", "_down")
    out = full.join(summary, ["allele", "outcome", "mutation"]).join(counts, ["allele", "mutation"])
    return out.select(
        "allele", "outcome", "mutation", "wt_aa", "mutant_aa", "position_relative", "position_absolute", "hydrophobicity_change", "volume_change", "charge_change",
        "n_variants_with_mutation", "full_data_coefficient", "bootstrap_mean_coefficient", "ci_low", "ci_high", "sign_stability",
    ), fits


def allele_summary(coefficients: DataFrame) -> DataFrame:
    """One row for each outcome and mutation: quartiles over alleles, signs, and how far alleles agree in sign."""
    c = F.col("full_data_coefficient")
    out = coefficients.groupBy("outcome", "mutation").agg(
        F.percentile("full_data_coefficient", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("full_data_coefficient").alias("n_alleles"),
        F.count_if(c < 0).alias("n_negative"), F.count_if(c == 0).alias("n_zero"), F.count_if(c > 0).alias("n_positive"),
    )
    return out.select(
        "outcome", "mutation", F.col("q")[1].alias("median_coefficient"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("allele_iqr"),
        "n_alleles", "n_negative", "n_zero", "n_positive",
        F.try_divide(F.greatest("n_negative", "n_zero", "n_positive"), F.col("n_alleles")).alias("sign_agreement"),
    )


def top_iqr(summary: DataFrame, n: int = 5) -> DataFrame:
    """The mutations whose effect differs most between alleles, n for each outcome."""
    place = F.row_number().over(W.partitionBy("outcome").orderBy(F.desc_nulls_last("allele_iqr"), "mutation"))
    return summary.withColumn("rank", place).where(F.col("rank") <= n).select("outcome", "rank", "mutation", "allele_iqr")


def allele_pivot(coefficients: DataFrame, alleles: Sequence[str]) -> DataFrame:
    """Mutations by alleles, for the edge of a pipeline: alleles are listed, so no job looks for them."""
    return coefficients.groupBy("outcome", "mutation").pivot("allele", list(alleles)).agg(F.avg("full_data_coefficient"))


#: Alleles and mutations of one block of the matrix of effects.
ALLELE_BLOCK, MUTATION_BLOCK = 128, 2048


def _moments(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the effects of each two alleles, one of block _i and one of block _j, have in common: products of their
    matrices of mutations by alleles, zeros for what is missing, and of those that say what is there."""
    i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
    row, names = pd.factorize(pdf["mutation"])
    sides = []
    for block in (i, j):
        own = (pdf["_a"] == block).to_numpy()
        column, alleles = pd.factorize(pdf["allele"][own], sort=True)
        x, there = np.zeros((len(names), len(alleles))), np.zeros((len(names), len(alleles)))
        x[row[own], column], there[row[own], column] = pdf["x"][own], 1
        sides.append((np.asarray(alleles, object), x, there))
    (a, xa, ia), (b, xb, ib) = sides
    found = {"n": ia.T @ ib, "sx": xa.T @ ib, "sy": ia.T @ xb, "sxy": xa.T @ xb, "sxx": (xa * xa).T @ ib, "syy": ia.T @ (xb * xb)}
    some = found["n"] > 0
    if i == j:
        some &= np.triu(np.ones_like(some))
    k, m = np.nonzero(some)
    out = pd.DataFrame({"allele_a": a[k], "allele_b": b[m]} | {c: v[k, m] for c, v in found.items()})
    out.insert(0, "outcome", pdf["outcome"].iloc[0])
    return out


def allele_correlation(coefficients: DataFrame, least: int = 3) -> DataFrame:
    """Pearson correlation of each two alleles' effects over common mutations; null below `least` or without variance.

    The matrix of effects is cut into blocks of alleles and mutations; each two blocks of alleles meet once, by matrix
    products, so an effect is repeated for each block of alleles, not for each allele.
    """
    one = coefficients.groupBy("outcome", "allele", "mutation").agg(F.avg("full_data_coefficient").alias("x")).where("x IS NOT NULL")
    # shifting by the outcome's mean keeps the moments from cancelling
    one = one.join(one.groupBy("outcome").agg(F.avg("x").alias("_m")), "outcome").withColumn("x", F.col("x") - F.col("_m")).drop("_m")
    n = one.agg(F.count_distinct("allele").alias("a"), F.count_distinct("mutation").alias("m")).first()
    blocks, rows = (max(1, -(-k // most)) for k, most in ((n.a, ALLELE_BLOCK), (n.m, MUTATION_BLOCK)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    cells = one.withColumns({"_a": block("allele", blocks), "_r": block("mutation", rows)}).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.withColumns({"_i": F.least("_a", "_b"), "_j": F.greatest("_a", "_b")}).drop("_b")
    names = ["n", "sx", "sy", "sxy", "sxx", "syy"]
    parts = cells.groupBy("outcome", "_i", "_j", "_r").applyInPandas(_moments, "outcome string, allele_a string, allele_b string, " + ", ".join(f"{c} double" for c in names))
    s = parts.groupBy("outcome", "allele_a", "allele_b").agg(*[F.sum(c).alias(c) for c in names])
    # the other triangle
    kept, turned = ["allele_a", "allele_b", *names], ["allele_b", "allele_a", "n", "sy", "sx", "sxy", "syy", "sxx"]
    both = [F.struct(*[F.col(c).alias(k) for k, c in zip(kept, order, strict=True)]) for order in (kept, turned)]
    s = s.select("outcome", F.explode(F.when(F.col("allele_a") == F.col("allele_b"), F.array(both[0])).otherwise(F.array(*both))).alias("s")).select("outcome", "s.*")
    s = s.withColumn("n", F.col("n").cast("long"))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    level = lambda v, ss: v > 1e-12 * F.col("n") * F.greatest(F.col(ss), F.lit(1e-300))
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(F.when(level(vx, "sxx"), vx)) * F.sqrt(F.when(level(vy, "syy"), vy)))
    return s.select("outcome", "allele_a", "allele_b", F.col("n").alias("n_common"), F.when((F.col("n") >= least) & r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("pearson_r"))


EFFECT_KEYS = ["outcome", "mutation", "wt_aa", "mutant_aa", "position_relative", "position_absolute", "hydrophobicity_change", "volume_change", "charge_change"]


def mutation_effects(coefficients: DataFrame, min_sign_stability: float = 0.8) -> DataFrame:
    """One row for each outcome and mutation: quartiles over alleles, and how many alleles support a stable sign."""
    out = coefficients.groupBy(*EFFECT_KEYS).agg(
        F.percentile("full_data_coefficient", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count_distinct("allele").alias("n_alleles"),
        F.count_if(F.col("sign_stability") >= min_sign_stability).alias("n_supported_alleles"),
    )
    return out.select(
        *EFFECT_KEYS, F.col("q")[1].alias("median_allele_coefficient"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("allele_iqr"),
        "n_alleles", "n_supported_alleles", (F.col("n_supported_alleles") / F.col("n_alleles")).alias("support_fraction"),
    )


def heatmap_cells(coefficients: DataFrame, min_sign_stability: float = 0.8) -> DataFrame:
    """What a heatmap of one allele and outcome shows: effect and whether it is stable, by mutant and position."""
    return coefficients.select(
        "allele", "outcome", "mutant_aa", "position_relative", F.col("full_data_coefficient").alias("effect"), (F.col("sign_stability") >= min_sign_stability).alias("stable")
    )
