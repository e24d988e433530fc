"""Least squares of mutation effects on residue chemistry and position, with inference, for each outcome."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CONTINUOUS = ["hydrophobicity_change", "volume_change", "charge_change"]
PREDICTORS = {"hydrophobicity_change": "Hydrophobicity", "volume_change": "Residue volume", "charge_change": "Charge"}


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d)
            c = 1 + top / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_p_value(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p > 0.5, by bisection."""
    low, high = 0.0, 1.0
    while 1 - t_p_value(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_p_value(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def design(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[str], list[int], pd.DataFrame]:
    """Constant, the three changes and an indicator for each position but the smallest."""
    data = group.dropna(subset=["median_allele_coefficient", *CONTINUOUS]).sort_values("mutation")
    position = data["position_relative"].astype(int)
    positions = sorted(position.unique().tolist())
    columns = [np.ones(len(data)), *(data[c].to_numpy(float) for c in CONTINUOUS), *((position == p).to_numpy(float) for p in positions[1:])]
    names = ["const", *CONTINUOUS, *(f"position_{p}" for p in positions[1:])]
    return np.column_stack(columns), data["median_allele_coefficient"].to_numpy(float), names, positions, data


def _sse(x: np.ndarray, y: np.ndarray) -> float:
    beta = np.linalg.pinv(x) @ y
    return float(np.sum((y - x @ beta) ** 2))


def _fit(group: pd.DataFrame):
    x, y, names, positions, data = design(group)
    n, p = x.shape
    if n <= p:
        raise ValueError(f"{group['outcome'].iloc[0]}: {n} mutations for {p} parameters; more mutations or alleles are needed")
    beta = np.linalg.pinv(x) @ y
    rank = int(np.linalg.matrix_rank(x))
    sse = float(np.sum((y - x @ beta) ** 2))
    free = n - rank
    covariance = np.linalg.pinv(x.T @ x) * sse / free
    return x, y, names, positions, data, beta, rank, sse, free, covariance


def _model(group: pd.DataFrame) -> pd.DataFrame:
    x, y, names, positions, _, _, rank, sse, free, _ = _fit(group)
    n, tss = len(y), float(np.sum((y - y.mean()) ** 2))
    r2 = 1 - sse / tss if tss else float("nan")
    log_l = -n / 2 * (math.log(2 * math.pi * sse / n) + 1) if sse > 0 else float("inf")
    row = [group["outcome"].iloc[0], n, len(positions), r2, 1 - (1 - r2) * (n - 1) / free, -2 * log_l + 2 * rank, -2 * log_l + math.log(n) * rank]
    return pd.DataFrame([row], columns=["outcome", "n_mutations", "n_positions", "r_squared", "adjusted_r_squared", "aic", "bic"])


def _coefficients(group: pd.DataFrame) -> pd.DataFrame:
    _, _, names, _, _, beta, _, _, free, covariance = _fit(group)
    half = t_quantile(0.975, free)
    rows = []
    for k, name in enumerate(names):
        se = math.sqrt(max(covariance[k, k], 0))
        p = t_p_value(beta[k] / se, free) if se else float("nan")
        rows.append((group["outcome"].iloc[0], name, beta[k], se, p, beta[k] - half * se, beta[k] + half * se))
    return pd.DataFrame(rows, columns=["outcome", "term", "coefficient", "standard_error", "p_value", "ci_low", "ci_high"])


def _partial(group: pd.DataFrame) -> pd.DataFrame:
    x, y, names, _, _, _, _, sse, _, _ = _fit(group)
    groups = {label: [names.index(c)] for c, label in PREDICTORS.items()}
    groups["Position"] = [k for k, name in enumerate(names) if name.startswith("position_")]
    rows = []
    for label, drop in groups.items():
        if drop:
            reduced = _sse(np.delete(x, drop, axis=1), y)
            rows.append((group["outcome"].iloc[0], label, (reduced - sse) / reduced if reduced else float("nan"), sse, reduced, len(drop)))
    return pd.DataFrame(rows, columns=["outcome", "predictor", "partial_r_squared", "full_model_sse", "reduced_model_sse", "degrees_of_freedom"])


def _positions(group: pd.DataFrame) -> pd.DataFrame:
    _, _, names, positions, data, beta, _, _, _, covariance = _fit(group)
    contrasts = np.zeros((len(positions), len(names)))
    contrasts[:, 0] = 1
    for i, p in enumerate(positions):
        if f"position_{p}" in names:
            contrasts[i, names.index(f"position_{p}")] = 1
    contrasts -= contrasts.mean(axis=0)
    rows = []
    for p, c in zip(positions, contrasts, strict=True):
        effect, half = float(c @ beta), 1.96 * math.sqrt(max(float(c @ covariance @ c), 0))
        absolute = int(data.loc[data["position_relative"].astype(int) == p, "position_absolute"].iloc[0])
        rows.append((group["outcome"].iloc[0], p, absolute, effect, effect - half, effect + half))
    return pd.DataFrame(rows, columns=["outcome", "position_relative", "position_absolute", "adjusted_position_effect", "ci_low", "ci_high"])


def physicochemical_models(effects: DataFrame) -> dict[str, DataFrame]:
    """From mutation_effects: tables `models`, `coefficients`, `partial_r_squared` and `positions`.

    A group is one outcome; its rows are mutations of one region, at most 20 for each position. An outcome with no
    more rows than parameters raises ValueError.
    """
    by = effects.groupBy("outcome")
    return {
        "models": by.applyInPandas(_model, "outcome string, n_mutations long, n_positions long, r_squared double, adjusted_r_squared double, aic double, bic double"),
        "coefficients": by.applyInPandas(_coefficients, "outcome string, term string, coefficient double, standard_error double, p_value double, ci_low double, ci_high double"),
        "partial_r_squared": by.applyInPandas(_partial, "outcome string, predictor string, partial_r_squared double, full_model_sse double, reduced_model_sse double, degrees_of_freedom long"),
        "positions": by.applyInPandas(_positions, "outcome string, position_relative long, position_absolute long, adjusted_position_effect double, ci_low double, ci_high double"),
    }
