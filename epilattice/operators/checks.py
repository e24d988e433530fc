"""Guards: each runs one small job and raises ValueError with at most ten examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 10


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def _raise_if_any(bad: DataFrame, message: str) -> None:
    rows = bad.limit(EXAMPLES).collect()
    if rows:
        raise ValueError(f"{message}: {[tuple(r) for r in rows]}")


def forbid(df: DataFrame, condition: Column, message: str, show: Sequence[str]) -> DataFrame:
    """No row may satisfy the condition."""
    _raise_if_any(df.where(condition).select(*show), message)
    return df


def unique_keys(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """Keys occur once each; null keys count as equal."""
    _raise_if_any(df.groupBy(*keys).count().where("count > 1"), f"{what} has duplicate keys {list(keys)}")
    return df


def all_matched(left: DataFrame, right: DataFrame, keys: Sequence[str], message: str) -> None:
    """Every left row finds a right one."""
    _raise_if_any(left.join(right, list(keys), "left_anti").select(*keys), message)


def one_mutation(df: DataFrame, groups: Sequence[str], column: str = "VR_mutation") -> DataFrame:
    _raise_if_any(
        df.groupBy(*groups).agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a <> b"), f"groups with several {column} annotations"
    )
    return df


def check_alleles(predictions: DataFrame, requested: Sequence[str], missing: bool = True, unexpected: bool = True) -> None:
    """Requested and observed alleles agree; each direction can be waived. The message names 100 unexpected ones at most."""
    wanted = set(requested)
    seen, asked = predictions.select("allele").distinct(), F.coalesce(F.col("allele").isin(*wanted), F.lit(False))
    problems = []
    if unexpected and (other := [r[0] for r in seen.where(~asked).limit(100).collect()]):
        problems.append(f"unexpected alleles {sorted(map(str, other))}")
    if missing and (absent := wanted - {r[0] for r in seen.where(asked).collect()}):
        problems.append(f"missing alleles {sorted(absent)}")
    if problems:
        raise ValueError("; ".join(problems))
