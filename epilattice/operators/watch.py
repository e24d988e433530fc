"""Guards and counts that ride along with the work: metrics of the same pass, judged after the action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .checks import EXAMPLES


class Watch:
    """Collects metrics of tables on their way and judges them once the work is done.

    A guard adds no job and no shuffle: it counts its rows, and keeps up to ten of them, where they pass. Nothing is
    known before an action over the watched table has ended; then judge() raises ValueError for what was forbidden, and
    report() gives the counts. A Watch serves one action.

        watch = Watch()
        scores = wt_scores_mhci(variants, wt, watch=watch)
        scores.write.parquet(path)
        watch.judge()
    """

    def __init__(self) -> None:
        self._guards: list[tuple[Observation, str]] = []
        self._reports: dict[str, Observation] = {}

    def forbid(self, df: DataFrame, condition: Column, message: str, show: Sequence[str]) -> DataFrame:
        """df, of which no row may satisfy the condition."""
        bad = F.coalesce(condition, F.lit(False))
        seen = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in show])
        # ten slots by hash, the first of each: examples of bounded size from any number of rows
        slot = F.pmod(F.xxhash64(seen), F.lit(EXAMPLES))
        kept = [F.min(F.when(bad & (slot == i), seen)).alias(f"e{i}") for i in range(EXAMPLES)]
        observation = Observation()
        self._guards.append((observation, message))
        return df.observe(observation, F.count_if(bad).alias("n"), *kept)

    def count(self, df: DataFrame, name: str, **metrics: Column) -> DataFrame:
        """df, with aggregates of its rows as a report."""
        self._reports[name] = Observation()
        return df.observe(self._reports[name], *[c.alias(k) for k, c in metrics.items()])

    def report(self, name: str) -> dict:
        return dict(self._reports[name].get)

    def judge(self) -> None:
        problems = []
        for observation, message in self._guards:
            found = observation.get
            if found.get("n"):
                examples = sorted(v for k, v in found.items() if k != "n" and v is not None)
                problems.append(f"{message}: {found['n']} rows, such as {examples}")
        if problems:
            raise ValueError("; ".join(problems))
