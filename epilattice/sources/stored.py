"""Fragment and prediction tables that lie ready for their join: bucketed by (peptide, k), with hot peptides apart."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_keys
from .settled import remove, shared_dir

KEYS = ["peptide", "k"]
#: Rows of hot peptides' predictions that are broadcast; beyond it they are shuffled.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Stored:
    """Tables of the catalogue: `name` in buckets by KEYS, and `name`_hot with the rows of the hot peptides as they
    came, so that no bucket holds one of them."""

    spark: SparkSession
    name: str
    path: str
    buckets: int
    hot: tuple[str, ...]

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    @property
    def hot_rows(self) -> DataFrame:
        return self.spark.table(f"{self.name}_hot")

    def all_rows(self) -> DataFrame:
        return self.rows.unionByName(self.hot_rows)

    def peptides(self) -> DataFrame:
        """(peptide, k, occurrence_count): counted where the buckets lie; only hot peptides' partial counts are shuffled."""
        count = lambda df: df.groupBy(*KEYS).agg(F.count("*").alias("occurrence_count"))
        return count(self.rows).unionByName(count(self.hot_rows))

    def drop(self) -> None:
        for name in (self.name, f"{self.name}_hot"):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.path)


def _bucketed(df: DataFrame, name: str, path: str, buckets: int) -> None:
    # dealt like the buckets, so that each is one file
    df.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)


def store(df: DataFrame, buckets: int, name: str | None = None, hot: Sequence[str] | None = None) -> Stored:
    """df(peptide, k, ...) written for joins by peptide and k, in the shared folder.

    Two tables in as many buckets are joined without a shuffle. Peptides with more than an eighth of a bucket's share
    are hot, and lie apart; `hot` takes another table's, for one that is to be joined with it.
    """
    spark = df.sparkSession
    name = name or f"stored_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    if hot is None:
        hot = sorted(hot_keys(df, "peptide", buckets))
    is_hot = F.coalesce(F.col("peptide").isin(*hot), F.lit(False)) if hot else F.lit(False)
    _bucketed(df.where(~is_hot), name, f"{path}/cold", buckets)
    df.where(is_hot).write.option("path", f"{path}/hot").option("compression", "zstd").format("parquet").saveAsTable(f"{name}_hot")
    return Stored(spark, name, path, buckets, tuple(hot))
