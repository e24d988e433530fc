"""A store of predictor scores that grows: only (peptide, allele) pairs that it hasn't seen are scored."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .settled import discard, settle

KEYS = ["peptide", "allele"]


class ScoreStore:
    """Batches of scored pairs in a folder, and a manifest that says which of them count.

    A run writes its batch into a folder of its own and then commits it: an entry of the manifest, numbered on from the
    last, is put in place by a rename that fails where another run was first. What a killed run has left behind is in
    no manifest, so nothing is lost or read twice, and the next run scores those pairs again; vacuum() removes it. A
    run that was overtaken drops the pairs that the other one has committed meanwhile, and commits the rest.

    Pairs for which the predictor gives no row are remembered, so that they aren't asked again. Batches are partitioned
    by allele; only those of the alleles asked for are read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        """schema names the score columns, such as "netMHCpan_EL_score double, netMHCpan_EL_rank double"."""
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = StructType.fromDDL(f"peptide string, {schema}, _found boolean, batch string, allele string")
        self.scores = [c for c in self.schema.names if c not in (*KEYS, "_found", "batch")]
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        self._fs = self._at("x").getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _found(self, *pattern: str):
        return [s.getPath() for s in self._fs.globStatus(self._at(*pattern)) or []]

    def versions(self) -> dict[str, int]:
        """batch -> number of its commit. An entry of the manifest is a folder, its number, that names the batch."""
        return {p.getName(): int(p.getParent().getName()) for p in self._found("manifest", "*", "*")}

    def _rows(self, alleles: list[str] | None = None) -> DataFrame:
        batches = [str(self._at("batches", f"batch={b}")) for b in self.versions()]
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", str(self._at("batches"))).parquet(*batches)
        return rows if alleles is None else rows.where(F.col("allele").isin(*alleles))

    def read(self, alleles: list[str] | None = None) -> DataFrame:
        """(peptide, allele, scores..., version): what is committed now, and by which commit each pair came."""
        versions = self.spark.createDataFrame(list(self.versions().items()), "batch string, version int")
        return self._rows(alleles).where("_found").join(F.broadcast(versions), "batch").select(*KEYS, *self.scores, "version")

    def missing(self, pairs: DataFrame, alleles: list[str] | None = None) -> DataFrame:
        """The distinct pairs that the store hasn't seen."""
        return pairs.select(*KEYS).distinct().join(self._rows(alleles).select(*KEYS), KEYS, "left_anti")

    def update(self, pairs: DataFrame, scorer: Callable[[DataFrame], DataFrame], alleles: list[str] | None = None) -> int:
        """Scores the pairs that are missing and commits them; returns how many there were.

        scorer takes a table of pairs and gives their scores, with peptide and allele. alleles, if the caller knows
        them, are those of the pairs. Pairs without peptide or allele are ignored.
        """
        new = settle(self.missing(pairs.where("peptide IS NOT NULL AND allele IS NOT NULL"), alleles))
        n = new.count()
        if n:
            scored = scorer(new).select(*KEYS, *self.scores, F.lit(True).alias("_found")).dropDuplicates(KEYS)
            batch = self._write(new.join(scored, KEYS, "left").withColumn("_found", F.coalesce("_found", F.lit(False))))
            while not self._commit(batch):
                own = self.spark.read.schema(self.schema).option("basePath", str(self._at("batches"))).parquet(str(self._at("batches", f"batch={batch}")))
                batch = self._write(own.drop("batch").join(self._rows().select(*KEYS), KEYS, "left_anti"))
        discard(new)
        return n

    def _write(self, rows: DataFrame) -> str:
        batch = uuid.uuid4().hex
        kept = [F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names if c != "batch"]
        rows.select(*kept).write.partitionBy("allele").parquet(str(self._at("batches", f"batch={batch}")))
        return batch

    def _commit(self, batch: str) -> bool:
        """Whether the batch is the next version; False if another run has taken the number."""
        number = max(self.versions().values(), default=0) + 1
        entry = self._at("entries", batch)
        self._fs.create(self._at("entries", batch, batch), True).close()
        self._fs.mkdirs(self._at("manifest"))
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(entry, self._at("manifest", f"{number:08d}"), options)
        except Py4JJavaError:
            self._fs.delete(entry, True)
            if not self._fs.exists(self._at("manifest", f"{number:08d}")):
                raise
            return False
        return True

    def vacuum(self) -> int:
        """Removes what no commit names; only while no run is under way. Returns how many batches went."""
        kept = self.versions()
        gone = [p for p in self._found("batches", "batch=*") if p.getName().removeprefix("batch=") not in kept]
        for p in gone:
            self._fs.delete(p, True)
        self._fs.delete(self._at("entries"), True)
        return len(gone)
