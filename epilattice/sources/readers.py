"""Sources: libraries, FASTA, peptide tables, predictors' files and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import lenient_double, lenient_int
from ..operators.checks import require_columns


def clean_library(df: DataFrame, id_col: str, sequence_col: str, metadata: Sequence[str] = ()) -> DataFrame:
    """variant_id, aa_sequence, metadata... as text: trimmed, sequences without inner spaces, rows with a blank id or
    sequence left out, missing metadata empty."""
    require_columns(df, [id_col, sequence_col, *metadata], "library")
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = df.select(text(id_col).alias("variant_id"), F.replace(text(sequence_col), F.lit(" "), F.lit("")).alias("aa_sequence"), *[text(m).alias(m) for m in metadata])
    return out.where("variant_id <> '' AND aa_sequence <> ''")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] = (), sep: str = "\t") -> DataFrame:
    """A Parquet folder, or delimited text with a header in which every column is text; required columns are checked.
    Files of one folder may have their columns in different orders, or not all of them: they are matched by name."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = _by_name(spark, [path], sep, '"').drop("_file")
    return require_columns(df, columns, path)


def _by_name(spark: SparkSession, paths: Sequence[str], sep: str, escape: str = "\\", glob: str | None = None) -> DataFrame:
    """Delimited files with headers as text columns, matched by name over all files, and _file.

    Spark's reader takes the first file's header for all. So the header lines are read first, one for each file, and
    the files of each distinct header (a few layouts, however many files there are) are read together and united.
    """
    looked = spark.read.option("recursiveFileLookup", True)
    looked = looked.option("pathGlobFilter", glob) if glob else looked
    lines = looked.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    # lines of a file's first block come numbered in their order
    headers = lines.where("at = 0").withColumn("_i", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "_i").alias("header"))
    layouts = headers.groupBy("header").agg(F.collect_list("file").alias("files")).collect()  # a name for each file
    if not layouts:
        raise ValueError(f"no files in {list(paths)}")
    read = spark.read.option("header", True).option("sep", sep).option("escape", escape).option("nullValue", "")
    out = None
    for layout in sorted(layouts, key=lambda r: r.header):
        own = read.csv(sorted(layout.files)).withColumn("_file", F.input_file_name())
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def read_library(spark: SparkSession, path: str, id_col: str, sequence_col: str, metadata: Sequence[str] = (), sep: str = ",") -> DataFrame:
    return clean_library(read_table(spark, path, [id_col, sequence_col, *metadata], sep), id_col, sequence_col, metadata)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """variant_id (first word of the header), record_desc, aa_sequence. Records begin at every `>`."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    records = records.withColumn("value", F.replace("value", F.lit("\r"), F.lit("")))
    header = F.trim(F.split("value", "\n", 2)[0])
    body = F.coalesce(F.get(F.split("value", "\n", 2), 1), F.lit(""))
    out = records.select(F.split(header, r"\s+")[0].alias("variant_id"), header.alias("record_desc"), F.regexp_replace(body, r"[\s]+", "").alias("aa_sequence"))
    return out.where("variant_id <> '' AND aa_sequence <> ''")


def read_unique_peptides(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """peptide_id, peptide, k, occurrence_count; strict raises for text that is no whole number."""
    df = read_table(spark, path, ["peptide_id", "peptide", "k", "occurrence_count"])
    number = (lambda c, t: F.col(c).cast(t)) if strict else (lambda c, t: lenient_int(F.col(c)).cast(t))
    return df.withColumns({"k": number("k", "int"), "occurrence_count": number("occurrence_count", "long")})


def read_peptide_map(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """peptide_id, variant_id, start, end and all metadata columns."""
    df = read_table(spark, path, ["peptide_id", "variant_id", "start", "end"])
    return df.withColumns({c: F.col(c).cast("int") if strict else lenient_int(F.col(c)) for c in ("start", "end")})


def _wide(spark: SparkSession, path: str, header: str, named: bool) -> DataFrame:
    """Data lines of wide predictor files, with their file's header and allele names.

    Lines are read in splits. A file's header stands in its first split, with few other lines that are no data; the
    one before it names the alleles. Later splits hold data alone. Headers, one a file, are joined to the lines.
    """
    raw = spark.read.text(path).select(
        F.rtrim(F.col("value"), F.lit("\r")).alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    titles = raw.where((F.col("block") == 0) & ~F.col("line").rlike(r"^\s*[0-9]+\t"))
    titles = titles.withColumn("before", F.lag("line").over(W.partitionBy("file").orderBy("at"))).where(F.col("line").startswith(header))
    heads = titles.groupBy("file").agg(F.min(F.struct("at", "before", F.col("line").alias("header"))).alias("h")).select("file", "h.*")
    is_allele = (lambda c: c.contains("-") | c.startswith("HLA")) if named else (lambda c: c != "")
    names = F.filter(F.transform(F.split(F.coalesce("before", F.lit("")), "\t"), lambda c: F.trim(c)), is_allele)
    heads = heads.select("file", F.col("at").alias("head_at"), "header", names.alias("alleles"))
    bad = raw.select("file").distinct().join(heads.where("size(alleles) > 0"), "file", "left_anti").limit(10).collect()
    if bad:
        raise ValueError(f"no header or no allele names in {[r.file for r in bad]}")
    lines = raw.join(heads, "file").where("block > 0 OR at > head_at").where("trim(line) <> '' AND NOT startswith(line, '#')")
    return lines.select("header", "alleles", F.split("line", "\t").alias("cells"))


def read_wide_mhci(spark: SparkSession, path: str) -> DataFrame:
    """peptide, k, allele, netMHCpan_EL_score, netMHCpan_EL_rank and, where the files have them, the BA columns.

    Each allele has a block of cells (core, icore, EL_score, EL_rank[, BA_score, BA_rank]). Rows without a full first
    block are skipped; a row ends at its first incomplete block.
    """
    lines = _wide(spark, path, "Pos\tPeptide\tID\t", True)
    lines = lines.withColumn("width", F.when(F.col("header").contains("\tBA_score"), 6).otherwise(4))
    rows = lines.where("size(cells) >= 3 + width").select("cells", "width", F.posexplode("alleles").alias("i", "allele"))
    rows = rows.where("3 + (i + 1) * width <= size(cells)")
    cell = lambda j: lenient_double(F.get("cells", 3 + F.col("i") * F.col("width") + j))
    ba = lambda j: F.when(F.col("width") == 6, cell(j))
    return rows.select(
        F.col("cells")[1].alias("peptide"), F.length(F.col("cells")[1]).alias("k"), "allele", cell(2).alias("netMHCpan_EL_score"), cell(3).alias("netMHCpan_EL_rank"),
        ba(4).alias("netMHCpan_BA_score"), ba(5).alias("netMHCpan_BA_rank"),
    )


def read_wide_mhcii(spark: SparkSession, path: str) -> DataFrame:
    """peptide, allele, netMHCIIpan_core, _inverted, _EL_score, _EL_rank. A row needs the blocks of all alleles; no
    row at all raises."""
    lines = _wide(spark, path, "Pos\tPeptide\tID\tTarget\t", False)
    rows = lines.where("size(cells) >= 4 + 4 * size(alleles)").select("cells", F.posexplode("alleles").alias("i", "allele"))
    cell = lambda j: F.get("cells", 4 + F.col("i") * 4 + j)
    out = rows.select(
        F.col("cells")[1].alias("peptide"), "allele", cell(0).alias("netMHCIIpan_core"), lenient_double(cell(1)).alias("netMHCIIpan_inverted"),
        lenient_double(cell(2)).alias("netMHCIIpan_EL_score"), lenient_double(cell(3)).alias("netMHCIIpan_EL_rank"),
    )
    if out.isEmpty():
        raise ValueError(f"no predictions in {path}")
    return out


def tidy_long(df: DataFrame) -> DataFrame:
    """Long predictions: trimmed text, numbers or null, k; rows without peptide or allele stay out."""
    scores = ["mhcflurry_affinity_percentile", "mhcflurry_presentation_percentile"]
    require_columns(df, ["peptide", "allele", *scores], "predictions")
    out = df.select(F.trim("peptide").alias("peptide"), F.trim("allele").alias("allele"), *[lenient_double(F.col(c)).alias(c.replace("mhcflurry", "MHCflurry")) for c in scores])
    return out.where("peptide <> '' AND allele <> ''").withColumn("k", F.length("peptide"))


def read_long_predictions(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return tidy_long(read_table(spark, path, sep=sep))


def read_scores(spark: SparkSession, paths: Sequence[str], outcomes: Sequence[str], file_name: str | None = None) -> DataFrame:
    """Score tables of single alleles, from files or from folders searched for file_name at any depth.

    Folders that end in _combined are left out. Columns are matched by name, so files may order them as they like and
    lack outcomes that others have. Every file must hold one allele and no two files the same one; at least one of the
    outcomes must be there. One row a variant; missing mutations read WT.
    """
    df = _by_name(spark, paths, "\t", glob=file_name)
    df = df.where(~F.col("_file").rlike(r"_combined/[^/]*$"))
    require_columns(df, ["allele", "variant_id", "VR_mutation"], "score tables")
    if not any(o in df.columns for o in outcomes):
        raise ValueError(f"none of the outcomes {list(outcomes)} is in the score tables")
    return tidy_scores(df, outcomes)


def tidy_scores(df: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Rows of score tables as text, with their _file, checked and read as read_scores says."""
    there = [o for o in outcomes if o in df.columns]
    held = df.groupBy("_file").agg(F.min("allele").alias("a"), F.max("allele").alias("b"))
    several = [r[0] for r in held.where("a <> b OR a IS NULL").limit(10).collect()]
    twice = [r[0] for r in held.groupBy("a").count().where("count > 1").limit(10).collect()]
    if several or twice:
        raise ValueError(f"files without exactly one allele: {several}; alleles in several files: {twice}")
    rows = df.select(
        "allele", "variant_id", F.coalesce("VR_mutation", F.lit("WT")).alias("VR_mutation"),
        *[(lenient_double(F.col(o)) if o in there else F.lit(None).cast("double")).alias(o) for o in outcomes],
    )
    if rows.isEmpty():
        raise ValueError("no score rows were found")
    place = F.row_number().over(W.partitionBy("allele", "variant_id").orderBy("VR_mutation", *outcomes))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")
