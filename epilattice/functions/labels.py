"""Mutation labels, variable regions and tolerant readings of text columns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A decimal number as text; try_cast alone would also take '1d' or 'NaN'.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
LABEL = r"^([A-Z*])([0-9]+)([A-Z*])$"


def lenient_double(c: Column) -> Column:
    """A number where the text is one, else null; NaN becomes null."""
    text = F.trim(c.cast("string"))
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def lenient_int(c: Column) -> Column:
    """A whole number where the text is one ('9' or '9.0'), else null."""
    value = lenient_double(c)
    return F.when(value == F.floor(value), value).try_cast("int")


def int_of(df: DataFrame, c: str) -> Column:
    """lenient_int, without the way over text where the column is a whole number already."""
    is_int = isinstance(df.schema[c].dataType, (T.IntegerType, T.ShortType, T.ByteType))
    return (F.col(c).cast("int") if is_int else lenient_int(F.col(c))).alias(c)


def decoded_boolean(c: Column) -> Column:
    """true and 1 in any case are true; everything else, null included, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1"), F.lit(False))


def passes(score: Column, threshold: float) -> Column:
    """Whether a score is there and strictly below the threshold."""
    return F.coalesce(score < F.lit(float(threshold)), F.lit(False))


def normalised_allele(c: Column) -> Column:
    """Trims, and writes mouse alleles H-2-Xy as H2-X*y; others stay."""
    name = F.trim(c)  # few are to be rewritten, and a prefix is found faster than a pattern
    return F.when(name.startswith("H-2-"), F.regexp_replace(name, r"^H-2-(.)(.+)$", "H2-$1*$2")).otherwise(name)


def safe_label(c: Column) -> Column:
    """A name that any file system takes: runs of other characters become one underscore."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def vr_slice(sequence: Column, start: int, end: int) -> Column:
    """The variable region, 1-based and inclusive."""
    first = max(start, 1)
    return F.substring(sequence, first, max(end - first + 1, 0))


def mutation_string(vr: Column, wt: Column) -> Column:
    """Differences over the shorter length as S1A;T3G; WT if there are none; null if either is.

    Both are cut into residues once: substring() would walk from the front for each position."""
    own, other = F.slice(F.split(vr, ""), F.lit(1), F.least(F.length(vr), F.length(wt))), F.split(wt, "")
    label = lambda x, i: F.when(x != F.get(other, i), F.concat(F.get(other, i), (i + 1).cast("string"), x))
    # places without a difference are null, which array_join leaves out
    return F.coalesce(F.nullif(F.array_join(F.transform(own, label), ";"), F.lit("")), F.when(vr.isNotNull() & wt.isNotNull(), F.lit("WT")))


def peptide_mutation_string(mutation: Column, start: Column, end: Column, region_start: int) -> Column:
    """The labels whose position lies in the peptide; malformed ones are dropped; WT if none is left."""
    labels = F.transform(F.split(mutation, ";"), lambda x: F.trim(x))
    # each label is parsed once; those outside are null, which array_join leaves out
    placed = F.transform(labels, lambda x: F.struct(x.alias("label"), (F.regexp_extract(x, LABEL, 2).try_cast("int") + (region_start - 1)).alias("at")))
    kept = F.transform(placed, lambda p: F.when(p["at"].between(start, end), p["label"]))
    return F.coalesce(F.nullif(F.array_join(kept, ";"), F.lit("")), F.lit("WT"))


def mutation_list(mutation: Column) -> Column:
    """The distinct labels of a variant; none for blank, WT, NAN or null."""
    parts = F.array_distinct(F.filter(F.transform(F.split(mutation, ";"), lambda x: F.trim(x)), lambda x: x != ""))
    none = F.upper(F.trim(mutation)).isin("", "WT", "NAN") | mutation.isNull()
    return F.when(none, F.array().cast("array<string>")).otherwise(parts)


def count_mutations(mutation: Column) -> Column:
    """How many labels a text holds; 0 for blank, WT in any case or null."""
    parts = F.filter(F.split(mutation, ";"), lambda x: F.trim(x) != "")
    return F.when(mutation.isNull() | F.upper(F.trim(mutation)).isin("", "WT"), F.lit(0)).otherwise(F.size(parts))


def filled_mutation(mutation: Column, blank_too: bool = True) -> Column:
    """WT where a mutation is missing, and where it is blank if blank_too."""
    return F.coalesce(F.nullif(F.trim(mutation), F.lit("")) if blank_too else mutation, F.lit("WT"))
