"""Chat formatting: one rendering of a dialogue for each participant, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEAD, TAIL = "<|assistant|>\n", "<|end|>\n"


def _escaped(c: Column, *marks: str) -> Column:
    r"""Backslashes doubled, then one before the bar of each of the marks: what is left of them can't be a marker."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in marks:
        c = F.replace(c, F.lit(mark), F.lit(mark.replace("|", "\\|")))
    return c


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    r"""One row for each dialogue and participant (each distinct role): conv_id, participant, n_turns,
    n_target_turns, rendered, mask.

    That speaker is `assistant`, all others are users with their role as name. mask holds [start, end) in characters
    of rendered for what the assistant says, in order: the parts that a loss may use. Turns go by turn, role, text;
    repeated rows stay. A null role is a participant of its own, with null as participant and a user without name in
    other views. A null text is an empty turn, a null turn comes first, and rows without conv_id form one dialogue.

    Nothing in a text or a role can forge a marker: a backslash becomes two, `<|` in a text `<\|`, and in a role each
    `|` becomes `\|` and a line break `\n`; so what was said can be read back exactly. A dialogue is rendered whole,
    so its renderings must fit a task, as they must fit a row of the result.
    """
    name = F.replace(_escaped(F.col("role"), "|"), F.lit("\n"), F.lit("\\n"))
    head = F.when(F.col("role").isNull(), F.lit("<|user|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    t = turns.select("conv_id", "turn", "role", _escaped(F.coalesce("text", F.lit("")), "<|").alias("body"), head.alias("head"))
    order = [F.col("turn"), F.col("role"), F.col("body")]
    before = W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = W.partitionBy("conv_id", "role").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.length("head") + F.length("body") + len(TAIL)
    # where a turn begins if all are users, moved by what the speaker's own earlier heads are shorter or longer
    t = t.repartition("conv_id").withColumn("_at", F.coalesce(F.sum(size).over(before), F.lit(0))).withColumn("_k", F.count("*").over(own) - 1)
    start = F.col("_at") + F.col("_k") * (F.lit(len(HEAD)) - F.length("head")) + len(HEAD)
    spoken = t.withColumn("start", start).groupBy("conv_id", "role").agg(
        F.array_sort(F.collect_list(F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end")))).alias("mask")
    )
    whole = t.groupBy(F.col("conv_id").alias("_conv")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "head"))).alias("turns"))
    out = spoken.join(whole, F.col("conv_id").eqNullSafe(F.col("_conv")))
    said = F.transform("turns", lambda x: F.concat(F.when(x["role"].eqNullSafe(F.col("role")), F.lit(HEAD)).otherwise(x["head"]), x["body"], F.lit(TAIL)))
    return out.select(
        "conv_id", F.col("role").alias("participant"), F.size("turns").cast("long").alias("n_turns"),
        F.size("mask").cast("long").alias("n_target_turns"), F.array_join(said, "").alias("rendered"), "mask",
    )
