"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Each source's documents stand in a shuffled order, up to ``max_epochs`` times over.
A copy's virtual finish time is the tokens that its source has given up to and
including it, divided by the source's target. All copies are range-sorted by that
time and the order is cut where the total budget is used up. Because virtual time
rises along each source's own order, what is taken from a source is a prefix of
that order, so the whole mix is one short row per source: the last epoch and the
last shuffle key that are in.

Running sums never gather a source in one task: keys are cut into ranges, ranges
are summed first, and only rows of one range are sorted together.

Defined cases: null text has size 0; null source is a source of its own, last in
order; documents of size 0 are never taken; rows with equal ids share their place
in the order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, store

WORD = r"[^\x20\x09-\x0D]+"


def shuffle_key(id_col: str, seed: int) -> Column:
    """A place in the shuffled order that depends on the id alone (32 hex digits)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def source_targets(base: DataFrame, period: int = 3, max_epochs: int = 3) -> DataFrame:
    """One row per source: size, weight and target; ``base`` has source and size.

    Weights are 1..period by the order of source names, repeating, null last. Targets
    share the total by weight and stop at ``max_epochs`` times the source's size; the
    excess goes to the others by weight. The level is found in closed form: in order
    of cap over weight, the share per weight left after paying the earlier caps
    rises up to the first source that isn't capped and falls after it, so its
    maximum is the level.
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    return (
        base.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", ((F.row_number().over(everything) - 1) % period + 1).cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * max_epochs)
        .withColumn("budget", F.sum("source_size").over(whole))
        .withColumn("share", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("level", F.max("share").over(whole))
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .select("source", "source_size", "weight", "target", "budget")
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """Id, source, size in words and shuffle key of every row."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        shuffle_key(id_col, seed).alias("key"),
    )


def mix_cuts(base: DataFrame, period: int = 3, max_epochs: int = 3) -> DataFrame:
    """One row per source with its target and the last copy taken (epoch, key; null: none)."""
    n = base.count()
    digits = max(1, math.ceil(math.log(max(n, 2), 16) / 2))  # about the square root of n ranges in a source
    ranges = 16**digits
    targets = cut(source_targets(base, period, max_epochs))
    positive = base.where("size > 0").withColumn("range", F.substring("key", 1, digits))
    in_source = Window.partitionBy("b_source").orderBy("b_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        positive.groupBy(F.col("source").alias("b_source"), F.col("range").alias("b_range"))
        .agg(F.sum("size").alias("b_sum"))
        .select("b_source", "b_range", F.coalesce(F.sum("b_sum").over(in_source), F.lit(0)).alias("b_before"))
    )
    here = Window.partitionBy("source", "range").orderBy("key")  # rows with equal keys come in together
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target", "budget")
    given = F.col("epoch") * F.col("source_size") + F.col("b_before") + F.col("within")
    copies = (
        positive.withColumn("within", F.sum("size").over(here))
        .join(sums, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("range") == F.col("b_range")))
        .join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
        .where(given - F.col("size") < F.col("target"))  # a copy that would start after all targets are met can't be needed
        .select("source", "key", "epoch", "size", "budget", (given / F.col("target")).alias("finish"))
        .withColumn("slot", F.least(F.floor(F.col("finish") * ranges), F.lit(ranges)))
    )
    slots = (
        copies.groupBy(F.col("slot").alias("s_slot"))
        .agg(F.sum("size").alias("s_sum"))
        .select("s_slot", F.coalesce(F.sum("s_sum").over(Window.orderBy("s_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s_before"))
    )
    in_slot = Window.partitionBy("slot").orderBy("finish", F.col("source").isNull(), "source", "epoch", "key")
    last = (
        copies.withColumn("inside", F.sum("size").over(in_slot))
        .join(slots, F.col("slot") == F.col("s_slot"))
        .where(F.col("s_before") + F.col("inside") <= F.col("budget"))
        .groupBy(F.col("source").alias("l_source"))
        .agg(F.max(F.struct("epoch", "key")).alias("last"))
    )
    return targets.join(last, F.col("source").eqNullSafe(F.col("l_source")), "left").select(
        "source", "source_size", "target", F.col("last.epoch").alias("last_epoch"), F.col("last.key").alias("last_key")
    )


def _copies() -> Column:
    """How often a row is taken, from its key and its source's cut."""
    return F.when(F.col("c_key").isNull() | (F.col("size") == 0), 0).otherwise(F.col("c_epoch") + (F.col("key") <= F.col("c_key")).cast("int")).cast("long")


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    c = cuts.select(F.col("source").alias("c_source"), F.col("source_size").alias("c_size"), F.col("target").alias("c_target"), F.col("last_epoch").alias("c_epoch"), F.col("last_key").alias("c_key"))
    return rows.join(c, rows["source"].eqNullSafe(F.col("c_source")), "left")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, period: int = 3, max_epochs: int = 3) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies and taken words."""
    base = cut(measured(docs, id_col, text_col, source_col, seed))
    return _with_cuts(base, store(mix_cuts(base, period, max_epochs), "cuts")).select(
        "doc_id", "source", "size", F.col("c_size").alias("source_size"), F.col("c_target").alias("target"), _copies().alias("copies"), (_copies() * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, period: int = 3, max_epochs: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    The cuts, a row per source, are stored, so that their size is known and Spark
    broadcasts them as long as it is below its limit; texts aren't shuffled then.
    """
    cuts = store(mix_cuts(cut(measured(docs, id_col, text_col, source_col, seed)), period, max_epochs), "cuts")
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).alias("size"), shuffle_key(id_col, seed).alias("key"))
    return _with_cuts(rows, cuts).where(_copies() > 0).select("row", F.explode(F.sequence(F.lit(1), _copies().cast("int")))).select("row.*")
