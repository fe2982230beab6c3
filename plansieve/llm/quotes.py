"""Quotation linking: reply-ordered conversations without quotes.

A message's lines are parsed into quote levels (leading ``>`` signs). Consecutive lines of
a level are a passage; it is normalised (lower case, single spaces, line ends ignored) and
hashed as windows of ``WINDOW`` words, a shorter passage or line as a whole. What a message
holds at a level is what a message that quotes it holds one level deeper, so passages of
level n are joined, within their conversation, to messages that hold them at level n - 1.
The quoted part as a whole, one level up, is one more hash, which only the whole text of a
message has. Each hash votes for the latest earlier message that holds it, by its number
of words (the whole with all its words, own words of the holder several times); the message with most votes is what is replied to (of
equal ones the latest). Replies stand after what they reply to: the order is by the turn
of the first message of the thread, the depth in it, and the turn.

The latest holder before a turn is found in ranges of turns: the last one of each range,
then inside the range. Positions are counted over ranges of the whole order, which cut
long threads and conversations, and depths are found by doubling links, so a conversation
is never gathered in one task.

Defined cases: null text counts as empty; a message that quotes only itself or later
messages, or nothing that is known, replies to none; a line that says who wrote what is
quoted next is dropped with the quote; rows with equal conversation and turn count as
one message for links and keep a row each; null conversations and turns are groups like
others but get no links; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_digest

from .common import as_texts, cut, slices, small_batches, store
from .ngram_join import Words, shingles

MARK = re.compile(r"^((?:[ \t]*>)+)[ \t]?")
INTRO = re.compile(r"^\s*(?:on\b.{1,200}\bwrote|.{1,80}\bwrote)\s*:\s*$", re.IGNORECASE)
#: Words of a window, and how often a message's own words count against those that it quoted itself.
WINDOW, OWN = 6, 4


def parse_line(line: str) -> tuple[int, str]:
    """Quote level and body of a line."""
    m = MARK.match(line)
    return (m[1].count(">"), line[m.end() :]) if m else (0, line)


def parse_message(text: str) -> tuple[str, list[tuple[int, list[str]]], int]:
    """A message's own text, its passages (level and normalised lines) in order, and its number of quoted lines. Empty lines belong to no passage and part none."""
    lines = [parse_line(x) for x in text.split("\n")]
    kept = [(level, body) for i, (level, body) in enumerate(lines) if level or not (INTRO.match(body) and any(x for x, _ in lines[i + 1 : i + 3]))]
    clean = re.sub(r"\n{3,}", "\n\n", "\n".join(body for level, body in kept if not level)).strip("\n")
    said = [(level, " ".join(body.lower().split())) for level, body in kept]
    said = [x for x in said if x[1]]
    return clean, [(level, [body for _, body in run]) for level, run in groupby(said, key=lambda x: x[0])], sum(level > 0 for level, _ in said)


def hashes_of(passages: list[tuple[int, list[str]]], words: Words) -> dict[tuple[int, int], int]:
    """(level, hash) of a message's passages, with their number of words; the whole message stands at level -1, and its quoted part as a whole at level 0.

    The whole is hashed with the levels of its words, so that only a message quoted as it stands has it.
    """
    out: dict[tuple[int, int], int] = {}
    for level, lines in passages:
        run = " ".join(lines)
        parts = [run, *[x for x in lines if len(x.split()) < WINDOW]] if len(lines) > 1 else [run]
        for part in parts:
            n = min(WINDOW, part.count(" ") + 1)
            for h in shingles(part.encode("utf-8", "surrogatepass"), WINDOW, words).astype(np.int64).tolist():
                out[level, h] = n
    for least in (0, 1):
        whole = [f"{level - least}:{w}" for level, lines in passages if level >= least for x in lines for w in x.split()]
        if whole:
            h = int.from_bytes(xxh3_64_digest(" ".join(whole).encode("utf-8", "surrogatepass")), "big", signed=True)
            out[least - 1, h] = WINDOW * len(whole)
    return out


def parsed_messages(messages: DataFrame) -> DataFrame:
    """The columns conv_id, turn, role, clean text and n_quoted."""
    small_batches(messages.sparkSession)
    ids = dict(messages.dtypes)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [parse_message(t) for t in as_texts(batch.column(3))]
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array([c for c, _, _ in found], pa.string()), pa.array([n for _, _, n in found], pa.int64())], ["conv_id", "turn", "role", "clean", "n_quoted"])

    return messages.select("conv_id", "turn", "role", "text").mapInArrow(parse, f"conv_id {ids['conv_id']}, turn {ids['turn']}, role {ids['role']}, clean string, n_quoted long")


def held_passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_quoted, level, hash and words: a row for each hash of what a message holds."""
    ids = dict(messages.dtypes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches, 256):
            found = [parse_message(t) for t in as_texts(batch.column(2))]
            held = [hashes_of(p, words) for _, p, _ in found]
            row = np.repeat(np.arange(len(held)), [len(h) for h in held])
            quoted = np.array([n for _, _, n in found], np.int64)[row]
            keys = [k for h in held for k in h]
            cols = [pa.array([a for a, _ in keys], pa.int32()), pa.array([x for _, x in keys], pa.int64()), pa.array([n for h in held for n in h.values()], pa.int32())]
            yield pa.record_batch([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(quoted), *cols], ["conv_id", "turn", "n_quoted", "level", "hash", "words"])

    return messages.select("conv_id", "turn", "text").mapInArrow(hashed, f"conv_id {ids['conv_id']}, turn {ids['turn']}, n_quoted long, level int, hash long, words int")


def reply_links(messages: DataFrame, parsed: DataFrame, stretch: int = 64) -> DataFrame:
    """conv_id, turn and parent (the turn replied to) of every message that replies to one. Only conversations with a quote are hashed."""
    quoting = cut(parsed.where((F.col("n_quoted") > 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id").distinct())
    items = store(held_passages(messages.where(F.col("turn").isNotNull()).join(quoting, "conv_id", "left_semi")), "passages")
    # a quoted passage asks for one level up; the quoted part as a whole (level 0) for a whole message (level -1)
    whole = F.col("words") > WINDOW
    asked = items.where((F.col("n_quoted") > 0) & ((F.col("level") > 0) | ((F.col("level") == 0) & whole)))
    asked = asked.select("conv_id", (F.col("level") - 1).alias("level"), "hash", "turn", "words").distinct()
    holders = items.where((F.col("level") >= 0) & ~whole | (F.col("level") == -1)).select("conv_id", "level", "hash", "turn").distinct()
    key = ["conv_id", "level", "hash"]
    holders = holders.join(asked.select(*key).distinct(), key, "left_semi")
    span = F.floor(F.col("turn") / stretch)
    events = cut(holders.select(*key, "turn", F.col("turn").alias("own"), F.lit(None).cast("int").alias("words")).unionByName(asked.select(*key, "turn", F.lit(None).cast(dict(parsed.dtypes)["turn"]).alias("own"), "words")).withColumn("span", span))
    here = Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = events.groupBy(*key, "span").agg(F.max("own").alias("last")).select(*key, "span", F.max("last").over(before).alias("earlier"))
    near = events.withColumn("near", F.max("own").over(here)).where("words is not null")
    votes = near.join(spans, [*key, "span"]).withColumn("origin", F.coalesce("near", "earlier")).where("origin is not null")
    counted = votes.groupBy("conv_id", "turn", "origin").agg(F.sum(F.when(F.col("level") == 0, OWN * F.col("words")).otherwise(F.col("words"))).alias("words"))
    return counted.groupBy("conv_id", "turn").agg(F.max(F.struct("words", "origin")).alias("best")).select("conv_id", "turn", F.col("best.origin").alias("parent"))


def threads(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """conv_id, turn, root and depth of every message in a link table, by doubling; more than ``most_rounds`` rounds (2**60 replies in a row) are an error."""
    at = cut(links.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    for _ in range(most_rounds):
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = at.join(up, ["conv_id", "root"], "left")
        at = cut(step.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")
    raise RuntimeError(f"threads are not settled after {most_rounds} rounds")


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``position``, from 0 in each conv_id, in this order; rows that agree in all of it are alike.

    Ranges of the whole order are counted, so the largest conversation is in many of them.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            here = []
            for conv in batch.column(0).to_pylist():
                if conv not in seen:
                    seen.clear()
                here.append(seen[conv])
                seen[conv] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(here), pa.int32()), pa.array(here, pa.int64())], [*batch.schema.names, "part", "here"])

    names = ["conv_id", *[c for c in rows.columns if c != "conv_id"]]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*names).dtypes)
    ranged = rows.select(*names).withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order, "tie").sortWithinPartitions("conv_id", *order, "tie").drop("tie")
    placed = store(ranged.mapInArrow(number, f"{schema}, part int, here long"), "placed")
    before = Window.partitionBy("c_conv").orderBy("c_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(F.col("part").alias("c_part"), F.col("conv_id").alias("c_conv")).agg(F.count("*").alias("n"))
    carried = cut(counts.withColumn("before", F.sum("n").over(before)).where("before is not null").select("c_part", "c_conv", "before"))  # at most a row for each range
    same = (F.col("part") == F.col("c_part")) & F.col("conv_id").eqNullSafe(F.col("c_conv"))
    return placed.join(carried, same, "left").withColumn("position", F.col("here") + F.coalesce("before", F.lit(0))).drop("part", "here", "c_part", "c_conv", "before")


def link_quotations(messages: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, parent_turn, root_turn, depth, position in its conversation, n_quoted and clean text."""
    parsed = store(parsed_messages(messages), "parsed")
    links = cut(reply_links(messages, parsed))
    placed = threads(links)
    known = cut(links.join(placed, ["conv_id", "turn"]).select(F.col("conv_id").alias("k_conv"), F.col("turn").alias("k_turn"), "parent", "root", "depth"))
    rows = (
        parsed.join(known, (F.col("conv_id") == F.col("k_conv")) & (F.col("turn") == F.col("k_turn")), "left")
        .select("conv_id", "turn", "role", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), "n_quoted", "clean")
    )
    placed = positions(rows, ["root_turn", "depth", "turn", "role", "clean"])
    return placed.select("conv_id", "turn", "role", "parent_turn", "root_turn", "depth", F.col("position").cast("long").alias("position"), "n_quoted", "clean")
