"""Best-fit packing by a linear grouping scheme.

Documents are tokenized and cut into pieces of at most ``capacity`` ids. How pieces
are packed depends on nothing but how many have each length, so a histogram of
``capacity`` numbers is planned on the driver, whatever the size of the corpus:

1. large lengths are sorted and cut into groups of equal cardinality, and each is
   rounded up to the largest of its group;
2. the few sizes' configurations are optimised as a linear program by column
   generation (a knapsack prices new configurations), and its values rounded down;
3. actual lengths take the places of the rounded ones, the last place of a sequence
   going to the longest that still fits;
4. what is left over, the small lengths above all, goes in by best fit, longest first;
   sequences of step 3 that leave more room than a bound join it, with the bound that
   gives the fewest sequences, and of such bounds the one that keeps most of step 3.

The plan is a list of runs of equal sequences. Pieces get a rank among those of their
length (counted by salted groups, so that a length shared by very many documents is
never in one task) and the plan says which sequence and offset the rank has.

Defined cases: null text counts as empty, an empty document is its end id alone; ids
may be null or repeat, each row is packed; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import as_texts, slices, small_batches, store

Run = tuple[tuple[int, ...], int]


def grouped(sizes: list[tuple[int, int]], groups: int) -> list[tuple[int, int]]:
    """Rounded sizes and demands, largest first, from (size, count), largest first."""
    if len(sizes) <= groups:
        return sizes
    each = math.ceil(sum(n for _, n in sizes) / groups)
    out: list[tuple[int, int]] = []
    top, held = sizes[0][0], 0
    for size, n in sizes:
        while n:
            if not held:
                top = size
            part = min(n, each - held)
            held, n = held + part, n - part
            if held == each:
                out.append((top, held))
                held = 0
    if held:
        out.append((top, held))
    merged: dict[int, int] = {}
    for size, n in out:
        merged[size] = merged.get(size, 0) + n
    return list(merged.items())


def configurations(sizes: list[int], demands: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, from the linear relaxation by column generation."""
    k, r, d = len(sizes), np.array(sizes), np.array(demands, float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    inverse = np.linalg.inv(basis)
    x = inverse @ d
    for _ in range(rounds):
        worth = inverse.T @ np.ones(k)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(r.min()), capacity + 1):
            fits = r <= room
            value = np.where(fits, best[np.where(fits, room - r, 0)] + worth, -1.0)
            i = int(value.argmax())
            if value[i] > best[room - 1] + 1e-12:
                best[room], choice[room] = value[i], i
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        while room > 0:
            if choice[room] < 0:
                room -= 1
                continue
            column[choice[room]] += 1
            room -= sizes[choice[room]]
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        inverse = np.linalg.inv(basis)
        x = np.maximum(inverse @ d, 0)
    return [(basis[:, i].astype(int), float(x[i])) for i in range(k)]


class Stock:
    """Lengths still to be packed: counts with a sorted list of the lengths that have any."""

    def __init__(self, counts: Mapping[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def largest(self, most: int) -> int | None:
        i = bisect.bisect_right(self.sizes, most)
        return self.sizes[i - 1] if i else None

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]


def plan_packing(counts: Mapping[int, int], capacity: int, groups: int = 48, small: float = 1 / 8) -> list[Run]:
    """Runs of equal sequences that hold every length as often as ``counts`` says."""
    stock = Stock(counts)
    runs: list[Run] = []
    large = [(s, stock.count[s]) for s in reversed(stock.sizes) if capacity * small < s < capacity]
    if large:
        rounded = grouped(large, groups)
        sizes = [s for s, _ in rounded]
        for config, times in configurations(sizes, [n for _, n in rounded], capacity):
            places, left = [s for s, n in zip(sizes, config, strict=True) for _ in range(n)], math.floor(times + 1e-9)
            while left > 0:
                held, room = [], capacity
                need: dict[int, int] = defaultdict(int)
                for i, place in enumerate(places):
                    # a length whose pieces are all spoken for in this sequence is passed over
                    size = stock.largest(room if i == len(places) - 1 else min(place, room))
                    while size is not None and stock.count[size] <= need[size]:
                        size = stock.largest(size - 1)
                    if size is None or size <= capacity * small:
                        continue
                    held.append(size)
                    need[size] += 1
                    room -= size
                if not held:
                    break
                times_here = min(left, *(stock.count[s] // n for s, n in need.items() if n))
                for s, n in need.items():
                    if n:
                        stock.take(s, n * times_here)
                runs.append((tuple(held), times_here))
                left -= times_here
    best: list[Run] | None = None
    for slack in (capacity, *(capacity // n for n in (16, 32, 64, 128, 170, 256, 340, 512)), 0):  # sequences with more room are given up and packed anew
        kept, rest = [], dict(stock.count)
        for sizes, n in runs:
            if capacity - sum(sizes) <= slack:
                kept.append((sizes, n))
                continue
            for s in sizes:
                rest[s] = rest.get(s, 0) + n
        plan = best_fit(kept, Stock(rest), capacity)
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
    return best or []


def best_fit(runs: list[Run], stock: Stock, capacity: int) -> list[Run]:
    """Puts the rest of the stock, longest first, where least room is left."""
    by_room: dict[int, list[Run]] = defaultdict(list)
    for sizes, n in runs:
        by_room[capacity - sum(sizes)].append((sizes, n))
    rooms = sorted(by_room)
    for size in reversed(list(stock.sizes)):
        left = stock.count[size]
        while left:
            i = bisect.bisect_left(rooms, size)
            if i == len(rooms):
                fit = capacity // size
                for each, n in ((fit, left // fit), (left % fit, 1)):
                    if each and n:
                        room = capacity - each * size
                        if not by_room[room]:
                            bisect.insort(rooms, room)
                        by_room[room].append(((size,) * each, n))
                break
            room = rooms[i]
            sizes, n = by_room[room].pop()
            put = min(n, left)
            if put < n:
                by_room[room].append((sizes, n - put))
            if not by_room[room]:
                del rooms[i]
            if not by_room[room - size]:
                bisect.insort(rooms, room - size)
            by_room[room - size].append(((*sizes, size), put))
            left -= put
    return [run for room in rooms for run in by_room[room]]


def places(runs: list[Run]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of intervals, and the first sequence and the offset of each."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for sizes, n in runs:
        offset = 0
        for s in sizes:
            found[s].append((used[s], sequence, offset))
            used[s] += n
            offset += s
        sequence += n
    return {s: tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for s, x in found.items()}


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keeps_space: bool, with_ids: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (and ids). The first piece takes what doesn't fill a whole one."""
    id_type = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, keeps_space)
        end = np.uint32(end_id)
        for batch in slices(batches, 256):
            rows = []
            for d, raw in zip(batch.column(0).to_pylist(), encoder.encode(as_texts(batch.column(1))), strict=True):
                ids = np.append(np.frombuffer(raw, encoder.kind).astype("<u4"), end)
                n, raw = len(ids), memoryview(ids).cast("B")
                first = (n - 1) % capacity + 1
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    part = raw[4 * start : 4 * stop]
                    rows.append((d, piece, start, stop - start, zlib.crc32(part), part.tobytes() if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, ids binary")


def ranked(pieces: DataFrame, n: int) -> DataFrame:
    """Adds ``rank``, from 0 without gaps among the pieces of each length."""
    salts = max(1, math.ceil(math.sqrt(n) / 8))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("b_length").orderBy("b_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(F.col("length").alias("b_length"), F.col("salt").alias("b_salt")).agg(F.count("*").alias("n")).select("b_length", "b_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    here = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = salted.withColumn("here", F.row_number().over(here) - 1)
    return numbered.join(counts, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt"))).withColumn("rank", F.col("here") + F.col("before")).drop("salt", "here", "before", "b_length", "b_salt")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, keeps_space: bool = True, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: where it comes from, its length and checksum, its sequence and its offset there (and its ids as bytes)."""
    small_batches(docs.sparkSession)
    pieces = store(cut_pieces(docs, tokenizer, end_id, capacity, keeps_space, with_ids, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    where = places(plan_packing(counts, capacity))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 6))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                firsts, base, offsets = where[int(size)]
                at = np.searchsorted(firsts, rank[mine], "right") - 1
                sequence[mine] = base[at] + rank[mine] - firsts[at]
                offset[mine] = offsets[at]
            yield pa.record_batch([*(batch.column(i) for i in range(6)), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    id_type = dict(pieces.dtypes)["doc_id"]
    rows = ranked(pieces, sum(counts.values())).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "rank")
    out = rows.mapInArrow(assign, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long")
    return out if with_ids else out.drop("ids")
