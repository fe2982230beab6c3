"""Nearest neighbours by inner product with collision-counting hashing.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) for the largest norm M of their block,
and queries are scaled to norm M with 0 there, so that the largest inner product is the
smallest distance. Each hash function is a single random projection. A block of vectors keeps,
for every projection, its values in sorted order; a query's window in each of them is
centred on the query's own value, and virtual rehashing widens all windows by a factor
until enough vectors lie in at least ``share`` of the windows. These are verified with
exact inner products of the original vectors.

Vectors are dealt into blocks by hash, once. Each block is indexed once, and the queries,
sent to every block, stream past it; the best of each block are merged for each query. For
hashing alone vectors and queries are scaled by powers of two, so that no component is
too small or too large to be squared.

Defined cases: rows whose id is null, or whose vector is null, zero or holds null or
non-finite components take no part; of the rest only vectors of the most frequent
length do (of equally frequent ones the longest); of rows with equal ids the smallest
vector, in the order of arrays, counts; equal scores go to the smaller id; a sum that
overflows is infinite, and one that is undefined (infinite terms of both signs) counts as
minus infinity; fewer candidates than k give all; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, slices, small_batches

#: The most rows of a block of vectors, and the least that it is cut into to keep a cluster busy.
BLOCK, LEAST_BLOCK = 1 << 15, 1 << 12


def usable(vector: str) -> Column:
    """Whether a vector can take part, whatever its length."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_rows(x: np.ndarray) -> np.ndarray:
    """For each row the number of the first row equal to it."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(r.tobytes(), i) for i, r in enumerate(x)], np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Each row divided by a power of two, so that its largest component is between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


class Windows:
    """Sorted single projections of a block of vectors."""

    def __init__(self, vectors: np.ndarray, projections: int, share: float, seed: int):
        n, d = vectors.shape
        if projections > 255 or n > 1 << 16:
            raise ValueError("at most 255 projections of at most 65536 vectors")
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((d + 1, projections))
        vectors = unit(vectors.reshape(1, -1)).reshape(n, d)
        self.coarse = vectors.astype(np.float32)
        squares = (vectors**2).sum(1)
        self.norm = math.sqrt(squares.max())
        values = vectors @ self.a[:-1] + np.sqrt(np.maximum(squares.max() - squares, 0))[:, None] * self.a[-1]
        order = np.argsort(values, axis=0, kind="stable").T
        self.sorted = np.sort(values, axis=0).T.copy()
        self.place = np.empty(order.shape, np.uint16)  # where each vector stands in each sorted array
        np.put_along_axis(self.place, order, np.arange(n, dtype=np.uint16)[None, :], axis=1)
        self.n, self.least = n, math.ceil(share * projections)
        self.half = 0.5 * (float(values.std()) or 1.0)
        self.shifted, self.inside = np.empty_like(self.place), np.empty(self.place.shape, bool)

    def directions(self, queries: np.ndarray) -> np.ndarray:
        """Queries of norm 1."""
        scaled = unit(queries)
        return scaled / np.sqrt((scaled**2).sum(1))[:, None]

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """How many values of each sorted array are below x (a column for each array), by bisection in all arrays at once."""
        below, row = np.zeros(x.shape, np.int64), np.arange(len(self.sorted))
        for bit in reversed(range(self.n.bit_length())):
            more = below + (1 << bit)
            fits = more <= self.n
            fits &= self.sorted[row, np.where(fits, more, 1) - 1] < x
            below = np.where(fits, more, below)
        return below

    def candidates(self, at: np.ndarray, half: float) -> np.ndarray:
        """The vectors that stand in enough of the windows of this half-width around a query's projections."""
        low, high = self.ranks(np.stack([at - half, at + half]))
        size = high - low
        full = int((size == self.n).sum())  # windows that hold every vector; they are left out of the count
        if full >= self.least:
            return np.arange(self.n)
        size[size == self.n] = 0
        np.subtract(self.place, low.astype(np.uint16)[:, None], out=self.shifted)  # wraps below the window, so one comparison does
        np.less(self.shifted, size.astype(np.uint16)[:, None], out=self.inside)
        return np.flatnonzero(np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8) >= self.least - full)

    def search(self, directions: np.ndarray, wanted: int, factor: float = 1.03) -> Iterator[np.ndarray]:
        """For each query the vectors to verify: at least ``wanted``, or all if there are fewer.

        Virtual rehashing starts from the width that served the query before. It ends at
        the latest when the windows hold whole arrays.
        """
        wanted = min(wanted, self.n)
        for at in (self.norm * directions) @ self.a[:-1]:
            hits, widened = self.candidates(at, self.half), False
            while len(hits) < wanted:
                self.half *= factor
                hits, widened = self.candidates(at, self.half), True
            if not widened and len(hits) > 1.1 * wanted:  # narrower for the next query; this one keeps what it has
                self.half /= factor
            yield hits


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", projections: int = 128, share: float = 0.7, verify: float = 0.15, least: int = 400, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best found for each row that ``queries`` marks.

    Windows grow until they reach at least the share ``verify`` of a block's vectors, and ``least``.
    """
    small_batches(vectors.sparkSession)
    valid = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    valid = valid.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    valid = cut(valid.withColumn("d", F.size("v")))
    top = valid.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d, n = (top["d"], top["n"]) if top else (0, 0)
    parts = max(1, math.ceil(n / block), min(vectors.sparkSession.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    rows = valid.where(F.col("d") == d)
    placed = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), "vec_id", "v")
    asked = rows.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "vec_id", "v")
    id_type = dict(valid.dtypes)["vec_id"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, index = None, [], None

        def built() -> tuple[Windows, np.ndarray, list[list]]:
            """The block's windows, distinct vectors and their ids."""
            ids, x = [i for a, _ in held for i in a], np.concatenate([b for _, b in held])
            members: dict[int, list] = {}
            for i, f in enumerate(distinct_rows(x).tolist()):
                if len(members.setdefault(f, [])) <= k:  # of equal vectors the k + 1 smallest ids are enough
                    members[f].append(ids[i])
            x = x[list(members)]
            return Windows(x, projections, share, seed), x, list(members.values())

        def best(q: np.ndarray, query_ids: list) -> list[tuple]:
            windows, x, names = index
            out, directions, top = [], windows.directions(q), float(np.abs(x).max()) * d
            for query, vector, direction, hits in zip(query_ids, q, directions, windows.search(directions, max(least, math.ceil(verify * windows.n))), strict=True):
                reach = top * float(np.abs(vector).max())
                if len(hits) > k + 1 and 1e-290 < reach < 1e300:  # nothing over- or underflows; single precision leaves out only what is below the best by more than its error
                    rough = windows.coarse[hits] @ direction.astype(np.float32)
                    margin = 2 * d * 2.0**-23 * windows.norm
                    hits = hits[rough >= np.partition(rough, -k - 1)[-k - 1] - margin]
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = (x[hits] * vector).sum(1)
                scores[np.isnan(scores)] = -np.inf
                found = [(-s, i) for h, s in zip(hits.tolist(), scores.tolist(), strict=True) for i in names[h] if i != query]
                out += [(query, i, -s) for s, i in sorted(found)[:k]]
            return out

        for batch in slices(batches, 1000):
            at, kinds, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            flat = batch.column(3).flatten().to_numpy().reshape(-1, d)
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if at[a] != part:
                    part, held, index = at[a], [], None
                names = ids.slice(a, b - a).to_pylist()
                if kinds[a] == 0:
                    held.append((names, flat[a:b].copy()))
                    continue
                if not held and index is None:  # no vector in the block
                    continue
                if index is None:
                    index, held = built(), []
                cols = list(zip(*best(flat[a:b], names), strict=True)) or [()] * 3
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (ids.type, ids.type, pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    dealt = placed.union(asked).repartition("part").sortWithinPartitions("part", "kind", "vec_id")
    found = dealt.mapInArrow(search, f"query_id {id_type}, vec_id {id_type}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
