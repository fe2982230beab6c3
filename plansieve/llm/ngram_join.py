"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

A document's row of the matrix is its set of hashed word n-grams. Equal rows are one
class from the start. Columns are ordered from rare to frequent by a count sketch of
fixed size, ties by hash. Which rows have to be multiplied with each other is found out
from few entries of each row. A short row, or any if the threshold is low, enters its first
``n - ceil(t*n) + 1`` columns, of which two rows that reach the threshold share one. Of a
longer row that would let in every row that shares a rare column by chance, more of them
the more rows there are. So the hash deals its columns into parts, a power of two of them by
its length; a row that links with it differs in at most ``d = n * (1 - t) / t`` columns, so
in no more parts, and of the ``d + 1`` parts whose columns are rarest together, in an
order that all rows have in common, the two share one with all its columns. Rows that can
link with rows of the next number of parts enter the parts of that number, too. Then:

1. Regions. Within a column rows gather around leaders: the distance is the number of
   places in which two parity signatures differ, which is never more than the symmetric
   difference has members. A row near a leader (as near as a linked row must be) is
   covered by it, and every row as near as a row linked with a covered one can be, by the
   triangle inequality, joins the leader's region. So linked rows are always in one
   region, and a column gives a forest of fewer edges than it has rows. A column of very
   many rows is dealt into blocks, whose leaders then meet. The signatures of 512 bits that
   go with the entries say little about long rows, so the regions are gathered once more
   by themselves, with signatures of two bits and more for each member. In a column of few
   rows nothing is gathered, as long rows that met there by chance would grow into one region,
   the faster the more rows there are: its pairs are tested for a link, with the short
   signatures and then with the long ones, and those that pass are edges.
2. Product. The rows of a region are multiplied block by block: overlaps are accumulated
   for every pair, and pairs below the overlap that their sizes ask for are discarded. What
   leaves a block is a row for each of its rows: the number of its links and a row it is
   connected with.

Neither step emits pairs but those of columns of few rows, so what moves is in proportion to
the entries, and for a region of m rows to m times its number of blocks. Regions and links become components by label
propagation along minima.

Sets are told apart by two 64-bit digests; if equal first digests ever had different second
ones, the scan is repeated with other digests. N-grams are 64-bit hashes.

Defined cases: null text and text without words has 0 n-grams and links with nothing;
fewer than ``width`` words are one n-gram; rows with equal ids are copies of a document
id like any other row and keep a row each in ``join_similar``; null ids never become a component's id
unless all its members have none; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, discard, mix64, slices, small_batches, store

#: The sketch that orders columns has about COUNTERS counters a row of the matrix, within these powers of two; CHUNK of them travel together.
COUNTERS, LEAST_BITS, MOST_BITS, CHUNK = 16, 16, 24, 1 << 14
#: Rows of fewer columns enter single columns; others parts, at least SPARE (a fraction) times as many as they enter.
SHORT, SPARE = 64, (5, 4)
#: Bits of a parity signature that goes with entries, and most bits of one of a row.
SIGNATURE, WIDEST = 512, 1 << 17
#: The most rows of a column that are gathered at once, and of a region in a block of the product.
BLOCKS = (4096, 1024)
#: The pairs of a column of up to so many entries are tested one by one.
FEW = 16
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class Words(dict):
    """Word to the 8 bytes of its hash."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_digest(word)
        return value


def shingles(text: bytes, width: int, words: Words) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    hashes = np.frombuffer(b"".join(map(words.__getitem__, text.lower().split())), ">u8").astype(np.uint64)
    n = len(hashes)
    if not n:
        return hashes
    k = min(n, width)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += mix64(hashes[i : n - k + 1 + i] + np.uint64(i)) if i >= len(ODD) else hashes[i : n - k + 1 + i] * ODD[i]
        total ^= total >> np.uint64(29)
    return np.unique(mix64(total))


def needed(n: int, threshold: tuple[int, int]) -> int:
    """The least overlap of a row of n entries with any row that it links with."""
    return -(-n * threshold[0] // threshold[1])


def apart_at_most(n: int, threshold: tuple[int, int]) -> int:
    """The most columns that a row of n entries and one that it links with don't share."""
    return n * (threshold[1] - threshold[0]) // threshold[0]


def parts_of(n: int, threshold: tuple[int, int]) -> int:
    """The parts that the columns of a row of n entries are dealt into, a power of two; 0: single columns are entered."""
    if n < SHORT or 4 * (threshold[1] - threshold[0]) > threshold[0]:
        return 0
    return 1 << (-(-SPARE[0] * (apart_at_most(n, threshold) + 1) // SPARE[1]) - 1).bit_length()


def first_entries(s: np.ndarray, cell: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """What a row of columns s, of levels ``cell``, enters: two rows that link share an entry unless they are equal."""
    n, (up, down) = len(s), threshold
    d = apart_at_most(n, threshold)
    if not d:  # links with equal rows only
        return s[:0]
    parts, last, out = parts_of(n, threshold), parts_of(n * down // up, threshold), []
    if not parts:
        k = n - needed(n, threshold) + 1
        near = np.flatnonzero(cell <= np.partition(cell, k - 1)[k - 1])
        out.append(s[near[np.argsort(cell[near], kind="stable")[:k]]])
        parts = parts_of(SHORT, threshold) or 1
    rare = 256 - cell.astype(np.int64)
    while parts <= last:
        part = (s >> np.uint64(20) & np.uint64(parts - 1)).astype(np.int64)
        total = np.zeros(parts, np.uint64)
        np.add.at(total, part, s)
        first = np.argsort(-np.bincount(part, rare, parts), kind="stable")[: d + 1]  # empty parts come last
        out.append(mix64(total[first] ^ mix64((first + (parts << 32)).astype(np.uint64))))
        parts *= 2
    return np.concatenate(out)


def fingerprint(s: np.ndarray, seed: int = 0) -> int:
    """An order-free 64-bit digest of a set, as a signed integer; seeds give independent ones."""
    with np.errstate(over="ignore"):
        return int(mix64(s ^ mix64(np.array([seed + 1], np.uint64))[0]).sum(dtype=np.uint64).astype(np.int64))


def signature(s: np.ndarray) -> np.ndarray:
    """For each of at least two slots a member, a power of two, whether an odd number of members falls into it; packed."""
    slots = min(WIDEST, max(SIGNATURE, 1 << (2 * len(s) - 1).bit_length())) if len(s) else SIGNATURE
    odd = np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(sig: np.ndarray, size: int) -> np.ndarray:
    """A signature (or a row of them for each) with fewer slots, of ``size`` bytes."""
    while sig.shape[-1] > size:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] ^ sig[..., half:]
    return sig


class Signatures:
    """Packed signatures of several sizes, each also folded to all smaller sizes."""

    def __init__(self, raw: list[bytes]):
        size = np.array([len(x) for x in raw], np.int64)
        self.level = np.log2(np.maximum(size, 1) * 8 // SIGNATURE).astype(np.int64)
        self.matrix, self.at = {}, {}
        longer: np.ndarray | None = None
        for level in range(int(self.level.max(initial=0)), -1, -1):
            own = np.flatnonzero(self.level == level)
            rows = np.frombuffer(b"".join([raw[i] for i in own.tolist()]), np.uint8).reshape(len(own), -1) if len(own) else np.zeros((0, SIGNATURE // 8 << level), np.uint8)
            if longer is not None:
                rows = np.concatenate([rows, folded(self.matrix[level + 1].view(np.uint8), rows.shape[1])])
                own = np.concatenate([own, longer])
            longer = own
            self.matrix[level] = np.ascontiguousarray(rows).view(np.uint64)
            self.at[level] = np.zeros(len(raw), np.int64)
            self.at[level][own] = np.arange(len(own))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many places the signatures of rows a and b differ, in the smaller size of the two."""
        level = np.minimum(self.level[a], self.level[b])
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            here, matrix, at = np.flatnonzero(level == k), self.matrix[k], self.at[k]
            step = max(1, (1 << 22) // matrix.shape[1])
            for part in (here[i : i + step] for i in range(0, len(here), step)):
                out[part] = np.bitwise_count(matrix[at[a[part]]] ^ matrix[at[b[part]]]).sum(1, dtype=np.int64)
        return out


def sketch_bits(n: int) -> int:
    """The size of the sketch for n rows: in proportion, up to 2**MOST_BITS bytes when broadcast."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n * COUNTERS)))))


def rows_of(docs: DataFrame, width: int, bits: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Scan 1: text key, n, both digests and signature of each document, and a sketch of the column counts per task; stored."""
    id_type = dict(docs.dtypes)[id_col]
    names = ["doc_id", "key", "n", "fp", "check", "sig", "wide", "chunk", "counts"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sketch, id_kind = Words(), np.zeros(1 << bits, np.uint16), None
        for batch in slices(batches, 256):
            id_kind = batch.column(0).type
            sets = [shingles(t, width, words) for t in as_bytes(batch.column(1))]
            at, n = np.unique((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            sketch[at] += np.minimum(n, 65535 - sketch[at]).astype(np.uint16)  # stops at the largest value
            numbers = ([len(s) for s in sets], [fingerprint(s, seed) for s in sets], [fingerprint(s, ~seed & 0xFFFF) for s in sets])
            none, wide = pa.nulls(len(sets)), [signature(s) for s in sets]
            yield pa.record_batch([batch.column(0), batch.column(2), *[pa.array(x, pa.int64()) for x in numbers], pa.array([folded(x, SIGNATURE // 8).tobytes() for x in wide], pa.binary()), pa.array([x.tobytes() for x in wide], pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if id_kind is not None:
            chunks = [(i, c) for i, c in enumerate(sketch.reshape(-1, CHUNK)) if c.any()]
            none = pa.nulls(len(chunks))
            yield pa.record_batch([pa.nulls(len(chunks), id_kind), *[none.cast(pa.int64())] * 4, *[none.cast(pa.binary())] * 2, pa.array([i for i, _ in chunks], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for _, c in chunks], pa.binary())], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), text_col, F.xxhash64(text_col).alias("key")).mapInArrow(scan, f"doc_id {id_type}, key long, n long, fp long, check long, sig binary, wide binary, chunk int, counts binary")
    return store(rows, "rows")


def column_order(rows: DataFrame, bits: int) -> np.ndarray:
    """The sketch's counts on a logarithmic scale, a byte per counter: at most 2**MOST_BITS bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chunk not in total:
                    total[chunk] = np.zeros(CHUNK, np.int64)
                total[chunk] += np.frombuffer(zlib.decompress(raw), np.uint16)
        levels = [(c, np.floor(4 * np.log2(1 + t)).astype(np.uint8).tobytes()) for c, t in total.items()]
        yield pa.record_batch([pa.array([c for c, _ in levels], pa.int32()), pa.array([x for _, x in levels], pa.binary())], ["chunk", "levels"])

    order = np.zeros(1 << bits, np.uint8)
    parts = rows.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, levels binary")
    for r in parts.collect():
        order[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["levels"], np.uint8)
    return order


def prefix_entries(docs: DataFrame, order: np.ndarray, width: int, threshold: tuple[int, int], seed: int, text_col: str) -> DataFrame:
    """Scan 2: the entries of each row: column or part, row, row length."""
    held, shift = docs.sparkSession.sparkContext.broadcast(order), 65 - len(order).bit_length()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, level, seen = Words(), held.value, set()
        for batch in slices(batches, 256):
            out: list[tuple[np.ndarray, int, int]] = []
            for text in as_bytes(batch.column(0)):
                s = shingles(text, width, words)
                if not len(s):
                    continue
                fp = fingerprint(s, seed)
                if fp in seen:  # a copy in the same task adds nothing
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(fp)
                first = first_entries(s, level[(s >> np.uint64(shift)).astype(np.int64)], threshold)
                out.append((first.astype(np.int64), fp, len(s)))
            if out:
                sizes = [len(h) for h, _, _ in out]
                cols = [np.concatenate([h for h, _, _ in out]), np.repeat([f for _, f, _ in out], sizes), np.repeat([n for _, _, n in out], sizes)]
                yield pa.record_batch([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int64, np.int32), strict=True)], ["h", "fp", "n"])

    return docs.select(text_col).mapInArrow(scan, "h long, fp long, n int")


def shared_entries(entries: DataFrame) -> DataFrame:
    """The entries of columns (or parts) that hold different rows, once for each row, with the number of entries of the column, copies counted; stored."""
    shared = entries.groupBy(F.col("h").alias("c_h")).agg(F.count("*").alias("c_n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("c_h", "c_n")
    return store(entries.join(shared, F.col("h") == F.col("c_h")).select("h", "c_n", "fp", "n").dropDuplicates(["h", "fp"]), "shared")


class Forest:
    """Edges that connect what wasn't connected before; forgets at ``most`` nodes, which only lets more edges through."""

    def __init__(self, most: int = 500_000):
        self.parent, self.most = {}, most

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    def joins(self, a: int, b: int) -> bool:
        if len(self.parent) > self.most:
            self.parent.clear()
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def gather(group: np.ndarray, n: np.ndarray, fp: np.ndarray, sig: Signatures, threshold: tuple[int, int], spread: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges that connect the regions of each group, and a mask of the leaders.

    Rows are sorted by group and n. ``spread``: how many links away from a row may be
    that it stands for (0 for rows themselves, 1 for leaders of blocks).
    """
    up, down = threshold
    t, rho, far = up / down, (down - up) / (down + up), 2 * spread + 2
    number = np.cumsum(np.append(0, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    left, leads = np.ones(len(n), bool), np.zeros(len(n), bool)
    label, to, active = np.arange(len(n)), np.arange(len(n)), np.arange(len(n))
    edges: list[tuple[int, int]] = []
    lead = np.full(int(number[-1]) + 1 if len(n) else 0, -1)
    while len(active):
        free = active[left[active]]
        first = free[np.append(True, number[free[1:]] != number[free[:-1]])] if len(free) else free
        lead[:] = -1
        lead[number[first]] = first
        leads[first] = True
        active = active[lead[number[active]] >= 0]
        at = lead[number[active]]
        apart = sig.apart(active, at)
        long, short = np.maximum(n[active], n[at]), np.minimum(n[active], n[at])
        covered = (apart <= rho * (long + short) + 1e-9) & (short >= t * long - 1e-9)
        left[active[covered | (active == at)]] = False
        joins = (apart <= 2 * far * rho * long / t ** (far // 2) + 1e-9) & (short >= t**far * long - 1e-9) & (label[active] != label[at])
        rows, leaders = active[joins], at[joins]
        old, which = np.unique(label[rows], return_index=True)
        if len(old):
            edges += zip(fp[rows[which]].tolist(), fp[leaders[which]].tolist(), strict=True)
            to[old] = label[leaders[which]]
            label[active] = to[label[active]]
            to[old] = old
    return edges, leads


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, sig: Signatures, threshold: tuple[int, int]) -> np.ndarray:
    """Whether the lengths and signatures of rows a and b allow a link."""
    up, down = threshold
    close = np.flatnonzero(down * np.minimum(n[a], n[b]) >= up * np.maximum(n[a], n[b]))
    out = np.zeros(len(a), bool)
    out[close] = (down + up) * sig.apart(a[close], b[close]) <= (down - up) * (n[a[close]] + n[b[close]])
    return out


def pair_edges(entries: DataFrame, signed: DataFrame, whole: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of rows (entries: h, fp, n) that share an h and may link by their whole signatures; each once.

    signed: fp and short signature of each row; whole: fp, n and whole signature.
    """
    signed = signed.toDF("s_fp", "sig")
    rows = entries.join(signed, F.col("fp") == F.col("s_fp")).select("h", F.col("n").cast("long").alias("n"), "fp", "sig")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def pairs(table: pa.Table, old: int) -> pa.RecordBatch:
            h, n, fp = (table.column(k).to_numpy() for k in range(3))
            sig, met = Signatures(table.column(3).to_pylist()), [np.zeros((3, 0), np.int64)]
            for step in range(1, FEW):
                a = np.arange(max(0, old - step), max(0, old - step, len(h) - step))  # pairs of old rows are out
                a = a[h[a] == h[a + step]]
                a = a[may_link(a, a + step, n, sig, threshold)]
                b = a + step
                met.append(np.array([np.minimum(fp[a], fp[b]), np.maximum(fp[a], fp[b]), np.minimum(n[a], n[b]) > SIGNATURE // 2]))
            new = [p for p in set(zip(*np.concatenate(met, 1).tolist(), strict=True)) if p[:2] not in seen]
            if len(seen) > 500_000:
                seen.clear()
            seen.update(p[:2] for p in new)
            return pa.record_batch([pa.array([p[k] for p in new], pa.int64()) for k in range(3)], ["a", "b", "longer"])

        held, old, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 14:
                table = pa.Table.from_batches(held).combine_chunks()
                yield pairs(table, old)
                held, old, size = table.slice(table.num_rows - FEW + 1).to_batches(), FEW - 1, 0
        if size:
            yield pairs(pa.Table.from_batches(held).combine_chunks(), old)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            m, n = batch.num_rows, np.concatenate([batch.column(k).to_numpy() for k in (2, 3)])
            sig = Signatures(batch.column(4).to_pylist() + batch.column(5).to_pylist())
            yield batch.filter(pa.array(may_link(np.arange(m), np.arange(m, 2 * m), n, sig, threshold))).select(["a", "b"])

    pairs = store(rows.repartition("h").sortWithinPartitions("h", "n", "fp").mapInArrow(meet, "a long, b long, longer long"), "pairs")
    longer = pairs.where("longer = 1").select("a", "b").distinct()
    both = longer.join(whole.toDF("a", "n_a", "sig_a"), "a").join(whole.toDF("b", "n_b", "sig_b"), "b")
    tested = both.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(checked, "a long, b long")
    return pairs.where("longer = 0").select("a", "b").distinct().union(tested)


def region_edges(entries: DataFrame, signed: DataFrame, threshold: tuple[int, int], block: int, whole: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between rows (entries: h, c_n, fp, n) so that linked rows that share an h are connected; stored.

    signed: fp and signature of each row. A group h of more than ``block`` rows is dealt
    into blocks by hash. Their leaders meet afterwards, in pairs of blocks if they are
    more than a block again. With ``whole`` (fp, n and whole signature) groups of up to
    ``FEW`` entries give the pairs that may link by it instead.
    """
    pairs = None
    if whole is not None:
        pairs = pair_edges(entries.where(F.col("c_n") <= FEW), signed, whole, threshold)
        entries = entries.where(F.col("c_n") > FEW)
    blocks = F.ceil(F.col("c_n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    signed = signed.toDF("s_fp", "sig")
    rows = entries.join(signed, F.col("fp") == F.col("s_fp")).withColumn("blocks", blocks).withColumn("i", own).select("h", "i", F.col("i").alias("j"), F.col("blocks"), F.col("n").cast("long").alias("n"), "fp", "sig")

    def found(rows: DataFrame, spread: int) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, held, size = Forest(), [], 0

            def done(cols: list[np.ndarray]) -> pa.RecordBatch:
                h, i, j, blocks, n, fp, raw = cols
                new = np.append(True, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
                edges, leads = gather(np.cumsum(new), n, fp, Signatures(raw), threshold, spread)
                edges = [e for e in edges if forest.joins(*e)]
                up = np.flatnonzero(leads & (blocks > 1)) if not spread else np.zeros(0, np.int64)
                none, last = [None] * len(up), [None] * len(edges)
                return pa.record_batch(
                    [
                        pa.array([*[a for a, _ in edges], *fp[up].tolist()], pa.int64()),
                        pa.array([*[b for _, b in edges], *none], pa.int64()),
                        pa.array([*last, *h[up].tolist()], pa.int64()),
                        pa.array([*last, *n[up].tolist()], pa.int64()),
                        pa.array([*last, *[raw[x] for x in up.tolist()]], pa.binary()),
                    ],
                    ["a", "b", "h", "n", "sig"],
                )

            def flat(held: list[pa.RecordBatch]) -> list:
                table = pa.Table.from_batches(held)
                return [*[table.column(k).to_numpy() for k in range(6)], table.column(6).to_pylist()]

            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                size += batch.nbytes
                if size >= 1 << 22:
                    table = pa.Table.from_batches(held).combine_chunks()
                    h, i, j = (table.column(k).to_numpy() for k in range(3))
                    whole = int(np.flatnonzero((h != h[-1]) | (i != i[-1]) | (j != j[-1]))[-1:].sum() + 1) if ((h[0], i[0], j[0]) != (h[-1], i[-1], j[-1])) else 0
                    if whole:
                        yield done(flat(table.slice(0, whole).to_batches()))
                    held = table.slice(whole).to_batches()
                    size = table.nbytes * (table.num_rows - whole) // table.num_rows
            if held:
                yield done(flat(held))

        dealt = rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "n", "fp")
        return store(dealt.mapInArrow(work, "a long, b long, h long, n long, sig binary"), "regions")

    first = found(rows, 0)
    edges, leaders = first.where("b is not null").select("a", "b"), first.where("b is null")
    if pairs is not None:
        edges = edges.union(pairs)
    if leaders.isEmpty():
        return edges
    counted = leaders.join(leaders.groupBy(F.col("h").alias("c_h")).agg(F.count("*").alias("c_n")), F.col("h") == F.col("c_h"))
    met = (
        counted.withColumn("fp", F.col("a"))
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "blocks", "n", "fp", "sig")
    )
    return edges.union(found(met, 1).select("a", "b"))


def bit_filter(wanted: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, with those of the hashed ids of ``wanted`` set."""
    chunk = 1 << min(bits, 20)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(1).to_numpy()
            for c in np.unique(at // chunk).tolist():
                total.setdefault(c, np.zeros(chunk, bool))[at[at // chunk == c] % chunk] = True
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in total.values()], pa.binary())], ["chunk", "bits"])

    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    parts = wanted.select(F.floor(place / chunk).cast("long").alias("chunk"), place.alias("place")).repartition("chunk").mapInArrow(fill, "chunk long, bits binary")
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in parts.collect():  # 2**(bits - 3) bytes in all
        out[r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Scan 3: fp and set of the documents with ids in ``wanted`` (doc_id, fp), once and more for each fp, and of some others.

    A bit filter over the wanted ids, of 16 bits for each and 16 MB at most, spares most
    other documents; what it lets through in error is joined away.
    """
    bits = min(27, max(16, math.ceil(math.log2(16 * max(1, wanted.count())))))
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, mask, seen = Words(), held.value, set()
        for batch in slices(batches, 256):
            at = batch.column(0).to_numpy()
            hit = mask[at >> 3] >> (at & 7).astype(np.uint8) & 1
            chosen = batch.filter(pa.array(hit == 1))
            sets = {fingerprint(s, seed): s for t in as_bytes(chosen.column(1)) if len(s := shingles(t, width, words))}
            new = [fp for fp in sets if fp not in seen]
            if len(seen) > 500_000:
                seen.clear()
            seen.update(new)
            yield pa.record_batch([pa.array(new, pa.int64()), pa.array([sets[fp].tobytes() for fp in new], pa.binary())], ["fp", "members"])

    placed = docs.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << bits)).alias("bit"), F.col(text_col).alias("text"))
    return placed.mapInArrow(scan, "fp long, members binary")


def overlaps(sets: list[np.ndarray], dense: int = 32, columns: int = 1024) -> np.ndarray:
    """The product of the incidence matrix of the sets with its transpose, without the diagonal.

    Columns of up to ``dense`` rows are added pair by pair, fuller ones as dense slabs.
    """
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = held[column] > 1
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros(m * m, np.int64)
    thin = held[column] <= dense
    r, c = row[thin], column[thin]
    live, step = np.arange(len(r)), 1
    while len(live):
        live = live[live + step < len(r)]
        live = live[c[live] == c[live + step]]
        if len(live):
            both += np.bincount(r[live] * m + r[live + step], minlength=m * m)
        step += 1
    both = both.reshape(m, m)
    both += both.T
    r, c = row[~thin], column[~thin]
    if len(r):
        full = np.zeros((m, m), np.float32)  # counts stay far below 2**24
        number = np.cumsum(np.append(0, c[1:] != c[:-1]))
        cuts = np.searchsorted(number, np.arange(0, number[-1] + columns + 1, columns))
        for a, b in zip(cuts, cuts[1:], strict=False):
            slab = np.zeros((m, columns), np.float32)
            slab[r[a:b], number[a:b] % columns] = 1
            full += slab @ slab.T
        both += np.rint(full).astype(np.int64)
    np.fill_diagonal(both, 0)
    return both


def block_links(sets: list[np.ndarray], own: np.ndarray, copies: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block the copies of rows it links with, and the first row it is connected with. Rows of one block only, or links between two."""
    up, down = threshold
    n = np.array([len(s) for s in sets])
    both = overlaps(sets)
    links = (both > 0) & (down * both >= up * (n[:, None] + n[None, :] - both))
    if own.min() != own.max():
        links &= own[:, None] != own[None, :]
    first, before = np.arange(len(n)), None
    a, b = np.nonzero(links)
    while before is None or (first != before).any():
        before = first.copy()
        np.minimum.at(first, a, before[b])
        first = first[first]
    return links @ copies, first


def linked_rows(regions: DataFrame, classes: DataFrame, sets: DataFrame, threshold: tuple[int, int], most_rows: int, most_members: int = 1 << 20) -> DataFrame:
    """The blocked product: node, linked (copies of the rows it links with) and least (a node it is connected with), a row for each node and block pair in which it has links; stored.

    A region of more than ``most_rows`` rows or ``most_members`` entries is dealt into
    blocks by hash, and each pair of blocks is multiplied apart.
    """
    sizes = classes.select(F.col("fp").alias("node"), "n", "copies").join(regions, "node")
    blocks = F.ceil(F.greatest(F.count("*") / most_rows, F.sum("n") / most_members)).cast("int")
    cells = cut(sizes.groupBy(F.col("component").alias("region")).agg(blocks.alias("blocks")))
    placed = cut(sizes.join(cells, F.col("component") == F.col("region")).select("region", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"), "node", "copies"))
    dealt = (
        sets.join(placed, F.col("fp") == F.col("node"))
        .dropDuplicates(["fp"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "members")
        .repartition("region", "i", "j")
        .sortWithinPartitions("region", "i", "j", "node")
    )

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out, ready = None, [], [], 0

        def done() -> None:
            if len(held) < 2:
                return
            node = [r[1] for r in held]
            linked, first = block_links([np.frombuffer(r[3], np.uint64) for r in held], np.array([r[0] for r in held]), np.array([r[2] for r in held], np.int64), threshold)
            out.extend((node[k], int(linked[k]), node[first[k]]) for k in np.flatnonzero(linked).tolist())

        def batch_of(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["node", "linked", "least"])

        for batch in slices(batches, 256):
            for region, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if (region, i, j) != key:
                    done()
                    key, held = (region, i, j), []
                held.append(row)
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        done()
        yield batch_of(out)

    return store(dealt.mapInArrow(product, "node long, linked long, least long"), "links")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node) of every node of a link table (a, b), by alternating large and small stars.

    Every node has a row, if only nodes of links do. Rounds end when each node but the
    smallest of its component has one edge, to that one; a component of n nodes needs about
    log(n) rounds, and more than ``most_rounds`` are an error.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    for _ in range(most_rounds):
        edges = cut(edges)
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("high"), F.lit(0).alias("low")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).where("high > 1 or (high = 1 and low > 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = small.union(down.select("u", F.col("m").alias("v"))).distinct()
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def classes_of(docs: DataFrame, width: int, threshold: tuple[int, int], id_col: str, text_col: str, blocks: tuple[int, int] = BLOCKS, seeds: int = 8) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key, n, fp) and the classes of equal rows: fp, component, doc_id (the least), least (the first row: null ids last, then by text key), copies, and linked (rows of other classes that they link with)."""
    small_batches(docs.sparkSession)
    bits = sketch_bits(docs.count())
    for seed in range(seeds):
        rows = rows_of(docs, width, bits, seed, id_col, text_col)
        found = rows.where("n is not null").drop("chunk", "counts", "sig", "wide")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "key")).alias("least")
        alike = (F.min("check") != F.max("check")).alias("clash")
        classes = store(rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), least, F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("wide").alias("wide"), F.first("n").alias("n"), alike), "classes")
        if classes.where("clash").isEmpty():
            break
    else:
        raise RuntimeError(f"no digest of {seeds} tells all sets apart")
    entries = store(prefix_entries(docs, column_order(rows, bits), width, threshold, seed, text_col), "entries", "lz4")
    shared = shared_entries(entries)
    discard(entries)
    coarse = components(region_edges(shared, classes.select("fp", "sig"), threshold, blocks[0], classes.select("fp", "n", "wide")))
    discard(shared)
    coarse = cut(coarse.join(classes.select(F.col("fp").alias("node"), "n"), "node").select(F.col("component").alias("h"), F.col("node").alias("fp"), "n"))
    sized = coarse.join(coarse.groupBy(F.col("h").alias("c_h")).agg(F.count("*").alias("c_n")), F.col("h") == F.col("c_h"))
    regions = cut(components(region_edges(sized, classes.select("fp", "wide"), threshold, blocks[0])))
    sets = whole_sets(docs, classes.join(regions.select(F.col("node").alias("fp")), "fp", "left_semi").select("doc_id", "fp"), width, seed, id_col, text_col)
    links = linked_rows(regions, classes, sets, threshold, blocks[1])
    nodes = components(links.select(F.col("node").alias("a"), F.col("least").alias("b")))
    nodes = nodes.join(links.groupBy("node").agg(F.sum("linked").alias("linked")), "node")
    labelled = classes.drop("sig", "wide", "n", "clash").join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return found, cut(labelled)


def join_similar(docs: DataFrame, width: int = 3, threshold: tuple[int, int] = (90, 100), id_col: str = "doc_id", text_col: str = "text", blocks: tuple[int, int] = BLOCKS) -> DataFrame:
    """A row per document: doc_id, n_shingles, copies (documents with an equal set, itself included), n_links (documents it links with, copies counted) and component_id.

    Two documents link when 100 * |intersection| >= 90 * |union| (``threshold`` gives the two factors).
    """
    found, labelled = classes_of(docs, width, threshold, id_col, text_col, blocks)
    names = cut(labelled.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    n_links = F.col("copies") - 1 + F.coalesce("linked", F.lit(0))
    final = labelled.drop("doc_id").join(names, "component").select(F.col("fp").alias("k_fp"), "component_id", "copies", n_links.alias("n_links"))
    own = F.when(F.col("n") > 0, F.col("fp"))
    return found.withColumn("own", own).join(final, F.col("own") == F.col("k_fp"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 3, threshold: tuple[int, int] = (90, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the first by id (null ids last), then fingerprint and text.

    Rows are told apart by id and text; of rows with both equal, one stays by a hash of
    all its columns. Documents without words link with nothing, so all of them stay.
    """
    found, labelled = classes_of(docs, width, threshold, id_col, text_col)
    names = cut(labelled.groupBy("component").agg(F.min("least").alias("one")))
    ones = labelled.select("fp", "component").join(names, "component").select(F.col("fp").alias("k_fp"), "one")
    stays = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("fp") == F.col("one.fp")) & (F.col("key") == F.col("one.key"))
    rows = found.where("n > 0").join(ones, F.col("fp") == F.col("k_fp"))
    told = rows.groupBy(F.col("doc_id").alias("t_id"), F.col("key").alias("t_key")).agg(F.max(stays).alias("stays"), F.count("*").alias("times"))
    told = cut(told.where("not stays or times > 1"))  # the rows that go, and those of which one stays
    same = docs[id_col].eqNullSafe(told["t_id"]) & (F.xxhash64(docs[text_col]) == told["t_key"])
    kept = docs.join(told, same, "left_anti")
    repeated = told.where("stays")
    if repeated.isEmpty():
        return kept
    whole = F.struct(*docs.columns)
    order = F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t])
    again = docs.join(repeated, docs[id_col].eqNullSafe(repeated["t_id"]) & (F.xxhash64(docs[text_col]) == repeated["t_key"]))
    return kept.unionByName(again.groupBy("t_id", "t_key").agg(F.min_by(whole, order).alias("row")).select("row.*"))
