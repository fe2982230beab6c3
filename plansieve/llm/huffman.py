"""Token ids as files of canonical, length-limited Huffman codes.

Texts are tokenized once and their ids kept in the shared folder with one histogram
per task; the histograms are added up into the global counts, from which package-merge
finds code lengths of at most ``LIMIT`` bits and the canonical code follows. Ids are
range-sorted by document and written in independent blocks of whole documents, each
with the bit offset of every ``STRIDE``-th id. Decoding starts at all checkpoints of
several blocks side by side and looks codes up in one table.

A file is a folder with two Parquet tables: ``codebook`` (a row: ids and lengths) and
``blocks``, whose rows hold part and block numbers in document order, the documents'
ids and token counts, the first token's place within the part, bits and checkpoints.

Defined cases: null text counts as empty, an empty document is its end id alone; null
ids come first in order; documents with equal ids stand in the order of their token
counts and a hash of their ids; an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import as_texts, delete_on_exit, shared_dir, slices, small_batches, store

LIMIT = 18
STRIDE = 256
BLOCK = 1 << 16


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for counts of 0."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(float)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        rank = np.argsort(items, kind="stable")
        levels.append(rank < n)
        items = items[rank]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    return lengths


class Code:
    """The canonical code of given lengths, with its encoding and decoding tables."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.bits = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        sizes = np.int64(1) << (self.bits - lengths[order])
        starts = np.concatenate([[0], np.cumsum(sizes)])[: len(order)]
        self.left = np.zeros(len(lengths), np.uint64)  # codes at the upper end of 64 bits
        self.left[order] = starts.astype(np.uint64) << np.uint64(64 - self.bits)
        self.table = np.zeros(1 << self.bits, np.uint32)  # id and length of the code that starts here
        filled = np.repeat((order << 5 | lengths[order]).astype(np.uint32), sizes)
        self.table[: len(filled)] = filled
        self.table[len(filled) :] = 1

    def encode(self, ids: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
        """Bits of the ids, and the bit offset of every ``stride``-th id."""
        if not len(ids):
            return b"", np.zeros(0, np.int64)
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = end - size
        word = at >> 6
        shift = (at & 63).astype(np.uint64)
        left = self.left[ids]
        first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
        out = np.zeros(int(end[-1] + 63 >> 6), np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(left >> shift, first)
        last = np.concatenate([first[1:] - 1, [len(ids) - 1]])  # only these can reach into the next word
        last = last[(shift[last].astype(np.int64) + size[last]) > 64]
        out[word[last] + 1] |= left[last] << (np.uint64(64) - shift[last])
        return out.astype(">u8").tobytes()[: int(end[-1] + 7 >> 3)], at[::stride]

    def decode(self, bits: list[bytes], checkpoints: list[np.ndarray], counts: list[int], stride: int = STRIDE) -> list[np.ndarray]:
        """Ids of several blocks, decoded from all their checkpoints at once."""
        padded = [b + b"\0" * (8 + -len(b) % 4) for b in bits]
        base = np.cumsum([0, *[len(b) for b in padded]])[:-1] * 8
        words = np.frombuffer(b"".join([*padded, b"\0" * 8]), ">u4").astype(np.uint64)
        double = words[:-1] << np.uint64(32) | words[1:]
        at = np.concatenate([np.asarray(c, np.int64) + b for c, b in zip(checkpoints, base, strict=True)] or [np.zeros(0, np.int64)])
        steps = min(stride, max(counts, default=0))
        out = np.empty((steps, len(at)), np.uint32)
        keep, top = np.uint64(64 - self.bits), 32 * len(double) - 1
        for k in range(steps):
            window = double[at >> 5]
            window <<= (at & 31).astype(np.uint64)
            window >>= keep
            entry = self.table[window]
            out[k] = entry
            at += entry & 31
            np.minimum(at, top, out=at)
        out >>= 5
        done, lane = [], 0
        for n, c in zip(counts, checkpoints, strict=True):
            done.append(out[:, lane : lane + len(c)].T.reshape(-1)[:n] if n else np.zeros(0, np.uint32))
            lane += len(c)
        return done


def tokenize(docs: DataFrame, path: str, end_id: int, keeps_space: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n and ids (16-bit where they fit) of every document, and a histogram row per task; stored."""
    id_type = dict(docs.dtypes)[id_col]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, keeps_space)
        size = max(len(encoder.edge), end_id + 1)
        tail, width = np.array([end_id], encoder.kind).tobytes(), encoder.kind.itemsize
        histogram, id_kind = np.zeros(size, np.int64), None
        names = ["doc_id", "n", "ids", "histogram"]
        for batch in slices(batches, 256):
            id_kind = batch.column(0).type
            ids = [x + tail for x in encoder.encode(as_texts(batch.column(1)))]
            histogram += np.bincount(np.frombuffer(b"".join(ids), encoder.kind), minlength=size)
            yield pa.record_batch([batch.column(0), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.nulls(batch.num_rows, pa.binary())], names)
        if id_kind is not None:
            yield pa.record_batch([pa.nulls(1, id_kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([histogram.tobytes()], pa.binary())], names)

    rows = docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(encode, f"doc_id {id_type}, n long, ids binary, histogram binary")
    return store(rows, "ids")


def global_counts(stored: DataFrame) -> np.ndarray:
    """Counts of all ids; a row per id, at most the vocabulary, reaches the driver."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts = np.frombuffer(raw, np.int64)
                used = np.flatnonzero(counts)
                yield pa.record_batch([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["id", "n"])

    got = stored.where("histogram is not null").select("histogram").mapInArrow(unpack, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(got["id"].max()) + 1 if len(got) else 0, np.int64)
    counts[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def write_blocks(stored: DataFrame, path: str, limit: int = LIMIT, block: int = BLOCK) -> None:
    """Writes the ids of ``tokenize`` to ``path`` in ascending order of documents."""
    spark = stored.sparkSession
    lengths = code_lengths(global_counts(stored), limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(used.tolist(), lengths[used].tolist())], "ids array<long>, lengths array<long>").coalesce(1).write.parquet(f"{path}/codebook")
    code, id_type = Code(lengths), dict(stored.dtypes)["doc_id"]
    names = ["part", "block", "start", "doc_ids", "counts", "bits", "checkpoints"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start, held, tokens = TaskContext.get().partitionId(), 0, 0, [], 0

        def packed() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(x, f"<u{len(x) // n}") for _, x, n in held])
            bits, at = code.encode(ids)
            row = [[part], [number], [start], pa.array([pa.array([d for d, _, _ in held], id_kind)], pa.list_(id_kind)), [[n for _, _, n in held]], pa.array([bits], pa.binary()), [at.tolist()]]
            return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(row, [pa.int32(), pa.int64(), pa.int64(), None, pa.list_(pa.int64()), None, pa.list_(pa.int64())], strict=True)], names)

        for batch in slices(batches, 256):
            id_kind = batch.column(0).type
            for d, x, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append((d, x, n))
                tokens += n
                if tokens >= block:
                    yield packed()
                    number, start, held, tokens = number + 1, start + tokens, [], 0
        if held:
            yield packed()

    docs = stored.where("histogram is null").select("doc_id", "ids", "n", F.xxhash64("ids").alias("tie"))
    placed = docs.repartitionByRange("doc_id", "n", "tie").sortWithinPartitions("doc_id", "n", "tie").select("doc_id", "ids", "n")
    blocks = placed.mapInArrow(encode, f"part int, block long, start long, doc_ids array<{id_type}>, counts array<long>, bits binary, checkpoints array<long>")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of a file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids."""
    blocks = spark.read.parquet(f"{path}/blocks")
    book = spark.read.parquet(f"{path}/codebook").first()
    lengths = np.zeros(max(book["ids"], default=0) + 1, np.int64)
    lengths[np.asarray(book["ids"], np.int64)] = book["lengths"]
    code = Code(lengths)
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    before, total = {}, 0
    for r in blocks.groupBy("part").agg(F.max(F.col("start") + size).alias("n")).orderBy("part").collect():  # a row per part of the file
        before[r["part"]], total = total, total + r["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            part, start, doc_ids, counts, bits, points = (batch.column(i) for i in range(6))
            counts = counts.to_pylist()
            ids = code.decode(bits.to_pylist(), [np.asarray(x, np.int64) for x in points.to_pylist()], [sum(c) for c in counts])
            starts, crcs, kept = [], [], []
            for p, s, c, x in zip(part.to_pylist(), start.to_pylist(), counts, ids, strict=True):
                ends = np.cumsum(c)
                raw, s = memoryview(x.astype("<u4").tobytes()), s + before[p]
                for a, b in zip((ends - c).tolist(), ends.tolist(), strict=True):
                    starts.append(s + a)
                    crcs.append(zlib.crc32(raw[4 * a : 4 * b]))
                    if with_ids:
                        kept.append(x[a:b])
            cols = [doc_ids.flatten(), pa.array(starts, pa.int64()), pa.array([n for c in counts for n in c], pa.int64()), pa.array(crcs, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.record_batch(cols, names)

    id_type = dict(blocks.dtypes)["doc_ids"][6:-1]
    return blocks.select("part", "start", "doc_ids", "counts", "bits", "checkpoints").mapInArrow(decode, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, keeps_space: bool = False, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenizes all documents into a file; returns its path. Unless one is given it is in the shared folder, and goes when the JVM ends."""
    small_batches(docs.sparkSession)
    if path is None:
        path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
        delete_on_exit(docs.sparkSession, path)
    write_blocks(tokenize(docs, tokenizer, end_id, keeps_space, id_col, text_col), path)
    return path
