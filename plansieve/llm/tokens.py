"""Tokenizing with public vocabularies: whole texts, remembered by chunk.

A text is cut at single spaces and line ends, places at which the pre-tokenizers of
the supported files always start a new piece, so a text's ids are its chunks' ids in a
row. Each distinct chunk is encoded by the tokenizers library once while it is
remembered. Chunks are looked up by a hash and then compared byte by byte. Texts with
other white space, or with runs of it, texts that hold one of the file's added tokens and
texts with a chunk whose hash another chunk has go to the library whole. The library is used as
loaded: an added token that stands in a text gets its own id.
"""

from __future__ import annotations

import gc
import os
from functools import cache

import numpy as np


#: Marks that may follow a word; neither letters nor digits, no apostrophe.
MARKS = ".,;:!?#$%&*|()\"-"


class Table:
    """Chunks by a 64-bit hash of their bytes, with these bytes and their ids, all in flat arrays.

    Open addressing; ``look`` gives the entry number of a hash or -1, ``add`` takes chunks
    with new hashes, ``same`` compares chunks with the entries found for them.
    """

    def __init__(self, bits: int, kind: np.dtype):
        self.mask = (1 << bits) - 1
        self.keys, self.entry = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.ids, self.used, self.n = np.zeros(1 << 16, kind), 0, 0
        self.offset, self.length = np.zeros(1 << bits - 1, np.int64), np.zeros(1 << bits - 1, np.int32)
        self.text, self.filled = np.zeros(1 << 16, np.uint8), 0
        self.place, self.size = np.zeros(1 << bits - 1, np.int64), np.zeros(1 << bits - 1, np.int32)

    def look(self, h: np.ndarray) -> np.ndarray:
        found = np.full(len(h), -1, np.int64)
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            at = slot[left]
            key = self.keys[at]
            hit = key == h[left]
            found[left[hit]] = self.entry[at[hit]]
            left = left[~hit & (key != 0)]
            slot[left] = slot[left] + 1 & self.mask
        return found

    def same(self, entry: np.ndarray, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether each chunk has the bytes of its entry; the chunks follow one another in ``data`` from ``start``."""
        size = np.diff(np.append(start, len(data)))
        equal = size == self.size[entry]
        if equal.all():
            return np.logical_and.reduceat(self.text[np.repeat(self.place[entry] - start, size) + np.arange(len(data))] == data, start)
        for i in np.flatnonzero(equal).tolist():
            at, n = int(self.place[entry[i]]), int(size[i])
            equal[i] = (self.text[at : at + n] == data[start[i] : start[i] + n]).all()
        return equal

    def add(self, h: np.ndarray, chunks: list[bytes], ids: list[bytes | None]) -> np.ndarray:
        """Entries of distinct new hashes; ids of None mark a chunk that doesn't stand alone (length -1)."""
        words = np.frombuffer(b"".join(chunks), np.uint8)
        if self.filled + len(words) > len(self.text):
            self.text = np.concatenate([self.text[: self.filled], np.zeros(max(len(self.text), len(words)), np.uint8)])
        self.text[self.filled : self.filled + len(words)] = words
        flat = np.frombuffer(b"".join([x or b"" for x in ids]), self.ids.dtype)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(flat)), self.ids.dtype)])
        self.ids[self.used : self.used + len(flat)] = flat
        size = np.array([len(x or b"") // self.ids.itemsize for x in ids], np.int64)
        entries = np.arange(self.n, self.n + len(h))
        each = np.array([len(c) for c in chunks], np.int64)
        self.place[entries], self.size[entries] = self.filled + np.cumsum(each) - each, each
        self.filled += len(words)
        self.offset[entries] = self.used + np.cumsum(size) - size
        self.length[entries] = np.where([x is None for x in ids], -1, size)
        self.used, self.n = self.used + len(flat), self.n + len(h)
        slot, left = (h & np.uint64(self.mask)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.entry[at] = h[free[first]], entries[free[first]]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = slot[left] + 1 & self.mask
        return entries


class ChunkEncoder:
    """Ids of texts as little-endian integers of ``kind``: 16 bits where the vocabulary fits, else 32.

    ``keeps_space``: a space belongs to the word after it (byte-level files); otherwise
    white space only separates. A chunk starts at a space, a line end or the start of
    the text. About ``most`` chunks are remembered, of ``MOST_BYTES`` together; then all are
    forgotten.
    """

    #: Bytes of text worked on at a time; longer texts go to the library.
    GROUP = 1 << 19
    MOST_BYTES = 1 << 25

    def __init__(self, path: str, keeps_space: bool, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        self.keeps_space, self.most = keeps_space, most
        self.cores: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        #: Ids that begin a word after a space, or that end a word: what parts the words of a joined text.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if keeps_space else t.endswith("</w>"))]] = True
        self.table = self._empty()
        rng = np.random.default_rng(11)
        self.values = rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
        factor = 0x9E3779B97F4A7C15
        self.power = np.cumprod(np.full(self.GROUP, factor, np.uint64))
        self.inverse = np.cumprod(np.full(self.GROUP, pow(factor, -1, 1 << 64), np.uint64))

    def _empty(self, least: int = 0) -> Table:
        return Table(max(12, (2 * max(self.most, least)).bit_length()), self.kind)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Straight from the library."""
        return [np.asarray(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, each as if after a space, from joined texts."""
        out: list[bytes] = []
        parts = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        joined = [" " + " ".join(part) for part in parts]
        for part, ids in zip(parts, map(np.frombuffer, self.whole(joined), [self.kind] * len(parts)), strict=True):
            at = np.flatnonzero(self.edge[ids])
            ends = [*at[1:].tolist(), len(ids)] if self.keeps_space else (at + 1).tolist()
            if len(ends) != len(part):
                out += self.whole([f" {w}" for w in part])
                continue
            raw, last, size = ids.tobytes(), 0, self.kind.itemsize
            for end in ends:
                out.append(raw[size * last : size * end])
                last = end
        return out

    def _learn(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of chunks, or None where white space keeps one from standing alone.

        A word with marks after it is its letters' ids and the marks' ids: a piece
        never mixes the two.
        """
        fold, out, words, rest = not self.keeps_space, {}, {}, []
        for c in chunks:
            core = c[1:].rstrip(MARKS)
            if c[0] == " " and core.isalpha() and (not fold or core.lower().isalpha()):
                words[c] = core.lower() if fold and core.isascii() else core
            else:
                rest.append(c)
        if len(self.cores) > 100_000:
            self.cores.clear()
        new = list({core for core in words.values() if core not in self.cores})
        self.cores.update(zip(new, self._words(new), strict=True))
        tails = {c[len(core) + 1 :] for c, core in words.items()}
        tail_ids = dict(zip(tails, self.whole(list(tails)), strict=True))
        for c, core in words.items():
            out[c] = self.cores[core] + tail_ids[c[len(core) + 1 :]]
        for c, ids in zip(rest, self.whole(rest), strict=True):
            bare = c[1:] if c[0] in " \n" else c
            alone = bare.split() == [bare] or (fold and not bare)
            out[c] = ids if alone else None
        return [out[c] for c in chunks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, one after the other."""
        tracing = gc.isenabled()
        gc.disable()  # nothing here is in a cycle
        try:
            raw = [t.encode("utf-8", "surrogatepass") if self.keeps_space else b" " + t.encode("utf-8", "surrogatepass").replace(b"\n", b" ") for t in texts]
            out: list[bytes] = [b""] * len(texts)
            group: list[int] = []
            size = 0
            for i, r in enumerate(raw):
                if len(r) > self.GROUP // 2:
                    out[i] = self.whole([texts[i]])[0]
                    continue
                if size + len(r) > self.GROUP:
                    self._group(group, raw, texts, out)
                    group, size = [], 0
                group.append(i)
                size += len(r)
            self._group(group, raw, texts, out)
            return out
        finally:
            if tracing:
                gc.enable()

    def _group(self, group: list[int], raw: list[bytes], texts: list[str], out: list[bytes]) -> None:
        buffer = b"".join([raw[i] for i in group])
        if not buffer:
            return
        data = np.frombuffer(buffer, np.uint8)
        size = np.array([len(raw[i]) for i in group])
        begin = np.cumsum(size) - size
        starts = data == 32
        if self.keeps_space:
            starts |= data == 10
        starts[begin[size > 0]] = True
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=total[1:])
        h = (total[end] - total[start]) * self.inverse[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h[h == 0] = 1
        if self.table.n > self.most or self.table.filled > self.MOST_BYTES:
            self.table = self._empty()
        entry = self.table.look(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            if self.table.n + len(new) > len(self.table.offset):
                self.table = self._empty(len(start))
                return self._group(group, raw, texts, out)
            chunks = [buffer[start[i] : end[i]] for i in missing[first].tolist()]
            entry[missing] = self.table.add(new, chunks, self._learn([c.decode("utf-8", "surrogatepass") for c in chunks]))[back]
        length = self.table.length[entry].astype(np.int64)
        owner = np.searchsorted(begin, start, "right") - 1
        odd = set(owner[(length < 0) | ~self.table.same(entry, data, start)].tolist())
        lower = buffer.lower()
        if any(t in lower for t in self.added):
            odd.update(k for k, i in enumerate(group) if any(t in raw[i].lower() for t in self.added))
        length = np.maximum(length, 0)
        done = np.cumsum(length)
        ids = self.table.ids[np.repeat(self.table.offset[entry] - (done - length), length) + np.arange(done[-1])]
        count = np.bincount(owner, length, len(group)).astype(np.int64)
        stops = (np.cumsum(count) * self.kind.itemsize).tolist()
        flat, last = ids.tobytes(), 0
        for k, (i, stop) in enumerate(zip(group, stops, strict=True)):
            out[i] = self.whole([texts[i]])[0] if k in odd else flat[last:stop]
            last = stop


@cache
def encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    """The worker's own encoder; it outlives a task, and so does what it remembers."""
    return ChunkEncoder(path, keeps_space)
