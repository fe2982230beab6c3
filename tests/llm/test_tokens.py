"""Token files and packing against the tokenizers library."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plansieve.llm import huffman, packing, tokens

public = pytest.importorskip("public_tokenizers")
FILES = (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True))


@pytest.mark.parametrize(("name", "keeps_space"), FILES)
def test_chunks_equal_whole_texts(name, keeps_space):
    encoder = tokens.ChunkEncoder(public.path(name), keeps_space, most=50)
    rng = random.Random(3)
    signs = " \n\t\r\x0b\x1c\x85\xa0 ab'sT9.,é$ßΣİ́"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for _ in range(2):
        assert encoder.encode(texts) == encoder.whole(texts)


def thue_morse(a, b, doublings=10):
    """A word whose hash by any power series modulo 2**64 is that of the same word with letters swapped."""
    for _ in range(doublings):
        a, b = a + b, b + a
    return a


@pytest.mark.parametrize(("name", "keeps_space"), FILES)
def test_equal_hashes_and_added_tokens(name, keeps_space):
    one, two = thue_morse("a", "b"), thue_morse("b", "a")
    texts = [one, two, f"x {one} y", f"x {two} y", f"{two} {one}", "a <|endoftext|> b", "a<|ENDOFTEXT|>b", "<|startoftext|>x", "plain words"]
    want = [reference(name, t)[:-1].tolist() for t in texts]
    assert want[0] != want[1]
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1)):
        single, together = (tokens.ChunkEncoder(public.path(name), keeps_space) for _ in range(2))
        got = [single.encode([texts[i]])[0] for i in order]
        assert got == together.encode([texts[i] for i in order])
        assert [np.frombuffer(x, single.kind).tolist() for x in got] == [want[i] for i in order]


def reference(name, text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path(name))
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("spread", [1.0, 1.4, 3.0])
def test_code(spread):
    rng = np.random.default_rng(1)
    ids = rng.zipf(1 + spread / 2, 50_000) % 30_000
    lengths = huffman.code_lengths(np.bincount(ids, minlength=30_000))
    used = lengths[lengths > 0]
    assert used.max() <= huffman.LIMIT and (2.0**-used).sum() <= 1
    code = huffman.Code(lengths)
    parts = [ids, ids[:777], ids[:0], ids[:1]]
    made = [code.encode(p) for p in parts]
    for p, d in zip(parts, code.decode([b for b, _ in made], [c for _, c in made], [len(p) for p in parts]), strict=True):
        assert (p == d).all()


def test_code_of_one_and_none():
    code = huffman.Code(huffman.code_lengths(np.array([0, 5])))
    bits, at = code.encode(np.array([1, 1, 1]))
    assert code.decode([bits], [at], [3])[0].tolist() == [1, 1, 1]
    assert huffman.code_lengths(np.zeros(4, int)).tolist() == [0, 0, 0, 0]


def test_file(spark, messy, nothing):
    name = FILES[0][0]
    path = huffman.encode_documents(messy, public.path(name))
    got = huffman.read_blocks(spark, path, with_ids=True).orderBy("start").collect()
    rows = sorted(messy.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert [g["doc_id"] for g in got] == [r["doc_id"] for r in rows]
    left, at = defaultdict(Counter), 0
    for r in rows:
        left[r["doc_id"]][tuple(reference(name, r["text"]).tolist())] += 1
    for g in got:
        ids = tuple(g["ids"])
        assert g["start"] == at and g["n_tokens"] == len(ids) and g["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and left[g["doc_id"]][ids] > 0
        left[g["doc_id"]][ids] -= 1
        at += len(ids)
    assert huffman.read_blocks(spark, huffman.encode_documents(nothing, public.path(name))).count() == 0


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(messy, nothing, capacity):
    name = FILES[1][0]
    rows = packing.pack_documents(messy, public.path(name), capacity=capacity, with_ids=True).collect()
    n = check_packing(rows, capacity)
    assert n <= 1.1 * -(-sum(r["length"] for r in rows) // capacity) + 1
    want = Counter()
    for r in messy.collect():
        ids = reference(name, r["text"])
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want.update((r["doc_id"], i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.pack_documents(nothing, public.path(name), capacity=capacity).count() == 0


@pytest.mark.parametrize("sizes", [[1024] * 5, [1] * 3000, [600] * 7 + [424] * 7, [513] * 10, list(range(1, 1025)) * 3, []])
def test_plan(sizes):
    counts = Counter(sizes)
    runs = packing.plan_packing(counts, 1024)
    held = Counter()
    for s, n in runs:
        assert sum(s) <= 1024 and n > 0
        for x in s:
            held[x] += n
    assert held == counts
    assert sum(n for _, n in runs) <= sum(n for _, n in packing.best_fit([], packing.Stock(counts), 1024))
