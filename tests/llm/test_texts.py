"""Licences, toxicity, quality, media and quotations."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansieve.llm import licenses, media, quality, quotes, toxicity

SF = "/root/testdata/sf0.01"


def brute_license(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses(spark, messy, nothing):
    extra = ["under the MIT license, under-the-mit license", "CC BY NC cc by-nc apache LICENSE version 2", "This work is licensed under the GNU General Public License, version 3.", "all rights reserved", "all rights"]
    docs = messy.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(1000 + i, t, 0.0) for i, t in enumerate(extra)], "doc_id long, text string, score double"))
    got = sorted((tuple(r) for r in licenses.scan_licenses(docs).collect()), key=repr)
    want = sorted(((r["doc_id"], *brute_license(r["text"])) for r in docs.collect()), key=repr)
    assert [g[:6] for g in got] == want
    by = {g[0]: g for g in got}
    assert by[1002][6] == "gpl-3" and by[1003][6] == "proprietary" and by[1004][6] == ""
    assert all(0 <= g[7] <= 1 and set(g[5].split(",")) - {""} <= set(g[6].split(",")) for g in got)
    assert licenses.scan_licenses(nothing).count() == 0


def test_licenses_by_trying_every_place():
    """Labels of the method against all alignments of all templates, with words left out and changed, and any document frequencies."""
    rng = random.Random(21)
    vocabulary = [w.decode() for w in licenses.vocabulary()] + [f"w{i}" for i in range(30)]
    found = 0
    for _ in range(300):
        df = {w: rng.choice([0, 1, 5, 50, 99]) for w in licenses.vocabulary()}
        index = licenses.Index(100, df)
        words = rng.choices(vocabulary, k=rng.randint(0, 30))
        for _, text, _ in rng.choices(licenses.TEMPLATES, k=rng.randint(0, 3)):
            t = [w if rng.random() < rng.choice([1, 0.9]) else rng.choice(vocabulary) for w in text.split()]
            at = rng.randint(0, len(words))
            words[at:at] = t[: rng.randint(len(t) * 2 // 3, len(t))]
        words = [w.encode() for w in words]
        want, best = set(), 0.0
        for label, text, key in licenses.TEMPLATES:
            t, k = text.encode().split(), key.encode().split()
            key_at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            for shift in range(-len(t), len(words)):
                here = [0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(t)]
                if all(here[key_at : key_at + len(k)]):
                    got = sum(index.idf[w] for w, h in zip(t, here, strict=True) if h) / sum(index.idf[w] for w in t)
                    best = max(best, got)
                    want |= {label} if got >= 0.6 else set()
        *_, base, labels, score = index.scan(words, 0.6)
        found += bool(want)
        assert labels == base | want and score == pytest.approx(1.0 if base else min(1.0, best))
    assert found > 100


def test_toxicity(spark, messy, nothing):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = toxicity.remainder("doc_id", 3)
    model = toxicity.train(docs, labels.where(held != 1))
    scored = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(held == 1)
    hits = {(r["toxic"], r["score"] >= 0.7): r["count"] for r in scored.groupBy("toxic", (F.col("score") >= 0.7).alias("score")).count().withColumn("score", F.col("score").cast("int")).collect()}
    assert hits.get((0, True), 0) == 0 and hits.get((1, True), 0) >= 9 * hits.get((1, False), 0)
    worst = scored.where("score >= 0.7 and size(offending) > 0").count()
    assert worst > 0
    assert toxicity.score_toxicity(messy, model).count() == messy.count()
    assert {r["score"] for r in toxicity.score_toxicity(messy, model).where("n_sentences = 0").collect()} == {0.0}
    assert toxicity.drop_toxic(messy, model).columns == messy.columns
    none = toxicity.train(nothing, labels)
    assert {r["score"] for r in toxicity.score_toxicity(messy, none).collect()} == {0.0}


def test_toxicity_few_labels(spark):
    """A few labels that separate the classes are enough, and each sentence counts once."""
    docs = spark.createDataFrame([(i, f"Good day number {i}. " + ("You vile creature. " if i % 2 else "You kind creature. ") + "Bye.") for i in range(40)], "doc_id long, text string")
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    assert model.weights
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((r["score"] >= 0.7) == bool(i % 2) and r["offending"] == [1] * (i % 2) for i, r in scored.items())
    tokens = model.tokens()
    assert model.sentences("vile vile vile", tokens) == model.sentences("vile", tokens)


def test_noisy_or_by_hand():
    """Scores from sets of features, multiplied out sentence by sentence; slopes by differences."""
    model = toxicity.NoisyOr(-2.0, {"bad": 3.0, "bad~": -0.5, "wor~": 1.5})
    text = "Bad things, bad day! A badger. words\n\nnothing here"
    logits = [-2.0 + 3.0, -2.0 - 0.5, -2.0 + 1.5, -2.0]
    assert model.sentences(text, model.tokens()) == pytest.approx(logits)
    none = 1.0
    for z in logits:
        none *= 1 - 1 / (1 + math.exp(-z))
    assert model.combine(logits) == pytest.approx(1 - none) and model.combine([]) == 0
    rng = np.random.default_rng(6)
    bags = [(int(rng.random() < 0.4), int(rng.integers(0, 3)), [sorted(set(rng.integers(0, 6, rng.integers(1, 5)).tolist())) for _ in range(rng.integers(0, 4))]) for _ in range(30)]
    objective, theta = toxicity.Objective(bags, 6, 0.01), rng.standard_normal(7)
    value, slope = objective(theta)
    by_hand = 0.0
    for y, plain, lists in bags:
        none = (1 - 1 / (1 + math.exp(-theta[-1]))) ** plain
        for f in lists:
            none *= 1 - 1 / (1 + math.exp(-(theta[-1] + sum(theta[x] for x in f))))
        by_hand += math.log(max(1 - none, 1e-9) if y else none)
    assert value == pytest.approx(by_hand / len(bags) - 0.005 * (theta[:-1] ** 2).sum())
    for k in range(7):
        if all(y == 0 or plain or lists for y, plain, lists in bags):
            near = [objective(theta + d * 1e-6 * (np.arange(7) == k))[0] for d in (1, -1)]
            assert slope[k] == pytest.approx((near[0] - near[1]) / 2e-6, abs=1e-5)


def test_quality(spark, messy, nothing):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = toxicity.remainder("doc_id", 5)
    scored = quality.score_quality(docs, labels.where(held != 0)).join(labels, "doc_id").where(held == 0)
    right = scored.where((F.col("score") >= 0.3) == (F.col("quality") == 1)).count()
    assert right >= 0.97 * scored.count()
    got = quality.score_quality(messy, labels)
    assert got.count() == messy.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert {r["score"] for r in quality.score_quality(messy, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(nothing, labels).count() == 0
    assert quality.drop_poor(messy, labels).columns == messy.columns


def test_media_round_trip(messy, nothing):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.media_features(messy).collect()}
    for r in messy.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        g = got[r["doc_id"], len(raw)]
        assert g["payload_bytes"] == len(payload) and g["payload_sha256"] == hashlib.sha256(payload).hexdigest() and g["tail_crc32"] == zlib.crc32(payload[-32:])
    assert media.media_features(nothing).count() == 0


@pytest.mark.parametrize("kind", media.KINDS)
def test_media_kinds(kind):
    payload = bytes(random.Random(1).randrange(256) for _ in range(1152))
    data = media.encode(kind, payload)
    whole, carved = media.Sniffer().sniff(data)
    assert whole.kind == kind and data[whole.data_start : whole.data_end] == payload and not carved
    loose = b"junk BM RIFF" + data + b"tail"
    whole, carved = media.Sniffer().sniff(loose)
    assert whole is None and [(c.kind, loose[c.data_start : c.data_end] == payload) for c in carved] == [(kind, True)]
    assert media.Sniffer().sniff(data[:-1])[0] is None
    inner = media.encode("wav", media.padded(media.encode(kind, payload)))
    whole, carved = media.Sniffer().sniff(inner)
    assert whole.kind == "wav" and [c.kind for c in carved] == [kind]


def png(w, h):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


FOREIGN = {
    "wav of 16 bits": ("wav", "4@44100", b"RIFF" + struct.pack("<I", 52) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + b"data" + struct.pack("<I", 16) + bytes(range(16))),
    "au of 16 bits": ("au", "6@8000", b".snd" + struct.pack(">5I", 24, 12, 3, 8000, 1) + bytes(12)),
    "au of unknown length": ("au", "9@8000", b".snd" + struct.pack(">5I", 24, 0xFFFFFFFF, 1, 8000, 1) + bytes(9)),
    "pgm on one line": ("pgm", "3x2", b"P5 3 2 255\n" + bytes(6)),
    "pgm with a comment": ("pgm", "3x2", b"P5\n# made by hand\n3\t2\r\n65535 " + bytes(12)),
    "bmp of 24 bits": ("bmp", "3x2", b"BM" + struct.pack("<IHHI", 54 + 24, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 24, 0, 24, 0, 0, 0, 0) + bytes(24)),
    "png": ("png", "5x4", png(5, 4)),
    "gif": ("gif", "2x2", b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6) + b"!\xf9\x04" + bytes(5) + b"," + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + b"\x02\x02\x4c\x01\x00;"),
    "jpeg": ("jpeg", "7x9", b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 9, 7, 1) + b"\1\x11\0" + b"\xff\xda" + struct.pack(">H", 8) + b"\1\1\0\0\x3f\0" + b"\x12\x34\xff\xd9"),
}


@pytest.mark.parametrize("name", FOREIGN)
def test_media_of_others(name):
    """Files as other programs write them: typed as a whole, carved out of loose bytes, and not taken for whole when cut short or spoilt."""
    kind, shape, data = FOREIGN[name]
    sniffer = media.Sniffer()
    whole, carved = sniffer.sniff(data)
    assert (whole.kind, whole.shape, whole.end, carved) == (kind, shape, len(data), [])
    if name != "au of unknown length":
        loose = b"x BM RIFF P5 " + data + b"rest"
        assert [(c.kind, loose[c.start : c.end]) for c in sniffer.sniff(loose)[1]] == [(kind, data)]
        assert sniffer.sniff(data[:-1])[0] is None
    if kind == "png":
        assert sniffer.sniff(data[:20] + b"!" + data[21:])[0] is None


def test_quotations(spark, nothing):
    messages = [
        (1, 0, "user", "Shall we meet?\nMonday suits me."),
        (1, 1, "assistant", "On Monday, A wrote:\n> Monday suits  me.\nFine."),
        (1, 2, "user", "Other topic"),
        (1, 3, "user", ">> monday suits me.\n> Fine.\nSee you"),
        (1, 4, "user", "> never said\nWhat?"),
        (1, 5, "user", "> Other topic\nYes"),
        (2, 0, "user", None),
        (2, 1, "user", "> Monday suits me."),
        (None, None, None, "> x"),
    ]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").withColumn("parent", F.lit(1)).withColumn("depth", F.lit("x"))
    got = quotes.link_quotations(df)
    rows = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert {k[1]: r["parent_turn"] for k, r in rows.items() if k[0] == 1} == {0: None, 1: 0, 2: None, 3: 1, 4: None, 5: 2}
    assert [k[1] for k, _ in sorted(((k, r) for k, r in rows.items() if k[0] == 1), key=lambda x: x[1]["position"])] == [0, 1, 3, 2, 5, 4]
    assert rows[1, 3]["depth"] == 2 and rows[1, 1]["clean"] == "Fine." and rows[2, 1]["parent_turn"] is None and rows[None, None]["n_quoted"] == 1
    assert quotes.link_quotations(df.limit(0)).count() == 0
    assert quotes.parse_line("> > a") == (2, "a") and quotes.parse_line(">") == (1, "") and quotes.parse_line("a > b") == (0, "a > b")


def brute_links(messages):
    """Reply links of one conversation (turn, text) by walking back from each quoting message."""
    words, held, links = quotes.Words(), {}, {}
    for turn, text in messages:
        held[turn] = quotes.hashes_of(quotes.parse_message(text)[1], words)
    for turn, mine in held.items():
        votes = {}
        for (level, h), n in mine.items():
            if level > 0 or (level == 0 and n > quotes.WINDOW):
                for earlier in range(turn - 1, -1, -1):
                    theirs = held.get(earlier, {})
                    if (level - 1, h) in theirs and (theirs[level - 1, h] <= quotes.WINDOW or level == 0):
                        votes[earlier] = votes.get(earlier, 0) + n * (quotes.OWN if level == 1 else 1)
                        break
        if votes:
            links[turn] = max((n, o) for o, n in votes.items())[1]
    return links


def test_quotations_against_walking_back(spark):
    """Generated conversations: nested quotes, wrapped anew, in part or whole, with lines that many messages have."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    rows, truth = [], {}

    def wrapped(text, width):
        w = text.split()
        return [" ".join(w[i : i + width]) for i in range(0, len(w), width)]

    for conv in range(12):
        bodies = []
        for turn in range(200 if conv == 0 else 25):
            own = wrapped(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40))), 9) + (["Thanks"] if rng.random() < 0.4 else [])
            parent = rng.randrange(turn) if turn and rng.random() < 0.8 else None
            quoted = []
            if parent is not None:
                for level, lines in bodies[parent]:
                    if level < 2 and (level == 0 or rng.random() < 0.7):
                        again = wrapped(" ".join(lines), rng.choice([5, 12])) if rng.random() < 0.5 and "Thanks" not in lines else lines
                        quoted.append((level + 1, again))
            bodies.append([*quoted, (0, own)])
            text = "\n".join([*(["On Monday, A wrote:"] if quoted else []), *["> " * level + x for level, lines in bodies[-1] for x in lines]])
            rows.append((conv, turn, "user", text))
            truth[conv, turn] = parent
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    for conv in range(12):
        want = brute_links([(t, x) for c, t, _, x in rows if c == conv])
        assert {t: r["parent_turn"] for (c, t), r in got.items() if c == conv and r["parent_turn"] is not None} == want
        depth = {}
        for t in sorted(t for c, t in got if c == conv):
            depth[t] = (depth[want[t]][0] + 1, depth[want[t]][1]) if t in want else (0, t)
            assert (got[conv, t]["depth"], got[conv, t]["root_turn"]) == depth[t]
        order = sorted(depth, key=lambda t: (depth[t][1], depth[t][0], t))
        assert [got[conv, t]["position"] for t in order] == list(range(len(order)))
    assert sum(got[k]["parent_turn"] == p for k, p in truth.items()) >= 0.97 * len(truth)
    assert all(">" not in r["clean"] and "wrote" not in r["clean"] for r in got.values())


def test_quotations_of_many_alike(spark):
    """A very long thread, and very many messages alike, are cut into ranges."""
    rows = [(1, i, "user", f"> step {i - 1}\nstep {i}") for i in range(300)] + [(None, None, "user", "x")] * 300
    got = quotes.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert [(r["turn"], r["depth"], r["parent_turn"]) for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])] == [(i, i, i - 1 if i else None) for i in range(300)]
    assert sorted(r["position"] for r in got if r["conv_id"] is None) == list(range(300))
