"""The similarity join, nearest neighbours, mixing and the pipeline."""

from __future__ import annotations

import math
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plansieve.llm import ann, mixing, ngram_join, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, width):
    found = []
    for r in rows:
        w = WORD.findall((r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        found.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return found


def brute_components(rows, width, up, down):
    sets = sets_of(rows, width)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and down * len(a & b) >= up * len(a | b):
            parent[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r["doc_id"])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((r["doc_id"], len(sets[i]), least[root(i)]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("width", "threshold"), [(3, (90, 100)), (5, (80, 100)), (1, (50, 100))])
def test_join(spark, messy, width, threshold):
    rng = random.Random(width)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([4, 30, 90]))]
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    docs = messy.select("doc_id", "text", "n", "fp").unionByName(spark.createDataFrame([(2000 + i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int, fp long"))
    rows = docs.collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_similar(docs, width, threshold).collect()), key=repr)
    assert got == brute_components(rows, width, *threshold)


def test_join_blocks_and_empty(spark, nothing):
    """Columns and regions with more rows than a block are cut, and nothing is lost."""
    text = [" ".join(f"w{j}" if j != i % 40 else f"v{i}" for j in range(60)) for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(text)]
    for threshold in ((90, 100), (97, 100)):
        got = ngram_join.join_similar(docs, 1, threshold, blocks=(7, 9)).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(a, c) for a, _, c in brute_components(rows, 1, *threshold)}
        sets = sets_of(rows, 1)
        near = [sum(threshold[1] * len(a & b) >= threshold[0] * len(a | b) for b in sets) - 1 for a in sets]
        assert [r["n_links"] for r in sorted(got)] == near
    assert ngram_join.join_similar(nothing).count() == 0


def test_join_grows_with_the_rows(spark, monkeypatch):
    """Nothing that a dense group of near copies makes grows with its pairs."""
    made, plain = [], ngram_join.store
    monkeypatch.setattr(ngram_join, "store", lambda df, name, *a: made.append((name, out := plain(df, name, *a), out.count())) or out)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    sizes = []
    for n in (400, 2000):
        made.clear()
        text = [" ".join(rng.choice(words) if rng.random() < 0.02 else w for w in base) for _ in range(n)]
        ngram_join.one_of_each(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"), 5, (80, 100)).count()
        sizes.append({name: rows for name, _, rows in made})
    assert sizes[0].keys() == sizes[1].keys() >= {"regions", "links"}
    for name in sizes[0].keys() - {"entries", "shared"}:
        assert sizes[1][name] <= 6 * sizes[0][name], name
    assert sizes[1]["regions"] < 2000 * 8


def test_long_rows_of_common_columns(spark, monkeypatch):
    """Long rows that share rare columns by chance only are not gathered, and near copies among them are found."""
    made, plain = [], ngram_join.region_edges
    monkeypatch.setattr(ngram_join, "region_edges", lambda *a: (made.append(out := plain(*a)), out)[1])
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    texts = [rng.choices(words, k=rng.randint(1500, 2500)) for _ in range(150)]
    texts += [[w if rng.random() > 0.01 else "x" for w in texts[i % 5]] for i in range(20)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for threshold, most in (((90, 100), 5), ((80, 100), 75)):  # parts of some two columns at 0.8
        made.clear()
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_similar(docs, 2, threshold).collect())
        assert got == sorted(brute_components(docs.collect(), 2, *threshold))
        assert len({c for _, _, c in got}) == 150
        assert max(r["count"] for r in ngram_join.components(made[0]).groupBy("component").count().collect()) <= most


def test_long_rows_that_meet_by_chance(spark):
    """Long rows that meet two by two in columns don't grow into a region, and those that link do, in columns of few and of many rows."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in rng.integers(1500, 2000, 80)]
    sets += [np.append(sets[i][20:], rng.integers(0, 1 << 63, 20).astype(np.uint64)) for i in (0, 0, 1)]  # 80 and 81 like 0, 82 like 1
    sets += [np.append(sets[2][k:], rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in range(1, 30)]  # 83 to 111 like 2
    columns = [(i, i + 1) for i in range(79)] + [(0, 80, 81), (1, 82), (1, 82), (2, *range(83, 112))]
    n, sig = [len(s) for s in sets], [ngram_join.signature(s) for s in sets]
    entries = spark.createDataFrame([(h, len(c), i, n[i]) for h, c in enumerate(columns) for i in c], "h long, c_n long, fp long, n int")
    short = spark.createDataFrame([(i, ngram_join.folded(x, 64).tobytes()) for i, x in enumerate(sig)], "fp long, sig binary")
    whole = spark.createDataFrame([(i, n[i], x.tobytes()) for i, x in enumerate(sig)], "fp long, n long, wide binary")
    edges = ngram_join.region_edges(entries, short, (80, 100), 4096, whole)
    regions = {}
    for r in ngram_join.components(edges).collect():
        regions.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, regions.values())) == [[0, 80, 81], [1, 82], [2, *range(83, 112)]]
    assert len(columns[-1]) > ngram_join.FEW
    assert sorted(map(tuple, edges.where("a < 2 or a = 80").collect())) == [(0, 80), (0, 81), (1, 82), (80, 81)]


def test_chance_does_not_gather_at_08(spark, monkeypatch):
    """As test_long_rows_of_common_columns at 0.8: only the rows that link are in a region."""
    made, plain = [], ngram_join.region_edges
    monkeypatch.setattr(ngram_join, "region_edges", lambda *a: (made.append(out := plain(*a)), out)[1])
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    texts = [rng.choices(words, k=rng.randint(1500, 2500)) for _ in range(150)]
    texts += [[w if rng.random() > 0.01 else "x" for w in texts[i % 5]] for i in range(20)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join_similar(docs, 2, (80, 100)).collect())
    assert got == sorted(brute_components(docs.collect(), 2, 80, 100))
    assert max(r["count"] for r in ngram_join.components(made[-2]).groupBy("component").count().collect()) == 5


@pytest.mark.parametrize("threshold", [(90, 100), (80, 100), (97, 100), (70, 100)])
def test_entries(threshold):
    """Rows that just reach the threshold share an entry, on both sides of each number of parts."""
    rng = np.random.default_rng(6)
    up, down = threshold
    level = rng.integers(0, 120, 1 << 16).astype(np.uint8)
    entries = lambda s: ngram_join.first_entries(s, level[(s >> np.uint64(48)).astype(np.int64)], threshold)
    for n in [*range(1, 140), *range(190, 260, 3), 900, 4000]:
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        for gone in {0, int(rng.integers(0, n * (down - up) // down + 1)), n * (down - up) // down}:
            new = (n - gone) * down // up - n  # as many as leave the two linked
            b = np.append(rng.choice(a, n - gone, replace=False), rng.integers(0, 1 << 63, new).astype(np.uint64) * np.uint64(2) + np.uint64(1))
            if gone + new:
                assert down * (n - gone) >= up * (n + new)
                assert len(np.intersect1d(entries(a), entries(np.sort(b)))), (n, gone, new)


def test_signatures():
    """Signatures of any two sizes differ in no more places than the sets have members of their own."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 3, 200, 256, 257, 900, 3000, 3100)]
    sets += [np.sort(np.append(s[: len(s) // 2 + 1], rng.integers(0, 1 << 63, len(s) // 4).astype(np.uint64))) for s in sets]
    held = ngram_join.Signatures([ngram_join.signature(s).tobytes() for s in sets])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            size = min(len(ngram_join.signature(x)) for x in (a, b))
            apart = int(held.apart(np.array([i]), np.array([j]))[0])
            assert apart == np.bitwise_count(np.bitwise_xor(*(ngram_join.folded(ngram_join.signature(x), size) for x in (a, b)))).sum()
            assert apart <= len(np.setxor1d(a, b)) and (apart > 0 or a.tolist() == b.tolist())


def test_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60)).astype(np.uint64)) for _ in range(70)]
    both = ngram_join.overlaps(sets, dense=9, columns=16)
    assert all(both[i, j] == (len(np.intersect1d(sets[i], sets[j])) if i != j else 0) for i in range(70) for j in range(70))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(400 + i, 401 + i) for i in range(50)]
    parent = {x: x for e in links for x in e}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in {x for e in links if e[0] != e[1] for x in e}}
    with pytest.raises(RuntimeError):
        ngram_join.components(spark.createDataFrame(links, "a long, b long"), most_rounds=2)


def test_join_links(spark, messy):
    """Links inside a dense group of near copies are counted, and copies with them."""
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words[:i] + [f"v{i}"] + words[i + 1 :]) for i in range(0, 80, 2)] + [" ".join(words)] * 3
    docs = messy.select("doc_id", "text").unionByName(spark.createDataFrame([(3000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = docs.collect()
    sets = sets_of(rows, 1)
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 95 * len(a | b)
    want = sorted(((r["doc_id"], sum(near(a, b) for j, b in enumerate(sets) if j != i)) for i, (r, a) in enumerate(zip(rows, sets, strict=True))), key=repr)
    got = sorted(((r["doc_id"], r["n_links"]) for r in ngram_join.join_similar(docs, 1, (95, 100)).collect()), key=repr)
    assert got == want and dict(got)[3000] == 42


def test_one_of_each(messy):
    kept = ngram_join.one_of_each(messy, 3, (90, 100))
    assert kept.columns == messy.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 7 in ids and 8 not in ids and {0, 1, 2, 3} <= set(ids)  # 9 differs: only A-Z are lower-cased


def test_one_row_of_each(spark, nothing):
    """Repeated rows, ids with several texts and null ids: one row of each component stays."""
    rng = random.Random(11)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(5)]
    near = [b.rsplit(" ", 1)[0] + " other" for b in base]
    rows = [(4, base[0], 1), (4, base[0], 1), (4, base[0], 2), (2, base[1], 1), (7, near[1], 1), (7, base[2], 1), (8, near[2], 1)]
    rows += [(None, base[0], 1), (None, near[1], 1), (None, base[3], 1), (None, base[3], 1), (None, near[3], 2), (9, base[4], 1), (9, near[4], 1), (1, "", 1), (1, "", 1), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int").repartition(3)
    kept = ngram_join.one_of_each(docs, 3, (90, 100))
    assert kept.columns == docs.columns
    got = [tuple(r)[:2] for r in kept.collect()]
    assert sorted((r for r in got if r[1]), key=repr)[:3] == [(2, base[1]), (4, base[0]), (7, base[2])]
    assert sorted((str(i) for i, t in got if t)) == ["2", "4", "7", "9", "None"] and len([r for r in got if not r[1]]) == 3
    assert ngram_join.one_of_each(nothing).count() == 0


def exact(rows, queries_, k):
    out = {}
    for q, v in queries_:
        s = sorted((-float(np.dot(np.array(v, float), np.array(x, float))), i) for i, x in rows if i != q)
        out[q] = s[:k]
    return out


def test_nearest(spark):
    """Every vector is verified here, so the result is exact; untidy rows and extreme vectors."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).astype(float).tolist()) for i in range(1500)]
    rows += [(5000 + i, rows[3][1]) for i in range(60)]
    rows += [(6000, [1e-200] * 16), (6020, [1e-320] * 16), (6040, [1e200] * 16), (6060, [1e308, -1e308] * 8), (6080, [3e38] + [0.0] * 15), (6100, [-0.0] * 15 + [5e-324])]
    bad = [(9000, None), (9020, [0.0] * 16), (9040, [math.nan] * 16), (9060, [None] * 16), (9080, [math.inf] * 16), (9100, [1.0] * 3), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in [*rows, *bad]], "vec_id long, embedding array<double>, rank int, score double")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, block=700, least=700).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == {i for i, _ in rows if i % 20 == 0}
    x = np.array([v for _, v in rows])
    for q, v in rows:
        if q % 20:
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (x * np.array(v)).sum(1)
        scores[np.isnan(scores)] = -np.inf
        want = sorted((-s, i) for s, (i, _) in zip(scores.tolist(), rows, strict=True) if i != q)[:20]
        assert [(r, i, -s) for r, (s, i) in enumerate(want, 1)] == sorted(by[q])
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    with pytest.raises(ValueError):
        ann.Windows(np.ones((3, 2)), 256, 0.5, 1)


def test_nearest_recall(spark):
    """The windows choose: at most a third of a block is verified, and recall is at least 0.9."""
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    windows = ann.Windows(x, 128, 0.7, 7)
    directions = windows.directions(x[ids % 20 == 0])
    seen = [len(h) / len(x) for h in windows.search(directions, max(400, math.ceil(0.15 * len(x))))]
    assert np.mean(seen) <= 1 / 3
    want = dict(exact(rows, [r for r in rows if r[0] % 20 == 0], 20))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    hits = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in got)
    assert hits >= 0.9 * 20 * len(want)


def test_mixing(spark, messy, nothing):
    duck = duckdb.connect()
    duck.register("documents", messy.select("doc_id", "text", "source").where("doc_id is not null").dropDuplicates(["doc_id"]).toPandas())
    docs = messy.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix_sources(docs).collect())
    cursor = duck.execute(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({queries.ORACLES['op9_mixing']})")
    assert got == sorted(cursor.fetchall())
    everything = mixing.mix_sources(messy)
    assert everything.count() == messy.count() and everything.where("taken > 3 * size or taken < 0").count() == 0
    assert mixing.mixed_documents(messy).columns == messy.columns
    assert mixing.mixed_documents(messy).count() == everything.agg(F.sum("copies")).first()[0]
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mixing_caps(spark):
    """A small source stops at three times its size and the rest is shared anew."""
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 90 else "b") for i in range(100)], "doc_id long, text string, source string")
    rows = {r["source"]: r for r in mixing.mix_sources(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert rows["b"]["target"] == 300 and rows["b"]["taken"] == 300 and rows["a"]["target"] == 700 and rows["a"]["taken"] == 700


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "jaccard_join", "mixing", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= 3 * docs.count(), name
        docs = out
    packed = corpus_pipeline.run(spark, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_untidy(spark, messy, nothing):
    """Nulls, empty and long texts, repeated rows and clashing columns through all stages; an empty table stays empty."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = messy
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == messy.columns, name
        docs = docs.checkpoint()
        if name != "mixing":
            lost = before.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).collect()
            assert name != "toxicity" or all((r["text"] or "").strip() for r in lost)
            assert docs.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0, name
        else:
            assert docs.where("text is null or trim(text) = ''").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0
