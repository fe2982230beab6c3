"""Untidy tables for the corpus operators."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, fp long, n int, score double, target double"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, repeated rows, copies, near copies and columns with clashing names."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgäé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " ", "\n\n", "one", "two words", "A b  c\td", base, base, base.upper(), " ".join(near), text(5), text(3000), "x" * 30_000, "Released under the MIT License.", "µ ß İ Σ   \x1c end", "<|endoftext|> a"]
    texts += [text(rng.randint(1, 200)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, None, 1, "k", 2, 3, 0.5, 1.0) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, base, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
