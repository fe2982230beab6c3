"""Interfaces to PDF decoding and label reading, which need libraries outside Spark."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import OCR_TOKENS, RAW_OBJECTS


class Decoder(Protocol):
    """Turns a document's bytes into rows of RAW_OBJECTS without ``doc``; a row of kind ``page`` has a page's width as x1 and its height as bottom."""

    def decode(self, content: bytes, pages: list[int] | None) -> Iterable[dict[str, Any]]: ...


class Reader(Protocol):
    """Reads the tokens inside a box of a page."""

    def read(self, content: bytes, page: int, box: tuple[float, float, float, float], dpi: int) -> list[dict[str, Any]]: ...


class LibraryDecoder:
    """Decodes with pdfplumber, where it is installed."""

    def decode(self, content: bytes, pages: list[int] | None) -> Iterator[dict[str, Any]]:
        import io

        try:
            import pdfplumber
        except ImportError as e:
            raise RuntimeError("decoding PDF files needs pdfplumber on the executors") from e
        groups = (("line", "lines"), ("rect", "rects"), ("curve", "curves"), ("char", "chars"))
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            for number, page in enumerate(pdf.pages, 1):
                if pages is not None and number not in pages:
                    continue
                yield {"page": number, "kind": "page", "ord": -1, "x0": 0.0, "top": 0.0, "x1": float(page.width), "bottom": float(page.height)}
                found = [(kind, o) for kind, name in groups for o in getattr(page, name)] + [("word", w) for w in page.extract_words()]
                for place, (kind, o) in enumerate(found):
                    color = {c: list(v) if isinstance(v := o.get(c), (tuple, list)) else None for c in ("stroke_color", "stroking_color", "non_stroking_color")}
                    pts = [{"x": float(x), "y": float(y)} for x, y, *_ in o.get("pts") or []]
                    yield {"page": number, "kind": kind, "ord": place, "filled": bool(o.get("fill")), "pts": pts, **color, **{c: o.get(c) for c in ("x0", "top", "x1", "bottom", "linewidth", "text", "fontname", "size")}}


def decode_documents(documents: DataFrame, decoder: Decoder, crops: DataFrame | None = None) -> DataFrame:
    """Raw objects of all documents; with crops, of their pages alone.

    The pages wanted of a document travel with it, so the decoder skips the others.
    """
    docs = documents.select(F.col("path").alias("doc"), "content")
    if crops is not None:
        docs = docs.join(crops.groupBy("doc").agg(F.collect_set("page").alias("pages")), "doc")
    else:
        docs = docs.withColumn("pages", F.lit(None).cast("array<bigint>"))
    names = RAW_OBJECTS.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content, pages in zip(batch["doc"], batch["content"], batch["pages"], strict=True):
                rows = [{**row, "doc": doc} for row in decoder.decode(content, None if pages is None else [int(p) for p in pages])]
                yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return docs.mapInPandas(run, RAW_OBJECTS)


def read_labels(boxes: DataFrame, documents: DataFrame, reader: Reader, dpi: int = 1200, together: int = 64) -> DataFrame:
    """Tokens of every box (doc, page, ord, edges).

    About ``together`` boxes of a document are read in one go, so its bytes travel once for
    so many boxes, and a document with very many boxes is dealt out.
    """
    counts = boxes.groupBy(F.col("doc").alias("c_doc")).agg(F.ceil(F.count("*") / together).alias("parts"))
    part = F.pmod(F.xxhash64("page", "ord"), F.col("parts"))
    dealt = boxes.join(counts, F.col("doc") == F.col("c_doc")).groupBy("doc", part.alias("part")).agg(F.collect_list(F.struct("page", "ord", "x0", "top", "x1", "bottom")).alias("boxes"))
    rows = dealt.join(documents.select(F.col("path").alias("doc"), "content"), "doc").select("doc", "content", "boxes")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content, found in zip(batch["doc"], batch["content"], batch["boxes"], strict=True):
                tokens = [reader.read(content, int(b["page"]), (b["x0"], b["top"], b["x1"], b["bottom"]), dpi) for b in found]
                yield pd.DataFrame({"doc": doc, "page": [b["page"] for b in found], "ord": [b["ord"] for b in found], "tokens": tokens})

    return rows.mapInPandas(run, OCR_TOKENS)
