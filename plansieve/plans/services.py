"""Whole services over documents: extraction with crops, and scale detection.

Each is one plan for all documents and pages; parameters out of range raise ValueError
before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import extract as E
from ..operators import scale as S
from ..schema import USUAL, Thresholds
from ..sources import intake
from ..sources.decoders import Decoder, Reader, decode_documents, read_labels

KEYS = ["doc", "page"]


def page_sizes(objects: DataFrame) -> DataFrame:
    """The pages of decoded documents, from the decoder's rows of kind ``page``."""
    return objects.where("kind = 'page'").select(*KEYS, F.col("x1").alias("width"), F.col("bottom").alias("height"))


def extract(documents: DataFrame, decoder: Decoder, requests: DataFrame | None = None) -> DataFrame:
    """A row per accepted document: its pages with their elements, cropped where ``requests`` (doc, raw) asks for it."""
    good, _ = intake.split_uploads(documents)
    crops = None if requests is None else intake.parse_crops(requests)
    objects = decode_documents(good, decoder, crops)
    pages = page_sizes(objects)
    elements = E.page_elements(objects.where("kind <> 'page'"), pages, KEYS)
    return E.nested(elements if crops is None else E.crop_elements(elements, crops, KEYS), pages, KEYS)


def detect_scale(documents: DataFrame, decoder: Decoder, reader: Reader, crops: DataFrame, max_luma: float = USUAL.max_luma, t: Thresholds = USUAL) -> tuple[DataFrame, DataFrame]:
    """Callouts with their ducts, and the scale of each cropped page (doc, page, edges in ``crops``)."""
    if not 0 <= max_luma <= 1:
        raise ValueError("max_luma must be between 0 and 1")
    if t.label_dpi < 1 or t.max_upload < 1:
        raise ValueError("dpi and upload limit must be positive")
    good, _ = intake.split_uploads(documents)
    crops = crops.where(F.col("page") >= 1)
    return scale_objects(decode_documents(good, decoder, crops), crops, lambda boxes: read_labels(boxes, good, reader, t.label_dpi), KEYS, max_luma, t)


def scale_objects(objects: DataFrame, crops: DataFrame, tokens_of: Callable[[DataFrame], DataFrame], keys: Sequence[str], max_luma: float = USUAL.max_luma, t: Thresholds = USUAL) -> tuple[DataFrame, DataFrame]:
    """Callouts with their ducts, and the scale of each crop, of decoded objects: ink, labels without repeats, reading, matching, scale.

    ``tokens_of`` gives the tokens (keys, ord, tokens) of label boxes. Native rectangles come before paths, so
    ``ord`` is not that of ``objects``: paths have 2**40 added.
    """
    keys = list(keys)
    c = crops.select(*keys, *[F.col(e).alias(f"c_{e}") for e in G.EDGES])
    black = S.black_objects(objects.join(c, keys), max_luma, G.edges("c_")).where("shape = 'rect'")
    rank = F.when(F.col("kind") == "rect", 0).otherwise(1)
    rects = black.select(*keys, (rank.cast("long") * (1 << 40) + F.col("ord")).alias("ord"), *G.EDGES)
    boxes = S.dedupe_boxes(rects.where(S.label_sized(t)), keys, t.dedupe_tolerance)
    tokens = tokens_of(S.inset_boxes(boxes, t.label_inset))
    raw = T.decode_tokens(F.col("tokens"), t)
    decoded = tokens.where(T.min_confidence(F.col("tokens")) >= t.min_confidence).select(*keys, "ord", T.callout_text(raw, t).alias("text"), T.callout_diameter(raw, t).alias("diameter_in"))
    labels = boxes.join(decoded.where("diameter_in is not null"), [*keys, "ord"])
    callouts = S.match_ducts(labels, rects, keys, t)
    scales = crops.select(*keys).join(S.page_scales(callouts, keys, t.scale_band), keys, "left").select(*keys, "scale", F.coalesce("callout_count", F.lit(0)).alias("callout_count"), F.coalesce("rejected", F.lit(0)).alias("rejected"))
    return callouts, scales


def run_all(elements: DataFrame, scales: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row per document of a full run: regions, elements in them, and the first region without a scale, which fails the run (null if there is none).

    elements: of the cropped pages, after the crop; scales: a row per region.
    """
    doc, page = keys
    counts = elements.groupBy(doc).agg(F.count("*").alias("elements"))
    regions = scales.groupBy(doc).agg(F.count("*").alias("regions"), F.min(F.when(F.col("scale").isNull(), F.col(page))).alias("failed"))
    return regions.join(counts, doc, "left").select(doc, "regions", F.coalesce("elements", F.lit(0)).alias("elements"), "failed")
