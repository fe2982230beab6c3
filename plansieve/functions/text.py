"""Label texts, tokens and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import USUAL, Thresholds

# A number, an inch mark or none, and signs that stand for a diameter sign.
CALLOUT = "^\\s*(\\d+(?:\\.\\d+)?)\\s*(?:\"|″)?\\s*([@°ØøOoDd6¢]+)\\s*$"

# Real inches per paper inch of usual drawing scales, and their names.
SCALES = ((192, "1/16\" = 1'"), (96, "1/8\" = 1'"), (64, "3/16\" = 1'"), (48, "1/4\" = 1'"), (32, "3/8\" = 1'"), (24, "1/2\" = 1'"), (16, "3/4\" = 1'"), (12, "1\" = 1'"))


def callout_number(raw: Column) -> Column:
    """The number of a label as it is written, or null if the text isn't a label."""
    return F.nullif(F.regexp_extract(raw, CALLOUT, 1), F.lit(""))


def callout_diameter(raw: Column, t: Thresholds = USUAL) -> Column:
    """Diameter in inches of a label, or null if it isn't one or is out of range."""
    d = callout_number(raw).cast("double")
    return F.when(d.between(t.min_diameter, t.max_diameter), d)


def callout_text(raw: Column, t: Thresholds = USUAL) -> Column:
    """The label in its canonical form, or null."""
    n = callout_number(raw)
    shown = F.when(n.contains("."), n).otherwise(callout_diameter(raw, t).cast("long").cast("string"))
    return F.when(callout_diameter(raw, t).isNotNull(), F.concat(shown, F.lit('"ø')))


def decode_tokens(tokens: Column, t: Thresholds = USUAL) -> Column:
    """The raw text that tokens decode from: all of them joined, else the first that is a label by itself."""
    texts = F.transform(tokens, lambda x: x["text"])
    whole = F.array_join(texts, "")
    single = F.try_element_at(F.filter(texts, lambda x: callout_diameter(x, t).isNotNull()), F.lit(1))
    return F.when(callout_diameter(whole, t).isNotNull(), whole).otherwise(single)


def min_confidence(tokens: Column) -> Column:
    """The lowest confidence of all tokens."""
    return F.array_min(F.transform(tokens, lambda x: x["conf"]))


def tokens_bbox(tokens: Column, x0: Column, top: Column, dpi: int) -> Column:
    """The box around all tokens, from pixels at ``dpi`` to points from (x0, top)."""
    k = 72.0 / dpi

    def edge(pick, of) -> Column:
        return pick(F.transform(tokens, of)) * k

    return F.struct(
        (x0 + edge(F.array_min, lambda x: x["left"])).alias("x0"),
        (top + edge(F.array_min, lambda x: x["top"])).alias("top"),
        (x0 + edge(F.array_max, lambda x: x["left"] + x["width"])).alias("x1"),
        (top + edge(F.array_max, lambda x: x["top"] + x["height"])).alias("bottom"),
    )


def nearest_scale(pts_per_inch: Column) -> Column:
    """The usual scale with the smallest log error, as struct(error, ratio, label); the first of equal ones."""
    ratio = 72.0 / pts_per_inch
    options = F.array(*[F.struct(F.abs(F.log(ratio / r)).alias("error"), F.lit(i).alias("place"), F.lit(r).alias("ratio"), F.lit(name).alias("label")) for i, (r, name) in enumerate(SCALES)])
    return F.array_min(options)


def scale_ratio(pts_per_inch: Column, snap: float = 0.08) -> Column:
    """1:n, with n a usual scale if the measured one is near it."""
    best = nearest_scale(pts_per_inch)
    return F.when(best["error"] < snap, F.concat(F.lit("1:"), best["ratio"].cast("string"))).otherwise(F.concat(F.lit("1:"), F.format_string("%.1f", 72.0 / pts_per_inch)))


def scale_label(pts_per_inch: Column, snap: float = 0.08) -> Column:
    """The name of the usual scale, or points per inch."""
    best = nearest_scale(pts_per_inch)
    return F.when(best["error"] < snap, best["label"]).otherwise(F.concat(F.format_string("%.2f", pts_per_inch), F.lit(" pts/in")))


def file_size(n: Column) -> Column:
    """Bytes as B, KB or MB."""
    kb, mb = n / 1024, n / 1024 / 1024
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", kb), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.2f", mb), F.lit(" MB")))


def style_properties(style: Column) -> Column:
    """The properties of a style attribute as a map; keys in lower case, the last of equal ones wins."""
    parts = F.filter(F.split(style, ";"), lambda p: p.contains(":"))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("key"), F.trim(F.substring(p, F.locate(":", p) + 1, F.length(p))).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def element_label(text: Column, x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    """An element's own text, or its corners at one decimal."""
    corner = F.format_string("(%.1f, %.1f) → (%.1f, %.1f)", x0, top, x1, bottom)
    return F.coalesce(F.nullif(text, F.lit("")), corner)


def is_pdf_name(name: Column, mime: Column) -> Column:
    """Whether a file is offered as PDF: by its name or by its type."""
    return F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False)) | F.coalesce(mime == "application/pdf", F.lit(False))
