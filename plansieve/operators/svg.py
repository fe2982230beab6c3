"""Black-ink filtering of SVG pages.

The rule is a column expression (``paint_action``). What needs XML is done by two passes of a
streaming parser in Arrow batches: one lists the paints of the drawn nodes, the other
copies the page, doing with each node what the rule says. Names and prefixes stay as they
are in the page.
"""

from __future__ import annotations

import io
import re
import xml.sax
from xml.sax.saxutils import XMLGenerator
from xml.sax.xmlreader import AttributesImpl, InputSource

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.color import svg_luma

DECLARATION = re.compile(r"([^:;]*):([^;]*)")
PAINTS = ("fill", "stroke")


def paint_action(fill: Column, stroke: Column, max_luma: float) -> Column:
    """What becomes of a node with these paints (null: not stated): keep, drop, or keep without fill or stroke."""
    black = lambda c: F.coalesce((c != "none") & (svg_luma(c) <= max_luma), F.lit(False))
    invisible = F.coalesce((fill == "none") & (stroke == "none"), F.lit(False))
    return (
        F.when(invisible | (fill.isNull() & stroke.isNull()), "keep")
        .when(~black(fill) & ~black(stroke), "drop")
        .when(~black(fill) & fill.isNotNull(), "no fill")
        .when(~black(stroke) & stroke.isNotNull(), "no stroke")
        .otherwise("keep")
    )


def declarations(attributes) -> dict[str, str]:
    """The style attribute by property."""
    return {name.strip().lower(): value.strip() for name, value in DECLARATION.findall(attributes.get("style", ""))}


class Places(xml.sax.ContentHandler):
    """Follows a page: ``drawn`` is called for each node that the rule is for, all but the root and what definitions hold."""

    def __init__(self):
        super().__init__()
        self.depth = self.defining = 0

    def startElement(self, name, attributes):
        self.depth += 1
        if self.defining or (self.depth > 1 and name.rpartition(":")[2] == "defs"):
            self.defining += 1
            self.opened(name, attributes)
        elif self.depth == 1:
            self.opened(name, attributes)
        else:
            self.drawn(name, attributes)

    def endElement(self, name):
        self.depth -= 1
        self.defining -= bool(self.defining)
        self.closed(name)

    def opened(self, name, attributes): ...

    def drawn(self, name, attributes): ...

    def closed(self, name): ...


class PaintList(Places):
    """The stated fill and stroke of each drawn node, in order; the style goes before the attributes."""

    def __init__(self):
        super().__init__()
        self.found: list[dict[str, str | None]] = []

    def drawn(self, name, attributes):
        style = declarations(attributes)
        self.found.append({p: style.get(p) or attributes.get(p) for p in PAINTS})


class Copy(Places):
    """Copies a page, without the nodes to drop and all that they hold; the root's attributes are overlaid."""

    def __init__(self, actions: list[str], root: dict[str, str | None]):
        super().__init__()
        self.text, self.actions, self.root, self.gone = io.StringIO(), iter(actions), root, 0
        self.out = XMLGenerator(self.text, "utf-8", short_empty_elements=True)

    def opened(self, name, attributes):
        if self.gone:
            self.gone += 1
            return
        if self.depth == 1:
            attributes = {k: v for k, v in {**dict(attributes), **self.root}.items() if v is not None}
        self.out.startElement(name, AttributesImpl(dict(attributes)))

    def drawn(self, name, attributes):
        action = next(self.actions)
        if self.gone or action == "drop":
            self.gone += 1
            return
        attributes = dict(attributes)
        if action.startswith("no "):
            paint, style = action[3:], declarations(attributes)
            if paint in style:
                style[paint] = "none"
                attributes["style"] = "; ".join(f"{k}: {v}" for k, v in style.items())
            else:
                attributes[paint] = "none"
        self.out.startElement(name, AttributesImpl(attributes))

    def closed(self, name):
        if self.gone:
            self.gone -= 1
        else:
            self.out.endElement(name)

    def characters(self, content):
        if not self.gone:
            self.out.characters(content)


def parse(text: str, handler: Places) -> Places:
    source = InputSource()
    source.setCharacterStream(io.StringIO(text))
    xml.sax.parse(source, handler)
    return handler


LISTED = T.StructType([T.StructField("paints", T.ArrayType(T.StructType([T.StructField(p, T.StringType()) for p in PAINTS]))), T.StructField("error", T.StringType())])


@F.pandas_udf(LISTED)
def listed(pages: pd.Series) -> pd.DataFrame:
    """The paints of each page's drawn nodes, or what is wrong with its text."""

    def one(text):
        try:
            return (None, None) if text is None else (parse(text, PaintList()).found, None)
        except xml.sax.SAXException as e:
            return None, str(e)

    return pd.DataFrame([one(t) for t in pages], columns=["paints", "error"])


@F.pandas_udf(T.StringType())
def copied(pages: pd.Series, actions: pd.Series, x0: pd.Series, top: pd.Series, x1: pd.Series, bottom: pd.Series) -> pd.Series:
    """Each page after its actions, its view box set to the crop where there is one; null where actions are."""

    def one(text, actions, x0, top, x1, bottom):
        if text is None or actions is None:
            return None
        edges = [x0, top, x1, bottom]
        root = {} if pd.isna(edges).any() else {"viewBox": f"{x0} {top} {x1 - x0} {bottom - top}", "preserveAspectRatio": "xMinYMin meet", "width": None, "height": None}
        return parse(text, Copy(list(actions), root)).text.getvalue()

    return pd.Series([one(*row) for row in zip(pages, actions, x0, top, x1, bottom, strict=True)], dtype=object)


def filter_pages(pages: DataFrame, svg: str, max_luma: float, crop: tuple[Column, ...] | None = None) -> DataFrame:
    """Adds ``filtered``, the page with black ink only and its view box set to the crop (four edges), and ``error``.

    Null text gives null; malformed text gives null and an error, and fails no other page.
    """
    edges = dict(zip(("_x0", "_top", "_x1", "_bottom"), crop or [F.lit(None)] * 4, strict=True))
    read = pages.withColumn("_listed", listed(F.col(svg)))
    judged = read.withColumn("_actions", F.transform("_listed.paints", lambda p: paint_action(p["fill"], p["stroke"], max_luma)))
    judged = judged.withColumns({k: c.cast("double") for k, c in edges.items()}).withColumn("error", F.col("_listed.error"))
    return judged.withColumn("filtered", copied(svg, "_actions", *edges)).drop("_listed", "_actions", *edges)
