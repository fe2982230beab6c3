"""Extraction and scale detection end to end, with stand-ins for the PDF and OCR libraries."""

from __future__ import annotations

import pytest

from plansieve.plans import services


def stand_ins():
    """Classes made here travel to the workers by value."""

    class Drawing:
        """A page of 200 x 100: a label box drawn twice, its duct, a far frame, a path and a word."""

        def decode(self, content, pages):
            for page in (1, 2):
                if pages is not None and page not in pages:
                    continue
                yield {"page": page, "kind": "page", "ord": -1, "x0": 0.0, "top": 0.0, "x1": 200.0, "bottom": 100.0}
                for i, (x0, top, x1, bottom) in enumerate([(50, 40, 90, 56), (50.5, 40, 90.5, 56), (20, 30, 160, 51), (0, 0, 199, 99)]):
                    yield {"page": page, "kind": "rect", "ord": i, "x0": float(x0), "top": float(top), "x1": float(x1), "bottom": float(bottom), "non_stroking_color": [0.0]}
                yield {"page": page, "kind": "curve", "ord": 4, "x0": 1.0, "top": 2.0, "x1": 9.0, "bottom": 8.0, "pts": [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 5.0, "y": 9.0}]}
                yield {"page": page, "kind": "word", "ord": 5, "x0": 150.0, "top": 80.0, "x1": 170.0, "bottom": 90.0, "text": "Plan"}


    class Label:
        def read(self, content, page, box, dpi):
            return [{"text": '14"', "conf": 60, "left": 0, "top": 0, "width": 9, "height": 9}, {"text": "@", "conf": 40, "left": 10, "top": 0, "width": 9, "height": 9}]

    return Drawing(), Label()


DRAWING, LABEL = stand_ins()


@pytest.fixture
def documents(spark):
    return spark.createDataFrame([("a.pdf", 9, b"%PDF-1.7"), ("b.pdf", 9, b"GIF89a")], "path string, length long, content binary")


def test_extract(spark, documents):
    whole = services.extract(documents, DRAWING).collect()
    assert [(r["doc"], r["page_count"]) for r in whole] == [("a.pdf", 2)]
    assert [e["id"] for e in whole[0]["pages"][0]["elements"]] == ["rect#0001", "rect#0002", "rect#0003", "rect#0004", "curve#0001", "word#0001"]
    requests = spark.createDataFrame([("a.pdf", '[{"page":2,"bbox":{"x0":140,"top":70,"x1":200,"bottom":100}}]')], "doc string, raw string")
    cropped = services.extract(documents, DRAWING, requests).collect()[0]
    assert [(p["page_number"], [e["id"] for e in p["elements"]]) for p in cropped["pages"]] == [(2, ["rect#0004", "word#0001"])]


def test_detect_scale(spark, documents):
    crops = spark.createDataFrame([("a.pdf", 1, 0.0, 0.0, 200.0, 100.0)], "doc string, page long, x0 double, top double, x1 double, bottom double")
    callouts, scales = services.detect_scale(documents, DRAWING, LABEL, crops)
    assert [(r["text"], r["diameter_in"], r["drawn_pts"]) for r in callouts.collect()] == [('14"ø', 14.0, 21.0)]
    assert [(r["scale"], r["callout_count"]) for r in scales.collect()] == [(1.5, 1)]
    with pytest.raises(ValueError):
        services.detect_scale(documents, DRAWING, LABEL, crops, max_luma=2.0)
