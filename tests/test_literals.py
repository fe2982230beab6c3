"""Literal cases of single operators, with values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plansieve.functions import color, geometry, text
from plansieve.operators import cleanup, extract, scale, shapes, svg
from plansieve.sources import intake


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def components(*v):
    return F.array(*[F.lit(float(x)) for x in v]) if v else F.lit(None).cast("array<double>")


def path(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


@pytest.mark.parametrize(("c", "want"), [((0.5,), "#808080"), ((1, 1, 1, 0), "#000000"), ((0.5, 0.5, 0.5, 1), "#000000"), ((0.1, 0.2), None), ((2, 0, 0), None), ((), None), ((1, 0, 0.5), "#ff0080")])
def test_hex(spark, c, want):
    assert one(spark, color.hex_color(components(*c))) == want


@pytest.mark.parametrize(("c", "want"), [((), True), ((1, 1, 1, 0), False), ((0.5, 0.5, 0.5, 1), False), ((0, 0, 0, 1), True), ((0.02,), True), ((0.03,), False), ((0.1, 0.2), False)])
def test_black(spark, c, want):
    assert one(spark, color.is_black(components(*c), 0.02)) is want


@pytest.mark.parametrize(("c", "want"), [("#050505", True), ("#060606", False), (None, True), ("#12", False)])
def test_ink(spark, c, want):
    assert one(spark, color.is_ink(F.lit(c).cast("string"), 0.02)) is want


@pytest.mark.parametrize(("raw", "label", "d"), [('14"@', '14"ø', 14.0), ('10.5"O', '10.5"ø', 10.5), ("166", '16"ø', 16.0), ("16", None, None), ("2024@", None, None), ('12"', None, None), (None, None, None)])
def test_callout(spark, raw, label, d):
    r = F.lit(raw).cast("string")
    assert one(spark, text.callout_text(r)) == label
    assert one(spark, text.callout_diameter(r)) == d


@pytest.mark.parametrize(("v", "want"), [(0.15, 0.1), (0.25, 0.2), (0.35, 0.3), (0.45, round(0.45, 1)), (2.675, round(2.675, 1)), (-0.25, -0.2), (1234.05, round(1234.05, 1))])
def test_round1(spark, v, want):
    assert one(spark, geometry.round1(F.lit(v))) == want


def test_round1_like_python(spark):
    values = [i * 0.05 + j * 1e-3 for i in range(400) for j in (0, 1)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", geometry.round1(F.col("v")).alias("r")).collect()
    assert all(r["r"] == round(r["v"], 1) for r in got)


@pytest.mark.parametrize(
    ("points", "axis"),
    [
        ([(0, 0), (0, 10), (10, 10), (10, 0)], True),
        ([(0, 0), (10, 10), (0, 10), (10, 0)], False),
        ([(0, 0), (2, 0), (2, 2), (0, 2)], False),
        ([(0, 0), (10, 0), (10, 10)], False),
    ],
)
def test_axis_rectangle(spark, points, axis):
    assert one(spark, shapes.has_axis_rectangle(path(*points))) is axis


@pytest.mark.parametrize(
    ("points", "kind"),
    [
        ([(0, 0), (10, 10), (0, 10), (10, 0)], "rect_curve"),
        ([(40, 0), (0, 0), (0, 10), (40, 10)], "rect_curve"),
        ([(40, 0), (0, 0), (0, 10), (39, 10)], "rect_curve"),
        ([(40, 0), (0, 0), (0, 10), (32, 10)], "rect_partial"),
        ([(40, 0), (0, 0), (0, 10), (27, 10)], "curve"),
        ([(0, 0), (40, 0), (40, 10), (80, 10)], "rect_partial"),
        ([(0, 0), (10, 0), (5, 8), (0, 0)], "curve"),
        ([(10, 0), (20, 10), (10, 20), (0, 10), (10, 0)], "rect_curve"),
    ],
)
def test_curve_types(spark, points, kind):
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in points],)], "pts array<struct<x:double,y:double>>")
    assert extract.classify_curves(df).first()["type"] == kind


def test_partial_box(spark):
    assert tuple(one(spark, shapes.partial_box(path((0, 0), (40, 0), (40, 10), (80, 10))))) == (0.0, 0.0, 80.0, 10.0)


def test_without_repeats(spark):
    assert [tuple(p) for p in one(spark, shapes.without_repeats(path((1, 1), (1, 1), (2, 2), (2, 2), (1, 1))))] == [(1.0, 1.0), (2.0, 2.0)]


def test_hull_of_hull(spark):
    points = [{"x": float(i % 7), "y": float(i * 5 % 11)} for i in range(20)]
    df = spark.createDataFrame([(points,)], "p array<struct<x:double,y:double>>")
    once = df.select(shapes.convex_hull("p").alias("p"))
    assert {tuple(q) for q in once.first()["p"]} == {tuple(q) for q in once.select(shapes.convex_hull("p").alias("p")).first()["p"]}


def boxes(spark, *rows):
    return spark.createDataFrame([("s", i, *map(float, r)) for i, r in enumerate(rows)], "sheet string, ord long, x0 double, top double, x1 double, bottom double")


def test_dedupe_is_ordered(spark):
    kept = scale.dedupe_boxes(boxes(spark, (-1, 0, 1, 2), (0.5, 0, 2.5, 2), (2, 0, 4, 2), (9, 0, 11, 2)), ["sheet"])
    assert sorted(r["ord"] for r in kept.collect()) == [0, 2, 3]


def test_label_size(spark):
    kept = boxes(spark, (0, 0, 40, 16), (0, 0, 14, 10), (0, 0, 20, 20)).where(scale.label_sized())
    assert [r["ord"] for r in kept.collect()] == [0]


@pytest.mark.parametrize(
    ("rects", "want"),
    [
        ([(0, 0, 10, 10), (0, 0, 30, 30)], 1),
        ([(0, 0, 30, 30), (0, 0, 30, 30)], 0),
        ([(60, 0, 70, 10), (55, -5, 75, 15)], 1),
        ([(500, 500, 520, 520)], None),
    ],
)
def test_match(spark, rects, want):
    labels = boxes(spark, (-2, -1, 2, 1)).withColumn("diameter_in", F.lit(10.0))
    found = scale.match_ducts(labels, boxes(spark, *rects), ["sheet"]).collect()
    assert [r["duct_ord"] for r in found] == [want]
    again = scale.match_ducts(labels, boxes(spark, *rects), ["sheet"], cell=200.0).collect()
    assert [r["duct_ord"] for r in again] == [want]


@pytest.mark.parametrize(("values", "want"), [([1.0, 1.02, 1.04, 3.0], 1.02), ([1.0, 3.0], 2.0), ([None], None)])
def test_scale(spark, values, want):
    df = spark.createDataFrame([("s", v) for v in values], "sheet string, pts_per_inch double")
    got = scale.page_scales(df, ["sheet"]).first()["scale"]
    assert got is None if want is None else abs(got - want) < 1e-9


@pytest.mark.parametrize(("s", "ratio"), [(1.5, "1:48"), (0.75, "1:96"), (0.4, "1:192"), (5.0, "1:14.4"), (2.0, "1:36.0")])
def test_scale_ratio(spark, s, ratio):
    assert one(spark, text.scale_ratio(F.lit(s))) == ratio


def elements(spark, *rows):
    return spark.createDataFrame([(k, *map(float, b)) for k, *b in rows], "type string, x0 double, top double, x1 double, bottom double").withColumn("corners", F.lit(None).cast("array<struct<x:double,y:double>>"))


def test_rectangle_filters(spark):
    kept = elements(spark, ("rect", 0, 0, 12, 10), ("rect", 0, 0, 11, 10), ("rect_partial", 0, 0, 10, 10)).where(cleanup.passes_aspect())
    assert [(r["type"], r["x1"]) for r in kept.collect()] == [("rect", 12.0), ("rect_partial", 10.0)]
    kept = elements(spark, ("rect", 0, 0, 10, 4.5), ("rect", 0, 0, 10, 4.4)).where(cleanup.passes_min_side(F.lit(1.5)))
    assert [r["bottom"] for r in kept.collect()] == [4.5]
    kept = elements(spark, ("rect", 0, 0, 80, 100), ("rect", 0, 0, 81, 100)).where(cleanup.passes_max_area(F.lit(1.0)))
    assert [r["x1"] for r in kept.collect()] == [80.0]


def test_crop_touching_and_unknown(spark):
    crop = tuple(F.lit(v) for v in (10.0, 0.0, 20.0, 10.0))
    df = spark.createDataFrame([(0, 10.0), (1, 9.9), (2, None)], "i int, x1 double")
    kept = df.where(geometry.intersects((F.lit(0.0), F.lit(0.0), F.col("x1"), F.lit(5.0)), crop))
    assert [r["i"] for r in kept.collect()] == [0]


def requests(spark, *raw):
    return spark.createDataFrame([(str(i), r) for i, r in enumerate(raw)], "doc string, raw string")


def test_crop_json(spark):
    box = '{"page":1,"bbox":{"x0":%d,"top":0,"x1":9,"bottom":9}}'
    got = intake.parse_crops(requests(spark, f"[{box % 1},{box % 2}]", "[]", "", None)).collect()
    assert [(r["doc"], r["page"], r["x0"]) for r in got] == [("0", 1, 2.0)]


@pytest.mark.parametrize("raw", ['{"page":1}', "nonsense", '[{"page":1,"bbox":{"x0":9,"top":0,"x1":9,"bottom":9}}]', '[{"bbox":{"x0":1,"top":0,"x1":9,"bottom":9}}]'])
def test_bad_crop_json(spark, raw):
    from pyspark.errors import PySparkException

    assert intake.parse_crops(requests(spark, raw), strict=False).where("error is not null").count() == 1
    with pytest.raises(PySparkException):
        intake.parse_crops(requests(spark, raw)).collect()


def test_uploads(spark):
    df = spark.createDataFrame([(10, b"%PDF-1"), (10, b"GIF8"), (2**25, b"%PDF"), (0, b"")], "length long, content binary")
    good, bad = intake.split_uploads(df)
    assert good.count() == 1 and sorted(r["error"] for r in bad.collect()) == ["not a PDF", "not a PDF", "too large"]


def test_svg(spark):
    page = '<svg xmlns="http://www.w3.org/2000/svg" width="9" height="9"><defs><path fill="red"/></defs><g><path fill="#000" stroke="red"/></g><path style="stroke: red"/><path fill="none" stroke="none"/></svg>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "<svg"), (4, "<svg/>")], "id int, page string")
    rows = {r["id"]: r for r in svg.filter_pages(df, "page", 0.02, tuple(F.lit(v) for v in (1.0, 2.0, 5.0, 1234567.25))).collect()}
    out = rows[1]["filtered"]
    assert out.count("<path") == 3 and 'stroke="none"' in out and 'viewBox="1.0 2.0 4.0 1234565.25"' in out and "width" not in out and out.startswith('<svg xmlns="http://www.w3.org/2000/svg"')
    assert 'preserveAspectRatio="xMinYMin meet"' in out and 'fill="red"' in out
    assert rows[2]["filtered"] is None and rows[2]["error"] is None and rows[3]["filtered"] is None and rows[3]["error"] and rows[4]["filtered"].startswith("<svg")


def test_stream(spark, tmp_path):
    from plansieve.streaming import stream_documents

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "in" / "b.pdf").write_bytes(b"GIF89a")
    run = stream_documents(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("intake").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(str(r["error"]) for r in spark.table("intake").collect()) == ["None", "not a PDF"]


def test_missing_decoder(spark):
    from plansieve.sources.decoders import LibraryDecoder

    with pytest.raises(RuntimeError):
        list(LibraryDecoder().decode(b"%PDF", None))
