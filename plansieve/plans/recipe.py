"""Drawing relations derived from the supplied tables, alike on every engine.

One row of lineitem is one drawing object. Coordinates are multiples of a quarter
point, so that sums and ties are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scale import label_sized
from ..schema import USUAL
from ..session import table

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
WIDTH, HEIGHT = 1224.0, 792.0


def sheet(dense: bool = False) -> Column:
    s = F.col("l_suppkey")
    return s if dense else s * 1000 + F.col("l_orderkey") % 40


def rectangles(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Rectangles of sheets, with the columns of lineitem that later steps derive from."""
    half = F.floor("l_extendedprice") % 97 * 0.5
    placed = table(spark, sf_dir, "lineitem").withColumn("sheet", sheet(dense))
    x0 = (F.col("l_partkey") * 37 + F.col("l_orderkey") * 11) % 4896 * 0.25
    top = (F.col("l_orderkey") * 53 + F.col("l_linenumber") * 101) % 3168 * 0.25
    return placed.select(
        "sheet",
        F.row_number().over(Window.partitionBy("sheet").orderBy(*ORDER)).cast("long").alias("ord"),
        x0.alias("x0"),
        top.alias("top"),
        (x0 + 8 + 2 * F.col("l_quantity")).alias("x1"),
        (top + 6 + half).alias("bottom"),
        *["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"],
    )


def colors() -> Column:
    """Components of 1, 3, 4 and unusable arity, or null."""
    k = F.col("l_orderkey") % 6
    three = F.array(F.col("l_tax") * 10, F.col("l_discount") * 5, F.lit(0.25))
    four = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), 1 - F.col("l_tax"))
    return (
        F.when(k == 1, F.array(F.col("l_discount") * 10)).when(k == 2, three).when(k == 3, four).when(k == 4, F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(0.0))).when(k == 5, F.array(F.lit(0.1), F.lit(0.2)))
    )


def path() -> Column:
    """A closed rectangle, a U of equal arms, a U of unequal arms or a triangle, by line number."""
    x = ((F.col("l_partkey") * 37 + F.col("l_orderkey") * 11) % WIDTH).cast("double")
    y = ((F.col("l_orderkey") * 53 + F.col("l_linenumber") * 101) % HEIGHT).cast("double")
    w, h = 8 + 2 * F.col("l_quantity"), 6 + F.floor("l_extendedprice") % 97 * 0.5
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    zero = F.lit(0.0)
    k = F.col("l_linenumber") % 4
    closed = F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h), at(zero, zero))
    equal = F.array(at(w, zero), at(zero, zero), at(zero, h), at(w, h))
    unequal = F.array(at(w, zero), at(zero, zero), at(zero, h), at(0.75 * w, h))
    return F.when(k == 0, closed).when(k == 1, equal).when(k == 2, unequal).otherwise(F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, zero)))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rectangles(spark, sf_dir).withColumn("pts", path())


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of several types with stroke and fill as hex colours."""
    n = F.col("l_linenumber")
    flag = F.col("l_returnflag")
    kind = F.when(n <= 2, "line").when(n <= 4, "rect").when(n == 5, "rect_curve").when(n == 6, "rect_partial").otherwise("word")
    none = F.lit(None).cast("array<struct<x:double,y:double>>")
    return rectangles(spark, sf_dir).select(
        "*",
        kind.alias("type"),
        F.when(flag == "A", "#000000").when(flag == "R", "#808080").alias("stroke"),
        F.when(n % 2 == 0, "#000000").alias("fill"),
        none.alias("corners"),
        F.format_string("%s#%04d", kind, F.col("ord")).alias("id"),
        F.when(n == 7, F.concat(F.lit("W"), F.col("l_partkey").cast("string"))).alias("text"),
    )


def raw_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecoded objects: lines, rectangles, paths, chars and words, a few with an unknown edge."""
    n = F.col("l_linenumber")
    kind = F.when(n == 1, "line").when(n == 2, "rect").when(n <= 5, "curve").when(n == 6, "char").otherwise("word")
    null = F.lit(None).cast("array<double>")
    return rectangles(spark, sf_dir).select(
        "sheet",
        "ord",
        kind.alias("kind"),
        "x0",
        "top",
        F.when(F.col("l_partkey") % 50 != 0, F.col("x1")).alias("x1"),
        "bottom",
        (F.col("l_tax") * 10).alias("linewidth"),
        F.when(F.col("l_orderkey") % 2 == 0, colors()).otherwise(F.when(F.col("l_orderkey") % 3 == 0, F.array().cast("array<double>"))).alias("stroke_color"),
        F.when(F.col("l_orderkey") % 5 == 0, colors()).otherwise(null).alias("stroking_color"),
        colors().alias("non_stroking_color"),
        (F.col("l_returnflag") == "A").alias("filled"),
        F.when(kind == "curve", path()).alias("pts"),
        F.when(n >= 6, F.concat(F.lit("T"), F.col("l_partkey").cast("string"))).alias("text"),
        F.lit("Sans").alias("fontname"),
        (F.col("l_quantity") / 4).alias("size"),
    )


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the sparse recipe."""
    return table(spark, sf_dir, "lineitem").select(sheet().alias("sheet")).distinct().select("sheet", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop for the first ten sheets of each supplier."""
    s = F.col("s_suppkey")
    x0, top = s % 10 * 60.0, s % 7 * 40.0
    return table(spark, sf_dir, "supplier").select(F.explode(F.sequence(s * 1000, s * 1000 + 9)).alias("sheet"), x0.alias("x0"), top.alias("top"), (x0 + 600).alias("x1"), (top + 300).alias("bottom"))


def labels(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Label-sized rectangles with the diameter of their part, as far as it is in range."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("diameter_in"))
    found = rectangles(spark, sf_dir, dense).where(label_sized()).join(parts, "l_partkey")
    return found.where(F.col("diameter_in").between(USUAL.min_diameter, USUAL.max_diameter)).select("sheet", "ord", "x0", "top", "x1", "bottom", "diameter_in")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of labels: digits, and an inch mark and a sign in one or two pieces."""
    p = F.col("p_partkey")
    sign = F.element_at(F.array(*[F.lit(x) for x in ("@", "ø", "O", "6", "°@", "x")]), (p % 6 + 1).cast("int"))
    number = F.when(p % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).otherwise(F.col("p_size").cast("string"))
    conf = lambda k: (p * k % 100).cast("int")
    token = lambda text, c, left: F.struct(text.alias("text"), c.alias("conf"), left.cast("int").alias("left"), (p % 9).cast("int").alias("top"), F.lit(20).alias("width"), F.lit(30).alias("height"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", F.when(p % 7 == 0, F.array(token(F.lit("Ø"), conf(3), p % 5), token(F.concat(number, F.lit('"'), sign), conf(7), p % 5 + 25))).otherwise(F.array(token(number, conf(3), p % 5), token(F.concat(F.lit('"'), sign), conf(7), p % 5 + 25))).alias("tokens")
    )


def label_tokens(spark: SparkSession, sf_dir: str, boxes: DataFrame) -> DataFrame:
    """What is read in boxes (sheet, ord, with paths at 2**40 and more): the size of the object's part in inches, in two pieces."""
    p = F.col("p_partkey")
    token = lambda text, conf, left: F.struct(text.alias("text"), conf.cast("int").alias("conf"), F.lit(left).alias("left"), F.lit(0).alias("top"), F.lit(9).alias("width"), F.lit(9).alias("height"))
    pieces = F.array(token(F.concat(F.col("p_size").cast("string"), F.lit('"')), p * 3 % 100, 0), token(F.lit("@"), p * 7 % 100, 10))
    parts = table(spark, sf_dir, "part").select(p.alias("l_partkey"), pieces.alias("tokens"))
    objects = rectangles(spark, sf_dir).select("sheet", F.col("ord").alias("own"), "l_partkey")
    return boxes.withColumn("own", F.col("ord") % (1 << 40)).join(objects, ["sheet", "own"]).join(parts, "l_partkey").select("sheet", "ord", "tokens")
