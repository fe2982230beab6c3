"""The registry, and the recipe's relations as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rect_cte(name: str = "r", dense: bool = False) -> str:
    """The recipe's rectangles."""
    sheet = "l_suppkey" if dense else "l_suppkey * 1000 + l_orderkey % 40"
    return f"""{name} AS (
      SELECT *, x0 + 8 + 2 * l_quantity AS x1, top + 6 + (floor(l_extendedprice)::BIGINT % 97) * 0.5::DOUBLE AS bottom
      FROM (SELECT *, {sheet} AS sheet,
                   row_number() OVER (PARTITION BY {sheet} ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS ord,
                   ((l_partkey * 37 + l_orderkey * 11) % 4896) * 0.25::DOUBLE AS x0,
                   ((l_orderkey * 53 + l_linenumber * 101) % 3168) * 0.25::DOUBLE AS top
            FROM lineitem))"""


COLORS = """CASE l_orderkey % 6 WHEN 1 THEN [l_discount * 10] WHEN 2 THEN [l_tax * 10, l_discount * 5, 0.25::DOUBLE]
  WHEN 3 THEN [0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 1 - l_tax] WHEN 4 THEN [1::DOUBLE, 1::DOUBLE, 1::DOUBLE, 0::DOUBLE] WHEN 5 THEN [0.1::DOUBLE, 0.2::DOUBLE] END"""

KIND = "CASE WHEN l_linenumber <= 2 THEN 'line' WHEN l_linenumber <= 4 THEN 'rect' WHEN l_linenumber = 5 THEN 'rect_curve' WHEN l_linenumber = 6 THEN 'rect_partial' ELSE 'word' END"


def kinds_cte(source: str = "r", name: str = "e") -> str:
    """The recipe's typed elements over its rectangles."""
    return f"""{name} AS (
      SELECT *, {KIND} AS type, CASE l_returnflag WHEN 'A' THEN '#000000' WHEN 'R' THEN '#808080' END AS stroke,
             CASE WHEN l_linenumber % 2 = 0 THEN '#000000' END AS fill, printf('%s#%04d', {KIND}, ord) AS id,
             CASE WHEN l_linenumber = 7 THEN 'W' || l_partkey END AS text
      FROM {source})"""


COLOR = "CASE WHEN type = 'line' THEN stroke WHEN type IN ('rect', 'rect_curve', 'rect_partial') THEN coalesce(stroke, fill) WHEN type = 'char' THEN fill END"
INK = f"coalesce({COLOR}, '#000000') = '#000000'"


def hex_sql(c: str) -> str:
    """#rrggbb of components."""
    level = lambda v: f"format('{{:02x}}', round_even({v} * 255, 0)::BIGINT)"
    channel = lambda i: level(f"CASE len({c}) WHEN 1 THEN {c}[1] WHEN 3 THEN {c}[{i}] ELSE (1 - {c}[{i}]) * (1 - {c}[4]) END")
    return f"""CASE WHEN {c} IS NULL OR len({c}) NOT IN (1, 3, 4) THEN NULL
      WHEN len(list_filter({c}, lambda v: v IS NULL OR v < 0 OR v > 1)) > 0 THEN NULL
      ELSE '#' || {channel(1)} || {channel(2)} || {channel(3)} END"""


def black_sql(c: str, t: float) -> str:
    """The ink test on components."""
    return f"""CASE WHEN {c} IS NULL THEN TRUE WHEN len({c}) IN (1, 3) THEN list_max({c}) <= {t}::DOUBLE
      WHEN len({c}) = 4 THEN {c}[4] >= {1 - t}::DOUBLE AND list_max({c}[1:3]) <= {t}::DOUBLE ELSE FALSE END"""


LABEL = """x1 - x0 BETWEEN 15 AND 80 AND bottom - top BETWEEN 8 AND 22 AND greatest((x1 - x0) / (bottom - top), (bottom - top) / (x1 - x0)) >= 1.4::DOUBLE"""


def label_cte(source: str = "r", name: str = "lab") -> str:
    return f"""{name} AS (SELECT {source}.sheet, {source}.ord, x0, top, x1, bottom, p_size::DOUBLE AS diameter_in
      FROM {source} JOIN part ON l_partkey = p_partkey WHERE {LABEL} AND p_size BETWEEN 2 AND 80)"""


def match_cte(labels: str = "lab", rects: str = "r", name: str = "m") -> str:
    """Labels with their ducts: tiers, then the first of each label."""
    return f"""pairs AS (
      SELECT a.sheet, a.ord, b.ord AS duct_ord, b.x0 AS dx0, b.top AS dtop, b.x1 AS dx1, b.bottom AS dbottom,
             (b.x1 - b.x0) * (b.bottom - b.top) AS area, least(b.x1 - b.x0, b.bottom - b.top) AS shorter, a.diameter_in,
             (a.x0 + a.x1) / 2 AS cx, (a.top + a.bottom) / 2 AS cy, greatest(a.x1 - a.x0, a.bottom - a.top) AS g
      FROM {labels} a JOIN {rects} b ON a.sheet = b.sheet
      WHERE NOT (abs(a.x0 - b.x0) < 1 AND abs(a.top - b.top) < 1 AND abs(a.x1 - b.x1) < 1 AND abs(a.bottom - b.bottom) < 1)),
    tiers AS (
      SELECT *, CASE WHEN cx BETWEEN dx0 - g AND dx1 + g AND cy BETWEEN dtop - g AND dbottom + g THEN 0
                     WHEN sqrt(((dx0 + dx1) / 2 - cx) ** 2 + ((dtop + dbottom) / 2 - cy) ** 2) <= 120 THEN 1 END AS tier,
             sqrt(((dx0 + dx1) / 2 - cx) ** 2 + ((dtop + dbottom) / 2 - cy) ** 2) AS away
      FROM pairs WHERE shorter BETWEEN 0.3::DOUBLE * diameter_in AND least(120::DOUBLE, 5 * diameter_in)),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY sheet, ord ORDER BY tier, CASE tier WHEN 1 THEN away ELSE 0 END, area DESC, duct_ord) AS place
      FROM tiers WHERE tier IS NOT NULL),
    {name} AS (
      SELECT l.sheet, l.ord, l.diameter_in, tier, duct_ord, dx0, dtop, dx1, dbottom, shorter AS drawn_pts, shorter / l.diameter_in AS pts_per_inch
      FROM {labels} l LEFT JOIN (SELECT * FROM best WHERE place = 1) b ON l.sheet = b.sheet AND l.ord = b.ord)"""


def scale_cte(source: str = "m", name: str = "sc") -> str:
    return f"""med AS (SELECT *, median(pts_per_inch) OVER (PARTITION BY sheet) AS middle FROM {source}),
    {name} AS (
      SELECT sheet, coalesce(avg(CASE WHEN pts_per_inch BETWEEN middle * 0.9::DOUBLE AND middle * 1.1::DOUBLE THEN pts_per_inch END), any_value(middle)) AS scale,
             count(*) AS callout_count,
             count(*) FILTER (WHERE pts_per_inch IS NOT NULL AND NOT pts_per_inch BETWEEN middle * 0.9::DOUBLE AND middle * 1.1::DOUBLE) AS rejected
      FROM med GROUP BY sheet)"""
