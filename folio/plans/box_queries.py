"""Queries over boxes, regions and colours, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import boxes as X
from folio.operators import regions as R
from folio.plans.fixtures import sql_with, table
from folio.storage import shuffled

QUERIES: dict[str, tuple] = {}


def _add(name: str, sql: str | None, *fixtures: str):
    def keep(run):
        QUERIES[name] = (run, sql_with(list(fixtures or ("lines_fx",)), sql) if sql else None)
        return run

    return keep


def _docs(name: str, sql: str):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lines_fx")


def _panels(spark, sf_dir):
    return table(spark, sf_dir, "panels_fx")


_GAPX, _GAPY = "greatest(0, {a}.x1 - {b}.x2, {b}.x1 - {a}.x2)", "greatest(0, {a}.y1 - {b}.y2, {b}.y1 - {a}.y2)"


def _dist(a: str, b: str) -> str:
    gx, gy = _GAPX.format(a=a, b=b), _GAPY.format(a=a, b=b)
    return f"sqrt(CAST({gx} * {gx} + {gy} * {gy} AS DOUBLE))"


def _common(a: str, b: str) -> str:
    return f"(CAST(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) AS BIGINT) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"


def _area(a: str) -> str:
    return f"(CAST({a}.x2 - {a}.x1 AS BIGINT) * ({a}.y2 - {a}.y1))"


@_add("confidence_filter", "SELECT line_id FROM lines_fx WHERE prob >= 0.7 AND trim(text) <> '' AND (x2 - x1) * (y2 - y1) > 1")
def confidence_filter(spark, sf_dir):
    big = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) > 1
    return _lines(spark, sf_dir).where((F.col("prob") >= 0.7) & (F.trim("text") != "") & big).select("line_id")


@_add(
    "box_score_filter",
    """SELECT line_id, greatest(x1 - 3, 0) AS x1, greatest(y1 - 3, 0) AS y1, least(x2 + 3, 900) AS x2, least(y2 + 3, 2600) AS y2 FROM lines_fx
       WHERE least(x2 - x1, y2 - y1) >= 3 AND prob >= 0.6 AND least(x2 - x1, y2 - y1) + 6 >= 5""",
)
def box_score_filter(spark, sf_dir):
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    kept = _lines(spark, sf_dir).where((side >= 3) & (F.col("prob") >= 0.6) & (side + 6 >= 5))
    return kept.select(
        "line_id", F.greatest(F.col("x1") - 3, F.lit(0)).alias("x1"), F.greatest(F.col("y1") - 3, F.lit(0)).alias("y1"),
        F.least(F.col("x2") + 3, F.lit(900)).alias("x2"), F.least(F.col("y2") + 3, F.lit(2600)).alias("y2"),
    )


@_add(
    "quad_features",
    """SELECT line_id, x2 - x1 AS w, y2 - y1 AS h, least(x2 - x1, y2 - y1) AS font, round((x2 - x1) * 1.0 / (y2 - y1), 6) AS aspect, x1 + x2 AS cx2, y1 + y2 AS cy2,
       CAST(x2 - x1 AS BIGINT) * (y2 - y1) AS area, CASE WHEN y2 - y1 >= x2 - x1 THEN 'v' ELSE 'h' END AS direction FROM lines_fx""",
)
def quad_features(spark, sf_dir):
    return X.features(_lines(spark, sf_dir)).select("line_id", "w", "h", "font", F.round("aspect", 6).alias("aspect"), "cx2", "cy2", "area", "direction")


_EDGES = f"""
    SELECT a.page_id, a.line_id AS u, b.line_id AS v
    FROM (SELECT *, x2 - x1 AS w, y2 - y1 AS h, least(x2 - x1, y2 - y1) AS font, (x2 - x1) * 1.0 / (y2 - y1) AS aspect FROM lines_fx) a
    JOIN (SELECT *, x2 - x1 AS w, y2 - y1 AS h, least(x2 - x1, y2 - y1) AS font, (x2 - x1) * 1.0 / (y2 - y1) AS aspect FROM lines_fx) b
      ON a.page_id = b.page_id AND a.line_id < b.line_id
    WHERE {_dist('a', 'b')} < least(a.font, b.font) AND greatest(a.font, b.font) <= 2 * least(a.font, b.font)
      AND NOT ((a.aspect > 1.3 AND b.aspect < 1 / 1.3) OR (b.aspect > 1.3 AND a.aspect < 1 / 1.3))
      AND CASE WHEN abs(a.x1 + a.w // 2 - b.x1 - b.w // 2) < 3 THEN true
               WHEN (a.w > 1.9 * a.h AND b.h > 1.9 * b.w) OR (b.w > 1.9 * b.h AND a.h > 1.9 * a.w) THEN false
               WHEN a.w > 1.9 * a.h OR b.w > 1.9 * b.h THEN abs(a.x1 - b.x1) < 3 * least(a.font, b.font) OR abs(a.x2 - b.x2) < 3 * least(a.font, b.font)
               WHEN a.h > 1.9 * a.w OR b.h > 1.9 * b.w THEN abs(a.y1 - b.y1) < 3 * least(a.font, b.font) OR abs(a.y2 - b.y2) < 3 * least(a.font, b.font)
               ELSE false END"""


@_add("merge_edges", _EDGES)
def merge_edges(spark, sf_dir):
    return X.merge_edges(_lines(spark, sf_dir))


_COMPONENTS = f"""WITH RECURSIVE e AS ({_EDGES}), s AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    r AS (SELECT line_id AS node, line_id AS seen FROM lines_fx UNION SELECT r.node, s.v FROM r JOIN s ON r.seen = s.u)
    SELECT l.page_id, l.line_id, m.component FROM lines_fx l JOIN (SELECT node, min(seen) AS component FROM r GROUP BY node) m ON l.line_id = m.node"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH lines_fx AS", "WITH RECURSIVE lines_fx AS").replace(", RECURSIVE e AS", ", e AS")


@_add("components", None)
def components(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return X.components(lines, X.merge_edges(lines))


QUERIES["components"] = (components, _recursive(sql_with("lines_fx", _COMPONENTS)))


def _regions(spark, sf_dir):
    """Lines with the region (component) they belong to."""
    lines = _lines(spark, sf_dir)
    return lines.join(X.components(lines, X.merge_edges(lines)).select("line_id", F.col("component").alias("region_id")), "line_id")


def _over_regions(body: str) -> str:
    """SQL over lines with their region."""
    comp = _COMPONENTS.replace("SELECT l.page_id, l.line_id, m.component FROM", "SELECT l.*, m.component AS region_id FROM")
    head, tail = comp.rsplit("SELECT l.*", 1)
    return _recursive(sql_with("lines_fx", f"{head.rstrip()}, g AS (SELECT l.*{tail}) {body}"))


@_add("rect_distance", f"SELECT a.line_id AS u, b.line_id AS v, round({_dist('a', 'b')}, 6) AS distance FROM lines_fx a JOIN lines_fx b ON a.page_id = b.page_id AND a.line_id < b.line_id")
def rect_distance(spark, sf_dir):
    """Distances of all pairs of boxes of a page; a page is bounded."""
    lines = _lines(spark, sf_dir)
    pairs = lines.alias("a").join(lines.alias("c"), (F.col("a.page_id") == F.col("c.page_id")) & (F.col("a.line_id") < F.col("c.line_id")))
    return pairs.select(F.col("a.line_id").alias("u"), F.col("c.line_id").alias("v"), F.round(X.rect_distance("a", "c"), 6).alias("distance"))


@_add(
    "panel_assign",
    """SELECT page_id, line_id, panel_id FROM (SELECT l.page_id, l.line_id, p.panel_id, row_number() OVER (PARTITION BY l.line_id ORDER BY
         CASE WHEN l.x1 + l.x2 BETWEEN 2 * p.x1 AND 2 * p.x2 AND l.y1 + l.y2 BETWEEN 2 * p.y1 AND 2 * p.y2 THEN 0 ELSE 1 END,
         CASE WHEN l.x1 + l.x2 BETWEEN 2 * p.x1 AND 2 * p.x2 AND l.y1 + l.y2 BETWEEN 2 * p.y1 AND 2 * p.y2 THEN 0
              ELSE CAST(greatest(0, 2 * p.x1 - l.x1 - l.x2, l.x1 + l.x2 - 2 * p.x2) AS BIGINT) ** 2 + CAST(greatest(0, 2 * p.y1 - l.y1 - l.y2, l.y1 + l.y2 - 2 * p.y2) AS BIGINT) ** 2 END, p.panel_id) AS n
       FROM lines_fx l JOIN (SELECT page_id, panel_id, x1 + 60 * CAST(panel_id % 3 AS INT) AS x1, y1, x2 + 60 * CAST(panel_id % 3 AS INT) AS x2, y2 FROM panels_fx) p ON l.page_id = p.page_id) q WHERE n = 1""",
    "lines_fx", "panels_fx",
)
def panel_assign(spark, sf_dir):
    """Panels moved aside by up to 120, so that lines lie within one, in part or beside."""
    aside = 60 * (F.col("panel_id") % 3).cast("int")
    return X.panel_assign(_lines(spark, sf_dir), _panels(spark, sf_dir).withColumns({"x1": F.col("x1") + aside, "x2": F.col("x2") + aside}))


@_add(
    "nearest_owner",
    """SELECT page_id, point_id, owner FROM (SELECT q.page_id, q.point_id, l.line_id AS owner, row_number() OVER (PARTITION BY q.point_id ORDER BY
         CAST(greatest(0, l.x1 - q.px, q.px - l.x2) AS BIGINT) ** 2 + CAST(greatest(0, l.y1 - q.py, q.py - l.y2) AS BIGINT) ** 2,
         CAST(2 * q.px - l.x1 - l.x2 AS BIGINT) ** 2 + CAST(2 * q.py - l.y1 - l.y2 AS BIGINT) ** 2, l.line_id) AS n
       FROM (SELECT page_id, line_id AS point_id, x1 + 40 AS px, y1 - 10 AS py FROM lines_fx) q JOIN lines_fx l ON q.page_id = l.page_id) z WHERE n = 1""",
)
def nearest_owner(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    points = lines.select("page_id", F.col("line_id").alias("point_id"), (F.col("x1") + 40).alias("px"), (F.col("y1") - 10).alias("py"))
    return X.nearest_owner(points, lines)


@_add(
    "component_assign",
    f"""WITH b AS (SELECT page_id, line_id AS blob_id, x1 + 15 + d AS x1, y1 + 20 AS y1, x1 + 35 + d AS x2, y1 + 60 AS y2 FROM (SELECT *, CASE line_id % 4 WHEN 1 THEN 18 WHEN 2 THEN -40 ELSE 0 END AS d FROM lines_fx) z),
    j AS (SELECT b.page_id, b.blob_id, l.line_id, {_common('b', 'l')} * 1.0 / least({_area('b')}, {_area('l')}) AS share, {_dist('b', 'l')} AS apart,
            0.5 * greatest(least(l.x2 - l.x1, l.y2 - l.y1, b.x2 - b.x1, b.y2 - b.y1), 10) AS reach,
            CAST(b.x1 + b.x2 - l.x1 - l.x2 AS BIGINT) ** 2 + CAST(b.y1 + b.y2 - l.y1 - l.y2 AS BIGINT) ** 2 AS centres
          FROM b JOIN lines_fx l ON b.page_id = l.page_id WHERE {_area('b')} > 9 AND {_area('b')} < {_area('l')}),
    r AS (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY share DESC, line_id) AS n, row_number() OVER (PARTITION BY blob_id ORDER BY centres, line_id) AS c FROM j),
    o AS (SELECT page_id, blob_id, max(CASE WHEN n = 1 AND share > 0.01 THEN line_id END) AS a, max(CASE WHEN c = 1 AND apart <= reach THEN line_id END) AS z FROM r GROUP BY page_id, blob_id)
    SELECT page_id, blob_id, coalesce(a, z) AS line_id FROM o WHERE coalesce(a, z) IS NOT NULL""",
)
def component_assign(spark, sf_dir):
    """Each blob to the line it shares most with, else to a near one; blobs as large as a line are dropped for it."""
    lines = _lines(spark, sf_dir).withColumn("d", F.when(F.col("line_id") % 4 == 1, 18).when(F.col("line_id") % 4 == 2, -40).otherwise(0))
    edges = [(F.col("x1") + 15 + F.col("d")).alias("x1"), (F.col("y1") + 20).alias("y1"), (F.col("x1") + 35 + F.col("d")).alias("x2"), (F.col("y1") + 60).alias("y2")]
    return R.component_assign(lines.select("page_id", F.col("line_id").alias("blob_id"), *edges), lines.drop("d"))


@_add(
    "exclusive_cover",
    f"""WITH b AS (SELECT page_id, line_id, x1 + CASE line_id % 3 WHEN 1 THEN 5000 WHEN 2 THEN 40 ELSE 0 END AS x1, y1, x2 + CASE line_id % 3 WHEN 1 THEN 5000 WHEN 2 THEN 40 ELSE 0 END AS x2, y2 FROM lines_fx),
    s AS (SELECT l.page_id, l.line_id, p.panel_id, {_common('l', 'p')} * 1.0 / {_area('l')} AS share FROM b l JOIN panels_fx p ON l.page_id = p.page_id),
    m AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY share DESC, panel_id) AS n FROM s),
    c AS (SELECT page_id, line_id, CASE WHEN share >= 0.5 THEN panel_id END AS panel_id FROM m WHERE n = 1)
    SELECT page_id, line_id, CASE WHEN count(panel_id) OVER (PARTITION BY page_id, panel_id) = 1 THEN panel_id END AS panel_id FROM c""",
    "lines_fx", "panels_fx",
)
def exclusive_cover(spark, sf_dir):
    """Lines of which some lie far from all panels and some half beside one."""
    aside = F.when(F.col("line_id") % 3 == 1, 5000).when(F.col("line_id") % 3 == 2, 40).otherwise(0)
    return X.exclusive_cover(_lines(spark, sf_dir).withColumns({"x1": F.col("x1") + aside, "x2": F.col("x2") + aside}), _panels(spark, sf_dir))


@_add(
    "contained_remove",
    """WITH b AS (SELECT page_id, line_id, x1, y1, CASE WHEN line_id % 5 = 0 THEN x1 + 200 ELSE x2 END AS x2, y2 FROM lines_fx)
    SELECT page_id, line_id FROM b i WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.page_id = i.page_id AND o.x1 <= i.x1 AND o.y1 <= i.y1 AND o.x2 >= i.x2 AND o.y2 >= i.y2
      AND (o.x1 <> i.x1 OR o.y1 <> i.y1 OR o.x2 <> i.x2 OR o.y2 <> i.y2))""",
)
def contained_remove(spark, sf_dir):
    wide = _lines(spark, sf_dir).withColumn("x2", F.when(F.col("line_id") % 5 == 0, F.col("x1") + 200).otherwise(F.col("x2")))
    return X.contained_remove(wide).select("page_id", "line_id")


@_add(
    "overlap_pairs",
    f"""WITH b AS (SELECT page_id, line_id, x1, y1, x2 + 25 AS x2, y2 FROM lines_fx)
    SELECT l.page_id, l.line_id AS u, r.line_id AS v, {_common('l', 'r')} AS common, round({_common('l', 'r')} * 1.0 / least({_area('l')}, {_area('r')}), 6) AS ratio, {_common('l', 'r')} > 0.5 * {_area('r')} AS u_contains_v
    FROM b l JOIN b r ON l.page_id = r.page_id AND l.line_id <> r.line_id WHERE {_common('l', 'r')} * 1.0 / least({_area('l')}, {_area('r')}) > 0.1""",
)
def overlap_pairs(spark, sf_dir):
    wide = _lines(spark, sf_dir).withColumn("x2", F.col("x2") + 25)
    return X.overlap_pairs(wide).withColumn("ratio", F.round("ratio", 6))


_NEIGHBOURS = """
    n AS (SELECT a.page_id, a.line_id,
      min_by(c.line_id, (-c.x2) * 100000000 + c.line_id) FILTER (c.x2 <= a.x1 AND rowy) AS left_id, min_by(c.line_id, c.x1 * 100000000 + c.line_id) FILTER (c.x1 >= a.x2 AND rowy) AS right_id,
      min_by(c.line_id, (-c.y2) * 100000000 + c.line_id) FILTER (c.y2 <= a.y1 AND colx) AS top_id, min_by(c.line_id, c.y1 * 100000000 + c.line_id) FILTER (c.y1 >= a.y2 AND colx) AS bottom_id
      FROM lf a LEFT JOIN lf c ON a.page_id = c.page_id AND a.line_id <> c.line_id
      CROSS JOIN LATERAL (SELECT 3 * (least(a.y2, c.y2) - greatest(a.y1, c.y1)) >= least(a.y2 - a.y1, c.y2 - c.y1) AS rowy, 3 * (least(a.x2, c.x2) - greatest(a.x1, c.x1)) >= least(a.x2 - a.x1, c.x2 - c.x1) AS colx) k
      GROUP BY a.page_id, a.line_id)"""
_LF = "WITH lf AS (SELECT page_id, line_id, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM lines_fx),"


@_add("neighbor_lookup", f"{_LF}{_NEIGHBOURS} SELECT * FROM n")
def neighbor_lookup(spark, sf_dir):
    return X.neighbours(_lines(spark, sf_dir))


_GUTTER = """g AS (SELECT a.page_id, coalesce(min(a.x1 - l.x2), 1) AS gx, coalesce(min(a.y1 - t.y2), 1) AS gy
    FROM n JOIN lf a ON a.line_id = n.line_id LEFT JOIN lf l ON l.line_id = n.left_id LEFT JOIN lf t ON t.line_id = n.top_id GROUP BY a.page_id)"""


@_add("gutter_stats", f"{_LF}{_NEIGHBOURS}, {_GUTTER} SELECT * FROM g")
def gutter_stats(spark, sf_dir):
    return X.gutter_stats(_lines(spark, sf_dir))


@_add(
    "box_expand",
    f"""{_LF}{_NEIGHBOURS}, {_GUTTER}, h AS (SELECT page_id, min(x1) AS px1, min(y1) AS py1, max(x2) AS px2, max(y2) AS py2 FROM lf GROUP BY page_id)
    SELECT n.page_id, n.line_id, coalesce(l.x2 + gx, px1) AS x1, coalesce(t.y2 + gy, py1) AS y1, coalesce(r.x1 - gx, px2) AS x2, coalesce(b.y1 - gy, py2) AS y2
    FROM n JOIN g ON n.page_id = g.page_id JOIN h ON n.page_id = h.page_id LEFT JOIN lf l ON l.line_id = n.left_id LEFT JOIN lf r ON r.line_id = n.right_id
    LEFT JOIN lf t ON t.line_id = n.top_id LEFT JOIN lf b ON b.line_id = n.bottom_id""",
)
def box_expand(spark, sf_dir):
    return X.box_expand(_lines(spark, sf_dir))


@_add(
    "row_groups",
    """WITH a AS (SELECT *, max(y2) OVER (PARTITION BY page_id ORDER BY y1, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lines_fx),
    g AS (SELECT *, sum(CASE WHEN y1 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y1, line_id) AS row FROM a)
    SELECT page_id, line_id, CAST(row AS BIGINT) AS row, CAST(row_number() OVER (PARTITION BY page_id, row ORDER BY x1 - y1 DESC, line_id) AS INT) AS ord FROM g""",
)
def row_groups(spark, sf_dir):
    return X.row_groups(_lines(spark, sf_dir))


@_add(
    "reading_order",
    """WITH c AS (SELECT page_id, line_id, x1 + x2 AS x, y1 + y2 AS y FROM lines_fx),
    v AS (SELECT *, (count(*) OVER p * sum(CAST(x AS BIGINT) * x) OVER p - (sum(CAST(x AS BIGINT)) OVER p) ** 2) > (count(*) OVER p * sum(CAST(y AS BIGINT) * y) OVER p - (sum(CAST(y AS BIGINT)) OVER p) ** 2) AS by_x FROM c WINDOW p AS (PARTITION BY page_id)),
    m AS (SELECT page_id, line_id, by_x, CASE WHEN by_x THEN -x ELSE y END AS main, CASE WHEN by_x THEN y ELSE -x END AS side FROM v),
    j AS (SELECT *, main - lag(main) OVER (PARTITION BY page_id ORDER BY main, line_id) > CASE WHEN by_x THEN 40 ELSE 30 END AS jump FROM m),
    g AS (SELECT *, sum(CAST(coalesce(jump, false) AS INT)) OVER (PARTITION BY page_id ORDER BY main, line_id) AS g FROM j)
    SELECT page_id, line_id, row_number() OVER (PARTITION BY page_id ORDER BY g, side, line_id) AS ord FROM g""",
)
def reading_order(spark, sf_dir):
    return X.reading_order(_lines(spark, sf_dir))


@_add(
    "reading_order_panels",
    """WITH o AS (SELECT page_id, line_id, panel_id FROM (SELECT l.page_id, l.line_id, p.panel_id, row_number() OVER (PARTITION BY l.line_id ORDER BY
         CASE WHEN l.x1 + l.x2 BETWEEN 2 * p.x1 AND 2 * p.x2 AND l.y1 + l.y2 BETWEEN 2 * p.y1 AND 2 * p.y2 THEN 0 ELSE 1 END,
         CASE WHEN l.x1 + l.x2 BETWEEN 2 * p.x1 AND 2 * p.x2 AND l.y1 + l.y2 BETWEEN 2 * p.y1 AND 2 * p.y2 THEN 0
              ELSE CAST(greatest(0, 2 * p.x1 - l.x1 - l.x2, l.x1 + l.x2 - 2 * p.x2) AS BIGINT) ** 2 + CAST(greatest(0, 2 * p.y1 - l.y1 - l.y2, l.y1 + l.y2 - 2 * p.y2) AS BIGINT) ** 2 END, p.panel_id) AS n
       FROM lines_fx l JOIN panels_fx p ON l.page_id = p.page_id) q WHERE n = 1),
    c AS (SELECT l.page_id, panel_id, l.line_id, x1 + x2 AS x, y1 + y2 AS y FROM lines_fx l JOIN o ON l.page_id = o.page_id AND l.line_id = o.line_id),
    v AS (SELECT *, (count(*) OVER p * sum(CAST(x AS BIGINT) * x) OVER p - (sum(CAST(x AS BIGINT)) OVER p) ** 2) > (count(*) OVER p * sum(CAST(y AS BIGINT) * y) OVER p - (sum(CAST(y AS BIGINT)) OVER p) ** 2) AS by_x FROM c WINDOW p AS (PARTITION BY page_id, panel_id)),
    m AS (SELECT page_id, panel_id, line_id, by_x, CASE WHEN by_x THEN -x ELSE y END AS main, CASE WHEN by_x THEN y ELSE -x END AS side FROM v),
    j AS (SELECT *, main - lag(main) OVER (PARTITION BY page_id, panel_id ORDER BY main, line_id) > CASE WHEN by_x THEN 40 ELSE 30 END AS jump FROM m),
    g AS (SELECT *, sum(CAST(coalesce(jump, false) AS INT)) OVER (PARTITION BY page_id, panel_id ORDER BY main, line_id) AS g FROM j)
    SELECT page_id, line_id, row_number() OVER (PARTITION BY page_id ORDER BY panel_id, g, side, line_id) AS ord FROM g""",
    "lines_fx", "panels_fx",
)
def reading_order_panels(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return X.reading_order(lines.join(shuffled(X.panel_assign(lines, _panels(spark, sf_dir))), ["page_id", "line_id"]), panel="panel_id")


_SIMPLE = """WITH RECURSIVE p AS (SELECT page_id, list({'cy': cy, 'id': line_id, 'cx': cx, 'a': y1, 'b': y2} ORDER BY cy, line_id) AS boxes
      FROM (SELECT *, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy FROM lines_fx) q GROUP BY page_id),
    r AS (SELECT page_id, boxes, 1 AS i, boxes[1:1] AS placed FROM p
          UNION ALL SELECT page_id, boxes, i + 1, CASE WHEN pos IS NULL THEN placed || [boxes[i + 1]] ELSE placed[1:pos - 1] || [boxes[i + 1]] || placed[pos:] END
          FROM (SELECT *, nullif(list_position([boxes[i + 1].cy <= o.b AND (boxes[i + 1].cy < o.a OR boxes[i + 1].cx > o.cx) FOR o IN placed], true), 0) AS pos FROM r WHERE i < len(boxes)) s)
    SELECT page_id, placed[k].id AS line_id, k AS ord FROM (SELECT page_id, placed, CAST(unnest(range(1, len(placed) + 1)) AS INT) AS k FROM r WHERE i = len(boxes)) t"""


@_add("simple_order", None)
def simple_order(spark, sf_dir):
    return R.simple_order(_lines(spark, sf_dir))


QUERIES["simple_order"] = (simple_order, sql_with("lines_fx", _SIMPLE).replace("WITH lines_fx", "WITH RECURSIVE lines_fx").replace(", RECURSIVE p AS", ", p AS"))


@_add(
    "panel_order",
    """WITH RECURSIVE t AS (SELECT *, greatest(10.0, 0.3 * avg(y2 - y1) OVER (PARTITION BY page_id)) AS tol FROM panels_fx),
    r AS (SELECT page_id, min(y1) AS base, 1 AS row FROM t GROUP BY page_id
          UNION ALL SELECT page_id, nxt, row + 1 FROM (SELECT r.page_id, r.row, (SELECT min(t.y1) FROM t WHERE t.page_id = r.page_id AND t.y1 - r.base > t.tol) AS nxt FROM r) q WHERE nxt IS NOT NULL)
    SELECT page_id, panel_id, row_number() OVER (PARTITION BY page_id ORDER BY row, -x1, y1, panel_id) AS ord
    FROM (SELECT t.page_id, t.panel_id, t.x1, t.y1, (SELECT max(row) FROM r WHERE r.page_id = t.page_id AND r.base <= t.y1) AS row FROM t) z""",
    "lines_fx", "panels_fx",
)
def panel_order(spark, sf_dir):
    return X.panel_order(_panels(spark, sf_dir))


QUERIES["panel_order"] = (panel_order, QUERIES["panel_order"][1].replace("WITH lines_fx", "WITH RECURSIVE lines_fx").replace(", RECURSIVE t AS", ", t AS"))


@_add(
    "small_group",
    None,
)
def small_group(spark, sf_dir):
    return X.small_group(_lines(spark, sf_dir), 23, 95)


_SMALL = """WITH RECURSIVE f AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h, x1 + x2 AS cx, y1 + y2 AS cy FROM lines_fx), s AS (SELECT * FROM f WHERE w < 23 OR h < 95),
    e AS (SELECT a.line_id AS u, c.line_id AS v FROM s a JOIN s c ON a.page_id = c.page_id AND a.line_id <> c.line_id AND 2 * abs(a.cx - c.cx) <= 3 * (a.w + c.w) AND 2 * abs(a.cy - c.cy) <= 3 * (a.h + c.h)),
    r AS (SELECT line_id AS node, line_id AS seen FROM lines_fx UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u),
    m AS (SELECT node, min(seen) AS box_id FROM r GROUP BY node)
    SELECT page_id, box_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM lines_fx JOIN m ON line_id = node GROUP BY page_id, box_id"""
QUERIES["small_group"] = (small_group, sql_with("lines_fx", _SMALL).replace("WITH lines_fx", "WITH RECURSIVE lines_fx").replace(", RECURSIVE f AS", ", f AS"))


_NMS = """WITH RECURSIVE r AS (SELECT page_id, line_id, x1, y1, x2 + 25 AS x2, y2, prob, line_id % 2 AS kind, row_number() OVER (PARTITION BY page_id ORDER BY prob DESC, line_id) AS n FROM lines_fx),
    s AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(x1 INT, y1 INT, x2 INT, y2 INT, kind BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS line_id, false AS stays FROM r
          UNION ALL
          SELECT page_id, n, CASE WHEN stays THEN list_append(held, {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'kind': kind}) ELSE held END, line_id, stays
          FROM (SELECT r.*, s.held, len([b for b in s.held if b.kind = r.kind AND greatest(least(b.x2, r.x2) - greatest(b.x1, r.x1), 0) * greatest(least(b.y2, r.y2) - greatest(b.y1, r.y1), 0)
                  > 0.3 * ((b.x2 - b.x1) * (b.y2 - b.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - greatest(least(b.x2, r.x2) - greatest(b.x1, r.x1), 0) * greatest(least(b.y2, r.y2) - greatest(b.y1, r.y1), 0))]) = 0 AS stays
                FROM s JOIN r ON r.page_id = s.page_id AND r.n = s.n + 1) q)
    SELECT r.page_id, r.line_id, x1, y1, CAST(x2 AS INT) AS x2, y2, prob, kind FROM s JOIN r ON r.line_id = s.line_id WHERE stays QUALIFY row_number() OVER (PARTITION BY r.page_id ORDER BY prob DESC, r.line_id) <= 14"""


@_add("nms", _NMS)
def nms(spark, sf_dir):
    """Two kinds of boxes on a page, widened so that neighbours overlap; at most 14 stay."""
    wide = _lines(spark, sf_dir).withColumn("x2", F.col("x2") + 25).withColumn("kind", F.col("line_id") % 2).select("page_id", "line_id", *X.EDGES, "prob", "kind")
    return X.nms(wide, 0.3, "prob", "kind", 14)


@_add("iou_pairs", f"""WITH d AS (SELECT page_id, line_id, x1 + 4 AS x1, y1 + 3 AS y1, x2 + 4 AS x2, y2 + 3 AS y2 FROM lines_fx WHERE line_id % 7 <> 0)
    SELECT l.page_id, l.line_id AS truth, d.line_id AS found, round({_common('l', 'd')} * 1.0 / ({_area('l')} + {_area('d')} - {_common('l', 'd')}), 6) AS iou FROM lines_fx l JOIN d ON l.page_id = d.page_id
    WHERE {_common('l', 'd')} * 1.0 / ({_area('l')} + {_area('d')} - {_common('l', 'd')}) > 0.5""")  # fmt: skip
def iou_pairs(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return R.iou_pairs(lines, R.shifted(lines.where("line_id % 7 <> 0"), 4, 3)).withColumn("iou", F.round("iou", 6))


_EVAL = f"""WITH RECURSIVE d AS (SELECT page_id, line_id, x1 + 4 AS x1, y1 + 3 AS y1, x2 + 20 AS x2, y2 + 3 AS y2 FROM lines_fx WHERE line_id % 7 <> 0
        UNION ALL SELECT page_id, line_id + 1000000000, x1 - 5, y1, x2 + 4, y2 + 5 FROM lines_fx WHERE line_id % 5 <> 0),
    p AS (SELECT l.page_id, l.line_id AS t, d.line_id AS f, row_number() OVER (PARTITION BY l.page_id ORDER BY l.line_id, d.line_id) AS n FROM lines_fx l JOIN d ON l.page_id = d.page_id
          WHERE {_common('l', 'd')} * 1.0 / ({_area('l')} + {_area('d')} - {_common('l', 'd')}) > 0.4),
    s AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS ts, CAST([] AS BIGINT[]) AS fs FROM p
          UNION ALL
          SELECT s.page_id, p.n, CASE WHEN list_contains(ts, t) OR list_contains(fs, f) THEN ts ELSE list_append(ts, t) END, CASE WHEN list_contains(ts, t) OR list_contains(fs, f) THEN fs ELSE list_append(fs, f) END
          FROM s JOIN p ON p.page_id = s.page_id AND p.n = s.n + 1),
    m AS (SELECT page_id, CAST(max(len(ts)) AS BIGINT) AS matched FROM s GROUP BY page_id),
    c AS (SELECT page_id, count(*) AS n_truth FROM lines_fx GROUP BY page_id), e AS (SELECT page_id, count(*) AS n_found FROM d GROUP BY page_id),
    j AS (SELECT page_id, n_truth, coalesce(n_found, 0) AS n_found, coalesce(matched, 0) AS matched FROM c LEFT JOIN e USING (page_id) LEFT JOIN m USING (page_id)),
    a AS (SELECT * FROM j UNION ALL SELECT NULL, CAST(sum(n_truth) AS BIGINT), CAST(sum(n_found) AS BIGINT), CAST(sum(matched) AS BIGINT) FROM j),
    r AS (SELECT *, CASE WHEN n_found > 0 THEN matched * 1.0 / n_found ELSE 0 END AS p, matched * 1.0 / n_truth AS q FROM a)
    SELECT page_id, n_truth, n_found, matched, round(p, 9) AS precision, round(q, 9) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 9) AS hmean FROM r"""


@_add("detection_eval", _EVAL)
def detection_eval(spark, sf_dir):
    """Two detections near each line, some left out, so that greedy matches wait for one another."""
    lines = _lines(spark, sf_dir)
    one = R.shifted(lines.where("line_id % 7 <> 0"), 4, 3).withColumn("x2", F.col("x2") + 16)
    two = lines.where("line_id % 5 <> 0").withColumns({"line_id": F.col("line_id") + 1_000_000_000, "x1": F.col("x1") - 5, "x2": F.col("x2") + 4, "y2": F.col("y2") + 5})
    out = R.detection_eval(lines, one.unionByName(two), 0.4)
    return out.select("page_id", "n_truth", "n_found", "matched", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "hmean")])


@_add("region_aggregate", None)
def region_aggregate(spark, sf_dir):
    return R.region_aggregate(_regions(spark, sf_dir)).withColumn("prob", F.round("prob", 6))


QUERIES["region_aggregate"] = (
    region_aggregate,
    _over_regions("""SELECT page_id, region_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, min(least(x2 - x1, y2 - y1)) AS font, CAST(0 AS DOUBLE) AS angle,
        round(exp(sum(ln(prob) * ((x2 - x1) * (y2 - y1))) / any_value(total)), 6) AS prob
        FROM (SELECT *, sum((x2 - x1) * (y2 - y1)) OVER (PARTITION BY page_id) AS total FROM g) q GROUP BY page_id, region_id"""),
)


@_add("direction_vote", None)
def direction_vote(spark, sf_dir):
    """Directions made up from the line number."""
    return R.direction_vote(_regions(spark, sf_dir).withColumn("direction", F.when((F.col("line_id") * 7) % 3 > 0, "v").otherwise("h")))


QUERIES["direction_vote"] = (
    direction_vote,
    _over_regions("""SELECT page_id, region_id, CASE WHEN v > h THEN 'v' WHEN h > v THEN 'h' WHEN vc > hc THEN 'v' WHEN hc > vc THEN 'h' ELSE strongest END AS direction
        FROM (SELECT page_id, region_id, count(*) FILTER (d = 'v') AS v, count(*) FILTER (d = 'h') AS h, coalesce(sum(c) FILTER (d = 'v'), 0) AS vc, coalesce(sum(c) FILTER (d = 'h'), 0) AS hc,
              max_by(d, shape * 1000000.0 - line_id / 1000000.0) AS strongest
              FROM (SELECT *, CASE WHEN (line_id * 7) % 3 > 0 THEN 'v' ELSE 'h' END AS d, length(replace(text, ' ', '')) AS c, greatest((x2 - x1) * 1.0 / (y2 - y1), (y2 - y1) * 1.0 / (x2 - x1)) AS shape FROM g) q GROUP BY page_id, region_id) z"""),
)


@_add("dominant_color", None)
def dominant_color(spark, sf_dir):
    return R.dominant_color(_regions(spark, sf_dir))


@_add("component_split", None)
def component_split(spark, sf_dir):
    return R.component_split(_regions(spark, sf_dir))


@_add("line_order", None)
def line_order(spark, sf_dir):
    return X.line_order(_regions(spark, sf_dir), "region_id")


QUERIES["line_order"] = (line_order, _over_regions("SELECT page_id, line_id, row_number() OVER (PARTITION BY page_id, region_id ORDER BY CASE WHEN y2 - y1 >= x2 - x1 THEN -(x1 + x2) ELSE y1 + y2 END, line_id) AS ord FROM g"))


@_add(
    "color_saturate",
    """SELECT line_id, CAST(least(greatest(round_even(g + 1.47 * (fg_r - g), 0), 0), 255) AS INT) AS r, CAST(least(greatest(round_even(g + 1.47 * (fg_g - g), 0), 0), 255) AS INT) AS gr, CAST(least(greatest(round_even(g + 1.47 * (fg_b - g), 0), 0), 255) AS INT) AS b
       FROM (SELECT *, CAST(0.213 AS DOUBLE) * fg_r + CAST(0.715 AS DOUBLE) * fg_g + CAST(0.072 AS DOUBLE) * fg_b AS g FROM lines_fx) q""",
)
def color_saturate(spark, sf_dir):
    r, g, b = R.saturate(F.col("fg_r"), F.col("fg_g"), F.col("fg_b"))
    return _lines(spark, sf_dir).select("line_id", r.alias("r"), g.alias("gr"), b.alias("b"))


def _blend(end: int) -> str:
    """Whether (a, b, c) is a blend of the fill (f, g, h) with an end."""
    along = f"((a - f) * ({end} - f) + (b - g) * ({end} - g) + (c - h) * ({end} - h)) * 1.0 / nullif(({end} - f) ** 2 + ({end} - g) ** 2 + ({end} - h) ** 2, 0)"
    off = ", ".join(f"abs({o} - ({i} + {along} * ({end} - {i})))" for o, i in zip("abc", "fgh"))
    far = f"greatest(abs({end} - f), abs({end} - g), abs({end} - h)) >= greatest(abs(a - f), abs(b - g), abs(c - h)) + 20"
    return f"({along} > 0.10 AND {along} < 0.90 AND greatest({off}) <= 18 AND {far})"


@_add(
    "outline_resolve",
    f"""WITH o AS (SELECT line_id, CAST(fg_r AS DOUBLE) AS f, CAST(fg_g AS DOUBLE) AS g, CAST(fg_b AS DOUBLE) AS h, CAST(fg_b AS DOUBLE) AS a, CAST(255 - fg_r AS DOUBLE) AS b, CAST(fg_g AS DOUBLE) AS c FROM lines_fx),
    s AS (SELECT *, CASE WHEN least(a, b, c) >= 225 AND greatest(a, b, c) - least(a, b, c) <= 32 THEN 255 WHEN greatest(a, b, c) <= 30 AND greatest(a, b, c) - least(a, b, c) <= 20 THEN 0
            WHEN {_blend(255)} THEN 255 WHEN {_blend(0)} THEN 0 END AS v FROM o)
    SELECT line_id, CAST(coalesce(v, a) AS INT) AS r, CAST(coalesce(v, b) AS INT) AS g, CAST(coalesce(v, c) AS INT) AS b FROM s""",
)
def outline_resolve(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    out = R.outline_resolve([F.col(c) for c in ("fg_r", "fg_g", "fg_b")], [F.col("fg_b"), 255 - F.col("fg_r"), F.col("fg_g")])
    return lines.select("line_id", out.alias("outline")).select("line_id", "outline.*")


@_add("color_clusters", None)
def color_clusters(spark, sf_dir):
    return R.color_clusters(_lines(spark, sf_dir), 40)


_CLUSTER = """WITH RECURSIVE e AS (SELECT a.line_id AS u, b.line_id AS v FROM lines_fx a JOIN lines_fx b ON a.page_id = b.page_id AND a.line_id <> b.line_id
      AND greatest(abs(a.fg_r - b.fg_r), abs(a.fg_g - b.fg_g), abs(a.fg_b - b.fg_b)) <= 40),
    r AS (SELECT line_id AS node, line_id AS seen FROM lines_fx UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u),
    m AS (SELECT node, min(seen) AS cluster FROM r GROUP BY node)
    SELECT l.page_id, l.line_id, m.cluster, CASE WHEN max(chroma) OVER k >= 30 THEN first_value(l.line_id) OVER (PARTITION BY m.cluster ORDER BY chroma DESC, l.line_id)
      WHEN avg(luma) OVER k < 128 THEN first_value(l.line_id) OVER (PARTITION BY m.cluster ORDER BY luma, l.line_id) ELSE first_value(l.line_id) OVER (PARTITION BY m.cluster ORDER BY luma DESC, l.line_id) END AS representative
    FROM (SELECT *, greatest(fg_r, fg_g, fg_b) - least(fg_r, fg_g, fg_b) AS chroma, CAST(0.299 AS DOUBLE) * fg_r + CAST(0.587 AS DOUBLE) * fg_g + CAST(0.114 AS DOUBLE) * fg_b AS luma FROM lines_fx) l JOIN m ON l.line_id = m.node WINDOW k AS (PARTITION BY m.cluster)"""
QUERIES["color_clusters"] = (color_clusters, sql_with("lines_fx", _CLUSTER).replace("WITH lines_fx", "WITH RECURSIVE lines_fx").replace(", RECURSIVE e AS", ", e AS"))


@_add(
    "outline_consensus",
    """WITH c AS (SELECT *, fg_r > 150 AND fg_g < 140 AS pink, fg_b > 120 AS white FROM lines_fx),
    n AS (SELECT *, count(*) FILTER (pink) OVER p AS pinks, count(*) FILTER (pink AND white) OVER p AS whites FROM c WINDOW p AS (PARTITION BY page_id))
    SELECT line_id, CASE WHEN pink AND pinks >= 2 AND whites >= 2 AND whites * 10 >= pinks * 6 THEN true ELSE white END AS white FROM n""",
)
def outline_consensus(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("pink", (F.col("fg_r") > 150) & (F.col("fg_g") < 140)).withColumn("white", F.col("fg_b") > 120)
    return R.outline_consensus(lines).select("line_id", "white")


@_add(
    "modal_color",
    """WITH z AS (SELECT page_id * 3 + line_id % 3 AS zone, fg_r, fg_g, fg_b, greatest(abs(fg_r - 10), abs(fg_g - 10), abs(fg_b - 10)) >= 30 AS far FROM lines_fx),
    s AS (SELECT zone, count(*) AS size, count(*) FILTER (far) AS away FROM z GROUP BY zone),
    b AS (SELECT zone, fg_r // 24 AS br, fg_g // 24 AS bg, fg_b // 24 AS bb, count(*) AS n, quantile_cont(fg_r, 0.5) AS r, quantile_cont(fg_g, 0.5) AS g, quantile_cont(fg_b, 0.5) AS b FROM z WHERE far GROUP BY 1, 2, 3, 4),
    m AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY n DESC, br, bg, bb) AS k FROM b)
    SELECT s.zone, CAST(round_even(r, 0) AS INT) AS r, CAST(round_even(g, 0) AS INT) AS g, CAST(round_even(m.b, 0) AS INT) AS b, coalesce(round(n * 1.0 / size, 6), 0) AS share
    FROM s LEFT JOIN m ON s.zone = m.zone AND m.k = 1 AND s.away >= 8""",
)
def modal_color(spark, sf_dir):
    """Three zones a page: the most frequent colour bucket away from a reference colour, and its share; none in zones with few such lines."""
    lines = _lines(spark, sf_dir).withColumn("zone", F.col("page_id") * 3 + F.col("line_id") % 3)
    return R.modal_color(lines.select("zone", "fg_r", "fg_g", "fg_b"), "zone", (10, 10, 10))


@_add(
    "char_color_mean",
    """SELECT page_id, round(avg(fg_r) FILTER (line_id % 2 = 0), 6) AS r, round(coalesce(avg(fg_b) FILTER (line_id % 3 = 0), avg(fg_r) FILTER (line_id % 2 = 0)), 6) AS bg, round(exp(avg(ln(prob))), 6) AS prob FROM lines_fx GROUP BY page_id""",
)
def char_color_mean(spark, sf_dir):
    """Mean colour of flagged rows, the background falling back to the foreground; geometric mean of the probability."""
    fg = F.avg(F.when(F.col("line_id") % 2 == 0, F.col("fg_r")))
    bg = F.coalesce(F.avg(F.when(F.col("line_id") % 3 == 0, F.col("fg_b"))), fg)
    return _lines(spark, sf_dir).groupBy("page_id").agg(F.round(fg, 6).alias("r"), F.round(bg, 6).alias("bg"), F.round(F.exp(F.avg(F.log("prob"))), 6).alias("prob"))


@_add(
    "normalize_box",
    """SELECT line_id, round(x1 / 1000.0, 6) AS x, round(y1 / 3000.0, 6) AS y, round((x2 - x1) / 1000.0, 6) AS w, round((y2 - y1) / 3000.0, 6) AS h,
       round(greatest(least(x1, x1 - 6), 0) / 1000.0, 6) AS region_x, round(least(greatest(x2, x2 + 6), 1000) / 1000.0, 6) AS region_x2 FROM lines_fx""",
)
def normalize_box(spark, sf_dir):
    x1, y1, x2, y2 = (F.col(e) for e in X.EDGES)
    r = lambda c: F.round(c, 6)
    return _lines(spark, sf_dir).select(
        "line_id", r(x1 / 1000.0).alias("x"), r(y1 / 3000.0).alias("y"), r((x2 - x1) / 1000.0).alias("w"), r((y2 - y1) / 3000.0).alias("h"),
        r(F.greatest(F.least(x1, x1 - 6), F.lit(0)) / 1000.0).alias("region_x"), r(F.least(F.greatest(x2, x2 + 6), F.lit(1000)) / 1000.0).alias("region_x2"),
    )


@_add(
    "orientation",
    """SELECT page_id, max_by(CASE WHEN y2 - y1 >= x2 - x1 THEN 'v' ELSE 'h' END, CAST(x2 - x1 AS BIGINT) * (y2 - y1) * 100000000 + line_id) AS direction,
       CASE WHEN count(*) = 1 THEN 'center' WHEN max_by(CASE WHEN y2 - y1 >= x2 - x1 THEN 'v' ELSE 'h' END, CAST(x2 - x1 AS BIGINT) * (y2 - y1) * 100000000 + line_id) = 'h' THEN 'center' ELSE 'left' END AS alignment FROM lines_fx GROUP BY page_id""",
)
def orientation(spark, sf_dir):
    """Direction of the largest line of a region; alignment by direction, a single line being centred."""
    f = X.features(_lines(spark, sf_dir))
    d = F.max_by("direction", F.struct("area", "line_id"))
    return f.groupBy("page_id").agg(d.alias("direction"), F.when((F.count("*") == 1) | (d == "h"), "center").otherwise("left").alias("alignment"))


@_add("region_orientation", None)
def region_orientation(spark, sf_dir):
    """Regions of pages with languages, and with a direction or an alignment given for some; all made up from the page's number."""
    kind = F.col("page_id") % 6
    lines = _regions(spark, sf_dir).withColumn("language", F.when(kind == 0, "ENG").when(kind == 1, "ARA").when(kind == 2, "JPN").when(kind == 3, "XXX"))
    lines = lines.withColumns({"given": F.when(kind == 4, "vr").when(kind == 5, "auto"), "align": F.when(F.col("page_id") % 5 == 0, "right")})
    return R.orientation(lines, "language", "given", "align")


QUERIES["region_orientation"] = (
    region_orientation,
    _over_regions("""SELECT page_id, region_id, direction, CASE WHEN page_id % 5 = 0 THEN 'right' WHEN n = 1 OR direction = 'h' THEN 'center' WHEN direction = 'hr' THEN 'right' ELSE 'left' END AS alignment
        FROM (SELECT page_id, region_id, count(*) AS n, CASE page_id % 6 WHEN 0 THEN 'h' WHEN 1 THEN 'hr' WHEN 4 THEN 'vr'
                ELSE CASE WHEN max_by(x2 - x1 < y2 - y1, CAST(x2 - x1 AS BIGINT) * (y2 - y1) * 100000000 - line_id) THEN 'v' ELSE 'h' END END AS direction
              FROM g GROUP BY page_id, region_id) q"""),
)


def _turned(spark, sf_dir):
    """The boxes of two pages in three turned: the upper side moved to the right by a sixth (or a hundredth) of the height, the right side down to match."""
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    lean = F.floor(h / F.when(F.col("page_id") % 3 == 0, 6).when(F.col("page_id") % 3 == 1, 100).otherwise(1000000)).cast("int")
    sink = F.floor(w * lean / h).cast("int")
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    x1, y1, x2, y2 = (F.col(e) for e in X.EDGES)
    pts = F.array(at(x1 + lean, y1), at(x2 + lean, y1 + sink), at(x2, y2 + sink), at(x1, y2))
    return X.with_edges(_lines(spark, sf_dir).select("page_id", "line_id", "prob", pts.alias("pts")))


@_add("turned_features", None)
def turned_features(spark, sf_dir):
    f = X.features(_turned(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return f.select("line_id", "w", "h", r("font"), r("aspect"), "cx2", "cy2", "area", "direction", r("angle"), "upright")


_QUADS = """k AS (SELECT *, CAST(CASE page_id % 3 WHEN 0 THEN (y2 - y1) // 6 WHEN 1 THEN (y2 - y1) // 100 ELSE 0 END AS INT) AS lean FROM lines_fx),
    c AS (SELECT line_id, x1 + lean AS ax, y1 AS ay, x2 + lean AS bx, y1 + (x2 - x1) * lean // (y2 - y1) AS by_, x2 AS cx, y2 + (x2 - x1) * lean // (y2 - y1) AS cy, x1 AS dx, y2 AS dy FROM k),
    m AS (SELECT *, (cx + dx) // 2 - (ax + bx) // 2 AS vx, (cy + dy) // 2 - (ay + by_) // 2 AS vy, (dx + ax) // 2 - (bx + cx) // 2 AS ux, (dy + ay) // 2 - (by_ + cy) // 2 AS uy FROM c),
    q AS (SELECT *, sqrt(CAST(vx * vx + vy * vy AS DOUBLE)) AS down, sqrt(CAST(ux * ux + uy * uy AS DOUBLE)) AS across FROM m)
    SELECT line_id, greatest(ax, bx, cx, dx) - least(ax, bx, cx, dx) AS w, greatest(ay, by_, cy, dy) - least(ay, by_, cy, dy) AS h, round(least(down, across), 6) AS font, round(across / down, 6) AS aspect,
      (ax + bx + cx + dx) / 2.0 AS cx2, (ay + by_ + cy + dy) / 2.0 AS cy2, abs(ax * by_ - bx * ay + bx * cy - cx * by_ + cx * dy - dx * cy + dx * ay - ax * dy) / 2.0 AS area,
      CASE WHEN (CASE WHEN down >= across THEN abs(vx) ELSE abs(ux) END) <= (CASE WHEN down >= across THEN abs(vy) ELSE abs(uy) END) THEN 'v' ELSE 'h' END AS direction,
      round(acos(vx / down), 6) AS angle, least(abs(vx) / down, abs(vy) / down, abs(ux) / across, abs(uy) / across) < 0.05 AS upright FROM q"""
QUERIES["turned_features"] = (turned_features, sql_with("lines_fx", "WITH " + _QUADS))


@_add("turned_groups", None)
def turned_groups(spark, sf_dir):
    """Leant lines grouped, and the groups split."""
    lines = _turned(spark, sf_dir)
    comp = X.components(lines, X.merge_edges(lines)).withColumnRenamed("component", "region_id")
    return R.component_split(lines.join(comp, ["page_id", "line_id"]))


@_add(
    "size_sorted_chunks",
    """SELECT page_id, line_id, chunk, CAST(4 * ((max(w) OVER (PARTITION BY page_id, chunk) + 7) // 4) AS BIGINT) AS padded
       FROM (SELECT page_id, line_id, x2 - x1 AS w, CAST((row_number() OVER (PARTITION BY page_id ORDER BY x2 - x1, line_id) - 1) // 16 AS BIGINT) AS chunk FROM lines_fx) q""",
)
def size_sorted_chunks(spark, sf_dir):
    return X.size_sorted_chunks(_lines(spark, sf_dir), 16)


@_docs("tile_plan", """SELECT doc_id, CAST(tile AS INT) AS tile, tile * step AS start, least(tile * step + 500, n) AS stop FROM (SELECT doc_id, n, CASE WHEN k > 1 THEN (n - 500) // (k - 1) ELSE 0 END AS step, unnest(generate_series(0, k - 1)) AS tile
      FROM (SELECT doc_id, length(text) AS n, (length(text) + 499) // 500 AS k FROM documents WHERE length(text) > 0) a) b""")  # fmt: skip
def tile_plan(spark, sf_dir):
    return X.tile_plan(table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n")), "doc_id", "n", 500)


@_add("tile_stitch", """WITH t AS (SELECT page_id, line_id, unnest(generate_series(x1 // 10, x2 // 10)) AS pos, prob FROM lines_fx) SELECT page_id, CAST(pos AS BIGINT) AS pos, round(avg(prob), 6) AS value FROM t GROUP BY page_id, pos""")
def tile_stitch(spark, sf_dir):
    span = F.explode(F.sequence(F.floor(F.col("x1") / 10), F.floor(F.col("x2") / 10)))
    v = _lines(spark, sf_dir).select("page_id", span.alias("pos"), F.col("prob").alias("value"))
    return X.tile_stitch(v, "page_id").withColumn("value", F.round("value", 6))




@_docs("sequence_collapse", """WITH c AS (SELECT doc_id, string_split(text, '') AS a FROM documents WHERE text <> ''), s AS (SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) AS i FROM c),
    k AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM s) SELECT doc_id, string_agg(s, '' ORDER BY i) AS collapsed FROM k WHERE (b IS NULL OR s <> b) AND s <> ' ' GROUP BY doc_id
    UNION ALL SELECT doc_id, '' FROM documents WHERE trim(coalesce(text, ''), ' ') = ''""")  # fmt: skip
def sequence_collapse(spark, sf_dir):
    """A text without symbols collapses to an empty one."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", X.text_collapse(F.coalesce("text", F.lit("")), " ").alias("collapsed"))


@_docs("char_accuracy", """WITH p AS (SELECT doc_id, string_split(text, '') AS a, string_split(replace(text, 'e', 'E'), '') AS b FROM documents WHERE text <> ''),
    s AS (SELECT doc_id, unnest(a) AS x, unnest(b) AS y FROM p) SELECT doc_id, round(count(*) FILTER (x = y) * 1.0 / (count(*) + 1), 6) AS ratio FROM s GROUP BY doc_id
    UNION ALL SELECT doc_id, 0.0 FROM documents WHERE coalesce(text, '') = ''""")  # fmt: skip
def char_accuracy(spark, sf_dir):
    """Characters equal by position, over the number of characters of the truth plus one."""
    docs = table(spark, sf_dir, "documents")
    chars = docs.where("text <> ''").select("doc_id", F.explode(F.arrays_zip(F.split("text", "").alias("x"), F.split(F.replace("text", F.lit("e"), F.lit("E")), "").alias("y"))).alias("z"))
    some = chars.groupBy("doc_id").agg(F.round(F.count_if(F.col("z.x") == F.col("z.y")) / (F.count("*") + 1), 6).alias("ratio"))
    return docs.select("doc_id").join(some, "doc_id", "left").select("doc_id", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
