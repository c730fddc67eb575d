"""Regions of lines: evaluation, votes, colours and splitting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import boxes as X
from folio.operators.graph import matched
from folio.storage import materialize


def shifted(boxes: DataFrame, dx: int, dy: int) -> DataFrame:
    return boxes.withColumns({"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + dy, "y2": F.col("y2") + dy})


def component_assign(blobs: DataFrame, lines: DataFrame, cell: int = 256) -> DataFrame:
    """Each blob to the line with the largest common share of the smaller area, over 1 %; else to the line whose centre is nearest,
    if the boxes are no further apart than half of the line's font, width or the blob's height, 10 at least: max(min(font, w, h), 10) / 2.

    Only lines larger than the blob count. Lines that overlap it, and those within the reach that its size
    allows, are found on the grid. The nearest centre of the latter holds unless a line with a nearer one
    lies out of reach, which is looked for within that distance.
    """
    fits = (X.area("l") > 9) & (X.area("l") < X.area("r"))
    share = X.overlap("l", "r") / F.least(X.area("l"), X.area("r"))
    by_blob = (F.col("l.page_id").alias("page_id"), F.col("l.blob_id").alias("blob_id"))
    common = X.grid_pairs(blobs, lines, F.lit(0), cell, "blob_id", "line_id").where(fits & (share > 0.01)).groupBy(*by_blob)
    owned = common.agg(F.max_by("r.line_id", F.struct(share, -F.col("r.line_id"))).alias("line_id"))
    rest = blobs.join(owned.select("page_id", "blob_id"), ["page_id", "blob_id"], "left_anti").select("page_id", "blob_id", *X.EDGES)
    size = lambda side: (X.b(side, "x2") - X.b(side, "x1"), X.b(side, "y2") - X.b(side, "y1"))
    most = 0.5 * F.greatest(F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.lit(10))
    reach = 0.5 * F.greatest(F.least(*size("l"), *size("r")), F.lit(10))
    across, down = (X.b("l", f"{c}1") + X.b("l", f"{c}2") - X.b("r", f"{c}1") - X.b("r", f"{c}2") for c in "xy")
    centres = across.cast("long") * across + down.cast("long") * down  # of twice the coordinates
    within = X.grid_pairs(rest, lines, most, cell, "blob_id", "line_id").where(fits & (X.rect_distance("l", "r") <= reach)).groupBy(*by_blob)
    best = within.agg(F.min(F.struct(centres.alias("d"), F.col("r.line_id").alias("line_id"))).alias("c"))
    best = materialize(rest.join(best, ["page_id", "blob_id"]), "component-best")
    cx, cy, area = F.col("x1") + F.col("x2"), F.col("y1") + F.col("y2"), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    wide = F.ceil(F.sqrt("c.d"))
    asks = best.select("page_id", "blob_id", "c", area.alias("area"), cx.alias("cx"), cy.alias("cy"), (cx - wide).alias("x1"), (cx + wide).alias("x2"), (cy - wide).alias("y1"), (cy + wide).alias("y2"))
    middles = lines.select("page_id", "line_id", area.alias("area"), cx.alias("x1"), cx.alias("x2"), cy.alias("y1"), cy.alias("y2"))
    dx, dy = (F.col("l.cx") - F.col("r.x1")).cast("long"), (F.col("l.cy") - F.col("r.y1")).cast("long")
    nearer = F.struct((dx * dx + dy * dy).alias("d"), F.col("r.line_id").alias("line_id")) < F.col("l.c")
    beaten = X.grid_pairs(asks, middles, F.lit(0), 2 * cell, "blob_id", "line_id").where((F.col("l.area") < F.col("r.area")) & nearer).select(*by_blob).distinct()
    held = best.join(beaten, ["page_id", "blob_id"], "left_anti").select("page_id", "blob_id", F.col("c.line_id").alias("line_id"))
    return owned.union(held)


def iou_pairs(truth: DataFrame, found: DataFrame, least: float = 0.5, cell: int = 256) -> DataFrame:
    pairs = X.grid_pairs(truth, found, F.lit(0), cell, "line_id", "line_id")
    common = X.overlap("l", "r")
    iou = common / (X.area("l") + X.area("r") - common)
    return pairs.where(iou > least).select(F.col("l.page_id").alias("page_id"), F.col("l.line_id").alias("truth"), F.col("r.line_id").alias("found"), iou.alias("iou"))


def detection_eval(truth: DataFrame, found: DataFrame, least: float = 0.5, ignore: str | None = None) -> DataFrame:
    """Per page, and over all (page_id null): greedy one-to-one matches in the order of (truth, found), with precision, recall and their harmonic mean.

    Truth with a true `ignore` column counts for nothing, nor does what was found with more than
    `least` of its area in one such box. A page without truth that counts has a recall of 1, and a
    precision of 1 if nothing that counts was found there.
    """
    if ignore:
        masks = truth.where(F.col(ignore)).select("page_id", "line_id", *X.EDGES)
        hidden = X.grid_pairs(found, masks, F.lit(0), 256, "line_id", "line_id").where(X.overlap("l", "r") > least * X.area("l"))
        hidden = hidden.select(F.col("l.page_id").alias("page_id"), F.col("l.line_id").alias("line_id")).distinct()
        found = found.join(hidden, ["page_id", "line_id"], "left_anti")
        pages = truth.select("page_id").distinct()
        truth = truth.where(~F.coalesce(F.col(ignore), F.lit(False)))
    else:
        pages = truth.select("page_id").distinct()

    pairs = iou_pairs(truth, found, least).select(F.col("page_id").alias("page"), F.col("truth").alias("left"), F.col("found").alias("right"))
    matches = matched(pairs).groupBy(F.col("page").alias("page_id")).agg(F.count("*").alias("matched"))
    count = lambda df, name: df.groupBy("page_id").agg(F.count("*").alias(name))
    pages = pages.union(found.select("page_id")).distinct()
    j = pages.join(count(truth, "n_truth"), "page_id", "left").join(count(found, "n_found"), "page_id", "left").join(matches, "page_id", "left")
    j = j.select("page_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_truth", "n_found", "matched")])
    every = j.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_truth", "n_found", "matched")])
    ratio = lambda a, c: F.when(c > 0, a / c).otherwise(0.0)
    m, t, n = (F.col(c) for c in ("matched", "n_truth", "n_found"))

    def scored(df: DataFrame, recall: Column, precision: Column) -> DataFrame:
        df = df.withColumn("precision", precision).withColumn("recall", recall)
        p, r = F.col("precision"), F.col("recall")
        return df.withColumn("hmean", ratio(2 * p * r, p + r))

    empty = F.when(n > 0, 0.0).otherwise(1.0)
    by_page = scored(j, F.when(t == 0, 1.0).otherwise(ratio(m, t)), F.when(t == 0, empty).otherwise(ratio(m, n)))
    return by_page.unionByName(scored(every.withColumn("page_id", F.lit(None).cast("bigint")), ratio(m, t), ratio(m, n)))


def region_aggregate(lines: DataFrame) -> DataFrame:
    """Bounds, least font size, mean angle in degrees (0 under 3) and the area-weighted log probability over the area of the whole page."""
    f = X.features(lines).withColumn("total", F.sum("area").over(Window.partitionBy("page_id")))
    turn = F.degrees(F.avg("angle")) - 90
    return f.groupBy("page_id", "region_id").agg(
        *[(F.min if e in ("x1", "y1") else F.max)(e).alias(e) for e in X.EDGES],
        F.min("font").cast("int").alias("font"),
        F.when(F.abs(turn) < 3, 0.0).otherwise(turn).alias("angle"),
        F.exp(F.sum(F.log("prob") * F.col("area")) / F.max("total")).alias("prob"),
    )


def direction_vote(lines: DataFrame, direction: str = "direction") -> DataFrame:
    """Majority of the directions of a region's lines (a column of v and h); ties go by characters, then by the strongest shape."""
    f = X.features(lines.withColumn("_vote", F.col(direction)))
    d = F.col("_vote")
    chars, shape = F.length(F.replace("text", F.lit(" "), F.lit(""))), F.greatest("aspect", 1 / F.col("aspect"))
    v, h = F.count_if(d == "v"), F.count_if(d == "h")
    vc, hc = (F.coalesce(F.sum(F.when(d == x, chars)), F.lit(0)) for x in "vh")
    strongest = F.max_by(d, F.struct(shape, -F.col("line_id")))
    vote = F.when(v > h, "v").when(h > v, "h").when(vc > hc, "v").when(hc > vc, "h").otherwise(strongest)
    return f.groupBy("page_id", "region_id").agg(vote.alias("direction"))


def dominant_color(lines: DataFrame, near: int = 10, channels: tuple[str, str, str] = ("fg_r", "fg_g", "fg_b")) -> DataFrame:
    """Colours pooled in line order to the first group within `near` per channel, weighted by area; the heaviest group's first colour.

    Which group a colour joins depends on those before it, so a region is folded as one small array.
    """
    f = X.features(lines)
    color = [F.col(c).alias(x) for c, x in zip(channels, "rgb")]
    rows = f.groupBy("page_id", "region_id").agg(F.sort_array(F.collect_list(F.struct("line_id", *color, F.col("area").cast("long").alias("area")))).alias("rows"))
    group = "struct<r:int,g:int,b:int,weight:bigint>"

    def step(groups: Column, x: Column) -> Column:
        close = lambda g: (F.abs(g["r"] - x["r"]) <= near) & (F.abs(g["g"] - x["g"]) <= near) & (F.abs(g["b"] - x["b"]) <= near)
        first = F.array_position(F.transform(groups, close), True)
        grown = F.transform(groups, lambda g, i: F.struct(g["r"], g["g"], g["b"], (g["weight"] + F.when(i + 1 == first, x["area"]).otherwise(0)).alias("weight")))
        new = F.struct(x["r"].alias("r"), x["g"].alias("g"), x["b"].alias("b"), x["area"].alias("weight"))
        return F.when(first > 0, grown).otherwise(F.concat(groups, F.array(new)))

    folded = rows.select("page_id", "region_id", F.aggregate("rows", F.array().cast(f"array<{group}>"), step).alias("groups"))
    heaviest = F.array_max(F.transform("groups", lambda g, i: F.struct(g["weight"].alias("w"), (-i).alias("i"))))
    best = F.get("groups", -heaviest["i"])
    return folded.select("page_id", "region_id", best.alias("c")).select("page_id", "region_id", "c.r", "c.g", "c.b")


class _Line:
    """A line as the splitting rules see it: corners, middles of the upper and lower side, font size, angle and direction."""

    def __init__(self, r: dict):
        self.pts = [(p["x"], p["y"]) for p in r["quad"]]
        self.top, self.bottom = (tuple(int((self.pts[i][k] + self.pts[j][k]) / 2) for k in (0, 1)) for i, j in ((0, 1), (2, 3)))
        self.font, self.angle, self.direction = float(r["font"]), r["angle"], r["direction"]
        self.centre = tuple(sum(p[k] for p in self.pts) / 4 for k in (0, 1))


def _split(ids: list[int], at: dict[int, _Line]) -> list[list[int]]:
    """Split one group of lines at its longest link while its links are too uneven."""
    if len(ids) == 1:
        return [ids]
    gap = lambda a, c: _span(at[a], at[c])
    if len(ids) == 2:
        a, c = (at[i] for i in ids)
        return [ids] if _span(a, c) < 1.5 * max(a.font, c.font) and abs(a.angle - c.angle) < 0.2 * math.pi else [[ids[0]], [ids[1]]]
    links = _spanning_tree(ids, gap)
    lengths = np.array([d for d, _, _ in links])
    font = float(np.mean([at[i].font for i in ids]))
    _, u, v = links[0]
    a, c = at[u], at[v]
    off = min(abs(x - y) for x, y in zip(a.centre, c.centre))
    even = lengths[0] <= lengths.mean() + 2 * lengths.std() or lengths[0] <= 1.5 * font
    if even and (lengths.std() < max(0.3 * font + 5, 5) or (off < 5 and _touch(a.pts, c.pts))):
        return [ids]
    side, grown = {u}, True
    while grown:
        more = {y for _, x, y in links[1:] if x in side} | {x for _, x, y in links[1:] if y in side}
        grown = not more <= side
        side |= more
    return [g for part in ([i for i in ids if i in side], [i for i in ids if i not in side]) for g in _split(part, at)]


def _hull_area(p: list[tuple]) -> float:
    """Area of the convex hull of four points: the largest that three of them, or all four in some order, enclose."""
    around = lambda *q: abs(sum(q[i - 1][0] * q[i][1] - q[i][0] * q[i - 1][1] for i in range(len(q)))) / 2
    a, b, c, d = p
    return max(around(a, b, c), around(a, b, d), around(a, c, d), around(b, c, d), around(a, b, c, d), around(a, c, b, d), around(a, b, d, c))


def _touch(p: list[tuple], q: list[tuple]) -> bool:
    """Whether two convex polygons have a point in common: no side of either parts them."""
    for one in (p, q):
        for (x, y), (u, v) in zip(one, one[1:] + one[:1]):
            a, c = ([(y - v) * s + (u - x) * t for s, t in r] for r in (p, q))
            if max(a) < min(c) or max(c) < min(a):
                return False
    return True


def _span(a: _Line, c: _Line) -> float:
    """Distance between matching points of two lines: where they start, or on the side (middle, if horizontal) along which they are better aligned."""
    font = max(a.font, c.font) or 1.0
    p, q = a.pts, c.pts
    if a.direction == "h":
        ways = [([p[0], p[3], q[0], q[3]], p[0], q[0]), ([p[2], p[1], q[2], q[1]], p[1], q[1]), ([a.top, a.bottom, c.top, c.bottom], a.top, c.top)]
    else:
        ways = [([p[0], p[1], q[0], q[1]], p[0], q[0]), ([p[2], p[3], q[2], q[3]], p[2], q[2])]
    off = [_hull_area(w[0]) / font for w in ways]
    best = 0
    for i in range(1, len(ways)):
        if off[i] < font / 2 and off[i] < min(off[:i]):
            best = i
    return math.dist(*ways[best][1:])


def _spanning_tree(ids: list[int], gap) -> list[tuple[float, int, int]]:
    """Links of a minimum spanning tree, longest first (Prim's method)."""
    near = {i: (gap(ids[0], i), ids[0]) for i in ids[1:]}
    links = []
    while near:
        i = min(near, key=lambda k: (near[k][0], k))
        d, j = near.pop(i)
        links.append((d, j, i))
        for k in near:
            near[k] = min(near[k], (gap(i, k), i))
    return sorted(links, key=lambda x: (-x[0], x[1], x[2]))


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        page, line, part = [], [], []
        for p, rows in zip(batch.column("page_id").to_pylist(), batch.column("rows").to_pylist()):
            at = {r["line_id"]: _Line(r) for r in rows}
            for g in _split(list(at), at):
                page += [p] * len(g)
                line += g
                part += [min(g)] * len(g)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (page, line, part)], names=["page_id", "line_id", "split_id"])


def component_split(lines: DataFrame) -> DataFrame:
    """(page_id, line_id, split_id): components cut where a link stands out; split_id is the least line of the part.

    Lines may be turned (column pts, see boxes.features). A component is a handful of lines of one
    page, so it is one array; Arrow batches bring many of them to a worker at once.
    """
    f = X.features(lines).withColumn("quad", X.corners(lines))
    grouped = f.groupBy("page_id", "region_id").agg(F.sort_array(F.collect_list(F.struct("line_id", "quad", "font", "angle", "direction"))).alias("rows"))
    alone = grouped.where(F.size("rows") == 1).select("page_id", F.col("rows")[0]["line_id"].alias("line_id"), F.col("rows")[0]["line_id"].alias("split_id"))
    more = grouped.where(F.size("rows") > 1).select("page_id", "rows")
    return alone.union(more.mapInArrow(_split_rows, "page_id bigint, line_id bigint, split_id bigint"))


def simple_order(boxes: DataFrame, right_to_left: bool = True) -> DataFrame:
    """(page_id, line_id, ord): boxes by the height of their centres, each put before the first one placed that it precedes.

    It precedes a box whose lower edge it is not below, if its centre is above that box or, at its height,
    further on against the reading direction. The relation is not transitive, so a page is folded as one array.
    """
    cx, cy = ((F.col(f"{c}1") + F.col(f"{c}2")) / 2 for c in "xy")
    rows = boxes.select("page_id", F.struct(cy.alias("cy"), "line_id", cx.alias("cx"), "y1", "y2").alias("box"))
    pages = rows.groupBy("page_id").agg(F.sort_array(F.collect_list("box")).alias("boxes"))
    kind = "array<struct<cy:double,line_id:bigint,cx:double,y1:int,y2:int>>"

    def place(placed: Column, box: Column) -> Column:
        def precedes(other: Column) -> Column:
            beside = box["cx"] > other["cx"] if right_to_left else box["cx"] < other["cx"]
            return (box["cy"] <= other["y2"]) & ((box["cy"] < other["y1"]) | beside)

        at = F.array_position(F.transform(placed, precedes), True).cast("int")
        return F.when(at > 0, F.array_insert(placed, at, box)).otherwise(F.array_append(placed, box))

    ordered = pages.select("page_id", F.aggregate("boxes", F.array().cast(kind), lambda acc, box: place(acc, box)).alias("placed"))
    return ordered.select("page_id", F.posexplode("placed").alias("at", "box")).select("page_id", "box.line_id", (F.col("at") + 1).alias("ord"))


# Writing direction by target language; languages that are not named, and CHS, CHT and JPN, go by shape.
PRESETS = {
    "CSY": "h", "NLD": "h", "ENG": "h", "FRA": "h", "DEU": "h", "HUN": "h", "ITA": "h", "KOR": "h", "POL": "h", "PTB": "h",
    "ROM": "h", "RUS": "h", "ESP": "h", "TRK": "h", "UKR": "h", "VIN": "h", "ARA": "hr", "FIL": "h",
}


def orientation(lines: DataFrame, language: str | None = None, direction: str | None = None, alignment: str | None = None) -> DataFrame:
    """(page_id, region_id, direction, alignment) of regions, given columns that are constant in a region.

    Direction: the given one (h, v, hr, vr), else that of the language, else by the shape of the
    largest line. Alignment: the given one, else a single line and h are centred, hr is to the right, the rest to the left.
    """
    given = lambda c, values: F.when(F.col(c).isin(*values), F.col(c)) if c else F.lit(None).cast("string")
    known = F.create_map(*[F.lit(x) for kv in PRESETS.items() for x in kv])
    preset = F.element_at(known, F.col(language)) if language else F.lit(None).cast("string")
    rows = X.features(lines).select(
        "page_id", "region_id", "line_id", "area", F.when(F.col("w") < F.col("h"), "v").otherwise("h").alias("shape"),
        F.coalesce(given(direction, ("h", "v", "hr", "vr")), preset).alias("d"), given(alignment, ("left", "center", "right")).alias("a"),
    )
    largest = F.max_by("shape", F.struct("area", -F.col("line_id")))
    regions = rows.groupBy("page_id", "region_id").agg(F.coalesce(F.max("d"), largest).alias("direction"), F.max("a").alias("a"), F.count("*").alias("n"))
    d = F.col("direction")
    by_rule = F.when((F.col("n") == 1) | (d == "h"), "center").when(d == "hr", "right").otherwise("left")
    return regions.select("page_id", "region_id", "direction", F.coalesce("a", by_rule).alias("alignment"))


def saturate(r: Column, g: Column, b: Column, by: float = 1.47) -> tuple[Column, Column, Column]:
    luma = 0.213 * r + 0.715 * g + 0.072 * b
    return tuple(F.least(F.greatest(F.rint(luma + by * (c - luma)), F.lit(0)), F.lit(255)).cast("int") for c in (r, g, b))


def outline_resolve(fill: list[Column], outline: list[Column]) -> Column:
    """Outline struct(r, g, b): near white and near black snap; so does a blend of the fill with white or black that is 20 further from the fill than it."""
    hi, lo = F.greatest(*outline), F.least(*outline)
    white = (lo >= 225) & (hi - lo <= 32)
    black = (hi <= 30) & (hi - lo <= 20)

    def blend(end: int) -> Column:
        span = [F.lit(end) - f for f in fill]
        length = sum((s * s for s in span), F.lit(0))
        along = sum(((o - f) * s for o, f, s in zip(outline, fill, span)), F.lit(0)) / F.when(length >= 1, length)
        residual = F.greatest(*[F.abs(o - (f + along * s)) for f, s, o in zip(fill, span, outline)])
        further = F.greatest(*map(F.abs, span)) >= F.greatest(*[F.abs(o - f) for f, o in zip(fill, outline)]) + 20
        return F.coalesce((along > 0.10) & (along < 0.90) & (residual <= 18) & further, F.lit(False))

    to = lambda v: F.struct(F.lit(v).alias("r"), F.lit(v).alias("g"), F.lit(v).alias("b"))
    kept = F.struct(outline[0].cast("int").alias("r"), outline[1].cast("int").alias("g"), outline[2].cast("int").alias("b"))
    return F.when(white, to(255)).when(black, to(0)).when(blend(255), to(255)).when(blend(0), to(0)).otherwise(kept)


def color_clusters(lines: DataFrame, near: int) -> DataFrame:
    """(page_id, line_id, cluster, representative): transitive groups of close colours of a page and their most chromatic line; of groups without a chroma of 30 the darkest, or the brightest if the mean luma is 128 or more."""
    far = F.greatest(*[F.abs(X.b("a", c) - X.b("c", c)) for c in ("fg_r", "fg_g", "fg_b")])
    same = (F.col("a.page_id") == F.col("c.page_id")) & (F.col("a.line_id") < F.col("c.line_id"))
    edges = lines.alias("a").join(lines.alias("c"), same & (far <= near)).select(F.col("a.line_id").alias("u"), F.col("c.line_id").alias("v"))
    rows = X.components(lines, edges).withColumnRenamed("component", "cluster").join(lines.select("line_id", "fg_r", "fg_g", "fg_b"), "line_id")
    chroma = F.greatest("fg_r", "fg_g", "fg_b") - F.least("fg_r", "fg_g", "fg_b")
    luma = F.lit(0.299) * F.col("fg_r") + F.lit(0.587) * F.col("fg_g") + F.lit(0.114) * F.col("fg_b")
    pick = lambda key: F.max_by("line_id", F.struct(key, -F.col("line_id")))
    grey = F.when(F.avg(luma) < 128, pick(-luma)).otherwise(pick(luma))
    best = rows.groupBy("cluster").agg(F.when(F.max(chroma) >= 30, pick(chroma)).otherwise(grey).alias("representative"))
    return rows.join(best, "cluster").select("page_id", "line_id", "cluster", "representative")


def outline_consensus(lines: DataFrame) -> DataFrame:
    """With two pink fills or more on a page whose outlines are mostly white (60 %, two at least), all of them are white."""
    page = Window.partitionBy("page_id")
    pinks, whites = F.count_if("pink").over(page), F.count_if(F.col("pink") & F.col("white")).over(page)
    agreed = F.col("pink") & (pinks >= 2) & (whites >= 2) & (whites * 10 >= pinks * 6)
    return lines.withColumn("white", agreed | F.col("white"))


def modal_color(pixels: DataFrame, zone: str, reference: tuple[int, int, int], away: int = 30, bucket: int = 24, least: int = 8) -> DataFrame:
    """(zone, r, g, b, share) for each zone of pixels(zone, fg_r, fg_g, fg_b): the medians of its fullest colour bucket away from the reference.

    The medians are rounded, half to even; of buckets as full the lowest counts. The share is that of
    the bucket's pixels in all of the zone. A zone with fewer than `least` pixels away from the
    reference has no colour and the share zero.
    """
    channels = ("fg_r", "fg_g", "fg_b")
    far = F.greatest(*[F.abs(F.col(c) - v) for c, v in zip(channels, reference)]) >= away
    keys = [F.floor(F.col(c) / bucket).alias(f"k{i}") for i, c in enumerate(channels)]
    middle = [F.bround(F.percentile(c, F.lit(0.5))).cast("int").alias(x) for c, x in zip(channels, "rgb")]
    counted = pixels.where(far).groupBy(zone, *keys).agg(F.count("*").alias("n"), *middle)
    best = counted.groupBy(zone).agg(F.max_by(F.struct("r", "g", "b", "n"), F.struct("n", -F.col("k0"), -F.col("k1"), -F.col("k2"))).alias("m"), F.sum("n").alias("far"))
    enough = best.where(F.col("far") >= least).select(zone, "m")
    sizes = pixels.groupBy(zone).agg(F.count("*").alias("size"))
    return sizes.join(enough, zone, "left").select(zone, "m.r", "m.g", "m.b", F.coalesce(F.round(F.col("m.n") / F.col("size"), 6), F.lit(0.0)).alias("share"))
