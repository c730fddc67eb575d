"""Golden colours, grouping, order and job folding on literal rows."""

from pyspark.sql import functions as F

from folio.operators import boxes as X
from folio.operators import glossary as G
from folio.operators import jobs as J
from folio.operators import regions as R
from folio.operators.graph import connected_components


def lines(spark, boxes, page=0):
    return spark.createDataFrame([(page, i, *b) for i, b in enumerate(boxes)], "page_id bigint, line_id bigint, x1 int, y1 int, x2 int, y2 int")


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (4, 4), (None, 3), (3, 1), (7, 8)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    chain = connected_components(spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert {r["component"] for r in chain.collect()} == {0} and chain.count() == 301
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_grouping_of_vertical_lines(spark):
    boxes = [(2400, 3210, 2498, 4061), (2306, 3208, 2416, 3992), (2226, 3208, 2328, 4050), (2144, 3205, 2242, 4005), (2160, 2298, 2250, 3069), (2082, 2296, 2176, 3032), (162, 1733, 256, 2141), (242, 1733, 336, 2144)]
    t = lines(spark, boxes)
    comp = X.components(t, X.merge_edges(t)).withColumnRenamed("component", "region_id")
    split = R.component_split(t.join(comp, ["page_id", "line_id"])).toPandas()
    groups = sorted(sorted(g) for g in split.groupby("split_id")["line_id"].apply(list))
    assert groups == [[0, 1, 2, 3], [4, 5], [6, 7]]


def test_outline_goldens(spark):
    cases = [((194, 61, 107), (228, 156, 181), (255, 255, 255)), ((182, 60, 107), (226, 154, 183), (255, 255, 255)), ((196, 65, 117), (226, 156, 181), (255, 255, 255)), ((199, 76, 127), (253, 230, 243), (255, 255, 255)), ((210, 65, 115), (75, 125, 205), (75, 125, 205))]
    t = spark.createDataFrame([(*f, *o) for f, o, _ in cases], "a int, b int, c int, x int, y int, z int").coalesce(1)
    got = t.select(R.outline_resolve([F.col(k) for k in "abc"], [F.col(k) for k in "xyz"]).alias("o")).collect()
    assert [tuple(r["o"]) for r in got] == [w for *_, w in cases]


def test_nms_and_order(spark):
    t = lines(spark, [(0, 0, 10, 10), (1, 1, 11, 11), (50, 0, 60, 10)]).withColumn("prob", F.lit(0.9) - F.col("line_id") * 0.1)
    assert sorted(r["line_id"] for r in X.nms(t, 0.5, "prob").collect()) == [0, 2]
    ordered = R.simple_order(lines(spark, [(0, 0, 10, 10), (50, 0, 60, 10), (0, 100, 10, 110)])).toPandas()
    assert ordered.sort_values("ord")["line_id"].tolist() == [1, 0, 2]


def test_job_state(spark):
    f = [("t", 1, 1, "gallery-pre:5/36"), ("t", 2, 1, "gallery-pre:36/36"), ("t", 3, 1, "gallery-tl:1/4"), ("t", 4, 1, "gallery-tl-done:1/4"), ("t", 5, 3, "2"), ("t", 6, 4, "")]
    r = J.job_state(spark.createDataFrame(f, "token string, seq long, code int, payload string")).first()
    assert (r.pre, r.tl, r.tl_done, r.batches, r.dispatched, r.queue_pos, r.terminal) == (36, 1, 1, 4, True, None, None)


def test_glossary_rules(spark):
    name, rest = "Robinsonvilleheightstown", " and then we all went home together by the old road to the sea and back again over the hills at night" * 2
    texts = spark.createDataFrame([(1, f"a friend of {name} came"), (2, "we met Robinsomvilleheightstown there" + rest), (3, "no such place" + rest)], "text_id long, text string")
    terms = spark.createDataFrame([(name, "R"), ("nowhere", "N")], "term string, target string")
    assert sorted((r.text_id, r.term, r.rule) for r in G.glossary_match(texts, terms).collect()) == [(1, name, "exact"), (2, name, "fuzzy")]
    patterns = terms.union(spark.createDataFrame([(r"m[ae]t robin\w+", "P"), ("a friend of", "Q"), ("no (such)? places", None)], "term string, target string"))
    got = {(r.text_id, r.term): (r.target, r.rule) for r in G.glossary_match(texts, patterns).collect()}
    assert got == {(1, name): ("R", "exact"), (2, name): ("R", "fuzzy"), (1, "a friend of"): ("Q", "exact"), (2, r"m[ae]t robin\w+"): ("P", "regex")}


# Corners of lines of a page and the groups they belong to.
QUADS = [[[0, 3280], [237, 3234], [394, 4069], [149, 4096]], [[2400, 3210], [2493, 3210], [2498, 4061], [2405, 4061]],
 [[2306, 3208], [2410, 3208], [2416, 3992], [2312, 3992]], [[2226, 3208], [2328, 3208], [2328, 4050], [2226, 4050]],
 [[2149, 3205], [2242, 3205], [2237, 4005], [2144, 4005]], [[2160, 2298], [2245, 2298], [2250, 3069], [2165, 3069]],
 [[2082, 2296], [2176, 2296], [2176, 3032], [2082, 3032]], [[2008, 2293], [2109, 2293], [2109, 2680], [2008, 2680]],
 [[162, 1733], [256, 1733], [256, 2141], [162, 2141]], [[242, 1733], [336, 1733], [336, 2144], [242, 2144]],
 [[2269, 1349], [2368, 1349], [2373, 1960], [2274, 1960]], [[2186, 1352], [2288, 1352], [2288, 1760], [2186, 1760]],
 [[2373, 1357], [2442, 1357], [2442, 2077], [2373, 2077]], [[536, 1349], [613, 1349], [613, 1997], [536, 1997]],
 [[594, 1344], [680, 1344], [696, 2072], [610, 2072]], [[1037, 485], [1282, 469], [1349, 1418], [1104, 1434]],
 [[234, 528], [312, 528], [312, 1176], [234, 1176]], [[138, 509], [256, 509], [256, 706], [138, 706]],
 [[2418, 384], [2504, 384], [2509, 1234], [2424, 1234]], [[2344, 381], [2429, 381], [2434, 965], [2349, 965]],
 [[2269, 376], [2370, 376], [2370, 818], [2269, 818]], [[197, 42], [2405, 37], [2405, 362], [197, 368]]]
GROUPS = [[0], [1, 2, 3, 4], [5, 6, 7], [8, 9], [10, 11, 12], [13, 14], [15], [16, 17], [18, 19, 20], [21]]


def quads(spark, pts):
    return X.with_edges(spark.createDataFrame([(0, i, [(float(x), float(y)) for x, y in p]) for i, p in enumerate(pts)], "page_id bigint, line_id bigint, pts array<struct<x:double,y:double>>"))


def grouped(t):
    comp = X.components(t, X.merge_edges(t)).withColumnRenamed("component", "region_id")
    split = R.component_split(t.join(comp, ["page_id", "line_id"])).toPandas()
    return sorted(sorted(g) for g in split.groupby("split_id")["line_id"].apply(list))


def test_grouping_of_turned_lines(spark):
    assert grouped(quads(spark, QUADS)) == GROUPS


def test_turned_lines_merge_by_angle(spark):
    """Two lines turned by 45 degrees side by side, one across them, and one further off."""
    line = lambda x, y, dx, dy, wx, wy: [(x, y), (x + wx, y + wy), (x + wx + dx, y + wy + dy), (x + dx, y + dy)]
    t = quads(spark, [line(0, 0, -200, 200, 20, 20), line(30, 30, -200, 200, 20, 20), line(60, 60, 200, 200, 20, -20), line(150, 150, -200, 200, 20, 20)])
    assert not any(r.upright for r in X.features(t).collect())
    assert [(r.u, r.v) for r in X.merge_edges(t).collect()] == [(0, 1)]


def test_quad_distance(spark):
    square = lambda x, y: [(x, y), (x + 10.0, y), (x + 10.0, y + 10.0), (x, y + 10.0)]
    tilted = [(20.0, 0.0), (30.0, 10.0), (20.0, 20.0), (10.0, 10.0)]
    cases = [(square(0.0, 0.0), square(13.0, 14.0), 5.0), (square(0.0, 0.0), square(5.0, 5.0), 0.0), (square(2.0, -4.0), tilted, 2**0.5), (square(15.0, 5.0), tilted, 0.0), (square(0.0, 0.0), square(10.0, 0.0), 0.0)]
    kind = "array<struct<x:double,y:double>>"
    got = spark.createDataFrame([(i, a, c) for i, (a, c, _) in enumerate(cases)], f"i int, a {kind}, c {kind}").select("i", X.quad_distance(F.col("a"), F.col("c")).alias("d"), X.quad_distance(F.col("c"), F.col("a")).alias("e")).collect()
    assert all(abs(r.d - cases[r.i][2]) < 1e-9 and r.d == r.e for r in got)


def test_angle_of_regions(spark):
    tilt = lambda x, by: [(x, 0), (x + 20, 0), (x + 20 + by, 200), (x + by, 200)]
    t = quads(spark, [tilt(0, 40), tilt(30, 60), tilt(500, 4)]).selectExpr("*", "if(line_id < 2, 0, 2) as region_id", "0.5D as prob")
    got = {r.region_id: round(r.angle, 3) for r in R.region_aggregate(t).collect()}
    assert got == {0: round(-(11.310 + 16.699) / 2, 3), 2: 0.0}


def test_evaluation_with_ignored_truth(spark):
    rows = [(1, 1, 0, 0, 10, 10, False), (1, 2, 100, 0, 200, 100, True), (2, 3, 0, 0, 10, 10, True), (3, 4, 0, 0, 10, 10, None)]
    truth = spark.createDataFrame(rows, "page_id bigint, line_id bigint, x1 int, y1 int, x2 int, y2 int, dim boolean")
    found = spark.createDataFrame([(1, 1, 0, 0, 10, 9), (1, 2, 110, 0, 140, 20), (1, 3, 190, 0, 230, 10), (2, 4, 1, 1, 9, 9), (4, 5, 0, 0, 5, 5)], "page_id bigint, line_id bigint, x1 int, y1 int, x2 int, y2 int")
    got = {r.page_id: (r.n_truth, r.n_found, r.matched, r.recall, r.precision) for r in R.detection_eval(truth, found, ignore="dim").collect()}
    assert got == {1: (1, 2, 1, 1.0, 0.5), 2: (0, 0, 0, 1.0, 1.0), 3: (1, 0, 0, 0.0, 0.0), 4: (0, 1, 0, 1.0, 0.0), None: (2, 3, 1, 0.5, 1 / 3)}


def test_the_distance_of_turned_lines_is_told_once_a_pair(spark):
    """It is asked last and in one place of the plan (two uses of hypot, one a direction)."""
    corner = "struct<x:int,y:int>"
    lines = spark.createDataFrame([(1, 1, [(0, 0), (40, 5), (38, 25), (-2, 20)]), (1, 2, [(3, 30), (43, 35), (41, 55), (1, 50)])], f"page_id bigint, line_id bigint, pts array<{corner}>")
    edges = X.merge_edges(X.with_edges(lines))
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("HYPOT") == 2 and [tuple(r) for r in edges.collect()] == [(1, 1, 2)]
