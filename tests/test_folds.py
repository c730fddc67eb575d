"""Operators without SQL against plain loops over the whole derived tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import boxes, enrich, graph, jobs
from folio.operators import regions as R
from folio.plans import registry
from folio.plans.fixtures import table
from folio.sources import files


def rows_of(spark, sf_dir, name):
    return registry.queries()[name](spark, sf_dir).collect()


def grouped(rows, key):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


def seconds(ts):
    return (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at")


def hour(times, hourly=12, window=3600):
    starts, out = [], []
    for t in times:
        out.append(sum(x >= t - window for x in starts) < hourly)
        if out[-1]:
            starts.append(t)
    return out


def test_admission_hourly_by_loop(spark, sf_dir):
    got = {r.req_id: r.admitted for r in rows_of(spark, sf_dir, "admission_hourly")}
    requests = table(spark, sf_dir, "bursts_fx").withColumnRenamed("moment", "at").collect()
    for rs in grouped(requests, "ip").values():
        rs.sort(key=lambda r: (r.at, r.req_id))
        assert [got[r.req_id] for r in rs] == hour([r.at for r in rs], window=3_600_000_000)
    assert len(got) == len(requests)


def test_admission_refuses(spark):
    rows = [(i, i % 2, (i // 2) * 100, "x") for i in range(400)] + [(1000, None, 5, None)]
    out = jobs.admission(spark.createDataFrame(rows, "id long, ip int, at long, other string"), "ip", "at", "id", 12, 3600)
    assert out.columns == ["id", "ip", "at", "other", "admitted"] and out.count() == 401
    for ip, rs in grouped(out.collect(), "ip").items():
        rs.sort(key=lambda r: (r.at, r.id))
        want = hour([r.at for r in rs])
        assert [r.admitted for r in rs] == want and (ip is None or not all(want))


def plain_server(rows, most_pages, most_live, most_own, hourly, window):
    out, jobs = {}, []
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        req, ip, at, pages, ends = r
        live = [j for j in jobs if j[1] is not None and j[1] > at]
        if pages > most_pages:
            out[req] = 413
        elif len(live) >= most_live:
            out[req] = 503
        elif sum(j[2] == ip for j in live) >= most_own or sum(j[2] == ip and at - j[0] <= window for j in jobs) >= hourly:
            out[req] = 429
        else:
            out[req] = 200
            jobs.append((at, ends, ip))
    return out


def test_admission_server_by_loop(spark):
    """Blocks much shorter than the jobs, so decisions reach over many of them; ties in time; jobs of no length."""
    rnd = random.Random(1)
    rows = [(i, rnd.choice([1, 1, 2, 3, 4, None]), rnd.randrange(1000) * 10, rnd.choice([5, 5, 5, 20]), None) for i in range(500)]
    rows = [(i, ip, at, pages, rnd.choice([None, at - 5, at, at + rnd.randrange(400)])) for i, ip, at, pages, _ in rows]
    df = spark.createDataFrame(rows, "req_id long, ip int, at long, pages int, ends long")
    for block in (150, 3000, 10**6):
        got = jobs.admission_server(df, 10, 4, 2, 3, 300, block).collect()
        want = plain_server(rows, 10, 4, 2, 3, 300)
        assert {r.req_id: r.status for r in got} == want
        assert set(want.values()) == {200, 413, 429, 503} and len(got) == 500
    assert jobs.admission_server(df.where("false")).collect() == []


def test_throttle_latest_by_loop(spark, sf_dir):
    got = collections.defaultdict(set)
    for r in rows_of(spark, sf_dir, "throttle_latest"):
        got[r.token].add((r.seq, round(r.sent_at, 6)))
    for token, rs in grouped(table(spark, sf_dir, "frames_fx").select("token", "seq", seconds("ts")).collect(), "token").items():
        rs.sort(key=lambda r: (r.at, r.seq))
        want, left = set(), list(rs)
        at = rs[0].at  # from here the next event may go out
        while left:
            ready = [r for r in left if r.at < at]
            if ready:  # the last of those that came meanwhile, when the time is over
                want.add((ready[-1].seq, round(at, 6)))
                left = [r for r in left if r.at >= at]
            else:
                at = max(at, left[0].at)
                want.add((left[0].seq, round(at, 6)))
                left = left[1:]
            at += 600.0
        assert got[token] == want


def area(r):
    return (r.x2 - r.x1) * (r.y2 - r.y1)


def test_detection_eval_by_loop(spark, sf_dir):
    lines = table(spark, sf_dir, "lines_fx")
    shifted = R.shifted(lines.where("line_id % 7 <> 0"), 4, 3)
    got = {r.page_id: r for r in R.detection_eval(lines, shifted).collect()}
    found = grouped(shifted.collect(), "page_id")
    for page, truth in grouped(lines.collect(), "page_id").items():
        used = set()
        for t in sorted(truth, key=lambda r: r.line_id):
            for f in sorted(found[page], key=lambda r: r.line_id):
                common = max(0, min(t.x2, f.x2) - max(t.x1, f.x1)) * max(0, min(t.y2, f.y2) - max(t.y1, f.y1))
                if f.line_id not in used and common > 0.5 * (area(t) + area(f) - common):
                    used.add(f.line_id)
                    break
        g = got[page]
        assert (g.matched, g.n_truth, g.n_found) == (len(used), len(truth), len(found[page]))
        assert abs(g.recall - len(used) / len(truth)) < 1e-12 and (not found[page] or abs(g.precision - len(used) / len(found[page])) < 1e-12)


def test_dominant_color_by_loop(spark, sf_dir):
    from folio.plans.box_queries import _regions

    got = {(r.page_id, r.region_id): (r.r, r.g, r.b) for r in rows_of(spark, sf_dir, "dominant_color")}
    regions = collections.defaultdict(list)
    for r in _regions(spark, sf_dir).collect():
        regions[r.page_id, r.region_id].append(r)
    for key, rs in regions.items():
        pools = []
        for r in sorted(rs, key=lambda r: r.line_id):
            c = (r.fg_r, r.fg_g, r.fg_b)
            pool = next((p for p in pools if all(abs(x - y) <= 10 for x, y in zip(p[0], c))), None)
            if pool:
                pool[1] += area(r)
            else:
                pools.append([c, area(r)])
        assert got[key] == max(pools, key=lambda p: p[1])[0]
    assert len(got) == len(regions)


def test_region_report_by_loop(spark, sf_dir):
    got = {r.page_id: (r.report, r.n_colors) for r in rows_of(spark, sf_dir, "region_report")}
    pages = grouped(table(spark, sf_dir, "lines_fx").collect(), "page_id")
    for page, rs in pages.items():
        colors, parts = [], []
        for i, r in enumerate(sorted(rs, key=lambda r: r.line_id), 1):
            c = (r.fg_r, r.fg_g, r.fg_b)
            close = lambda d: sum(abs(x - y) for x, y in zip(c, d)) < 50  # noqa: E731, B023
            if not any(map(close, colors)):
                colors.append(c)
            number = 1 + next(k for k, d in enumerate(colors) if close(d))
            parts.append(f"-- {i} --\ncolor #{number}: {c[0]:02x}{c[1]:02x}{c[2]:02x}\nbox: {r.x1},{r.y1},{r.x2},{r.y2}\ntext: {r.text}")
        assert got[page] == ("\n\n".join(parts), len(colors))
    assert len(got) == len(pages)


def test_job_log_keeps_what_is_written_and_leaves_out_a_torn_line(spark, tmp_path):
    path = str(tmp_path / "jobs")
    schema = "token string, pages bigint, wall_s double"
    rows = [("a", 3, 1.5), ("tab\t\"quote\"\nline", None, None), (None, 0, 2.0)]
    for part in (rows[:1], rows[1:]):  # a second write adds to the first
        files.write_job_log(spark.createDataFrame(part, schema), path)
    (tmp_path / "jobs" / "part-torn.txt").write_text('{"token":"b","pa')
    assert sorted(map(str, files.read_job_log(spark, path, schema).collect())) == sorted(map(str, spark.createDataFrame(rows, schema).collect()))


def test_page_language_check_merges_the_page(spark):
    known = spark.createDataFrame([("the cat sat on the mat with the hat", "en"), ("le chat est sur la table avec le chien", "fr")], "text string, lang string")
    pages = [("en", ["the cat", " the mat", "the hat\n", ""]), ("fr", ["le chat", "la table", "le chien", None]), ("few", ["le chien"] * 3), ("blank", [" ", None, "", "\n"]), ("odd", ["0", "1", "", ""])]
    rows = [(name, i, t) for name, texts in pages for i, t in enumerate(texts)]
    got = enrich.page_language_check(spark.createDataFrame(rows, "page string, i int, dst string"), "page", "i", enrich.language_profile(known, "text", "lang"), "en", 3)
    assert {r.page: (r.n, r.passed) for r in got.collect()} == {"en": (4, True), "fr": (4, False), "few": (3, True), "blank": (4, True), "odd": (4, False)}


def test_reading_order_by_panel(spark):
    """Two panels beside one another, each read from the right; without panels the columns of both mix by x; null comes last."""
    rows = [(1, 1, 0, 0, 10, 10, 2), (1, 2, 100, 0, 110, 10, 2), (1, 3, 200, 0, 210, 10, 1), (1, 4, 300, 0, 310, 10, 1), (1, 5, 400, 0, 410, 10, None)]
    boxes_ = spark.createDataFrame(rows, "page_id long, line_id long, x1 int, y1 int, x2 int, y2 int, panel_id int")
    order = lambda df: [r.line_id for r in df.orderBy("ord").collect()]
    assert order(boxes.reading_order(boxes_)) == [5, 4, 3, 2, 1]
    assert order(boxes.reading_order(boxes_, panel="panel_id")) == [4, 3, 2, 1, 5]
    assert order(boxes.reading_order(boxes_, False, "panel_id")) == [3, 4, 1, 2, 5]


def iou_over(a, b, least):
    common = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
    return common > 0 and common > least * ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - common)


BOXES = "page_id long, line_id long, x1 int, y1 int, x2 int, y2 int, prob double, kind string"


def some_boxes(rnd, n, room):
    rows = []
    for i in range(n):
        x, y = rnd.randrange(room), rnd.randrange(room)
        rows.append((rnd.choice([1, 1, 1, 2]), i, x, y, x + rnd.choice([0, 30, 50, 300]), y + rnd.choice([20, 40, 300]), rnd.choice([0.5, 0.7, 0.9, rnd.random(), None]), rnd.choice(["a", "a", "b", None])))
    return rows


@pytest.mark.parametrize(("kind", "most"), [(None, None), ("kind", None), ("kind", 9)])
def test_nms_by_loop(spark, kind, most):
    """Crowded boxes, ties and null scores, boxes without area; chains in which each waits for the one before."""
    rows = some_boxes(random.Random(1), 300, 500) + [(3, 1000 + i, 10 * i, 0, 10 * i + 30, 30, 1 - i / 100, "a") for i in range(12)]
    df = spark.createDataFrame(rows, BOXES)
    want = []
    for page in (1, 2, 3):
        stay = []
        for r in sorted((r for r in rows if r[0] == page), key=lambda r: (r[6] is None, -(r[6] or 0), r[1])):
            if not any(iou_over(s, r, 0.3) and (kind is None or s[7] == r[7]) for s in stay):
                stay.append(r)
        want += stay[:most]
    assert sorted(map(str, map(tuple, boxes.nms(df, 0.3, "prob", kind, most).collect()))) == sorted(map(str, want))
    assert len(want) < len(rows)
    assert boxes.nms(df.where("false"), 0.3, "prob").collect() == []


def test_matches_by_loop(spark):
    rnd = random.Random(2)
    pairs = list({(rnd.randrange(3), rnd.randrange(25), rnd.randrange(25)) for _ in range(400)})
    pairs += [(9, i, j) for i in range(8) for j in (i, i + 1)]  # each waits for the one before
    want, lefts, rights = [], set(), set()
    for p, a, b in sorted(pairs):
        if (p, a) not in lefts and (p, b) not in rights:
            lefts.add((p, a))
            rights.add((p, b))
            want.append((p, a, b))
    df = spark.createDataFrame(pairs + pairs[:20], "page long, left long, right long")
    assert sorted(map(tuple, graph.matched(df).collect())) == want
    assert graph.matched(df.where("false")).collect() == []


def test_suppressed_refuses_circles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 2), (7, None)], "strong long, weak long")
    assert sorted(r.node for r in graph.suppressed(edges).collect()) == [2, 4]
    with pytest.raises(ValueError, match="circle"):
        graph.suppressed(edges.union(spark.createDataFrame([(11, 12), (12, 11)], "strong long, weak long")))


def spread_boxes(rnd, n, room):
    rows = [(rnd.choice([1, 1, 2]), i, rnd.randrange(room), rnd.randrange(room)) for i in range(n)] + [(3, n, 5, 5), (4, n + 1, 0, 0), (4, n + 2, 0, 9)]
    return [(p, i, x, y, x + rnd.choice([0, 10, 60]), y + rnd.choice([5, 10, 60])) for p, i, x, y in rows]


@pytest.mark.parametrize(("room", "cell"), [(4000, 16), (300, 256)])
def test_neighbours_by_loop(spark, room, cell):
    """Boxes far apart, so that the reach widens often, and close together."""
    rows = spread_boxes(random.Random(room), 120, room)
    shared = lambda a, c, lo, hi: 3 * (min(a[hi], c[hi]) - max(a[lo], c[lo])) >= min(a[hi] - a[lo], c[hi] - c[lo])
    want = []
    for a in rows:
        row = [c for c in rows if c[0] == a[0] and c[1] != a[1] and shared(a, c, 3, 5)]
        col = [c for c in rows if c[0] == a[0] and c[1] != a[1] and shared(a, c, 2, 4)]
        best = lambda some: min(some, default=(0, None))[1]
        want.append((a[0], a[1], best([(a[2] - c[4], c[1]) for c in row if c[4] <= a[2]]), best([(c[2] - a[4], c[1]) for c in row if c[2] >= a[4]]),
                     best([(a[3] - c[5], c[1]) for c in col if c[5] <= a[3]]), best([(c[3] - a[5], c[1]) for c in col if c[3] >= a[5]])))
    df = spark.createDataFrame(rows, "page_id long, line_id long, x1 int, y1 int, x2 int, y2 int")
    got = boxes.neighbours(df, cell).select("page_id", "line_id", "left_id", "right_id", "top_id", "bottom_id")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert boxes.neighbours(df.where("false"), cell).collect() == []


def test_nearest_by_loop(spark):
    """Points far outside and inside boxes, ties, and a page without boxes."""
    rnd = random.Random(6)
    rows = spread_boxes(rnd, 60, 3000)
    points = [(rnd.choice([1, 2, 3, 9]), i, rnd.randrange(-9000, 9000, 10), rnd.randrange(-9000, 9000, 10)) for i in range(150)]
    want = []
    for page, i, x, y in points:
        some = []
        for _, k, x1, y1, x2, y2 in (r for r in rows if r[0] == page):
            dx, dy = max(0, x1 - x, x - x2), max(0, y1 - y, y - y2)
            some.append((dx * dx + dy * dy, (2 * x - x1 - x2) ** 2 + (2 * y - y1 - y2) ** 2, k))
        if some:
            want.append((page, i, min(some)[2]))
    df = spark.createDataFrame(rows, "page_id long, line_id long, x1 int, y1 int, x2 int, y2 int")
    p = spark.createDataFrame(points, "page_id long, point_id long, px int, py int")
    assert sorted(map(tuple, boxes.nearest_owner(p, df).collect())) == sorted(want)
    assert boxes.nearest_owner(p.where("page_id = 9"), df).collect() == [] == boxes.nearest_owner(p, df.where("false")).collect()


def test_grams_are_counted_in_tasks(spark):
    """Counts by language, with characters beyond 16 bits, repeats and texts too short; only sums of texts are shuffled."""
    rows = [("en", "Abab"), ("en", "ABA"), ("de", "\U0001f600ab"), ("de", "ab"), ("de", None), (None, "xyz")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lang string, text string")
    code = lambda g: ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2])
    profile = enrich.language_profile(docs, "text", "lang")
    got = sorted(map(tuple, profile.select("lang", "gram", "n", "total", "v").collect()), key=str)
    assert got == sorted([("en", code("aba"), 2, 3, 4), ("en", code("bab"), 1, 3, 4), ("de", code("\U0001f600ab"), 1, 1, 4)], key=str)  # a text without a language counts for v only
    whole, joined = (sorted(map(tuple, enrich.language_detect(docs, profile, "i", "text", n).collect())) for n in (1000, 0))
    assert [r[:2] for r in whole] == [(0, "en"), (1, "en"), (2, "de")] == [r[:2] for r in joined]
