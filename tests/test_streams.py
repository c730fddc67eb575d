"""Keyed folds in batches and in streams of many micro-batches: order, timers, late rows, restarts, state that ends."""

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import jobs as J
from folio.plans.fixtures import table
from folio.storage import scratch_path
from folio.streaming import folds
from folio.streaming import jobs as S

SECOND = 1_000_000
START = 1_704_067_200_000_000
END = START + 100_000 * SECOND


def plain_uploads(rows, most, ttl, exists):
    """A server that looks at its uploads before each part: drops what is too old, forgets what is done."""
    out, pending, known = [], {}, {}
    for token, part, parts, pages, at in [*sorted(rows, key=lambda r: (r[4], r[1])), (None, 0, 0, 0, END)]:
        for t, u in list(pending.items()):
            if at - u["at"] > ttl:
                out.append((t, u["at"], u["at"] + ttl, len(u["got"]), sum(u["got"].values()), "dropped"))
                del pending[t]
        for t in [t for t, x in known.items() if at - x > exists]:
            del known[t]
        if token is None or token in known:
            continue
        u = pending.setdefault(token, {"at": at, "parts": parts, "got": {}})
        u["got"][part] = pages
        status = "rejected" if sum(u["got"].values()) > most else "complete" if len(u["got"]) == u["parts"] else None
        if status:
            out.append((token, u["at"], at, len(u["got"]), sum(u["got"].values()), status))
            del pending[token]
            if status == "complete":
                known[token] = at
    return sorted(out)


def plain_jobs(rows, grace, keep):
    out, jobs = [], {}
    for token, seq, kind, at, done_at in [*sorted(rows, key=lambda r: (r[3], r[1])), (None, 0, "", END, None)]:
        for t, j in list(jobs.items()):
            if j["status"] == "running" and at - j["polled"] > grace:
                j["status"], j["done"] = "cancelled", j["polled"] + grace
            since = j["done"] or j["polled"]
            if j["status"] != "running" and at - since > keep:
                out.append((t, j["status"], j["started"], j["polled"], j["done"], since + keep))
                del jobs[t]
        j = jobs.get(token)
        if j is None:
            if kind == "start":
                jobs[token] = {"status": "running", "started": at, "polled": at, "done": None}
        elif kind in ("start", "poll"):
            j["polled"] = at
        elif j["status"] == "running":
            j["status"], j["done"] = kind, done_at
    return sorted(out, key=str)


def plain_hours(rows, hourly, window):
    out, starts = [], {}
    for req, ip, at in sorted(rows, key=lambda r: (r[2], r[0])):
        held = [x for x in starts.get(ip, []) if not at - x > window]
        out.append((req, ip, at, len(held) < hourly))
        starts[ip] = held + [at] * (len(held) < hourly)
    return sorted(out)


def some_uploads(rnd):
    rows = [("t%d" % rnd.randrange(12), rnd.randrange(3), 3, rnd.randrange(1, 40), START + rnd.randrange(0, 3000) * SECOND) for _ in range(250)]
    return list({(r[0], r[1], r[4]): r for r in rows}.values())


def some_jobs(rnd):
    rows, at = [], {}
    for seq in range(500):
        token = f"j{rnd.randrange(8)}"
        at[token] = at.get(token, START) + rnd.choice([5, 20, 40, 41, 60, 120, 161]) * SECOND
        kind = rnd.choice(["start", "poll", "poll", "poll", "done", "failed"])
        rows.append((token, seq, kind, at[token], rnd.choice([None, at[token]]) if kind in ("done", "failed") else None))
    return rows


def replayed(spark, rows, schema, jitter, slices, delay_rnd):
    """In order of arrival, up to `jitter` seconds late; then a row that closes all."""
    df = spark.createDataFrame([(*r, r[schema.split(", ").index("at bigint")] + delay_rnd.randrange(jitter + 1) * SECOND) for r in rows], schema + ", arrival bigint")
    names = [c.split()[0] for c in schema.split(", ")]
    last = spark.range(1).select(*[F.lit(END + 1000 * SECOND if n == "at" else None).cast(c.split()[1]).alias(n) for n, c in zip(names, schema.split(", "))], F.lit(END).alias("arrival"))
    return S.replay(df, "arrival", slices, last).drop("arrival")


UPLOADS, JOBS, REQUESTS = "token string, part int, parts int, pages int, at bigint", "token string, seq bigint, kind string, at bigint, done_at bigint", "req_id bigint, ip bigint, at bigint"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_uploads(spark, seed):
    rnd = random.Random(seed)
    rows, columns = some_uploads(rnd), ("token", "created", "ended_at", "have", "pages", "status")
    want = sorted(plain_uploads(rows, 60, 300 * SECOND, 120 * SECOND), key=str)
    assert {r[5] for r in want} == {"complete", "rejected", "dropped"}
    batch = J.uploads(spark.createDataFrame(rows, UPLOADS), 60, 300 * SECOND, 120 * SECOND, END)
    assert rows_of(batch, *columns) == want
    reports = []
    stream = S.uploads(replayed(spark, rows, UPLOADS, 30, 6, rnd), 60, 300 * SECOND, 120 * SECOND, "1 minute")
    assert rows_of(S.run_available(stream, keep=reports), *columns) == want
    assert sum(p.numInputRows > 0 for p in reports) >= 5
    assert reports[-1].stateOperators[0].numRowsTotal == 0  # of the closing row there is no state either


def test_an_upload_is_rejected_before_all_parts_are_in(spark):
    rows = [("a", 0, 4, 70, START), ("a", 1, 4, 40, START + SECOND), ("b", 0, 2, 1, START), ("b", 0, 2, 5, START + 2 * SECOND), ("b", 1, 2, 3, START + 300 * SECOND), ("c", 0, 2, 1, START), ("c", 1, 2, 1, START + 300 * SECOND + 1)]
    out = J.uploads(spark.createDataFrame(rows, UPLOADS), 100, 300 * SECOND, 120 * SECOND, END)
    assert rows_of(out, "token", "have", "layout", "status") == [("a", 2, "70,40", "rejected"), ("b", 2, "5,3", "complete"), ("c", 1, "1", "dropped"), ("c", 1, "1", "dropped")]
    assert J.uploads(spark.createDataFrame([], UPLOADS), 100, 1, 1, END).collect() == []


def test_lifecycle(spark):
    rnd = random.Random(3)
    rows, columns = some_jobs(rnd), ("token", "status", "started", "last_poll", "done_at", "gone_at")
    want = plain_jobs(rows, 40 * SECOND, 120 * SECOND)
    assert {r[1] for r in want} == {"cancelled", "done", "failed"} and any(r[4] is None for r in want)
    assert rows_of(J.lifecycle(spark.createDataFrame(rows, JOBS), 40 * SECOND, 120 * SECOND, END), *columns) == want
    reports = []
    stream = S.lifecycle(replayed(spark, rows, JOBS, 30, 6, rnd), 40 * SECOND, 120 * SECOND, "1 minute")
    assert rows_of(S.run_available(stream, keep=reports), *columns) == want
    assert sum(p.numInputRows > 0 for p in reports) >= 5
    assert reports[-1].stateOperators[0].numRowsTotal == 0


def test_hours(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.randrange(4), START + rnd.choice([600, 1200]) * rnd.randrange(40) * SECOND) for i in range(200)]
    want = plain_hours(rows, 3, 3600 * SECOND)
    assert 0 < sum(r[3] for r in want) < len(want)
    assert sorted(map(tuple, J.admission(spark.createDataFrame(rows, REQUESTS), "ip", "at", "req_id", 3, 3600 * SECOND).collect())) == want
    reports = []
    stream = S.admission(replayed(spark, rows, REQUESTS, 60, 5, rnd), 3, 3600 * SECOND, "2 minutes")
    assert rows_of(S.run_available(stream, keep=reports), "req_id", "ip", "at", "admitted") == sorted(want, key=str)
    assert reports[-1].stateOperators[0].numRowsTotal == 0


def test_keys_of_one_bucket_keep_apart(spark, monkeypatch):
    """Folds of many keys in one group, with state and timers of each, numbers as keys."""
    monkeypatch.setattr(folds, "BUCKETS", 1)
    rnd = random.Random(6)
    rows = [(i, rnd.randrange(9), START + rnd.choice([600, 1200]) * rnd.randrange(40) * SECOND) for i in range(300)]
    reports = []
    stream = S.admission(replayed(spark, rows, REQUESTS, 60, 5, rnd), 3, 3600 * SECOND, "2 minutes")
    assert rows_of(S.run_available(stream, keep=reports), "req_id", "ip", "at", "admitted") == sorted(plain_hours(rows, 3, 3600 * SECOND), key=str)
    assert reports[-1].stateOperators[0].numRowsTotal == 0


def test_rows_behind_the_watermark_are_dropped(spark):
    at = [START + n * 3600 * SECOND for n in range(0, 240)]
    late = [START + n * 3600 * SECOND + 1 for n in (3, 30, 50)]
    rows = [(t, t, False) for t in at] + [(t, START + 200 * 3600 * SECOND, True) for t in late] + [(at[199] + 2, at[200], True)]
    df = spark.createDataFrame(rows, "at bigint, arrival bigint, planted boolean")
    last = spark.createDataFrame([(END + 10**6 * SECOND, END, None)], df.schema)
    stream = S.replay(df, "arrival", 8, last).withColumn("ts", F.timestamp_micros("at"))
    reports = []
    out = S.run_available(S.tumbling(stream, "1 day", "2 hours", F.count("*").alias("n"), F.count_if("planted").alias("planted")), keep=reports).collect()
    assert sum(r.n for r in out) == 241 and sum(r.planted for r in out) == 1  # the one that is just two hours late
    assert sum(o.numRowsDroppedByWatermark for p in reports for o in p.stateOperators) == 3


def test_a_restart_gives_no_page_twice(spark, sf_dir):
    frames = table(spark, sf_dir, "frames_fx").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_micros("ts"))
    pages = frames.where("code = 5").withColumn("arrival", F.col("at"))
    again = pages.withColumn("arrival", F.col("at") + 4 * 3600 * SECOND)  # each page is sent again four hours later
    both = pages.union(again)
    folder, path = scratch_path(spark, "test-replay"), scratch_path(spark, "test-stream")
    once = lambda: S.once_per_key(spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder), ["token", "idx"], "ts", "2 days")
    parts = S.sliced(both, "arrival", 6)
    counts = []
    for done in (2, 3, 6):
        for n, part in enumerate(parts[:done]):
            part.coalesce(1).write.mode("ignore").parquet(f"{folder}/slice={n}")
        counts.append(S.run_available(once().select("token", "idx", "seq"), path=path).count())
    out = S.run_available(once().select("token", "idx", "seq"), path=path)
    assert counts == sorted(set(counts)) and out.count() == counts[-1] == pages.select("token", "idx").distinct().count()
    assert out.select("token", "idx").distinct().count() == out.count()


def test_a_fold_goes_on_after_a_restart(spark):
    rnd = random.Random(5)
    rows = some_uploads(rnd)
    df = spark.createDataFrame([(*r, r[4]) for r in rows] + [(None, None, None, None, END + 1000 * SECOND, END)], UPLOADS + ", arrival bigint")
    folder, path = scratch_path(spark, "test-replay"), scratch_path(spark, "test-stream")
    stream = lambda: S.uploads(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder).drop("arrival"), 60, 300 * SECOND, 120 * SECOND, "1 second")
    parts = S.sliced(df.where(f"arrival < {END}"), "arrival", 4) + [df.where(f"arrival = {END}")]
    for done in (1, 3, 5):
        for n, part in enumerate(parts[:done]):
            part.coalesce(1).write.mode("ignore").parquet(f"{folder}/slice={n}")
        out = S.run_available(stream(), path=path)
    assert rows_of(out, "token", "created", "ended_at", "have", "pages", "status") == sorted(plain_uploads(rows, 60, 300 * SECOND, 120 * SECOND), key=str)


def test_update_mode_is_refused(spark):
    with pytest.raises(ValueError, match="append or complete"):
        S.run_available(spark.readStream.format("rate").load(), "update")
