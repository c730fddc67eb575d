"""Queries over job frames, calls, uploads and requests, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import jobs as J
from folio.plans.fixtures import sql_with, table
from folio.sources.files import read_job_log, write_job_log
from folio.storage import scratch_path

QUERIES: dict[str, tuple] = {}


def _add(name: str, sql: str | None, *fixtures: str):
    def keep(run):
        QUERIES[name] = (run, sql_with(list(fixtures), sql) if sql and fixtures else sql)
        return run

    return keep


@_add(
    "frame_parse",
    """SELECT seq, code, CASE WHEN code = 5 THEN CAST(length(token) + 5 AS BIGINT) ELSE 0 END AS size,
       CASE WHEN code = 5 THEN token END AS token, CASE WHEN code = 5 THEN CAST(idx AS BIGINT) END AS idx FROM frames_fx""",
    "frames_fx",
)
def frame_parse(spark, sf_dir):
    """Frames packed to bytes and parsed again."""
    be = lambda c, n: F.unhex(F.lpad(F.hex(c.cast("long")), 2 * n, "0"))
    f = table(spark, sf_dir, "frames_fx")
    page = F.col("code") == J.PAGE
    size = F.when(page, F.length("token") + 5).otherwise(0)
    tail = F.concat(be(F.length("token"), 1), F.col("token").cast("binary"), be(F.col("idx"), 4))
    packed = F.concat(be(F.col("code"), 1), be(size, 4), F.when(page, tail).otherwise(F.lit(b"")))
    return f.select("seq", J.frame_parse(packed).alias("p")).select("seq", "p.*")


_STATE = """
    SELECT token, count(*) FILTER (code = 5) AS emitted,
      coalesce(max(n) FILTER (stage = 'pre'), 0) AS pre, coalesce(max(n) FILTER (stage = 'tl'), 0) AS tl, coalesce(max(n) FILTER (stage = 'tl-done'), 0) AS tl_done,
      coalesce(max(total) FILTER (stage IN ('tl', 'tl-done')), 0) AS batches,
      CASE WHEN max(seq) FILTER (code IN (3, 4)) = max(seq) FILTER (code = 3) THEN max_by(TRY_CAST(payload AS INT), seq) FILTER (code = 3) END AS queue_pos,
      coalesce(bool_or(code = 4), false) AS dispatched, min_by(CASE WHEN code = 0 THEN 'done' ELSE 'failed' END, seq) FILTER (code IN (0, 2)) AS terminal
    FROM (SELECT *, CASE WHEN code = 1 THEN regexp_extract(payload, '^gallery-(pre|tl|tl-done):', 1) END AS stage,
                 TRY_CAST(regexp_extract(payload, ':(\\d+)/', 1) AS INT) AS n, TRY_CAST(regexp_extract(payload, '/(\\d+)$', 1) AS INT) AS total FROM frames_fx) q
    GROUP BY token"""


@_add("job_state", _STATE, "frames_fx")
def job_state(spark, sf_dir):
    return J.job_state(table(spark, sf_dir, "frames_fx"))


@_add(
    "poll_since",
    """SELECT token, seq, cursor FROM (SELECT token, seq, row_number() OVER (PARTITION BY token ORDER BY seq) AS cursor, count(*) OVER (PARTITION BY token) AS n FROM frames_fx) q
       WHERE cursor > least(greatest(length(token) % 5 - 1, 0), n)""",
    "frames_fx",
)
def poll_since(spark, sf_dir):
    f = table(spark, sf_dir, "frames_fx")
    return J.poll_since(f, f.select("token").distinct().withColumn("cursor", F.length("token") % 5 - 1))


@_add("abandoned_jobs", """SELECT token, min(ts) AS last_poll FROM (SELECT token, ts, coalesce(lead(ts) OVER (PARTITION BY token ORDER BY ts), (SELECT max(ts) FROM frames_fx)) AS nxt FROM frames_fx) q
       WHERE epoch_us(nxt) - epoch_us(ts) > 40000000 GROUP BY token""", "frames_fx")  # fmt: skip
def abandoned_jobs(spark, sf_dir):
    """As seen at the last frame of all."""
    polls = table(spark, sf_dir, "frames_fx").select("token", F.col("ts").cast("timestamp").alias("ts"))
    now = F.lit(polls.agg(F.max("ts")).first()[0])
    return J.abandoned(polls, 40, now).withColumn("last_poll", F.col("last_poll").cast("timestamp_ntz"))


@_add(
    "retention",
    """WITH j AS (SELECT token, max(ts) FILTER (code IN (0, 2) AND seq % 2 = 0) AS done_at, bool_or(code IN (0, 2)) AS ended, max(ts) AS last_poll FROM frames_fx GROUP BY token)
       SELECT token FROM j WHERE ended AND epoch_us((SELECT max(ts) FROM frames_fx)) - coalesce(epoch_us(done_at), epoch_us(last_poll)) > 120000000""",
    "frames_fx",
)
def retention(spark, sf_dir):
    """Ends with an odd number carry no time, so the last poll counts for some jobs."""
    f = table(spark, sf_dir, "frames_fx").select("token", "seq", "code", F.col("ts").cast("timestamp").alias("ts"))
    ended = F.col("code").isin(0, 2)
    jobs = f.groupBy("token").agg(F.max(F.when(ended & (F.col("seq") % 2 == 0), F.col("ts"))).alias("done_at"), F.bool_or(ended).alias("ended"), F.max("ts").alias("last_poll")).where("ended")
    now = f.agg(F.max("ts")).first()[0]
    return J.retention(jobs, F.lit(now), 120).select("token")


@_add(
    "upload_assembly",
    """WITH last AS (SELECT token, part, max_by(pages, ts) AS pages, max(parts) AS parts FROM uploads_fx GROUP BY token, part),
       a AS (SELECT token, count(*) AS have, max(parts) AS parts, CAST(sum(pages) AS BIGINT) AS pages, string_agg(CAST(pages AS VARCHAR), ',' ORDER BY part) AS layout FROM last GROUP BY token)
       SELECT token, have, pages, layout, CASE WHEN pages > 100 THEN 'rejected' WHEN have < parts THEN 'incomplete' ELSE 'complete' END AS status FROM a""",
    "uploads_fx",
)
def upload_assembly(spark, sf_dir):
    return J.upload_assembly(table(spark, sf_dir, "uploads_fx"), 100)


_ONCE = "SELECT token, idx, seq FROM (SELECT *, row_number() OVER (PARTITION BY token, idx ORDER BY seq) AS n FROM frames_fx WHERE code = 5) q WHERE n = 1"


@_add("exactly_once_pages", _ONCE, "frames_fx")
def exactly_once_pages(spark, sf_dir):
    return J.first_per_key(table(spark, sf_dir, "frames_fx").where(F.col("code") == J.PAGE), ["token", "idx"], "seq").select("token", "idx", "seq")


@_add("record_once", "SELECT token, min(seq) AS seq FROM frames_fx WHERE code IN (0, 2) GROUP BY token", "frames_fx")
def record_once(spark, sf_dir):
    return J.first_per_key(table(spark, sf_dir, "frames_fx").where(F.col("code").isin(J.RESULT, J.ERROR)), ["token"], "seq").select("token", "seq")


@_add("token_isolation", "SELECT seq, token FROM frames_fx WHERE token IN (SELECT token FROM frames_fx WHERE code = 4)", "frames_fx")
def token_isolation(spark, sf_dir):
    f = table(spark, sf_dir, "frames_fx")
    return f.join(f.where(F.col("code") == J.DISPATCHED).select("token").distinct(), "token", "left_semi").select("seq", "token")


@_add("admission", """SELECT req_id, CASE WHEN pages > 150 THEN 413 ELSE 200 END AS status FROM requests_fx""", "requests_fx")
def admission(spark, sf_dir):
    return table(spark, sf_dir, "requests_fx").select("req_id", F.when(F.col("pages") > 150, 413).otherwise(200).alias("status"))


@_add(
    "admission_hourly",
    """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY moment, req_id) AS n FROM bursts_fx),
       s AS (SELECT DISTINCT ip, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS held, CAST(NULL AS BIGINT) AS req_id, false AS admitted FROM bursts_fx
             UNION ALL
             SELECT ip, n, CASE WHEN len(h) < 12 THEN list_append(h, moment) ELSE h END, req_id, len(h) < 12
             FROM (SELECT r.ip, r.n, r.moment, r.req_id, [x for x in s.held if r.moment - x <= 3600000000] AS h FROM s JOIN r ON r.ip = s.ip AND r.n = s.n + 1) q)
       SELECT req_id, ip, admitted FROM s WHERE n > 0""",
    "bursts_fx",
)
def admission_hourly(spark, sf_dir):
    return J.admission(table(spark, sf_dir, "bursts_fx"), "ip", "moment", "req_id", 12, 3_600_000_000).select("req_id", "ip", "admitted")


#: After all times of the derived tables: what is open then comes to its end.
CLOSING = 2_000_000_000_000_000

_UPLOADS = """WITH RECURSIVE r AS (SELECT token, part, pages, moment, row_number() OVER (PARTITION BY token ORDER BY moment, part) AS n FROM timed_uploads_fx
           UNION ALL SELECT token, NULL, NULL, 2000000000000001, count(*) + 1 FROM timed_uploads_fx GROUP BY token),
    s AS (SELECT DISTINCT token, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS created, [CAST(NULL AS BIGINT), NULL, NULL, NULL] AS got, CAST(0 AS BIGINT) AS known,
                 CAST(NULL AS STRUCT(created BIGINT, ended_at BIGINT, got BIGINT[], status VARCHAR)) AS before, CAST(NULL AS STRUCT(created BIGINT, ended_at BIGINT, got BIGINT[], status VARCHAR)) AS out FROM timed_uploads_fx
          UNION ALL
          SELECT token, n, CASE WHEN status IS NULL THEN created END, CASE WHEN status IS NULL THEN got ELSE [NULL, NULL, NULL, NULL] END,
                 CASE WHEN status = 'complete' THEN moment + 120000000 ELSE known END, before, CASE WHEN status IS NOT NULL THEN {'created': created, 'ended_at': moment, 'got': got, 'status': status} END
          FROM (SELECT *, CASE WHEN idle THEN NULL WHEN list_sum(got) > 100 THEN 'rejected' WHEN len([x for x in got if x IS NOT NULL]) >= 4 THEN 'complete' END AS status
            FROM (SELECT token, n, moment, known, before, idle, CASE WHEN idle THEN created ELSE coalesce(created, moment) END AS created,
                         CASE WHEN idle THEN got ELSE [CASE WHEN part = i THEN pages ELSE got[i + 1] END for i in [0, 1, 2, 3]] END AS got
              FROM (SELECT *, part IS NULL OR known > 0 AS idle
                FROM (SELECT r.token, r.n, r.part, CAST(r.pages AS BIGINT) AS pages, r.moment, CASE WHEN s.known < r.moment THEN 0 ELSE s.known END AS known,
                             CASE WHEN r.moment > s.created + 300000000 THEN NULL ELSE s.created END AS created,
                             CASE WHEN r.moment > s.created + 300000000 THEN [NULL, NULL, NULL, NULL] ELSE s.got END AS got,
                             CASE WHEN r.moment > s.created + 300000000 THEN {'created': s.created, 'ended_at': s.created + 300000000, 'got': s.got, 'status': 'dropped'} END AS before
                      FROM s JOIN r ON r.token = s.token AND r.n = s.n + 1) q1) q2) q3) q4),
    o AS (SELECT token, before AS o FROM s WHERE before IS NOT NULL UNION ALL SELECT token, out FROM s WHERE out IS NOT NULL)
    SELECT token, o.created AS created, o.ended_at AS ended_at, CAST(len([x for x in o.got if x IS NOT NULL]) AS INT) AS have, CAST(list_sum(o.got) AS BIGINT) AS pages,
           array_to_string([CAST(x AS VARCHAR) for x in o.got if x IS NOT NULL], ',') AS layout, o.status AS status FROM o"""


@_add("upload_expiry", _UPLOADS, "timed_uploads_fx")
def upload_expiry(spark, sf_dir):
    """Uploads rejected at the part that passes 100 pages, dropped 300 s after their first part; complete ones are known for 120 s."""
    parts = table(spark, sf_dir, "timed_uploads_fx").drop("arrival").withColumnRenamed("moment", "at")
    return J.uploads(parts, 100, 300_000_000, 120_000_000, CLOSING)


_LIFECYCLE = """WITH RECURSIVE r AS (SELECT token, kind, moment, done_at, row_number() OVER (PARTITION BY token ORDER BY moment, seq) AS n FROM job_events_fx
           UNION ALL SELECT token, 'end', 2000000000000001, NULL, count(*) + 1 FROM job_events_fx GROUP BY token),
    s AS (SELECT DISTINCT token, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS started, CAST(NULL AS BIGINT) AS last_poll, CAST(NULL AS BIGINT) AS done_at,
                 CAST(NULL AS STRUCT(status VARCHAR, started BIGINT, last_poll BIGINT, done_at BIGINT, gone_at BIGINT)) AS gone FROM job_events_fx
          UNION ALL
          SELECT token, n, CASE WHEN status IS NULL AND kind = 'start' THEN 'running' WHEN status = 'running' AND kind IN ('done', 'failed') THEN kind ELSE status END,
                 CASE WHEN status IS NULL AND kind = 'start' THEN moment ELSE started END, CASE WHEN kind = 'start' OR kind = 'poll' AND status IS NOT NULL THEN moment ELSE last_poll END,
                 CASE WHEN status = 'running' AND kind IN ('done', 'failed') THEN end_at ELSE done_at END, gone
          FROM (SELECT token, n, kind, moment, end_at, CASE WHEN NOT over THEN status END AS status, CASE WHEN NOT over THEN started END AS started, CASE WHEN NOT over THEN last_poll END AS last_poll,
                       CASE WHEN NOT over THEN done_at END AS done_at,
                       CASE WHEN over THEN {'status': status, 'started': started, 'last_poll': last_poll, 'done_at': done_at, 'gone_at': coalesce(done_at, last_poll) + 120000000} END AS gone
            FROM (SELECT *, coalesce(status <> 'running' AND moment > coalesce(done_at, last_poll) + 120000000, false) AS over
              FROM (SELECT r.token, r.n, r.kind, r.moment, r.done_at AS end_at, s.started, s.last_poll,
                           CASE WHEN s.status = 'running' AND r.moment > s.last_poll + 40000000 THEN 'cancelled' ELSE s.status END AS status,
                           CASE WHEN s.status = 'running' AND r.moment > s.last_poll + 40000000 THEN s.last_poll + 40000000 ELSE s.done_at END AS done_at
                    FROM s JOIN r ON r.token = s.token AND r.n = s.n + 1) q1) q2) q3)
    SELECT token, gone.status AS status, gone.started AS started, gone.last_poll AS last_poll, gone.done_at AS done_at, gone.gone_at AS gone_at FROM s WHERE gone IS NOT NULL"""


@_add("job_lifecycle", _LIFECYCLE, "job_events_fx")
def job_lifecycle(spark, sf_dir):
    """Jobs cancelled 40 s after their last poll, forgotten 120 s after their end."""
    return J.lifecycle(table(spark, sf_dir, "job_events_fx").drop("arrival").withColumnRenamed("moment", "at"), 40_000_000, 120_000_000, CLOSING)


_DECIDE = """WITH r AS (SELECT req_id, ip, epoch_us(ts) AS t, pages FROM requests_fx), j AS (SELECT ip, t AS a, t + CAST(pages AS BIGINT) * 15000000 AS b FROM r WHERE req_id % 3 <> 0 AND pages <= 150),
    m AS (SELECT ip, a AS t, 1 AS d, NULL AS req_id, 0 AS pages FROM j UNION ALL SELECT ip, b, -1, NULL, 0 FROM j UNION ALL SELECT ip, t, 0, req_id, pages FROM r),
    w AS (SELECT *, sum(d) OVER (ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live, sum(d) OVER (PARTITION BY ip ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own,
            count(*) FILTER (d > 0) OVER (PARTITION BY ip ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS starts FROM m)
    SELECT req_id, CASE WHEN pages > 150 THEN 413 WHEN live >= 8 THEN 503 WHEN own >= 2 OR starts >= 2 THEN 429 ELSE 200 END AS status FROM w WHERE req_id IS NOT NULL"""


@_add("admission_decision", _DECIDE, "requests_fx")
def admission_decision(spark, sf_dir):
    """Two requests in three were admitted and run for a quarter of a minute a page; two starts an hour, since the events are sparse."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    requests = table(spark, sf_dir, "requests_fx").select("req_id", "ip", at.alias("at"), "pages")
    run = requests.where("req_id % 3 <> 0 and pages <= 150")
    jobs = run.select("ip", F.col("at").alias("start"), (F.col("at") + F.col("pages").cast("long") * 15_000_000).alias("end"))
    return J.admission_decision(requests, jobs, hourly=2).select("req_id", "status")


_SERVER = """WITH RECURSIVE r AS (SELECT *, floor((moment - 1704067200000000) / 25000000000) AS burst FROM bursty_requests_fx),
    o AS (SELECT *, row_number() OVER (PARTITION BY burst ORDER BY moment, req_id) AS n FROM r),
    s AS (SELECT DISTINCT burst, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(ip BIGINT, a BIGINT, b BIGINT)[]) AS jobs, CAST(NULL AS BIGINT) AS req_id, 0 AS status FROM o
          UNION ALL
          SELECT burst, n, CASE WHEN status = 200 THEN list_append(kept, {'ip': ip, 'a': moment, 'b': ends}) ELSE kept END, req_id, status
          FROM (SELECT *, CASE WHEN pages > 150 THEN 413 WHEN len([j for j in kept if j.b > moment]) >= 8 THEN 503
                               WHEN len([j for j in kept if j.ip = q.ip AND j.b > moment]) >= 2 OR len([j for j in kept if j.ip = q.ip AND moment - j.a <= 3600000000]) >= 12 THEN 429 ELSE 200 END AS status
                FROM (SELECT o.*, [j for j in s.jobs if j.b > o.moment OR o.moment - j.a <= 3600000000] AS kept FROM s JOIN o ON o.burst = s.burst AND o.n = s.n + 1) q) q2)
    SELECT req_id, status FROM s WHERE n > 0"""


@_add("admission_server", _SERVER, "bursty_requests_fx")
def admission_server(spark, sf_dir):
    """Every decision rests on the jobs admitted before. Bursts of four hours with three hours between them, which the SQL counts from one by one."""
    return J.admission_server(table(spark, sf_dir, "bursty_requests_fx").withColumnRenamed("moment", "at")).select("req_id", "status")


_LIVE = """WITH m AS (SELECT owner, ts, sum(d) AS d FROM (SELECT ip AS owner, epoch_us(ts) AS ts, 1 AS d FROM requests_fx UNION ALL SELECT ip, epoch_us(ts) + CAST(pages AS BIGINT) * 60000000, -1 FROM requests_fx) a GROUP BY owner, ts),
    e AS (SELECT ts, CAST(sum(d) OVER (ORDER BY ts) AS BIGINT) AS live_all FROM (SELECT ts, sum(d) AS d FROM m GROUP BY ts) b)
    SELECT owner, m.ts, CAST(sum(d) OVER (PARTITION BY owner ORDER BY m.ts) AS BIGINT) AS live, live_all FROM m JOIN e ON m.ts = e.ts"""


@_add("concurrency_profile", _LIVE, "requests_fx")
def concurrency_profile(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    r = table(spark, sf_dir, "requests_fx").select("ip", start.alias("a"), (start + F.col("pages").cast("long") * 60_000_000).alias("b"))
    return J.concurrency_profile(r, "ip", "a", "b")


@_add("throttle_latest", None)
def throttle_latest(spark, sf_dir):
    f = table(spark, sf_dir, "frames_fx").select("token", "seq", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return J.throttle_latest(f, "token", "at", "seq", 600.0).select("token", "seq", "sent_at")


@_add(
    "stall_counter",
    """SELECT token, seq, CAST(sum(CAST(code <> 5 AS INT)) OVER (PARTITION BY token, g ORDER BY seq) AS BIGINT) AS stalls
       FROM (SELECT *, sum(CAST(code = 5 AS INT)) OVER (PARTITION BY token ORDER BY seq) AS g FROM frames_fx) q""",
    "frames_fx",
)
def stall_counter(spark, sf_dir):
    f = table(spark, sf_dir, "frames_fx").withColumn("progress", (F.col("code") == J.PAGE).cast("int"))
    return J.stall_counter(f, "token", "seq", "progress").select("token", "seq", "stalls")


@_add(
    "tumbling_metrics",
    """SELECT CAST(ts AS DATE) AS day, count(DISTINCT token) AS jobs, count(*) FILTER (code = 5) AS pages, count(*) FILTER (code = 2) AS failures FROM frames_fx GROUP BY 1""",
    "frames_fx",
)
def tumbling_metrics(spark, sf_dir):
    f = table(spark, sf_dir, "frames_fx").withColumn("day", F.to_date("ts"))
    return f.groupBy("day").agg(F.countDistinct("token").alias("jobs"), F.count_if(F.col("code") == 5).alias("pages"), F.count_if(F.col("code") == 2).alias("failures"))


@_add(
    "undelivered_ranges",
    """WITH p AS (SELECT chunk_id, end_page, unnest(generate_series(start_page, end_page - 1)) AS page FROM chunks_fx)
       SELECT chunk_id, min(page) AS from_page, end_page FROM p WHERE page NOT IN (SELECT page FROM delivered_fx) AND page % 50 <> 7 GROUP BY chunk_id, end_page""",
    "chunks_fx",
    "delivered_fx",
)
def undelivered_ranges(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks_fx")
    failed = chunks.select(F.explode(F.sequence("start_page", F.col("end_page") - 1)).alias("page")).where("page % 50 = 7")
    return J.undelivered_ranges(chunks, table(spark, sf_dir, "delivered_fx"), failed)


@_add(
    "page_offset_rewrite",
    """SELECT seq, idx + (seq // 16) * 16 AS page, CASE WHEN payload LIKE 'gallery-%' THEN regexp_extract(payload, '^(.*:)', 1) || (CAST(regexp_extract(payload, ':(\\d+)/', 1) AS BIGINT) + (seq // 16) * 16) || '/' || 4000 ELSE payload END AS payload
       FROM frames_fx""",
    "frames_fx",
)
def page_offset_rewrite(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks_fx").select("chunk_id", "start_page")
    f = table(spark, sf_dir, "frames_fx").withColumn("chunk_id", F.floor(F.col("seq") / 16)).join(chunks, "chunk_id")
    done = F.regexp_extract("payload", r":(\d+)/", 1)
    moved = F.concat(F.regexp_extract("payload", "^(.*:)", 1), (F.nullif(done, F.lit("")).cast("long") + F.col("start_page")).cast("string"), F.lit("/4000"))
    return f.select("seq", (F.col("idx") + F.col("start_page")).alias("page"), F.when(F.col("payload").startswith("gallery-"), moved).otherwise(F.col("payload")).alias("payload"))


@_add(
    "job_telemetry",
    """SELECT token, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, max(wall_s) AS slowest, bool_or(stage = 'error') AS any_error,
       round(sum(wall_s * completion_tokens) / sum(wall_s), 6) AS gauge FROM calls_fx GROUP BY token""",
    "calls_fx",
)
def job_telemetry(spark, sf_dir):
    """Chunks folded to jobs: sums, maxima, any error, and a gauge averaged by wall time."""
    w = F.col("wall_s")
    return table(spark, sf_dir, "calls_fx").groupBy("token").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.max("wall_s").alias("slowest"), F.bool_or(F.col("stage") == "error").alias("any_error"),
        F.round(F.sum(w * F.col("completion_tokens")) / F.sum(w), 6).alias("gauge"),
    )


@_add(
    "map_sum",
    """SELECT token, key, round(sum(v), 6) AS total FROM (SELECT token, stage AS key, wall_s AS v FROM calls_fx UNION ALL SELECT token, 'all', wall_s FROM calls_fx) q GROUP BY token, key""",
    "calls_fx",
)
def map_sum(spark, sf_dir):
    """Maps summed by key, shown as rows; keys in order of their value, largest first."""
    maps = table(spark, sf_dir, "calls_fx").select("token", F.create_map("stage", "wall_s", F.lit("all"), "wall_s").alias("m"))
    sums = maps.select("token", F.explode("m").alias("key", "v")).groupBy("token", "key").agg(F.round(F.sum("v"), 6).alias("total"))
    ordered = sums.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("total", "key")), asc=False).alias("r"))
    return ordered.select("token", F.explode(F.map_from_entries(F.transform("r", lambda x: F.struct(x["key"], x["total"])))).alias("key", "total"))


@_add(
    "job_summary",
    """SELECT token, round(CASE WHEN wall > 0 THEN n / wall ELSE 0 END, 6) AS pages_per_s, round(CASE WHEN n > 0 THEN wall / n ELSE 0 END, 6) AS s_per_page,
       round(CASE WHEN top > 0 THEN wall / top ELSE 0 END, 6) AS overlap, round(CASE WHEN prompt > 0 THEN 100.0 * hit / prompt ELSE 0 END, 6) AS cache_hit_pct
       FROM (SELECT token, count(*) AS n, sum(wall_s) AS wall, max(wall_s) AS top, sum(cache_hit) AS hit, sum(prompt_tokens) AS prompt FROM calls_fx GROUP BY token) q""",
    "calls_fx",
)
def job_summary(spark, sf_dir):
    j = table(spark, sf_dir, "calls_fx").groupBy("token").agg(
        F.count("*").alias("n"), F.sum("wall_s").alias("wall"), F.max("wall_s").alias("top"), F.sum("cache_hit").alias("hit"), F.sum("prompt_tokens").alias("prompt")
    )
    c = F.col
    return j.select(
        "token", F.round(J.ratio(c("n"), c("wall")), 6).alias("pages_per_s"), F.round(J.ratio(c("wall"), c("n")), 6).alias("s_per_page"),
        F.round(J.ratio(c("wall"), c("top")), 6).alias("overlap"), F.round(J.ratio(c("hit"), c("prompt"), 100.0), 6).alias("cache_hit_pct"),
    )


@_add(
    "daily_counters",
    """SELECT CAST(ts AS DATE) AS day, count(*) AS calls, count(*) FILTER (stage = 'error') AS failed, CAST(sum(prompt_tokens) AS BIGINT) AS tokens, round(sum(wall_s), 6) AS compute_s FROM calls_fx GROUP BY 1""",
    "calls_fx",
)
def daily_counters(spark, sf_dir):
    return table(spark, sf_dir, "calls_fx").groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("stage") == "error").alias("failed"), F.sum("prompt_tokens").alias("tokens"), F.round(F.sum("wall_s"), 6).alias("compute_s")
    )


@_add(
    "llm_cost",
    """SELECT token, count(*) AS requests, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, round(sum(cache_hit * 0.07 + cache_miss * 0.27 + completion_tokens * 1.10) / 1e6, 12) AS cost, max(wall_s) AS slowest
       FROM calls_fx GROUP BY token""",
    "calls_fx",
)
def llm_cost(spark, sf_dir):
    price = F.col("cache_hit") * 0.07 + F.col("cache_miss") * 0.27 + F.col("completion_tokens") * 1.10
    return table(spark, sf_dir, "calls_fx").groupBy("token").agg(
        F.count("*").alias("requests"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.round(F.sum(price) / 1e6, 12).alias("cost"), F.max("wall_s").alias("slowest")
    )


@_add(
    "queue_snapshot",
    """SELECT live, least(live, 3) AS active, greatest(live - 3, 0) AS waiting, pending FROM (SELECT count(DISTINCT token) AS live, count(*) FILTER (code = 3) AS pending FROM frames_fx) q""",
    "frames_fx",
)
def queue_snapshot(spark, sf_dir):
    q = table(spark, sf_dir, "frames_fx").agg(F.countDistinct("token").alias("live"), F.count_if(F.col("code") == J.QUEUE).alias("pending"))
    return q.select("live", F.least("live", F.lit(3)).alias("active"), F.greatest(F.col("live") - 3, F.lit(0)).alias("waiting"), "pending")


@_add(
    "waiting_position",
    "SELECT ip, req_id, greatest(row_number() OVER (PARTITION BY ip, CAST(ts AS DATE) ORDER BY ts, req_id) - 3, 0) AS pos FROM requests_fx",
    "requests_fx",
)
def waiting_position(spark, sf_dir):
    w = Window.partitionBy("ip", F.to_date("ts")).orderBy("ts", "req_id")
    return table(spark, sf_dir, "requests_fx").select("ip", "req_id", F.greatest(F.row_number().over(w) - 3, F.lit(0)).alias("pos"))


@_add("recent_jobs", "SELECT token, call_id FROM calls_fx ORDER BY ts DESC, call_id LIMIT 20", "calls_fx")
def recent_jobs(spark, sf_dir):
    """The last 20: a top-k report."""
    return table(spark, sf_dir, "calls_fx").orderBy(F.desc("ts"), "call_id").limit(20).select("token", "call_id")


@_add(
    "spacing_schedule",
    """SELECT token, call_id, round(i * 30.0 + max(t - i * 30.0) OVER (PARTITION BY token ORDER BY t, call_id), 6) AS start
       FROM (SELECT token, call_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY token ORDER BY ts, call_id) AS i FROM calls_fx) q""",
    "calls_fx",
)
def spacing_schedule(spark, sf_dir):
    c = table(spark, sf_dir, "calls_fx").select("token", "call_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return J.spacing_schedule(c, "token", "t", "call_id", 30.0).select("token", "call_id", F.round("start", 6).alias("start"))


def redact(df, full: bool, secret: tuple[str, ...]):
    """Without the privileged columns unless the caller sees everything."""
    return df if full else df.drop(*secret)


@_add("redact", "SELECT token, call_id, wall_s, stage FROM calls_fx", "calls_fx")
def redact_query(spark, sf_dir):
    return redact(table(spark, sf_dir, "calls_fx").drop("ts", "completion_tokens"), False, ("prompt_tokens", "cache_hit", "cache_miss"))


@_add("job_log", "SELECT token, call_id, prompt_tokens, wall_s FROM calls_fx", "calls_fx")
def job_log(spark, sf_dir):
    """Records written as JSON lines and read back with their schema."""
    c = table(spark, sf_dir, "calls_fx").select("token", "call_id", "prompt_tokens", "wall_s")
    path = scratch_path(spark, "job-log")
    write_job_log(c, path)
    return read_job_log(spark, path, "token string, call_id bigint, prompt_tokens bigint, wall_s double")


@_add(
    "ip_allow",
    """SELECT req_id FROM (SELECT req_id, CAST(10 * 16777216 + ip * 65536 + req_id % 65536 AS BIGINT) AS a FROM requests_fx) q
       WHERE a BETWEEN 167837696 AND 167903231 OR a BETWEEN 167903232 AND 167903487 OR a = 167772161""",
    "requests_fx",
)
def ip_allow(spark, sf_dir):
    """Addresses in any of a few nets, as a broadcast range semi-join."""
    nets = cidr_ranges(spark, ["10.1.0.0/16", "10.2.0.0/24", "10.0.0.1"])
    r = table(spark, sf_dir, "requests_fx").select("req_id", (F.lit(10 << 24) + F.col("ip") * 65536 + F.col("req_id") % 65536).alias("addr"))
    return r.join(F.broadcast(nets), F.col("addr").between(F.col("lo"), F.col("hi")), "left_semi").select("req_id")


def cidr_ranges(spark, nets: list[str]):
    """(lo, hi) of each net of a configured list."""
    import ipaddress

    spans = [(int(n.network_address), int(n.broadcast_address)) for n in (ipaddress.ip_network(x, strict=False) for x in nets)]
    return spark.createDataFrame(spans, "lo bigint, hi bigint")


@_add(
    "key_resolve",
    "SELECT req_id, CASE ip WHEN 0 THEN 'alice' WHEN 1 THEN 'bob' END AS name FROM requests_fx",
    "requests_fx",
)
def key_resolve(spark, sf_dir):
    """Secrets to names by their digest; the secret itself goes."""
    keys = spark.createDataFrame([("alice", "secret-0"), ("bob", "secret-1")], "name string, secret string").select("name", F.sha2("secret", 256).alias("digest"))
    r = table(spark, sf_dir, "requests_fx").select("req_id", F.sha2(F.concat(F.lit("secret-"), F.col("ip").cast("string")), 256).alias("digest"))
    return r.join(F.broadcast(keys), "digest", "left").select("req_id", "name")
