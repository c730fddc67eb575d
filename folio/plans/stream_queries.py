"""Streams over derived tables, replayed in several micro-batches; their SQL is that of the batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.plans import job_queries
from folio.plans.fixtures import sql_with, table
from folio.streaming import jobs as S

QUERIES: dict[str, tuple] = {}


def _add(name: str, sql: str | None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


SLICES = 6


def _replayed(spark, sf_dir, name: str, slices: int = SLICES):
    """A derived table in order of arrival, and then one row that moves the watermark past all; its other columns are null."""
    rows = table(spark, sf_dir, name).withColumnRenamed("moment", "at")
    if "at" not in rows.columns:
        rows = rows.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("ts", F.col("ts").cast("timestamp"))
    if "arrival" not in rows.columns:
        rows = rows.withColumn("arrival", F.col("at"))
    last = spark.range(1).selectExpr(*[f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in rows.schema.fields])
    last = last.withColumn("at", F.lit(job_queries.CLOSING + 3_600_000_000))
    if "ts" in rows.columns:
        last = last.withColumn("ts", F.timestamp_micros("at"))
    return S.replay(rows, "arrival", slices, last).drop("arrival")


@_add("stream_job_state", job_queries.QUERIES["job_state"][1])
def stream_job_state(spark, sf_dir):
    frames = _replayed(spark, sf_dir, "frames_fx").where("token is not null")
    return S.run_available(S.job_state(frames), "complete")


@_add("stream_exactly_once_pages", sql_with("frames_fx", "SELECT DISTINCT token, idx FROM frames_fx WHERE code = 5"))
def stream_exactly_once_pages(spark, sf_dir):
    """A page may come again within two days; after that its key is forgotten."""
    pages = S.once_per_key(_replayed(spark, sf_dir, "frames_fx"), ["token", "idx", "code"], "ts", "2 days")
    return S.run_available(pages.where("code = 5").select("token", "idx"))


@_add("stream_record_once", sql_with("frames_fx", "SELECT DISTINCT token FROM frames_fx WHERE code IN (0, 2)"))
def stream_record_once(spark, sf_dir):
    ended = _replayed(spark, sf_dir, "frames_fx").withColumn("ended", F.col("code").isin(0, 2))
    return S.run_available(S.once_per_key(ended, ["token", "ended"], "ts", "2 days").where("ended").select("token"))


_TUMBLING = """WITH p AS (SELECT *, floor((arrival - (SELECT min(arrival) FROM late_calls_fx)) * 15 / ((SELECT max(arrival) FROM late_calls_fx) - (SELECT min(arrival) FROM late_calls_fx) + 1)) AS slice FROM late_calls_fx),
    m AS (SELECT slice, max(moment) AS last FROM p GROUP BY slice),
    w AS (SELECT p.*, (SELECT max(last) FROM m WHERE m.slice <= p.slice - 2) - 7200000000 AS mark, (moment // 86400000000 + 1) * 86400000000 AS closes FROM p)
    SELECT CAST(make_timestamp(moment) AS DATE) AS day, count(*) AS calls, count(*) FILTER (stage = 'error') AS failed FROM w WHERE mark IS NULL OR closes > mark GROUP BY 1"""


@_add("stream_tumbling_metrics", sql_with("late_calls_fx", _TUMBLING))
def stream_tumbling_metrics(spark, sf_dir):
    """Counters by day in fifteen micro-batches; one call in 97 comes six days late, behind the watermark, and is not counted.

    Spark turns rows down by the watermark of the batch before, so what closes a window lies two slices back.
    """
    calls = _replayed(spark, sf_dir, "late_calls_fx", 15).withColumn("ts", F.timestamp_micros("at"))
    out = S.run_available(S.tumbling(calls, "1 day", "2 hours", F.count("*").alias("calls"), F.count_if(F.col("stage") == "error").alias("failed")))
    return out.select(F.to_date("start").alias("day"), "calls", "failed")


@_add(
    "stream_abandoned_jobs",
    sql_with(
        "frames_fx",
        """WITH g AS (SELECT token, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY token ORDER BY ts)) < 40000000 THEN 0 ELSE 1 END AS new FROM frames_fx),
        s AS (SELECT token, ts, sum(new) OVER (PARTITION BY token ORDER BY ts) AS s FROM g) SELECT token, count(*) AS polls, epoch_us(max(ts)) + 40000000 AS gone_at FROM s GROUP BY token, s""",
    ),
)
def stream_abandoned_jobs(spark, sf_dir):
    out = S.run_available(S.abandoned(_replayed(spark, sf_dir, "frames_fx"), "40 seconds", "1 hour"))
    return out.where("token is not null").select("token", "polls", F.unix_micros("w.end").alias("gone_at"))


@_add("stream_token_isolation", job_queries.QUERIES["token_isolation"][1])
def stream_token_isolation(spark, sf_dir):
    jobs = table(spark, sf_dir, "frames_fx").where("code = 4").select("token").distinct()
    return S.run_available(S.isolated(_replayed(spark, sf_dir, "frames_fx"), jobs)).select("seq", "token")


@_add("stream_admission_hourly", job_queries.QUERIES["admission_hourly"][1])
def stream_admission_hourly(spark, sf_dir):
    requests = _replayed(spark, sf_dir, "bursts_fx")
    return S.run_available(S.admission(requests, 12, 3_600_000_000, "1 minute")).select("req_id", "ip", "admitted")


@_add("stream_upload_assembly", job_queries.QUERIES["upload_expiry"][1])
def stream_upload_assembly(spark, sf_dir):
    """Six micro-batches; parts come up to 90 s late."""
    parts = _replayed(spark, sf_dir, "timed_uploads_fx")
    return S.run_available(S.uploads(parts, 100, 300_000_000, 120_000_000, "2 minutes"))


@_add("stream_job_lifecycle", job_queries.QUERIES["job_lifecycle"][1])
def stream_job_lifecycle(spark, sf_dir):
    """Six micro-batches; polls and ends of a job in one stream, up to 20 s late."""
    events = _replayed(spark, sf_dir, "job_events_fx")
    return S.run_available(S.lifecycle(events, 40_000_000, 120_000_000, "1 minute"))
