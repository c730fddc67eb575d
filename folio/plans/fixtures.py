"""Tables of lines, pairs, frames, calls and uploads derived from the given tables, once as SQL for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "lines_fx": """
        SELECT CAST(floor(o_orderkey/27) AS BIGINT) AS page_id, o_orderkey AS line_id,
               x1, y1, x1+w AS x2, y1+h AS y2, CAST((50+o_custkey%50) AS DOUBLE)/100 AS prob,
               CAST((o_custkey*17)%256 AS INT) AS fg_r, CAST((o_custkey*29)%256 AS INT) AS fg_g, CAST((o_custkey*43)%256 AS INT) AS fg_b,
               o_orderpriority AS text
        FROM (SELECT *, CAST((c%3)*330 + p*(w0+2+o_custkey%14) AS INT) AS x1, CAST(floor(c/3)*330 + (o_custkey%5)*4 AS INT) AS y1,
                     CAST(w0 AS INT) AS w, CAST(90+(o_orderkey*31)%60 AS INT) AS h
              FROM (SELECT *, CAST(floor((o_orderkey%27)/3) AS BIGINT) AS c, o_orderkey%3 AS p, 20+o_custkey%6 AS w0 FROM orders) a) b""",
    "frames_fx": """
        SELECT 'u' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS token, event_id AS seq, ts,
               CASE WHEN event_id%11=0 THEN 0 WHEN event_id%17=0 THEN 2 WHEN event_type='view' THEN 1 WHEN event_type IN ('click','purchase') THEN 5
                    WHEN event_type='signup' THEN 4 ELSE 3 END AS code,
               CAST(event_id%9 AS INT) AS idx,
               CASE WHEN event_id%11=0 OR event_id%17=0 THEN ''
                    WHEN event_type='view' THEN CASE event_id%3 WHEN 0 THEN 'gallery-pre:' WHEN 1 THEN 'gallery-tl:' ELSE 'gallery-tl-done:' END || CAST(event_id%40 AS STRING) || '/40'
                    WHEN event_type='error' THEN CAST(event_id%6 AS STRING) ELSE '' END AS payload
        FROM events""",
    "pairs_fx": """
        SELECT conv_id, turn AS pos, text AS src,
               CASE (conv_id*8+turn)%8 WHEN 0 THEN '' WHEN 1 THEN text || '  ' WHEN 2 THEN repeat('ha ', 30) WHEN 3 THEN '12345'
                    WHEN 4 THEN 'a' || repeat('!', 25) WHEN 5 THEN '[' || text || ']' WHEN 6 THEN '"' || text || '"'
                    ELSE 'fine: ' || text END AS dst
        FROM conversations""",
    "uploads_fx": """
        SELECT CAST(floor(o_orderkey/4) AS BIGINT) AS token, CAST(o_orderkey%4 AS INT) AS part, 4 AS parts,
               CAST(1+o_custkey%40 AS INT) AS pages, o_orderdate AS ts
        FROM orders WHERE o_orderkey%13 <> 0""",
    "requests_fx": "SELECT event_id AS req_id, user_id AS ip, ts, CAST(event_id%160 AS INT) AS pages FROM events",
    "calls_fx": """
        SELECT 'u' || CAST(user_id AS STRING) AS token, event_id AS call_id, CAST(floor(value*10) AS BIGINT) AS prompt_tokens,
               CAST(floor(value*10) AS BIGINT) - CAST(floor(value*4) AS BIGINT) AS cache_miss, CAST(floor(value*4) AS BIGINT) AS cache_hit,
               CAST(floor(value*3) AS BIGINT) AS completion_tokens, value/50 AS wall_s, ts, event_type AS stage
        FROM events""",
    "chunks_fx": """
        SELECT page_range AS chunk_id, page_range*16 AS start_page, page_range*16+16 AS end_page
        FROM (SELECT DISTINCT CAST(floor(event_id/16) AS BIGINT) AS page_range FROM events) a""",
    "delivered_fx": "SELECT event_id AS page FROM events WHERE event_id%16 < 4 + CAST(floor(event_id/16) AS BIGINT)%13",
    "timed_uploads_fx": """
        SELECT 'g' || CAST(CAST(floor(o_orderkey/4) AS BIGINT) AS STRING) AS token, CAST(o_orderkey%4 AS INT) AS part, 4 AS parts,
               CAST(1+o_custkey%40 AS INT) AS pages, 1704067200000000 + CAST(floor(o_orderkey/4) AS BIGINT)*7000000 + ((o_custkey*37)%420)*1000000 AS moment,
               1704067200000000 + CAST(floor(o_orderkey/4) AS BIGINT)*7000000 + ((o_custkey*37)%420 + o_orderkey%90)*1000000 AS arrival
        FROM orders WHERE o_orderkey%13 <> 0
        UNION ALL
        SELECT 'g' || CAST(CAST(floor(o_orderkey/4) AS BIGINT) AS STRING), CAST(o_orderkey%4 AS INT), 4, CAST(1+o_custkey%30 AS INT),
               1704067200000000 + CAST(floor(o_orderkey/4) AS BIGINT)*7000000 + ((o_custkey*37)%420 + 30 + o_custkey%50)*1000000,
               1704067200000000 + CAST(floor(o_orderkey/4) AS BIGINT)*7000000 + ((o_custkey*37)%420 + 30 + o_custkey%50 + o_orderkey%90)*1000000
        FROM orders WHERE o_orderkey%5 = 0""",
    "job_events_fx": """
        SELECT 'j' || CAST(job AS STRING) AS token, seq, kind, moment, CASE WHEN kind IN ('done', 'failed') AND job%4 <> 0 THEN moment END AS done_at,
               moment + (user_id%20)*1000000 AS arrival
        FROM (SELECT job, event_id AS seq, user_id,
                     CASE WHEN step=0 OR (step=11 AND job%11=0) THEN 'start' WHEN step=9 AND job%3=1 THEN 'done' WHEN step=9 AND job%3=2 THEN 'failed' ELSE 'poll' END AS kind,
                     1704067200000000 + job*15000000 + step*(5+job%9)*1000000 + CASE WHEN job%5=0 AND step>=7 THEN 60000000 ELSE 0 END + CASE WHEN job%11=0 AND step=11 THEN 400000000 ELSE 0 END AS moment
              FROM (SELECT *, CAST(floor(event_id/12) AS BIGINT) AS job, event_id%12 AS step FROM events) a) b""",
    "bursts_fx": "SELECT event_id AS req_id, user_id AS ip, 1704067200000000 + (event_id%9973)*600000 AS moment FROM events",
    "bursty_requests_fx": """
        SELECT req_id, ip, moment, pages, moment + CAST(pages AS BIGINT)*(2+req_id%3)*1000000 AS ends
        FROM (SELECT event_id AS req_id, user_id%10 AS ip, CAST(event_id%160 AS INT) AS pages,
                     1704067200000000 + CAST(floor(event_id/700) AS BIGINT)*25000000000 + (event_id%700)*20000000 AS moment FROM events) a""",
    "late_calls_fx": """
        SELECT event_id AS call_id, event_type AS stage, moment, moment + CASE WHEN event_id%97=0 THEN 518400000000 ELSE (event_id%50)*60000000 END AS arrival
        FROM (SELECT *, 1704067200000000 + (event_id%9973)*259000000 AS moment FROM events) a""",
    "panels_fx": """
        SELECT page_id, CAST(page_id*9 + c AS BIGINT) AS panel_id, CAST(min(x1) AS INT) AS x1, CAST(min(y1) AS INT) AS y1,
               CAST(max(x2) AS INT) AS x2, CAST(max(y2) AS INT) AS y2
        FROM (SELECT *, CAST(floor((line_id%27)/3) AS BIGINT) AS c FROM lines_fx) l GROUP BY page_id, c""",
}


def sql_with(names: str | list[str], body: str) -> str:
    """An oracle statement over derived tables: their definitions as CTEs in front of it."""
    wanted = [names] if isinstance(names, str) else list(names)
    if "panels_fx" in wanted and "lines_fx" not in wanted:
        wanted.insert(0, "lines_fx")
    ctes = ", ".join(f"{n} AS ({TABLES[n]})" for n in sorted(wanted, key=list(TABLES).index))
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived one as a lazy plan over the given tables."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sources = set(re.findall(r"FROM\s+(\w+)", TABLES[name])) - {"SELECT"}
    frames = {s: table(spark, sf_dir, s) for s in sources}
    body = TABLES[name]
    for s in sources:
        body = re.sub(rf"FROM\s+{s}\b", f"FROM {{{s}}}", body)
    return spark.sql(body, **frames)
