"""Queries of sources, sinks and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.plans.fixtures import sql_with, table
from folio.sources import files as S

QUERIES: dict[str, tuple] = {}


def _add(name: str, sql: str | None, *fixtures: str):
    def keep(run):
        QUERIES[name] = (run, sql_with(list(fixtures), sql) if sql and fixtures else sql)
        return run

    return keep


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))


_PATH = r"regexp_replace(url, '[?#].*$', '')"
_OUT = rf"regexp_replace(regexp_replace(regexp_replace({_PATH}, '^http', 'out'), '(\.[A-Za-z0-9]+)?$', '.png'), '(\.png)+$', '.png')"


@_add("page_manifest", f"SELECT page_id, {_PATH} AS path, {_OUT} AS output FROM pages")
def page_manifest(spark, sf_dir):
    return S.page_manifest(_pages(spark, sf_dir), "path", "http", "out", "png")


@_add(
    "natural_order",
    r"""WITH k AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(url, '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(p, 20, '0') ELSE p END), '') AS k FROM pages)
    SELECT page_id, k AS sort_key FROM k""",
)
def natural_order(spark, sf_dir):
    """The sort key; an ordered write or limit uses it."""
    return table(spark, sf_dir, "pages").select("page_id", S.natural_key(F.col("url")).alias("sort_key"))


@_add("incremental_pending", f"SELECT page_id, {_OUT} AS output FROM pages WHERE {_OUT} NOT IN (SELECT {_OUT} FROM pages WHERE page_id % 3 = 0)")
def incremental_pending(spark, sf_dir):
    manifest = page_manifest(spark, sf_dir)
    return S.incremental_pending(manifest, manifest.where("page_id % 3 = 0").select("output")).select("page_id", "output")


_RULE = "CASE conv_id % 5 WHEN 0 THEN '# ' || src WHEN 1 THEN split_part(src, ' ', 1) || ' # note' WHEN 2 THEN 'a b // c' WHEN 3 THEN 'one two three' ELSE '' END"


@_add(
    "dictionary_source",
    f"""WITH l AS (SELECT conv_id, pos, {_RULE} AS line FROM pairs_fx),
    b AS (SELECT conv_id, pos, trim(regexp_replace(regexp_replace(trim(line), '(?s)#.*$', ''), '(?s)//.*$', '')) AS t FROM l),
    p AS (SELECT conv_id, pos, regexp_split_to_array(t, '\\s+') AS a FROM b WHERE t <> '')
    SELECT conv_id, pos, a[1] AS pattern, coalesce(a[2], '') AS replacement, CASE WHEN len(a) > 2 THEN 'rejected' ELSE 'rule' END AS status FROM p""",
    "pairs_fx",
)
def dictionary_source(spark, sf_dir):
    p = table(spark, sf_dir, "pairs_fx")
    k = F.col("conv_id") % 5
    line = F.when(k == 0, F.concat(F.lit("# "), "src")).when(k == 1, F.concat(F.split_part("src", F.lit(" "), F.lit(1)), F.lit(" # note"))).when(k == 2, "a b // c").when(k == 3, "one two three").otherwise("")
    return S.parse_rules(p.select("conv_id", "pos", line.alias("value"))).drop("value")


def _glossary_lines(spark, sf_dir):
    p = table(spark, sf_dir, "pairs_fx").withColumn("w", F.regexp_extract("src", r"\p{L}+", 0))
    k = F.col("conv_id") % 4
    line = F.when(k == 0, F.concat("w", F.lit("->X"))).when(k == 1, F.concat("w", F.lit("\tY"))).when(k == 2, F.concat("w", F.when(F.col("pos") % 3 == 1, F.lit("(")).otherwise(F.lit("")), F.lit("_z Z"))).otherwise(F.concat("w", F.lit(" a b c d")))
    return p.select("conv_id", "pos", line.alias("value"))


@_add("glossary_format", "SELECT DISTINCT conv_id, CASE conv_id % 4 WHEN 0 THEN 'arrow' WHEN 1 THEN 'tab' WHEN 2 THEN 'pair' ELSE 'unknown' END AS format FROM pairs_fx", "pairs_fx")
def glossary_format(spark, sf_dir):
    return S.glossary_format(_glossary_lines(spark, sf_dir), "conv_id")


@_add(
    "glossary_source",
    r"""WITH w AS (SELECT conv_id, pos, regexp_extract(src, '\p{L}+', 0) AS w FROM pairs_fx)
    SELECT conv_id, pos, CASE WHEN conv_id % 4 = 2 THEN w || CASE WHEN pos % 3 = 1 THEN '(' ELSE '' END || ' z' ELSE w END AS term, CASE conv_id % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'Z' END AS target, CASE WHEN conv_id % 4 = 2 AND pos % 3 = 1 THEN 'rejected' ELSE 'term' END AS status FROM w WHERE conv_id % 4 <> 3 AND (w <> '' OR conv_id % 4 = 2)""",
    "pairs_fx",
)
def glossary_source(spark, sf_dir):
    lines = _glossary_lines(spark, sf_dir)
    kinds = S.glossary_format(lines, "conv_id").where("format <> 'unknown'")
    rows = lines.join(kinds, "conv_id")
    return S.parse_glossary(rows, F.col("format")).select("conv_id", "pos", "term", "target", "status")


@_add(
    "upload_validate",
    """SELECT page_id, CASE WHEN strlen(html) > 6000 AND page_id % 3 <> 2 THEN 'too large' WHEN page_id % 3 = 0 THEN 'not an image' END AS reason FROM pages""",
)
def upload_validate(spark, sf_dir):
    """Pages as uploads: as they are, with a PNG head, and with a WEBP head and 20 bytes only."""
    html = F.col("html").cast("binary")
    png = F.concat(F.unhex(F.lit("89504E47")), F.substring(html, 5, 1 << 30))
    webp = F.concat(F.unhex(F.lit("524946460000000057454250")), F.substring(html, 1, 8))
    k = F.col("page_id") % 3
    data = F.when(k == 0, html).when(k == 1, png).otherwise(webp)
    return table(spark, sf_dir, "pages").select("page_id", S.reject_reason(data, 6000).alias("reason"))


@_add("content_key", "SELECT page_id, substr(md5(html), 1, 8) AS key FROM pages")
def content_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.content_key(F.col("html").cast("binary")).alias("key"))


@_add(
    "region_export",
    """SELECT page_id, line_id, x1, y1, x2, y2, printf('#%02x%02x%02x', fg_r, fg_g, fg_b) AS color, text AS english, upper(text) AS french FROM lines_fx""",
    "lines_fx",
)
def region_export(spark, sf_dir):
    """The nested rows, shown flat."""
    lines = table(spark, sf_dir, "lines_fx")
    texts = lines.select("line_id", F.lit("ENG").alias("lang"), "text").union(lines.select("line_id", F.lit("FRA"), F.upper("text")))
    out = S.region_export(lines, texts)
    return out.select("page_id", "line_id", "bounds.*", "color", F.col("text")["ENG"].alias("english"), F.col("text")["FRA"].alias("french"))


@_add("region_report", None)
def region_report(spark, sf_dir):
    return S.region_report(table(spark, sf_dir, "lines_fx"))
