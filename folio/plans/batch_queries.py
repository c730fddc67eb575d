"""Queries of batching, prompts and parsing, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import batching as B
from folio.plans.fixtures import sql_with, table

QUERIES: dict[str, tuple] = {}


def _add(name: str, sql: str | None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "pairs_fx")


def _p(body: str) -> str:
    return sql_with("pairs_fx", body)


@_add("fixed_batches", _p("SELECT conv_id, pos, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1) // 3 AS BIGINT) AS batch FROM pairs_fx"))
def fixed_batches(spark, sf_dir):
    return B.fixed_batches(_pairs(spark, sf_dir), "conv_id", "pos", 3).select("conv_id", "pos", "batch")


@_add(
    "budget_pack",
    _p("""WITH RECURSIVE s AS (SELECT conv_id, pos, strlen(src) + 10 AS need, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM pairs_fx),
    r AS (SELECT conv_id, pos, i, CAST(0 AS BIGINT) AS batch, need AS filled FROM s WHERE i = 1
          UNION ALL SELECT s.conv_id, s.pos, s.i, CASE WHEN r.filled + s.need > 600 THEN r.batch + 1 ELSE r.batch END,
                           CASE WHEN r.filled + s.need > 600 THEN s.need ELSE r.filled + s.need END
          FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
    SELECT conv_id, pos, batch FROM r""").replace("WITH pairs_fx AS", "WITH RECURSIVE pairs_fx AS").replace(", RECURSIVE s AS", ", s AS"),
)
def budget_pack(spark, sf_dir):
    return B.budget_pack(_pairs(spark, sf_dir), "conv_id", "pos", F.octet_length("src"), 600)


@_add(
    "page_flush",
    _p("""WITH RECURSIVE s AS (SELECT conv_id, pos, strlen(src) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM pairs_fx),
    a AS (SELECT *, 0 AS batch, t AS held, 1 AS pages FROM s WHERE i = 1),
    r AS (SELECT conv_id, pos, i, n, batch, held, pages, (held >= 200 OR pages >= 3) AS flush FROM a
          UNION ALL SELECT conv_id, pos, i, n, batch, held, pages,
            CASE WHEN batch = 0 THEN held >= 200 OR pages >= 3 ELSE pages >= 4 OR held >= 600 OR (held >= 200 AND n - i <= 4) END
          FROM (SELECT s.conv_id, s.pos, s.i, s.n, r.batch + CAST(r.flush AS INT) AS batch, CASE WHEN r.flush THEN 0 ELSE r.held END + s.t AS held,
                       CASE WHEN r.flush THEN 0 ELSE r.pages END + 1 AS pages FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1) q)
    SELECT conv_id, pos, CAST(batch AS BIGINT) AS batch FROM r""").replace("WITH pairs_fx AS", "WITH RECURSIVE pairs_fx AS").replace(", RECURSIVE s AS", ", s AS"),
)
def page_flush(spark, sf_dir):
    sized = _pairs(spark, sf_dir).select("conv_id", "pos", F.octet_length("src").cast("long").alias("tokens"))
    return B.page_flush(sized, "conv_id", "pos", "tokens", 4, 600)


_BATCHED = "SELECT conv_id, pos, src, dst, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1) // 3 AS BIGINT) AS batch FROM pairs_fx"
_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY conv_id, batch ORDER BY pos) AS i FROM ({_BATCHED}) b"


@_add("prompt_build", _p(f"SELECT conv_id, batch, 'Translate:' || string_agg(chr(10) || '<|' || i || '|>' || src, '' ORDER BY i) AS prompt, count(*) AS n FROM ({_NUMBERED}) q GROUP BY conv_id, batch"))
def prompt_build(spark, sf_dir):
    batched = B.fixed_batches(_pairs(spark, sf_dir), "conv_id", "pos", 3)
    return B.prompt_build(batched, ["conv_id", "batch"], "pos", "src", "Translate:")


@_add(
    "json_prompt_build",
    _p(f"""SELECT conv_id, batch, '{{"TextList":[' || string_agg('{{"ID":' || (i - 1) || ',"text":' || CAST(to_json(src) AS VARCHAR) || '}}', ',' ORDER BY i) || ']}}' AS prompt
    FROM ({_NUMBERED}) q GROUP BY conv_id, batch"""),
)
def json_prompt_build(spark, sf_dir):
    batched = B.fixed_batches(_pairs(spark, sf_dir), "conv_id", "pos", 3)
    return B.json_prompt_build(batched, ["conv_id", "batch"], "pos", "src")


@_add(
    "tagged_parse",
    _p(r"""SELECT conv_id, batch, CAST(i - 1 AS INT) AS pos, regexp_replace(regexp_replace(src, '^\s+|\s+$', '', 'g'), '^\|', '') AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, batch ORDER BY pos) AS i FROM (""" + _BATCHED + ") b) q"),
)
def tagged_parse(spark, sf_dir):
    batched = B.fixed_batches(_pairs(spark, sf_dir), "conv_id", "pos", 3)
    prompts = B.prompt_build(batched, ["conv_id", "batch"], "pos", "src")
    return B.tagged_parse(prompts, ["conv_id", "batch"], "prompt")


@_add(
    "tagged_validate",
    _p("""SELECT conv_id, CASE WHEN conv_id % 5 = 1 AND n > 1 THEN 'duplicate index' WHEN conv_id % 5 = 2 THEN 'index out of range' WHEN conv_id % 5 = 3 THEN 'missing index'
        WHEN hollow THEN 'empty text' ELSE 'ok' END AS status
    FROM (SELECT conv_id, count(*) AS n, bool_or(trim(src) <> '' AND trim(dst) = '') AS hollow FROM pairs_fx GROUP BY conv_id) q"""),
)
def tagged_validate(spark, sf_dir):
    """Answers made from the pairs, with faults by conversation: a repeated, a too large and a missing number."""
    rows = _pairs(spark, sf_dir).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "src", "dst"))).alias("r"), F.count("*").alias("n"))
    fault = F.col("conv_id") % 5
    number = lambda i: F.when(fault == 1, F.lit(1)).when(fault == 2, i + 101).otherwise(i + 1).cast("string")
    lines = F.transform("r", lambda x, i: F.concat(F.lit("<|"), number(i), F.lit("|>"), x["dst"]))
    lines = F.when(fault == 3, F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    made = rows.select("conv_id", "n", F.array_join(lines, "\n").alias("answer"), F.col("r.src").alias("sources"), F.col("r.dst").alias("texts"))
    return made.select("conv_id", B.tagged_validate(made, "answer", "n", "sources", "texts").alias("status"))


@_add(
    "align_batch",
    _p(f"""SELECT conv_id, pos, CASE WHEN length(regexp_replace(src, '{T.NOT_VALUABLE}', '', 'g')) = 0 THEN src WHEN pos % 3 = 2 THEN '' ELSE dst END AS dst FROM pairs_fx"""),
)
def align_batch(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    answers = pairs.where("pos % 3 <> 2").select("conv_id", "pos", F.col("dst").alias("answer"))
    return B.align_batch(pairs.select("conv_id", "pos", "src"), answers, ["conv_id", "pos"], "src", "answer", T.valuable_chars(F.col("src")) > 0).select("conv_id", "pos", "dst")


@_add(
    "json_parse",
    _p("""SELECT conv_id, pos, CASE WHEN conv_id % 4 = 1 OR (conv_id % 4 = 2 AND n > 1) THEN src WHEN i > 1 AND i % 3 = 0 THEN src ELSE dst END AS dst,
        CASE WHEN conv_id % 4 = 1 THEN 'bad item' WHEN conv_id % 4 = 2 AND n > 1 THEN 'id out of range' ELSE 'ok' END AS status
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM pairs_fx) q"""),
)
def json_parse(spark, sf_dir):
    """Answers numbered from 5, every third left out; some broken, some with numbers too large."""
    pairs = _pairs(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("pos")
    some = pairs.withColumn("i", F.row_number().over(w)).where("i = 1 or i % 3 <> 0")
    item = F.struct(F.when((F.col("conv_id") % 4 == 2) & (F.col("i") > 1), F.col("i") + 1000).otherwise(F.col("i") + 4).alias("ID"), F.col("dst").alias("text"))
    made = some.groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("TextList"))).alias("good"))
    made = made.select("conv_id", F.when(F.col("conv_id") % 4 == 1, "not json").otherwise(F.col("good")).alias("answer"))
    return B.json_parse(pairs.select("conv_id", "pos", "src"), made, "conv_id", "pos", "src", "answer")


@_add("json_salvage", _p("SELECT conv_id, pos, '{\"a\": [' || pos || ']}' AS salvaged FROM pairs_fx"))
def json_salvage(spark, sf_dir):
    wrapped = F.concat(F.lit('Sure!\n```json\n{"a": ['), F.col("pos").cast("string"), F.lit("]}\n```\nDone."))
    return _pairs(spark, sf_dir).select("conv_id", "pos", B.json_salvage(wrapped).alias("salvaged"))


@_add(
    "flag_parse",
    _p("SELECT conv_id, list_transform(generate_series(0, 5), lambda i: i < n AND i % 2 = 0) AS flags FROM (SELECT conv_id, count(*) AS n FROM pairs_fx GROUP BY conv_id) q"),
)
def flag_parse(spark, sf_dir):
    rows = _pairs(spark, sf_dir).groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    lines = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i % 2 == 0, "it is True").otherwise("no, FALSE"))
    return rows.select("conv_id", B.flag_parse(F.concat(F.lit("Answers\n"), F.array_join(lines, "\n")), F.lit(6)).alias("flags"))


@_add(
    "order_remap",
    _p("""SELECT conv_id, pos, CASE WHEN conv_id % 3 = 0 THEN src ELSE 'T' || dst END AS dst, CAST(CASE WHEN conv_id % 3 = 0 THEN i - 1 ELSE n - i END AS INT) AS reading
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM pairs_fx) q"""),
)
def order_remap(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    w = Window.partitionBy("conv_id")
    rows = pairs.withColumn("i", (F.row_number().over(w.orderBy("pos")) - 1).cast("int")).withColumn("n", F.count("*").over(w).cast("int"))
    item = F.struct((F.col("n") - 1 - F.col("i")).alias("order"), F.when(F.col("conv_id") % 3 == 0, F.col("i") + 7).otherwise(F.col("i")).alias("id"), F.concat(F.lit("T"), F.col("dst")).alias("text"))
    answers = rows.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("answer"))
    return B.order_remap(answers, pairs.select("conv_id", "pos", "src"), "conv_id", "pos", "src", "answer")


@_add(
    "page_pairs_map",
    _p("""SELECT conv_id, src, max_by(dst, pos) AS dst FROM pairs_fx GROUP BY conv_id, src"""),
)
def page_pairs_map(spark, sf_dir):
    """Per page its map source -> translation, the later of equal sources winning; shown as rows."""
    last = _pairs(spark, sf_dir).groupBy("conv_id", "src").agg(F.max_by("dst", "pos").alias("dst"))
    maps = last.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("src", "dst"))).alias("m"))
    return maps.select("conv_id", F.explode("m").alias("src", "dst"))


def seam_join(rows, text: str):
    """Lines joined in order: no space where either side of a seam is an East Asian character."""
    wide = r"[\x{3000}-\x{9FFF}]"
    return F.aggregate(
        rows,
        F.lit(None).cast("string"),
        lambda a, r: F.when(a.isNull(), r[text]).otherwise(
            F.concat(a, F.when(a.rlike(wide + "$") | r[text].rlike("^" + wide), F.lit("")).otherwise(F.lit(" ")), r[text])
        ),
    )


@_add("text_join", _p("SELECT conv_id, string_agg(src, ' ' ORDER BY pos) AS joined, string_agg(src || '、', '' ORDER BY pos) AS joined_wide FROM pairs_fx GROUP BY conv_id"))
def text_join(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("conv_id", "pos", "src", F.concat(F.col("src"), F.lit("、")).alias("wide"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "src", "wide"))).alias("r"))
    return listed.select("conv_id", seam_join(F.col("r"), "src").alias("joined"), seam_join(F.col("r"), "wide").alias("joined_wide"))


@_add("text_line_source", "SELECT doc_id, CAST(i - 1 AS INT) AS line_no, parts[i] AS text FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) p) q")
def text_line_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


@_add("text_line_roundtrip", "SELECT doc_id, text FROM documents")
def text_line_roundtrip(spark, sf_dir):
    lines = text_line_source(spark, sf_dir)
    return lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("r")).select("doc_id", F.array_join("r.text", "\n").alias("text"))


@_add(
    "previous_context",
    _p("""WITH pages AS (SELECT conv_id // 8 AS job, conv_id AS page, list(trim(src) ORDER BY pos) FILTER (trim(src) <> '') AS s FROM pairs_fx GROUP BY conv_id),
    full_pages AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY page) AS k FROM pages WHERE len(s) > 0),
    before AS (SELECT p.job, p.page, (SELECT count(*) FROM full_pages f WHERE f.job = p.job AND f.page < p.page) AS k FROM pages p),
    lines AS (SELECT b.page, unnest(f.s) AS line, f.page AS from_page, generate_subscripts(f.s, 1) AS j FROM before b JOIN full_pages f ON f.job = b.job AND f.k > b.k - 2 AND f.k <= b.k),
    numbered AS (SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY from_page, j) AS i FROM lines)
    SELECT b.page, coalesce('Context:' || string_agg(chr(10) || '<|' || n.i || '|>' || n.line, '' ORDER BY n.i), '') AS context FROM before b LEFT JOIN numbered n ON b.page = n.page GROUP BY b.page"""),
)
def previous_context(spark, sf_dir):
    """Per page the sentences of the last two non-empty earlier pages of its job, numbered."""
    lines = _pairs(spark, sf_dir).select((F.floor(F.col("conv_id") / 8)).alias("job"), F.col("conv_id").alias("page"), "pos", F.trim("src").alias("s"))
    pages = lines.groupBy("job", "page").agg(F.sort_array(F.collect_list(F.when(F.col("s") != "", F.struct("pos", "s")))).alias("r")).withColumn("s", F.col("r.s"))
    full = F.size("s") > 0
    k = F.coalesce(F.sum(full.cast("int")).over(Window.partitionBy("job").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pages.withColumn("k", k)
    shown = placed.where(full).select("job", (F.col("k") + 1).alias("k"), "s", F.col("page").alias("from_page"))
    last = shown.groupBy("job", "k").agg(F.first("s").alias("s"))
    wanted = placed.select("job", "page", F.explode_outer(F.when(F.col("k") > 0, F.sequence(F.greatest(F.col("k") - 1, F.lit(1)), F.col("k")))).alias("k"))
    joined = wanted.join(last, ["job", "k"], "left").groupBy("page").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda r: F.coalesce(r["s"], F.array().cast("array<string>")))).alias("lines"))
    numbered = F.transform("lines", lambda t, i: F.concat(F.lit("\n<|"), (i + 1).cast("string"), F.lit("|>"), t))
    return joined.select("page", F.when(F.size("lines") > 0, F.concat(F.lit("Context:"), F.array_join(numbered, ""))).otherwise("").alias("context"))


@_add(
    "skipped_context_pages",
    _p("""WITH pages AS (SELECT conv_id // 8 AS job, conv_id AS page, bool_or(dst <> '') AS filled FROM pairs_fx GROUP BY conv_id)
    SELECT page, least(3, count(*) OVER w) - least(3, coalesce(sum(filled::INT) OVER w, 0)) AS skipped FROM pages WINDOW w AS (PARTITION BY job ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
)
def skipped_context_pages(spark, sf_dir):
    pages = _pairs(spark, sf_dir).groupBy(F.floor(F.col("conv_id") / 8).alias("job"), F.col("conv_id").alias("page")).agg(F.bool_or(F.col("dst") != "").alias("filled"))
    w = Window.partitionBy("job").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    done, some = F.count("*").over(w), F.coalesce(F.sum(F.col("filled").cast("int")).over(w), F.lit(0))
    return pages.select("page", (F.least(F.lit(3), done) - F.least(F.lit(3), some)).alias("skipped"))


@_add(
    "flagship_translation_slice",
    _p(f"""SELECT conv_id, pos, CASE WHEN length(regexp_replace(src, '{T.NOT_VALUABLE}', '', 'g')) = 0 THEN src ELSE regexp_replace(regexp_replace(src, '^\\s+|\\s+$', '', 'g'), '^\\|', '') END AS dst FROM pairs_fx"""),
)
def flagship(spark, sf_dir):
    """Valuable rows in batches of three, a prompt for each, an echo as the model, parsed and aligned back."""
    pairs = _pairs(spark, sf_dir).select("conv_id", "pos", "src")
    valuable = T.valuable_chars(F.col("src")) > 0
    batched = B.fixed_batches(pairs.where(valuable), "conv_id", "pos", 3)
    answers = B.tagged_parse(B.prompt_build(batched, ["conv_id", "batch"], "pos", "src"), ["conv_id", "batch"], "prompt").withColumnRenamed("pos", "slot")
    slot = F.row_number().over(Window.partitionBy("conv_id", "batch").orderBy("pos")) - 1
    placed = batched.withColumn("slot", slot).join(answers, ["conv_id", "batch", "slot"], "left").select("conv_id", "pos", F.col("text").alias("answer"))
    return B.align_batch(pairs, placed, ["conv_id", "pos"], "src", "answer", valuable).select("conv_id", "pos", "dst")
