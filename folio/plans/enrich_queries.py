"""Queries of enrichment, glossary and language detection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import enrich as E
from folio.operators import glossary as G
from folio.plans.fixtures import sql_with, table


QUERIES: dict[str, tuple] = {}
_WORTH = f"length(regexp_replace(src, '{T.NOT_VALUABLE}', '', 'g')) > 0"


def _add(name: str, sql: str | None, *fixtures: str):
    def keep(run):
        QUERIES[name] = (run, sql_with(list(fixtures), sql) if sql and fixtures else sql)
        return run

    return keep


def _pairs(spark, sf_dir):
    return table(spark, sf_dir, "pairs_fx").select("conv_id", "pos", "src")


def upper(texts: list[str]) -> list[str]:
    """A model for tests: marks each text."""
    return [f"T:{t}" for t in texts]


def picky(texts: list[str]) -> list[str]:
    """A model that leaves texts of an even length empty."""
    return ["" if len(t) % 2 == 0 else f"T:{t}" for t in texts]


def short(texts: list[str]) -> list[str]:
    """A model that loses one answer when a batch has more than two."""
    return upper(texts)[:-1] if len(texts) > 2 else upper(texts)


@_add("enrich_batches", f"SELECT conv_id, pos, CASE WHEN {_WORTH} THEN 'T:' || src ELSE src END AS dst FROM pairs_fx", "pairs_fx")
def enrich_batches(spark, sf_dir):
    return E.enrich_batches(_pairs(spark, sf_dir), "conv_id", "pos", "src", upper, 3).select("conv_id", "pos", "dst")


@_add(
    "retry_invalid",
    f"SELECT conv_id, pos, CASE WHEN {_WORTH} THEN 'T:' || src ELSE src END AS dst, CASE WHEN {_WORTH} AND length(src) % 2 = 0 THEN 2 ELSE 1 END AS attempts FROM pairs_fx",
    "pairs_fx",
)
def retry_invalid(spark, sf_dir):
    out = E.retry_invalid(_pairs(spark, sf_dir), "conv_id", "pos", "src", [picky, upper], T.invalid_translation, 3)
    return out.select("conv_id", "pos", "dst", "attempts")


@_add("split_retry", "SELECT conv_id, pos, 'T:' || src AS dst FROM pairs_fx", "pairs_fx")
def split_retry(spark, sf_dir):
    return E.split_retry(_pairs(spark, sf_dir), "conv_id", "pos", "src", short, 8).select("conv_id", "pos", "dst")


@_add(
    "fallback_enrich",
    f"""WITH a AS (SELECT *, CASE WHEN {_WORTH} THEN CASE WHEN length(src) % 2 = 0 THEN '' ELSE 'T:' || src END ELSE src END AS one, CASE WHEN {_WORTH} THEN 'T:' || src ELSE src END AS two FROM pairs_fx),
    f AS (SELECT conv_id, bool_and(one = '') AS failed, bool_or(two <> src) AS ok FROM a GROUP BY conv_id)
    SELECT a.conv_id, a.pos, CASE WHEN failed THEN CASE WHEN ok AND two <> '' THEN two ELSE src END ELSE one END AS dst, CASE WHEN failed THEN 'second' ELSE 'first' END AS route FROM a JOIN f ON a.conv_id = f.conv_id""",
    "pairs_fx",
)
def fallback_enrich(spark, sf_dir):
    return E.fallback_enrich(_pairs(spark, sf_dir), "conv_id", "pos", "src", picky, upper, 3).select("conv_id", "pos", "dst", "route")


@_add("chain_enrich", "SELECT conv_id, pos, 'T:T:' || src AS dst, 'T:' || src AS first_step FROM pairs_fx", "pairs_fx")
def chain_enrich(spark, sf_dir):
    out = E.chain_enrich(_pairs(spark, sf_dir), "conv_id", "pos", "src", [("JPN", upper), ("ENG", upper)], 4)
    return out.select("conv_id", "pos", "dst", F.col("steps")["JPN"].alias("first_step"))


@_add(
    "screened_route",
    f"""WITH a AS (SELECT *, CASE WHEN {_WORTH} THEN 'T:' || src ELSE src END AS one FROM pairs_fx)
    SELECT conv_id, pos, one AS first, CASE WHEN length(one) % 3 = 0 THEN one WHEN {_WORTH} THEN CASE WHEN length(src) % 2 = 0 THEN '' ELSE 'T:' || src END ELSE src END AS dst, CASE WHEN length(one) % 3 = 0 THEN 'first' ELSE 'second' END AS route FROM a""",
    "pairs_fx",
)
def screened_route(spark, sf_dir):
    out = E.screened_route(_pairs(spark, sf_dir), "conv_id", "pos", "src", upper, picky, lambda d: F.length(d) % 3 == 0, 4)
    return out.select("conv_id", "pos", "first", "dst", "route")


@_add("page_retry", None)
def page_retry(spark, sf_dir):
    """Pages with an empty answer are run again whole."""
    out = E.page_retry(_pairs(spark, sf_dir), "conv_id", "pos", "src", [picky, upper], lambda d: d.where("dst = ''"), 4)
    return out.select("conv_id", "pos", "dst", "attempts")


QUERIES["page_retry"] = (
    page_retry,
    sql_with(
        "pairs_fx",
        f"""WITH a AS (SELECT *, CASE WHEN {_WORTH} THEN CASE WHEN length(src) % 2 = 0 THEN '' ELSE 'T:' || src END ELSE src END AS one FROM pairs_fx),
        b AS (SELECT *, bool_or(one = '') OVER (PARTITION BY conv_id) AS again FROM a)
        SELECT conv_id, pos, CASE WHEN again THEN CASE WHEN {_WORTH} THEN 'T:' || src ELSE src END ELSE one END AS dst, CASE WHEN again THEN 2 ELSE 1 END AS attempts FROM b""",
    ),
)


@_add("combine_regions", "SELECT conv_id, pos, 'T:' || src AS src FROM pairs_fx WHERE conv_id % 3 = 0 UNION ALL SELECT conv_id, pos, src FROM pairs_fx WHERE conv_id % 3 <> 0", "pairs_fx")
def combine_regions(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    changed = pairs.where("conv_id % 3 = 0").withColumn("src", F.concat(F.lit("T:"), "src"))
    return E.combine_regions(changed, pairs, "conv_id")


@_add(
    "failed_pages",
    """WITH j AS (SELECT token, count(*) FILTER (code = 5) AS emitted FROM frames_fx GROUP BY token), p AS (SELECT DISTINCT token, idx FROM frames_fx WHERE code IN (2, 3))
    SELECT j.token, emitted, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx), '') AS failed FROM j LEFT JOIN p ON j.token = p.token GROUP BY j.token, emitted""",
    "frames_fx",
)
def failed_pages(spark, sf_dir):
    """What a job's last frame tells: how many pages it gave and which failed, each once."""
    f = table(spark, sf_dir, "frames_fx")
    jobs = f.groupBy("token").agg(F.count_if(F.col("code") == 5).alias("emitted"))
    out = E.failed_pages(jobs, f.where("code in (2, 3)"), "token", "idx")
    return out.select("token", "emitted", F.array_join(F.transform("failed", lambda x: x.cast("string")), ",").alias("failed"))


@_add("route_by_language", "SELECT doc_id, CASE lang WHEN 'fr' THEN 'route-b' WHEN 'de' THEN 'route-c' ELSE 'route-a' END AS route FROM documents")
def route_by_language(spark, sf_dir):
    return E.route_by_language(table(spark, sf_dir, "documents"), "lang", {"fr": "route-b", "de": "route-c"}, "route-a").select("doc_id", "route")


@_add("closest_language", "SELECT doc_id, CASE lang WHEN 'fr' THEN 'es' WHEN 'de' THEN 'en' WHEN 'en' THEN 'en' WHEN 'es' THEN 'es' END AS sample FROM documents")
def closest_language(spark, sf_dir):
    rows = [("fr", "es", 4.0), ("fr", "en", 7.0), ("de", "en", 5.0), ("de", "es", 5.5), ("en", "en", 0.0), ("es", "es", 0.0), ("en", "es", 9.0)]
    distances = spark.createDataFrame(rows, "lang string, sample string, d double")
    return G.closest_language(table(spark, sf_dir, "documents"), "lang", distances, 6.0).select("doc_id", "sample")


def _terms(spark, sf_dir):
    """The words of the benchmark; long ones also as patterns, and some as expressions that are not valid."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("term")).distinct()
    long = words.where(F.length("term") >= 10)
    pattern = F.concat(F.substring("term", 1, 4), F.lit(".{2,9}"), F.substring("term", -2, 2), F.lit("( |$)"))
    more = long.select(pattern.alias("term")).union(long.select(F.concat("term", F.lit("(")))).distinct()
    return words.union(more).withColumn("target", F.concat(F.lit("T:"), "term"))


@_add(
    "glossary_match",
    r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS term FROM benchmark),
    t AS (SELECT term, false AS pattern FROM w UNION ALL SELECT DISTINCT substr(term, 1, 4) || '.{2,9}' || substr(term, -2, 2) || '( |$)', true FROM w WHERE length(term) >= 10
          UNION ALL SELECT term || '(', false FROM w WHERE length(term) >= 10),
    g AS (SELECT term, pattern, regexp_replace(lower(term), '[^\p{L}\p{N}_\s\p{Z}]', '', 'g') AS low FROM t),
    p AS (SELECT doc_id, text, lower(regexp_replace(text, '[^\p{L}\p{N}_\s\p{Z}]', '', 'g')) AS norm FROM documents),
    r AS (SELECT doc_id AS text_id, term, CASE WHEN contains(text, term) THEN 'exact' WHEN contains(norm, low) THEN CASE WHEN length(norm) > 5 * length(low) OR length(norm) - length(low) <= least(length(low) // 8, 3) THEN 'fuzzy' ELSE 'normal' END
                 WHEN pattern AND regexp_matches(text, term, 'i') THEN 'regex' END AS rule FROM p JOIN g ON contains(norm, low) OR contains(text, term) OR pattern)
    SELECT text_id, term, 'T:' || term AS target, rule FROM r WHERE rule IS NOT NULL""",
)
def glossary_match(spark, sf_dir):
    """Terms that are contained in a text, as they are or once both are normalised, or found as patterns; close spellings have a query of their own."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return G.glossary_match(texts, _terms(spark, sf_dir), fuzzy=False)


@_add("glossary_fuzzy", None)
def glossary_fuzzy(spark, sf_dir):
    """All rules, with the one that fired, over the turns of the conversations."""
    texts = _pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("pos")).alias("text_id"), F.col("src").alias("text"))
    return G.glossary_match(texts, _terms(spark, sf_dir))


@_add("window_edit_distance", None)
def window_edit_distance(spark, sf_dir):
    """Each turn against the first word of its conversation's first turn."""
    # ASCII only: the other engine's distance counts bytes
    pairs = _pairs(spark, sf_dir).withColumn("src", F.regexp_replace(F.lower("src"), r"[^\x00-\x7F]", ""))
    first = pairs.groupBy("conv_id").agg(F.regexp_extract(F.min_by("src", "pos"), r"\p{L}+", 0).alias("term")).where("term <> ''")
    return pairs.join(first, "conv_id").select("conv_id", "pos", G.window_edit_distance(F.col("src"), F.col("term")).alias("distance"))


QUERIES["window_edit_distance"] = (
    window_edit_distance,
    sql_with(
        "pairs_fx",
        r"""WITH a AS (SELECT conv_id, pos, regexp_replace(lower(src), '[^\x00-\x7F]', '', 'g') AS src FROM pairs_fx),
        f AS (SELECT conv_id, regexp_extract(min_by(src, pos), '\p{L}+', 0) AS term FROM a GROUP BY conv_id),
        p AS (SELECT p.conv_id, p.pos, p.src AS t, f.term, length(f.term) AS n, length(f.term) + CASE WHEN length(f.term) <= 8 THEN 0 WHEN length(f.term) <= 16 THEN 1 ELSE 2 END AS w
              FROM a p JOIN f ON p.conv_id = f.conv_id WHERE f.term <> '')
        SELECT conv_id, pos, CAST(CASE WHEN length(t) > 5 * n THEN list_min(list_transform(generate_series(1, greatest(length(t) - w + 1, 1)), lambda i: levenshtein(substr(t, i, w), term)))
          ELSE levenshtein(t, term) END AS INT) AS distance FROM p""",
    ),
)


def _profile_sql() -> str:
    return """WITH s AS (SELECT doc_id, lang, lower(text) AS t FROM documents WHERE length(text) >= 3),
    c AS (SELECT doc_id, lang, string_split(t, '') AS a FROM s),
    g AS (SELECT doc_id, lang, unnest(list_transform(generate_series(1, len(a) - 2), lambda i: a[i] || a[i + 1] || a[i + 2])) AS gram FROM c),
    n AS (SELECT gram, lang, count(*) AS n FROM g GROUP BY gram, lang), tot AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang), v AS (SELECT count(DISTINCT gram) AS v FROM n),
    k AS (SELECT doc_id, gram, count(*) AS k FROM g GROUP BY doc_id, gram), m AS (SELECT doc_id, sum(k) AS m FROM k GROUP BY doc_id),
    sc AS (SELECT k.doc_id, n.lang, sum(k.k * ln(n.n + 1)) AS gain FROM k JOIN n ON k.gram = n.gram GROUP BY k.doc_id, n.lang),
    z AS (SELECT sc.doc_id, sc.lang, gain / m - ln(total + v) AS score FROM sc JOIN tot ON sc.lang = tot.lang JOIN m ON sc.doc_id = m.doc_id CROSS JOIN v),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, lang DESC) AS i FROM z)
    SELECT doc_id, lang AS language, round(score, 6) AS score FROM r WHERE i = 1"""


@_add("language_detect", _profile_sql())
def language_detect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profile = E.language_profile(docs, "text", "lang")
    return E.language_detect(docs, profile, "doc_id", "text").withColumn("score", F.round("score", 6))


_PAGE = "CAST(floor(doc_id / 12) * 2 + CASE WHEN doc_id % 12 < floor(doc_id / 12) % 3 THEN 1 ELSE 0 END AS BIGINT)"


@_add(
    "page_language_check",
    f"""WITH t AS (SELECT lang, string_split(lower(text), '') AS a FROM documents WHERE length(text) >= 3),
    n AS (SELECT gram, lang, count(*) AS n FROM (SELECT lang, unnest(list_transform(generate_series(1, len(a) - 2), lambda i: a[i] || a[i + 1] || a[i + 2])) AS gram FROM t) q GROUP BY gram, lang),
    tot AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang), v AS (SELECT count(DISTINCT gram) AS v FROM n),
    p AS (SELECT {_PAGE} AS page_id, count(*) AS n, coalesce(string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '' ORDER BY doc_id), '') AS merged FROM documents GROUP BY 1),
    c AS (SELECT page_id, string_split(lower(merged), '') AS a FROM p WHERE n > 10 AND length(merged) >= 3),
    k AS (SELECT page_id, gram, count(*) AS k FROM (SELECT page_id, unnest(list_transform(generate_series(1, len(a) - 2), lambda i: a[i] || a[i + 1] || a[i + 2])) AS gram FROM c) q GROUP BY page_id, gram),
    m AS (SELECT page_id, sum(k) AS m FROM k GROUP BY page_id),
    sc AS (SELECT k.page_id, n.lang, sum(k.k * ln(n.n + 1)) AS gain FROM k JOIN n ON k.gram = n.gram GROUP BY k.page_id, n.lang),
    z AS (SELECT sc.page_id, sc.lang, gain / m - ln(total + v) AS score FROM sc JOIN tot ON sc.lang = tot.lang JOIN m ON sc.page_id = m.page_id CROSS JOIN v),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(score, 9) DESC, lang DESC) AS i FROM z)
    SELECT p.page_id, p.n, p.n <= 10 OR p.merged = '' OR coalesce(r.lang = 'en', false) AS passed FROM p LEFT JOIN r ON p.page_id = r.page_id AND r.i = 1""",
)
def page_language_check(spark, sf_dir):
    """Ten to twelve documents make a page; the languages are those of the documents."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.expr(_PAGE).alias("page_id"), "doc_id", F.col("text").alias("dst"))
    return E.page_language_check(rows, "page_id", "doc_id", E.language_profile(docs, "text", "lang"), "en")


