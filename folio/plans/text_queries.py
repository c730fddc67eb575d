"""Queries of the text expressions and predicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.functions import text as T
from folio.plans.fixtures import sql_with, table

QUERIES: dict[str, tuple] = {}


def _pairs(name: str, sql: str | None, columns):
    """Register a query over the pairs: their keys and the columns that columns() makes once there is a session."""
    def run(spark, sf_dir):
        return table(spark, sf_dir, "pairs_fx").select("conv_id", "pos", *[c.alias(n) for n, c in columns().items()])

    QUERIES[name] = (run, None if sql is None else sql_with("pairs_fx", f"SELECT conv_id, pos, {sql} FROM pairs_fx"))


def _docs(name: str, sql: str | None, columns):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in columns().items()])

    QUERIES[name] = (run, None if sql is None else f"SELECT doc_id, {sql} FROM documents")


_COUNT = "(length({t}) - length(regexp_replace({t}, '{c}', '', 'g')))"


def _n(t: str, c: str) -> str:
    return _COUNT.format(t=t, c=c.replace("'", "''"))


_STRIP = r"regexp_replace({t}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _strip(t: str) -> str:
    return _STRIP.format(t=t)


_pairs(
    "valuable_chars",
    rf"length(regexp_replace(src, '{T.NOT_VALUABLE}', '', 'g')) AS n_src, length(regexp_replace(dst, '{T.NOT_VALUABLE}', '', 'g')) AS n_dst",
    lambda: dict(n_src=T.valuable_chars(F.col("src")), n_dst=T.valuable_chars(F.col("dst"))),
)
_docs(
    "weighted_length",
    f"length({_strip('text')}) - 0.5 * {_n(_strip('text'), f'[{T.SMALL}]')} AS weighted",
    lambda: dict(weighted=T.weighted_length(F.col("text")).cast("double")),
)
QUERIES["weighted_length"] = (QUERIES["weighted_length"][0], QUERIES["weighted_length"][1].replace("SELECT doc_id, ", "SELECT doc_id, CAST(").replace(" AS weighted", " AS DOUBLE) AS weighted"))


def _token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "pairs_fx").groupBy("conv_id").agg(F.sum(T.token_estimate(F.col("src"))).alias("tokens"))


QUERIES["token_estimate"] = (
    _token_estimate,
    sql_with(
        "pairs_fx",
        rf"""SELECT conv_id, CAST(sum(CAST(floor((w * 14 + (n - w) * 7) / 20) AS BIGINT) + 6) AS BIGINT) AS tokens
        FROM (SELECT conv_id, length(src) AS n, {_n('src', T.WIDE)} AS w FROM pairs_fx) t GROUP BY conv_id""",
    ),
)


def _script_sql() -> str:
    counts = ", ".join(f"{_n('text', c)} AS n_{k.lower()}" for k, c in T.SCRIPTS.items())
    label = "CASE " + " ".join(f"WHEN {_n('text', c)} > 0 THEN '{k}'" for k, c in T.SCRIPTS.items()) + " ELSE 'OTHER' END AS label"
    return f"{counts}, {label}"


_docs(
    "script_profile",
    _script_sql(),
    lambda: dict(**{f"n_{k.lower()}": c for k, c in T.script_counts(F.col("text")).items()}, label=T.script_label(F.col("text"))),
)
_KANA = f"translate(translate({{t}}, '{T.SMALL_KANA}', '{T.NORMAL_KANA}'), '{T.KATAKANA}', '{T.HIRAGANA}')"
# the given texts hold no kana, so some are put behind each
_SAMPLE = "カタカナのッェュ・ー"
_docs(
    "kana_normalize",
    _KANA.format(t=f"concat(text, '{_SAMPLE}')") + " AS normal",
    lambda: dict(normal=T.kana_normalize(F.concat(F.col("text"), F.lit(_SAMPLE)))),
)
_docs(
    "term_normalize",
    _KANA.format(t=r"lower(regexp_replace(text, '[^\p{L}\p{N}_\s\p{Z}]', '', 'g'))") + " AS term",
    lambda: dict(term=T.term_normalize(F.col("text"))),
)
_pairs(
    "query_preprocess",
    rf"'「' || replace(regexp_replace(translate(src || '❤ッ', '{T.SMALL_KANA}', '{T.NORMAL_KANA}'), '[\x{{10000}}-\x{{10FFFF}}]', '', 'g'), '❤', '♥') || '」' AS query, src || '❤ツ' AS restored",
    lambda: dict(query=T.query_preprocess(F.concat(F.col("src"), F.lit("❤ッ"))), restored=F.replace(T.query_restore(T.query_preprocess(F.concat(F.col("src"), F.lit("❤ッ")))), F.lit("♥"), F.lit("❤"))),
)
_pairs(
    "bracket_repair",
    None,
    lambda: dict(fixed=T.bracket_repair(F.concat(F.lit("("), F.col("dst"), F.lit("]'")))),
)


def _quote_sql(src: str, dst: str) -> str:
    cases = ""
    for o, c in ("『』", "「」", "【】"):
        n = _n(src, f"\\x{{{ord(o):X}}}")
        fits = f"""({n} = {_n(dst, '"')} OR {n} = {_n(dst, '＂')}) AND regexp_matches({dst}, '[^\\x00-\\x7F]')"""
        cases += f""" WHEN contains({src}, '{o}') AND contains({src}, '{c}') THEN CASE WHEN {fits} THEN regexp_replace({dst}, '"([^"]*)"', '{o}\\1{c}', 'g') ELSE {dst} END"""
    return f"CASE{cases} ELSE {dst} END"


def _qs():
    return F.when(F.col("pos") % 2 == 0, F.concat(F.lit("「"), F.col("src"), F.lit("」『』"))).otherwise(F.concat(F.lit("【"), F.col("src"), F.lit("】")))


_QS_SQL = "(CASE WHEN pos % 2 = 0 THEN '「' || src || '」『』' ELSE '【' || src || '】' END)"
_pairs(
    "quote_transfer",
    _quote_sql(_QS_SQL, "(dst || '\"é')") + " AS moved",
    lambda: dict(moved=T.quote_transfer(_qs(), F.concat(F.col("dst"), F.lit('"é')))),
)


def _align_sql(src: str, dst: str) -> str:
    """The rules one after another, as nested subqueries over column d."""
    inner = f"SELECT conv_id, pos, {src} AS s, {dst} AS d FROM pairs_fx"
    for rule in T.ALIGNMENT:
        std, others = rule[0], rule[1:]
        cls = lambda cs: "[" + "".join(f"\\x{{{ord(c):X}}}" for c in cs) + "]"
        ss, sv, dd = _n("s", cls(std)), _n("s", cls(others)), _n("d", cls(rule))
        inner = f"SELECT conv_id, pos, s, CASE WHEN {ss} > 0 AND {ss} <> {sv} AND {ss} = {dd} THEN translate(d, '{others}', '{std * len(others)}') ELSE d END AS d FROM ({inner}) q"
    return sql_with("pairs_fx", f"SELECT conv_id, pos, d AS aligned FROM ({inner}) z")


def _bracket_align(spark, sf_dir):
    pairs = table(spark, sf_dir, "pairs_fx").select("conv_id", "pos", F.concat(F.lit("(a)「"), F.col("src")).alias("s"), F.concat(F.col("dst"), F.lit("（b）“")).alias("d"))
    return pairs.select("conv_id", "pos", T.bracket_align(F.col("s"), F.col("d")).alias("aligned"))


QUERIES["bracket_align"] = (_bracket_align, _align_sql("'(a)「' || src", "dst || '（b）“'"))
_pairs(
    "bracket_force",
    "translate(dst, '“‘”’[]', '「「」」【】') AS forced",
    lambda: dict(forced=T.bracket_force(F.col("dst"))),
)

RULES = [(r"\bthe\b", "THE"), (r"([aeiou])\1", r"<\1>"), ("[.,]", "$1"), ("  +", " ")]


def _rules_sql(t: str) -> str:
    # the second rule has a back-reference, which RE2 lacks: its five cases are written out
    t = rf"regexp_replace({t}, '\bthe\b', 'THE', 'g')"
    t = rf"regexp_replace({t}, '(a)a|(e)e|(i)i|(o)o|(u)u', '<\1\2\3\4\5>', 'g')"
    return f"regexp_replace(regexp_replace({t}, '[.,]', '$1', 'g'), '  +', ' ', 'g')"


_pairs(
    "dict_apply",
    _rules_sql("src") + " AS replaced",
    lambda: dict(replaced=T.dict_apply(F.col("src"), RULES)),
)


def _dict_audit(spark, sf_dir):
    steps = table(spark, sf_dir, "pairs_fx").select("conv_id", "pos", T.dict_steps(F.col("src"), RULES).alias("s"))
    rows = steps.select("conv_id", "pos", "s", F.explode(F.sequence(F.lit(1), F.lit(len(RULES)))).alias("rule"))
    rows = rows.select("conv_id", "pos", "rule", F.get("s", F.col("rule") - 1).alias("before_text"), F.get("s", F.col("rule")).alias("after_text"))
    return rows.where("before_text <> after_text")


def _audit_sql() -> str:
    a = r"regexp_replace(src, '\bthe\b', 'THE', 'g')"
    b = rf"regexp_replace({a}, '(a)a|(e)e|(i)i|(o)o|(u)u', '<\1\2\3\4\5>', 'g')"
    c = f"regexp_replace({b}, '[.,]', '$1', 'g')"
    steps = ["src", a, b, c, f"regexp_replace({c}, '  +', ' ', 'g')"]
    parts = [f"SELECT conv_id, pos, {k} AS rule, {x} AS before_text, {y} AS after_text FROM pairs_fx" for k, (x, y) in enumerate(zip(steps, steps[1:]), 1)]
    return sql_with("pairs_fx", f"SELECT * FROM ({' UNION ALL '.join(parts)}) t WHERE before_text <> after_text")


QUERIES["dict_audit"] = (_dict_audit, _audit_sql())
_pairs(
    "output_clean",
    None,
    lambda: dict(cleaned=T.output_clean(F.col("dst"))),
)
def _unit(t: str) -> str:
    """The shortest repeated prefix in SQL."""
    least = f"list_min([k for k in generate_series(1, length({t}) // 2) if substr({t}, k + 1) = substr({t}, 1, length({t}) - k)])"
    return f"CASE WHEN {least} IS NULL THEN {t} ELSE substr({t}, 1, {least}) END"


_pairs(
    "repeat_unit",
    f"{_unit('dst')} AS unit",
    lambda: dict(unit=T.repeat_unit(F.col("dst"))),
)
_pairs(
    "repeat_shrink",
    f"""CASE WHEN length(dst) < length(src) AND length({_unit('lower(dst)')}) < 0.5 * length(dst) THEN
        array_to_string([CASE WHEN regexp_matches(substr(src, CAST(i AS BIGINT), 1), '^\\p{{Lu}}$') THEN upper(c) ELSE c END
          for c, i in string_split(substr(repeat({_unit('lower(dst)')}, greatest(length(src) // length({_unit('lower(dst)')}), 1)), 1, length(src)), '')], '') ELSE dst END AS shrunk""",
    lambda: dict(shrunk=T.repeat_shrink(F.col("src"), F.col("dst"))),
)
_pairs(
    "case_fold_option",
    "lower(src) AS folded",
    lambda: dict(folded=F.lower(F.col("src"))),
)
_pairs(
    "tag_normalize",
    None,
    lambda: dict(tagged=T.tag_normalize(F.concat(F.lit("< |l0 |> "), F.col("src"), F.lit(" <|  O2|>")))),
)
_pairs(
    "capture_extract",
    r"nullif(trim(array_to_string(regexp_extract_all(src, '\b(th[a-z]+)', 1), chr(10))), '') AS captured",
    lambda: dict(captured=T.capture_extract(F.col("src"), r"\b(th[a-z]+)")),
)


def _bullet_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("- "), F.regexp_replace("text", "\n", "\n- ")).alias("b"))
    return docs.select(
        "doc_id", T.bullet_list(F.split("text", "\n")).alias("plain"), T.bullet_list(F.split("b", "\n")).alias("marked")
    )


def _bullet_sql(col: str) -> str:
    kind = r"CASE WHEN regexp_matches(x, '^[^\p{L}\p{N}_\s]') THEN 1 WHEN regexp_matches(x, '^[0-9]+\.') THEN 2 WHEN regexp_matches(x, '^[QA]:') THEN 3 END"
    kinds = f"list_transform(string_split({col}, chr(10)), lambda x: {kind})"
    return f"(len({kinds}) > 1 AND len(list_filter({kinds}, lambda k: k IS NULL)) = 0 AND len(list_distinct({kinds})) = 1)"


QUERIES["bullet_list"] = (
    _bullet_lines,
    f"SELECT doc_id, {_bullet_sql('text')} AS plain, {_bullet_sql('b')} AS marked FROM (SELECT doc_id, text, '- ' || replace(text, chr(10), chr(10) || '- ') AS b FROM documents) t",
)

# Language codes by ISO-639-1 code.
LANGUAGES = {
    "zh": "CHS", "ja": "JPN", "en": "ENG", "ko": "KOR", "vi": "VIN", "cs": "CSY", "nl": "NLD", "fr": "FRA", "de": "DEU",
    "hu": "HUN", "it": "ITA", "pl": "POL", "pt": "PTB", "ro": "ROM", "ru": "RUS", "es": "ESP", "tr": "TRK", "uk": "UKR",
    "ar": "ARA", "sr": "SRP", "hr": "HRV", "th": "THA", "id": "IND", "tl": "FIL",
}


def language_code(iso):
    codes = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, F.lower(iso)), F.lit("UNKNOWN"))


_LANG_SQL = "CASE lower({c}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " ELSE 'UNKNOWN' END"
_docs(
    "lang_code",
    f"{_LANG_SQL.format(c='lang')} AS code",
    lambda: dict(code=language_code(F.col("lang"))),
)


def _region_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.length("text") < 100, "too short").when(T.valuable_chars(F.col("text")) == 0, "no valuable text")
        .when(language_code(F.col("lang")) == "DEU", "already in the target language").otherwise("kept").alias("reason"),
    )


QUERIES["region_filter"] = (
    _region_filter,
    f"""SELECT doc_id, CASE WHEN length(text) < 100 THEN 'too short' WHEN length(regexp_replace(text, '{T.NOT_VALUABLE}', '', 'g')) = 0 THEN 'no valuable text'
        WHEN {_LANG_SQL.format(c='lang')} = 'DEU' THEN 'already in the target language' ELSE 'kept' END AS reason FROM documents""",
)


def skip_language(df, lang, skipped: str):
    """Rows whose language is not in a comma-separated list."""
    wanted = [x.strip().upper() for x in skipped.split(",")]
    return df.where(~language_code(lang).isin(wanted))


QUERIES["skip_language"] = (
    lambda spark, sf_dir: skip_language(table(spark, sf_dir, "documents"), F.col("lang"), "deu , FRA").select("doc_id", "lang"),
    f"SELECT doc_id, lang FROM documents WHERE {_LANG_SQL.format(c='lang')} NOT IN ('DEU', 'FRA')",
)


def translation_reason(src, dst, filter_text: str | None = None):
    """Why a translation is dropped: blank, numeric, filtered, same; null if it stays."""
    same = F.lower(T.strip(src)) == F.lower(T.strip(dst))
    reason = F.when(T.strip(dst) == "", "blank").when(dst.rlike(r"^\p{N}+$"), "numeric")
    if filter_text:
        reason = reason.when(dst.rlike(filter_text), "filtered")
    return reason.when(same, "same")


_pairs(
    "translation_filter",
    rf"""CASE WHEN {_strip('dst')} = '' THEN 'blank' WHEN regexp_matches(dst, '^\p{{N}}+$') THEN 'numeric' WHEN regexp_matches(dst, '(ha ){{5}}') THEN 'filtered'
         WHEN lower({_strip('src')}) = lower({_strip('dst')}) THEN 'same' ELSE 'kept' END AS reason""",
    lambda: dict(reason=F.coalesce(translation_reason(F.col("src"), F.col("dst"), "(ha ){5}"), F.lit("kept"))),
)
_DISTINCT = "len(list_distinct(string_split({t}, '')))"
_pairs(
    "invalid_translation",
    f"""CASE WHEN dst = '' AND src <> '' THEN true WHEN dst = '' OR src = '' THEN false
        ELSE {_DISTINCT.format(t='src')} > 6 AND {_DISTINCT.format(t='dst')} < 6 AND {_DISTINCT.format(t='dst')} < 0.25 * length(dst) END AS invalid""",
    lambda: dict(invalid=T.invalid_translation(F.col("src"), F.col("dst"))),
)
_pairs(
    "repetition_flag",
    None,
    lambda: dict(kind=T.repetition_kind(F.col("dst"), 20)),
)
_pairs(
    "repetition_flag_five",
    None,
    lambda: dict(kind=T.repetition_kind(F.col("src"), 5)),
)
_pairs(
    "pattern_repeat",
    None,
    lambda: dict(pattern_size=T.pattern_repeat(F.col("dst"), 20), squeezed=T.pattern_squeeze(F.col("dst"), 20)),
)


def _repeat_guard(spark, sf_dir):
    """Batches (conversations) with a reply whose longest run of a character passes max(20, that of the sources)."""
    def run(c):
        return F.array_max(F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(c, F.lit(r"(?s)((.)\2*)"), F.lit(1)), lambda x: F.length(x))))

    p = table(spark, sf_dir, "pairs_fx").select("conv_id", run(F.col("src")).alias("s"), run(F.col("dst")).alias("d"))
    return p.groupBy("conv_id").agg(F.max("s").alias("src_run"), F.max("d").alias("dst_run")).select(
        "conv_id", "src_run", "dst_run", (F.col("dst_run") > F.greatest(F.col("src_run"), F.lit(20))).alias("flagged")
    )


QUERIES["repeat_guard"] = (
    _repeat_guard,
    sql_with(
        "pairs_fx",
        """WITH c AS (SELECT conv_id, pos, 's' AS side, string_split(src, '') AS a FROM pairs_fx WHERE src <> '' UNION ALL SELECT conv_id, pos, 'd', string_split(dst, '') FROM pairs_fx WHERE dst <> ''),
        x AS (SELECT conv_id, pos, side, unnest(a) AS ch, generate_subscripts(a, 1) AS i FROM c),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, pos, side, ch ORDER BY i) AS island FROM x),
        r AS (SELECT conv_id, side, count(*) AS n FROM g GROUP BY conv_id, pos, side, ch, island),
        m AS (SELECT p.conv_id, coalesce(max(n) FILTER (side = 's'), 0) AS src_run, coalesce(max(n) FILTER (side = 'd'), 0) AS dst_run
              FROM (SELECT DISTINCT conv_id FROM pairs_fx) p LEFT JOIN r ON p.conv_id = r.conv_id GROUP BY p.conv_id)
        SELECT conv_id, src_run, dst_run, dst_run > greatest(src_run, 20) AS flagged FROM m""",
    ),
)
_REFUSE = "concat(src, CASE pos WHEN 0 THEN ' Sorry, I cannot help' WHEN 1 THEN '申し訳ありませんが' ELSE '' END)"
_pairs(
    "refusal_flag",
    f"regexp_matches({_REFUSE}, '(?is)" + "|".join(f"(?:{p})" for p in T.REFUSALS).replace("'", "''") + "') AS refused",
    lambda: dict(refused=T.refusal_flag(F.concat(F.col("src"), F.when(F.col("pos") == 0, " Sorry, I cannot help").when(F.col("pos") == 1, "申し訳ありませんが").otherwise("")))),
)
_pairs(
    "suspicious_symbols",
    "regexp_matches(src || CASE WHEN pos = 1 THEN 'ହ' ELSE '' END, '[ହିഹ]') AS suspicious",
    lambda: dict(suspicious=F.concat(F.col("src"), F.when(F.col("pos") == 1, "ହ").otherwise("")).rlike("[ହିഹ]")),
)
_PUNCT = r"'^[!-/:-@\[-`{-~]*$'"
_pairs(
    "merged_pair_flag",
    f"""((regexp_matches(dst, {_PUNCT}) AND dst <> '' AND NOT regexp_matches(src, {_PUNCT})) OR ({_strip('dst')} = '' AND {_strip('src')} <> '')) AS merged""",
    lambda: dict(merged=T.merged_pair_flag(F.col("src"), F.col("dst"))),
)
def _un():
    return F.concat(F.when(F.col("pos") % 2 == 0, "「").otherwise("（"), F.col("src"), F.when(F.col("pos") % 3 == 0, "」").otherwise(""))


_UN_SQL = "concat(CASE WHEN pos % 2 = 0 THEN '「' ELSE '（' END, src, CASE WHEN pos % 3 = 0 THEN '」' ELSE '' END)"
_pairs(
    "unbalanced_symbol_strip",
    f"CASE WHEN {_n(_UN_SQL, '[「『【（]')} <> {_n(_UN_SQL, '[」』】）]')} THEN regexp_replace({_UN_SQL}, '[「『【（」』】）]', '', 'g') ELSE {_UN_SQL} END AS stripped",
    lambda: dict(stripped=T.unbalanced_symbol_strip(_un())),
)
_pairs(
    "word_segments",
    None,
    lambda: dict(segments=T.word_segments(F.col("src"))),
)
