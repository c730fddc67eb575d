"""Text expressions: counts, normalisation, repair and predicates as columns."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the counted and stripped characters.
NOT_VALUABLE = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E\p{P}\p{Cc}\p{Cf}\p{Zs}\p{Nd}]"
SMALL = "っッぁぃぅぇぉ"
WIDE = r"[\x{2E80}-\x{10FFFF}]"
BLANKS = r"[\s\p{Z}]"
# Small kana and what they become.
SMALL_KANA, NORMAL_KANA = "ァィゥェォッャュョぁぃぅぇぉっゃゅょ", "アイウエオツヤユヨあいうえおつやゆよ"
KATAKANA = "".join(map(chr, range(0x30A0, 0x3100)))
HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A0, 0x3100))
# Scripts in the order in which they name a text.
SCRIPTS = {
    "JPN": r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]",
    "KOR": r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]",
    "CN": r"[\x{4E00}-\x{9FFF}]",
    "ARA": r"[\x{0600}-\x{06FF}]",
    "THA": r"[\x{0E00}-\x{0E7F}]",
    "RUS": r"[\x{0400}-\x{04FF}]",
}
# Opening and closing marks of the repair, in pairs.
OPENERS = "(（[【{〔〈「\"＂'“《『〝﹁﹃⸂⸄⸉⸌⸜⸠‹«＜<"
CLOSERS = ")）]】}〕〉」\"＂'”》』〞﹂﹄⸃⸅⸊⸍⸝⸡›»＞>"
# A mark and the marks that stand for it, in order.
ALIGNMENT = (
    "(（「【", "（(「【", ")）」】", "）)」】", "[［【「", "［[【「", "]］】」", "］]】」",
    "「“‘『【", "」”’』】", "『“‘「【", "』”’」】", "【(（「『[", "】)）」』]",
)
# Case-insensitive patterns of an answer that refuses.
REFUSALS = (
    r"I must decline",
    r"(i('m| am)?\s+)?sorry(.|\n)*?(can(['’]t|not)|unable to)\s+(assist|help)",
    r"unable to (assist|help)",
    r"cannot (assist|help)",
    r"(抱歉，|对不起，)",
    r"我(无法[将把]|不[能会便](提供|处理))",
    r"我无法(满足|回答|处理|提供)",
    r"这超出了我的范围",
    r"我需要婉拒",
    r"翻译或生成",
    r"[个]内容(吧)?",
    r"申し訳ありませんが",
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once; inside a lambda an outer expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_of(text: Column, pattern: str | Column) -> Column:
    """Number of characters that match a one-character pattern."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, F.lit("")))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANKS}+|{BLANKS}+$", "")


def valuable_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, NOT_VALUABLE, ""))


def weighted_length(text: Column) -> Column:
    bare = strip(text)
    return F.length(bare) - 0.5 * count_of(bare, f"[{SMALL}]")


def token_estimate(text: Column) -> Column:
    """Tokens of a text: 0.7 per wide character, 0.35 per other, and 6 (in twentieths, so nothing rounds)."""
    wide = count_of(text, WIDE)
    return F.floor((wide * 14 + (F.length(text) - wide) * 7) / 20) + 6


def script_counts(text: Column) -> dict[str, Column]:
    return {name: count_of(text, cls) for name, cls in SCRIPTS.items()}


def script_label(text: Column) -> Column:
    out = F.lit("OTHER")
    for name, n in reversed(script_counts(text).items()):
        out = F.when(n > 0, name).otherwise(out)
    return out


def kana_normalize(text: Column) -> Column:
    return F.translate(F.translate(text, SMALL_KANA, NORMAL_KANA), KATAKANA, HIRAGANA)


def term_normalize(text: Column) -> Column:
    return kana_normalize(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_\s\p{Z}]", "")))


def query_preprocess(text: Column) -> Column:
    kept = F.regexp_replace(F.translate(text, SMALL_KANA, NORMAL_KANA), r"[\x{10000}-\x{10FFFF}]", "")
    return F.concat(F.lit("「"), F.replace(kept, F.lit("❤"), F.lit("♥")), F.lit("」"))


def query_restore(text: Column) -> Column:
    return F.regexp_replace(text, "^[「」]+|[「」]+$", "")


def bracket_repair(text: Column) -> Column:
    """Strip, drop marks without a partner, and give each closer the shape its opener asks for.

    A mark that can open always opens: straight quotes are pushed and never pop one another.
    """
    chars = F.split(strip(text), "")
    opens, closes = F.lit(OPENERS), F.lit(CLOSERS)
    at = F.zip_with(F.sequence(F.lit(1), F.size(chars)), chars, lambda i, c: F.struct(i.alias("i"), c.alias("c")))
    is_open = lambda c: F.call_function("instr", opens, c) > 0
    is_close = lambda c: F.call_function("instr", closes, c) > 0
    ints = F.array().cast("array<int>")
    first = F.aggregate(
        at,
        F.struct(ints.alias("stack"), ints.alias("skip")),
        lambda a, x: F.when(is_open(x["c"]), F.struct(F.concat(F.array(x["i"]), a["stack"]).alias("stack"), a["skip"].alias("skip")))
        .when(
            is_close(x["c"]),
            F.when(F.size(a["stack"]) > 0, F.struct(F.slice(a["stack"], F.lit(2), F.size(a["stack"])).alias("stack"), a["skip"].alias("skip"))).otherwise(
                F.struct(a["stack"].alias("stack"), F.concat(a["skip"], F.array(x["i"])).alias("skip"))
            ),
        )
        .otherwise(a),
        lambda a: F.concat(a["stack"], a["skip"]),
    )
    kept = let(first, lambda skip: F.filter(at, lambda x: ~F.array_contains(skip, x["i"])))
    second = F.aggregate(
        F.transform(kept, lambda x: x["c"]),
        F.struct(F.lit("").alias("stack"), F.lit("").alias("out")),
        lambda a, c: F.when(is_open(c), F.struct(F.concat(c, a["stack"]).alias("stack"), F.concat(a["out"], c).alias("out")))
        .when(
            is_close(c),
            F.when(
                a["stack"] != "",
                F.struct(
                    F.call_function("substr", a["stack"], F.lit(2)).alias("stack"),
                    F.concat(a["out"], F.translate(F.call_function("substr", a["stack"], F.lit(1), F.lit(1)), OPENERS, CLOSERS)).alias("out"),
                ),
            ).otherwise(a),
        )
        .otherwise(F.struct(a["stack"].alias("stack"), F.concat(a["out"], c).alias("out"))),
        lambda a: a["out"],
    )
    return F.when(text.isNull(), text).otherwise(strip(second))


def quote_transfer(src: Column, dst: Column) -> Column:
    """Straight quotes of a translation take the shape of the source's quotes if there are as many."""
    doubles, wides = count_of(dst, '"'), count_of(dst, "＂")
    out = dst
    for o, c in ("【】", "「」", "『』"):  # the last to be applied is looked for first
        n = count_of(src, _char_class(o))
        fits = ((n == doubles) | (n == wides)) & dst.rlike(r"[^\x00-\x7F]")
        has = F.contains(src, F.lit(o)) & F.contains(src, F.lit(c))
        out = F.when(has, F.when(fits, F.regexp_replace(dst, '"([^"]*)"', f"{o}$1{c}")).otherwise(dst)).otherwise(out)
    return out


def _char_class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def bracket_align(src: Column, dst: Column) -> Column:
    """Bring the marks of a translation to the source's, rule by rule, where their numbers allow it.

    One fold over the rules: chained conditions would repeat the text in every branch.
    """
    rules = F.array(*[
        F.struct(F.lit(_char_class(r[0])).alias("std"), F.lit(_char_class(r[1:])).alias("others"), F.lit(_char_class(r)).alias("all"), F.lit(r[1:]).alias("was"), F.lit(r[0] * (len(r) - 1)).alias("now"))
        for r in ALIGNMENT
    ])

    def apply(d: Column, r: Column) -> Column:
        n = count_of(src, r["std"])
        fits = (n > 0) & (n != count_of(src, r["others"])) & (n == count_of(d, r["all"]))
        return F.when(fits, F.call_function("translate", d, r["was"], r["now"])).otherwise(d)

    return F.aggregate(rules, dst, apply)


def bracket_force(dst: Column) -> Column:
    return F.translate(dst, "“‘”’[]", "「「」」【】")


def java_replacement(text: str) -> str:
    """A replacement in the rule files' notation for the regular expressions of the JVM: $ is literal, \\1 a group."""
    import re

    return re.sub(r"\\\\(\d)", r"$\1", text.replace("\\", "\\\\").replace("$", "\\$"))


def dict_apply(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered substitution: each rule sees what the rules before it made."""
    return reduce(lambda t, r: F.regexp_replace(t, r[0], java_replacement(r[1])), rules, text)


def dict_steps(text: Column, rules: list[tuple[str, str]]) -> Column:
    """array<string>: the text before the first rule and after each."""
    steps = [text]
    for pattern, to in rules:
        steps.append(F.regexp_replace(steps[-1], pattern, java_replacement(to)))
    return F.array(*steps)


def output_clean(dst: Column, arabic: Column | None = None) -> Column:
    w = r"[\p{L}\p{N}_]"
    t = F.regexp_replace(dst, r"\s+", " ")
    t = F.regexp_replace(t, rf"(?<![.,;!?])([.,;!?])(?={w})", "$1 ")
    t = F.regexp_replace(t, r"([.,;!?])\s+(?=[.,;!?]|$)", "$1")
    u = F.regexp_replace(t, rf"(?<=[.,;!?\p{{L}}\p{{N}}_])\s+([.,;!?])", "$1")
    u = F.regexp_replace(u, rf"((?:\s|^)\.+)\s+(?={w})", "$1")
    return u if arabic is None else F.when(arabic, t).otherwise(u)


def period(text: str) -> int:
    """Least shift under which a text stands on itself, by its border array: one pass, amortised."""
    border = [0] * len(text)
    k = 0
    for i in range(1, len(text)):
        while k and text[i] != text[k]:
            k = border[k - 1]
        k += text[i] == text[k]
        border[i] = k
    return len(text) - border[-1] if text else 0


def _units(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or 2 * period(t) > len(t) else t[: period(t)])


def repeat_unit(text: Column) -> Column:
    """Shortest prefix of at most half the text whose repetition gives the text; else the text."""
    return F.pandas_udf(_units, "string")(text)


def repeat_shrink(src: Column, dst: Column) -> Column:
    """A translation that is one unit repeated is rebuilt to the source's length with its capitals."""
    unit = repeat_unit(F.lower(dst))
    loops = (F.length(dst) < F.length(src)) & (F.length(unit) < 0.5 * F.length(dst))
    built = F.repeat(unit, F.greatest(F.floor(F.length(src) / F.length(unit)), F.lit(1)).cast("int"))
    cut = F.call_function("substr", built, F.lit(1), F.length(src))
    cased = F.zip_with(
        F.split(cut, ""), F.slice(F.split(src, ""), F.lit(1), F.length(cut)), lambda d, s: F.when(s.rlike(r"^\p{Lu}$"), F.upper(d)).otherwise(d)
    )
    return F.when(loops, F.array_join(cased, "")).otherwise(dst)


def tag_normalize(text: Column) -> Column:
    """Loose numbered tags such as '< | l0 | >' as '<|10|>'."""
    tag = r"<\s*\|\s*([0-9lLIiOo]+)\s*\|\s*>"
    parts = F.split(text, tag)
    nums = F.transform(F.regexp_extract_all(text, F.lit(tag), F.lit(1)), lambda n: F.concat(F.lit("<|"), F.translate(n, "lLIiOo", "111100"), F.lit("|>")))
    return F.array_join(F.zip_with(parts, nums, lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")


def capture_extract(text: Column, pattern: str, groups: int = 1) -> Column:
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
    rows = found[0] if groups == 1 else F.flatten(F.transform(F.arrays_zip(*found), lambda z: F.array(*[z[str(k)] for k in range(groups)])))
    return F.nullif(F.trim(F.array_join(rows, "\n")), F.lit(""))


def bullet_list(lines: Column) -> Column:
    """At least two lines whose starts are bullets of one kind only: a sign, a number with a dot, Q: or A:."""
    kinds = F.transform(
        lines,
        lambda t: F.when(t.rlike(r"^[^\p{L}\p{N}_\s]"), 1).when(t.rlike(r"^[0-9]+\."), 2).when(t.rlike(r"^[QA]:"), 3),
    )
    return (F.size(lines) > 1) & F.forall(kinds, lambda k: k.isNotNull()) & (F.size(F.array_distinct(kinds)) == 1)


def invalid_translation(src: Column, dst: Column) -> Column:
    distinct = lambda t: F.size(F.array_distinct(F.split(t, "")))
    few = (distinct(src) > 6) & (distinct(dst) < 6) & (distinct(dst) < 0.25 * F.length(dst))
    return F.when((dst == "") & (src != ""), True).when((dst == "") | (src == ""), False).otherwise(few)


def repeats_char(text: Column, times: int) -> Column:
    return text.rlike(rf"(?s)(.)\1{{{times - 1}}}")


def repeats_segment(text: Column, times: int) -> Column:
    """The same ideograph or word `times` times in a row."""
    parts = F.regexp_extract_all(text, F.lit(r"[\x{4E00}-\x{9FFF}]|[^\s\x{4E00}-\x{9FFF}]+"), F.lit(0))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a, x):
        run = F.when(x == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(parts, start, step, lambda a: a["best"]) >= times


def repeats_phrase(text: Column, times: int) -> Column:
    """With 2t words or more: a phrase of t/2 words that comes again later and three times in all."""
    k = times // 2
    often = lambda p: F.size(F.split(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(r"\Q"), p, F.lit(r"\E")))) > 3

    def found(words: Column) -> Column:
        phrases = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
        repeated = let(F.array_sort(phrases), lambda ps: F.array_distinct(F.filter(ps, lambda p, i: p == F.get(ps, i + 1))))
        return (F.size(words) >= 2 * times) & F.exists(repeated, often)

    return let(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), found)


def repetition_kind(text: Column, times: int) -> Column:
    """Which rule finds a repetition: char, segment, phrase; null if none."""
    long_enough = F.length(strip(text)) >= times
    return F.when(
        long_enough,
        F.when(repeats_char(text, times), "char").when(repeats_segment(text, times), "segment").when(repeats_phrase(text, times), "phrase"),
    )


def repeated_size(text: str, times: int) -> int | None:
    """Length of the smallest pattern that stands `times` times in a row: a shift by it leaves so long a stretch as it was. One vector pass a length."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for k in range(1, len(codes) // times + 1):
        apart = np.flatnonzero(np.r_[True, codes[k:] != codes[:-k], True])
        if np.diff(apart).max() > (times - 1) * k:
            return k
    return None


def pattern_repeat(text: Column, times: int = 20) -> Column:
    """Length of the smallest pattern that stands `times` times in a row; null if none."""

    def sizes(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else repeated_size(t, times) for t in texts], dtype="Int32")

    return F.pandas_udf(sizes, "int")(text)


def pattern_squeeze(text: Column, times: int = 20) -> Column:
    """The text with each run of `times` or more copies of a pattern cut to one copy."""
    return F.regexp_replace(text, rf"(?s)(.+?)\1{{{times - 1},}}", "$1")


def refusal_flag(text: Column, patterns: tuple[str, ...] = REFUSALS) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def merged_pair_flag(src: Column, dst: Column) -> Column:
    punct = r"^[!-/:-@\[-`{-~]*$"
    return (dst.rlike(punct) & (dst != "") & ~src.rlike(punct)) | ((strip(dst) == "") & (strip(src) != ""))


def unbalanced_symbol_strip(text: Column, lefts: str = "「『【（", rights: str = "」』】）") -> Column:
    uneven = count_of(text, f"[{lefts}]") != count_of(text, f"[{rights}]")
    return F.when(uneven, F.regexp_replace(text, f"[{lefts}{rights}]", "")).otherwise(text)


# Punctuation after which a word begins.
RIGHT_PUNCTUATION = '.?!:;)}"'


def word_segments(text: Column, right: str = RIGHT_PUNCTUATION) -> Column:
    """Words of a caption in capitals; a word of one or two letters joins the shorter of its neighbours.

    Two letters join a neighbour of at most four only. A fold over the words, each of which sees the
    last segment so far and the word to come.
    """
    marks = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in right) + "]"
    t = F.upper(strip(text))
    t = F.replace(F.replace(F.replace(t, F.lit("  "), F.lit(" ")), F.lit(" ."), F.lit(".")), F.lit("\n"), F.lit(" "))
    words = F.split(F.regexp_replace(t, rf"({marks})(?=[\p{{L}}\p{{N}}])", "$1 "), " ")
    kind = "struct<out:array<string>,skip:boolean>"

    def segments(ws: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            word, after, out = F.get(ws, i), F.get(ws, i + 1), a["out"]
            n, left, ahead = F.length(word), F.coalesce(F.length(F.get(out, F.size(out) - 1)), F.lit(-1)), F.coalesce(F.length(after), F.lit(-1))
            joins = lambda side: (n == 1) | ((n == 2) & (side <= 4))
            both = (left > 0) & (ahead > 0)
            to_right = (n < 3) & (ahead > 0) & F.when(both, ahead < left).otherwise(True) & joins(ahead)
            to_left = (n < 3) & (left >= 0) & F.when(both, ahead >= left).otherwise(ahead <= 0) & joins(left)
            glued = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(F.get(out, F.size(out) - 1), F.lit(" "), word)))
            grown = (
                F.when(to_left, F.struct(glued.alias("out"), F.lit(False).alias("skip")))
                .when(to_right, F.struct(F.concat(out, F.array(F.concat(word, F.lit(" "), after))).alias("out"), F.lit(True).alias("skip")))
                .otherwise(F.struct(F.concat(out, F.array(word)).alias("out"), F.lit(False).alias("skip")))
            )
            return F.when(a["skip"], F.struct(out.alias("out"), F.lit(False).alias("skip"))).otherwise(grown)

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip")).cast(kind)
        return F.aggregate(F.sequence(F.lit(0), F.size(ws) - 1), start, step, lambda a: a["out"])

    return let(words, segments)
