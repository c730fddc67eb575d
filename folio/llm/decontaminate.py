"""Benchmark decontamination by canonical templates; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.storage import materialize

# Measure words that follow a number.
UNITS = (
    "kg|kgs|g|mg|lb|lbs|oz|t|km|m|cm|mm|mi|ft|in|yd|l|ml|s|sec|secs|second|seconds|min|mins|minute|minutes|h|hr|hrs|hour|hours|"
    "day|days|week|weeks|month|months|year|years|mile|miles|meter|meters|metre|metres|kilometer|kilometers|inch|inches|foot|feet|yard|"
    "yards|gram|grams|kilogram|kilograms|pound|pounds|ounce|ounces|liter|liters|litre|litres|gallon|gallons|dollar|dollars|cent|cents|"
    "euro|euros|percent|degree|degrees|usd|eur|mph|kmh|kb|mb|gb"
)
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: Template words of a window; items with fewer words are one window.
WINDOW = 8
#: Words that a copy may have more or less than its item between two hits, to count as one occurrence.
DRIFT = 4
#: What a hit is judged with: its document, the hits of the same start, or those of near starts.
WHOLE, START, RUN = 0, 1, 2


def _spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x20\x{A0}]+", " ")


def _marked(text: Column) -> Column:
    """Words without punctuation; a capitalised word inside a sentence bears the name mark in front."""
    named = F.regexp_replace(_spaced(text), r"(?<=[\p{Ll}\p{N},;:] )(?=\p{Lu}\p{Ll})", NAME)
    return F.trim(_spaced(F.regexp_replace(named, r"[^\p{L}\p{M}\p{N}\x20" + NAME + "]+", "")))


def slot_words(text: Column) -> Column:
    """The words as they stand, aligned with template_words."""
    return F.split(_marked(text), " ")


def _bare(word: Column) -> Column:
    return F.translate(word, NAME, "")


def value_words(text: Column) -> Column:
    """The lower-cased words without name marks, aligned with template_words."""
    return F.split(F.lower(_bare(_marked(text))), " ")


def _template(text: Column) -> Column:
    t = F.lower(F.regexp_replace(_marked(text), NAME + r"\S+", NAME))
    t = F.regexp_replace(t, r"\S*\p{N}\S*", NUMBER)
    return F.regexp_replace(t, f"(?<={NUMBER} )(?:{UNITS})(?= |$)", UNIT)


def template_words(text: Column) -> Column:
    """Lower-cased words with names, numbers and the units behind numbers replaced by their type."""
    return F.split(_template(text), " ")


def _heavy(template: Column, n: Column) -> Column:
    """Whether more than half of the n words of a window are placeholders."""
    return 2 * F.size(F.filter(template, lambda w: w.isin(NAME, NUMBER, UNIT))) > n


def _may_be_heavy(template: Column, n: int) -> Column:
    """Whether a text can have a heavy window of n words: n // 2 + 1 placeholders with so few words between them."""
    mark, word, most = f"[{NAME}{NUMBER}{UNIT}]", f"[^ {NAME}{NUMBER}{UNIT}]+", n - (n // 2 + 1)
    return template.rlike(f"{mark}(?: (?:{word} ){{0,{most}}}{mark}){{{n // 2}}}")


def _windows(words: Column, n: int) -> Column:
    """Hash of each window of n words of a bound array; none if there are fewer."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, n)))


def _hashes(words: Column, sizes: list[int]) -> Column:
    """Hashes of the windows of all sizes; the words are bound once, before the windows are cut."""
    return F.flatten(F.transform(F.array(words), lambda ws: F.concat(*[_windows(ws, n) for n in sizes])))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, at, heavy, key, template, slots, words, n_windows) of the template windows of each item.

    The first word of an item is taken both as written and as a name, since inside a document a
    capital there looks like one. Windows of which more than half are placeholders (heavy) say too
    little as templates: their key is that of the words as they stand, so they are found where the
    values are the item's. Items without words have no windows.
    """
    base = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    inside = F.concat(F.lit("a, "), F.col("text"))
    plain, second = template_words(F.col("text")), template_words(inside)
    templates = F.array_distinct(F.array(plain, F.slice(second, F.lit(2), F.size(second))))
    variants = base.select("item_id", slot_words(F.col("text")).alias("raw"), value_words(F.col("text")).alias("values"), F.explode(templates).alias("marked"))
    variants = variants.where(F.size("marked") > 0).where("marked[0] <> ''")
    n = F.least(F.lit(window), F.size("marked"))
    rows = variants.select("item_id", "raw", "values", "marked", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("marked") - n + 1)).alias("at"))
    cut = lambda c: F.slice(c, F.col("at"), F.col("n"))
    rows = rows.select(
        "item_id", "n", "at", cut("marked").alias("template"), cut("raw").alias("slots"), cut("values").alias("words"), (F.size("marked") - F.col("n") + 1).alias("n_windows")
    )
    rows = rows.withColumn("heavy", _heavy(F.col("template"), F.col("n")))
    return rows.withColumn("key", F.when(F.col("heavy"), F.xxhash64("words")).otherwise(F.xxhash64("template"))).distinct()


def _placed(hits: DataFrame) -> DataFrame:
    """Each hit once for the whole document, once for the start that it gives the item in its text, once for the run of near starts."""
    by_start = Window.partitionBy("doc_id", "row", "item_id").orderBy("start")
    # items of few windows are short: their copies can stand closer together than DRIFT words
    apart = F.col("start") - F.lag("start").over(by_start) > F.least(F.lit(DRIFT), F.col("n_windows") - 1)
    runs = hits.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("run", F.sum("apart").over(by_start))
    place = lambda kind, row, no: F.struct(F.lit(kind).alias("kind"), row.alias("row"), no.cast("bigint").alias("no"))
    places = F.array(place(WHOLE, F.lit(0).cast("bigint"), F.lit(0)), place(START, F.col("row"), F.col("start")), place(RUN, F.col("row"), F.col("run")))
    return runs.withColumn("place", F.explode(places)).drop("apart", "run", "row", "start")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    least_share: float = 0.25,
    consistent: float = 0.8,
    broadcast_rows: int = 500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, share, n_slots, n_conflicts, reparameterised) of each item found in a document.

    A document holds an item when at least least_share of the item's template windows occur in it -
    those that are mostly placeholders word for word, whatever the case - and the slots agree: each name, number or unit of the item stands for one value throughout, in
    at least `consistent` of the distinct slots. Both are judged for the document as a whole and for
    each occurrence, that is the hits of one text that put the item's start at the same word or
    within DRIFT words of the hit before; one that passes is enough. The figures are those of the
    whole document if it passes, else of its best occurrence. reparameterised: some slot has another
    value than in the item. Only such (document, item) rows are returned.

    Windows of the benchmark go to every task while there are at most broadcast_rows of them, and
    are shuffled beyond that; hashes are checked against the template itself before they count.
    One scan looks up windows of all sizes; only the documents with a hit are cut again, to compare.
    Null texts and items hold no words, texts of any length are cut whole; repeated rows of an id count as one document, their texts
    as occurrences of their own; extra columns are ignored; empty tables give an empty table.
    """
    items = materialize(item_windows(benchmark, window), "templates")
    keys = items.select("key").distinct()
    kinds = sorted((r["n"], r["heavy"]) for r in items.select("n", "heavy").distinct().collect()) or [(window, False)]  # at most 2 * `window`
    few = items.count() <= broadcast_rows
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = base.select("doc_id", "text", _template(F.col("text")).alias("template"))
    # one scan for windows of all sizes; words as they stand are cut only from texts that can have a heavy window
    heavy_sizes = [n for n, heavy in kinds if heavy]
    marked = _hashes(F.split("template", " "), sorted({n for n, _ in kinds}))
    words = [F.when(_may_be_heavy(F.col("template"), n), _hashes(value_words(F.col("text")), [n])).otherwise(F.array().cast("array<bigint>")) for n in heavy_sizes]
    one = texts.select("doc_id", F.explode(F.concat(marked, *words)).alias("key"))
    suspects = one.join(F.broadcast(keys) if few else keys.hint("merge"), "key", "left_semi").select("doc_id").distinct()
    suspects = materialize(suspects, "suspects")
    near = base.join(suspects, "doc_id", "left_semi").select(
        "doc_id", F.xxhash64("text").alias("row"), template_words(F.col("text")).alias("marked"), slot_words(F.col("text")).alias("raw"),
        value_words(F.col("text")).alias("words"),
    )
    rows = None
    for n, heavy in kinds:
        cut = lambda c: F.slice(c, F.col("p") + 1, n)  # noqa: E731, B023
        w = near.select("doc_id", "row", "marked", "raw", "words", F.posexplode(_hashes(F.col("words" if heavy else "marked"), [n])).alias("p", "key"))
        same = "words" if heavy else "template"
        w = w.select("doc_id", "row", "p", "key", cut("words" if heavy else "marked").alias(same), cut("raw").alias("values"))
        there = items.where((F.col("n") == n) & (F.col("heavy") == heavy))
        m = w.join(F.broadcast(there) if few else there.hint("merge"), ["key", same])
        m = m.select("doc_id", "row", "item_id", "at", "p", "n_windows", "template", "slots", "values")
        rows = m if rows is None else rows.union(m)
    rows = rows.select("doc_id", "row", "item_id", "at", (F.col("p") - F.col("at")).alias("start"), "n_windows", "template", "slots", "values")
    rows = _placed(materialize(rows, "template-hits"))
    group = ["doc_id", "item_id", "place"]
    share = rows.groupBy(*group).agg(F.countDistinct("at").alias("n_matched"), F.max("n_windows").alias("n_windows"))
    slots = rows.select(*group, F.explode(F.arrays_zip("template", "slots", "values")).alias("s")).where(F.col("s.template").isin(NAME, NUMBER, UNIT))
    slots = slots.select(*group, F.lower(_bare(F.col("s.slots"))).alias("old"), F.lower(_bare(F.col("s.values"))).alias("new"))
    slots = slots.groupBy(*group, "old").agg(F.countDistinct("new").alias("k"), F.max(F.col("old") != F.col("new")).alias("moved"))
    slots = slots.groupBy(*group).agg(F.count("*").alias("n_slots"), F.count_if(F.col("k") > 1).alias("n_conflicts"), F.max("moved").alias("reparameterised"))
    out = share.join(slots, group, "left").select(
        *group, "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("share"),
        F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
    )
    out = out.where((F.col("share") >= least_share) & (F.col("n_slots") - F.col("n_conflicts") >= consistent * F.col("n_slots")))
    figures = ["n_matched", "n_windows", "share", "n_slots", "n_conflicts", "reparameterised"]
    best = F.max_by(F.struct(*figures), F.struct(F.col("place.kind") == WHOLE, "share", -F.col("n_conflicts"), "place"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("f")).select("doc_id", "item_id", *[f"f.{c}" for c in figures])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs, all its columns, without the documents that hold a benchmark item. Rows with a null id stay."""
    held = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(held, id_col, "left_anti")
