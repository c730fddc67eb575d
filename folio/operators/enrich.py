"""Batched enrichment around a user's function: batches, retries, halving, fallbacks, chains, and language checks."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import strip, valuable_chars
from folio.operators.batching import fixed_batches
from folio.storage import materialize

#: A user's function: a list of texts to a list of answers, of any length.
Translate = Callable[[list[str]], list[str]]
#: Trigrams that a task counts at once.
GRAMS = 1 << 21


def run_batches(rows: DataFrame, key: str, order: str, text: str, fn: Translate, cap: int) -> DataFrame:
    """rows(key, order, text) plus dst: fn is called once per batch; missing answers are '', extra ones are dropped."""
    batched = fixed_batches(rows, key, order, cap)

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)
        out = list(fn(p[text].tolist()))[: len(p)]
        return p.assign(dst=out + [""] * (len(p) - len(out)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batched.schema.fields) + ", dst string"
    return batched.groupBy(key, "batch").applyInPandas(call, schema).drop("batch")


def enrich_batches(rows: DataFrame, key: str, order: str, text: str, fn: Translate, cap: int = 8, same_language: bool = False) -> DataFrame:
    """rows plus dst; rows without valuable text, and all rows of an unchanged language, keep their own text and never reach fn."""
    if same_language:
        return rows.withColumn("dst", F.col(text))
    worth = valuable_chars(F.col(text)) > 0
    return run_batches(rows.where(worth), key, order, text, fn, cap).unionByName(rows.where(~worth).withColumn("dst", F.col(text)))


def retry_invalid(rows: DataFrame, key: str, order: str, text: str, fns: list[Translate], invalid: Callable[[Column, Column], Column], cap: int = 8) -> DataFrame:
    """rows plus dst and attempts: up to len(fns) rounds, each only over the rows still invalid; the last value stays."""
    done = None
    todo = rows
    for n, fn in enumerate(fns, 1):
        out = materialize(enrich_batches(todo, key, order, text, fn, cap).withColumn("attempts", F.lit(n)), "retry")
        bad = F.coalesce(invalid(F.col(text), F.col("dst")), F.lit(False))
        good = out if n == len(fns) else out.where(~bad)
        done = good if done is None else done.unionByName(good)
        todo = out.where(bad).select(*rows.columns)
    return done


def split_retry(rows: DataFrame, key: str, order: str, text: str, fn: Translate, cap: int = 8, depth: int = 3) -> DataFrame:
    """rows plus dst: a batch whose answers do not match in number is halved, to `depth` levels; then the source stays."""
    done, todo = None, fixed_batches(rows, key, order, cap).withColumnRenamed("batch", "part")

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order)
        out = list(fn(p[text].tolist()))
        fits = len(out) == len(p)
        half = (len(p) + 1) // 2
        parts = [part * 2 + (i >= half) for i, part in enumerate(p["part"])]
        return p.assign(dst=out if fits else [None] * len(p), part=p["part"] if fits else parts)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in todo.schema.fields) + ", dst string"
    for _ in range(depth + 1):
        out = materialize(todo.groupBy(key, "part").applyInPandas(call, schema), "split")
        good = out.where("dst is not null")
        done = good if done is None else done.unionByName(good)
        todo = out.where("dst is null").drop("dst")
    return done.unionByName(todo.withColumn("dst", F.col(text))).drop("part")


def fallback_enrich(rows: DataFrame, key: str, order: str, text: str, fn: Translate, second: Translate, cap: int = 8) -> DataFrame:
    """rows plus dst and route: keys all of whose answers are empty go to the second function, taken if any answer differs from its source."""
    first = materialize(enrich_batches(rows, key, order, text, fn, cap), "first")
    failed = first.groupBy(key).agg(F.bool_and(F.col("dst") == "").alias("f")).where("f").select(key)
    again = materialize(enrich_batches(rows.join(failed, key, "left_semi"), key, order, text, second, cap), "second")
    taken = again.groupBy(key).agg(F.bool_or(F.col("dst") != F.col(text)).alias("ok"))
    fell = again.join(taken, key).withColumn("dst", F.when(F.col("ok") & (F.col("dst") != ""), F.col("dst")).otherwise(F.col(text))).drop("ok")
    return first.join(failed, key, "left_anti").withColumn("route", F.lit("first")).unionByName(fell.withColumn("route", F.lit("second")))


def chain_enrich(rows: DataFrame, key: str, order: str, text: str, steps: list[tuple[str, Translate]], cap: int = 8) -> DataFrame:
    """rows plus dst and steps map<language, text>: functions one after another, each on the answers of the one before."""
    out = rows.withColumn("dst", F.col(text)).withColumn("steps", F.create_map().cast("map<string,string>"))
    for lang, fn in steps:
        nxt = run_batches(out.withColumnRenamed("dst", "src_now"), key, order, "src_now", fn, cap).drop("src_now")
        out = nxt.withColumn("steps", F.map_concat("steps", F.create_map(F.lit(lang), F.col("dst"))))
    return out


def screened_route(rows: DataFrame, key: str, order: str, text: str, first: Translate, second: Translate, flagged: Callable[[Column], Column], cap: int = 8) -> DataFrame:
    """rows plus first (the answer of the first function, which all get), dst and route: rows that it flags keep that answer, the others get the second function's.

    So a row is the log's line of itself. A null flag is none.
    """
    a = materialize(enrich_batches(rows, key, order, text, first, cap).withColumn("first", F.col("dst")), "route")
    flag = F.coalesce(flagged(F.col("first")), F.lit(False))
    kept = a.where(flag).withColumn("route", F.lit("first"))
    return kept.unionByName(enrich_batches(a.where(~flag).drop("dst"), key, order, text, second, cap).withColumn("route", F.lit("second")))


def route_by_language(groups: DataFrame, lang: str, routes: dict[str, str], default: str) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv])
    return groups.withColumn("route", F.coalesce(F.try_element_at(table, F.col(lang)), F.lit(default)))


def combine_regions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a, and those of b whose key a does not have."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"))


def failed_pages(jobs: DataFrame, failures: DataFrame, key: str, page: str) -> DataFrame:
    """jobs(key, ...) plus failed: the distinct pages of failures(key, page) in order, none for a job without any."""
    pages = failures.where(F.col(page).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(page)).alias("failed"))  # as many as a job has pages
    empty = F.array().cast(pages.schema["failed"].dataType)
    return jobs.join(pages, key, "left").withColumn("failed", F.coalesce("failed", empty))


def language_profile(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(gram, lang, n, total, v): counts of character trigrams by language, of each language, and the number of different ones. Kept as a table.

    A gram is the number that its three characters make. Tasks count what they read, so only different grams are shuffled.
    """
    counts = _gram_counts(docs, lang, text).groupBy("gram", F.col("by").alias("lang")).agg(F.sum("k").alias("n"))
    counts = materialize(counts, "language-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    v = counts.agg(F.countDistinct("gram").alias("v"))
    return counts.join(F.broadcast(totals), "lang").withColumn("v", F.lit(v.first()["v"]))


def _grams(text: bytes | None) -> np.ndarray:
    """The trigrams of a text in UTF-8, 21 bits a character."""
    c = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


def _in_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, list, list[np.ndarray]]]:
    """The type of the first column, its values and the grams of the second, up to about GRAMS at once; texts without grams are left out."""
    for b in batches:
        keys, parts, held = [], [], 0
        for key, text in zip(b.column(0).to_pylist(), b.column(1)):
            if len(grams := _grams(text.as_py())):
                keys.append(key)
                parts.append(grams)
                held += len(grams)
            if held >= GRAMS:
                yield b.schema.field(0).type, keys, parts
                keys, parts, held = [], [], 0
        if keys:
            yield b.schema.field(0).type, keys, parts


def _gram_counts(docs: DataFrame, by: str, text: str) -> DataFrame:
    """(by, gram, k): how often trigrams occur in the lower case of texts, by a column; counted within tasks, so a pair may come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, keys, parts in _in_turns(batches):
            of = defaultdict(list)
            for key, grams in zip(keys, parts):
                of[key].append(grams)
            for key, some in of.items():
                gram, k = np.unique(np.concatenate(some), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key, kind), len(gram)), pa.array(gram, pa.int64()), pa.array(k, pa.int64())], names=["by", "gram", "k"])

    rows = docs.select(F.col(by).alias("by"), F.lower(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"by {docs.schema[by].dataType.simpleString()}, gram bigint, k bigint")


def _gain_sums(docs: DataFrame, wide: DataFrame, id_col: str, text: str, names: list[str]) -> DataFrame:
    """(id, m, names...): the number of a text's trigrams and the sums of their gains, from a table that goes to every task."""
    table = wide.toPandas().sort_values("gram")
    zero = np.zeros((1, len(names)))  # what a gram has that is not in the table
    sent = docs.sparkSession.sparkContext.broadcast((table["gram"].to_numpy(np.int64), np.concatenate([table[names].to_numpy(np.float64), zero])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gains = sent.value
        for kind, keys, parts in _in_turns(batches):
            grams, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
            at = np.searchsorted(known, grams)
            at[(at < len(known)) & (np.append(known, -1)[at] != grams)] = len(known)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            sums = [np.add.reduceat(gains[at, i], starts) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(sizes, pa.int64()), *map(pa.array, sums)], names=["id", "m", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.lower(text).cast("binary").alias("text"))
    ddl = f"id {docs.schema[id_col].dataType.simpleString()}, m bigint" + "".join(f", {n} double" for n in names)
    return rows.mapInArrow(run, ddl).groupBy("id").agg(F.sum("m").alias("m"), *[F.sum(n).alias(n) for n in names])


def language_detect(docs: DataFrame, profile: DataFrame, id_col: str, text: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id, language, score) by naive Bayes with add-one smoothing: best mean log probability of the trigrams.

    A gram unseen in a language costs log(1 / (total + v)); this base is added per gram. The profile
    becomes one row per gram with a gain per language. While it has at most broadcast_rows rows it
    goes to every task, so that only sums per document are shuffled; beyond that it is joined.
    """
    sizes = profile.select("lang", "total", "v").distinct().orderBy("lang").collect()  # one row per language
    gain = lambda r: F.coalesce(F.max(F.when(F.col("lang").eqNullSafe(F.lit(r["lang"])), F.log(F.col("n") + 1))), F.lit(0.0))
    wide = profile.groupBy("gram").agg(*[gain(r).alias(f"g{i}") for i, r in enumerate(sizes)], F.lit(0.0).alias("g"))
    wide = materialize(wide, "language-gains")
    names = [f"g{i}" for i in range(len(sizes))]
    if wide.count() <= broadcast_rows:
        sums = _gain_sums(docs, wide, id_col, text, names)
    else:
        met = _gram_counts(docs, id_col, text).withColumnRenamed("by", "id").join(wide, "gram", "left")
        sums = met.groupBy("id").agg(F.sum("k").alias("m"), *[F.sum(F.col("k") * F.coalesce(F.col(n), F.lit(0.0))).alias(n) for n in names])
    score = lambda i, r: F.col(f"g{i}") / F.col("m") - math.log(r["total"] + r["v"])
    # a language none of whose grams occur is not scored
    found = F.array(*[F.when(F.col(f"g{i}") > 0, F.struct(F.round(score(i, r), 9).alias("k"), F.lit(r["lang"]).alias("lang"), score(i, r).alias("score"))) for i, r in enumerate(sizes)])
    best = sums.select("id", F.array_max(found).alias("b")) if sizes else sums.select("id", F.lit(None).cast("struct<k:double,lang:string,score:double>").alias("b"))
    return best.where("b is not null").select(F.col("id").alias(id_col), F.col("b.lang").alias("language"), F.col("b.score").alias("score"))


def page_language_check(rows: DataFrame, page: str, order: str, profile: DataFrame, target: str, least: int = 10) -> DataFrame:
    """(page, n, passed): a page of more than `least` regions passes only if the language detected in its merged texts is the target.

    The stripped texts (column dst) are merged in order, without a space; a page without any passes,
    one whose language cannot be told (under three characters, no gram in the profile) does not.
    """
    text = F.nullif(strip(F.col("dst")), F.lit(""))
    merged = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text.alias("t")))), lambda r: F.coalesce(r["t"], F.lit(""))), "")
    pages = materialize(rows.groupBy(page).agg(F.count("*").alias("n"), merged.alias("merged")), "page-texts")
    asked = pages.where((F.col("n") > least) & (F.col("merged") != ""))
    detected = language_detect(asked, profile, page, "merged").select(page, (F.col("language") == target).alias("right"))
    free = (F.col("n") <= least) | (F.col("merged") == "")
    return pages.join(detected, page, "left").select(page, "n", (free | F.coalesce("right", F.lit(False))).alias("passed"))


def page_retry(rows: DataFrame, page: str, order: str, text: str, fns: list[Translate], fails: Callable[[DataFrame], DataFrame], cap: int = 8) -> DataFrame:
    """rows plus dst and attempts: pages that fails(rows) returns are run again whole, by the next function."""
    done, todo = None, rows
    for k, fn in enumerate(fns, 1):
        out = materialize(enrich_batches(todo, page, order, text, fn, cap).withColumn("attempts", F.lit(k)), "page-retry")
        bad = fails(out).select(page).distinct()
        good = out if k == len(fns) else out.join(bad, page, "left_anti")
        done = good if done is None else done.unionByName(good)
        todo = rows.join(materialize(bad, "page-bad"), page, "left_semi")
    return done


