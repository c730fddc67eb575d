"""Batches of queries, prompts from batches, and answers parsed back into rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.folds import Flush, Fold, Pack, folded


def ordered(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row per key with rows: array of structs (order, columns...) in order."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("rows"))


def fixed_batches(df: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """df plus batch: every `cap` rows of a key in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("batch", F.floor((n - 1) / cap).cast("long"))


def _batched(rows: DataFrame, key: str, order: str, fold: Callable[[], Fold]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return folded(rows, key, order, order, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, batch bigint", fold)


def budget_pack(df: DataFrame, key: str, order: str, size: Column, limit: int, overhead: int = 10) -> DataFrame:
    """df(key, order) plus batch: a new batch begins when the next row and its overhead no longer fit and the batch is not empty.

    The sizes of a key are streamed in order; a key of any length is held nowhere.
    """
    sized = df.select(F.col(key), F.col(order), size.cast("long").alias("size"))
    return _batched(sized, key, order, lambda: Pack(limit, overhead))


def page_flush(df: DataFrame, key: str, order: str, tokens: str, cap: int, soft: int) -> DataFrame:
    """df(key, order) plus batch by token estimate: a third of the budget or 3 pages first, then cap pages or the budget, a third of it near the end."""
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"))
    sized = df.select(F.col(key), F.col(order), F.col(tokens).cast("long").alias("size")).join(counts, F.col(key).eqNullSafe(F.col("_key")))
    return _batched(sized.select(key, order, "size", "n"), key, order, lambda: Flush(cap, soft))


def prompt_build(df: DataFrame, keys: list[str], order: str, text: str, template: str = "") -> DataFrame:
    """One prompt per batch: the template and a numbered line per query."""
    listed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("rows"))
    lines = F.transform("rows", lambda r, i: F.concat(F.lit("\n<|"), (i + 1).cast("string"), F.lit("|>"), r[text]))
    return listed.select(*keys, F.ltrim(F.concat(F.lit(template), F.array_join(lines, "")), F.lit("\n ")).alias("prompt"), F.size("rows").cast("long").alias("n"))


def json_prompt_build(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    listed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("rows"))
    items = F.transform("rows", lambda r, i: F.struct(i.alias("ID"), r[text].alias("text")))
    return listed.select(*keys, F.to_json(F.struct(items.alias("TextList"))).alias("prompt"))


def tagged_parse(df: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """(keys, pos, text) of the parts of an answer between numbered tags; an empty first part goes."""
    parts = F.transform(F.split(answer, r"<\|\d+\|>"), lambda t: F.regexp_replace(F.trim(F.regexp_replace(t, r"^\s+|\s+$", "")), r"^\|", ""))
    rows = df.select(*keys, F.when(F.get(parts, F.lit(0)) == "", F.slice(parts, 2, F.size(parts))).otherwise(parts).alias("parts"))
    return rows.select(*keys, F.posexplode("parts").alias("pos", "text"))


def tagged_validate(df: DataFrame, answer: str, expected: str, sources: str, texts: str) -> Column:
    """Status of a batch: duplicate index, index out of range, missing index, wrong count, empty text, or ok."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"(?m)^\s*<\|(\d+)\|>"), F.lit(1)), lambda n: n.cast("int"))
    n = F.col(expected)
    wanted = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    hollow = F.exists(F.zip_with(sources, texts, lambda s, t: (F.trim(s) != "") & (F.trim(F.coalesce(t, F.lit(""))) == "")), lambda x: F.coalesce(x, F.lit(False)))
    return (
        F.when(F.size(found) != F.size(F.array_distinct(found)), "duplicate index")
        .when(F.exists(found, lambda x: (x < 1) | (x > n)), "index out of range")
        .when(F.size(F.array_except(wanted, found)) > 0, "missing index")
        .when(F.size(texts) != n, "wrong count")
        .when(hollow, "empty text")
        .otherwise("ok")
    )


def align_batch(queries: DataFrame, answers: DataFrame, keys: list[str], text: str, answer: str, valuable: Column) -> DataFrame:
    """Answers back on queries by position: missing ones '', extra ones dropped, worthless queries keep their text."""
    joined = queries.join(answers.select(*keys, answer), keys, "left")
    return joined.withColumn("dst", F.when(valuable, F.coalesce(answer, F.lit(""))).otherwise(F.col(text))).drop(answer)


ANSWER = "struct<TextList:array<struct<ID:int,text:string>>>"


def json_parse(queries: DataFrame, answers: DataFrame, key: str, pos: str, text: str, answer: str) -> DataFrame:
    """Queries plus dst by ID - min(ID), the source where an ID is missing, and a status per batch."""
    items = answers.select(key, F.from_json(answer, ANSWER).alias("j")).select(key, F.col("j.TextList").alias("items"))
    low = F.array_min(F.transform("items", lambda x: x["ID"]))
    checked = items.select(
        key, "items", low.alias("low"),
        F.when(F.col("items").isNull() | F.exists("items", lambda x: x["ID"].isNull() | x["text"].isNull()), "bad item").alias("bad"),
    )
    sizes = queries.groupBy(key).agg(F.count("*").alias("n"))
    status = sizes.join(checked, key, "left").withColumn(
        "status",
        F.coalesce("bad", F.when(F.col("items").isNull(), "no answer").when(F.exists("items", lambda x: x["ID"] - F.col("low") >= F.col("n")), "id out of range"), F.lit("ok")),
    )
    found = status.where("status = 'ok'").select(key, "low", F.explode("items").alias("x")).select(key, (F.col("x.ID") - F.col("low")).alias("slot"), F.col("x.text").alias("found"))
    found = found.groupBy(key, "slot").agg(F.max("found").alias("found"))
    numbered = queries.withColumn("slot", (F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1).cast("int"))
    return numbered.join(found, [key, "slot"], "left").join(status.select(key, "status"), key).select(
        key, pos, F.coalesce("found", text).alias("dst"), "status"
    )


def json_salvage(text: Column) -> Column:
    """The answer from its first bracket to its last, without code fences; unchanged if there is none."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    cut = F.regexp_extract(bare, r"(?s)[\[{].*[\]}]", 0)
    return F.when(cut == "", F.trim(bare)).otherwise(cut)


def flag_parse(answer: Column, n: Column) -> Column:
    """array<boolean>: one flag per line with the word true or false, padded with false and cut to n."""
    lines = F.filter(F.split(F.lower(answer), "\n"), lambda t: t.rlike(r"\b(true|false)\b"))
    flags = F.transform(lines, lambda t: t.rlike(r"\btrue\b"))
    return F.slice(F.concat(flags, F.array_repeat(F.lit(False), n)), F.lit(1), n)


def order_remap(answers: DataFrame, queries: DataFrame, key: str, pos: str, text: str, answer: str) -> DataFrame:
    """Answers of (reading order, original id, text) back in original order; any mismatch of ids gives the originals."""
    schema = "array<struct<order:int,id:int,text:string>>"
    items = answers.select(key, F.from_json(answer, schema).alias("items"))
    sizes = queries.groupBy(key).agg(F.count("*").cast("int").alias("n"))
    good = sizes.join(items, key).where(F.array_sort(F.transform("items", lambda x: x["id"])) == F.sequence(F.lit(0), F.col("n") - 1))
    rows = good.select(key, F.explode("items").alias("x")).select(key, F.col("x.id").alias("slot"), F.col("x.order").alias("reading"), F.col("x.text").alias("found"))
    numbered = queries.withColumn("slot", (F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1).cast("int"))
    return numbered.join(rows, [key, "slot"], "left").select(key, pos, F.coalesce("found", text).alias("dst"), F.coalesce("reading", "slot").alias("reading"))
