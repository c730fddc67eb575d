"""Exact duplicate removal by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, salts: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its group of equal texts.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    - Texts are equal when identical after each run of ASCII space becomes one space; a null text
      counts as empty. An empty table gives an empty table; other columns are ignored.
    - The smallest id of a group stays. Rows that repeat an id are rows of their own in group_size,
      and each of them that bears the kept id is kept. Null ids lose to any id; a group of null ids
      only has keep_id null and kept false.

    Three combines, each keyed by digest AND the whole text: within a task (map-side partial
    aggregation), within a salt (a hot digest is spread over `salts` tasks), then over the salts,
    where a key has at most `salts` rows. The way back to rows joins digests (SHA-256 and XXH64) and
    salts, so a hot group comes back in as many tasks. Texts of any length are compared whole.
    """
    norm = normalise(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id",
        "norm",
        F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.xxhash64("norm").alias("h"),
    )
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("sha", "h", "norm", "salt").agg(F.min("doc_id").alias("m"), F.count("*").alias("c"))
    winners = by_salt.groupBy("sha", "h", "norm").agg(F.min("m").alias("keep_id"), F.sum("c").alias("group_size"), F.collect_list("salt").alias("salt"))
    winners = winners.select("sha", "h", "keep_id", "group_size", F.explode("salt").alias("salt"))
    return (
        salted.select("doc_id", "sha", "h", "salt")
        .join(winners, ["sha", "h", "salt"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all its columns, without the rows whose text a smaller id has.

    A row with a null id goes if a row with an id has its text; else all rows of the text stay, as
    nothing tells which is first. Rows that repeat the kept id stay as well.
    """
    groups = exact_groups(docs, id_col=id_col, text_col=text_col, **options)
    kept = groups.where("kept").select(F.col("doc_id").alias(id_col)).distinct()
    nameless = docs.where(F.col(id_col).isNull())
    named = groups.where("keep_id is not null").select(F.col("text_sha256").alias("_sha")).distinct()
    sha = F.lower(F.sha2(normalise(F.col(text_col)), 256))
    alone = nameless.join(named, sha == F.col("_sha"), "left_anti")
    return docs.join(kept, id_col, "left_semi").select(*docs.columns).union(alone.select(*docs.columns))
