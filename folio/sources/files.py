"""Sources and sinks: page manifests, rule files, glossaries, upload checks and nested exports."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """Sort key in which digit runs compare as numbers: each run padded to a fixed width."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def page_manifest(paths: DataFrame, path: str, root: str, dest: str, ext: str) -> DataFrame:
    """Input paths with the output path of each: prefix and extension swapped; thumbnails are left out."""
    out = F.regexp_replace(F.regexp_replace(F.col(path), f"^{re.escape(root)}", dest), r"(\.[A-Za-z0-9]+)?$", f".{ext}")
    once = F.regexp_replace(out, rf"(\.{ext})+$", f".{ext}")
    return paths.where(~F.col(path).contains(".thumb")).withColumn("output", once)


def scan_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder tree with their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def incremental_pending(manifest: DataFrame, done: DataFrame, overwrite: bool = False) -> DataFrame:
    return manifest if overwrite else manifest.join(done, "output", "left_anti")


def parse_rules(lines: DataFrame, text: str = "value") -> DataFrame:
    """Rule lines with pattern, replacement and status (rule, rejected); blank and comment lines are dropped.

    A line is cut at the first '#', then at the first '//'; one part deletes, two replace, more are rejected.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?s)#.*$", ""), r"(?s)//.*$", ""))
    parts = F.split(bare, r"\s+")
    return lines.withColumn("_p", parts).where(bare != "").withColumns({
        "pattern": F.get("_p", F.lit(0)), "replacement": F.coalesce(F.get("_p", F.lit(1)), F.lit("")),
        "status": F.when(F.size("_p") > 2, "rejected").otherwise("rule"),
    }).drop("_p")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of one file with their line numbers."""
    whole = spark.read.text(path, wholetext=True)
    return parse_rules(whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value")))


def glossary_format(lines: DataFrame, file: str, text: str = "value") -> DataFrame:
    """Format of each glossary file: arrow if all lines have '->', tab if all have a tab or four spaces, pair if all are two words, else unknown."""
    rows = lines.where((F.trim(text) != "") & ~F.trim(text).rlike("^(#|//)"))
    arrow, tab, pair = F.col(text).contains("->"), F.col(text).rlike("\t| {4}"), F.size(F.split(F.trim(text), r"\s+")) == 2
    return rows.groupBy(file).agg(
        F.when(F.bool_and(arrow), "arrow").when(F.bool_and(tab), "tab").when(F.bool_and(pair), "pair").otherwise("unknown").alias("format")
    )


def _compile(terms: pd.Series) -> pd.Series:
    def compiles(term: str | None) -> bool:
        try:
            return term is not None and re.compile(term) is not None
        except (re.error, OverflowError, RecursionError):
            return False

    return terms.map(compiles)


def valid_pattern(term: Column) -> Column:
    """Whether a term compiles as a regular expression; a null term does not."""
    return F.pandas_udf(_compile, "boolean")(term)


def parse_glossary(lines: DataFrame, kind: Column, text: str = "value") -> DataFrame:
    """Glossary lines as term, target, comment and status by format; underscores of the pair format stand for spaces.

    A term of the pair format is a regular expression; one that is not valid is rejected (status).
    """
    t = F.regexp_replace(F.trim(text), r"(?:#|//).*$", "")
    by = F.when(kind == "arrow", F.split(t, "->")).when(kind == "tab", F.split(t, "\t| {4}")).otherwise(F.split(t, r"\s+"))
    part = lambda i: F.trim(F.coalesce(F.get(by, F.lit(i)), F.lit("")))
    spaced = lambda c: F.when(kind == "pair", F.replace(c, F.lit("_"), F.lit(" "))).otherwise(c)
    rows = lines.withColumns({"term": spaced(part(0)), "target": spaced(part(1)), "comment": F.nullif(part(2), F.lit("")), "_pair": kind == "pair"}).where("term <> ''")
    valid = valid_pattern(F.when(F.col("_pair"), F.col("term")).otherwise(F.lit("")))
    return rows.withColumn("status", F.when(valid, "term").otherwise("rejected")).drop("_pair")


def reject_reason(data: Column, most: int) -> Column:
    """Why uploaded bytes are refused: too large, or no image by their first bytes; null if fine."""
    head = F.hex(F.substring(data, 1, 12))
    image = (
        head.startswith("89504E47") | head.startswith("FFD8FF") | head.startswith("47494638") | head.startswith("424D")
        | (head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"))
        | ((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("61766966", "61766973"))
    )
    return F.when(F.octet_length(data) > most, "too large").when(~image, "not an image")


def content_key(data: Column) -> Column:
    return F.substring(F.md5(data), 1, 8)


def region_export(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """Nested rows: bounds, colours as hex and a map language -> text, the source language included."""
    maps = texts.groupBy("line_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "text")))).alias("text"))
    color = F.format_string("#%02x%02x%02x", "fg_r", "fg_g", "fg_b")
    box = F.struct(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return regions.drop("text").join(maps, "line_id").select("page_id", "line_id", box.alias("bounds"), color.alias("color"), "prob", "text")


def region_report(regions: DataFrame, near: int = 50) -> DataFrame:
    """One report per page: its regions in order with number, colour class and box.

    A colour takes the number of the first earlier colour within an L1 distance below `near`; the
    fold runs over the regions of one page.
    """
    rows = regions.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("line_id", "fg_r", "fg_g", "fg_b", "x1", "y1", "x2", "y2", "text"))).alias("rows"))
    kind = "array<struct<r:int,g:int,b:int>>"

    def step(acc: Column, x: Column) -> Column:
        close = F.transform(acc, lambda c: F.abs(c["r"] - x["fg_r"]) + F.abs(c["g"] - x["fg_g"]) + F.abs(c["b"] - x["fg_b"]) < near)
        return F.when(F.array_position(close, True) > 0, acc).otherwise(F.concat(acc, F.array(F.struct(x["fg_r"].alias("r"), x["fg_g"].alias("g"), x["fg_b"].alias("b")))))

    colors = rows.select("page_id", "rows", F.aggregate("rows", F.array().cast(kind), step).alias("colors"))
    number = lambda x: F.array_position(F.transform("colors", lambda c: F.abs(c["r"] - x["fg_r"]) + F.abs(c["g"] - x["fg_g"]) + F.abs(c["b"] - x["fg_b"]) < near), True)
    line = lambda x, i: F.format_string("-- %d --\ncolor #%d: %02x%02x%02x\nbox: %d,%d,%d,%d\ntext: %s", i + 1, number(x), x["fg_r"], x["fg_g"], x["fg_b"], x["x1"], x["y1"], x["x2"], x["y2"], x["text"])
    return colors.select("page_id", F.array_join(F.transform("rows", line), "\n\n").alias("report"), F.size("colors").alias("n_colors"))


def write_job_log(jobs: DataFrame, path: str) -> None:
    """Appends one JSON line per job, null fields left out; every task writes a file of its own."""
    jobs.select(F.to_json(F.struct("*"))).write.mode("append").text(path)


def read_job_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Jobs of a log by the schema given, so that no pass over the files infers one; a torn line is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
