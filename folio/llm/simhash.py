"""SimHash near-duplicate classes by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from folio.operators.graph import connected_components
from folio.storage import discard, materialize

SEED = 42
#: Shingles hashed at once: bounds the memory of a very long text.
BLOCK = 1 << 14
#: Table entries with more fingerprints are split by quarters of the other segment.
DENSE = 64


def fingerprint(text: str, words: int = 3) -> int:
    """64 majority bits of the XXH64 hashes of the word shingles of a text, repeats included."""
    # bytes.lower() and bytes.split() touch A-Z and the six ASCII spaces alone
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        block = parts[at : at + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(block[k:] for k in range(words)))) if len(parts) >= words else [b" ".join(parts)]
        hashes = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t.as_py() or "") for t in b.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint) per row: the bits of the fingerprint as a signed long."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_fingerprints, f"doc_id {kind}, fp bigint")


def _segment(fp: Column, segment: int) -> Column:
    return (F.shiftrightunsigned(fp, 32) if segment == 0 else fp).bitwiseAND(F.lit(0xFFFFFFFF))


def _near(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def similar_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that give the same components as all pairs of fps(fp) with up to 3 differing bits.

    Of 3 differing bits at most one falls into one of the two 32-bit segments. So each fingerprint
    looks, per segment, into the table at its own segment value and at each value made by setting
    one zero bit (the partner with the zero does the looking): on average 34 equi-join probes. A
    table entry holds its smallest and largest fingerprint; every prober is compared in full with
    those two. Only entries of three or more fingerprints have others left, and of these only
    pairs that lie in different components so far are compared: a dense bucket of thousands of
    near copies costs two comparisons each, and no link between components is lost. Entries of more
    than DENSE fingerprints are split first: of three differing bits none falls into one of the four
    quarters of the other segment, so partners share a quarter, and the entry is joined on each.
    """
    bits = 3
    fps = fps.distinct()
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _segment(F.col("fp"), s).alias("key")) for s in (0, 1)])).alias("t")
    table = fps.select("fp", rows).select("fp", "t.seg", "t.key")
    ball = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.col("key").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))),
        lambda k: k != F.col("key"),
    )
    probes = table.select("fp", "seg", F.explode(F.concat(F.array("key"), ball)).alias("key"))
    ends = table.groupBy("seg", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n"))
    met = probes.join(ends.hint("merge"), ["seg", "key"]).where(_near("fp", "lo", bits) | _near("fp", "hi", bits) | (F.col("n") > 2))
    met = materialize(met, "simhash-met")
    first = met.select("fp", F.explode(F.array("lo", "hi")).alias("v")).where((F.col("fp") != F.col("v")) & _near("fp", "v", bits))
    first = materialize(first.select(F.col("fp").alias("u"), "v").distinct(), "simhash-links")
    wide = met.where("n > 2").select("fp", "seg", "key", "lo", "hi", "n")
    comp = connected_components(first)
    probing = wide.join(comp.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    probing = materialize(probing, "simhash-wide")
    mixed = probing.groupBy("seg", "key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("seg", "key")
    here = probing.join(mixed.hint("merge"), ["seg", "key"], "left_semi")
    other_segment = F.when(F.col("seg") == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    quarter = lambda q: F.shiftright(other_segment, 8 * q).bitwiseAND(F.lit(0xFF)).cast("int")
    quarters = F.array(*[F.struct(F.lit(q).alias("q"), quarter(q).alias("v")) for q in range(4)])
    whole = F.array(F.struct(F.lit(-1).alias("q"), F.lit(0).alias("v")))
    here = here.withColumn("part", F.explode(F.when(F.col("n") > DENSE, quarters).otherwise(whole)))
    held = here.where((_segment(F.col("fp"), 0) == F.col("key")) & (F.col("seg") == 0) | (_segment(F.col("fp"), 1) == F.col("key")) & (F.col("seg") == 1))
    held = held.where("fp <> lo and fp <> hi").select("seg", "key", "part", F.col("fp").alias("v"), F.col("component").alias("other"))
    second = here.join(held.hint("merge"), ["seg", "key", "part"]).where((F.col("component") != F.col("other")) & _near("fp", "v", bits))
    second = materialize(second.select(F.col("fp").alias("u"), "v").distinct(), "simhash-links")
    discard(met, probing)
    return first.union(second)


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), per input row.

    A text without words (null, empty, spaces) has fingerprint zero and links like any other. Equal
    fingerprints are one node, so copies never meet in pairs. Rows repeating an id are rows of
    their own; null ids come back with the class of their text and never name one unless the class
    has null ids only (then component_id is null). Extra columns are ignored; an empty table gives
    an empty table. Very long texts are hashed in blocks.
    """
    marked = materialize(fingerprints(docs, id_col, text_col), "simhash-docs")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    comp = connected_components(similar_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    named = nodes.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = named.join(first, "component").select("fp", "component_id")
    return marked.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all its columns, with only the smallest id of each class.

    A row with a null id goes if its class has a row with an id; else it stays. Rows that repeat the
    kept id stay as well, if their text is of its class.
    """
    classes = materialize(simhash_classes(docs, id_col, text_col), "simhash-classes")
    keep = classes.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    stay = docs.join(keep, id_col, "left_semi").select(*docs.columns)
    if classes.where("doc_id is null").isEmpty():
        return stay
    nameless = docs.where(F.col(id_col).isNull())
    texts = fingerprints(nameless.select(F.col(text_col).alias("text")).distinct(), "text", "text")
    named = classes.where("component_id is not null").select(F.col("fingerprint").alias("_fp")).distinct()
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    alone = texts.join(named, hexed == F.col("_fp"), "left_anti").select(F.col("doc_id").alias("_text"))
    return stay.union(nameless.join(alone, F.col(text_col).eqNullSafe(F.col("_text")), "left_semi").select(*docs.columns))
