"""Near-duplicate classes by b-bit MinHash: bands meet, packed low bits estimate, whole sets decide."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from folio.operators.graph import connected_components
from folio.storage import discard, materialize

#: Hashes of a signature, low bits kept of each, and minima in a band.
HASHES, BITS, ROWS = 128, 2, 5
#: Places of the odd sketch that goes with a signature.
PARITIES = 512
#: Chance that the estimate turns down a pair which is just similar enough.
MISS = 1e-9
#: Shingles hashed at once: bounds the memory of a very long text.
BLOCK = 1 << 12
#: Parts over which the members of one band, and pairs of one set, are dealt.
SALTS, PAIRS = 32, 256
#: Bits of the hash buckets whose counts order shingles by how rare they are; the order costs time, never a pair.
ORDER = 18

# Odd factors of the hash functions: the output of a fixed linear congruential generator.
_FACTORS = (np.cumprod(np.full(HASHES, 747796405, np.uint64)).astype(np.uint32) ^ np.uint32(0x9E3779B9)) | np.uint32(1)


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles of a text; fewer words are one shingle, none give an empty set."""
    # bytes.lower() and bytes.split() touch A-Z and the six ASCII spaces alone
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(b" ".join(parts))], np.uint64)
    found = []
    for at in range(0, len(parts) - words + 1, BLOCK):
        block = parts[at : at + BLOCK + words - 1]
        shingles = map(b" ".join, zip(*(block[k:] for k in range(words))))
        found.append(np.fromiter((xxh64_intdigest(s) for s in shingles), np.uint64))
    return np.unique(np.concatenate(found))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, so that the low bits of different minima are independent."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The mixed minimum of a set under each hash function."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    folded = _mixed((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32))
    for at in range(0, len(folded), BLOCK):
        np.minimum(low, np.multiply.outer(_FACTORS, folded[at : at + BLOCK]).min(axis=1), out=low)
    return _mixed(low)


def packed(low: np.ndarray) -> np.ndarray:
    """The BITS low bits of the minima as planes of 64 bits: HASHES / 64 longs for the lowest bit, as many for the next."""
    planes = [np.packbits((low >> np.uint32(i)) & np.uint32(1)).view(np.int64) for i in range(BITS)]
    return np.concatenate(planes)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's hashes falls into each of PARITIES places, as longs: two sets differ in a place only by a shingle that one of them lacks."""
    odd = np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bands(low: np.ndarray) -> list[int]:
    """A hash of each run of ROWS minima and its number, as signed longs."""
    keys = []
    for i in range(HASHES // ROWS):
        keys.append(xxh64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i))
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, one, two, sig, keys = [], [], [], [], []
        for t in b.column(2):
            hashes = shingle_hashes(t.as_py())
            digest = np.frombuffer(xxh3_128_digest(hashes.tobytes()), np.int64)
            low = minima(hashes)
            n.append(len(hashes))
            one.append(int(digest[0]))
            two.append(int(digest[1]))
            sig.append([*packed(low).tolist(), *parities(hashes).tolist()])
            keys.append(bands(low))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, longs), pa.array(keys, longs)],
            names=["doc_id", "h", "n", "d1", "d2", "sig", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [shingle_hashes(t.as_py()).view(np.int64) for t in b.column(1)]
        values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
        yield pa.RecordBatch.from_arrays([b.column(0), values], names=["id", "set"])


def most_different(threshold: float) -> int:
    """Signatures of sets with this similarity differ in more places with a chance of MISS at most."""
    p = (1 - threshold) * (1 - 2.0**-BITS)
    tail, d = 0.0, HASHES
    while d and tail + comb(HASHES, d) * p**d * (1 - p) ** (HASHES - d) <= MISS:
        tail += comb(HASHES, d) * p**d * (1 - p) ** (HASHES - d)
        d -= 1
    return d


def different(a: Column, b: Column) -> Column:
    """In how many places two packed signatures differ, by bit counts."""
    longs = HASHES // 64
    word = lambda i: [a[p * longs + i].bitwiseXOR(b[p * longs + i]) for p in range(BITS)]
    either = lambda xs: xs[0] if len(xs) == 1 else xs[0].bitwiseOR(either(xs[1:]))
    return sum((F.bit_count(either(word(i))) for i in range(1, longs)), F.bit_count(either(word(0))))


def can_be_similar(a: Column, b: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether signatures of sets of n and m shingles allow the similarity, by bit counts.

    The places in which the odd sketches differ are at most as many as the shingles that one of the
    sets lacks, which are at most (n + m) (1 - t) / (1 + t); so this loses no pair. The packed minima
    estimate the similarity, which loses one with a chance of MISS.
    """
    first = HASHES // 64 * BITS
    lacking = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(first + 1, first + PARITIES // 64)), F.bit_count(a[first].bitwiseXOR(b[first])))
    return (lacking * (100 + percent) <= (n + m) * (100 - percent)) & (different(a, b) <= most_different(percent / 100))


def similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of equal places less what chance makes equal."""
    chance = 2.0**-BITS
    return ((1 - different(a, b) / HASHES) - chance) / (1 - chance)


def _pairs(u: Column, v: Column) -> list[Column]:
    return [F.greatest(u, v).alias("u"), F.least(u, v).alias("v")]


def _chained(members: DataFrame) -> DataFrame:
    """(u, v) from members(key, id): each with the member before it, in any band.

    A band is dealt over SALTS parts, whose smallest members are chained in turn, so no band is one
    key and no member meets more than a few others.
    """
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    before = F.lag("id").over(Window.partitionBy("key", "salt").orderBy("id"))
    inside = salted.select("id", before.alias("v")).where("v is not null").select(*_pairs(F.col("id"), F.col("v")))
    heads = salted.groupBy("key", "salt").agg(F.min("id").alias("id")).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most SALTS
    between = heads.where(F.size("ids") > 1).select(F.explode(F.arrays_zip(F.expr("slice(ids, 2, size(ids) - 1)").alias("u"), F.expr("slice(ids, 1, size(ids) - 1)").alias("v"))).alias("p"))
    return inside.union(between.select("p.u", "p.v")).distinct()


def _with(pairs: DataFrame, table: DataFrame, what: str) -> DataFrame:
    """pairs(u, v, ...) with `what` of both ends from table(id, what), as a and b.

    An end of more than PAIRS pairs is dealt over parts, and its value goes to each, so no end is one key.
    """
    most = [pairs.groupBy(end).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")) for end in ("u", "v")]
    most = [r.n for r in most[0].union(most[1]).collect()]
    for end, other, name, n in (("u", "v", "a", most[0]), ("v", "u", "b", most[1])):
        sent = table.select(F.col("id").alias(end), F.col(what).alias(name))
        if n <= PAIRS:
            pairs = pairs.join(sent.hint("merge"), end)
            continue
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
        count = salted.groupBy(end, "salt").agg(F.count("*").alias("n"))
        hubs = count.groupBy(end).agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where(F.col("n") > PAIRS)
        hubs = hubs.select(end, F.ceil(F.col("n") / PAIRS).cast("int").alias("parts"), "salts")
        known = salted.join(hubs.select(end, "parts", F.explode("salts").alias("salt")), [end, "salt"], "left")
        dealt = known.withColumn("part", F.pmod(F.xxhash64(other, F.lit(1)), F.coalesce("parts", F.lit(1)))).drop("parts", "salt")
        sent = sent.join(hubs.drop("salts"), end, "left")
        sent = sent.select(end, name, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        pairs = dealt.join(sent.hint("merge"), [end, "part"]).drop("part")
    return pairs


def _near(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(u, v) whose sizes and signatures allow the similarity."""
    both = _with(pairs, signatures.select("id", F.struct("n", "sig").alias("s")), "s")
    return both.where(can_be_similar(F.col("a.sig"), F.col("b.sig"), F.col("a.n"), F.col("b.n"), percent)).select("u", "v")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(u, v) whose whole sets have the similarity."""
    both = _with(pairs.select("u", "v"), sets, "set").withColumn("common", F.size(F.array_intersect("a", "b")))
    return both.where(F.col("common") * 100 >= percent * (F.size("a") + F.size("b") - F.col("common"))).select("u", "v")


def _prefixes(counts, percent: int):
    """(id, n, keys): of each set the shingles of its prefix, the rarest first by counts of hash buckets.

    Similar sets of n and m shingles have at least percent of n and of m in common. So of the first
    (100 - percent) % of n and one more, in an order that is the same for all sets, one is common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for b in batches:
            n, keys = [], []
            for t in b.column(1):
                hashes = np.array(t.as_py(), np.int64)
                order = np.lexsort((hashes, often[hashes & (len(often) - 1)]))
                n.append(len(hashes))
                keys.append(hashes[order[: len(hashes) - -(-percent * len(hashes) // 100) + 1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "keys"])

    return run


def _across(members: DataFrame, signatures: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of sets in bands of several components, the ends in different ones, that may be similar.

    A large group of copies, each changed in its own places, would make pairs by the square of its
    size. So these sets meet not by band but by the shingles of their prefixes, the rarest of each,
    which loses no similar pair. What comes before a common shingle in one of the sets is rarer and not
    common, unless it made the pair meet before; so the rest of both bounds the similarity. Copies
    that differ too much meet late in their prefixes and are out by it. Sets of a shingle's largest
    component stay where they are, dealt over parts of about PAIRS; the others go to each part. The
    bounds and the signatures are compared in the join, so a pair that cannot be similar never comes
    out of it.
    """
    spark = members.sparkSession
    comp = connected_components(links).withColumnRenamed("node", "id")
    named = members.join(comp.hint("merge"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    named = materialize(named.select("key", "id", "c", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")), "minhash-members")
    mixed = named.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    apart = materialize(named.join(mixed.hint("merge"), ["key", "salt"]).select("id", "c").distinct(), "minhash-apart")
    if apart.isEmpty():
        discard(named, apart)
        return members.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
    held = sets.join(apart.select("id").hint("merge"), "id", "left_semi")
    bucket = F.explode("set").alias("shingle")
    counted = held.select(bucket).groupBy(F.col("shingle").bitwiseAND(F.lit((1 << ORDER) - 1)).cast("int").alias("b")).agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("n"))
    counted = counted.toArrow()  # at most 2^ORDER rows of 8 bytes
    often = np.zeros(1 << ORDER, np.int32)
    often[counted["b"].to_numpy()] = counted["n"].to_numpy()
    sent = spark.sparkContext.broadcast(often)
    prefixes = held.mapInArrow(_prefixes(sent, percent), "id bigint, n bigint, keys array<bigint>")
    known = prefixes.join(apart.hint("merge"), "id").join(signatures.select("id", "sig").hint("merge"), "id")
    rows = materialize(known.select("id", "n", "c", "sig", F.posexplode("keys").alias("at", "key"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")), "minhash-prefixes")
    per = rows.groupBy("key", "c").agg(F.count("*").alias("k"))
    main = per.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("all"), F.sum("k").alias("k")).where("all > 1")
    main = main.select("key", "main", F.ceil(F.col("k") / PAIRS).alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    here = rows.join(main.hint("merge"), ["key", "salt"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")))
    minor = here.where("c <> main").select(
        "key", F.col("id").alias("v"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("sig").alias("other"),
        F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"),
    )
    once = ((F.col("c") == F.col("main")) | (F.col("c") < F.col("d"))) & (F.col("c") != F.col("d"))
    enough = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) * (100 + percent) >= percent * (F.col("n") + F.col("m"))
    near = can_be_similar(F.col("sig"), F.col("other"), F.col("n"), F.col("m"), percent)
    found = here.join(minor.hint("merge"), ["key", "part"]).where(once & enough & near).select(*_pairs(F.col("id"), F.col("v"))).distinct()
    found = materialize(found, "minhash-near")
    sent.destroy()
    discard(named, apart, rows)
    return found


def similar_links(classes: DataFrame, sets_of, percent: int = 85) -> DataFrame:
    """Links (u, v) that give the same components as all similar pairs of classes(id, n, sig, bands) that a band or more joins.

    First each set is compared with the one before it in each of its bands; that joins groups of near
    copies, however large, by a few comparisons a set. Sets of a band that still lie apart meet by
    the shingles of their prefixes. A pair counts only if its whole sets are similar; sets_of(ids)
    gives them.
    """
    signatures = classes.select("id", "n", "sig")
    members = classes.select("id", F.explode("bands").alias("key"))
    many = members.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(many.hint("merge"), ["key", "salt"]).select("key", "id")
    members = materialize(members, "minhash-members")
    chained = materialize(_chained(members), "minhash-pairs")
    near = materialize(_near(chained, signatures, percent), "minhash-near")
    sets = materialize(sets_of(members.select("id").distinct()), "minhash-sets")
    links = materialize(_similar(near, sets, percent), "minhash-links")
    across = _across(members, signatures, sets, links, percent)
    last = materialize(_similar(across, sets, percent), "minhash-links")
    discard(members, chained, near, sets, across)
    return links.union(last)


def minhash_classes(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, per row of docs.

    A document's set is its distinct 3-word shingles, A-Z lower-cased, words ended by ASCII space;
    fewer words are one shingle. A text without words (null, empty, spaces) has an empty set and is
    linked with nothing, so its component_id is its own id. Rows link when their sets have a Jaccard
    similarity of at least percent. Equal sets are one node, so copies never meet in pairs. Rows that
    repeat an id are rows of their own; null ids come back with the class of their set and name it
    only if it has no other (component_id null), and are never kept. Extra columns are ignored; an
    empty table gives an empty table. Texts of any length are used whole; sets are held as 64-bit
    hashes of their shingles.

    Candidates share a band of ROWS minima; a pair of just 85 % is in none of the 25 with a chance of
    4e-7, and turned down by its packed bits with one of MISS.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, h bigint, n bigint, d1 bigint, d2 bigint, sig array<bigint>, bands array<bigint>"
    marked = materialize(base.select("doc_id", "h", "text").mapInArrow(_signed, schema), "minhash-docs")
    salted = marked.select("doc_id", "h", "n", "d1", "d2").where("n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)).cast("int"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("f")
    by_salt = salted.groupBy("d1", "d2", "n", "salt").agg(first)
    nodes = by_salt.groupBy("d1", "d2", "n").agg(F.min("f").alias("f"), F.collect_list("salt").alias("salts"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", "n", F.col("f.doc_id").alias("first_id"), F.col("f.h").alias("h"), "salts")
    nodes = materialize(nodes, "minhash-nodes")
    # the row of the smallest id stands for its class; rows that repeat both id and text are alike
    named = nodes.select("id", "first_id", "h", "d1", "d2")
    chosen = marked.join(named.hint("merge"), marked["doc_id"].eqNullSafe(named["first_id"]) & (marked["h"] == named["h"]) & (marked["d1"] == named["d1"]) & (marked["d2"] == named["d2"]))
    classes = materialize(chosen.select("id", "n", "sig", "bands").dropDuplicates(["id"]), "minhash-classes")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = named.join(ids.hint("merge"), "id").select("id", F.col("first_id").alias("w"), F.col("h").alias("wh"))
        texts = base.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w")) & (F.col("h") == F.col("wh"))).select("id", "text")
        return texts.dropDuplicates(["id"]).mapInArrow(_sets, "id bigint, set array<bigint>")

    comp = connected_components(similar_links(classes, sets_of, percent)).withColumnRenamed("node", "id")
    joined = nodes.join(comp.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = joined.join(names.hint("merge"), "component").select("d1", "d2", F.explode("salts").alias("salt"), "component_id")
    back = salted.join(ids.hint("merge"), ["d1", "d2", "salt"]).select("doc_id", "n", "component_id")
    every = back.union(marked.where("n = 0").select("doc_id", "n", "doc_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def minhash_dedup(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all its columns, with only the smallest id of each class; rows with a null id, and texts without words, stay."""
    keep = minhash_classes(docs, percent, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(keep, id_col, "left_semi").select(*docs.columns).union(docs.where(F.col(id_col).isNull()))
