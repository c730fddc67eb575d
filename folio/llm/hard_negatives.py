"""Hard negatives of anchors: overlapping windows of scores answered from disjoint slots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.vector_codes import finite
from folio.storage import materialize, scratch_path

#: Scores held at once in a task.
BLOCK = 1 << 21
#: Stands for a null id in the order of ties: after every other.
NO_ID = np.iinfo(np.int64).max


def scaled(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 x) of a column of lists of dim numbers, as doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return np.floor(values * 256.0).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a and b, exact: in floats while all sums fit their mantissa, in longs beyond."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
    if most < 1 << 53:
        return a @ b.T
    if most < 1 << 56:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("scores do not fit in a long")


class Best:
    """The k best (score, smaller id first) of each group so far; groups are numbered."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, np.iinfo(np.int64).min)
        self.group = self.score = self.id = self.row = np.zeros(0, np.int64)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        able = score >= self.floor[group]
        group, score, ids, row = (np.concatenate([old, new[able]]) for old, new in ((self.group, group), (self.score, score), (self.id, ids), (self.row, row)))
        order = np.lexsort((row, ids, -score, group))
        g = group[order]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
        keep = order[rank < self.k]
        self.group, self.score, self.id, self.row = group[keep], score[keep], ids[keep], row[keep]
        full = rank[rank < self.k] == self.k - 1
        self.floor[self.group[full]] = self.score[full]


class Anchors:
    """A bounded block of anchors: number of the row, label, components; and once found, its positives' limits."""

    def __init__(self, table: pa.Table, dim: int):
        self.row = table["row"].to_numpy()
        self.label = table["label"].to_numpy()
        self.vector = scaled(table["vector"].combine_chunks(), dim)

    def limit(self, scores: np.ndarray, there: np.ndarray, low: int, high: int) -> None:
        """scores[anchor, positive] where they are there, descending, are cut at low and high percent, in whole numbers."""
        none = np.iinfo(np.int64)
        self.high = np.where(there, scores * high // 100, none.min)
        open_ = there & (-(-scores * low // 100) <= self.high)
        self.least = np.where(open_, -(-scores * low // 100), none.max).min(axis=1, initial=none.max)
        self.most = np.where(open_, self.high, none.min).max(axis=1, initial=none.min)

    def slot(self, anchor: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The last positive whose upper limit lets the score in: limits descend, so it stands for the narrowest set that does."""
        return (score[:, None] <= self.high[anchor]).sum(axis=1) - 1


def _scan(anchors, dim: int, k: int, slots: int, pick):
    """Each batch of rows against a block of anchors; per task the k best of each anchor and slot.

    pick(block, scores, labels, rows) gives the places in the matrix of scores that count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Anchors = anchors.value
        n = len(block.row)
        best = Best(n * slots, k)
        step = max(1, BLOCK // n)
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                row, ids, label = (part.column(i).to_numpy() for i in range(3))
                scores = products(block.vector, scaled(part.column(3), dim))
                a, r = pick(block, scores, label, row)
                score = scores[a, r]
                slot = block.slot(a, score) if slots > 1 else 0
                best.add(a * slots + slot, score.astype(np.int64), ids[r], row[r])
        columns = (block.row[best.group // slots], best.group % slots, best.score, best.id)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "slot", "score", "id"])

    return run


def _same_label(block: Anchors, scores: np.ndarray, label: np.ndarray, row: np.ndarray):
    return np.nonzero((block.label[:, None] == label[None, :]) & (block.row[:, None] != row[None, :]))


def _other_label(block: Anchors, scores: np.ndarray, label: np.ndarray, row: np.ndarray):
    inside = (scores >= block.least[:, None]) & (scores <= block.most[:, None])
    return np.nonzero(inside & (block.label[:, None] != label[None, :]))


def _top(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best of each key with their rank from 1; Spark cuts within tasks before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _windows(winners: Column, positives: Column, n_slots: int, k: int, low: int) -> Column:
    """The k best of each positive's window: winners of the slots merged from the lowest up, cut at the lower limit.

    All scores of a slot lie above those of the slots after it, so a merge puts the slot's winners in
    front and keeps k.
    """
    of_slot = lambda i: F.filter(winners, lambda w: w["slot"] == i)
    cut = lambda merged, p: F.filter(merged, lambda w: w["score"] * 100 >= p["score"] * low)
    merged, windows = of_slot(n_slots), []  # no slot has this number
    for i in reversed(range(n_slots)):
        merged = F.slice(F.concat(of_slot(i), merged), 1, k)
        windows.insert(0, cut(merged, F.get(positives, F.lit(i))))
    return F.array(*windows)


def hard_negatives(
    rows: DataFrame, anchors: Column, label: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
    block_bytes: int = 8 << 20, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows (id, vector, label) whose label or vector is null, or whose vector has a null or a component
    that is not finite, take no part; nor do vectors of another length than that of the smallest
    id. anchors and label are expressions over vec_id and label: which rows are anchors, and the label
    that counts. Scores are inner products of floor(256 x). An anchor's positives are its first
    n_positives other rows of its label, higher scores first, ties by smaller id. A negative of a
    positive has another label and a score from low to high percent of the positive's; the first
    n_negatives are returned. Rows that repeat an id are rows of their own, so an anchor that occurs
    twice is the other's positive and both report; a null id is never an anchor, but may be a
    positive or a negative, after all other ids in ties. A positive with a score under zero has no
    window. Extra columns are ignored; an empty table, or one without anchors, gives an empty table.
    Scores that may reach 2^56 raise an error.

    The upper limits of an anchor's positives cut the scores into slots. Tasks keep the n_negatives best
    of each slot, the slots' winners meet by anchor and slot, and merging them from the lowest slot
    up answers every window, since a window is a run of slots cut at its lower limit. So each pass
    over the rows gives at most n_positives * n_negatives winners an anchor and task.

    Anchors go to the tasks in blocks of at most block_bytes, two passes over the rows for each; a
    block's results are written to the shared folder before the next begins.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).alias("vector"))
    able = base.where(F.col("label").isNotNull() & finite(F.col("vector"))).withColumn("label", label).withColumn("vector", F.col("vector").cast("array<double>"))
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    first = able.orderBy(F.col("vec_id").isNull(), "vec_id", F.size("vector")).select(F.size("vector")).first()
    if first is None or first[0] == 0:
        return spark.createDataFrame([], out)
    dim = first[0]
    table = able.where(F.size("vector") == dim).withColumn("row", F.monotonically_increasing_id()).withColumn("id", F.coalesce("vec_id", F.lit(int(NO_ID))))
    table = materialize(table.select("row", "id", "label", "vector", F.coalesce(anchors, F.lit(False)).alias("anchor")), "negatives-rows")
    path = scratch_path(spark, "negatives")
    n_blocks = -(-table.where("anchor").count() // max(1, block_bytes // (8 * dim)))
    asked = table.where("anchor").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, n_blocks))).cast("int"))
    scanned = table.select("row", "id", "label", "vector")
    for i in range(n_blocks):
        block = asked.where(F.col("block") == i)
        held = Anchors(block.select("row", "label", "vector").toArrow(), dim)
        if not len(held.row):
            continue
        _mine(scanned, block.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), held, dim, n_positives, n_negatives, low, high).write.parquet(f"{path}/block={i}")
    if not n_blocks:
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(path).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _mine(scanned: DataFrame, names: DataFrame, held: Anchors, dim: int, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    spark, schema = scanned.sparkSession, "anchor bigint, slot bigint, score bigint, id bigint"
    sent = spark.sparkContext.broadcast(held)
    near = scanned.mapInArrow(_scan(sent, dim, n_positives, 1, _same_label), schema)
    positives = materialize(_top(near, n_positives, "anchor").select("anchor", "score", "id", "rank"), "negatives-positives")
    limits = positives.toPandas()  # n_positives rows an anchor of the block
    place = np.argsort(held.row)
    at = place[np.searchsorted(held.row, limits["anchor"].to_numpy(), sorter=place)], limits["rank"].to_numpy() - 1
    scores, there = np.zeros((len(held.row), n_positives), np.int64), np.zeros((len(held.row), n_positives), bool)
    scores[at], there[at] = limits["score"], True
    held.limit(scores, there, low, high)
    sent.destroy()
    sent = spark.sparkContext.broadcast(held)
    slots = scanned.mapInArrow(_scan(sent, dim, n_negatives, n_positives, _other_label), schema)
    ordered = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    winners = _top(slots, n_negatives, "anchor", "slot").groupBy("anchor").agg(ordered("slot", "rank", "score", "id").alias("winners"))
    asked = positives.groupBy("anchor").agg(ordered("rank", "score", "id").alias("positives"))
    found = asked.join(winners, "anchor").join(names, "anchor")
    windows = found.select("anchor_id", "positives", F.posexplode(_windows(F.col("winners"), F.col("positives"), n_positives, n_negatives, low)).alias("i", "window"))
    one = windows.select("anchor_id", F.get("positives", F.col("i")).alias("p"), F.posexplode("window").alias("at", "w"))
    known = lambda c: F.when(c != int(NO_ID), c)
    return one.select(
        "anchor_id", known(F.col("p.id")).alias("positive_id"), (F.col("at") + 1).alias("rank"), known(F.col("w.id")).alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("w.score").alias("negative_score"),
    )
