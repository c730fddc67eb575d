"""Product codes of vectors: codebooks by two rounds of integer means, nearest entries by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.storage import materialize

#: Vectors coded at once in a task.
BLOCK = 4096
#: Largest sum of a part's components in amount, so that no square and no sum of squares leaves a long.
LARGEST = 1 << 28


def finite(vector: Column) -> Column:
    """True where a vector is there and all its components are there and finite."""
    x_ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector.cast("array<double>"), x_ok)


def integers(column: pa.Array, dim: int, most: int = LARGEST) -> np.ndarray:
    """floor(256 x) of a column of lists of dim numbers, as a matrix of longs; an error beyond most."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    scaled = np.floor(values * 256.0)
    if scaled.size and np.abs(scaled).max() > most:
        raise ValueError(f"a component times 256 lies beyond {most}")
    return scaled.astype(np.int64).reshape(-1, dim)


class Codebooks:
    """entries[part, index, position]; each part's entries sorted by their component sum for the search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        sums = entries.sum(axis=2)
        self.order = np.argsort(sums, axis=1, kind="stable")
        self.sums = np.take_along_axis(sums, self.order, axis=1)
        # an edge on each side, so that both pointers can run out
        edge = np.full((len(entries), 1), np.iinfo(np.int64).max // 4)
        self.edged = np.hstack([-edge, self.sums, edge])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """parts[n, part, position] -> (index, squared distance) of each part's nearest entry, ties to the lower index.

        For k positions the squared distance is at least the squared gap of the sums over k. So the
        search begins at the part's sum among the sorted sums and goes outward, to the nearer side
        first, and a part is done when the gap's square exceeds k times its best distance. At equality
        it goes on: an entry of a lower index may be as near.
        """
        n, p, k = parts.shape
        x = parts.reshape(n * p, k)
        part = np.tile(np.arange(p), n)
        total = x.sum(axis=1)
        right = np.empty(n * p, np.int64)
        for i in range(p):
            right[i::p] = np.searchsorted(self.sums[i], total[i::p]) + 1
        left = right - 1
        best = np.full(n * p, np.iinfo(np.int64).max // k)
        index = np.full(n * p, self.entries.shape[1])
        live = np.arange(n * p)
        while len(live):
            at, lo, hi = part[live], left[live], right[live]
            down, up = total[live] - self.edged[at, lo], self.edged[at, hi] - total[live]
            go_left = down <= up
            gap = np.where(go_left, down, up)
            # beyond two times LARGEST lies the edge alone, whose square would not fit
            on = (gap <= 2 * LARGEST) & (np.minimum(gap, 2 * LARGEST) ** 2 <= k * best[live])
            live, at, go_left = live[on], at[on], go_left[on]
            lo, hi = lo[on], hi[on]
            entry = self.order[at, np.where(go_left, lo, hi) - 1]
            distance = ((x[live] - self.entries[at, entry]) ** 2).sum(axis=1)
            better = (distance < best[live]) | (distance == best[live]) & (entry < index[live])
            best[live[better]], index[live[better]] = distance[better], entry[better]
            left[live] = np.where(go_left, lo - 1, lo)
            right[live] = np.where(go_left, hi, hi + 1)
        return index.reshape(n, p), best.reshape(n, p)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _parts(column: pa.Array, dim: int, parts: int) -> np.ndarray:
    return integers(column, dim, LARGEST // (dim // parts)).reshape(len(column), parts, -1)


def _sums(books: Codebooks, dim: int):
    """Per task one row (slot, n, s0, s1, ...) for each entry that parts chose: counts and sums of those parts."""
    p, size, k = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(p * size, np.int64), np.zeros((p * size, k), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                parts = _parts(b.column(0).slice(at, BLOCK), dim, p)
                slot = (books.nearest(parts)[0] + np.arange(p) * size).reshape(-1)
                count += np.bincount(slot, minlength=p * size)
                flat = parts.reshape(-1, k)
                for j in range(k):  # sums of BLOCK parts of at most 2^28 are exact as doubles
                    total[:, j] += np.bincount(slot, flat[:, j], minlength=p * size).astype(np.int64)
        used = np.flatnonzero(count)
        columns = [pa.array(used), pa.array(count[used]), *(pa.array(total[used, j]) for j in range(k))]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "n", *(f"s{j}" for j in range(k))])

    return run, "slot bigint, n bigint, " + ", ".join(f"s{j} bigint" for j in range(k))


def _coded(books: Codebooks, dim: int):
    p = len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, errors = [], []
            for at in range(0, b.num_rows, BLOCK):
                index, distance = books.nearest(_parts(b.column(2).slice(at, BLOCK), dim, p))
                codes += ["".join(f"{i:02x}" for i in row) for row in index.tolist()]
                errors += distance.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"]
            )

    return run


def fit_codebooks(kept: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks of kept(vec_id, vector), None if it has no rows.

    The start is that part of the vectors of the `size` smallest ids, all if there are fewer (null
    ids last, equal ids by their vectors). A round is one scan: tasks sum the parts of each entry,
    the sums are added up by entry, and `parts * size` rows come to the driver, as many for any table.
    """
    start = kept.orderBy(F.col("vec_id").isNull(), "vec_id", "vector").limit(size).select("vector").toArrow().column(0).combine_chunks()
    if not len(start):
        return None
    dim = len(start[0])
    books = Codebooks(np.ascontiguousarray(_parts(start, dim, parts).swapaxes(0, 1)))
    for _ in range(rounds):
        run, schema = _sums(books, dim)
        sums = kept.select("vector").mapInArrow(run, schema)
        added = sums.groupBy("slot").agg(*[F.sum(c).alias(c) for c in sums.columns if c != "slot"]).collect()
        entries = books.entries.copy()
        for r in added:
            entries[divmod(r.slot, entries.shape[1])] = [s // r.n for s in r[2:]]
        books = Codebooks(entries)
    return books


def vector_codes(
    rows: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, salts: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row that is kept.

    A component x counts as floor(256 x). Rows go whose vector is null or has a null or a component
    that is not finite, and those of another length than the kept vector with the smallest id, as
    long as it is a multiple of `parts`; vectors whose length is not are never kept. Codes are the
    entries' indexes in part order, two hex digits each (`size` up to 256); error is the sum of the
    parts' squared distances, label_error its sum over equal labels, null labels together. Rows that
    repeat an id are rows of their own; rows with a null id are coded and start no codebook while
    others can. Extra columns are ignored; an empty table gives an empty table. A component
    whose 256-fold times a part's length passes 2^28 raises an error, as distances may not fit.

    The codebooks are all that is sent to tasks: `size` vectors, whatever the table. The rows of a
    label meet in sums only, which come back by label and salt.
    """
    if not 0 < size <= 256:
        raise ValueError("size must be 1 to 256: two hex digits")
    vector = F.col(vector_col).cast("array<double>")
    base = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("raw"), vector.alias("vector"))
    kept = base.where(finite(F.col("raw")) & (F.size("raw") > 0) & (F.size("raw") % parts == 0)).drop("raw")
    first = kept.orderBy(F.col("vec_id").isNull(), "vec_id", "vector").select(F.size("vector")).first()
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
    if first is None:
        empty = rows.sparkSession.createDataFrame([], schema)
        return empty.select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    kept = kept.where(F.size("vector") == first[0])
    books = fit_codebooks(kept, parts, size, rounds)
    coded = materialize(kept.select("vec_id", "label", "vector").mapInArrow(_coded(books, first[0]), schema), "vector-codes")
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy("label", "salt").agg(F.sum("error").alias("e"))
    sums = by_salt.groupBy("label").agg(F.sum("e").alias("label_error"), F.collect_list("salt").alias("salt"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode("salt").alias("of_salt"))
    back = salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
    return back.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
