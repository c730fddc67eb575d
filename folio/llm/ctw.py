"""Language-model scores by context-tree weighting over byte contexts, and a unigram word base."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.storage import discard, materialize

#: Context bytes at most; with the byte that follows, a window fits six bytes of one long.
DEPTH = 5
#: Depth down to which the tree is held by the driver and sent to every task: at most 65,793 contexts.
#: Below it the tree is dealt over tasks, all that is under the same TOP + 1 bytes together.
TOP = 2
#: Windows and words that are sent to every task with their values (the most frequent); all others are
#: looked up by a join. These bound what is broadcast, at 16 and about 100 bytes each.
MAX_WINDOWS, MAX_WORDS = 2_000_000, 120_000
#: Windows of whole subtrees that are worked on together.
CHUNK = 200_000
END = ""  # the end token, which no word equals
#: Windows held before they are counted, and distinct windows held before they are sent on, per task.
BLOCK, FLUSH = 1 << 21, 3_000_000


def tokens(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased, without the end token."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def stream(words: list[bytes]) -> bytes:
    """The byte sequence that is coded: words joined by a space and one end byte; spells the words uniquely."""
    return b" ".join(words) + b"\n"


def windows(data: bytes, width: int = DEPTH + 1) -> np.ndarray:
    """Each byte with the bytes before it, packed big-endian; before the start there are newlines."""
    a = np.frombuffer(b"\n" * (width - 1) + data, np.uint8).astype(np.int64)
    n = len(data)
    g = np.zeros(n, np.int64)
    for j in range(width):
        g <<= 8
        g |= a[j : j + n]
    return g


def _blocks(data: bytes) -> list[np.ndarray]:
    """Windows of a stream, a very long one in blocks that each bring their own context."""
    out = []
    for at in range(0, len(data), BLOCK):
        before = data[max(0, at - DEPTH) : at]
        out.append(windows(before + data[at : at + BLOCK])[len(before) :])
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return [(keys, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64))]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: rows (gram, word, n) with gram or word null."""
    names = ["gram", "word", "n"]
    words: Counter[bytes] = Counter()
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    pending: list[np.ndarray] = []
    ends, waiting = 0, 0

    def out_words():
        w = pa.array([k.decode("utf-8", "surrogatepass") for k in words], pa.string())
        return pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.int64()), w, pa.array(list(words.values()), pa.int64())], names=names)

    def out_grams(k, n):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(len(k), pa.string()), pa.array(n)], names=names)

    for b in batches:
        for t in b.column(0):
            w = tokens(t.as_py() or "")
            words.update(w)
            ends += 1
            fresh = _blocks(stream(w))
            pending += fresh
            waiting += sum(map(len, fresh))
            if waiting > BLOCK:
                grams.append(np.unique(np.concatenate(pending), return_counts=True))
                pending, waiting = [], 0
                if sum(len(k) for k, _ in grams) > FLUSH:
                    grams = _merge(grams)
                    if len(grams[0][0]) > FLUSH // 2:
                        yield out_grams(*grams.pop())
            if len(words) > FLUSH // 6:
                yield out_words()
                words.clear()
    if pending:
        grams.append(np.unique(np.concatenate(pending), return_counts=True))
    if ends:
        words[END.encode()] += ends
        yield out_words()
    if grams:
        yield out_grams(*_merge(grams).pop())


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


def _stirling(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 8."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0, small arguments by way of x + 8."""
    low = np.flatnonzero(x < 8)
    y = x.copy()
    y[low] += 8
    out = _stirling(y)
    rise = np.ones(len(low))
    for k in range(8):
        rise *= x[low] + k
    out[low] -= np.log(rise)
    return out


#: Nodes of one depth and one number of known bits: sorted keys (context, then the known bits of the
#: byte), the share of the weight that stops there, and the estimate of a one.
Nodes = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, values, len(distinct))


def _suffix(d: int, known: int = 8) -> int:
    """Mask that leaves the last d context bytes and the known bits of a key."""
    return (1 << 8 * d + known) - 1


def weigh(grams: np.ndarray, n: np.ndarray, depth: int, least: int, below: list | None = None) -> tuple[list[list[Nodes]], list]:
    """Weights the nodes of depths least..depth of a tree, or of whole subtrees, from its counted windows.

    grams: distinct windows of depth context bytes and the byte that follows; n: their counts. Each
    pair of context and known bits is a binary node with P_w = 1/2 KT + 1/2 prod P_w(children), at
    the largest depth KT alone. below: what the children of the deepest level have, as this function
    returns it for the nodes one level above least: per number of known bits the keys and the summed
    log P_w. The nodes come by depth, from least on, then by known bits.
    """
    levels: list[list[Nodes]] = []
    n = n.astype(np.float64)
    deepest = below is None
    for d in range(depth, least - 1, -1):
        grams, n = _sum_by(grams & _suffix(d), n)
        level, up = [], []
        for known in range(8):
            key = grams >> 8 - known
            start = np.flatnonzero(np.diff(key, prepend=-1))
            one = n * (grams >> 7 - known & 1)
            a_one, total = (np.add.reduceat(v, start) if len(start) else np.zeros(0) for v in (one, n))
            key = key[start]
            log_w, stop = _log_kt(total - a_one, a_one), np.ones(len(key))
            if not deepest:
                deeper = np.zeros(len(key))
                child, w = below[known]
                deeper[np.searchsorted(key, child)] = w
                log_e = log_w - math.log(2)
                log_w = np.logaddexp(log_e, deeper - math.log(2))
                stop = np.exp(log_e - log_w)
            level.append((key, stop, (a_one + 0.5) / (total + 1)))
            if d:
                up.append(_sum_by(key & _suffix(d - 1, known), log_w))
        levels.insert(0, level)
        below, deepest = up, False
    return levels, below


def predict(grams: np.ndarray, levels: list[list[Nodes]]) -> np.ndarray:
    """log2 P of the last byte of each window: per bit, the estimates of all depths on its path by their weights.

    A node that the training data never reached, and all below it, estimates one half.
    """
    out = np.zeros(len(grams))
    for known in range(8):
        one, left = np.zeros(len(grams)), np.ones(len(grams))
        for d, level in enumerate(levels):
            keys, stop, estimate = level[known]
            if not len(keys):
                break
            look = (grams & _suffix(d)) >> 8 - known
            at = np.minimum(np.searchsorted(keys, look), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == look)
            at = at[hit]
            one[hit] += left[hit] * stop[at] * estimate[at]
            left[hit] *= 1 - stop[at]
        one += left / 2
        out += np.log2(np.where(grams >> 7 - known & 1, one, 1 - one))
    return out


class Head:
    """Values of frequent windows in one hashed table; a window whose place a more frequent one has is not found."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        """keys: the most frequent first."""
        self.bits = max(12, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        slot, first = np.unique(self._slot(keys), return_index=True)
        self.keys[slot], self.values[slot] = keys[first], values[first]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def total(self, grams: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the values of the windows found, and the windows not found."""
        at = self._slot(grams)
        hit = self.keys[at] == grams
        return float(np.where(hit, self.values[at], 0.0).sum()), grams[~hit]


_READY: dict[str, tuple] = {}


def _ready(model) -> tuple:
    """Tables of a broadcast model, built once per Python worker."""
    name, keys, values, words = model.value
    if name not in _READY:
        _READY.clear()
        _READY[name] = (Head(keys, values), words)
    return _READY[name]


def _by_subtree(windows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(gram, n, asked) -> record batches, on whole subtrees of TOP + 1 context bytes, many at a time.

    A subtree has at most 2 ** 24 windows whatever the input, in text far fewer, as bytes follow one
    another in few ways; so none has to be split. windows: (gram, n, asked).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, wait = [], 0, CHUNK
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if size < wait:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            tree = columns[0] >> 8 & _suffix(TOP + 1, 0)
            end = size - int(np.argmax(tree[::-1] != tree[-1])) if tree[0] != tree[-1] else 0
            if end:
                yield from work(*(c[:end] for c in columns))
            held, size = [[c[end:] for c in columns]], size - end
            wait = size + CHUNK if end else 2 * size
        if size:
            yield from work(*(np.concatenate(c) for c in zip(*held)))

    tree = F.shiftright("gram", 8).bitwiseAND(F.lit(_suffix(TOP + 1, 0)))
    return windows.repartition(tree).sortWithinPartitions(tree).select("gram", "n", "asked").mapInArrow(run, schema)


def _top_levels(grams: DataFrame, depth: int) -> list[list[Nodes]]:
    """The levels 0..TOP of the tree; what is under them is weighted in tasks and summed by their nodes."""

    def raise_up(gram: np.ndarray, n: np.ndarray, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        for known, (key, w) in enumerate(weigh(gram, n, depth, TOP + 1)[1]):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), known, np.int32)), pa.array(key), pa.array(w)], names=["known", "key", "w"])

    sums = _by_subtree(grams.withColumn("asked", F.lit(False)), raise_up, "known int, key bigint, w double")
    sums = sums.groupBy("known", "key").agg(F.sum("w").alias("w")).orderBy("known", "key").toArrow()
    known, key, w = (sums[c].to_numpy() for c in ("known", "key", "w"))
    top = grams.groupBy(F.col("gram").bitwiseAND(F.lit(_suffix(TOP))).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    return weigh(top["gram"].to_numpy(), top["n"].to_numpy(), TOP, 0, [(key[known == k], w[known == k]) for k in range(8)])[0]


def _values(windows: DataFrame, depth: int, top) -> DataFrame:
    """(gram, n, value) of the windows asked for: value is log2 P of their last byte under the whole tree.

    windows: (gram, n, asked), every training window once with its count, others with count 0.
    """

    def look(gram: np.ndarray, n: np.ndarray, asked: np.ndarray) -> Iterator[pa.RecordBatch]:
        if asked.any():
            some = np.flatnonzero(n)
            want = np.flatnonzero(asked)
            want = want[np.argsort(gram[want])]
            value = predict(gram[want], top.value + weigh(gram[some], n[some], depth, TOP + 1)[0])
            yield pa.RecordBatch.from_arrays([pa.array(gram[want]), pa.array(n[want]), pa.array(value)], names=["gram", "n", "value"])

    return _by_subtree(windows, look, "gram bigint, n bigint, value double")


def _frequent(grams: DataFrame, most: int) -> int | None:
    """The least class of counts (eighths of a power of two) such that it and those above have at most `most` windows."""
    classes = grams.groupBy(_count_class().alias("c")).count().orderBy(F.desc("c")).collect()  # some hundred rows at most
    least, total = None, 0
    for r in classes:
        total += r["count"]
        if total > most:
            break
        least = r["c"]
    return least


def _count_class():
    return F.floor(F.log2("n") * 8).cast("int")


def lm_scores(
    docs: DataFrame,
    depth: int = DEPTH,
    max_windows: int = MAX_WINDOWS,
    max_words: int = MAX_WORDS,
    folds: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model learns from the rows whose crc32(doc_id as text) mod folds is not 0, all of them and
    their whole texts, and scores every row. Both scores are log10 probabilities of the same event,
    the words and the end of the text: base_score by smoothed word frequencies, score by context-tree
    weighting of the bytes. A null text counts as empty (only the end is coded); a null id counts as
    the empty string in the split; repeated rows count and score as often as they occur; extra
    columns are ignored; an empty table gives an empty table. With no training rows the model is
    uniform over bytes and base_score has c = N = V = 0.

    Windows and words are counted per task, summed by a shuffle and kept as tables. The tree is whole:
    each context of 0..depth bytes (TOP < depth <= DEPTH) that occurs in training is a node. What
    lies under the same TOP + 1 bytes is weighted in one task, the few levels above by the driver.
    max_windows windows and max_words words, the most frequent, are sent to every task with their
    values; all others are counted per document and get theirs by a join, so the bounds do not change
    a score. A very long text is coded in blocks that each bring their context.
    """
    if not TOP < depth <= DEPTH:
        raise ValueError(f"depth must be in {TOP + 1}..{DEPTH}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), held.alias("held_out"))
    partial = materialize(base.where("not held_out").select("text").mapInArrow(_count, "gram bigint, word string, n bigint"), "ctw-partial")
    gram = F.col("gram").bitwiseAND(F.lit(_suffix(depth)))
    grams = materialize(partial.where("gram is not null").groupBy(gram.alias("gram")).agg(F.sum("n").alias("n")), "ctw-grams")
    words = materialize(partial.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "ctw-words")
    discard(partial)
    n_all, n_words = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = words.orderBy(F.desc("c"), "word").limit(max_words).toArrow()
    frequent = dict(zip((w.encode("utf-8", "surrogatepass") for w in top["word"].to_pylist()), top["c"].to_pylist()))
    top_levels = spark.sparkContext.broadcast(_top_levels(grams, depth))
    least = _frequent(grams, max_windows)
    asked = F.lit(False) if least is None else _count_class() >= least
    head = _values(grams.withColumn("asked", asked), depth, top_levels).toArrow()
    first = np.lexsort((head["gram"].to_numpy(), -head["n"].to_numpy()))
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, head["gram"].to_numpy()[first], head["value"].to_numpy()[first], frequent))
    whole = n_words <= max_words  # then the table has every word and the join finds nothing to do
    bottom = n_all + 0.1 * (n_words + 1)
    kind = base.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_windows, table = _ready(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n_tokens, known, base_score, bits, size, rare, missed = [], [], [], [], [], [], []
                for t in part.column(1):
                    w = tokens(t.as_py())
                    data = stream(w)
                    total, other = 0.0, []
                    for g in _blocks(data):
                        found, rest = known_windows.total(g & _suffix(depth))
                        total += found
                        other.append(np.unique(rest, return_counts=True))
                    seen = Counter(w)
                    seen[END.encode()] += 1
                    k, s, left = 0, 0.0, []
                    for word, m in seen.items():
                        c = table.get(word)
                        if c is not None:
                            k += m
                            s += m * math.log10((c + 0.1) / bottom)
                        elif whole:
                            s += m * math.log10(0.1 / bottom)
                        else:
                            left.append({"word": word.decode("utf-8", "surrogatepass"), "m": m})
                    n_tokens.append(len(w) + 1)
                    known.append(k)
                    base_score.append(s)
                    bits.append(total)
                    size.append(len(data))
                    rare.append(left)
                    missed.append(other[0] if len(other) == 1 else _merge(other)[0])
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([m[i] for m in missed])) for i in (0, 1)], ["gram", "m"])
                ends = np.cumsum([0, *(len(m[0]) for m in missed)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base_score, pa.float64()),
                        pa.array(bits, pa.float64()), pa.array(size, pa.int64()),
                        pa.array(rare, pa.list_(pa.struct([("word", pa.string()), ("m", pa.int64())]))), pa.ListArray.from_arrays(pa.array(ends), pairs),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "bits", "n_stream", "rare", "missed"],
                )

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, bits double, n_stream bigint, rare array<struct<word:string,m:bigint>>, missed array<struct<gram:bigint,m:bigint>>"
    # rows are told apart by a number of their own, since ids may repeat
    scored = base.select("doc_id", "text", "held_out").mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored, "ctw-scored")
    missed = scored.select("row", F.inline("missed"))
    # of the windows outside the head none is frequent, but for the few whose place in its table was taken
    windows = grams.withColumn("asked", F.lit(False)).union(missed.select("gram", F.lit(0).cast("long"), F.lit(True)).distinct())
    windows = windows.groupBy("gram").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    values = materialize(_values(windows, depth, top_levels).select("gram", "value"), "ctw-values")
    more = missed.join(values, "gram").select("row", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("s"), (F.col("m") * F.col("value")).alias("b"))
    if not whole:
        c = F.coalesce("c", F.lit(0))
        more = more.union(
            scored.select("row", F.inline("rare")).join(words, "word", "left").select(
                "row", F.when(c > 0, F.col("m")).otherwise(0), F.col("m") * F.log10((c + 0.1) / F.lit(bottom)), F.lit(0.0)
            )
        )
    more = more.groupBy("row").agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("b").alias("b"))
    scored = scored.drop("rare", "missed").join(more, "row", "left").withColumns(
        {"n_known": F.col("n_known") + F.coalesce("k", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("s", F.lit(0.0)), "bits": F.col("bits") + F.coalesce("b", F.lit(0.0))}
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score",
        (F.col("bits") * math.log10(2)).alias("score"), (-F.col("bits") / F.col("n_stream")).alias("bits_per_byte"),
    )
