"""Quality classifier from weak labels: expectation-maximisation over heuristics, then a hashed linear scorer."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from folio.storage import discard, materialize

GOOD, BAD, NONE = 0, 1, 2
#: Labellers: five measures of a text, words that mark abuse, and the two given labels.
LABELLERS = ("shouting", "symbols", "stutter", "columns", "exclaiming", "cue words", "quality label", "toxic label")
MEASURES, CUE, QUALITY, TOXIC = range(5), 5, 6, 7
#: Kinds of documents: clean, junk of the kind that a measure tells, junk that none tells, abuse.
CLEAN, UNMARKED, ABUSE = 0, 6, 7
#: Votes that each labeller is credited with in each kind beforehand, and the share of them that is right.
CREDIT, RIGHT = 20.0, 0.9
#: Texts of fewer characters are not judged by their capitals.
SHORT = 30
#: Features are hashed to so many bits: words, word beginnings and binned measures.
BITS = 18
#: At most so many labelled rows are fitted on, and half as many without labels; chosen by a hash of the id.
SAMPLE_ROWS = 8_000
#: Rows that a step of the fit takes at once.
BLOCK = 1_000
#: A cue word is in at least CUE_DOCS fitted texts labelled toxic, and CUE_SHARE of the labelled texts that have it are; the CUES most frequent vote.
CUE_DOCS, CUE_SHARE, CUES = 8, 0.95, 500
_WORD = re.compile(r"[^\W\d_]+")
_UPPER = np.array([65 <= b <= 90 for b in range(256)], float)
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC2 for b in range(256)], float)
_SYMBOL = np.array([chr(b) in "#$%&*+/<=>@\\^_`{}~" for b in range(256)], float)


def measures(text: str) -> tuple[float, ...]:
    """Shares of capitals among letters, of symbols, of words that repeat the last, of bars, of exclamation marks."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    h = np.bincount(data, minlength=256)
    n, letters = max(1, len(data)), max(1.0, h @ _LETTER)
    words = text.split()
    same = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words))
    return h @ _UPPER / letters, h @ _SYMBOL / n, same, h[124] / n, h[33] / n


_BINS = ((0.05, 0.15, 0.4), (0.01, 0.04, 0.1), (0.05, 0.2, 0.5), (0.005, 0.02, 0.06), (0.005, 0.02, 0.06))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def votes(text: str, cues: frozenset[str] = frozenset()) -> list[int]:
    """Vote of each heuristic. A measure far up votes bad, far down votes good, between abstains; a cue word votes bad."""
    found = [BAD if m >= b[2] else GOOD if m < b[0] else NONE for m, b in zip(measures(text), _BINS)]
    if len(text) < SHORT:  # a capital or two are no shouting yet
        found[0] = NONE
    return [*found, NONE if not cues else GOOD if cues.isdisjoint(words_of(text)) else BAD]


def features(text: str) -> set[str]:
    """Words, their first five letters (marked), and binned measures (marked)."""
    words = words_of(text)
    starts = {f"^{w[:5]}" for w in words if len(w) > 5}
    bins = {f"#{k}:{sum(m >= x for x in b)}" for k, (m, b) in enumerate(zip(measures(text), _BINS))}
    return words | starts | bins


def slot(feature: str) -> int:
    return xxh32_intdigest(feature.encode("utf-8", "surrogatepass"), 9) >> (32 - BITS)


def _expected() -> np.ndarray:
    """The vote that is right for each labeller and kind (labellers, kinds); NONE where a labeller has no say."""
    right = np.full((len(LABELLERS), 8), GOOD)
    for j in MEASURES:
        right[j, j + 1] = BAD
    right[QUALITY, 1 : UNMARKED + 1] = BAD
    right[[CUE, TOXIC], ABUSE] = BAD
    right[QUALITY, ABUSE] = NONE
    return right


def _first_guess(patterns: np.ndarray) -> np.ndarray:
    """P(kind | pattern) to start from: the kinds that have a vote share it."""
    share = np.zeros((len(patterns), 8))
    share[:, 1:UNMARKED] = patterns[:, list(MEASURES)] == BAD
    share[:, ABUSE] = (patterns[:, CUE] == BAD).astype(float) + 2 * (patterns[:, TOXIC] == BAD)
    share[:, UNMARKED] = (patterns[:, QUALITY] == BAD) & (share.sum(1) == 0)
    share[:, CLEAN] = share.sum(1) == 0
    share += 0.02
    return share / share.sum(1, keepdims=True)


def estimate_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (k, labellers) with their counts.

    Documents are of one of eight kinds, in each of which the labellers vote independently. Returns
    P(bad | pattern), P(kind | pattern) (k, kinds) and the tables P(vote | kind) (labellers, kinds, 3).
    The accuracies of all labellers are estimated, those of the given labels too; each is credited
    with the same few right and wrong votes. A given label is missing at random: that it abstains
    says nothing. A kind is as bad as the given labels, by their tables, say of it.
    """
    onehot = (patterns[:, :, None] == np.arange(3)).astype(float)
    right = _expected()
    credit = np.where(right[:, :, None] == NONE, 0.5, np.where(np.arange(3) == right[:, :, None], RIGHT, 1 - RIGHT)) * CREDIT
    credit[:, :, NONE] = 1.0
    p = _first_guess(patterns)

    def tables(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = p * counts[:, None]
        table = np.einsum("kc,klv->lcv", weight, onehot) + credit
        table[[QUALITY, TOXIC], :, NONE] = 0.0
        table /= table.sum(2, keepdims=True)
        table[[QUALITY, TOXIC], :, NONE] = 1.0  # the same in all kinds
        return (weight.sum(0) + 1.0) / (weight.sum() + 8.0), table

    for _ in range(rounds):
        prior, table = tables(p)
        logs = np.log(prior)[None] + np.einsum("klv,lcv->kc", onehot, np.log(table))
        new = np.exp(logs - logs.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        done = np.abs(new - p).max(initial=0.0) < 1e-9
        p = new
        if done:
            break
    _, table = tables(p)
    bad = 1 - (1 - table[QUALITY, :, BAD]) * (1 - table[TOXIC, :, BAD])
    return p @ bad, p, table


def posteriors(codes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """P(bad) per code of all votes."""
    return estimate_accuracies(np.stack([codes // 3**j % 3 for j in range(len(LABELLERS))], axis=1), counts, rounds)[0]


def _counts(of: np.ndarray, width: int) -> np.ndarray:
    """np.bincount by pieces, which it copies."""
    total = np.zeros(width, np.int64)
    for at in range(0, len(of), 1 << 18):
        total += np.bincount(of[at : at + (1 << 18)], minlength=width)
    return total


def fit_logistic(owner: np.ndarray, slots: np.ndarray, target: np.ndarray, width: int, l2: float = 3.0, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of soft labels on features slots[i] of rows owner[i], in order; accelerated gradient steps.

    Each step goes over blocks of rows, so it needs no copy of all features; sums are taken in the order of the rows.
    """
    count = len(target)
    used = np.flatnonzero(_counts(slots, width))
    place = np.zeros(width, np.int32)
    place[used] = np.arange(len(used))
    index = place[slots]
    lengths = _counts(owner, count)
    w, v, b, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    scale = _counts(index, len(used)) * 0.25 + l2  # diagonal bound of the curvature
    step = 1 / max(1.0, float(np.percentile(lengths, 95) if count else 1))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    blocks = [(at, min(count, at + BLOCK)) for at in range(0, count, BLOCK)]
    for k in range(rounds):
        m = (k - 1) / (k + 2) if k else 0.0
        ahead, r, g = w + m * v, np.zeros(count), np.zeros(len(used))
        for x, y in blocks:
            own, features_of = owner[ends[x] : ends[y]], index[ends[x] : ends[y]]
            z = np.bincount(own - x, ahead[features_of], minlength=y - x) + b + m * vb
            r[x:y] = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target[x:y]
            np.add.at(g, features_of, r[own])
        g += l2 * ahead
        new = w + m * v - step * g / scale
        nb = b + m * vb - step * r.sum() / (0.25 * max(1, count))
        v, vb, w, b = new - w, nb - b, new, nb
    weights = np.zeros(width)
    weights[used] = w
    return weights, b


class Scorer:
    """Sum of the weights of the distinct slots of a text; remembers the slots of words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights.tolist(), bias, {}

    def probability(self, text: str) -> float:
        known = self.known
        if len(known) > 400_000:
            known.clear()
        used = set()
        for f in features(text):
            s = known.get(f)
            if s is None:
                s = known[f] = slot(f)
            used.add(s)
        total = self.bias + sum(map(self.weights.__getitem__, sorted(used)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


_SCORERS: dict[str, Scorer] = {}


def _scorer(model) -> Scorer:
    name, weights, bias = model.value
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(weights, bias)
    return _SCORERS[name]


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            texts = [t.as_py() or "" for t in part.column(1)]
            words = [sorted(words_of(t)) if toxic is not None else None for t, toxic in zip(texts, part.column(2).to_pylist())]
            slots = [sorted({slot(f) for f in features(t)}) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(words, pa.list_(pa.string())), pa.array(slots, pa.list_(pa.int32()))], names=["doc_id", "toxic", "words", "slots"]
            )


def _cue_words(sample: DataFrame) -> frozenset[str]:
    """Words that mark the texts labelled toxic in the bounded sample."""
    seen = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") == BAD).alias("n"), F.count("*").alias("all"))
    cues = seen.where((F.col("n") >= CUE_DOCS) & (F.col("n") >= CUE_SHARE * F.col("all"))).orderBy(F.desc("n"), "word").limit(CUES)
    return frozenset(r["word"] for r in cues.collect())


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.4,
    sample_rows: int = SAMPLE_ROWS,
    rounds: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, p_bad, kept (p_bad < threshold), weak_p (the weak-label posterior).

    A document is bad if it is junk or abuse. Heuristics vote on every whole text; labels(doc_id,
    quality, toxic) are two labellers more: quality 0 votes junk, toxic 1 abuse. One heuristic looks
    for cue words, which the sampled texts with a toxic label tell. Expectation-maximisation over the
    counts of all vote patterns (at most 3 to the number of labellers, whatever the corpus)
    estimates the accuracy of each labeller. The posteriors of at most sample_rows rows with labels
    and half as many without, chosen by a hash of the id, train a linear scorer over hashed words,
    word beginnings and measures, which then scores every whole text.

    A null text is empty and votes like one; null ids have no label and are not sampled; several
    labels of an id count as bad if any is; repeated rows are scored each; without any label the
    heuristics alone train the scorer; where no row has an id all score one half and are rejected;
    texts of any length are read whole; extra columns are ignored; an empty table gives an empty
    table.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vote = lambda column, bad: F.max(F.when(F.col(column) == bad, BAD).when(F.col(column).isNotNull(), GOOD)).alias(column)
    given = labels.where("doc_id is not null").groupBy("doc_id").agg(vote("quality", 0), vote("toxic", 1))
    given = given.where("quality is not null or toxic is not null")

    ids = base.select("doc_id").where("doc_id is not null")
    by_hash = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    labelled = ids.join(given, "doc_id").select("doc_id", "toxic").distinct().orderBy(*by_hash).limit(sample_rows)
    free = ids.join(given, "doc_id", "left_anti").distinct().orderBy(*by_hash).limit(sample_rows // 2).withColumn("toxic", F.lit(None).cast("int"))
    chosen = materialize(labelled.union(free), "quality-chosen")
    # bounded by sample_rows; a repeated id is sampled once
    sample = base.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    sample = sample.mapInArrow(_sample_features, f"doc_id {kind}, toxic int, words array<string>, slots array<int>")
    sample = materialize(sample, "quality-features")
    cues = spark.sparkContext.broadcast(_cue_words(sample))

    def vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [sum(v * 3**k for k, v in enumerate(votes(t.as_py() or "", cues.value))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.int32())], names=["doc_id", "votes"])

    voted = base.mapInArrow(vote_rows, f"doc_id {kind}, votes int").join(given, "doc_id", "left")
    code = F.col("votes") + 3**QUALITY * F.coalesce("quality", F.lit(NONE)) + 3**TOXIC * F.coalesce("toxic", F.lit(NONE))
    voted = materialize(voted.select("doc_id", code.cast("int").alias("votes")), "quality-votes")
    seen = voted.groupBy("votes").count().orderBy("votes").collect()  # at most 3 ** 8 rows
    codes, counts = np.array([r["votes"] for r in seen], int), np.array([r["count"] for r in seen], float)
    posterior = posteriors(codes, counts, rounds) if seen else np.zeros(0)
    table = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, posterior)], "votes int, weak_p double")
    weak = voted.join(F.broadcast(table), "votes").groupBy("doc_id").agg(F.max("weak_p").alias("weak_p"))

    rows = sample.select("doc_id", "slots").join(weak, "doc_id").select(F.monotonically_increasing_id().alias("row"), F.col("weak_p").alias("p"), "slots")
    rows = rows.orderBy("row").toArrow()  # bounded by sample_rows; Arrow columns, not Python rows
    lists = rows["slots"].combine_chunks()
    owner = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy()) if len(lists) else np.zeros(0, np.int32)
    index = lists.flatten().to_numpy() if len(lists) else np.zeros(0, np.int32)
    target, name = rows["p"].to_numpy(), f"{len(lists)}"
    del rows, lists
    pa.default_memory_pool().release_unused()
    weights, bias = fit_logistic(owner, index, target, 1 << BITS)
    del owner, index, target
    discard(sample, chosen)
    model = spark.sparkContext.broadcast((f"{name}-{bias!r}-{weights.sum()!r}", weights.astype(np.float32), float(bias)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for b in batches:
            p = [scorer.probability(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc_id", "p_bad"])

    scored = base.mapInArrow(score, f"doc_id {kind}, p_bad double")
    return (
        scored.join(weak.withColumnRenamed("doc_id", "weak_id"), F.col("doc_id").eqNullSafe(F.col("weak_id")), "left")
        .select("doc_id", "p_bad", (F.col("p_bad") < threshold).alias("kept"), "weak_p")
    )


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all its columns, without the rows that the classifier rejects. Of an id that occurs twice both go if one does; rows with a null id stay."""
    bad = quality_scores(docs, labels, id_col=id_col, text_col=text_col, **options).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
