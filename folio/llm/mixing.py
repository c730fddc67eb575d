"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.storage import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(source, source_size) -> plus target: weighted shares of share * total, none above cap * size.

    Water filling in closed form: sources fill up in order of cap*size/weight, so the level is read
    off running sums over the sources (one row each, ordered by a window on the source table).
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("full", cap * F.col("source_size")).withColumn("turn", F.col("full") / F.col("w"))
    order = Window.orderBy("turn", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("filled", F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("turn_no", F.row_number().over(order))
        .withColumn("budget", share * F.sum("source_size").over(everything))
    )
    # the level is that of the first source, in filling order, which its share does not fill
    level = (F.col("budget") - F.col("filled")) / F.col("open_w")
    rows = rows.withColumn("level", F.min_by(level, F.when(level < F.col("turn"), F.col("turn_no"))).over(everything))
    target = F.when(F.col("level").isNull() | (F.col("turn") <= F.col("level")), F.col("full")).otherwise(F.col("w") * F.col("level"))
    return rows.select("source", "source_size", target.alias("target"))


def _rate(lam: Column, x: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(lam * x, F.lit(50.0))))


def tilted_rates(classes: DataFrame, targets: DataFrame, cap: float = 2.0, rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """Entropy-balanced rates of document classes(source, size, n): -> source, size, n, target, rate.

    Rates nearest to one in relative entropy, at most cap, whose words meet each source's target:
    rate = min(cap, exp(lambda_source * size / mean size)). The dual is convex and separable, so
    every Newton round is one grouped sum over the classes (value and slope per source) and a
    step, kept inside a bracket that each evaluation narrows. Sources at their cap need no
    multiplier: their rate is cap.
    """
    means = classes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    base = classes.join(targets, classes["source"].eqNullSafe(targets["source"]), "left").drop(targets["source"])
    base = base.join(means, base["source"].eqNullSafe(means["source"]), "left").drop(means["source"])
    open_ = (F.col("target") < cap * F.col("source_size") * (1 - 1e-12)) & (F.col("target") > 0)
    base = materialize(base.withColumn("open", open_).withColumn("x", F.when(F.col("mean") > 0, F.col("size") / F.col("mean")).otherwise(0.0)), "mix-classes")
    state = materialize(
        base.where("open and size > 0").groupBy("source", "target")
        .agg(F.min("x").alias("x"), F.first("source_size").alias("all")).select(
            "source",
            "target",
            F.lit(0.0).alias("lam"),
            F.least(F.lit(0.0), F.log(F.col("target") / F.col("all")) / F.col("x")).alias("lo"),
            (F.lit(math.log(cap)) / F.col("x")).alias("hi"),
            F.lit(False).alias("done"),
        ),
        "mix-state",
    )
    for _ in range(rounds):
        s = state.alias("s")
        joined = base.where("open and size > 0").alias("b").join(s, F.col("b.source").eqNullSafe(F.col("s.source")))
        rate = _rate(F.col("s.lam"), F.col("b.x"), cap)
        words = F.col("b.size") * F.col("b.n")
        sums = joined.groupBy("s.source", "s.target", "s.lam", "s.lo", "s.hi").agg(
            F.sum(words * rate).alias("value"), F.sum(F.when(rate < cap, words * rate * F.col("b.x")).otherwise(0.0)).alias("slope")
        )
        gap = F.col("value") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        moved = sums.withColumn("done", F.abs(gap) <= tolerance * F.col("target")).withColumn("nlo", lo).withColumn("nhi", hi)
        step = F.when((newton > F.col("nlo")) & (newton < F.col("nhi")), newton).otherwise((F.col("nlo") + F.col("nhi")) / 2)
        moved = moved.withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(step))
        after = materialize(moved.select("source", "target", "lam", F.col("nlo").alias("lo"), F.col("nhi").alias("hi"), "done"), "mix-state")
        discard(state)
        state = after
        if not state.where("not done").limit(1).count():
            break
    lams = state.select(F.col("source").alias("of"), "lam")
    rate = F.when(F.col("target") <= 0, F.lit(0.0)).when(~F.col("open"), F.lit(cap)).otherwise(_rate(F.coalesce("lam", F.lit(0.0)), F.col("x"), cap))
    return base.join(lams, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "size", "n", "target", "source_size", rate.alias("rate"))


def class_copies(rates: DataFrame, cap: int = 2) -> DataFrame:
    """Whole copies per class (source, size): -> source, size, copies, with the words of a source near its target.

    Sizes are taken from the largest down; the running error of words is carried on to the next
    size, so what remains at the end is about half of the smallest documents. The fold runs over
    the distinct sizes of a source, which the longest text bounds, not over its documents.
    """

    def fold(classes: pd.DataFrame) -> pd.DataFrame:
        err, copies = 0.0, []
        classes = classes.sort_values("size", ascending=False)
        for size, n, rate in zip(classes["size"].tolist(), classes["n"].tolist(), classes["rate"].tolist()):
            err += rate * n * size
            copies.append(max(0, min(cap * n, math.floor(err / size + 0.5))) if size else 0)
            err -= copies[-1] * size
        return pd.DataFrame({"source": classes["source"], "size": classes["size"], "copies": copies})

    kind = rates.schema["source"].dataType.simpleString()
    return rates.groupBy("source").applyInPandas(fold, f"source {kind}, size bigint, copies bigint")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    buckets: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (copies * size), copies.

    Size is the number of words (null text: 0); documents of size 0 are taken 0 times. Sources are
    ordered by code point, null last, and weigh `weights` in turn; they share `share` times all
    words, none above `cap` times its own. Ties and repeated rows: documents of one source and size
    are alike, and their copies go round by a hash of the id, so reruns agree. An empty table gives
    an empty table. Extra columns are ignored.

    Documents are first summed to classes (source, size); balancing and rounding see classes only.
    A class of a third of all rows is ranked in `buckets` hash buckets, joined by their offsets.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = sized.withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    sized = materialize(sized.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")), "mix-docs")
    counts = materialize(sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("k")), "mix-counts")
    classes = counts.groupBy("source", "size").agg(F.sum("k").alias("n"))
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, float(cap)), "mix-targets")
    rates = materialize(tilted_rates(classes, targets, float(cap)), "mix-rates")
    copies = class_copies(rates, cap)
    per_class = rates.alias("r").join(
        copies.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size"))
    ).select("r.source", "r.size", "r.n", "r.target", "r.source_size", "c.copies")
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("k").over(before), F.lit(0)))
    plan = offsets.alias("o").join(
        per_class.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source")) & (F.col("o.size") == F.col("p.size"))
    ).select("o.source", "o.size", "o.bucket", "o.offset", "p.n", "p.target", "p.source_size", "p.copies")
    place = Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id")
    ranked = sized.withColumn("place", F.row_number().over(place) - 1)
    out = ranked.alias("d").join(
        plan.alias("q"),
        F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.size") == F.col("q.size")) & (F.col("d.bucket") == F.col("q.bucket")),
    )
    rank = F.col("q.offset") + F.col("d.place")
    n = F.floor(F.col("q.copies") / F.col("q.n")) + F.when(rank < F.pmod(F.col("q.copies"), F.col("q.n")), 1).otherwise(0)
    return out.select("d.doc_id", "d.size", "q.source_size", "q.target", (n * F.col("d.size")).cast("long").alias("taken"), n.cast("int").alias("copies"))
