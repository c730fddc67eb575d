"""Connected components, and choices in order of priority, as rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.storage import discard, materialize, scratch_path, shuffled

#: Parts over which the neighbours of one node are spread.
SALTS = 32


def _with_lowest(edges: DataFrame) -> DataFrame:
    """edges(u, v) with m, the smallest v of each u: found per salt, then per node, and joined back per salt, so no hub is one key."""
    salted = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    part = salted.groupBy("u", "s").agg(F.min("v").alias("m"))
    low = part.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("s").alias("s"))  # at most SALTS a node
    return salted.join(shuffled(low.select("u", "m", F.explode("s").alias("s"))), ["u", "s"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_lowest(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return (
        _with_lowest(down)
        .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        .where("u <> v")
    )


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges(u, v), v the smaller end, are stars: each u has one v, which is no u. A round would change nothing."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    sums = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or (up > 0 and down > 0)").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u, v) of one orderable type -> (node, component), component being its smallest node.

    Nodes without an edge do not appear; an empty table gives an empty table; loops, repeats and
    null ends are dropped. Alternates large-star and small-star contraction, so each round is a
    pre-aggregated minimum and an equi-join, and each round's edges go to the shared folder. No
    group is gathered: the neighbours of a hub are dealt over SALTS parts, which meet only in
    their minima.
    """
    now = materialize(
        edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        if _settled(now):
            break
        after = materialize(_small_star(_large_star(now)).distinct(), "edges")
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def suppressed(edges: DataFrame) -> DataFrame:
    """(node) that go when, from the strongest on, each node that is still there removes those below it: edges(strong, weak).

    No edge may lead round in a circle. In a round all nodes stay that nothing stronger can remove any
    more; what they remove goes, with its edges. So there are as many rounds as nodes in a chain wait
    for one another, whatever the number of chains. An empty table gives an empty table; repeated
    edges and null ends are dropped.
    """
    now = materialize(edges.select("strong", "weak").where("strong is not null and weak is not null").distinct(), "suppress-edges")
    path, rounds = scratch_path(edges.sparkSession, "suppressed"), 0
    while not now.isEmpty():
        stay = now.select("strong").distinct().join(shuffled(now.select(F.col("weak").alias("strong")).distinct()), "strong", "left_anti")
        gone = now.join(shuffled(stay), "strong", "left_semi").select(F.col("weak").alias("node")).distinct()
        gone.write.parquet(f"{path}/round={rounds}")
        gone = edges.sparkSession.read.parquet(f"{path}/round={rounds}")
        if gone.isEmpty():
            raise ValueError("the edges lead round in a circle")
        after = now.join(shuffled(gone.withColumnRenamed("node", "weak")), "weak", "left_anti").join(shuffled(gone.withColumnRenamed("node", "strong")), "strong", "left_anti")
        after = materialize(after.select("strong", "weak"), "suppress-edges")
        discard(now)
        now, rounds = after, rounds + 1
    kind = edges.schema["weak"].dataType.simpleString()
    if not rounds:
        return edges.sparkSession.createDataFrame([], f"node {kind}")
    return edges.sparkSession.read.schema(f"node {kind}").parquet(path).select("node")


def matched(pairs: DataFrame) -> DataFrame:
    """Those of pairs(page, left, right) that are taken when, on each page in order of (left, right), a pair is if both of its ends are free.

    In a round all pairs are taken that are the first of their left end and of their right end; the
    other pairs of these ends go. An empty table gives an empty table; repeated pairs are one.
    """
    now = materialize(pairs.select("page", "left", "right").distinct(), "match-pairs")
    path, rounds = scratch_path(pairs.sparkSession, "matched"), 0
    while not now.isEmpty():
        of_left, of_right = now.groupBy("page", "left").agg(F.min("right").alias("right")), now.groupBy("page", "right").agg(F.min("left").alias("left"))
        of_left.join(shuffled(of_right), ["page", "left", "right"], "left_semi").select("page", "left", "right").write.parquet(f"{path}/round={rounds}")
        took = pairs.sparkSession.read.schema(now.schema).parquet(f"{path}/round={rounds}")
        after = materialize(now.join(shuffled(took.select("page", "left")), ["page", "left"], "left_anti").join(shuffled(took.select("page", "right")), ["page", "right"], "left_anti"), "match-pairs")
        discard(now)
        now, rounds = after, rounds + 1
    if not rounds:
        return now
    return pairs.sparkSession.read.schema(now.schema).parquet(path).select("page", "left", "right")
