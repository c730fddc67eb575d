"""Job frames, telemetry and admission as batch operators; folio.streaming runs the same expressions on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.folds import Fold, Hour, Lifecycle, Server, Uploads, folded
from folio.storage import discard, materialize

# Codes of a status frame.
RESULT, PROGRESS, ERROR, QUEUE, DISPATCHED, PAGE = 0, 1, 2, 3, 4, 5
STAGE = r"^gallery-(pre|tl|tl-done):(\d+)/(\d+)$"


def frame_parse(frame: Column) -> Column:
    """Struct of a binary frame: code, size, and for pages the token and page index behind it."""
    number = lambda at, n: F.conv(F.hex(F.substring(frame, at, n)), 16, 10).cast("long")
    code, size, token_len = number(1, 1).cast("int"), number(2, 4), number(6, 1)
    tail = F.call_function("substr", frame, F.lit(7), token_len.cast("int")).cast("string")
    index = F.conv(F.hex(F.call_function("substr", frame, (F.lit(7) + token_len).cast("int"), F.lit(4))), 16, 10).cast("long")
    page = code == PAGE
    return F.struct(code.alias("code"), size.alias("size"), F.when(page, tail).alias("token"), F.when(page, index).alias("idx"))


def job_state_aggregates() -> list[Column]:
    """The aggregates that fold the frames of a job into its state; order-free, so they also run on streams."""
    code, payload = F.col("code"), F.col("payload")
    stage, done, total = (F.regexp_extract(payload, STAGE, g) for g in (1, 2, 3))
    reached = lambda name: F.coalesce(F.max(F.when((code == PROGRESS) & (stage == name), done.cast("int"))), F.lit(0))
    return [
        F.count_if(code == PAGE).alias("emitted"),
        reached("pre").alias("pre"),
        reached("tl").alias("tl"),
        reached("tl-done").alias("tl_done"),
        F.coalesce(F.max(F.when((code == PROGRESS) & stage.isin("tl", "tl-done"), total.cast("int"))), F.lit(0)).alias("batches"),
        F.max_by(F.when(code == QUEUE, payload.cast("int")), F.when(code.isin(QUEUE, DISPATCHED), F.col("seq"))).alias("queue_pos"),
        F.coalesce(F.bool_or(code == DISPATCHED), F.lit(False)).alias("dispatched"),
        F.min_by(F.when(code == RESULT, "done").otherwise("failed"), F.when(code.isin(RESULT, ERROR), F.col("seq"))).alias("terminal"),
    ]


def job_state(frames: DataFrame) -> DataFrame:
    """frames(token, seq, code, payload) -> one row per token; the first terminal frame decides."""
    safe = frames.withColumn("payload", F.when(F.col("code") == QUEUE, F.when(F.col("payload").rlike(r"^\d+$"), F.col("payload"))).otherwise(F.col("payload")))
    return safe.groupBy("token").agg(*job_state_aggregates())


def poll_since(frames: DataFrame, since: DataFrame) -> DataFrame:
    """Frames past each token's cursor, since(token, cursor) clamped to [0, n]: token, seq, cursor (number of the frame)."""
    w = Window.partitionBy("token")
    numbered = frames.withColumn("cursor", F.row_number().over(w.orderBy("seq"))).withColumn("n", F.count("*").over(w))
    asked = since.select("token", F.col("cursor").alias("since"))
    return numbered.join(asked, "token").where(F.col("cursor") > F.least(F.greatest("since", F.lit(0)), "n")).select("token", "seq", "cursor")


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: pages delivered exactly once, jobs recorded once. A minimum, so it is combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(order, *[c for c in others if c != order])).alias("_first"))
    return first.select(*[c if c in keys else F.col("_first")[c].alias(c) for c in rows.columns])


def abandoned(polls: DataFrame, grace_s: int, now: Column | None = None) -> DataFrame:
    """polls(token, ts): for each token the first poll after which none came for longer than the grace; after its last poll, until now (if given)."""
    gap = F.lead("ts").over(Window.partitionBy("token").orderBy("ts"))
    seconds = F.unix_micros("next") - F.unix_micros("ts")
    following = gap if now is None else F.coalesce(gap, now)
    return polls.withColumn("next", following).where(seconds > grace_s * 1_000_000).groupBy("token").agg(F.min("ts").alias("last_poll"))


def retention(jobs: DataFrame, now: Column, keep_s: int) -> DataFrame:
    """Finished jobs whose end, or last poll where the end is not known, lies further back than keep_s."""
    return jobs.where(F.unix_micros(now) - F.coalesce(F.unix_micros("done_at"), F.unix_micros("last_poll")) > keep_s * 1_000_000)


def upload_assembly(parts: DataFrame, most_pages: int) -> DataFrame:
    """parts(token, part, parts, pages, ts): last write per part wins; status rejected (too many pages, though parts be missing), complete or incomplete."""
    last = parts.groupBy("token", "part").agg(F.max_by("pages", "ts").alias("pages"), F.max("parts").alias("parts"))
    all_ = last.groupBy("token").agg(
        F.count("*").alias("have"), F.max("parts").alias("parts"), F.sum("pages").alias("pages"),
        F.transform(F.sort_array(F.collect_list(F.struct("part", "pages"))), lambda x: x["pages"]).alias("layout"),
    )
    status = F.when(F.col("pages") > most_pages, "rejected").when(F.col("have") < F.col("parts"), "incomplete").otherwise("complete")
    return all_.select("token", "have", "pages", F.array_join(F.transform("layout", lambda x: x.cast("string")), ",").alias("layout"), status.alias("status"))


def undelivered_ranges(chunks: DataFrame, delivered: DataFrame, failed: DataFrame) -> DataFrame:
    """chunks(chunk_id, start_page, end_page): the range from the first page neither delivered nor failed to the chunk's end."""
    pages = chunks.select("chunk_id", "end_page", F.explode(F.sequence("start_page", F.col("end_page") - 1)).alias("page"))
    open_ = pages.join(delivered.select("page").union(failed.select("page")).distinct(), "page", "left_anti")
    return open_.groupBy("chunk_id", "end_page").agg(F.min("page").alias("from_page")).select("chunk_id", "from_page", "end_page")


def stall_counter(returns: DataFrame, key: str, order: str, progress: str) -> DataFrame:
    """Consecutive returns without progress so far, reset by progress."""
    w = Window.partitionBy(key).orderBy(order)
    islands = returns.withColumn("_g", F.sum((F.col(progress) > 0).cast("int")).over(w))
    inside = Window.partitionBy(key, "_g").orderBy(order)
    return islands.withColumn("stalls", F.sum((F.col(progress) <= 0).cast("int")).over(inside)).drop("_g")


def concurrency_profile(jobs: DataFrame, owner: str, start: str, end: str, block: int = 3_600_000_000) -> DataFrame:
    """(owner, ts, live, live_all): live jobs of an owner, and of all, after each moment (long) at which one of the owner's starts or ends.

    The overall sum runs within blocks of time, which are offset by the sum of the blocks before.
    """
    ups = jobs.select(F.col(owner).alias("owner"), F.col(start).alias("ts"), F.lit(1).alias("d"))
    downs = jobs.select(F.col(owner).alias("owner"), F.col(end).alias("ts"), F.lit(-1).alias("d"))
    moves = ups.union(downs).groupBy("owner", "ts").agg(F.sum("d").alias("d"))
    live = moves.select("owner", "ts", F.sum("d").over(Window.partitionBy("owner").orderBy("ts")).alias("live"))
    every = moves.groupBy("ts").agg(F.sum("d").alias("d")).withColumn("block", F.floor(F.col("ts") / block))
    blocks = every.groupBy("block").agg(F.sum("d").alias("d"))  # one row per block of time
    offsets = blocks.select("block", (F.sum("d").over(Window.orderBy("block")) - F.col("d")).alias("offset"))
    inside = F.sum("d").over(Window.partitionBy("block").orderBy("ts"))
    overall = every.withColumn("inside", inside).join(offsets, "block").select("ts", (F.col("inside") + F.col("offset")).alias("live_all"))
    return live.join(overall, "ts").select("owner", "ts", "live", "live_all")


def spacing_schedule(calls: DataFrame, key: str, at: str, order: str, gap: float) -> DataFrame:
    """start = max(own time, previous start + gap), in closed form: i*gap + max over earlier rows of time - j*gap."""
    w = Window.partitionBy(key).orderBy(at, order)
    i = F.row_number().over(w)
    shifted = calls.withColumn("_i", i).withColumn("_s", F.col(at) - F.col("_i") * gap)
    return shifted.withColumn("start", F.col("_i") * gap + F.max("_s").over(w)).drop("_i", "_s")


def admission(requests: DataFrame, key: str, at: str, order: str, hourly: int, window: int) -> DataFrame:
    """Per key in time order: admitted unless `hourly` admitted starts lie in the window before, its edge included; only admitted starts count.

    The decisions of one key depend on one another; the fold remembers its last `hourly` starts.
    Times are whole numbers of one unit.
    """
    rows = requests.withColumnRenamed(at, "at")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", admitted boolean"
    return folded(rows, key, "at", order, schema, lambda: Hour(hourly, window)).withColumnRenamed("at", at)


def uploads(parts: DataFrame, most_pages: int, ttl: int, exists: int, until: int) -> DataFrame:
    """parts(token, part, parts, pages, at): what became of each upload until then, as folds.Uploads tells."""
    return folded(parts, "token", "at", "part", Uploads.schema, lambda: Uploads(most_pages, ttl, exists), until)


def lifecycle(events: DataFrame, grace: int, keep: int, until: int) -> DataFrame:
    """events(token, seq, kind, at, done_at): the jobs that are forgotten until then, as folds.Lifecycle tells."""
    return folded(events, "token", "at", "seq", Lifecycle.schema, lambda: Lifecycle(grace, keep), until)


def admission_decision(requests: DataFrame, jobs: DataFrame, most_pages: int = 150, most_live: int = 8, most_own: int = 2, hourly: int = 12, block: int = 3_600_000_000) -> DataFrame:
    """requests(req_id, ip, at, pages) plus status, given the admitted jobs(ip, start, end), times in whole microseconds.

    413 for too many pages, else 503 if most_live jobs are live on the server, else 429 if most_own of
    the address are live or it had `hourly` starts in the hour before, else 200. What lies before the
    moment of the request counts. The server's jobs are summed within blocks of time, offset by the
    blocks before, so no task gets all of them.
    """
    none = F.lit(None).cast("bigint")
    moves = jobs.select("ip", F.col("start").alias("at"), F.lit(1).alias("d"), none.alias("req_id"), F.lit(0).alias("pages"))
    moves = moves.union(jobs.select("ip", "end", F.lit(-1), none, F.lit(0))).union(requests.select("ip", "at", F.lit(0), "req_id", "pages"))
    moves = moves.withColumn("block", F.floor(F.col("at") / block))
    own = Window.partitionBy("ip").orderBy("at")
    before = lambda w, x, start=Window.unboundedPreceding: F.coalesce(F.sum(x).over(w.rangeBetween(start, -1)), F.lit(0))
    rows = moves.withColumn("own", before(own, F.col("d"))).withColumn("starts", before(own, (F.col("d") > 0).cast("int"), -3_600_000_000))
    sums = moves.groupBy("block").agg(F.sum("d").alias("d"))  # one row per block of time
    offsets = sums.select("block", (F.sum("d").over(Window.orderBy("block")) - F.col("d")).alias("offset"))
    rows = rows.withColumn("inside", before(Window.partitionBy("block").orderBy("at"), F.col("d"))).where("req_id is not null").join(offsets, "block")
    live = F.col("inside") + F.col("offset")
    status = F.when(F.col("pages") > most_pages, 413).when(live >= most_live, 503).when((F.col("own") >= most_own) | (F.col("starts") >= hourly), 429).otherwise(200)
    return rows.select("req_id", "ip", "at", "pages", status.alias("status"))


def admission_server(
    requests: DataFrame, most_pages: int = 150, most_live: int = 8, most_own: int = 2, hourly: int = 12, window: int = 3_600_000_000, block: int = 21_600_000_000
) -> DataFrame:
    """requests(req_id, ip, at, pages, ends) plus status, as folds.Server decides them in order of (at, req_id); times in microseconds.

    Each decision rests on those before it, so time is cut into blocks. A task folds the requests of a
    block, given the jobs of earlier blocks that still are live or count for the hour. In the first
    round there are none; then the blocks whose given jobs have changed are decided again, until
    none has. The first block is right after one round and each next one at most a round after the
    one before, so the rounds end; where a server comes to rest, or is given the same jobs, they end
    there. No task sees more than a block and what reaches into it. A request that ends before its
    start, or with a null end, is live at no time.
    """
    rows = requests.select("req_id", "ip", "at", "pages", F.coalesce("ends", "at").alias("ends"), F.floor(F.col("at") / block).alias("block"), F.lit(False).alias("given"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", status int"
    server = lambda: Server(most_pages, most_live, most_own, hourly, window)
    decide = lambda r: folded(r, "block", "at", "req_id", schema, server)
    rows = materialize(rows, "admission-requests")
    decided = materialize(decide(rows), "admission")
    used = None
    while True:
        reach = F.floor(F.greatest("ends", F.col("at") + window) / block)
        later = decided.where((F.col("status") == 200) & (reach > F.col("block")))
        given = later.drop("status").withColumn("given", F.lit(True)).withColumn("block", F.explode(F.sequence(F.col("block") + 1, reach)))
        given = materialize(given, "admission-given")
        marks = given.groupBy("block").agg(F.sum(F.xxhash64("req_id", "at", "ip").cast("decimal(38,0)")).alias("mark"), F.count("*").alias("n"))
        marks = materialize(marks, "admission-marks")  # a row for each block
        if used is None:
            changed = marks.select("block")
        else:
            both = marks.join(used.withColumnsRenamed({"mark": "old", "n": "m"}), "block", "full")
            changed = both.where(~(F.col("mark").eqNullSafe(F.col("old")) & F.col("n").eqNullSafe(F.col("m")))).select("block")
        changed = materialize(changed.join(rows.select("block").distinct(), "block", "left_semi"), "admission-changed")
        if changed.isEmpty():
            discard(rows, given, marks, changed)
            return decided.select("req_id", "ip", "at", "pages", "ends", "status")
        again = decide(rows.union(given.select(*rows.columns)).join(changed, "block", "left_semi").select(*rows.columns))
        after = materialize(again.unionByName(decided.join(changed, "block", "left_anti")), "admission")
        discard(decided, given, changed, *([] if used is None else [used]))
        decided, used = after, marks


def throttle_latest(events: DataFrame, key: str, at: str, order: str, rate: float) -> DataFrame:
    """At most one event per `rate` seconds: the last of those that come meanwhile goes out when the time is over. Adds sent_at."""

    class Throttle(Fold):
        def __init__(self):
            self.open_at, self.pending = -1e18, None

        def close(self) -> list[dict]:
            return [] if self.pending is None else [self.pending | {"sent_at": self.open_at}]

        def step(self, row: dict) -> list[dict]:
            out = []
            if self.pending is not None and row[at] >= self.open_at:
                out, self.pending = self.close(), None
                self.open_at += rate
            if row[at] >= self.open_at:
                self.open_at = row[at] + rate
                return [*out, row | {"sent_at": row[at]}]
            self.pending = row
            return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", sent_at double"
    return folded(events, key, at, order, schema, Throttle)


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.when(b > 0, scale * a / b).otherwise(F.lit(0.0))
