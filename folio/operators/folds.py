"""Rules that fold the rows of a key in order of time, told once: batches and streams run the same ones."""

from __future__ import annotations

import heapq
from collections import Counter, deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Fold:
    """The state of a key. step(row), expire() and close() give the rows that go out.

    deadline() is a time after which the state changes by itself; a row at that very time still comes
    before. expire() makes the change. dump() is the state as plain values, None if there is nothing
    to remember; load() takes them back.
    """

    def step(self, row: dict) -> list[dict]:
        raise NotImplementedError

    def deadline(self) -> int | None:
        return None

    def expire(self) -> list[dict]:
        raise NotImplementedError

    def close(self) -> list[dict]:
        return []

    def dump(self) -> Any:
        raise NotImplementedError

    def load(self, state: Any) -> None:
        raise NotImplementedError

    def passed(self, until: int, also_at: bool = False) -> list[dict]:
        """All that happens by itself before a time, or at it."""
        out: list[dict] = []
        while (t := self.deadline()) is not None and (t < until or also_at and t == until):
            out += self.expire()
        return out


def folded(rows: DataFrame, key: str, at: str, order: str, schema: str, fold: Callable[[], Fold], until: int | None = None) -> DataFrame:
    """Each key's rows in order (at, order) through a fold of its own; deadlines up to `until` are met at a key's end.

    The rows are sorted and streamed, so only what the fold remembers is held, never a key.
    """
    names = rows.columns
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out, first = None, None, [], True
        end = lambda: ([] if until is None else state.passed(until, also_at=True)) + state.close()
        for b in batches:
            for row in b.to_pylist():
                if first or row[key] != current:
                    out += [] if first else end()
                    current, state, first = row[key], fold(), False
                out += state.passed(row[at]) + state.step(row)
            yield pa.RecordBatch.from_pylist(out, schema=target)
            out = []
        if not first:
            yield pa.RecordBatch.from_pylist(end(), schema=target)

    return rows.select(*names).repartition(key).sortWithinPartitions(key, at, order).mapInArrow(run, schema)


class Hour(Fold):
    """rows(req_id, ip, at): admitted unless `hourly` admitted starts lie in the window, its edge included; only admitted starts count."""

    def __init__(self, hourly: int, window: int):
        self.hourly, self.window, self.held = hourly, window, deque()

    def step(self, row: dict) -> list[dict]:
        admitted = len(self.held) < self.hourly
        if admitted:
            self.held.append(row["at"])
        return [row | {"admitted": admitted}]

    def deadline(self) -> int | None:
        return self.held[0] + self.window if self.held else None

    def expire(self) -> list[dict]:
        self.held.popleft()
        return []

    def dump(self) -> Any:
        return list(self.held) or None

    def load(self, state: Any) -> None:
        self.held = deque(state)


class Server(Fold):
    """rows(req_id, ip, at, pages, ends, given) -> those not given, with status, as a server with one list of jobs decides them.

    413 for too many pages, else 503 if most_live jobs are live, else 429 if most_own of the address are
    live or `hourly` of its jobs began in the window before, its edge included, else 200. Only admitted
    jobs count, from their start until just before they end. A given row is a job that was admitted before.
    """

    def __init__(self, most_pages: int, most_live: int, most_own: int, hourly: int, window: int):
        self.most_pages, self.most_live, self.most_own, self.hourly, self.window = most_pages, most_live, most_own, hourly, window
        self.live: list[tuple] = []
        self.own: Counter = Counter()
        self.starts: dict[Any, deque] = {}

    def _status(self, row: dict) -> int:
        if row["pages"] > self.most_pages:
            return 413
        if len(self.live) >= self.most_live:
            return 503
        if self.own[row["ip"]] >= self.most_own:
            return 429
        starts = self.starts.get(row["ip"], ())
        while starts and row["at"] - starts[0] > self.window:
            starts.popleft()
        return 429 if len(starts) >= self.hourly else 200

    def step(self, row: dict) -> list[dict]:
        while self.live and self.live[0][0] <= row["at"]:
            self.own[heapq.heappop(self.live)[2]] -= 1
        status = 200 if row["given"] else self._status(row)
        if status == 200:
            if row["ends"] > row["at"]:
                heapq.heappush(self.live, (row["ends"], row["req_id"], row["ip"]))
                self.own[row["ip"]] += 1
            self.starts.setdefault(row["ip"], deque()).append(row["at"])
        return [] if row["given"] else [row | {"status": status}]


class Uploads(Fold):
    """rows(token, part, parts, pages, at) -> (token, created, ended_at, have, pages, layout, status).

    The last write of a part wins. An upload is rejected as soon as its pages exceed the bound, complete
    when as many parts are in as its first row said, and dropped when that has not come `ttl` after
    its first part. For `exists` after it was complete, parts of the token are retries and change
    nothing. What comes after any of these begins a new upload.
    """

    schema = "token string, created bigint, ended_at bigint, have int, pages bigint, layout string, status string"

    def __init__(self, most_pages: int, ttl: int, exists: int):
        self.most_pages, self.ttl, self.exists = most_pages, ttl, exists
        self.load([None, None, 0, 0, {}])

    def load(self, state: Any) -> None:
        self.token, self.created, self.parts, self.known_until, got = state
        self.got = {int(k): v for k, v in got.items()}

    def dump(self) -> Any:
        return [self.token, self.created, self.parts, self.known_until, self.got] if self.got or self.known_until else None

    def _ended(self, at: int, status: str) -> list[dict]:
        row = {
            "token": self.token, "created": self.created, "ended_at": at, "have": len(self.got), "pages": sum(self.got.values()),
            "layout": ",".join(str(self.got[p]) for p in sorted(self.got)), "status": status,
        }
        self.load([None, None, 0, at + self.exists if status == "complete" else 0, {}])
        return [row]

    def step(self, row: dict) -> list[dict]:
        if self.known_until:
            return []
        if not self.got:
            self.token, self.created, self.parts = row["token"], row["at"], max(1, row["parts"] or 0)
        self.got[row["part"]] = row["pages"] or 0
        if sum(self.got.values()) > self.most_pages:
            return self._ended(row["at"], "rejected")
        return self._ended(row["at"], "complete") if len(self.got) >= self.parts else []

    def deadline(self) -> int | None:
        return self.created + self.ttl if self.got else self.known_until or None

    def expire(self) -> list[dict]:
        if self.got:
            return self._ended(self.created + self.ttl, "dropped")
        self.known_until = 0
        return []


class Lifecycle(Fold):
    """rows(token, kind, at, done_at) -> (token, status, started, last_poll, done_at, gone_at), one row when a job is forgotten.

    kind is start, poll, done or failed; what comes before a start is of no job. A running job that
    nobody polls for longer than `grace` is cancelled at that time. A finished one goes `keep` after
    done_at, or after its last poll where that is null; polls put off only the latter.
    """

    schema = "token string, status string, started bigint, last_poll bigint, done_at bigint, gone_at bigint"

    def __init__(self, grace: int, keep: int):
        self.grace, self.keep = grace, keep
        self.load([None] * 5)

    def load(self, state: Any) -> None:
        self.token, self.status, self.started, self.last_poll, self.done_at = state

    def dump(self) -> Any:
        return [self.token, self.status, self.started, self.last_poll, self.done_at] if self.status else None

    def step(self, row: dict) -> list[dict]:
        if self.status is None:
            if row["kind"] == "start":
                self.load([row["token"], "running", row["at"], row["at"], None])
        elif row["kind"] in ("start", "poll"):
            self.last_poll = row["at"]
        elif self.status == "running":
            self.status, self.done_at = row["kind"], row["done_at"]
        return []

    def deadline(self) -> int | None:
        if self.status is None:
            return None
        if self.status == "running":
            return self.last_poll + self.grace
        return (self.last_poll if self.done_at is None else self.done_at) + self.keep

    def expire(self) -> list[dict]:
        at = self.deadline()
        if self.status == "running":
            self.status, self.done_at = "cancelled", at
            return []
        row = {"token": self.token, "status": self.status, "started": self.started, "last_poll": self.last_poll, "done_at": self.done_at, "gone_at": at}
        self.load([None] * 5)
        return [row]


class Pack(Fold):
    """rows(size) -> with batch: a new one begins when a row and its overhead no longer fit and the batch is not empty."""

    def __init__(self, limit: int, overhead: int):
        self.limit, self.overhead, self.batch, self.filled = limit, overhead, 0, 0

    def step(self, row: dict) -> list[dict]:
        need = (row["size"] or 0) + self.overhead
        if self.filled > 0 and self.filled + need > self.limit:
            self.batch, self.filled = self.batch + 1, 0
        self.filled += need
        return [row | {"batch": self.batch}]


class Flush(Fold):
    """rows(size, n rows in all) -> with batch: the first ends at a third of the budget or three pages; later ones at cap pages or the budget, at a third of it when at most four rows are left."""

    def __init__(self, cap: int, soft: int):
        self.cap, self.soft, self.batch, self.held, self.pages, self.seen = cap, soft, 0, 0, 0, 0

    def step(self, row: dict) -> list[dict]:
        self.held, self.pages, self.seen = self.held + (row["size"] or 0), self.pages + 1, self.seen + 1
        third, out = self.held >= self.soft // 3, [row | {"batch": self.batch}]
        if self.batch == 0:
            over = third or self.pages >= 3
        else:
            over = self.pages >= self.cap or self.held >= self.soft or third and row["n"] - self.seen <= 4
        if over:
            self.batch, self.held, self.pages = self.batch + 1, 0, 0
        return out
