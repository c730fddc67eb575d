"""Chat formatting with minimum-cost role repair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.storage import materialize

ROLES = ("system", "user", "assistant")
# States of the automaton: nothing said yet, and the role of the turn that is open.
START, SYSTEM, USER, ASSISTANT = range(4)
#: (state, role) pairs in which a turn of the role may open.
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Costs: joining a turn to the open one, changing a known role, naming an unknown one, an empty turn.
MERGE, RELABEL, NAMING, INSERT = 2, 5, 1, 8
#: Conversations of more turns are repaired block by block, a block in a task.
BLOCK = 4096
_FAR = 10**9


def _steps(role: int) -> list[list[tuple[int, int, tuple]]]:
    """Per state before a turn of this role (0: unknown): (cost, state after, (inserted roles, written role, merged))."""
    out: list[list] = [[] for _ in range(4)]
    for before in range(4):
        for written in (SYSTEM, USER, ASSISTANT):
            name = 0 if written == role else (NAMING if role == 0 else RELABEL)
            if written == before:
                out[before].append((name + MERGE, written, ((), written, True)))
            for inserted in ((), (USER,), (ASSISTANT,), (USER, ASSISTANT)):
                state = before
                for r in (*inserted, written):
                    if (state, r) not in LEGAL:
                        break
                    state = r
                else:
                    out[before].append((name + INSERT * len(inserted), written, (inserted, written, False)))
    return out


#: The cheapest step for each role, state before and state after; ties go to merging, then fewer insertions.
STEP: list[list[list[tuple | None]]] = [
    [[min((s for s in _steps(role)[a] if s[1] == b), key=lambda s: (s[0], not s[2][2], len(s[2][0])), default=None) for b in range(4)] for a in range(4)]
    for role in range(4)
]
COST = np.array([[[s[0] if s else _FAR for s in row] for row in per] for per in STEP], np.int64)
#: An assistant turn must close a conversation: (cost, inserted roles) per last state.
CLOSE = [(0, ()), (2 * INSERT, (USER, ASSISTANT)), (INSERT, (ASSISTANT,)), (0, ())]


def _role_code(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def block_matrix(roles: list[int]) -> np.ndarray:
    """Least cost from each state before a block to each state after it: a (min, +) product over its turns."""
    m = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for r in roles:
        m = np.minimum((m[:, :, None] + COST[r][None]).min(axis=1), _FAR)
    return m


def block_steps(roles: list[int], best: list[int]) -> tuple[list[list[int]], list[int]]:
    """Least cost of reaching each state, turn by turn from the costs `best` before a block.

    Returns per turn the state before it on a cheapest path to each state after it (ties go to the
    lower state), and the costs after the block.
    """
    back = []
    for r in roles:
        total = [[best[a] + int(COST[r][a][b]) for a in range(4)] for b in range(4)]
        back.append([min(range(4), key=row.__getitem__) for row in total])
        best = [min(min(row), _FAR) for row in total]
    return back, best


def entered_from(back: list[list[int]], leave: int) -> int:
    """State before the block on the cheapest path that leaves it in a state."""
    for choice in reversed(back):
        leave = choice[leave]
    return leave


def path(roles: list[int], back: list[list[int]], leave: int) -> list[tuple]:
    """The (inserted roles, written role, merged) of each turn on the cheapest path that leaves in a state."""
    steps = []
    for r, choice in zip(reversed(roles), reversed(back)):
        before = choice[leave]
        steps.append(STEP[r][before][leave][2])
        leave = before
    return steps[::-1]


def last_state(best: list[int]) -> int:
    """The state in which closing a conversation is cheapest in all; ties go to the lower state."""
    return min(range(4), key=lambda s: best[s] + CLOSE[s][0])


BEGIN = [0, _FAR, _FAR, _FAR]


def _parts(batches: Iterator[pa.RecordBatch], value: str, found) -> Iterator[pa.RecordBatch]:
    """found(row) per row of one block, beside conv_id and block, as a list of longs."""
    for b in batches:
        rows = [found(r) for r in b.drop_columns(["conv_id"]).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(rows, pa.list_(pa.int64()))], names=["conv_id", "block", value])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _parts(batches, "m", lambda r: block_matrix([_role_code(x) for x in r["roles"]]).reshape(-1).tolist())


def _backs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(r: dict) -> list[int]:
        back, _ = block_steps([_role_code(x) for x in r["roles"]], r["best"])
        return [entered_from(back, s) for s in range(4)]

    return _parts(batches, "back", found)


def _over_parts(batches: Iterator[pa.RecordBatch], value: str, scan) -> Iterator[pa.RecordBatch]:
    """scan(parts of a conversation in order) -> a list of longs per part."""
    for b in batches:
        conv, block, out = [], [], []
        for c, parts in zip(b.column("conv_id").to_pylist(), b.column("parts").to_pylist()):
            conv += [c] * len(parts)
            block += [p["block"] for p in parts]
            out += scan(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv, b.schema.field("conv_id").type), pa.array(block, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "block", value]
        )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block the least costs before it and, in its last block, the state in which the conversation is left (else -1)."""

    def scan(parts: list[dict]) -> list[list[int]]:
        best, out = np.array(BEGIN), []
        for p in parts:
            out.append([*map(int, best), -1])
            best = np.minimum((best[:, None] + np.array(p["m"]).reshape(4, 4)).min(axis=0), _FAR)
        out[-1][4] = last_state(best.tolist())
        return out

    return _over_parts(batches, "entry", scan)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: the state before it, the state after it, and whether it is the last."""

    def scan(parts: list[dict]) -> list[list[int]]:
        state, out = parts[-1]["last"], []
        for p in reversed(parts):
            out.append([p["back"][state], state, int(not out)])
            state = p["back"][state]
        return out[::-1]

    return _over_parts(batches, "span", scan)


def render(turns: list[dict], steps: list[tuple], state: int, last: bool) -> tuple[int, int, int, int, int, str]:
    """(turns, merged, relabelled, inserted, cost, text) of turns with their steps, entered in a state."""
    out: list[str] = []
    merged_n = relabelled = inserted_n = cost = 0

    def begin(role: int) -> None:
        nonlocal state
        out.append(("<|end|>\n" if state != START else "") + f"<|{ROLES[role - 1]}|>\n")
        state = role

    for turn, (inserted, written, merged) in zip(turns, steps):
        code, text = _role_code(turn["role"]), turn["text"] or ""
        for r in inserted:
            begin(r)
        inserted_n += len(inserted)
        relabelled += written != code
        merged_n += merged
        cost += INSERT * len(inserted) + MERGE * merged + (written != code) * (RELABEL if code else NAMING)
        if merged:
            out.append("\n\n")
        else:
            begin(written)
        out.append(text if text.endswith("\n") else text + "\n")
    if last:
        closing, inserted = CLOSE[state]
        for r in inserted:
            begin(r)
        inserted_n += len(inserted)
        cost += closing
        if state != START:
            out.append("<|end|>\n")
    return len(turns), merged_n, relabelled, inserted_n, cost, "".join(out)


FIGURES = ("n_turns", "n_merged", "n_relabelled", "n_inserted", "cost")


def _figures(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows)) or [()] * 6
    return [pa.array(c, k) for c, k in zip(columns, (pa.int64(),) * 5 + (pa.string(),))]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one block: found, repaired and rendered in one go."""
    for b in batches:
        rows = []
        for turns in b.column("turns").to_pylist():
            codes = [_role_code(t["role"]) for t in turns]
            back, best = block_steps(codes, BEGIN)
            rows.append(render(turns, path(codes, back, last_state(best)), START, True))
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), *_figures(rows)], names=["conv_id", *FIGURES, "text"])


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of longer conversations, with the costs and states at their ends."""
    for b in batches:
        rows = []
        for r in b.drop_columns(["conv_id"]).to_pylist():
            enter, leave, last = r["span"]
            codes = [_role_code(t["role"]) for t in r["turns"]]
            back, _ = block_steps(codes, r["entry"][:4])
            rows.append(render(r["turns"], path(codes, back, leave), enter, bool(last)))
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), *_figures(rows)], names=["conv_id", "block", *FIGURES, "text"])


_SUMS = ", ".join(f"{c} bigint" for c in FIGURES)


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b joined on conv_id (null is a conversation as well) and block."""
    b = b.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    return a.join(b, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block")


def _parts_of_long(turns: DataFrame, kind: str) -> DataFrame:
    """(conv_id, block, figures, text) of the blocks of long conversations, in order of block.

    Turns are range-partitioned by their order, so one conversation spreads over tasks. Blocks give
    (min, +) matrices; a scan over the matrices gives the least costs before each block; with
    these each block says from which state it is entered for each state in which it is left; a scan
    backwards over these fixes the states at all borders. So the path is the one that the turns
    give when taken one by one, wherever the blocks are cut.
    """
    order = ["conv_id", "turn", "role", "text"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = turns.repartitionByRange(n, "conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.floor(F.col("at") / BLOCK)), "chat-turns")
    blocks = placed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    roles = blocks.select("conv_id", "block", F.transform("turns", lambda t: t["role"]).alias("roles"))

    def parts(rows: DataFrame, *values: str) -> DataFrame:
        return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", *values))).alias("parts"))

    matrices = roles.mapInArrow(_matrices, f"conv_id {kind}, block bigint, m array<bigint>")
    entries = materialize(parts(matrices, "m").mapInArrow(_entries, f"conv_id {kind}, block bigint, entry array<bigint>"), "chat-entries")
    backs = _same(roles, entries).select("conv_id", "block", "roles", F.slice("entry", 1, 4).alias("best"))
    backs = _same(backs.mapInArrow(_backs, f"conv_id {kind}, block bigint, back array<bigint>"), entries)
    spans = parts(backs.withColumn("last", F.get("entry", F.lit(4))), "back", "last").mapInArrow(_leaves, f"conv_id {kind}, block bigint, span array<bigint>")
    return _same(_same(blocks, entries), spans).mapInArrow(_rendered, f"conv_id {kind}, block bigint, {_SUMS}, text string")


def format_chats(turns: DataFrame) -> DataFrame:
    """Repair the roles of turns(conv_id, turn, role, text, ...) at least cost and render each conversation.

    Legal: an optional system turn, then user and assistant turns by turns, an assistant turn last.
    A repair may join a turn to the one before, change its role or put an empty turn in front; the
    cheapest sequence is found by dynamic programming over the automaton. Of equally cheap repairs of
    a step joins win, then fewer insertions; of equally cheap sequences the one that, from the end
    backwards, comes from the lower state.

    One row per conversation: conv_id, n_turns, n_merged, n_relabelled, n_inserted, cost, text; the
    same however the rows are partitioned. Turns are ordered by (turn, role, text), so repeated rows
    and ties have a defined place; null turns come first; a null or other role is unknown and gets
    named; a null text is empty; null conv_ids are one conversation. Texts of any length are used
    whole. Extra columns are ignored; an empty table gives an empty table.

    Conversations of up to BLOCK turns are repaired in one go. Longer ones, up to one of a third of
    all rows, are found, repaired and rendered block by block in many tasks; only the finished texts
    of their blocks meet, in the row that holds them.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", "role", "text")
    long = materialize(rows.groupBy("conv_id").count().where(F.col("count") > BLOCK).select(F.col("conv_id").alias("long_id")), "chat-long")
    of_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    one = F.struct(F.col("turn").isNotNull().alias("some"), "turn", "role", "text")
    short = rows.join(long, of_long, "left_anti").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    short = short.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    out = short.mapInArrow(_whole, f"conv_id {kind}, {_SUMS}, text string")
    if not long.isEmpty():
        parts = _parts_of_long(rows.join(long, of_long, "left_semi"), kind)
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text")
        out = out.union(parts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in FIGURES], text))
    return out.select("conv_id", *[F.col(c).cast("int").alias(c) if c != "cost" else c for c in FIGURES], "text")
