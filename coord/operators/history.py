"""Task command logs: folding to state, claim arbitration, guards, dwell times, history checks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coord.functions.status import is_terminal, lookup
from coord.operators import ordered as O
from coord.schemas import (
    CHAT_TRANSITIONS, PROPOSAL_TRANSITIONS, RUNNER_TRANSITIONS, SESSION_TRANSITIONS, TASK_STATUSES, TASK_TRANSITIONS,
)

ABSENT = "absent"
#: Command code of a row that only carries the start state of its group.
MARKER = -9


@dataclass(frozen=True)
class Machine:
    """A transition table as data. ``initial`` is the state of a key before its first command."""

    states: Sequence[str]
    transitions: dict[tuple[str, str], str]
    initial: str
    commands: list[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "commands", sorted({c for _, c in self.transitions}))

    def table(self) -> list[list[int]]:
        """Next state per [state][command]; -1 where the command is not allowed."""
        index = {s: i for i, s in enumerate(self.states)}
        return [
            [index[self.transitions[s, c]] if (s, c) in self.transitions else -1 for c in self.commands] + [-1]
            for s in self.states
        ]

    def steps(self) -> np.ndarray:
        """[command][guard + 2][state before] -> state after; guard -2 never matches, -1 is none."""
        table, n = self.table(), len(self.states)
        out = np.tile(np.arange(n), (len(self.commands) + 1, n + 2, 1))
        for s, row in enumerate(table):
            for c, to in enumerate(row):
                if to >= 0:
                    out[c, [1, s + 2], s] = to
        return out

    def code(self, cmd: Column) -> Column:
        return lookup(cmd, {c: i for i, c in enumerate(self.commands)}, F.lit(len(self.commands))).cast("int")

    def state_code(self, state: Column) -> Column:
        """-1 for null (no guard), -2 for a name the machine does not know (never matches)."""
        known = lookup(state, {s: i for i, s in enumerate(self.states)}, F.lit(-2))
        return F.when(state.isNull(), F.lit(-1)).otherwise(known).cast("int")

    def state_name(self, code: Column) -> Column:
        return F.element_at(F.array(*[F.lit(s) for s in self.states]), code + 1)


TASKS = Machine(TASK_STATUSES, TASK_TRANSITIONS, "planning")
#: The same machine when the log also holds the ``create`` commands.
CREATED_TASKS = Machine([*TASK_STATUSES, ABSENT], {**TASK_TRANSITIONS, (ABSENT, "create"): "planning"}, ABSENT)


def machine(transitions: dict[tuple[str, str], str], initial: str) -> Machine:
    """Machine over the states its transitions name."""
    states = {initial, *(s for s, _ in transitions), *transitions.values()}
    return Machine(sorted(states), transitions, initial)


CHATS = machine(CHAT_TRANSITIONS, "created")
SESSIONS = machine(SESSION_TRANSITIONS, "creating")
RUNNERS = machine(RUNNER_TRANSITIONS, "registered")
PROPOSALS = machine(PROPOSAL_TRANSITIONS, "draft")


def prefixes(steps: np.ndarray, new: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """Composition of the steps of a group up to and including each row; ``new`` marks the first row of a group.

    A step is a vector: the state after, per state before. The rows are cut into about sqrt(n) blocks of as many
    rows. All blocks advance together, row by row, each from the identity; then what came before a block
    (``carry`` ahead of the first one) is put in front of its rows that no new group has cut off.
    """
    n, states = steps.shape
    width = max(1, math.isqrt(n))
    blocks = -(-n // width)
    identity = np.arange(states)
    steps = np.concatenate([steps, np.tile(identity, (blocks * width - n, 1))]).reshape(blocks, width, states)
    new = np.concatenate([new, np.zeros(blocks * width - n, bool)]).reshape(blocks, width)
    out, at = np.empty_like(steps), np.tile(identity, (blocks, 1))
    for k in range(width):
        at = np.take_along_axis(steps[:, k], np.where(new[:, k, None], identity, at), axis=1)
        out[:, k] = at
    cut = np.logical_or.accumulate(new, axis=1)
    for b in range(blocks):
        out[b, ~cut[b]] = out[b, ~cut[b]][:, carry]
        carry = out[b, -1]
    return out.reshape(-1, states)[:n]


def walk(machine: Machine, codes: np.ndarray, wants: np.ndarray, new: np.ndarray, starts: np.ndarray, carry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state before, state after or -1 not allowed or -2 guard failed, compositions) of each row.

    ``starts`` holds, on every row, the state its group begins in; ``carry`` what the open group was composed to before.
    """
    table = np.array(machine.table())
    steps = machine.steps()[np.maximum(codes, 0), wants + 2]
    steps[codes == MARKER] = np.arange(len(machine.states))
    carry = np.arange(len(machine.states)) if carry is None else carry
    done = prefixes(steps, new, carry)
    held = np.concatenate([carry[None], done[:-1]])
    before = np.where(new, starts, held[np.arange(len(codes)), starts])
    after = np.where((wants != -1) & (wants != before), -2, table[before, np.maximum(codes, 0)])
    return before, after, done


def _starts(batch: pa.RecordBatch, cols: list[str], last: tuple | None) -> np.ndarray:
    """True where a new group begins, given the group the batch before ended in."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    for c in cols:
        col = batch.column(c)
        a, b = col.slice(1), col.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    new[0] = last != _key(batch, cols, 0)
    return new


def _key(batch: pa.RecordBatch, cols: list[str], i: int) -> tuple:
    return tuple(batch.column(c)[i].as_py() for c in cols)


def fold(
    commands: DataFrame,
    machine: Machine = TASKS,
    keys: Sequence[str] = ("slug",),
    order: Sequence[str] = ("ts", "seq"),
    cmd: str = "cmd",
    expected: str | None = None,
    start: DataFrame | None = None,
    chunks: int | None = None,
) -> DataFrame:
    """Apply each key's commands in order; adds ``from_status``, ``to_status`` and ``outcome`` to every row.

    ``outcome`` is ``ok``, ``invalid_transition``, ``not_found`` (key not created yet) or ``conflict`` (the
    column ``expected`` names a status other than the current one). Rejected commands change nothing.
    ``start`` may give a state per key (column ``status``) to continue from.

    Rows stream through sorted partitions, so no group is held in memory. A key that crosses the borders of
    range partitions is cut into chunks: each chunk is first reduced to the function it computes from any
    start state, the functions are composed in order, and then every chunk is replayed from its own start
    state in parallel. The commands are stored in the shared checkpoint folder.

    Start states travel as marker rows ahead of the commands they belong to and are not joined. A join on
    the same keys would let the planner drop the repartitioning that follows it, and adaptive execution
    could then read the join's shuffle in another grouping, which a Python operator cannot forbid.
    """
    keys, order = list(keys), list(order)
    kept = commands.columns
    n_states = len(machine.states)
    initial = list(machine.states).index(machine.initial)
    codes_ = {
        "_code": machine.code(F.col(cmd)), "_want": machine.state_code(F.col(expected)) if expected else F.lit(-1),
    }
    coded, split_keys = O.in_chunks(commands.withColumns(codes_), keys, order, chunks)
    part = [*keys, "_chunk"]

    def reduce_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, last, open_ = machine.steps(), None, None  # open_: (key, composition) of the chunk that may go on
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _starts(batch, part, last)
            codes, wants = (batch.column(c).to_numpy() for c in ("_code", "_want"))
            done = prefixes(steps[codes, wants + 2], new, open_[1] if open_ else np.arange(n_states))
            ends = np.append(np.flatnonzero(new[1:]), n - 1)
            if open_ and new[0]:
                yield out(*open_)
            if len(ends) > 1:
                yield out(batch.select(part).take(pa.array(ends[:-1])), done[ends[:-1]])
            last, open_ = _key(batch, part, n - 1), (batch.select(part).slice(n - 1, 1), done[-1])
        if open_:
            yield out(*open_)

    def out(keys_: pa.RecordBatch, functions: np.ndarray) -> pa.RecordBatch:
        fns = pa.array(list(functions.reshape(-1, n_states).astype(np.int32)), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*keys_.columns, fns], [*part, "_fn"])

    def chain_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, initial
        for batch in batches:
            if not batch.num_rows:
                continue
            new, begun = _starts(batch, keys, last).tolist(), []
            fns, marks = batch.column("_fn").to_pylist(), batch.column("_begin").to_pylist()
            for i, fn in enumerate(fns):
                if new[i]:
                    state = initial
                if fn is None:
                    state = marks[i]
                begun.append(state)
                if fn is not None:
                    state = fn[state]
            last = _key(batch, keys, batch.num_rows - 1)
            out = pa.RecordBatch.from_arrays([*batch.select(part).columns, pa.array(begun, pa.int32())], [*part, "_begin"])
            yield out.filter(pc.is_valid(batch.column("_fn")))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, carry = None, initial, None
        cols = [*kept, "_chunk"]
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _starts(batch, part, last)
            codes, wants, marks = (batch.column(c).to_numpy() for c in ("_code", "_want", "_begin"))
            firsts = np.where(codes == MARKER, marks, initial)[new]  # a marker stands ahead of its chunk
            starts = np.concatenate([[state], firsts])[np.cumsum(new)]
            before, after, done = walk(machine, codes, wants, new, starts, carry)
            last, state, carry = _key(batch, part, batch.num_rows - 1), starts[-1], done[-1]
            arrays = [*batch.select(cols).columns, pa.array(before, pa.int32()), pa.array(after, pa.int32())]
            rows = pa.RecordBatch.from_arrays(arrays, [*cols, "_before", "_after"])
            yield rows.filter(pc.not_equal(batch.column("_code"), MARKER))

    def schema(*cols: str) -> str:
        types = {f.name: f.dataType.simpleString() for f in coded.schema}
        return ", ".join(f"`{c}` {types[c]}" for c in cols)

    hot = coded.filter("_chunk > 0").select(*part, *[o for o in order if o not in part], "_code", "_want")
    functions = (
        hot.repartition(*part)
        .sortWithinPartitions(*part, *order)
        .mapInArrow(reduce_chunks, f"{schema(*part)}, _fn array<int>")
        .withColumn("_begin", F.lit(-1))
    )
    firsts = None
    if start is not None:
        firsts = start.select(
            *keys, F.lit(0).cast("long").alias("_chunk"), machine.state_code(F.col("status")).alias("_begin")
        )
        names = [f"_k{i}" for i in range(len(keys))]
        split_keys = split_keys.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
        of_hot = firsts.join(F.broadcast(split_keys), O.same_keys(keys, names), "left_semi")
        functions = functions.unionByName(of_hot.withColumn("_fn", F.lit(None).cast("array<int>")))
    begins = (
        functions.repartition(*keys)
        .sortWithinPartitions(*part)
        .mapInArrow(chain_chunks, f"{schema(*part)}, _begin int")
    )
    if firsts is not None:
        begins = begins.unionByName(firsts)
    markers = begins.withColumns({"_code": F.lit(MARKER), "_want": F.lit(-1), "_mark": F.lit(0)})
    rows = coded.withColumns({"_begin": F.lit(-1), "_mark": F.lit(1)})
    replayed = (
        rows.unionByName(markers, allowMissingColumns=True)
        .repartition(*part)
        .sortWithinPartitions(*part, "_mark", *order)
        .mapInArrow(replay, f"{schema(*kept, '_chunk')}, _before int, _after int")
    )
    ok = F.col("_after") >= 0
    was = machine.state_name(F.col("_before"))
    outcome = (
        F.when(ok, "ok")
        .when(F.col("_after") == -2, "conflict")
        .when(was == ABSENT, "not_found")
        .otherwise("invalid_transition")
    )
    to = machine.state_name(F.when(ok, F.col("_after")).otherwise(F.col("_before")))
    return replayed.select(*kept, was.alias("from_status"), to.alias("to_status"), outcome.alias("outcome"))


def task_states(folded: DataFrame, initial: str = "planning") -> DataFrame:
    """Current row per task from folded commands; one map-side aggregation, no ordering of groups.

    Optional columns ``by_agent``, ``run``, ``reason`` and ``summary`` are used when present. A claim sets
    agent, branch ``agent/<run>`` and claim time, a release clears them, unblocking clears the reason.
    """
    have = set(folded.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    ok, at = F.col("outcome") == "ok", F.struct("ts", "seq")
    cmd = F.col("cmd")
    owned = ok & cmd.isin("claim", "release")
    claimed = lambda v: F.when(cmd == "claim", v)
    run = text("run") if "run" in have else text("by_agent")
    reasoned = ok & cmd.isin("fail", "block", "unblock")
    latest = lambda v, when, name: F.max_by(v, F.when(when, at)).alias(name)
    states = folded.groupBy("slug").agg(
        latest(F.col("to_status"), ok, "status"),
        F.max(F.when(ok, F.col("ts"))).alias("updated_at"),
        latest(claimed(F.col("ts")), owned, "claimed_at"),
        latest(claimed(text("by_agent")), owned, "agent"),
        latest(claimed(F.concat(F.lit("agent/"), run)), owned, "branch"),
        latest(F.when(cmd != "unblock", text("reason")), reasoned, "reason"),
        latest(text("summary"), ok & (cmd == "complete"), "summary"),
        F.coalesce(F.bool_or(ok & (cmd == "request_abort")), F.lit(False)).alias("abort_requested"),
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("rejected"),
    )
    return states.withColumn("status", F.coalesce("status", F.lit(initial)))


def arbitrate_claims(
    requests: DataFrame, tasks: DataFrame, deps: DataFrame | None = None, enforce_deps: bool = True
) -> DataFrame:
    """Outcome of every claim request (``slug, ts, seq, agent``) against the current tasks.

    The earliest request on a queued task wins, the others are ``conflict``; a task in another state (or,
    with ``enforce_deps``, one with unfinished dependencies) gives ``invalid_transition``. The winner is a
    map-side minimum, so thousands of agents racing for one task need no ordering of that group.
    """
    from coord.operators.tasks import unmet_counts

    state = tasks.select("slug", "status")
    claimable = F.col("status") == "queued"
    if deps is not None and enforce_deps:
        state = state.join(unmet_counts(tasks, deps), "slug", "left")
        claimable = claimable & (F.coalesce("unmet", F.lit(0)) == 0)
    state = state.select("slug", "status", claimable.alias("claimable"))
    first = requests.groupBy("slug").agg(F.min(F.struct("ts", "seq")).alias("first"))
    judged = requests.join(state.join(first, "slug"), "slug", "left")
    outcome = (
        F.when(F.col("claimable").isNull(), "not_found")
        .when(~F.col("claimable"), "invalid_transition")
        .when(F.struct("ts", "seq") == F.col("first"), "ok")
        .otherwise("conflict")
    )
    return judged.select(*requests.columns, outcome.alias("outcome"))


def guard_updates(updates: DataFrame, current: DataFrame) -> DataFrame:
    """Optimistic lock for a batch of writes (``slug, ts, seq, expected_status, expected_updated_at``).

    A write whose expectation differs from the current row is a ``conflict``. The earliest write that passes
    moves the version, so later guarded ones conflict too. A write without expectations cannot be stale.
    """
    row = current.select("slug", F.col("status").alias("_s"), F.col("updated_at").alias("_u"))
    seen = updates.join(row, "slug", "left")
    matches = lambda want, have: want.isNull() | (want == F.col(have))
    fresh = matches(F.col("expected_status"), "_s") & matches(F.col("expected_updated_at"), "_u")
    seen = seen.withColumn("_fresh", F.coalesce(fresh & F.col("_s").isNotNull(), F.lit(False)))
    winner = seen.filter("_fresh").groupBy("slug").agg(F.min(F.struct("ts", "seq")).alias("_first"))
    outcome = (
        F.when(F.col("_s").isNull(), "not_found")
        .when(F.col("expected_status").isNull() & F.col("expected_updated_at").isNull(), "ok")
        .when(F.col("_fresh") & (F.struct("ts", "seq") == F.col("_first")), "ok")
        .otherwise("conflict")
    )
    return seen.join(winner, "slug", "left").select(*updates.columns, outcome.alias("outcome"))


def time_in_status(
    changes: DataFrame, as_of: Column, chunks: int | None = None
) -> DataFrame:
    """Dwell time of each accepted status change (``slug, ts, seq, to_status``); the last runs to ``as_of``."""
    nxt = O.over_order(changes, ["slug"], ["ts", "seq"], O.lead("next_ts", F.col("ts")), chunks=chunks)
    until = F.coalesce("next_ts", as_of)
    return nxt.select(
        "slug", "seq", F.col("to_status").alias("status"), F.col("ts").alias("entered_at"),
        F.col("next_ts").alias("left_at"),
        F.timestamp_diff("SECOND", F.col("ts"), until).alias("dwell_s"),
    )


def run_durations(changes: DataFrame) -> DataFrame:
    """Seconds from the first start of work to the terminal change, per finished task."""
    ends = changes.groupBy("slug").agg(
        F.min(F.when(F.col("to_status") == "in_progress", F.col("ts"))).alias("started_at"),
        F.min(F.when(is_terminal(F.col("to_status")), F.col("ts"))).alias("finished_at"),
    )
    return ends.filter("started_at IS NOT NULL AND finished_at IS NOT NULL").select(
        "slug", "started_at", "finished_at",
        F.timestamp_diff("SECOND", F.col("started_at"), F.col("finished_at")).alias("duration_s"),
    )


def validate_history(
    changes: DataFrame, machine: Machine = TASKS, chunks: int | None = None
) -> DataFrame:
    """Check recorded changes (``slug, ts, seq, from_status, to_status``): continuous, and each one legal."""
    legal_pairs = sorted({(s, t) for (s, _), t in machine.transitions.items()})
    pair = F.concat_ws(">", F.col("from_status"), F.col("to_status"))
    legal = pair.isin([f"{s}>{t}" for s, t in legal_pairs])
    prev = O.over_order(
        changes, ["slug"], ["ts", "seq"], O.lag("previous", F.col("to_status")), chunks=chunks
    )
    continuous = F.coalesce(F.col("previous"), F.lit(machine.initial)) == F.col("from_status")
    return prev.select(
        "slug", "seq", "from_status", "to_status", continuous.alias("continuous"), legal.alias("legal")
    )


def split_board(
    tasks: DataFrame, as_of: Column, limit: int | None = 10, hours: int | None = None, board: str = "board"
) -> DataFrame:
    """Board rows with ``section`` active or recently_finished; older finished rows leave the board.

    ``limit`` keeps the newest N finished rows per board, ``hours`` those of the last H hours; the limit
    wins when both are given. Ties in finish time go to the smaller slug.
    """
    done = is_terminal(F.col("status"))
    active = tasks.filter(~done).withColumn("section", F.lit("active"))
    finished = tasks.filter(done)
    if limit is not None:
        finished = O.top_per_key(finished, [board], [F.col("updated_at").desc(), F.col("slug")], limit).drop("rank")
    elif hours is not None:
        finished = finished.filter(F.col("updated_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    return active.unionByName(finished.withColumn("section", F.lit("recently_finished")))
