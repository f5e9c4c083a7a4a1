"""State per key in the engine's own store: live task state, decision timeouts, runner status."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from coord.functions import text as X
from coord.operators import history
from coord.streaming.io import run_folder

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_store(spark: SparkSession):
    """Queries started here keep their state in the store for single keys, of which a checkpoint writes only what changed."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def packed(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """One row per key and Arrow batch, with a list of each column: a hot key reaches its state as a few rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.Table.from_batches([batch]).group_by(key, use_threads=False).aggregate([(c, "list") for c in columns])
            yield from lists.select([key, *[f"{c}_list" for c in columns]]).rename_columns([key, *columns]).to_batches()

    kinds = ", ".join(f"`{c}` array<{kind}>" for c, kind in columns.items())
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, {kinds}")


class _TaskFold(StatefulProcessor):
    """Status of a task and the time of its last command; answers every command."""

    def __init__(self, machine: history.Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.task = handle.getValueState("task", "state int, ts long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lists = pd.concat(list(rows), ignore_index=True)
        ts, seq, code, want = (np.concatenate([np.asarray(x, np.int64) for x in lists[c]]) for c in ("ts", "seq", "code", "want"))
        cmd = np.concatenate([np.asarray(x, object) for x in lists["cmd"]])
        order = np.lexsort((seq, ts))
        ts, seq, code, want, cmd = ts[order], seq[order], code[order], want[order], cmd[order]
        state, last = list(self.machine.states).index(self.machine.initial), None
        late = np.zeros(len(ts), bool)
        if self.task.exists():
            state, *last = self.task.get()
            late = (ts < last[0]) | ((ts == last[0]) & (seq <= last[1]))
        before, after = np.full(len(ts), state), np.full(len(ts), -1)
        on = np.flatnonzero(~late)
        if len(on):
            new = np.zeros(len(on), bool)
            new[0] = True
            before[on], after[on], done = history.walk(self.machine, code[on], want[on], new, np.full(len(on), state))
            self.task.update((int(done[-1][state]), int(ts[on[-1]]), int(seq[on[-1]])))
        yield pd.DataFrame({"slug": [key[0]], "ts": [ts], "seq": [seq], "cmd": [cmd], "before": [before.astype(np.int32)], "after": [after.astype(np.int32)]})

    def close(self) -> None:
        pass


def task_outcomes(commands: DataFrame, machine: history.Machine = history.TASKS, expected: str | None = None) -> DataFrame:
    """Stream of ``slug, ts, seq, cmd, from_status, to_status, outcome`` for a stream of commands.

    A task's commands of a micro-batch arrive as lists, are put in order and folded at once from the stored
    state; so a batch costs what it holds, whatever the state holds. A command not later than the last one
    applied to its task by a batch before is answered ``invalid_transition`` and changes nothing; the column
    ``expected`` may name a status to guard by. The lists of one task and batch are in memory together:
    bound the batches (files or offsets per trigger), not the tasks.
    """
    kind = commands.schema["ts"].dataType
    rows = commands.select(
        "slug", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("seq").cast("long").alias("seq"), "cmd",
        machine.code(F.col("cmd")).cast("long").alias("code"), (machine.state_code(F.col(expected)) if expected else F.lit(-1)).cast("long").alias("want"),
    )
    columns = {"ts": "bigint", "seq": "bigint", "cmd": "string", "code": "bigint", "want": "bigint"}
    folded = packed(rows, "slug", columns).groupBy("slug").transformWithStateInPandas(
        statefulProcessor=_TaskFold(machine), outputStructType="slug string, ts array<long>, seq array<long>, cmd array<string>, before array<int>, after array<int>",
        outputMode="append", timeMode="none",
    )
    one = folded.select("slug", F.explode(F.arrays_zip("ts", "seq", "cmd", "before", "after")).alias("r")).select("slug", "r.*")
    ok, was = F.col("after") >= 0, machine.state_name(F.col("before"))
    outcome = F.when(ok, "ok").when(F.col("after") == -2, "conflict").when(was == history.ABSENT, "not_found").otherwise("invalid_transition")
    return one.select(
        "slug", F.timestamp_micros("ts").cast(kind).alias("ts"), "seq", "cmd", was.alias("from_status"),
        machine.state_name(F.when(ok, F.col("after")).otherwise(F.col("before"))).alias("to_status"), outcome.alias("outcome"),
    )


class LiveTaskState:
    """Task state kept up to date from a command stream; ``folder`` holds the answers and the engine's checkpoint.

    Another object on the same folder goes on where the last run ended, and reads the state without new commands.
    """

    def __init__(self, folder: str, machine: history.Machine = history.TASKS):
        self.folder, self.machine = folder, machine

    def run(self, commands: DataFrame, expected: str | None = None) -> None:
        """Process what the stream holds now."""
        with keyed_store(commands.sparkSession):
            query = (
                task_outcomes(commands, self.machine, expected).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
                .option("path", f"{self.folder}/outcomes").option("checkpointLocation", f"{self.folder}/progress").start()
            )
            query.awaitTermination()

    def outcomes(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/outcomes")

    def current(self, spark: SparkSession) -> DataFrame:
        """(slug, status, last_ts, last_seq) from the state store."""
        rows = spark.read.format("statestore").option("stateVarName", "task").load(f"{self.folder}/progress")
        return rows.select(
            "key.slug", self.machine.state_name(F.col("value.state")).alias("status"), F.timestamp_micros("value.ts").alias("last_ts"), F.col("value.seq").alias("last_seq"),
        )


def stream_task_state(commands: DataFrame, folder: str | None = None, **options) -> LiveTaskState:
    """Run a command stream to its end; read the result from the returned state."""
    live = LiveTaskState(folder or run_folder(commands.sparkSession, "task-state"), **options)
    live.run(commands)
    return live


class _Held:
    """An open decision with the earliest answers of its first people, or the mark of a closed one."""

    __slots__ = ("needed", "due", "closed", "end", "here")

    def __init__(self, needed: int | None = None, due: int | None = None, closed: bool = False, end: int | None = None, who=(), ms=()):
        self.needed, self.due, self.closed, self.end, self.here = needed, due, closed, end, dict(zip(who, ms))

    def stored(self) -> tuple:
        return self.needed, self.due, self.closed, self.end, list(self.here), list(self.here.values())

    def take(self, new: dict[str, int], far: dict[str, int], near: int) -> tuple[tuple | None, list[tuple[str, int]]]:
        """Add a batch's earliest answers per person: what it completes, and the answers for the list of further people."""
        more = []
        for person, at in new.items():
            if person not in far and (person in self.here or len(self.here) < near):
                self.here[person] = min(at, self.here.get(person, at))
            elif person not in far or at < far[person]:
                far[person] = at
                more.append((person, at))
        times = sorted([*self.here.values(), *far.values()])
        needed, due = self.needed, self.due
        if needed is not None and len(times) >= needed and (due is None or times[needed - 1] <= due):
            self.closed, self.here = True, {}
            return ("completed", times[needed - 1], needed), []
        return None, more

    def failed(self, far: dict[str, int]) -> tuple | None:
        """What the end of its time makes of it."""
        if self.closed or self.due is None:
            return None
        return "failed", self.due, sum(t <= self.due for t in [*self.here.values(), *far.values()])

    def until(self, latest: int, mark: int, keep_ms: int) -> int:
        return max(latest, mark) + keep_ms if self.closed or self.due is None else max(self.due, mark + 1)


class _Decision(StatefulProcessor):
    """Earliest answer per person of an open decision; a mark for a closed one. Every state has a timer that ends it.

    Every call to the store is a round trip, so a batch reads a decision's state once and writes it once: the answers
    of the first ``near`` people lie with the request, only those of more people in a list of their own.
    """

    def __init__(self, keep_ms: int, near: int = 100):
        self.keep_ms, self.near = keep_ms, near

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "needed long, due long, closed boolean, end long, who array<string>, ms array<long>")
        self.answers = handle.getListState("answers", "who string, ms long")

    def _far(self, here: dict[str, int]) -> dict[str, int]:
        """Earliest answer per person of the list; one of them may be listed again with an earlier one."""
        people: dict[str, int] = {}
        if len(here) >= self.near:
            for who, ms in self.answers.get():
                people[who] = min(ms, people.get(who, ms))
        return people

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = _Held(*(self.asked.get() or ()))
        listed, latest, mark, new = len(held.here) >= self.near, 0, timerValues.getCurrentWatermarkInMs(), {}
        for row in rows:
            latest = max(latest, row.ms)
            if held.closed:
                continue
            if row.who == "":
                held.needed, held.due = row.needed, None if row.timeout_s is None else row.ms + row.timeout_s * 1000
            else:
                new[row.who] = min(row.ms, new.get(row.who, row.ms))
        if not held.closed:
            done, more = held.take(new, self._far(held.here), self.near)
            if done:
                yield Row(decision=key[0], status=done[0], at_ms=done[1], responses=done[2])
                if listed:
                    self.answers.clear()
            elif more:
                self.answers.appendList(more)
        until = held.until(latest, mark, self.keep_ms)
        if until != held.end:
            if held.end is not None:
                self.handle.deleteTimer(held.end)
            self.handle.registerTimer(until)
        held.end = until
        self.asked.update(held.stored())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = _Held(*(self.asked.get() or (None, None, True)))
        failed = held.failed(self._far(held.here))
        if failed:
            yield Row(decision=key[0], status=failed[0], at_ms=failed[1], responses=failed[2])
        if len(held.here) >= self.near:
            self.answers.clear()
        self.asked.clear()

    def close(self) -> None:
        pass


class _DecisionGroup(StatefulProcessor):
    """The same for many decisions under one key: a batch reads and writes the state of all of them in a few calls.

    One timer stands at the first end among them; when it fires, all that has ended is dropped.
    """

    def __init__(self, keep_ms: int, near: int = 100):
        self.keep_ms, self.near = keep_ms, near

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kinds = {"decision": "string", "needed": "long", "due": "long", "closed": "boolean", "end": "long", "who": "array<string>", "ms": "array<long>"}
        self.asked = handle.getValueState("asked", ", ".join(f"{c} array<{kind}>" for c, kind in kinds.items()))
        self.answers = handle.getListState("answers", "decision string, who string, ms long")

    def _read(self) -> tuple[dict[str, _Held], int | None]:
        lists = self.asked.get()
        held = {row[0]: _Held(*row[1:]) for row in zip(*lists)} if lists else {}
        return held, min((h.end for h in held.values()), default=None)

    def _far(self, held: dict[str, _Held], some) -> dict[str, dict[str, int]]:
        """Earliest answer per further person of each decision that has such."""
        people: dict[str, dict[str, int]] = {}
        if any(d in held and len(held[d].here) >= self.near for d in some):
            for d, who, ms in self.answers.get():
                people.setdefault(d, {})
                people[d][who] = min(ms, people[d].get(who, ms))
        return people

    def _write(self, held: dict[str, _Held], wake: int | None, far: dict[str, dict[str, int]], gone: list[str]) -> None:
        if any(d in far for d in gone):
            self.answers.put([(d, *one) for d, people in far.items() if d not in gone for one in people.items()]) if far.keys() - set(gone) else self.answers.clear()
        if held:
            self.asked.update(tuple(map(list, zip(*((d, *h.stored()) for d, h in held.items())))))
        else:
            self.asked.clear()
        first = min((h.end for h in held.values()), default=None)
        if first != wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            if first is not None:
                self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, wake = self._read()
        mark, latest, new = timerValues.getCurrentWatermarkInMs(), {}, {}
        whole = lambda x: None if pd.isna(x) else int(x)
        for pdf in rows:
            for d, ms, who, needed, timeout in zip(*(pdf[c].tolist() for c in ("decision", "ms", "who", "needed", "timeout_s"))):
                if d not in latest:
                    latest[d], new[d] = ms, {}
                    held.setdefault(d, _Held())
                latest[d] = max(latest[d], ms)
                if who == "":
                    if not held[d].closed:
                        held[d].needed, held[d].due = whole(needed), None if pd.isna(timeout) else ms + int(timeout) * 1000
                else:
                    new[d][who] = min(ms, new[d].get(who, ms))
        far, out, gone, more = self._far(held, latest), [], [], []
        for d, last in latest.items():
            if not held[d].closed:
                done, further = held[d].take(new[d], far.get(d, {}), self.near)
                if done:
                    out.append((d, *done))
                    gone.append(d)
                more += [(d, *one) for one in further]
            held[d].end = held[d].until(last, mark, self.keep_ms)
        self._write(held, wake, far, gone)
        if more:
            self.answers.appendList(more)
        if out:
            yield pd.DataFrame(out, columns=["decision", "status", "at_ms", "responses"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, wake = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        ended = [d for d, h in held.items() if h.end <= now]
        far, out = self._far(held, ended), []
        for d in ended:
            failed = held.pop(d).failed(far.get(d, {}))
            if failed:
                out.append((d, *failed))
        self._write(held, None, far, ended)  # the engine removes the timer that fired
        if out:
            yield pd.DataFrame(out, columns=["decision", "status", "at_ms", "responses"])

    def close(self) -> None:
        pass


def decision_timeouts(events: DataFrame, assigned: DataFrame | None = None, keep_days: int = 365, groups: int | None = None) -> DataFrame:
    """Decisions resolved or, at their timeout, failed, from one stream of requests and responses.

    ``events``: ``decision, ts, who`` (null on the request), ``needed, timeout_s`` (set on the request, the
    timeout may be null). Of several responses of one person the earliest counts. ``assigned`` (a table:
    ``decision, who``) drops responses of other people. A timer at the due time fails what is still open.

    State of a decision: the answers of its people while it is open, nothing but a mark once it is completed.
    Every state has a timer: the due time; ``keep_days`` after its latest event where there is no request (yet,
    or any more), no due time, or the decision is completed. When it fires the state is gone.

    Every call to the store is a round trip, some ten for a decision. ``groups`` is for large batches: the decisions are
    dealt by hash over so many keys, and the state of all decisions of a key is read and written at once. A batch then
    costs the decisions held under the keys it meets, so small batches over many open decisions go without it.
    """
    identity = X.stakeholder(F.col("who"))["identity"]
    named = events.withColumn("who", F.coalesce(identity, F.lit("")))
    if assigned is not None:
        people = assigned.select("decision", identity.alias("who"))
        people = people.unionByName(people.select("decision", F.lit("").alias("who"))).distinct()
        named = named.join(people, ["decision", "who"], "left_semi")
    rows = named.where("ts IS NOT NULL").select("decision", "ts", F.unix_millis("ts").alias("ms"), "who", F.col("needed").cast("long"), F.col("timeout_s").cast("long"))
    how = {"outputStructType": "decision string, status string, at_ms long, responses int", "outputMode": "append", "timeMode": "eventTime"}
    if groups is None:
        out = rows.groupBy("decision").transformWithState(statefulProcessor=_Decision(keep_days * 86_400_000), **how)
    else:
        dealt = rows.withColumn("group", F.pmod(F.xxhash64("decision"), F.lit(groups)))
        out = dealt.groupBy("group").transformWithStateInPandas(statefulProcessor=_DecisionGroup(keep_days * 86_400_000), **how)
    return out.select("decision", "status", F.timestamp_millis("at_ms").alias("at"), "responses")


class _Runner(StatefulProcessor):
    """Status of a runner host and its open sessions, moved in event time.

    Every call to the store is a round trip, so events wait as lists, one per Arrow batch that brought them, and one
    timer stands at the next moment something is due. When it fires, all that is due is applied at once.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.host = handle.getValueState("host", "status string, beat long")
        self.sessions = handle.getMapState("sessions", "session string", "since long")
        self.waiting = handle.getListState("waiting", "ms array<long>, seq array<long>, kind array<string>, session array<string>")
        self.wake = handle.getValueState("wake", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lists, first = [], None
        for pdf in rows:
            if len(pdf):
                lists.append(tuple(pdf[c].tolist() for c in ("ms", "seq", "kind", "session")))
                lo = min(lists[-1][0])
                first = lo if first is None else min(first, lo)
        if lists:
            self.waiting.appendList(lists)
            wake = self.wake.get()
            if wake is None or first < wake[0]:
                if wake is not None:
                    self.handle.deleteTimer(wake[0])
                self.handle.registerTimer(first)
                self.wake.update((first,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        events = [e for lists in self.waiting.get() for e in zip(*lists)]
        due = sorted({e for e in events if e[0] <= now})
        later = [e for e in events if e[0] > now]
        status, beat = self.host.get() or ("registered", None)
        before = {k[0]: v[0] for k, v in self.sessions.iterator()}
        opened = dict(before)
        out: list[tuple] = []

        def move(ms: int, to: str, cause: str) -> None:
            nonlocal status
            if to != status:
                out.append((key[0], ms, status, to, cause))
                status = to

        def time_passes(until: int) -> None:
            if status == "online" and beat is not None and beat + self.timeout_ms <= until:
                move(beat + self.timeout_ms, "offline", "timeout")

        for ms, _, kind, session in due:
            time_passes(ms - 1)  # a heartbeat at the very end of the time counts
            if kind == "heartbeat":
                if status in ("registered", "online", "offline"):
                    move(ms, "online", "heartbeat")
                    beat = ms
            elif kind == "session_opened":
                opened[session] = ms
            elif kind == "session_closed":
                opened.pop(session, None)
            elif kind == "drain" and status == "online":
                move(ms, "draining", "drain")
            elif kind == "deregister" and status in ("online", "offline"):
                move(ms, "deregistered", "deregister")
                status, beat = "registered", None
                opened.clear()
            if status == "draining" and not opened:
                move(ms, "offline", "sessions_closed")
        time_passes(now - 1)
        self._keep(status, beat, before, opened, later if due else None)
        wakes = [min(e[0] for e in later)] if later else []
        if status == "online":
            wakes.append(beat + self.timeout_ms + 1)
        if wakes:
            self.handle.registerTimer(min(wakes))
            self.wake.update((min(wakes),))
        else:
            self.wake.clear()
        yield pd.DataFrame(out, columns=["runner", "at_ms", "from_status", "to_status", "cause"])

    def _keep(self, status: str, beat: int | None, before: dict[str, int], opened: dict[str, int], later: list[tuple] | None) -> None:
        """Write what changed; ``later`` is None where no event was due."""
        if status == "registered":
            self.host.clear()
        else:
            self.host.update((status, beat))
        for session in before.keys() - opened.keys():
            self.sessions.removeKey((session,))
        for session, since in opened.items():
            if before.get(session) != since:
                self.sessions.updateValue((session,), (since,))
        if later:
            self.waiting.put([tuple(map(list, zip(*later[k:k + 10_000]))) for k in range(0, len(later), 10_000)])
        elif later is not None:
            self.waiting.clear()

    def close(self) -> None:
        pass


def runner_status(events: DataFrame, timeout_s: int = 120) -> DataFrame:
    """Status changes of runner hosts (``runner, at, from_status, to_status, cause``) from one stream of host and session events.

    ``events``: ``runner, ts, seq, kind, session``; kinds ``heartbeat``, ``drain``, ``deregister``,
    ``session_opened``, ``session_closed``. A host is online from its first heartbeat, offline ``timeout_s``
    after the last one, draining from ``drain`` until its last session closes (at once without any), and online
    again by a heartbeat when offline. Heartbeats of a draining host keep it draining.

    Events wait for the watermark and are applied in the order of their times (then ``seq``), whatever batch
    brought them, so the changes are those of the whole log. State of a host: its status, its open sessions and
    the events not yet due; a deregistered host leaves none
    (a later heartbeat registers it anew).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(2**63 - 1)).alias("seq")
    rows = events.where("ts IS NOT NULL").select("runner", "ts", F.unix_millis("ts").alias("ms"), seq, text("kind"), text("session"))
    out = rows.groupBy("runner").transformWithStateInPandas(
        statefulProcessor=_Runner(timeout_s * 1000), outputStructType="runner string, at_ms long, from_status string, to_status string, cause string",
        outputMode="append", timeMode="eventTime",
    )
    return out.select("runner", F.timestamp_millis("at_ms").alias("at"), "from_status", "to_status", "cause")
