"""Streams fed in several micro-batches against the batch operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coord.operators import history
from coord.plans.registry import QUERIES  # noqa: F401
from coord.sources.standins import standin
from coord.streaming import messages, state, windows
from coord.streaming.io import event_time, open_stream, run_available, run_folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def feed(spark, df, parts=3, column="ts"):
    """Store a table as consecutive files in time order and open it one file per batch."""
    folder = run_folder(spark, "feed")
    cuts = [r[0] for r in df.select(F.percentile(F.unix_micros(F.col(column).cast("timestamp")), [i / parts for i in range(1, parts)])).collect()][0]
    t = F.unix_micros(F.col(column).cast("timestamp"))
    lo = None
    for hi in [*(cuts or []), None]:
        piece = df if lo is None else df.filter(t > lo)
        piece = piece if hi is None else piece.filter(t <= hi)
        piece.coalesce(1).write.mode("append").parquet(folder)
        lo = hi
    return open_stream(spark, folder, files_per_trigger=1)


@pytest.mark.parametrize("parts", [1, 4])
def test_live_task_state_equals_fold(spark, sf, parts):
    commands = standin(spark, sf, "task_commands").select("slug", "seq", "ts", "cmd")
    live = state.stream_task_state(feed(spark, commands, parts))
    want = history.fold(commands)
    keep = ["slug", "seq", "from_status", "to_status", "outcome"]
    assert rows(live.outcomes(spark).select(*keep)) == rows(want.select(*keep))
    final = want.groupBy("slug").agg(F.max_by("to_status", F.struct("ts", "seq")).alias("status"))
    assert rows(live.current(spark).select("slug", "status")) == rows(final)


def test_live_task_state_goes_on_after_a_restart(spark):
    folder, live = run_folder(spark, "restart"), run_folder(spark, "live")
    cmds = [("t", k, f"2024-01-01 00:0{k}:00", c, g) for k, (c, g) in enumerate([("enqueue", None), ("claim", "queued"), ("claim", "queued"), ("start", None)])]
    df = spark.createDataFrame(cmds, "slug string, seq int, ts string, cmd string, guard string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for k in range(4):
        df.where(f"seq = {k}").coalesce(1).write.mode("append").parquet(folder)
        state.LiveTaskState(live).run(open_stream(spark, folder), expected="guard")
    again = state.LiveTaskState(live)
    assert rows(again.current(spark).select("slug", "status", "last_seq")) == [("t", "in_progress", 3)]
    again.run(open_stream(spark, folder), expected="guard")  # nothing new
    assert [r.outcome for r in again.outcomes(spark).orderBy("seq").collect()] == ["ok", "ok", "conflict", "ok"]


def test_prefixes_are_compositions():
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 100, 333):
        steps, new, carry = r.integers(0, 5, (n, 5)), r.random(n) < 0.2, r.integers(0, 5, 5)
        at, want = carry, []
        for step, first in zip(steps, new):
            at = step[np.arange(5) if first else at]
            want.append(at)
        assert (history.prefixes(steps, new, carry) == np.array(want)).all()


def test_late_command_is_refused(spark):
    cmds = [("t", 1, "2024-01-01 00:01:00", "enqueue"), ("t", 3, "2024-01-01 00:03:00", "claim"), ("t", 2, "2024-01-01 00:02:00", "claim"), ("t", 4, "2024-01-01 00:04:00", "start")]
    folder = run_folder(spark, "late")
    for c in (cmds[:2], cmds[2:]):
        df = spark.createDataFrame(c, "slug string, seq int, ts string, cmd string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(folder)
    live = state.stream_task_state(open_stream(spark, folder, files_per_trigger=1))
    got = {r["seq"]: (r["outcome"], r["to_status"]) for r in live.outcomes(spark).collect()}
    assert got == {1: ("ok", "queued"), 3: ("ok", "claimed"), 2: ("invalid_transition", "claimed"), 4: ("ok", "in_progress")}
    assert live.current(spark).first()["status"] == "in_progress"


def closed(df, end, ts, delay="1 HOUR"):
    mark = ts.agg(F.max(F.col("ts").cast("timestamp")) - F.expr(f"INTERVAL {delay}")).first()[0]
    return df.filter(F.col(end).cast("timestamp") <= F.lit(mark))


def test_sessions_and_alerts_equal_batch(spark, sf):
    requests = standin(spark, sf, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run_available(windows.idle_sessions(event_time(feed(spark, requests), "1 hour")), "s")
    assert rows(got) == rows(closed(windows.idle_sessions(requests), "end", requests))
    beats = standin(spark, sf, "heartbeats").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run_available(windows.liveness(event_time(feed(spark, beats), "1 hour"), timeout="6 hours"), "l")
    assert rows(got) == rows(closed(windows.liveness(beats, timeout="6 hours"), "offline_at", beats))
    got = run_available(windows.error_rate(event_time(feed(spark, requests), "1 hour"), [], "1 day", "6 hours"), "a")
    assert rows(got) == rows(closed(windows.error_rate(requests, [], "1 day", "6 hours"), "window_end", requests))


def test_dedup_across_batches(spark):
    df = spark.createDataFrame([(i % 7, f"2024-01-01 00:{i:02d}:00") for i in range(21)], "message_id int, t string").select("message_id", F.col("t").cast("timestamp").alias("ts"))
    got = run_available(messages.dedup_messages(event_time(feed(spark, df), "1 hour")), "d")
    assert got.count() == 7


def test_verdicts(spark):
    t = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    req = spark.createDataFrame(pd.DataFrame([(1, t(0)), (2, t(1)), (3, t(2)), (9, t(300))], columns=["request_id", "ts"]))
    ver = spark.createDataFrame(pd.DataFrame([(1, t(5), "allow"), (2, t(30), "deny"), (9, t(301), "allow"), (8, t(301), "deny")], columns=["request_id", "ts", "verdict"]))
    got = run_available(messages.match_verdicts(event_time(feed(spark, req, 2), "1 hour"), event_time(feed(spark, ver, 2), "1 hour")), "v")
    assert rows(got.select("request_id", "verdict")) == [(1, "allow"), (2, None), (3, None), (9, "allow")]


def test_payload_boundary(spark):
    ev = spark.createDataFrame([(1, "x", "a" * 499), (2, "x", "a" * 500), (3, "y", "b")], "event_id int, type string, content string")
    sub = spark.createDataFrame([("x", "r1"), ("x", "r2")], "type string, recipient string")
    got = messages.notifications(ev, sub)
    assert rows(got.select("event_id", "recipient", "delivery")) == [(1, "r1", "inline"), (1, "r2", "inline"), (2, "r1", "reference"), (2, "r2", "reference")]


def test_sustained(spark):
    w = [("e", "s", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)) for m in (0, 1, 2, 3, 10, 11)]
    df = spark.createDataFrame(pd.DataFrame(w, columns=["alert", "subject", "window_start"])).withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 5 MINUTES"))
    assert rows(windows.sustained(df, "1 minute", "8 minutes").select("windows")) == [(4,)]


def test_sustained_alerts_are_one_stream(spark, sf):
    requests = standin(spark, sf, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    rate = lambda df, **how: windows.error_rate(df, [], "6 hours", "1 hour", 0.2, **how)
    got = run_available(windows.sustained(rate(event_time(feed(spark, requests, 4), "1 hour"), staged=True), "1 hour", "9 hours"), "sus")
    want = windows.sustained(rate(requests), "1 hour", "9 hours").withColumn("shut", F.col("until") + F.expr("INTERVAL 1 HOUR"))
    assert got.count() > 3 and rows(got) == rows(closed(want, "shut", requests).drop("shut"))


def runner_log(events, timeout, mark):
    """Plain replay of (runner, second, seq, kind, session) up to a second."""
    out = []
    for runner in sorted({e[0] for e in events}):
        status, beat, open_ = "registered", None, set()
        def lapse(until):
            nonlocal status
            if status == "online" and beat + timeout < until:
                out.append((runner, beat + timeout, status, "offline", "timeout"))
                status = "offline"
        for _, t, _, kind, session in sorted(e for e in events if e[0] == runner and e[1] < mark):
            lapse(t)
            was = status
            if kind == "heartbeat" and status != "draining":
                status, beat = "online", t
            elif kind == "session_opened":
                open_.add(session)
            elif kind == "session_closed":
                open_.discard(session)
            elif kind == "drain" and status == "online":
                status = "draining"
            elif kind == "deregister" and status in ("online", "offline"):
                out.append((runner, t, status, "deregistered", kind))
                was = status = "registered"
                open_ = set()
            if status != was:
                out.append((runner, t, was, status, kind))
            if status == "draining" and not open_:
                out.append((runner, t, "draining", "offline", "sessions_closed"))
                status = "offline"
        lapse(mark)
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_runner_goes_offline_with_its_last_session(spark, parts):
    r = np.random.default_rng(parts)
    kinds = ["heartbeat", "heartbeat", "session_opened", "session_closed", "drain", "deregister"]
    events = [(f"h{r.integers(3)}", int(r.integers(0, 9000)), k, kinds[r.integers(6)], f"s{r.integers(2)}") for k in range(300)]
    events += [("drained", 10, 400, "heartbeat", None), ("drained", 20, 401, "session_opened", "a"), ("drained", 30, 402, "session_opened", "b"), ("drained", 40, 403, "drain", None),
               ("drained", 50, 404, "session_closed", "a"), ("drained", 5000, 405, "heartbeat", None), ("drained", 6000, 406, "session_closed", "b"), ("clock", 10_000, 407, "drain", None)]
    df = spark.createDataFrame(events, "runner string, s long, seq long, kind string, session string").withColumn("ts", F.timestamp_seconds("s"))
    with state.keyed_store(spark):
        got = run_available(state.runner_status(event_time(feed(spark, df, parts), "1 minute"), timeout_s=600), "runner")
    seen = sorted((x[0], int(x[1]), *x[2:]) for x in map(tuple, got.select("runner", F.unix_seconds("at"), "from_status", "to_status", "cause").collect()))
    assert seen == runner_log(events, 600, 9940)
    assert ("drained", 6000, "draining", "offline", "sessions_closed") in seen


def test_decision_state_is_freed(spark):
    t = lambda h: f"2024-01-01 00:00:00".replace("01 00", f"{1 + h // 24:02d} {h % 24:02d}")
    cmds = [
        ("a", t(0), None, 2, 36_000), ("a", t(1), "x", None, None), ("a", t(2), "x", None, None), ("a", t(3), "y", None, None), ("a", t(4), "z", None, None),
        ("b", t(0), None, 1, 3600), ("b", t(5), "x", None, None),  # after its timer
        ("c", t(1), "x", None, None),  # no request
        ("d", t(0), None, 3, None), ("d", t(2), "x", None, None),  # no timeout
        ("clock", t(24 * 9), None, 1, 3600),
    ]
    df = spark.createDataFrame(cmds, "decision string, ts string, who string, needed int, timeout_s long").withColumn("ts", F.col("ts").cast("timestamp"))
    folder, feed_ = run_folder(spark, "decisions"), run_folder(spark, "feed")
    for batch in (df.where("decision <> 'clock' and ts < '2024-01-01 04:30:00'"), df.where("ts = '2024-01-01 05:00:00'"), df.where("decision = 'clock'")):
        batch.coalesce(1).write.mode("append").parquet(feed_)
    with state.keyed_store(spark):
        out = state.decision_timeouts(event_time(open_stream(spark, feed_, 1), "1 hour"), keep_days=2)
        query = out.writeStream.format("parquet").trigger(availableNow=True).option("path", folder + "/out").option("checkpointLocation", folder + "/progress").start()
        query.awaitTermination()
    got = {(x.decision, x.status, x.responses) for x in spark.read.parquet(folder + "/out").collect()}
    assert got == {("a", "completed", 2), ("b", "failed", 0)}
    left = spark.read.format("statestore").option("stateVarName", "asked").load(folder + "/progress")
    assert [x[0] for x in left.select("key.decision").collect()] == ["clock"]
    assert spark.read.format("statestore").option("stateVarName", "answers").load(folder + "/progress").count() == 0


def test_many_events_of_a_runner_cost_one_timer(spark):
    """A host's events wait as lists: the store holds a row per batch of them and one timer, not one of each per event."""
    t0, n = 1_704_067_200, 2_000
    events = [("h", t0 + k, k, "heartbeat", None) for k in range(n)] + [("clock", t0 + 10, n, "drain", None)]
    df = spark.createDataFrame(events, "runner string, s long, seq long, kind string, session string").withColumn("ts", F.timestamp_seconds("s")).coalesce(1)
    folder, feed_ = run_folder(spark, "runners"), run_folder(spark, "feed")
    df.write.parquet(feed_)
    with state.keyed_store(spark):
        out = state.runner_status(event_time(open_stream(spark, feed_, 1), "1 hour"), timeout_s=600)
        out.writeStream.format("parquet").trigger(availableNow=True).option("path", folder + "/out").option("checkpointLocation", folder + "/progress").start().awaitTermination()
    held = lambda name: spark.read.format("statestore").option("stateVarName", name).load(folder + "/progress").where("key.runner = 'h'")
    assert held("wake").select("value.ms").collect() == [(t0 * 1000,)]
    assert held("waiting").count() == 1
    assert spark.read.parquet(folder + "/out").count() == 0


@pytest.mark.parametrize("near", [1, 2, 100])
def test_decision_with_more_people_than_lie_near(spark, near):
    t = lambda m: f"2024-01-01 00:{m:02d}:00"
    asks = [("done", t(0), None, 3, 3600), ("late", t(0), None, 5, 600), ("never", t(0), None, 2, None), ("clock", "2024-01-02 00:00:00", None, 1, 3600)]
    answers = [("done", t(4), "x"), ("done", t(3), "y"), ("late", t(1), "x"), ("late", t(2), "y"), ("late", t(8), "z"), ("late", t(30), "w"), ("never", t(1), "x")]
    second = [("done", t(2), "y"), ("done", t(6), "y"), ("done", t(9), "x"), ("late", t(5), "z"), ("late", t(9), "z"), ("late", t(9), "w")]
    third = [("done", t(20), "z"), ("done", t(1), "x")]
    kind, feed_ = "decision string, ts string, who string, needed int, timeout_s long", run_folder(spark, "feed")
    for batch in (asks[:3] + [(*a, None, None) for a in answers], [(*a, None, None) for a in second], [(*a, None, None) for a in third], asks[3:]):
        spark.createDataFrame(batch, kind).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(feed_)
    rows_ = event_time(open_stream(spark, feed_, 1), "1 hour").withColumn("who", F.coalesce("who", F.lit("")))
    rows_ = rows_.select("decision", "ts", F.unix_millis("ts").alias("ms"), "who", F.col("needed").cast("long"), "timeout_s")
    with state.keyed_store(spark):
        out = rows_.groupBy("decision").transformWithState(
            statefulProcessor=state._Decision(86_400_000, near), outputStructType="decision string, status string, at_ms long, responses int", outputMode="append", timeMode="eventTime",
        )
        got = run_available(out, "near")
    at = lambda m: 1_704_067_200_000 + m * 60_000
    assert rows(got) == sorted([("done", "completed", at(20), 3), ("late", "failed", at(10), 4)], key=repr)


@pytest.mark.parametrize("near", [1, 2, 100])
def test_decisions_of_a_group_equal_single_ones(spark, near):
    """Several batches, late and early answers, further people, decisions that end at different times under one key."""
    r, t0 = np.random.default_rng(near), 1_704_067_200
    kind, feed_ = "decision string, s long, who string, needed int, timeout_s long", run_folder(spark, "feed")
    asks = [(f"d{k}", t0 + 60 * k, None, int(r.integers(1, 5)), None if k % 4 == 0 else int(r.integers(0, 9)) * 600) for k in range(40)] + [(None, t0, None, 2, 3600)]
    answers = [(f"d{r.integers(45)}", t0 + int(r.integers(0, 9_000)), f"p{r.integers(5)}", None, None) for _ in range(400)] + [(None, t0 + 60, "x", None, None), (None, t0 + 90, "y", None, None)]
    for batch in (answers[:100], asks + answers[100:200], answers[200:], [("clock", t0 + 12_000, None, 1, 999_999)], [("clock", t0 + 700_000, "x", None, None)]):
        spark.createDataFrame(batch, kind).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(feed_)
    rows_ = event_time(open_stream(spark, feed_, 1), "1 hour").withColumn("who", F.coalesce("who", F.lit("")))
    rows_ = rows_.select("decision", "ts", F.unix_millis("ts").alias("ms"), "who", F.col("needed").cast("long"), "timeout_s")
    how = {"outputStructType": "decision string, status string, at_ms long, responses int", "outputMode": "append", "timeMode": "eventTime"}
    with state.keyed_store(spark):
        one = run_available(rows_.groupBy("decision").transformWithState(statefulProcessor=state._Decision(86_400_000, near), **how), "one")
        folder = run_folder(spark, "groups")
        many = rows_.withColumn("group", F.pmod(F.xxhash64("decision"), F.lit(3))).groupBy("group").transformWithStateInPandas(statefulProcessor=state._DecisionGroup(86_400_000, near), **how)
        many.writeStream.format("parquet").trigger(availableNow=True).option("path", folder + "/out").option("checkpointLocation", folder + "/progress").start().awaitTermination()
    got = rows(spark.read.parquet(folder + "/out"))
    assert got == rows(one) and {x[1] for x in got} == {"completed", "failed"}
    left = spark.read.format("statestore").option("stateVarName", "asked").load(folder + "/progress")
    assert [x[0] for x in left.select("value.decision").collect()] == [["clock"]]
    assert spark.read.format("statestore").option("stateVarName", "answers").load(folder + "/progress").count() == 0


def test_decisions_dealt_over_groups_share_their_state(spark):
    """The store holds a row and a timer per group, not per decision."""
    df = spark.createDataFrame([(f"d{k}", 1_704_067_200 + k, None, 1, 86_400) for k in range(500)], "decision string, s long, who string, needed int, timeout_s long")
    folder, feed_ = run_folder(spark, "groups"), run_folder(spark, "feed")
    df.withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.parquet(feed_)
    with state.keyed_store(spark):
        out = state.decision_timeouts(event_time(open_stream(spark, feed_, 1), "1 hour"), groups=4)
        out.writeStream.format("parquet").trigger(availableNow=True).option("path", folder + "/out").option("checkpointLocation", folder + "/progress").start().awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", "asked").load(folder + "/progress").select(F.size("value.decision")).collect()
    assert len(held) == 4 and sum(x[0] for x in held) == 500
