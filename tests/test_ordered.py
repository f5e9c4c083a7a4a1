"""Hot keys: the chunked computation must equal the plain window and the sequential fold."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from coord.operators import history
from coord.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}"
        rows.append((key, rng.randrange(400), i, rng.choice([None, 1, 2, 3]), rng.random()))
    pdf = pd.DataFrame(rows, columns=["k", "t", "i", "v", "x"])
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["t"] * 37, unit="s")
    return spark.createDataFrame(pdf.astype({"v": "Int64"})).select(
        "k", F.col("ts").cast("timestamp_ntz").alias("ts"), "i", F.col("v").cast("long").alias("v"), "x"
    ).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_over_order_equals_plain_window(skewed):
    w = Window.partitionBy("k").orderBy("ts", "i")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select(
        "k", "i", F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"),
        F.row_number().over(w).cast("long").alias("rn"), F.sum("v").over(run).alias("s"),
        F.last("v", ignorenulls=True).over(run).alias("f"),
    )
    got = O.over_order(
        skewed, ["k"], ["ts", "i"], O.lag("lag", F.col("v")), O.lead("lead", F.col("v")), O.rank("rn"),
        O.running_sum("s", F.col("v")), O.last_known("f", F.col("v")), chunks=30,
    ).select("k", "i", "lag", "lead", "rn", "s", "f")
    assert rows(got) == rows(want)


def test_chunks_are_even_and_in_order(skewed):
    cut, split = O.in_chunks(skewed, ["k"], ["ts", "i"], 30)
    per = cut.groupBy("k", "_chunk").agg(F.count("*").alias("n"), F.min(F.struct("ts", "i")).alias("lo"), F.max(F.struct("ts", "i")).alias("hi"))
    hot = per.where("k = 'hot'").orderBy("_chunk").collect()
    assert len(hot) > 10 and max(r["n"] for r in hot) < 300
    assert all(a["hi"] < b["lo"] for a, b in zip(hot, hot[1:]))
    assert "hot" in {r["k"] for r in split.collect()} and split.count() < 30
    assert cut.where("_chunk = 0").select("k").join(split, "k", "left_semi").isEmpty()


AWKWARD = {
    "null key": [(None, float(i % 50), i) for i in range(400)] + [("b", 1.0, 1000)],
    "one moment": [("a", 5.0, i) for i in range(400)] + [("b", 5.0, 1000)],
    "stray value": [("a", -1e300, 9999)] + [("a", 1.0 + i / 1000, i) for i in range(400)],
    "NaN and infinities": [("a", [float("nan"), float("inf"), float("-inf"), None, 1.5][i % 5], i) for i in range(400)],
    "nothing": [],
}


@pytest.mark.parametrize("chunks", [1, 7, None])
@pytest.mark.parametrize("case", AWKWARD)
def test_awkward_keys_and_orders(spark, case, chunks):
    df = spark.createDataFrame(AWKWARD[case], "k string, x double, i long")
    w = Window.partitionBy("k").orderBy("x", "i")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "i", F.lag("i").over(w).alias("lag"), F.lead("i").over(w).alias("lead"), F.row_number().over(w).cast("long").alias("n"), F.sum("i").over(run).alias("s"))
    got = O.over_order(df, ["k"], ["x", "i"], O.lag("lag", F.col("i")), O.lead("lead", F.col("i")), O.rank("n"), O.running_sum("s", F.col("i")), chunks=chunks)
    assert rows(got.select(*want.columns)) == rows(want)


def test_string_order(spark):
    df = spark.createDataFrame([("a", f"{(i * 37) % 211}x", i) for i in range(400)], "k string, x string, i long")
    want = df.select("k", "i", F.row_number().over(Window.partitionBy("k").orderBy("x", "i")).cast("long").alias("n"))
    assert rows(O.over_order(df, ["k"], ["x", "i"], O.rank("n"), chunks=9).select("k", "i", "n")) == rows(want)


def test_quantiles_do_not_depend_on_the_number_of_chunks(spark):
    values = [float(i) for i in range(3000)] + [float("nan"), float("inf")]
    df = spark.createDataFrame([(None, v) for v in values], "k string, x double")
    assert [rows(O.exact_quantiles(df, ["k"], "x", {"p50": 0.5}, c)) for c in (1, 13)] == [[(None, 3002, 1500.5)]] * 2


def test_trailing_count(skewed):
    w = Window.partitionBy("k").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-600_000_000, 0)
    want = skewed.select("k", "ts", F.count("*").over(w).alias("n")).distinct()
    got = O.trailing_count(skewed, ["k"], "ts", "10 MINUTES", "n", chunks=30).select("k", "ts", "n")
    assert rows(got) == rows(want)


def test_exact_quantiles(skewed):
    got = {r["k"]: r for r in O.exact_quantiles(skewed, ["k"], "x", {"p50": 0.5, "p95": 0.95}, 30).collect()}
    for k, g in skewed.toPandas().groupby("k"):
        assert got[k]["p50"] == pytest.approx(g["x"].quantile(0.5))
        assert got[k]["p95"] == pytest.approx(g["x"].quantile(0.95))
        assert got[k]["samples"] == len(g)


def test_top_per_key_limits_before_the_shuffle(skewed):
    df = O.top_per_key(skewed, ["k"], [F.col("ts").desc(), F.col("i")], 3)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def commands(spark):
    rng = random.Random(3)
    names = history.TASKS.commands + ["nonsense"]
    data = []
    for i in range(4000):
        slug = "hot" if rng.random() < 0.5 else f"t{rng.randrange(60)}"
        want = rng.choice([None, None, None, "queued", "claimed", "bogus"])
        data.append((slug, i, rng.randrange(500), rng.choice(names), want))
    pdf = pd.DataFrame(data, columns=["slug", "seq", "t", "cmd", "want"])
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["t"], unit="m")
    return pdf.drop(columns="t")


def sequential(pdf, table, initial="planning"):
    out = []
    for slug, g in pdf.sort_values(["slug", "ts", "seq"]).groupby("slug"):
        state = initial
        for r in g.itertuples():
            before, res = state, "ok"
            if r.want is not None and r.want != state:
                res = "conflict"
            elif (state, r.cmd) in table:
                state = table[state, r.cmd]
            else:
                res = "invalid_transition"
            out.append((slug, r.seq, before, state, res))
    return sorted(out)


@pytest.mark.parametrize("chunks", [60, 1, None])
def test_fold_matches_sequential(spark, chunks):
    pdf = commands(spark)
    df = spark.createDataFrame(pdf, "slug string, seq long, cmd string, want string, ts timestamp_ntz")
    got = history.fold(df, expected="want", chunks=chunks).repartition(7)
    got = sorted(map(tuple, got.select("slug", "seq", "from_status", "to_status", "outcome").collect()))
    assert got == sequential(pdf, history.TASK_TRANSITIONS)
    # terminal states are never left
    assert not [r for r in got if r[2] in ("completed", "failed", "aborted") and r[4] == "ok"]


def test_fold_continues_from_given_state(spark):
    pdf = commands(spark)
    pdf["want"] = None
    half = pdf.ts.sort_values().iloc[2000]
    schema = "slug string, seq long, cmd string, want string, ts timestamp_ntz"
    full = history.fold(spark.createDataFrame(pdf, schema))
    early = history.fold(spark.createDataFrame(pdf[pdf.ts <= half], schema))
    start = history.task_states(early).select("slug", "status")
    late = history.fold(spark.createDataFrame(pdf[pdf.ts > half], schema), start=start, chunks=60)
    keep = ["slug", "seq", "to_status", "outcome"]
    assert rows(early.unionByName(late).select(*keep)) == rows(full.select(*keep))


def test_fold_on_many_files(spark, tmp_path):
    """Stored input with many files and partitions: groups must stay whole under adaptive execution."""
    names = history.TASKS.commands
    df = spark.range(0, 120_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.xxhash64("id") % 4000).cast("string"))).alias("slug"),
        F.col("id").alias("seq"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") % 60_000)).alias("ts"),
        F.element_at(F.array(*[F.lit(c) for c in names]), (F.abs(F.hash("id")) % len(names) + 1).cast("int")).alias("cmd"),
        F.lit(None).cast("string").alias("want"),
    )
    df.write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c"))
    want = sequential(df.toPandas(), history.TASK_TRANSITIONS)
    for chunks in (None, 24):
        got = history.fold(df, chunks=chunks).select("slug", "seq", "from_status", "to_status", "outcome")
        assert sorted(map(tuple, got.collect())) == want
