"""The session detector against a state machine, batch and streaming."""

import random

from pyspark.sql import functions as F

from parley.operators import sessions
from parley.session import scratch
from parley.streaming import run
from parley.streaming import sessions as live

D, C, M = 15, 20, 30
SIGNAL = "key string, ts long, ord long, on boolean"


def machine(edges):
    """The reference behaviour: deadlines fire before an edge at that instant."""
    phase, since, started, out = "idle", 0, 0, []
    for t, on in [*edges, (10**9, None)]:
        if phase == "arming" and since + D <= t:
            phase, started = "recording", since + D
        if phase == "coasting" and since + C <= t:
            out.append((started, since, since - started, since - started >= M))
            phase = "idle"
        if on is None:
            break
        if phase == "idle" and on:
            phase, since = "arming", t
        elif phase == "arming" and not on:
            phase = "idle"
        elif phase == "recording" and not on:
            phase, since = "coasting", t
        elif phase == "coasting" and on:
            phase = "recording"
    if phase == "recording":
        out.append((started, None, None, None))
    return out


def random_signal(seed, keys=40):
    rng = random.Random(seed)
    rows, want = [], {}
    for k in range(keys):
        t, edges = 0, []
        for _ in range(rng.randrange(1, 40)):
            t += rng.choice([1, 5, 14, 15, 16, 19, 20, 21, 60])
            edges.append((t, rng.random() < 0.5))
        rows += [(f"k{k}", t, i, on) for i, (t, on) in enumerate(edges)]
        want[f"k{k}"] = machine(edges)
    return rows, want


def grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.key, []).append((r.started, r.ended, r.duration, r.keep))
    return {k: sorted(v) for k, v in out.items()}


def test_batch_equals_machine(spark):
    rows, want = random_signal(1)
    for span in (7, 50, 100_000):
        got = sessions.detect(spark.createDataFrame(rows, SIGNAL), D, C, M, span)
        assert grouped(got.collect()) == {k: v for k, v in want.items() if v}


def test_short_blip_is_discarded(spark):
    rows = [("a", 0, 0, True), ("a", D + 29, 1, False)]
    got = sessions.detect(spark.createDataFrame(rows, SIGNAL), D, C, M, 1000).first()
    assert (got.started, got.ended, got.duration, got.keep) == (D, D + 29, 29, False)


def test_streaming_equals_batch(spark):
    rows, want = random_signal(2, 12)
    end = max(r[1] for r in rows) + 1000
    path = scratch(spark, "edges")
    df = spark.createDataFrame(rows, SIGNAL).orderBy("ts")
    third = end // 3
    for lo in range(0, end, third + 1):
        df.filter((F.col("ts") >= lo) & (F.col("ts") < lo + third + 1)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", 1).parquet(path)
    rules = live.Rules(D, C, M)
    out = run.drain(spark, live.detect(stream, rules), "test", finish=live.finish(rules)).collect()
    ended = sorted((r.key, r.started, r.ended, r.event == "finished") for r in out if r.event != "started")
    assert ended == sorted((k, s, e, keep) for k, v in want.items() for s, e, _, keep in v if e is not None)
    begun = sorted((r.key, r.started) for r in out if r.event == "started")
    assert begun == sorted((k, s) for k, v in want.items() for s, *_ in v)


def test_owner_tiers(spark):
    rows = [
        (1, 0, "com.apple.CoreSpeech", 5), (1, 1, "com.acme.X", 6), (1, 2, "us.zoom.xos", 7),
        (2, 0, "com.apple.CoreSpeech", 5), (2, 1, "com.acme.X", 6), (3, 0, "com.apple.CoreSpeech", 5),
    ]
    df = spark.createDataFrame(rows, "snapshot_id long, ord long, bundle_id string, pid int")
    assert {r.snapshot_id: r.pid for r in sessions.best_owner(df).collect()} == {1: 7, 2: 6, 3: 5}


def test_short_turn_inside_a_long_one_opens_no_gap(spark):
    from parley.operators.sessions import smooth_turns

    rows = [("r", "A", 0, 0.0, 100.0), ("r", "A", 1, 10.0, 20.0), ("r", "A", 2, 60.0, 70.0), ("r", "A", 3, 140.0, 155.0)]
    df = spark.createDataFrame(rows, "recording_id string, label string, seq long, start double, end double")
    for span in (15.0, 1200.0):
        got = sorted((r.start, r.end) for r in smooth_turns(df, 10.0, 30.0, span).collect())
        assert got == [(0.0, 100.0), (140.0, 155.0)]


def test_short_log_entries_fill_the_budget(spark):
    from parley.operators.feeds import recent_logs

    rows = [(i, i, "t", "l", "x", "m") for i in range(200)] + [(200, 200, "t", None, "x", "mm")]
    df = spark.createDataFrame(rows, "at long, ord long, timestamp string, level string, target string, message string")
    for span in (7, 1000):
        assert {r.ord for r in recent_logs(df, span, 280).collect()} == set(range(131, 201))
