"""Keyed states: stream and batch agree in any order of arrival, with repeats, over a restart; idle keys end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codestrata.streaming import keyed as K

EVENTS = "run_id long, event_id long, ts timestamp, event string, done long, total long, cost double, error string"


def feed(spark, folder, rows, schema, parts):
    """Files read one a micro-batch, in the order of their making."""
    import os
    import time

    for i in range(parts):
        at = f"{folder}/{time.time_ns()}-{i}.json"
        with open(f"{at}.tmp", "w") as f:
            f.writelines(json.dumps(r, default=str) + "\n" for r in rows[i::parts])
        os.rename(f"{at}.tmp", at)
        os.utime(at, (1_000_000 + feed.clock, 1_000_000 + feed.clock))
        feed.clock += 10
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.json").json(str(folder))


feed.clock = 0


def run(q):
    q.awaitTermination()
    assert q.exception() is None


def test_log_entries_as_stated(spark):
    lines = ['{"level":40,"time":5,"msg":"Blue Print: slow","taskId":"t","err":{"message":"m","stack":"s"}}', '{"level":35,"msg":"x"}', '{"level":"50","msg":7,"err":{"message":"m"},"taskId":3}',
             '{"err":{"code":1}}', '{"err":"bad","msg":"no:space"}', "broken", "", " ", "null", "5", "[1]", '{"msg":"db:\\u00a0wide"}']
    got = {r["raw"]: tuple(r)[:6] + (r["component"],) for r in K.log_entries(spark.createDataFrame([(x,) for x in lines], "value string"), now=F.lit(9)).collect()}
    assert list(map(got.get, lines)) == [
        (40.0, "warn", 5, "Blue Print: slow", "t", "s", "blue print"), (35.0, "info", 9, "x", None, None, "app"), (30.0, "info", 9, "", None, "m", "app"), (30.0, "info", 9, "", None, '{"code":1}', "app"),
        (30.0, "info", 9, "no:space", None, "bad", "app"), None, None, None, None, (30.0, "info", 9, "", None, None, "app"), (30.0, "info", 9, "", None, None, "app"), (30.0, "info", 9, "db: wide", None, None, "db"),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_last_lines_of_stream_and_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [{"value": json.dumps({"level": 30, "time": 1_700_000_000_000 + rng.randrange(4_000), "msg": f"{rng.choice(['hot', 'hot', 'hot', 'a', 'b', 'C d'])}: {rng.randrange(60)} é"})} for _ in range(900)] + [{"value": "junk"}]
    rng.shuffle(rows)
    (files := tmp_path / "in").mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    half = feed(spark, files, rows[:500], "value string", 2)
    run(K.publish(K.last_lines_stream(K.log_entries(half), 20), out, cp))
    whole = feed(spark, files, rows[500:], "value string", 2)  # the same checkpoint goes on
    run(K.publish(K.last_lines_stream(K.log_entries(whole), 20), out, cp))
    got = sorted(map(tuple, K.ranked(K.current(spark, out, "component")).collect()))
    want = sorted(map(tuple, K.last_lines(K.log_entries(spark.createDataFrame([(r["value"],) for r in rows], "value string")), 20).collect()))
    assert got == want and len(got) == 80 and {r[0] for r in got} == {"hot", "a", "b", "c d"}


def test_an_idle_log_is_emptied(spark, tmp_path):
    (files := tmp_path / "in").mkdir()
    line = lambda t, c: {"value": json.dumps({"time": t, "msg": f"{c}: x"})}
    s = feed(spark, files, [line(1_000, "old"), line(90_000_000_000, "new"), line(90_000_000_001, "new")], "value string", 3)
    run(K.publish(K.last_lines_stream(K.log_entries(s), 5, late="1 second", idle_ms=1000), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert {r["component"]: len(r["lines"]) for r in K.current(spark, str(tmp_path / "out"), "component").collect()} == {"old": 0, "new": 2}


def events_of(rng, runs):
    rows, no = [], 0
    for run_id in range(runs):
        at = 1_700_000_000 + rng.randrange(3000)
        for event in rng.sample(["create", "progress", "progress", "progress", "complete", "fail"], rng.randrange(1, 7)):
            no += 1
            at += rng.randrange(3)  # equal times occur
            rows.append({"run_id": run_id, "event_id": no, "ts": f"{__import__('datetime').datetime.fromtimestamp(at, __import__('datetime').UTC):%Y-%m-%dT%H:%M:%S}", "event": event,
                         "done": rng.choice([None, rng.randrange(9)]), "total": rng.choice([None, 9]), "cost": rng.choice([None, 0.25, 0.5]), "error": rng.choice([None, f"e{no}"])})
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_runs_of_stream_and_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = events_of(rng, 60)
    rows += rng.sample(rows, 30)  # repeats
    rng.shuffle(rows)
    (files := tmp_path / "in").mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for part in (rows[:100], rows[100:]):
        run(K.publish(K.runs_stream(feed(spark, files, part, EVENTS, 2), late="2 hours"), out, cp, "append"))
    got = sorted(map(tuple, K.current(spark, out, "run_id").collect()))
    want = sorted(map(tuple, K.runs_batch(spark.read.schema(EVENTS).json(str(files))).collect()))
    assert got == want and len(got) == 60 and {r[1] for r in got} == {"running", "completed", "failed"}


def test_a_silent_run_fails_and_may_come_back(spark, tmp_path):
    e = lambda run_id, no, minute, event: {"run_id": run_id, "event_id": no, "ts": f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00", "event": event, "done": None, "total": None, "cost": 1.0, "error": None}
    rows = [e(1, 1, 0, "create"), e(2, 2, 0, "create"), e(2, 3, 1, "complete"), e(3, 4, 590, "create"), e(3, 5, 600, "progress")]
    (files := tmp_path / "in").mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    options = dict(late="1 minute", idle_ms=3_600_000, forget_ms=30 * 86_400_000)
    stream = feed(spark, files, rows, EVENTS, 1)
    run(K.publish(K.runs_stream(stream, **options), out, cp, "append"))
    got = sorted(map(tuple, K.current(spark, out, "run_id").collect()))
    assert got == sorted(map(tuple, K.runs_batch(spark.read.schema(EVENTS).json(str(files)), 3_600_000).collect()))
    assert [(r[0], r[1], r[6]) for r in got] == [(1, "failed", K.INTERRUPTED), (2, "completed", None), (3, "running", None)]
    feed(spark, files, [e(1, 6, 605, "progress"), e(1, 7, 606, "complete"), e(1, 1, 0, "create")], EVENTS, 1)  # the last one is late
    run(K.publish(K.runs_stream(stream, **options), out, cp, "append"))
    assert [(r[0], r[1], r[2], r[5]) for r in K.current(spark, out, "run_id").orderBy("run_id").collect()][0] == (1, "completed", 606 * 60_000, 3.0)


def test_runs_share_states_and_keep_deadlines_of_their_own(spark, tmp_path):
    """As many states as buckets, whatever the number of runs."""
    e = lambda run_id, no, minute, event: {"run_id": run_id, "event_id": no, "ts": f"2024-01-01T{minute // 60:02}:{minute % 60:02}:00", "event": event, "done": None, "total": None, "cost": 1.0, "error": None}
    (files := tmp_path / "in").mkdir()
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    options = dict(late="1 minute", idle_ms=3_600_000, forget_ms=7_200_000, buckets=2)
    rows = [e(i, i, i % 3, "create") for i in range(1, 40)] + [e(90, 90, 100, "create")]
    first = K.publish(K.runs_stream(feed(spark, files, rows, EVENTS, 1), **options), out, cp, "append")
    run(first)
    assert max(s["numRowsTotal"] for p in first.recentProgress for s in p["stateOperators"] if "Dedup" not in s["operatorName"] and "dedup" not in s["operatorName"]) <= 2
    got = {r["run_id"]: (r["status"], r["error"]) for r in K.current(spark, out, "run_id").collect()}
    assert got == {i: ("failed", K.INTERRUPTED) for i in range(1, 40)} | {90: ("running", None)}
    # run 7 is told of again beside the others of its state, which are forgotten by then but for the last
    run(K.publish(K.runs_stream(feed(spark, files, [e(7, 107, 130, "complete"), e(90, 190, 300, "progress")], EVENTS, 1), **options), out, cp, "append"))
    got = {r["run_id"]: (r["status"], r["cost"]) for r in K.current(spark, out, "run_id").collect()}
    assert got[7] == ("completed", 2.0) and got[90] == ("running", 2.0) and got[8] == ("failed", 1.0)
