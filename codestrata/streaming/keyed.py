"""Keyed state over streams: the last lines of each log (A11) and the life of runs and jobs.

Each of the two has a batch form in DataFrame functions and a stream form that holds a small state for a key.  The states are folds
that don't depend on the order of arrival, so both forms agree whatever the files' order, with rows later than the watermark left out.
A stream publishes the keys of each micro-batch (:func:`publish`), and :func:`current` reads the last row of each key.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from codestrata.operators.runs import run_lifecycle

#: The names of levels, the head of a message that names its component, lines kept.
LEVELS = {10: "trace", 20: "debug", 30: "info", 40: "warn", 50: "error", 60: "fatal"}
COMPONENT = r"^(\w[\w -]*?):[\h\x0A-\x0D\x{FEFF}\x{2028}\x{2029}]"
KEPT = 500
#: Fixed value: the error of a run that stopped reporting.
INTERRUPTED = "Interrupted by process restart"
#: States among which the runs of a stream are dealt.
BUCKETS = 8192


def log_entries(lines: DataFrame, text: str = "value", now: Column | None = None) -> DataFrame:
    """Log lines in JSON as (level, level_label, time, msg, component, task_id, err, raw); other lines are left out.

    A level that is no number is 30 and one without a name is called info, a message that is no text is empty, a time that is no
    number is ``now``, in milliseconds.  An error is its stack, its message, or its JSON, in this order.
    """
    v = F.col("__v")

    def typed(path: str, kinds: tuple[str, ...], sql_type: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return F.when(kind.rlike(f"^({'|'.join(kinds)})"), F.try_variant_get(v, path, sql_type))

    number = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    level = F.coalesce(typed("$.level", number, "double"), F.lit(30.0))
    msg = F.coalesce(typed("$.msg", ("STRING",), "string"), F.lit(""))
    named = F.coalesce(*[F.when(level == k, name) for k, name in LEVELS.items()], F.lit("info"))
    err = F.coalesce(typed("$.err", ("STRING",), "string"), typed("$.err.stack", ("STRING",), "string"), typed("$.err.message", ("STRING",), "string"), F.to_json(F.when(F.schema_of_variant(F.try_variant_get(v, "$.err", "variant")).rlike("^(OBJECT|ARRAY)"), F.try_variant_get(v, "$.err", "variant"))))
    time = F.coalesce(typed("$.time", number, "long"), now if now is not None else F.unix_millis(F.current_timestamp()))
    parsed = lines.select(F.col(text).alias("raw"), F.try_parse_json(text).alias("__v")).where(F.schema_of_variant(v) != "VOID")
    told = parsed.select(level.alias("level"), named.alias("level_label"), time.alias("time"), msg.alias("msg"), typed("$.taskId", ("STRING",), "string").alias("task_id"), err.alias("err"), "raw")
    head = F.regexp_extract("msg", COMPONENT, 1)
    return told.withColumn("component", F.when(head == "", "app").otherwise(F.lower(head)))


def last_lines(entries: DataFrame, n: int = KEPT, key: str = "component") -> DataFrame:
    """(key, rank, time, raw): the ``n`` latest lines of each key, the latest first; equal times by the line, descending.

    Spark keeps ``n`` rows of a key on the map side, so a key with most of the rows does not meet in one task.
    """
    w = W.partitionBy(key).orderBy(F.desc("time"), F.desc("raw"))
    return entries.select(key, F.row_number().over(w).alias("rank"), "time", "raw").where(F.col("rank") <= n)


def last_lines_stream(entries: DataFrame, n: int = KEPT, key: str = "component", late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """(key, lines): for each key of a micro-batch its ``n`` latest lines as :func:`last_lines` ranks them.

    A key whose latest line is ``idle_ms`` behind the watermark is emptied and forgotten.  Each Arrow batch is cut to the ``n``
    latest of a key before the shuffle; a line later than the watermark is left out.  Bytes of text compare as code points do.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.sort_values(["time", "raw"], ascending=False).groupby("k", sort=False, dropna=False).head(n)

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"k": [k[0]], "lines": ["[]"]})
            return
        kept: list = [tuple(x) for x in json.loads(state.get[0])] if state.exists else []
        for b in batches:
            kept = heapq.nlargest(n, kept + [(int(t), r) for t, r in zip(b["time"], b["raw"], strict=True)])
        told = json.dumps(kept)
        state.update((told,))
        state.setTimeoutTimestamp(max(kept[0][0] + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": [k[0]], "lines": [told]})

    few = entries.select(F.col(key).alias("k"), "time", "raw").mapInPandas(cut, "k string, time long, raw string")
    timed = few.withColumn("at", F.timestamp_millis("time")).withWatermark("at", late)
    folded = timed.groupBy("k").applyInPandasWithState(keep, "k string, lines string", "told string", "update", "EventTimeTimeout")
    pairs = F.from_json("lines", "array<array<string>>")
    return folded.select(F.col("k").alias(key), F.transform(pairs, lambda x: F.struct(x[0].cast("long").alias("time"), x[1].alias("raw"))).alias("lines"))


def ranked(last: DataFrame, key: str = "component") -> DataFrame:
    """The published lines as :func:`last_lines` has them."""
    return last.select(key, F.posexplode("lines").alias("at", "x")).select(key, (F.col("at") + 1).alias("rank"), "x.time", "x.raw")


_RUN = "status string, started_us long, ended_us long, done long, total long, cost double, error string"


def _told(events: DataFrame) -> DataFrame:
    kinds = {"run_id": "long", "event_id": "long", "event": "string", "done": "long", "total": "long", "cost": "double", "error": "string"}
    return events.select(F.col("ts").cast("timestamp").alias("ts"), *[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


def runs_batch(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The life of runs, each event once; a running one is failed that is ``idle_ms`` behind the latest event of all.

    ``events`` is (run_id, event_id, ts, event, done, total, cost, error); see :func:`codestrata.operators.runs.run_lifecycle`.
    """
    once = _told(events).where("ts is not null and run_id is not null").dropDuplicates(["run_id", "event_id"])
    runs = run_lifecycle(once).select("run_id", "status", "duration_ms", "done", "total", "cost", "error")
    if idle_ms is None:
        return runs
    seen = once.groupBy("run_id").agg(F.max("ts").alias("seen"))
    stale = (F.col("status") == "running") & (F.unix_millis("seen") + idle_ms < F.unix_millis("latest"))
    both = runs.join(seen, "run_id").crossJoin(F.broadcast(once.agg(F.max("ts").alias("latest"))))  # one row
    return both.select("run_id", F.when(stale, "failed").otherwise(F.col("status")).alias("status"), "duration_ms", "done", "total", "cost", F.when(stale, INTERRUPTED).otherwise(F.col("error")).alias("error"))


def runs_stream(events: DataFrame, late: str = "1 hour", idle_ms: int = 6 * 3_600_000, forget_ms: int = 7 * 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """The life of each run that a micro-batch tells of, as :func:`runs_batch` has it.

    Repeated events count once: they are dropped by id until the watermark passes them, and are late then.  A run that reports
    nothing for ``idle_ms`` fails, and is running again when it reports; ``forget_ms`` after its last event its state goes, and
    a later event begins a new life.  A state holds the runs of one of ``buckets`` by a hash, each with a deadline of its own, as a
    call of Python for each run costs more than its events; a checkpoint goes on only with the number that it began with.
    """
    def later(a: list | None, b: list) -> list:
        return b if a is None or (b[0], b[1]) > (a[0], a[1]) else a

    def row(s: dict) -> str:
        end = s["end"]
        status = ("completed" if end[2] == "complete" else "failed") if end else "failed" if s["stale"] else "running"
        error = INTERRUPTED if s["stale"] and not end else s["error"][2] if end and end[2] == "fail" and s["error"] else None
        return json.dumps(dict(status=status, started_us=s["start"], ended_us=s["ended"], done=s["done"][2] if s["done"] else None, total=s["total"], cost=round(s["cost"], 4), error=error))

    def live(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs: dict[str, dict] = json.loads(state.get[0]) if state.exists else {}
        now, told = state.getCurrentWatermarkMs(), {}
        for b in () if state.hasTimedOut else batches:
            for run, no, us, event, done, total, cost, error in map(json.loads, b["told"].tolist()):
                run = str(run)
                if (s := told.get(run)) is None:
                    s = told[run] = runs.setdefault(run, dict(start=None, ended=None, end=None, done=None, total=None, cost=0.0, error=None, seen=0))
                s["seen"], s["cost"] = max(s["seen"], us), s["cost"] + (cost or 0.0)
                if total is not None:
                    s["total"] = max(total, s["total"] if s["total"] is not None else total)
                if event == "create":
                    s["start"] = us if s["start"] is None else min(us, s["start"])
                elif event == "progress":
                    s["done"] = later(s["done"], [us, no, done])
                elif event in ("complete", "fail"):
                    s["end"], s["ended"] = later(s["end"], [us, no, event]), max(us, s["ended"] or us)
                    if event == "fail":
                        s["error"] = later(s["error"], [us, no, error])
        for s in told.values():
            s["stale"] = False
            s["until"] = max(s["seen"] // 1000 + (forget_ms if s["end"] else idle_ms), now + 1)
        for run in [r for r, s in runs.items() if r not in told and s["until"] < now]:
            s = runs[run]
            if s["end"] or s["stale"]:
                del runs[run]
                continue
            s["stale"], s["until"] = True, max(s["seen"] // 1000 + forget_ms, now + 1)
            told[run] = s
        if runs:
            state.update((json.dumps(runs),))
            state.setTimeoutTimestamp(max(min(s["until"] for s in runs.values()), now + 1))
        else:
            state.remove()
        yield pd.DataFrame({"run_id": pd.Series(map(int, told), dtype="int64"), "told": pd.Series(map(row, told.values()), dtype=object)})

    timed = _told(events).where("ts is not null and run_id is not null").withWatermark("ts", late)
    # one text an event and one a state, as Arrow's cost for a key grows with the columns
    told = F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(c, F.lit("null")) for c in (F.col("run_id").cast("string"), F.col("event_id").cast("string"), F.unix_micros("ts").cast("string"), _text("event"), F.col("done").cast("string"), F.col("total").cast("string"), F.col("cost").cast("string"), _text("error"))]), F.lit("]"))
    once = timed.dropDuplicatesWithinWatermark(["run_id", "event_id"]).select(F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket"), "ts", told.alias("told"))
    folded = once.groupBy("bucket").applyInPandasWithState(live, "run_id long, told string", "told string", "append", "EventTimeTimeout")
    r = folded.select("run_id", F.from_json("told", _RUN).alias("r"))
    return r.select("run_id", "r.status", ((F.col("r.ended_us") - F.col("r.started_us")) / 1000).cast("long").alias("duration_ms"), "r.done", "r.total", "r.cost", "r.error")


def _text(name: str) -> Column:
    """A text as JSON has it, null as such."""
    return F.regexp_extract(F.to_json(F.struct(F.array(name).alias("a"))), r'(?s)^\{"a":\[(.*)\]\}$', 1)


def publish(stream: DataFrame, folder: str, checkpoint: str, mode: str = "update", every: str | None = None):
    """Writes the rows of each micro-batch to a folder of its own, so that a repeated batch replaces itself; without ``every`` what is there, once."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    w = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def current(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The last published row of each key."""
    rows = spark.read.parquet(folder)
    own = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*own), "batch").alias("r")).select("r.*")
