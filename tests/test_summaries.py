"""The answer log: every prompt asked once, under a budget, through failures and restarts; JSON in answers."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.functions import semantic as SEM
from codestrata.operators import summaries as S

CHUNK = "id long, prompt string, name string, lines int"


def chunks_of(spark, n, repeats=0):
    rows = [(i, f"prompt {i}", "f", 1) for i in range(n)] + [(n + i, f"prompt {i}", "f", 1) for i in range(repeats)]
    return spark.createDataFrame(rows, CHUNK).repartition(5)


def counting(folder, answer):
    """A model that leaves a file for each call, whichever worker makes it."""
    def ask(prompt):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(prompt)
        return answer(prompt)
    return ask


def calls(folder):
    return [p.read_text() for p in folder.iterdir()]


def test_each_prompt_once_with_a_random_model(spark, tmp_path):
    (made := tmp_path / "calls").mkdir()
    def answer(prompt):
        return f"A summary with words\nCONFIDENCE: {random.random():.3f}", 0.25
    got = S.summarise(chunks_of(spark, 1000, 50), str(tmp_path / "log"), 1e9, counting(str(made), answer), wave=300).collect()
    assert sorted(r["id"] for r in got) == list(range(1050))
    assert sum(r["calls"] for r in got) == len(calls(made)) and sum(r["cost"] for r in got) == 0.25 * len(calls(made))
    assert len([p for p in calls(made) if "neighboring" not in p]) == 1000
    assert {r["calls"] for r in got if r["id"] >= 1000} == {0}
    by = {r["id"]: r for r in got}
    assert all(by[i]["summary"] == by[1000 + i]["summary"] and by[i]["quality_score"] == by[1000 + i]["quality_score"] for i in range(50))


def test_failures_are_rows_and_are_tried_by_the_next_run(spark, tmp_path):
    def raising(prompt):
        if "7" in prompt:
            raise TimeoutError("no answer")
        return "Fine words of a summary", 1.0
    chunks, log = chunks_of(spark, 100), str(tmp_path / "log")
    got = {r["id"]: r for r in S.summarise(chunks, log, 1e9, raising).collect()}
    failed = {i for i in range(100) if "7" in str(i)}
    assert len(got) == 100 and {i for i, r in got.items() if r["error"]} == failed and got[7]["error"] == "TimeoutError: no answer" and got[7]["summary"] is None
    (made := tmp_path / "calls").mkdir()
    again = S.summarise(chunks, log, 1e9, counting(str(made), lambda p: ("Now it works well", 1.0)), run="2").collect()
    assert {r["id"] for r in again} == failed and len(calls(made)) == len(failed)


def test_the_budget_is_what_was_spent(spark, tmp_path):
    chunks = chunks_of(spark, 60)
    def cost(prompt):
        return "An answer of some words", 0.5 + int(prompt.split("\n")[0].split()[1]) % 3
    got = S.summarise(chunks, str(tmp_path / "one"), 10.0, cost, wave=1).orderBy("id").collect()
    total, want = 0.0, 0
    while total < 10:
        total, want = total + 0.5 + want % 3, want + 1
    assert [r["id"] for r in got] == list(range(want)) and sum(r["cost"] for r in got) == total
    assert S.summarise(chunks, str(tmp_path / "none"), 0.0, cost).count() == 0


def test_a_stopped_run_goes_on(spark, tmp_path):
    (made := tmp_path / "calls").mkdir()
    chunks, log = chunks_of(spark, 500), str(tmp_path / "log")
    ask = counting(str(made), lambda p: ("An answer of some words", 1.0))
    part = S.summarise(chunks, log, 150.0, ask, wave=40)  # ends by its budget in the middle, as a stopped driver would
    n = part.count()
    assert 0 < n < 500
    rest = S.summarise(chunks, log, 1e9, ask, wave=100)
    assert rest.count() == 500 and len(calls(made)) == 500
    assert S.summarise(chunks, log, 1e9, ask, run="later").count() == 0 and len(calls(made)) == 500


def test_a_second_try_has_the_context_and_stays(spark, tmp_path):
    symbols = spark.createDataFrame([("a.ts", n, "function", i, f"{n}()" if n != "c" else None) for i, n in enumerate("abcdefgh")], "path string, name string, kind string, start_line int, signature string")
    context = {r["name"]: r["context"] for r in S.neighbour_context(symbols).collect()}
    assert context["a"] == "  - b (function): b()\n  - c (function): no signature\n  - d (function): d()\n  - e (function): e()\n  - f (function): f()"
    def model(prompt):
        return ("Worse still\nCONFIDENCE: 0.1" if "neighboring" in prompt and "b()" in prompt else "Poor\nCONFIDENCE: 0.3"), 1.0
    one = spark.createDataFrame([(1, "p", "f", 1, context["a"])], CHUNK + ", context string")
    r = S.summarise(one, str(tmp_path / "log"), 1e9, model).first()
    assert (r["summary"], r["quality_score"], r["demoted"], r["cost"], r["calls"]) == ("Worse still", 0.1, True, 2.0, 2)


def test_json_in_answers(spark):
    texts = ['see {"a": "}"} and {"b": 1}', "none", "[1, [2]] x", 'x {"a": "\\"}{"} y', "{ open", "}{}", '```json\n{"a": 1}\n```', 'He said "{" then [1]', ""]
    got = [r[0] for r in spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int").orderBy("i").select(SEM.json_in(F.col("t"))).collect()]
    assert got == ['{"a": "}"}', "none", "[1, [2]]", '{"a": "\\"}{"}', "{ open", "{}", '{"a": 1}\n', 'He said "{" then [1]', ""]


VALUES = st.recursive(st.integers() | st.text(max_size=8) | st.booleans(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=8)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.dictionaries(st.text(max_size=4), VALUES, max_size=3) | st.lists(VALUES, max_size=3), min_size=1, max_size=40))
def test_json_of_random_values(spark, values):
    texts = [f"Here is it: {json.dumps(v)} and [more] {{}}" for v in values if "```" not in json.dumps(v)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int")
    got = {r["i"]: r["j"] for r in df.select("i", SEM.json_in(F.col("t")).alias("j")).collect()}
    assert [json.loads(got[i]) for i in range(len(texts))] == [v for v in values if "```" not in json.dumps(v)]


@pytest.mark.parametrize("text,score", [("CONFIDENCE: 1.2.3", 1.0), ("CONFIDENCE: .4", 0.4), ("x", 0.5)])
def test_both_readings_of_a_score_agree(spark, text, score):
    assert S._score(text) == score == spark.range(1).select(SEM.parse_answer(F.lit(text))["score"]).first()[0]


def test_a_plan_is_read_once_for_each_row(spark):
    plan = spark.createDataFrame([('{"phases": [{}]}',)], "t string").select(SEM.parse_plan(F.col("t")).alias("p"))
    shown = plan._jdf.queryExecution().analyzed().toString()
    assert shown.count("from_json") == 1 and shown.count("aggregate(") == 1
    assert plan.first()["p"]["phases"][0]["title"] == "Phase 1"


def test_waves_double_and_read_their_own_answers(spark, tmp_path, monkeypatch):
    """Free prompts are asked in a few growing waves; a given size stays the most."""
    monkeypatch.setattr(S, "WAVE", 20)
    monkeypatch.setattr(S, "TASK", 10)
    free = lambda p: ("An answer of some words", 0.0)
    got = S.summarise(chunks_of(spark, 400), str(tmp_path / "grown"), 1.0, free)
    assert got.count() == 400 and len(list((tmp_path / "grown/answers/1").iterdir())) <= 7
    S.summarise(chunks_of(spark, 100), str(tmp_path / "even"), 1.0, free, wave=25)
    assert len(list((tmp_path / "even/answers/1").iterdir())) == 5


def test_only_ids_and_hashes_are_numbered_and_repeated_rows_are_asked_once(spark, tmp_path):
    """A prompt travels once, after the numbering; an id that has it in several rows is one prompt."""
    from codestrata.operators import summaries

    rows = [("a", "p", "z", 1), ("a", "p", "b", 2), ("c", "p", "c", 3), ("d", "q", "d", 4), (None, "r", "e", 5)]
    chunks = spark.createDataFrame(rows, "id string, prompt string, name string, lines int")
    todo = summaries._todo(chunks, None, None, "1")
    assert "prompt" not in todo.columns
    todo.write.parquet(str(tmp_path / "todo"))
    got = summaries._prompts(chunks, summaries._numbered(spark.read.parquet(str(tmp_path / "todo")))).collect()
    assert sorted((r["seq"], r["id"], r["prompt"], r["name"], r["lines"]) for r in got) == [(0, None, "r", "e", 5), (1, "a", "p", "b", 2), (2, "d", "q", "d", 4)]
