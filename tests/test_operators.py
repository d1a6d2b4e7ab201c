"""Operators on small rows."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from codestrata.functions import text as T
from codestrata.operators import ann as N
from codestrata.operators import assemble as A
from codestrata.operators import context as C
from codestrata.operators import detectors as D
from codestrata.operators import graph as G
from codestrata.operators import incremental as I
from codestrata.operators import merge as M
from codestrata.operators import vector as V
from pyspark.sql import functions as F


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def brute_scc(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a, b in pairs:
            for r in reach.values():
                if a in r:
                    r.add(b)
    out = {}
    for a in nodes:
        c = {b for b in reach[a] if a in reach[b]}
        if len(c) > 1:
            out[a] = min(c)
    return out


@pytest.mark.parametrize("core", [0, 1000])
def test_scc(spark, core):
    rng = random.Random(5)
    pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(18)] + [(20, 21), (21, 22), (22, 20), (30, 30), (31, 32)]
    got = {r[0]: r[1] for r in G.scc(edges(spark, pairs), core).collect()}
    assert got == brute_scc([p for p in pairs if p[0] != p[1]])


def test_scc_of_large_ids(spark):
    """Sums of such ids would overflow; the colouring path compares hashes."""
    big = 1 << 62
    got = G.scc(edges(spark, [(big + i, big + (i + 1) % 6) for i in range(6)]), 3).collect()
    assert {r["component"] for r in got} == {big} and len(got) == 6


def test_scc_of_nothing(spark):
    assert G.scc(edges(spark, [])).count() == 0
    assert G.scc(edges(spark, [(1, 2), (2, 3), (1, None)])).count() == 0


def test_coupling_counts_self_edges_once_only_outward(spark):
    got = {r["node"]: (r["efferent"], r["afferent"]) for r in G.coupling(edges(spark, [(1, 1), (1, 2), (1, 2), (3, 2), (3, None)])).collect()}
    assert got == {1: (2, 0), 2: (0, 2), 3: (1, 0)}
    got = {r["node"]: (r["fan_out"], r["fan_in"]) for r in G.fan_in_out(edges(spark, [(1, 1), (1, 2)])).collect()}
    assert got == {1: (2, 1), 2: (0, 1)}


def test_bfs_keeps_least_depth_and_ends_on_cycles(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 1), (3, 4), (4, 5)])
    start = spark.createDataFrame([(1,)], "node long")
    assert {(r["node"], r["depth"]) for r in G.bfs(e, start, 2).collect()} == {(2, 1), (3, 1), (4, 2)}
    assert {(r["node"], r["depth"]) for r in G.bfs(e, start, 1, "reverse").collect()} == {(3, 1)}
    assert G.bfs(e, start, 0).count() == 0


def test_near_duplicates_are_exact_for_any_block_count(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {(r["a"], r["b"]) for r in N.near_duplicates(e, 0.5, 1000).collect()}
    got = [(r["a"], r["b"]) for r in N.near_duplicates(e, 0.5, 6).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k long, v string, ord long")
    assert sorted(map(tuple, M.upsert_keep_last(old, new, ["k"], "ord").collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, M.insert_ignore(old, new, ["k"], "ord").collect())) == [(3, "z")]
    again = M.upsert_keep_last(M.upsert_keep_last(old, new, ["k"], "ord"), new, ["k"], "ord")
    assert sorted(map(tuple, again.collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, M.replace_by_parent(old, spark.createDataFrame([(1, "n"), (1, "m")], "k long, v string"), "k").collect())) == [(1, "m"), (1, "n"), (2, "b")]


def test_greedy_batches(spark):
    items = spark.createDataFrame([("g", i, f"f{i}", s) for i, s in enumerate([6000, 6000, 6000, 20000, 1])], "grp string, ord long, id string, size long")
    assert [r["batch"] for r in I.batches(items, "grp").orderBy("ord").collect()] == [0, 0, 1, 2, 3]


def test_related_findings_merge(spark):
    rows = [("a.ts", "circular-dep", "low", "t1", "d1", "s1", 0), ("a.ts", "god-module", "high", "t2", "d2", "s2", 1), ("a.ts", "coupling", "medium", "t3", "d3", "s1", 2), ("b.ts", "layering", "low", "t4", "d4", None, 3)]
    f = spark.createDataFrame(rows, "primary_file string, category string, severity string, title string, description string, suggestion string, ord long")
    got = {(r["primary_file"], r["merged"]): (r["severity"], r["description"], r["confidence"]) for r in D.merge_related(f).collect()}
    assert got[("a.ts", "coupling,circular-dep")] == ("medium", "d3 Additionally: d1", 1.0)  # the worst first
    assert got[("a.ts", "god-module")][0] == "high" and got[("b.ts", "layering")][2] == 1.0


def test_gap_answers(spark):
    texts = ['```json\n[{"title":"T","severity":"HIGH"},{"severity":"odd"}]\n```', "not json", "[]", None]
    got = D.parse_gaps(spark.createDataFrame([(t,) for t in texts], "response string")).collect()
    assert [(r["title"], r["severity"]) for r in got] == [("T", "high"), ("Untitled", "low")]


def test_markdown_sections(spark):
    md = "lost\n# A\none\n\n## B ##\n### C\nlast"
    got = T.markdown_sections(spark.createDataFrame([(1, md), (2, ""), (3, None)], "doc long, text string")).orderBy("section").collect()
    assert [(r["heading"], r["level"], r["content"]) for r in got] == [("A", 1, "one"), ("B ##", 2, ""), ("C", 3, "last")]


def test_token_budget_never_exceeds(spark):
    s = spark.createDataFrame([("a", 1, "x" * 40, 10), ("b", 2, "y" * 40, 10), ("c", 3, "z" * 40, 10)], "heading string, priority int, content string, tokens long")
    got = C.truncate(s, 15).orderBy("priority").collect()
    assert [r["heading"] for r in got] == ["a", "b"] and sum(r["tokens"] for r in got) == 15 and got[1]["truncated"]


@given(st.text(alphabet='{}[]",:ab1\\ ', max_size=40))
def test_balanced_json_parses_or_is_none(text):
    import json

    found = T.balanced_json(text)
    assert found is None or json.loads(found) is not None or found == "null"


def test_balanced_json_skips_prose():
    assert T.balanced_json('Sure: {"a": "}"} done') == '{"a": "}"}'


def test_templates(spark):
    df = spark.createDataFrame([("n", ""), ("m", "x")], "name string, extra string")
    got = [r[0] for r in df.select(T.fill_template("Hi {{name}}{{#if extra}} ({{extra}}){{/if}}!", {"name": F.col("name"), "extra": F.col("extra")})).collect()]
    assert got == ["Hi n!", "Hi m (x)!"]


def test_edit_ratio(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("", ""), ("abcd", ""), ("abcd", "abxd")], "a string, b string")
    assert [r[0] for r in df.select(I.edit_ratio(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0, 0.25]


def test_file_context(spark):
    frame = spark.createDataFrame
    changed = frame([(c, 1, f, f"src/{f}", 1.0) for c in range(12) for f in (1, 2)], "commit_id long, line long, file_id long, file_path string, lines_added double")
    args = dict(
        summaries=frame([("what it does", 1.0), ("its module", 0.9)], "content string, relevance double"),
        users=frame([("b", 2, None), ("a", 1, "sum")], "path string, depth int, summary string"), uses=frame([], "path string, depth int, summary string"),
        symbols=frame([("f(x)", "function"), (None, "class")], "signature string, kind string"), findings=frame([("low", "small"), ("critical", "big")], "severity string, content string"),
        commit_files=changed,
    )
    whole = {r.heading: r for r in A.file_context(1, **args).collect()}
    assert whole["File & Module Context"].content == "what it does\n\nits module"
    assert whole["Blast Radius (imported by)"].content == "**a** (depth 1)\nsum\n\n**b** (depth 2)"
    assert whole["Exported Symbols"].content == "`f(x)` (function)"
    assert whole["Findings"].content == "big\n\nsmall"
    assert whole["Change History"].content == "Co-changes with **src/2** (12 times)\n\nChanged 12 times (**hotspot**)"
    assert "Dependencies (imports)" not in whole and not any(r.truncated for r in whole.values())
    few = A.file_context(1, **args, budget=3).collect()
    assert [(r.heading, r.tokens, r.truncated) for r in few] == [("File & Module Context", 3, True)] and few[0].content == "what it does" + C.MARK


def test_change_context_of_a_module(spark):
    commits = spark.sql("SELECT id, concat('sha', id) AS sha, IF(id = 2, NULL, 'ann') AS author_name, TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(CAST(id AS INT)) AS committed_at, 'm' AS message FROM range(6)")
    changed = spark.sql("SELECT id AS commit_id, 1 AS line, id AS file_id, IF(id % 2 = 0, 'src/a/x', 'src/ab/x') AS file_path, 1.0 AS lines_added FROM range(6)")
    got = {r.heading: r.content for r in A.change_context(commits, changed, module="src/a", most=4).collect()}
    # the newest four are 2 to 5, of which 2 and 4 touch the module
    assert got == {"Recent Commits": "`sha4` m — ann (2024-01-05)\n\n`sha2` m (2024-01-03)", "Author Distribution": "ann: 1 commits\n\nunknown: 1 commits"}
    assert A.change_context(commits.limit(0), changed.limit(0), file_id=1).count() == 0


def test_document_chunks(spark):
    text = "## A\nbody\n### small\nx\n" + "y" * 20 + "\n### big \nz\n## B"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "#### no\n## C\n### c")], "doc long, text string")
    got = [tuple(r)[:1] + tuple(r)[2:] for r in T.document_chunks(rows, most=20).orderBy("doc", "chunk").collect()]
    assert got == [
        (1, "A", "A", "## A\nbody\n### small\nx\n" + "y" * 20), (1, "big", "A > big", "### big \nz"), (1, "B", "B", "## B"),
        (2, "Introduction", "Introduction", ""), (4, "Introduction", "Introduction", "#### no"), (4, "C", "C", "## C\n### c"),
    ]


def test_architecture_context(spark):
    frame = spark.createDataFrame
    told = frame([(1, "system", "system:purpose", "why"), (2, "system", "system:all", "how"), (3, "system", "system:late", "no"), (4, "intent", "intent", "why"), (5, "module", "module:src/a", "part a"), (6, "file", "file:x", "no")], "id long, level string, target_id string, content string")
    links = frame([("a", "b"), ("a", "c"), ("a", "b"), ("b", "b")], "source string, target string")
    found = frame([("high", "second"), ("critical", "first"), ("low", "no")], "severity string, content string")
    changed = frame([(1, 1, 1, "x", 1.0), (2, 1, 1, "x", 1.0)], "commit_id long, line long, file_id long, file_path string, lines_added double")
    got = {r.heading: r.content for r in A.architecture_context(told, links, found, changed).collect()}
    assert got == {
        "Purpose": "why", "System Architecture": "how", "Module Map": "**src/a**\npart a", "Inter-Module Dependencies": "a → b, c",
        "Critical Findings": "first\n\nsecond", "Change Hotspots": "**x** — 2 changes",
    }
    empty = A.architecture_context(told.limit(0), links.limit(0), found.limit(0), changed.limit(0)).collect()
    assert [(r.heading, r.content) for r in empty] == [("Inter-Module Dependencies", "No cross-module dependencies detected.")]
