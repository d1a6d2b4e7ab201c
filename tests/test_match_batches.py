"""Containment of many patterns, term search, greedy batches over tasks, paths in nested evidence: brute force."""

import random

from pyspark.sql import functions as F

from codestrata.operators import detectors as D
from codestrata.operators import incremental as I
from codestrata.operators import match as M


def test_containing_is_brute_force(spark):
    rng = random.Random(3)
    folders = ["src/" + "/".join(rng.choice(("core", "app", "ui", "db")) for _ in range(rng.randrange(1, 4))) for _ in range(20)]
    patterns = [f"{rng.choice(folders)}/{rng.choice('abc')}{i}.ts" for i in range(400)] + ["a", "ts", "src/", "", "core/app", "aaaaaaaaaaaa", "aaaaaaaa", "日本語", "日本語のファイル名.ts"]
    texts = [" ".join(rng.choice(patterns) + rng.choice(("", "x", '"')) for _ in range(rng.randrange(5))) for _ in range(300)] + ["a" * 50, "", "日本語のファイル名.tsx"]
    got = M.containing(spark.createDataFrame([*enumerate(texts), (999, None)], "id long, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(i, p) for i, t in enumerate(texts) for p in set(patterns) if p and p in t}


def test_a_hundred_thousand_paths(spark):
    paths = spark.range(100_000).select(F.concat(F.lit("packages/core/src/module"), (F.col("id") % 500).cast("string"), F.lit("/file"), F.col("id").cast("string"), F.lit(".ts")).alias("pattern"))
    texts = spark.range(300).select("id", F.concat(F.lit('[{"filePath": "packages/core/src/module'), (F.col("id") * 7 % 500).cast("string"), F.lit("/file"), (F.col("id") * 7).cast("string"), F.lit('.ts"}]')).alias("text"))
    got = M.containing(texts, paths)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"packages/core/src/module{i * 7 % 500}/file{i * 7}.ts") for i in range(300)]


def test_no_patterns_and_no_texts(spark):
    none, one = spark.createDataFrame([], "pattern string"), spark.createDataFrame([(1, "x")], "id long, text string")
    assert M.containing(one, none).count() == 0 and M.containing(one.limit(0), spark.createDataFrame([("x",)], "pattern string")).count() == 0


def test_term_hits_are_those_of_a_scan(spark):
    rng = random.Random(4)
    docs = [(f"d{i:03}", " ".join("".join(rng.choice("abÉ") for _ in range(rng.randrange(1, 5))) for _ in range(8))) for i in range(150)]
    terms = ["a", "ab", "aba", "abab", "ÉA", "b a", "bbb b", "zzz", ""]
    df, t = spark.createDataFrame(docs, "path string, content string"), spark.createDataFrame([(x,) for x in terms], "term string")
    want = {(x.lower(), p) for x in terms if x for p, c in docs if x.lower() in c.lower()}
    assert {tuple(r) for r in M.term_hits(M.postings(df), df, t).collect()} == want
    first = {(x, p) for x in {w[0] for w in want} for p in sorted(p for y, p in want if y == x)[:5]}
    assert {tuple(r) for r in M.term_hits(M.postings(df), df, t, each=5).collect()} == first


def fold(sizes, largest, chars):
    out, no, count, total = [], 0, 0, 0
    for s in sizes:
        if count and (count >= largest or total + s > chars):
            no, count, total = no + 1, 0, 0
        count, total = count + 1, total + s
        out.append(no)
    return out


def test_batches_are_the_fold(spark, monkeypatch):
    rng = random.Random(5)
    for piece, largest in ((4096, 10), (3, 4), (1, 3), (7, 10)):
        monkeypatch.setattr(I, "PIECE", piece)
        rows = [(g, i, i, rng.choice((0, 10, 300, 5000, 20000))) for g in (None, "a", "b", "c") for i in range(rng.choice((1, 40, 300)))]
        got = {(r["grp"], r["ord"]): r["batch"] for r in I.batches(spark.createDataFrame(rows, "grp string, ord long, id long, size long").repartition(6), "grp", largest, 12000).collect()}
        want = {}
        for g in (None, "a", "b", "c"):
            own = [r for r in rows if r[0] == g]
            want |= {(g, r[1]): b for r, b in zip(own, fold([r[3] for r in own], largest, 12000), strict=True)}
        assert got == want
    assert I.batches(spark.createDataFrame([], "grp string, ord long, id long, size long"), "grp").count() == 0


def test_batches_of_one_large_group(spark):
    n = 200_000
    items = spark.range(n).select(F.lit("g").alias("grp"), F.col("id").alias("ord"), "id", (F.col("id") * 7919 % 6001).alias("size"))
    got = I.batches(items, "grp").toPandas().sort_values("ord")["batch"].tolist()
    assert got == fold([i * 7919 % 6001 for i in range(n)], 10, 16000)


def test_primary_files(spark):
    cases = [('[{"n": 1}, {"n": 2}, {}, {}, {}, {}, {}, {}, {"path": "ninth"}]', "ninth"), ('[[["x"]], [[{"file": "deep"}]]]', "deep"), ('[{"a": {"path": "no"}}]', None), ('{"a": [{"path": "no"}]}', None), ('{"filePaths": ["p", "q"]}', "p"), ('[{"filePaths": [1, "q"]}, {"path": "z"}]', "z"), ('[{"path": "a\\"b}"}]', 'a"b}'), ("[]", None), ("not json", None), ("[{", None), (None, None), ("3", None)]
    got = [r[0] for r in spark.createDataFrame([(c[0], i) for i, c in enumerate(cases)], "e string, i int").orderBy("i").select(D.primary_file(F.col("e"))).collect()]
    assert got == [c[1] for c in cases]


def test_long_texts_in_spans(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(M, "SPAN", 40)
    texts = ["".join(rng.choice("ab\U0001f600é") for _ in range(rng.randrange(400))) for _ in range(60)]
    patterns = ["a", "ab", "é\U0001f600", *(t[i : i + n] for t in texts[:20] for i, n in ((3, 8), (30, 9), (35, 60), (10, 25))), "b" * 200]
    df, p = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"), spark.createDataFrame([(x,) for x in patterns], "pattern string")
    got = [tuple(r) for r in M.containing(df, p).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, x) for i, t in enumerate(texts) for x in set(patterns) if x and x in t}


def test_only_parts_that_may_be_patterns_leave_the_texts(spark):
    texts = spark.range(400).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(200)), lambda x: F.md5((x * 1000 + F.col("id")).cast("string")))).alias("text")).cache()
    patterns = spark.createDataFrame([("no such word",), ("nor",), ("zzzzzzzz",)], "pattern string")
    got = M.containing(texts, patterns)
    assert got.count() == 0
    plan = got._jdf.queryExecution().executedPlan()
    seen, rows = [plan], 0
    while seen:
        node = seen.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            seen.append(node.executedPlan())
        if "QueryStage" in node.nodeName():
            seen.append(node.plan())
        if node.nodeName() == "Generate" and node.metrics().contains("numOutputRows"):
            rows = max(rows, node.metrics().apply("numOutputRows").value())
        kids = node.children()
        seen += [kids.apply(i) for i in range(kids.size())]
    assert rows < 10_000  # a key for every part would be over two million


def test_batches_of_a_group_that_begins_with_small_items(spark, monkeypatch):
    monkeypatch.setattr(I, "PIECE", 50)
    sizes = [1 + i % 3 for i in range(400)]  # no batch is full by size
    items = spark.createDataFrame([("g", i, i, s) for i, s in enumerate(sizes)], "grp string, ord long, id long, size long")
    got = I.batches(items, "grp").orderBy("ord").collect()
    assert [r["batch"] for r in got] == fold(sizes, 10, 16000) and [r["size"] for r in got] == sizes


def test_objects_of_evidence_by_pattern_and_fold_agree(spark):
    """What the pattern reaches equals the fold, deeper texts are folded, and a long text needs no deep stack."""
    cases = ['[]', '["{", "}", {"a": "}{"}]', '[{"a": {"b": {"c": 1}}}, {"d": 2}]', '[{"a": {"b": {"c": {"e": "{"}}}}, [[{"d": "\\""}]]]', '[{"n": "\\\\"}, {"p": "\\"}{"}]', '["a\nb", {"x": "line\nline"}]', "[" + '{"n": "]"}, ' * 20_000 + "{}]"]
    df = spark.createDataFrame([(c,) for c in cases], "e string")
    for row in df.select(D._objects_in(F.col("e")).alias("a"), D._folded_objects(F.col("e")).alias("b"), F.regexp_replace("e", D._OBJECTS, "").alias("rest"), F.col("e")).where("length(e) < 1000").collect():
        assert row["a"] == row["b"]
        assert ("{" in row["rest"]) == ('"c": {' in row["e"])
    assert df.where("length(e) > 1000").select(F.size(D._objects_in(F.col("e")))).first()[0] == 20_001
    escaped = spark.createDataFrame([('[{"n": 1}, {"\\u0070ath": "found"}]',)], "e string")
    assert escaped.select(D.primary_file(F.col("e"))).first()[0] == "found"
