"""Sources, extractors and streams on fixtures of our own."""

import subprocess

from codestrata.functions import code as K
from codestrata.operators import resolve as R
from codestrata.sources import config, files, gitlog
from codestrata.streaming import events as S

TS = '''/** Says hello. */
export function hello(name: string) {
  if (name && name.length) { return "a ? b : c"; }
  return null;
}
// plain
export const twice = (x: number) => x * 2;
class Inner { run() {} }
export interface Shape { a: string }
export type Id = string;
export enum Color { Red }
import { x } from "./lib.js";
export * from "./more";
const y = require("./late");
'''
PY = '"""Module."""\nimport os\nfrom . import a\n\n\ndef _hid(x):\n    """Doc."""\n    return x and 1 or 2\n\n\nclass Big:\n    pass\n'


def test_symbols():
    got = {(k, n): (a, b, x, d) for k, n, a, b, x, d, _ in K.symbols(TS, "typescript")}
    assert got[("function", "hello")] == (2, 5, True, None) and got[("function", "twice")][2]
    assert not got[("class", "Inner")][2] and {("interface", "Shape"), ("type", "Id"), ("enum", "Color"), ("import", "./lib.js"), ("export", "./more")} <= set(got)
    py = {(k, n): x for k, n, _, _, x, *_ in K.symbols(PY, "python")}
    assert py == {("import", "import os"): False, ("import", "."): False, ("function", "_hid"): False, ("class", "Big"): True}
    assert K.symbols("def (", "python") == []
    cs = K.symbols("using System.Text;\npublic class A {\n  private int F(int x) { return x; }\n}\n", "c_sharp")
    assert [(s[0], s[1], s[4]) for s in cs] == [("import", "System.Text", False), ("class", "A", True), ("function", "F", False)]


def test_imports_and_complexity():
    assert K.imports(TS, "typescript") == [("import", "./lib.js"), ("import", "./more"), ("call", "./late")]
    assert K.imports("import os.path as p, sys\nfrom .a import b", "python") == [("import", "os.path"), ("import", "sys"), ("import", ".a")]
    assert K.complexity(TS, "typescript") == 3 and K.complexity(PY, "python") == 3 and K.complexity("", "typescript") == 1


def test_comments_and_header():
    got = K.comments(TS, "typescript")
    assert [(c[0], c[1]) for c in got] == [("jsdoc", "Says hello."), ("line", "plain")] and K.file_header(got) == "Says hello."
    assert K.comments("/// one\n/// two\nint x;", "c_sharp") == [("xml-doc", "one\ntwo", 1, 2)]
    assert K.file_header(K.comments("# a\n# b\n\n# c", "python")) == "a\nb"


def test_scan_and_extract(spark, tmp_path):
    for name, text in {"src/a.ts": TS, "src/lib.ts": "export const x = 1;\n", "src/more/index.ts": " ", "node_modules/z/i.js": "1", "big.ts": "x" * 200, "README.md": "# R"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.scan(spark, str(tmp_path), files.ScanConfig(max_bytes=1000))
    got = {r["path"]: (r["language"], r["line_count"], r["is_doc"]) for r in found.collect()}
    assert got == {"src/a.ts": ("typescript", 15, False), "src/lib.ts": ("typescript", 2, False), "src/more/index.ts": ("typescript", 1, False), "big.ts": ("typescript", 1, False), "README.md": (None, 1, True)}
    imports = K.extract(found, "imports").selectExpr("path as source_file", "specifier")
    resolved = {(r["specifier"]): r["target_file"] for r in R.resolve_imports(imports, found).collect()}
    assert resolved == {"./lib.js": "src/lib.ts", "./more": "src/more/index.ts", "./late": None}


def test_git_log(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.txt").write_text("1\n2\n3\n4\n5\n6\n")
    git("add", ".")
    git("commit", "-qm", "Fix #7\n\nbody")
    git("mv", "d/x.txt", "d/y.txt")
    git("commit", "-qm", "move")
    log = gitlog.dump(str(tmp_path))
    got = gitlog.parse(spark.createDataFrame([(log,), (f"junk{gitlog.COMMIT}a{gitlog.FIELD}b",)], "value string")).collect()
    assert [(r["message"], [(f["path"], f["change_type"], f["lines_added"]) for f in r["files"]]) for r in got] == [("move", [("d/y.txt", "rename", 0)]), ("Fix #7\n\nbody", [("d/x.txt", "modify", 6)])]


def test_rename_keeps_the_head_of_the_path(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("src/{a => b}/c.ts",), ("old.ts => new.ts",), ("src/{ => x}/c.ts",), ("p.ts",)], "p string")
    assert [r[0] for r in df.select(gitlog.new_path(F.col("p"))).collect()] == ["src/b/c.ts", "new.ts", "src/x/c.ts", "p.ts"]


def test_settings():
    got = config.settings({"a": {"b": 1, "c": [1, 2]}, "d": 1}, {"a": {"c": [3]}}, {"d": 2}, env={"CODESTRATA_A__B": "9", "OTHER": "x"})
    assert got == {"a": {"b": "9", "c": [3]}, "d": 2}


def test_namespaces_and_modules(spark):
    declared = spark.createDataFrame([("A.B", "1.cs"), ("A.B", "2.cs"), ("A.C.D", "3.cs")], "namespace string, path string")
    usings = spark.createDataFrame([("1.cs", "A.B"), ("1.cs", "A.C"), ("1.cs", "Z")], "source_file string, namespace string")
    assert {(r["namespace"], r["target_file"]) for r in R.resolve_namespaces(usings, declared).collect()} == {("A.B", "2.cs"), ("A.C", "3.cs")}
    f = spark.createDataFrame([("a/b/c.ts",), ("x/y.ts",), ("top.ts",)], "path string")
    m = spark.createDataFrame([("a",), ("a/b",)], "module string")
    assert {r["path"]: r["module"] for r in R.nearest_module(f, m).collect()} == {"a/b/c.ts": "a/b", "x/y.ts": "x", "top.ts": "general"}
    assert {(r["module"], r["inner"]) for r in R.submodules(m).collect()} == {("a", "a"), ("a", "a/b"), ("a/b", "a/b")}
    q = spark.createDataFrame([(0, "b/c.ts"), (1, "a/b/c.ts"), (2, "none.ts")], "ord long, mention string")
    assert [(r["path"], r["ord"]) for r in R.match_mentions(q, f).collect()] == [("a/b/c.ts", 0)]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    batch.write.parquet(str(tmp_path / "in/e"))
    got = S.run_available(spark, str(tmp_path / "in/e"), S.counts, batch.schema, "stream_counts", str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.counts(batch).collect()))
    logs = spark.createDataFrame([('{"level":"warn","msg":"[db] slow","taskId":"1"}',), ("bad",), ('{"msg":"plain text"}',)], "value string")
    parsed = S.parse_logs(logs)
    assert sorted((r["level"], r["component"]) for r in parsed.collect()) == [("info", "app"), ("warn", "db")] and S.filter_logs(parsed, ["warn"], "db", "1", "SLOW").count() == 1
