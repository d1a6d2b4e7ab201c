"""Three levels of summaries against a plain fold: reuse after edits, dirty sets, budgets, failing batches."""

import hashlib

from codestrata.operators import rollup as R

ROWS = "path string, target_id string, input_hash string, content string"
SUMMARY = "level string, target_id string, input_hash string, content string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def project(edit=None):
    rows = []
    for i, n in enumerate([1, 2, 7, 3, 12, 4, 1]):
        path = ["top.ts", "a/x.ts", "a/y.ts", "a/b/z.ts", "a/b/big.ts", "c/k.ts", "c/l:1.ts"][i]
        for k in range(n):
            text = f"the symbol {k} of the file does a thing of its own {i}"
            text = edit.get((path, k), text) if edit else text
            rows.append((path, f"{path}:s{k:02}:function", sha(text), text))
    return rows


def run(spark, tmp_path, rows, previous=(), ask=R.digest_model, budget=1e9, name="1", dirty=None):
    prev = spark.createDataFrame(list(previous), SUMMARY)
    d = spark.createDataFrame([(p,) for p in dirty], "path string") if dirty is not None else None
    got = R.rollup(spark.createDataFrame(rows, ROWS), prev, str(tmp_path / name), budget, ask, dirty=d).collect()
    assert len({r["target_id"] for r in got}) == len(got)
    return {r["target_id"]: r for r in got}


def after(rows, got):
    return [("function", t, h, c) for _, t, h, c in rows] + [(r["level"], r["target_id"], r["input_hash"], r["content"]) for r in got.values()]


def plain(rows):
    """All three levels by the digest model, nothing reused."""
    files = {}
    for path, target, _, text in rows:
        files.setdefault(path, []).append(f"- {target}: {text}")
    told = {f"file:{p}": sha(f"Summarise the following file based on its symbol summaries:\n\nFile: {p}\n\n" + "\n".join(sorted(x))) for p, x in files.items()}
    return told


def above(told):
    modules = {}
    for target, text in sorted(told.items()):
        folder = target[5:].rpartition("/")[0]
        if folder:
            modules.setdefault(folder, []).append(f"- {target}: {text}")
    m = {f"module:{p}": sha(f"Summarise the following module based on its file summaries:\n\nModule: {p}\n\n" + "\n".join(x)) for p, x in modules.items()}
    s = {"system:project": sha("Summarise the following system based on its module summaries:\n\nProject: project\n\n" + "\n".join(f"- {t}: {c}" for t, c in sorted(m.items())))}
    return told | m | s


def test_second_run_after_edits(spark, tmp_path):
    rows = project()
    first = run(spark, tmp_path, rows)
    assert {t: r["content"] for t, r in first.items()} == above(plain(rows)) and not any(r["reused"] for r in first.values())
    same = run(spark, tmp_path, rows, after(rows, first), name="2", ask=None)  # nothing is asked
    assert all(r["reused"] for r in same.values()) and {t: r["content"] for t, r in same.items()} == {t: r["content"] for t, r in first.items()}
    # one symbol of twelve is under a tenth, a full stop is no edit; one of two counts
    edited = project({("a/b/big.ts", 0): "#" * 50, ("c/k.ts", 1): "the symbol 1 of the file does a thing of its own 5.", ("a/x.ts", 1): "?" * 50})
    third = run(spark, tmp_path, edited, after(rows, first), name="3")
    want = above(plain(rows) | {"file:a/x.ts": plain(edited)["file:a/x.ts"]})
    assert {t: r["content"] for t, r in third.items()} == want
    assert {t for t, r in third.items() if not r["reused"]} == {"file:a/x.ts", "module:a", "system:project"}


def test_dirty_sets(spark, tmp_path):
    rows = project()
    first = run(spark, tmp_path, rows)
    edited = project({("a/x.ts", 0): "?" * 50, ("c/k.ts", 0): "!" * 50})
    second = run(spark, tmp_path, edited, after(rows, first), name="2", dirty=["c/k.ts", "a/y.ts"])
    assert {t for t, r in second.items() if not r["reused"]} == {"file:c/k.ts", "module:c", "system:project"}
    none = run(spark, tmp_path, edited, after(rows, first), name="3", dirty=[], ask=None)
    assert all(r["reused"] for r in none.values()) and len(none) == len(first)


def test_a_failing_batch_is_asked_file_by_file(spark, tmp_path):
    def ask(prompt):
        if prompt.startswith(R.BATCH) or "File: c/k.ts" in prompt:
            raise TimeoutError("too much")
        return R.digest_model(prompt)[0], 0.5
    rows = project()
    got = run(spark, tmp_path, rows, ask=ask)
    told = plain(rows)
    del told["file:c/k.ts"]
    assert {t: r["content"] for t, r in got.items()} == above(told)
    assert sum(r["cost"] for r in got.values()) == 0.5 * len(got)


def test_budget(spark, tmp_path):
    """A wave asks what there is, so 1.5 pays for the batch and both large files, and for nothing after them."""
    old = [("system", "system:project", "x", "old words")]
    def ask(prompt):
        return R.digest_model(prompt)[0], 1.0
    nothing = run(spark, tmp_path, project(), old, ask=ask, budget=0.0)
    assert [tuple(r)[:4] for r in nothing.values()] == old
    got = run(spark, tmp_path, project(), old, ask=ask, budget=1.5, name="2")
    assert {t: r["content"] for t, r in got.items()} == plain(project()) | {"system:project": "old words"} and sum(r["cost"] for r in got.values()) == 3.0


def test_empty(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}
