"""Extractors from source text: comments, symbols, imports, complexity (K1-K13), as one pass over files."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from codestrata.functions import parse
from codestrata.functions.parse import Declaration

Comment = tuple[str, str, int, int]


def _block_comments(lines: list[str], opener: str, closer: str, kind: str) -> Iterator[Comment]:
    i = 0
    while i < len(lines):
        s = lines[i].strip()
        if s.startswith(opener) and not (opener == "/*" and s.startswith("/**")):
            body, end = [s[len(opener) :]], i
            while closer not in body[-1] and end + 1 < len(lines):
                end += 1
                body.append(lines[end].strip())
            body[-1] = body[-1].split(closer)[0]
            text = "\n".join(re.sub(r"^\*\s?", "", b).strip() for b in body).strip()
            if text:
                yield kind, text, i + 1, end + 1
            i = end
        i += 1


def comments(text: str, language: str | None) -> list[Comment]:
    """(kind, text, first line, last line) of the comments that start a line, in order."""
    lines = text.split("\n")
    found: list[Comment] = []
    if language == "python":
        for quote in ('"""', "'''"):
            found += _block_comments(lines, quote, quote, "docstring")
        found += [("line", s[1:].strip(), i, i) for i, s in enumerate((x.strip() for x in lines), 1) if s.startswith("#") and not s.startswith("#!") and s[1:].strip()]
    else:
        found += _block_comments(lines, "/**", "*/", "jsdoc")
        found += _block_comments(lines, "/*", "*/", "block")
        run: list[tuple[int, str]] = []
        for i, s in enumerate((*(x.strip() for x in lines), ""), 1):
            if language == "c_sharp" and s.startswith("///"):
                run.append((i, s[3:].strip()))
                continue
            if run:
                found.append(("xml-doc", "\n".join(t for _, t in run), run[0][0], run[-1][0]))
                run = []
            if s.startswith("//") and s[2:].strip():
                found.append(("line", s[2:].strip(), i, i))
    return sorted(found, key=lambda c: (c[2], c[3]))


def file_header(found: list[Comment]) -> str | None:
    """The first comment if it starts in the first three lines; line comments that follow each other are one."""
    if not found or found[0][2] > 3:
        return None
    text, last = found[0][1], found[0][3]
    for c in found[1:]:
        if found[0][0] != "line" or c[0] != "line" or c[2] != last + 1:
            break
        text, last = f"{text}\n{c[1]}", c[3]
    return text


def _python(text: str) -> list[Declaration]:
    """Functions, classes and imports of Python in order; of a broken file what its parts give that parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _python_parts(text)
    lines, out = text.split("\n"), []

    def walk(node: ast.AST) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.append(_python_definition(n, text, lines))
            elif isinstance(n, ast.Import):
                out.append(Declaration("import", ast.get_source_segment(text, n) or "", n.lineno, n.end_lineno or n.lineno, False, None, ast.get_source_segment(text, n)))
            elif isinstance(n, ast.ImportFrom) and n.module != "__future__":
                out.append(Declaration("import", "." * n.level + (n.module or ""), n.lineno, n.end_lineno or n.lineno, False, None, ast.get_source_segment(text, n)))
            walk(n)

    walk(tree)
    return sorted(out, key=lambda d: (d.start_line, -d.end_line))


def _python_definition(n: ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef, text: str, lines: list[str]) -> Declaration:
    first = n.body[0]
    doc = None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        raw = ast.get_source_segment(text, first.value) or ""
        doc = re.sub(r"(?:\"\"\"|'''|\"|')$", "", re.sub(r"^(?:\"\"\"|'''|\"|')", "", raw)).strip()
    # the head is what stands before the body, without its colon
    head = "\n".join([lines[n.lineno - 1].encode()[n.col_offset :].decode(), *lines[n.lineno : first.lineno]])
    at = re.match(r"(?:async\s+)?(?:def|class)\s+\w+\s*(?:\[[^\]]*\])?", head)
    rest, params = head[at.end() :] if at else "", ""
    if rest.startswith("("):
        depth, i, quote = 0, 0, ""
        while i < len(rest):
            c = rest[i]
            if quote:
                i += c == "\\"
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            depth += (c in "([{") - (c in ")]}") if not quote else 0
            i += 1
            if not depth:
                break
        params = rest[:i]
    kind = "class" if isinstance(n, ast.ClassDef) else "function"
    returns = f" -> {ast.get_source_segment(text, n.returns)}" if kind == "function" and n.returns else ""
    return Declaration(kind, n.name, n.lineno, n.end_lineno or n.lineno, not n.name.startswith("_"), doc, f"{'class' if kind == 'class' else 'def'} {n.name}{params}{returns}")


def _python_parts(text: str) -> list[Declaration]:
    """A broken file cut where a line begins at the margin: the parts that parse, and the first lines of those that don't."""
    lines, out = text.split("\n"), []
    cuts = [i for i, x in enumerate(lines) if x[:1].strip() and not x.startswith((")", "]", "}", "#", "else", "elif", "except", "finally"))]
    for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True):
        part = "\n".join(lines[a:b])
        try:
            ast.parse(part)
        except (SyntaxError, ValueError, RecursionError):
            if m := re.match(r"(?:async\s+)?(?P<k>def|class)\s+(?P<n>\w+)", part):
                last = max((i for i in range(a, b) if lines[i].strip()), default=a)
                out.append(Declaration("class" if m["k"] == "class" else "function", m["n"], a + 1, last + 1, not m["n"].startswith("_"), None, f"{m['k']} {m['n']}"))
            continue
        out += [d._replace(start_line=d.start_line + a, end_line=d.end_line + a) for d in _python(part)]
    return out


def symbols(text: str, language: str | None) -> list[Declaration]:
    """(kind, name, first line, last line, exported, docstring, signature) in order (K1-K5)."""
    return _python(text) if language == "python" else parse.sharp(text) if language == "c_sharp" else parse.script(text)


_CALLS = re.compile(r"\b(?:import|require)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")


def imports(text: str, language: str | None) -> list[tuple[str, str]]:
    """(kind, specifier): import for declarations and re-exports, call for import() and require() anywhere (K6)."""
    if language == "python":  # each name of a declaration is a dependency of its own
        names = (re.findall(r"[\w.]+", re.sub(r"\s+as\s+\w+", "", d.name.removeprefix("import "))) if d.name.startswith("import ") else [d.name] for d in symbols(text, language) if d.kind == "import")
        return [("import", x) for own in names for x in own]
    out = [("import", d.name) for d in symbols(text, language) if d.kind in ("import", "export")]
    return out + ([("call", x) for x in _CALLS.findall(text)] if language != "c_sharp" else [])


def complexity(text: str, language: str | None) -> int:
    """1 and the number of decisions outside strings and comments (K7)."""
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return 1
        kinds = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)
        return 1 + sum(isinstance(n, kinds) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(tree))
    return parse.decisions(text, language == "c_sharp")


def extract(files: DataFrame, what: str) -> DataFrame:
    """Rows of ``what`` (comments, symbols, imports, complexity) for files (path, content, language)."""
    schemas = {
        "comments": "path string, kind string, text string, start_line int, end_line int",
        "symbols": "path string, kind string, name string, start_line int, end_line int, exported boolean, docstring string, signature string",
        "imports": "path string, kind string, specifier string",
        "complexity": "path string, complexity int",
    }
    read = {"comments": comments, "symbols": symbols, "imports": imports, "complexity": lambda t, lang: [(complexity(t, lang),)]}[what]
    names = [c.split()[0] for c in schemas[what].split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *r) for p, c, lang in zip(b["path"], b["content"], b["language"], strict=True) for r in read(c or "", lang)], columns=names)

    return files.select("path", "content", "language").mapInPandas(rows, schemas[what])
