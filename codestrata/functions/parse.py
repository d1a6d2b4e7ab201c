"""Declarations and decisions of TypeScript, JavaScript and C# sources: a lexer with state, and a nesting parser that recovers.

The lexer knows strings, template literals with nested code, regular expressions by what stands before them, comments and
C#'s verbatim, raw and interpolated strings; unclosed ones end with their line or file.  Brackets are matched once, a
closing one without a partner is left out and an open one reaches to the end of the file, so broken files still give
the declarations around the damage.  Columns of a declaration are kind, name, lines, exported, docstring, signature.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, number, string, regex, punct, comment
    text: str
    start: int
    line: int


class Declaration(NamedTuple):
    kind: str
    name: str
    start_line: int
    end_line: int
    exported: bool
    docstring: str | None
    signature: str | None


_WORD = r"[@#]?[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"
_NUMBER = r"\d[\w.]*"
_OPERATORS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|::|->|[^\s]"
_COMMENT = r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)"
_SCRIPT = re.compile(rf"(?P<comment>{_COMMENT})|(?P<string>\"(?:\\(?s:.)|[^\"\\\n])*\"?|'(?:\\(?s:.)|[^'\\\n])*'?)|(?P<tick>`)|(?P<word>{_WORD})|(?P<number>{_NUMBER})|(?P<punct>{_OPERATORS})")
_SHARP = re.compile(rf"(?P<comment>{_COMMENT}|^[ \t]*#[^\n]*)|(?P<string>\$*(?P<raw>\"\"\"+)(?s:.*?)(?:(?P=raw)|\Z)|\$?@\$?\"(?:\"\"|[^\"])*\"?|\$?\"(?:\\(?s:.)|[^\"\\\n])*\"?|'(?:\\(?s:.)|[^'\\\n])*'?)|(?P<word>{_WORD})|(?P<number>{_NUMBER})|(?P<punct>{_OPERATORS})", re.M)
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_TEMPLATE = re.compile(r"(?:\\(?s:.)|\$(?!\{)|[^`\\$])*(?P<end>`|\$\{|\Z)")
#: Words after which a slash begins a regular expression and a value is expected.
_BEFORE_VALUE = frozenset("return typeof case in of new delete void throw instanceof await yield else do extends default".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def lex(text: str, sharp: bool = False) -> list[Token]:
    """Tokens in order, comments among them."""
    out: list[Token] = []
    at, line, counted = 0, 1, 0
    #: for each template literal around: how many braces are open in its code
    depths: list[int] = []
    last: Token | None = None
    master = _SHARP if sharp else _SCRIPT

    def add(kind: str, start: int, end: int) -> Token:
        nonlocal line, counted
        line += text.count("\n", counted, start)
        counted = start
        out.append(Token(kind, text[start:end], start, line))
        return out[-1]

    def template(start: int) -> int:
        m = _TEMPLATE.match(text, start)
        if m["end"] == "${":
            depths.append(0)
        return m.end()

    while m := master.search(text, at):
        kind, start, end = m.lastgroup if m.lastgroup != "raw" else "string", m.start(), m.end()
        here = m[0]
        if kind == "tick":
            end = template(end)
            last = add("string", start, end)
        elif kind == "punct" and depths and here == "}" and depths[-1] == 0:
            depths.pop()
            end = template(end)
            last = add("string", start, end)
        else:
            if not sharp and here in ("/", "/=") and (last is None or last.kind == "punct" and last.text not in (")", "]", "}") or last.kind == "word" and last.text in _BEFORE_VALUE) and (r := _REGEX.match(text, start)):
                kind, end = "regex", r.end()
            elif depths and here in "{}":
                depths[-1] += 1 if here == "{" else -1
            token = add(kind, start, end)
            last = last if kind == "comment" else token
        at = end
    return out


class Source:
    """Tokens without comments, the bracket that closes each, and the comment right before each."""

    def __init__(self, text: str, sharp: bool = False) -> None:
        self.text, self.tokens, self.note, self.shut = text, [], {}, {}
        comment = None
        for t in lex(text, sharp):
            if t.kind == "comment":
                comment = t.text
                continue
            if comment is not None:
                self.note[len(self.tokens)] = comment
                comment = None
            self.tokens.append(t)
        open_: list[int] = []
        self.parent = [-1] * len(self.tokens)
        for i, t in enumerate(self.tokens):
            if t.kind == "punct" and t.text in _CLOSE:
                same = next((k for k in range(len(open_) - 1, -1, -1) if _OPEN[self.tokens[open_[k]].text] == t.text), None)
                if same is not None:
                    for j in open_[same:]:
                        self.shut[j] = i
                    del open_[same:]
            self.parent[i] = open_[-1] if open_ else -1
            if t.kind == "punct" and t.text in _OPEN:
                open_.append(i)

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind in ("word", "punct")

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def after(self, i: int) -> int:
        """The token after the brackets that open at i."""
        return self.shut.get(i, len(self.tokens) - 1) + 1

    def line_of_end(self, i: int) -> int:
        t = self.tokens[min(i, len(self.tokens) - 1)]
        return t.line + t.text.count("\n")

    def span(self, i: int, j: int) -> str:
        """The text from token i to token j, both included."""
        last = self.tokens[min(j, len(self.tokens) - 1)]
        return self.text[self.tokens[i].start : last.start + len(last.text)]

    def past_angles(self, i: int) -> int:
        """The token after type arguments that open at i, or i."""
        if not self.is_(i, "<"):
            return i
        depth, j = 0, i
        while j < len(self.tokens):
            s = self.tokens[j].text if self.tokens[j].kind == "punct" else ""
            depth += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(s, 0)
            if depth <= 0:
                return j + 1
            if s in (";", "{") and not (s == "{" and j in self.shut):
                return i
            j = self.after(j) if s in _OPEN else j + 1
        return i


def _told(comment: str | None) -> str | None:
    """A comment without its marks."""
    if comment is None:
        return None
    if comment.startswith("//"):
        return comment[2:].strip()
    inner = re.sub(r"\s*\*/$", "", re.sub(r"^/\*\*?\s*", "", comment))
    return (re.sub(r"(?m)^\s*\* ?", "", inner) if comment.startswith("/**") else inner).strip()


#: Punctuation and words after which no statement begins.
_CONTINUES = frozenset("= ( , [ => : ? . ?. && || ?? ! & | ^ ~ + - * / % ** < > <= >= == != === !== += -= *= /= ... ??= &&= ||=".split())
_DECLARES = frozenset("function class interface type enum import export const let var abstract declare namespace module return if for while switch throw try".split())


def _begins(s: Source, i: int) -> bool:
    """Whether a statement may begin at token i."""
    if i == 0:
        return True
    before = s.tokens[i - 1]
    if before.kind == "punct":
        return before.text not in _CONTINUES
    return before.kind != "word" or before.text not in _BEFORE_VALUE or before.text in ("else", "do", "default")


def _end_of_statement(s: Source, i: int) -> int:
    """The last token of the statement that goes on at i: a semicolon, or where a line ends and another statement begins."""
    home = s.parent[i]
    while i < len(s.tokens):
        t = s.tokens[i]
        if t.kind == "punct" and t.text == ";":
            return i
        if t.kind == "punct" and t.text in _CLOSE and s.shut.get(home) == i:
            return i - 1
        j = s.after(i) if t.kind == "punct" and t.text in _OPEN else i + 1
        if j >= len(s.tokens):
            return len(s.tokens) - 1
        last, following = s.tokens[j - 1], s.tokens[j]
        ends = last.kind in ("number", "string", "regex") or last.kind == "word" and last.text not in _BEFORE_VALUE or last.text in _CLOSE
        more = following.kind == "punct" and following.text not in ("{", "}", "++", "--", "@", "#", "~") or following.kind == "word" and following.text in ("in", "of", "instanceof", "as", "satisfies", "extends")
        if ends and following.line > s.line_of_end(j - 1) and not more:
            return j - 1
        i = j
    return len(s.tokens) - 1


def _type_end(s: Source, i: int, stops: tuple[str, ...]) -> int:
    """The token before a type annotation's end, at one of ``stops`` outside brackets."""
    first = i
    while i < len(s.tokens):
        t = s.tokens[i]
        # an object type stands where a type may begin; elsewhere a brace is the body
        if t.kind == "punct" and t.text in stops and not (t.text == "{" and (i == first or s.is_(i - 1, "|", "&", ":", "=>", "is"))):
            break
        if t.kind == "punct" and (t.text in (";", ",") or t.text in _CLOSE):
            break
        i = s.past_angles(i) if t.text == "<" and s.past_angles(i) > i else s.after(i) if t.kind == "punct" and t.text in _OPEN else i + 1
    return i - 1


def _function_at(s: Source, i: int) -> tuple[str | None, str | None, int] | None:
    """(parameters, return annotation, token of the body's first brace or of the arrow) of an arrow function or function expression at i."""
    if s.is_(i, "async") and not s.is_(i + 1, "=>"):
        i += 1
    if s.is_(i, "function"):
        i += 1
        if s.is_(i, "*"):
            return None
        i = s.past_angles(i + 1 if s.word(i) else i)
        if not s.is_(i, "(") or i not in s.shut:
            return None
        params, j, stops = s.span(i, s.shut[i]), s.after(i), ("{",)
    else:
        if s.word(i) and s.is_(i + 1, "=>"):
            return None, None, i + 1
        i = s.past_angles(i)
        if not s.is_(i, "(") or i not in s.shut:
            return None
        params, j, stops = s.span(i, s.shut[i]), s.after(i), ("=>",)
    returns = None
    if s.is_(j, ":"):
        e = _type_end(s, j + 1, stops)
        returns, j = s.span(j, e), e + 1
    return (params, returns, j) if s.is_(j, *stops) else None


def script(text: str) -> list[Declaration]:
    """Declarations of TypeScript and JavaScript, in order."""
    s, out = Source(text), []

    def put(kind: str, name: str, first: int, last: int, signature: str) -> None:
        back = first - 1
        while s.is_(back, "default", "export") and s.tokens[back].text == "default":
            back -= 1
        exported = s.is_(back, "export")
        doc = None if exported or s.is_(first - 1, "default", "declare") else _told(s.note.get(first))
        out.append(Declaration(kind, name, s.tokens[first].line, s.line_of_end(last), exported, doc, signature))

    for i, t in enumerate(s.tokens):
        if t.kind != "word" or t.text not in _DECLARES or s.is_(i - 1, ".", "?."):
            continue
        first = i
        if t.text == "function":
            if s.is_(i - 1, "async"):
                first = i - 1
            if not _begins(s, first) and not s.is_(first - 1, "export", "default", "declare") or not s.word(i + 1):
                continue
            params = s.past_angles(i + 2)
            if not s.is_(params, "("):
                continue
            j, returns = s.after(params), ""
            if s.is_(j, ":"):
                e = _type_end(s, j + 1, ("{",))
                returns, j = f": {s.span(j, e)}", e + 1
            if s.is_(j, "{"):  # one without a body is a signature
                put("function", s.tokens[i + 1].text, first, s.after(j) - 1, f"function {s.tokens[i + 1].text}{s.span(params, s.after(params) - 1)}{returns}")
        elif t.text in ("const", "let", "var") and not s.is_(i + 1, "enum"):
            if not _begins(s, i) and not s.is_(i - 1, "export", "declare") or s.parent[i] >= 0 and s.is_(s.parent[i], "("):
                continue
            end, j = _end_of_statement(s, i + 1), i + 1
            while j <= end:
                name = j
                j = s.after(j) if s.is_(j, "{", "[") else j + 1
                shown = s.span(name, j - 1)
                if s.is_(j, "!"):
                    j += 1
                if s.is_(j, ":"):
                    j = _type_end(s, j + 1, ("=",)) + 1
                if s.is_(j, "=") and (f := _function_at(s, j + 1)):
                    params, returns, _ = f
                    put("function", shown, i, end, f"const {shown} = {params or '()'}{f': {returns}' if returns else ''} => ...")
                while j <= end and not s.is_(j, ","):  # to the next declarator
                    j = s.after(j) if s.is_(j, *_OPEN) else s.past_angles(j) if s.is_(j, "<") and s.past_angles(j) > j else j + 1
                j += 1
        elif t.text == "class" and s.word(i + 1) and not s.is_(i - 1, "abstract"):
            while s.tokens[first - 1].text.startswith("@") and first > 0 or s.is_(first - 1, ")") and any(s.shut.get(k) == first - 1 and s.tokens[k - 1].text.startswith("@") for k in range(max(1, first - 200), first)):
                first = first - 1 if s.tokens[first - 1].text.startswith("@") else next(k for k in range(max(1, first - 200), first) if s.shut.get(k) == first - 1) - 1
            if not _begins(s, first) and not s.is_(first - 1, "export", "default", "declare"):
                continue
            j = s.past_angles(i + 2)
            head = j
            while j < len(s.tokens) and not s.is_(j, "{"):
                j = s.past_angles(j) if s.is_(j, "<") and s.past_angles(j) > j else s.after(j) if s.is_(j, "(", "[") else j + 1
            if j < len(s.tokens):
                put("class", s.tokens[i + 1].text, first, s.after(j) - 1, f"class {s.tokens[i + 1].text}" + (f" {s.span(head, j - 1)}" if j > head else ""))
        elif t.text in ("interface", "enum") and s.word(i + 1):
            first = i - 1 if t.text == "enum" and s.is_(i - 1, "const") else i
            j = s.past_angles(i + 2)
            while t.text == "interface" and j < len(s.tokens) and not s.is_(j, "{", ";"):
                j = s.past_angles(j) if s.is_(j, "<") and s.past_angles(j) > j else j + 1
            if s.is_(j, "{") and (_begins(s, first) or s.is_(first - 1, "export", "default", "declare")):
                put(t.text, s.tokens[i + 1].text, first, s.after(j) - 1, f"{t.text} {s.tokens[i + 1].text}")
        elif t.text == "type" and s.word(i + 1) and s.is_(s.past_angles(i + 2), "=") and (_begins(s, i) or s.is_(i - 1, "export", "declare")):
            put("type", s.tokens[i + 1].text, i, _end_of_statement(s, i + 1), f"type {s.tokens[i + 1].text}")
        elif t.text in ("import", "export") and _begins(s, i) and not s.is_(i + 1, "(", "."):
            j = i + 1
            if t.text == "export" and not s.is_(j, "*", "{") and not (s.is_(j, "type") and s.is_(j + 1, "*", "{")):
                continue
            while j < len(s.tokens) and s.tokens[j].kind in ("word", "punct") and not s.is_(j, ";", "=", "from", "import"):
                j = s.after(j) if s.is_(j, "{") else j + 1
            j += s.is_(j, "from")
            if j < len(s.tokens) and s.tokens[j].kind == "string":
                end = _end_of_statement(s, j)
                out.append(Declaration(t.text, re.sub("['\"]", "", s.tokens[j].text), t.line, s.line_of_end(end), t.text == "export", None, s.span(i, end)))
    return out


_MODIFIERS = frozenset("public private protected internal static async override virtual sealed abstract extern unsafe partial new readonly required file".split())
_TYPES = frozenset("class interface enum struct record namespace".split())


def sharp(text: str) -> list[Declaration]:
    """Declarations of C#, in order: methods, classes, interfaces, enums and using directives."""
    s, out = Source(text, True), []
    bodies: dict[int, str] = {-1: "namespace"}

    def first_of(i: int) -> int:
        """The first modifier or attribute of the declaration whose keyword or type is at i."""
        while True:
            if s.word(i - 1) and s.tokens[i - 1].text in _MODIFIERS:
                i -= 1
            elif s.is_(i - 1, "]") and (k := next((k for k in range(i - 2, -1, -1) if s.shut.get(k) == i - 1), -1)) >= 0 and s.parent[k] == s.parent[i] and (k == 0 or s.is_(k - 1, ";", "{", "}", "]")):
                i = k
            else:
                return i

    def put(kind: str, name: str, first: int, last: int, signature: str) -> None:
        j, public = first, False
        while s.is_(j, "[") or s.word(j) and s.tokens[j].text in _MODIFIERS:
            public = public or s.is_(j, "public")
            j = s.after(j) if s.is_(j, "[") else j + 1
        out.append(Declaration(kind, name, s.tokens[first].line, s.line_of_end(last), public, _told(s.note.get(first)), signature))

    i = 0
    while i < len(s.tokens):
        t, inside = s.tokens[i], bodies.get(s.parent[i], "")
        if t.kind != "word" and not (t.text == "(" and inside == "type") or not inside:
            i += 1
            continue
        if t.text == "using" and inside == "namespace" and not s.is_(i + 1, "(", "var") and (i == 0 or s.is_(i - 1, ";", "{", "}", "global", "]") or s.tokens[i - 1].line < t.line):
            first = i - 1 if s.is_(i - 1, "global") else i
            end = next((j for j in range(i, len(s.tokens)) if s.is_(j, ";")), len(s.tokens) - 1)
            own = s.span(first, end)
            out.append(Declaration("import", re.sub(r";$", "", re.sub(r"^using\s+", "", own)).strip(), s.tokens[first].line, s.line_of_end(end), False, None, own))
            i = end + 1
        elif t.text in _TYPES and s.word(i + 1) and not s.is_(i - 1, ".", ":", ","):
            name = i + 2 if t.text == "record" and s.is_(i + 1, "class", "struct") else i + 1
            j = name + 1
            while j < len(s.tokens) and not s.is_(j, "{", ";"):
                j = s.after(j) if s.is_(j, "(", "[") else j + 1
            if s.is_(j, "{"):
                bodies[j] = "namespace" if t.text == "namespace" else "" if t.text == "enum" else "type"
            if t.text in ("class", "interface", "enum") and s.is_(j, "{"):
                put(t.text, s.tokens[name].text, first_of(i), s.after(j) - 1, f"{t.text} {s.tokens[name].text}")
            i = j + 1
        elif inside == "type" and (i == 0 or s.is_(i - 1, "{", "}", ";", "]")):
            # a member: its head ends at the first bracket, semicolon or assignment
            j = i
            while s.word(j) and s.tokens[j].text in _MODIFIERS:
                j += 1
            if s.word(j) and s.tokens[j].text in _TYPES:
                i = j
                continue
            returns, k = j, j
            while k < len(s.tokens) and not s.is_(k, "(", "{", ";", "=", "=>", "}"):
                k = s.past_angles(k) if s.is_(k, "<") and s.past_angles(k) > k else s.after(k) if s.is_(k, "[") else k + 1
            if s.is_(k, "(") and returns == k:  # a tuple is the type
                k = s.after(k)
                k = k + 1 if s.word(k) else k
            name = k - 1
            if s.is_(name, ">", ">>"):
                name = next((n for n in range(name, returns, -1) if s.past_angles(n) == k), name) - 1
            if s.is_(k, "(") and k in s.shut and name > returns and s.word(name) and not any(s.is_(n, "operator", "delegate", "event") for n in range(returns, k)):
                e = s.after(k)
                while e < len(s.tokens) and not s.is_(e, "{", ";", "=>"):
                    e = s.after(e) if s.is_(e, "(", "[") else e + 1
                if s.is_(e, "=>"):
                    while e < len(s.tokens) and not s.is_(e, ";"):
                        e = s.after(e) if s.is_(e, *_OPEN) else e + 1
                last = s.after(e) - 1 if s.is_(e, "{") else e
                shown = name - 1
                while s.is_(shown, "."):  # an explicit interface member
                    shown -= 2
                put("function", s.tokens[name].text, first_of(i), last, f"{s.span(returns, max(returns, shown))} {s.tokens[name].text}{s.span(k, s.shut[k])}")
                i = last + 1
            else:
                while k < len(s.tokens) and not s.is_(k, ";", "}", "{"):
                    k = s.after(k) if s.is_(k, "(", "[") else k + 1
                k = s.after(k) if s.is_(k, "{") else k
                i = k + 1 if s.is_(k, ";") or not s.is_(k, "}") and k <= i else max(k, i + 1)
        else:
            i += 1
    return sorted(out, key=lambda d: (d.start_line, -d.end_line))


def decisions(text: str, sharp_: bool = False) -> int:
    """1 and the number of decision points: branches, loops, cases, handlers, conditional expressions and logical operators."""
    s = Source(text, sharp_)
    tails, types, n = set(), [], 1
    for i, t in enumerate(s.tokens):  # the while of a do is not one of its own, and a type alias has no expressions
        if s.is_(i, "do") and not s.is_(i - 1, ".", "?.") and not s.is_(i + 1, ":"):
            j = s.after(i + 1) if s.is_(i + 1, "{") else _end_of_statement(s, i + 1) + 1
            if s.is_(j, "while"):
                tails.add(j)
        if not sharp_ and s.is_(i, "type") and s.word(i + 1) and s.is_(s.past_angles(i + 2), "=") and (_begins(s, i) or s.is_(i - 1, "export", "declare")):
            types.append((i, _end_of_statement(s, i + 1)))
    inside = iter([*types, (len(s.tokens), len(s.tokens))])
    first, last = next(inside)
    for i, t in enumerate(s.tokens):
        while i > last:
            first, last = next(inside)
        if t.kind == "punct":
            if t.text in ("&&", "||", "??"):
                n += not first <= i <= last
            elif t.text == "?" and not first <= i <= last:
                n += _is_conditional(s, i, sharp_)
            continue
        if t.kind != "word" or s.is_(i - 1, ".", "?.") or s.is_(i + 1, ":", "=", ",", ")", "?"):
            # a property or a name; but a C# section begins with default and a colon
            n += sharp_ and t.text == "default" and s.is_(i + 1, ":") and _starts_section(s, i)
            continue
        if t.text == "case":
            n += _starts_section(s, i) if sharp_ else 1
        elif t.text == "do":
            n += s.is_(i + 1, "{") or _begins(s, i)
        elif t.text in ("if", "while", "for", "foreach"):
            n += i not in tails and (s.is_(i + 1, "(") or t.text == "for" and s.is_(i + 1, "await")) and (sharp_ or t.text != "foreach")
        elif t.text == "else" or t.text == "catch" and s.is_(i - 1, "}"):
            n += 1
    return n


def _starts_section(s: Source, i: int) -> bool:
    """Whether a C# label is the first of its section: labels in a row share one."""
    j = i - 1
    while j > 0 and not s.is_(j, "case", ";", "{", "}", "default"):
        j -= 1
    return not (s.is_(i - 1, ":") and s.is_(j, "case", "default"))


def _is_conditional(s: Source, i: int, sharp_: bool) -> bool:
    """Whether a question mark is of a conditional expression, not of an optional name or a nullable type."""
    if s.is_(i + 1, ":", ")", ",", ";", "=", "]", ">", "(", "[") and not (s.is_(i + 1, "(", "[") and s.tokens[i + 1].start > s.tokens[i].start + 1):
        return False
    tight = i > 0 and s.tokens[i - 1].start + len(s.tokens[i - 1].text) == s.tokens[i].start
    if sharp_ and tight and s.word(i + 1) and s.is_(i + 2, "=", ";", ",", ")", "{", "(", "=>", "in", "<"):
        return False
    depth, j = 0, i + 1
    while j < len(s.tokens):
        if s.is_(j, "?"):
            depth += 1
        elif s.is_(j, ":"):
            if not depth:
                return True
            depth -= 1
        elif s.is_(j, ";") or s.tokens[j].kind == "punct" and s.tokens[j].text in _CLOSE:
            return False
        j = s.after(j) if s.is_(j, *_OPEN) else j + 1
    return False
