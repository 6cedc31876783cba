"""What all front ends share: the result of parsing a file, and a lexer for brace languages."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, string, number, mark
    text: str
    start: int
    line: int


@dataclass
class Collector:
    """Symbols in the order they begin, imports without repeats, and calls grouped by the function
    that makes them, in the order in which functions begin, each pair of names once."""

    source: str
    symbols: list[tuple[str, str, int, str]] = field(default_factory=list)
    refs: dict[str, None] = field(default_factory=dict)
    by_function: dict[str, dict[str, None]] = field(default_factory=dict)

    def symbol(self, name: str, kind: str, start: int, line: int, end: int | None = None) -> None:
        stop = self.source.find("\n", start)
        stop = len(self.source) if stop < 0 else stop
        self.symbols.append((name, kind, line, self.source[start : stop if end is None else min(stop, end)].strip()))

    def enter(self, name: str) -> None:
        self.by_function.setdefault(name, {})

    def call(self, caller: str | None, callee: str | None) -> None:
        if caller and callee:
            self.by_function.setdefault(caller, {})[callee] = None

    def result(self) -> dict:
        calls = [(f, c) for f, callees in self.by_function.items() for c in callees]
        return {"symbols": self.symbols, "imports": list(self.refs), "calls": calls}


CLOSES = {"(": ")", "[": "]", "{": "}"}


def matches(tokens: list[Token]) -> dict[int, int]:
    """Place of the closing bracket of each opening one; one that is never closed ends with the file."""
    out, open_ = {}, []
    for i, t in enumerate(tokens):
        if t.kind != "mark":
            continue
        if t.text in CLOSES:
            open_.append(i)
        elif t.text in CLOSES.values():
            while open_:
                k = open_.pop()
                out[k] = i
                if CLOSES[tokens[k].text] == t.text:
                    break
    for k in open_:
        out[k] = len(tokens)
    return out


#: tokens after which a slash divides and a less-than compares
VALUE_MARKS = {")", "]", "}"}


class Lexer:
    """Tokens of a brace language; strings and comments never show as marks.  templates: ${} inside
    backquotes holds code; raw: backquotes hold plain text; jsx: elements in expressions."""

    def __init__(self, source: str, templates: bool = False, raw: bool = False, regex: bool = False, jsx: bool = False, blocks: bool = False):
        self.s, self.templates, self.raw, self.regex, self.jsx, self.blocks = source, templates, raw, regex, jsx, blocks
        self.out: list[Token] = []
        self.line_at, self.line = 0, 1

    def add(self, kind: str, start: int, end: int) -> None:
        self.line += self.s.count("\n", self.line_at, start)
        self.line_at = max(self.line_at, start)
        self.out.append(Token(kind, self.s[start:end], start, self.line))

    def after_value(self) -> bool:
        if not self.out:
            return False
        t = self.out[-1]
        if t.kind == "name":
            return t.text not in {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "default", "instanceof"}
        return t.kind != "mark" or t.text in VALUE_MARKS

    def run(self) -> list[Token]:
        """What is being lexed stands on a stack, so that nesting may be of any depth: code, in braces
        all but the first, with the braces open in it; templates; elements, with their depth, whether
        the place is within a tag, and whether that closes or is empty."""
        work: list[list] = [["code", 0]]
        i = 0
        while i < len(self.s):
            i = {"code": self.code, "template": self.template, "element": self.element}[work[-1][0]](i, work)
        return self.out

    def quoted(self, i: int) -> int:
        q, i = self.s[i], i + 1
        while i < len(self.s) and self.s[i] != q and self.s[i] != "\n":
            i += 2 if self.s[i] == "\\" else 1
        return min(i + 1, len(self.s))

    def code(self, i: int, work: list[list]) -> int:
        """Lexes one token; returns the place behind it."""
        s, c = self.s, self.s[i]
        if c.isspace():
            return i + 1
        if s.startswith("//", i):
            i = s.find("\n", i)
            return len(s) if i < 0 else i
        if s.startswith("/*", i):
            i = s.find("*/", i + 2)
            return len(s) if i < 0 else i + 2
        if self.blocks and s.startswith('"""', i):
            end = s.find('"""', i + 3)
            return self.token("string", i, len(s) if end < 0 else end + 3)
        if c in "\"'":
            return self.token("string", i, self.quoted(i))
        if c == "`" and self.templates:
            work.append(["template"])
            return i + 1
        if c == "`" and self.raw:
            end = s.find("`", i + 1)
            return self.token("string", i, len(s) if end < 0 else end + 1)
        if c.isalpha() or c in "_$#" or ord(c) > 127:
            end = i + 1
            while end < len(s) and (s[end].isalnum() or s[end] in "_$" or ord(s[end]) > 127 and not s[end].isspace()):
                end += 1
            return self.token("name", i, end)
        if c.isdigit():
            end = i + 1
            while end < len(s) and (s[end].isalnum() or s[end] in "_." and s[end : end + 2] != ".."):
                end += 1
            return self.token("number", i, end)
        if c == "/" and self.regex and not self.after_value():
            return self.pattern(i)
        if c == "<" and self.jsx and not self.after_value() and (s[i + 1 : i + 2].isalpha() or s[i + 1 : i + 2] == ">"):
            work.append(["element", 0, False, False, False])
            return i
        two = s[i : i + 2]
        n = 3 if s.startswith("...", i) else 2 if two in ("=>", "?.", "->", "::", ":=") else 1
        if n == 1 and len(work) > 1 and c in "{}":
            work[-1][1] += 1 if c == "{" else -1
            if work[-1][1] < 0:
                work.pop()
        return self.token("mark", i, i + n)

    def token(self, kind: str, start: int, end: int) -> int:
        self.add(kind, start, end)
        return end

    def template(self, i: int, work: list[list]) -> int:
        s = self.s
        if s[i] == "`":
            work.pop()
            return self.token("string", i, i + 1)
        if s.startswith("${", i):
            work.append(["code", 0])
            return self.token("mark", i + 1, i + 2)
        return i + (2 if s[i] == "\\" else 1)

    def element(self, i: int, work: list[list]) -> int:
        """An element: its text is no code, what stands in braces is."""
        s, state = self.s, work[-1]
        _, depth, in_tag, closing, empty = state
        if s[i] == "{":
            work.append(["code", 0])
            return self.token("mark", i, i + 1)
        if not in_tag:
            if s[i] == "<":
                state[2:] = [True, s.startswith("</", i), False]
            return i + 1
        if s[i] in "\"'":
            return self.quoted(i)
        if s[i] != ">":
            state[4] = s.startswith("/>", i)
            return i + 1
        state[1], state[2] = depth + (-1 if closing else 0 if empty else 1), False
        if state[1] <= 0:
            work.pop()
            self.add("string", i + 1, i + 1)
        return i + 1

    def pattern(self, i: int) -> int:
        start, i, inside = i, i + 1, False
        while i < len(self.s) and self.s[i] != "\n" and (inside or self.s[i] != "/"):
            if self.s[i] == "\\":
                i += 1
            elif self.s[i] in "[]":
                inside = self.s[i] == "["
            i += 1
        i += 1
        while i < len(self.s) and self.s[i].isalpha():
            i += 1
        self.add("string", start, min(i, len(self.s)))
        return i
