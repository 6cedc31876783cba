"""Go, from tokens."""

from __future__ import annotations

from loomgraph.functions.parsers.base import Collector, Lexer, matches

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


def parse_go(source: str) -> dict:
    out, tokens = Collector(source), Lexer(source, raw=True).run()
    close, n = matches(tokens), len(tokens)
    text = [t.text for t in tokens] + [""] * 4
    scopes: dict[int, str | None] = {}  # scope that begins at a token

    def name_at(i: int) -> bool:
        return i < n and tokens[i].kind == "name" and text[i] not in KEYWORDS

    def past(i: int) -> int:
        return close.get(i, n) + 1

    def body(i: int) -> int | None:
        """Place of the brace that opens a function's body, from behind its parameters."""
        line = tokens[i - 1].line if i <= n else 0
        while i < n:
            if text[i] == "{" and text[i - 1] not in ("struct", "interface"):
                return i
            if text[i] in ("(", "[", "{"):
                i = past(i)
                line = tokens[i - 1].line if i - 1 < n else line
                continue
            if tokens[i].line != line or text[i] in (";", "}"):
                return None
            i += 1
        return None

    def type_spec(i: int) -> None:
        k = past(i + 1) if text[i + 1] == "[" and text[i + 2] != "]" else i + 1
        if text[k] == "=":
            return
        if name_at(i) and text[k] in ("struct", "interface"):
            out.symbol(text[i], "class", tokens[i].start, tokens[i].line)

    def string(i: int) -> None:
        if len(text[i]) >= 2:
            out.refs[text[i][1:-1]] = None

    stack: list[tuple[int, str | None]] = []  # end of a scope, what was current before
    scope: str | None = None
    depth, i = 0, 0
    while i < n:
        while stack and i >= stack[-1][0]:
            scope = stack.pop()[1]
        t = text[i]
        if t in ("{", "(", "["):
            depth += 1
        elif t in ("}", ")", "]"):
            depth -= 1
        if i in scopes:
            stack.append((close.get(i, n), scope))
            scope = scopes[i]
        if tokens[i].kind == "name":
            if t == "import" and depth == 0:
                if text[i + 1] == "(":
                    for k in range(i + 2, close.get(i + 1, n)):
                        if tokens[k].kind == "string":
                            string(k)
                    i = past(i + 1)
                    continue
                k = next((k for k in range(i + 1, min(i + 3, n)) if tokens[k].kind == "string"), None)
                if k is not None:
                    string(k)
                    i = k + 1
                    continue
            elif t == "type" and text[i - 1 if i else n] != ".":
                if text[i + 1] == "(":
                    k, end = i + 2, close.get(i + 1, n)
                    begins = True
                    while k < end:
                        if begins and name_at(k):
                            type_spec(k)
                        line = tokens[k].line
                        k = past(k) if text[k] in ("{", "(", "[") else k + 1
                        begins = k < end and (tokens[k].line != tokens[k - 1].line or text[k - 1] == ";") and line is not None
                elif name_at(i + 1):
                    type_spec(i + 1)
            elif t == "func" and depth == 0:
                k, kind = i + 1, "function"
                if text[k] == "(":
                    k, kind = past(k), "method"
                if name_at(k):
                    p = past(k + 1) if text[k + 1] == "[" else k + 1
                    if text[p] == "(":
                        start = body(past(p))
                        out.symbol(text[k], kind, tokens[i].start, tokens[i].line)
                        out.enter(text[k])
                        if start is not None:
                            scopes[start] = text[k]
                        i = p
                        continue
            elif name_at(i) and text[i + 1] == "(" and scope and text[i - 1 if i else n] not in ("func", "]"):
                out.call(scope, t)
        i += 1
    return out.result()
