"""TypeScript and TSX, from tokens."""

from __future__ import annotations

from loomgraph.functions.parsers.base import Collector, Lexer, Token, matches

RESERVED = frozenset("if for while switch catch function return typeof new delete void in of instanceof do else case throw await yield with super import require class const let var export default extends".split())
MODIFIERS = frozenset("public private protected static readonly async override abstract get set declare accessor".split())
#: words that no declaration goes on behind
AFTER_DECLARATION = frozenset("export if for while switch try throw break continue return".split())
STATEMENTS = frozenset("const let var function class export import return if for while switch try throw do break continue interface type enum declare abstract async".split())
#: a brace after one of these opens an object, else a block
BEFORE_OBJECT = frozenset(["=", "(", ",", ":", "[", "return", "?", "|", "&", "=>", "??", "!", "...", "default", "in", "of", "typeof", "await", "yield", "new"])


class _Parse:
    def __init__(self, source: str, tsx: bool):
        self.out = Collector(source)
        self.tokens: list[Token] = Lexer(source, templates=True, regex=True, jsx=tsx).run()
        self.n = len(self.tokens)
        self.text = [t.text for t in self.tokens] + [""] * 4
        self.kind = [t.kind for t in self.tokens] + [""] * 4
        self.close = matches(self.tokens)
        self.parts_declarators = self._commas()

    def _commas(self) -> set[int]:
        """Places of the commas between the declarators of one statement."""
        out, open_ = set(), [False]
        for i, t in enumerate(self.tokens):
            if t.kind == "name":
                if t.text in ("const", "let", "var"):
                    open_[-1] = True
                elif t.text in AFTER_DECLARATION and self.before(i) != ".":
                    open_[-1] = False
            elif t.text in ("(", "[", "{"):
                open_.append(False)
            elif t.text in (")", "]", "}"):
                open_.pop()
                open_ = open_ or [False]
            elif t.text == ";":
                open_[-1] = False
            elif t.text == "," and open_[-1]:
                out.add(i)
        return out

    def past(self, i: int) -> int:
        return self.close.get(i, self.n) + 1

    def named(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == "name"

    def before(self, i: int) -> str:
        return self.text[i - 1] if i else ""

    def angles(self, i: int) -> int | None:
        """Behind the type arguments that open at i, if that is what they are."""
        depth, k = 0, i
        while k < self.n:
            t = self.text[k]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if depth == 0:
                    return k + 1
            elif t in ("(", "{", "["):
                k = self.close.get(k, self.n)
            elif not (self.named(k) or self.kind[k] == "string" or t in (".", ",", "|", "&", "?", ":", "=>", "=")):
                return None
            k += 1
        return None

    def begins_statement(self, i: int) -> bool:
        p = self.before(i)
        if i == 0 or p in (";", "{", "}", "export", "default", ")", "declare"):
            return True
        # a new line after something complete
        return self.tokens[i].line > self.tokens[i - 1].line and (self.kind[i - 1] in ("string", "number") or p == "]" or (self.named(i - 1) and p not in RESERVED))

    def parameters(self, i: int) -> int | None:
        """Place of the parameter list of a declaration whose name is in front of i."""
        if self.text[i] in ("?", "!"):
            i += 1
        if self.text[i] == "<":
            i = self.angles(i) or self.n
        return i if self.text[i] == "(" else None

    def body(self, i: int, arrow: bool = False) -> int | None:
        """Behind a parameter list: place of the body's brace, or of what stands behind the arrow."""
        want = "=>" if arrow else "{"
        if self.text[i] == want:
            return i + 1 if arrow else i
        if self.text[i] != ":":
            return None
        k, fresh = i + 1, True
        while k < self.n:
            t = self.text[k]
            if t == want and not (want == "{" and fresh):
                return k + 1 if arrow else k
            if t in (";", "}", ")") or t == "=" or (t == "=>" and not arrow and self.before(k) != ")"):
                return None
            if t == "=>" and not arrow:
                fresh = True
                k += 1
                continue
            fresh = t in ("|", "&", ":", "<", ",", "is")
            k = self.past(k) if t in ("(", "{", "[") else k + 1
        return None

    def expression_end(self, i: int) -> int:
        """Behind the expression that begins at i."""
        k, start = i, i
        while k < self.n:
            t = self.text[k]
            if t in (";", ",", ")", "]", "}"):
                return k
            if k > start and self.tokens[k].line > self.tokens[k - 1].line and self.named(k) and (self.kind[k - 1] in ("string", "number", "name") or self.before(k) in (")", "]", "}")) and (t in STATEMENTS or self.before(k) not in RESERVED) and t not in ("in", "of", "instanceof", "as"):
                return k
            k = self.past(k) if t in ("(", "[", "{") else k + 1
        return k

    def run(self) -> dict:
        out, text, tokens = self.out, self.text, self.tokens
        begins: dict[int, tuple[int, str | None, str]] = {}  # place: (end, scope, kind of braces)
        muted: dict[int, int] = {}  # parameter lists, in which no function is current
        ends: list[tuple[int, str | None, str]] = []
        scope: str | None = None
        where = "block"
        i = 0
        while i < self.n:
            while ends and i >= ends[-1][0]:
                _, scope, where = ends.pop()
            if i in muted:
                ends.append((muted[i], scope, where))
                scope, where = None, "block"
            if i in begins:
                end, s, kind = begins[i]
                ends.append((end, scope, where))
                scope, where = s, kind
            elif text[i] == "{":
                ends.append((self.close.get(i, self.n), scope, where))
                where = "object" if self.before(i) in BEFORE_OBJECT and not (self.before(i) == "=>") else "block"
            t = text[i]
            if not self.named(i):
                i += 1
                continue
            p = self.before(i)
            if t == "import" and p != "." and text[i + 1] not in ("(", "."):
                k = i + 1
                while k < self.n and self.kind[k] != "string" and text[k] != ";" and text[k] != "=":
                    k += 1
                if self.kind[k] == "string":
                    out.refs[text[k][1:-1]] = None
                i = k + 1
                continue
            if t == "class" and p != ".":
                k = i + 1
                while k < self.n and text[k] != "{":
                    k = self.past(k) if text[k] == "(" else k + 1
                if self.named(i + 1) and text[i + 1] not in ("extends", "implements") and self.begins_statement(i) and p != "abstract":
                    out.symbol(text[i + 1], "class", tokens[i].start, tokens[i].line)
                begins[k] = (self.close.get(k, self.n), None, "class")
                i += 1
                continue
            if t == "function" and p != ".":
                first = i - 1 if p == "async" else i
                k = self.parameters(i + 2) if self.named(i + 1) else None
                brace = self.body(self.past(k)) if k is not None else None
                if brace is not None and self.begins_statement(first):
                    self.declare(text[i + 1], "function", first, k, brace, begins, muted)
                i = k if k is not None else i + 1
                continue
            if where in ("class", "object") and not (text[i + 1] == ":" and where == "object"):
                k = self.parameters(i + 1) if p not in (".", "new", "=", ":", "?.") or where == "class" and p == "}" else None
                if k is not None and t not in RESERVED - {"delete", "import", "catch", "with", "new", "of", "in", "return", "for", "if", "default", "export", "extends", "require"} and p not in (".", "?.", "=", ":", "new", "(", "=>", "&", "|", "?", "@"):
                    brace = self.body(self.past(k))
                    if brace is not None:
                        first = i
                        while first and (text[first - 1] in MODIFIERS or text[first - 1] == "*"):
                            first -= 1
                        self.declare(t, "method", first, k, brace, begins, muted)
                        i = k
                        continue
            if p in ("const", "let", "var") or i - 1 in self.parts_declarators:
                k = i + 1
                if text[k] == "!":
                    k += 1
                if text[k] == ":":
                    while k < self.n and text[k] not in ("=", ";"):
                        k = self.past(k) if text[k] in ("(", "{", "[") else k + 1
                if text[k] == "=":
                    k += 1 + (text[k + 1] == "async" and (text[k + 2] in ("(", "<") or self.named(k + 2)))
                    if self.named(k) and text[k + 1] == "=>":
                        self.arrow(i, k + 2, begins)
                        i = k + 2
                        continue
                    m = self.parameters(k)
                    after = self.body(self.past(m), arrow=True) if m is not None else None
                    if after is not None:
                        muted[m] = self.past(m)
                        self.arrow(i, after, begins)
                        i = m
                        continue
            called = text[i + 1] == "(" or (text[i + 1] == "?." and text[i + 2] == "(")
            if text[i + 1] == "<" and not called:
                k = self.angles(i + 1)
                called = k is not None and text[k] == "("
            if called and scope and t not in ("require", "import") and (t not in RESERVED or p in (".", "?.")) and not self.constructed(i) and not t.startswith("#"):
                out.call(scope, t)
            i += 1
        return out.result()

    def constructed(self, i: int) -> bool:
        while i >= 2 and self.text[i - 1] == "." and self.named(i - 2):
            i -= 2
        return self.before(i) == "new"

    def declare(self, name: str, kind: str, first: int, params: int, brace: int, begins: dict, muted: dict) -> None:
        t = self.tokens[first]
        self.out.symbol(name, kind, t.start, t.line)
        self.out.enter(name)
        muted[params] = self.past(params)
        begins[brace] = (self.close.get(brace, self.n), name, "block")

    def arrow(self, at: int, body: int, begins: dict) -> None:
        t = self.tokens[at]
        block = self.text[body] == "{"
        end = self.close.get(body, self.n) if block else self.expression_end(body)
        stop = self.tokens[min(end if block else end - 1, self.n - 1)]
        self.out.symbol(self.text[at], "function", t.start, t.line, stop.start + len(stop.text))
        self.out.enter(self.text[at])
        begins[body] = (end, self.text[at], "block")


def parse_typescript(source: str, tsx: bool = False) -> dict:
    return _Parse(source, tsx).run()
