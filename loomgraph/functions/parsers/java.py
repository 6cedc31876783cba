"""Java, from tokens."""

from __future__ import annotations

from loomgraph.functions.parsers.base import Collector, Lexer, matches

MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed non".split())
NOT_CALLED = frozenset("if for while switch catch synchronized return throw try new assert else do case this super when yield".split())
TYPES = ("class", "interface", "enum", "record")


def parse_java(source: str) -> dict:
    out, tokens = Collector(source), Lexer(source, blocks=True).run()
    close, n = matches(tokens), len(tokens)
    text = [t.text for t in tokens] + [""] * 4

    def past(i: int) -> int:
        return close.get(i, n) + 1

    def named(i: int) -> bool:
        return 0 <= i < n and tokens[i].kind == "name"

    class_bodies, enum_bodies, scopes, class_bodies_scope = set(), set(), {}, {}
    stack: list[tuple[int, str | None, bool, bool]] = []
    constants = False  # whether the place is among the constants of an enum
    scope: str | None = None
    in_class, begin, i = False, 0, 0  # begin: first token of the member or statement
    while i < n:
        while stack and i >= stack[-1][0]:
            _, scope, in_class, constants = stack.pop()
            begin = i + 1
        t, before = text[i], text[i - 1] if i else ""
        if t == "{":
            stack.append((close.get(i, n), scope, in_class, constants))
            body_of_constant = constants and (before == ")" or named(i - 1))
            constants = i in enum_bodies
            if i in class_bodies or body_of_constant:
                scope, in_class = class_bodies_scope.get(i, None), True
            elif i in scopes:
                scope, in_class = scopes[i], False
            else:
                in_class = False
            begin = i + 1
        elif t in (";", "}"):
            begin = i + 1
            constants = constants and t != ";"
        elif t == "@" and text[i + 1] == "interface":
            i += 2
            while i < n and text[i] != "{":
                i += 1
            class_bodies.add(i)
            continue
        elif t == "@":
            i += 2
            while text[i] == ".":
                i += 2
            if text[i] == "(":
                i = past(i)
            continue
        elif t == "import" and not in_class and scope is None:
            k = i + 1 + (text[i + 1] == "static")
            parts = []
            while k < n and text[k] != ";":
                parts.append(text[k])
                k += 1
            if parts and parts[-1] == "*":
                parts = parts[:-2]
            if len(parts) > 1:
                out.refs["".join(parts)] = None
            begin = i = k + 1
            continue
        elif t in TYPES and before != "." and named(i + 1) and (t != "record" or text[i + 2] in ("(", "<")) and text[i + 1] not in ("extends",):
            out.symbol(text[i + 1], "class", tokens[min(begin, i)].start, tokens[min(begin, i)].line)
            k = i + 2
            while k < n and text[k] not in ("{", ";"):
                k = past(k) if text[k] == "(" else k + 1
            class_bodies.add(k)
            if t == "enum":
                enum_bodies.add(k)
            i = k
            continue
        elif t == "new" and named(i + 1):
            k, parts, angle = i + 1, [], 0
            while k < n and (angle or named(k) or text[k] in (".", "<")):
                angle += (text[k] == "<") - (text[k] == ">")
                parts.append(k)
                k += 1
            if text[k] == "(":
                last = tokens[parts[-1]]
                written = source[tokens[parts[0]].start : last.start + len(last.text)]
                out.call(scope, written.split(".")[-1])
                if text[past(k)] == "{":
                    class_bodies.add(past(k))
                    class_bodies_scope[past(k)] = scope
                i = k
                continue
        elif named(i) and text[i + 1] == "(" and t not in NOT_CALLED and not (constants and before in ("{", ",", ")")):
            end = past(i + 1)
            typed = (named(i - 1) and before not in MODIFIERS and before not in NOT_CALLED) or before in (">", "]")
            if in_class and typed and i > begin:
                k = end
                while k < n and text[k] not in ("{", ";", "}"):
                    k += 1
                first = tokens[begin]
                out.symbol(t, "method", first.start, first.line)
                out.enter(t)
                if text[k] == "{":
                    scopes[k] = t
                i = end
                continue
            if in_class and text[end] in ("{", "throws"):
                k = end
                while k < n and text[k] not in ("{", ";"):
                    k += 1
                scopes[k] = None
                i = end
                continue
            out.call(scope, t)
        i += 1
    return out.result()
