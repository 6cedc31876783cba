"""Python: by the standard library's parser; files that it rejects by an indentation scanner."""

from __future__ import annotations

import ast
import re

from loomgraph.functions.parsers.base import Collector


def parse_python(source: str) -> dict:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _scan(source)
    out = Collector(source)
    lines = source.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def offset(line: int, column: int) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[:column].decode("utf-8", "ignore"))

    def declare(node, kind: str) -> None:
        out.symbol(node.name, kind, offset(node.lineno, node.col_offset), node.lineno, offset(node.end_lineno, node.end_col_offset))

    # work items in reverse order of visit: (node, enclosing function, parent is a class body)
    work: list[tuple[ast.AST, str | None, bool]] = [(n, None, False) for n in reversed(tree.body)]

    def later(nodes, scope: str | None, in_class: bool = False) -> None:
        work.extend((n, scope, in_class) for n in reversed([n for n in nodes if n is not None]))

    while work:
        node, scope, in_class = work.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            declare(node, "method" if in_class else "function")
            out.enter(node.name)
            # the body belongs to the function, decorators to what is around it, the rest to nothing
            later(node.body, node.name)
            later([node.args, node.returns, *getattr(node, "type_params", [])], None)
            later(node.decorator_list, scope)
        elif isinstance(node, ast.ClassDef):
            declare(node, "class")
            later(node.body, None, True)
            later([*node.bases, *node.keywords, *getattr(node, "type_params", [])], None)
            later(node.decorator_list, scope)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                out.refs[alias.name] = None
        elif isinstance(node, ast.ImportFrom):
            ref = "." * node.level + (node.module or "")
            if ref and ref != "__future__":
                out.refs[ref] = None
        else:
            if isinstance(node, ast.Call):
                f = node.func
                out.call(scope, f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None)
            later(ast.iter_child_nodes(node), scope)
    return out.result()


_DEF = re.compile(r"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)")
_IMPORT = re.compile(r"[ \t]*(?:import[ \t]+(.+)|from[ \t]+([.\w]+)[ \t]+import\b)")
_CALL = re.compile(r"(?<![\w.])(?:[^\W\d]\w*\s*\.\s*)*([^\W\d]\w*)\s*\(")
_BLANK = re.compile(r"(\"\"\"|''').*?(?:\1|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*", re.S)
_WORDS = {"if", "elif", "while", "for", "return", "and", "or", "not", "in", "is", "lambda", "print", "assert", "with", "yield", "await", "except", "def", "class", "del", "raise"} - {"print"}


def _behind_header(line: str, at: int) -> str:
    depth = 0
    for k in range(at, len(line)):
        depth += (line[k] in "([{") - (line[k] in ")]}")
        if line[k] == ":" and depth <= 0:
            return line[k + 1 :]
    return ""


def _scan(source: str) -> dict:
    """Scopes by indentation, for files with errors."""
    out = Collector(source)
    plain = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    open_: list[tuple[int, str, str | None]] = []  # indentation, def or class, scope of the body
    at = 0
    for number, line in enumerate(plain.split("\n"), 1):
        if line.strip():
            indent = len(line) - len(line.lstrip())
            while open_ and open_[-1][0] >= indent:
                open_.pop()
            scope = open_[-1][2] if open_ else None
            rest = line
            if m := _DEF.match(line):
                method = m[2] == "def" and bool(open_) and open_[-1][1] == "class"
                out.symbol(m[3], "class" if m[2] == "class" else "method" if method else "function", at + len(m[1]), number)
                if m[2] == "def":
                    out.enter(m[3])
                open_.append((indent, m[2], m[3] if m[2] == "def" else None))
                # what stands behind the header in its line is the body
                rest, scope = _behind_header(line, m.end()), open_[-1][2]
            elif m := _IMPORT.match(line):
                for ref in [m[2]] if m[2] else [x.strip().split(" ")[0] for x in m[1].split(",")]:
                    if ref and ref != "__future__":
                        out.refs[ref] = None
                rest = ""
            for m in _CALL.finditer(rest):
                out.call(scope, m[1] if m[1] not in _WORDS else None)
        at += len(line) + 1
    return out.result()
