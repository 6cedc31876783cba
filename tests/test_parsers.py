"""Front ends on small sources with known results."""

import pytest

from loomgraph.functions.parsers import analyze, extract_symbols


def brief(a):
    return [f"{n}:{k}:{line}" for n, k, line, _ in a["symbols"]]


PY = '''\
import os, json as j
from typing import Any
from .near import thing
from . import other
from __future__ import annotations
import os

@register(make())
class Settings(base()):
    size: int = default()
    @property
    def load(self, x=start()) -> None: ...
    if os:
        def odd(self):
            pass

async def get(url: str, *, again: int = 3) -> Any:  # note
    def inner():
        deep().then(step(1))
    factory()()
    with open(url) as f:
        f.read(); f.read()
    return inner

top()
'''


def test_python():
    a = analyze(PY)
    assert brief(a) == ["Settings:class:9", "load:method:12", "odd:function:14", "get:function:17", "inner:function:18"]
    assert [s[3] for s in a["symbols"]][1] == "def load(self, x=start()) -> None: ..."
    assert a["imports"] == ["os", "json", "typing", ".near", "."]
    assert a["calls"] == [("get", "factory"), ("get", "open"), ("get", "read"), ("inner", "then"), ("inner", "deep"), ("inner", "step")]
    assert extract_symbols("import os\nX = 1\n") == []


def test_python_with_errors_falls_back():
    a = analyze("import os\nclass A:\n    def m(self):\n        go(1)\n        x = = 2\n\ndef f(\n    a):\n    stop('g()')\n")
    assert brief(a) == ["A:class:2", "m:method:3", "f:function:7"]
    assert ("m", "go") in a["calls"] and not any(c == "g" for _, c in a["calls"]) and a["imports"] == ["os"]


TS = """\
import { one } from './near';
import * as far from "far-lib";
export { two } from './not-an-import';

export class Box<T> extends Base {
  size = compute();
  static async open(x: number = start()): Promise<void> {
    return one(this.size, `a ${far.run(x)} b`);
  }
  get width() { return this.size.get<number>(0); }
  abstract area(): number;
  arrow = () => { lost(); };
}
abstract class Hidden { shown(): void { one(); } }
interface Shape { area(): number }
type Fn = (x: number) => void;

export async function main(a: string): Promise<{ x: number }> {
  const f = (x: number): number => one(x);
  let g = async y => { far.go(y) }, h = 3;
  if (a) { f(1); }
  new Box().open(2);
  [1].map((z) => nested(z));
  const re = /[(]"'/.test(a);
  require('x'); import('y');
  a?.trim?.();
}
function* gen() { yield one(); }
function over(a: string): void;
function over(a: any) { main("}"); }
"""


def test_typescript():
    a = analyze(TS, "typescript")
    assert brief(a) == ["Box:class:5", "open:method:7", "width:method:10", "shown:method:14", "main:function:18", "f:function:19", "g:function:20", "over:function:30"]
    assert [s[3] for s in a["symbols"]][:2] == ["class Box<T> extends Base {", "static async open(x: number = start()): Promise<void> {"]
    assert a["symbols"][5][3] == "f = (x: number): number => one(x)"
    assert a["imports"] == ["./near", "far-lib"]
    assert a["calls"] == [("open", "one"), ("open", "run"), ("width", "get"), ("shown", "one"), ("main", "f"), ("main", "open"), ("main", "map"), ("main", "nested"), ("main", "test"), ("main", "trim"), ("f", "one"), ("g", "go"), ("over", "main")]


def test_tsx():
    a = analyze("import R from 'r';\n\nexport function App(p: P) {\n  const n = p.a < 3;\n  return <div className=\"x(y)\">It's {fmt(p.n)} <B/> b()</div>;\n}\nfunction Next() { App(); }\n", "tsx")
    assert brief(a) == ["App:function:3", "Next:function:7"]
    assert a["imports"] == ["r"] and a["calls"] == [("App", "fmt"), ("Next", "App")]
    assert analyze("import { u } from './u';\nu();\n", "typescript") == {"symbols": [], "imports": ["./u"], "calls": []}


GO = """\
package main

import (
	"fmt"

	u "repo/util"
)
import "os"

type Box struct {
	Size int
}

type (
	Maker interface {
		Make() Box
	}
	Count int
)

func New[T any](n int) (*Box, error) {
	return &Box{Size: n}, nil
}

func (b *Box) Fill() error {
	fmt.Println("x(", `raw {(`, u.Deep(b.Size))
	go func() { os.Exit(len("a")) }()
	_ = []byte("x")
	return nil
}

var x = New(1)
"""


def test_go():
    a = analyze(GO, "go")
    assert brief(a) == ["Box:class:10", "Maker:class:15", "New:function:21", "Fill:method:25"]
    assert a["symbols"][0][3] == "Box struct {" and a["symbols"][3][3] == "func (b *Box) Fill() error {"
    assert a["imports"] == ["fmt", "repo/util", "os"]
    assert a["calls"] == [("Fill", "Println"), ("Fill", "Deep"), ("Fill", "Exit"), ("Fill", "len")]


JAVA = """\
package p;

import java.util.List;
import static java.lang.Math.max;
import java.io.*;

@Deprecated
public class Shop<T> {
    private int n = start();

    public Shop(int n) {
        init(n);
    }

    @Override
    public List<T> find(String s) throws Error {
        if (s.isEmpty()) { return null; }
        return helper(s, x -> deep(x)).trim();
    }

    abstract int size();

    String[] helper(String s, F f) { return new java.util.ArrayList<String>(max(1, 2)).get("{("); }
}

interface Ware { void price(); }
enum Kind { A(1), B; Kind(int x) {} int code() { return Shop.of(); } }
record Pair(int a, int b) { int sum() { return a(); } }
"""


def test_java():
    a = analyze(JAVA, "java")
    assert brief(a) == ["Shop:class:7", "find:method:15", "size:method:21", "helper:method:23", "Ware:class:26", "price:method:26", "Kind:class:27", "code:method:27", "Pair:class:28", "sum:method:28"]
    assert a["symbols"][0][3] == "@Deprecated" and a["symbols"][3][3].startswith("String[] helper(")
    assert a["imports"] == ["java.util.List", "java.lang.Math.max", "java.io"]
    assert a["calls"] == [("find", "isEmpty"), ("find", "helper"), ("find", "deep"), ("find", "trim"), ("helper", "ArrayList<String>"), ("helper", "max"), ("helper", "get"), ("code", "of"), ("sum", "a")]


@pytest.mark.parametrize("lang", ["python", "typescript", "tsx", "go", "java"])
def test_odd_input(lang):
    for source in ("", None, "}}}((([[", "\"'`/*", "func", "class", "import", "function f(", "a\x00b", "é ñ 世界 {(", "<div>{"):
        assert set(analyze(source, lang)) == {"symbols", "imports", "calls"}


def test_unknown_language():
    with pytest.raises(ValueError):
        analyze("", "cobol")


def test_a_declaration_of_many_names():
    source = "const " + ",\n".join(f"v{i} = {i}" for i in range(500)) + ", go = () => { run(); };"
    got = analyze(source, "typescript")
    assert [s[:3] for s in got["symbols"]] == [("go", "function", 500)]
    assert got["calls"] == [("go", "run")]


def test_commas_behind_a_declaration_are_no_declarators():
    got = analyze("const a = 1\nif (x) y = 2, f = () => g()\n", "typescript")
    assert got["symbols"] == []


@pytest.mark.parametrize("lang, open_, close", [("typescript", "`${", "}`"), ("tsx", "<A>{", "}</A>"), ("typescript", "(", ")"), ("go", "{", "}"), ("java", "{", "}")])
def test_deep_nesting(lang, open_, close):
    head = "function f() { return " if lang in ("typescript", "tsx") else "class K { int f() { return " if lang == "java" else "package p\nfunc f() { "
    got = analyze(head + open_ * 3000 + " g() " + close * 3000 + "; }", lang)
    assert got["calls"] == [("f", "g")]


def test_bodies_of_enum_constants():
    source = "enum E {\n  A { int m() { return f(); } },\n  B(g(1)) { void k() { h(); } };\n  E(int x) { z(); }\n  void n() { q(); }\n}\nclass C { void r() { s(); } }\n"
    got = analyze(source, "java")
    assert [s[:3] for s in got["symbols"]] == [("E", "class", 1), ("m", "method", 2), ("k", "method", 3), ("n", "method", 5), ("C", "class", 7), ("r", "method", 7)]
    assert got["calls"] == [("m", "f"), ("k", "h"), ("n", "q"), ("r", "s")]


def test_bodies_in_the_line_of_their_header_after_an_error():
    got = analyze("def f(x=(1\n\ndef g(): return h(a)\nclass K: pass\n  def m(self, b=z()) -> int: k(); l()\n", "python")
    assert got["calls"] == [("g", "h"), ("m", "k"), ("m", "l")]


def test_elements_hold_code_in_braces():
    got = analyze("function App() { return <div a={g(1)} b='x'>text {h(`z ${k()} `)} <br/> more()</div>; }\nfunction B() { return a < b ? <></> : q(); }", "tsx")
    assert got["calls"] == [("App", "g"), ("App", "h"), ("App", "k"), ("B", "q")]
