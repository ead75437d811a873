"""Declarations, heritage, imports, calls and spans of languages with braces."""

import pytest

from tessella.sources import lexers, parsers


def edges(name, text, *kinds):
    return sorted((k, n) for k, n in parsers.Registry().parse(name, text.encode()).edges if k in kinds)


def test_heritage():
    both = ("extends", "implements")
    assert edges("a.rs", "impl Foo for Bar {}\nimpl Baz {}", *both) == [("implements", "Foo")]
    assert edges("a.js", "class Foo extends Bar {}", *both) == [("extends", "Bar")]
    assert edges("a.ts", "class Foo extends Bar implements Baz, Qux {}", *both) == [("extends", "Bar"), ("implements", "Baz"), ("implements", "Qux")]
    assert edges("A.java", "class Foo extends Bar implements Baz, Qux {}\ninterface A extends B, C {}\n", *both) == [("extends", "B"), ("extends", "Bar"), ("extends", "C"), ("implements", "Baz"), ("implements", "Qux")]
    assert edges("a.cpp", "class Foo : public Bar, private Baz {};\nstruct S : Base {};\n", *both) == [("extends", "Bar"), ("extends", "Base"), ("extends", "Baz")]
    assert edges("a.go", "type A struct { B }\n", *both) == edges("a.c", "struct A { int b; };\n", *both) == []


def test_spans_and_kinds():
    got = parsers.Registry().parse("lib.rs", b"use std::fmt;\n\npub fn run() {\n    helper();\n}\n\npub struct Widget {\n    x: i32,\n}\n")
    assert got.symbols == [("run", "fn", 3, 5), ("Widget", "struct", 7, 9)]
    assert got.edges == [("calls", "helper"), ("defines", "Widget"), ("defines", "run"), ("imports", "std::fmt")]
    assert [h for h, _ in got.chunks] == ["run", "Widget"] and got.chunks[0][1] == "pub fn run() {\n    helper();\n}"


IMPORTS = [
    ("lib.rs", "use std::collections::HashMap;\nuse crate::foo::Bar;\npub use a::{b, c};\nuse x::y as z;\nuse p::*;", ["a::{b, c}", "crate::foo::Bar", "p", "std::collections::HashMap", "x::y"]),
    ("a.js", "import { x } from './util';\nimport React from 'react';\nimport 'side';\nconst f = require('no');\nexport { y } from 'neither';", ["./util", "react", "side"]),
    ("s.go", 'package main\n\nimport (\n\t"fmt"\n\tx "os"\n)\nimport "one"\n\nfunc main() { fmt.Println("no") }\n', ["fmt", "one", "os"]),
    ("A.java", "import java.util.List;\nimport static a.b.C.d;\nimport p.q.*;\nclass A {}", ["a.b.C.d", "java.util.List", "p.q"]),
    ("a.c", '#include <stdio.h>\n#  include "helper.h"\n// #include "no.h"\n', ["helper.h", "stdio.h"]),
]
CALLS = [
    ("main.rs", 'fn main() { parse("a"); render(); obj.connect(); a::bb(); println!("{}", no()); f(); }\nfn parse(s: &str) -> i32 { match x { Some(v) => v, None => go(1) } }\n', ["bb", "connect", "go", "parse", "render"]),
    ("app.js", "const x = parse(data);\nobj.render(ctx);\nconst y = build();\nnew Thing();\nclass A { method(a) { return this.run(a); } }\nconst t = `no() ${yes(`${deep()}`)} no()`;\nif (a / bb(c) / d) { s.replace(/no(x)/g, '') }", ["bb", "build", "deep", "parse", "render", "replace", "run", "yes"]),
    ("a.ts", "interface I { sig(x: number): void }\nasync function f(a: string) { await fetch(a); [1].map(async (x) => x); }\n", ["fetch", "map"]),
    ("s.go", "func (s *S) Run(f func(int) error) interface{} {\n\treturn s.inner.Call(make([]int, 2))\n}\n", ["Call", "make"]),
    ("A.java", 'class A { @Ann(no()) String name() { return obj.get(helper("x(y)")); } A(int x) { init(x); } int z = new B().size(); }', ["get", "helper", "init", "no", "size"]),
    ("app.cpp", "#include <vector>\nint run() {\n  Obj obj;\n  obj.render();\n  ns::build();\n  compute();\n  if (x) return later(1);\n}\n", ["build", "compute", "later", "render"]),
]
DEFINES = [
    ("a.rs", 'pub(crate) async fn a1() {}\n/* fn no() {} /* fn no2() {} */ fn no3() {} */\n// fn no4() {}\nconst S: &str = "fn no5() {}"; static R: &str = r#"fn no6() {} " "#;\ntrait T { fn sig(&self); fn with(&self) { } }\nmod m { enum E { A(u8), B } }\nfn lt<\'a>(x: &\'a str) -> char { \'{\' }\nfn last() {}', [("E", "enum"), ("R", "static"), ("S", "const"), ("T", "trait"), ("a1", "fn"), ("last", "fn"), ("lt", "fn"), ("m", "module"), ("with", "fn")]),
    ("a.go", "type T struct{}\nfunc Fn[K any](k K) (int, error) { return 1, nil }\nfunc (t T) Method() {}\nvar s = `func no() {}`\n", [("Fn", "fn"), ("Method", "method")]),
    ("a.ts", "export function f() {}\nexport default class K {}\ninterface I {}\ntype A<T> = { x: T }\nconst g = () => { function inner() {} }\n// class no {}\nconst s = 'class no2 {}'\nconst h = class Named {}\n", [("A", "type"), ("I", "interface"), ("K", "class"), ("f", "fn"), ("inner", "fn")]),
    ("A.java", '/** class No {} */ public class A<T> { private static Map<String, List<T>> build(int x) throws E { return null; } abstract int size(); enum C { X } interface I {} String t = """\n class No2 { } """; }', [("A", "class"), ("C", "enum"), ("I", "interface"), ("build", "method"), ("size", "method")]),
    ("a.c", '#define MAX(a, b) \\\n  ((a) > (b))\nstatic int *add(int a, int b) { return a; }\nint proto(int);\nstruct S { int x; };\ntypedef struct { int y; } T;\ntypedef int (*cb)(int);\nenum E { A };\nchar *s = "int no(void) { }";\n', [("E", "enum"), ("MAX", "macro"), ("S", "struct"), ("T", "type"), ("add", "fn"), ("cb", "type"), ("proto", "declaration")]),
    ("a.cpp", "namespace n { class G { public: G(int x) : a(x), b{2} { go(); } void greet() const override { } int a; }; }\nvoid G::greet() {}\ntemplate <typename T> T most(T a) { return a; }\nauto s = R\"x(class No {};)x\";\n", [("G", "class"), ("greet", "fn"), ("most", "fn"), ("n", "module")]),
]


@pytest.mark.parametrize(("name", "text", "want"), IMPORTS, ids=[x[0] for x in IMPORTS])
def test_imports(name, text, want):
    assert [n for _, n in edges(name, text, "imports")] == want


@pytest.mark.parametrize(("name", "text", "want"), CALLS, ids=[x[0] for x in CALLS])
def test_calls(name, text, want):
    assert [n for _, n in edges(name, text, "calls")] == want


@pytest.mark.parametrize(("name", "text", "want"), DEFINES, ids=[x[0] for x in DEFINES])
def test_defines(name, text, want):
    assert sorted({(s[0], s[1]) for s in parsers.Registry().parse(name, text.encode()).symbols}) == want


def test_broken_text_is_read_to_its_end():
    for language in lexers.FAMILY:
        for text in ("fn ( { unclosed <<<>>> ??? impl for 123", '"', "`${", "/*", "}})]", "", "class", "impl", "import", "a" * 5000, "{" * 3000):
            lexers.read(text, language)
    assert parsers.Registry().parse("x.h", b"int a(void) { return 1; }").language == "c" and parsers.Registry().parse("x.h++", b"").language == "cpp"
