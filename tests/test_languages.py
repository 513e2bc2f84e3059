"""Structure of source files in many languages, documents and broken files."""

import zlib

import pytest

from weftgraph.extract import files as parsers
from weftgraph.extract import languages, pdf

SOURCES = {
    "java": (
        "package a;\nimport java.util.List;\n\n/** A dog.\n * Barks. */\npublic class Dog extends Animal implements Pet {\n    public Dog(int age) { this.age = age; }\n    // Makes noise\n    @Override\n    public String bark(String loud,\n                       int times) throws E {\n        if (times > 0) { speak(loud); }\n        return new Sound(loud).play();\n    }\n}\n",
        {("class", "Dog"), ("method", "Dog.Dog"), ("method", "Dog.bark")},
        {("Dog", "inherits", "*::class::Animal"), ("Dog", "implements", "*::interface::Pet"), ("Dog.bark", "calls", "*::speak"), ("Dog.bark", "references", "*::class::Sound"), ("mod", "imports", "*::module::java.util.List")},
    ),
    "go": (
        'package m\nimport (\n\t"os"\n\tx "net/http"\n)\ntype Server struct {\n\tBase\n\tport int\n}\n// Run it.\nfunc (s *Server) Run(a int) error {\n\tfmt.Println("x {")\n\thelper(a)\n}\nfunc helper(a int) int { return a }\n',
        {("class", "Server"), ("method", "Run"), ("function", "helper")},
        {("Server", "inherits", "*::class::Base"), ("Run", "calls", "*::helper"), ("mod", "imports", "*::module::net/http")},
    ),
    "rust": (
        "use std::fmt::Display;\npub struct Point { x: i32 }\ntrait Shape: Display { fn sides(&self) -> u8; }\nimpl Shape for Point {\n    fn area(&self) -> f64 { compute(self.x) }\n}\npub async fn run() -> i32 { 1 }\n",
        {("class", "Point"), ("interface", "Shape"), ("method", "Point.area"), ("function", "run")},
        {("Point", "inherits", "*::class::Shape"), ("Point", "implements", "*::interface::Shape"), ("Shape", "extends", "*::class::Display"), ("Point.area", "calls", "*::compute")},
    ),
    "c": (
        '#include <stdio.h>\n#define MAX 10\nstruct node { int v; };\nstatic int helper(int a, char *b)\n{\n    printf("x");\n    return a;\n}\nint proto(int);\nint main(void) { return helper(1, "a"); }\n',
        {("variable", "MAX"), ("class", "node"), ("function", "helper"), ("function", "main")},
        {("mod", "imports", "*::module::<stdio.h>"), ("main", "calls", "*::helper")},
    ),
    "cpp": (
        "#include <vector>\nnamespace geo {\nclass Circle : public Shape, private Other<int> {\npublic:\n    double area() const override { return f(r); }\n};\n}\nvoid Circle::grow(double r) { init(); }\n",
        {("module", "geo"), ("class", "Circle"), ("method", "Circle.area"), ("method", "Circle::grow")},
        {("Circle", "inherits", "*::class::Shape"), ("Circle", "inherits", "*::class::Other"), ("Circle.area", "calls", "*::f")},
    ),
    "ruby": (
        "require 'json'\n# A cat\nclass Cat < Animal\n  SIZE = 3\n  def initialize(name)\n    if name\n      setup(name)\n    end\n  end\n  def self.make; Cat.new(1); end\nend\nmodule Util\n  def help(x) = x\nend\n",
        {("class", "Cat"), ("variable", "SIZE"), ("method", "Cat.initialize"), ("method", "Cat.make"), ("module", "Util"), ("method", "help")},
        {("Cat", "inherits", "*::class::Animal"), ("Cat.initialize", "calls", "*::setup"), ("mod", "imports", "*::module::json")},
    ),
    "php": (
        "<?php\nuse App\\User;\nclass A extends B implements C {\n  public function go(int $x): string { return foo($x); }\n}\nfunction top($a) { return new A(); }\n",
        {("class", "A"), ("method", "A.go"), ("function", "top")},
        {("A", "inherits", "*::class::B"), ("A", "implements", "*::interface::C"), ("A.go", "calls", "*::foo"), ("mod", "imports", "*::module::App\\User")},
    ),
    "swift": ("import UIKit\nclass View: UIView, Proto {\n  func draw(_ r: Int) -> String { helper(r) }\n}\nprotocol Proto { func go() }\n", {("class", "View"), ("method", "View.draw"), ("interface", "Proto")}, {("View", "inherits", "*::class::UIView"), ("View.draw", "calls", "*::helper")}),
    "kotlin": ("import a.b.C\nclass Foo(val x: Int) : Base(x), Iface {\n    override fun go(a: Int): String { return call(a) }\n}\nfun top() = Foo(3)\n", {("class", "Foo"), ("method", "Foo.go"), ("function", "top")}, {("Foo", "inherits", "*::class::Base"), ("Foo", "inherits", "*::class::Iface"), ("Foo.go", "calls", "*::call")}),
    "c_sharp": ("using System.Text;\nnamespace My.App {\n  public class Foo : Bar, IThing {\n    public async Task<int> Go(int a) { return await Call(a); }\n  }\n  interface IThing { }\n}\n", {("module", "My.App"), ("class", "Foo"), ("method", "Foo.Go"), ("interface", "IThing")}, {("Foo", "inherits", "*::class::Bar"), ("Foo.Go", "calls", "*::Call"), ("mod", "imports", "*::module::System.Text")}),
    "objc": ("#import <F/F.h>\n@interface Dog : Animal <Pet>\n- (void)bark:(int)n;\n@end\nint helper(int a) {\n  return a;\n}\n", {("class", "Dog"), ("method", "Dog.bark"), ("function", "helper")}, {("Dog", "inherits", "*::class::Animal"), ("Dog", "implements", "*::interface::Pet")}),
    "scala": ("import a.b\nclass A(x: Int) extends B(x) with C {\n  def go(a: Int): String = { call(a) }\n}\ntrait C { }\n", {("class", "A"), ("method", "A.go"), ("interface", "C")}, {("A", "inherits", "*::class::B"), ("A", "inherits", "*::class::C"), ("A.go", "calls", "*::call")}),
    "lua": ('local json = require("json")\n-- helps\nlocal function help(a)\n  if a then return call(a) end\nend\nfunction M.go(x)\n  help(x)\nend\n', {("function", "help"), ("function", "M.go")}, {("help", "calls", "*::call"), ("M.go", "calls", "*::help"), ("mod", "imports", "*::module::json")}),
    "shell": ('source ./lib.sh\nMAX=3\nrun() {\n  echo "hi"\n}\nfunction other {\n  run\n}\n', {("variable", "MAX"), ("function", "run"), ("function", "other")}, {("mod", "imports", "*::module::./lib.sh")}),
    "r": ("library(dplyr)\nadd <- function(a, b) {\n  total(a, b)\n}\n", {("function", "add")}, {("add", "calls", "*::total"), ("mod", "imports", "*::module::dplyr")}),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_structure(language):
    source, nodes, edges = SOURCES[language]
    f = parsers.parse("src/mod.x", language, source.encode())
    assert {(n["kind"], n["name"]) for n in f.nodes[1:]} >= nodes and f.nodes[0]["kind"] == "module"
    name = {n["id"]: n["name"] for n in f.nodes}
    found = {(name.get(e["source"]), e["relation"], e["target"]) for e in f.edges}
    assert found >= edges
    assert all(any(e["relation"] == "defines" and e["target"] == n["id"] for e in f.edges) for n in f.nodes[1:])
    assert language in languages.supported()


def test_signatures_and_comments():
    f = parsers.parse("src/mod.java", "java", SOURCES["java"][0].encode())
    by = {n["name"]: n for n in f.nodes}
    assert by["Dog"]["docstring"] == "A dog.\nBarks." and by["Dog.bark"]["docstring"] == "Makes noise"
    assert by["Dog.bark"]["signature"] == "(String loud, int times)" and (by["Dog.bark"]["start_line"], by["Dog.bark"]["end_line"]) == (9, 13)
    assert by["Dog"]["source_snippet"].endswith("}")


@pytest.mark.parametrize("language", sorted(languages.LANGUAGES))
@pytest.mark.parametrize("text", ["", "}}}}", "{{{{", '"', "class", "/*", "class A {\n" * 300, "end\n" * 50, "function f(" + "(" * 500])
def test_structure_of_broken_files(language, text):
    assert parsers.parse("a/b.x", language, text.encode()).nodes[0]["kind"] == "module"


def a_pdf(texts):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(texts), b" ".join(b"%d 0 R" % (3 + 2 * k) for k in range(len(texts))))]
    for k, text in enumerate(texts):
        stream = zlib.compress(b"BT /F1 12 Tf 10 10 Td (" + text + b") Tj ET")
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * k), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream)]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (k, o) for k, o in enumerate(objects, 1)) + b"\n%%EOF"


def test_pdf_pages():
    data = a_pdf([rb"Hello \(world\)", b"", rb"caf\351"])
    assert pdf.pages(data) == ["Hello (world)", "", "café"] and pdf.pages(b"\xff\x00 no") == []
    f = parsers.parse("doc.pdf", "pdf", data)
    assert [(n["kind"], n["name"]) for n in f.nodes] == [("document", "doc"), ("section", "Page 1"), ("section", "Page 3")]


def test_bytes_that_are_no_text(spark):
    rows = [("a.py", "python", b"# caf\xe9\nX_Y = 1\n\n\ndef f():\n    pass\n"), ("b.pdf", "pdf", b"%PDF\xff\xfe"), ("c.json", "json", b"{\xff"), ("d.md", "markdown", b"# T\xe4st\n")]
    nodes, _ = parsers.extract(spark.createDataFrame(rows, "path string, language string, content binary"))
    got = {(r.file_path, r.kind, r.name) for r in nodes.collect()}
    assert {("a.py", "function", "f"), ("b.pdf", "document", "b"), ("c.json", "document", "c"), ("d.md", "section", "T�st")} <= got
