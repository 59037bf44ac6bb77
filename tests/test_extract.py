import pytest

from quern.extract.operator import extract, extract_entities, file_rows
from quern.sources.scan import source_files


def by(rows, key="name"):
    return {r[key]: r for r in rows}


def test_python():
    f, c, t, i = extract('''
import os, numpy as np
from .pkg import thing
async def load(url: str, n=2) -> bytes:
    """Loads it."""
    return await fetch(open(url).read(), Client(url))
class Outer(base.Kind, metaclass=M):
    """Doc."""
    @staticmethod
    @deco(arg=1)
    def __hidden(x): return x.a().b()
    class Inner:
        def _m(self): pass
    def __init__(self): self.go()
''', "python")
    f = by(f)
    assert f["load"]["is_async"] and f["load"]["docstring"] == "Loads it." and f["load"]["return_type"] == "bytes" and f["load"]["signature"] == "load(url: str, n=2)"
    assert set(f["load"]["calls"]) == {"fetch", "open", "read", "Client"}
    kinds = {d["name"]: (d["call_type"], d["is_nested"], d["is_chained"]) for d in f["load"]["call_details"]}
    assert kinds["Client"] == ("constructor", True, False) and kinds["open"] == ("function", True, True) and kinds["fetch"][1:] == (False, False)
    assert f["__hidden"]["is_static"] and f["__hidden"]["access_modifier"] == "private" and f["__hidden"]["decorators"] == ["staticmethod", "deco"] and f["__hidden"]["class_name"] == "Outer"
    assert f["_m"]["class_name"] == "Outer.Inner" and f["__init__"]["is_constructor"] and f["__init__"]["access_modifier"] == "protected"
    assert {x["name"]: x["bases"] for x in c} == {"Outer": ["base.Kind"], "Inner": []} and i == [".pkg", "numpy", "os"] and not t


def test_broken_python_gives_what_it_shows():
    f, c, _, i = extract("import a.b\nclass K(Base):\n    def m(self:\n        go(1)\ndef f(x)\n    return h.k(x)\n", "python")
    assert [x["name"] for x in f] == ["m", "f"] and c[0]["bases"] == ["Base"] and i == ["a.b"] and f[0]["class_name"] == "K"


def test_typescript():
    f, c, t, i = extract('''
import { Alpha, Beta as B } from './lib/util';
export interface Shape { area(): number; }
type Pair<T> = { a: T; b: T };
/** Adds. */
export async function sum<T extends number>(a: T, b: T): Promise<T> { return helper(a).then(Box.of(b)); }
@Injectable()
export abstract class Calc extends Base implements Shape {
  constructor(private x: number) { super(); }
  private static add(a: number): number { if (a) { this.log(a); } return a; }
  #secret() { return 1; }
}
const twice = async (n: number): Promise<number> => { return n * two(); };
''', "typescript")
    f = by(f)
    assert set(f) == {"sum", "constructor", "add", "#secret", "twice"}, set(f)
    assert f["sum"]["is_async"] and f["sum"]["docstring"] == "Adds." and f["sum"]["return_type"] == "Promise<T>" and f["sum"]["type_parameters"][0]["constraint"] == "number"
    assert f["sum"]["calls"] == ["helper", "then", "of"] and {d["name"]: d["call_type"] for d in f["sum"]["call_details"]}["of"] == "static"
    assert f["add"]["access_modifier"] == "private" and f["add"]["is_static"] and f["add"]["class_name"] == "Calc" and f["constructor"]["is_constructor"]
    assert f["#secret"]["access_modifier"] == "private" and f["twice"]["calls"] == ["two"]
    assert c[0]["bases"] == ["Base"] and c[0]["decorators"] == ["Injectable"] and c[0]["is_abstract"] and [(x["name"], x["kind"]) for x in t] == [("Shape", "interface"), ("Pair", "type")]
    assert {"./lib/util", "Alpha"} <= set(i)


def test_javascript():
    f, c, _, i = extract("const a = require('x'); const b = require(\"./y\");\nimport z from 'z';\nfunction one(p) { return new Foo(p); }\nconst two = function () { one(); };\nclass K { run() { a.go(); } }\n", "javascript")
    assert [x["name"] for x in f] == ["one", "two", "run"] and i == ["./y", "x", "z"] and c[0]["name"] == "K" and by(f)["one"]["calls"] == ["Foo"] and by(f)["run"]["call_details"][0]["receiver"] == "a"


def test_go():
    f, c, t, i = extract('package m\nimport (\n "fmt"\n x "net/http"\n)\n// Store keeps.\ntype Store struct { a int }\ntype Reader interface { Read() }\nfunc NewStore(n int) *Store { return build(n) }\n// Get gets.\nfunc (s *Store) Get(k string) (int, error) { fmt.Println(k); return 0, nil }\n', "go")
    f = by(f)
    assert f["NewStore"]["is_constructor"] and f["Get"]["class_name"] == "Store" and f["Get"]["signature"] == "Get(k string)" and f["Get"]["return_type"] == "(int, error)"
    assert f["Get"]["docstring"] == "Get gets." and c[0]["name"] == "Store" and t[0]["kind"] == "interface" and i == ["fmt", "net/http"]


def test_rust():
    f, c, t, i = extract("use crate::a::B;\npub struct P { x: i32 }\nimpl P {\n pub fn new(x: i32) -> Self { helper(x) }\n async fn run<'a, T: Clone>(&'a self, t: T) -> Vec<T> { self.go(); t.clone() }\n}\nimpl Show for P { fn show(&self) {} }\npub enum E { A, B }\ntype N = u8;\n", "rust")
    f = by(f)
    assert f["new"]["is_constructor"] and f["new"]["access_modifier"] == "public" and f["new"]["class_name"] == "P" and f["new"]["return_type"] == "Self"
    assert f["run"]["is_async"] and f["run"]["access_modifier"] == "private" and f["show"]["class_name"] == "P" and [x["kind"] for x in t] == ["enum", "type"] and i == ["crate::a::B"]
    assert [x["name"] for x in c] == ["P", "P", "P"]


def test_java():
    f, c, _, i = extract("package p; import java.util.List; import q.R;\npublic abstract class Dog extends Animal implements Pet, Loud {\n  public Dog(String n) { super(n); }\n  protected static <T> List<T> all(T t) throws X { return Lists.of(t); }\n  @Override void bark() { this.say(\"w\"); }\n}\ninterface Pet { int age(); }\n", "java")
    f = by(f)
    assert f["Dog"]["is_constructor"] and f["all"]["is_static"] and f["all"]["return_type"] == "List<T>" and f["all"]["access_modifier"] == "protected" and f["bark"]["class_name"] == "Dog"
    c = by(c)
    assert c["Dog"]["bases"] == ["Animal"] and c["Dog"]["implements"] == ["Pet", "Loud"] and c["Dog"]["is_abstract"] and c["Pet"]["is_interface"] and i == ["java.util.List", "q.R"]


def test_c_and_cpp():
    f, c, _, i = extract('#include <stdio.h>\n#include "u.h"\nstruct P { int x; };\nstatic int add(int a, int b) { return a + mul(a, b); }\nint main(void) { printf("x"); add(1, 2); done(); }\n', "c")
    assert [x["name"] for x in f] == ["add", "main"] and c[0]["name"] == "P" and i == ["<stdio.h>", "u.h"] and by(f)["main"]["calls"] == ["printf", "add", "done"]
    f, c, _, _ = extract("namespace n { class A : public B { public: void go() const { x.run(); } }; int A::out(int q) { return go2(q); } template <typename T> T best(T a) { return a; } }\n", "cpp")
    f = by(f)
    assert set(f) == {"go", "out", "best"} and f["out"]["class_name"] == "A" and f["go"]["call_details"][0]["receiver"] == "x" and c[0]["bases"] == ["B"]


def test_dart():
    f, c, _, i = extract("""
import 'dart:io';
import 'package:a/b.dart';
part 'x.dart';
class Point extends Shape with M {
  final int x;
  Point(this.x);
  Point.origin() : x = 0;
  factory Point.of(int v) { return Point(v); }
  int get twice => x * 2;
  Future<void> load() async { list.map(f).toList(); builder..add(1)..end(); }
}
mixin M { void mix() {} }
extension Ext on String { bool ok() => true; }
enum Color { red }
int top(int a) { return helper(Point(a)); }
""", "dart")
    names = [x["name"] for x in f]
    assert names == ["Point", "origin", "of", "twice", "load", "mix", "ok", "top"], names
    f = by(f)
    assert all(f[n]["is_constructor"] for n in ("Point", "origin", "of")) and f["load"]["is_async"] and [x["name"] for x in c] == ["Point", "M", "Ext", "Color"]
    got = {d["name"]: (d["call_type"], d["receiver"]) for d in f["load"]["call_details"]}
    assert got["map"] == ("method", "list") and got["add"] == ("method", "builder") and {d["name"]: d["call_type"] for d in f["top"]["call_details"]}["Point"] == "constructor" and len(i) == 3


@pytest.mark.parametrize("language", ["python", "typescript", "javascript", "go", "rust", "java", "c", "cpp", "dart"])
def test_odd_inputs(language):
    for text in ("", "}{)(", "class", "fn (", "def ", "\0�", "a" * 5000, "((((" * 200, "func f(", "import"):
        extract(text, language)
    assert file_rows("p/x", language, None, "r")[-1]["entity_type"] == "file"


def test_scan_and_extract(spark, tmp_path):
    for path, text in {"src/a.py": "def f():\n    g()\n", "src/b.JS": "function g() {}\n", "node_modules/c.js": "x", ".github/d.py": "y = 1\n", "e.txt": "no", "src/bad.py": b"\xff def"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    files = source_files(spark, str(tmp_path))
    assert sorted(r.file_path for r in files.collect()) == [".github/d.py", "src/a.py", "src/b.JS", "src/bad.py"]
    rows = extract_entities(files, "demo").orderBy("file_path", "seq").collect()
    assert [(r.entity_type, r.name) for r in rows] == [("file", "d.py"), ("function", "f"), ("file", "a.py"), ("function", "g"), ("file", "b.JS"), ("file", "bad.py")]
    assert rows[2].defines == ["demo:src/a.py:f"] and rows[2].end_line == 3
