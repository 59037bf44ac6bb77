"""Small sources in all nine languages, and what the extraction has to find in them, written by hand.

The queries run the extraction operator over these sources; the SQL of each is the expected table itself. Between
them the sources hold what the driver's tables lack: types, Dart, C and C++, generics, constructors, calls of every kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.operator import extract_entities
from ..operators import entities as E
from ..operators.imports import language_of

PYTHON = '''import os, numpy as np
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

    @abc.abstractmethod
    def run(self):
        def helper():
            Registry.find()
        helper()

    def __init__(self): self.go()
'''
TYPESCRIPT = '''import { Alpha, Beta as B } from './lib/util';
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
'''
JAVASCRIPT = '''const a = require('x');
const b = require("./y");
import z from 'z';
/** One. */
function one(p) { return new Foo(p); }
const two = function () { one(); };
class K { run() { a.go(); } }
'''
GO = '''package m
import (
 "fmt"
 x "net/http"
)
type Store struct { a int }
type Reader interface { Read() }
func NewStore(n int) *Store { return build(n) }
// Get gets.
func (s *Store) Get(k string) (int, error) { fmt.Println(k); return 0, nil }
'''
RUST = '''use crate::a::B;
pub struct P { x: i32 }
impl P {
 pub fn new(x: i32) -> Self { helper(x) }
 async fn run<T: Clone>(&self, t: T) -> Vec<T> { self.go(); t.clone() }
}
pub enum E { A, B }
type N = u8;
'''
JAVA = '''package p;
import java.util.List;
import q.R;
public abstract class Dog extends Animal implements Pet, Loud {
  public Dog(String n) { super(n); }
  protected static <T> List<T> all(T t) throws X { return Lists.of(t); }
  @Override void bark() { this.say("w"); }
}
interface Pet { int age(); }
'''
C = '''#include <stdio.h>
#include "u.h"
struct P { int x; };
static int add(int a, int b) { return a + mul(a, b); }
int main(void) { printf("x"); add(1, 2); done(); }
'''
CPP = '''#include "a.hpp"
class A : public B { public: void go() const { x.run(); } };
int A::out(int q) { return go2(q); }
'''
DART = '''import 'dart:io';
part 'x.dart';
class Point extends Shape {
  Point(this.x);
  Point.origin() : x = 0;
  factory Point.of(int v) { return Point(v); }
  int get twice => x * 2;
  void load() { list.map(f).toList(); builder..add(1)..end(); }
}
mixin M { void mix() {} }
extension Ext on String { bool ok() => true; }
enum Color { red }
int top(int a) { return helper(Point(a)); }
'''
SOURCES = {"s/a.py": PYTHON, "s/b.ts": TYPESCRIPT, "s/c.js": JAVASCRIPT, "s/d.go": GO, "s/e.rs": RUST, "s/F.java": JAVA, "s/g.c": C, "s/h.cpp": CPP, "s/i.dart": DART, "s/none.py": "", "s/bad.py": "def x(:\n"}


def values_sql(columns: str, rows: list[tuple]) -> str:
    """``select * from (values ...)`` of some rows."""

    def one(v) -> str:
        return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return f"select * from (values {body}) t({columns})"


def snippets(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(SOURCES.items()), "file_path string, text string")
    return extract_entities(rows.select("file_path", language_of(F.col("file_path")).alias("language"), F.encode("text", "UTF-8").alias("content")), "snippets")


def _joined(name: str):
    return F.array_join(F.coalesce(F.col(name), F.array().cast("array<string>")), ",").alias(name)


def extract_functions(spark: SparkSession, d: str) -> DataFrame:
    """Name, class, signature, flags and lines of every function."""
    rows = snippets(spark).where("entity_type = 'function'")
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    flags = F.concat(*[F.when(flag(n), letter).otherwise("-") for n, letter in (("is_async", "a"), ("is_constructor", "c"), ("is_static", "s"), ("is_abstract", "b"))])
    return rows.select("file_path", "name", "class_name", "signature", "docstring", "return_type", "access_modifier", flags.alias("flags"), _joined("decorators"), "start_line", "end_line")


def extract_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The code of every function that fills whole lines."""
    return snippets(spark).where("entity_type = 'function' and file_path in ('s/a.py', 's/d.go', 's/g.c')").select("file_path", "name", "code")


def extract_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = snippets(spark).where("entity_type = 'class'")
    flags = F.concat(*[F.when(F.coalesce(F.col(n), F.lit(False)), letter).otherwise("-") for n, letter in (("is_abstract", "b"), ("is_interface", "i"))])
    return rows.select("file_path", "name", "docstring", "start_line", _joined("bases"), _joined("implements"), _joined("methods"), _joined("decorators"), flags.alias("flags"))


def extract_types(spark: SparkSession, d: str) -> DataFrame:
    """Type rows with the id, the hash and the text to embed that follow from them."""
    rows = E.embeddable(E.identified(snippets(spark))).where("entity_type = 'type'")
    return rows.select("id", "name", "kind", "start_line", "code", "content_hash", E.embedding_text().alias("text"))


def extract_imports(spark: SparkSession, d: str) -> DataFrame:
    return snippets(spark).where("entity_type = 'file'").select("file_path", F.explode("imports").alias("import"))


def extract_files(spark: SparkSession, d: str) -> DataFrame:
    return snippets(spark).where("entity_type = 'file'").select("file_path", "name", "language", "start_line", "end_line", F.size("defines").alias("defined"), F.array_join(F.array_sort("defines"), ",").alias("defines"))


def extract_calls(spark: SparkSession, d: str) -> DataFrame:
    """Every call with its kind, receiver and place in other calls."""
    rows = snippets(spark).where("entity_type = 'function'").select("file_path", F.col("name").alias("function"), F.posexplode("call_details").alias("pos", "c"))
    return rows.select("file_path", "function", "c.name", "c.call_type", "c.receiver", "c.is_nested", "c.is_chained").distinct()


def extract_call_names(spark: SparkSession, d: str) -> DataFrame:
    """The distinct names a function calls."""
    return snippets(spark).where("entity_type = 'function'").select("file_path", F.col("name").alias("function"), F.array_join(F.array_sort("calls"), ",").alias("calls"))


def extract_type_parameters(spark: SparkSession, d: str) -> DataFrame:
    rows = snippets(spark).where("entity_type = 'function'").select("file_path", F.col("name").alias("function"), F.explode("type_parameters").alias("t"))
    return rows.select("file_path", "function", "t.name", F.col("t.constraint").alias("bound"))


_FUNCTIONS = [
    ("s/a.py", "load", None, "load(url: str, n=2)", "Loads it.", "bytes", None, "a---", "", 4, 6),
    ("s/a.py", "__hidden", "Outer", "__hidden(x)", None, None, "private", "--s-", "staticmethod,deco", 12, 12),
    ("s/a.py", "_m", "Outer.Inner", "_m(self)", None, None, "protected", "----", "", 15, 15),
    ("s/a.py", "run", "Outer", "run(self)", None, None, None, "---b", "abc.abstractmethod", 18, 21),
    ("s/a.py", "helper", "Outer", "helper()", None, None, None, "----", "", 19, 20),
    ("s/a.py", "__init__", "Outer", "__init__(self)", None, None, "protected", "-c--", "", 23, 23),
    ("s/b.ts", "sum", None, "sum(a: T, b: T)", "Adds.", "Promise<T>", None, "a---", "", 5, 5),
    ("s/b.ts", "constructor", "Calc", "constructor(private x: number)", None, None, None, "-c--", "", 8, 8),
    ("s/b.ts", "add", "Calc", "add(a: number)", None, "number", "private", "--s-", "", 9, 9),
    ("s/b.ts", "#secret", "Calc", "#secret()", None, None, "private", "----", "", 10, 10),
    ("s/b.ts", "twice", None, "twice(n: number)", None, "Promise<number>", None, "a---", "", 12, 12),
    ("s/c.js", "one", None, "one(p)", "One.", None, None, "----", "", 5, 5),
    ("s/c.js", "two", None, "two()", None, None, None, "----", "", 6, 6),
    ("s/c.js", "run", "K", "run()", None, None, None, "----", "", 7, 7),
    ("s/d.go", "NewStore", None, "NewStore(n int)", None, "*Store", None, "-c--", "", 8, 8),
    ("s/d.go", "Get", "Store", "Get(k string)", "Get gets.", "(int, error)", None, "----", "", 10, 10),
    ("s/e.rs", "new", "P", "new(x: i32)", None, "Self", "public", "-c--", "", 4, 4),
    ("s/e.rs", "run", "P", "run(&self, t: T)", None, "Vec<T>", "private", "a---", "", 5, 5),
    ("s/F.java", "Dog", "Dog", "Dog(String n)", None, None, "public", "-c--", "", 5, 5),
    ("s/F.java", "all", "Dog", "all(T t)", None, "List<T>", "protected", "--s-", "", 6, 6),
    ("s/F.java", "bark", "Dog", "bark()", None, "void", "package", "----", "", 7, 7),
    ("s/g.c", "add", None, "add(int a, int b)", None, None, None, "----", "", 4, 4),
    ("s/g.c", "main", None, "main(void)", None, None, None, "----", "", 5, 5),
    ("s/h.cpp", "go", "A", "go()", None, None, None, "----", "", 2, 2),
    ("s/h.cpp", "out", "A", "out(int q)", None, None, None, "----", "", 3, 3),
    ("s/i.dart", "Point", "Point", "Point(this.x)", None, None, None, "-c--", "", 4, 4),
    ("s/i.dart", "origin", "Point", "origin()", None, None, None, "-c--", "", 5, 5),
    ("s/i.dart", "of", "Point", "of(int v)", None, None, None, "-c--", "", 6, 6),
    ("s/i.dart", "twice", "Point", "twice()", None, None, None, "----", "", 7, 7),
    ("s/i.dart", "load", "Point", "load()", None, None, None, "----", "", 8, 8),
    ("s/i.dart", "mix", "M", "mix()", None, None, None, "----", "", 10, 10),
    ("s/i.dart", "ok", "Ext", "ok()", None, None, None, "----", "", 11, 11),
    ("s/i.dart", "top", None, "top(int a)", None, None, None, "----", "", 13, 13),
    ("s/bad.py", "x", None, "x()", None, None, None, "----", "", 1, 1),
]
_CLASSES = [
    ("s/a.py", "Outer", "Doc.", 8, "base.Kind", "", "__hidden,_m,run,helper,__init__", "", "--"), ("s/a.py", "Inner", None, 14, "", "", "_m", "", "--"),
    ("s/b.ts", "Calc", None, 7, "Base", "", "constructor,add,#secret", "Injectable", "b-"), ("s/c.js", "K", None, 7, "", "", "run", "", "--"), ("s/d.go", "Store", None, 6, "", "", "", "", "--"),
    ("s/e.rs", "P", None, 2, "", "", "", "", "--"), ("s/e.rs", "P", None, 3, "", "", "new,run", "", "--"), ("s/F.java", "Dog", None, 4, "Animal", "Pet,Loud", "all,bark", "", "b-"), ("s/F.java", "Pet", None, 9, "", "", "age", "", "-i"),
    ("s/g.c", "P", None, 3, "", "", "", "", "--"), ("s/h.cpp", "A", None, 2, "B", "", "go", "", "--"),
    ("s/i.dart", "Point", None, 3, "Shape", "", "Point,origin,of,twice,load", "", "--"), ("s/i.dart", "M", None, 10, "", "", "mix", "", "--"), ("s/i.dart", "Ext", None, 11, "", "", "ok", "", "--"), ("s/i.dart", "Color", None, 12, "", "", "", "", "--"),
]
_TYPES = [
    ("s/b.ts", "Shape", "interface", 2, "interface Shape { area(): number; }"), ("s/b.ts", "Pair", "type", 3, "type Pair<T> = { a: T; b: T };"), ("s/d.go", "Reader", "interface", 7, "type Reader interface { Read() }"),
    ("s/e.rs", "E", "enum", 7, "pub enum E { A, B }"), ("s/e.rs", "N", "type", 8, "type N = u8;"),
]
_IMPORTS = [
    ("s/a.py", "os"), ("s/a.py", "numpy"), ("s/a.py", ".pkg"), ("s/b.ts", "./lib/util"), ("s/b.ts", "Alpha"), ("s/b.ts", "Beta"), ("s/c.js", "x"), ("s/c.js", "./y"), ("s/c.js", "z"), ("s/d.go", "fmt"), ("s/d.go", "net/http"),
    ("s/e.rs", "crate::a::B"), ("s/F.java", "java.util.List"), ("s/F.java", "q.R"), ("s/g.c", "<stdio.h>"), ("s/g.c", "u.h"), ("s/h.cpp", "a.hpp"), ("s/i.dart", "dart:io"), ("s/i.dart", "x.dart"),
]
_CALLS = [
    ("s/a.py", "load", "fetch", "function", None, False, False), ("s/a.py", "load", "open", "function", None, True, True), ("s/a.py", "load", "read", "method", "open", True, False), ("s/a.py", "load", "Client", "constructor", None, True, False),
    ("s/a.py", "__hidden", "a", "method", "x", False, True), ("s/a.py", "__hidden", "b", "method", "x", False, False), ("s/a.py", "run", "helper", "function", None, False, False), ("s/a.py", "run", "find", "static", "Registry", False, False),
    ("s/a.py", "helper", "find", "static", "Registry", False, False), ("s/a.py", "__init__", "go", "method", "self", False, False),
    ("s/b.ts", "sum", "helper", "function", None, False, True), ("s/b.ts", "sum", "then", "method", "helper", False, False), ("s/b.ts", "sum", "of", "static", "Box", True, False), ("s/b.ts", "add", "log", "method", "this", False, False), ("s/b.ts", "twice", "two", "function", None, False, False),
    ("s/c.js", "one", "Foo", "function", None, False, False), ("s/c.js", "two", "one", "function", None, False, False), ("s/c.js", "run", "go", "method", "a", False, False),
    ("s/d.go", "NewStore", "build", "function", None, False, False), ("s/d.go", "Get", "Println", "method", "fmt", False, False),
    ("s/e.rs", "new", "helper", "function", None, False, False), ("s/e.rs", "run", "go", "method", "self", False, False), ("s/e.rs", "run", "clone", "method", "t", False, False),
    ("s/F.java", "all", "of", "static", "Lists", False, False), ("s/F.java", "bark", "say", "method", "this", False, False),
    ("s/g.c", "add", "mul", "function", None, False, False), ("s/g.c", "main", "printf", "function", None, False, False), ("s/g.c", "main", "add", "function", None, False, False), ("s/g.c", "main", "done", "function", None, False, False),
    ("s/h.cpp", "go", "run", "method", "x", False, False), ("s/h.cpp", "out", "go2", "function", None, False, False),
    ("s/i.dart", "of", "Point", "constructor", None, False, False), ("s/i.dart", "load", "map", "method", "list", False, True), ("s/i.dart", "load", "toList", "method", "list", False, False), ("s/i.dart", "load", "add", "method", "builder", False, False),
    ("s/i.dart", "load", "end", "method", "builder", False, False), ("s/i.dart", "top", "helper", "function", None, False, False), ("s/i.dart", "top", "Point", "constructor", None, True, False),
]
_LANGUAGES = {"py": "python", "ts": "typescript", "js": "javascript", "go": "go", "rs": "rust", "java": "java", "c": "c", "cpp": "cpp", "dart": "dart"}


def _ids(path: str) -> list[str]:
    full = lambda r: f"{r[2]}.{r[1]}" if r[2] else r[1]
    return [f"snippets:{path}:{n}" for n in [*(full(r) for r in _FUNCTIONS if r[0] == path), *(r[1] for r in _CLASSES if r[0] == path), *(r[1] for r in _TYPES if r[0] == path)]]


_FILES = [(p, p[2:], _LANGUAGES[p.rsplit(".", 1)[1]], 1, t.count("\n") + 1, len(_ids(p)), ",".join(sorted(_ids(p)))) for p, t in SOURCES.items()]
_NAMES = [(r[0], r[1], ",".join(sorted({c[2] for c in _CALLS if c[:2] == r[:2]}))) for r in _FUNCTIONS]

QUERIES = {
    "extract_functions": extract_functions, "extract_bodies": extract_bodies, "extract_classes": extract_classes, "extract_types": extract_types, "extract_imports": extract_imports, "extract_files": extract_files,
    "extract_calls": extract_calls, "extract_call_names": extract_call_names, "extract_type_parameters": extract_type_parameters,
}
_TEXTS = values_sql("file_path, text", list(SOURCES.items()))
_LINES = values_sql("file_path, name, first, last", [(r[0], r[1], r[9], r[10]) for r in _FUNCTIONS if r[0] in ("s/a.py", "s/d.go", "s/g.c")])
ORACLES = {
    "extract_functions": values_sql("file_path, name, class_name, signature, docstring, return_type, access_modifier, flags, decorators, start_line, end_line", _FUNCTIONS),
    "extract_bodies": f"select file_path, name, trim(array_to_string(list_slice(string_split(text, chr(10)), first, last), chr(10))) as code from ({_LINES}) join ({_TEXTS}) using (file_path)",
    "extract_classes": values_sql("file_path, name, docstring, start_line, bases, implements, methods, decorators, flags", _CLASSES),
    "extract_types": f"select 'snippets:' || p || ':' || name as id, name, kind, start_line, code, sha256(code) as content_hash, 'File: ' || p || chr(10) || 'Type: ' || name || chr(10) || 'Kind: ' || kind || chr(10) || 'Definition:' || chr(10) || code as text from ({values_sql('p, name, kind, start_line, code', _TYPES)})",
    "extract_imports": values_sql('file_path, "import"', _IMPORTS),
    "extract_files": values_sql("file_path, name, language, start_line, end_line, defined, defines", _FILES),
    "extract_calls": values_sql("file_path, function, name, call_type, receiver, is_nested, is_chained", _CALLS),
    "extract_call_names": values_sql("file_path, function, calls", _NAMES),
    "extract_type_parameters": values_sql("file_path, function, name, bound", [("s/b.ts", "sum", "T", "number"), ("s/e.rs", "run", "T", "Clone"), ("s/F.java", "all", "T", None)]),
}
