"""Source files in the scanned languages, in shapes chosen by id, with what a scanner has to find in them.

A shape is (text, symbols, imports); § stands for the id. Symbols: name, kind, signature, first line, last line,
exported, async, parent. Imports: source, identifiers, line. The expected rows are written by hand from the rules of
each language, not taken from the scanner.
"""

from __future__ import annotations

Shape = tuple[str, list[tuple], list[tuple]]

SHAPES: dict[str, tuple[str, list[Shape]]] = {
    "javascript": (
        "js",
        [
            (
                "import def, { one, two as zwei } from './m§';\nconst { a, b: c } = require('./n§');\nexport const up = async (x, y) => x + y;\nconst low = function (z) {\n  return z.replace(/[{(]/g, '') + `t ${up(`{`)} }`;\n};\nconst plain = a / 2;\n",
                [("up", "function", "up(x, y)", 3, 3, 0, 1, None), ("low", "function", "low(z)", 4, 6, 0, 0, None)],
                [("./m§", ["def", "one", "two"], 1), ("./n§", ["a", "c"], 2)],
            ),
            (
                "// class No {\nclass K§ {\n  /* } */\n  async load(id) {\n    const inner = () => id;\n    return inner() / 2;\n  }\n  static of() { return new K§(); }\n}\napp.post('/k/§', check, async (req, res) => {\n  res.send('}');\n});\n",
                [
                    ("K§", "class", "class K§", 2, 9, 0, 0, None), ("load", "method", "load(id)", 4, 7, 0, 1, "K§"), ("inner", "function", "inner()", 5, 5, 0, 0, "load"), ("of", "method", "of()", 8, 8, 0, 0, "K§"),
                    ("POST /k/§", "route", "POST /k/§", 10, 12, 0, 1, None),
                ],
                [],
            ),
            (
                "import './side§';\nfunction outer§(a) {\n  function inner(b) { return b; }\n  return inner(a);\n}\nasync function last() {}\n",
                [("outer§", "function", "function outer§(a) {", 2, 5, 0, 0, None), ("inner", "function", "function inner(b) { return b; }", 3, 3, 0, 0, "outer§"), ("last", "function", "async function last() {}", 6, 6, 0, 1, None)],
                [("./side§", [], 1)],
            ),
        ],
    ),
    "typescript": (
        "ts",
        [
            (
                "import type { T§ } from './t';\nexport interface Shape§ {\n  readonly id: number;\n  area(x: number): string;\n}\nexport enum Color {\n  Red,\n  Green = 'g',\n}\ntype Id = string | number;\nexport function go(a: Id): void {\n  const s = \"{\";\n}\n",
                [
                    ("Shape§", "interface", "interface Shape§", 2, 5, 0, 0, None), ("id", "property", "readonly id: number", 3, 3, 0, 0, "Shape§"), ("area", "method", "area(x: number): string", 4, 4, 0, 0, "Shape§"),
                    ("Color", "enum", "enum Color", 6, 9, 0, 0, None), ("Red", "enum_member", "Red", 7, 7, 0, 0, "Color"), ("Green", "enum_member", "Green = 'g'", 8, 8, 0, 0, "Color"),
                    ("Id", "type", "type Id = string | number;", 10, 10, 0, 0, None), ("go", "function", "export function go(a: Id): void {", 11, 13, 0, 0, None),
                ],
                [("./t", ["T§"], 1)],
            ),
            (
                "import * as fs from 'fs';\nimport base, { x } from './b§';\nclass Svc§ {\n  private n: number = 1;\n  constructor(a: string) {\n    this.n = 2;\n  }\n  async run(id: string): Promise<void> {\n    await go(`${id}}`);\n  }\n}\nexport const make = (k: number): Svc§ => new Svc§();\n",
                [
                    ("Svc§", "class", "class Svc§", 3, 11, 0, 0, None), ("constructor", "method", "constructor(a: string)", 5, 7, 0, 0, "Svc§"), ("run", "method", "run(id: string)", 8, 10, 0, 1, "Svc§"),
                    ("make", "function", "make(k: number)", 12, 12, 0, 0, None),
                ],
                [("fs", [], 1), ("./b§", ["base", "x"], 2)],
            ),
        ],
    ),
    "python": (
        "py",
        [
            (
                "import os, sys as system\nfrom .pkg§ import a, b as c\nfrom x import *\n\n@wraps(f)\n@cache\ndef deco§(x, y=\"(\"):\n    # def no():\n    return 1\n\nasync def go():\n    def inner(z):\n        return z\n    return inner\n",
                [("deco§", "function", "@wraps(f)\n@cache\ndef deco§(x, y=\"(\")", 7, 9, 0, 0, None), ("go", "function", "def go()", 11, 14, 0, 1, None), ("inner", "method", "def inner(z)", 12, 13, 0, 0, "go")],
                [("os", ["os"], 1), (".pkg§", ["a", "b"], 2), ("x", [], 3)],
            ),
            (
                "class Box§(Base):\n    \"\"\"def no(): {\"\"\"\n\n    def area(self, w,\n             h):\n        return w * h\n\n    async def load(self):\n        pass\n\n\ndef tail(): return '}'\n",
                [("Box§", "class", "class Box§", 1, 9, 0, 0, None), ("area", "method", "def area(self, w,\n             h)", 4, 6, 0, 0, "Box§"), ("load", "method", "def load(self)", 8, 9, 0, 1, "Box§"), ("tail", "function", "def tail()", 12, 12, 0, 0, None)],
                [],
            ),
        ],
    ),
    "go": (
        "go",
        [
            (
                "package p§\n\nimport (\n\t\"fmt\"\n\tx \"a/b§\"\n)\n\ntype Box§ struct {\n\tw int\n}\n\nfunc (b *Box§) Area(h int) int {\n\treturn b.w * h // }\n}\n\nconst Max§ = 10\n\nfunc main() {\n\tvar n = 1\n\tfmt.Println(\"{\", n)\n}\n",
                [
                    ("Box§", "class", "type Box§ struct", 8, 10, 0, 0, None), ("Area", "method", "func (b *Box§) Area(h int) int", 12, 14, 0, 0, "Box§"), ("Max§", "constant", "const Max§ = 10", 16, 16, 0, 0, None),
                    ("main", "function", "func main() {", 18, 21, 0, 0, None), ("n", "variable", "var n = 1", 19, 19, 0, 0, "main"),
                ],
                [("fmt", [], 4), ("a/b§", [], 5)],
            ),
            (
                "package q\n\nimport \"os§\"\n\nvar first, second = 1, 2\n\ntype Doer§ interface {\n\tDo(a string) error\n\tStop()\n}\n\ntype ID int\n\nfunc Run(d Doer§) {}\n\nconst (\n\tA = iota\n\tB\n)\n",
                [
                    ("first", "variable", "var first, second = 1, 2", 5, 5, 0, 0, None), ("Do", "method", "Do(a string) error", 8, 8, 0, 0, "Doer§"), ("Stop", "method", "Stop()", 9, 9, 0, 0, "Doer§"),
                    ("Doer§", "interface", "type Doer§ interface", 7, 10, 0, 0, None), ("ID", "type", "type ID int", 12, 12, 0, 0, None), ("Run", "function", "func Run(d Doer§) {}", 14, 14, 0, 0, None),
                    ("A", "constant", "A = iota", 17, 17, 0, 0, None), ("B", "constant", "B", 18, 18, 0, 0, None),
                ],
                [("os§", [], 3)],
            ),
        ],
    ),
    "rust": (
        "rs",
        [
            (
                "use std::fmt;\npub use crate::m§::{a, b};\n\npub struct Box§ {\n    w: u32,\n}\n\nimpl fmt::Display for Box§ {\n    fn fmt(&self, f: &mut F) -> R {\n        write!(f, \"}}\")\n    }\n}\n\npub enum Kind {\n    Plain,\n    Wide(u8),\n}\n\npub const MAX: u32 = 3;\nstatic NAME: &str = \"{\";\n",
                [
                    ("Box§", "class", "struct Box§", 4, 6, 1, 0, None), ("Box§", "impl", "impl fmt::Display for Box§", 8, 12, 0, 0, None), ("fmt", "method", "fn fmt(&self, f: &mut F) -> R", 9, 11, 0, 0, "Box§"),
                    ("Kind", "enum", "enum Kind", 14, 17, 1, 0, None), ("Plain", "enum_member", "Plain", 15, 15, 0, 0, "Kind"), ("Wide", "enum_member", "Wide(u8)", 16, 16, 0, 0, "Kind"),
                    ("MAX", "constant", "pub const MAX: u32 = 3;", 19, 19, 1, 0, None), ("NAME", "variable", "static NAME: &str = \"{\";", 20, 20, 0, 0, None),
                ],
                [("std::fmt", [], 1), ("pub use crate::m§::{a, b}", [], 2)],
            ),
            (
                "pub trait Run§ {\n    fn go(&self, n: i32) -> i32;\n    fn stop(&self);\n}\n\ntype Id = u64;\n\nmacro_rules! say {\n    () => { println!(\"x\") };\n}\n\nfn main§(a: &'static str) {\n    let s = r#\"{ \"#;\n}\n\nimpl Box {\n    pub fn new() -> Self { Box {} }\n}\n",
                [
                    ("Run§", "trait", "trait Run§", 1, 4, 1, 0, None), ("go", "method", "fn go(&self, n: i32) -> i32", 2, 2, 0, 0, "Run§"), ("stop", "method", "fn stop(&self)", 3, 3, 0, 0, "Run§"),
                    ("Id", "type", "type Id = u64;", 6, 6, 0, 0, None), ("say", "macro", "macro_rules! say", 8, 10, 0, 0, None), ("main§", "function", "fn main§(a: &'static str)", 12, 14, 0, 0, None),
                    ("Box", "impl", "impl Box", 16, 18, 0, 0, None), ("new", "method", "fn new() -> Self", 17, 17, 1, 0, "Box"),
                ],
                [],
            ),
        ],
    ),
    "java": (
        "java",
        [
            (
                "package p;\n\nimport java.util.List;\nimport java.io.*;\n\npublic class Box§ {\n    private int w = 1, h;\n\n    public Box§(int w) {\n        this.w = w; // }\n    }\n\n    public String name(List<String> xs) {\n        return \"{\" + '}';\n    }\n\n    void go() { }\n}\n",
                [
                    ("Box§", "class", "class Box§", 6, 18, 0, 0, None), ("w", "property", "private int w = 1, h;", 7, 7, 0, 0, "Box§"), ("h", "property", "private int w = 1, h;", 7, 7, 0, 0, "Box§"), ("Box§", "constructor", "Box§(int w)", 9, 11, 0, 0, "Box§"),
                    ("name", "method", "String name(List<String> xs)", 13, 15, 0, 0, "Box§"), ("go", "method", "void go()", 17, 17, 0, 0, "Box§"),
                ],
                [("java.util.List", ["List"], 3), ("java.io", ["io"], 4)],
            ),
            (
                "import a.B§;\n\ninterface Run§ {\n    int go(int n);\n    void stop();\n}\n\nenum Color {\n    RED, GREEN;\n}\n\n@interface Mark {\n    String value();\n}\n",
                [
                    ("Run§", "interface", "interface Run§", 3, 6, 0, 0, None), ("go", "method", "int go(int n)", 4, 4, 0, 0, "Run§"), ("stop", "method", "void stop()", 5, 5, 0, 0, "Run§"),
                    ("Color", "enum", "enum Color", 8, 10, 0, 0, None), ("RED", "enum_member", "RED", 9, 9, 0, 0, "Color"), ("GREEN", "enum_member", "GREEN", 9, 9, 0, 0, "Color"),
                    ("Mark", "annotation", "@interface Mark", 12, 14, 0, 0, None),
                ],
                [("a.B§", ["B§"], 1)],
            ),
        ],
    ),
    "csharp": (
        "cs",
        [
            (
                "using System;\nusing System.IO;\n\nnamespace App§ {\n    public class Box {\n        private int count;\n        public int Width { get; set; }\n        public Box(int w) {\n            Width = w;\n        }\n        public string Name(int a) {\n            return \"{\" + @\"}\"\"\";\n        }\n    }\n}\n",
                [
                    ("App§", "namespace", "namespace App§", 4, 15, 0, 0, None), ("Box", "class", "class Box", 5, 14, 0, 0, "App§"), ("Width", "property", "int Width", 7, 7, 0, 0, "Box"),
                    ("Box", "constructor", "Box(int w)", 8, 10, 0, 0, "Box"), ("Name", "method", "string Name(int a)", 11, 13, 0, 0, "Box"),
                ],
                [("System", ["System"], 1), ("System.IO", ["IO"], 2)],
            ),
            (
                "using A.B§;\n\npublic struct P§ {\n    public int X { get; }\n    public int Sum() {\n        return X;\n    }\n}\n\npublic enum Color { Red, Green }\n",
                [
                    ("P§", "class", "struct P§", 3, 8, 0, 0, None), ("X", "property", "int X", 4, 4, 0, 0, "P§"), ("Sum", "method", "int Sum()", 5, 7, 0, 0, "P§"),
                    ("Color", "enum", "enum Color", 10, 10, 0, 0, None), ("Red", "enum_member", "Red", 10, 10, 0, 0, "Color"), ("Green", "enum_member", "Green", 10, 10, 0, 0, "Color"),
                ],
                [("A.B§", ["B§"], 1)],
            ),
        ],
    ),
    "typescript_types": (
        "ts",
        [
            (
                "const id§ = <T>(x: T) => x;\nexport const load = async <T, K extends keyof T>(x: T): Promise<Map<K, T[]>> => {\n  const test = (y: { a: number }): y is Foo => y.a < 3 && y.b > 4;\n  return f(x);\n};\nconst k: (x: number) => string = (x) => `${x}`;\nlet n = a < b, m = c > (d);\n",
                [
                    ("id§", "function", "id§(x: T)", 1, 1, 0, 0, None), ("load", "function", "load(x: T)", 2, 5, 0, 1, None), ("test", "function", "test(y: { a: number })", 3, 3, 0, 0, "load"),
                    ("k", "function", "k(x)", 6, 6, 0, 0, None),
                ],
                [],
            ),
            (
                "export default class extends C§<{ q: 1 }> {\n  run<K extends keyof T>(k: K): T[K] {\n    function deep§() {}\n  }\n}\nabstract class Abs<T> {\n  abstract go(): void;\n}\nclass Map§<K extends string = 'a', V = { x: 1 }> extends Base<K, V> {\n  private cache: Map<K, V> = new Map<K, V>();\n  get<T>(key: K): T | undefined { return a < b ? c : d; }\n  async all<T>(): Promise<{ t: T }> {}\n}\n",
                [
                    ("deep§", "function", "function deep§() {}", 3, 3, 0, 0, "run"), ("Map§", "class", "class Map§", 9, 13, 0, 0, None), ("get", "method", "get(key: K)", 11, 11, 0, 0, "Map§"),
                    ("all", "method", "all()", 12, 12, 0, 1, "Map§"),
                ],
                [],
            ),
            (
                "function over(a: string): void;\nfunction over§<T extends { id: number }>(a: T): { x: number } {\n  function inner() {}\n}\ntype Cond§<T = {}> = T extends string ? '}' : { b: T };\ninterface Api§<T extends { a: 1 }> extends Base<T> {\n  get<K>(k: K, o?: { deep: boolean }): Promise<T>;\n  nested: { inner: number; other: string };\n  readonly opt?: string\n  [key: string]: any;\n}\n",
                [
                    ("over§", "function", "function over§<T extends { id: number }>(a: T): { x: number } {", 2, 4, 0, 0, None), ("inner", "function", "function inner() {}", 3, 3, 0, 0, "over§"),
                    ("Cond§", "type", "type Cond§<T = {}> = T extends string ? '}' : { b: T };", 5, 5, 0, 0, None), ("Api§", "interface", "interface Api§", 6, 11, 0, 0, None),
                    ("get", "method", "get<K>(k: K, o?: { deep: boolean }): Promise<T>", 7, 7, 0, 0, "Api§"), ("nested", "property", "nested: { inner: number; other: string }", 8, 8, 0, 0, "Api§"),
                    ("opt", "property", "readonly opt?: string", 9, 9, 0, 0, "Api§"),
                ],
                [],
            ),
        ],
    ),
    "javascript_patterns": (
        "js",
        [
            (
                "class A§ {\n  m(s) { if (s) /}/.test(s); while (s) /{/.exec(s); return (s) / 2 / 3; } get n() { return 1; }\n  static k() {} #p() {}\n}\n",
                [
                    ("A§", "class", "class A§", 1, 4, 0, 0, None), ("m", "method", "m(s)", 2, 2, 0, 0, "A§"), ("n", "method", "n()", 2, 2, 0, 0, "A§"), ("k", "method", "k()", 3, 3, 0, 0, "A§"),
                    ("#p", "method", "#p()", 3, 3, 0, 0, "A§"),
                ],
                [],
            ),
            (
                "export default class extends K§ {\n  load() {\n    function inside§() {}\n  }\n}\nclass B { [Symbol.iterator]() { return a < b && c > (d); } }\nexport async function* gen() {}\n",
                [
                    ("inside§", "function", "function inside§() {}", 3, 3, 0, 0, "load"), ("B", "class", "class B", 6, 6, 0, 0, None), ("[Symbol.iterator]", "method", "[Symbol.iterator]()", 6, 6, 0, 0, "B"),
                ],
                [],
            ),
        ],
    ),
    "csharp_types": (
        "cs",
        [
            (
                "using System;\nusing X§ = Y.Z;\nusing static System.Math;\n\npublic class Box§<T> : Base<T>, IFoo<Dictionary<string, List<T>>> where T : class, new() {\n    private readonly Dictionary<string, List<T>> map = new Dictionary<string, List<T>>();\n    public List<T> Items { get; set; } = new List<T>();\n    public void Run<U>() { }\n    public U N<U>(U t) where U : class { return t; }\n    public Box§(int w) : base(w) { }\n    class Nested { void No() { } }\n}\n",
                [
                    ("Box§", "class", "class Box§", 5, 12, 0, 0, None), ("Items", "property", "List<T> Items", 7, 7, 0, 0, "Box§"), ("Run", "method", "void Run()", 8, 8, 0, 0, "Box§"), ("N", "method", "U N(U t)", 9, 9, 0, 0, "Box§"),
                    ("Box§", "constructor", "Box§(int w)", 10, 10, 0, 0, "Box§"),
                ],
                [("System", ["System"], 1), ("X§", ["X§"], 2), ("System.Math", ["Math"], 3)],
            ),
            (
                "public struct S§<A> {\n    public async Task<Dictionary<string, A>> Go<B, C>(B a, Func<B, C> f) where B : struct where C : new() => await f(a);\n    [Http(\"x\", Y = new[] { 1 })]\n    public (int a, string b) Pair(int[] x) { if (a < b && c > d) { } return (1, \"}\"); }\n    public string Name => \"x\";\n}\npublic interface IThing<T> {\n    int Count { get; }\n    T Get<U>(U u);\n}\n",
                [
                    ("S§", "class", "struct S§", 1, 6, 0, 0, None), ("Go", "method", "Task<Dictionary<string, A>> Go(B a, Func<B, C> f)", 2, 2, 0, 0, "S§"), ("Pair", "method", "(int a, string b) Pair(int[] x)", 3, 4, 0, 0, "S§"),
                    ("Name", "property", "string Name", 5, 5, 0, 0, "S§"), ("IThing", "interface", "interface IThing", 7, 10, 0, 0, None), ("Get", "method", "void Get(U u)", 9, 9, 0, 0, "IThing"),
                ],
                [],
            ),
        ],
    ),
    "java_types": (
        "java",
        [
            (
                "import static a.b.C§.d;\n\npublic class Box§<T extends Comparable<? super T>> extends Base<Map<String, List<T>>> {\n    private final Map<String, List<T>> m = new HashMap<String, List<T>>(), n;\n    @Override\n    public <K, V extends List<K>> Map<K, V> conv(Map<? extends K, V[]> in, int... r) throws E {\n        return a < b ? null : in;\n    }\n    @Inject(value = \"}\", other = @A(1)) Box§(T t) { super(t); }\n    List<String>[] arr() { return null; }\n}\n",
                [
                    ("Box§", "class", "class Box§", 3, 11, 0, 0, None), ("m", "property", "private final Map<String, List<T>> m = new HashMap<String, List<T>>(), n;", 4, 4, 0, 0, "Box§"),
                    ("n", "property", "private final Map<String, List<T>> m = new HashMap<String, List<T>>(), n;", 4, 4, 0, 0, "Box§"), ("conv", "method", "Map<K, V> conv(Map<? extends K, V[]> in, int... r)", 5, 8, 0, 0, "Box§"),
                    ("Box§", "constructor", "Box§(T t)", 9, 9, 0, 0, "Box§"), ("arr", "method", "List<String>[] arr()", 10, 10, 0, 0, "Box§"),
                ],
                [("a.b.C§.d", ["d"], 1)],
            ),
            (
                "interface I§<T> {\n    int X = 1;\n    T get();\n    default <U> U map(Function<T, U> f) { return null; }\n}\n",
                [("I§", "interface", "interface I§", 1, 5, 0, 0, None), ("get", "method", "T get()", 3, 3, 0, 0, "I§"), ("map", "method", "U map(Function<T, U> f)", 4, 4, 0, 0, "I§")],
                [],
            ),
        ],
    ),
    "python_scopes": (
        "py",
        [
            (
                "import os.path, sys, re as r§\nimport numpy as np\n\nclass A§(Base):\n    x = 1\n\n    @property\n    def name(self):\n        def hidden(): pass\n        import inner\n        return 1\n\n    class Nested:\n        def no(self): pass\n\n    if x:\n        def maybe(self): pass\n\ndef plain§():\n    from a import b\n    class Local:\n        def go(self): pass\n    def nested(): pass\n\n@deco\ndef wrapped():\n    import never\n    def nor(): pass\n",
                [
                    ("A§", "class", "class A§", 4, 17, 0, 0, None), ("name", "method", "@property\ndef name(self)", 8, 11, 0, 0, "A§"), ("plain§", "function", "def plain§()", 19, 23, 0, 0, None),
                    ("Local", "class", "class Local", 21, 22, 0, 0, "plain§"), ("go", "method", "def go(self)", 22, 22, 0, 0, "Local"), ("nested", "method", "def nested()", 23, 23, 0, 0, "plain§"),
                    ("wrapped", "function", "@deco\ndef wrapped()", 26, 28, 0, 0, None),
                ],
                [("os.path", ["os.path", "sys"], 1), ("numpy as np", ["numpy as np"], 2), ("a", ["b"], 20)],
            ),
        ],
    ),
    "rust_types": (
        "rs",
        [
            (
                "impl<T: Into<Vec<u8>>, U> Conv<U> for Box§<T> where U: Clone {\n    const N: u32 = 1;\n    pub fn go<F: Fn(T) -> U>(&self, f: F) -> Option<Vec<U>> where F: Copy {\n        fn hidden() {}\n        None\n    }\n}\n\npub trait Run§<T> {\n    fn one(&self) -> T;\n    fn two(&self) -> Vec<T> where T: Clone {\n        fn no() {}\n        vec![]\n    }\n    fn three();\n}\n",
                [
                    ("Box§<T>", "impl", "impl Conv<U> for Box§<T>", 1, 7, 0, 0, None), ("go", "method", "fn go(&self, f: F) -> Option<Vec<U>>", 3, 6, 1, 0, "Box§<T>"), ("Run§", "trait", "trait Run§", 9, 16, 1, 0, None),
                    ("one", "method", "fn one(&self) -> T", 10, 10, 0, 0, "Run§"), ("two", "method", "fn two(&self) -> Vec<T>", 11, 14, 0, 0, "Run§"), ("three", "method", "fn three()", 15, 15, 0, 0, "Run§"),
                ],
                [],
            ),
        ],
    ),
    "go_types": (
        "go",
        [
            (
                "package p\n\ntype Pair§[K comparable, V any] struct {\n\ta K\n}\n\nfunc (p *Pair§[K, V]) Key() K { return p.a }\nfunc Map§[T, U any](xs []T, f func(T) U) []U {\n\treturn nil\n}\n\ntype F func(int) error\n\ntype (\n\tA = int\n\tB map[string]int\n)\n",
                [
                    ("Pair§", "class", "type Pair§ struct", 3, 5, 0, 0, None), ("Key", "method", "func (p *Pair§[K, V]) Key() K", 7, 7, 0, 0, "Pair§[K, V]"), ("Map§", "function", "func Map§[T, U any](xs []T, f func(T) U) []U {", 8, 10, 0, 0, None), ("F", "type", "type F func(int) error", 12, 12, 0, 0, None),
                    ("B", "type", "type B map[string]int", 16, 16, 0, 0, None),
                ],
                [],
            ),
        ],
    ),
}


def literal(text: str) -> str:
    """A string in SQL that both engines read: marks stand for line breaks, tabs and backslashes."""
    for a, b in (("\n", "¶"), ("\t", "→"), ("\\", "¬"), ("'", "''")):
        text = text.replace(a, b)
    return f"'{text}'"


def filled(sql: str, key: str) -> str:
    """The string with its marks replaced, and § by the id."""
    for mark, char in (("¶", "chr(10)"), ("→", "chr(9)"), ("¬", "chr(92)"), ("§", key)):
        sql = f"replace({sql}, '{mark}', {char})"
    return sql


def files_sql(lang: str) -> str:
    """(path, content) for each row of part, the shape by its id."""
    ext, shapes = SHAPES[lang]
    whens = " ".join(f"when {k} then {literal(t)}" for k, (t, _, _) in enumerate(shapes))
    key = "cast(p_partkey as string)"
    content = filled(f"case p_partkey % {len(shapes)} {whens} end", key)
    return f"select concat('lang/f', {key}, '.{ext}') as path, {content} as content from {{part}}".replace("{", "{{").replace("}", "}}").replace("{{part}}", "{part}")


def expected_sql(lang: str, what: str) -> str:
    """The rows of symbols or imports that the files hold."""
    ext, shapes = SHAPES[lang]
    text = lambda x: "cast(null as varchar)" if x is None else literal(x)

    def row(k: int, r: tuple) -> str:
        if what == "symbols":
            cols = dict(zip("nkgseapc", (*map(text, r[:3]), r[3], r[4], r[5], r[6], text(r[7])), strict=True))
        else:
            cols = {"n": text(r[0]), "i": "cast([" + ", ".join(map(literal, r[1])) + "] as varchar[])", "l": r[2]}
        return "{" + ", ".join(f"'{c}': {v}" for c, v in ({"o": k} | cols).items()) + "}"

    rows = {k: [row(i, r) for i, r in enumerate(s[1] if what == "symbols" else s[2])] for k, s in enumerate(shapes)}
    parts = [f"select p_partkey, unnest([{', '.join(v)}]) as r from part where p_partkey % {len(shapes)} = {k}" for k, v in rows.items() if v]
    f = lambda c: filled(f"r.{c}", "cast(p_partkey as varchar)")
    if what == "symbols":
        cols = f"{f('n')} as name, r.k as kind, {f('g')} as signature, cast(r.s as int) as start_line, cast(r.e as int) as end_line, cast(r.a as int) as exported, cast(r.p as int) as async, {f('c')} as parent_class"
    else:
        cols = f"{f('n')} as source, list_transform(r.i, lambda x: replace(x, '§', cast(p_partkey as varchar))) as identifiers, cast(r.l as int) as line"
    return f"select concat('lang/f', p_partkey, '.{ext}') as path, cast(r.o as int) as ordinal, {cols} from ({' union all '.join(parts)})"
