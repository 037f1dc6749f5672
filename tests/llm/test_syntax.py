import ast
import random
import warnings

import pytest

from cairn.llm.syntax import invalid_ids

VALID_PY = [
    "", "# only a comment", "﻿x = 1\n", "x = 1", "def f(a, /, b: int = 1, *args, c, **kw) -> list[int]:\n    return [*args, a if a else -b]\n",
    "class A(B, metaclass=M):\n    '''doc <<<<<<< HEAD'''\n    x: int = 3\n\n    @property\n    async def f(self):\n        async with a as b, c:\n            await b\n        async for i in c: pass\n",
    "try:\n    x\nexcept (A, B) as e:\n    raise X from e\nelse:\n    y\nfinally:\n    z\n", "if (n := 3) > 2: x = 1; y = 2\nelif not a in b: pass\nelse: z\n",
    "s = f\"a {x!r:>{w}} {{}}\" 'b' r'\\d'\nt = b'''c'''\n", "a = lambda x, *y, z=1: x\nb = yield_ = {**a, 'k': [i for i in range(3) if i]}\n", "match x:\n    case [1, *rest] if rest:\n        pass\n    case _:\n        pass\n",
    "from . import a\nfrom ..b.c import (d as e,\n   f)\nimport g.h as i, j\n", "x[1:2, ::3] = y = not z\ndel x, y\nglobal q\nassert a, 'b'\nprint(*a, **b)\nx @= y ** -z\n", "while a:\n    if b: break\n    continue\nelse:\n    pass\n",
    "x = (1 +\n  2)\n\n\n  # c\ny = \\\n  3\n", "type X[T] = list[T]\nmatch = case = 1\nprint(match)\n", "def f():\n\treturn 1\n", "x = 1\r\nif x:\r\n    y\r\n",
]
INVALID_PY = [
    "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "def f(:\n  pass", "x = (1", "def f():\n", "def f():\nx = 1\n", "if a:\n    b\n  c\n", "x = 'abc\n", "x = '''abc", "try:\n    x\n", "x +\n", "import\n", "assert x !=\n",
    "const x = 3;\n", "use crate::a;\n", "export function f() {}\n", "  x = 1\n", "else:\n    x\n", "try:\n    x\nexcept KeyError\n", "@d\n", "x = a if b\n", "f(a b)\n", "x = {1: }\n", "for x y:\n    z\n", "(]\n", "// c\n",
]
VALID_RS = [
    "", "// c", "/* a /* b */ c */", "use a::{b, c::D};\n", "/// doc\n#[inline]\npub(crate) fn f<'a, T: Into<u32>>(x: &'a str, mut y: Vec<Vec<u8>>) -> Result<(), E> where T: X {\n let c = '{'; let r = r#\"a \" }\"#; match x { Some(y) if y > 0 => z?, _ => 0..=5, };\n for i in 0..n { a[i] += 1; } loop { break 'a; }\n Ok(())\n}\n",
    "impl<'a> A<'a> for B<'a> { const X: u8 = 1; fn f(&mut self) { self.x.await; } }\npub struct S(pub u8);\nenum E { A, B { x: u8 } }\ntrait T { fn f(&self); }\ntype X = Y<u8>;\nstatic mut Z: [u8; 3] = [0; 3];\nmod m;\n",
    "macro_rules! m { ($x:expr, $($y:tt)*) => { $x + 1 } }\nm! { a b c }\n", "#![allow(x)]\n", "const A: fn(u8) -> u8 = |x| x;\nextern \"C\" fn g() {}\n", "// x\n// <<<<<<< a", "fn f() { let s = \"a\n<<<<<<< b\n\"; }\n",
]
VALID_RS += [
    "fn f() { if a.b() { c() } else if let Some(x) = y { z } while a() > 0 { b(); } match a() { B { x, .. } if x > 0 => { c() } _ => d {}, } }\n",
    "fn f() -> impl Fn(u8) -> u8 { let g = |x: u8| -> u8 { x }; let s = S { a: 1, ..b() }; unsafe { h(); } async move { k().await } }\n",
    "impl<F> T for F where F: Fn(u8) -> u8 { pub fn g(&self) where Self: Sized {} }\nstruct P { pub a: u8, pub b: fn(u8) -> u8 }\n",
    "fn f() { for (i, x) in a.iter().enumerate() { b[i] = x; } let Some(y) = z() else { return; }; let t = if a() { 1 } else { 2 }; let v = for_each(|x| x); 'a: loop { break 'a; } }\n",
    "macro_rules! m { ($x:ident in $y:expr) => { for $x in $y { $x.f() } } }\nfn f() { v![1, 2]; m!(a in b()); const N: usize = 3; static S: [u8; 2] = [1, 2]; }\n",
]
INVALID_RS = [
    "fn f() { a.len() > 6 { b(); } }", "fn f() { x.is_empty() { b(); } }", "fn f() { x in y.iter() { b(); } }", "impl A { pub g(&self) {} }", "impl A { g(&self) -> u8 { 1 } }", "impl A { pub async g(&self) {} }",
    "fn f() { let a = b()? if c { d } }",
    "fn f() {", "fn f( -> u8 {}", "fn f() { let x = ; }", "use a::b", "def f(self):\n    pass\n", "export const a = 1;\n", "fn f() {}\n<<<<<<< HEAD\nfn g() {}\n=======\n>>>>>>> x\n", "/// doc only\n", "pub struct A", "fn f() { x y }", "fn f() { \"abc }", "/* open", "# comment\n",
    "fn f() { (] }", "const x = 3;\n",
]
VALID_TS = [
    "", "// c", "/* c */", "import a, { b as c } from \"./x\";\nimport * as d from 'y'\nexport * from \"z\";\n", "export default async function* f<T>(a: T, b?: number, ...c: any[]): Promise<Map<string, T>> {\n  const r = a.replace(/[{(\"']x+/g, \"y\") ?? `a ${b ? `n ${c}` : '}'} }`;\n  for (const x of c) { if (x) continue; }\n  return r!;\n}\n",
    "export abstract class A<T> extends B implements C {\n  private readonly x: number = 1;\n  static async f(): Promise<void> { await 1; }\n  get y() { return this.x / 2 / 3; }\n  abstract z(): void;\n}\n",
    "export interface I { a: string; b?(x: number): void }\ntype X = A | B & { c: number };\nexport const f = async (x: number): Promise<any> => { return { ...x }; };\nlet a = 1\nlet b = 2\n", "enum E { A = 1, B }\n@dec()\nclass C {}\nexport { E as default };\ndeclare module 'm' { }\n", "a\n  .b()\n  .c();\nx = y as unknown as Z;\n", "// a\n// =======",
]
VALID_TS += [
    "export default class A<T> { constructor(private x: number) {} f(a: string): a is B { return true; } get [k]() { return 1; } static { g(); } }\nexport = A;\nexport as namespace N;\n",
    "declare global { interface W { x: number } }\nexport declare global { var y: number; }\nexport const { a, b } = c;\nexport { a as default } from './x';\nimport d, { e } from './y';\nimport './z';\nimport type { F } from './t';\n",
    "if (a) { b(); } else if (c) { d(); } else { e(); }\nfor (const x of y) { z(x); }\nwhile (a) { b(); }\nswitch (a) { case 1: { b(); break; } default: c(); }\ntry { a(); } catch { b(); } finally { c(); }\ndo { a(); } while (b)\n",
    "const o = { f(x: number) { return x; }, async g() { await h(); }, 'k'() { return 1; }, [m]: (a) => { n(); } };\nlabel: for (;;) { break label; }\n(function () { a(); })();\n(() => { b(); })();\n",
    "namespace N { export function f(): void {} }\nabstract class B { abstract g(): void; protected h(): Promise<{ a: number }> { return k(); } }\nfunction over(a: string): void;\nfunction over(a: any) { return a.export.import; }\n",
]
INVALID_TS = [
    "function f() { (a === b) { c(); } }\n", "export f(a: string) { return a; }\n", "export async f() { return 1; }\n", "export A { x = 1; }\n", "import { a } './x';\n", "{ a } from './x';\n", "function f() { g(a) { return 1; } }\n",
    "function f() {", "const x = ;", "def f(self):\n    pass\n", "use crate::a;\npub fn f() {}\n", "from a import b\n", "class A {}\n=======\nclass B {}\n", "const s = \"abc;\n", "`open", "/* open", "f(a b);", "export\n", "import { a } from\n", "x = (1]\n", "# c d\n", "const a = {b: =};\n",
    "export class A {}\n>>>>>>> shelf/sample\nexport class B {}\n", "const a = 1;\n||||||| a/b/c\n", "function f() {}\n<<<<<<< a/'b'\n",
]


def bad(spark, ext, texts):
    df = spark.createDataFrame([(i, ext, t, "x") for i, t in enumerate(texts)], "id long, ext string, text string, code string")
    return {r[0] for r in invalid_ids(df).collect()}


@pytest.mark.parametrize("ext, valid, invalid", [("py", VALID_PY, INVALID_PY), ("rs", VALID_RS, INVALID_RS), ("ts", VALID_TS, INVALID_TS)])
def test_valid_and_invalid_texts(spark, ext, valid, invalid):
    got = bad(spark, ext, valid + invalid)
    n = len(valid)
    assert [valid[i] for i in sorted(got) if i < n] == []
    assert [t for i, t in enumerate(invalid) if n + i not in got] == []


def test_python_agrees_with_the_compiler_on_cut_texts(spark):
    random.seed(3)
    texts = []
    for source in VALID_PY:
        for _ in range(12):
            texts.append(source[: random.randrange(len(source) + 1)])
    got = bad(spark, "py", texts)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for i, t in enumerate(texts):
            try:
                ast.parse(t.removeprefix("﻿"))
                ok = True
            except SyntaxError:
                ok = False
            assert (i not in got) == ok, t


def test_nulls_unknown_extensions_long_and_empty(spark):
    rows = [(1, "py", None), (2, "md", "((("), (3, None, "((("), (4, "py", "x = 1\n" * 20000), (5, "rs", "fn f() { " + "(" * 200 + ")" * 200 + "; }"), (6, "py", "x = (" * 300), (6, "py", "x = (" * 300)]
    df = spark.createDataFrame(rows, "id long, ext string, text string")
    assert sorted(r[0] for r in invalid_ids(df).collect()) == [6]
    assert invalid_ids(df.limit(0)).collect() == []


@pytest.mark.parametrize("ext, valid, invalid", [
    ("rs", ["fn f() { let a = 1; if a > 0 { g() } else if b { h() } else { let Some(x) = y else { return }; } }", "fn f() { m! { else let } match x { A if y => 1, _ => -1 }; loop { while a {} } let b = if c { 1 } else { 2 }; }"],
     ["fn f() -> { 1 }", "fn f() { let a = b - ; }", "fn f() { let a = 1 }", "fn f() { else { } }", "fn f() { if a; }", "mod m { fn g() { while { } loop x; } }"]),
    ("ts", ["function f() { try { a() } catch { b() } finally { c() } p.catch(e).finally(f); if (a) b\nelse c; do { x } while (y) }", "class A { catch(e) { } if() { } }\nconst o = { else: 1, try: 2 };"],
     ["function f(x: number) { if x > 3 { return 1; } }", "try { a(); }", "function f() { else { a(); } }", "function f() { catch (e) { } }", "if (a) { finally { } }", "do { x() }"]),
    ("py", ["f(a=1, *b)\nf(a, b=1)[0] = x.y = 2\na: b or c = 3\n", "def f(a=1, *, b): pass\n"], ["f() = 1\n", "a + b = 1\n", "1 = x\n", "f() += 1\n", "f(a=1, b)\n", "def f(a=1, b): pass\n"]),
])
def test_statements_inside_braces_and_targets(spark, ext, valid, invalid):
    assert bad(spark, ext, valid + invalid) == set(range(len(valid), len(valid) + len(invalid)))


def test_repeated_rows_and_other_columns(spark):
    text = "try:\n    x\nexcept E:\n    y\nelse:\n    z\n"
    rows = [(1, "py", text, 1), (1, "py", text, 2), (2, "py", "x = (", 1), (2, "py", "x = (", 1), (3, "py", None, 1), (4, "xx", "(", 1)]
    df = spark.createDataFrame(rows, "id long, ext string, text string, copy int")
    assert [r[0] for r in invalid_ids(df).collect()] == [2]
    assert invalid_ids(df.limit(0)).count() == 0


def test_nesting_of_any_depth(spark):
    deep = "/* " * 40 + "x" + " */" * 40
    template = "`a" + "${`b" * 30 + "${ {a: {b: {c: {d: {}}}}}.a }" + "`}" * 30 + "`"
    assert bad(spark, "rs", [deep, f"fn f() {{ {deep} }}\n", deep[:-2], "#[a([[[[[1]]]]])]\nfn f() {}\n"]) == {2}
    assert bad(spark, "ts", [f"const a = {template};\n", f"const a = {template[:-1]};\n", f"{template} a b"]) == {1, 2}
