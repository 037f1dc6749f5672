import pytest

from cairn.llm.docpairs import documented_functions, function_pairs, says_something

PY = '''class Box:
    """Not a function."""

    @wrap(1)
    async def open_lid(
        self, x: dict[str, int] = {},
    ) -> None:
        """Lifts the lid, then waits."""
        s = """
def fake(): pass
"""
        return x

    def close_lid(self):
        # Closes it.
        pass


def to_do():
    """TODO: write docs"""

def f(): """One line that tells."""
'''
RS = """/// Not for the impl.
impl<'a> Box<'a> {
    /// Lifts the lid and waits.
    // plain comment between
    #[inline]
    pub(crate) fn open_lid(&self) -> u8 { let s = "fn fake() {"; 1 }
    //// Four slashes are a comment.
    fn close_lid(&self) {}
    #[doc = "Weighs the box twice."]
    unsafe fn weigh(&self) {}
}
trait T {
    /// No body here at all.
    fn none(&self);
}
/** Block words here. */
const fn g() {}
"""
TS = """/** Sends one request. */
export async function send<T>(a: T): Promise<T> { return a; }

// Builds the thing from parts.
// Second line.
export const build = async (x: number): Promise<any> => { return x; };

/** Too far away. */

function far() {}
class A {
  /* plain */
  one() { return 1; }
  /**
   * Counts what is left.
   * @param x the number
   */
  @dec({ a: 1 })
  private static two(x: number): void { if (x) { } }
  // eslint-disable-next-line
  three() {}
}
/** An overload says nothing. */
declare function over(a: string): void;
"""


def found(ext, text):
    return [(f[0], f[1]) for f in documented_functions(ext, text)]


def test_python():
    assert found("py", PY) == [(5, "Box::open_lid"), (22, "f")]
    assert found("py", "﻿" + PY.replace("\n", "\r\n")) == found("py", PY)
    row = documented_functions("py", PY)[0]
    assert row[2].startswith("async def open_lid(") and row[2].endswith("-> None") and row[3].endswith("return x") and row[4] == "Lifts the lid, then waits."


def test_rust():
    assert found("rs", RS) == [(6, "Box::open_lid"), (10, "Box::weigh"), (17, "g")]


def test_typescript():
    assert found("ts", TS) == [(2, "send"), (6, "build"), (19, "A::two")]


@pytest.mark.parametrize(
    "doc", ["", "...", "-----", "TODO", "todo document this", "FIXME: later", "n/a", "_summary_", "Handles event", "Helper.", "main", "open_lid", "Open lid.", "Opens the lid.", "To open lid", "The open lid function.", "@see", "@param x\n@returns", ":param x:\n:returns:", "# Errors", "Args:\n", "eslint-disable-next-line", "@ts-ignore", "XXX", "TBD"]
)
def test_says_nothing(doc):
    assert not says_something(doc, "open_lid") and not says_something(doc, "openLid")


@pytest.mark.parametrize("doc", ["Idempotent; safe to retry.", "Opens the lid of the box.", ":param x: the urgent kernel", "Prüft den Deckel.", "Opens the lid.\n\nThen waits.", "@param {number} x how many"])
def test_says_something(doc):
    assert says_something(doc, "open_lid")


def test_frame(spark):
    rows = [(1, "py", PY), (1, "py", PY), (2, "py", PY + "\ndef broken(:\n"), (3, "rs", RS), (4, "ts", None), (5, "md", PY), (6, "py", "")]
    df = spark.createDataFrame(rows, "id long, ext string, text string")
    got = sorted((r["doc_id"], r["start_line"]) for r in function_pairs(df).collect())
    assert got == [(1, 5), (1, 22), (3, 6), (3, 10), (3, 17)]
    assert function_pairs(df.limit(0)).collect() == []


@pytest.mark.parametrize("body", ["xs\n  .filter(a)\n  .map(b);", "({\n  a: x,\n});", "x.a +\n  x.b", "`a\nb ${x}\nc`", "new Map<string, number>([\n  [x, 1],\n])", "x\n  ? [1,\n 2]\n  : y;"])
def test_expression_bodies_are_whole(body):
    for after in ("\nexport const z = 1;\n", "\n\nfoo();\n", ""):
        (row,) = documented_functions("ts", f"/** Sends one request. */\nconst f = (x) =>\n  {body}{after}")
        assert row[3] == f"const f = (x) =>\n  {body}"


@pytest.mark.parametrize("doc", ["Region of the cache that holds live slots.", "Coverage of the window in percent.", "Black pixels are skipped.", "@internal Resolves the route.", "@override Returns the weight.", "{@inheritDoc} Adds the weight.", "Placeholder text shown while the list loads", "```\nlet x = weigh(2);\n```", ">>> weigh(2)\n4", "Pragma lines are kept.", "Sonar depth in metres."])
def test_english_and_examples_say_something(doc):
    assert says_something(doc, "open_lid")


@pytest.mark.parametrize("doc", ["fmt: off", "#region Cache", "pragma: no cover", "@internal", "{@inheritDoc}", "noqa: E501", "istanbul ignore next", "webpackChunkName: 'a'", "Placeholder.", "placeholder for now", "clippy::all", "type: ignore[x]", "-*- coding: utf-8 -*-", "@license MIT", "prettier-ignore", "pylint: disable=x"])
def test_directives_say_nothing(doc):
    assert not says_something(doc, "open_lid")


def test_methods_of_any_class_and_of_objects():
    wide = ", ".join(f"key{i}: {i}" for i in range(80))
    text = """class Store<T extends { id: string }> {
  /** Loads the slots. */
  load() { return 1; }
}
class A extends B<{ x: number }> {
  /** Sends the rest. */
  async send(): Promise<void> { if (x) { y(); } }
}
const api = {
  /** Weighs all slots. */
  weigh(x: number) { return x; }, /** Counts the rest. */ count() { },
};
class C {
  /** Paints the rest. */
  @dec({ WIDE }) @other
  public static paint() { }
}
function f() { switch (x) { default: { g(); } } return { /** Makes it wet. */ rain() { } }; }
""".replace("WIDE", wide)
    assert found("ts", text) == [(3, "Store::load"), (7, "A::send"), (11, "api::weigh"), (11, "api::count"), (16, "C::paint"), (18, "f::rain")]


def test_no_bounds_on_what_stands_in_between():
    far = " " * 900
    deep = "/* " * 12 + "x" + " */" * 12
    rust = f"/// Says it.\n#[a({'(' * 9}{')' * 9})]\n{deep}\npub(crate){far}async{far}unsafe{far}extern \"C\"{far}fn go() {{ let s = 1; {deep} }}\n"
    assert [(f[0], f[1]) for f in documented_functions("rs", rust)] == [(4, "go")]
    template = "`a" + "${`b" * 9 + "{" + "`}" * 9 + "`"
    ts = f"/** Says it. */\nfunction go() {{\n  const a = {template};\n  return a;\n}}\n/** Says more. */\nfunction on() {{ return 1; }}\n"
    assert [(f[0], f[1]) for f in documented_functions("ts", ts)] == [(2, "go"), (7, "on")]
    python = f'def go():\n    """Says it."""{far}# and more\n    return 1\n'
    assert [(f[0], f[1]) for f in documented_functions("py", python)] == [(1, "go")]
