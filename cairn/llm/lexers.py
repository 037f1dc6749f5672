"""Lexers for Python, Rust and TypeScript that turn a text into a string of token classes, one character each.

White space and comments are dropped. A line break is `$`; in Python it is followed by a character that encodes the
next code line's indentation. `¿` is a token that the language does not have: an unterminated text, a stray character,
a conflict marker at the start of a line.
"""

from __future__ import annotations

import re

#: Indentation n is encoded as chr(INDENT_BASE + n).
INDENT_BASE = 0x4000
ERROR = "¿"

_MARKS = ("<" * 7, ">" * 7, "=" * 7, "|" * 7)
_MARKER = r"(?:(?<=\n)|(?<=\r))(?:<{7}|>{7}|={7}|\|{7})(?![<>=|])[^\n]*"


_COMMENT_EDGE = re.compile(r"/\*|\*/")
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_HOLE = re.compile(r"[`{}]|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|//[^\n]*|/\*.*?\*/", re.S)


def comment_end(text: str, at: int) -> int:
    """The end of the block comment at `at`, in which others nest to any depth; -1 if it is not closed."""
    depth = 0
    for m in _COMMENT_EDGE.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return -1


def template_end(text: str, at: int) -> int:
    """The end of the template literal at `at`, whose holes hold code and other templates to any depth; -1 if it is not
    closed."""
    stack, i = [-1], at + 1  # -1: in a template's text; else in a hole, inside so many braces
    while stack:
        m = (_TEMPLATE if stack[-1] < 0 else _HOLE).search(text, i)
        if not m:
            return -1
        t, i = m.group(), m.end()
        if stack[-1] < 0:
            if t == "`":
                stack.pop()
            elif t == "${":
                stack.append(0)
        elif t == "`":
            stack.append(-1)
        elif t == "{":
            stack[-1] += 1
        elif t == "}":
            stack[-1] -= 1
            if stack[-1] < 0:
                stack.pop()
    return i


_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_BEFORE_REGEX = set("(,=:[!&|?{};~+-*%<>")


def regex_end(text: str, at: int) -> int:
    """The end of the regular expression at the slash `at`; -1 if it is a division."""
    i = at
    while i and text[i - 1] in " \t":
        i -= 1
    if i and text[i - 1] not in _BEFORE_REGEX and not text.endswith(("return", "typeof", "case"), 0, i):
        return -1
    m = _REGEX.match(text, at)
    return m.end() if m else -1


#: Where what begins with these characters ends.
_END_OF = {"`": template_end, "/*": comment_end, "/": regex_end}


def rewritten(text: str, pattern: re.Pattern, put) -> str:
    """`text` with put(start, end) in the place of every match of `pattern`; what begins with one of `_END_OF` is taken to
    its end, and stays as it is if it has none."""
    out, at, last, search = [], 0, 0, pattern.search
    while m := search(text, at):
        start, at = m.span()
        if at - start < 3 and (find := _END_OF.get(m.group())):
            end = find(text, start)
            if end < 0:
                continue
            at = end
        out.append(text[last:start])
        out.append(put(start, at))
        last = at
    out.append(text[last:])
    return "".join(out)


class _ClassOf(dict):
    """The class of each token: the fixed ones, and by `rule` the others, of which short ones are remembered."""

    def __init__(self, fixed: dict[str, str], rule):
        super().__init__(fixed)
        self.fixed, self.rule = fixed, rule

    def __missing__(self, token: str) -> str:
        c = self.rule(token)
        if len(token) < 64:
            if len(self) > 300_000:
                self.clear()
                self.update(self.fixed)
            self[token] = c
        return c


def _classes(spec: str) -> dict[str, str]:
    """'x: a b, y: c' -> {'a': 'x', 'b': 'x', 'c': 'y'}"""
    out = {}
    for line in spec.strip().splitlines():
        name, _, members = line.strip().partition(" ")
        out |= dict.fromkeys(members.split(), name)
    return out


# ---------------------------------------------------------------- Python
PY = _classes("""
a and or
n not
i in
I is
f if
e else
E elif
l lambda
r for
w while
Y async
A await
d def
k class
R return
y yield
F from
M import
s as
W with
t try
x except
z finally
q raise
g assert
D del
p pass break continue
G global nonlocal
H match type
J case
0 None True False ...
( (
) )
[ [
] ]
{ {
} }
, ,
: :
. .
; ;
@ @
= =
> ->
u += -= *= /= //= %= @= &= |= ^= >>= <<= **=
V :=
c == != < > <= >=
m + -
~ ~
* *
^ **
o / // % << >> & | ^
""") | {"^": "o"}  # `^` names the class of `**`, the token itself is a binary operator

_PY_FIELD = r"\{{(?:[^{{}}{0}]|\{{[^{{}}{0}]*\}})+\}}"
_PY_TOKEN = re.compile(
    r"[ \t\f\r]*+(?:(?:\\\r?\n|\#[^\n]*)[ \t\f\r]*+)*+("
    + r"""[A-Za-z_]\w*+(?!["'])|[()\[\]{},]|"""  # most tokens; the rest is tried only for others
    + _MARKER
    + r"""|\n(?:[ \t\f\r]*(?:\#[^\n]*)?\n)*+[ \t\f]*"""
    + r"""|(?:[bBuU]|[bB]?[rR]|[rR][bB])?(?:\"{3}(?:[^"\\]|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3})"""
    + r"""|(?:[fF][rR]?|[rR][fF])(?:\"{3}(?:[^"\\{}]|\\[^{}]|\{\{|\}\}|"(?!"")|"""
    + _PY_FIELD.format("")
    + r""")*\"{3}|'{3}(?:[^'\\{}]|\\[^{}]|\{\{|\}\}|'(?!'')|"""
    + _PY_FIELD.format("")
    + r""")*'{3})"""
    + r"""|(?:[bBuU]|[bB]?[rR]|[rR][bB])?(?!\"{3}|'{3})(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
    + r"""|(?:[fF][rR]?|[rR][fF])(?!\"{3}|'{3})(?:"(?:[^"\\\n{}]|\\[^{}]|\{\{|\}\}|"""
    + _PY_FIELD.format(r"\n")
    + r""")*"|'(?:[^'\\\n{}]|\\[^{}]|\{\{|\}\}|"""
    + _PY_FIELD.format(r"\n")
    + r""")*')"""
    + r"""|(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d+)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![0-9A-Za-z_])"""
    + r"""|[^\W\d]\w*|->|:=|\.\.\.|\*\*=|//=|>>=|<<=|[+\-*/%@&|^=!<>]=|\*\*|//|>>|<<|[()\[\]{},:.;@=+\-*/%&|^~<>]|\S)""",
    re.S,
)


def _py_class(t: str) -> str:
    c = t[0]
    if t.startswith(_MARKS):
        return ERROR
    if c == "\n":
        return "$" + chr(INDENT_BASE + min(len(t.rpartition("\n")[2].expandtabs(8)), 20000))
    if len(t) > 1 and t[-1] in "\"'":
        return "S"
    if c.isdigit() or (c == "." and len(t) > 1):
        return "0"
    return "N" if c.isidentifier() else ERROR


_PY_OF = _ClassOf(PY, _py_class)


def python_classes(text: str) -> str:
    """The class string of a Python text; every code line begins with `$` and its indentation."""
    return "".join(map(_PY_OF.__getitem__, _PY_TOKEN.findall("\n" + text.removeprefix("﻿") + "\n")))


# ---------------------------------------------------------------- Rust
RS = _classes("""
F fn
P pub
U use
M mod
S struct union
E enum
I impl
T trait
y type
c const static
l let
u mut ref
f if
e else
h match
w while
r for
o loop
i in
R return
b break continue yield
v move
Y async
x unsafe
W where
s as
n dyn
X extern
0 true false
( (
) )
[ [
] ]
{ {
} }
, ,
: :
; ;
k ::
. .
g .. ..= ...
j ->
J =>
= =
A += -= *= /= %= &= |= ^= <<= >>=
< <
> > >>
? ?
! !
& & &&
* *
m -
| | ||
q == != <= >=
B + / % ^ <<
$ $
z @
""") | {"_": "N"}
_RS_COMMENT = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|{})*+\*/"
_RS_NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*+\*/"
for _ in range(4):
    _RS_NESTED = _RS_COMMENT.format(_RS_NESTED)
_RS_STRING = r'"(?:[^"\\]|\\.)*+"'
_RS_ATTRIBUTE = r"\[(?:[^\[\]\"]|" + _RS_STRING + r")*\]"
for _ in range(6):
    _RS_ATTRIBUTE = r"\[(?:[^\[\]\"]|" + _RS_STRING + "|" + _RS_ATTRIBUTE + r")*\]"
#: Comments (block comments by their first characters) and strings of Rust.
RS_TEXT = re.compile(r"//[^\n]*|/\*|\b(?:br|cr|r)(\#*)\".*?\"\1|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\\n]|\\(?:x..|u\{[^}]*\}|.))'", re.S)
_RS_TOKEN = re.compile(
    r"[ \t\f\r]*+(?:(?://(?!/(?!/))[^\n]*|" + r"(?!/\*\*[^*/])" + _RS_NESTED + r")[ \t\f\r]*+)*+("
    + r"""(?!pub\b)[A-Za-z_]\w*+(?!["'\#])|[(){}\[\],;]|"""
    + _MARKER
    + r"|\n\s*|///(?!/)[^\n]*|" + _RS_NESTED
    + r"""|(?:br|cr|r)(\#*)".*?"\2|[bc]?""" + _RS_STRING
    + r"""|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'|'[A-Za-z_]\w*(?!')"""
    + r"""|\#!?""" + _RS_ATTRIBUTE
    + r"""|pub\s*\(\s*(?:crate|self|super|in\s+[\w:]+)\s*\)|r\#[A-Za-z_]\w*"""
    + r"""|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?[A-Za-z_]\w*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?"""
    + r"""|[^\W\d]\w*|\.\.=|\.\.\.|<<=|>>=|->|=>|::|\.\.|&&|\|\||<<|>>|[+\-*/%&|^=!<>]=|[()\[\]{},:;.=<>?!&*\-|+/%^$]|\S)""",
    re.S,
)


def _rs_class(t: str) -> str:
    c = t[0]
    if t.startswith(_MARKS):
        return ERROR
    if c == "\n":
        return "\n"
    if c == "/":
        return "D" if t.startswith("///") or (t.startswith("/**") and len(t) > 4) else ERROR
    if c == "#":
        return ERROR if len(t) == 1 else "a" if t[1] == "!" else "@"
    if c == "'":
        return "0" if t[-1] == "'" and len(t) > 2 else "L" if len(t) > 1 else ERROR
    if t[-1] in "\"'#" and len(t) > 1:
        return "0"
    if c.isdigit():
        return "0"
    if t.startswith("pub") and t[-1] == ")":
        return "P"
    return "N" if c.isidentifier() else ERROR


_RS_OF = _ClassOf(RS, _rs_class)


def rust_classes(text: str) -> str:
    """The class string of a Rust text; line breaks are kept as line feeds. Outer documentation is a token (`D`)."""
    of = _RS_OF
    text = "\n" + text.removeprefix("﻿") + "\n"
    if text.count("/*") > 5 and _may_nest(text) > 5:  # comments nested deeper than the pattern goes
        whole = text
        text = rewritten(whole, RS_TEXT, lambda a, b: _flat_comment(whole[a:b]))
    return "".join([of[t] for t, _ in _RS_TOKEN.findall(text)])


def _may_nest(text: str) -> int:
    """How deep block comments could nest at most: the greatest excess of openings over closings in a stretch."""
    depth = most = 0
    for m in _COMMENT_EDGE.finditer(text):
        depth = depth + 1 if m.group() == "/*" else max(depth - 1, 0)
        most = max(most, depth)
    return most


def _flat_comment(t: str) -> str:
    if not t.startswith("/*") or len(t) < 4:
        return t
    return (t[:4] + " */" if re.match(r"/\*\*[^*/]", t) else " ") + "\n" * t.count("\n")


# ---------------------------------------------------------------- TypeScript
TS = _classes("""
v const let var
d function
k class
x extends implements
P export
M import
R return
f if
e else
r for
w while
o do
h switch
C case default
t try
K catch
z finally
Z throw
n new
u typeof void delete await yield keyof infer unique asserts
i in instanceof of as satisfies is from
b break continue debugger
D public private protected static readonly abstract declare override async get set accessor
T interface type enum namespace module
0 true false null
( (
) )
[ [
] ]
{ {
} }
, ,
: :
; ;
. .
Q ?.
g ...
J =>
= =
A += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=
< <
> > >> >>>
? ?
! !
~ ~
m + -
p ++ --
| |
& &
q == != === !== <= >=
B * / % ** && || ?? ^ <<
@ @
""")
_TS_INNER = r"[^`\\{}]|\\."
_TS_BRACES = r"\{(?:[^{}`]|`(?:[^`\\]|\\.)*`)*\}"
for _ in range(3):
    _TS_BRACES = r"\{(?:[^{}`]|`(?:[^`\\]|\\.)*`|" + _TS_BRACES + r")*\}"
#: Comments and strings of TypeScript, template literals and regular expressions by their first character.
TS_TEXT = re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|`|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|/", re.S)
_TS_TOKEN = re.compile(
    r"[ \t\f\r ]*+(?:(?://[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)[ \t\f\r ]*+)*+("
    + r"(?!return\b|typeof\b|case\b)[A-Za-z_]\w*+(?!\$)|[)\]]|[(\[{},;](?![ \t]*/)|"
    + _MARKER
    + r"|\n\s*|/\*|`(?:[^`\\$]|\\.|\$(?!\{)|\$" + _TS_BRACES + r")*`"
    + r"""|"(?:[^"\\\n]|\\(?:\r\n|.))*+"|'(?:[^'\\\n]|\\(?:\r\n|.))*+'"""
    + r"""|(?:[(,=:\[!&|?{};~+\-*%<>^\n]|=>|\breturn\b|\btypeof\b|\bcase\b)[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*"""
    + r"""|0[xXoObB][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?(?![A-Za-z_$])"""
    + r"""|\#?[^\W\d]\w*(?:\$\w*)*|\$[\w$]*|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|\?\.(?!\d)|\?\?|\+\+|--|\*\*|&&|\|\||<<|>>|[+\-*/%&|^=!<>]=|[()\[\]{},:;.=<>?!~+\-|&*/%^@]|\S)""",
    re.S,
)
_TS_LEAD = re.compile(r"^(=>|return|typeof|case|.)", re.S)


def _ts_class(t: str) -> str:
    c = t[0]
    if t.startswith(_MARKS):
        return ERROR
    if c == "\n":
        if t[-1] in "/" or (len(t) > 1 and "/" in t):
            return "$0"
        return "$"
    if c in "\"'`":
        return "0" if len(t) > 1 and t[-1] == c else ERROR
    if c == "/":
        return ERROR
    if c.isdigit() or (c == "." and len(t) > 1):
        return "0"
    if c.isidentifier() or c in "$#":
        if "/" in t:
            lead = _TS_LEAD.match(t).group()
            return TS.get(lead, "N") + "0"
        return "N" if t != "#" else ERROR
    if "/" in t:
        lead = _TS_LEAD.match(t).group()
        return (TS.get(lead) or ("$" if lead == "\n" else ERROR)) + "0"
    return ERROR


_TS_OF = _ClassOf(TS, _ts_class)


def typescript_classes(text: str) -> str:
    """The class string of a TypeScript text; a line break is `$`."""
    text = "\n" + text.removeprefix("﻿") + "\n"
    out = "".join(map(_TS_OF.__getitem__, _TS_TOKEN.findall(text)))
    if ERROR in out and "`" in text:  # templates nested deeper than the pattern goes
        flat = rewritten(text, TS_TEXT, lambda a, b: "``" + "\n" * text.count("\n", a, b) if text[a] == "`" and b > a + 1 else text[a:b])
        out = "".join(map(_TS_OF.__getitem__, _TS_TOKEN.findall(flat)))
    return out
