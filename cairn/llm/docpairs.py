"""Functions paired with their documentation.

Strings and comments are blanked first, so that the signature patterns see code only. Python bodies end by an indentation
stack, Rust and TypeScript bodies by a brace stack. Documentation is what each language takes for it: the docstring, the
outer documentation in front of a Rust item (attributes between allowed), the comment block directly above a TypeScript
function. Pairs whose documentation says nothing are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.lexers import RS_TEXT, TS_TEXT, comment_end, rewritten
from cairn.llm.syntax import OTHER, invalid_rows, known_files, source_files, syntax_rows
from cairn.session import checkpoint, table

# ------------------------------------------------------------------------------------------ does a text say something?
# The generic words that count as no documentation.
GENERIC = {"todo", "fixme", "placeholder", "stub", "handles event", "helper", "main"}
PLACEHOLDERS = {
    "xxx", "tbd", "tba", "n a", "na", "none", "summary", "description", "type", "doc", "docs", "docstring", "documentation", "wip", "hack", "fix me",
    "to do", "tbc", "lorem ipsum", "no description", "undocumented", "missing docs", "missing documentation", "not documented", "description here",
}
FILLERS = {"the", "to", "function", "a", "an", "this", "method", "fn"}
_TODO = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|tbd|wip)\b|(?:hack|placeholder)\s*(?:[:.,;!(–—-]|\Z|(?:for now|until|implementation|comment|description|doc\w*|documentation)\b))", re.I
)
#: Lines that address a tool, in the syntax that the tool demands: a word alone is English.
_DIRECTIVE = re.compile(
    r"^\W*(?:eslint(?:-(?:disable|enable|env)\b|\s+[\w@/-]+\s*:)|tslint:\s*(?:disable|enable)|js[hl]int(?:\s+\w+\s*:|\s*ignore:)|prettier-ignore|(?:istanbul|c8|v8)\s+ignore\b|webpack[A-Z]\w*\s*:"
    r"|biome-ignore|deno-(?:lint|fmt|coverage)-ignore|ts-(?:ignore|expect-error|nocheck|check)\b|(?:noqa|nosec|nosonar)\s*(?::|\Z|[A-Z]\d+)|type:\s*ignore\b|pylint:\s*[\w-]+\s*(?:=|\Z)|flake8[:=]\s*noqa|mypy:\s*[\w-]+"
    r"|pyright:\s*(?:ignore|basic|strict|\w+=)|ruff:\s*(?:noqa|isort)|isort:\s*[\w-]+|yapf:\s*(?:disable|enable)|fmt:\s*(?:off|on|skip)\b|pragma:?\s*(?:no\s*cover|no\s*branch|once)\b|coverage:\s*ignore|rustfmt(?:::|-)\w+"
    r"|clippy::\w+|cspell:\s*\w+|spell-checker:\s*\w+|noinspection\s+\w+\s*\Z|endregion\s*\Z|language=\w+|vim:\s*\w+|-\*-|doctest:\s*[+-])"
    r"|^\W*\#(?:end)?region\b|^\W*@(?:ts-\w+|jsx\w*|flow|format|license|preserve)\b|^-\*-",
    re.I,
)
_TAG = re.compile(
    r"^(?:\{@[Ii]nherit[Dd]oc[^}]*\}\s*|[@\\:](?:param|parameter|arg|argument|property|prop|template|typeparam|type|raises?|throws?|exception|keyword|ivar|cvar|var)\b:?(?:\s*\{[^}]*\})?(?:\s+[\w.$\[\]*]+)?\s*:?\s*-?\s*"
    r"|[@\\:]\w+:?(?:\s*\{[^}]*\})?\s*:?\s*-?\s*)"
)
_HEADING = re.compile(
    r"^(?:\#+\s*[\w /-]+:?|(?:args|arguments|parameters?|params|returns?|return value|yields?|raises|throws|examples?|notes?|see also|attributes|errors|panics|safety|"
    r"usage|todo|warning|warnings|references|description|summary|overview|details|remarks|other parameters|keyword args|keyword arguments)\s*:?)$",
    re.I,
)
_WORD = re.compile(r"[^\W_]+")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+")


def name_words(name: str) -> list[str]:
    """The words of a snake_case or camelCase identifier, in lower case."""
    return [w.lower() for w in _NAME.findall(name)]


def _stems(words: list[str]) -> list[str]:
    return [w[:-1] if len(w) > 1 and w.endswith("s") else w for w in words]


def says_something(doc: str, name: str) -> bool:
    """Whether a description tells more than the function's name does.

    Not counted: empty lines, punctuation and rules, tags and headings without text, tool directives, to-do and
    placeholder notes, the marks around code (not the code), the generic words, and the name itself - as a word or as a phrase
    with filler words or an ending -s.
    """
    own, kept = name_words(name), []
    for raw in doc.splitlines():
        line = raw.strip().strip("*").strip()
        if line.startswith("```") or line.startswith("~~~") or not _WORD.search(line):
            continue
        if _DIRECTIVE.match(line) or _TODO.match(line) or _HEADING.match(line):
            continue
        line = _TAG.sub("", line, count=1) if line[0] in "@\\:{" else line
        words = [w.lower() for w in _WORD.findall(line)]
        if words:
            kept.append((line, words))
    said = [w for _, words in kept for w in words]
    text = " ".join(said)
    if not said or text in GENERIC or text in PLACEHOLDERS:
        return False
    if all(" ".join(words) in GENERIC or " ".join(words) in PLACEHOLDERS for _, words in kept):
        return False
    parts = [p for line, _ in kept for w in re.findall(r"[\w$]+", line) for p in name_words(w)]
    plain = _stems([w for w in parts if w not in FILLERS])
    mine = _stems([w for w in own if w not in FILLERS])
    return bool(plain) and plain not in (mine, _stems(own))


# ------------------------------------------------------------------------------------------ blanking
def _blank(t: str, keep: int = 0) -> str:
    return t[:keep] + (re.sub(r"[^\n]", " ", t[keep:]) if "\n" in t else " " * (len(t) - keep))


_PY_TEXT = re.compile(
    r"\#[^\n]*|[A-Za-z]{0,2}(?:\"{3}(?:[^\"\\]|\\.|\"(?!\"\"))*+\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+')", re.S
)
_BRACES = re.compile(r"[{}]")
_ANY_BRACKET = re.compile(r"[()\[\]{};]")


_TS_STEP = re.compile(r"[()\[\]{};,\n`<]")
_TS_ANGLES = re.compile(r"(?<=[\w$])<[^()=;]*?>(?=\s*(?:[(\[;,)\]}.`]|\n|\Z))")
_TS_GOES_ON = re.compile(r"\s*(?:[.?:&|*/%<>=^,)\]}(\[`;]|\+(?!\+)|-(?!-)|!=|(?:instanceof|in|as|satisfies)\b)")
_TS_UNFINISHED = re.compile(r"(?:[.?:&|*/%<=^,~]|=>|(?<!\+)\+|(?<!-)-|\b(?:new|typeof|await|void|delete|in|instanceof|as|satisfies|yield))\Z")


def _expression_end(code: str, at: int, texts: dict[int, int]) -> int:
    """Where the expression at `at` ends: at `;`, `,` or a closing bracket outside of its own brackets, or at a line break
    there that neither side carries on. `texts` has the ends of the template literals by their starts."""
    depth, i = 0, at
    while m := _TS_STEP.search(code, i):
        c, i = m.group(), m.end()
        if c == "`":
            i = texts.get(m.start(), i)
        elif c == "<":
            g = _TS_ANGLES.match(code, m.start())
            i = g.end() if g else i
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return m.start()
        elif depth == 0 and c in ";,":
            return m.end() if c == ";" else m.start()
        elif depth == 0 and c == "\n" and not _TS_GOES_ON.match(code, i) and not _TS_UNFINISHED.search(code[at : m.start()].rstrip()[-12:]):
            return m.start()
    return len(code)


class Blocks:
    """The brace pairs of a blanked text, and names for some of them."""

    def __init__(self, code: str):
        self.close, stack, self.opens = {}, [], []
        self.parent = {}
        for m in _BRACES.finditer(code):
            if m.group() == "{":
                self.parent[m.start()] = stack[-1] if stack else None
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()
        self.opens = sorted(self.parent)
        self.names: dict[int, str] = {}

    def around(self, at: int) -> int | None:
        """The innermost opening brace whose block holds `at`."""
        i = bisect_right(self.opens, at - 1) - 1
        b = self.opens[i] if i >= 0 else None
        while b is not None and self.close.get(b, 1 << 60) < at:
            b = self.parent[b]
        return b

    def owner(self, at: int) -> str | None:
        b = self.around(at)
        while b is not None:
            if b in self.names:
                return self.names[b]
            b = self.parent[b]
        return None


def _close_of(code: str, at: int) -> int:
    """The position of the bracket that closes the one at `at`; -1 if there is none."""
    depth = 0
    for m in _ANY_BRACKET.finditer(code, at):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                return m.start()
    return -1


def _body_start(code: str, at: int) -> tuple[str, int]:
    """The first `{` or `;` after `at` outside of other brackets, and its position."""
    depth = 0
    for m in _ANY_BRACKET.finditer(code, at):
        c = m.group()
        if depth == 0 and c in "{;":
            return c, m.start()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                break
    return "", -1


def _flat(text: str) -> str:
    return " ".join(text.split())


class Lines:
    """Line numbers, from 1, of positions asked for in any order."""

    def __init__(self, text: str):
        self.ends = [m.start() for m in re.finditer("\n", text)]

    def at(self, position: int) -> int:
        return bisect_left(self.ends, position) + 1


def _word_starts(pattern: re.Pattern, code: str, inner: str = "_"):
    """The matches of `pattern` that do not begin inside a word, nor behind one of the characters `inner`."""
    for m in pattern.finditer(code):
        at = m.start()
        if not at or not (code[at - 1].isalnum() or code[at - 1] in inner):
            yield m


def _end_before(text: str, at: int, spaces: str) -> int:
    """The end of what stands before `at`, without `spaces`."""
    while at and text[at - 1] in spaces:
        at -= 1
    return at


# ------------------------------------------------------------------------------------------ Python
_PY_DEF = re.compile(r"^([ \t]*)((?:async[ \t]+)?def)[ \t]+(\w+)|^([ \t]*)class[ \t]+(\w+)", re.M)
_PY_QUOTED = re.compile(_PY_TEXT.pattern.replace("[A-Za-z]{0,2}", ""), re.S)  # prefixes stay outside: no try at each letter
_PY_DOC = re.compile(r"(?:[ \t\r\n]|\#[^\n]*|\\\n)*([rRuU]?)(\"{3}|'{3}|\"|')", re.S)
_PY_SUITE = re.compile(r"[()\[\]{}:]")
_PY_REST = re.compile(r"[ \t]*(?:\#[^\n]*)?\r?(?:\n|;|\Z)")


def _python_pairs(text: str):
    code = _PY_QUOTED.sub(lambda m: _blank(m.group(), 0 if m.group()[0] == "#" else 1), text)
    lines = code.split("\n")
    starts, depth_at, depth, at = [], [], 0, 0
    for ln in lines:
        starts.append(at)
        depth_at.append(depth)
        at += len(ln) + 1
        depth += ln.count("(") + ln.count("[") + ln.count("{") - ln.count(")") - ln.count("]") - ln.count("}")
    stack: list[tuple[int, str]] = []
    for m in _PY_DEF.finditer(code):
        first = bisect_right(starts, m.start(2) if m.group(2) else m.start(5)) - 1
        if depth_at[first]:
            continue
        indent = len((m.group(1) if m.group(2) else m.group(4)).expandtabs(8))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        name = m.group(3) or m.group(5)
        owner = stack[-1][1] if stack else None
        stack.append((indent, name))
        if not m.group(2):
            continue
        depth, colon = 0, -1
        for b in _PY_SUITE.finditer(code, m.end()):
            c = b.group()
            depth += (c in "([{") - (c in ")]}")
            if c == ":" and depth == 0:
                colon = b.start()
                break
        if colon < 0:
            continue
        d = _PY_DOC.match(text, colon + 1)
        if not d:
            continue
        s = _PY_TEXT.match(text, d.start(1))
        if not s or not _PY_REST.match(text, s.end()):
            continue
        q = d.group(2)
        raw = s.group()[len(d.group(1)) + len(q) : -len(q)]
        last = bisect_right(starts, colon) - 1
        end = last
        for k in range(last + 1, len(lines)):
            ln = lines[k]
            bare = ln.strip()
            if not bare:
                continue
            if depth_at[k] == 0 and len(ln[: len(ln) - len(ln.lstrip())].expandtabs(8)) <= indent:
                break
            end = k
        end = max(end, bisect_right(starts, s.end()) - 1)
        stop = starts[end + 1] - 1 if end + 1 < len(starts) else len(text)
        yield name, owner, first + 1, text[m.start(2) : colon], text[m.start(2) : stop], raw


# ------------------------------------------------------------------------------------------ Rust
# These begin with letters, so that the search skips fast; `_word_starts` drops matches inside of words.
_RS_FN = re.compile(r"fn\s+(?:r\#)?(\w+)")
_RS_MODIFIERS = {"pub", "async", "unsafe", "const", "default", "extern", "crate"}
_RS_OWNER = re.compile(r"(impl|trait)\b([^;{]*)\{")
_RS_FRONT = re.compile(
    r"///(?!/)([^\n]*)|//[^\n]*|(/\*)|\#\s*\[\s*doc\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"|r(\#*)\"(.*?)\"\4)\s*\]", re.S
)
_RS_ATTRIBUTE = re.compile(r"\#\s*!?\s*\[")
_STARS = re.compile(r"^[ \t]*\*?", re.M)


def _rust_owner(kind: str, head: str) -> str:
    head = head.strip()
    depth = 0
    if head.startswith("<"):
        for i, c in enumerate(head):
            depth += (c == "<") - (c == ">" and head[i - 1] != "-")
            if depth == 0:
                head = head[i + 1 :]
                break
    head = re.split(r"\bwhere\b", head)[0]
    if kind == "impl":
        head = re.split(r"\bfor\b(?!\s*<)", head)[-1]
    m = re.match(r"\s*(?:&\s*(?:'\w+\s*)?(?:mut\s+)?|dyn\s+|!\s*)*((?:\w+\s*::\s*)*\w+)", head)
    return re.split(r"\s*::\s*", m.group(1))[-1] if m else head.strip()


def _without_attributes(code: str) -> str:
    """`code` with its attributes blanked, whatever their nesting."""
    out, at = [], 0
    while m := _RS_ATTRIBUTE.search(code, at):
        close = _close_of(code, m.end() - 1)
        end = close + 1 if close > 0 else m.end()
        out.append(code[at : m.start()])
        out.append(_blank(code[m.start() : end]))
        at = end
    return "".join([*out, code[at:]])


def _before_rust_modifiers(bare: str, at: int, opened: dict[int, int]) -> int:
    """Where the modifiers (`pub(crate)`, `extern "C"`) in front of `at` begin."""
    while True:
        end = _end_before(bare, at, " \t\r\n")
        begin = end
        if end and bare[end - 1] == ")":
            begin = _end_before(bare, opened.get(end - 1, end), " \t\r\n")
            if not bare.endswith("pub", 0, begin):
                return at
        elif end and bare[end - 1] == '"':
            begin = _end_before(bare, end - 1, " \t\r\n")
            if not bare.endswith("extern", 0, begin):
                return at
        while begin and (bare[begin - 1].isalnum() or bare[begin - 1] == "_"):
            begin -= 1
        if begin == end or bare[begin:end].split("(")[0].split('"')[0].strip() not in _RS_MODIFIERS:
            return at
        at = begin


def _rust_docs(text: str, front: int, begin: int) -> list[str]:
    docs, at = [], front
    while d := _RS_FRONT.search(text, at, begin):
        at = d.end()
        if d.group(1) is not None:
            docs.append(d.group(1))
        elif d.group(2) is not None:
            at = comment_end(text, d.start())
            comment = text[d.start() : at]
            if comment.startswith("/**") and comment[3] not in "*/":
                docs.append(_STARS.sub("", comment[3:-2]))
        elif d.group(3) is not None:
            docs.append(d.group(3).replace("\\n", "\n").replace('\\"', '"'))
        elif d.group(5) is not None:
            docs.append(d.group(5))
    return docs


def _rust_pairs(text: str):
    code = rewritten(text, RS_TEXT, lambda a, b: _blank(text[a:b], 0 if text[a] == "/" else 1))
    bare = _without_attributes(code)
    blocks, found, opened, lines = Blocks(bare), [], _opened_at(bare), Lines(text)
    for m in _word_starts(_RS_OWNER, bare):
        blocks.names[m.end() - 1] = _rust_owner(m.group(1), m.group(2))
    for m in _word_starts(_RS_FN, bare):
        c, at = _body_start(bare, m.end())
        if c == "{":
            blocks.names[at] = m.group(1)
            found.append((m, at))
    for m, at in found:
        begin = _before_rust_modifiers(bare, m.start(), opened)
        docs = _rust_docs(text, _end_before(bare, begin, " \t\r\n"), begin)
        if docs:
            close = blocks.close.get(at, len(text) - 1)
            yield m.group(1), blocks.owner(begin), lines.at(m.start()), text[begin:at], text[begin : close + 1], "\n".join(docs)


# ------------------------------------------------------------------------------------------ TypeScript
_TS_FUNCTION = re.compile(r"function\b\s*\*?\s*([\w$]+)\s*(?=[(<])")
_TS_ARROW = re.compile(r"const\s+([\w$]+)\s*(?::(?:[^=;]|=>)+?)?=(?![=>])\s*(?:async\b\s*)?(?=[(<\w$])")
_TS_CLASS = re.compile(r"(class|interface)\b\s*(?!(?:extends|implements)\b)([\w$]*)\s*(?=[<{]|(?:extends|implements)\b)")
_TS_HEAD = re.compile(r"=>|[<>(){}\[\];]")
#: A brace after one of these opens an object literal (or a type, whose methods have no bodies).
_TS_OBJECT = re.compile(r"(?:(?:\b(?:const|let|var)\s+([\w$]+)\s*(?::[^={}();]*)?=|([\w$]+)\s*:)|[=(,\[?|&]|\b(?:return|default|yield|await))\s*\Z")
_TS_METHOD = re.compile(
    r"[\n;{}),][ \t\r]*((?:(?:public|private|protected|static|async|override|readonly|get|set|declare|accessor)\s+)*)(?:\*\s*)?(\#?[\w$]+)\s*\??\s*(?:<[^(){};]*>)?\s*\("
)
_TS_RETURN = re.compile(r"\s*(?::[^;{}=]*(?:\{[^{}]*\}[^;{}=]*)*?)?\s*\{")
_TS_TO_ARROW = re.compile(r"\s*(?::[^;=]*?)?\s*=>\s*")
_TS_GENERIC = re.compile(r"<[^()]*?>\s*(?=\()")
_TS_MODIFIERS = {"export", "default", "declare", "async", "public", "private", "protected", "static", "override", "abstract", "readonly", "get", "set", "accessor"}
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "await", "typeof", "super", "with", "do", "else", "throw", "in", "of"}


def _class_body(code: str, at: int) -> int:
    """The brace that opens the body of the class whose head goes on at `at`: the first outside of angle and other
    brackets; -1 if there is none."""
    inside = 0
    for m in _TS_HEAD.finditer(code, at):
        c = m.group()
        if c == "{" and not inside:
            return m.start()
        if c == ";" and not inside:
            return -1
        inside += 1 if c in "<([{" else -1 if c in ">)]}" else 0
        if inside < 0:
            return -1
    return -1


def _opened_at(code: str) -> dict[int, int]:
    """The opening parenthesis of each closing one."""
    out, stack = {}, []
    for m in re.finditer(r"[()]", code):
        if m.group() == "(":
            stack.append(m.start())
        elif stack:
            out[m.start()] = stack.pop()
    return out


def _before_modifiers(code: str, at: int, opened: dict[int, int]) -> int:
    """Where the modifiers and decorators in front of `at` begin."""
    while True:
        end = len(code) if at > len(code) else at
        while end and code[end - 1].isspace():
            end -= 1
        call = opened.get(end - 1) if end and code[end - 1] == ")" else None
        stop = end if call is None else call
        begin = stop - 1 if call is None and stop and code[stop - 1] == "*" else stop
        if begin == stop:
            while begin and (code[begin - 1].isalnum() or code[begin - 1] in "_$."):
                begin -= 1
            if begin and code[begin - 1] == "@" and begin < stop:
                begin -= 1
            elif call is not None or code[begin:stop] not in _TS_MODIFIERS:
                return at
        at = begin


def _typescript_docs(text: str, comments: dict[int, int], begin: int) -> str | None:
    """The comment block that ends on the line above `begin` (or before it on its line)."""
    docs, at = [], begin
    while True:
        end = _end_before(text, at, " \t\r")
        if end and text[end - 1] == "\n":
            end = _end_before(text, end - 1, " \t\r")
        start = comments.get(end)
        if start is None:
            break
        comment = text[start:end]
        head = text[text.rfind("\n", 0, start) + 1 : start]
        if comment.startswith("//"):
            if head.strip():
                break
            docs.append(comment[2:].strip("/").strip())
        elif comment.startswith("/**") and len(comment) > 4:
            docs.append(_STARS.sub("", comment[3:-2]))
            break
        else:
            break
        at = start
    return "\n".join(reversed(docs)) if docs else None


def _typescript_pairs(text: str):
    comments: dict[int, int] = {}
    texts: dict[int, int] = {}

    def hide(start: int, end: int) -> str:
        t = text[start:end]
        if t[:2] in ("//", "/*"):
            comments[start + len(t.rstrip(" \t\r"))] = start
            return _blank(t)
        if t[0] == "`":
            texts[start] = end
        return _blank(t, 1) if t[0] != "/" else "0" + _blank(t[1:])

    code, lines = rewritten(text, TS_TEXT, hide), Lines(text)
    blocks, found = Blocks(code), []
    classes = {}
    for m in _word_starts(_TS_CLASS, code, "._$"):
        at = _class_body(code, m.end())
        if at >= 0:
            blocks.names[at] = m.group(2) or "default"
            classes[at] = m.group(1) == "class"

    def holds_methods(at: int | None) -> bool:
        """Whether the brace at `at` opens a class or an object literal; the literal gets the name of its variable or key."""
        if at is not None and at not in classes:
            start = max(code.rfind(c, 0, at) for c in "{};") + 1
            m = None if code[start:at].rstrip().endswith("=>") else _TS_OBJECT.search(code, start, at)
            classes[at] = m is not None
            if m and (m.group(1) or m.group(2)):
                blocks.names.setdefault(at, m.group(1) or m.group(2))
        return at is not None and classes[at]

    for m in _word_starts(_TS_FUNCTION, code):
        c, at = _body_start(code, code.find("(", m.end()))
        close = _close_of(code, code.find("(", m.end()))
        r = _TS_RETURN.match(code, close + 1) if close > 0 else None
        if r:
            found.append((m.group(1), m.start(), m.start(), r.end() - 1, None))
    for m in _word_starts(_TS_ARROW, code):
        g = _TS_GENERIC.match(code, m.end())
        at = g.end() if g else m.end()
        if code[at : at + 1] == "(":
            close = _close_of(code, at)
            a = _TS_TO_ARROW.match(code, close + 1) if close > 0 else None
        else:
            a = re.compile(r"[\w$]+\s*=>\s*").match(code, at)
        if a:
            brace = code[a.end() : a.end() + 1] == "{"
            found.append((m.group(1), m.start(), m.start(), a.end() if brace else -1, None if brace else a.end()))
    for m in _TS_METHOD.finditer(code):
        name, begin = m.group(2), m.start(1)
        if name in _NOT_METHODS or not holds_methods(blocks.around(begin)):
            continue
        close = _close_of(code, m.end() - 1)
        r = _TS_RETURN.match(code, close + 1) if close > 0 else None
        if r:
            found.append((name, begin, m.start(2), r.end() - 1, None))
    for name, _, _, at, _ in found:
        if at >= 0:
            blocks.names.setdefault(at, name)
    opened = _opened_at(code)
    for name, begin, name_at, at, expression in sorted(found, key=lambda x: x[1]):
        first = _before_modifiers(code, begin, opened)
        doc = _typescript_docs(text, comments, first)
        if doc is None:
            continue
        if at >= 0:
            stop, sign = blocks.close.get(at, len(text) - 1) + 1, text[first:at]
        else:
            stop = _end_before(code, _expression_end(code, expression, texts), " \t\r\n")
            stop = max(stop, *(e for b, e in texts.items() if expression <= b < stop), 0) if texts else stop
            sign = text[first:expression]
        yield name, blocks.owner(begin), lines.at(name_at), sign, text[first:stop], doc


PAIRS_OF = {"py": _python_pairs, "rs": _rust_pairs, "ts": _typescript_pairs}


def documented_functions(ext: str, text: str):
    """[(start_line, qualified_name, signature, code, description)] of the functions whose documentation tells something."""
    text = text[1:] if text.startswith("﻿") else text
    out = []
    for name, owner, line, signature, code, doc in PAIRS_OF[ext](text):
        if says_something(doc, name):
            description = "\n".join(x.strip() for x in doc.strip().splitlines()).strip()
            out.append((line, f"{owner}::{name}" if owner else name, _flat(signature), code, description))
    return out


_TEXTS = ("qualified_name", "signature", "body", "description")  # the rows have a `code` already
_COLUMNS = pa.schema([("start_line", pa.int64()), *[(c, pa.string()) for c in _TEXTS]])


def function_pairs(files: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, start_line, qualified_name, signature, code, description) of (id, ext, text); without `texts` only
    (doc_id, start_line).

    Files that do not parse, unknown extensions and null texts give nothing; repeated rows count once. Functions and what
    decides whether a file parses come from one pass over the texts.
    """
    columns = _COLUMNS if texts else pa.schema([_COLUMNS.field(0)])
    find = documented_functions if texts else lambda ext, text: [f[:1] for f in documented_functions(ext, text)]
    rows = checkpoint(syntax_rows(known_files(files), find, columns))
    found = rows.filter(F.col("seq") == OTHER).select(F.col("id").alias("doc_id"), *[F.col(c).alias("code" if c == "body" else c) for c in columns.names])
    return found.join(invalid_rows(rows).withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_pairs(source_files(table(spark, sf_dir, "documents")), texts=False)


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_pairs(source_files(table(spark, sf_dir, "documents")))


SQL = {}
QUERIES = {"p7_found": p7_found, "p7_pairs": p7_pairs}
