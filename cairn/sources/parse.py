"""Symbols, imports, snippets and chunks of source files: one Arrow pass gives a nested row for each file."""

from __future__ import annotations

import ast
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.text import doc_is_useful
from cairn.operators.textops import looks_internal, python_imports, rust_imports, typescript_imports

# How many snippets a file has, and how many lines follow a snippet's first.
SNIPPETS, SNIPPET_LINES = 6, 20
CHUNK_KINDS = ["function", "method", "class", "struct", "enum", "interface"]
SYMBOL = "struct<name:string,qualified_name:string,kind:string,signature:string,start_line:int,end_line:int,doc:string>"


def _symbol(name, owner, kind, signature, start, end, doc=None):
    qualified = f"{owner}::{name}" if owner and kind == "method" else name
    return {"name": name, "qualified_name": qualified, "kind": kind, "signature": signature.strip().rstrip("{:").strip(), "start_line": start, "end_line": end, "doc": doc}


# ---------------------------------------------------------------- Python
def _python(text: str, lines: list[str]):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_lines(lines)
    out = []

    def visit(node, owner):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(child, ast.ClassDef)
                kind = "class" if cls else "method" if owner else "function"
                out.append(_symbol(child.name, owner, kind, lines[child.lineno - 1], child.lineno, child.end_lineno, ast.get_docstring(child)))
                visit(child, child.name)
            else:
                visit(child, owner)

    visit(tree, None)
    return out


def _python_lines(lines: list[str]):
    """Definitions of a text that does not parse, with blocks by indentation."""
    out, stack = [], []
    for i, line in enumerate(lines):
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line)
        if not m:
            continue
        indent = len(m.group(1).expandtabs(8))
        while stack and stack[-1][0] >= indent:
            stack.pop()
        end = i
        for j in range(i + 1, len(lines)):
            bare = lines[j].strip()
            if bare and len(lines[j]) - len(lines[j].lstrip()) <= indent:
                break
            end = j if bare else end
        owner = stack[-1][1] if stack else None
        out.append(_symbol(m.group(3), owner, "class" if m.group(2) == "class" else "method" if owner else "function", line, i + 1, end + 1))
        stack.append((indent, m.group(3)))
    return out


# ---------------------------------------------------------------- Rust and TypeScript
_RUST_HIDE = re.compile(r'//[^\n]*|/\*.*?\*/|\br(\#*)".*?"\1|"(?:[^"\\]|\\.)*+"|\'(?:[^\'\\\n]|\\[^\n]{1,8}?)\'', re.S)
_TS_HIDE = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:[^`\\]|\\.)*+`|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|(?<=[(,=:?&|!])\s*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/", re.S)
_RUST_ITEM = re.compile(r"^[ \t]*((?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:async|unsafe|const|default|extern)\s+)*(fn|struct|enum|union|trait|type|impl)\b\s*(<[^{;]*?>\s*)?([^{;(=]*))", re.M)
_TS_ITEM = re.compile(
    r"^[ \t]*((?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function\s*\*?|class|interface|type|const|let|var|enum)\s+([\w$]+))|"
    r"^[ \t]+((?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(\#?[\w$]+)\s*(?:<[^(){};]*>)?\([^;{}]*(?:\{[^}]*\})?[^;{}]*\)\s*(?::[^;{}=]+)?)\{",
    re.M,
)
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "do", "else", "constructor?"}


def _hide(pattern: re.Pattern, text: str) -> str:
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _closing(code: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return len(code) - 1


def _line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _comment_above(lines: list[str], start: int, block: bool) -> str | None:
    """Doc comment lines just above 1-based line `start`; attributes and decorators between are passed over."""
    i, out = start - 2, []
    while i >= 0 and lines[i].strip().startswith(("#[", "@")):
        i -= 1
    while i >= 0:
        line = lines[i].strip()
        if line.startswith("///") and not line.startswith("////") and not block:
            out.append(line[3:].strip())
        elif block and line.startswith("//"):
            out.append(line[2:].strip())
        elif not out and line.endswith("*/"):
            j = i
            while j >= 0 and not lines[j].strip().startswith("/*"):
                j -= 1
            if j < 0 or not lines[j].strip().startswith("/**"):
                return None
            raw = "\n".join(x.strip() for x in lines[j : i + 1]).removeprefix("/**").removesuffix("*/")
            return "\n".join(x.strip().lstrip("*").strip() for x in raw.split("\n")).strip() or None
        else:
            break
        i -= 1
    return "\n".join(reversed(out)).strip() or None


def _rust(text: str, lines: list[str]):
    code = _hide(_RUST_HIDE, text)
    owners, out = [], []
    for m in _RUST_ITEM.finditer(code):
        word, rest = m.group(2), m.group(4).strip()
        at = m.start(1)
        brace, semi = code.find("{", m.end()), code.find(";", m.end())
        end = _closing(code, brace) if brace >= 0 and (semi < 0 or brace < semi) else semi if semi >= 0 else len(code) - 1
        owners = [o for o in owners if o[0] > at]
        if word == "impl":
            target = re.split(r"\bwhere\b", rest.split(" for ")[-1])[0].strip()
            owners.append((end, re.sub(r"<.*", "", target).split("::")[-1].strip(" &")))
            continue
        name = re.match(r"\w+", rest)
        if not name:
            continue
        start, stop = _line_of(code, at), _line_of(code, end)
        owner = owners[-1][1] if owners else None
        kind = {"fn": "method" if owner else "function", "struct": "struct", "union": "struct", "enum": "enum", "trait": "interface", "type": "type_alias"}[word]
        out.append(_symbol(name.group(), owner, kind, lines[start - 1], start, stop, _comment_above(lines, start, False)))
        if word in ("trait", "fn"):
            owners.append((end, name.group()))
    return out


_TS_INITIALISER = re.compile(r"\s*(?::[^=;]*?)?=(?![=>])\s*(.*?)(?:\{|;|\n|\Z)", re.S)
_TS_FUNCTION = re.compile(r"(?:async\s+)?function\b")
_TS_UP_TO_BODY = re.compile(r"[^;{]*")


def _typescript(text: str, lines: list[str]):
    code = _hide(_TS_HIDE, text)
    owners, out = [], []
    for m in _TS_ITEM.finditer(code):
        word = (m.group(2) or "method").split()[0].rstrip("*")
        name = m.group(3) or m.group(5)
        at = m.start(1) if m.group(1) else m.start(4)
        owners = [o for o in owners if o[0] > at]
        owner = owners[-1][1] if owners else None
        if word == "method" and (name in _NOT_METHODS or not owners or not owners[-1][2]):
            continue
        if word in ("const", "let", "var"):
            if owner:
                continue
            init = _TS_INITIALISER.match(code, m.end())
            called = init and (_TS_FUNCTION.match(init.group(1)) or "=>" in _TS_UP_TO_BODY.match(code, m.end()).group())
            kind = "function" if called else "constant"
        else:
            kind = {"function": "function", "class": "class", "interface": "interface", "type": "type_alias", "enum": "enum", "method": "method"}[word]
        start = _line_of(code, at)
        brace = code.find("{", m.end() - 1)
        semi = code.find(";", m.end())
        plain = kind in ("constant", "type_alias") or (semi >= 0 and (brace < 0 or semi < brace))
        end = (semi if semi >= 0 else code.find("\n", m.end())) if plain else _closing(code, brace)
        end = end if end >= 0 else len(code) - 1
        out.append(_symbol(name, owner, kind, lines[start - 1], start, _line_of(code, end), _comment_above(lines, start, True)))
        if kind in ("class", "function", "method", "interface") and not plain:
            owners.append((end, name, kind == "class"))
    return out


PARSERS = {"python": _python, "rust": _rust, "typescript": _typescript}


def parse_symbols(language: str, text: str) -> list[dict]:
    """The symbols of a text in order of their lines; unknown languages and texts that fail have none."""
    parser = PARSERS.get(language)
    if parser is None or not text:
        return []
    lines = text.split("\n")
    return sorted(parser(text, [*lines, ""]), key=lambda s: (s["start_line"], s["qualified_name"]))


def with_symbols(files: DataFrame) -> DataFrame:
    """`files` (path, language, text, ...) with the column `symbols`, one Arrow pass over the texts."""
    fields = pa.list_(pa.struct([(k, pa.int32() if k.endswith("line") else pa.string()) for k in ("name", "qualified_name", "kind", "signature", "start_line", "end_line", "doc")]))
    names = files.columns

    def run(batches):
        for batch in batches:
            at = {n: i for i, n in enumerate(names)}
            found = [parse_symbols(lang, text or "") for lang, text in zip(batch.column(at["language"]).to_pylist(), batch.column(at["text"]).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, fields)], [*names, "symbols"])

    schema = T.StructType([*files.schema.fields, T.StructField("symbols", T._parse_datatype_string(f"array<{SYMBOL}>"))])
    return files.mapInArrow(run, schema)


def with_imports(files: DataFrame) -> DataFrame:
    """`files` with the column `imports`: array of (module, names, line, resolved_file_id, is_internal), JVM-side.

    One entry for each import line, in order of the lines; equal neighbours count once; nothing is resolved yet.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "\r$", "")))
    lang = F.col("language")
    one = lambda x: F.when(lang == "python", python_imports(x)).when(lang == "typescript", typescript_imports(x)).when(lang == "rust", rust_imports(x))
    numbered = F.transform(lines, lambda x, i: F.struct(one(x).alias("m"), (i + 1).alias("line")))
    kept = F.filter(numbered, lambda x: x["m"].isNotNull())
    rows = F.transform(
        kept,
        lambda x: F.struct(
            x["m"]["module"].alias("module"), x["m"]["names"].alias("names"), x["line"].cast("int").alias("line"),
            F.lit(None).cast("string").alias("resolved_file_id"), looks_internal(x["m"]["module"], F.col("path")).alias("is_internal"),
        ),
    )
    return files.withColumn("imports", F.array_distinct(rows))


def with_snippets(files: DataFrame) -> DataFrame:
    """`files` with the column `snippets` of the first symbols: (snippet_id, file_id, title, start_line, end_line, text)."""
    lines = F.split("text", "\n")

    def snippet(s):
        end = F.least(s["end_line"], s["start_line"] + SNIPPET_LINES, F.size(lines))
        return F.struct(
            F.concat("file_id", F.lit("#"), s["start_line"].cast("string"), F.lit("-"), end.cast("string")).alias("snippet_id"), F.col("file_id").alias("file_id"),
            s["name"].alias("title"), s["start_line"].alias("start_line"), end.alias("end_line"),
            F.array_join(F.slice(lines, s["start_line"], F.greatest(end - s["start_line"] + 1, F.lit(0))), "\n").alias("text"),
        )

    return files.withColumn("snippets", F.transform(F.slice("symbols", 1, SNIPPETS), snippet))


def symbol_facts(files: DataFrame) -> DataFrame:
    s = files.select("file_id", "path", F.explode("symbols").alias("s"))
    sid = F.concat("file_id", F.lit("::"), "s.qualified_name", F.lit(":"), F.col("s.start_line").cast("string"))
    return s.select(sid.alias("symbol_id"), "file_id", "path", "s.name", "s.qualified_name", "s.kind", "s.signature", "s.start_line", "s.end_line", F.concat_ws("-", "s.start_line", "s.end_line").alias("lines"), "s.doc")


def code_chunks(files: DataFrame) -> DataFrame:
    """One chunk for each function, method, class, struct, enum and interface with its whole body and, where it is useful, its documentation."""
    s = files.select("file_id", "path", "language", "source_hash", F.split("text", "\n").alias("ls"), F.explode("symbols").alias("s"))
    useful = doc_is_useful("s.doc")
    source = F.when(~useful, "empty").when(F.col("language") == "python", "docstring").otherwise("doc_comment")
    sid = F.concat("file_id", F.lit("::"), "s.qualified_name", F.lit(":"), F.col("s.start_line").cast("string"))
    doc = F.when(useful, F.trim("s.doc"))
    return s.filter(F.col("s.kind").isin(*CHUNK_KINDS) & (F.col("s.end_line") >= F.col("s.start_line"))).select(
        sid.alias("chunk_id"), "file_id", sid.alias("symbol_id"), "path", F.col("s.qualified_name").alias("qualified_name"), F.col("s.kind").alias("kind"),
        F.col("s.signature").alias("signature"), F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"), doc.alias("doc_summary"),
        F.lit(None).cast("string").alias("generated_summary"), source.alias("summary_source"),
        F.array_join(F.slice("ls", F.col("s.start_line"), F.col("s.end_line") - F.col("s.start_line") + 1), "\n").alias("code"), "source_hash",
    )
