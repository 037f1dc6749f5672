"""Source files that do not parse, by token pairs, nesting and statement productions.

A lexer pass turns each file into DataFrame rows of three kinds: the distinct adjacent pairs of its token classes
(brackets seen from outside as one operand), the distinct skeletons of its statements (Python: logical lines; Rust and
TypeScript: the file and each brace block, inner brackets as one operand), and in their order the marks of nesting - the
brackets that each line leaves open or closes (matched ones inside a line are taken out there), Python's indents, dedents
and statement heads. The rows are written once; then

- an anti-join removes the pairs that the grammar permits (a fixed table of a few thousand rows); any that is left is
  an error,
- the skeletons of all files are made distinct, the productions judge each of these once, and a semi-join finds the files
  that have one which no production derives,
- windowed reductions validate nesting: the running sum of openings gives each mark its depth, and among the marks of
  one depth every closing must follow its opening and every `else`, `except`, `finally` a head that allows it.

The permissible pairs follow from the rules below: which classes begin and end an operand, what stands between two
operands, and what a keyword demands after it.
"""

from __future__ import annotations

import re
from operator import add

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from cairn.llm.lexers import ERROR, INDENT_BASE, PY, RS, TS, python_classes, rust_classes, typescript_classes
from cairn.session import broadcast_if_small, checkpoint, table

LANGUAGE_OF = {"py": "python", "rs": "rust", "ts": "typescript"}
#: Bracket groups as operands, and the marks for the start and the end of a text, indent and dedent.
PAREN, SQUARE, BRACE, START, END, INDENT, DEDENT = "①", "②", "③", "▶", "◀", "⇥", "⇤"
_GROUP_OF, _OPENER, _CLOSER = {"(": PAREN, "[": SQUARE, "{": BRACE}, dict(zip("①②③", "([{")), dict(zip("①②③", ")]}"))


# ------------------------------------------------------------------------------------------ permissible pairs
def _cross(left, right) -> set[str]:
    return {a + b for a in left for b in right}


def python_pairs() -> set[str]:
    """What may follow what in Python."""
    names, ends, closers = "NHJ", "NHJ0S)]}", ")]}"
    begins = "NHJ0S([{"
    prefix = "nlAm~"
    operand = begins + prefix
    infix = "aiIocm*^@"
    p = _cross(ends, infix + "n=u:,.;fers>YFMV" + "([" + closers + "$") | {"SS"}
    p |= _cross("aiIocm*^@=uV>fe", operand) | {"=y", "uy", "In", "ni", "=*", "e:"}
    p |= _cross("nAm~", operand)
    p |= _cross("l", "NHJ*^:o") | _cross(",", operand + closers + "*^$=:io;y")
    p |= _cross(":", operand + "],:*^y=" + "RpqDgGMF;" + INDENT)
    p |= {".N", ".H", ".J", "..", ".M", ".0", "F.", "F0"} | _cross("([{", operand + closers + "*^:yo") | _cross("*", ",)") | _cross("o", ",)")
    p |= _cross("y", operand + "F*$;=," + closers) | _cross("[", ":")
    p |= _cross("$;", operand + "*yfEerwYdkRFMWtxzqgDpG@") | {";$"}
    p |= _cross("tz", ":") | _cross("x", operand + "*:") | _cross("R", operand + "*$;") | _cross("p", "$;") | _cross("q", operand + "$;")
    p |= _cross("dkG", names) | _cross("D", begins + "*") | _cross("gfEwWF@", operand) | _cross("r", begins + "*") | _cross("M", "NHJ(*")
    p |= _cross("s", "NHJ([{0S*m") | {"Yd", "Yr", "YW", "*$"} | _cross("HJ", operand + "*^")
    return p - {":$"}


def rust_pairs() -> set[str]:
    """What may follow what in Rust: all pairs but those that the rules exclude."""
    every = set(RS.values()) | set("N0LDa@")
    p = _cross(every | {START}, every | {END})
    heads = "FPUMSEITyclhwoRbvxXDa@LYu"
    p -= _cross("N0)]?", "N0" + heads)
    p |= {"0F", "LN"}
    stops = ")]};,=AqBJ?:j"
    p -= _cross("=AqBsi.j", stops + END) | _cross(":", ")]};,AqBJ?j" + END) | _cross("k", ")];,=AqBJ?:j" + END)
    p -= {a + b for a in "FSETMy" for b in every | {END} if b not in "N(" or (b == "(" and a != "F")}
    p -= {"U" + b for b in every | {END} if b not in "Nk{*"} | {"I" + b for b in every | {END} if b not in "N<!&([*ckLxn"}
    p -= {"l" + b for b in every | {END} if b not in "Nu([&0mk*|@g"} | {"P" + b for b in every | {END} if b not in "FSETMUycIxXYN([&*<nk"}
    p -= _cross("D@", ")]};,=.?" + END) | _cross("([{,", "AqB.?j" + "J:") | _cross("([", ";=")
    p -= {a + END for a in every if a not in "};a"} | {START + b for b in every if b not in "FPUMSEITycxXYNa@D;"}
    p -= _cross("m", stops + END) | {"j{"}
    p |= {START + END} | _cross("$", every) | _cross(every, "$")
    return p


def typescript_pairs() -> set[str]:
    """What may follow what in TypeScript: all pairs but those that the rules exclude."""
    every = set(TS.values()) | set("N0$")
    p = _cross(every | {START}, every | {END})
    p -= _cross("N0]", "N0vdkPMRwohCtZnb@T")
    stops = ")]};,=AqBJ?:"
    p -= _cross("=AqJQ", stops + END) | _cross("B", stops.replace("=", "").replace(",", "") + END) | _cross("m~", ")]};,=AqBJ" + END)
    p -= {a + b for a in ".Q" for b in every | {END} if b not in "NDTixuvdkPMRferwohCtKzZnb0$([<!"} | {".(", ".[", ".<", ".!"}
    p -= _cross("([{,", "AqJ") | _cross("([", ";") | _cross("&|", ")]};,=AqB" + END)
    name = "NDTi0xu"
    p -= {"P" + b for b in every | {END} if b not in "dkvCTD{BM=iN@"} | {"M" + b for b in every | {END} if b not in "N{0B(.TDi"}
    p -= {"v" + b for b in every | {END} if b not in name + "{[$"} | {"d" + b for b in every | {END} if b not in name + "B(<$"}
    p -= {"k" + b for b in every | {END} if b not in name + "{<$"} | {"n" + b for b in every | {END} if b not in name + "(.k[{<$"}
    p -= _cross("=AqBJ.Q,([{:?&|m!~nuPMvdkxZferwhtzg@C", END) | _cross("x", ")];,=AqBJ") | _cross("@", ")]};,=.?")
    return p | {START + END, "!" + END}


PERMISSIBLE = {"py": python_pairs(), "rs": rust_pairs(), "ts": typescript_pairs()}


# ------------------------------------------------------------------------------------------ statement productions
def _python_productions() -> re.Pattern:
    nm, op = "[NHJ]", "[mo*^@]"
    trailer = rf"(?:[NHJ0]|S+|[①②③])(?:\.{nm}|①|②)*+"
    unary = rf"[m~]*+A?{trailer}"
    arith = rf"{unary}(?:{op}{unary})*+"
    boolean = rf"n*+{arith}(?:(?:c|ni|In?|i){arith})*+(?:an*+{arith}(?:(?:c|ni|In?|i){arith})*+)*+"
    expr = rf"(?:{boolean}f{boolean}e|l[^:]*:)*{boolean}"
    named = rf"(?:{nm}V)?{expr}"
    many = rf"\*?{expr}(?:,\*?{expr})*+,?"
    targets = rf"\*?{trailer}(?:,\*?{trailer})*+,?"
    yields = rf"y(?:F{expr}|{many})?"
    rhs = rf"(?:{yields}|{many})"
    dotted = rf"{nm}(?:\.{nm})*+"
    simple = "|".join([
        rf"{many}(?:u{rhs}|:{expr}(?:={rhs})?|(?:={rhs})*)", yields, rf"R(?:{many})?", rf"q(?:{expr}(?:F{expr})?)?", "p", rf"D{many}",
        rf"g{expr}(?:,{expr})?", rf"G{nm}(?:,{nm})*", rf"M{dotted}(?:s{nm})?(?:,{dotted}(?:s{nm})?)*",
        rf"F[.0]*(?:{dotted})?M(?:\*|①|{nm}(?:s{nm})?(?:,{nm}(?:s{nm})?)*)", rf"H{nm}②?={expr}",
    ])
    item = rf"{expr}(?:s{trailer})?"
    heads = "|".join([
        rf"[fEw]{named}", rf"Y?r{targets}i{many}", "[etz]", rf"x(?:\*?{expr}(?:s{nm})?)?", rf"Y?W{item}(?:,{item})*", rf"Y?d{nm}②?①(?:>{expr})?",
        rf"k{nm}②?①?", r"[HJ][^:]+",
    ])
    suite = rf"(?:{simple})(?:;(?:{simple}))*;?"
    return re.compile(rf"(?:(?:{heads}):(?:{suite})?|{suite}|@{named})\Z")


_PY_LINE = _python_productions()
_RS_ITEM = (
    r"(?:[cYxX0]*+FN[^③;]*①[^③;]*[③;]|c?[SE]N[^③;]*[③;]|x?I[^③;]*③|x?TN[^③;]*[③;]|MN[③;]|U[^;:]*;|cu?N:[^;]*;|yN[^;]*;|X0?③|XN[^;]*;"
    r"|k?N(?:kN)*!(?:N?③|N?[①②];))"
)
_RS_FILE = re.compile(rf"(?:a|;|[@D]*+P?{_RS_ITEM})*+\Z")
_TS_BAD = re.compile(
    r"dB?[NDTi](?![①<NDTi$])|k[NDTi]?[^③;]*\Z|(?:\A|[$;])P?M(?!①|\.|[NDTi]=)[^$;0]*(?:[$;]|\Z)"
)
#: Statements that no block has, whatever its level: looked for in the inside of each brace group, groups in it collapsed.
_RS_STATEMENT = re.compile(
    r"(?:\A|[;③@D])l[^;]*\Z|e(?![③f])|(?:\A|;)[^;fl]*e|f[^③;,J]*(?:[;,]|\Z)|w[^③;]*(?:;|\Z)|h[^③;]*(?:;|\Z)|o(?!③)|FN(?![①<])|FN[^③;]*\Z"
    r"|[N0①②]\*(?:[;,]|\Z)"
    # a block behind an operand without a head, `in` without `for`, a function without `fn`, `if` or `for` behind a let's operand
    r"|(?:\A|[;③])[^;③fwrhFIxYvMTSEoeJ|$!]*[①②0]③|(?:\A|[;③])[^;③r$!]*i|PN①|YN|(?:\A|[;③@D])N①j|l[^;③$!]*[N0①②?][fr]"
)
_TS_STATEMENT = re.compile(
    r"(?<![.Q])(?:[fwh][N0!m~nu②③]|r[N0!②③]|t③(?![Kz])|o③(?!w))|(?<!t③)(?<!K③)(?<!K①③)(?<![.Q])z③"
    # parentheses and a block without a head, `export` of nothing, imports without `from` or `import`
    r"|(?:\A|[;③])①③|(?<![.Q])P(?:N|DN(?!③))|(?<![.Q])M(?:N,)?③0|(?:\A|;)③i0"
)
#: In what is a block for sure (a class or an object may have methods of these names).
_TS_ORDER = re.compile(r"\A[^f]*(?<![.Q])e|(?<!t③)(?<![.Q])K①?③|(?:\A|[;③])N①(?::[^;③①②=J]*)?③")
_TS_BLOCK = "①Jeotz"
_RS_MACRO = re.compile(r"N!N?[(\[{]")
_BRACKETS = re.compile(r"[()\[\]{}]")
#: What is no target of an assignment, and a positional argument after a named one.
_PY_TARGET = re.compile(r"(?:\A|[=;])[^=:;l]*(?:[NHJ①②]①|[0S]|[mocIfaAi^@][^=:;l]*)[=u]")
_PY_ORDER = re.compile(r"(?:\A|,)[NHJ]=[^,]+,[^=,*^:oVrl]+(?:,|\Z)")


def skeleton_ok(skeleton: str) -> bool:
    """Whether the productions derive a statement skeleton; its first character tells what it is (see `SKELETONS`)."""
    return SKELETONS[skeleton[0]](skeleton[1:])


#: Python line, Rust file and block, TypeScript file, block and other brace group.
SKELETONS = {
    "p": lambda s: bool(_PY_LINE.match(s)) and not _PY_TARGET.search(s),
    "R": lambda s: bool(_RS_FILE.match(s)),
    "r": lambda s: not _RS_STATEMENT.search(s),
    "T": lambda s: not _TS_BAD.search(s),
    "b": lambda s: not _TS_STATEMENT.search(s) and not _TS_ORDER.search(s),
    "t": lambda s: not _TS_STATEMENT.search(s),
}


# ------------------------------------------------------------------------------------------ lexing into rows
_INNER = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
_LAYOUT = re.compile(r"\$.", re.S)
_NOT_BRACKET = re.compile(r"[^()\[\]{}]+")
_PAIR = re.compile(r"\(\)|\[\]|\{\}")
_MATCH = {"(": ")", "[": "]", "{": "}"}
_decoded: dict[str, str] = {}


def _collapse(s: str, pairs: set, clean, statements: set | None = None, sign: str = "", block: str | None = None) -> str:
    """`s` with every bracket group as one operand; the pairs inside the groups go into `pairs`. With `statements` the
    skeleton of each brace group goes there: `block` in front of what is a block for sure, else `sign`."""

    def group(m: re.Match) -> str:
        g = m.group()
        inside = clean(g)
        pairs.update(map(add, inside, inside[1:]))
        if statements is not None and g[0] == "{":
            at = m.start()
            while at and s[at - 1] == "$":
                at -= 1
            code = g[1:-1].replace("$", "")
            statements.add((block if block and at and s[at - 1] in _TS_BLOCK else sign) + code)
        return _GROUP_OF[g[0]] if g[-1] == _MATCH[g[0]] else ERROR

    while True:
        done, n = _INNER.subn(group, s)
        if not n:
            return s
        s = done


def _without_macros(s: str) -> str:
    """`s` without the arguments of macros, which may be any tokens."""
    out, at = [], 0
    while m := _RS_MACRO.search(s, at):
        depth = 0
        for b in _BRACKETS.finditer(s, m.end() - 1):
            depth += 1 if b.group() in "([{" else -1
            if not depth:
                break
        else:
            break  # never closed: found by its brackets
        out.append(s[at : m.end()])
        at = b.start()
    return "".join([*out, s[at:]])


def _decode(pairs: set) -> set:
    out = set()
    for p in pairs:
        d = _decoded.get(p)
        if d is None:
            d = _decoded[p] = _CLOSER.get(p[0], p[0]) + _OPENER.get(p[1], p[1])
        out.add(d)
    return out


def _open_brackets(line: str) -> str:
    """The brackets of a line that it does not match itself."""
    b = _NOT_BRACKET.sub("", line)
    while b:
        b, n = _PAIR.subn("", b)
        if not n:
            break
    return b


def _python_rows(text: str):
    s = python_classes(text)
    pairs: set = set()
    marks, statements = [], set()

    def inside(g: str) -> str:
        g = _LAYOUT.sub("", g) if "$" in g else g
        if g[0] == "(" and "=" in g and "l" not in g and "*" not in g and _PY_ORDER.search(g[1:-1]):
            marks.append(ERROR)
        return g

    flat = _collapse(s, pairs, inside)
    lines = [x for x in flat.split("$")[1:] if len(x) > 1]
    stack, last, opened = [0], "", ""
    for line in lines:
        indent, code = ord(line[0]) - INDENT_BASE, line[1:]
        if indent > stack[-1]:
            stack.append(indent)
            marks.append(INDENT)
            pairs.add(last + INDENT) if last else marks.append(ERROR)
        else:
            if last:
                pairs.add(last + "$")
            while indent < stack[-1]:
                stack.pop()
                marks.append(DEDENT)
            if indent != stack[-1]:
                marks.append(ERROR)
                stack.append(indent)
                marks.append(INDENT)
        pairs.add("$" + code[0])
        pairs.update(map(add, code, code[1:]))
        head = code[0]
        if head == "Y" and len(code) > 1:
            head = {"d": "d", "r": "r"}.get(code[1], "h")
        if head in "HJ" and len(code) > 2 and ":" in code and code[1] not in ":=.,u":
            head = "m" if head == "H" and code[-1] == ":" else "c" if head == "J" else "h"
        head = "d" if head == "k" else head if head in "fEerwtxz@dmc" else "h"
        if marks and marks[-1] == INDENT and opened == "m" and head != "c":
            marks.append(ERROR)
        opened = head
        if head != "h" or not marks or marks[-1] != "h":
            marks.append(head)
        statements.add("p" + code)
        last = code[-1]
    if last:
        pairs.add(last + "$")
    marks += [DEDENT] * (len(stack) - 1)
    # brackets are validated on their own, after the layout: they never span a logical line
    for line in s.split("$"):
        marks += _open_brackets(line)
    return _decode(pairs), statements, marks


def _rust_rows(text: str):
    s = rust_classes(text)
    pairs: set = set()
    marks = [b for line in s.split("\n") for b in _open_brackets(line)]
    if ERROR in s:
        marks.append(ERROR)
    s, statements = _without_macros(s.replace("\n", "")), set()
    flat = _collapse(s, pairs, lambda g: "" if "$" in g else g, statements, "r")
    statements |= {"R" + flat, "r" + flat}
    whole = START + flat + END
    pairs.update(map(add, whole, whole[1:]))
    return _decode(pairs), statements, marks


#: A keyword behind a dot is a name.
_TS_PROPERTY = re.compile(r"(?<=[.Q])[vdkxPMRferwohCtKZznuibDTs]")


def _typescript_rows(text: str):
    s = _TS_PROPERTY.sub("N", typescript_classes(text)).replace("r(;", "r(0;")  # a loop's start may be empty
    pairs: set = set()
    marks = [b for line in s.split("$") for b in _open_brackets(line)]
    statements: set = set()
    flat = _collapse(s, pairs, lambda g: g, statements, "t", "b")
    statements |= {"T" + flat, "b" + flat.replace("$", "")}
    whole = START + flat.strip("$") + END
    pairs.update(map(add, whole, whole[1:]))
    return _decode(pairs), statements, marks


ROWS_OF = {"py": _python_rows, "rs": _rust_rows, "ts": _typescript_rows}


#: What `seq` holds for a pair, for a skeleton and for what else was looked for; marks have their order.
PAIR, SKELETON, OTHER = -1, -2, -3
_ROWS = pa.schema([("id", pa.int64()), ("copy", pa.int64()), ("seq", pa.int32()), ("mark", pa.int32()), ("code", pa.string())])


def syntax_rows(documents: DataFrame, find=None, columns: pa.Schema = pa.schema([])) -> DataFrame:
    """(id, copy, seq, mark, code): what the lexer finds in each text of (id, ext, text): in `code` pairs as `ext:xy` and
    skeletons as in `SKELETONS`, in `mark` the number of a mark's character. `copy` numbers the input rows, so that
    repeated rows of an id stay apart. What `find(ext, text)` lists in the same pass comes as rows of its `columns`."""
    schema = pa.schema([*_ROWS, *columns])

    def run(batches):
        copy = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, copies, seqs, signs, codes, found = [], [], [], [], [], []
            for i, ext, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                pairs, statements, marks = ROWS_OF[ext](text)
                codes += [f"{ext}:{p}" for p in pairs]
                codes += statements
                codes += [None] * len(marks)
                signs += [0] * (len(pairs) + len(statements))
                signs += map(ord, marks)
                seqs += [PAIR] * len(pairs)
                seqs += [SKELETON] * len(statements)
                seqs += range(len(marks))
                n = len(codes) - len(ids)
                ids += [i] * n
                copies += [copy] * n
                if find is not None:
                    found += [(i, copy, OTHER, 0, None, *x) for x in find(ext, text)]
                copy += 1
            parts = [pa.array(x, f.type) for x, f in zip((ids, copies, seqs, signs, codes), _ROWS)]
            parts += [pa.nulls(len(ids), f.type) for f in columns]
            yield pa.RecordBatch.from_arrays(parts, schema=schema)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), schema)], schema=schema)

    return documents.select("id", "ext", "text").mapInArrow(run, from_arrow_schema(schema))


def _underivable(batches):
    for batch in batches:
        yield batch.filter(pa.array([not skeleton_ok(s) for s in batch.column(0).to_pylist()], pa.bool_()))


def permissible_pairs(spark: SparkSession) -> DataFrame:
    rows = sorted(f"{ext}:{p}" for ext, pairs in PERMISSIBLE.items() for p in pairs)
    return spark.createDataFrame([(r,) for r in rows], "code string")


#: Which head may come just before, on the same level of the same block.
AFTER = {"c": ["c", INDENT], "E": ["f", "E"], "e": ["f", "E", "r", "w", "x"], "x": ["t", "x"], "z": ["t", "x", "e"]}
BEFORE = {"t": ["x", "z"], "@": ["@", "d"], "c": ["c", DEDENT]}


def invalid_ids(documents: DataFrame) -> DataFrame:
    """(id): texts of (id, ext, text) with a pair, a nesting or a statement that their language does not have.

    Null texts and unknown extensions are not judged. The empty text is valid, and so is a byte order mark.
    """
    return invalid_rows(checkpoint(syntax_rows(known_files(documents))))  # three uses of one pass over the texts


def known_files(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("ext").isin(*LANGUAGE_OF) & F.col("text").isNotNull())


def invalid_rows(rows: DataFrame) -> DataFrame:
    """(id) of `invalid_ids`, from the (written) rows of `syntax_rows`."""
    spark = rows.sparkSession
    # fixed size: a few thousand rows that follow from the rules
    odd = rows.filter(F.col("seq") == PAIR).join(F.broadcast(permissible_pairs(spark)), "code", "left_anti")
    skeletons = rows.filter(F.col("seq") == SKELETON)
    wrong = checkpoint(skeletons.select("code").distinct().mapInArrow(_underivable, "code string"))
    unsound = skeletons.join(broadcast_if_small(wrong), "code", "left_semi")
    return odd.select("id").unionByName(unsound.select("id")).unionByName(_badly_nested(rows.filter(F.col("seq") >= 0).select("id", "copy", "seq", "mark"))).distinct()


def _badly_nested(marks: DataFrame) -> DataFrame:
    """(id): texts whose marks (id, copy, seq, mark) do not nest, or hold an error."""
    mark, one = F.col("mark"), lambda x: F.lit(ord(x))
    among = lambda c, xs: c.isin(*map(ord, xs))
    opens, closes = among(mark, ["(", "[", "{", INDENT]), among(mark, [")", "]", "}", DEDENT])
    run = Window.partitionBy("copy").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("copy", "level").orderBy("seq")
    prev, following = F.lag("mark").over(level), F.lead("mark").over(level)
    opener = F.when(mark == one(")"), one("(")).when(mark == one("]"), one("[")).when(mark == one("}"), one("{")).otherwise(one(INDENT))
    closer = F.when(mark == one("("), one(")")).when(mark == one("["), one("]")).otherwise(one("}"))
    error = mark == one(ERROR)
    wrong = F.when(error, True).when(closes, ~prev.eqNullSafe(opener) & ~((mark == one(DEDENT)) & among(prev, "hfEerwxzdmc") & prev.isNotNull()))
    wrong = wrong.when(opens & (mark != one(INDENT)), ~following.eqNullSafe(closer))
    for head, before in AFTER.items():
        wrong = wrong.when((mark == one(head)) & ~F.coalesce(among(prev, before), F.lit(False)), True)
    for head, after in BEFORE.items():
        wrong = wrong.when((mark == one(head)) & ~F.coalesce(among(following, after), F.lit(False)), True)
    return (
        marks.withColumn("depth", F.sum(F.when(error, 0).when(opens, 1).when(closes, -1).otherwise(0)).over(run))
        .withColumn("level", F.when(error, -1).otherwise(F.col("depth") + F.when(closes, 1).otherwise(0)))
        .withColumn("wrong", F.coalesce(wrong, F.lit(False)))
        .filter("wrong")
        .select("id")
    )


def source_files(documents: DataFrame) -> DataFrame:
    """(id, file_id, repo, ext, text) of the source documents; ext is the path's extension in lower case."""
    ext = F.lower(F.regexp_extract(F.coalesce("path", "file_id"), r"\.([A-Za-z0-9]+)$", 1))
    return documents.filter((F.col("kind") == "source_file") & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("id"), "file_id", F.col("source").alias("repo"), ext.alias("ext"), "text"
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(table(spark, sf_dir, "documents"))
    return files.select("id", "file_id").join(invalid_ids(files), "id", "left_semi").select("file_id").distinct()


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, language, files, invalid, rate): how many source files of each repository and language do not parse; repeated
    rows are one file."""
    files = source_files(table(spark, sf_dir, "documents")).filter(F.col("ext").isin(*LANGUAGE_OF))
    each = files.select("id", "file_id", "repo", "ext").distinct()
    language = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])[F.col("ext")]
    marked = each.join(invalid_ids(files).withColumn("invalid", F.lit(1)), "id", "left")
    return (
        marked.groupBy("repo", language.alias("language"))
        .agg(F.count(F.lit(1)).alias("files"), F.count("invalid").alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )


SQL = {}
QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates}
