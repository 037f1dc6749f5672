"""Projections and extractions over texts, identifiers and paths, as registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.session import table
from cairn.sources.scan import DEFAULT_IGNORES, EXTENSIONS, ignored_path

#: The line chunker: lines in a window, and how many two windows share.
CHUNK_LINES, CHUNK_OVERLAP = 40, 10


def line_windows(c: Column | str, size: int = CHUNK_LINES, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows (start_line, end_line, text) of a text's lines, one every size - overlap lines; the last may be short.

    An empty text has one empty line; null gives null.
    """
    lines = F.split(c, "\n")
    n = F.size(lines)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(
        starts,
        lambda s: F.struct(
            (s + 1).alias("start_line"), F.least(s + size, n).alias("end_line"), F.array_join(F.slice(lines, s + 1, F.lit(size)), "\n").alias("text")
        ),
    )


def python_imports(line: Column) -> Column:
    """(module, names) of a Python import line; null for other lines. Only the first module of `import a, b` counts."""
    from_module, names = F.regexp_extract(line, r"^from\s+(\S+)\s+import\s+(.*)$", 1), F.regexp_extract(line, r"^from\s+(\S+)\s+import\s+(.*)$", 2)
    plain = F.regexp_extract(line, r"^import\s+([^\s,;#]+)", 1)
    parts = F.filter(F.transform(F.split(names, ","), lambda x: F.split(F.trim(x), r"\s+")[0]), lambda x: x != "")
    return F.when(from_module != "", F.struct(from_module.alias("module"), parts.alias("names"))).when(
        plain != "", F.struct(plain.alias("module"), F.array().cast("array<string>").alias("names"))
    )


def typescript_imports(line: Column) -> Column:
    """(module, names) of a line that starts with `import ` or `export ` and holds a quoted module."""
    module = F.regexp_extract(line, r"""^(?:import|export) [^"']*["']([^"']+)["']""", 1)
    inner = F.regexp_extract(line, r"\{([^}]*)\}", 1)
    names = F.filter(F.transform(F.split(inner, ","), lambda x: F.split(F.trim(x), r"\s+")[0]), lambda x: x != "")
    return F.when(module != "", F.struct(module.alias("module"), names.alias("names")))


def rust_imports(line: Column) -> Column:
    """(module with dots, names) of a line that starts with `use ` and ends with `;`."""
    body = F.regexp_replace(F.regexp_extract(line, r"^use\s+(.*?);?\s*$", 1), ";", "")
    grouped = F.regexp_extract(body, r"^(.*?)::\{(.*)\}", 1)
    names = F.filter(F.transform(F.split(F.regexp_extract(body, r"^(.*?)::\{(.*)\}", 2), ","), lambda x: F.trim(x)), lambda x: x != "")
    whole = F.when(grouped != "", grouped).otherwise(body)
    return F.when(body != "", F.struct(F.replace(whole, F.lit("::"), F.lit(".")).alias("module"), F.when(grouped != "", names).otherwise(F.array().cast("array<string>")).alias("names")))


def looks_internal(module: Column, path: Column) -> Column:
    first = F.split_part(path, F.lit("/"), F.lit(1))
    return module.rlike(r"^(\.|crate\.|self\.|super\.)") | module.startswith(first)


def source_imports(docs: DataFrame) -> DataFrame:
    """(doc_id, line, module, names, is_internal) of the import lines of (doc_id, path, text); repeats on a line once."""
    rows = docs.filter("text IS NOT NULL").select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    line, lang = F.trim(F.regexp_replace("raw", "\r$", "")), T.language_of("path")
    found = F.when(lang == "python", python_imports(line)).when(lang == "typescript", typescript_imports(line)).when(lang == "rust", rust_imports(line))
    return (
        rows.filter(F.col("raw").rlike(r"^\s*(import|from|use|export)\s"))
        .select("doc_id", "path", (F.col("n") + 1).alias("line"), found.alias("i"))
        .filter("i IS NOT NULL")
        .select("doc_id", "line", "i.module", F.array_join("i.names", ",").alias("names"), looks_internal(F.col("i.module"), F.col("path")).alias("is_internal"))
        .distinct()
    )


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").dropDuplicates(["doc_id"])


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("hash"))


def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several documents share: class id, members and length."""
    h = _docs(spark, d).filter("text IS NOT NULL").select("doc_id", "n_chars", F.sha2("text", 256).alias("hash"))
    return h.groupBy("hash").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members"), F.max("n_chars").alias("n_chars")).filter("members > 1")


def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    w = _docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.explode(line_windows("text")).alias("w"))
    return w.select("doc_id", "w.start_line", "w.end_line", F.length("w.text").alias("chars"), F.sha2("w.text", 256).alias("hash"))


def identifier_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "read_symbols").select("name").distinct().select("name", F.array_join(T.identifier_terms("name"), " ").alias("terms"))


def sanitize_tags(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "file_cards").dropDuplicates(["card_id"])
    tags = F.transform("retrieval_tags", lambda t: F.concat(F.lit(" Tag/"), F.upper(t), F.lit("__X- ")))
    return c.select("card_id", F.array_join(T.sanitize_tags(F.concat(tags, F.col("retrieval_tags")), 24), ",").alias("tags"))


def clean_items(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "file_cards").dropDuplicates(["card_id"])
    items = F.concat(F.col("primary_behaviors"), F.transform("primary_behaviors", lambda x: F.concat(F.lit(" "), F.upper(x))), F.array("summary", "role_text"))
    return c.select("card_id", F.array_join(T.clean_strings(items, 32), "|").alias("items"))


def useful_docs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "read_symbols").dropDuplicates(["symbol_id"])
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("symbols"), F.sum(T.doc_is_useful("doc").cast("long")).alias("useful"))


def path_facts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").dropDuplicates(["file_id"])
    return f.select("file_id", T.language_of("path").alias("lang"), T.parent_folder("path").alias("folder"), T.extension("path").alias("ext"))


def scan_filter(spark: SparkSession, d: str) -> DataFrame:
    """Which paths a scan keeps: extension, default folders, one ignored subtree and one ignored component."""
    f = table(spark, d, "files").select("path").distinct()
    keep = T.extension("path").isin(*EXTENSIONS) & ~ignored_path("path", ["src/wharf_batch", "orbit"])
    return f.filter(keep).groupBy(T.extension("path").alias("ext")).agg(F.count(F.lit(1)).alias("files"))


def import_extract(spark: SparkSession, d: str) -> DataFrame:
    return source_imports(_docs(spark, d).filter("kind = 'source_file'").select("doc_id", "path", "text"))


def json_field_extract(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def summary_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line, clean): hashes of every text as one line of at most 400 characters, and without bullets."""
    docs = _docs(spark, d).filter("text IS NOT NULL")
    return docs.select("doc_id", F.sha2(T.truncate(T.one_line("text"), 400), 256).alias("line"), F.sha2(T.clean_summary("text"), 256).alias("clean"))


_D = "d AS (SELECT DISTINCT ON (doc_id) * FROM documents)"
_C = "c AS (SELECT DISTINCT ON (card_id) * FROM file_cards)"
_SPACE = r"[\t\n\x0b\f\r ]"
_IGN = ", ".join(f"'{x}'" for x in DEFAULT_IGNORES)
SQL = {
    "content_hash": f"WITH {_D} SELECT doc_id, sha256(text) AS hash FROM d",
    "exact_dup_groups": f"""WITH {_D} SELECT sha256(text) AS hash, min(doc_id) AS class_id, count(*) AS members, max(n_chars) AS n_chars FROM d WHERE text IS NOT NULL
GROUP BY 1 HAVING count(*) > 1""",
    "line_chunks": f"""WITH {_D}, l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM d WHERE text IS NOT NULL), s AS (SELECT doc_id, a, unnest(range(0, len(a), 30)) AS s FROM l),
  w AS (SELECT doc_id, (s + 1)::INT AS start_line, least(s + 40, len(a))::INT AS end_line, array_to_string(a[s + 1 : s + 40], chr(10)) AS t FROM s)
SELECT doc_id, start_line, end_line, length(t)::INT AS chars, sha256(t) AS hash FROM w""",
    "identifier_terms": r"""WITH n AS (SELECT DISTINCT name, regexp_replace(name, '^_+|_+$', '', 'g') AS b FROM read_symbols),
  p AS (SELECT name, unnest(list_distinct(list_concat([lower(b)], list_transform(regexp_split_to_array(regexp_replace(b, '([\p{Ll}0-9])(\p{Lu})', '\1_\2', 'g'), '_'), lambda x: lower(trim(x)))))) AS t FROM n)
SELECT name, string_agg(t, ' ' ORDER BY t) AS terms FROM p WHERE length(t) >= 2 GROUP BY 1""",
    "sanitize_tags": f"""WITH {_C}, t AS (SELECT card_id, list_concat(list_transform(retrieval_tags, lambda t: ' Tag/' || upper(t) || '__X- '), retrieval_tags) AS a FROM c),
  s AS (SELECT card_id, list_filter(list_transform(a, lambda x: regexp_replace(regexp_replace(regexp_replace(lower(trim(x)), '[^a-z0-9:_-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')), lambda x: x <> '') AS a FROM t)
SELECT card_id, coalesce(array_to_string(list_transform(list_filter(list_zip(a, range(1, len(a) + 1)), lambda z: list_position(a, z[1]) = z[2]), lambda z: z[1])[1:24], ','), '') AS tags FROM s""",
    "clean_items": f"""WITH {_C}, t AS (SELECT card_id, list_concat(primary_behaviors, list_transform(primary_behaviors, lambda x: ' ' || upper(x)), [summary, role_text]) AS a FROM c),
  s AS (SELECT card_id, list_filter(list_transform(a, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS a FROM t),
  k AS (SELECT card_id, a, list_transform(a, lambda x: lower(x)) AS b FROM s)
SELECT card_id, coalesce(array_to_string(list_transform(list_filter(list_zip(a, b, range(1, len(a) + 1)), lambda z: list_position(b, z[2]) = z[3]), lambda z: z[1])[1:32], '|'), '') AS items FROM k""",
    "useful_docs": """SELECT kind, count(*) AS symbols, sum(CASE WHEN strlen(trim(doc)) >= 12 AND lower(trim(doc)) NOT IN ('todo', 'fixme', 'placeholder', 'stub', 'handles event', 'helper', 'main') THEN 1 ELSE 0 END)::BIGINT AS useful
FROM (SELECT DISTINCT ON (symbol_id) * FROM read_symbols) GROUP BY 1""",
    "path_facts": r"""WITH f AS (SELECT DISTINCT ON (file_id) file_id, path, regexp_extract(path, '\.([^./]+)$', 1) AS ext FROM files)
SELECT file_id, CASE WHEN ext = 'py' THEN 'python' WHEN ext IN ('ts', 'tsx') THEN 'typescript' WHEN ext = 'rs' THEN 'rust' ELSE ext END AS lang,
  coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), 'repo') AS folder, ext FROM f""",
    "scan_filter": rf"""WITH f AS (SELECT DISTINCT path, regexp_extract(path, '\.([^./]+)$', 1) AS ext FROM files)
SELECT ext, count(*) AS files FROM f WHERE ext IN ('py', 'ts', 'tsx', 'rs') AND NOT list_has_any(string_split(path, '/'), [{_IGN}]) AND NOT list_contains(string_split(path, '/'), 'orbit')
  AND path <> 'src/wharf_batch' AND NOT starts_with(path, 'src/wharf_batch/') GROUP BY 1""",
    "import_extract": rf"""WITH {_D}, l AS (SELECT doc_id, path, regexp_extract(path, '\.([^./]+)$', 1) AS ext, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line
    FROM d WHERE kind = 'source_file' AND text IS NOT NULL),
  t AS (SELECT *, trim(regexp_replace(raw, '\r$', '')) AS x FROM l WHERE regexp_matches(raw, '^{_SPACE}*(import|from|use|export){_SPACE}')),
  m AS (SELECT doc_id, path, line, ext, x, regexp_extract(x, '^from\s+(\S+)\s+import\s+(.*)$', 1) AS f, regexp_extract(x, '^from\s+(\S+)\s+import\s+(.*)$', 2) AS fn, regexp_extract(x, '^import\s+([^\s,;#]+)', 1) AS i,
    regexp_extract(x, '^(?:import|export) [^"'']*["'']([^"'']+)["'']', 1) AS ts, regexp_extract(x, '\{{([^}}]*)\}}', 1) AS tn, replace(regexp_extract(x, '^use\s+(.*?);?\s*$', 1), ';', '') AS u FROM t),
  k AS (SELECT *, regexp_extract(u, '^(.*?)::\{{(.*)\}}', 1) AS ug, regexp_extract(u, '^(.*?)::\{{(.*)\}}', 2) AS un FROM m),
  r AS (SELECT doc_id, path, line, CASE WHEN ext = 'py' THEN coalesce(nullif(f, ''), nullif(i, '')) WHEN ext IN ('ts', 'tsx') THEN nullif(ts, '') WHEN ext = 'rs' THEN nullif(replace(CASE WHEN ug <> '' THEN ug ELSE u END, '::', '.'), '') END AS module,
    CASE WHEN ext = 'py' AND f <> '' THEN fn WHEN ext IN ('ts', 'tsx') THEN tn WHEN ext = 'rs' AND ug <> '' THEN un ELSE '' END AS names, ext FROM k)
SELECT DISTINCT doc_id, line::INT AS line, module, array_to_string(list_filter(list_transform(string_split(names, ','), lambda x: CASE WHEN ext = 'rs' THEN trim(x) ELSE regexp_split_to_array(trim(x), '\s+')[1] END), lambda x: x <> ''), ',') AS names,
  regexp_matches(module, '^(\.|crate\.|self\.|super\.)') OR starts_with(module, string_split(path, '/')[1]) AS is_internal FROM r WHERE module IS NOT NULL""",
    "json_field_extract": "SELECT event_type, json_extract_string(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1, 2",
    "summary_cleanup": rf"""WITH {_D}, t AS (SELECT doc_id, text, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')) AS s FROM d WHERE text IS NOT NULL)
SELECT doc_id, sha256(CASE WHEN length(s) > 400 THEN substr(s, 1, 400) || '...' ELSE s END) AS line,
  sha256(coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^(?:[-*•]|{_SPACE})+', ''))), lambda x: x <> ''), ' '), '')) AS clean FROM t""",
}
QUERIES = {
    f.__name__: f
    for f in (content_hash, exact_dup_groups, line_chunks, identifier_terms, sanitize_tags, clean_items, useful_docs, path_facts, scan_filter, import_extract, json_field_extract, summary_cleanup)
}
