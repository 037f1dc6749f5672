"""What is read beside facts: documentation above a symbol, behaviours of symbols and purposes of imports from a card.

The matches are theta conditions between the elements of one file, so they are higher-order functions over arrays that a
file bounds, never joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.ids import canonical_path
from cairn.operators.read import meaningful_behaviour
from cairn.session import table

_DOC_LINE = r"^(///|//!|#|\*)"
_MARKS = r"^(///)*(//!)*(//)*#*\**"


def source_lines(text: Column | str) -> Column:
    """The lines of a text, without line ends; null and empty texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.split(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n$", ""), "\n")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(lines)


def doc_above(lines: Column | str, start: Column | str) -> Column:
    """The documentation that ends on the line above line `start` (from 1); null if there is none.

    The walk upwards goes on over lines that begin with a documentation mark, and over blank ones once there was such a
    line. Marks are dropped, the lines of a block are joined by a blank, and blank lines between blocks become line ends.
    """
    start = F.col(start) if isinstance(start, str) else start
    above = F.reverse(F.transform(F.slice(lines, 1, F.greatest(start - 1, F.lit(0))), lambda x: F.ltrim(x)))
    stop = F.array_position(F.transform(above, lambda x: (x != "") & ~x.rlike(_DOC_LINE)), True)
    run = F.when(stop > 0, F.slice(above, 1, F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(above)
    text = F.array_join(F.reverse(F.transform(run, lambda x: F.trim(F.regexp_replace(x, _MARKS, "")))), "\n")
    blocks = F.transform(F.split(text, "\n\n"), lambda b: F.trim(F.regexp_replace(b, r"\s*\n\s*", " "), F.lit(" \n\t\r")))
    joined = F.array_join(F.filter(blocks, lambda b: b != ""), "\n")
    return F.when(F.try_element_at(above, F.lit(1)).rlike(_DOC_LINE), F.nullif(joined, F.lit("")))


def behaviour_of(symbol_id: Column, name: Column, qualified: Column, behaviours: Column) -> Column:
    """The first of `behaviours` (symbol_id, name, behavior) of the symbol's id or name, or whose name its qualified name
    ends with; null if none is."""
    hit = F.filter(behaviours, lambda b: (b["symbol_id"] == symbol_id) | (b["name"] == name) | F.endswith(qualified, b["name"]))
    return F.try_element_at(hit, F.lit(1))


def purpose_of(module: Column, resolved: Column, interpreted: Column) -> Column:
    """Why a module is imported, by the first of `interpreted` (target_id, target_path, why) that is its resolved file, by
    id or path, or of which one path holds the other; null if none is or it says nothing."""
    slashed = F.replace(module, F.lit("."), F.lit("/"))
    hit = F.filter(
        interpreted,
        lambda i: F.coalesce((resolved == i["target_id"]) | (resolved == i["target_path"]), F.lit(False))
        | F.contains(i["target_path"], slashed) | F.contains(module, F.replace(i["target_path"], F.lit("/"), F.lit("."))),
    )
    why = F.try_element_at(hit, F.lit(1))["why"]
    return F.when(F.trim(why) != "", why)


def batch_count(n: Column, size: int) -> Column:
    """In how many batches of `size` so many items go."""
    return F.ceil(n / F.lit(max(1, size))).cast("long")


def symbol_docs(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """(symbol_id, doc) of symbols (symbol_id, file_id, start_line) whose source (file_id, text) has documentation above."""
    lines = sources.select("file_id", source_lines("text").alias("ls"))
    return symbols.join(lines, "file_id").select("symbol_id", doc_above("ls", F.col("start_line")).alias("doc")).filter("doc IS NOT NULL")


def symbol_behaviours(symbols: DataFrame) -> DataFrame:
    """(symbol_id, behaviour): what the first matching behaviour of its file says of each symbol, where that has a meaning."""
    known = symbols.filter("behavior IS NOT NULL").groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("symbol_id", "name", "behavior"))).alias("b")
    )
    hit = behaviour_of(F.col("symbol_id"), F.col("name"), F.col("qualified_name"), F.col("b"))
    said = meaningful_behaviour(hit["behavior"], F.coalesce("signature", F.lit("")))
    return symbols.join(known, "file_id").select("symbol_id", said.alias("behaviour")).filter("behaviour IS NOT NULL")


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "read_symbols").dropDuplicates(["symbol_id"])


def doc_at_read(spark: SparkSession, d: str) -> DataFrame:
    """(symbol_id, doc) by the lines of the file's document."""
    start = F.split_part("lines", F.lit("-"), F.lit(1)).try_cast("int")
    docs = table(spark, d, "documents").filter("kind = 'source_file' AND file_id IS NOT NULL").groupBy("file_id").agg(F.min_by("text", "doc_id").alias("text"))
    return symbol_docs(_symbols(spark, d).withColumn("start_line", start).filter("start_line > 0"), docs)


def behaviours_of_symbols(spark: SparkSession, d: str) -> DataFrame:
    return symbol_behaviours(_symbols(spark, d))


def import_purposes(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, module, purpose): imports with what the cards of the files they reach in the repository say."""
    files = table(spark, d, "files").dropDuplicates(["file_id"])
    w = Window.partitionBy("k").orderBy("card_id")
    cards = table(spark, d, "file_cards").select(canonical_path("file_id").alias("k"), "card_id", "summary").filter("trim(summary) <> ''").withColumn("n", F.row_number().over(w)).filter("n = 1")
    one = files.select("file_id", F.explode("imports").alias("i")).select("file_id", F.col("i.module").alias("module"), F.col("i.resolved_file_id").alias("target")).distinct()
    said = one.join(cards, F.col("target") == F.col("k")).join(files.select(F.col("file_id").alias("target"), "path"), "target")
    known = said.groupBy("file_id").agg(F.array_sort(F.collect_set(F.struct(F.col("target").alias("target_id"), F.col("path").alias("target_path"), F.col("summary").alias("why")))).alias("known"))
    return one.join(known, "file_id").select("file_id", "module", purpose_of(F.col("module"), F.col("target"), F.col("known")).alias("purpose")).filter("purpose IS NOT NULL").distinct()


def summary_batches(spark: SparkSession, d: str) -> DataFrame:
    """(repo, chunks, batches): chunks without documentation and the requests of 32 that their summaries take."""
    c = table(spark, d, "code_chunks").dropDuplicates(["chunk_id"]).filter("trim(coalesce(doc_summary, '')) = ''")
    return c.groupBy("repo").agg(F.count(F.lit(1)).alias("chunks"), batch_count(F.count(F.lit(1)), 32).alias("batches"))


_P = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(replace(trim({c}), '\', '/'), '/+', '/', 'g'), '(/\.)+/', '/', 'g'), '^(\./)+', '')"
SQL = {
    "doc_at_read": r"""WITH s AS (SELECT DISTINCT ON (symbol_id) symbol_id, file_id, try_cast(split_part(lines, '-', 1) AS INT) AS start FROM read_symbols),
  d AS (SELECT file_id, string_split(regexp_replace(replace(arg_min(text, doc_id), chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) AS ls
        FROM documents WHERE kind = 'source_file' AND file_id IS NOT NULL GROUP BY 1),
  a AS (SELECT symbol_id, list_transform(list_reverse(ls[1:start - 1]), lambda x: ltrim(x)) AS up FROM s JOIN d USING (file_id) WHERE start > 0),
  b AS (SELECT symbol_id, up, list_position(list_transform(up, lambda x: x <> '' AND NOT regexp_matches(x, '^(///|//!|#|\*)')), true) AS stop FROM a WHERE len(up) > 0 AND regexp_matches(up[1], '^(///|//!|#|\*)')),
  c AS (SELECT symbol_id, array_to_string(list_transform(list_reverse(CASE WHEN stop > 0 THEN up[1:stop - 1] ELSE up END), lambda x: trim(regexp_replace(x, '^(///)*(//!)*(//)*#*\**', ''))), chr(10)) AS t FROM b),
  e AS (SELECT symbol_id, array_to_string(list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '\s*\n\s*', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS doc FROM c)
SELECT symbol_id, doc FROM e WHERE doc <> ''""",
    "behaviours_of_symbols": """WITH s AS (SELECT DISTINCT ON (symbol_id) * FROM read_symbols),
  m AS (SELECT s.symbol_id, s.signature, arg_min(b.behavior, b.symbol_id) AS said FROM s JOIN s b ON s.file_id = b.file_id AND b.behavior IS NOT NULL
        AND (b.symbol_id = s.symbol_id OR b.name = s.name OR suffix(s.qualified_name, b.name)) GROUP BY 1, 2)
SELECT symbol_id, trim(said) AS behaviour FROM m WHERE trim(said) <> '' AND trim(said) <> trim(coalesce(signature, '')) AND NOT regexp_matches(trim(said), '^(fn|struct|enum|impl) ')""",
    "import_purposes": f"""WITH f AS (SELECT DISTINCT ON (file_id) * FROM files), c AS (SELECT {_P("file_id")} AS k, arg_min(summary, card_id) AS summary FROM file_cards WHERE trim(summary) <> '' GROUP BY 1),
  o AS (SELECT DISTINCT file_id, i.module AS module, i.resolved_file_id AS target FROM (SELECT file_id, unnest(imports) AS i FROM f)),
  k AS (SELECT DISTINCT o.file_id, o.target AS tid, f.path AS tp, c.summary AS why FROM o JOIN c ON o.target = c.k JOIN f ON f.file_id = o.target),
  h AS (SELECT o.file_id, o.module, o.target, arg_min(why, row(tid, tp, why)) AS why FROM o JOIN k USING (file_id)
        WHERE o.target = tid OR o.target = tp OR contains(tp, replace(module, '.', '/')) OR contains(module, replace(tp, '/', '.')) GROUP BY ALL)
SELECT DISTINCT file_id, module, why AS purpose FROM h WHERE trim(why) <> ''""",
    "summary_batches": """SELECT repo, count(*) AS chunks, ceil(count(*) / 32.0)::BIGINT AS batches FROM (SELECT DISTINCT ON (chunk_id) * FROM code_chunks) WHERE trim(coalesce(doc_summary, '')) = '' GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (doc_at_read, behaviours_of_symbols, import_purposes, summary_batches)}
