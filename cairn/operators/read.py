"""Read views: one row for each file with its symbols, imports and dependencies, for all files in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.ids import canonical_path
from cairn.functions.text import low_signal_test_path
from cairn.operators.ranking import group_ranks
from cairn.session import table

# Pack mode -> symbols, dependencies, whether the description is shown.
PACKS = {"brief": (8, 3, False), "edit": (16, 8, True), "flow": (10, 12, True)}


def labelled(**parts) -> Column:
    """`Label: value` lines of the parts that are not empty, null if none is. `_` in a label is a blank."""
    rows = [F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(F.lit(k.replace("_", " ") + ": "), v)) for k, v in parts.items()]
    return F.nullif(F.concat_ws("\n", *rows), F.lit(""))


def meaningful_behaviour(behaviour: Column, signature: Column) -> Column:
    """A behaviour that is not empty, not the signature and does not look like code."""
    b = F.trim(behaviour)
    return F.when((b != "") & ~b.eqNullSafe(F.trim(signature)) & ~b.rlike(r"^(fn|struct|enum|impl) "), b)


def symbol_outline(symbols: DataFrame) -> DataFrame:
    """(file_id, symbols, total): `lines kind qualified :: signature` of each file's symbols in line order."""
    start = F.split_part("lines", F.lit("-"), F.lit(1)).cast("int")
    text = F.concat_ws(" ", "lines", "kind", "qualified_name", F.lit("::"), F.trim(F.regexp_replace(F.coalesce("signature", F.lit("")), r"\s+", " ")))
    rows = symbols.select("file_id", F.struct(start.alias("l"), F.col("symbol_id").alias("i"), text.alias("t")).alias("s"))
    # a file's symbols are bounded by its length
    grouped = rows.groupBy("file_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return grouped.select("file_id", F.transform("s", lambda x: x["t"]).alias("symbols"), F.size("s").alias("total_symbols"))


def import_groups(files: DataFrame) -> DataFrame:
    """(file_id, external, internal): external modules as sorted text; internal ones as `module -> file (names)`."""
    i = F.col("imports")
    external = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(i, lambda x: ~x["is_internal"]), lambda x: x["module"]))), ", ")
    shown = lambda x: F.concat(
        x["module"], F.coalesce(F.concat(F.lit(" -> "), x["resolved_file_id"]), F.lit("")), F.when(F.size(x["names"]) > 0, F.concat(F.lit(" ("), F.array_join(x["names"], ", "), F.lit(")"))).otherwise("")
    )
    internal = F.array_sort(F.array_distinct(F.transform(F.filter(i, lambda x: x["is_internal"]), shown)))
    return files.select("file_id", F.nullif(external, F.lit("")).alias("external"), internal.alias("internal"))


def read_cards(files: DataFrame, symbols: DataFrame, cards: DataFrame) -> DataFrame:
    """One read view for each file: summary and description of its latest card, outline, imports, importers and targets."""
    told = ("primary_behaviors", "owns_behaviors", "delegates_to", "side_effects", "blast_radius")
    lists = [F.col(n) if n in cards.columns else F.array().cast("array<string>").alias(n) for n in told]
    c = cards.groupBy(canonical_path("file_id").alias("k")).agg(F.max_by(F.struct("summary", "role_text", *lists), F.struct("provenance.generated_at", "card_id")).alias("c"))
    joined = lambda n: F.array_join(F.col(f"c.{n}"), "; ")
    e = files.select("file_id", F.explode("imports").alias("i")).select("file_id", F.col("i.resolved_file_id").alias("t")).filter("t IS NOT NULL").distinct()
    names = lambda df, key, val, out: df.groupBy(F.col(key).alias("file_id")).agg(F.array_sort(F.collect_set(val)).alias(out))
    wd = Window.partitionBy("t").orderBy("file_id")
    # importers of a hot target are counted, and only the first 20 are listed
    importers = e.withColumn("n", F.row_number().over(wd)).filter("n <= 20")
    total = e.groupBy(F.col("t").alias("file_id")).agg(F.count(F.lit(1)).alias("total_dependents"))
    empty = F.array().cast("array<string>")
    return (
        files.select("file_id", "path", "language", "line_count")
        .join(c, canonical_path("file_id") == F.col("k"), "left")
        .join(symbol_outline(symbols), "file_id", "left")
        .join(import_groups(files), "file_id", "left")
        .join(names(importers, "t", "file_id", "dependents"), "file_id", "left")
        .join(total, "file_id", "left")
        .join(names(e, "file_id", "t", "depends_on"), "file_id", "left")
        .select(
            "file_id", "path", "language", "line_count",
            F.nullif(F.trim("c.summary"), F.lit("")).alias("summary"),
            labelled(
                Role=F.trim("c.role_text"), Behaviors=joined("primary_behaviors"), Owns=joined("owns_behaviors"), Delegates_to=joined("delegates_to"),
                Side_effects=joined("side_effects"), Blast_radius=joined("blast_radius"),
            ).alias("description"),
            F.coalesce("symbols", empty).alias("symbols"), F.coalesce("total_symbols", F.lit(0)).alias("total_symbols"), "external",
            F.coalesce("internal", empty).alias("internal"), F.coalesce("dependents", empty).alias("dependents"),
            F.coalesce("total_dependents", F.lit(0)).alias("total_dependents"), F.coalesce("depends_on", empty).alias("depends_on"),
        )
    )


def pack(views: DataFrame, mode: str) -> DataFrame:
    """Read views cut to the limits of a mode, with notes of what was left out."""
    symbols, deps, describe = PACKS[mode]
    cut = {"symbols": (symbols, "symbols"), "internal": (deps, "internal imports"), "dependents": (deps, "dependents"), "depends_on": (deps, "dependencies")}
    notes = [F.when(F.size(c) > n, F.concat(F.lit("omitted "), (F.size(c) - n).cast("string"), F.lit(f" {name}"))) for c, (n, name) in cut.items()]
    return views.select(
        "file_id", "path", "summary", (F.col("description") if describe else F.lit(None).cast("string")).alias("description"),
        *[F.slice(c, 1, n).alias(c) for c, (n, _) in cut.items()], F.filter(F.array(*notes), lambda x: x.isNotNull()).alias("omitted"),
    )


def related_rank(candidates: DataFrame, primary: str, limit: int, tests: bool = False) -> DataFrame:
    """(file_id, points, pos): the `limit` best related files of (file_id, pos), by shared member area, folder and top level.

    Five points for the same `crates/<member>`, three for the same folder, one for the same first segment; ties keep their
    order. The primary file and, unless asked for, test contexts are left out; repeats count once.
    """
    seg = lambda c, i: F.split(c, "/")[i]
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    p, f = F.lit(primary), F.col("file_id")
    area = (seg(p, 0) == "crates") & (seg(f, 0) == "crates") & seg(p, 1).eqNullSafe(seg(f, 1))
    points = F.when(area, 5).otherwise(0) + F.when(folder(p) == folder(f), 3).otherwise(0) + F.when(seg(p, 0) == seg(f, 0), 1).otherwise(0)
    rows = candidates.groupBy("file_id").agg(F.min("pos").alias("pos")).filter(f != primary)
    rows = rows if tests else rows.filter(~low_signal_test_path("file_id"))
    return rows.withColumn("points", points).orderBy(F.desc("points"), "pos").limit(limit).select("file_id", "points", "pos")


def _views(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").dropDuplicates(["file_id"])
    return read_cards(files, table(spark, d, "read_symbols").dropDuplicates(["symbol_id"]), table(spark, d, "file_cards").dropDuplicates(["card_id"]))


def read_views(spark: SparkSession, d: str) -> DataFrame:
    v = _views(spark, d)
    return v.select(
        "file_id", "summary", "description", F.array_join("symbols", "\n").alias("symbols"), "external", F.array_join("internal", "\n").alias("internal"),
        F.array_join("dependents", ",").alias("dependents"), F.col("total_dependents").cast("long").alias("total_dependents"), F.array_join("depends_on", ",").alias("depends_on"),
    )


def pack_limits(spark: SparkSession, d: str) -> DataFrame:
    v = pack(_views(spark, d), "brief")
    return v.select("file_id", F.array_join("symbols", "\n").alias("symbols"), F.array_join("dependents", ",").alias("dependents"), F.array_join("omitted", "; ").alias("omitted"))


def related_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").select("file_id").distinct()
    first = files.agg(F.min("file_id")).first()[0]
    ranked = group_ranks(files.withColumn("all", F.lit(0)), ["all"], ["file_id"]).select("file_id", (F.col("less") + 1).alias("pos"))
    return related_rank(ranked, first, 10).select("file_id", F.col("points").cast("int").alias("points"), F.col("pos").cast("int").alias("pos"))


_D = lambda t, k: f"(SELECT DISTINCT ON ({k}) * FROM {t})"
_P = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(replace(trim({c}), '\', '/'), '/+', '/', 'g'), '(/\.)+/', '/', 'g'), '^(\./)+', '')"
_V = rf"""f AS (SELECT * FROM {_D("files", "file_id")}), c AS (SELECT {_P("file_id")} AS k, arg_max({{'s': summary, 'r': role_text, 'b': primary_behaviors}}, {{'g': provenance.generated_at, 'i': card_id}}) AS c FROM {_D("file_cards", "card_id")} GROUP BY 1),
  s AS (SELECT file_id, list(lines || ' ' || kind || ' ' || qualified_name || ' :: ' || trim(regexp_replace(coalesce(signature, ''), '\s+', ' ', 'g')) ORDER BY split_part(lines, '-', 1)::INT, symbol_id) AS l FROM {_D("read_symbols", "symbol_id")} GROUP BY 1),
  e AS (SELECT DISTINCT file_id, i.resolved_file_id AS t FROM (SELECT file_id, unnest(imports) AS i FROM f) WHERE i.resolved_file_id IS NOT NULL),
  dn AS (SELECT t AS file_id, list(file_id ORDER BY file_id) AS l FROM e GROUP BY 1), dp AS (SELECT file_id, list(t ORDER BY t) AS l FROM e GROUP BY 1)"""
SQL = {
    "read_views": rf"""WITH {_V} SELECT f.file_id, nullif(trim(c.c.s), '') AS summary,
  nullif(concat_ws(chr(10), CASE WHEN trim(coalesce(c.c.r, '')) <> '' THEN 'Role: ' || c.c.r END, CASE WHEN trim(coalesce(array_to_string(c.c.b, '; '), '')) <> '' THEN 'Behaviors: ' || array_to_string(c.c.b, '; ') END), '') AS description,
  coalesce(array_to_string(s.l, chr(10)), '') AS symbols,
  nullif(coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(f.imports, lambda x: NOT x.is_internal), lambda x: x.module))), ', '), ''), '') AS external,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(f.imports, lambda x: x.is_internal), lambda x: x.module || coalesce(' -> ' || x.resolved_file_id, '')
    || CASE WHEN len(x.names) > 0 THEN ' (' || array_to_string(x.names, ', ') || ')' ELSE '' END))), chr(10)), '') AS internal,
  coalesce(array_to_string(dn.l[1:20], ','), '') AS dependents, coalesce(len(dn.l), 0) AS total_dependents, coalesce(array_to_string(dp.l, ','), '') AS depends_on
FROM f LEFT JOIN c ON {_P("f.file_id")} = c.k LEFT JOIN s USING (file_id) LEFT JOIN dn USING (file_id) LEFT JOIN dp USING (file_id)""",
    "pack_limits": rf"""WITH {_V}, v AS (SELECT f.file_id, coalesce(s.l, []) AS s, coalesce(dn.l[1:20], []) AS dn, coalesce(dp.l, []) AS dp,
    coalesce(list_distinct(list_transform(list_filter(f.imports, lambda x: x.is_internal), lambda x: x.module || coalesce(x.resolved_file_id, '') || array_to_string(x.names, ','))), []) AS i
  FROM f LEFT JOIN s USING (file_id) LEFT JOIN dn USING (file_id) LEFT JOIN dp USING (file_id))
SELECT file_id, coalesce(array_to_string(s[1:8], chr(10)), '') AS symbols, coalesce(array_to_string(dn[1:3], ','), '') AS dependents,
  concat_ws('; ', CASE WHEN len(s) > 8 THEN 'omitted ' || (len(s) - 8) || ' symbols' END, CASE WHEN len(i) > 3 THEN 'omitted ' || (len(i) - 3) || ' internal imports' END,
    CASE WHEN len(dn) > 3 THEN 'omitted ' || (len(dn) - 3) || ' dependents' END, CASE WHEN len(dp) > 3 THEN 'omitted ' || (len(dp) - 3) || ' dependencies' END) AS omitted FROM v""",
    "related_files": r"""WITH c AS (SELECT file_id, row_number() OVER (ORDER BY file_id) AS pos FROM (SELECT DISTINCT file_id FROM files ORDER BY file_id LIMIT 400)), p AS (SELECT min(file_id) AS p FROM files)
SELECT file_id, (CASE WHEN split_part(p, '/', 1) = 'crates' AND split_part(file_id, '/', 1) = 'crates' AND split_part(p, '/', 2) = split_part(file_id, '/', 2) THEN 5 ELSE 0 END
  + CASE WHEN regexp_extract(p, '^(.*)/[^/]*$', 1) = regexp_extract(file_id, '^(.*)/[^/]*$', 1) THEN 3 ELSE 0 END + CASE WHEN split_part(p, '/', 1) = split_part(file_id, '/', 1) THEN 1 ELSE 0 END)::INT AS points, pos::INT AS pos
FROM c, p WHERE file_id <> p AND NOT regexp_matches(file_id, '/fixtures/|/tests/|/__tests__/|_test\.rs$|_test\.py$|\.test\.|\.spec\.') ORDER BY points DESC, pos LIMIT 10""",
}
QUERIES = {f.__name__: f for f in (read_views, pack_limits, related_files)}
