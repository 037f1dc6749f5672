"""References to records that do not exist, by a left anti-join of distinct foreign keys against parent keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.ids import canonical_path
from cairn.session import table


DAY_MICROS = 86_400_000_000


def utc_day(at) -> Column:
    """The UTC day of a timestamp, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(at) / DAY_MICROS).cast("int"))


def parent_lifetimes(df: DataFrame, key, since, until=None) -> DataFrame:
    """(key, since, until): one row for each non-null key. A key lives from its earliest `since`; it is dead from
    `until` on if all its rows have one (the latest counts), else for ever."""
    until = F.lit(None).cast("timestamp") if until is None else until
    return (
        df.select(key.alias("key"), since.alias("since"), until.alias("until"))
        .filter(F.col("key").isNotNull() & F.col("since").isNotNull())
        .groupBy("key")
        .agg(
            F.min("since").alias("since"),
            F.when(F.count("until") == F.count(F.lit(1)), F.max("until")).alias("until"),
        )
    )


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of `refs` (fk, day, ...) whose parent was missing when their day ended.

    refs: `fk` (null: no reference), `day` (date of the pointing row; null: cannot be judged, not reported) and
    whatever columns; parents: as from `parent_lifetimes`. A parent is missing at the end of a day - the next midnight,
    exclusive - if there is no such key, it began at that midnight or later, or it ended before it. The anti-join runs
    over the distinct (fk, day) pairs, so a key that a third of all rows share is one row of it.
    """
    keys = refs.filter(F.col("fk").isNotNull() & F.col("day").isNotNull()).select("fk", "day").distinct()
    midnight = (F.unix_date(F.col("k.day")) + 1).cast("long") * DAY_MICROS
    alive = (
        (F.col("k.fk") == F.col("p.key"))
        & (F.unix_micros("p.since") < midnight)
        & (F.col("p.until").isNull() | (F.unix_micros("p.until") >= midnight))
    )
    orphans = keys.alias("k").join(parents.alias("p"), alive, "left_anti")
    return refs.join(orphans, ["fk", "day"], "left_semi")


def _refs(df: DataFrame, name: str, row_key, fk, at) -> DataFrame:
    return df.select(
        F.lit(name).alias("table_name"), row_key.cast("string").alias("row_key"), fk.alias("fk"), utc_day(at).alias("day")
    )


def orphan_rows(
    file_cards: DataFrame, code_chunks: DataFrame, semantic_records: DataFrame, late_vectors: DataFrame, files: DataFrame, read_symbols: DataFrame
) -> DataFrame:
    """(table_name, row_key, day) of every orphan; exact duplicates of a row count once.

    Parents of one kind share one anti-join: a reference carries its kind in front of its key. Path spellings are made
    one on both sides. Rows with a null reference, an unknown record_id prefix or no time are not orphans. Orphans
    still count as existing targets.
    """
    col = F.col
    file_key = lambda c: F.concat(F.lit("file|"), canonical_path(c))
    parents = (
        parent_lifetimes(files, file_key("file_id"), col("indexed_at"), col("deleted_at"))
        .unionByName(parent_lifetimes(file_cards, F.concat(F.lit("file_card|"), canonical_path("file_id")), col("provenance.generated_at")))
        .unionByName(parent_lifetimes(read_symbols, F.concat(F.lit("symbol|"), canonical_path("symbol_id")), col("written_at")))
        .unionByName(parent_lifetimes(semantic_records, F.concat(F.lit("record|"), col("record_id")), col("written_at")))
    )
    kind = F.regexp_extract("record_id", r"^semantic:(file_card|file|symbol):", 1)
    entity = F.when(kind != "", F.concat(kind, F.lit("|"), canonical_path("entity_id")))
    refs = (
        _refs(file_cards, "file_cards", col("card_id"), file_key("file_id"), col("provenance.generated_at"))
        .unionByName(_refs(code_chunks, "code_chunks", col("chunk_id"), file_key("file_id"), col("written_at")))
        .unionByName(_refs(semantic_records, "semantic_records", col("record_id"), entity, col("written_at")))
        .unionByName(
            _refs(
                late_vectors,
                "late_vectors",
                F.concat_ws("#", F.coalesce("record_id", F.lit("")), F.coalesce(col("ordinal").cast("string"), F.lit(""))),
                F.concat(F.lit("record|"), col("record_id")),
                col("written_at"),
            )
        )
    )
    return orphan_references(refs, parents).select("table_name", "row_key", "day").distinct()


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    names = ("file_cards", "code_chunks", "semantic_records", "late_vectors", "files", "read_symbols")
    return orphan_rows(*[table(spark, d, n) for n in names])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_key) of every orphan."""
    return _orphans(spark, sf_dir).select("table_name", "row_key").distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, day, orphans): how many orphans each table has on each day."""
    return _orphans(spark, sf_dir).groupBy("table_name", "day").agg(F.count(F.lit(1)).alias("orphans"))


def _path_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(replace(trim({c}), '\', '/'), '/+', '/', 'g'), '(/\.)+/', '/', 'g'), '^(\./)+', '')"


def _orphan_sql() -> str:
    p, mid = _path_sql, "date_trunc('day', {} AT TIME ZONE 'UTC') + INTERVAL 1 DAY"
    live = lambda key, t, at, until="NULL::TIMESTAMP": (
        f"SELECT {key} AS key, min({at} AT TIME ZONE 'UTC') AS since, CASE WHEN count({until}) = count(*) THEN max({until}) END AS until "
        f"FROM {t} WHERE {key} IS NOT NULL GROUP BY 1"
    )
    ref = lambda t, key, fk, at: f"SELECT DISTINCT '{t}' AS table_name, {key} AS row_key, {fk} AS fk, {mid.format(at)} AS midnight FROM {t}"
    kind = "regexp_extract(record_id, '^semantic:(file_card|file|symbol):', 1)"
    return f"""WITH parents AS (
  {live("'file|' || " + p("file_id"), "files", "indexed_at", "(deleted_at AT TIME ZONE 'UTC')")}
  UNION ALL {live("'file_card|' || " + p("file_id"), "file_cards", "provenance.generated_at")}
  UNION ALL {live("'symbol|' || " + p("symbol_id"), "read_symbols", "written_at")}
  UNION ALL {live("'record|' || record_id", "semantic_records", "written_at")}),
refs AS (
  {ref("file_cards", "card_id::VARCHAR", "'file|' || " + p("file_id"), "provenance.generated_at")}
  UNION ALL {ref("code_chunks", "chunk_id", "'file|' || " + p("file_id"), "written_at")}
  UNION ALL {ref("semantic_records", "record_id", f"CASE WHEN {kind} <> '' THEN {kind} || '|' || {p('entity_id')} END", "written_at")}
  UNION ALL {ref("late_vectors", "record_id || '#' || ordinal", "'record|' || record_id", "written_at")}),
orphans AS (
  SELECT DISTINCT table_name, row_key, (midnight - INTERVAL 1 DAY)::DATE AS day FROM refs
  WHERE fk IS NOT NULL AND midnight IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM parents WHERE key = fk AND since < midnight AND (until IS NULL OR until >= midnight)))
"""


SQL = {
    "p6_found": _orphan_sql() + "SELECT DISTINCT table_name, row_key FROM orphans",
    "p6_report": _orphan_sql() + "SELECT table_name, day, count(*) AS orphans FROM orphans GROUP BY 1, 2",
}
QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
