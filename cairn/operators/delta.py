"""Differences between two snapshots, pruning and merging of tables, invalidation marks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.ids import canonical_hash, canonical_path
from cairn.functions.text import parent_folder
from cairn.operators.graph import neighbours
from cairn.session import broadcast_if_small, table
from cairn.store import upsert

#: From so many changed files on, the repository card is stale.
STALE_FILES = 4


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed keys between two tables with unique keys; null values equal each other."""
    o = old.select(F.col(key).alias("k"), F.col(value).alias("a"), F.lit(True).alias("o"))
    n = new.select(F.col(key).alias("k"), F.col(value).alias("b"), F.lit(True).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return o.join(n, "k", "full_outer").select(F.col("k").alias(key), change.alias("change")).filter("change IS NOT NULL")


def import_targets(files: DataFrame) -> DataFrame:
    """(source_id, target_id): distinct resolved imports of a file table."""
    i = files.select(F.col("file_id").alias("source_id"), F.explode("imports").alias("i"))
    return i.select("source_id", F.col("i.resolved_file_id").alias("target_id")).filter("target_id IS NOT NULL").distinct()


@dataclass
class SnapshotDelta:
    """Id tables of a delta; `repo_card_stale` is one boolean row."""

    changes: DataFrame
    affected_files: DataFrame
    affected_folders: DataFrame
    folder_changes: DataFrame
    repo_card_stale: DataFrame

    def is_noop(self) -> bool:
        return self.changes.isEmpty() and self.affected_folders.isEmpty() and self.folder_changes.isEmpty()


def snapshot_delta(old: DataFrame, new: DataFrame) -> SnapshotDelta:
    """What two file tables (file_id, path, parent_folder_id, source_hash, imports) differ in, and what that touches.

    Affected are changed and added files, their neighbours by one import in either snapshot, and targets that an import
    gained or lost; affected folders are the immediate ones. The repository card is stale if a file or folder was removed, a
    folder was added, four or more files changed, or a changed file's targets did.
    """
    changes = diff(old, new, "file_id", "source_hash")
    touched = changes.select(F.col("file_id").alias("id"))
    fresh = changes.filter("change <> 'removed'").select(F.col("file_id").alias("id"))
    a, b = import_targets(old), import_targets(new)
    near = neighbours(a.unionByName(b).distinct(), touched)
    marked = broadcast_if_small(fresh)
    own = lambda e: e.join(marked, F.col("source_id") == F.col("id"), "left_semi")
    moved = own(a).exceptAll(own(b)).unionByName(own(b).exceptAll(own(a)))
    affected = fresh.unionByName(near).unionByName(moved.select(F.col("target_id").alias("id"))).distinct()
    every = old.select("file_id", "parent_folder_id").unionByName(new.select("file_id", "parent_folder_id")).distinct()
    known = affected.unionByName(touched).distinct()
    folders = every.join(known, F.col("file_id") == F.col("id"), "left_semi").select(F.col("parent_folder_id").alias("folder_id"))
    folder_rows = lambda f: f.select(F.col("parent_folder_id").alias("folder_id")).distinct().withColumn("one", F.lit(1))
    folder_changes = diff(folder_rows(old), folder_rows(new), "folder_id", "one")
    stale = (
        changes.agg(
            F.coalesce(F.max((F.col("change") == "removed").cast("int")), F.lit(0)).alias("removed"),
            F.sum((F.col("change") != "removed").cast("int")).alias("fresh"),
        )
        .crossJoin(folder_changes.agg(F.count(F.lit(1)).alias("folders")))
        .crossJoin(moved.agg(F.count(F.lit(1)).alias("moved")))
        .select(((F.col("removed") > 0) | (F.coalesce("fresh", F.lit(0)) >= STALE_FILES) | (F.col("folders") > 0) | (F.col("moved") > 0)).alias("stale"))
    )
    added = folder_changes.filter("change = 'added'").select("folder_id")
    return SnapshotDelta(changes, affected, folders.unionByName(added).distinct(), folder_changes, stale)


def invalidations(delta: SnapshotDelta) -> DataFrame:
    """(entity_id, entity_kind, reason): the marks of a delta for the audit queue."""
    files = delta.changes.select(F.col("file_id").alias("entity_id"), F.lit("file").alias("entity_kind"), F.concat(F.lit("file "), "change").alias("reason"))
    near = delta.affected_files.join(delta.changes, F.col("id") == F.col("file_id"), "left_anti")
    return (
        files.unionByName(near.select(F.col("id").alias("entity_id"), F.lit("file").alias("entity_kind"), F.lit("neighbour changed").alias("reason")))
        .unionByName(delta.affected_folders.select(F.col("folder_id").alias("entity_id"), F.lit("folder").alias("entity_kind"), F.lit("child changed").alias("reason")))
        .unionByName(delta.repo_card_stale.filter("stale").select(F.lit("repo").alias("entity_id"), F.lit("repo").alias("entity_kind"), F.lit("structure changed").alias("reason")))
    )


def delete_by_key(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """`df` without the rows whose `key` is in the first column of `ids`."""
    k = ids.select(F.col(ids.columns[0]).alias("__k")).distinct()
    return df.join(broadcast_if_small(k), F.col(key) == F.col("__k"), "left_anti")


def delete_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """`edges` without those that start or end at one of `ids`."""
    return delete_by_key(delete_by_key(edges, ids, "source_id"), ids, "target_id")


def cascade_paths(records: DataFrame, late: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records without those of `paths`, and late vectors without those of the records that go."""
    k = paths.select(F.col(paths.columns[0]).alias("__k")).distinct()
    gone = records.join(k, F.col("path") == F.col("__k"), "left_semi").select("record_id")
    return delete_by_key(records, k, "path"), delete_by_key(late, gone, "record_id")


#: Owner tables, by what stands in a record's id behind `semantic:`: (table, its key, the record's reference to it).
OWNERS = {
    "file": ("files", "file_id", "entity_id"),
    "file_card": ("file_cards", "file_id", "entity_id"),
    "folder_card": ("folder_cards", "folder_id", "entity_id"),
    "repo_card": ("repo_cards", "repo_root", "entity_id"),
    "symbol": ("symbols", "symbol_id", "entity_id"),
    "snippet": ("files", "path", "path"),
}
PRUNED = ("file_cards", "folder_cards", "semantic_records", "fts_records", "late_vectors", "code_chunks")


def prune(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without orphans, and one row that counts what went from each of `PRUNED`.

    File cards and chunks need their file, folder cards their folder, records their owner by the prefix of their id (see
    `OWNERS`; owners are looked up in what stays), full-text rows (`fts_records`, by `id`) and late vectors a record that
    stays. Records of other prefixes stay. A null key refers to nothing, so its row stays. A table that is not given has
    no orphans, and a table of owners that is not given owns nothing unless its records are to stay: then leave out both.
    Keys are compared in canonical spelling.
    """
    out, counts = dict(tables), []
    key_of = lambda c, name: F.col(c) if name in ("record_id", "id") else canonical_path(c)

    def keep(name: str, column: str, owners: DataFrame) -> None:
        if name not in tables:
            return
        k = owners.filter(F.col("k").isNotNull()).distinct()
        mine = key_of(column, column)
        out[name] = tables[name].filter(F.col(column).isNull()).unionByName(tables[name].join(k, mine == F.col("k"), "left_semi"))
        # a row that no owner matches goes: counted apart, so that no table is counted twice
        counts.append(tables[name].filter(F.col(column).isNotNull()).join(k, mine == F.col("k"), "left_anti").select(F.lit(name).alias("name")))

    keys = lambda name, column: out[name].select(key_of(column, column).alias("k"))
    keep("file_cards", "file_id", keys("files", "file_id"))
    keep("code_chunks", "file_id", keys("files", "file_id"))
    if "folders" in tables:
        keep("folder_cards", "folder_id", keys("folders", "folder_id"))
    if "semantic_records" in tables:
        known = {p: o for p, o in OWNERS.items() if o[0] in tables}
        owners = reduce(DataFrame.unionByName, [keys(t, c).select(F.concat(F.lit(p + "|"), "k").alias("k")) for p, (t, c, _) in known.items()])
        prefix = F.regexp_extract("record_id", r"^semantic:([a-z_]+):", 1)
        reference = F.create_map(*[x for p, (_, _, r) in known.items() for x in (F.lit(p), canonical_path(r))])[prefix]
        full = tables["semantic_records"]
        tables = tables | {"semantic_records": full.withColumn("__owner", F.concat(prefix, F.lit("|"), reference))}
        key_of = lambda c, name: F.col(c) if name in ("record_id", "id", "__owner") else canonical_path(c)
        keep("semantic_records", "__owner", owners)
        out["semantic_records"] = out["semantic_records"].drop("__owner")
        ids = out["semantic_records"].select(F.col("record_id").alias("k"))
        keep("fts_records", "id", ids)
        keep("late_vectors", "record_id", ids)
    gone = reduce(DataFrame.unionByName, counts) if counts else None
    one = [F.count(F.when(F.col("name") == n, 1)).alias(n) for n in PRUNED]
    return out, gone.agg(*one)


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").dropDuplicates(["file_id"])


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the files: before and after the deletions, with the later files' hashes changed on one day."""
    f = _files(spark, d)
    old = f.filter("day(indexed_at) % 7 <> 3")
    new = f.filter("deleted_at IS NULL").withColumn("source_hash", F.when(F.expr("day(indexed_at) % 5 = 1"), F.concat("source_hash", F.lit("x"))).otherwise(F.col("source_hash")))
    return old, new


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff(*_two(spark, d), "file_id", "source_hash")


def snapshot_affected(spark: SparkSession, d: str) -> DataFrame:
    delta = snapshot_delta(*_two(spark, d))
    return delta.affected_files.select(F.col("id").alias("file_id"))


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    delta = o.filter("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 2).alias("o_orderkey"), "o_custkey", F.lit("U").alias("o_orderstatus"), (F.col("price") + 1).alias("price"))
    merged = upsert(o, delta, ["o_orderkey"])
    return merged.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("price"), 2).alias("price"))


def prune_counts(spark: SparkSession, d: str) -> DataFrame:
    """What goes from the tables, with folders and full-text rows derived: folders of live files only, and full-text rows
    of every second day's records under ids that may be gone."""
    names = ("files", "file_cards", "semantic_records", "late_vectors", "code_chunks")
    tables = {n: table(spark, d, n) for n in names} | {"symbols": table(spark, d, "read_symbols")}
    files = tables["files"]
    tables["folders"] = files.filter("deleted_at IS NULL").select(F.col("parent_folder_id").alias("folder_id")).distinct()
    tables["folder_cards"] = files.select(F.col("parent_folder_id").alias("folder_id")).distinct()
    tables["fts_records"] = tables["late_vectors"].select(F.col("record_id").alias("id")).distinct()
    snippets = files.select(F.concat(F.lit("semantic:snippet:"), "file_id").alias("record_id"), "file_id", F.when(F.col("deleted_at").isNull(), F.col("path")).otherwise(F.concat("path", F.lit(".gone"))).alias("path")).distinct()
    cards = tables["folder_cards"].select(F.concat(F.lit("semantic:folder_card:"), "folder_id").alias("record_id"), F.col("folder_id").alias("entity_id"))
    records = tables["semantic_records"].select("record_id", "entity_id", "path")
    tables["semantic_records"] = records.unionByName(snippets.drop("file_id"), allowMissingColumns=True).unionByName(cards, allowMissingColumns=True)
    return prune(tables)[1]


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = _files(spark, d).filter("deleted_at IS NOT NULL").select("path")
    records, late = cascade_paths(table(spark, d, "semantic_records").dropDuplicates(["record_id"]), table(spark, d, "late_vectors").distinct(), gone)
    one = lambda df, n: df.select(F.lit(n).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("rows_left"))
    return one(records, "semantic_records").unionByName(one(late, "late_vectors"))


def active_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards whose file exists and still has the hash that the card was made from."""
    c = table(spark, d, "file_cards").dropDuplicates(["card_id"])
    f = _files(spark, d).filter("deleted_at IS NULL").select(canonical_path("file_id").alias("k"), canonical_hash("source_hash").alias("h"))
    j = c.join(f, canonical_path("file_id") == F.col("k"))
    return j.select("card_id", (canonical_hash("provenance.source_hash").eqNullSafe(F.col("h"))).alias("fresh"))


_F = "f AS (SELECT DISTINCT ON (file_id) * FROM files)"
_P = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(replace(trim({c}), '\', '/'), '/+', '/', 'g'), '(/\.)+/', '/', 'g'), '^(\./)+', '')"
_HASH = "trim(regexp_replace(lower(trim({0})), '^[a-z0-9_.-]+:', ''))"
_TWO = f"""{_F}, o AS (SELECT * FROM f WHERE day(indexed_at AT TIME ZONE 'UTC') % 7 <> 3), n AS (SELECT * REPLACE (CASE WHEN day(indexed_at AT TIME ZONE 'UTC') % 5 = 1 THEN source_hash || 'x' ELSE source_hash END AS source_hash) FROM f WHERE deleted_at IS NULL),
  ch AS (SELECT coalesce(o.file_id, n.file_id) AS file_id, CASE WHEN o.file_id IS NULL THEN 'added' WHEN n.file_id IS NULL THEN 'removed' WHEN o.source_hash IS DISTINCT FROM n.source_hash THEN 'changed' END AS change
         FROM o FULL JOIN n ON o.file_id = n.file_id)"""
_T = "SELECT DISTINCT file_id AS s, i.resolved_file_id AS t FROM (SELECT file_id, unnest(imports) AS i FROM {0}) WHERE i.resolved_file_id IS NOT NULL"
SQL = {
    "snapshot_diff": f"WITH {_TWO} SELECT * FROM ch WHERE change IS NOT NULL",
    "snapshot_affected": f"""WITH {_TWO}, c AS (SELECT * FROM ch WHERE change IS NOT NULL), a AS ({_T.format("o")}), b AS ({_T.format("n")}), e AS (SELECT * FROM a UNION SELECT * FROM b),
  x AS (SELECT file_id FROM c WHERE change <> 'removed'),
  m AS ((SELECT * FROM a WHERE s IN (FROM x) EXCEPT SELECT * FROM b) UNION (SELECT * FROM b WHERE s IN (FROM x) EXCEPT SELECT * FROM a))
SELECT file_id FROM x UNION SELECT t FROM e WHERE s IN (SELECT file_id FROM c) UNION SELECT s FROM e WHERE t IN (SELECT file_id FROM c) UNION SELECT t FROM m""",
    "upsert_merge": """WITH d AS (SELECT o_orderkey * 2 AS o_orderkey, 'U' AS o_orderstatus, o_totalprice + 1 AS price FROM orders WHERE o_orderkey % 3 = 0),
  m AS (SELECT o_orderstatus, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d) UNION ALL SELECT o_orderstatus, price FROM d)
SELECT o_orderstatus, count(*) AS orders, round(sum(price), 2) AS price FROM m GROUP BY 1""",
    "prune_counts": f"""WITH fi AS (SELECT {_P("file_id")} AS k FROM files), fp AS (SELECT {_P("path")} AS k FROM files),
  fo AS (SELECT DISTINCT {_P("parent_folder_id")} AS k FROM files WHERE deleted_at IS NULL AND parent_folder_id IS NOT NULL), fc AS (SELECT DISTINCT parent_folder_id AS folder_id FROM files),
  c AS (SELECT {_P("file_id")} AS k FROM file_cards), ck AS (SELECT k FROM c WHERE k IN (FROM fi)), fck AS (SELECT {_P("folder_id")} AS k FROM fc WHERE {_P("folder_id")} IN (FROM fo)),
  r AS (SELECT record_id, {_P("entity_id")} AS e, NULL AS p FROM semantic_records
    UNION ALL SELECT DISTINCT 'semantic:snippet:' || file_id, NULL, {_P("CASE WHEN deleted_at IS NULL THEN path ELSE path || '.gone' END")} FROM files
    UNION ALL SELECT 'semantic:folder_card:' || folder_id, {_P("folder_id")}, NULL FROM fc),
  g AS (SELECT *, (record_id LIKE 'semantic:file:%' AND e NOT IN (FROM fi)) OR (record_id LIKE 'semantic:file\\_card:%' ESCAPE '\\' AND e NOT IN (FROM ck))
      OR (record_id LIKE 'semantic:folder\\_card:%' ESCAPE '\\' AND e NOT IN (FROM fck)) OR (record_id LIKE 'semantic:symbol:%' AND e NOT IN (SELECT {_P("symbol_id")} FROM read_symbols))
      OR (record_id LIKE 'semantic:snippet:%' AND p NOT IN (FROM fp)) AS gone FROM r),
  kept AS (SELECT record_id FROM g WHERE gone IS NOT TRUE AND record_id IS NOT NULL)
SELECT (SELECT count(*) FROM c WHERE k NOT IN (FROM fi)) AS file_cards, (SELECT count(*) FROM fc WHERE {_P("folder_id")} NOT IN (FROM fo)) AS folder_cards,
  (SELECT count(*) FROM g WHERE gone) AS semantic_records, (SELECT count(DISTINCT record_id) FROM late_vectors WHERE record_id NOT IN (FROM kept)) AS fts_records,
  (SELECT count(*) FROM late_vectors WHERE record_id NOT IN (FROM kept)) AS late_vectors, (SELECT count(*) FROM code_chunks WHERE {_P("file_id")} NOT IN (FROM fi)) AS code_chunks""",
    "cascade_delete": f"""WITH {_F}, g AS (SELECT path FROM f WHERE deleted_at IS NOT NULL), r AS (SELECT DISTINCT ON (record_id) * FROM semantic_records), l AS (SELECT DISTINCT * FROM late_vectors)
SELECT 'semantic_records' AS table_name, count(*) AS rows_left FROM r WHERE path NOT IN (SELECT path FROM g)
UNION ALL SELECT 'late_vectors', count(*) FROM l WHERE record_id NOT IN (SELECT record_id FROM r WHERE path IN (SELECT path FROM g))""",
    "active_cards": f"""WITH {_F}, c AS (SELECT DISTINCT ON (card_id) * FROM file_cards)
SELECT card_id, {_HASH.format("c.provenance.source_hash")} IS NOT DISTINCT FROM {_HASH.format("f.source_hash")} AS fresh FROM c JOIN f ON {_P("c.file_id")} = {_P("f.file_id")} WHERE f.deleted_at IS NULL""",
}
QUERIES = {f.__name__: f for f in (snapshot_diff, snapshot_affected, upsert_merge, prune_counts, cascade_delete, active_cards)}
