"""Folders, import resolution, edges and neighbourhoods of a file table, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.text import parent_folder
from cairn.session import broadcast_if_small, table

# The order of the candidate files of a module path, and the edges' weights and details.
CANDIDATES = ["{}.py", "{}.ts", "{}.tsx", "{}.rs", "{}/__init__.py", "{}/mod.rs", "{}/index.ts"]
ROOT_CANDIDATES = ["__init__.py", "mod.rs"]
EDGES = {"contains": (1, "folder contains file"), "contains_folder": (1, "folder contains folder"), "imports": (3, "imports "), "depends_on": (2, "resolved internal dependency")}


def folders(files: DataFrame, key: str = "file_id", path: str = "path") -> DataFrame:
    """(folder_id, name, parent_folder_id, child_file_ids, child_folder_ids) of every folder on the way to a file.

    The root is `repo`; its parent is null. Children are sorted.
    """
    rows = files.select(F.col(key).alias("file_id"), F.split(path, "/").alias("parts")).distinct()
    depth = F.size("parts") - 1
    prefixes = F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"))
    owned = rows.select("file_id", F.when(depth > 0, F.array_join(F.slice("parts", F.lit(1), depth), "/")).otherwise("repo").alias("folder_id"))
    chain = rows.filter(depth > 0).select(F.explode(prefixes).alias("folder_id")).distinct()
    child = chain.select(F.col("folder_id").alias("child"), parent_folder("folder_id").alias("folder_id"))
    every = chain.unionByName(rows.limit(1).select(F.lit("repo").alias("folder_id"))).distinct()
    files_of = owned.groupBy("folder_id").agg(F.array_sort(F.collect_list("file_id")).alias("child_file_ids"))
    folders_of = child.groupBy("folder_id").agg(F.array_sort(F.collect_list("child")).alias("child_folder_ids"))
    empty = F.array().cast("array<string>")
    return (
        every.join(files_of, "folder_id", "left").join(folders_of, "folder_id", "left")
        .select(
            "folder_id",
            F.regexp_extract("folder_id", r"([^/]*)$", 1).alias("name"),
            F.when(F.col("folder_id") != "repo", parent_folder("folder_id")).alias("parent_folder_id"),
            F.coalesce("child_file_ids", empty).alias("child_file_ids"),
            F.coalesce("child_folder_ids", empty).alias("child_folder_ids"),
        )
    )


def _normal(module: Column) -> Column:
    """A module without its leading dots and `crate`, `self` and `super`."""
    return F.regexp_replace(module, r"^(?:\./)*(?:\.\./)*(?:crate\.)*(?:self\.)*(?:super\.)*", "")


def module_paths(module: Column, importer: Column, aliases: Column) -> Column:
    """The paths that a module may mean, in the order in which they are tried.

    Leading dots climb from the importer's folder; the dotted name follows; then, for each alias (sorted), the root and
    the alias's path if the module is the alias, or the rest if it starts with it.
    """
    dots = F.length(module) - F.length(F.regexp_replace(module, r"^\.+", ""))
    parent = F.filter(F.split(F.regexp_extract(importer, r"^(.*)/[^/]*$", 1), "/"), lambda x: x != "")
    climbed = F.slice(parent, F.lit(1), F.greatest(F.size(parent) - F.greatest(dots - 1, F.lit(0)), F.lit(0)))
    rest = F.filter(F.split(F.regexp_replace(module, r"^\.+", ""), r"\."), lambda x: x != "")
    relative = F.when(module.startswith("."), F.array(F.array_join(F.concat(climbed, rest), "/"))).otherwise(F.array().cast("array<string>"))
    normal = _normal(module)
    dotted = F.when(normal != "", F.array(F.replace(normal, F.lit("."), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    by_alias = F.flatten(
        F.transform(
            aliases,
            lambda a: F.when(normal == a, F.array(F.lit(""), F.replace(a, F.lit("."), F.lit("/"))))
            .when(normal.startswith(F.concat(a, F.lit("."))), F.array(F.replace(F.substring(normal, F.length(a) + 2, F.lit(1 << 20)), F.lit("."), F.lit("/"))))
            .otherwise(F.array().cast("array<string>")),
        )
    )
    return F.array_distinct(F.concat(relative, dotted, by_alias))


def candidates(path: Column, crate_prefixes: list[str] = ()) -> Column:
    """Candidate files of one module path in order; workspace prefixes (`name_`) add the member's own files."""
    plain = F.when(path == "", F.array(*[F.lit(c) for c in ROOT_CANDIDATES])).otherwise(
        F.array(*[F.concat(F.lit(c.split("{}")[0]), path, F.lit(c.split("{}")[1])) for c in CANDIDATES])
    )
    for p in crate_prefixes:
        first = F.split_part(path, F.lit("/"), F.lit(1))
        member = F.replace(F.substring(first, F.lit(len(p) + 1), F.length(first)), F.lit("_"), F.lit("-"))
        more = F.regexp_extract(path, r"^[^/]*/(.*)$", 1)
        files = F.array(F.concat(member, F.lit("/src/lib.rs")), F.when(more != "", F.concat(member, F.lit("/src/"), more, F.lit(".rs"))), F.when(more != "", F.concat(member, F.lit("/src/"), more, F.lit("/mod.rs"))))
        plain = F.when(first.startswith(p), F.concat(plain, F.filter(files, lambda x: x.isNotNull()))).otherwise(plain)
    return plain


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: list[str] = (), crate_prefixes: list[str] = (), packages: DataFrame | None = None) -> DataFrame:
    """(repo, importer, module, target): the first existing candidate of each distinct import, null if none exists.

    imports: (repo, importer, module); files: (repo, path). Candidates carry their order, meet the files by one equi-join
    on (repo, path), and the least order wins; hot importers or targets are only as many rows as they have imports.
    Further aliases, any number of them, are the rows of `packages` (alias): they meet the leading segments of the modules.
    """
    names = F.array(*[F.lit(a) for a in sorted(set(aliases))]).cast("array<string>")
    one = imports.filter(F.col("module").isNotNull()).distinct()
    if packages is not None:
        parts = F.split(_normal(F.col("module")), r"\.")
        leading = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
        heads = one.select("module").distinct().select("module", F.explode(leading).alias("alias"))
        known = heads.join(packages.select("alias").distinct(), "alias").groupBy("module").agg(F.collect_set("alias").alias("known"))
        one = one.join(known, "module", "left")
        names = F.when(F.col("known").isNull(), names).otherwise(F.array_sort(F.array_union(names, F.col("known"))))
    tried = F.flatten(F.transform(module_paths(F.col("module"), F.col("importer"), names), lambda p: candidates(p, list(crate_prefixes))))
    rows = one.select("repo", "importer", "module", F.posexplode(tried).alias("ord", "path"))
    hit = rows.join(files.select("repo", "path").distinct(), ["repo", "path"])
    best = hit.groupBy("repo", "importer", "module").agg(F.min_by("path", "ord").alias("target"))
    return one.select("repo", "importer", "module").join(best, ["repo", "importer", "module"], "left")


def edges(folder_rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """(source_id, target_id, kind, weight, detail) of folders and resolved imports (source_id, target_id, module)."""
    f = lambda c, k: folder_rows.select(F.col("folder_id").alias("source_id"), F.explode(c).alias("target_id"), F.lit("contains").alias("kind"), F.lit(EDGES[k][0]).alias("weight"), F.lit(EDGES[k][1]).alias("detail"))
    on = resolved.filter("target_id IS NOT NULL")
    return (
        f("child_file_ids", "contains").unionByName(f("child_folder_ids", "contains_folder"))
        .unionByName(on.select("source_id", "target_id", F.lit("imports").alias("kind"), F.lit(3).alias("weight"), F.concat(F.lit("imports "), "module").alias("detail")))
        .unionByName(on.select("source_id", "target_id", F.lit("depends_on").alias("kind"), F.lit(2).alias("weight"), F.lit(EDGES["depends_on"][1]).alias("detail")))
    )


def neighbours(edge_rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id): the entities one edge away, in either direction, from those of (id)."""
    marked = broadcast_if_small(ids.distinct())
    out = edge_rows.join(marked, F.col("source_id") == F.col("id"), "left_semi").select(F.col("target_id").alias("id"))
    back = edge_rows.join(marked, F.col("target_id") == F.col("id"), "left_semi").select(F.col("source_id").alias("id"))
    return out.unionByName(back).distinct()


def siblings(files: DataFrame, limit: int = 12) -> DataFrame:
    """(file_id, siblings): up to `limit` other files of the same folder, in order of file_id.

    A file's siblings are the first `limit` of its folder, or the first `limit + 1` without itself; so a folder of any
    size sends that many rows on, by a rank limit that works before the shuffle.
    """
    rows = files.select("parent_folder_id", "file_id").distinct()
    w = Window.partitionBy("parent_folder_id").orderBy("file_id")
    first = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit + 1)
    heads = first.groupBy("parent_folder_id").agg(F.array_sort(F.collect_list("file_id")).alias("head"))
    return rows.join(heads, "parent_folder_id").select("file_id", F.slice(F.array_remove("head", F.col("file_id")), 1, limit).alias("siblings"))


def dependency_collapse(edge_rows: DataFrame, cap: int = 20) -> DataFrame:
    """(entity_id, direction, peer, relationships, details, why): edges but `contains`, one row for each peer."""
    e = edge_rows.filter("kind <> 'contains'")
    both = e.select(F.col("source_id").alias("entity_id"), F.lit("depends_on").alias("direction"), F.col("target_id").alias("peer"), "kind", "detail").unionByName(
        e.select(F.col("target_id").alias("entity_id"), F.lit("dependent").alias("direction"), F.col("source_id").alias("peer"), "kind", "detail")
    )
    w = Window.partitionBy("entity_id", "direction").orderBy("peer")
    grouped = both.groupBy("entity_id", "direction", "peer").agg(
        F.array_sort(F.collect_set("kind")).alias("relationships"), F.array_sort(F.collect_set("detail")).alias("details")
    )
    return grouped.withColumn("why", F.col("details")[0]).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap).drop("n")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").dropDuplicates(["file_id"])


def _imports(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("repo", "file_id", "path", F.explode("imports").alias("i")).select("repo", "file_id", "path", "i.*")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(
        folders(_files(spark, d), "file_id", "file_id"),
        _imports(spark, d).select(F.col("file_id").alias("source_id"), F.col("resolved_file_id").alias("target_id"), "module").distinct(),
    )


def folder_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    f = folders(_files(spark, d), "file_id", "file_id")
    return f.select("folder_id", "name", "parent_folder_id", F.array_join("child_file_ids", ",").alias("files"), F.array_join("child_folder_ids", ",").alias("folders"))


def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Resolve every import of the files by the candidate rules."""
    imports = _imports(spark, d).select("repo", F.col("path").alias("importer"), "module")
    return resolve_imports(imports, _files(spark, d).select("repo", "path"), ["crate"])


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("kind", "weight").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("source_id").alias("sources"), F.countDistinct("target_id").alias("targets"))


def edge_adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).filter("kind <> 'contains'")
    both = e.select(F.col("source_id").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("target_id").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("entity_id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def one_hop_neighbours(spark: SparkSession, d: str) -> DataFrame:
    deleted = _files(spark, d).filter("deleted_at IS NOT NULL").select(F.col("file_id").alias("id"))
    return neighbours(_edges(spark, d).filter("kind = 'imports'"), deleted)


def siblings_capped(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).withColumn("parent_folder_id", F.concat_ws("/", "repo", "parent_folder_id"))
    return siblings(files).select("file_id", F.array_join("siblings", ",").alias("siblings"))


def dependency_collapse_query(spark: SparkSession, d: str) -> DataFrame:
    c = dependency_collapse(_edges(spark, d))
    return c.select("entity_id", "direction", "peer", F.array_join("relationships", ",").alias("relationships"), F.array_join("details", "; ").alias("details"), "why")


def cross_folder_imports(spark: SparkSession, d: str) -> DataFrame:
    """Imports that leave their folder, by folder pair."""
    i = _imports(spark, d).filter("resolved_file_id IS NOT NULL").select(parent_folder("file_id").alias("from_folder"), parent_folder("resolved_file_id").alias("to_folder"), "file_id", "module").distinct()
    return i.filter("from_folder <> to_folder").groupBy("from_folder", "to_folder").agg(F.count(F.lit(1)).alias("imports"))


_F = "f AS (SELECT DISTINCT ON (file_id) * FROM files)"
_PARENT = "coalesce(nullif(regexp_extract({0}, '^(.*)/[^/]*$', 1), ''), 'repo')"
_CHAIN = f"""{_F}, p AS (SELECT file_id, string_split(file_id, '/') AS a FROM f),
  ch AS (SELECT DISTINCT array_to_string(a[1:i], '/') AS folder_id FROM (SELECT a, unnest(range(1, len(a))) AS i FROM p))"""
_EDGES = f"""{_CHAIN}, imp AS (SELECT DISTINCT file_id AS s, i.resolved_file_id AS t, i.module AS m FROM (SELECT file_id, unnest(imports) AS i FROM f) WHERE i.resolved_file_id IS NOT NULL),
  e AS (SELECT {_PARENT.format("file_id")} AS s, file_id AS t, 'contains' AS kind, 1 AS weight, 'folder contains file' AS detail FROM f
    UNION ALL SELECT {_PARENT.format("folder_id")}, folder_id, 'contains', 1, 'folder contains folder' FROM ch
    UNION ALL SELECT s, t, 'imports', 3, 'imports ' || m FROM imp UNION ALL SELECT s, t, 'depends_on', 2, 'resolved internal dependency' FROM imp)"""
SQL = {
    "folder_hierarchy": f"""WITH {_CHAIN}, fo AS (SELECT folder_id FROM ch UNION SELECT 'repo'),
  cf AS (SELECT {_PARENT.format("file_id")} AS folder_id, string_agg(file_id, ',' ORDER BY file_id) AS files FROM f GROUP BY 1),
  cd AS (SELECT {_PARENT.format("folder_id")} AS p, string_agg(folder_id, ',' ORDER BY folder_id) AS folders FROM ch GROUP BY 1)
SELECT fo.folder_id, regexp_extract(fo.folder_id, '([^/]*)$', 1) AS name, CASE WHEN fo.folder_id <> 'repo' THEN {_PARENT.format("fo.folder_id")} END AS parent_folder_id,
  coalesce(files, '') AS files, coalesce(folders, '') AS folders FROM fo LEFT JOIN cf USING (folder_id) LEFT JOIN cd ON cd.p = fo.folder_id""",
    "import_resolution": f"""WITH {_F}, i AS (SELECT DISTINCT repo, path AS importer, i.module AS module FROM (SELECT repo, path, unnest(imports) AS i FROM f) WHERE i.module IS NOT NULL),
  n AS (SELECT *, regexp_replace(module, '^(\\./)*(\\.\\./)*(crate\\.)*(self\\.)*(super\\.)*', '') AS m FROM i),
  v AS (SELECT repo, importer, module, 0 AS o, replace(m, '.', '/') AS p FROM n WHERE m <> ''),
  c AS (SELECT repo, importer, module, o * 10 + k AS ord, CASE k WHEN 0 THEN p || '.py' WHEN 1 THEN p || '.ts' WHEN 2 THEN p || '.tsx' WHEN 3 THEN p || '.rs' WHEN 4 THEN p || '/__init__.py'
        WHEN 5 THEN p || '/mod.rs' ELSE p || '/index.ts' END AS path FROM v, range(7) t(k)),
  b AS (SELECT c.repo, importer, module, arg_min(c.path, ord) AS target FROM c JOIN (SELECT DISTINCT repo, path FROM f) g ON g.repo = c.repo AND g.path = c.path GROUP BY ALL)
SELECT i.repo, i.importer, i.module, b.target FROM i LEFT JOIN b USING (repo, importer, module)""",
    "import_edges": f"WITH {_EDGES} SELECT kind, weight, count(*) AS edges, count(DISTINCT s) AS sources, count(DISTINCT t) AS targets FROM e GROUP BY 1, 2",
    "edge_adjacency": f"""WITH {_EDGES} SELECT id AS entity_id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT s AS id, 1 AS o, 0 AS i FROM e WHERE kind <> 'contains'
  UNION ALL SELECT t, 0, 1 FROM e WHERE kind <> 'contains') GROUP BY 1""",
    "one_hop_neighbours": f"""WITH {_EDGES}, x AS (SELECT file_id FROM f WHERE deleted_at IS NOT NULL)
SELECT t AS id FROM e WHERE kind = 'imports' AND s IN (SELECT file_id FROM x) UNION SELECT s FROM e WHERE kind = 'imports' AND t IN (SELECT file_id FROM x)""",
    "siblings_capped": f"""WITH {_F}, g AS (SELECT parent_folder_id AS p, list(file_id ORDER BY file_id) AS l FROM f GROUP BY 1)
SELECT file_id, coalesce(array_to_string(list_filter(l, lambda x: x <> file_id)[1:12], ','), '') AS siblings FROM f JOIN g ON g.p IS NOT DISTINCT FROM f.parent_folder_id""",
    "dependency_collapse": f"""WITH {_EDGES}, b AS (SELECT s AS entity_id, 'depends_on' AS direction, t AS peer, kind, detail FROM e WHERE kind <> 'contains'
  UNION ALL SELECT t, 'dependent', s, kind, detail FROM e WHERE kind <> 'contains')
SELECT entity_id, direction, peer, string_agg(DISTINCT kind, ',' ORDER BY kind) AS relationships, string_agg(DISTINCT detail, '; ' ORDER BY detail) AS details, min(detail) AS why
FROM b GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY entity_id, direction ORDER BY peer) <= 20""",
    "cross_folder_imports": f"""WITH {_F}, i AS (SELECT DISTINCT {_PARENT.format("file_id")} AS from_folder, {_PARENT.format("i.resolved_file_id")} AS to_folder, file_id, i.module AS m
  FROM (SELECT file_id, unnest(imports) AS i FROM f) WHERE i.resolved_file_id IS NOT NULL)
SELECT from_folder, to_folder, count(*) AS imports FROM i WHERE from_folder <> to_folder GROUP BY 1, 2""",
}
QUERIES = {
    "folder_hierarchy": folder_hierarchy,
    "import_resolution": import_resolution,
    "import_edges": import_edges,
    "edge_adjacency": edge_adjacency,
    "one_hop_neighbours": one_hop_neighbours,
    "siblings_capped": siblings_capped,
    "dependency_collapse": dependency_collapse_query,
    "cross_folder_imports": cross_folder_imports,
}
