"""Reading a repository tree, and the rules for which paths take part."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T

# What a scan reads and skips by default.
EXTENSIONS = ["py", "ts", "tsx", "rs"]
DEFAULT_IGNORES = [".git", ".venv", "venv", "node_modules", "dist", "build", "__pycache__", ".pytest_cache", "target"]


def _rules(ignores: list[str]) -> tuple[list[str], list[str]]:
    cleaned = [i.strip().removeprefix("./").rstrip("/") for i in ignores if i.strip().strip("/")]
    return [i for i in cleaned if "/" in i], [i for i in cleaned if "/" not in i]


def ignored_path(path: Column | str, ignores: list[str] = ()) -> Column:
    """Whether a path is skipped: a default folder name or one of `ignores` - with `/` a subtree, without any component."""
    path = F.col(path) if isinstance(path, str) else path
    trees, names = _rules(list(ignores))
    out = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in [*DEFAULT_IGNORES, *names]]))
    for t in trees:
        out = out | (path == t) | path.startswith(t + "/")
    return out


def is_ignored(path: str, ignores: list[str] = ()) -> bool:
    """The same rule on the driver."""
    trees, names = _rules(list(ignores))
    parts = path.split("/")
    return any(p in DEFAULT_IGNORES or p in names for p in parts) or any(path == t or path.startswith(t + "/") for t in trees)


def list_paths(root: str, extensions: list[str] = EXTENSIONS, ignores: list[str] = ()) -> list[str]:
    """Relative paths below a local root in order; ignored folders are not entered. A missing root is an error."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    out = []
    for folder, dirs, files in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        at = "" if rel == "." else rel + "/"
        dirs[:] = [d for d in dirs if not is_ignored(at + d, ignores)]
        out += [at + f for f in files if f.rsplit(".", 1)[-1] in extensions and "." in f and not is_ignored(at + f, ignores)]
    return sorted(out)


def read_repository(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS, ignores: list[str] = ()) -> DataFrame:
    """(path, text, source_hash, corrupt) of the files below `root`, any Hadoop file system.

    Only matching names are read (a glob at the scan); ignored folders are dropped by path. Texts that are not UTF-8 come
    out with `corrupt` true and a null text instead of failing the scan.
    """
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    )
    base = root.rstrip("/").split(":", 1)[-1].replace("//", "/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    rows = raw.select(path.alias("path"), "content").filter(~ignored_path("path", list(ignores)))
    return rows.select(
        "path",
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
    ).select("path", "text", F.sha2("text", 256).alias("source_hash"), F.col("text").isNull().alias("corrupt"))


def file_facts(sources: DataFrame) -> DataFrame:
    """One row for each file of (path, text, source_hash): id, name, language, folder, hash and line count."""
    ends = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    lines = F.when(F.col("text") == "", 0).otherwise(ends + F.when(F.col("text").endswith("\n"), 0).otherwise(1))
    return sources.filter("text IS NOT NULL").select(
        F.col("path").alias("file_id"),
        "path",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        T.language_of("path").alias("language"),
        T.parent_folder("path").alias("parent_folder_id"),
        "source_hash",
        lines.cast("int").alias("line_count"),
    )
