"""Tokenisers, identifier splitting, list sanitising and small text helpers, for the driver and as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that results depend on.
SEARCH_STOPWORDS = "the and for with from into that this what where when which does file code handled about there their".split()
LATE_STOPWORDS = (
    "the and for with from into that this file code pub use impl self let mut fn struct enum class def return none some true false"
).split()
GENERIC_DOCS = ["todo", "fixme", "placeholder", "stub", "handles event", "helper", "main"]
MIN_DOC_BYTES = 12
GENERIC_BEHAVIOURS = [
    "provide behavior used by downstream dependents",
    "coordinate internal dependencies used by this file",
    "coordinate internal dependencies used by this folder",
]
GENERIC_BEHAVIOUR_STARTS = ["no side effects were proven statically", "acts as a general module"]

#: A full-text token: letters, digits and `_ . / -`.
FTS_PATTERN = r"[\p{L}\p{N}_./-]+"
WORD_PATTERN = r"[\p{L}\p{N}_]+"


def search_tokens(query: str) -> list[str]:
    """Lower-case words of more than two bytes without stop words, in order, repeats kept."""
    words = re.split(r"[^\w]+", query.lower())
    return [w for w in words if len(w.encode()) > 2 and w not in SEARCH_STOPWORDS]


def planner_tokens(query: str) -> list[str]:
    """Words of letters, digits, `_` and `:` in their own case, of more than two bytes."""
    return [w for w in re.split(r"[^\w:]+", query) if len(w.encode()) > 2]


def fts_terms(query: str) -> list[str]:
    """Sorted distinct full-text terms of at least two bytes, in lower case."""
    words = re.split(r"[^\w./-]+", query.lower())
    return sorted({w for w in words if len(w.encode()) >= 2})


def fts_tokens(*cols: Column | str) -> Column:
    """All full-text tokens of the columns together, in lower case; nulls count as empty."""
    text = F.concat_ws(" ", *cols)
    return F.regexp_extract_all(F.lower(text), F.lit(FTS_PATTERN), F.lit(0))


def search_tokens_col(c: Column | str) -> Column:
    """`search_tokens` as a column."""
    words = F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), F.lit(0))
    return F.filter(words, lambda w: (F.octet_length(w) > 2) & ~w.isin(*SEARCH_STOPWORDS))


def _camel_parts(c: Column) -> Column:
    # a capital after a small letter or an ASCII digit starts a new term
    marked = F.regexp_replace(c, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", "\u0001")
    return F.split(marked, "[\u0001_]")


def identifier_terms(c: Column | str) -> Column:
    """Sorted distinct terms of an identifier: the whole in lower case, its `_` parts and their camel-case parts.

    Underscores around it are ignored; terms shorter than two characters are dropped; null gives null.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(c, "^_+|_+$", "")
    parts = F.transform(_camel_parts(bare), lambda p: F.lower(F.trim(p)))
    terms = F.filter(F.array_union(F.array(F.lower(bare)), parts), lambda t: F.length(t) >= 2)
    return F.when(F.length(bare) >= 2, F.array_sort(F.array_distinct(terms))).when(c.isNotNull(), F.array().cast("array<string>"))


def doc_is_useful(c: Column | str) -> Column:
    """At least twelve bytes after trimming and no generic word; null is not useful."""
    trimmed = F.trim(c)
    return F.coalesce((F.octet_length(trimmed) >= MIN_DOC_BYTES) & ~F.lower(trimmed).isin(*GENERIC_DOCS), F.lit(False))


def _first_of_equal(items: Column, key) -> Column:
    """Items whose key no earlier item has."""
    pairs = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    kept = F.filter(pairs, lambda p: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == p["i"] + 1)
    return F.transform(kept, lambda p: p["x"])


def clean_strings(c: Column | str, limit: int) -> Column:
    """Trimmed non-empty strings, the first of those equal without case, at most `limit`."""
    items = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.slice(_first_of_equal(items, F.lower), 1, limit)


def sanitize_tags(c: Column | str, limit: int) -> Column:
    """Tags in lower case, other characters than `a-z0-9:_-` as dashes, runs of dashes as one, none at the ends; distinct."""
    clean = lambda x: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9:_-]", "-"), "-+", "-"), "^-+|-+$", ""
    )
    return F.slice(F.array_distinct(F.filter(F.transform(c, clean), lambda x: x.isNotNull() & (x != ""))), 1, limit)


def is_generic_behaviour(x: Column) -> Column:
    low = F.lower(x)
    return reduce(lambda a, b: a | b, [low.startswith(s) for s in GENERIC_BEHAVIOUR_STARTS], low.isin(*GENERIC_BEHAVIOURS))


def clean_behaviours(c: Column | str, limit: int = 8) -> Column:
    """Trimmed non-empty behaviours that are not stock phrases, at most `limit`."""
    items = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "") & ~is_generic_behaviour(x))
    return F.slice(items, 1, limit)


def content_field(c: Column | str, key: str) -> Column:
    """The rest of the first line that starts with `key: `, trimmed; null if there is none or it is empty."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.trim(F.regexp_extract(c, rf"(?m)^{re.escape(key)}: (.*)$", 1))
    return F.nullif(found, F.lit(""))


def truncate(c: Column | str, limit: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(F.col(c) if isinstance(c, str) else c)


def clean_summary(c: Column | str) -> Column:
    """Lines without bullets and blanks, empty ones dropped, joined by a space."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-*•\s]+", "")))
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def one_line(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def metadata_text(c: Column | str) -> Column:
    """A map as text: keys in alphabetical order, each followed by its value (JSON arrays as their items)."""
    c = F.col(c) if isinstance(c, str) else c
    value = lambda v: F.coalesce(F.array_join(F.from_json(v, "array<string>"), " "), v)
    entries = F.array_sort(F.map_entries(c))
    return F.array_join(F.flatten(F.transform(entries, lambda e: F.array(e["key"], F.coalesce(value(e["value"]), F.lit(""))))), " ")


def metadata_list(c: Column | str, key: str) -> Column:
    """A list-valued metadata entry as text with its items joined by spaces; plain strings as they are; null if absent."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.try_element_at(c, F.lit(key))
    return F.coalesce(F.array_join(F.from_json(v, "array<string>"), " "), v)


def extension(c: Column | str) -> Column:
    return F.regexp_extract(c, r"\.([^./]+)$", 1)


def language_of(c: Column | str) -> Column:
    """The language of a path: py, ts, tsx and rs by name, any other extension as it is."""
    e = extension(c)
    return F.when(e == "py", "python").when(e.isin("ts", "tsx"), "typescript").when(e == "rs", "rust").otherwise(e)


def parent_folder(c: Column | str) -> Column:
    """The folder of a path; `repo` for paths without one."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("repo"))


def looks_like_test_path(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"^tests/|/tests/|/__tests__/|_test\.rs$|_test\.py$|\.test\.|\.spec\.")


def low_signal_test_path(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"/fixtures/|/tests/|/__tests__/|_test\.rs$|_test\.py$|\.test\.|\.spec\.")
