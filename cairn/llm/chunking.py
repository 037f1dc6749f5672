"""Splitting long code chunks: rolling-hash landmarks snapped to natural boundaries."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.ids import canonical_path
from cairn.llm.hashing import all_windows, mix, prefix_hash
from cairn.session import broadcast_if_small, checkpoint, table

MAX_LINES, MIN_LINES, OVERLAP, HASH_LINES = 60, 24, 5, 3

_TOKEN = re.compile(
    r"""\"{3}|'{3}|/\*|\*/|//[^\n]*|\#[^\n]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[()\[\]]""", re.X
)


def split_lines(text: str) -> list[str]:
    """Lines end with LF or CRLF; a final line end opens no new line; the empty text has none."""
    if not text:
        return []
    parts = text.split("\n")
    if not parts[-1]:
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def statement_borders(lines: list[str]) -> np.ndarray:
    """For each line: 2 if a cut before it stands at a blank line, 1 if between statements, 0 if inside one.

    A line is inside a statement if brackets, a block comment or a triple-quoted text are open before it, or if it
    starts with a closing bracket or a continuation.
    """
    out = np.zeros(len(lines), np.int64)
    depth, closer = 0, None
    for i, line in enumerate(lines):
        bare = line.strip()
        free = depth == 0 and closer is None
        if free and i and (not bare or not lines[i - 1].strip()):
            out[i] = 2
        elif free and not bare.startswith((")", "]", "}", ".", "else", "elif", "except", "finally", "catch")):
            out[i] = 1
        for m in _TOKEN.finditer(line):
            t = m.group()
            if closer:
                closer = None if t == closer else closer
            elif t in ('"""', "'''"):
                closer = t
            elif t == "/*":
                closer = "*/"
            elif t in "([":
                depth += 1
            elif t in ")]":
                depth = max(0, depth - 1)
    return out


def cut_lines(lines: list[str], most: int = MAX_LINES, least: int = MIN_LINES, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces [start, end) of at most `most` lines that cover `lines`; each shares `overlap` lines with the one before.

    Between `least` and `most` lines after a piece's start, the position with the greatest rolling hash (of the
    `HASH_LINES` lines before it) is the landmark; the cut is the natural boundary nearest to it in that range - blank
    lines before statement borders at equal distance, then the later one - and the landmark itself where there is none.
    Landmarks depend on the text around them only, so an edit changes the pieces near it.
    """
    n = len(lines)
    if n <= most:
        return [(0, n)]
    hashes = mix(np.array([zlib.crc32(x.rstrip().encode("utf-8", "surrogatepass")) for x in lines], np.uint64))
    rolled = np.zeros(n + 1, np.uint64)
    rolled[HASH_LINES:] = all_windows(prefix_hash(hashes), HASH_LINES)
    borders = statement_borders(lines)
    pieces, start = [], 0
    while n - start > most:
        at = np.arange(start + least, start + most + 1)
        landmark = int(at[np.argmax(rolled[at])])
        natural = at[borders[at] > 0]
        if len(natural):
            rank = np.lexsort((-natural, -borders[natural], np.abs(natural - landmark)))
            cut = int(natural[rank[0]])
        else:
            cut = landmark
        pieces.append((start, cut))
        start = cut - overlap
    return [*pieces, (start, n)]


_PIECES = "chunk_id string, piece int, first_line int, last_line int, n_lines int, text string"


def _pieces(batches):
    for batch in batches:
        out = {k: [] for k in ("chunk_id", "piece", "first_line", "last_line", "n_lines", "text")}
        for cid, code, lo, hi, doc in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if code is not None:
                lines = split_lines(code)
            else:
                lines = split_lines(doc or "")
                lines += [""] * (hi - lo + 1 - len(lines))
            for k, (a, b) in enumerate(cut_lines(lines)):
                for name, v in zip(out, (cid, k, a + 1, b, b - a, "\n".join(lines[a:b]))):
                    out[name].append(v)
        yield pa.RecordBatch.from_pydict(
            out, schema=pa.schema([("chunk_id", pa.string()), ("piece", pa.int32()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("n_lines", pa.int32()), ("text", pa.string())])
        )


def line_count(code):
    """Lines of a text column; see `split_lines`."""
    ends = F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit("")))
    return ends + F.when((code == "") | code.endswith("\n"), 0).otherwise(1)


def split_chunks(chunks: DataFrame, documents: DataFrame, most: int = MAX_LINES) -> DataFrame:
    """(chunk_id, piece, first_line, last_line, n_lines, text) of every chunk of more than `most` lines.

    Lines are those of `code`; where it is null, lines start_line..end_line of the file's source document. If that
    document is missing or too short, the lines it lacks count as blank ones. Chunks without code and without a valid
    line range, and chunks without an id, have no lines. Repeated rows count once; of rows that differ under one id,
    the one with the latest written_at counts. Line numbers are 1-based inside the chunk.
    """
    span = F.col("end_line") - F.col("start_line") + 1
    lines = F.when(F.col("code").isNotNull(), line_count(F.col("code"))).when(F.col("start_line") > 0, span)
    written = F.coalesce(F.col("written_at"), F.lit("0001-01-01").cast("timestamp"))
    newest = F.max_by(F.struct("code", "start_line", "end_line", "key"), F.struct(written, F.coalesce("code", F.lit("")), "start_line", "end_line"))
    long = (
        chunks.filter(F.col("chunk_id").isNotNull() & (lines > most))
        .withColumn("key", canonical_path("file_id"))
        .groupBy("chunk_id")
        .agg(newest.alias("c"))
        .select("chunk_id", "c.*")
    )
    texts = documents.filter((F.col("kind") == "source_file") & F.col("file_id").isNotNull()).select(
        canonical_path("file_id").alias("key"), F.col("text").alias("doc")
    )
    bare = checkpoint(long.filter("code IS NULL"))
    wanted = broadcast_if_small(bare.select("key").filter("key IS NOT NULL").distinct())
    docs = texts.join(wanted, "key", "left_semi").groupBy("key").agg(F.max("doc").alias("doc"))
    # only the chunk's lines of its document go to Python, not the document once for each of its chunks
    part = F.array_join(F.slice(F.split("doc", "\n"), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))), "\n")
    rows = (
        long.filter("code IS NOT NULL").withColumn("doc", F.lit(None).cast("string"))
        .unionByName(bare.join(docs, "key", "left").withColumn("doc", part))
        .select("chunk_id", "code", "start_line", "end_line", "doc")
    )
    return rows.mapInArrow(_pieces, _PIECES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id): the chunks that had to be split."""
    pieces = split_chunks(table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "documents"))
    return pieces.filter("piece = 1").select("chunk_id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chunks(table(spark, sf_dir, "code_chunks"), table(spark, sf_dir, "documents"))


SQL = {
    "p4_found": """SELECT DISTINCT chunk_id FROM code_chunks WHERE CASE WHEN code IS NOT NULL
  THEN length(code) - length(replace(code, chr(10), '')) + CASE WHEN code = '' OR ends_with(code, chr(10)) THEN 0 ELSE 1 END
  ELSE end_line - start_line + 1 END > 60"""
}
QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
