"""Token-bounded chunks with exact line ranges.

Filling chunks greedily depends on what came before, so it is a small vectorised helper per file (prefix sums and
binary search) inside ``mapInArrow``: narrow, no shuffle, any partitioning. A worker holds the chunks of about a megabyte of text at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, is_blank, split_lines
from ..options import BOM, SPACE_CHARS, ChunkOptions
from .postings import slices

_PIECES = re.compile(rf"[A-Za-z0-9_]+|[^{SPACE_CHARS}A-Za-z0-9_]")
_HEADING = re.compile(rf"(#{{1,6}})[{SPACE_CHARS}]+([^\n\r\u2028\u2029]*)\Z")
_FENCE = re.compile(rf"[{SPACE_CHARS}]*(```|~~~)")
_TRIM = re.compile(rf"^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+\Z")
_SOLID = re.compile(rf"[^{SPACE_CHARS}]")
#: Of every code point: 1 in words, 0 space, 2 a sign of its own.
_KIND = np.full(0x110000, 2, np.uint8)
_KIND[[c for c in range(0x10000) if not _SOLID.match(chr(c))]] = 0
_KIND[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]] = 1
SCHEMA = "repository_id string, relative_path string, ordinal int, start_line int, end_line int, text string, estimated_tokens int, heading_path array<string>"
ARROW = [(n, pa.list_(pa.string()) if n == "heading_path" else pa.int32() if n in ("ordinal", "start_line", "end_line", "estimated_tokens") else pa.string()) for n in (c.split()[0] for c in SCHEMA.split(", "))]
#: Text of the files that a worker chunks at a time.
SLICE_BYTES = 1 << 20


def tokens_of(text: str) -> int:
    if not text:
        return 0
    astral = sum(c > "\uffff" for c in text) if not text.isascii() else 0
    return max(1, int(((len(text) + astral) / 4 + len(_PIECES.findall(text)) + astral) / 2 + 0.5))


def lines_of(text: str) -> list[str]:
    text = text.removeprefix(BOM)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    return lines[:-1] if len(lines) > 1 and not lines[-1] else lines


def blank(text: str) -> bool:
    return not _SOLID.search(text)


def _estimate(units, pieces):
    """What :func:`tokens_of` says of a text of so many UTF-16 units and pieces (an astral sign is two), in whole numbers."""
    return np.where(units == 0, 0, np.maximum(1, (units + 4 * pieces + 4) // 8))


class Sizes:
    """Token counts of lines and of runs of them, as prefix sums: a piece never spans a line end, so no text is cut into pieces twice."""

    def __init__(self, lines: list[str]):
        """Lines of any number of files, without their ends."""
        codes = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le"), np.uint32)
        kind = _KIND[codes]
        word = kind == 1
        pieces = (kind == 2).view(np.int8) + word.view(np.int8)
        pieces[1:] -= (word[1:] & word[:-1]).view(np.int8)
        ends = np.flatnonzero(codes == 10) + 1
        starts = np.r_[0, ends[:-1]]
        units = ends - starts - 1
        pieces = np.add.reduceat(pieces, starts, dtype=np.int64)
        if codes.max() > 0xFFFF:
            astral = np.add.reduceat(codes > 0xFFFF, starts, dtype=np.int64)
            units, pieces = units + astral, pieces + astral
        self.units, self.pieces, self.costs = (np.r_[0, np.cumsum(c)].tolist() for c in (units, pieces, _estimate(units, pieces) + 1))

    def tokens(self, start: int, end: int) -> int:
        """Of lines ``start`` to ``end`` (exclusive), joined by line feeds."""
        units = self.units[end] - self.units[start] + end - start - 1
        return max(1, (units + 4 * (self.pieces[end] - self.pieces[start]) + 4) // 8) if units > 0 else 0


def line_chunks(lines: list[str], options: ChunkOptions, sizes: Sizes | None = None, at: int = 0) -> list[tuple[int, int, str, int]]:
    """(start, end, text, tokens), 1-based inclusive; the text of a merged tail is the exact slice of its range.

    ``sizes`` may be of more lines, of which these begin at ``at``.
    """
    if all(map(blank, lines)):
        return []
    sizes = sizes or Sizes(lines)
    out, start, n, costs = [], 0, len(lines), sizes.costs
    while True:
        end = max(start + 1, bisect_right(costs, costs[at + start] + options.max_tokens, at + start, at + n + 1) - 1 - at)
        out.append((start + 1, end, "\n".join(lines[start:end]), sizes.tokens(at + start, at + end)))
        if end >= n:
            break
        start = max(start + 1, end - options.overlap_lines)
    if len(out) > 1:
        before, last = out[-2], out[-1]
        both = before[3] + last[3]
        if last[3] < options.min_tokens / 4 and both <= 1.5 * options.max_tokens:
            out[-2:] = [(before[0], last[1], "\n".join(lines[before[0] - 1 : last[1]]), both)]
    return out


def markdown_chunks(lines: list[str], options: ChunkOptions, sizes: Sizes | None = None, at: int = 0, whole: bool = True) -> list[tuple[int, int, str, int, list[str]]]:
    """Sections by heading with their heading trail; an oversized section is cut by lines. Without ``whole``, only pieces of oversized ones."""
    sizes = sizes or Sizes(lines)
    marks, trail, fenced = [(0, [])], [], False
    for i, line in enumerate(lines):
        fenced ^= bool(_FENCE.match(line))
        if not fenced and (m := _HEADING.match(line)):
            depth = len(m[1])
            trail = (trail + [""] * depth)[: depth - 1] + [_TRIM.sub("", m[2])]
            marks.append((i, trail))
    out = []
    for (start, path), stop in zip(marks, [*[i for i, _ in marks[1:]], len(lines)], strict=True):
        body = lines[start:stop]
        if all(map(blank, body)):
            continue
        size = sizes.tokens(at + start, at + stop)
        if size > options.max_tokens:
            if body[0].startswith(BOM):  # a section is cut as a text of its own
                out += [(start + a, start + b, t, k, path) for a, b, t, k in line_chunks(lines_of("\n".join(body)), options)]
            else:
                body = body[:-1] if len(body) > 1 and not body[-1] else body
                out += [(start + a, start + b, t, k, path) for a, b, t, k in line_chunks(body, options, sizes, at + start)]
        elif whole:
            out.append((start + 1, stop, "\n".join(body), size, path))
    return out


def _chunker(options: ChunkOptions, schema: pa.Schema, whole: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE_BYTES):
            rows, at = [], 0
            texts = [lines_of(text or "") for text in part.column("text").to_pylist()]
            sizes = Sizes([line for lines in texts for line in lines])
            for lines, repo, path, language, *content_hash in zip(texts, *(part.column(c).to_pylist() for c in part.schema.names if c != "text"), strict=True):
                if language == "markdown":
                    chunks = markdown_chunks(lines, options, sizes, at, whole)
                else:
                    chunks = [(*c, None) for c in line_chunks(lines, options, sizes, at)]
                at += len(lines)
                rows += [(repo, path, k, *c, *content_hash) for k, c in enumerate(chunks)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def chunk_files(files: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """Chunks of (repository_id, relative_path, language, text): Markdown by heading, all else by lines.

    A file's content_hash, where there is one, comes along, so that chunk ids need no join.
    """
    hashed = "content_hash" in files.columns
    columns = ["repository_id", "relative_path", "language", "text", *["content_hash"] * hashed]
    return files.select(*columns).mapInArrow(_chunker(options, pa.schema(ARROW + [("content_hash", pa.string())] * hashed)), SCHEMA + ", content_hash string" * hashed)


def oversized_pieces(files: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """The pieces of oversized sections of Markdown files (repository_id, relative_path, text), as :func:`chunk_files` cuts them, in the same pass and without the other sections."""
    rows = files.select("repository_id", "relative_path", F.lit("markdown").alias("language"), "text")
    return rows.mapInArrow(_chunker(options, pa.schema(ARROW), whole=False), SCHEMA).drop("ordinal")


def file_token_totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repository_id", "relative_path").agg(F.sum("estimated_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_chunks"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """Sections with heading path in window SQL (the declarative twin of the helper): one sort per file."""
    lines = files.select("repository_id", "relative_path", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    up_to = Window.partitionBy("repository_id", "relative_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(f"^[{SPACE_CHARS}]*(```|~~~)")
    marked = lines.withColumn("fenced", F.sum(fence.cast("int")).over(up_to) % 2 == 1)
    pattern = f"^(#{{1,6}})[{SPACE_CHARS}]+(.*)$"
    marked = marked.withColumn("depth", F.when(~F.col("fenced"), F.length(F.regexp_extract("line", pattern, 1))).otherwise(0))
    marked = marked.withColumn("title", F.when(F.col("depth") > 0, F.trim(F.regexp_extract("line", pattern, 2)))).withColumn("section", F.sum((F.col("depth") > 0).cast("int")).over(up_to))
    for k in range(1, 7):
        marked = marked.withColumn(f"at{k}", F.max(F.when(F.col("depth") == k, F.col("pos"))).over(up_to)).withColumn(f"t{k}", F.last(F.when(F.col("depth") == k, F.col("title")), ignorenulls=True).over(up_to))
    newer = lambda k: F.greatest(*[F.coalesce(F.col(f"at{j}"), F.lit(-1)) for j in range(1, k)], F.lit(-1)) if k > 1 else F.lit(-1)
    level = F.coalesce(F.max(F.when(F.col("depth") > 0, F.struct("pos", "depth"))).over(up_to)["depth"], F.lit(0))
    path = F.array(*[F.when(F.coalesce(F.col(f"at{k}"), F.lit(-1)) > newer(k), F.col(f"t{k}")).otherwise("") for k in range(1, 7)])
    marked = marked.withColumn("path", F.slice(path, 1, level))
    return (
        marked.groupBy("repository_id", "relative_path", "section")
        .agg(
            (F.min("pos") + 1).alias("start_line"),
            (F.max("pos") + 1).alias("end_line"),
            F.max(F.when(~is_blank(F.col("line")), 1).otherwise(0)).alias("solid"),
            F.max_by("path", F.col("pos")).alias("heading_path"),
        )
        .filter("solid = 1")
        .drop("solid", "section")
    )


def with_ids(chunks: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Adds content-derived chunk ids, from the chunks' own content_hash or from ``hashes`` (repository_id, relative_path, content_hash)."""
    known = chunks if hashes is None else chunks.join(hashes, ["repository_id", "relative_path"])
    return known.withColumn("chunk_id", chunk_id(F.col("relative_path"), F.col("content_hash"), F.col("start_line"), F.col("end_line")))
