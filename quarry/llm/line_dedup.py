"""Substring dedup by hashing lines and, inside them, sentences.

A line end always ends a unit, so a line has the same digest whatever stands before it. Units are normalised (lower
case, blanks collapsed, ends trimmed) and digests are grouped over the whole corpus; the earliest ranked occurrence (smallest
doc_id, then position) stays, and every later copy of a whole line goes, with its line break, however short it is.

A repeated passage may stand inside a longer line, where a line digest cannot see it. So lines are also cut after sentence ends (a
piece shorter than ``min_unit`` code points is one unit with what follows it in its line), and later copies of sentences go where
a maximal run of removable units, lines among them, holds at least ``min_run`` code points of normalised text; a chance repeat of one
short sentence inside a line of its own wording stays. With ``min_unit=1, min_run=1`` every repeated sentence goes.

Only digests and positions are shuffled for the grouping, with map-side combine, and the few digests with a large share
of all units are dealt to many tasks, so one very common line is no task of its own; texts are put together again in one
linear pass, some at a time by bytes.

Defined results: null text counts as empty; blank units are never removed and end a run; a row without an id keeps its text and ranks
nowhere; an empty table gives no rows; repeated rows with the same id are ranked as one document, ties within it by position; a very
long text is cut and rebuilt whole by one task, in memory that grows with it; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, slices, staged

#: Least code points of a sentence unit, and least normalised code points of a run that takes sentences with it.
MIN_UNIT, MIN_RUN = 20, 100
LINE = r"[^\n]*\n|[^\n]+"


def unit_pattern(min_unit: int) -> str:
    """A unit of a line: at least so many characters up to a sentence or line end, or what is left of it."""
    return rf"(?s).{{{min_unit},}}?(?:[.!?] |\n|\z)|.+"


def normalised_unit(unit: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(unit), r"[ \t\n\x0B\f\r]+", " "))


def units(docs: DataFrame, min_unit: int = MIN_UNIT) -> DataFrame:
    """doc_id, line, piece, whole, part, body: each line (piece 0, ``whole``) and each sentence of a line with several (from 1, ``part``).

    The only sentence of a line is the line itself, both whole and part.
    """
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(LINE), F.lit(0))).alias("line", "body"))
    cut = lines.select("doc_id", (F.col("line") + 1).alias("line"), "body", F.regexp_extract_all("body", F.lit(unit_pattern(min_unit)), F.lit(0)).alias("pieces"))
    one = F.size("pieces") == 1
    unit = lambda piece, whole, part, body: F.struct(piece.cast("int").alias("piece"), whole.alias("whole"), part.alias("part"), body.alias("body"))
    inner = F.when(one, F.slice("pieces", 1, 0)).otherwise(F.col("pieces"))
    every = F.concat(F.array(unit(F.lit(0), F.lit(True), one, F.col("body"))), F.transform(inner, lambda p, i: unit(i + 1, F.lit(False), F.lit(True), p)))
    return cut.select("doc_id", "line", F.explode(every).alias("u")).select("doc_id", "line", "u.*")


def repeated_units(docs: DataFrame, min_unit: int = MIN_UNIT) -> DataFrame:
    """doc_id, line, piece, normalised size of every copy after the first, and of what: ``whole`` lines or a ``part`` of one."""
    digests = staged(
        units(docs.filter("doc_id is not null"), min_unit)
        .withColumn("body", normalised_unit(F.col("body")))
        .filter(F.length("body") > 0)
        .select("doc_id", "line", "piece", "whole", "part", F.length("body").alias("size"), F.substring(F.unhex(F.sha2("body", 256)), 1, 16).alias("digest")),
        "unit-digests",
    )
    place = F.struct("doc_id", "line", "piece")
    firsts = digests.groupBy("digest").agg(
        F.min(F.when(F.col("whole"), place)).alias("first_whole"), F.min(F.when(F.col("part"), place)).alias("first_part"),
        F.count_if("whole").alias("wholes"), F.count_if("part").alias("parts"), F.count(F.lit(1)).alias("n"),
    )
    firsts = staged(firsts.filter("wholes > 1 or parts > 1").drop("wholes", "parts"), "repeated-units")
    copies = hot_join(digests, firsts, "digest", "n", digests.count(), place)
    later = copies.select("doc_id", "line", "piece", "size", (F.col("whole") & (place != F.col("first_whole"))).alias("whole"), (F.col("part") & (place != F.col("first_part"))).alias("part"))
    return later.filter("whole or part").distinct()


def _rebuild(min_unit: int, min_run: int):
    line_of, piece_of = re.compile(LINE), re.compile(unit_pattern(min_unit).replace(r"\z", r"\Z"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(text: str, later: list[dict]) -> tuple[int, int, list[tuple[int, int]]]:
        """Numbers of units and of removed ones, and the runs that go."""
        marked = {(u["line"], u["piece"]): u for u in later}
        found: list[tuple[int, int, int, int, bool]] = []  # start, stop, units, size if removable, whole line
        total = 0
        for n, line in enumerate(line_of.finditer(text), 1):
            pieces = [m.span() for m in piece_of.finditer(line[0])]
            total += len(pieces)
            if not marked:
                continue
            whole = marked.get((n, 0))
            if whole is not None and whole["whole"]:
                found.append((*line.span(), len(pieces), whole["size"], True))
                continue
            for k, (a, b) in enumerate(pieces, 1):
                part = marked.get((n, 0 if len(pieces) == 1 else k))
                found.append((line.start() + a, line.start() + b, 1, part["size"] if part is not None and part["part"] else 0, False))
        removed, spans = 0, []
        for _, group in groupby(found, key=lambda u: u[3] > 0):
            run = list(group)
            enough = sum(u[3] for u in run) >= min_run
            for start, stop, count, size, whole in run:
                if size and (whole or enough):
                    removed += count
                    spans[-1:] = [(spans[-1][0], stop)] if spans and spans[-1][1] == start else [*spans[-1:], (start, stop)]
        return total, removed, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            total, removed, spans, kept = [], [], [], []
            for text, later in zip(part.column("text").to_pylist(), part.column("later").to_pylist(), strict=True):
                n, gone, runs = cut(text, later or [])
                edges = [0, *(x for r in runs for x in r), len(text)]
                total.append(n)
                removed.append(gone)
                spans.append([{"start": a, "stop": b} for a, b in runs])
                kept.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
                names=["doc_id", "n_units", "n_removed", "removed", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, min_unit: int = MIN_UNIT, min_run: int = MIN_RUN) -> DataFrame:
    """One row per document: doc_id, n_units, n_removed, removed (maximal runs of start, stop in the original), kept_text."""
    later = repeated_units(docs, min_unit).groupBy("doc_id").agg(F.collect_list(F.struct("line", "piece", "size", "whole", "part")).alias("later"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(later, "doc_id", "left")
    return rows.mapInArrow(_rebuild(min_unit, min_run), "doc_id long, n_units long, n_removed long, removed array<struct<start:long,stop:long>>, kept_text string")
