from __future__ import annotations

import random

import pytest

from quarry.operators import chunking
from quarry.options import ChunkOptions

SMALL = ChunkOptions(40, 20, 2)


def brute(lines, options):
    """The greedy loop, line by line."""
    if all(chunking.blank(x) for x in lines):
        return []
    out, start = [], 0
    while start < len(lines):
        end, used = start, 0
        while end < len(lines):
            cost = chunking.tokens_of(lines[end]) + 1
            if used > 0 and used + cost > options.max_tokens:
                break
            used += cost
            end += 1
        end = max(end, start + 1)
        out.append((start + 1, end))
        if end >= len(lines):
            break
        start = max(start + 1, end - options.overlap_lines)
    return out


@pytest.mark.parametrize("n", [1, 5, 50, 200])
def test_greedy_invariants(n):
    lines = [f"const value{i} = compute({i}, {i * 7});" for i in range(n)]
    chunks = chunking.line_chunks(lines, SMALL)
    assert chunks[0][0] == 1 and chunks[-1][1] == n
    for start, end, text, _ in chunks:
        assert text == "\n".join(lines[start - 1 : end])
    for before, after in zip(chunks, chunks[1:], strict=False):
        assert before[0] < after[0] <= before[1] + 1
    spans = brute(lines, SMALL)
    assert [c[:2] for c in chunks[:-1]] == spans[: len(chunks) - 1]


def test_random_lines_match_the_loop():
    draw = random.Random(5)
    options = ChunkOptions(30, 0, 3)
    for _ in range(200):
        lines = ["w " * draw.randint(0, 25) for _ in range(draw.randint(1, 40))]
        assert [c[:2] for c in chunking.line_chunks(lines, options)] == brute(lines, options)


def test_long_line_and_empty():
    assert [c[:2] for c in chunking.line_chunks(["x " * 2500], SMALL)] == [(1, 1)]
    assert chunking.line_chunks([""], SMALL) == [] and chunking.line_chunks([" ", " "], SMALL) == []


def test_markdown(spark):
    text = "intro\n# One\na\n## Two\nb\n```\n# not a heading\n```\n# Three\nc\n### Four\nd"
    rows = spark.createDataFrame([("r", "a.md", "markdown", text), ("r", "e.md", "markdown", ""), ("r", "n.md", "markdown", None)], "repository_id string, relative_path string, language string, text string")
    chunks = chunking.chunk_files(rows).orderBy("ordinal").collect()
    assert [(c.start_line, c.end_line, c.heading_path) for c in chunks] == [(1, 1, []), (2, 3, ["One"]), (4, 8, ["One", "Two"]), (9, 10, ["Three"]), (11, 12, ["Three", "", "Four"])]
    twin = chunking.markdown_sections(rows).filter("relative_path = 'a.md'").orderBy("start_line").collect()
    assert [(c.start_line, c.end_line, c.heading_path) for c in twin] == [(c.start_line, c.end_line, c.heading_path) for c in chunks]


def test_partition_invariance(spark):
    rows = spark.createDataFrame([("r", f"f{i}", "text", "\n".join(f"line {j} of {i}" for j in range(i))) for i in range(40)], "repository_id string, relative_path string, language string, text string")
    one = sorted(map(tuple, chunking.chunk_files(rows.coalesce(1), SMALL).drop("heading_path").collect()))
    seven = sorted(map(tuple, chunking.chunk_files(rows.repartition(7), SMALL).drop("heading_path").collect()))
    assert one == seven
    crlf = rows.selectExpr("repository_id", "relative_path", "language", r"replace(text, '\n', '\r\n') AS text")
    assert sorted(map(tuple, chunking.chunk_files(crlf, SMALL).drop("heading_path").collect())) == one


def test_a_worker_holds_the_chunks_of_few_texts():
    """Texts of a batch are chunked slice by slice, so memory does not grow with the rows of a batch."""
    import pyarrow as pa

    from quarry.operators import chunking as C
    from quarry.options import ChunkOptions

    text = "\n".join(f"line {i} of words" for i in range(4000))
    batch = pa.RecordBatch.from_pydict({"repository_id": ["r"] * 40, "relative_path": [str(i) for i in range(40)], "language": ["text"] * 38 + ["markdown", "text"], "text": [text] * 38 + ["# a\nb", None]})
    out = list(C._chunker(ChunkOptions(), pa.schema(C.ARROW))(iter([batch])))
    assert len(out) > 2 and max(b.nbytes for b in out) < 1 << 22
    rows = pa.Table.from_batches(out).to_pylist()
    want = [(str(i), k, *c) for i in range(38) for k, c in enumerate(C.line_chunks(C.lines_of(text), ChunkOptions()))] + [("38", 0, 1, 2, "# a\nb", C.tokens_of("# a\nb"))]
    assert [(r["relative_path"], r["ordinal"], r["start_line"], r["end_line"], r["text"], r["estimated_tokens"]) for r in rows] == want and rows[-1]["heading_path"] == ["a"]


def test_oversized_sections_are_cut_where_they_are_read(spark, tmp_path):
    """One pass without shuffle or join: pieces of a file never meet all its sections."""
    from quarry.plans import files

    text = "# a\n" + "\n".join(f"some words of line {i} \U0001f600é" for i in range(40)) + "\n# b\nshort\n"
    spark.createDataFrame([(1, text, "en", "src1"), (2, None, "en", "src1")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = files.c5_split_oversized_sections(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan
    whole = chunking.chunk_files(files.markdown_files(spark, str(tmp_path)).selectExpr("repository_id", "relative_path", "text", "'markdown' language"), files.CHUNKING).collect()
    got = sorted((c.start_line, c.end_line, c.estimated_tokens) for c in found.collect())
    assert len(got) > 2 and set(got) < {(c.start_line, c.end_line, c.estimated_tokens) for c in whole}


def test_sizes_of_runs_of_lines_are_those_of_their_text():
    draw = random.Random(7)
    signs = ["ab", "_9", " ", " ", " ", "﻿", "é", "\U0001f600", ".", "", "", "\t"]
    for _ in range(200):
        lines = ["".join(draw.choices(signs, k=draw.randint(0, 12))) for _ in range(draw.randint(1, 9))]
        sizes = chunking.Sizes(lines)
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                assert sizes.tokens(a, b) == chunking.tokens_of("\n".join(lines[a:b]))
