"""Column functions against golden cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.functions import paths as PA
from quarry.functions import policy as PO
from quarry.functions import text as TX


def values(spark, rows, expression, schema="v string"):
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, f"i int, {schema}").select("i", expression.alias("out"))
    return [r.out for r in df.orderBy("i").collect()]


def test_paths(spark):
    two = "r string, p string"
    cases = [("/repo", "/repo"), ("/repo", "/repo-backup/x"), ("/repo", "/"), ("/repo", "/repo/src/deep/file.ts"), ("/repo", "/repo/../etc"), ("/repo", "src/x")]
    assert values(spark, cases, PA.is_inside_root(F.col("r"), F.col("p")), two)[:5] == [True, False, False, True, False]
    assert values(spark, cases, PA.to_relative_posix(F.col("r"), F.col("p")), two) == ["", None, None, "src/deep/file.ts", None, None]
    assert values(spark, ["a/b/c.ts", "c.ts", "", "/a//b/"], PA.basename_posix(F.col("v"))) == ["c.ts", "c.ts", "", "b"]
    assert values(spark, ["a/b/c.ts", "c.ts", "", "/a//b/"], PA.dirname_posix(F.col("v"))) == ["a/b", "", "", "a"]
    assert values(spark, [("a", ""), ("", "b"), ("a", "b")], PA.join_posix(F.col("r"), F.col("p")), two) == ["a", "b", "a/b"]
    assert values(spark, ["a/b/c", "a"], PA.ancestors(F.col("v"))) == [["a", "a/b"], []]


def test_language(spark):
    names = ["a.ts", "a.TSX", "a.js", "a.php", "a.py", "Dockerfile", "Makefile", "mystery.qqq", "LICENSE", ".env.example", ".ts", "dockerfile"]
    assert values(spark, names, PO.detect_language(F.col("v"))) == ["typescript", "typescript", "javascript", "php", "python", "dockerfile", "makefile", None, None, "dotenv", None, None]


def test_exclusions(spark):
    names = [".env", ".env.local", ".env.example", ".env.exampleX", "x/.npmrc", "a.min.js", "a.min.jsx", "package-lockfile.ts", "yarn.lock", "b.PNG", "c.ts", "id_rsa", ".lock"]
    out = values(spark, names, PO.file_exclusion(F.col("v"))["category"])
    assert out == ["secret-bearing", "secret-bearing", None, "secret-bearing", "secret-bearing", "generated", None, "generated", "generated", "media", None, "secret-bearing", None]
    assert values(spark, ["node_modules", "src", ".git", "venv"], PO.directory_exclusion(F.col("v"))["category"]) == ["dependencies", None, "vcs", "dependencies"]


def test_minified_and_binary(spark):
    texts = ["x" * 5000, "a\n" + "b" * 2001, "ok\n" * 500, "x" * 2000, "😀" * 1001]
    assert values(spark, texts, PO.looks_minified(F.col("v"))) == [True, True, False, False, True]
    rows = [(b"abc\0",), (b"abc",), (b"a" * 8192 + b"\0",), (b"a" * 8191 + b"\0",), (b"",)]
    assert values(spark, rows, PO.looks_binary(F.col("v")), "v binary") == [True, False, False, True, False]
    assert values(spark, [(2000,), (1000,)], PO.oversize_reason(F.col("v"), 1000), "v long") == ["Larger than the 1 kB limit.", None]


def test_lines(spark):
    texts = ["a\nb", "a\r\nb\r\n", "a\rb", "a\n", "", "﻿a\nb", "\n", "\n\n", "é😀\n漢"]
    assert values(spark, texts, TX.split_lines(F.col("v"))) == [["a", "b"], ["a", "b"], ["a", "b"], ["a"], [""], ["a", "b"], [""], ["", ""], ["é😀", "漢"]]
    stats = values(spark, texts, TX.newline_stats(F.col("v")))
    assert [s.used_crlf for s in stats] == [False, True, True, False, False, False, False, False, False]
    assert [s.had_bom for s in stats].count(True) == 1
    five = F.array(*[F.lit(x) for x in "abcde"])
    ranges = [(2, 4), (3, 3), (4, 99), (0, 2)]
    assert values(spark, ranges, TX.slice_lines(five, F.col("a"), F.col("b")), "a int, b int") == ["b\nc\nd", "c", "d\ne", "a\nb"]
    offsets = [("ab\ncd\nef", o) for o in (0, 3, 6, 999, -5)] + [("ab\r\ncd\r\nef", o) for o in (0, 4, 8, 3)]
    assert values(spark, offsets, TX.offset_to_line(F.col("t"), F.col("o")), "t string, o int") == [1, 2, 3, 3, 1, 1, 2, 3, 1]


def test_tokens_and_terms(spark):
    assert values(spark, ["", " ", "hello", "a b c", "foo_bar(x)", "😀"], TX.estimate_tokens(F.col("v"))) == [0, 1, 1, 2, 3, 1]
    names = ["getUserName", "GetUser", "snake_case_name", "SCREAMING_CASE", "kebab-case", "a.b.c", "XMLParser", "utf8Decoder", "simple", ""]
    out = values(spark, names, TX.split_identifier(F.col("v")))
    assert out == [["get", "User", "Name"], ["Get", "User"], ["snake", "case", "name"], ["SCREAMING", "CASE"], ["kebab", "case"], ["a", "b", "c"], ["XML", "Parser"], ["utf8", "Decoder"], ["simple"], []]
    assert values(spark, ["plain words only", "getUserName and get_user twice getUserName"], TX.build_split_form(F.col("v"))) == ["", "get user name"]
    assert values(spark, ["How does processWebhook handle retries?", "what is it", "x y"], TX.query_terms(F.col("v"))) == [["processwebhook", "process", "webhook", "handle", "retries"], [], []]


def test_hashes(spark):
    import hashlib

    assert values(spark, ["a\r\nb", "a\nb"], TX.hash_text(F.col("v"))) == [hashlib.sha256(b"a\r\nb").hexdigest(), hashlib.sha256(b"a\nb").hexdigest()]
    expected = hashlib.sha256(b"p\0h\x001\x0020").hexdigest()[:32]
    assert values(spark, ["p"], TX.chunk_id(F.col("v"), F.lit("h"), F.lit(1), F.lit(20))) == [expected]


@pytest.mark.parametrize("flag", [True, False])
def test_paths_equal(spark, flag):
    assert values(spark, [("A", "a"), ("a", "a")], PA.paths_equal(F.col("r"), F.col("p"), flag), "r string, p string") == [flag, True]
