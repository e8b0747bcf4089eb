"""Column functions over slash-separated paths: no shuffle, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda s: s != "")


def basename_posix(path: Column) -> Column:
    return F.coalesce(F.try_element_at(path_segments(path), F.lit(-1)), F.lit(""))


def dirname_posix(path: Column) -> Column:
    parts = path_segments(path)
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def join_posix(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/")


def normal_segments(path: Column) -> Column:
    """Segments with ``.`` dropped and ``..`` resolved (never above the root)."""
    return F.aggregate(
        path_segments(path),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )


def is_inside_root(root: Column, path: Column) -> Column:
    """Containment on segment boundaries after normalising."""
    r, p = F.array_join(normal_segments(root), "/"), F.array_join(normal_segments(path), "/")
    return (r == "") | (r == p) | F.startswith(p, F.concat(r, F.lit("/")))


def to_relative_posix(root: Column, path: Column, sep: str = "/") -> Column:
    """Path below the root in slash form; null when not absolute or outside; '' for the root itself."""
    slashed = path if sep == "/" else F.replace(path, F.lit(sep), F.lit("/"))
    rooted = root if sep == "/" else F.replace(root, F.lit(sep), F.lit("/"))
    absolute = slashed.rlike(r"^(/|[A-Za-z]:/)")
    parts = normal_segments(slashed)
    return F.when(absolute & is_inside_root(rooted, slashed), F.array_join(F.slice(parts, F.size(normal_segments(rooted)) + 1, F.size(parts) + 1), "/"))


def paths_equal(a: Column, b: Column, case_insensitive: Column | bool) -> Column:
    flag = case_insensitive if isinstance(case_insensitive, Column) else F.lit(case_insensitive)
    return F.when(flag, F.lower(a) == F.lower(b)).otherwise(a == b)


def ancestors(path: Column) -> Column:
    """Proper ancestor directories of a path, outermost first, without the root."""
    parts = path_segments(path)
    return F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ).otherwise(F.array().cast("array<string>"))
