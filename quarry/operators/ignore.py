"""Layered ignore rules as a last-match join.

Rules are few and compiled by a small helper into the dialect of the engine that matches them, Java's: every character of a
class is written as a code point, so nothing in it means more there than in the rule. Matching is an equi-join of a path's
ancestor directories and of what its name ends with or its first directory with the same of the rules (``index``), so
a path meets only rules that can match it; the regular expression comes from the rule's own column, all in the JVM, and the
deciding rule is a ``max_by`` over (depth, file order, line).

Classes mean what they mean in the rule format's usual regular expressions: ``[]`` is empty, so that ``[]a]`` matches nothing, ``[^]`` is any
character, ``\\d``, ``\\w`` and ``\\s`` are sets, other escaped letters stand for themselves. What follows a leading ``]`` is taken literally.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename_posix, dirname_posix, path_segments
from ..options import DiscoveryOptions

RULE = "struct<compiled:boolean,negated:boolean,directory_only:boolean,regex:string>"

# What escapes in a class stand for, as ranges of code points.
SETS = {
    "d": ((0x30, 0x39),),
    "w": ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A)),
    "s": ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)),
}
CONTROLS = {"b": 0x08, "f": 0x0C, "n": 0x0A, "r": 0x0D, "t": 0x09, "v": 0x0B}
TOP = 0x10FFFF
ANY, NONE = r"[\x{0}-\x{10FFFF}]", "(?!)"
CLASS_ITEM = re.compile(r"\\(?:x(?P<hex>[0-9A-Fa-f]{2})|u(?P<unit>[0-9A-Fa-f]{4})|c(?P<ctl>[A-Za-z0-9_])|(?P<set>[dDwWsS])|(?P<octal>[0-3][0-7]{0,2}|[4-7][0-7]?)|(?P<other>(?!c).))|(?P<lit>.)", re.S)


def _complement(ranges: tuple) -> tuple:
    out, at = [], 0
    for lo, hi in ranges:
        if lo > at:
            out.append((at, lo - 1))
        at = hi + 1
    return (*out, (at, TOP))


def class_ranges(body: str) -> list[tuple[int, int]]:
    """The code points of a class body without its negation; raises ``re.error`` for a range out of order."""
    items: list = []
    for m in CLASS_ITEM.finditer(body):
        kind, text = m.lastgroup, m[m.lastgroup]
        if kind == "set":
            ranges = SETS[text.lower()]
            items.append(_complement(ranges) if text.isupper() else ranges)
        elif kind == "other":
            items.append(CONTROLS.get(text, ord(text)))
        else:
            items.append({"hex": lambda t: int(t, 16), "unit": lambda t: int(t, 16), "ctl": lambda t: ord(t) % 32, "octal": lambda t: int(t, 8), "lit": ord}[kind](text))
    marks = [m[0] for m in CLASS_ITEM.finditer(body)]
    out, at = [], 0
    while at < len(items):
        one = items[at]
        if at + 2 < len(items) and marks[at + 1] == "-":
            other = items[at + 2]
            if isinstance(one, int) and isinstance(other, int):
                if other < one:
                    raise re.error("class range out of order", body)
                out.append((one, other))
            else:  # a set is no end of a range: the hyphen stands for itself
                for item in (one, 0x2D, other):
                    out += [(item, item)] if isinstance(item, int) else item
            at += 3
            continue
        out += [(one, one)] if isinstance(one, int) else one
        at += 1
    return out


def class_pattern(body: str) -> str:
    """A class between its brackets, with what is behind a leading ``]``, in Java's dialect."""
    negated = body[:1] in ("!", "^")
    body = body[1:] if negated else body
    if body.startswith("]"):
        return (ANY if negated else NONE) + "".join(_literal(c) for c in re.sub(r"\\(.)", r"\1", body[1:], flags=re.S) + "]")
    ranges = class_ranges(body)
    if not ranges:
        return ANY if negated else NONE
    inner = "[" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" if hi > lo else rf"\x{{{lo:X}}}" for lo, hi in ranges) + "]"
    return f"(?!{inner}){ANY}" if negated else inner


def _literal(char: str) -> str:
    return char if char.isalnum() and char.isascii() or char in "/_" else rf"\x{{{ord(char):X}}}"


GLOB = re.compile(r"\\(?P<esc>.)|(?P<last>\\\Z)|(?P<stars>\*\*)|(?P<star>\*)|(?P<one>\?)|(?P<set>\[!?\]?(?:\\.|[^\]\\])*\])|(?P<lit>.)", re.S)


class Glob(NamedTuple):
    """A glob's pattern, and its text cut where it is not literal (``None``)."""

    pattern: str
    parts: list[str | None]


def read_glob(glob: str) -> Glob:
    out, parts, at = [], [], 0
    while at < len(glob):
        m = GLOB.match(glob, at)
        kind, end = m.lastgroup, m.end()
        part = None
        if kind in ("esc", "last", "lit"):
            part = m[0] if kind == "last" else m[kind]
            out.append(_literal(part))
        elif kind == "stars":
            open_left = at == 0 or glob[at - 1] == "/"
            if open_left and glob[end : end + 1] == "/":
                out.append("(?:.*/)?")
                parts.append(None)
                part, end = "/", end + 1  # what follows begins a segment
            else:
                out.append(".*" if open_left and end == len(glob) else "[^/]*")
        elif kind == "set":
            out.append(class_pattern(m["set"][1:-1]))
        else:
            out.append("[^/]*" if kind == "star" else "[^/]")
        parts.append(part)
        at = end
    return Glob("".join(out), parts)


def index_key(glob: Glob, anchored: bool) -> tuple[str, str]:
    """What every match of a rule has: (``name``, its last segment), (``ending``, from its last dot), (``first``, its first segment) or nothing.

    A wildcard may stand for slashes, but a literal tail of the glob is the tail of the path and a literal head of an anchored one its head.
    """
    tail: list[str] = []
    for part in reversed(glob.parts):
        if part is None or part == "/":
            break
        tail.append(part)
    literal = "".join(reversed(tail))
    before = len(glob.parts) - len(tail) - 1
    if literal and (before < 0 or glob.parts[before] == "/"):
        return "name", literal
    if "." in literal:
        return "ending", literal[literal.rindex(".") :]
    if anchored and "/" in glob.parts:
        head = glob.parts[: glob.parts.index("/")]
        if head and None not in head:
            return "first", "".join(head)
    return "any", ""


#: A rule line: marks around a glob, in which a backslash shields the character behind it (but no slash) from being trimmed.
RULE_LINE = re.compile(r"(?P<negated>!?)(?P<root>/?)(?P<glob>(?:\\[^/]|\\(?=/|\Z)|[^\\])*?)(?P<dirs>/?)[ \t]*", re.S)


class Rule(NamedTuple):
    negated: bool
    directory_only: bool
    regex: str
    key_kind: str
    key: str


def compile_rule(line: str) -> Rule | None:
    """A rule with its index key, or nothing; raises ``re.error`` for an invalid class."""
    part = RULE_LINE.fullmatch(line.removesuffix("\r"))
    glob = part["glob"]
    if line.startswith("#") or not (glob or part["root"] and part["dirs"]):
        return None
    anywhere = not part["root"] and ("/" not in glob or glob.startswith("**/"))
    read = read_glob(glob)
    # an unanchored literal without a slash before it stands behind one or at the start, like a whole segment
    return Rule(bool(part["negated"]), bool(part["dirs"]), "(?:.*/)?" * anywhere + read.pattern, *index_key(read, not anywhere))


def _compile(lines: pd.Series) -> pd.DataFrame:
    rows = []
    for line in lines:
        try:
            rule = compile_rule(line or "")
            rows.append((True, *rule, False) if rule else (False, *[None] * 5, False))
        except re.error:
            rows.append((False, *[None] * 5, True))
    return pd.DataFrame(rows, columns=["compiled", *Rule._fields, "invalid"])


def parse_ignore_files(files: DataFrame) -> DataFrame:
    """Rules of ignore files (repository_id, base_dir, origin, origin_order, text).

    A file with an uncompilable line is dropped whole; its rows stay with ``invalid`` true so that it is visible.
    """
    compiled = F.pandas_udf(_compile, "compiled boolean, negated boolean, directory_only boolean, regex string, key_kind string, key string, invalid boolean")
    lines = files.select("repository_id", "base_dir", "origin", "origin_order", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rules = lines.withColumn("r", compiled("line")).select("repository_id", "base_dir", "origin", "origin_order", "line_no", "line", "r.*")
    broken = rules.filter("invalid").select("repository_id", "base_dir", "origin", F.lit(True).alias("broken")).distinct()
    return rules.join(broken, ["repository_id", "base_dir", "origin"], "left").filter("compiled or invalid").withColumn("invalid", F.coalesce("broken", F.lit(False))).drop("broken", "compiled")


def load_ignore_files(files: DataFrame, options: DiscoveryOptions = DiscoveryOptions()) -> DataFrame:
    """Regular files with an ignore-file name, per directory, in the order of the names."""
    names = F.array(*[F.lit(n) for n in options.ignore_file_names])
    name = basename_posix(F.col("relative_path"))
    return files.filter((F.col("entry_type") == "file") & F.array_contains(names, name)).select(
        "repository_id", dirname_posix(F.col("relative_path")).alias("base_dir"), name.alias("origin"), F.array_position(names, name).alias("origin_order"), "text"
    )


def scope_to_base(base: Column, path: Column) -> Column:
    """The path relative to a directory; null outside it. The root, '', holds every path."""
    inside = F.startswith(path, F.concat(base, F.lit("/")))
    return F.when(base == "", path).when(inside, F.substring(path, F.length(base) + 2, F.length(path)))


def candidates(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Each path (repository_id, relative_path, is_dir) with the rules that can match it: on its own branch, and of its name, ending or first directory."""
    usable = rules.filter("not invalid").select("repository_id", "base_dir", "origin", "origin_order", "line_no", "line", "negated", "directory_only", "regex", "key_kind", "key")
    bases = F.concat(F.array(F.lit("")), ancestors(F.col("relative_path")))
    spread = paths.select("repository_id", "relative_path", "is_dir", F.explode(bases).alias("base_dir"))
    spread = spread.join(usable.select("repository_id", "base_dir").distinct(), ["repository_id", "base_dir"], "left_semi")
    scoped = spread.withColumn("scoped", scope_to_base(F.col("base_dir"), F.col("relative_path")))
    name = F.substring_index("scoped", "/", -1)
    ending = F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1)))
    keys = F.array(*[F.struct(F.lit(kind).alias("key_kind"), value.alias("key")) for kind, value in (("name", name), ("ending", ending), ("first", F.substring_index("scoped", "/", 1)), ("any", F.lit("")))])
    keyed = scoped.withColumn("k", F.explode(keys)).select("repository_id", "relative_path", "is_dir", "base_dir", "scoped", "k.*")
    return keyed.join(usable, ["repository_id", "base_dir", "key_kind", "key"]).filter(~F.col("directory_only") | F.col("is_dir"))


def decide(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """One decision per (repository_id, relative_path, is_dir): ignored, explicitly_included, rule, origin.

    Silence is "not ignored"; the last matching rule wins, deeper directories after shallower ones.
    """
    whole = F.concat(F.lit("(?s)^(?:"), F.col("regex"), F.lit(r")\z"))
    hits = candidates(paths, rules).filter(F.regexp_like("scoped", whole))
    place = F.struct(F.size(path_segments(F.col("base_dir"))), "origin_order", "line_no")
    verdict = hits.groupBy("repository_id", "relative_path", "is_dir").agg(F.max_by(F.struct("negated", "line", "origin"), place).alias("v"))
    return paths.join(verdict, ["repository_id", "relative_path", "is_dir"], "left").select(
        *paths.columns,
        F.coalesce(~F.col("v.negated"), F.lit(False)).alias("ignored"),
        F.coalesce("v.negated", F.lit(False)).alias("explicitly_included"),
        F.col("v.line").alias("rule"),
        F.col("v.origin").alias("rule_origin"),
    )
