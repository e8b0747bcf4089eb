"""Ignore rules: golden cases, and discovery against a brute-force walk of random trees."""

from __future__ import annotations

import random
import re

import pytest

from quarry.operators import discovery, ignore
from quarry.options import DiscoveryOptions

CASES = [
    # rules, path, is_dir, ignored
    ("*.log", "a.log", False, True), ("*.log", "x/y/a.log", False, True), ("*.log", "a.log/b", False, False),
    ("/build", "build", True, True), ("/build", "x/build", True, False), ("doc/a", "doc/a", False, True), ("doc/a", "x/doc/a", False, False),
    ("**/foo", "a/b/foo", True, True), ("a/**/b", "a/b", False, True), ("a/**/b", "a/x/y/b", False, True), ("a/**", "a/x/y", False, True),
    ("tmp/", "tmp", True, True), ("tmp/", "tmp", False, False), ("[ab].c", "a.c", False, True), ("[!ab].c", "a.c", False, False), ("[!ab].c", "c.c", False, True),
    ("?.c", "x.c", False, True), ("?.c", "xy.c", False, False), ("*.a\n!k.a", "k.a", False, False), ("!k.a\n*.a", "k.a", False, True),
    ("a.b", "aXb", False, False), ("README", "readme", False, False), ("\\#x", "#x", False, True), ("\\!x", "!x", False, True), ("# note", "# note", False, False),
    ("x  ", "x", False, True), ("x\\ ", "x ", False, True), ("x\r", "x", False, True), ("a**b", "aXXb", False, True), ("a**b", "a/b", False, False),
    ("[a", "[a", False, True), ("\\*", "*", False, True), ("\\*", "x", False, False), ("[]x]", "]", False, False), ("", "a", False, False),
    ("[a&&b].ts", "&.ts", False, True), ("[a&&b].ts", "b.ts", False, True), ("[\\Q]x", "Qx", False, True), ("[^]]x", "a]x", False, True), ("[^]]x", "x", False, False), ("[\\d-z]", "-", False, True),
    ("[\\d-z]", "5", False, True), ("[\\x41-C]", "B", False, True), ("[!\\w]", "é", False, True), ("[[:a]", ":", False, True), ("[+--]", ",", False, True), ("x[a]y/*", "xay/b", False, True), ("a/**/b.c", "a/x/y/b.c", False, True),
]


def decisions(spark, files, paths):
    rows = spark.createDataFrame(files, "repository_id string, base_dir string, origin string, origin_order int, text string")
    asked = spark.createDataFrame(paths, "repository_id string, relative_path string, is_dir boolean")
    out = ignore.decide(asked, ignore.parse_ignore_files(rows)).collect()
    return {(r.repository_id, r.relative_path, r.is_dir): r for r in out}


def test_golden_cases(spark):
    files = [(f"r{i}", "", ".gitignore", 1, rules) for i, (rules, *_) in enumerate(CASES)]
    paths = [(f"r{i}", path, is_dir) for i, (_, path, is_dir, _) in enumerate(CASES)]
    got = decisions(spark, files, paths)
    for i, (rules, path, is_dir, ignored) in enumerate(CASES):
        assert got[(f"r{i}", path, is_dir)].ignored == ignored, (rules, path)


def test_nesting_scope_and_reporting(spark):
    files = [("r", "", ".gitignore", 1, "*.ts"), ("r", "packages/api", ".gitignore", 1, "!*.ts"), ("r", "", ".indexignore", 2, "!keep.ts")]
    got = decisions(spark, files, [("r", "packages/api/a.ts", False), ("r", "packages/web/a.ts", False), ("r", "packages/api-x/a.ts", False), ("r", "keep.ts", False), ("r", "a.md", False)])
    assert not got[("r", "packages/api/a.ts", False)].ignored and got[("r", "packages/api/a.ts", False)].explicitly_included
    assert got[("r", "packages/web/a.ts", False)].ignored and got[("r", "packages/web/a.ts", False)].rule == "*.ts"
    assert got[("r", "packages/api-x/a.ts", False)].ignored
    assert got[("r", "keep.ts", False)].rule_origin == ".indexignore"
    silent = got[("r", "a.md", False)]
    assert not silent.ignored and not silent.explicitly_included and silent.rule is None


def test_invalid_class_drops_the_whole_file(spark):
    got = decisions(spark, [("r", "", ".gitignore", 1, "*.a\n[z-a]")], [("r", "x.a", False)])
    assert not got[("r", "x.a", False)].ignored
    rows = spark.createDataFrame([("r", "", ".gitignore", 1, "*.a\n[z-a]")], "repository_id string, base_dir string, origin string, origin_order int, text string")
    assert all(r.invalid for r in ignore.parse_ignore_files(rows).collect())


TREE = "repository_id string, relative_path string, entry_type string, size_bytes long, text string"


def dispositions(spark, entries, options=DiscoveryOptions()):
    rows = [("r", p, kind, size, text) for p, kind, size, text in entries]
    return {r.relative_path: r for r in discovery.discover(spark.createDataFrame(rows, TREE), options).collect()}


def test_tree_policy(spark):
    got = dispositions(spark, [
        ("src", "dir", None, None), ("src/real.ts", "file", 10, None), ("node_modules", "dir", None, None), ("node_modules/x.ts", "file", 1, None),
        (".env", "file", 1, None), (".env.example", "file", 1, None), ("a.png", "file", 1, None), ("link", "symlink", None, None), ("big.ts", "file", 2000, None),
        ("sub", "dir", None, None), ("sub/.git", "file", 1, None), ("sub/a.ts", "file", 1, None), (".gitignore", "file", 9, "*.md\n!x.md"), ("r.md", "file", 1, None), ("x.md", "file", 1, None), ("pipe", "other", None, None),
    ], DiscoveryOptions(max_file_bytes=1000))
    assert {p for p, r in got.items() if r.status == "indexable"} == {"src/real.ts", ".env.example", "x.md"}
    assert got["node_modules"].origin == "default" and "node_modules/x.ts" not in got
    assert got["link"].origin == "boundary" and got["big.ts"].origin == "size" and got["sub"].reason == discovery.NESTED and "sub/a.ts" not in got
    assert got["r.md"].reason == "Matched `*.md`." and got["r.md"].origin == ".gitignore"
    assert got[".gitignore"].reason == discovery.UNRECOGNISED and "pipe" not in got
    assert all(r.reason and r.origin for r in got.values() if r.status == "skipped")


def test_explicit_inclusion(spark):
    entries = [("vendor", "dir", None, None), ("vendor/a.php", "file", 1, None), (".env", "file", 1, None), ("k.pem", "file", 1, None), (".gitignore", "file", 8, "!vendor/\n!*")]
    got = dispositions(spark, entries)
    assert got["vendor/a.php"].status == "indexable" and got[".env"].status == "skipped" and got["k.pem"].status == "skipped"


def test_cap(spark):
    rows = spark.createDataFrame([("a", f"f{i}") for i in range(5)] + [("b", "x"), ("b", "y")], "repository_id string, relative_path string")
    got = discovery.cap_files(rows, 3).collect()
    assert sorted((r.repository_id, r.relative_path, r.truncated is not None) for r in got) == [("a", "f0", True), ("a", "f1", True), ("a", "f2", True), ("b", "x", False), ("b", "y", False)]


def in_python(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


def brute_class(body: str, char: str) -> bool:
    """Membership by a literal reading of a class body: escapes, then ranges, one character after another."""
    negated = body[:1] in ("!", "^")
    body = body[1:] if negated else body
    units, at = [], 0
    while at < len(body):
        if body[at] == "\\":
            c = body[at + 1]
            units.append(set("0123456789") if c == "d" else c)
            at += 2
        else:
            units.append(body[at])
            at += 1
    found, at = False, 0
    while at < len(units):
        one = units[at]
        if at + 2 < len(units) and units[at + 1] == "-" and isinstance(one, str) and isinstance(units[at + 2], str):
            found |= one <= char <= units[at + 2]
            at += 3
            continue
        found |= char in one if isinstance(one, set) else char == one
        at += 1
    return found != negated


def test_random_classes(spark):
    """Classes of odd characters against a literal reading; none loses the rule beside it."""
    draw, files, paths, want = random.Random(5), [], [], {}
    pieces = ["a", "b", "&&", "\\Q", "\\E", "^", "-", "[", "(", "|", "*", "\\]", "\\\\", "\\d", "0-4", "b-e", "~", "#", ".", "é", "{", "$"]
    chars = "abcdefQE^-[](|*\\059&~#.é{$!z"
    for i in range(150):
        body = draw.choice(["", "!"]) + "".join(draw.choice(pieces) for _ in range(draw.randint(1, 4)))
        if body in ("!", "") or body.lstrip("!").startswith("]") or body.endswith("\\"):
            continue
        char = draw.choice(chars)
        try:
            ignore.compile_rule(f"[{body}].q")
        except re.error:
            continue
        if "-" in body and (body.count("-") > 1 or "\\d-" in body or "-\\d" in body):
            continue  # the golden cases hold sets beside hyphens
        files.append((f"c{i}", "", ".gitignore", 1, f"[{body}].q\n*.log"))
        paths += [(f"c{i}", f"{char}.q", False), (f"c{i}", "x.log", False)]
        want[f"c{i}"] = (body, char, brute_class(body, char))
    got = decisions(spark, files, paths)
    assert len(want) > 60
    for repo, (body, char, hit) in want.items():
        assert got[repo, f"{char}.q", False].ignored == hit, (body, char)
        assert got[repo, "x.log", False].ignored


def test_rules_are_met_by_key(spark):
    """Literal names, endings and first directories are looked up; only wildcards meet every path of their branch."""
    rules = "\n".join(["README", "*.log", "docs/**", "/a*", "x/**/y.ts", "**/deep", "b[!x]c.md"])
    kinds = [ignore.compile_rule(r).key_kind for r in rules.split("\n")]
    assert kinds == ["name", "ending", "first", "any", "name", "name", "ending"]
    rows = spark.createDataFrame([("r", "", ".gitignore", 1, rules)], "repository_id string, base_dir string, origin string, origin_order int, text string")
    asked = spark.createDataFrame([("r", p, False) for p in ("src/m.py", "docs/m.py", "a/b.log", "q/README")], "repository_id string, relative_path string, is_dir boolean")
    met = ignore.candidates(asked, ignore.parse_ignore_files(rows)).groupBy("relative_path").count().collect()
    assert {r.relative_path: r["count"] for r in met} == {"src/m.py": 1, "docs/m.py": 2, "a/b.log": 2, "q/README": 2}


def brute_walk(entries: dict[str, tuple[str, str | None]], options: DiscoveryOptions) -> dict[str, str]:
    """A literal recursive walk with the same rules, for random trees of plain files and directories."""
    children: dict[str, list[str]] = {}
    for path in entries:
        children.setdefault(path.rpartition("/")[0], []).append(path)
    out = {}

    def verdict(stack, path, is_dir):
        last = None
        for base, rules in stack:
            if base and not path.startswith(base + "/"):
                continue
            scoped = path[len(base) + 1 :] if base else path
            for line in rules:
                rule = ignore.compile_rule(line)
                if rule and (is_dir or not rule.directory_only) and re.fullmatch(in_python(rule.regex), scoped, re.S):
                    last = rule
        return last

    def walk(here, stack):
        if here and f"{here}/.git" in entries:
            out[here] = "skipped"
            return
        ignore_file = f"{here}/.gitignore".lstrip("/")
        if ignore_file in entries:
            stack = [*stack, (here, entries[ignore_file][1].split("\n"))]
        for path in children.get(here, []):
            kind, name = entries[path][0], path.rpartition("/")[2]
            rule = verdict(stack, path, kind == "dir")
            if rule and not rule.negated:
                out[path] = "skipped"
            elif kind == "dir":
                if not rule and name in ("node_modules", ".git", "dist"):
                    out[path] = "skipped"
                else:
                    walk(path, stack)
            else:
                out[path] = "indexable" if name.endswith(".ts") else "skipped"

    walk("", [])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_trees(spark, seed):
    draw = random.Random(seed)
    entries: dict[str, tuple[str, str | None]] = {}
    for _ in range(60):
        depth, path = draw.randint(1, 4), ""
        for k in range(depth):
            path = f"{path}/{draw.choice(['a', 'b', 'dist', 'node_modules', 'c1'])}".lstrip("/")
            if k < depth - 1 or draw.random() < 0.2:
                entries.setdefault(path, ("dir", None))
        if entries.get(path, ("dir",))[0] == "dir" and path in entries:
            leaf = f"{path}/{draw.choice(['x.ts', 'y.ts', 'z.qqq'])}"
            entries.setdefault(leaf, ("file", None))
    dirs = [p for p, (k, _) in entries.items() if k == "dir"]
    for p in draw.sample(dirs, min(4, len(dirs))) + [""]:
        rules = "\n".join(draw.sample(["*.ts", "!x.ts", "a/", "/b", "!dist/", "c?/**", "!node_modules/", "**/y.ts", "b/*.ts"], 3))
        entries[f"{p}/.gitignore".lstrip("/")] = ("file", rules)
    if dirs:
        entries[f"{draw.choice(dirs)}/.git"] = ("dir", None)
    entries = {p: v for p, v in entries.items() if all(entries.get(p[:i], ("dir",))[0] == "dir" for i, c in enumerate(p) if c == "/")}
    got = dispositions(spark, [(p, k, 1, t) for p, (k, t) in entries.items()])
    assert {p: r.status for p, r in got.items()} == brute_walk(entries, DiscoveryOptions())
