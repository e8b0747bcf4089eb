"""Personal data by bootstrapped contextual extraction.

Seed entities are the matches of four base kinds. Every identifier-like token (one with a digit or an at sign) is a
mention that carries lexical patterns: the word before it, the word after it, its shape, and the key when it is
assigned one. A run of over ``RUN`` characters without a blank is not one token: it holds one for each piece between separators or
letters of other scripts, whatever its length, with the words beside it in the run. Patterns and mentions form a graph; Spark scores it iteratively: a context (word before or after) is
worth the share of its other mentions that are believed, a shape or key is worth the weighed mean of the contexts
its mentions stand in, and a well-supported shape or key above the threshold is a pattern that makes its mentions
believed. Believed mentions that no base span covers are added under kind ``context``.

Only mentions (a few bytes each; a pattern of over 64 characters is a digest) are shuffled, never texts. A pattern's worth is
joined to its mentions, never broadcast, and the few patterns with a large share of all mentions are dealt to many tasks.

Defined results: null text is empty; base spans are leftmost and non-overlapping per kind, and failing matches are
dropped, and no mention that fails its kind's check is added; added spans never overlap base ones; repeated rows carry the same spans; an empty table gives no rows; other
columns are ignored; a row without an id has base spans alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, slices, staged

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MENTION = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
#: Runs longer than this (minified JSON, CSV, query strings, scripts without blanks) are cut at separators and script changes.
RUN = 200
PIECE = re.compile(r"[^\s\"'`,=&;|?\\()\[\]{}<>\u0370-\U0010ffff]+")
WORD_AFTER = re.compile(r"[^\w\n]*([^\W\u0e00-\U0010ffff]+|[\u0e00-\U0010ffff]{1,2})")
NEXT_WORD = re.compile(r"\W*(\w+)")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
#: Patterns longer than this stand for themselves as a digest.
LONG_PATTERN = 64
EDGE = " .,;:!?()[]{}<>\"'"
ROUNDS, THRESHOLD, SUPPORT = 3, 0.55, 5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of KINDS, then start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def shape(token: str) -> str:
    """Literal prefix of capitals, character classes and a length bucket."""
    n = len(token)
    if n >= 12 and all(c in "0123456789abcdefABCDEF" for c in token):
        return f"hex{n // 16}"
    if n >= 12 and token.isalnum() and token.isascii():
        head = re.match(r"[A-Z]{2,4}|", token)[0][:4]
        return f"code:{head}:{n // 4}:{token.isupper()}"
    return re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}", re.sub(r"[^\W\d_]+", "a", token))


def plausible(token: str) -> bool:
    """False for what a base kind's own check refuses: long digit runs that fail Luhn, addresses with a part over 255."""
    digits = token.replace("-", "")
    if digits.isdigit() and 13 <= len(digits) <= 19:
        return luhn(digits)
    return not (IP.fullmatch(token) and not base_spans(token))


def _word_before(text: str, at: int) -> str:
    """The last word that ends before a position on the same line."""
    end = at
    while end and text[end - 1].isspace() and text[end - 1] != "\n":
        end -= 1
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:end].strip(EDGE).lower()


def _inner_word_before(text: str, at: int) -> str:
    """The last word that ends before a position in a long run; of scripts that may lack blanks two characters tell enough."""
    end = at
    while end and not (text[end - 1].isalnum() or text[end - 1] in "_\n"):
        end -= 1
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] == "_") and (text[start - 1] >= "\u0e00") == (text[end - 1] >= "\u0e00") and (text[end - 1] < "\u0e00" or end - start < 2):
        start -= 1
    return text[start:end].lower()


def _key_before(text: str, at: int, quoted: bool) -> tuple[int, str] | None:
    """Start and name of a key that is assigned what begins at a position: ``name=``, ``name: "`` or, in a long run, ``"name":"``."""
    i = at - (at > 0 and text[at - 1] in "\"'")
    i -= not quoted and i > 0 and text[i - 1].isspace()
    if not i or text[i - 1] not in "=:":
        return None
    i -= 1
    i -= i > 0 and (text[i - 1] in "\"'" if quoted else text[i - 1].isspace())
    start = i
    while start and text[start - 1] in NAME:
        start -= 1
    while start < i and text[start] in "0123456789-":
        start += 1
    return (start, text[start:i].lower()) if start < i else None


def _pattern(kind: str, text: str) -> str:
    return f"{kind}:{text}" if len(text) <= LONG_PATTERN else f"{kind}#{hashlib.md5(text.encode()).hexdigest()}"


def _tokens(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Start and end of runs with a digit or an at sign; long ones are listed in ``runs`` and give such pieces instead."""
    for m in MENTION.finditer(text):
        if m.end() - m.start() <= RUN:
            yield m.span()
            continue
        runs.append(m.span())
        for piece in PIECE.finditer(text, *m.span()):
            if re.search("[0-9@]", piece[0]):
                yield piece.span()


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, str, bool, list[str]]]:
    """(start, end, token, is_seed, patterns) of identifier-like tokens; a base span is one mention."""
    taken = sorted((s, e) for _, s, e in base)
    found, reach = [], 0
    spans: list[tuple[int, int, bool]] = []
    k = 0
    for s, e in taken:
        if s >= reach:
            spans.append((s, e, True))
            reach = e
    blocked = spans.copy()
    runs: list[tuple[int, int]] = []
    for at, stop in _tokens(text, runs):
        token = text[at:stop]
        start, key = at, re.match(r"[A-Za-z_][A-Za-z0-9_-]*[=:][\"']?", token)
        if key:
            start += key.end()
        while start < stop and text[start] in EDGE:
            start += 1
        end = stop
        while end > start and text[end - 1] in EDGE:
            end -= 1
        while k < len(blocked) and blocked[k][1] <= start:
            k += 1
        if end > start and plausible(text[start:end]) and not (k < len(blocked) and blocked[k][0] < end):
            spans.append((start, end, False))
    k = 0
    for start, end, seed in sorted(spans):
        while k < len(runs) and runs[k][1] <= start:
            k += 1
        inside = k < len(runs) and runs[k][0] <= start
        keyed = _key_before(text, start, inside)
        lead = keyed[0] if keyed else start
        after = (WORD_AFTER if inside else NEXT_WORD).match(text, end)
        kinds = [_pattern("S", shape(text[start:end]) if not seed or end - start < 40 else "long")]
        left = _inner_word_before(text, lead) if inside else _word_before(text, lead)
        if left:
            kinds.append(_pattern("L", left))
        if after:
            kinds.append(_pattern("R", after[1].lower()))
        if keyed:
            kinds.append(_pattern("K", keyed[1]))
        found.append((start, end, text[start:end], seed, kinds))
    return found


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of kind, start, stop), found (array of start, stop, seed, patterns): one pass over the text."""
    schema = "doc_id long, base array<struct<kind:string,start:int,stop:int>>, found array<struct<start:int,stop:int,seed:boolean,patterns:array<string>>>"
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
    seen = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            bases, founds = [], []
            for text in part.column("text").to_pylist():
                base = base_spans(text or "")
                bases.append([{"kind": k, "start": s, "stop": e} for k, s, e in base])
                founds.append([{"start": s, "stop": e, "seed": seed, "patterns": p} for s, e, _, seed, p in mentions(text or "", base)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bases, pa.list_(kind)), pa.array(founds, pa.list_(seen))], names=["doc_id", "base", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def believed(found: DataFrame, rounds: int = ROUNDS, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """doc_id, start, stop of mentions that the pattern graph comes to believe, without the seeds.

    ``found`` has one row per mention: doc_id, start, stop, seed, patterns. What a context says of a mention comes from its
    other mentions alone, and counts by how many these are.
    """
    mention = F.xxhash64("doc_id", "start").alias("m")
    edges = staged(found.select(mention, "doc_id", "seed", F.explode("patterns").alias("pattern")), "edges")
    outer = edges.filter("substring(pattern, 1, 1) in ('L', 'R')").select("m", "pattern")
    supported = edges.filter("substring(pattern, 1, 1) in ('S', 'K')").groupBy("pattern", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    supported = staged(supported.groupBy("pattern").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("uses")).filter(F.col("docs") >= support), "supported")
    total = edges.count()
    inner = staged(hot_join(edges.filter("substring(pattern, 1, 1) in ('S', 'K')").select("m", "pattern"), supported, "pattern", "uses", total, F.col("m")).select("m", "pattern", "uses"), "inner")
    seeds = staged(edges.filter("seed").select("m").distinct().withColumn("b", F.lit(1.0)), "seeds")
    belief = seeds
    for _ in range(rounds):
        seen = staged(outer.join(belief, "m", "left").select("m", "pattern", F.coalesce("b", F.lit(0.0)).alias("b")), "seen")
        context = staged(seen.groupBy("pattern").agg(F.sum("b").alias("total"), (F.count(F.lit(1)) - 1).alias("others")), "contexts")
        others = F.greatest("others", F.lit(1))
        weight = F.col("others") / (F.col("others") + 3)
        told = hot_join(seen, context, "pattern", "others", total, F.col("m")).groupBy("m").agg(F.sum((F.col("total") - F.col("b")) / others * weight).alias("s"), F.sum(weight).alias("w"))
        promoted = inner.join(staged(told, "told"), "m").groupBy("pattern").agg((F.sum("s") / (F.sum("w") + 1)).alias("worth"), F.max("uses").alias("uses"))
        promoted = staged(promoted.filter(F.col("worth") >= threshold), "promoted")
        worth = hot_join(inner.select("m", "pattern"), promoted, "pattern", "uses", total, F.col("m")).groupBy("m").agg(F.max("worth").alias("b"))
        belief = staged(worth.union(seeds).groupBy("m").agg(F.max("b").alias("b")), "belief")
    accepted = belief.filter(F.col("b") >= threshold).select("m")
    return found.filter(~F.col("seed")).withColumn("m", mention).join(accepted, "m", "left_semi").select("doc_id", "start", "stop")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and added (arrays of kind, start, stop in order)."""
    parts = staged(extract(docs), "mentions")
    found = parts.filter("doc_id is not null").select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*").distinct()
    added = believed(found).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.lit("context").alias("kind"), "start", "stop"))).alias("added"))
    empty = F.array().cast("array<struct<kind:string,start:int,stop:int>>")
    return parts.select("doc_id", "base").join(added, "doc_id", "left").select("doc_id", "base", F.coalesce("added", empty).alias("added"))
