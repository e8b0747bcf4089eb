"""Secret redaction and findings. The rules are this library's own; a found value is never emitted.

Replacement keeps every line break, so line numbers hold. A private key block runs from its begin mark to its end mark; where no
end mark comes before the next begin mark or the end of the text, it runs over the rest of its line and the lines behind that look
like key material (base64, header fields, blank lines). The text is cut at the marks and each block is rewritten by a pattern
that never spans lines, so the work is linear in the text, and what is found and what is redacted are the same lines.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_lines

#: Where a word starts or ends, as in the rules' SQL: letters beyond ASCII are no part of words (to Java's own mark they are before version 19).
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: In any case, s and k have a third form each beyond ASCII, in words and in classes of letters.
LONG_S, KELVIN = "\u017f", "\u212a"
_KEYS = "password|passwd|secret|token|api_key|apikey|access_key".replace("s", f"[s{LONG_S}]").replace("k", f"[k{KELVIN}]")
_LETTERS = f"A-Za-z{LONG_S}{KELVIN}"
#: name, pattern, replacement (the assignment rules keep the key). No pattern matches across lines.
RULES = (
    ("assignment", rf"(?i){EDGE}({_KEYS})([ \t]?[=:][ \t]?)(\"[^\"\r\n]{{8,}}\"|'[^'\r\n]{{8,}}'|[{_LETTERS}0-9_./+-]{{8,}})", "$1$2[REDACTED]"),
    ("cloud-key", rf"{EDGE}(AKIA|ASIA)[A-Z0-9]{{16}}{EDGE}", "[REDACTED]"),
    ("vcs-token", rf"{EDGE}(ghp|gho|ghs|github_pat|glpat)[_-][A-Za-z0-9_-]{{16,}}{EDGE}", "[REDACTED]"),
    ("bearer", rf"(?i){EDGE}bearer [{_LETTERS}0-9._~+/-]{{16,}}=*", "Bearer [REDACTED]"),
)
#: Every match of a rule or key block has one of these in it, the first ones in any case. They have no i, whose small form depends on the locale.
STEMS, CASED_STEMS = ("passw", "secret", "token", "key", "bearer", LONG_S), ("AKIA", "ASIA", "ghp", "gho", "ghs", "github_pat", "glpat")
KEY_BLOCK = "private-key"
BEGIN, END = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: A line of a block without an end mark: base64 (quoted or continued, as in source code), a header field, or nothing.
KEY_LINE = r"[ \t]*+(?:[\"'+>#*|]*+[ \t]*+[A-Za-z0-9+/=_-]*+(?:\\n)?[\"'+,;\\ \t]*+|[A-Za-z][A-Za-z0-9-]*+:[^\r\n]*+)[ \t]*+"


def redact_blocks(text: Column) -> Column:
    """Every line of a private key block, its marks included, replaced from its first visible character (or its begin mark) on."""
    pieces = F.split(text, f"(?={BEGIN})", -1)

    def rewritten(piece: Column) -> Column:
        mark = F.regexp_substr(piece, F.lit(f"\\A{BEGIN}"))
        behind = F.substr(piece, F.length(mark) + 1)
        closed = F.split(behind, END, 2)
        open_from = F.regexp_instr(behind, F.lit(rf"(?m)(?<=[\r\n])^(?!{KEY_LINE}$)"))
        end = F.when(F.size(closed) > 1, F.length(closed[0]) + F.length(F.regexp_substr(behind, F.lit(END)))).when(open_from > 0, open_from - 1).otherwise(F.length(behind))
        body = F.regexp_replace(F.concat(mark, F.substr(behind, F.lit(1), end)), r"\S[^\r\n]*+", "[REDACTED]")
        return F.when(mark.isNull(), piece).otherwise(F.concat(body, F.substr(behind, end + 1)))

    return F.when(F.contains(text, F.lit("PRIVATE KEY")), F.array_join(F.transform(pieces, rewritten), "")).otherwise(text)


def may_hold_secrets(text: Column) -> Column:
    """Whether any rule can match, by plain search: most texts need no pattern at all."""
    small = F.lower(text)
    return reduce(or_, [F.contains(small, F.lit(s)) for s in STEMS] + [F.contains(text, F.lit(s)) for s in CASED_STEMS])


def redact_secrets(text: Column) -> Column:
    out = redact_blocks(text)
    for _, pattern, replacement in RULES:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(may_hold_secrets(text), out).otherwise(text)


def secret_findings(files: DataFrame) -> DataFrame:
    """(repository_id, relative_path, line_no, rule): one row per rule and line that :func:`redact_secrets` changes."""
    both = files.select("repository_id", "relative_path", split_lines(redact_blocks(F.col("text"))).alias("safe"), split_lines(F.col("text")).alias("was"))
    lines = both.select("repository_id", "relative_path", F.posexplode(F.arrays_zip("was", "safe")).alias("pos", "line"))
    hidden = F.col("line.was") != F.col("line.safe")
    rules = F.array(F.when(hidden, F.lit(KEY_BLOCK)), *[F.when(F.col("line.safe").rlike(p), F.lit(n)) for n, p, _ in RULES])
    found = lines.select("repository_id", "relative_path", (F.col("pos") + 1).alias("line_no"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    return found


def secret_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repository_id", "rule").agg(F.count(F.lit(1)).alias("n"))
