"""Column functions over lines, token estimates, identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import BOM, SPACE, SPACE_CHARS, STOP_WORDS

BREAK = "\r\n|\r|\n"
WORDISH = f"[A-Za-z0-9_]+|[^A-Za-z0-9_{SPACE_CHARS}]"
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "") == ""


def split_lines(text: Column) -> Column:
    """Lines ended by LF, CRLF or CR; a leading byte-order mark goes; a final terminator adds no line."""
    body = F.regexp_replace(text, "^" + BOM, "")
    parts = F.split(body, BREAK, -1)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)


def newline_stats(text: Column) -> Column:
    crlf, lf = F.regexp_count(text, F.lit(r"\r\n?")), F.regexp_count(text, F.lit(r"(?<!\r)\n"))
    return F.struct((crlf > lf).alias("used_crlf"), F.startswith(text, F.lit(BOM)).alias("had_bom"))


def slice_lines(lines: Column, start: Column, end: Column) -> Column:
    first = F.least(F.greatest(start, F.lit(1)), F.greatest(F.size(lines), F.lit(1)))
    last = F.greatest(F.least(end, F.size(lines)), first)
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def offset_to_line(text: Column, offset: Column) -> Column:
    clamped = F.least(F.greatest(offset, F.lit(0)), F.length(text))
    head = F.substring(text, F.lit(1), clamped)
    cut = (F.substring(text, clamped, F.lit(2)) == "\r\n") & (clamped > 0)
    return (1 + F.regexp_count(head, F.lit(BREAK)) - F.when(cut, 1).otherwise(0)).cast("int")


def estimate_tokens(text: Column) -> Column:
    """0 for '', else the mean of a quarter of the code units and the word-or-sign count, rounded half up, at least 1."""
    units = utf16_length(text)
    pieces = F.regexp_count(text, F.lit(WORDISH)) + units - F.char_length(text)
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((units / 4 + pieces) / 2 + 0.5))).cast("int")


def split_identifier(name: Column) -> Column:
    return F.filter(F.split(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\-./ ]", -1), lambda w: w != "")


def _identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def build_split_form(text: Column) -> Column:
    """Lower-cased parts of multi-part identifiers, distinct in first-seen order."""
    parts = F.filter(F.transform(_identifiers(text), split_identifier), lambda p: F.size(p) > 1)
    return F.array_join(F.array_distinct(F.transform(F.flatten(parts), F.lower)), " ")


def query_terms(question: Column) -> Column:
    """Content words of a question with the parts of identifiers, distinct in order."""
    keep = lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS)
    tokens = F.filter(_identifiers(question), lambda t: keep(F.lower(t)))
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.concat(F.array(F.lower(t)), F.filter(F.transform(split_identifier(t), F.lower), keep)))))


def hash_bytes(content: Column) -> Column:
    return F.sha2(content, 256)


def hash_text(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def chunk_id(path: Column, file_hash: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", path, file_hash, start.cast("string"), end.cast("string")), 256), 1, 32)
