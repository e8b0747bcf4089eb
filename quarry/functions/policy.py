"""Column functions of file policy: language, exclusions, binary and minified checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import options as O
from .paths import basename_posix
from .text import utf16_length

REASON = "struct<category:string,message:string>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _reason(reason: tuple[str, str]) -> Column:
    return F.struct(F.lit(reason[0]).alias("category"), F.lit(reason[1]).alias("message"))


def _reasons(table: dict[str, tuple[str, str]], key: Column) -> Column:
    """Lookup in one constant map, so the key is computed once and the plan stays small."""
    return F.try_element_at(F.create_map(*[x for name, reason in table.items() for x in (F.lit(name), _reason(reason))]), key)


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; null where the dot is first or absent."""
    return F.when(name.rlike(r"(?s)^.+\."), F.lower(F.substring_index(name, ".", -1)))


def detect_language(name: Column) -> Column:
    return F.coalesce(_lookup(O.LANGUAGE_BY_NAME, name), _lookup(O.LANGUAGE_BY_EXTENSION, F.coalesce(extension(name), F.lit(""))))


def directory_exclusion(name: Column) -> Column:
    return _reasons(O.EXCLUDED_DIRECTORIES, name)


def env_file_reason(name: Column) -> Column:
    env = (name == ".env") | F.startswith(name, F.lit(".env."))
    return F.when(env & ~F.substring(name, 6, 1000).isin(*O.ENV_ALLOWED), _reason(O.ENV_REASON))


def generated_name_reason(name: Column) -> Column:
    return F.when(name.rlike(r"\.min\.(js|css)\z"), _reason(O.MINIFIED_REASON)).when(name.rlike(O.LOCKFILE_PREFIX), _reason(O.LOCKFILE_REASON))


def file_exclusion(path: Column) -> Column:
    """First hit wins: environment file, exact name, generated name, extension."""
    return file_exclusion_of(basename_posix(path))


def file_exclusion_of(name: Column) -> Column:
    ext = _reasons(O.EXCLUDED_EXTENSIONS, F.coalesce(extension(name), F.lit("")))
    return F.coalesce(env_file_reason(name), _reasons(O.EXCLUDED_NAMES, name), generated_name_reason(name), ext)


def looks_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, O.BINARY_SAMPLE), F.unhex(F.lit("00")))


def looks_minified(text: Column) -> Column:
    return F.exists(F.split(text, "\n", -1), lambda line: utf16_length(line) > O.MINIFIED_LINE_LENGTH)


def oversize_reason(size: Column, limit: int) -> Column:
    return F.when(size > limit, F.lit(f"Larger than the {int(limit / 1000 + 0.5)} kB limit."))
