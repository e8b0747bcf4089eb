"""A repository tree walked level by level, so that nothing is listed or read that policy drops.

Each level is one distributed step over a frontier of directories: their entries are listed, the ignore files among them are read, and
the rules so far, the built-in exclusions and nested repositories decide which directories make the next frontier. The driver
only learns whether a frontier is empty, once per level of depth. Sizes are read in a further step dealt by file, so the files of one
large directory are measured by many tasks, and contents only of files that :func:`quarry.operators.discovery.discover` keeps.

The folders must be mounted by all executors. A root or directory that cannot be listed is a row of type ``unreadable``, a file that cannot be measured
or opened one of type ``unreadable_file``; neither ends the job.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions.paths import basename_posix, dirname_posix
from ..options import DiscoveryOptions
from ..session import scratch, staged
from ..sources.repo_tree import entry_types, read_text_files
from .discovery import nested_repositories
from .ignore import decide, load_ignore_files, parse_ignore_files

KEY = ["repository_id", "relative_path"]
LISTED = "repository_id string, root string, relative_path string, entry_type string"
#: Entries handed on at a time while a directory is listed.
BLOCK = 10_000


def list_directories(directories: DataFrame) -> DataFrame:
    """Entries of (repository_id, root, relative_path) directories, by name and type alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                block: list[tuple] = []
                for path, kind in entry_types(row.root, row.relative_path):
                    block.append((row.repository_id, row.root, path, kind))
                    if len(block) == BLOCK:
                        yield pd.DataFrame(block, columns=["repository_id", "root", *KEY[1:], "entry_type"])
                        block = []
                if block:
                    yield pd.DataFrame(block, columns=["repository_id", "root", *KEY[1:], "entry_type"])

    return directories.select("repository_id", "root", "relative_path").mapInPandas(run, LISTED)


def _measured(files: DataFrame) -> DataFrame:
    """Adds size_bytes; a file whose size cannot be read becomes an ``unreadable_file``."""

    def size(path: str) -> int | None:
        try:
            return os.stat(path).st_size
        except OSError:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = [size(os.path.join(r.root, r.relative_path)) for r in frame.itertuples()]
            kinds = ["unreadable_file" if n is None else "file" for n in sizes]
            yield frame.assign(entry_type=kinds, size_bytes=pd.array(sizes, dtype="Int64"))

    return files.mapInPandas(run, LISTED + ", size_bytes long")


def read_contents(files: DataFrame) -> DataFrame:
    """Adds content to (root, relative_path) rows; null where the file cannot be opened."""

    def content(path: str) -> bytes | None:
        try:
            with open(path, "rb") as f:
                return f.read()
        except OSError:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):  # a few files at a time, so that a batch of large ones stays small
                part = frame.iloc[at : at + 64]
                yield part.assign(content=[content(os.path.join(r.root, r.relative_path)) for r in part.itertuples()])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", content binary"
    return files.mapInPandas(run, schema)


def walk(spark: SparkSession, roots: dict[str, str], options: DiscoveryOptions = DiscoveryOptions()) -> DataFrame:
    """What policy leaves to list: repository_id, root, relative_path, entry_type, size_bytes, and the text of ignore files.

    A directory that is dropped is a row without any below it. :func:`quarry.operators.discovery.discover` gives the same
    dispositions for this listing as for one of the whole tree.
    """
    home = scratch(spark, "walk")
    frontier = spark.createDataFrame([(r, root.rstrip("/") or "/", "") for r, root in roots.items()], "repository_id string, root string, relative_path string")
    frontier, depth = staged(frontier, "frontier"), 0
    while True:
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        listed = staged(list_directories(frontier.repartition(width, *KEY)), "level")
        nested = nested_repositories(listed).select("repository_id", F.col("relative_path").alias("_dir"))
        placed = listed.withColumn("_dir", dirname_posix(F.col("relative_path")))
        below = placed.join(nested, ["repository_id", "_dir"], "left_anti").select(listed.columns)
        marks = placed.filter(basename_posix(F.col("relative_path")) == ".git").join(nested, ["repository_id", "_dir"], "left_semi").select(listed.columns)
        entries = below.unionByName(marks)
        ignore_files = entries.filter((F.col("entry_type") == "file") & basename_posix(F.col("relative_path")).isin(*options.ignore_file_names))
        texts = read_text_files(read_contents(ignore_files)).select(*KEY, "text")
        entries.join(texts, KEY, "left").write.parquet(f"{home}/entries/level={depth}")
        now = spark.read.parquet(f"{home}/entries/level={depth}")
        parse_ignore_files(load_ignore_files(now, options)).write.parquet(f"{home}/rules/level={depth}")
        rules = spark.read.parquet(f"{home}/rules")
        inner = below.filter("entry_type = 'dir'").select("repository_id", "root", "relative_path", F.lit(True).alias("is_dir"))
        built_in = P.directory_exclusion(basename_posix(F.col("relative_path"))).isNotNull() & ~F.col("explicitly_included")
        frontier = staged(decide(inner, rules).filter(~F.col("ignored") & ~built_in).select("repository_id", "root", "relative_path"), "frontier")
        depth += 1
        if frontier.isEmpty():
            break
    entries = spark.read.parquet(f"{home}/entries").drop("level")
    files = _measured(entries.filter("entry_type = 'file'").drop("text").repartition(width, *KEY)).join(entries.filter("text is not null").select(*KEY, "text"), KEY, "left")
    others = entries.filter("entry_type <> 'file'").withColumn("size_bytes", F.lit(None).cast("long"))
    return staged(files.unionByName(others.select(files.columns)), "walked")


def read_kept(walked: DataFrame, found: DataFrame) -> DataFrame:
    """Text of the indexable files of ``found`` (dispositions of ``walked``): repository_id, relative_path, text, opened.

    Text is null where the content sniffs as binary; ``opened`` is false where the file was gone or closed by now.
    """
    kept = walked.select("repository_id", "root", "relative_path").join(found.filter("status = 'indexable'").select(*KEY), KEY, "left_semi")
    return read_text_files(read_contents(kept.repartition(*KEY))).select(*KEY, "text", F.col("content").isNotNull().alias("opened"))
