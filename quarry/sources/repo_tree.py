"""Repository trees as a Spark data source, text decoding, and streams.

The built-in binary source drops names that start with a dot or underscore, which are exactly the ignore files and
package markers policy needs; so trees come through the Python data source interface, one input partition per top
directory of each root.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from ..functions.policy import looks_binary

TREE_SCHEMA = "repository_id string, relative_path string, entry_type string, size_bytes long, content binary"
SEGMENT_SCHEMA = (
    "session_id string, source string, stream_epoch int, sequence long, text string, start_ms long, end_ms long, "
    "is_final boolean, is_turn_end boolean, revision int, ts timestamp"
)
EVENT_SCHEMA = (
    "event_id string, session_id string, request_id string, question_revision int, repository_id string, "
    "index_generation string, timestamp_ms long, type string, payload string"
)


@dataclass
class TreePart(InputPartition):
    repository_id: str
    root: str
    top: str | None


def _entry_type(entry: os.DirEntry) -> str:
    try:
        return "symlink" if entry.is_symlink() else "dir" if entry.is_dir() else "file" if entry.is_file() else "other"
    except OSError:
        return "unreadable_file"


def entry_types(root: str, directory: str) -> Iterator[tuple[str, str]]:
    """(relative path, type) of what a directory holds, as it is listed; one row ``unreadable`` of the directory itself where it cannot be."""
    prefix = directory + "/" if directory else ""
    try:
        with os.scandir(os.path.join(root, directory) if directory else root) as entries:
            for entry in entries:
                yield prefix + entry.name, _entry_type(entry)
    except OSError:
        yield directory, "unreadable"


class RepoTreeSource(DataSource):
    """Options: ``roots`` (newline-separated ``id=path``), ``max_bytes`` of content to read (larger files come without).

    Column pruning is by the schema that the reader asks for: without ``content`` no file is opened, without ``size_bytes`` none is measured.
    Filters on ``repository_id``, ``entry_type`` and the start of ``relative_path`` are pushed down with the option ``pushdown``, for which
    ``spark.sql.python.filterPushdown.enabled`` must be set: other roots and directories are not listed, other types not opened.
    """

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return TREE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = PushingReader if self.options.get("pushdown") == "true" else RepoTreeReader
        return kind(self.options, schema.names)


class RepoTreeReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.roots = [line.partition("=")[::2] for line in options["roots"].split("\n") if line]
        self.max_bytes = int(options.get("max_bytes", 1_000_000))
        self.columns = columns
        self.types: set[str] | None = None
        self.prefix = ""

    def _may_hold(self, directory: str) -> bool:
        """Whether paths below a directory can begin with the prefix."""
        return f"{directory}/".startswith(self.prefix) or self.prefix.startswith(f"{directory}/")

    def partitions(self) -> list[TreePart]:
        """One for each top directory, and one for what lies directly in each root."""
        parts = []
        for repo, root in self.roots:
            parts.append(TreePart(repo, root, None))
            parts += [TreePart(repo, root, path) for path, kind in entry_types(root, "") if kind == "dir" and self._may_hold(path)]
        return parts

    def read(self, partition: TreePart) -> Iterator[tuple]:
        stack = [partition.top or ""]
        while stack:
            for path, kind in entry_types(partition.root, stack.pop()):
                if kind == "dir" and partition.top is not None and self._may_hold(path):
                    stack.append(path)
                if kind == "other" or not (path.startswith(self.prefix) or kind == "unreadable"):
                    continue
                size = content = None
                if kind == "file":
                    kind, size, content = self._file(os.path.join(partition.root, path))
                if self.types is None or kind in self.types:
                    row = {"repository_id": partition.repository_id, "relative_path": path, "entry_type": kind, "size_bytes": size, "content": content}
                    yield tuple(row[c] for c in self.columns)

    def _file(self, path: str) -> tuple[str, int | None, bytes | None]:
        """Type, size and content of a file, as far as they are asked for; one that cannot be read is an ``unreadable_file``."""
        size = content = None
        try:
            if "size_bytes" in self.columns or "content" in self.columns:
                size = os.stat(path).st_size
            if "content" in self.columns and size <= self.max_bytes and (self.types is None or "file" in self.types):
                with open(path, "rb") as f:
                    content = f.read()
        except OSError:
            return "unreadable_file", None, None
        return "file", size, content


class PushingReader(RepoTreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what narrows the listing; Spark still checks all but exact tests of the repository."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if f.attribute == ("repository_id",) and wanted is not None:
                self.roots = [(r, path) for r, path in self.roots if r in wanted]
                continue
            if f.attribute == ("entry_type",) and wanted is not None:
                self.types = wanted if self.types is None else self.types & wanted
            elif f.attribute == ("relative_path",) and isinstance(f, (EqualTo, StringStartsWith)) and len(f.value) > len(self.prefix):
                self.prefix = f.value
            yield f


def read_repo_tree(spark: SparkSession, roots: dict[str, str], max_bytes: int = 1_000_000, columns: str = TREE_SCHEMA) -> DataFrame:
    """Every entry under the roots (id to path); fewer ``columns`` of the schema mean less to read."""
    spark.dataSource.register(RepoTreeSource)
    return spark.read.format("repo_tree").schema(columns).option("roots", "\n".join(f"{k}={v}" for k, v in roots.items())).option("max_bytes", str(max_bytes)).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled")).load()


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write each text to ``root/repository_id/relative_path`` from the tasks; the folder must be mounted everywhere. Returns what was written."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for repository, path, text in zip(frame["repository_id"], frame["relative_path"], frame["text"], strict=True):
                target = os.path.join(root, repository, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as f:
                    f.write((text or "").encode())
            yield frame[["repository_id", "relative_path"]]

    return files.select("repository_id", "relative_path", "text").mapInPandas(run, "repository_id string, relative_path string")


def _decode(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


def read_text_files(files: DataFrame) -> DataFrame:
    """Adds ``text``: UTF-8 with bad bytes replaced, null where the content sniffs as binary."""
    decode = F.pandas_udf(_decode, "string")
    return files.withColumn("text", decode(F.when(~looks_binary(F.col("content")), F.col("content"))))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SEGMENT_SCHEMA).parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Envelope stream from JSON lines; ``ts`` is the event time."""
    return spark.readStream.schema(EVENT_SCHEMA).json(path).withColumn("ts", F.timestamp_millis("timestamp_ms"))


def event_payload(events: DataFrame, kind: str, schema: str) -> DataFrame:
    """Events of one type with their payload parsed."""
    return events.filter(F.col("type") == kind).withColumn("payload", F.from_json("payload", schema))
