"""Shared helpers of the corpus operators: scratch tables, joins with hot keys and vectorised word hashing.

Scratch tables live under ``spark.checkpoint.dir`` (shared by driver and executors). Where a local session has none, as in
tests, a folder beside the warehouse is set once; on a cluster that would be one machine's own folder, so it is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes on exit what :func:`staged` wrote inside; the function it yields names a table that outlives the scope."""
    paths: list[str] = []
    _SCOPES.append(paths)

    def kept(table: DataFrame) -> DataFrame:
        paths.remove(table._quarry_path)
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(table._quarry_path)
        return table

    try:
        yield kept
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            remove(spark, path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh shared table and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._quarry_path = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete tables made by :func:`staged` once nothing will read them again."""
    for table in tables:
        remove(table.sparkSession, table._quarry_path)


_HELD: dict[str, Callable[[], None]] = {}


def holding(owner: str, drop: Callable[[], None] | None = None) -> None:
    """Called in a worker by an operator that begins: what other operators keep in its memory between tasks is dropped.

    ``drop`` empties what the owner itself keeps, when another operator comes.
    """
    for other in [o for o in _HELD if o != owner]:
        _HELD.pop(other)()
    if drop is not None:
        _HELD[owner] = drop


#: Keys with more than this share of the rows are dealt to many tasks; there are at most 1 / share of them.
HOT_SHARE, SALTS = 0.005, 32


def hot_join(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with one row per key of ``groups``; keys whose ``size`` is a large share of ``total`` are salted on both sides.

    At most ``1 / HOT_SHARE`` keys can be hot, so their list is broadcast; ``spread`` deals the rows of a hot key.
    """
    keys = [key] if isinstance(key, str) else key
    least = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col(size) > least).select(*keys, F.lit(True).alias("_hot")))
    salted = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.hash(spread), F.lit(SALTS))).otherwise(0)).drop("_hot")
    copies = F.explode(F.when(F.col(size) > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return salted.join(groups.withColumn("_salt", copies), [*keys, "_salt"], how).drop("_salt")


class Running(NamedTuple):
    """Rows with the sums inside their part, and one row per part and group with its sums and those of the parts before it."""

    rows: DataFrame
    parts: DataFrame
    group: list[str]
    sums: list[str]

    def totals(self) -> DataFrame:
        """One row per group with its whole sums."""
        return self.parts.groupBy(*self.group).agg(*[F.sum(f"_sum_{s}").alias(s) for s in self.sums])

    def joined(self, parts: DataFrame | None = None) -> DataFrame:
        """Rows with ``_run_`` sums over their group up to and with the row, and what ``parts`` adds to a group's parts; rows of groups that it lacks go."""
        parts = (self.parts if parts is None else parts).drop(*[f"_sum_{s}" for s in self.sums])
        out = self.rows.join(parts, ["_part", *self.group])
        return out.withColumns({f"_run_{s}": F.col(f"_run_{s}") + F.col(f"_before_{s}") for s in self.sums}).drop("_part", "_row", *[f"_before_{s}" for s in self.sums])


def running(table: DataFrame, group: list[str], order: list[str], sums: list[str], label: str) -> Running:
    """Prefix sums of ``sums`` within ``group`` in ``order``, however large a group is.

    Rows are dealt by ranges of (group, order), so that one group fills many parts; sums run inside each part, and what
    parts before it hold of the same group is added from one small row per part and group. Groups must not be null;
    rows alike in group and order count in the order in which they were read.
    """
    dealt = table.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*group, *order, "_row")
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()), label)
    parts = dealt.groupBy("_part", *group).agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({f"_before_{s}": F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)) for s in sums})
    inside = Window.partitionBy("_part", *group).orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, 0)
    return Running(dealt.withColumns({f"_run_{s}": F.sum(s).over(inside) for s in sums}), parts, group, sums)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 18, max_rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of each slice stays near ``max_bytes`` (one long text may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends, start, total = [], 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (total + n > max_bytes or i - start >= max_rows):
                ends.append((start, i))
                start, total = i, 0
            total += n
        ends.append((start, batch.num_rows))
        for lo, hi in ends:
            yield batch.slice(lo, hi - lo)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and the offsets of each text; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def fmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (published splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POW = {"n": 0, "pow": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}
#: What a byte adds to a hash, by its value.
BYTE_MIX = fmix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64, up to exponent ``n``."""
    if _POW["n"] < n:
        size = max(n, 1 << 18)
        for key, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size + 1, base, dtype=np.uint64)
            steps[0] = 1
            _POW[key] = np.multiply.accumulate(steps)
        _POW["n"] = size
    return _POW["pow"][: n + 1], _POW["inv"][: n + 1]


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_MIX) -> np.ndarray:
    """Running polynomial hash; ``(p[e] - p[s]) * inv[s]`` is the hash of bytes s to e."""
    pw, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * pw[:-1], out=out[1:])
    return out


#: Word bytes as in the decontamination contract: digits, letters (A-Z lowered) and every non-ASCII byte; 0 elsewhere.
WORD_BYTE = np.zeros(256, np.uint8)
WORD_BYTE[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_BYTE[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_BYTE[0x80:] = np.arange(0x80, 0x100)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered word bytes (0 elsewhere) of texts laid end to end, and start, end and text number of every word, in order."""
    low = WORD_BYTE[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = low != 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text number of every word of texts laid end to end, in order."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, starts, ends, texts = word_spans(data, offsets)
    run = prefix_hash(low)
    _, inv = powers(len(data))
    return fmix((run[ends] - run[starts]) * inv[starts] + (ends - starts).astype(np.uint64)), texts
