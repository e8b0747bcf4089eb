"""Target-distribution importance resampling with bit-sliced aggregation.

A document is a bag of hashed features (runs of one to three words, 10,000 buckets). The gain of a bucket says how much likelier
it is in the target than in the corpus, in thousandths of a nat, rounded down, so that a document's weight is an exact integer.
It is computed on bit planes: bit j of all bucket counts of a document is one plane of 10,000 bits; the gains are planes of
their positive and of their negative parts; the weight is the sum over pairs of planes of a power of two times the population
count of their conjunction. Gumbel noise from a digest of the seed and the id is added, and the highest scores are drawn.

The corpus counts come from all texts (at most 10,000 rows a task, then one sum per bucket), and only the 10,000 gains pass the
driver. Ranks are prefix sums over range partitions, so no task orders all documents. The checksums of features are composed from
those of their words, which are computed column-wise; a text is held whole in one task.

Defined results: null text has no features (weight 0); a null doc_id draws its noise from the seed alone and comes first among
equal scores; repeated rows are separate documents with equal scores; documents with too few words are scored but not drawn; an
empty target or corpus counts as no features; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, slices, staged, utf8, word_spans

BUCKETS, RUN, SCALE, SEED, MIN_WORDS, PERCENT = 10_000, 3, 1000, 42, 20, 5
#: Bytes of a plane, in whole 64-bit words; documents whose counts are laid out side by side.
PLANE_BYTES, ROWS = (BUCKETS + 63) // 64 * 8, 64
#: Words up to this many bytes are taken column-wise, by position.
SHORT = 64


def _crc_step() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = (out >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (out & np.uint32(1)))
    return out


_STEP = _crc_step()


def _then_zeros(rows: int) -> np.ndarray:
    """What each value of each of the four bytes of a state becomes after 0 .. rows - 1 zero bytes."""
    out = np.empty((rows, 4, 256), dtype=np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, rows):
        out[n] = _STEP[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


_ZEROS = _then_zeros(SHORT + 2)


def _applied(tables: np.ndarray, which: np.ndarray | int, states: np.ndarray) -> np.ndarray:
    out = tables[which, 0, states & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ tables[which, k, (states >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _shifted(states: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksum states after ``by`` zero bytes each: what appending a string of that length does to the part before it."""
    out = _applied(_ZEROS, np.minimum(by, SHORT + 1), states)
    long = np.flatnonzero(by > SHORT + 1)
    if len(long):
        left, now, table = by[long].copy(), states[long].copy(), _ZEROS[1:2]
        while left.any():
            odd = (left & 1) == 1
            now[odd] = _applied(table, 0, now[odd])
            left >>= 1
            table = _applied(table, 0, table)
        out[long] = now
    return out


def word_checksums(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of every word."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    sorted_starts, falling = starts[order], -sizes[order]
    first = int(np.searchsorted(falling, -SHORT))  # longer words stand before
    state = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(min(SHORT, int(sizes.max(initial=0)))):
        stop = int(np.searchsorted(falling, -at))
        now = state[first:stop]
        state[first:stop] = _STEP[(now ^ low[sorted_starts[first:stop] + at]) & np.uint32(255)] ^ (now >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(first):
        state[i] = zlib.crc32(low[starts[order[i]] : ends[order[i]]])
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature of texts laid end to end, and the number of words of each text."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_texts, np.int64)
    low, starts, ends, texts = word_spans(data, offsets)
    sizes, sums = ends - starts, word_checksums(low, starts, ends)
    spaced = _shifted(np.full(len(sizes), zlib.crc32(b" "), dtype=np.uint32), sizes) ^ sums
    buckets, owners, grams = [sums % np.uint32(BUCKETS)], [texts], sums
    for n in range(1, RUN):
        grams = _shifted(grams[: max(len(sums) - n, 0)], sizes[n:] + 1) ^ spaced[n:]
        whole = texts[n:] == texts[: max(len(texts) - n, 0)]
        buckets.append(grams[whole] % np.uint32(BUCKETS))
        owners.append(texts[n:][whole])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), np.bincount(texts, minlength=n_texts)


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in slices(batches, "text"):
            buckets, _, _ = features(*utf8(batch.column("text")))
            total += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> list[int]:
    """The gain of every bucket; the two tables of counts have at most 10,000 rows each, whatever the corpus."""
    counted = []
    for table in (docs, target):
        counts = [0] * BUCKETS
        for row in bucket_counts(table).collect():
            counts[row.bucket] = row.n
        counted.append(counts)
    (corpus, aim), (all_corpus, all_aim) = counted, map(sum, counted)
    ratio = lambda s, t: float(t + 1) * float(all_corpus + BUCKETS) / (float(s + 1) * float(all_aim + BUCKETS))
    return [math.floor(SCALE * math.log(ratio(s, t))) for s, t in zip(corpus, aim, strict=True)]


def planes(values: np.ndarray) -> list[np.ndarray]:
    """Bit planes of rows of non-negative integers, lowest first, each row in 64-bit words."""
    out = []
    for j in range(int(values.max(initial=0)).bit_length()):
        bits = np.packbits((values >> j) & 1 != 0, axis=1)
        whole = np.zeros((len(values), PLANE_BYTES), dtype=np.uint8)
        whole[:, : bits.shape[1]] = bits
        out.append(whole.view(np.uint64))
    return out


def gain_planes(gained: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Planes of the positive and of the negative parts of the gains, and the signed power of two of each."""
    values = np.array([gained], dtype=np.int64)
    found, factors = [], []
    for sign in (1, -1):
        for k, plane in enumerate(planes(np.maximum(sign * values, 0))):
            found.append(plane[0])
            factors.append(sign << k)
    return np.array(found, dtype=np.uint64).reshape(-1, PLANE_BYTES // 8), np.array(factors, dtype=np.int64)


def plane_weights(counts: np.ndarray, signed: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Exact sums of gains over rows of bucket counts."""
    out = np.zeros(len(counts), dtype=np.int64)
    for j, plane in enumerate(planes(counts)):
        common = np.bitwise_count(plane[:, None, :] & signed[None, :, :]).sum(axis=2, dtype=np.int64)
        out += (common @ factors) << j
    return out


def weights(docs: DataFrame, gained: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    signed, factors = gain_planes(gained)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", max_rows=ROWS):
            rows = batch.num_rows
            buckets, owners, n_words = features(*utf8(batch.column("text")))
            counts = np.bincount(owners * BUCKETS + buckets, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
            found = plane_weights(counts, signed, factors)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(counts.sum(axis=1)), pa.array(found)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-float(SCALE) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (from 1; null where not drawn) of every document."""
    scored = weights(docs, gains(docs, target)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = F.col("n_words") >= min_words
    scored = staged(scored.withColumns({"_fit": fit.cast("long"), "_unfit": ~fit, "_low": -F.col("score")}), "weights")  # a range shuffle reads its input twice
    ordered = running(scored, [], ["_unfit", "_low", "doc_id"], ["_fit"], "resample")
    drawn = F.floor(percent * F.sum("_sum__fit").over(Window.partitionBy()) / 100)  # over one row a part
    rows = ordered.joined(ordered.parts.withColumn("_drawn", drawn))
    rank = F.when(~F.col("_unfit") & (F.col("_run__fit") <= F.col("_drawn")), F.col("_run__fit"))
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def drawn(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The drawn documents with all their columns."""
    return docs.join(resampled.filter("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)
