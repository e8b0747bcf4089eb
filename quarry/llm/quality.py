"""Quality classifier by Bradley-Terry pairwise ranking.

A text's strength is a linear function of its wording (hashed words, word pairs and four-byte strings, by the root of their share)
and of a few surface counts. Preference pairs (a good text over a bad one) give a
logistic loss on feature differences; the threshold is the score quantile that matches the share of good texts
among the training rows, and is placed at 0.7 on the returned scale.

The fit takes every labelled training row and all pairs of a good and a bad one. Pairs are never listed: a pair's loss depends on the difference of two
strengths, so each Newton step counts strengths in narrow cells (a row is shared between the two nearest), sums the logistic curve over the cells of
the other kind, and weighs every row's features with that. Features are made in Arrow batches and stored; only sums of fixed size reach the driver.

Defined results: null and empty texts have the features of no text; without labels of both kinds nothing is learned
and every text scores 0.7; several labels of one row each count; very long texts are scored whole, in one task; equal scores are equal predictions; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fmix, holding, running, slices, staged, utf8, word_hashes

PAIRS = 20_000
CUT = 0.7
#: Penalties of surface counts and of hashed wording.
RIDGE, HASHED_RIDGE = 1e-3, 2e-2
#: Buckets of hashed words, word pairs and four-byte strings.
WORDS, PAIRED, STRINGS = 64, 64, 128
#: Width of a cell of strengths, units that a row shares between two cells, and nodes of the cross term of the second derivatives.
CELL, UNITS, NODES = 1 / 64, 1 << 20, 64
#: Newton steps at most, the step that ends them, and partial sums that reach the driver.
STEPS, LEAST_STEP, PARTS = 30, 1e-6, 16


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2


def _marked(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars.encode())] = 1
    return table


#: Shares of bytes that are features.
SHARES = (
    _marked("#$%&*@^~=+|<>{}[]\\/_"),
    _marked("0123456789"),
    _marked("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _marked(" \t"),
    _marked(".,;:?'\"()-"),
    _marked("!"),
    _marked("\n\r"),
    np.r_[np.zeros(128, np.int64), np.ones(128, np.int64)],
)
N_COUNTS = 7 + len(SHARES)
N_FEATURES = N_COUNTS + WORDS + PAIRED + STRINGS


def hashed_shares(code: np.ndarray, docs: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Root of the share of each bucket among a text's codes."""
    bucket = (fmix(code) % np.uint64(buckets)).astype(np.int64)
    count = np.bincount(docs * buckets + bucket, minlength=n * buckets).reshape(n, buckets)
    return np.sqrt(count / np.maximum(count.sum(axis=1, keepdims=True), 1))


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text."""
    data, offsets = utf8(column)
    n = len(column)
    size = np.diff(offsets)
    hashes, docs = word_hashes(data, offsets)
    count = np.bincount(docs, minlength=n)
    out = np.zeros((n, N_FEATURES))
    out[:, 0] = np.log1p(count)
    out[:, 1] = size / np.maximum(count, 1)
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    out[:, 2] = np.bincount(d[at], minlength=n) / np.maximum(np.sqrt(count), 1)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[at], runs)
    out[:, 3] = top / np.maximum(count, 1)
    same = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    out[:, 4] = np.bincount(docs[1:][same], minlength=n) / np.maximum(count, 1)
    out[:, 5] = size == 0
    out[:, 6] = np.minimum(out[:, 1], 30)
    total = np.zeros(len(data) + 1, np.int64)
    for k, table in enumerate(SHARES):
        np.cumsum(table[data], out=total[1:])
        out[:, 7 + k] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)
    out[:, 1] = np.log1p(out[:, 1])
    at = N_COUNTS
    out[:, at : at + WORDS] = hashed_shares(hashes, docs, n, WORDS)
    at += WORDS
    near = docs[1:] == docs[:-1]
    out[:, at : at + PAIRED] = hashed_shares((hashes[:-1] * np.uint64(3) + hashes[1:])[near], docs[1:][near], n, PAIRED)
    at += PAIRED
    if len(data) > 3:
        four = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 4)).view(np.uint32).ravel().astype(np.uint64)
        owner = np.repeat(np.arange(n), size)
        whole = owner[3:] == owner[:-3]
        out[:, at:] = hashed_shares(four[whole], owner[3:][whole], n, STRINGS)
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, hashed_ridge: float = HASHED_RIDGE) -> Model:
    """Bradley-Terry strengths from drawn pairs (good, bad) of a table in memory, by Newton steps on the logistic loss of differences; :func:`train` takes all pairs."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 1.0)
    mean, scale = x.mean(axis=0, dtype=np.float64), np.maximum(x.std(axis=0, dtype=np.float64), 1e-3)
    z = np.clip((x - mean.astype(np.float32)) / scale.astype(np.float32), -8, 8)
    draw = np.random.default_rng(7)
    m = min(pairs, max(len(good) * len(bad), 1))
    diff = z[draw.choice(good, m)] - z[draw.choice(bad, m)]
    w = np.zeros(x.shape[1])
    ridge = np.where(np.arange(len(w)) < N_COUNTS, ridge, hashed_ridge)
    for _ in range(10):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        grad = -(diff * p[:, None]).mean(axis=0) + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / m + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    strength = z @ w
    cut = float(np.quantile(strength, len(bad) / len(y), method="lower"))
    spread = float(np.abs(strength - cut).mean()) + 1e-9
    return Model(mean, scale, w, cut, 3.0 / spread)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, -1)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, x) of every labelled training row, x its features as 32-bit floats; one row for each label of an id however often it is repeated."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(~held_out(F.col("doc_id"))).join(known.hint("merge"), "doc_id")  # labels grow with the documents
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("quality")
        for part in slices(batches, "text"):
            x = features(part.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array([row.tobytes() for row in x], pa.binary())], names=["quality", "x"])

    return rows.select("quality", "text").mapInArrow(run, "quality int, x binary")


def _summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the vector that ``of`` makes of a batch's features and labels, always in the same order; at most ``PARTS`` sums reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                found = of(_vectors(part), part.column("quality").to_numpy())
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for one in batch.column("sums").to_pylist():
                total = np.frombuffer(one) if total is None else total + np.frombuffer(one)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = rows.mapInArrow(partial, "sums binary").withColumn("part", F.spark_partition_id())
    dealt = parts.repartition(PARTS, F.pmod("part", F.lit(PARTS))).sortWithinPartitions("part").select("sums")
    return np.sum([np.frombuffer(r.sums) for r in dealt.mapInArrow(together, "sums binary").collect()], axis=0)


def _strengths(mean: np.ndarray, scale: np.ndarray, weight: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Standardised features and strengths of rows of features."""

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - mean) / scale, -8, 8)
        return z, z @ weight

    return run


def _cells(rows: DataFrame, strength: Callable) -> tuple[int, np.ndarray, np.ndarray]:
    """The first cell, and good and bad rows by cell from there; a row between two cells counts in both by its nearness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                at = strength(_vectors(part))[1] / CELL
                cell = np.floor(at).astype(np.int64)
                units = np.rint((at - cell) * UNITS).astype(np.int64)
                kind = part.column("quality").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[cell, cell + 1]), pa.array(np.r_[kind, kind]), pa.array(np.r_[UNITS - units, units])], names=["cell", "quality", "units"])

    found = rows.mapInArrow(run, "cell long, quality int, units long").groupBy("cell", "quality").agg(F.sum("units").alias("units")).toPandas()
    first = int(found.cell.min())
    out = np.zeros((2, int(found.cell.max()) - first + 1))
    out[found.quality, found.cell - first] = found.units / UNITS
    return first, out[1], out[0]


def pair_sums(good: np.ndarray, bad: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Over all pairs of rows counted by cell: the loss; and of each cell, first for good rows there and then for bad ones, the sums over the other kind of its slope and of its curvature."""
    gap = np.arange(1 - len(good), len(good)) * CELL  # of a bad row's strength over a good one's
    p = 1 / (1 + np.exp(-np.clip(gap, -40, 40)))
    over_bad = lambda f: np.correlate(f, bad, "valid")[::-1]
    over_good = lambda f: np.convolve(f, good, "valid")
    return float(good @ over_bad(np.logaddexp(0, gap))), np.array([over_bad(p), over_good(p)]), np.array([over_bad(p * (1 - p)), over_good(p * (1 - p))])


def _derivatives(rows: DataFrame, strength: Callable, first: int, slope: np.ndarray, curve: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the ``n`` weights, summed over all pairs.

    The second ones are those of either row, exact, less the cross term of both, for which features are gathered at a few strengths; they guide the steps alone.
    """
    at = (first + np.arange(slope.shape[1])) * CELL
    nodes = np.linspace(at[0], max(at[-1], at[0] + CELL), NODES)
    upper = np.triu_indices(n)

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z, s = strength(x)
        grad, hess, gathered = np.zeros(n), np.zeros((n, n)), []
        for row, kind in enumerate((1, 0)):
            mine, own = z[y == kind], s[y == kind]
            grad += (-1 if kind else 1) * np.interp(own, at, slope[row]) @ mine
            hess += (mine * np.interp(own, at, curve[row])[:, None]).T @ mine
            place = np.clip((own - nodes[0]) / (nodes[1] - nodes[0]), 0, NODES - 1)
            low = np.minimum(place.astype(np.int64), NODES - 2)
            near = np.zeros((len(own), NODES))
            near[np.arange(len(own)), low] = 1 - (place - low)
            near[np.arange(len(own)), low + 1] = place - low
            gathered.append((near.T @ mine).ravel())
        return np.concatenate([grad, hess[upper], *gathered])

    sums = _summed(rows, run)
    grad, flat, good, bad = np.split(sums, np.cumsum([n, len(upper[0]), NODES * n]))
    p = 1 / (1 + np.exp(np.clip(nodes[:, None] - nodes, -40, 40)))
    cross = good.reshape(NODES, n).T @ (p * (1 - p)) @ bad.reshape(NODES, n)
    hess = np.zeros((n, n))
    hess[upper] = flat
    return grad, hess + np.triu(hess, 1).T - cross - cross.T


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled training rows and all pairs of a good and a bad one."""
    rows = staged(training_rows(docs, labels), "training-rows")
    counts = {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    if not n_good or not n_bad:
        return fit(np.zeros((0, N_FEATURES), np.float32), np.zeros(0))
    total, n, pairs = n_good + n_bad, N_FEATURES, n_good * n_bad
    mean = _summed(rows, lambda x, _: x.sum(axis=0, dtype=np.float64)) / total
    scale = np.maximum(np.sqrt(_summed(rows, lambda x, _: ((x - mean) ** 2).sum(axis=0)) / total), 1e-3)
    ridge = np.where(np.arange(n) < N_COUNTS, RIDGE, HASHED_RIDGE)
    weight, step, least = np.zeros(n), np.zeros(n), np.inf
    for _ in range(STEPS):
        strength = _strengths(mean, scale, weight - step)
        first, good, bad = _cells(rows, strength)
        loss, slope, curve = pair_sums(good, bad)
        loss = loss / pairs + 0.5 * (ridge * (weight - step) ** 2).sum()
        if loss > least + 1e-5:  # beyond what cells may blur
            step = step / 2
            continue
        weight, least = weight - step, loss
        if step.any() and np.abs(step).max() < LEAST_STEP:
            break
        grad, hess = _derivatives(rows, strength, first, slope, curve, n)
        step = np.linalg.solve(hess / pairs + np.diag(ridge), grad / pairs + ridge * weight)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    strength = _strengths(mean, scale, weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                yield pa.RecordBatch.from_arrays([pa.array(strength(_vectors(batch.slice(lo, 2048)))[1])], names=["s"])

    reached = staged(rows.mapInArrow(run, "s double"), "strengths")
    order = running(reached.select(F.lit(0).alias("all"), "s", F.lit(1).alias("one")), ["all"], ["s"], ["one"], "strength-order").joined()
    cut = order.filter(F.col("_run_one") == (total - 1) * n_bad // total + 1).first()["s"]
    spread = reached.agg(F.avg(F.abs(F.col("s") - cut))).first()[0] + 1e-9
    return Model(mean, scale, weight, cut, 3.0 / spread)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("quality")
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(features(part.column("text"))))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT - 1e-12).cast("int").alias("predicted"))


def select_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be good, whole and with all their columns, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("quality")
        for part in slices(batches, "text"):
            yield part.filter(pa.array(model.score(features(part.column("text"))) >= CUT - 1e-12))

    return docs.mapInArrow(run, docs.schema)


def auc(scores: pd.Series, labels: pd.Series) -> float:
    """Share of (good, bad) pairs in the right order; ties count half."""
    rank = scores.rank().to_numpy()
    good = labels.to_numpy() == 1
    n, m = good.sum(), (~good).sum()
    return float((rank[good].sum() - n * (n + 1) / 2) / (n * m))
