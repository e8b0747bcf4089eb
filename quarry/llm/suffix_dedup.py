"""Substring dedup by suffix order and longest-previous-factor arrays.

A byte goes when it lies in a string of ``length`` bytes that also starts elsewhere. Every such string holds a
winnowed anchor: the k-byte string of least hash in each window of ``length`` bytes, a choice that depends on the
window alone, so equal windows choose equal anchors. Only anchors are shuffled (about one per hundred bytes), and
only anchors that occur more than once matter.

Around a shared anchor stands its context, the bytes of all windows that hold it. Identical contexts are each
other's longest factors and need no sorting. Different contexts of one anchor are sorted together: their windows are
ordered by their ``length`` bytes (ranks of what stands before and behind the anchor, many anchors at once), ties by position. From the order come,
for every window, the previous smaller position with an equal string (the longest previous factor, cut at ``length``) and,
mirrored, the next larger one (the longest next factor); what has either is removed, and with ``keep_first`` only what has the
former, so that the first copy stays.

An anchor with very many different contexts is cut into blocks; what meets only across blocks is settled by grouping
hashes of one window of each class per block over the cluster, so no block grows with the data.

Defined results: null text is empty; texts shorter than ``length`` lose nothing; matches never cross documents;
a repeated row is a copy like any other and keeps its own result row; of several texts under one id each has its own result;
a row without an id keeps its text and is no copy of others; very long texts are cut into overlapping pieces for their anchors and held whole where bytes are removed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, fmix, hot_join, powers, prefix_hash, slices, staged, utf8

LENGTH, ANCHOR, BLOCK = 400, 200, 64
_PIECE = 1 << 23


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by block-wise running minima."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ``data``) and hashes of the winnowed anchors of texts laid end to end."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    run = prefix_hash(data)
    _, inv = powers(n)
    grams = fmix((run[k:] - run[:-k]) * inv[: n - k + 1])
    key = (grams >> np.uint64(24) << np.uint64(24)) | (np.uint64(0xFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    least = sliding_min(key, length - k + 1)
    stop = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    ok = stop - np.arange(len(least)) >= length  # windows that stay within one text
    chosen = least[ok]
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
    at = np.unique((np.uint64(0xFFFFFF) - (chosen & np.uint64(0xFFFFFF))).astype(np.int64))
    return at, grams[at]


def _anchor_pass(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column("text"))
            at, h = [], []
            for lo in range(0, max(len(data), 1), _PIECE):  # positions of one round must fit 24 bits
                hi = min(len(data), lo + _PIECE + length - 1)
                inner = np.unique(np.clip(offsets, lo, hi)) - lo
                p, g = anchors_of(data[lo:hi], inner, length, k) if len(inner) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                at.append(p + lo)
                h.append(g)
            at, first = np.unique(np.concatenate(at), return_index=True)
            h = np.concatenate(h)[first]
            doc = np.searchsorted(offsets, at, side="right") - 1
            left = np.maximum(offsets[doc], at - (length - k))
            right = np.minimum(offsets[doc + 1], at + length)
            raw = data.tobytes()
            place = np.stack([at - left, right - at], axis=1).astype("<u2").tobytes()
            around = [hashlib.blake2b(raw[a:b] + place[4 * i : 4 * i + 4], digest_size=16).digest() for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))]
            around = np.frombuffer(b"".join(around), np.int64).reshape(-1, 2)
            n = part.num_rows
            cut = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
            place = pa.StructArray.from_arrays(
                [pa.array((at - offsets[doc]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(around[:, 0].copy()), pa.array(around[:, 1].copy()), pa.array((at - left).astype(np.int16)), pa.array((right - at).astype(np.int16))],
                ["pos", "h", "ctx", "ctx2", "lo", "hi"],
            )
            marks = offsets.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(raw[a:b]).digest() for a, b in zip(marks, marks[1:], strict=False)], pa.binary()),
                    pa.ListArray.from_arrays(cut, place),
                ],
                names=["doc_id", "n_bytes", "sha", "anchors"],
            )

    return run


_PLACE = "array<struct<pos:int,h:long,ctx:long,ctx2:long,lo:short,hi:short>>"
_RUNS = "array<struct<a:int,b:int>>"


def _part(raw: bytes) -> bytes:
    """Tells apart texts that share an id."""
    return hashlib.sha256(raw).digest()[:8]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around each wanted anchor: h, block, ctx, ctx2, lo, body, and its place (doc_id, part, pos)."""
    for batch in batches:
        for i in range(batch.num_rows):
            raw = (batch.column("text")[i].as_py() or "").encode()
            own = _part(raw)
            want = [w for w in batch.column("want")[i].as_py() if w["part"] == own]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([w[c] for w in want], t) for c, t in (("h", pa.int64()), ("block", pa.int32()), ("ctx", pa.int64()), ("ctx2", pa.int64()), ("lo", pa.int32()))),
                    pa.array([raw[w["pos"] - w["lo"] : w["pos"] + w["hi"]] for w in want], pa.binary()),
                    pa.array([batch.column("doc_id")[i].as_py()] * len(want), pa.int64()),
                    pa.array([own] * len(want), pa.binary()),
                    pa.array([w["pos"] for w in want], pa.int32()),
                ],
                names=["h", "block", "ctx", "ctx2", "lo", "body", "doc_id", "part", "pos"],
            )


def _dense(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_inverse=True)[1]


def window_order(bodies: list[bytes], los: list[int], blocks: list[int], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order, truncated at ``length``, of all windows that hold their context's anchor.

    Context i has its anchor of ``k`` bytes at ``los[i]``; only contexts of one block with the same anchor are compared, and a window stands at the
    same place of the anchor in all of them. So the order needs no sorting of whole windows: what stands before the anchor is ranked
    outward a byte at a time (a byte and the rank of what follows it), what stands behind it likewise, and a window's
    key is its two ranks. Returns place (bytes before the anchor) and context of each window in order, ties by context,
    and whether it equals the one before it.
    """
    n, width = len(bodies), length - k
    los, sizes = np.array(los, np.int64), np.array([len(b) for b in bodies], np.int64)
    data = np.frombuffer(b"".join(bodies), np.uint8)
    anchor = np.cumsum(sizes) - sizes + los
    behind = sizes - los - k
    step = np.arange(1, width + 1)

    def around(at: np.ndarray, inside: np.ndarray) -> np.ndarray:
        out = np.full(inside.shape, 256, np.int64)
        out[inside] = data[at[inside]]
        return out

    before = around(anchor[:, None] - step, step <= los[:, None])
    after = around(anchor[:, None] + k - 1 + step, step <= behind[:, None])
    number: dict[tuple, int] = {}
    group = np.array([number.setdefault((b, body[lo : lo + k]), len(number)) for b, body, lo in zip(blocks, bodies, los.tolist(), strict=True)], np.int64)
    left, right = np.empty((width + 1, n), np.int64), np.empty((width + 1, n), np.int64)
    left[0] = right[0] = group
    for j in range(width):
        left[j + 1] = _dense(before[:, j] * n + left[j])
        right[j + 1] = _dense(right[j] * 257 + after[:, j])
    place, context = np.nonzero((np.arange(width + 1)[:, None] <= los) & (width - np.arange(width + 1)[:, None] <= behind))
    key = (place * n + left[place, context]) * n + right[width - place, context]
    order = np.argsort(key, kind="stable")
    key = key[order]
    return place[order], context[order], np.r_[False, key[1:] == key[:-1]][: len(key)]


def factor_arrays(place: np.ndarray, context: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window in suffix order, the contexts of the previous smaller and of the next larger position with an equal window; -1 for none.

    These are the PSV and NLV entries where the longest previous and next factor reach the length: windows equal at that
    length are neighbours in suffix order, and ties stand by position, so the entries are the neighbours themselves.
    """
    earlier = np.where(equal, np.r_[-1, context[:-1]][: len(context)], -1)
    later = np.full(len(context), -1)
    later[:-1] = np.where(equal[1:], context[1:], -1)
    return earlier, later


def factors(bodies: list[bytes], los: list[int], blocks: list[int], length: int, k: int, keep_first: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each context the offsets (from its start) of windows with an equal window in another context of its block (an earlier
    one, where the first is kept), and the offsets of windows that the block must show to other blocks: one of each class."""
    place, context, equal = window_order(bodies, los, blocks, length, k)
    earlier, later = factor_arrays(place, context, equal)
    at = np.array(los)[context] - place if len(context) else place

    def of_each(chosen: np.ndarray) -> list[np.ndarray]:
        who, where = context[chosen], at[chosen]
        order = np.lexsort((where, who))
        return np.split(where[order], np.searchsorted(who[order], np.arange(1, len(bodies))))

    hit = earlier >= 0 if keep_first else (earlier >= 0) | (later >= 0)
    return of_each(hit), of_each(earlier < 0)


def _runs(at: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that start at the given offsets."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + length).tolist(), strict=True))


def _sort_pass(length: int, k: int, keep_first: bool):
    """Contexts sorted by (h, block, place) to covered runs (relative to the anchor) and, for cut anchors, open windows."""
    run_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    open_type = pa.list_(pa.struct([("s", pa.int32()), ("w", pa.binary())]))

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        number, blocks = {}, []
        for h, block, *_ in rows:
            blocks.append(number.setdefault((h, block), len(number)))
        found, shown = factors([r[5] for r in rows], [r[4] for r in rows], blocks, length, k, keep_first)
        runs, opens = [], []
        for (_, block, _, _, lo, body, *_), at, rest in zip(rows, found, shown, strict=True):
            runs.append([{"a": a - lo, "b": b - lo} for a, b in _runs(at, length)])
            opens.append([{"s": s - lo, "w": hashlib.blake2b(body[s : s + length], digest_size=16).digest()} for s in rest.tolist()] if block >= 0 else [])
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array([r[c] for r in rows], pa.int64()) for c in (0, 2, 3)), pa.array(runs, run_type), pa.array(opens, open_type),
                pa.array([r[6] for r in rows], pa.int64()), pa.array([r[7] for r in rows], pa.binary()), pa.array([r[8] for r in rows], pa.int32()),
            ],
            names=["h", "ctx", "ctx2", "runs", "open", "doc_id", "part", "pos"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "block", "ctx", "ctx2", "lo", "body", "doc_id", "part", "pos")), strict=True):
                if size > 400_000 and row[:2] != rows[-1][:2]:
                    yield settle(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield settle(rows)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove merged runs from whole texts."""
    for batch in batches:
        out = {"sha": [], "n_removed": [], "n_spans": [], "cut_sha": []}
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            raw, at, gone, count, kept = (text or "").encode(), 0, 0, 0, hashlib.sha256()
            whole = hashlib.sha256(raw).digest()
            for a, b in merged([(r["a"], r["b"]) for r in runs if r["part"] == whole[:8]]):
                kept.update(raw[at:a])
                at, gone, count = b, gone + b - a, count + 1
            kept.update(raw[at:])
            for name, value in zip(out, (whole, gone, count, kept.digest()), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out["sha"], pa.binary()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["cut_sha"], pa.binary())],
            names=["doc_id", *out],
        )


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; runs that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_runs(profiles: DataFrame, texts: DataFrame, length: int, anchor: int, block: int, keep_first: bool = False) -> DataFrame:
    """(doc_id, runs) of documents with repeats; a run tells the text that it belongs to.

    Of identical contexts the one of the smallest place (doc_id, text, position) speaks; the others stand behind it and so lose all
    of their windows, the speaker those with an equal window elsewhere, or earlier where the first copy is kept.
    """
    anchors = profiles.filter("doc_id is not null").select("doc_id", F.substring("sha", 1, 8).alias("part"), F.explode("anchors").alias("x")).select("doc_id", "part", "x.*")
    context = ["h", "ctx", "ctx2"]
    kinds = staged(anchors.groupBy(*context).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "part", "pos", "lo", "hi")).alias("rep")), "contexts")
    per_anchor = staged(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("uses")).filter("uses > 1"), "shared-anchors")
    shared = staged(hot_join(kinds, per_anchor, "h", "forms", kinds.count(), F.col("ctx")).select(*context, "n", "forms", "rep"), "shared")
    total = kinds.agg(F.sum("n")).first()[0] or 0
    drop_staged(kinds, per_anchor)
    several = shared.filter("forms > 1").select(
        F.col("rep.doc_id").alias("doc_id"),
        F.struct(
            F.col("rep.part").alias("part"), F.col("rep.pos").alias("pos"), *context, F.col("rep.lo").cast("int").alias("lo"), F.col("rep.hi").cast("int").alias("hi"),
            F.when(F.col("forms") > 2 * block, F.pmod(F.col("ctx"), F.ceil(F.col("forms") / block)).cast("int")).otherwise(-1).alias("block"),
        ).alias("w"),
    )
    want = several.groupBy("doc_id").agg(F.collect_list("w").alias("want"))
    bodies = texts.join(want, "doc_id").mapInArrow(_contexts, "h long, block int, ctx long, ctx2 long, lo int, body binary, doc_id long, part binary, pos int")
    place = ["doc_id", "part", "pos"]
    sorted_runs = staged(
        bodies.repartition("h", "block").sortWithinPartitions("h", "block", *place).mapInArrow(
            _sort_pass(length, anchor, keep_first), f"h long, ctx long, ctx2 long, runs {_RUNS}, open array<struct<s:int,w:binary>>, doc_id long, part binary, pos int"
        ),
        "factors",
    )
    rest = sorted_runs.filter(F.size("open") > 0).select(*context, F.struct(*place).alias("place"), F.explode("open").alias("o")).select(*context, "place", F.col("o.s").alias("s"), F.col("o.w").alias("w"))
    again = rest.groupBy("h", "s", "w").agg(F.count(F.lit(1)).alias("k"), F.min("place").alias("first")).filter("k > 1").drop("k")
    met = rest.join(again, ["h", "s", "w"])
    later = (met.filter(F.col("place") != F.col("first")) if keep_first else met).groupBy(*context).agg(F.transform(F.collect_set("s"), lambda s: F.struct(s.alias("a"), (s + length).alias("b"))).alias("more"))
    none = F.array().cast(_RUNS)
    whole = F.array(F.struct((-F.col("rep.lo")).cast("int").alias("a"), F.col("rep.hi").cast("int").alias("b")))
    some = F.concat(F.coalesce("runs", none), F.coalesce("more", none))
    speaks = F.when(F.col("n") > 1, whole).otherwise(some) if not keep_first else some
    decided = staged(
        shared.join(sorted_runs.select(*context, "runs"), context, "left").join(later, context, "left").select(
            *context, "n", F.struct(*[F.col(f"rep.{c}").alias(c) for c in place]).alias("first"), speaks.alias("first_runs"), whole.alias("all_runs"),
        ).filter((F.col("n") > 1) | (F.size("first_runs") > 0)).dropDuplicates(context),
        "decided",
    )
    drop_staged(sorted_runs, shared)
    return (
        hot_join(anchors, decided, context, "n", total, F.struct("doc_id", "pos"))
        .withColumn("runs", F.when(F.struct(*place) == F.col("first"), F.col("first_runs")).otherwise(F.col("all_runs")))
        .select("doc_id", F.transform("runs", lambda r: F.struct(F.col("part").alias("part"), (F.col("pos") + r["a"]).alias("a"), (F.col("pos") + r["b"]).alias("b"))).alias("runs"))
        .groupBy("doc_id")
        .agg(F.flatten(F.collect_list("runs")).alias("runs"))
    )


def deduplicate(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, block: int = BLOCK, keep_first: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    All copies go; with ``keep_first`` the first of each string (smallest doc_id, then position) stays, and rows repeated with id and
    text are one document.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    profiles = staged(texts.mapInArrow(_anchor_pass(length, anchor), f"doc_id long, n_bytes long, sha binary, anchors {_PLACE}"), "anchors")
    runs = staged(repeated_runs(profiles, texts, length, anchor, block, keep_first), "runs")
    cut = texts.join(runs, "doc_id").mapInArrow(_cut, "doc_id long, sha binary, n_removed long, n_spans long, cut_sha binary").dropDuplicates(["doc_id", "sha"])
    return profiles.select("doc_id", "n_bytes", "sha").join(cut, ["doc_id", "sha"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.lower(F.hex(F.coalesce("cut_sha", "sha"))).alias("kept_sha256"),
    )
