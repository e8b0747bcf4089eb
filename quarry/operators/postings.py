"""Vectorised helpers of the term index inside tasks: words of a batch of texts counted by chunk, and the best hits of a partition.

Both are narrow: Spark deals the texts, shuffles the postings and ranks what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text of a slice that is cut into words at a time; candidates of a task that are held before they are cut to the best.
SLICE_BYTES, HELD = 1 << 22, 1 << 21
_WORD = np.zeros(256, bool)
_WORD[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$")] = True
_PARTS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_")


def split_parts(word: str) -> list[str]:
    """Lower-cased parts of a word's identifier (what follows its leading digits), none where there is but one."""
    parts = [p.lower() for p in _PARTS.split(word.lstrip("0123456789")) if p]
    return parts if len(parts) > 1 else []


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text of each slice stays near ``max_bytes`` (one long text may exceed it)."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of the text of each."""
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    ends_at = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_at), pa.py_buffer(np.ascontiguousarray(raw[inside[1:-1]])))
    return words, np.searchsorted(offsets, starts, side="right") - 1


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _split(words: pa.Array, codes: np.ndarray, docs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Parts of the words that have several: their strings, and (text, number of the string) of every word of every text, each once."""
    several = np.flatnonzero(_numbers(pc.match_substring_regex(words, "_|.[A-Z]"))) if len(words) else np.zeros(0, np.int64)
    parts = [split_parts(w) for w in words.take(pa.array(several)).to_pylist()]
    number: dict[str, int] = {}
    flat = np.array([number.setdefault(p, len(number)) for ps in parts for p in ps], np.int64)
    count = np.zeros(len(words), np.int64)
    count[several] = [len(p) for p in parts]
    first = np.cumsum(count) - count
    used = count[codes] > 0
    pairs = np.unique(docs[used] * max(len(words), 1) + codes[used])
    who, word = pairs // max(len(words), 1), pairs % max(len(words), 1)
    n = count[word]
    at = np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    found = np.unique(np.repeat(who, n) * max(len(number), 1) + flat[at])
    return list(number), found // max(len(number), 1), found % max(len(number), 1)


def postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, chunk_id, original, split, path) of (chunk_id, text, segments): one row a term and row, with its uses in each field."""
    for part in slices(batches, "text"):
        words, docs = _words(part.column("text"))
        coded = words.dictionary_encode()
        codes, known = _numbers(coded.indices).astype(np.int64), coded.dictionary
        strings, split_docs, split_codes = _split(known, codes, docs)
        segments = part.column("segments")
        path = pc.list_flatten(segments).cast(pa.large_string())
        terms = pa.concat_arrays([pc.ascii_lower(known), pa.array(strings, pa.large_string()), path]).dictionary_encode()
        ids, terms = _numbers(terms.indices).astype(np.int64), terms.dictionary
        n = max(len(terms), 1)
        low, split_ids, path_ids = np.split(ids, [len(known), len(known) + len(strings)])
        fields = [
            np.unique(docs * n + low[codes], return_counts=True),
            np.unique(split_docs * n + split_ids[split_codes], return_counts=True),
            np.unique(_numbers(pc.list_parent_indices(segments)).astype(np.int64) * n + path_ids, return_counts=True),
        ]
        keys = np.unique(np.concatenate([k for k, _ in fields]))
        counts = []
        for key, count in fields:
            counts.append(np.zeros(len(keys), np.int64))
            counts[-1][np.searchsorted(keys, key)] = count
        yield pa.RecordBatch.from_arrays(
            [terms.take(pa.array(keys % n)).cast(pa.string()), part.column("chunk_id").take(pa.array(keys // n)), *map(pa.array, counts)], names=["term", "chunk_id", "original", "split", "path"]
        )


def lengths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, original, split) of (chunk_id, text): words of each row, and distinct parts of its identifiers."""
    for part in slices(batches, "text"):
        words, docs = _words(part.column("text"))
        coded = words.dictionary_encode()
        _, split_docs, _ = _split(coded.dictionary, _numbers(coded.indices).astype(np.int64), docs)
        sizes = [np.bincount(d, minlength=part.num_rows).astype(np.int32) for d in (docs, split_docs)]
        yield pa.RecordBatch.from_arrays([part.column("chunk_id"), *map(pa.array, sizes)], names=["chunk_id", "original", "split"])


def best_hits(k: int, digits: int):
    """Of (chunk_id, part, queries) rows in order of chunk_id, all of a chunk in one partition: the sums of parts by query and chunk, of which
    each query keeps its ``k`` largest of the partition, ties by smaller chunk_id. What cannot come among a query's best any more is dropped at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict = {}
        least = np.zeros(0)
        held, size, order, rest, kinds = [], 0, 0, None, None

        def cut() -> None:
            nonlocal held, size
            query, score, place, chunk = (np.concatenate(c) for c in zip(*held, strict=True))
            at = np.lexsort((place, -score, query))
            query = query[at]
            new = np.r_[True, query[1:] != query[:-1]]
            rank = np.arange(len(query)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            kept = at[rank < k]
            last = rank == k - 1
            least[query[last]] = score[at][last]
            held = [(query[rank < k], score[kept], place[kept], chunk[kept])]
            size = len(kept)

        def add(rows: pa.RecordBatch, new: np.ndarray) -> None:
            nonlocal least, size, order
            coded = pc.list_flatten(rows.column("queries")).dictionary_encode()
            names = coded.dictionary.to_pylist()
            codes = np.array([number.setdefault(q, len(number)) for q in names], np.int64)
            least = np.r_[least, np.full(len(number) - len(least), -np.inf)]
            firsts = np.flatnonzero(new)
            parent = _numbers(pc.list_parent_indices(rows.column("queries"))).astype(np.int64)
            n = len(firsts)
            cell = _numbers(coded.indices).astype(np.int64) * n + (np.cumsum(new) - 1)[parent]
            score = np.bincount(cell, weights=_numbers(rows.column("part"))[parent], minlength=len(names) * n)
            met = np.flatnonzero(np.bincount(cell, minlength=len(names) * n))
            score, query, chunk = np.round(score[met], digits), codes[met // n], met % n
            good = score >= least[query]
            ids = _numbers(rows.column("chunk_id").take(pa.array(firsts)))
            held.append((query[good], score[good], order + chunk[good], ids[chunk[good]]))
            size, order = size + int(good.sum()), order + n
            if size > max(HELD, 2 * k * len(number)):
                cut()

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = (batch.schema.field("queries").type.value_type, batch.schema.field("chunk_id").type)
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            ids = batch.column("chunk_id")
            new = np.r_[True, _numbers(pc.not_equal(ids[1:], ids[:-1]))]
            last = int(np.flatnonzero(new)[-1])
            rest = batch.slice(last)
            if last:
                add(batch.slice(0, last), new[:last])
        if rest is not None:
            add(rest, np.r_[True, np.zeros(rest.num_rows - 1, bool)])
            cut()
            query, score, _, chunk = held[0]
            names = list(number)
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query.tolist()], kinds[0]), pa.array(chunk.tolist(), kinds[1]), pa.array(score)], names=["query_id", "chunk_id", "score"])

    return run
