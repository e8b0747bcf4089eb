"""Near-duplicate classes by ProbMinHash.

A text is the weighted set of its five-word shingles, weighted by count. Each shingle sends exponential
arrivals at its rate to random registers, in order, and stops as soon as its next arrival is later than
the latest register (early termination); two texts agree in a register with their probability Jaccard.
Signatures are banded, banded candidates are verified by the exact probability Jaccard of their shingles,
and verified links make classes.

How it stays bounded: texts with the same word sequence collapse to one representative first; buckets of up to
``SMALL_BUCKET`` representatives emit their pairs. Members of larger buckets carry a sketch, one byte of each of ``SKETCH``
ProbMinHash registers, whose agreement estimates the similarity. They meet a few heads of their bucket first, then one
another block by block; a pair is emitted only where the sketches leave a link possible and the two are not in one class yet.
So a group of n copies makes about n pairs, and texts that share a passage but no link make hardly any.

Defined results: null or wordless texts have no shingles and are classes of their own; so is a row without an id (its
class_id is null, it is kept); a text of one to four words is one shingle; ties go to the smallest id; rows under one id
are one document, for which the text of the smallest digest speaks; the shingles and registers of a very long text are held whole by one task; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, fmix, holding, hot_join, slices, staged, utf8, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
SMALL_BUCKET = 32
#: Larger buckets: heads that all members meet before they meet one another, rows of a block, registers of a sketch and
#: how many standard deviations below the threshold a sketch must say before a pair is refuted (1 in 300,000 at 4.5).
HEADS, BLOCK, SKETCH, SIGMAS = 4, 1024, 768, 4.5
#: A bucket has at most so many blocks while they are at most so many times as wide.
PARTS, WIDEST = 64, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xD6E8FEB86659FD93)


def shingles(hashes: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text with their counts: text number, hash, weight, ordered by both."""
    counts = np.bincount(docs, minlength=n_docs)
    first = np.cumsum(counts) - counts
    acc = np.zeros(len(hashes), dtype=np.uint64)
    position = np.arange(len(hashes)) - first[docs]
    short = counts < SHINGLE
    width = np.where(short[docs], counts[docs], SHINGLE)
    heads = np.flatnonzero(position + width <= counts[docs])
    for k in range(SHINGLE):
        use = heads[width[heads] > k]
        acc[use] = fmix(acc[use] * _FOLD + hashes[use + k])
    value, owner = acc[heads], docs[heads]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(value)))


def signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """ProbMinHash signature of every text; rows of texts without shingles stay zero.

    A few arrivals of every shingle are drawn at a time; those later than the latest register change nothing.
    """
    best = np.full(n_docs * registers, np.inf)
    who = np.zeros(n_docs * registers, dtype=np.uint64)
    arrival, seed = np.zeros(len(value)), value.copy()
    latest = np.full(n_docs, np.inf)
    ahead = int(np.clip(registers * np.log(registers) * n_docs / max(len(value), 1) / 4, 1, 16))
    steps = np.arange(1, ahead + 1, dtype=np.uint64) * _STEP
    while len(value):
        draw = fmix(seed[:, None] + steps)
        gap = -np.log((np.right_shift(draw, np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        times = arrival[:, None] + np.cumsum(gap, axis=1)
        row, col = np.nonzero(times < latest[owner][:, None])
        when = times[row, col]
        slot = owner[row] * registers + (fmix(draw[row, col] ^ _FOLD) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, slot, when)
        won = best[slot] == when
        who[slot[won]] = value[row[won]]
        latest = best.reshape(n_docs, registers).max(axis=1)
        arrival, seed = times[:, -1], seed + steps[-1]
        live = arrival < latest[owner]
        owner, value, weight, arrival, seed = (x[live] for x in (owner, value, weight, arrival, seed))
    return who.reshape(n_docs, registers)


def _profile(bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.binary()), ("n_shingles", pa.int32()), ("size", pa.int32()), ("bands", pa.list_(pa.int64()))])

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("near_dedup")
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column("text"))
            n = part.num_rows
            hashes, docs = word_hashes(data, offsets)
            owner, value, weight = shingles(hashes, docs, n)
            size = np.bincount(owner, minlength=n)
            flat = np.bincount(owner, weight, minlength=n) == size  # every shingle once
            sig = signatures(owner, value, weight, n, bands * rows).reshape(n, bands, rows)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _STEP, (n, bands)).copy()
            for r in range(rows):
                key = fmix(key * _FOLD + sig[:, :, r])
            keys = key.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(word_digests(hashes, docs, n), pa.binary()),
                    pa.array(size, pa.int32()),
                    pa.array(np.where(flat, size, 0), pa.int32()),
                    pa.array([k if s else [] for k, s in zip(keys, size.tolist(), strict=True)], pa.list_(pa.int64())),
                ],
                schema=schema,
            )

    return profile


def word_digests(hashes: np.ndarray, docs: np.ndarray, n: int) -> list[bytes]:
    """128-bit digest of every text's word sequence."""
    marks = [0, *(8 * np.cumsum(np.bincount(docs, minlength=n))).tolist()]
    raw = hashes.tobytes()
    return [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(marks, marks[1:], strict=False)]


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, shingles, weights (empty where all are 1) and, where ``wide``, a sketch: one byte of each of ``SKETCH`` registers."""
    holding("near_dedup")
    for part in slices(batches, "text", max_rows=512):
        n = part.num_rows
        data, offsets = utf8(part.column("text"))
        hashes, docs = word_hashes(data, offsets)
        owner, value, weight = shingles(hashes, docs, n)
        cut = np.searchsorted(owner, np.arange(n + 1))
        wide = np.asarray(part.column("wide").to_pylist(), dtype=bool)
        number = np.cumsum(wide) - 1
        use = wide[owner]
        registers = signatures(number[owner[use]], value[use], weight[use], int(wide.sum()), SKETCH)
        packed = [row.tobytes() for row in fmix(registers).astype(np.uint8)]
        same = np.array([a == b for a, b in zip(word_digests(hashes, docs, n), part.column("words").to_pylist(), strict=True)], dtype=bool)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array([value[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                pa.array([weight[a:b].astype(np.int32).tobytes() if (weight[a:b] > 1).any() else b"" for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                pa.array([packed[k] if w else None for k, w in zip(number.tolist(), wide.tolist(), strict=True)], pa.binary()),
            ],
            names=["doc_id", "shingles", "weights", "sketch"],
        ).filter(pa.array(same))


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard of two sorted weighted sets; with equal weights it is the Jaccard index."""
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if (x == 1).all() and (y == 1).all():
        return len(common) / (len(a) + len(b) - len(common))
    cx, cy = x[ia].astype(float), y[ib].astype(float)
    ratio = cy / cx
    order = np.argsort(ratio, kind="stable")
    ratio, cx, cy = ratio[order], cx[order], cy[order]
    above_y = np.append(np.cumsum(cy[::-1])[::-1], 0.0) + (y.sum() - cy.sum())
    below_x = np.append(0.0, np.cumsum(cx)) + (x.sum() - cx.sum())
    at = np.arange(len(ratio))
    return float((1.0 / (above_y[at] / cy + below_x[at] / cx)).sum())


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with their two weighted sets to pairs with their similarity."""
    holding("near_dedup")
    weights = lambda raw, n: np.frombuffer(raw, np.int32) if len(raw) else np.ones(n, np.int32)
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for i, (a, x, b, y) in enumerate(zip(*(batch.column(c) for c in ("sa", "wa", "sb", "wb")), strict=True)):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            out[i] = probability_jaccard(a, weights(x.as_buffer(), len(a)), b, weights(y.as_buffer(), len(b)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], names=["a", "b", "similarity"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their exact similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    joined = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return joined.select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(_similarity, "a long, b long, similarity double")


def fits(x: Column, y: Column, threshold: float) -> Column:
    """False for sizes that no similarity of the threshold allows; size 0 is a text with weights, of which sizes say nothing."""
    return (x == 0) | (y == 0) | (F.least(x, y) >= F.greatest(x, y) * threshold - 1e-9)


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def least_agreement(threshold: float) -> float:
    """How many registers of two sketches agree at least where their similarity reaches the threshold, but for ``SIGMAS`` deviations."""
    return SKETCH * threshold - SIGMAS * (SKETCH * threshold * (1 - threshold)) ** 0.5


def _meet(threshold: float):
    """Rows of a bucket's cells, sorted by (key, cell), to pairs of different classes that sizes and sketches allow."""
    agree = least_agreement(threshold)

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        own, id_, size, class_ = (rows[c].to_numpy() for c in ("own", "id", "size", "class"))
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(own), -1)
        keys, here = rows["keys"].to_pylist(), rows["key"][0].as_py()
        low, high = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        left, right = [], []
        for i in low.tolist():
            mates = high[high > i] if own[i] == own.max() else high
            small, large = np.minimum(size[mates], size[i]), np.maximum(size[mates], size[i])
            mates = mates[(class_[mates] != class_[i]) & ((small == 0) | (small >= large * threshold - 1e-9))]
            mates = mates[(sketch[mates] == sketch[i]).sum(axis=1) >= agree]
            mine = set(keys[i])
            for j in mates.tolist():
                if min(mine.intersection(keys[j])) == here:  # of several shared buckets the first makes the pair
                    left.append(int(min(id_[i], id_[j])))
                    right.append(int(max(id_[i], id_[j])))
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("near_dedup")
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column("key").to_numpy(), batch.column("cell").to_numpy().astype(np.int64)], axis=1)
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if held and (held[-1].column("key")[0] != part.column("key")[0] or held[-1].column("cell")[0] != part.column("cell")[0]):
                    yield pairs(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def candidate_links(members: DataFrame, sets: DataFrame, threshold: float, small: int, heads: int = HEADS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) among bucket members (key, id, size, n), and the class (id, root) of every linked one.

    With them every pair of a bucket is linked, in one class, or refuted.

    Small buckets are compared in full, and all members of a larger one with its ``heads`` heads, the texts that stand in most
    such buckets. A bucket that one class then holds is settled; in the others members of different classes, linked before or
    not, are compared wherever sizes and sketches allow a link. Buckets meet themselves block by block, so none is one task.
    """
    little = members.filter(F.col("n") <= small)
    left = little.select("key", F.col("id").alias("a"), F.col("size").alias("x"))
    right = little.select("key", F.col("id").alias("b"), F.col("size").alias("y"))
    pairs = left.join(right, "key").filter((F.col("a") < F.col("b")) & fits(F.col("x"), F.col("y"), threshold)).select("a", "b")
    large = members.filter(F.col("n") > small)
    keys = large.groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    sketch = sets.filter("sketch is not null").select(F.col("doc_id").alias("id"), "sketch")
    rest = staged(large.select("key", "id", "size").join(keys, "id").join(sketch, "id"), "large-buckets")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.size("keys")), "id"))
    chosen = rest.select("key", "id", "size", "keys").withColumn("place", place).filter(F.col("place") <= heads).select("key", F.col("id").alias("head"), F.col("size").alias("x"))
    led = rest.select("key", "id", "size").join(chosen, "key").filter((F.col("id") != F.col("head")) & fits(F.col("x"), F.col("size"), threshold)).select(*ordered("id", "head"))
    pairs = staged(pairs.union(led).distinct(), "pairs")
    first = staged(compared(pairs, sets).filter(F.col("similarity") >= threshold), "links")
    drop_staged(pairs)
    label = staged(components(first), "labels")
    own_rows = rest
    rest = rest.join(label.withColumnRenamed("root", "class"), "id", "left").withColumn("class", F.coalesce("class", "id"))
    mixed = rest.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count(F.lit(1)).alias("n")).filter("least <> most").select("key", "n")
    # block i of a bucket meets block j >= i in cell (i, j); blocks grow with the bucket, up to a limit, so that few copies of a row are dealt out
    parts = F.ceil(F.col("n") / F.least(F.greatest(F.lit(block), F.col("n") / PARTS), F.lit(WIDEST * block))).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j))
    spread = rest.join(mixed, "key").select("key", F.explode(cells).alias("cell"), own.alias("own"), "id", "size", "class", "keys", "sketch")
    met = staged(spread.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_meet(threshold), "a long, b long"), "pairs")
    second = staged(compared(met, sets).filter(F.col("similarity") >= threshold), "links")
    drop_staged(met, own_rows)
    # the few links between classes merge them
    root = lambda c, r: label.select(F.col("id").alias(c), F.col("root").alias(r))
    between = second.join(root("a", "p"), "a", "left").join(root("b", "q"), "b", "left").select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b"))
    merged = staged(components(between), "merged")
    nodes = label.union(second.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(label, "id", "left_anti").select("id", F.col("id").alias("root")))
    return first.union(second), relabelled(nodes, merged)


def components(links: DataFrame) -> DataFrame:
    """(id, root) with the smallest id of each connected component, by contraction.

    Each round every node hooks onto its smallest neighbour, pointers are followed, and links move to the roots; links
    within a root go, so a star leaves after a round or two and what is left shrinks by half at least.
    """
    label = None
    edges = staged(links.select(*ordered("a", "b")).filter("a <> b").distinct(), "edges")
    while label is None or not edges.isEmpty():
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).union(edges.select("b", "a"))
        hooked = staged(ends.groupBy("id").agg(F.least(F.min("near"), F.col("id")).alias("up")), "hooked")
        above = hooked.select(F.col("id").alias("up"), F.col("up").alias("over"))
        twice = hooked.join(above, "up").select("id", F.col("over").alias("up")).join(above, "up").select("id", F.col("over").alias("root"))
        roots = staged(twice, "roots")
        moved = edges.join(roots.select(F.col("id").alias("a"), F.col("root").alias("p")), "a").join(roots.select(F.col("id").alias("b"), F.col("root").alias("q")), "b")
        following = staged(moved.select(*ordered("p", "q")).filter("a <> b").distinct(), "edges")
        label = roots if label is None else relabelled(label, roots)
        drop_staged(edges, hooked)
        edges = following
    return label


def relabelled(label: DataFrame, roots: DataFrame) -> DataFrame:
    """Labels (id, root) after their roots were given roots of their own."""
    return label.join(roots.select(F.col("id").alias("root"), F.col("root").alias("over")), "root", "left").select("id", F.coalesce("over", "root").alias("root"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, small: int = SMALL_BUCKET, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), n_links of its representative, kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    profiles = staged(
        texts.mapInArrow(_profile(bands, rows), "doc_id long, words binary, n_shingles int, size int, bands array<long>"), "profiles"
    )
    shaped = profiles.select("doc_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("words")).alias("words"))
    groups = staged(
        profiles.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("words").agg(F.min(F.struct("doc_id", "size", "bands")).alias("best"), F.count(F.lit(1)).alias("copies")).select(
            "words", "copies", F.col("best.doc_id").alias("rep"), F.col("best.size").alias("size"), F.col("best.bands").alias("bands")
        ),
        "classes",
    )
    members = groups.select(F.explode("bands").alias("key"), F.col("rep").alias("id"), "size", "words")
    busy = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key")
    busy = staged(busy, "members")
    # of several texts under one id that of the smallest digest speaks for it
    wanted = busy.groupBy(F.col("id").alias("doc_id")).agg(F.min("words").alias("words"), (F.max("n") > small).alias("wide"))
    sets = staged(texts.join(wanted, "doc_id").mapInArrow(_shingle_sets, "doc_id long, shingles binary, weights binary, sketch binary").dropDuplicates(["doc_id"]), "shingles")
    spoken = wanted.select(F.col("doc_id").alias("id"), "words")
    links, roots = candidate_links(busy.join(spoken, ["id", "words"], "left_semi").drop("words"), sets, threshold, small, block=block)
    links, roots = links.select("a", "b").distinct(), staged(roots, "classes")
    drop_staged(sets, busy)
    degree = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").count()
    reps = staged(
        groups.select("words", "copies", "rep")
        .join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        .join(degree, "rep", "left")
        .select("words", "copies", F.coalesce("root", "rep").alias("class_id"), F.coalesce("count", F.lit(0)).cast("long").alias("n_links")),
        "representatives",
    )
    placed = hot_join(shaped.filter("words is not null"), reps, "words", "copies", profiles.count(), F.col("doc_id"))
    return placed.select("doc_id", "class_id", "n_links").union(
        shaped.filter("words is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
