"""Conversation prefix trie by collapsing whole sequences.

A prefix of a conversation is named by sums: each turn adds the 32-bit pieces of a digest of its depth, role and text, so the name
of every prefix is a prefix sum and no task needs a whole conversation. Identical conversations are grouped into one weighted
sequence, which keeps the smallest id and the list of ids that end there; a sequence that is a proper prefix of another one
(found by an anti-join on names) is no leaf; the prefixes of the weighted sequences are then summed into nodes.

What sharing saves in a subtree needs no tree walk. The bytes of all conversations below a node come from the weighted
sequences. The bytes of its distinct texts come from the leaves: each node is owned by the smallest leaf below it, the
nodes of one owner are the end of its path, and a leaf adds the bytes of its path from the later of the node and its first own node.

The list of ids that end at a sequence is hashed in order: blocks of it are formed in many tasks from ranges of (sequence, id), and
a stream of constant memory joins the blocks. Joins on a parent or a sequence salt hot keys.

Defined results: null roles and texts are empty; rows without a conv_id are no conversation; turns are ordered by number (null first),
those with the same number by the digest of role and text, repeated rows are kept; very long texts count by digest and bytes; a conversation
without turns ends at the root; an empty table has no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, running, staged

#: Conversations whose ids agree but for the remainder of this share the first turns of the first of them; so many at most, plus one.
FAMILY, SHARED = 5, 9
PIECES = ("_k0", "_k1", "_k2", "_k3")
#: Characters of a block of ids.
BLOCK = 1 << 16


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), n_bytes (of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.sha2(whole, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def shared_turns(conv_id: Column) -> Column:
    return F.crc32(F.encode(conv_id.cast("string"), "UTF-8")) % SHARED


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, digest, n_bytes: each conversation begins with turns of the first of its family; depth 0 is a row without a digest."""
    ranked = running(turns(conversations).withColumn("_one", F.lit(1).cast("long")), ["conv_id"], ["turn", "digest"], ["_one"], "turns")
    own = ranked.totals().withColumns({"first": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": shared_turns(F.col("conv_id"))})
    base = ranked.totals().select(F.col("conv_id").alias("first"), F.col("_one").alias("n_first"))
    families = own.join(base, "first", "left").select("conv_id", "first", "h", F.least("h", F.coalesce("n_first", F.lit(0))).alias("n_shared"))
    families = staged(families, "families")
    rows = staged(ranked.joined(ranked.parts.join(families, "conv_id")), "ranked")
    kept = rows.filter("_run__one > h").select("conv_id", (F.col("n_shared") + F.col("_run__one") - F.col("h")).alias("depth"), "digest", "n_bytes")
    heads = rows.filter(F.col("_run__one") < SHARED).select(F.col("conv_id").alias("first"), F.col("_run__one").alias("depth"), "digest", "n_bytes")
    borrowed = families.join(heads, "first").filter("depth <= h").select("conv_id", "depth", "digest", "n_bytes")
    roots = families.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
    return kept.unionByName(borrowed).unionByName(roots)


def _name(depth: Column, pieces: list[Column]) -> Column:
    return F.md5(F.concat_ws(".", depth.cast("string"), *[p.cast("string") for p in pieces]).cast("binary"))


def _ends_digest(members: DataFrame) -> DataFrame:
    """seq, conv_id to seq and the digest of its ids in ascending order, decimal, comma-joined."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, part, n, ids, chars = None, None, 0, [], 0

        def block():
            return pa.RecordBatch.from_pydict({"seq": [seq], "part": [part], "n": [n], "ids": [",".join(ids)]}, schema=pa.schema([("seq", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("ids", pa.string())]))

        for batch in batches:
            for name, where, conv in zip(*(batch.column(c).to_pylist() for c in ("seq", "part", "conv_id")), strict=True):
                if ids and (name != seq or chars > BLOCK):
                    yield block()
                    n, ids, chars = (n + 1 if name == seq else 0), [], 0
                seq, part = name, where
                ids.append(str(conv))
                chars += len(ids[-1]) + 1
        if ids:
            yield block()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"seq": [d[0] for d in done], "ends_sha256": [d[1] for d in done]}, schema=pa.schema([("seq", pa.string()), ("ends_sha256", pa.string())]))
        if now is not None:
            yield pa.RecordBatch.from_pydict({"seq": [now], "ends_sha256": [state.hexdigest()]})

    dealt = members.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").withColumn("part", F.spark_partition_id())
    listed = dealt.mapInArrow(blocks, "seq string, part int, n long, ids string")
    return listed.repartition("seq").sortWithinPartitions("seq", "part", "n").select("seq", "ids").mapInArrow(digests, "seq string, ends_sha256 string")


def trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of ``sequences`` (conv_id, depth, digest, n_bytes; depth 0 has no digest).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    pieces = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), F.col("digest")), 256)
    piece = lambda i: F.when(F.col("digest").isNull(), F.lit(0).cast("long")).otherwise(F.conv(F.substring("_of", 8 * i + 1, 8), 16, 10).cast("long"))
    turned = sequences.withColumn("_of", pieces).withColumns({k: piece(i) for i, k in enumerate(PIECES)}).withColumn("_turn", F.col("digest").isNotNull().cast("long")).drop("_of", "digest")
    sums = [*PIECES, "_turn", "n_bytes"]
    summed = running(turned, ["conv_id"], ["depth"], sums, "prefixes")

    members = summed.totals().select("conv_id", _name(F.col("_turn"), [F.col(k) for k in PIECES]).alias("seq"), F.col("_turn").alias("length"), F.col("n_bytes").alias("seq_bytes"))
    members = staged(members, "members")
    weighted = members.groupBy("seq").agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"))
    first = members.join(weighted, ["seq", "conv_id"])  # one conversation stands for its sequence
    rows = summed.joined(summed.parts.join(first, "conv_id"))
    run = [F.col(f"_run_{k}") for k in PIECES]
    rows = rows.select(
        "conv_id", "seq", "length", "seq_bytes", "weight", "depth", "n_bytes", (F.col("_run_n_bytes") - F.col("n_bytes")).alias("before"), _name(F.col("depth"), run).alias("node"),
        F.when(F.col("depth") > 0, _name(F.col("depth") - 1, [r - F.col(k) for r, k in zip(run, PIECES, strict=True)])).alias("parent"),
    )
    rows = staged(rows, "sequences")
    total = rows.count()

    proper = rows.filter("depth < length").select(F.col("node").alias("seq")).distinct()
    leaves = first.select("seq", "length").join(proper, "seq", "left_anti").withColumn("leaf", F.lit(1).cast("long"))
    marked = hot_join(rows, leaves.withColumn("_rows", F.col("length") + 1).select("seq", "leaf", "_rows"), "seq", "_rows", total, F.col("depth"), "left").drop("_rows")
    marked = staged(marked, "marked")
    nodes = marked.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("before").alias("before"), F.sum("weight").alias("n_convs"),
        F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("seq"))).alias("owner"), F.sum(F.col("weight") * F.col("seq_bytes")).alias("all_bytes"),
    )
    nodes = staged(nodes, "nodes")
    n_nodes = nodes.count()

    owned = nodes.groupBy(F.col("owner").alias("seq")).agg(F.min("before").alias("own_from"))
    owned = owned.join(first.select("seq", (F.col("length") + 1).alias("_rows")), "seq")
    distinct = hot_join(marked.filter("leaf = 1"), owned, "seq", "_rows", total, F.col("depth"))
    distinct = distinct.groupBy("node").agg(F.sum(F.col("seq_bytes") - F.greatest("before", "own_from")).alias("distinct_bytes"))
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select("node", F.col("conv_id").alias("parent_conv_id")).join(children, "node").withColumnRenamed("node", "parent").withColumnRenamed("n_children", "_children")
    named = hot_join(nodes, parents, "parent", "_children", n_nodes, F.col("node"), "left")
    whole = named.join(distinct, "node").join(children, "node", "left").join(_ends_digest(members).withColumnRenamed("seq", "node"), "node", "left")
    saved = F.col("all_bytes") - F.col("n_convs") * F.col("before") - F.col("distinct_bytes")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
