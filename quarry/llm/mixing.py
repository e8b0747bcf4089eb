"""Mixing sources to target weights by systematic sampling.

Sources get shares of a budget by weight, no more than a multiple of what they hold; what is over goes to the others by
weight (water filling, in closed form over one row per source). A document's expected copies are its source's target over its
source's size. Within a source, documents are ranked by size, the expected copies are summed along the ranks, one random offset
(a digest of the seed and the source) is added, and a document is emitted once per whole number that the sum crosses: the copies of
one document are the expected number rounded down or up, and since neighbours are alike in size, the words taken miss the target
by about one largest document at most. Ranks are prefix sums over range partitions, so a source with any share of the rows is
spread over many tasks; only the table of sources (one short row each) is ordered in one task.

Defined results: null text has size 0 and may be emitted like others of its source; a null source is a source of its own, last in
order; a source of size 0 has target 0 and no copies; documents of equal size are ranked by doc_id (null first); repeated rows are
separate documents; very long texts count whole; an empty table gives no rows; other columns are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running

#: Weights of the sources in order, repeated; the budget as a share of all sizes; the most copies of a source.
WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2.0, 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size to the same with weight and target; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("cap") * F.col("left") <= F.col("weight") * (F.col("budget") - F.col("before"))
    rest = F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).over(every)
    caps = sources.withColumn("weight", dealt).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("budget", share * F.sum("source_size").over(every).cast("double"))
    levels = caps.withColumns({"before": before, "left": left}).withColumn("full", full)
    return levels.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rest / open_weight)).select("source", "source_size", "weight", "target")


def offset(source: Column, seed: int = SEED) -> Column:
    """A number from 0 to below 1 that depends on the seed and the source only."""
    named = F.concat(F.lit(str(seed)), F.coalesce(F.concat(F.lit(":"), source), F.lit("")))
    return F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def copies(docs: DataFrame, size: Column, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source and any other columns) with ``mix``, in place of a column of that name: a struct of size, source_size, target and copies."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    keyed = docs.select(F.struct(*[c for c in docs.columns if c.lower() != "mix"]).alias("_doc"), F.col("doc_id").alias("_id"), size.alias("_size"), F.lit(1).cast("long").alias("_one"), key.alias("_key"))
    ranked = running(keyed, ["_key"], ["_size", "_id"], ["_one", "_size"], "mix")
    key = F.col("_key")
    sources = ranked.totals().select(F.when(key != "", F.substr(key, F.lit(2))).alias("source"), F.col("_size").alias("source_size"), key)
    aimed = source_targets(sources, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    aimed = aimed.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key"), F.struct("source_size", "target", rate.alias("rate"), offset(F.col("source"), seed).alias("offset")).alias("_aim"))
    rows = ranked.joined(ranked.parts.join(aimed, "_key"))
    reached = lambda n: F.floor(F.col("_aim.rate") * n + F.col("_aim.offset"))
    n = F.col("_run__one")
    taken = (reached(n) - reached(n - 1)).cast("long")
    return rows.select("_doc.*", F.struct(F.col("_size").alias("size"), "_aim.source_size", "_aim.target", taken.alias("copies")).alias("mix"))


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus itself: every document as often as it is taken, with ``copy_no`` from 1."""
    named = copies(docs, word_count(F.col("text")), weights, share, most, seed).filter("mix.copies > 0")
    return named.select(*[c for c in docs.columns if c.lower() not in ("mix", "copy_no")], F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies"))).alias("copy_no"))
