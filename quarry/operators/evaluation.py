"""Evaluation metrics and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_at_k(evidence: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """(question_id, hit) of answerable questions: known evidence (question_id, repository_id, relative_path, start_line,
    end_line) overlaps one of the first k chunks (question_id, repository_id, relative_path, start_line, end_line, rank)."""
    top = ranked.filter(F.col("rank") <= k).select("question_id", "repository_id", "relative_path", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    hits = evidence.join(top, ["question_id", "repository_id", "relative_path"]).filter("a <= end_line and start_line <= b").select("question_id").distinct().withColumn("h", F.lit(True))
    return evidence.select("question_id").distinct().join(hits, "question_id", "left").select("question_id", F.coalesce("h", F.lit(False)).alias("hit"))


def recall(hits: DataFrame) -> DataFrame:
    return hits.agg(F.avg(F.col("hit").cast("double")).alias("recall"), F.count(F.lit(1)).alias("n"))


def answer_support_rates(judgements: DataFrame) -> DataFrame:
    """Share of supported answerable answers and of flagged unanswerable questions (answerable, supported, flagged)."""
    return judgements.agg(
        F.avg(F.when(F.col("answerable"), F.col("supported").cast("double"))).alias("support_rate"),
        F.avg(F.when(~F.col("answerable"), F.col("flagged").cast("double"))).alias("unanswerable_rate"),
        F.count(F.lit(1)).alias("n"),
    )


def detection_precision_recall(predicted: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Counts, precision and recall of predicted keys against labelled keys."""
    both = predicted.select(key, F.lit(True).alias("p")).distinct().join(labels.select(key, F.lit(True).alias("t")).distinct(), key, "full")
    counts = both.agg(F.count_if(F.col("p") & F.col("t")).alias("tp"), F.count_if(F.col("p") & F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull() & F.col("t")).alias("fn"))
    return counts.select("tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"))


#: Metric, the event that starts it, and the one that ends it.
LATENCIES = (("first_text", "question.accepted", "answer.delta"), ("completion", "question.accepted", "answer.completed"), ("retrieval", "question.accepted", "answer.sources"))


def next_events(events: DataFrame, pairs: tuple[tuple[str, str, str], ...] = LATENCIES) -> DataFrame:
    """(metric, request_id, started_ms, latency_ms): of each starting event the first ending one of its request at or after it, null where none came.

    ``events`` are raw envelopes (event_id, request_id, timestamp_ms, type, payload). One sort of each request's events serves
    all pairs: a window from the row to the end knows the next time of every kind. Events of one time count in the order of their
    ids; a text that is blank is not yet useful and ends nothing. A start before another start has the same end as that one.
    """
    order = Window.partitionBy("request_id").orderBy("timestamp_ms", "event_id").rowsBetween(0, Window.unboundedFollowing)
    useful = (F.col("type") != "answer.delta") | (F.trim("payload") != "")
    ends = {kind: F.min(F.when((F.col("type") == kind) & useful, F.col("timestamp_ms"))).over(order).alias(f"next_{i}") for i, kind in enumerate(sorted({e for _, _, e in pairs}))}
    known = {kind: f"next_{i}" for i, kind in enumerate(sorted(ends))}
    timed = events.select("request_id", "type", "timestamp_ms", *ends.values())
    found = F.array(*[F.when(F.col("type") == start, F.struct(F.lit(metric).alias("metric"), F.col(known[end]).alias("at"))) for metric, start, end in pairs])
    rows = timed.select("request_id", "timestamp_ms", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("p"))
    return rows.select("p.metric", "request_id", F.col("timestamp_ms").alias("started_ms"), (F.col("p.at") - F.col("timestamp_ms")).alias("latency_ms"))


def latency_percentiles(latencies: DataFrame, exact: bool = True) -> DataFrame:
    """(metric, p50, p95, n) of (metric, latency_ms); approximate percentiles for large inputs."""
    at = (lambda q: F.percentile("latency_ms", q)) if exact else (lambda q: F.percentile_approx("latency_ms", q, 10_000))
    return latencies.groupBy("metric").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.count(F.lit(1)).alias("n"))


def gate_report(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """metric, value, target, passed, n; gates have metric, target, at_least."""
    joined = metrics.join(gates, "metric")
    return joined.select("metric", "value", "target", F.when(F.col("at_least"), F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target")).alias("passed"), "n")


def split_leakage(questions: DataFrame) -> DataFrame:
    """Leaked pairs (held_out_id, other_id, other_split) of questions (question_id, split, text): equal but for case and punctuation.

    A text that many questions share gives as many pairs as there are: a held-out one is paired with the smallest id of each other
    split, and ``n_others`` tells how many there are.
    """
    norm = questions.select("question_id", "split", F.trim(F.regexp_replace(F.lower("text"), r"[^a-z0-9]+", " ")).alias("norm"))
    held = norm.filter("split = 'held_out'").select("norm", F.col("question_id").alias("held_out_id"))
    other = norm.filter("split <> 'held_out'").groupBy("norm", F.col("split").alias("other_split")).agg(F.min("question_id").alias("other_id"), F.count(F.lit(1)).alias("n_others"))
    return held.join(other, "norm").select("held_out_id", "other_id", "other_split", "n_others")


def split_counts(questions: DataFrame, least: int = 100) -> DataFrame:
    counts = questions.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("split", "n", ((F.col("split") != "held_out") | (F.col("n") >= least)).alias("enough"))
