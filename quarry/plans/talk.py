"""Queries over transcripts, questions and event logs (batch twins of the streams)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transcripts
from ..session import scratch
from ..sources import repo_tree
from ..streaming import stateful
from ..streaming import transcripts as streams
from .registry import SQL, query, table

OPENINGS = ("What about ", "Walk me through ", "Okay", "So ", "Why ", "")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is one final segment, some with an earlier revision, some repeated; system turns are dropped."""
    n = F.col("conv_id") * 7 + F.col("turn")
    talk = table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')")
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.pmod(n, F.lit(6)) + 1).cast("int"))
    text = F.when(F.pmod(n, F.lit(6)) == 2, F.lit("Okay")).otherwise(F.concat(opening, "text", F.when(F.pmod(n, F.lit(4)) == 1, "?").otherwise("")))
    base = talk.select(
        F.col("conv_id").cast("string").alias("session_id"), F.when(F.col("role") == "user", "call").otherwise("me").alias("source"),
        (F.col("turn") / 5).cast("int").alias("stream_epoch"), F.col("turn").cast("long").alias("sequence"), text.alias("text"),
        (F.col("turn") * 40_000 + F.pmod(n, F.lit(3)) * 30_000).alias("start_ms"), (F.col("turn") * 40_000 + F.pmod(n, F.lit(3)) * 30_000 + 29_700).alias("end_ms"),
        F.lit(True).alias("is_final"), (F.pmod(n, F.lit(3)) != 1).alias("is_turn_end"), F.lit(1).alias("revision"),
    )
    early = base.filter("sequence % 3 = 0").withColumns({"revision": F.lit(0), "text": F.lit("draft"), "is_final": F.col("sequence") % 2 == 0})
    return base.unionByName(early).unionByName(base.filter("sequence % 4 = 1"))


SEGMENTS = f"""
base AS (
  SELECT conv_id::VARCHAR AS session_id, CASE WHEN role = 'user' THEN 'call' ELSE 'me' END AS source, (turn // 5)::INT AS stream_epoch, turn::BIGINT AS sequence,
    CASE WHEN n % 6 = 2 THEN 'Okay' ELSE ([{", ".join(f"'{o}'" for o in OPENINGS)}])[n % 6 + 1] || text || CASE WHEN n % 4 = 1 THEN '?' ELSE '' END END AS text,
    turn * 40000 + n % 3 * 30000 AS start_ms, turn * 40000 + n % 3 * 30000 + 29700 AS end_ms, true AS is_final, n % 3 <> 1 AS is_turn_end, 1 AS revision
  FROM (SELECT *, conv_id * 7 + turn AS n FROM conversations WHERE role IN ('user', 'assistant'))),
segments AS (
  SELECT * FROM base UNION ALL SELECT session_id, source, stream_epoch, sequence, 'draft', start_ms, end_ms, sequence % 2 = 0, is_turn_end, 0 FROM base WHERE sequence % 3 = 0
  UNION ALL SELECT * FROM base WHERE sequence % 4 = 1),
finals AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, source, stream_epoch, sequence ORDER BY revision DESC) AS k FROM segments WHERE is_final) WHERE k = 1),
turn_rows AS (SELECT *, sum(ended) OVER (PARTITION BY session_id, source, stream_epoch ORDER BY sequence ROWS UNBOUNDED PRECEDING)::BIGINT AS turn_id
  FROM (SELECT *, coalesce(lag(is_turn_end::INT) OVER (PARTITION BY session_id, source, stream_epoch ORDER BY sequence), 0) AS ended FROM finals)),
turns AS (SELECT session_id, source, stream_epoch, turn_id, string_agg(text, ' ' ORDER BY sequence) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM turn_rows GROUP BY ALL),
utter_rows AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, source ORDER BY start_ms, stream_epoch, turn_id ROWS UNBOUNDED PRECEDING)::BIGINT AS utterance_id
  FROM (SELECT *, CASE WHEN coalesce(start_ms - max(end_ms) OVER (PARTITION BY session_id, source ORDER BY start_ms, stream_epoch, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 12000, true) THEN 1 ELSE 0 END AS fresh FROM turns)),
utterances AS (SELECT session_id, source, utterance_id, string_agg(text, ' ' ORDER BY start_ms, stream_epoch, turn_id) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM utter_rows GROUP BY ALL)"""
PAUSE = 12_000
_RULES = "CASE WHEN regexp_matches(trim(text), '" + transcripts.ACKNOWLEDGEMENT + "') THEN NULL " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in transcripts.QUESTION_RULES) + " END"
QUESTIONS = f"""{SEGMENTS},
asked AS (SELECT session_id || ':' || utterance_id AS request_id, session_id, text, start_ms, {_RULES} AS matched_rule FROM utterances WHERE source = 'call'),
questions AS (SELECT * FROM asked WHERE matched_rule IS NOT NULL)"""


def _finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.final_segments(segments(spark, sf_dir))


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.debounce_turns(transcripts.assemble_turns(_finals(spark, sf_dir)), PAUSE)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transcripts.question_candidates(_utterances(spark, sf_dir))
    return found.select(F.concat_ws(":", "session_id", F.col("utterance_id").cast("string")).alias("request_id"), "session_id", "text", "start_ms", "matched_rule")


@query(f"WITH {SEGMENTS} SELECT session_id, source, stream_epoch, sequence, text, revision FROM finals")
def t1_final_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finals(spark, sf_dir).select("session_id", "source", "stream_epoch", "sequence", "text", "revision")


@query(f"WITH {SEGMENTS} SELECT DISTINCT session_id, source, stream_epoch, sequence, revision, text FROM segments")
def t2_dedupe_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.dedupe_segments(segments(spark, sf_dir)).select("session_id", "source", "stream_epoch", "sequence", "revision", "text")


@query(f"WITH {SEGMENTS} SELECT session_id, source, stream_epoch, turn_id, text, start_ms, end_ms FROM turns")
def t3_assemble_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.assemble_turns(_finals(spark, sf_dir))


@query(f"WITH {SEGMENTS} SELECT session_id, source, utterance_id, text, start_ms, end_ms FROM utterances")
def t4_debounce_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utterances(spark, sf_dir)


@query(f"""WITH {SEGMENTS} SELECT session_id, source, gap_start, gap_end, kind FROM (
  SELECT session_id, source, lag(end_ms) OVER w AS gap_start, start_ms AS gap_end, CASE WHEN lag(stream_epoch) OVER w <> stream_epoch THEN 'epoch' WHEN sequence > lag(sequence) OVER w + 1 THEN 'sequence' END AS kind
  FROM finals WINDOW w AS (PARTITION BY session_id, source ORDER BY stream_epoch, sequence)) WHERE kind IS NOT NULL""")
def t5_transcript_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.transcript_gaps(_finals(spark, sf_dir))


@query(f"WITH {QUESTIONS} SELECT request_id, session_id, text, start_ms, matched_rule FROM questions")
def t6_question_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir)


@query(f"""WITH {QUESTIONS}, asked_again AS (SELECT request_id, session_id, text, start_ms FROM questions UNION ALL SELECT request_id || '-r', session_id, ' - ' || text || ' !', start_ms + CASE WHEN length(text) % 2 = 0 THEN 50000 ELSE 150000 END FROM questions)
SELECT request_id, text, start_ms FROM (SELECT *, lag(start_ms) OVER (PARTITION BY session_id, norm ORDER BY start_ms, request_id) AS before
  FROM (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS norm FROM asked_again)) WHERE before IS NULL OR start_ms - before > 100000""")
def t7_dedupe_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.dedupe_questions(_asked_again(spark, sf_dir), 100_000).select("request_id", "text", "start_ms")


def _asked_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question is asked once more in other punctuation, half of them within the window."""
    asked = _questions(spark, sf_dir).select("request_id", "session_id", "text", "start_ms")
    later = F.col("start_ms") + F.when(F.length("text") % 2 == 0, 50_000).otherwise(150_000)
    again = asked.select(F.concat("request_id", F.lit("-r")).alias("request_id"), "session_id", F.concat(F.lit(" - "), "text", F.lit(" !")).alias("text"), later.alias("start_ms"))
    return asked.union(again)


@query(f"WITH {QUESTIONS} SELECT session_id AS request_id, start_ms AS revision, CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY start_ms DESC) = 1 THEN 'active' ELSE 'superseded' END AS status FROM questions")
def t8_latest_question_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    revised = _questions(spark, sf_dir).select(F.col("session_id").alias("request_id"), F.col("start_ms").alias("revision"))
    return transcripts.latest_question_revision(revised)


@query(f"""WITH {QUESTIONS} SELECT q.request_id, count(f.text) AS n_segments, coalesce(string_agg(f.source || ': ' || f.text, ' / ' ORDER BY f.start_ms, f.source, f.sequence), '') AS context
  FROM questions q LEFT JOIN finals f ON f.session_id = q.session_id AND f.start_ms >= q.start_ms - 180000 AND f.start_ms < q.start_ms GROUP BY q.request_id""")
def t9_conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transcripts.conversation_window(_questions(spark, sf_dir), _finals(spark, sf_dir))
    return out.select("request_id", "n_segments", F.array_join("context", " / ").alias("context"))


TYPES = {"view": "answer.delta", "click": "answer.delta", "purchase": "answer.completed", "search": "answer.canceled", "login": "operation.failed", "signup": "question.accepted", "error": "answer.sources"}


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer events from the event log: a user's hundred consecutive ids are a request, revisions by parity."""
    log = table(spark, sf_dir, "events")
    kinds = F.try_element_at(F.create_map(*[F.lit(x) for p in TYPES.items() for x in p]), F.col("event_type"))
    return log.select(
        F.col("event_id"), F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 500).cast("string")).alias("request_id"), (F.col("event_id") % 2).cast("int").alias("question_revision"),
        F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("repository_id"), F.when(F.col("event_id") % 11 != 4, F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string"))).alias("index_generation"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.coalesce(kinds, F.lit("index.updated")).alias("type"), F.col("event_type").alias("payload"),
    )


ENVELOPES = "env AS (SELECT event_id, user_id || '-' || event_id // 500 AS request_id, (event_id % 2)::INT AS question_revision, 'src' || user_id % 5 AS repository_id, CASE WHEN event_id % 11 <> 4 THEN 'g' || event_id % 3 END AS index_generation, epoch_us(ts) // 1000 AS timestamp_ms, coalesce(CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " END, 'index.updated') AS type, event_type AS payload FROM events)"


ASKED = "asked AS (SELECT request_id, question_revision, CASE WHEN question_revision = max(question_revision) OVER (PARTITION BY request_id) THEN 'active' ELSE 'superseded' END AS asked FROM (SELECT DISTINCT request_id, question_revision FROM env))"


def _asked(log: DataFrame) -> DataFrame:
    return transcripts.latest_question_revision(log.select("request_id", F.col("question_revision").alias("revision")).distinct())


@query(f"""WITH {ENVELOPES}, {ASKED}
SELECT event_id, request_id, type FROM env JOIN asked USING (request_id, question_revision) WHERE asked = 'active' AND coalesce(repository_id = 'src1', true) AND coalesce(index_generation = 'g1', true) AND request_id NOT IN (SELECT request_id FROM env WHERE type = 'answer.canceled')""")
def t10_drop_stale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = envelopes(spark, sf_dir)
    return transcripts.drop_stale_events(log, _asked(log), "src1", "g1").select("event_id", "request_id", "type")


@query(f"""WITH {ENVELOPES}, {ASKED}, o AS (SELECT request_id, question_revision, arg_min(type, (timestamp_ms, event_id)) FILTER (type IN ('answer.completed', 'answer.canceled', 'operation.failed')) AS t,
  coalesce(string_agg(payload, '' ORDER BY timestamp_ms, event_id) FILTER (type = 'answer.delta'), '') AS text, count(*) FILTER (type = 'answer.delta') AS deltas FROM env GROUP BY ALL)
SELECT request_id, question_revision, coalesce(CASE t WHEN 'answer.completed' THEN 'completed' WHEN 'answer.canceled' THEN 'canceled' WHEN 'operation.failed' THEN 'failed' END, CASE asked WHEN 'superseded' THEN asked END, 'open') AS status,
  text, coalesce(t = 'operation.failed', false) AND deltas > 0 AS partial FROM o JOIN asked USING (request_id, question_revision)""")
def t11_answer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = envelopes(spark, sf_dir)
    return transcripts.answer_outcomes(log, _asked(log))


@query("""WITH c AS (SELECT 'src' || user_id % 5 AS repository_id, event_type AS relative_path, ['create', 'modify', 'delete'][event_id % 3 + 1] AS op, epoch_us(ts) // 1000 AS at_ms FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY repository_id, relative_path ORDER BY at_ms, op ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM (SELECT *, CASE WHEN coalesce(at_ms - lag(at_ms) OVER (PARTITION BY repository_id, relative_path ORDER BY at_ms, op) > 600000, true) THEN 1 ELSE 0 END AS fresh FROM c))
SELECT repository_id, relative_path, burst, arg_max(op, (at_ms, op)) AS op, max(at_ms) + 600000 AS settled_at, count(*) AS n_changes FROM b GROUP BY ALL""")
def t12_debounce_file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events")
    op = F.element_at(F.array(F.lit("create"), F.lit("modify"), F.lit("delete")), (F.col("event_id") % 3 + 1).cast("int"))
    changes = log.select(F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("repository_id"), F.col("event_type").alias("relative_path"), op.alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return transcripts.debounce_file_changes(changes, 600_000)


@query(f"WITH {SEGMENTS} SELECT session_id, source, sum(end_ms - start_ms)::BIGINT AS duration_ms, count(*) AS n_segments FROM finals GROUP BY ALL")
def t13_session_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.session_usage(_finals(spark, sf_dir))


@query(f"WITH {SEGMENTS} SELECT DISTINCT session_id, source, stream_epoch, sequence, revision, text FROM segments")
def s6_read_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment table read as a stream, deduplicated within the watermark, written and read back."""
    path = scratch(spark, "segments")
    stamped = segments(spark, sf_dir).withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("start_ms")))
    columns = [c.split(" ")[0] for c in repo_tree.SEGMENT_SCHEMA.split(", ")]
    stamped.select(*[F.col(c).cast("long") if c in ("start_ms", "end_ms") else F.col(c) for c in columns]).write.parquet(f"{path}/in")
    found = streams.dedupe_segments(repo_tree.read_segments(spark, f"{path}/in"))
    flow = found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    flow.awaitTermination()
    return spark.read.schema(repo_tree.SEGMENT_SCHEMA).parquet(f"{path}/out").select("session_id", "source", "stream_epoch", "sequence", "revision", "text")


@query(f"WITH {ENVELOPES} SELECT event_id::VARCHAR AS event_id, request_id, type, timestamp_ms, payload AS delta FROM env WHERE type = 'answer.delta'")
def s6_read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log written as JSON lines, read as a stream, and the deltas' payloads parsed."""
    path = scratch(spark, "events")
    log = envelopes(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), "request_id", "question_revision", "repository_id", "timestamp_ms", "type", F.to_json(F.struct(F.col("payload").alias("delta"))).alias("payload"))
    log.write.json(f"{path}/in")
    deltas = repo_tree.event_payload(repo_tree.read_events(spark, f"{path}/in"), "answer.delta", "delta string").select("event_id", "request_id", "type", "timestamp_ms", F.col("payload.delta").alias("delta"))
    flow = deltas.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    flow.awaitTermination()
    return spark.read.schema(deltas.schema).parquet(f"{path}/out")


@query("""WITH u AS (SELECT 's' || user_id % 50 AS session_id, 'p' || event_id % 2 AS provider, event_type AS model, CASE WHEN event_id % 7 <> 0 THEN event_id % 900 END AS input_tokens, event_id % 300 AS output_tokens FROM events),
t AS (SELECT session_id, provider, model, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM u GROUP BY ALL)
SELECT *, CASE WHEN provider = 'p0' THEN round(coalesce(input_tokens, 0) * 0.000002::DOUBLE + coalesce(output_tokens, 0) * 0.000008::DOUBLE, 6) END AS cost FROM t""")
def t13_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, log = F.col("event_id"), table(spark, sf_dir, "events")
    usage = log.select(F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("session_id"), F.concat(F.lit("p"), (n % 2).cast("string")).alias("provider"), F.col("event_type").alias("model"), F.when(n % 7 != 0, n % 900).alias("input_tokens"), (n % 300).alias("output_tokens"))
    rates = log.select(F.lit("p0").alias("provider"), F.col("event_type").alias("model"), F.lit(0.000002).alias("input_rate"), F.lit(0.000008).alias("output_rate")).distinct()
    return transcripts.token_usage(usage, rates)


# ---- stateful streams, against the SQL of their batch twins

#: Two events far behind the last: the first moves the watermark, the second wakes what waits for it.
CLOSING_MS = (4_000_000_000_000, 4_100_000_000_000)


def streamed(spark: SparkSession, label: str, rows: DataFrame, key: str, flow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (with their event time in ``ts``) through a stream that is run, and resumed for each closing event, until all keys have settled."""
    stateful.use_state_store(spark)
    path = scratch(spark, label)
    for at in (None, *CLOSING_MS):
        if at is not None:
            rows = spark.read.schema(rows.schema).parquet(f"{path}/in").limit(1).withColumns({key: F.lit("closing"), "ts": F.timestamp_millis(F.lit(at))})
        rows.write.mode("append").parquet(f"{path}/in")
        found = flow(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out").filter(F.col(key) != "closing")


def _at(ms: str) -> Column:
    return F.timestamp_millis(F.lit(1_700_000_000_000) + F.col(ms))


@query(SQL["t9_conversation_window"])
def t9_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and final segments as one event stream; windows are kept in state."""
    none = lambda kind: F.lit(None).cast(kind)
    asked = _questions(spark, sf_dir).select("session_id", "request_id", none("string").alias("source"), none("long").alias("sequence"), none("string").alias("text"), F.col("start_ms").cast("long").alias("start_ms"))
    said = _finals(spark, sf_dir).select("session_id", none("string").alias("request_id"), "source", "sequence", "text", F.col("start_ms").cast("long").alias("start_ms"))
    rows = asked.unionByName(said).withColumn("ts", _at("start_ms"))
    flow = lambda m: streams.conversation_window(m.filter("request_id is not null"), m.filter("request_id is null"))
    out = streamed(spark, "windows", rows, "request_id", flow)
    return out.select("request_id", "n_segments", F.array_join("context", " / ").alias("context"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes, and rows that tell a request's revisions; ids are padded, since they order events of one time as text."""
    log = envelopes(spark, sf_dir).withColumn("event_id", F.lpad(F.col("event_id").cast("string"), 12, "0")).withColumn("ts", F.timestamp_millis("timestamp_ms"))
    asked = log.groupBy("request_id", F.col("question_revision").alias("revision")).agg(F.min("ts").alias("ts"))
    return log.withColumn("revision", F.lit(None).cast("int")).unionByName(asked, allowMissingColumns=True)


@query(SQL["t11_answer_outcomes"])
def t11_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes and question revisions as one event stream; a request's states come once, when it has settled."""
    flow = lambda m: streams.answer_outcomes(m.filter("revision is null"), m.filter("revision is not null"))
    return streamed(spark, "outcomes", _requests(spark, sf_dir), "request_id", flow)


@query(SQL["t7_dedupe_questions"])
def t7_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as a stream; the last of each text and session is kept in state."""
    rows = _asked_again(spark, sf_dir).withColumn("start_ms", F.col("start_ms").cast("long")).withColumn("ts", _at("start_ms"))
    return streamed(spark, "questions", rows, "request_id", lambda q: streams.dedupe_questions(q, 100_000)).select("request_id", "text", "start_ms")


@query(SQL["t10_drop_stale_events"])
def t10_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes and question revisions as one event stream; what was stale is known when a request has settled."""
    flow = lambda m: streams.drop_stale_events(m.filter("revision is null"), m.filter("revision is not null"), "src1", "g1")
    out = streamed(spark, "stale", _requests(spark, sf_dir), "request_id", flow)
    return out.select(F.col("event_id").cast("long").alias("event_id"), "request_id", "type")


@query(SQL["t13_session_usage"])
def t13_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as a stream, revisions and repeats among them; the state holds durations and no text."""
    rows = segments(spark, sf_dir).withColumns({"start_ms": F.col("start_ms").cast("long"), "end_ms": F.col("end_ms").cast("long")}).withColumn("ts", _at("start_ms"))
    return streamed(spark, "usage", rows, "session_id", streams.session_usage)


@query(SQL["t8_latest_question_revision"])
def t8_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of each session's question as a stream, told apart once the session has settled."""
    rows = _questions(spark, sf_dir).select(F.col("session_id").alias("request_id"), F.col("start_ms").cast("int").alias("revision")).withColumn("ts", _at("revision"))
    return streamed(spark, "revisions", rows, "request_id", streams.latest_question_revision).withColumn("revision", F.col("revision").cast("long"))
