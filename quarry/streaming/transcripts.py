"""Structured Streaming twins of the transcript jobs. State is keyed by session and bounded by watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.transcripts import SEGMENT, STREAM, TERMINAL, normalised_question
from .stateful import InOrder, Settled, keyed

LATE = "10 minutes"


def dedupe_segments(segments: DataFrame, late: str = LATE) -> DataFrame:
    return segments.withWatermark("ts", late).dropDuplicatesWithinWatermark([*SEGMENT, "revision"])


def _timer(state: GroupState, at_ms: int) -> None:
    """Wake the group when the watermark passes a time, or as soon as may be where it has passed already."""
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, at_ms))


def final_segments(segments: DataFrame, late: str = LATE, settle_ms: int = 600_000, keep_ms: int = 3_600_000) -> DataFrame:
    """Latest revision of every final segment, once: when the watermark is ``settle_ms`` past its last change.

    An emitted key is remembered for ``keep_ms`` more, so a revision that comes later still never makes a second row.
    """
    columns = segments.columns
    rest = [c for c in columns if c not in (*SEGMENT, "ts")]
    at = rest.index("revision")
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, ts, emitted = state.get if state.exists else (*[None] * len(rest), 0, False)
        if state.exists and not emitted and state.getCurrentWatermarkMs() >= ts + settle_ms:
            emitted = True
            row = dict(zip(SEGMENT, key, strict=True)) | dict(zip(rest, held, strict=True)) | {"ts": pd.Timestamp(ts, unit="ms", tz="UTC")}
            yield pd.DataFrame([row], columns=columns)
        elif state.hasTimedOut and emitted:
            state.remove()
            return
        if not state.hasTimedOut and not emitted:
            for frame in frames:
                for r in frame.to_dict("records"):
                    if held[at] is None or r["revision"] > held[at]:
                        held = [r[c] for c in rest]
                    ts = max(ts, int(r["ts"].timestamp() * 1000))
        state.update((*held, ts, emitted))
        _timer(state, ts + settle_ms + (keep_ms if emitted else 0))

    state_schema = ", ".join(f"{c} {kinds[c]}" for c in rest) + ", last long, emitted boolean"
    return segments.filter("is_final").withWatermark("ts", late).groupBy(*SEGMENT).applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


TURN_SCHEMA = "session_id string, source string, stream_epoch int, turn_id long, text string, start_ms long, end_ms long"
WAITING = "w_sequence array<long>, w_text array<string>, w_start array<long>, w_end array<long>, w_last array<boolean>, w_ts array<long>"


def assemble_turns(finals: DataFrame, late: str | None = LATE, silence_ms: int = 60_000, keep_ms: int = 3_600_000) -> DataFrame:
    """Turns as they end, in sequence order; an open turn is emitted when its stream has been silent for ``silence_ms``.

    Segments wait until the watermark has passed them, so one that comes late but within it still joins its own turn. The turn
    number of a silent stream is remembered for ``keep_ms``. ``late`` is None when the input already has its watermark (one
    stream has one).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, texts, start, end, last, *held = state.get if state.exists else (0, [], None, None, 0, [], [], [], [], [], [])
        texts, waiting, out, now = list(texts), list(zip(*held, strict=True)), [], state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for frame in frames:
                for r in frame.itertuples():
                    waiting.append((r.sequence, r.text, r.start_ms, r.end_ms, bool(r.is_turn_end), int(r.ts.timestamp() * 1000)))
        waiting.sort(key=lambda w: w[0])
        while waiting and waiting[0][5] <= now:
            _, text, a, b, ends, ts = waiting.pop(0)
            texts.append(text)
            start, end, last = a if start is None else min(start, a), b if end is None else max(end, b), max(last, ts)
            if ends:
                out.append((*key, turn, " ".join(texts), start, end))
                turn, texts, start, end = turn + 1, [], None, None
        if not waiting and texts and now >= last + silence_ms:
            out.append((*key, turn, " ".join(texts), start, end))
            turn, texts, start, end = turn + 1, [], None, None
        if state.hasTimedOut and not waiting and not texts and now >= last + keep_ms:
            state.remove()
        else:
            columns = [list(c) for c in zip(*waiting, strict=True)] or [[] for _ in range(6)]
            state.update((turn, texts, start, end, last, *columns))
            _timer(state, waiting[0][5] if waiting else last + (silence_ms if texts else keep_ms))
        yield pd.DataFrame(out, columns=["session_id", "source", "stream_epoch", "turn_id", "text", "start_ms", "end_ms"])

    marked = finals.withWatermark("ts", late) if late else finals
    state_schema = f"turn long, texts array<string>, start long, end long, last long, {WAITING}"
    return marked.groupBy(*STREAM).applyInPandasWithState(step, TURN_SCHEMA, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def debounce_turns(turns: DataFrame, pause_ms: int = 550, late: str = LATE) -> DataFrame:
    """Turns (with ``ts``, their start) closer than the pause to the furthest end before them, by session windows.

    The gap of a turn is its duration and the pause, less a microsecond since windows that touch are one, so they meet exactly
    where one turn starts before another's end plus pause.
    """
    gap = F.concat(((F.col("end_ms") - F.col("start_ms") + pause_ms) * 1000 - 1).cast("string"), F.lit(" microseconds"))
    spoken = F.sort_array(F.collect_list(F.struct("start_ms", "stream_epoch", "turn_id", "text")))
    return turns.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "session_id", "source").agg(
        F.array_join(F.transform(spoken, lambda s: s["text"]), " ").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")
    )


def _columns(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _timed(rows: DataFrame, schema: str, late: str | None, **computed: Column) -> DataFrame:
    """The columns of a state schema, ``at_ms`` from the event time, and the watermark."""
    marked = rows.withWatermark("ts", late) if late else rows
    return marked.withColumns({"at_ms": F.unix_millis("ts"), **computed}).select(*_columns(schema), "ts")


def dedupe_questions(questions: DataFrame, window_ms: int = 5_000, late: str | None = LATE) -> DataFrame:
    """An equal normalised question within the window of the one before it, itself a repeat or not, is a repeat: request_id, session_id, text, start_ms."""
    schema = "session_id string, norm string, at_ms long, start_ms long, request_id string, text string"
    at = {c: i for i, c in enumerate(_columns(schema))}
    result = "request_id string, session_id string, text string, start_ms long"

    def step(held: list, ready: list) -> tuple[list, list]:
        out, before = [], held[-1][at["start_ms"]] if held else None
        for row in sorted(ready, key=lambda r: (r[at["start_ms"]], r[at["request_id"]])):
            if before is None or row[at["start_ms"]] - before > window_ms:
                out.append(tuple(row[at[c]] for c in _columns(result)))
            before = row[at["start_ms"]]
        return out, ready[-1:]

    rows = _timed(questions, schema, late, norm=normalised_question(F.col("text")))
    return keyed(rows, InOrder(["session_id", "norm"], _columns(schema), schema, "at_ms", _columns(result), step, window_ms), result)


def conversation_window(questions: DataFrame, finals: DataFrame, minutes: int = 3, late: str | None = LATE) -> DataFrame:
    """Dialogue of the last minutes before each question, in time order, as one row a question, also where there was none: request_id, n_segments, context."""
    span = minutes * 60_000
    schema = "session_id string, at_ms long, start_ms long, request_id string, source string, sequence long, text string"
    at = {c: i for i, c in enumerate(_columns(schema))}
    result = "session_id string, request_id string, n_segments long, context array<string>"

    def step(held: list, ready: list) -> tuple[list, list]:
        said, out = list(held), []
        said += [r for r in ready if r[at["request_id"]] is None]
        said.sort(key=lambda r: (r[at["start_ms"]], r[at["source"]], r[at["sequence"]], r[at["text"]]))
        for row in ready:
            if row[at["request_id"]] is not None:
                begin, end = row[at["start_ms"]] - span, row[at["start_ms"]]
                near = [f"{r[at['source']]}: {r[at['text']]}" for r in said if begin <= r[at["start_ms"]] < end]
                out.append((row[at["session_id"]], row[at["request_id"]], len(near), near))
        last = max(r[at["at_ms"]] for r in ready)
        return out, sorted((r for r in said if r[at["at_ms"]] >= last - span), key=lambda r: r[at["at_ms"]])

    none = lambda kind: F.lit(None).cast(kind)
    asked = questions.select("session_id", "ts", "start_ms", "request_id", none("string").alias("source"), F.lit(-1).cast("long").alias("sequence"), none("string").alias("text"))
    said = finals.select("session_id", "ts", "start_ms", none("string").alias("request_id"), "source", "sequence", "text")
    rows = _timed(asked.unionByName(said), schema, late)
    return keyed(rows, InOrder(["session_id"], _columns(schema), schema, "at_ms", _columns(result), step, span), result).select("request_id", "n_segments", "context")


EVENT = "request_id string, at_ms long, kind string, event_id string, question_revision int, repository_id string, index_generation string, timestamp_ms long, type string, payload string"
_AT = {c: i for i, c in enumerate(_columns(EVENT))}
SETTLE_MS, KEEP_MS = 600_000, 3_600_000


def _requests(events: DataFrame | None, questions: DataFrame | None, late: str | None) -> DataFrame:
    """Events and question revisions (request_id, revision, ts) as one stream with one watermark."""
    parts = []
    none = lambda kind: F.lit(None).cast(kind)
    if events is not None:
        parts.append(events.select("request_id", "ts", F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("event_id"), "question_revision", "repository_id", "index_generation", "timestamp_ms", "type", "payload"))
    if questions is not None:
        parts.append(questions.select("request_id", "ts", F.lit("question").alias("kind"), none("string").alias("event_id"), F.col("revision").cast("int").alias("question_revision"), none("string").alias("repository_id"), none("string").alias("index_generation"), F.lit(0).cast("long").alias("timestamp_ms"), none("string").alias("type"), none("string").alias("payload")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _timed(rows, EVENT, late)


def _of_requests(rows: DataFrame, reduce: Callable[[list], list], result: str, settle_ms: int, keep_ms: int) -> DataFrame:
    return keyed(rows, Settled(["request_id"], _columns(EVENT), EVENT, "at_ms", _columns(result), reduce, settle_ms, keep_ms), result)


def _revisions(rows: list) -> list[int]:
    return sorted({r[_AT["question_revision"]] for r in rows if r[_AT["kind"]] == "question"})


def latest_question_revision(questions: DataFrame, late: str | None = LATE, settle_ms: int = SETTLE_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """Every revision of a request (request_id, revision, ts) with its status, once the request has settled."""

    def reduce(rows: list) -> list:
        known = _revisions(rows)
        return [(rows[0][_AT["request_id"]], r, "active" if r == known[-1] else "superseded") for r in known]

    return _of_requests(_requests(None, questions, late), reduce, "request_id string, revision int, status string", settle_ms, keep_ms)


def drop_stale_events(events: DataFrame, questions: DataFrame, repository_id: str | None = None, index_generation: str | None = None, late: str | None = LATE, settle_ms: int = SETTLE_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """Events of the newest revision of requests that nobody canceled, in scope, in time order, once the request has settled."""
    result = "event_id string, request_id string, question_revision int, timestamp_ms long, type string, payload string"
    scope = (("repository_id", repository_id), ("index_generation", index_generation))

    def reduce(rows: list) -> list:
        known = _revisions(rows)
        found = [r for r in rows if r[_AT["kind"]] == "event"]
        if not known or any(r[_AT["type"]] == "answer.canceled" for r in found):
            return []
        live = [r for r in found if r[_AT["question_revision"]] == known[-1] and all(want is None or r[_AT[c]] in (None, want) for c, want in scope)]
        return [tuple(r[_AT[c]] for c in _columns(result)) for r in live]

    return _of_requests(_requests(events, questions, late), reduce, result, settle_ms, keep_ms)


def answer_outcomes(events: DataFrame, questions: DataFrame, late: str | None = LATE, settle_ms: int = SETTLE_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """One terminal state per request and revision, with its text in order, once the request has settled."""

    def reduce(rows: list) -> list:
        known, out = _revisions(rows), []
        by_revision: dict[int, list] = {}
        for r in rows:
            if r[_AT["kind"]] == "event":
                by_revision.setdefault(r[_AT["question_revision"]], []).append(r)
        for revision, found in sorted(by_revision.items()):
            found.sort(key=lambda r: (r[_AT["timestamp_ms"]], r[_AT["event_id"]]))
            ends = [TERMINAL[r[_AT["type"]]] for r in found if r[_AT["type"]] in TERMINAL]
            deltas = [r[_AT["payload"]] or "" for r in found if r[_AT["type"]] == "answer.delta"]
            status = ends[0] if ends else "superseded" if revision in known[:-1] else "open"
            out.append((rows[0][_AT["request_id"]], revision, status, "".join(deltas), status == "failed" and bool(deltas)))
        return out

    result = "request_id string, question_revision int, status string, text string, partial boolean"
    return _of_requests(_requests(events, questions, late), reduce, result, settle_ms, keep_ms)


def session_usage(segments: DataFrame, late: str | None = LATE, settle_ms: int = SETTLE_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """Speech time per session and source, the latest revision of each final segment counted once; no text is kept, not even in the state."""
    schema = "session_id string, source string, at_ms long, stream_epoch int, sequence long, revision int, spoken_ms long"
    at = {c: i for i, c in enumerate(_columns(schema))}

    def reduce(rows: list) -> list:
        latest: dict[tuple, tuple] = {}
        for r in rows:
            place = (r[at["stream_epoch"]], r[at["sequence"]])
            if place not in latest or r[at["revision"]] > latest[place][0]:
                latest[place] = (r[at["revision"]], r[at["spoken_ms"]])
        return [(rows[0][at["session_id"]], rows[0][at["source"]], sum(ms for _, ms in latest.values()), len(latest))]

    result = "session_id string, source string, duration_ms long, n_segments long"
    rows = _timed(segments.filter("is_final"), schema, late, spoken_ms=F.col("end_ms") - F.col("start_ms"))
    return keyed(rows, Settled(["session_id", "source"], _columns(schema), schema, "at_ms", _columns(result), reduce, settle_ms, keep_ms), result)


def debounce_file_changes(changes: DataFrame, gap: str = "2 seconds", late: str = LATE) -> DataFrame:
    """One item per burst of changes of a path, with its last operation."""
    return changes.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "repository_id", "relative_path").agg(
        F.max_by("op", F.struct("ts", "op")).alias("op"), F.count(F.lit(1)).alias("n_changes")
    ).select("repository_id", "relative_path", "op", F.col("w.end").alias("settled_at"), "n_changes")
