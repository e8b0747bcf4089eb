from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from quarry.operators import discovery, transcripts, walk
from quarry.options import DiscoveryOptions
from quarry.sources import generations, repo_tree
from quarry.streaming import stateful
from quarry.streaming import transcripts as streams


def test_tree_source(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src" / "pkg").mkdir(parents=True)
    (root / "src" / "pkg" / "__init__.py").write_text("x = 1\n")
    (root / ".gitignore").write_text("*.log\n")
    (root / "a.log").write_text("no")
    (root / "b.ts").write_bytes(b"let a = '\xff';")
    (root / "c.ts").write_bytes(b"\0\1")
    os.symlink("/etc", root / "link")
    tree = repo_tree.read_repo_tree(spark, {"r": str(root)})
    got = {r.relative_path: r for r in tree.collect()}
    assert {p: r.entry_type for p, r in got.items()} == {"src": "dir", "src/pkg": "dir", "src/pkg/__init__.py": "file", ".gitignore": "file", "a.log": "file", "b.ts": "file", "c.ts": "file", "link": "symlink"}
    texts = {r.relative_path: r.text for r in repo_tree.read_text_files(tree).collect()}
    assert texts["b.ts"] == "let a = '�';" and texts["c.ts"] is None and texts["src"] is None
    status = {r.relative_path: r.status for r in discovery.discover(repo_tree.read_text_files(tree)).collect()}
    assert status["src/pkg/__init__.py"] == "indexable" and status["a.log"] == "skipped" and status["link"] == "skipped"


def test_generations_are_published_last(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    table = spark.createDataFrame([("a",)], "relative_path string")
    generations.write_generation(path, "r", "g1", 1, table, table, table)
    stamped = table.withColumns({"repository_id": F.lit("r"), "generation_id": F.lit("g2")})
    stamped.write.mode("append").partitionBy("repository_id", "generation_id").parquet(f"{path}/chunks/snapshot=none")  # not published
    assert [r.generation_id for r in generations.read_generation(spark, path, "chunks").collect()] == ["g1"]
    generations.write_generation(path, "r", "g2", 2, table, table, table)
    assert sorted(r.generation_id for r in generations.read_generation(spark, path, "chunks").collect()) == ["g1", "g2"]
    generations.write_summary_json(table, f"{path}/summary")
    assert spark.read.json(f"{path}/summary").first().relative_path == "a"


def test_snapshots(spark, tmp_path):
    """A failed rewrite leaves the old rows, an empty table replaces old ones, a retry makes no second stamp, a pinned reader sees no change."""
    path = f"file://{tmp_path}/index"
    table = lambda *names: spark.createDataFrame([(n,) for n in names], "relative_path string")
    generations.write_generation(path, "1", "0123", 1, table("a", "b"), table("a"), table("x"), attempt="first")
    read = lambda part, pinned=None: sorted(r.relative_path for r in generations.read_generation(spark, path, part, pinned).collect())
    pinned = generations.pin(spark, path)
    broken = table("c").select(F.raise_error(F.lit("disk full")).alias("relative_path"))
    with pytest.raises(Exception, match="disk full"):
        generations.write_generation(path, "1", "0123", 1, table("c"), broken, table(), attempt="second")
    assert (read("manifest"), read("chunks"), read("excluded")) == (["a", "b"], ["a"], ["x"])
    for _ in range(2):
        generations.write_generation(path, "1", "0123", 1, table("c"), table("c", "d"), table(), attempt="second")
    assert (read("manifest"), read("chunks"), read("excluded")) == (["c"], ["c", "d"], [])
    assert (read("manifest", pinned), read("excluded", pinned)) == (["a", "b"], ["x"])
    assert spark.read.parquet(f"{path}/generations").count() == 2 and generations.stamps(spark, path).count() == 1
    assert [tuple(r) for r in generations.read_generation(spark, path, "chunks").select("repository_id", "generation_id").distinct().collect()] == [("1", "0123")]


def test_walk_lists_only_what_policy_leaves(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    for folder in ("src/deep/er", "node_modules/big", "build/x", "sub/in", "vendor/kept"):
        (root / folder).mkdir(parents=True)
    texts = {"src/a.ts": "let a = 1", "src/deep/er/b.py": "b = 1", "node_modules/big/c.ts": "no", "build/x/d.ts": "no", "sub/.git": "gitdir", "sub/in/e.ts": "no", "vendor/kept/f.php": "<?php", ".gitignore": "build/\n!vendor/\n*.log", "src/.gitignore": "deep/er/*.ts", "src/deep/er/g.ts": "no", "h.log": "no", "bin.ts": "\0\1"}
    for path, text in texts.items():
        (root / path).write_text(text)
    os.symlink("/etc", root / "link")
    gone = root / "src/lost.ts"
    gone.write_text("x")
    walked = walk.walk(spark, {"r": str(root), "missing": str(tmp_path / "nowhere")})
    listed = {(r.repository_id, r.relative_path): r.entry_type for r in walked.collect()}
    assert listed["missing", ""] == "unreadable"
    paths = {p for r, p in listed if r == "r"}
    assert not any(p.startswith(("node_modules/", "build/", "sub/in")) for p in paths) and {"node_modules", "build", "sub", "vendor/kept/f.php", "src/deep/er/b.py"} <= paths
    whole = repo_tree.read_text_files(repo_tree.read_repo_tree(spark, {"r": str(root), "missing": str(tmp_path / "nowhere")}))
    shown = lambda files: {(r.repository_id, r.relative_path, r.status, r.reason, r.origin) for r in discovery.discover(files).collect()}
    assert shown(walked) == shown(whole)
    found = discovery.discover(walked)
    found.count()
    gone.unlink()  # between the listing and the reading
    dispositions, chunks = discovery.ingest_texts(found, walk.read_kept(walked, found))
    status = {r.relative_path: (r.status, r.reason, r.origin) for r in dispositions.collect() if r.repository_id == "r"}
    assert status["src/lost.ts"] == ("skipped", discovery.UNREADABLE_FILE, "boundary") and status["src/a.ts"][0] == "indexed" and status["bin.ts"][0] == "binary"
    assert {r.relative_path for r in chunks.collect()} == {"src/a.ts", "src/deep/er/b.py", "vendor/kept/f.php"}


def test_walk_of_one_large_directory(spark, tmp_path):
    root = tmp_path / "wide"
    root.mkdir()
    for i in range(1500):
        (root / f"f{i}.ts").write_text(str(i))
    walked = walk.walk(spark, {"r": str(root)})
    assert walked.filter("entry_type = 'file'").agg(F.count(F.lit(1)), F.sum("size_bytes")).first()[:] == (1500, sum(len(str(i)) for i in range(1500)))


def test_tree_source_prunes_columns_and_pushes_filters(spark, tmp_path, monkeypatch):
    for repo in ("p", "q"):
        (tmp_path / repo / "a" / "b").mkdir(parents=True)
        (tmp_path / repo / "a" / "b" / "x.ts").write_text("x")
        (tmp_path / repo / "y.ts").write_text("yy")
    reader = repo_tree.PushingReader({"roots": f"p={tmp_path}/p\nq={tmp_path}/q"}, ["relative_path", "entry_type"])
    kept = list(reader.pushFilters([EqualTo(("repository_id",), "p"), StringStartsWith(("relative_path",), "a/b"), In(("entry_type",), ("file",))]))
    assert len(kept) == 2
    monkeypatch.setattr(repo_tree.os, "stat", lambda *_: pytest.fail("nothing asked for sizes"))
    parts = reader.partitions()
    assert {p.repository_id for p in parts} == {"p"}
    assert [row for part in parts for row in reader.read(part)] == [("a/b/x.ts", "file")]
    monkeypatch.undo()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    tree = repo_tree.read_repo_tree(spark, {r: str(tmp_path / r) for r in ("p", "q")}, columns="repository_id string, relative_path string, entry_type string")
    got = tree.filter("repository_id = 'q' and entry_type = 'file'").collect()
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(r.relative_path for r in got) == ["a/b/x.ts", "y.ts"] and {r.repository_id for r in got} == {"q"}


SEGMENTS = [
    # session, source, epoch, sequence, text, start, end, final, turn end, revision
    ("s", "call", 0, 0, "hello", 0, 900, True, False, 1), ("s", "call", 0, 1, "there", 1000, 1900, True, True, 1), ("s", "call", 0, 1, "their", 1000, 1900, True, True, 0),
    ("s", "call", 0, 2, "draft", 5000, 5900, False, True, 0), ("s", "call", 0, 3, "why is it slow", 9000, 9900, True, True, 1), ("t", "me", 0, 0, "ok", 0, 500, True, True, 1),
]


def stream_rows(spark, tmp_path, flow):
    """Writes the segments and a late marker as two batches and runs the stream over what is there."""
    rows = spark.createDataFrame(SEGMENTS, "session_id string, source string, stream_epoch int, sequence long, text string, start_ms long, end_ms long, is_final boolean, is_turn_end boolean, revision int")
    rows = rows.unionByName(rows)
    stamped = rows.withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("start_ms")))
    marker = stamped.limit(1).withColumns({"session_id": F.lit("z"), "ts": F.timestamp_millis(F.lit(1_700_090_000_000)), "sequence": F.lit(99).cast("long"), "is_final": F.lit(True)})
    source = f"file://{tmp_path}/in"
    stamped.coalesce(1).write.parquet(source + "/a")
    marker.coalesce(1).write.parquet(source + "/b")
    read = spark.readStream.schema(repo_tree.SEGMENT_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    name = f"out_{tmp_path.name.replace('-', '_')}"
    query = flow(read).writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).filter("session_id <> 'z'"), rows


def test_stream_dedupe_equals_batch(spark, tmp_path):
    out, rows = stream_rows(spark, tmp_path, streams.dedupe_segments)
    key = ["session_id", "source", "stream_epoch", "sequence", "revision"]
    assert sorted(map(tuple, out.select(key).collect())) == sorted(map(tuple, transcripts.dedupe_segments(rows).select(key).collect()))


def test_stream_finals_equal_batch(spark, tmp_path):
    out, rows = stream_rows(spark, tmp_path, streams.final_segments)
    key = ["session_id", "source", "sequence", "text", "revision"]
    assert sorted(map(tuple, out.select(key).collect())) == sorted(map(tuple, transcripts.final_segments(rows).select(key).collect()))


def test_stream_turns_equal_batch(spark, tmp_path):
    flow = lambda s: streams.assemble_turns(streams.dedupe_segments(s.filter("is_final and revision = 1")), None)
    out, rows = stream_rows(spark, tmp_path, flow)
    key = ["session_id", "source", "turn_id", "text", "start_ms", "end_ms"]
    batch = transcripts.assemble_turns(transcripts.final_segments(rows))
    assert sorted(map(tuple, out.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))


SCHEMA = "session_id string, source string, stream_epoch int, sequence long, text string, start_ms long, end_ms long, is_final boolean, is_turn_end boolean, revision int"
ORIGIN = 1_700_000_000_000


def stream_batches(spark, tmp_path, batches, flow, schema, stamp):
    """Each list of rows is one micro-batch, in order; a marker far ahead in time closes the stream."""
    source, name = f"{tmp_path}/in", f"out_{tmp_path.name.replace('-', '_')}"
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema).withColumn("ts", stamp)
        frame.coalesce(1).write.parquet(f"file://{source}/{k}")
        for f in (tmp_path / "in" / str(k)).iterdir():
            os.utime(f, (1_700_000_000 + 10 * k, 1_700_000_000 + 10 * k))
    read = spark.readStream.schema(spark.read.parquet(f"file://{source}/0").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{source}")
    query = flow(read).writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name).filter("session_id <> 'z'")


def marker(at_ms, sequence=0):
    return ("z", "call", 0, sequence, "m", at_ms, at_ms, True, True, 0)


def test_stream_finals_with_late_revisions(spark, tmp_path):
    """A revision minutes later replaces the first; one after emission makes no second row."""
    first = [("s", "call", 0, 0, "draft", 0, 900, True, True, 0), ("s", "call", 0, 1, "other", 1_000, 1_900, True, True, 3)]
    later = [("s", "call", 0, 0, "final", 0, 900, True, True, 1)]
    stamp = F.timestamp_millis(F.lit(ORIGIN) + F.col("start_ms") + F.col("revision") * 120_000)
    late = [("s", "call", 0, 0, "too late", 2_000_000, 900, True, True, 5)]
    out = stream_batches(spark, tmp_path, [first, later, [marker(1_900_000)], late, [marker(90_000_000, 1)]], streams.final_segments, SCHEMA, stamp)
    batch = transcripts.final_segments(spark.createDataFrame(first + later, SCHEMA))
    key = ["session_id", "sequence", "text", "revision"]
    assert sorted(map(tuple, out.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))


def test_stream_turns_with_late_segments(spark, tmp_path):
    """A segment that comes a batch late joins its own turn; the open turn comes out after silence."""
    rows = [("s", "call", 0, k, f"w{k}", 1_000 * k, 1_000 * k + 900, True, k in (2, 5), 1) for k in range(8)]
    stamp = F.timestamp_millis(F.lit(ORIGIN) + F.col("start_ms"))
    batches = [[rows[0], rows[2]], [rows[1], rows[4]], [rows[3], rows[6], rows[5]], [rows[7]], [marker(10_000_000)], [marker(20_000_000, 1)], [marker(30_000_000, 2)]]
    out = stream_batches(spark, tmp_path, batches, streams.assemble_turns, SCHEMA, stamp)
    batch = transcripts.assemble_turns(spark.createDataFrame(rows, SCHEMA))
    key = ["session_id", "source", "stream_epoch", "turn_id", "text", "start_ms", "end_ms"]
    assert sorted(map(tuple, out.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))


def test_stream_utterances_equal_batch(spark, tmp_path):
    """Turns longer than the pause, one inside another, a gap of exactly the pause, out of order."""
    schema = "session_id string, source string, stream_epoch int, turn_id long, text string, start_ms long, end_ms long"
    spans = [(0, 5_000), (5_400, 6_000), (6_550, 7_000), (1_000, 1_500), (20_000, 40_000), (25_000, 26_000), (40_549, 41_000)]
    rows = [("s", "call", 0, k, f"t{k}", a, b) for k, (a, b) in enumerate(spans)] + [("s", "me", 0, 0, "x", 5_100, 5_200)]
    stamp = F.timestamp_millis(F.lit(ORIGIN) + F.col("start_ms"))
    closing = [("z", "me", 0, 0, "m", 90_000_000, 90_000_001)]
    out = stream_batches(spark, tmp_path, [[rows[4], *rows[:3]], rows[5:] + [rows[3]], closing], streams.debounce_turns, schema, stamp)
    batch = transcripts.debounce_turns(spark.createDataFrame(rows, schema))
    key = ["session_id", "source", "text", "start_ms", "end_ms"]
    assert sorted(map(tuple, out.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))


def test_unreadable_directories_and_truncation(spark, tmp_path):
    rows = [("r", "locked", "dir", None, None), ("r", "locked", "unreadable", None, None), ("r", "node_modules", "dir", None, None), ("r", "node_modules/x", "unreadable", None, None)]
    rows += [("r", f"f{i}.ts", "file", 10, "x") for i in range(5)] + [("q", "a.ts", "file", 10, "x"), ("q", "b.bin", "file", 10, "x")]
    files = spark.createDataFrame(rows, "repository_id string, relative_path string, entry_type string, size_bytes long, text string")
    got = {(r.repository_id, r.relative_path): r for r in discovery.discover(files, DiscoveryOptions(max_files=3)).collect()}
    assert (got["r", "locked"].reason, got["r", "locked"].origin, got["r", "locked"].status) == (discovery.UNREADABLE, "boundary", "skipped")
    assert ("r", "node_modules/x") not in got and ("r", "f3.ts") not in got and ("r", "f2.ts") in got
    assert got["r", "locked"].truncated.limit == 3 and "3 files" in got["r", "f0.ts"].truncated.message
    assert got["q", "a.ts"].truncated is None
    dispositions, chunks = discovery.ingest(files, DiscoveryOptions(max_files=3))
    assert sorted(r.status for r in dispositions.collect() if r.repository_id == "r") == ["indexed"] * 3 + ["skipped"] * 2
    assert chunks.select("repository_id", "relative_path").distinct().count() == 4


def test_tree_is_written_and_read(spark, tmp_path):
    files = spark.createDataFrame([("r", "a/b.txt", "héllo"), ("q", "c.txt", None)], "repository_id string, relative_path string, text string")
    assert repo_tree.write_tree(files, str(tmp_path / "out")).count() == 2
    tree = repo_tree.read_text_files(repo_tree.read_repo_tree(spark, {k: str(tmp_path / "out" / k) for k in ("r", "q")}))
    assert {(r.repository_id, r.relative_path): r.text for r in tree.collect()} == {("r", "a"): None, ("r", "a/b.txt"): "héllo", ("q", "c.txt"): ""}


CLOSE = 4_000_000_000


@pytest.fixture
def state_store(spark):
    stateful.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run_stream(spark, tmp_path, batches, schema, flow):
    """Rows (their last column is the event time in ms) in batches; later batches may hold earlier times, the last closes the stream."""
    stamp = F.timestamp_millis(F.lit(ORIGIN) + F.col("t"))
    out = stream_batches(spark, tmp_path, batches, flow, schema, stamp)
    return [tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in out.collect()]


def test_stream_questions_equal_batch(spark, tmp_path, state_store):
    schema = "request_id string, session_id string, text string, start_ms long, t long"
    asked = [(f"r{i}", "s", text, at, at) for i, (text, at) in enumerate([("What is X?", 0), ("what is x", 4_000), ("WHAT is -- x", 8_000), ("what is x!", 14_000), ("Why?", 15_000), ("why", 20_000), ("Why?", 25_001)])]
    closing = [[("z", "z", "m", CLOSE * k, CLOSE * k)] for k in (1, 2)]
    flow = lambda q: streams.dedupe_questions(q, 5_000).select("session_id", "request_id")
    got = run_stream(spark, tmp_path, [[asked[0], asked[4], asked[0]], [asked[3], asked[2]], [asked[1], asked[6], asked[5]], *closing], schema, flow)
    batch = transcripts.dedupe_questions(spark.createDataFrame(asked, schema), 5_000)
    assert sorted(r for _, r in got) == sorted(r.request_id for r in batch.collect()) == ["r0", "r3", "r4", "r6"]


def test_stream_windows_equal_batch(spark, tmp_path, state_store):
    schema = "session_id string, request_id string, source string, sequence long, text string, start_ms long, t long"
    said = [("s", None, ("call", "me")[i % 2], i, f"w{i}", i * 40_000, i * 40_000) for i in range(12)]
    asked = [("s", "q1", None, None, None, 200_000, 200_000), ("s", "q2", None, None, None, 440_000, 440_000), ("s", "q0", None, None, None, 0, 0), ("u", "alone", None, None, None, 5, 5)]
    rows = said + asked
    batches = [[said[1], asked[1], *said[6:9]], [asked[0], said[0], *said[3:6], said[1]], [*said[9:], said[2], *asked[2:]]] + [[("z", "z", None, None, None, CLOSE * k, CLOSE * k)] for k in (1, 2)]
    flow = lambda m: streams.conversation_window(m.filter("request_id is not null"), m.filter("request_id is null")).select(F.col("request_id").alias("session_id"), "n_segments", "context")
    got = run_stream(spark, tmp_path, batches, schema, flow)
    table = spark.createDataFrame(rows, schema)
    batch = transcripts.conversation_window(table.filter("request_id is not null"), table.filter("request_id is null"))
    assert sorted(got) == sorted((r.request_id, r.n_segments, tuple(r.context)) for r in batch.collect())
    assert {r[0]: r[1] for r in got} == {"q0": 0, "q1": 4, "q2": 4, "alone": 0}


ENVELOPE = "request_id string, revision int, event_id string, question_revision int, repository_id string, index_generation string, timestamp_ms long, type string, payload string, t long"


def envelope_rows():
    def event(n, request, revision, kind, at, payload="", repo="r", generation="g"):
        return (request, None, f"e{n:02d}", revision, repo, generation, at, kind, payload, at)

    rows = [(q, r, None, None, None, None, None, None, None, at) for q, r, at in [("a", 1, 0), ("a", 2, 50), ("b", 1, 0), ("c", 1, 0), ("d", 1, 0)]]
    rows += [
        event(1, "a", 1, "answer.delta", 10, "old"), event(2, "a", 2, "answer.sources", 60), event(3, "a", 2, "answer.delta", 70, "He"), event(4, "a", 2, "answer.delta", 80, "y"), event(5, "a", 2, "answer.completed", 90), event(6, "a", 2, "operation.failed", 95),
        event(7, "b", 1, "answer.delta", 10, "part"), event(8, "b", 1, "operation.failed", 20), event(9, "c", 1, "answer.delta", 10, "x"), event(10, "c", 1, "answer.canceled", 20), event(11, "d", 1, "answer.delta", 30, "y", "q"), event(12, "d", 1, "answer.delta", 20, "x", None, None),
    ]
    batches = [[rows[0], rows[2], rows[3], *rows[8:10], rows[11], rows[7]], [rows[1], *rows[4:7], rows[5], rows[10]], [*rows[12:], rows[12]]]
    closing = [[("z", 1, None, None, None, None, None, None, None, CLOSE * k)] for k in (1, 2)]
    too_late = [[("b", None, "e99", 1, "r", "g", 30, "answer.completed", "", 30)]]
    return rows, batches + closing[:1] + too_late + closing[1:]


def split(table):
    return table.filter("revision is null"), table.filter("revision is not null")


@pytest.mark.parametrize("kind", ["revisions", "stale", "outcomes"])
def test_stream_requests_equal_batch(spark, tmp_path, state_store, kind):
    """Late, repeated and too late events: each request has one terminal state, that of the batch job."""
    rows, batches = envelope_rows()
    table = spark.createDataFrame(rows, ENVELOPE)
    events, questions = split(table)
    status = transcripts.latest_question_revision(questions.select("request_id", "revision"))
    named = lambda t, *c: t.select(F.col("request_id").alias("session_id"), *c)
    if kind == "revisions":
        flow = lambda m: named(streams.latest_question_revision(split(m)[1]), "revision", "status")
        want = named(status, "revision", "status")
    elif kind == "stale":
        flow = lambda m: named(streams.drop_stale_events(*split(m), "r", "g"), "event_id", "type")
        want = named(transcripts.drop_stale_events(events, status, "r", "g"), "event_id", "type")
    else:
        flow = lambda m: named(streams.answer_outcomes(*split(m)), "question_revision", "status", "text", "partial")
        want = named(transcripts.answer_outcomes(events, status), "question_revision", "status", "text", "partial")
    got = run_stream(spark, tmp_path, batches, ENVELOPE, flow)
    assert sorted(got) == sorted(map(tuple, want.collect())) and len(got) > 3


def test_stream_usage_equals_batch(spark, tmp_path, state_store):
    rows = [("s", "call", 0, k, f"w{k}", 1_000 * k, 1_000 * k + 700 + 10 * r, True, True, r) for k in range(5) for r in range(k % 3 + 1)] + [("s", "me", 0, 0, "x", 500, 900, True, True, 1), ("s", "call", 1, 0, "draft", 9_000, 9_900, False, True, 0)]
    stamp = F.timestamp_millis(F.lit(ORIGIN) + F.col("start_ms"))
    out = stream_batches(spark, tmp_path, [rows[4:], rows[:5], [marker(CLOSE)], [marker(2 * CLOSE, 1)]], streams.session_usage, SCHEMA, stamp)
    batch = transcripts.session_usage(transcripts.final_segments(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.select("session_id", "source", "duration_ms", "n_segments").collect()))


def test_keys_that_share_state_are_told_apart(spark, tmp_path, state_store, monkeypatch):
    """Many keys in few state keys: each waits, settles and is forgotten by itself, with late, repeated and too late rows."""
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    rows, batches = envelope_rows()
    more = [[(f"{r[0]}{i}", *r[1:]) for r in batch for i in range(5) if r[0] != "z"] + [r for r in batch if r[0] == "z"] for batch in batches]
    flow = lambda m: streams.answer_outcomes(*split(m)).select(F.col("request_id").alias("session_id"), "question_revision", "status", "text", "partial")
    got = run_stream(spark, tmp_path / "requests", more, ENVELOPE, flow)
    events, questions = split(spark.createDataFrame([(f"{r[0]}{i}", *r[1:]) for r in rows for i in range(5)], ENVELOPE))
    want = transcripts.answer_outcomes(events, transcripts.latest_question_revision(questions.select("request_id", "revision")))
    assert sorted(got) == sorted(map(tuple, want.collect())) and len(got) == 25
    schema = "request_id string, session_id string, text string, start_ms long, t long"
    asked = [(f"r{i}-{s}", f"s{s}", "Why?", at + s, at + s) for s in range(7) for i, at in enumerate([0, 4_000, 8_000, 14_000])]
    closing = [[("z", "z", "m", CLOSE * k, CLOSE * k)] for k in (1, 2)]
    out = run_stream(spark, tmp_path / "asked", [asked[1::2], asked[::2], *closing], schema, lambda q: streams.dedupe_questions(q, 5_000).select("session_id", "request_id"))
    assert sorted(r for _, r in out if r != "z") == sorted(f"r{i}-{s}" for s in range(7) for i in (0, 3))


def test_rows_of_a_call_are_one_value_of_the_state():
    """Rows that come together are kept together, so the store converts one value a call and not one a row."""
    from quarry.streaming import stateful

    class Store:
        def __init__(self):
            self.values, self.schemas = [], []

        def getListState(self, name, schema):
            self.schemas.append(schema)
            return self

        def get(self):
            return iter(self.values)

        def appendList(self, values):
            self.values += values

        def put(self, values):
            self.values = list(values)

    processor = stateful.Settled(["k"], ["k", "at", "n"], "k string, at long, n long", "at", ["k", "n"], lambda rows: rows, 1, 1)
    store = Store()
    processor.init(store)
    rows = [("a", i, None) for i in range(500)]
    processor.rows.appendList(rows)
    processor.rows.appendList(rows[:1])
    assert len(store.values) == 2 and list(processor.rows.get()) == rows + rows[:1]
    processor.rows.put(rows[:2])
    assert len(store.values) == 1 and list(processor.rows.get()) == rows[:2]
    assert set(store.schemas) == {"packed binary"}
