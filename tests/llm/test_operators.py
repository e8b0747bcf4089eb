"""Corpus operators against brute force, exact round trips and held-out accuracy, with odd rows in every table."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, chat_format, decontaminate, exact_dedup, language_id, line_dedup, near_dedup, pii, quality, suffix_dedup
from quarry.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, keep_id string, n int, digest string"


def prose(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randint(0, vocabulary)}{draw.choice('abcdef')}" for _ in range(n))


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", "x", 1, "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd_rows():
    draw = random.Random(3)
    base = prose(draw, 120)
    near = base.replace(" ", "  ", 3).split(" ")
    near[60] = "changed"
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "one  two"), (8, prose(draw, 20_000)), (9, base), (9, base), (10, "é" * 30 + " ß Σ😀 tail")]
    rows += [(20 + i, prose(draw, 60) + ". " + base[:450] + "! " + prose(draw, 40)) for i in range(6)]
    return rows


OPERATORS = [
    exact_dedup.deduplicate, suffix_dedup.deduplicate, lambda d: bpe.encode(d, vocabulary()), line_dedup.remove_repeats, near_dedup.classes, pii.find,
    lambda d: decontaminate.contamination(d, d.sparkSession.createDataFrame([(1, "one two"), (2, None), (3, "")], "item_id long, text string")),
    lambda d: quality.score(d, quality.train(d, d.sparkSession.createDataFrame([(0, 1), (4, 0), (None, 1), (1, None)], "doc_id long, quality int"))),
    lambda d: language_id.predict(d, language_id.train(d)),
]


@pytest.mark.parametrize("k", range(len(OPERATORS)))
def test_empty_tables_and_odd_rows(spark, odd_rows, k):
    """One result row per row, repeated ones and those without an id too; repeated rows have equal results."""
    assert OPERATORS[k](table(spark, [])).count() == 0
    rows = [*odd_rows, (None, "no id at all here"), (None, None), (11, odd_rows[0][1] + " more"), (11, "another text under one id")]
    got = OPERATORS[k](table(spark, rows)).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
    assert len({tuple(map(str, r)) for r in got if r.doc_id == 9}) == 1


def test_rows_without_an_id(spark):
    base = " ".join(f"t{i}" for i in range(200))
    rows = [(None, base), (1, base), (2, base + " tail"), (None, "mail a@b.example now"), (None, None)]
    near = near_dedup.classes(table(spark, rows)).collect()
    assert all(r.kept and r.class_id is None and r.n_links == 0 for r in near if r.doc_id is None)
    assert {r.doc_id: r.class_id for r in near if r.doc_id} == {1: 1, 2: 1}
    assert sorted((r.doc_id or 0, r.kept) for r in exact_dedup.deduplicate(table(spark, rows)).collect()) == [(0, False), (0, True), (0, True), (1, True), (2, True)]
    assert all(r.n_removed == 0 for r in suffix_dedup.deduplicate(table(spark, rows)).collect() if r.doc_id is None)
    assert all(r.n_removed == 0 for r in line_dedup.remove_repeats(table(spark, rows)).collect() if r.doc_id is None)
    assert sum(len(r.base) for r in pii.find(table(spark, rows)).collect() if r.doc_id is None) == 1
    items = spark.createDataFrame([(1, "t3 t4 t5 t6 t7 t8 t9 t10 t11 t12")], "item_id long, text string")
    hits = {r.doc_id: r.contaminated for r in decontaminate.contamination(table(spark, rows), items).collect()}
    assert hits == {None: False, 1: True, 2: True}


def test_texts_that_share_an_id(spark):
    long = " ".join(f"u{i}" for i in range(150))
    rows = [(1, "x " + long), (1, "something else"), (2, "y " + long)]
    cut = sorted((r.doc_id, r.n_removed > 0) for r in suffix_dedup.deduplicate(table(spark, rows)).collect())
    assert cut == [(1, False), (1, True), (2, True)]
    assert {r.class_id for r in near_dedup.classes(table(spark, rows)).collect() if r.doc_id == 1} == {1}


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_exact_dedup(spark, odd_rows):
    got = {r.doc_id: r for r in exact_dedup.deduplicate(table(spark, odd_rows)).collect()}
    groups = collections.defaultdict(list)
    for i, t in odd_rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-(len(t or "")), i))
    for norm, members in groups.items():
        for _, i in members:
            assert (got[i].keep_id, got[i].group_size) == (min(members)[1], len(members))
            assert got[i].digest.hex() == hashlib.sha256(norm.encode()).hexdigest() if hasattr(got[i].digest, "hex") else True
    assert got[7].kept and not got[6].kept


def test_digest_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "index"), 4)
    index.add(table(spark, [(1, "a b"), (2, "c")]))
    again = exact_dedup.DigestIndex(spark, scratch_path(spark, "other"), 4)
    assert again.rows().count() == 0
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.add(table(spark, [(3, "ab"), (4, "d"), (5, "d d")])).collect()}
    assert got == {3: (1, False), 4: (4, True), 5: (5, True)} and index.rows().count() == 4


def test_hot_digest(spark):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(6000)]
    got = exact_dedup.deduplicate(table(spark, rows))
    assert got.filter("kept").count() == 2001 and got.count() == 6000


def brute_cut(rows, length, keep_first=False):
    count, first = collections.Counter(), {}
    for i, raw in sorted(rows):
        for p in range(len(raw) - length + 1):
            count[raw[p : p + length]] += 1
            first.setdefault(raw[p : p + length], (i, p))
    out = {}
    for i, raw in rows:
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if count[raw[p : p + length]] > 1 and not (keep_first and first[raw[p : p + length]] == (i, p)):
                gone[p : p + length] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block, keep_first", [(64, False), (2, False), (64, True), (2, True)])
def test_suffix_dedup(spark, block, keep_first):
    draw = random.Random(8)
    common = [prose(draw, n) for n in (20, 40, 90)]
    rows = []
    for i in range(40):
        parts = [prose(draw, draw.randint(5, 60)), draw.choice(common), prose(draw, draw.randint(0, 30)), draw.choice(common)]
        rows.append((i, " ".join(parts)))
    rows += [(50, rows[0][1]), (51, "ab" * 300), (52, "x" * 41), (53, None), (54, "é" * 40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(table(spark, rows), 40, 20, block, keep_first).collect()}
    assert got == brute_cut([(i, (t or "").encode()) for i, t in rows], 40, keep_first)


def test_suffix_factors_against_psv_nsv():
    """The arrays tell where longest previous (next) factors, from previous and next smaller (larger) positions, reach the length."""
    draw = random.Random(2)
    length, k = 9, 4
    for _ in range(30):
        anchors = [b"abab", b"bbab"]
        bodies, los, blocks = [], [], []
        for _ in range(draw.randint(1, 12)):
            left, right = (bytes(draw.choice(b"ab") for _ in range(draw.randint(0, length - k))) for _ in range(2))
            bodies.append(left + draw.choice(anchors) + right)
            los.append(len(left))
            blocks.append(draw.randint(0, 1))
        place, context, equal = suffix_dedup.window_order(bodies, los, blocks, length, k)
        earlier, later = suffix_dedup.factor_arrays(place, context, equal)
        got = {(c, los[c] - p): (a, b) for p, c, a, b in zip(place.tolist(), context.tolist(), earlier.tolist(), later.tolist(), strict=True)}
        whole = {(c, s) for c, body in enumerate(bodies) for s in range(los[c] + 1) if s + length <= len(body)}
        assert set(got) == whole
        for c, s in whole:
            # suffixes of one place of the anchor, in order of their text, then of their context
            mates = sorted((bodies[d][los[d] - los[c] + s :], d) for d in range(len(bodies)) if blocks[d] == blocks[c] and bodies[d][los[d] : los[d] + k] == bodies[c][los[c] : los[c] + k] and 0 <= los[d] - los[c] + s)
            at = mates.index((bodies[c][s:], c))
            for value, nearer in ((got[c, s][0], lambda d: d < c), (got[c, s][1], lambda d: d > c)):
                near = [next((m for m in side if nearer(m[1])), None) for side in (reversed(mates[:at]), mates[at + 1 :])]
                factor = max((len(os.path.commonprefix([m[0], bodies[c][s:]])) for m in near if m), default=0)
                assert (value >= 0) == (factor >= length)
                assert value < 0 or nearer(value) and bodies[value][los[value] - los[c] + s :][:length] == bodies[c][s : s + length]


def test_suffix_factors_can_keep_the_first():
    body = bytes(range(65, 91))
    found, shown = suffix_dedup.factors([body, body, body[:20]], [8, 8, 8], [0, 0, 0], 12, 4, keep_first=True)
    assert [f.tolist() for f in found] == [[], list(range(9)), list(range(9))] and [x.tolist() for x in shown] == [list(range(9)), [], []]
    assert [f.tolist() for f in suffix_dedup.factors([body, body], [8, 8], [0, 1], 12, 4)[0]] == [[], []]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    draw = random.Random(4)
    alphabet = "abcdefghij éÉßñ漢字Σİ😀0123½²'!?.,-\n\t\x85​\x1c’s"
    texts = ["Hello world's <|endoftext|>foo", "ΑΣ ΣΑΣ", "don't we'll I'D", "é é", "", None, "<|startoftext|><|endoftext|>", "x" * 3000]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 120))) for _ in range(300)]
    texts += ["".join(draw.choice(["the", "ing", "an", "re", "tion", "er", "qu", "zx", " "]) for _ in range(60)) for _ in range(200)]
    got = {r.doc_id: r for r in bpe.encode(table(spark, list(enumerate(texts))), vocabulary()).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids, text
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()


def test_bpe_long_words_and_segments():
    import time

    from tokenizers import Tokenizer

    library, draw = Tokenizer.from_file(vocabulary()), random.Random(8)
    with open(vocabulary(), encoding="utf-8") as f:
        model = bpe.WordBpe(f.read())
    for alphabet, n in (("abcdefghijklmnopqrstuvwxyz", 20_000), ("ab", 5_000), ("éñßж", 3_000), ("#-_", 4_000)):
        word = "".join(draw.choice(alphabet) for _ in range(n))
        assert np.frombuffer(model.encode_batch([word])[0], "<u4").tolist() == library.encode(word, add_special_tokens=False).ids
    start = time.time()
    model.encode_batch(["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))])
    assert time.time() - start < 60 and not any(len(w) > bpe.LONG_WORD for w in model.cache if w not in model.special)
    text = prose(draw, 500) + " é" + "x" * 300 + " " + prose(draw, 300) + "  <|endoftext|> end"
    parts = bpe.segments(text, 200)
    assert "".join(parts) == text and len(parts) > 5
    assert b"".join(model.encode_batch([p])[0] for p in parts) == model.encode_batch([text])[0]
    ids = np.frombuffer(model.encode_batch([text])[0], "<u4").tolist()
    assert model.decode_batch(model.encode_batch([text, ""])).to_pylist() == [library.decode(ids, skip_special_tokens=False), ""]


def test_bpe_speculation_is_verified():
    with open(vocabulary(), encoding="utf-8") as f:
        model = bpe.WordBpe(f.read())
    words = ["thering", "anthere", "zxqing", "abcdefghijkl"]
    proposals = [model.proposed(w) for w in words]
    for word, tokens, ok in zip(words, proposals, model.verified(proposals), strict=True):
        exact = model.merged([*word[:-1], word[-1] + model.end])
        assert (tokens == exact) == bool(ok)


TALK = "conv_id long, turn long, role string, text string, segments string"


def test_chat_round_trip(spark):
    draw = random.Random(6)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "<<SYS>>", "<</SYS>>", "[ROLE]", "x", "\n", "é", "<\\/s>", " "]
    rows = []
    for c in range(60):
        for t in range(draw.randint(1, 6)):
            role = draw.choice(["system", "user", "assistant", "tool", None, "[/ROLE]"])
            rows.append((c, t, role, None if draw.random() < 0.1 else "".join(draw.choice(bits) for _ in range(draw.randint(0, 12))), "z"))
    formatted = chat_format.format_turns(spark.createDataFrame(rows, TALK))
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    for c in range(60):
        turns = [(t, r or "", x or "") for k, t, r, x, _ in sorted(rows, key=lambda z: z[1]) if k == c]
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.read_back(chat_format.format_turns(spark.createDataFrame([], TALK))).count() == 0


def test_chat_order(spark):
    rows = [(1, 0, "system", "a", ""), (1, 1, "user", "b", ""), (1, 2, "assistant", "c", ""), (2, 0, "assistant", "c", ""), (3, 0, "user", "a", ""), (3, 1, "user", "a", "")]
    got = {r.conv_id: r.out_of_order for r in chat_format.read_back(chat_format.format_turns(spark.createDataFrame(rows, TALK))).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items):
    low = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in docs:
        words, hit, found = low(t), set(), set()
        for k, x in items:
            item = low(x)
            n = min(10, len(item))
            for s in range(len(item) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == item[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(k))
        out[i] = (len(words), len(hit), sorted(found))
    return out


def test_decontamination(spark):
    draw = random.Random(9)
    items = [(k, prose(draw, n, 60)) for k, n in enumerate((30, 15, 10, 9, 3, 1))] + [(10, None), (11, "... !"), (12, "ÉCOLE école"), (13, "a a a a a a a a a a a a")]
    docs = [(i, prose(draw, 80, 60)) for i in range(25)]
    for i in range(25, 60):
        words = items[draw.randrange(6)][1].split()
        a = draw.randrange(len(words))
        docs.append((i, f"{prose(draw, 20, 60)} {' '.join(words[a:]).upper()}, {prose(draw, 15, 60)} {' '.join(words[: a + 1])}"))
    docs += [(70, None), (71, ""), (72, "École ÉCOLE École"), (73, "a " * 40), (74, " ".join(items[0][1].split()[5:]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(table(spark, docs), benchmark).collect()}
    assert got == brute_hits(docs, items)


def test_proximity(spark):
    docs = table(spark, [(1, "a b c d e"), (2, "a x x x x x x e"), (3, "e a")])
    terms = spark.createDataFrame([("a", 3), ("e", 3)], "term string, cf long")
    pairs = spark.createDataFrame([(1, "a", 3, "e", 3)], "pair_id int, left_term string, left_cf long, right_term string, right_cf long")
    got = decontaminate.proximity_matches(decontaminate.build_postings(docs, terms, 6), pairs, 4, 6)
    assert {r.doc_id for r in got.collect()} == {1, 3}


@pytest.mark.parametrize("limit", [decontaminate.VOCABULARY_BYTES, 0])
def test_near_items_and_hot_terms(spark, monkeypatch, limit):
    """With broadcasts and without. One word in every document asks for a third of all postings; the rarest two words of an item count where they stand near each other."""
    monkeypatch.setattr(decontaminate, "VOCABULARY_BYTES", limit)
    docs = [(i, " ".join(["the"] * 5 + [f"x{i}", "rare" if i % 50 == 0 else "y", "z"] + (["seldom"] if i % 100 == 0 else []))) for i in range(3000)]
    items = [(1, "the"), (2, "seldom rare"), (3, "nothing here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(table(spark, docs), benchmark).collect()}
    assert all(r.n_hit == 5 and r["items"] == ["1"] for r in got.values())
    assert {i: r.n_near for i, r in got.items()} == {i: 1 + (i % 100 == 0) for i in got}  # "the" is near itself


def test_posting_index_is_kept_and_extended(spark, monkeypatch):
    docs = [(i, f"alpha beta w{i} gamma " + "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10" * (i == 4)) for i in range(30)]
    corpus, base = table(spark, docs), scratch_path(spark, "postings")
    index = decontaminate.PostingIndex.of(corpus, base)
    first, second = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")], [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (2, "alpha beta w7"), (3, "absent")]
    shown = lambda rows: sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows.collect())
    for items in (first, second):
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        assert shown(decontaminate.contamination(corpus, benchmark, index=index)) == shown(decontaminate.contamination(corpus, benchmark))
    monkeypatch.setattr(decontaminate, "build_postings", lambda *_: pytest.fail("everything is indexed"))
    monkeypatch.setattr(decontaminate, "term_counts", lambda *_: pytest.fail("everything is counted"))
    again = decontaminate.contamination(corpus, spark.createDataFrame(second, "item_id long, text string"), index=decontaminate.PostingIndex.of(corpus.repartition(2), base))
    assert {r.doc_id for r in again.collect() if r.contaminated} == {4, 7}
    assert decontaminate.PostingIndex.of(table(spark, docs[1:]), base).path != index.path
    index.drop()


def test_quality_fit_is_the_optimum(monkeypatch):
    """The Bradley-Terry fit against brute force: the penalised loss on the drawn pairs has no lower point around, and the cut is the score quantile."""
    monkeypatch.setattr(quality, "N_COUNTS", 3)
    draw = np.random.default_rng(5)
    x, y = draw.normal(size=(60, 4)).astype(np.float32), np.array([1] * 40 + [0] * 20)
    x[y == 1, 0] += 1.5
    model = quality.fit(x, y, pairs=300)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    again = np.random.default_rng(7)
    diff = z[again.choice(np.flatnonzero(y == 1), 300)] - z[again.choice(np.flatnonzero(y == 0), 300)]
    ridge = np.array([quality.RIDGE] * 3 + [quality.HASHED_RIDGE])
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean() + 0.5 * (ridge * w * w).sum()
    best = loss(model.weight)
    for _ in range(200):
        assert loss(model.weight + draw.normal(scale=draw.choice([1e-3, 1e-2, 0.3]), size=4)) > best - 1e-9
    strength = np.sort(z @ model.weight)
    assert (strength < model.cut).sum() == int(np.floor((len(y) - 1) * 20 / 60))
    score = model.score(x)
    assert (np.argsort(score, kind="stable") == np.argsort(z @ model.weight, kind="stable")).all() or np.ptp(score) == 1
    assert score[np.abs(z @ model.weight - model.cut).argmin()] == pytest.approx(quality.CUT, abs=0.02)


def test_quality_training_takes_all_rows_and_pairs(spark):
    """Against brute force over every pair of a good and a bad training row: the penalised loss is flat, scale and cut are those of all rows."""
    draw = random.Random(12)
    rows = [(i, prose(draw, draw.randint(5, 40), 60)) for i in range(120)] + [(200 + i, prose(draw, draw.randint(5, 40), 90) + "!" * draw.randint(0, 9)) for i in range(60)]
    labels = [(i, int(i < 120)) for i, _ in rows]
    model = quality.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = [(t, y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    x, y = quality.features(pa.array([t for t, _ in kept])).astype(np.float32), np.array([y for _, y in kept])
    assert np.allclose(model.mean, x.mean(axis=0, dtype=float)) and np.allclose(model.scale, np.maximum(x.std(axis=0, dtype=float), 1e-3))
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    ridge = np.where(np.arange(z.shape[1]) < quality.N_COUNTS, quality.RIDGE, quality.HASHED_RIDGE)
    grad = -(diff / (1 + np.exp(diff @ model.weight))[:, None]).mean(axis=0) + ridge * model.weight
    assert np.abs(grad).max() < 1e-4
    strength = z @ model.weight
    assert model.cut == pytest.approx(np.quantile(strength, (y == 0).mean(), method="lower"))
    assert model.slope == pytest.approx(3 / np.abs(strength - model.cut).mean())


def test_quality_pair_sums():
    """Sums over cells against all pairs one by one."""
    draw = np.random.default_rng(2)
    good, bad = draw.random(40), draw.random(40)
    loss, slope, curve = quality.pair_sums(good, bad)
    gap = (np.arange(40)[None] - np.arange(40)[:, None]) * quality.CELL  # good by row, bad by column
    p = 1 / (1 + np.exp(-gap))
    assert loss == pytest.approx(good @ np.log1p(np.exp(gap)) @ bad)
    assert np.allclose(slope, [p @ bad, good @ p]) and np.allclose(curve, [(p * (1 - p)) @ bad, good @ (p * (1 - p))])


def test_training_takes_one_row_of_a_repeated_id(spark):
    rows = [(i, prose(random.Random(i), 30)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    plain, repeated = table(spark, rows), table(spark, rows + rows[:1] * 500)
    a, b = quality.train(plain, labels), quality.train(repeated, labels.union(labels))
    assert np.allclose(a.weight, b.weight) and a.cut == pytest.approx(b.cut)
    text = "an english sentence of words"
    assert [tuple(r) for r in language_id.predict(table(spark, [(1, text)]), language_id.train(plain)).collect()] == [tuple(r) for r in language_id.predict(table(spark, [(1, text)]), language_id.train(repeated)).collect()]


def test_quality_ranks_and_cuts(spark):
    draw = random.Random(1)
    good = [(i, prose(draw, 80)) for i in range(0, 400)]
    bad = [(i, " ".join(["Of"] * 60) if i % 2 else " ".join(f"{w}%%%" for w in prose(draw, 60).split())) for i in range(400, 480)]
    docs = table(spark, good + bad)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    scored = quality.score(docs, quality.train(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    held = scored[scored.held_out]
    assert quality.auc(held.score, held.quality) > 0.99
    assert ((held.predicted == held.quality).mean()) > 0.95
    assert quality.score(docs, quality.train(docs, labels.filter("quality = 1"))).filter("predicted = 0").count() == 0


def brute_phrases(text, sample):
    count, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(j - 1, i + 1)
        count += 1
    return count


def test_language_phrases_equal_brute_force():
    draw = random.Random(5)
    samples = {"a": "".join(draw.choice("abc ") for _ in range(300)), "b": "".join(draw.choice("bcd ") for _ in range(300))}
    model = language_id.build(samples)
    clean = {k: "".join(map(chr, language_id.symbols(v)[0])) for k, v in samples.items()}
    for _ in range(50):
        text = "".join(draw.choice("abcdx ") for _ in range(draw.randint(1, 200)))
        low = language_id.symbols(text)[0]
        got = model.phrases([low])[0]
        assert got.tolist() == [brute_phrases("".join(map(chr, low)), clean[k]) for k in model.langs]


def test_language_accuracy(spark):
    draw = random.Random(7)
    parts = {"xx": ["the", "an", "ing", "er"], "yy": ["ción", "ñ", "ez", "mente"], "zz": ["eau", "é", "ou", "tre"]}
    rows = [(i, " ".join("".join(draw.choice(parts[lang]) for _ in range(draw.randint(1, 3))) for _ in range(60)), lang) for i, lang in enumerate(list(parts) * 60)]
    rows += [(900, None, "xx"), (901, "123 456", "xx"), (902, "the thing", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(docs, language_id.train(docs)).toPandas().set_index("doc_id")
    assert all(got.lang_pred[i] == lang for i, _, lang in rows[:180] if got.held_out[i])
    assert got.lang_pred[900] == got.lang_pred[901] == "und" and got.lang_pred[902] == "xx"
    assert ((got.score >= 0) & (got.score <= 1)).all()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans():
    draw = random.Random(11)
    bits = ["a", "@", ".", "b.c", "1", "23", "456", " ", "-", "+", "(", ")", "4111111111111111", "1.2.3.4", "+1 (736) 555-2678", "x@y.z", "%", "é", "\n", "300.1.1.1"]
    for _ in range(3000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(1, 30)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_pii_bootstrap_discovers_unseen_identifiers(spark):
    draw = random.Random(12)
    rows = []
    for i in range(300):
        kind = i % 3
        entity = [f"user{i}@mail.example.com", f"10.0.{i % 256}.7", f"AKIA{draw.choice('QRST')}{draw.randint(10**14, 10**15 - 1)}X"][kind]
        rows.append((i, f"{prose(draw, 5, 30)} contact is {entity} from today {prose(draw, 5, 30).replace('w', 'v')}"))
    rows += [(1000 + i, "Licensed under version 2.0. All rights reserved") for i in range(50)]
    rows = [(i, re.sub(r"\b([vw])\d+([a-f])", r"\1\2", t)) for i, t in rows]
    got = {r.doc_id: [(s.start, s.stop) for s in r.added] for r in pii.find(table(spark, rows)).collect()}
    text = dict(rows)
    assert sum(any(text[i][a:b].startswith("AKIA") for a, b in got[i]) for i in range(2, 300, 3)) >= 85  # some hold a digit run that is a base card itself
    assert not any(got[i] for i in range(1000, 1050))


def brute_believed(found, rounds, threshold, support):
    """The scoring of the pattern graph, mention by mention."""
    seeds = {m for m, (seed, _) in found.items() if seed}
    docs = collections.defaultdict(set)
    for (doc, start), (_, patterns) in found.items():
        for p in patterns:
            if p[0] in "SK":
                docs[p].add(doc)
    belief = dict.fromkeys(seeds, 1.0)
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for m, (_, patterns) in found.items():
            for p in patterns:
                if p[0] in "LR":
                    members[p].append(m)
        told = {}
        for m, (_, patterns) in found.items():
            s = w = 0.0
            for p in patterns:
                if p[0] in "LR":
                    others = [belief.get(o, 0.0) for o in members[p] if o != m]
                    weight = len(others) / (len(others) + 3)
                    s, w = s + sum(others) / max(len(others), 1) * weight, w + weight
            if any(p[0] in "LR" for p in patterns):
                told[m] = (s, w)
        worth = {}
        for p, have in docs.items():
            own = [told[m] for m, (_, patterns) in found.items() if p in patterns and m in told]
            if own and len(have) >= support:
                score = sum(s for s, _ in own) / (sum(w for _, w in own) + 1)
                if score >= threshold:
                    worth[p] = score
        belief = {m: max([1.0] * (m in seeds) + [worth[p] for p in patterns if p in worth]) for m, (_, patterns) in found.items() if m in seeds or any(p in worth for p in patterns)}
    return {m for m, b in belief.items() if b >= threshold and m not in seeds}


def test_pii_scores_equal_brute_force(spark):
    draw = random.Random(19)
    rows = []
    for i in range(160):
        entity = [f"u{i}@mail.example.com", f"10.1.{i % 200}.9", f"AB{draw.randint(100000, 999999)}", f"Q{i}" * 50][draw.choice([0, 0, 1, 1, 2, 3])]
        noise = draw.choice([f"v{draw.randint(1, 9)}", f"AB{draw.randint(100000, 999999)}", "k9"])
        rows.append((i, f"{draw.choice(['so', 'then'])} reach me at {entity} {draw.choice(['today', 'now'])} {draw.choice(['see', 'like'])} {noise} key={draw.choice([entity, 'k9'])} end"))
    parts = pii.extract(table(spark, rows)).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    found = {(r.doc_id, r.start): (r.seed, r.patterns) for r in parts.collect()}
    got = {(r.doc_id, r.start) for r in pii.believed(parts).collect()}
    assert got == brute_believed(found, pii.ROUNDS, pii.THRESHOLD, pii.SUPPORT) and got


def test_pii_has_no_reach_limit(spark):
    """Long tokens, and words far before and behind a mention, count whole."""
    token = "Q7" * 5_000
    text = f"key{' ' * 100}word{' ' * 300}{token}{' ' * 200}{'z' * 3_000}"
    base = pii.base_spans(text)
    (mention,) = [m for m in pii.mentions(text, base) if m[2].startswith("Q7")]
    assert (mention[0], mention[1]) == (407, 407 + len(token))
    kinds = {p[0]: p for p in mention[4]}
    assert kinds["L"] == "L:word" and kinds["S"].startswith("S#") or kinds["S"].startswith("S:code")
    assert kinds["R"].startswith("R#")


def brute_lines(rows, min_unit, min_run):
    """Lines first, sentences inside the others: a unit is (text, pieces, size where it may go, whether it is a whole line)."""
    pattern = re.compile(r"(?s).{%d,}?(?:[.!?] |\n|\Z)|.+" % min_unit)
    norm = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")
    lines_seen, parts_seen, out = set(), set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        found, total = [], 0
        for line in re.findall(r"[^\n]*\n|[^\n]+", text or ""):
            pieces = [m[0] for m in pattern.finditer(line)]
            total += len(pieces)
            marks = []
            for piece in pieces:
                marks.append(len(norm(piece)) if norm(piece) in parts_seen else 0)
                parts_seen.add(norm(piece) or None)
            if norm(line) and norm(line) in lines_seen:
                found.append((line, len(pieces), len(norm(line)), True))
            else:
                found += [(p, 1, m, False) for p, m in zip(pieces, marks, strict=True)]
            lines_seen.add(norm(line))
        gone = [u[3] for u in found]
        k = 0
        while k < len(found):
            e = k
            while e < len(found) and found[e][2]:
                e += 1
            if e > k and sum(u[2] for u in found[k:e]) >= min_run:
                gone[k:e] = [True] * (e - k)
            k = max(e, k + 1)
        runs, kept, n, at = [], "", 0, 0
        for (body, count, _, _), go in zip(found, gone, strict=True):
            if go:
                n += count
                runs = [*runs[:-1], (runs[-1][0], at + len(body))] if runs and runs[-1][1] == at else [*runs, (at, at + len(body))]
            else:
                kept += body
            at += len(body)
        out[i] = (total, n, runs, kept)
    return out


@pytest.mark.parametrize("min_unit, min_run", [(20, 100), (1, 1), (8, 40)])
def test_line_dedup(spark, min_unit, min_run):
    draw = random.Random(31)
    pool = [prose(draw, draw.randint(1, 12), 60) + draw.choice([". ", "! ", "\n", "? ", "\n\n"]) for _ in range(40)] + ["漢字かな交じり文。" * 6 + "\n", "短い行\n", " \t\n"]
    rows = [(i, "".join(draw.choice(pool) for _ in range(draw.randint(0, 14)))) for i in range(60)] + [(70, None), (71, ""), (72, "no end")]
    got = {r.doc_id: (r.n_units, r.n_removed, [(s.start, s.stop) for s in r.removed], r.kept_text) for r in line_dedup.remove_repeats(table(spark, rows), min_unit, min_run).collect()}
    assert got == brute_lines(rows, min_unit, min_run)


def test_line_dedup_passages(spark):
    long = " ".join(f"word{i}" for i in range(25))
    rows = [(1, f"{long}\nshort\nTail one"), (2, f"x\n  {long.upper()}  \ny"), (3, f"{long}\n{long}"), (4, "short"), (5, "Copyright notice, all rights kept.\n"), (6, "Copyright notice, all rights kept.\n"), (7, f"Other words {long} go. {long}\nEnd"), (8, "Only here. A chance repeat of one sentence. More.\n"), (9, "Alone. A chance repeat of one sentence. Else.\n")]
    got = {r.doc_id: r for r in line_dedup.remove_repeats(table(spark, rows)).collect()}
    assert got[1].kept_text == rows[0][1] and got[2].kept_text == "x\ny" and got[4].kept_text == "" and got[6].kept_text == ""
    assert got[3].kept_text == "" and got[3].n_removed == 2 and len(got[3].removed) == 1
    assert got[7].kept_text == f"Other words {long} go. End"
    assert got[9].kept_text == rows[8][1]


def test_whole_lines_go_whatever_stands_before_them(spark):
    """Short lines before a repeated one do not shift its borders; no later copy of a line is left."""
    line = "A line of two sentences, of which this is the first one. And this is the second one of them, a little longer than it was! "
    rows = [(1, f"{line}\nx"), (2, f"Ok.\n{line}\ny"), (3, f"{line}\nz"), (4, f"Menu\n{line}"), (5, "Menu\r\nown text of the fifth\nOk.")]
    got = {r.doc_id: r.kept_text for r in line_dedup.remove_repeats(table(spark, rows)).collect()}
    assert got == {1: f"{line}\nx", 2: "Ok.\ny", 3: "z", 4: "Menu\n", 5: "own text of the fifth\n"}


def test_probability_jaccard():
    a, b = np.array([1, 2, 3], np.uint64), np.array([2, 3, 4, 5], np.uint64)
    ones = lambda x: np.ones(len(x), np.int32)
    assert near_dedup.probability_jaccard(a, ones(a), b, ones(b)) == pytest.approx(2 / 5)
    x, y = np.array([3, 1, 2], np.int32), np.array([1, 5, 2, 2], np.int32)
    full = sorted({*a.tolist(), *b.tolist()})
    vx, vy = [dict(zip(a.tolist(), x.tolist(), strict=True)).get(k, 0) for k in full], [dict(zip(b.tolist(), y.tolist(), strict=True)).get(k, 0) for k in full]
    expected = sum(1 / sum(max(p / vx[d], q / vy[d]) for p, q in zip(vx, vy, strict=True)) for d in range(len(full)) if vx[d] and vy[d])
    assert near_dedup.probability_jaccard(a, x, b, y) == pytest.approx(expected)


def test_signatures_estimate_probability_jaccard():
    draw = np.random.default_rng(0)
    base = np.sort(draw.integers(1, 2**63, 300).astype(np.uint64))
    owner, value = np.r_[np.zeros(300, int), np.ones(300, int)], np.r_[base, np.sort(np.r_[base[:240], draw.integers(1, 2**63, 60).astype(np.uint64)])]
    sig = near_dedup.signatures(owner, value, np.ones(600), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.05


def brute_classes(rows, threshold=0.8):
    shingles = {}
    for i, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles[i] = collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else {}
    parent = {i: i for i in shingles}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = list(shingles)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = shingles[i], shingles[j]
            if not a or not b or not a.keys() & b.keys():
                continue
            keys = a.keys() | b.keys()
            similar = sum(1 / sum(max(a.get(k, 0) / a[d], b.get(k, 0) / b[d]) for k in keys) for d in a if d in b) if len(keys) < 500 else len(a.keys() & b.keys()) / len(keys)
            if similar >= threshold - 1e-12:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("small", [32, 3])
def test_near_dedup(spark, small):
    draw = random.Random(13)
    rows = []
    for group in range(12):
        base = prose(draw, 100).split()
        for k in range(draw.randint(1, 8)):
            words = base.copy()
            for _ in range(k % 3):
                words[draw.randrange(100)] = "zz"
            rows.append((len(rows), " ".join(words)))
    shared = prose(draw, 40)
    rows += [(200 + i, f"{shared} {prose(draw, 40)}") for i in range(30)]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "One, two!"), (304, "a b c d"), (305, "of " * 80)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(table(spark, rows), small=small, block=4).collect()}
    assert got == brute_classes(rows)
    assert table(spark, rows).count() == len(got)


def test_pipeline_stages(spark, tmp_path, odd_rows):
    import corpus_pipeline

    draw = random.Random(21)
    passage = prose(draw, 30)
    docs = [(i, prose(draw, 70)) for i in range(200)] + [(300, "Of " * 70), (301, "Of " * 90)] + [(302 + i, "The% of% " * (20 + i)) for i in range(30)]
    docs += [(400, docs[5][1]), (401, docs[6][1].replace(" ", "\n", 2)), (402, docs[7][1] + " extra"), (403, f"{prose(draw, 30)} {passage} {prose(draw, 30)}")]
    home = f"file://{tmp_path}/in"
    table(spark, docs).write.parquet(home + "/documents.parquet")
    spark.createDataFrame([(i, int(i < 300)) for i, _ in docs if i < 340], "doc_id long, quality int").write.parquet(home + "/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(home + "/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    now = spark.read.parquet(home + "/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, home)
        assert out.columns == now.columns
    kept = {r.doc_id: r for r in corpus_pipeline.run(spark, home).collect()}
    assert set(range(200)) - set(kept) <= {6} and not {300, 301, 400, 402, 403} & set(kept)
    assert len({6, 401} & set(kept)) == 1
    assert kept[0].n_tokens == len(kept[0].ids) > 0


def test_hot_near_group_makes_linear_links(spark):
    draw = random.Random(30)
    base = prose(draw, 80).split()
    rows = []
    for i in range(300):
        words = base.copy()
        words[i % 80] = f"q{i}"
        rows.append((i, " ".join(words)))
    docs = table(spark, rows)
    out = near_dedup.classes(docs)
    assert out.select("class_id").distinct().count() == 1
    assert out.agg(F.sum("n_links")).first()[0] < 300 * 60


def test_line_units_offsets(spark):
    rows = [(1, "a\n\nb. c\n"), (2, "")]
    got = sorted((r.doc_id, r.line, r.piece, r.whole, r.part, r.body) for r in line_dedup.units(table(spark, rows), 1).collect())
    assert got == [(1, 1, 0, True, True, "a\n"), (1, 2, 0, True, True, "\n"), (1, 3, 0, True, False, "b. c\n"), (1, 3, 1, False, True, "b. "), (1, 3, 2, False, True, "c\n")]


def test_near_dedup_links_that_bypass_the_leader(spark):
    """Revisions of revisions: each second revision is similar enough to its own first revision alone, which is linked to the original."""
    draw = random.Random(44)
    base = [f"b{i}" for i in range(404)]
    rows = [(0, " ".join(base))]
    for k in range(1, 101):
        first = base.copy()
        first[draw.randrange(5, 150)] = f"x{k}"
        second, at = first.copy(), draw.randrange(160, 360)
        second[at : at + 36] = [f"y{k}z{i}" for i in range(36)]
        rows += [(k, " ".join(first)), (500 + k, " ".join(second))]
    rows += [(1000 + k, prose(draw, 60)) for k in range(20)]
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(table(spark, rows)).collect()}
    assert got == {i: find(i) for i in root}
    assert sum(1 for i in got if got[i] == 0) == 201


def test_pii_identifiers_inside_long_runs(spark):
    """Minified JSON, CSV, query strings and sentences without blanks hold identifiers like any other text."""
    draw = random.Random(45)
    rows, secret = [], {}
    for i in range(320):
        entity = [f"user{i}@mail.example.com", f"10.0.{i % 256}.7", f"AKIA{draw.choice('QRST')}{draw.choice('ABCD')}{draw.randint(10**9, 10**10 - 1)}X"][i % 3]
        if i % 3 == 2:
            secret[i] = entity
        junk = [f"{draw.choice('abcdef')}{draw.choice('ghij')}" for _ in range(80)]
        rows.append((i, [
            '{"a":["' + '","'.join(junk) + '"],"contact":"' + entity + '","from":"' + '","'.join(junk[:9]) + '"}',
            ",".join(junk) + ",contact," + entity + ",from," + ",".join(junk[:9]),
            "https://x.test/p?q=" + "&q=".join(junk) + "&contact=" + entity + "&from=" + "&q=".join(junk[:9]),
            "天地玄黄宇宙洪荒" * 30 + "联系人" + entity + "请回复" + "日月盈昃" * 4,
        ][i // 3 % 4]))
    text = dict(rows)
    assert all(len(t) > 200 and " " not in t for t in text.values())
    got = {r.doc_id: {text[r.doc_id][s.start : s.stop] for s in r.added} for r in pii.find(table(spark, rows)).collect()}
    for way in range(4):
        mine = [i for i in secret if i // 3 % 4 == way]
        assert len(mine) > 20 and sum(secret[i] in got[i] for i in mine) >= 0.9 * len(mine), way
    long = "x9" * 300
    assert [m[2] for m in pii.mentions(f"a,{long},b", [])] == [long]


def test_language_learns_from_all_of_its_texts(spark):
    """Long texts that open with the same foreign passage: what stands behind it is learned, from every text."""
    draw = random.Random(46)
    parts = {"xx": ["the", "an", "ing", "er"], "yy": ["dor", "mel", "ku", "si"]}
    words = lambda lang, n: " ".join("".join(draw.choice(parts[lang]) for _ in range(draw.randint(1, 3))) for _ in range(n))
    heading = words("xx", 900)
    rows = [(i, words("xx", 2000), "xx") for i in range(60)] + [(100 + i, heading[:4200] + " " + words("yy", 2000), "yy") for i in range(60)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    lang, _ = model.predict([words("yy", 60) for _ in range(20)] + [words("xx", 60) for _ in range(20)])
    assert lang == ["yy"] * 20 + ["xx"] * 20
    long, short = np.arange(1000) % 26 + 97, np.full(5, 64)
    got = language_id.shares([(k * 37, long + 100 * k) for k in range(9)] + [(7, short)], 500)
    assert len(got) <= 500 and (got == 64).sum() == 5
    assert {int(((got >= 97 + 100 * k) & (got < 123 + 100 * k)).sum()) for k in range(9)} <= {53, 54}


def test_near_dedup_recall_in_large_buckets(spark):
    """Sixty copies of a text and pairs that both resemble it, each pair linked but only one half of it to the text."""
    draw = random.Random(77)
    base = [f"b{i}" for i in range(400)]
    rows = [(i, " ".join([*base[: 3 + i], f"c{i}", *base[4 + i :]])) for i in range(60)]
    for k in range(150):
        first, at = base.copy(), draw.randrange(10, 150)
        first[at : at + 30] = [f"x{k}w{i}" for i in range(30)]
        second, at = first.copy(), draw.randrange(200, 350)
        second[at : at + 30] = [f"y{k}w{i}" for i in range(30)]
        rows += [(1000 + k, " ".join(first)), (2000 + k, " ".join(second))]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(table(spark, rows)).collect()}
    assert set(got.values()) == {0}


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Stage by stage in plain Python, on null ids and texts, repeated rows, copies, near copies and leaked passages."""
    import corpus_pipeline
    import pyarrow as pa
    from tokenizers import Tokenizer

    draw = random.Random(55)
    passage = prose(draw, 14)
    docs = [(i, prose(draw, draw.randint(20, 60))) for i in range(60)] + [(100 + i, "The% of% #$ " * (10 + i)) for i in range(20)]
    docs += [(200, docs[3][1]), (201, docs[4][1].replace(" ", "\n")), (202, docs[5][1] + " extra"), (203, f"{prose(draw, 20)} {passage} {prose(draw, 20)}")]
    docs += [docs[7], docs[7], (None, prose(draw, 30)), (None, None), (300, None), (301, ""), (302, " \t"), (303, "é漢字 " * 12)]
    home = f"file://{tmp_path}/in"
    table(spark, docs).write.parquet(home + "/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in docs if i is not None and i < 110], "doc_id long, quality int")
    labels.write.parquet(home + "/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(home + "/benchmark.parquet")
    model = quality.train(table(spark, docs), labels)
    score = model.score(quality.features(pa.array([t for _, t in docs], pa.string())))
    rows = [(i, t) for (i, t), s in zip(docs, score, strict=True) if i is not None and s >= quality.CUT - 1e-12]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i, t))
    rows = [(i, t) for _, i, t in (min(g, key=lambda x: x[:2]) for g in groups.values())]
    kept = brute_classes(rows)
    rows = [(i, t) for i, t in rows if kept[i] == i]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    leaks = {tuple(words(passage)[k : k + 10]) for k in range(len(words(passage)) - 9)}
    rows = [(i, t) for i, t in rows if not leaks & {tuple(words(t)[k : k + 10]) for k in range(len(words(t)) - 9)}]
    library = Tokenizer.from_file(vocabulary())
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, home).collect()) == want
    assert {i for i, _ in want} >= {0, 7} and not {200, 203} & {i for i, _ in want}


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    home = f"file://{tmp_path}/in"
    table(spark, []).write.parquet(home + "/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(home + "/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(home + "/benchmark.parquet")
    assert corpus_pipeline.run(spark, home).count() == 0


def test_chat_odd_rows(spark):
    """A conversation without an id, turns of equal number, repeated rows, a very long text, null role and text."""
    long = "x</s>[INST]" * 30_000
    rows = [(None, 0, "user", "a", "z"), (1, 0, "user", "b", "z"), (1, 0, "assistant", "c", "z"), (1, 0, "user", "b", "z"), (2, 1, "assistant", long, "z"), (3, 0, None, None, "z")]
    talks = spark.createDataFrame(rows, TALK)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(talks)).collect()}
    assert set(got) == {None, 1, 2, 3}
    assert got[None].n_turns == 1 and got[1].n_turns == 3 and got[1].loss_chars == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"assistant\nc\nuser\nb\nuser\nb\n").hexdigest()
    assert got[2].loss_chars == len(long) and got[2].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[3].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[3].loss_chars == 0
    assert chat_format.read_back(chat_format.format_turns(talks.filter("false"))).count() == 0
