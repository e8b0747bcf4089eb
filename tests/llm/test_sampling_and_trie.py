"""Mixing, resampling and the prefix trie against brute force, with odd rows in every table."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing, prefix_trie, resampling
from quarry.llm.common import running, scratch_scope, staged

DOCS = "doc_id long, text string, source string, size int, mix string, rank int, _part string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, "p") for i, t, s in rows], DOCS)


def odd_docs(seed=1, n=300):
    draw = random.Random(seed)
    rows = [(i, " ".join(f"w{draw.randint(0, 50)}" for _ in range(draw.choice([0, 1, 5, 20, 60]))), draw.choice(["a", "b", "c", "d"])) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", None), (n + 2, "x y z", None), (None, "no id", "b"), (None, None, None), (7, "again", "c"), (7, "again", "c"), (n + 3, " ".join("long" for _ in range(30_000)), "d"), (n + 4, "é ß 😀 x", "c")]
    return rows + [(1000 + i, "same text of ten words in a row for all", "hot") for i in range(150)]


def test_running_sums_over_groups_of_any_size(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["hot", "hot", "hot", "a", "b"]), draw.randint(0, 99), draw.randint(0, 5)) for _ in range(3000)]
    table = spark.createDataFrame(rows, "g string, k int, v long")
    got = collections.defaultdict(list)
    for r in running(table, ["g"], ["k"], ["v"], "t").joined().collect():
        got[r.g].append((r.k, r._run_v, r.v))
    for g, found in got.items():
        found.sort(key=lambda x: (x[1], x[0]))
        assert sorted(x[1] for x in found)[-1] == sum(v for h, _, v in rows if h == g)
        assert [x[0] for x in sorted(found, key=lambda x: (x[0], x[1]))] == sorted(k for h, k, _ in rows if h == g)
        total = 0
        for k in sorted({k for h, k, _ in rows if h == g}):
            total += sum(v for h, x, v in rows if h == g and x == k)
            assert max(run for x, run, _ in found if x == k) == total


def brute_targets(sizes):
    """Shares by weight, the excess of full sources dealt again until none is over."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2.0 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in full and target[s] > 2.0 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(2))
def test_mixing(spark, seed):
    rows = odd_docs(seed)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = brute_targets(sizes)
    mixed = mixing.copies(docs(spark, rows), mixing.word_count(F.col("text")))
    got = mixed.select("doc_id", "source", "text", F.col("mix.*")).collect()
    assert len(got) == len(rows)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2
        expected = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert math.floor(expected + 1e-9) <= r.copies <= math.ceil(expected - 1e-9)
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= 1.01 * largest[s] for s in sizes)
    again = mixing.copies(docs(spark, rows[::-1]).repartition(5), mixing.word_count(F.col("text"))).select("doc_id", "source", F.col("mix.*")).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter((r.doc_id, r.source, r.size, r.source_size, r.target, r.copies) for r in got)
    emitted = mixing.mixture(docs(spark, rows))
    assert emitted.columns == [*[c for c in docs(spark, []).columns if c != "mix"], "copy_no"]
    assert emitted.count() == sum(r.copies for r in got)


def test_mixing_of_nothing(spark):
    assert mixing.copies(docs(spark, []), mixing.word_count(F.col("text"))).count() == 0
    empty = mixing.copies(docs(spark, [(1, None, "a"), (2, "", None)]), mixing.word_count(F.col("text"))).select("mix.*").collect()
    assert all((r.size, r.target, r.copies) == (0, 0.0, 0) for r in empty)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    return len(words), collections.Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1))


def brute_resample(rows, items):
    bags = [(i, *bag(t)) for i, t, _ in rows]
    corpus, aim = sum((b for *_, b in bags), collections.Counter()), sum((bag(t)[1] for _, t in items), collections.Counter())
    s_all, t_all = sum(corpus.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log(float(aim[b] + 1) * (s_all + 10_000) / (float(corpus[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, b in bags:
        weight = sum(gain[k] * c for k, c in b.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(b.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: 5 * len(fit) // 100])}
    return collections.Counter((*r[:4], ranks.get(id(r))) for r in out)


def test_resampling(spark):
    rows = odd_docs(3) + [(5000 + i, "Café ÉCOLE " * 12 + "Ünïcode 漢字" * 40 + f" tail{i} " + "z" * (63 + i), "a") for i in range(4)] + [(6000, "word-" * 25, "b"), (6000, "word-" * 25, "b")]
    items = [(1, "w1 w2 w3 same text of ten words"), (2, None), (3, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = resampling.resample(docs(spark, rows), bench).collect()
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == brute_resample(rows, items)
    chosen = {r.doc_id for r in got if r["rank"] is not None}
    assert {r.doc_id for r in resampling.drawn(docs(spark, rows), resampling.resample(docs(spark, rows), bench)).collect()} == chosen
    assert resampling.resample(docs(spark, []), bench).count() == 0
    assert resampling.resample(docs(spark, rows[:5]), spark.createDataFrame([], "item_id long, text string")).count() == 5


def test_planes_are_exact():
    draw = np.random.default_rng(4)
    counts = draw.integers(0, 3, size=(5, resampling.BUCKETS)) * draw.integers(0, 70_000, size=(5, resampling.BUCKETS))
    gained = [int(g) for g in draw.integers(-40_000, 40_000, size=resampling.BUCKETS)]
    assert (resampling.plane_weights(counts, *resampling.gain_planes(gained)) == counts @ np.array(gained)).all()
    assert (resampling.plane_weights(counts, *resampling.gain_planes([0] * resampling.BUCKETS)) == 0).all()


def test_checksums_of_words_of_any_length():
    text = " ".join("x" * n + "é" for n in (1, 5, 62, 63, 64, 65, 66, 67, 130, 1000, 3)).encode()
    offsets = np.array([0, 30, len(text)])
    pieces = [text[:30].decode("utf-8", "ignore"), text[30:].decode("utf-8", "ignore")]
    data = np.frombuffer("".join(pieces).encode(), dtype=np.uint8)
    offsets = np.array([0, len(pieces[0].encode()), len(data)])
    buckets, owners, n_words = resampling.features(data, offsets)
    for k, piece in enumerate(pieces):
        n, want = bag(piece)
        assert n_words[k] == n and collections.Counter(buckets[owners == k].tolist()) == want


TALK = "conv_id long, turn long, role string, text string, depth int, node string, digest string"


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    talks = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in talks:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        built[c] = tuple(talks.get(base, [])[:h] + talks[c][h:])
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    saved, leaves = collections.Counter(), collections.Counter()
    for n, who in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(who) - 1) * (len(n[-1][1].encode()) if n else 0)
            leaves[n[:d]] += n not in kids
    out = set()
    for n, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if built[c] == n)))
        out.add((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_rows(spark, rows):
    table = spark.createDataFrame([(*r, 1, "n", "d") for r in rows], TALK)
    got = prefix_trie.trie(prefix_trie.rebuilt(table)).collect()
    assert len(got) == len({(r.conv_id, r.depth) for r in got})
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}


@pytest.mark.parametrize("seed", range(3))
def test_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 12)
    draw = random.Random(seed)
    rows = []
    for c in range(-12, 60):
        if draw.random() < 0.15:
            continue
        for t in range(draw.randint(1, 11)):
            rows.append((c, t, ("user", "assistant")[t % 2], draw.choice(["hi", "yes", "größer", "", None])))
    rows += [(200 + i, t, "user", "same") for i in range(40) for t in range(2)] + [(301, None, None, "null turn"), (301, 0, "user", "x"), (301, 0, "user", "x"), (None, 1, "user", "no id"), (303, 1, "user", "long " * 20_000)]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_little(spark):
    assert trie_rows(spark, []) == set()
    alone = [(c, 0, "user", "x") for c in (3, 4, 13)]  # with h of 1 or more and no base, nothing is left
    assert trie_rows(spark, alone) == brute_trie(alone)


def test_scope_deletes_scratch(spark):
    table = spark.range(5)
    with scratch_scope(spark) as kept:
        gone, stays = staged(table, "gone"), kept(staged(table, "stays"))
        assert gone.count() == 5
    assert stays.count() == 5
    target = spark._jvm.org.apache.hadoop.fs.Path(gone._quarry_path)
    assert not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
