"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives the longest match from any position; a text is parsed
greedily into such longest matches, and the language that needs the fewest phrases, normalised by the size of
its training text, wins. All pieces of all texts of a slice advance together, one symbol a step, so the parse is
vectorised; a text is cut into pieces of ``PIECE`` symbols that are parsed independently and summed, at most ``LANES``
pieces at once, so a very long text is as many more lanes, not more steps or memory. An automaton is shipped as the list of
its transitions (at most three a training symbol, whatever the alphabet) and looked up in a hash table that each worker builds.

Training takes at most ``DOCS`` texts a language (those of smallest hash), ``CHARS`` symbols of them in all, in equal shares at
hashed offsets; what a short text leaves of its share goes to the longer ones.

Defined results: null text or a text without a letter is ``und`` with score 0; with nothing learned everything is
``und``; ties go to the language first in order; repeated rows are predicted each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fmix, slices
from .quality import held_out

DOCS, CHARS, PIECE, LANES = 40, 24_000, 256, 4096


def _letters() -> np.ndarray:
    """Lowered code point of each letter of the basic plane, 32 (blank) for all else; letters beyond it are kept as one symbol."""
    table = np.full(0x10000, 32, np.int32)
    for c in range(0x10000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else ord(low[0])
    return table


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> tuple[np.ndarray, bool]:
    """Lowered letters with single blanks between words, and whether there is a letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _TABLE[0][np.minimum(raw, 0xFFFF)]
    astral = raw > 0xFFFF
    if astral.any():
        low[astral] = [0xFFFF if chr(c).isalpha() else 32 for c in raw[astral].tolist()]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    low = low[keep]
    return low, bool((low != 32).any())


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of every state of the suffix automaton of a symbol sequence; state 0 is the root."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nexts


class Transitions:
    """Hash lookup of (state, symbol): one slot a key, and a sorted list of the few keys whose slot was taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.shift = np.uint64(64 - bits)
        slot = (fmix(keys) >> self.shift).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.key = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.value = np.full(1 << bits, -1, np.int32)
        self.key[slot[first]], self.value[slot[first]] = keys[first], values[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[slot[rest]] = True
        rest = rest[np.argsort(keys[rest])]
        self.more, self.more_value = np.append(keys[rest], np.uint64(np.iinfo(np.uint64).max)), np.append(values[rest], -1)

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next state of each, -1 where there is none."""
        key = state.astype(np.uint64) << np.uint64(16) | symbol
        slot = (fmix(key) >> self.shift).astype(np.int64)
        miss = self.key[slot] != key
        out = np.where(miss, -1, self.value[slot])
        again = np.flatnonzero(miss & self.crowded[slot])
        if len(again):
            at = np.searchsorted(self.more, key[again])
            out[again] = np.where(self.more[at] == key[again], self.more_value[at], -1)
        return out


@dataclass(frozen=True)
class Model:
    langs: list[str]
    moves: list[tuple[np.ndarray, np.ndarray]]  # per language: sorted keys (state, symbol) and next states; state 0 is the root
    bits: np.ndarray  # what a phrase costs
    tables: list = field(default_factory=list, compare=False)

    def __getstate__(self):
        return {"langs": self.langs, "moves": self.moves, "bits": self.bits, "tables": []}

    def lookups(self) -> list[tuple[Transitions, np.ndarray]]:
        """Per language the transitions and the dense first moves from the root; the last state, of no transition, for other symbols."""
        if not self.tables:
            for keys, values in self.moves:
                dead = int(values.max()) + 1
                first = np.full(1 << 16, dead, np.int32)
                root = keys >> np.uint64(16) == 0
                first[(keys[root] & np.uint64(0xFFFF)).astype(np.int64)] = values[root]
                self.tables.append((Transitions(keys, values), first))
        return self.tables

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Greedy longest-match phrases of every text against every language."""
        out = np.zeros((len(texts), len(self.langs)))
        pieces = [(i, t[k : k + PIECE]) for i, t in enumerate(texts) for k in range(0, len(t), PIECE)]
        for lo in range(0, len(pieces), LANES):
            part = pieces[lo : lo + LANES]
            sizes = np.array([len(p) for _, p in part])
            order = np.argsort(-sizes, kind="stable")
            grid = np.zeros((PIECE, len(part)), np.uint64)
            for row, k in enumerate(order.tolist()):
                grid[: sizes[k], row] = part[k][1]
            alive = np.searchsorted(-sizes[order], -np.arange(PIECE), side="left")
            owner = np.array([part[k][0] for k in order.tolist()])
            for lang, (move, first) in enumerate(self.lookups()):
                count = np.ones(len(part))
                state = first[grid[0].astype(np.int64)]
                for step in range(1, PIECE):
                    n = alive[step]
                    if not n:
                        break
                    symbol = grid[step, :n]
                    after = move(state[:n], symbol)
                    miss = np.flatnonzero(after < 0)
                    count[miss] += 1
                    after[miss] = first[symbol[miss].astype(np.int64)]
                    state[:n] = after
                out[:, lang] += np.bincount(owner, count, minlength=len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        rows, codes = [], []
        for i, text in enumerate(texts):
            if text:
                low, has = symbols(text)
                if has:
                    rows.append(i)
                    codes.append(low)
        if rows:
            cost = self.phrases(codes) * self.bits
            best = cost.argmin(axis=1)
            low = np.partition(cost, 1, axis=1)[:, :2] if cost.shape[1] > 1 else np.c_[cost[:, 0], np.full(len(cost), np.inf)]
            with np.errstate(invalid="ignore"):
                share = np.where(np.isinf(low[:, 1]), 1.0, low[:, 1] / (low[:, 0] + low[:, 1]))
            for i, b, s in zip(rows, best.tolist(), share.tolist(), strict=True):
                lang[i], score[i] = self.langs[b], s
        return lang, score


def build(samples: dict[str, str]) -> Model:
    """A model of whole labelled texts, one per language."""
    return build_coded({lang: symbols(text)[0] for lang, text in samples.items()})


def shares(texts: list[tuple[int, np.ndarray]], total: int = CHARS) -> np.ndarray:
    """Equal shares of texts (hash, symbols) laid end to end with blanks between, ``total`` symbols at most."""
    left, share = total - len(texts), {}
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i][1]))):
        share[i] = min(len(texts[i][1]), max(0, left) // (len(texts) - done))
        left -= share[i]
    parts = []
    for i, (place, code) in enumerate(texts):
        at = place % (len(code) - share[i] + 1)
        parts += [code[at : at + share[i]], np.array([32], code.dtype)]
    out = np.concatenate(parts)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep][:total]


def build_coded(samples: dict[str, np.ndarray]) -> Model:
    """A model of the symbols of each language."""
    coded = {lang: c for lang, c in sorted(samples.items()) if len(c)}
    moves = []
    for text in coded.values():
        pairs = sorted((i << 16 | c, j) for i, state in enumerate(suffix_automaton(text.tolist())) for c, j in state.items())
        moves.append((np.array([k for k, _ in pairs], np.uint64), np.array([j for _, j in pairs], np.int32)))
    bits = np.log2(np.array([len(c) + 1 for c in coded.values()], float)) if coded else np.zeros(0)
    return Model(list(coded), moves, bits)


def train(docs: DataFrame, per_lang: int = DOCS) -> Model:
    """Learn from the training ids of smallest hash of each language (ids are ranked alone, texts come after), one text each however often an id is repeated."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.select("lang", "doc_id").distinct().select("lang", "doc_id", place.alias("place")).filter(F.col("place") <= per_lang)
    place = F.xxhash64("doc_id", "lang")
    # a window as long as the whole sample, so that no long text meets the driver
    window = F.substring("text", (F.pmod(place, F.greatest(F.char_length("text") - CHARS + 1, F.lit(1))) + 1).cast("int"), F.lit(CHARS))
    texts = rows.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "place", "doc_id", window.alias("text"), place.alias("hash"))
    texts = texts.groupBy("lang", "place", "doc_id", "hash").agg(F.min("text").alias("text"))
    samples: dict[str, list[tuple[int, np.ndarray]]] = {}
    for lang, _, text, place in sorted((r.lang, r.place, r.text, r.hash) for r in texts.collect()):
        samples.setdefault(lang, []).append((place, symbols(text)[0]))
    return build_coded({lang: shares(own) for lang, own in samples.items()})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20, 1 << 15):
            lang, score = shared.value.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
