"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. A proposal is the true encoding exactly when every token
encodes to itself and every adjacent pair encodes to that pair, so all pairs of all new words of a batch are
tested at once against a table of known verdicts; only words with a failing pair go through the exact merges.

The exact merges of a word of n letters take n log n steps. Ids are decoded by taking token texts from a table.

The vocabulary file is read by the driver and broadcast (its size is that of the vocabulary, not of the data);
each worker keeps a bounded cache of encoded short words. Texts are taken in segments that end at blanks, so a
worker holds one segment (or one unbroken word) at a time.

Defined results: null and empty texts have no tokens; the control strings of the vocabulary are matched in the raw
text as the library does; a document is encoded whole; repeated rows are encoded each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import holding, slices

#: White space as the library's pattern engine has it.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + BLANK + r"\p{L}\p{N}]+")
#: Texts of these characters alone (no combining marks, no letters whose lower case is longer) need no Unicode classes or
#: normalisation: ASCII, Latin letters up to U+017F, common punctuation.
PLAIN = re.compile(r"[\x00-\x7f\u00a1-\u00a9\u00ab-\u00b1\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac]*")
PLAIN_WORDS = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t\n\x0b\x0c\r a-z0-9\u00df-\u00f6\u00f8-\u017f]+")
CACHE_WORDS = 250_000
#: Longer words are merged on a heap, and are not kept in the cache.
LONG_WORD = 48
#: Characters of a segment, cut at the next blank.
SEGMENT = 1 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary in the JSON form of the tokenizers library."""

    def __init__(self, source: str):
        data = json.loads(source)
        self.vocab: dict[str, int] = data["model"]["vocab"]
        self.end = data["model"]["end_of_word_suffix"]
        self.rank = {tuple(pair): i for i, pair in enumerate(data["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.text = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        cut = len(self.end)
        self.final = {t[:-cut]: i for t, i in self.vocab.items() if t.endswith(self.end)}
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.end)}
        self.longest_final, self.longest_inner = max(map(len, self.final)), max(map(len, self.inner))
        self.letters = byte_letters()
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.whole: dict[int, bool] = {}
        self.known = np.zeros(0, np.int64)
        self.verdict = np.zeros(0, bool)
        self.cache: dict[str, bytes] = {}
        self.table = pa.array([self.text.get(i, "") for i in range(max(self.text) + 1)], pa.string())

    def symbols(self, token: int) -> list[str]:
        text = self.text[token]
        if text.endswith(self.end) and len(text) > len(self.end):
            text = text[: -len(self.end)]
            return [*text[:-1], text[-1] + self.end]
        return list(text)

    def merged(self, parts: list[str]) -> list[int]:
        """The exact merges: always the pair of lowest rank, the leftmost of equals."""
        if len(parts) > LONG_WORD:
            return self.merged_on_heap(parts)
        rank = self.rank
        while len(parts) > 1:
            ranks = [rank.get(pair, 1 << 30) for pair in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 30:
                break
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.vocab[p] for p in parts]

    def merged_on_heap(self, parts: list[str]) -> list[int]:
        """The same merges in n log n: pairs wait on a heap, neighbours are linked."""
        rank, n = self.rank, len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(r, i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank.get(pair)) is not None]
        heapq.heapify(waiting)
        while waiting:
            r, i = heapq.heappop(waiting)
            j = right[i]
            if not parts[i] or j == n or rank.get((parts[i], parts[j])) != r:
                continue  # one of the two has been merged since
            parts[i] += parts[j]
            parts[j] = ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(waiting, (r, i))
            if (h := left[i]) >= 0 and (r := rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(waiting, (r, h))
        return [self.vocab[p] for p in parts if p]

    def proposed(self, word: str) -> list[int]:
        out, i, n = [], 0, len(word)
        final, inner = self.final, self.inner
        while True:
            if n - i <= self.longest_final and (token := final.get(word[i:])) is not None:
                out.append(token)
                return out
            for j in range(min(n - 1, i + self.longest_inner), i, -1):
                if (token := inner.get(word[i:j])) is not None:
                    break
            out.append(token)
            i = j

    def stands(self, token: int) -> bool:
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.merged(self.symbols(token)) == [token]
        return ok

    def verified(self, proposals: list[list[int]]) -> np.ndarray:
        """Which proposals hold: every token stands for itself and every adjacent pair is compatible."""
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(proposals)), lengths)
        tokens, back = np.unique(flat, return_inverse=True)
        fails = ~np.fromiter(map(self.stands, tokens.tolist()), bool, len(tokens))[back]
        bad = np.zeros(len(proposals), bool)
        bad[owner[fails]] = True
        inside = owner[1:] == owner[:-1]
        pairs, first = (flat[:-1] << 32 | flat[1:])[inside], owner[:-1][inside]
        codes, back = np.unique(pairs, return_inverse=True)
        new = np.setdiff1d(codes, self.known, assume_unique=True)
        if len(new):
            fresh = [self.merged(self.symbols(c >> 32) + self.symbols(c & 0xFFFFFFFF)) == [c >> 32, c & 0xFFFFFFFF] for c in new.tolist()]
            self.known, self.verdict = np.concatenate([self.known, new]), np.concatenate([self.verdict, fresh])
            order = np.argsort(self.known)
            self.known, self.verdict = self.known[order], self.verdict[order]
        if len(codes):
            holds = self.verdict[np.searchsorted(self.known, codes)]
            bad[first[~holds[back]]] = True
        return ~bad

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache has not; ids are kept as little-endian 32-bit integers."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.verdict = self.known[:0], self.verdict[:0]
        shown = [w if w.isascii() and w.isprintable() else "".join([self.letters[b] for b in w.encode()]) for w in words]
        proposals = [self.proposed(w) for w in shown]
        for word, text, tokens, ok in zip(words, shown, proposals, self.verified(proposals).tolist(), strict=True):
            if not ok:
                tokens = self.merged([*text[:-1], text[-1] + self.end])
            self.cache[word] = np.array(tokens, "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """Words in order; a control string comes as itself."""
        if self.split and "<|" in text and self.split.search(text):
            return [w for part in self.split.split(text) for w in ([part] if part in self.special else self.pieces_of(part))]
        return self.pieces_of(text)

    @staticmethod
    def pieces_of(text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return PLAIN_WORDS.findall(text.lower())
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as bytes."""
        for content, token in self.special.items():
            self.cache[content] = np.array([token], "<u4").tobytes()
        split, out, open_ = [self.pieces(t) for t in texts], [b""] * len(texts), []
        known = self.cache.__getitem__
        for i, words in enumerate(split):
            try:
                out[i] = b"".join(map(known, words))
            except KeyError:
                open_.append(i)
        if open_:
            new = set().union(*[split[i] for i in open_]).difference(self.cache)
            self.learn(list(new))
            for i in open_:
                out[i] = b"".join(map(known, split[i]))
            for word in new:
                if len(word) > LONG_WORD:
                    del self.cache[word]
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
        return out

    def decode_batch(self, ids: list[bytes]) -> pa.Array:
        """The library's decode of a vocabulary without a decoder: token texts with one blank between."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        tokens = self.table.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), tokens), " ")


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """The text in parts of about ``size`` characters that end before a blank; no word or control string holds one."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size and (cut := text.find(" ", start + size)) >= 0:
        out.append(text[start:cut])
        start = cut
    return [*out, text[start:]]


_MODELS: dict[str, WordBpe] = {}


def _model(key: str, source) -> WordBpe:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = WordBpe(source.value)
    return _MODELS[key]


def _segment_pairs(model: WordBpe, parts: list[str]) -> Iterator[tuple[bytes, str]]:
    """Ids and decoded text of one segment of a very long text after another."""
    for part in parts:
        code = model.encode_batch([part])
        yield code[0], model.decode_batch(code)[0].as_py()


def encode(docs: DataFrame, vocabulary: str, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and on demand ids (array) and decoded (text)."""
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    key, source = hashlib.sha256(content.encode()).hexdigest(), spark.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("bpe", _MODELS.clear)
        model = _model(key, source)
        for part in slices(batches, "text", 1 << 19, 1024):
            rows = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            texts = [segments(t or "") for t in part.column("text").to_pylist()]
            whole = [t[0] for t in texts if len(t) == 1]
            ids = iter(model.encode_batch(whole))
            plain = [next(ids) if len(t) == 1 else None for t in texts]
            shown = iter(model.decode_batch([i for i in plain if i is not None]).to_pylist())
            for own, done in zip(texts, plain, strict=True):
                pairs = [(done, next(shown))] if done is not None else _segment_pairs(model, own)
                count, left, right, kept, shown_text, first = 0, hashlib.sha256(), hashlib.sha256(), [], [], True
                for code, text in pairs:
                    count += len(code) // 4
                    left.update(code)
                    if code:
                        text = text if first else " " + text
                        right.update(text.encode())
                        first = False
                        if with_ids:
                            kept.append(code)
                        if with_text:
                            shown_text.append(text)
                rows["n_tokens"].append(count)
                rows["ids_sha256"].append(left.hexdigest())
                rows["decoded_sha256"].append(right.hexdigest())
                rows["ids"].append(np.frombuffer(b"".join(kept), "<u4").astype(np.int32))
                rows["decoded"].append("".join(shown_text))
            columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(rows["n_tokens"], pa.int64()), "ids_sha256": pa.array(rows["ids_sha256"], pa.string()), "decoded_sha256": pa.array(rows["decoded_sha256"], pa.string())}
            if with_ids:
                columns["ids"] = pa.array(rows["ids"], pa.list_(pa.int32()))
            if with_text:
                columns["decoded"] = pa.array(rows["decoded"], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
