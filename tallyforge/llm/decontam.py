"""Benchmark decontamination by winnowing.

Texts are runs of word characters, A-Z lower-cased. The fingerprints of a text
are, for every `window - gram + 1` consecutive grams of `gram` words, the least
hash among them. Equal spans of `window` words have the same grams, so the same
least hash: every shared span of that length has a fingerprint in common. Where
a document's fingerprint is one of the benchmark's, the hit is extended: every
window of `window` words that covers it is looked up among the benchmark's
windows and compared word by word, and overlapping windows join to spans.

Items shorter than a window are one window of their own length; winnowing
promises nothing for those, so each document position is looked up for each such
length.

The benchmark is a set of queries against all rows. Its index is broadcast in
blocks of at most `block_bytes` of text; a document passes through one Arrow map
for each block, without a shuffle. Null text has no words, an item without words
or identifier is no item, repeated items count once by identifier, and with an
empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, utf8

#: Lower-cases A-Z; a byte of a word keeps its value, every other becomes 0. Bytes over 127 belong to characters that are all word characters.
_WORD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a column of texts: hash, row, and bounds in data. first[r] : first[r + 1] are those of row r."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray):
        self.data = _WORD[raw]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = self.data != 0
        # a word also ends where its text ends
        change = inside[1:] != inside[:-1]
        starts = np.flatnonzero(change & inside[1:])
        stops = np.flatnonzero(change & inside[:-1])
        bounds = offsets[1:-1]
        across = bounds[(bounds > 0) & (bounds < len(raw))]
        across = across[inside[across] & inside[across + 1]]
        if len(across):
            across = np.unique(across)
            starts, stops = np.sort(np.append(starts, across)), np.sort(np.append(stops, across))
        self.starts, self.stops = starts, stops
        self.first = np.searchsorted(starts, offsets)
        self.first[-1] = len(starts)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        """Words in groups of a length, so that no array is larger than the text."""
        size = self.stops - self.starts
        out = np.zeros(len(size), np.uint64)
        order = np.argsort(size, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(size[order], prepend=-1)), len(order))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at, n = order[a:b], int(size[order[a]])
            if n > 64:
                for i in at:
                    out[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.stops[i]].tobytes(), digest_size=8).digest(), "little")
                continue
            h, begin = np.full(len(at), np.uint64(n)), self.starts[at]
            for k in range(n):
                h = h * _BASE + self.data[begin + k]
            out[at] = _mix(h * _STEP)
        return out

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n words from each word on; NONE where a text has no n words left."""
        out = np.full(len(self.hash), NONE)
        m = len(self.hash) - n + 1
        if m > 0:
            h = np.zeros(m, np.uint64)
            for k in range(n):
                h = h * _BASE + self.hash[k : k + m]
            h = _mix(h * _STEP)
            h[h == NONE] = 0
            out[:m] = np.where(self.row[:m] == self.row[n - 1 :], h, NONE)
        return out

    def words(self, at: int, n: int) -> tuple[bytes, ...]:
        return tuple(self.data[self.starts[i] : self.stops[i]].tobytes() for i in range(at, at + n))


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least gram in every `width` consecutive ones, also in shorter texts; of equals each counts."""
    if not len(grams):
        return np.zeros(0, np.int64)
    pad = np.concatenate([np.full(width - 1, NONE), grams, np.full(width - 1, NONE)])
    least = pad[: len(grams) + width - 1].copy()
    for k in range(1, width):
        np.minimum(least, pad[k : k + len(least)], out=least)
    # a gram is chosen if it equals the least of any window that holds it
    most = least[: len(grams)].copy()
    for k in range(1, width):
        np.maximum(most, np.where(least[k : k + len(grams)] == NONE, np.uint64(0), least[k : k + len(grams)]), out=most)
    return np.flatnonzero((grams == most) & (grams != NONE))


class Index:
    """Windows of the items, by their length in words, and the items' fingerprints."""

    def __init__(self, items: list[tuple[int | str, str]], window: int = 10, gram: int = 5):
        self.window, self.gram = window, gram
        items = [(i, t) for i, t in items if i is not None and t]
        raw = [t.encode() for _, t in items]
        offsets = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
        words = Words(offsets, np.frombuffer(b"".join(raw), np.uint8))
        self.names = [str(i) for i, _ in items]
        #: by length: hash -> the windows of that hash, each its words and its items
        self.windows: dict[int, dict[int, list[tuple[tuple[bytes, ...], set[int]]]]] = {}
        counts, grams = np.diff(words.first), {}
        for r, n in enumerate(counts.tolist()):
            if n:
                size = min(n, window)
                if size not in grams:
                    grams[size] = words.grams(size)
                hashes = grams[size]
                for at in range(int(words.first[r]), int(words.first[r]) + n - size + 1):
                    same = self.windows.setdefault(size, {}).setdefault(int(hashes[at]), [])
                    text = words.words(at, size)
                    known = next((x for x in same if x[0] == text), None)
                    if known is None:
                        same.append((text, {r}))
                    else:
                        known[1].add(r)
        keys = words.grams(gram)
        self.prints = np.unique(keys[winnow(keys, window - gram + 1)])
        self.hashes = {n: np.array(sorted(x), np.uint64) for n, x in self.windows.items()}

    @staticmethod
    def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(x), bool)
        at = np.searchsorted(known, x)
        return known[np.minimum(at, len(known) - 1)] == x

    def search(self, words: Words) -> list[tuple[int, int, set[int]]]:
        """(first word, number of words, items) of every window in the texts."""
        found = []

        def confirm(n: int, places: np.ndarray, hashes: np.ndarray) -> None:
            for at in places.tolist():
                text = words.words(at, n)
                for known, items in self.windows[n][int(hashes[at])]:
                    if known == text:
                        found.append((at, n, items))

        for n, known in self.hashes.items():
            if n < self.window:
                hashes = words.grams(n)
                confirm(n, np.flatnonzero(self._among(hashes, known) & (hashes != NONE)), hashes)
        if self.window in self.hashes:
            grams = words.grams(self.gram)
            seeds = winnow(grams, self.window - self.gram + 1)
            seeds = seeds[self._among(grams[seeds], self.prints)]
            if len(seeds):
                # extension: the windows that cover a common fingerprint
                places = np.unique(seeds[:, None] - np.arange(self.window - self.gram + 1))
                places = places[places >= 0]
                hashes = words.grams(self.window)
                confirm(self.window, places[self._among(hashes[places], self.hashes[self.window]) & (hashes[places] != NONE)], hashes)
        return found


def spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """docs with n_words (long), hits (array of (start, words) spans that benchmark windows cover) and items (their identifiers as strings, sorted)."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs.select("*", F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<struct<start:long,words:long>>").alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in part.collect()], window, gram))  # a block
        out = _pass(out, index, text_col)
    return out


def _pass(docs: DataFrame, index, text_col: str) -> DataFrame:
    def work(batches):
        known = index.value
        for batch in slices(batches, 500):
            at = batch.schema.get_field_index(text_col)
            words = Words(*utf8(batch.column(at)))
            rows: dict[int, list] = {}
            for place, n, items in known.search(words):
                rows.setdefault(int(words.row[place]), []).append((place - int(words.first[words.row[place]]), n, items))
            hits, names = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            hits = [[(x["start"], x["words"]) for x in h] if h else [] for h in hits]
            names = [n or [] for n in names]
            for r, found in rows.items():
                merged: list[tuple[int, int]] = []
                for start, n in sorted([*hits[r], *((p, n) for p, n, _ in found)]):
                    if merged and start <= sum(merged[-1]):
                        merged[-1] = (merged[-1][0], max(sum(merged[-1]), start + n) - merged[-1][0])
                    else:
                        merged.append((start, n))
                hits[r] = merged
                names[r] = sorted({*names[r], *(known.names[i] for _, _, items in found for i in items)})
            new = [pa.array(np.diff(words.first)), pa.array([[{"start": s, "words": n} for s, n in h] for h in hits], batch.schema.types[-2]), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *new], [*batch.schema.names])

    return docs.mapInArrow(work, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_words, n_hit, n_items, items, hits, contaminated for each row."""
    found = spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), benchmark, **options)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return found.select("id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "hits", (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with docs' columns."""
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]  # so that no column clashes with the operator's
    found = spans(docs.select(*columns), benchmark, text_col=f"c{docs.columns.index(text_col)}", **options)
    return found.filter(F.size("hits") == 0).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
