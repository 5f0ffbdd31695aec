"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is fixed and public. Each language has a probability for each
piece, and a word's probability is the sum over every way to cut it into
pieces, by the forward algorithm. No piece of the vocabulary reaches across
white space, so a text's score is the sum of its words' log scores, and each
distinct word is scored once in a task. The probabilities are fitted by
expectation-maximisation (forward and backward) on the word counts of a bounded
sample of labelled rows; every text is scored whole.

A text without a letter, or null, is "und" with score 0. Rows whose label is
null teach nothing; with no labelled row at all, every text is "und". Ties go to
the first language by name. Repeated rows get equal results.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import slices

UNKNOWN = "und"
#: The vocabulary's mark for the start of a word.
MARK = "▁"


def load_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [p for p in map(model.id_to_piece, ids) if MARK not in p[1:]]


class Pieces:
    """The vocabulary's pieces by length, as sorted 64-bit hashes of their code points."""

    _BASE = np.uint64(0x100000001B3)

    def __init__(self, pieces: list[str]):
        self.pieces, self.unknown = pieces, len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.keys, self.numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for n in range(1, self.longest + 1):
            own = [(self._hash(p), i) for i, p in enumerate(pieces) if len(p) == n]
            own.sort()
            self.keys.append(np.array([h for h, _ in own], np.uint64))
            self.numbers.append(np.array([i for _, i in own], np.int64))
        every = np.concatenate(self.keys)
        if len(np.unique(every)) < len(every):
            raise ValueError("two pieces have the same hash")

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self._BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """word, begin, end and piece of every piece that occurs in a word with its mark; a character that is no piece is an unknown one."""
        text = "".join([MARK + w for w in words])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        start = (np.cumsum(sizes) - sizes)[word]
        left = start + sizes[word] - np.arange(len(codes))
        at, h, out = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for n in range(1, self.longest + 1):
            stay = left[at] >= n
            at, h = at[stay], h[stay]
            if not len(at):
                break
            h = h * self._BASE + codes[at + n - 1]
            keys = self.keys[n]
            if len(keys):
                place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[place] == h
                piece = np.where(hit, self.numbers[n][place], self.unknown)
            else:
                hit, piece = np.zeros(len(at), bool), np.full(len(at), self.unknown)
            take = hit | (n == 1)
            here = at[take]
            out.append((word[here], here - start[here], here - start[here] + n, piece[take]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


@dataclass
class Lattice:
    """The pieces that occur in some words, as arcs; words are grouped so that each array step serves all of them.

    word, begin, end: of each arc, in code points of the word with its mark; piece: its number, or the number of pieces for an unknown character.
    """

    words: list[str]
    word: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, words: list[str], pieces: Pieces) -> Lattice:
        return cls(words, *pieces.arcs(words))

    def _by(self, key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(arcs, where each word begins among them) for each value of key, ascending."""
        order = np.lexsort((self.word, key))
        cuts = np.append(np.flatnonzero(np.diff(key[order], prepend=-1)), len(order))
        parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [(p, np.flatnonzero(np.diff(self.word[p], prepend=-1))) for p in parts]

    def short_forward(self, logs: np.ndarray) -> np.ndarray:
        """forward()'s log scores for words short enough for plain products."""
        sizes = np.array([len(w) + 2 for w in self.words])
        base = np.cumsum(sizes) - sizes
        at, p = np.zeros((int(sizes.sum()), logs.shape[1])), np.exp(logs)
        at[base] = 1.0
        for arcs, cuts in self._by(self.end):
            at[base[self.word[arcs[cuts]]] + self.end[arcs[cuts]]] = np.add.reduceat(at[base[self.word[arcs]] + self.begin[arcs]] * p[self.piece[arcs]], cuts)
        return np.log(at[base + sizes - 1])

    def forward(self, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log scores, forward sums by word and place, base): logs has a row for each piece and a column for each language.

        Sums stay in range as each place is kept relative to the largest piece of its word so far.
        """
        sizes = np.array([len(w) + 2 for w in self.words])
        base = np.cumsum(sizes) - sizes
        at = np.full((int(sizes.sum()), logs.shape[1]), -np.inf)
        at[base] = 0.0
        for arcs, cuts in self._by(self.end):
            come = at[base[self.word[arcs]] + self.begin[arcs]] + logs[self.piece[arcs]]
            top = np.maximum.reduceat(come, cuts)
            many = np.diff(np.append(cuts, len(arcs)))
            total = np.add.reduceat(np.exp(come - np.repeat(top, many, 0)), cuts)
            at[base[self.word[arcs[cuts]]] + self.end[arcs[cuts]]] = top + np.log(total)
        return at[base + sizes - 1], at, base

    def expected(self, logs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of each piece (and of unknown characters) over all segmentations; weight: occurrences of each word, one column."""
        score, at, base = self.forward(logs)
        sizes = np.array([len(w) + 2 for w in self.words])
        back = np.full_like(at, -np.inf)
        back[base + sizes - 1] = 0.0
        for arcs, cuts in reversed(self._by(self.begin)):
            come = back[base[self.word[arcs]] + self.end[arcs]] + logs[self.piece[arcs]]
            top = np.maximum.reduceat(come, cuts)
            many = np.diff(np.append(cuts, len(arcs)))
            back[base[self.word[arcs[cuts]]] + self.begin[arcs[cuts]]] = top + np.log(np.add.reduceat(np.exp(come - np.repeat(top, many, 0)), cuts))
        share = np.exp(at[base[self.word] + self.begin] + logs[self.piece] + back[base[self.word] + self.end] - score[self.word])[:, 0] * weight[self.word]
        return np.bincount(self.piece, share, logs.shape[0])


class _Numbers(dict):
    """word -> its row in the table of scores, given on first use; new words wait in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


#: Splits at everything in ASCII that is no letter; other characters stay in words.
_GAPS = {i: " " for i in range(128) if not chr(i).isalpha()}


def words_of(text: str | None) -> list[str]:
    return text.lower().translate(_GAPS).split() if text else []


@dataclass
class Model:
    pieces: list[str]
    languages: list[str]
    logs: np.ndarray
    prior: np.ndarray

    #: Words that are remembered, and the length beyond which products are taken in logarithms.
    LIMIT, LONG = 400_000, 32

    def __post_init__(self):
        self.lookup = Pieces(self.pieces)
        self._anew()

    def _anew(self) -> None:
        self.numbers, self.table = _Numbers(), np.zeros((0, len(self.languages)))

    @classmethod
    def fit(cls, counts: dict[str, Counter], pieces: list[str], rounds: int = 4, smooth: float = 0.1) -> Model:
        """counts: words of each language with their occurrences."""
        languages = sorted(counts)
        lookup = Pieces(pieces)
        logs = np.zeros((len(pieces) + 1, len(languages)))
        for k, lang in enumerate(languages):
            words = sorted(counts[lang])
            weight = np.array([counts[lang][w] for w in words], float)
            own = np.full((len(pieces) + 1, 1), -math.log(len(pieces) + 1))
            own[:-1, 0] += [0.5 * len(p) for p in pieces]  # at first, few long pieces rather than many short ones
            lattice = Lattice.of(words, lookup)
            for _ in range(rounds):
                got = lattice.expected(own, weight) + smooth
                own = np.log(got / got.sum())[:, None]
            logs[:, k] = own[:, 0]
        total = np.array([sum(counts[x].values()) for x in languages], float)
        return cls(pieces, languages, logs, np.log(total / total.sum()) if len(languages) else total)

    def _learn(self) -> None:
        """Score the words that wait."""
        words, self.numbers.fresh = self.numbers.fresh, []
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            scores = np.zeros((len(part), len(self.languages)))
            for long in (False, True):
                own = [k for k, w in enumerate(part) if (len(w) > self.LONG) == long]
                if own:
                    lattice = Lattice.of([part[k] for k in own], self.lookup)
                    scores[own] = lattice.forward(self.logs)[0] if long else lattice.short_forward(self.logs)
            self.table = np.concatenate([self.table, scores])

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability among the languages) of each text. The probability takes the square root of the words as their number: words are not independent."""
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self.numbers) >= self.LIMIT:
            self._anew()
        out = []
        places = [np.fromiter(map(self.numbers.__getitem__, w), np.int64, len(w)) for w in map(words_of, texts)]
        self._learn()
        for text, at in zip(texts, places, strict=True):
            if not text or not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0))
                continue
            total = self.prior + self.table[at].sum(0)
            p = np.exp((total - total.max()) / max(1.0, math.sqrt(len(at))))
            best = int(np.argmax(total))
            out.append((self.languages[best], float(p[best] / p.sum())))
        return out


def fit(rows: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", per_language: int = 400, *, order: Column, **options) -> Model:
    """Fit on about per_language rows of each language (1.2 times that are expected), whole texts, chosen by a hash of `order`, which should tell rows apart.

    The sample's word counts are made on the cluster; the driver gets the
    distinct words of the sample.
    """
    labelled = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), order.alias("order"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.2 * per_language / n))) for k, n in counts.items()], F.lit(0.0))
    drawn = labelled.filter(F.pmod(F.xxhash64("order", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)
    kept: dict[str, Counter] = {k: Counter() for k in counts}

    def count(batches):
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            found = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["lang", "word", "n"])

    words = drawn.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for lang, word, n in words.toPandas().itertuples(index=False):
        kept[lang][word] += n
    return Model.fit(kept, load_vocabulary(vocabulary), **options)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (0 to 1) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.pieces, model.languages, model.logs, model.prior))  # the vocabulary's size
    tag = uuid.uuid4().hex

    def work(batches):
        own = _resident(tag, shared)
        for batch in slices(batches, 1000):
            found = own.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "id long, lang_pred string, score double")


_models: dict[str, Model] = {}


def _resident(tag: str, shared) -> Model:
    """The model with its table of words, kept while a worker serves tasks of one query."""
    if tag not in _models:
        _models.clear()
        _models[tag] = Model(*shared.value)
    return _models[tag]
