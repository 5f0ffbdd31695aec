"""Toxicity by compression distance between two zstandard dictionaries.

Each dictionary is a base, trained on whole ordinary texts, followed by a part
of its own: in the toxic one, a dictionary trained on excerpts of toxic texts;
in the ordinary one, filling of the same length, so that distances into the base
cost the same in both. A window is a run of `words` words, windows don't
overlap, and a text's equal windows count once. It is compressed with both
dictionaries, between a lead-in and a tail that either holds; its gain is the
ordinary length less the toxic length. A logistic curve over how many windows
reach each calibrated threshold, relative to the number of windows, gives the
score. A window no word of which shares five bytes with the toxic part has no
gain and is not compressed.

Toxic texts are mostly ordinary text, on which both dictionaries do alike.
The toxic part therefore learns from excerpts only: those runs of a toxic text
whose pieces of five and six bytes turn up in toxic texts in significantly more,
and several times as many, distinct contexts as in ordinary ones. How many times
is chosen by what the curve that follows achieves.

Fitting uses a bounded sample: see fit(). Scoring reads every text whole,
whatever its length, and holds one text at a time. Null and empty texts have no
window and get the curve's foot. Rows without label teach nothing; of labels
that contradict each other for one identifier, the toxic one counts; equal rows
teach once. With no toxic or no ordinary label, or an empty table, every score
is 0. Extra columns of the input never clash with those made here.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass, field
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import slices, stored

#: A-Z in lower case; ASCII that is no letter becomes a space.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Bytes of the pieces whose frequencies are compared, and of a match that may pay.
PIECES, MATCH = (5, 6), 5
#: Least gains that count as hits, in bytes.
THRESHOLDS = (2, 4, 6)


def words_of(text: str | None) -> list[bytes]:
    return text.encode(errors="replace").translate(_LETTERS).split() if text else []


def windows_of(words: list[bytes], size: int) -> set[tuple]:
    """The distinct windows; the last one may be shorter (filled with None)."""
    return set(zip_longest(*(words[i::size] for i in range(size)))) if words else set()


def _pieces(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(len(data) - size + 1)]


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(format=zstd.FORMAT_ZSTD1_MAGICLESS, window_log=17, hash_log=15, chain_log=16, search_log=6, min_match=3, target_length=64, strategy=zstd.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT))


def _trained(size: int, samples: list[bytes], **how) -> bytes:
    """A dictionary's bytes; of too few samples for training, the samples themselves."""
    try:
        return zstd.train_dictionary(size, samples, **how).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


class Meter:
    """Gains of windows under a model. Remembers which words may match, for as many words as `limit`."""

    def __init__(self, model: Model, limit: int = 500_000):
        self.size, self.lead, self.tail, self.limit = model.words, model.lead + b" ", b" " + model.tail, limit
        filling = bytes([1]) * len(model.toxic)
        self.ordinary, self.toxic = (_compressor(model.base + own + model.lead) for own in (filling, model.toxic))
        self.shared, self.known = frozenset(_pieces(model.toxic, MATCH)), {}

    def may_match(self, word: bytes) -> bool:
        found = self.known.get(word)
        if found is None:
            found = not self.shared.isdisjoint(_pieces(b" " + word + b" ", MATCH))
            if len(self.known) >= self.limit:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = found
        return found

    def gain(self, window: tuple) -> int:
        data = self.lead + b" ".join(w for w in window if w is not None) + self.tail
        return len(self.ordinary.compress(data)) - len(self.toxic.compress(data))

    def gains_of(self, windows: set[tuple], distinct: set[bytes]) -> np.ndarray:
        """Gains of those windows that may match; distinct: their words."""
        telling = set(filter(self.may_match, distinct))
        met = [w for w in windows if not telling.isdisjoint(w)] if telling else []
        return np.fromiter(map(self.gain, met), np.int64, len(met))

    def gains(self, text: str | None) -> tuple[int, np.ndarray]:
        """(number of distinct windows, gains of those that may match)."""
        words = words_of(text)
        windows = windows_of(words, self.size)
        return len(windows), self.gains_of(windows, set(words))


def features(windows: int, gains: np.ndarray) -> list[float]:
    hits = [int((gains >= t).sum()) for t in THRESHOLDS]
    root = math.sqrt(windows + 1)
    return [1.0, math.log1p(windows), *(math.log1p(h) for h in hits), *(h / root for h in hits)]


@dataclass
class Model:
    base: bytes = b""
    toxic: bytes = b""
    words: int = 4
    weights: list[float] = field(default_factory=list)

    @property
    def lead(self) -> bytes:
        return self.base[-32:]

    @property
    def tail(self) -> bytes:
        """zstandard looks for no match in a block's last bytes; these stand there."""
        return self.base[-64:-48]

    def score(self, text: str | None, meter: Meter) -> float:
        if not self.weights:
            return 0.0
        z = float(np.dot(self.weights, features(*meter.gains(text))))
        return 1 / (1 + math.exp(-min(max(z, -60.0), 60.0)))


def _contexts(texts: list[list[bytes]]) -> tuple[Counter, int]:
    """In how many distinct (word, next word) pairs each word stands, and the number of pairs. Copies of a text count once by that."""
    pairs = {p for t in texts for p in zip(t, [*t[1:], b""], strict=True)}
    return Counter(w for w, _ in pairs), len(pairs)


def telling_pieces(toxic: list[list[bytes]], ordinary: list[list[bytes]], least: float = 6.0, times: float = 8.0) -> dict[bytes, float]:
    """piece -> how many times as frequent it is in toxic texts.

    Pieces are kept from `times` on, where the signed root of the log-likelihood
    ratio of both frequencies reaches `least`.
    """
    (a, n), (b, m) = _contexts(toxic), _contexts(ordinary)
    found, at = {}, lambda word, size: set(_pieces(b" " + word + b" ", size))
    for size in PIECES:
        here, there = Counter(), Counter()
        for word, k in a.items():
            for piece in at(word, size):
                here[piece] += k
        enough = {piece for piece, k in here.items() if 2 * k * math.log((n + m) / n) >= least**2}  # what fewer cannot reach
        for word, k in b.items():
            for piece in at(word, size) & enough:
                there[piece] += k
        for piece in enough:
            x, y = here[piece], there[piece]
            ratio = (x / n) / ((y + 1) / m)
            if ratio >= times and x * math.log(x * (n + m) / ((x + y) * n)) + (y * math.log(y * (n + m) / ((x + y) * m)) if y else 0.0) >= least**2 / 2:
                found[piece] = ratio
    return found


def excerpts(text: list[bytes], pieces: frozenset[bytes]) -> list[bytes]:
    """The runs of a text's words that the pieces cover."""
    found = []
    for word in text:
        data, runs = b" " + word + b" ", []
        for i in range(len(data) - PIECES[0] + 1):
            ends = [i + n for n in PIECES if data[i : i + n] in pieces]
            if ends and runs and i <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], *ends)
            elif ends:
                runs.append([i, max(ends)])
        found += [data[i:j] for i, j in runs]
    return found


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method; returns the weights and the mean log loss."""
    w, keep = np.zeros(x.shape[1]), np.diag([0.0] + [ridge * weight.sum()] * (x.shape[1] - 1))
    weight = weight / weight.mean()

    def loss(v):
        z = x @ v
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * v @ keep @ v)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.lstsq((x * (weight * p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (weight * (p - y)) + keep @ w, rcond=None)[0]
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w, loss(w) / len(y)


def fit_sample(sample: pd.DataFrame, rates: tuple[float, float], words: int = 4, toxic_bytes: int = 2048, ordinary_bytes: tuple[int, ...] = (2048, 4096), times: tuple[float, ...] = (8, 12), at: float = 0.3) -> Model:
    """From text and toxic (0 or 1). rates: how many rows each class has in all.

    times: how many times as frequent an excerpt's pieces are in toxic texts, at
    least; ordinary_bytes: sizes of the base. Of these, those are taken that give the best F1 at `at`.
    """
    if not {0, 1} <= set(sample["toxic"]):
        return Model(words=words)
    sample = sample.drop_duplicates()
    y = sample["toxic"].to_numpy(float)
    texts = [words_of(t) for t in sample["text"]]
    toxic, ordinary = ([t for t, c in zip(texts, y, strict=True) if c == k] for k in (1, 0))
    weight = np.where(y == 1, rates[1] / max(1, y.sum()), rates[0] / max(1, (1 - y).sum()))
    ratios = telling_pieces(toxic, ordinary, times=min(times))
    cut = [(windows_of(t, words), set(t)) for t in texts]
    runs = [b" ".join(t[i : i + 8]) for t in ordinary for i in range(0, len(t), 8)]
    bases = [_trained(size, runs, k=64, d=8).rjust(64, b" ") for size in ordinary_bytes]
    best, best_worth = Model(words=words), (-1.0, 0.0)
    for least in times:
        pieces = frozenset(p for p, r in ratios.items() if r >= least)
        own = [b"\n".join(x) for t in toxic if (x := excerpts(t, pieces))]  # no window holds the line break
        trained = _trained(toxic_bytes, own, k=16, d=6) if own else b""
        for base in bases:
            model = Model(base, trained, words)
            meter = Meter(model)
            x = np.array([features(len(w), meter.gains_of(w, distinct)) for w, distinct in cut])
            weights, loss = _logistic(x, y, weight)
            model.weights = weights.tolist()
            said = 1 / (1 + np.exp(-np.clip(x @ weights, -60, 60))) >= at
            hit, wrong = float((weight * said * y).sum()), float((weight * (said != y)).sum())
            worth = (hit / max(hit + wrong / 2, 1e-9), -loss)
            if worth > best_worth:
                best, best_worth = model, worth
    return best


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1000, most_bytes: int = 24 << 20, **options) -> Model:
    """Fit on labelled rows for which `learn` (a condition on id_col) holds.

    The sample has about `per_class` identifiers of toxic rows and twice that of
    ordinary ones, drawn by a hash of the identifier, or the smaller share of them
    that holds about `most_bytes` of text. Further options are those of fit_sample().
    """
    known = labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if not counts.get(0) or not counts.get(1):
        return Model()
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, 2 * per_class / counts[0]))
    drawn = known.filter(F.pmod(F.xxhash64("__id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20) < share)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    sample = stored(rows.join(F.broadcast(drawn), "__id").distinct(), "sample")  # drawn is bounded by per_class
    size = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        sample = sample.filter(F.pmod(F.xxhash64("__id", "text"), F.lit(1 << 20)) / float(1 << 20) < most_bytes / size)
    return fit_sample(sample.orderBy("__id", "text").select("text", "toxic").toPandas(), (counts[0], counts[1]), **options)


_meters: dict[str, tuple[Model, Meter]] = {}


def _resident(tag: str, shared) -> tuple[Model, Meter]:
    if tag not in _meters:
        _meters.clear()
        _meters[tag] = (shared.value, Meter(shared.value))
    return _meters[tag]


def _scored(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """docs with a last column, score. Column names must differ from it."""
    shared, tag = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # a few kilobytes

    def work(batches):
        own, meter = _resident(tag, shared)
        for batch in slices(batches, 1000):
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.score(t.as_py(), meter) for t in texts], pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(work, docs.withColumn("score", F.lit(0.0)).schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) for each row."""
    return _scored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), model, "text").select("id", "score")


def without_toxic(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below `least`, with docs' columns."""
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    found = _scored(docs.select(*columns), model, f"c{docs.columns.index(text_col)}")
    return found.filter(F.col("score") < least).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
