"""SimHash fingerprints, BK-trees for those within a radius, and their components.

Distinct fingerprints are dealt to shards, and each shard searches its own
BK-tree: the children of a node are keyed by their Hamming distance to it, and a
query follows only the edges within the radius of its own distance. Fingerprints
that differ in at most r bits agree in at least one of r + 1 runs of bits, so a
shard holds the fingerprints that agree in one run, and each fingerprint is in
r + 1 shards: no pair within the radius is missed, and a tree's size does not
follow the corpus. A broadcast of all trees would; hence each shard's queries
are sent to its tree instead. Shards over MOST_IN_TREE are dealt once more by
runs of the remaining bits, by the same argument.

A shard returns, for each fingerprint that has a neighbour, one link to the
smallest fingerprint of its group, never all pairs.

Null or blank text has no word and fingerprint zero, which links like any
other. Null identifiers are no component's smallest. Repeated rows share their
component; an empty table gives none.

`similar_documents`, for the pipeline, takes such links as proposals, checks them
by the Jaccard similarity of shingle sets, and finds the pairs of that similarity
which fingerprints miss; see the note above SAMPLE_DOCS.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import last, mark, slices, stored
from tallyforge.llm.components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fingerprints in one tree; a shard with more is dealt anew.
MOST_IN_TREE = 50_000
LEAF = 16


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of `words` words (or of the whole sequence if it is shorter), as unsigned integers."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[:n].tolist()
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp) of every row, fp as a signed long; written to the shared folder."""

    def work(batches):
        for batch in slices(batches, 2000):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(shingle_hashes(t, words, seed)) if t else 0 for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(work, "id long, fp long"), "fingerprints")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances; fingerprints are integers or rows of several."""
    bits = np.bitwise_count(a ^ b)
    return bits.sum(-1, dtype=np.int64) if bits.ndim == 2 else bits.astype(np.int64)


def neighbour_roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct unsigned fingerprints, the index of the smallest that it is joined to within radius, through any number of steps.

    The BK-tree and its search advance together: at a node, all queries that
    come this way meet its pivot, and each edge takes on the items at its
    distance and the queries within the radius of it.
    """
    parent = np.arange(len(fps))

    def root(i: np.ndarray) -> np.ndarray:
        while True:
            up = parent[i]
            if (up == i).all():
                return i
            parent[i] = parent[up]
            i = up

    stack = [(np.arange(len(fps)), np.arange(len(fps)))]
    while stack:
        items, queries = stack.pop()
        if len(items) <= LEAF:
            pivots, rest = items, items[:0]
        else:
            pivots, rest = items[:1], items[1:]
        for pivot in pivots:
            away = _apart(fps[queries], fps[pivot])
            near = queries[away <= radius]
            if len(near) > 1 or len(near) and near[0] != pivot:
                roots = root(np.append(near, pivot))
                parent[roots] = roots.min()
        if len(rest):
            edge = _apart(fps[rest], fps[pivots[0]])
            order = np.argsort(edge, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(edge[order], prepend=-1)), len(order))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                come = queries[np.abs(away - edge[order[a]]) <= radius]
                if len(come):
                    stack.append((rest[order[a:b]], come))
    return root(np.arange(len(fps)))


def _runs(bits: list[int], parts: int) -> list[list[int]]:
    cuts = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def _shards(bits: list[int], radius: int) -> list[Column]:
    """(run, value of those bits) for each of radius + 1 runs of bits."""
    return [F.struct(F.lit(i).alias("run"), F.col("fp").bitwiseAND(F.lit(_signed(run))).alias("value")) for i, run in enumerate(_runs(bits, radius + 1))]


def links(distinct: DataFrame, radius: int, most: int = MOST_IN_TREE) -> DataFrame:
    """(high, low) fingerprints: a spanning set of the pairs within radius. distinct: one row for each fp."""
    runs = _runs(list(range(64)), radius + 1)
    dealt = distinct.select("fp", F.explode(F.array(*_shards(list(range(64)), radius))).alias("shard")).select("fp", "shard.run", "shard.value", F.lit(-1).alias("run2"), F.lit(0).cast("long").alias("value2"))
    sizes = dealt.groupBy("run", "value").count().filter("count > 1")
    large = stored(sizes.filter(F.col("count") > most).select("run", "value"), "large")
    if large.limit(1).count():
        split = dealt.drop("run2", "value2").join(large, ["run", "value"], "left_semi")
        other = F.coalesce(*[F.when(F.col("run") == i, F.array(*_shards([b for b in range(64) if b not in run], radius))) for i, run in enumerate(runs)])
        split = split.select("fp", "run", "value", F.explode(other).alias("s")).select("fp", "run", "value", F.col("s.run").alias("run2"), F.col("s.value").alias("value2"))
        dealt = dealt.join(large, ["run", "value"], "left_anti").unionByName(split)
    keys = ["run", "value", "run2", "value2"]

    def search(batches):
        """Rows arrive sorted by shard."""
        last, held = None, []

        def found(fps):
            fps = np.sort(np.array(fps, np.int64).view(np.uint64))
            low = neighbour_roots(fps, radius)
            moved = np.flatnonzero(low != np.arange(len(fps)))
            return fps[moved].view(np.int64), fps[low[moved]].view(np.int64)

        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            for fp, *shard in zip(batch.column("fp").to_pylist(), *columns, strict=True):
                if shard != last:
                    if len(held) > 1:
                        out.append(found(held))
                    last, held = shard, []
                held.append(fp)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found(held)], ["a", "b"])

    pairs = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long")
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))


def _components(table: DataFrame, found: DataFrame) -> DataFrame:
    """table (id, fp) with component_id, from links (high, low) between its fingerprints."""
    distinct = stored(table.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    star = components(found).select(F.col("high").alias("fp"), F.col("low").alias("root"))
    ends = star.unionByName(star.select(F.col("root").alias("fp"), "root")).distinct()
    least = ends.join(distinct, "fp").groupBy("root").agg(F.min("low").alias("least"))
    joined = ends.join(least, "root").select("fp", "least")
    final = stored(distinct.join(joined, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id")), "components")
    return table.join(final, "fp").select("id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component_id) for each row: component_id is the smallest identifier reachable over links within radius."""
    table = fingerprints(docs, id_col, text_col, words, seed)
    return _components(table, links(stored(table.select("fp").distinct(), "distinct"), radius))


# Pairs by the Jaccard similarity of their shingle sets itself. In any order of all
# shingles, two sets of that similarity share one of their first few (prefix filter);
# with the shingles that are frequent in a sample last, few unrelated sets do. The
# sample, the lists' sizes and the leaders change the time only, never the pairs.

#: Documents whose shingles are counted for the order, and frequent shingles held.
SAMPLE_DOCS, MOST_FREQUENT = 20_000, 200_000
#: Bits of a set's sketch. Sets of over twice as many shingles are told apart by their places in lists alone.
SKETCH_BITS = 4096
#: Times at most that leaders are drawn.
LEADER_TURNS = 5
#: Parts of the sets, at least, while the pairs of short lists are checked; each two have a turn.
SIDES = 2
#: Bits that say which sets are wanted; with more sets than a quarter of them, all sets are dealt.
WANTED_BITS = 1 << 26


def _key(hashes: np.ndarray) -> int:
    """One number for a set of shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).astype(np.int64))


def _set_of(text: bytes | None, words: int, seed: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or b"", words, seed))


def _least(size, similarity: float):
    """The least number of shared shingles with an equally large or larger set."""
    return np.ceil(np.asarray(size) * similarity - 1e-9).astype(np.int64)


def _may(at: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets can be similar that share no shingle before this one; at: size << 32 | place of the shingle."""
    n, m = at >> 32, other >> 32
    i, j = at & 0xFFFFFFFF, other & 0xFFFFFFFF
    most = np.minimum(n - i, m - j)
    return most * (1 + similarity) >= similarity * (n + m) - 1e-6


def _frequent(texts: DataFrame, rows: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) that at least three documents of a sample hold, ascending by shingle."""

    def work(batches):
        for batch in slices(batches, 200):
            sets = [_set_of(t, words, seed) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    drawn = texts.filter(F.pmod(F.xxhash64("text", F.lit(23)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_DOCS / max(1, rows)))).select("text")
    several = stored(drawn.mapInArrow(work, "h long").groupBy("h").count().filter("count >= 3"), "counts")
    counts = several.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).toPandas()
    h, n = counts["h"].to_numpy(np.int64).view(np.uint64), counts["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _rows(column: pa.Array) -> np.ndarray:
    """Numbers, or, of binary values of one length, rows of 64-bit words."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH_BITS // 64)


def _lists(batches, columns: list[str]):
    """Arrays of whole lists, from rows sorted by token; a list may go on in the next batch."""
    held = None
    for batch in batches:
        now = [_rows(batch.column(c)) for c in columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        last = int(np.flatnonzero(np.diff(held[0], prepend=held[0][0]))[-1]) if len(held[0]) and held[0][0] != held[0][-1] else 0
        if last:
            yield [x[:last] for x in held]
            held = [x[last:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _bounds(token: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token))


def _once(token: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each set once in a list, by key, however many documents have it."""
    order = np.lexsort((key, token))
    token, key, at = token[order], key[order], at[order]
    new = np.append(True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]))
    return token[new], key[new], at[new]


def _pairs(keys: list[np.ndarray], others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (high, low)."""
    a, b = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *others])
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0)
    return both[:, 0].copy(), both[:, 1].copy()


def _mix(keys: np.ndarray, turn: int) -> np.ndarray:
    h = (keys.view(np.uint64) ^ np.uint64(turn * 0x9E3779B1)) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def _few(token: np.ndarray, key: np.ndarray, at: np.ndarray, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low) of all possible pairs in lists of up to `most` rows, and which rows are in larger lists."""
    cuts = _bounds(token)
    size = np.repeat(np.diff(cuts), np.diff(cuts))
    keys, others = [], []
    for lag in range(1, min(most, int(size.max(initial=0)))):
        x = np.flatnonzero((size[lag:] <= most) & (token[lag:] == token[:-lag]))
        x = x[_may(at[x], at[x + lag], similarity)]
        keys.append(key[x])
        others.append(key[x + lag])
    return *_pairs(keys, others), size > most


def _sketch(hashes: np.ndarray) -> bytes:
    """For each residue of the shingles modulo SKETCH_BITS, whether an odd number has it. Bits that differ each stand for a shingle that only one of two sets has."""
    odd = np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _close(at: np.ndarray, sketch: np.ndarray, other_at: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches (rows of 64-bit words) leave room for similarity: sets of n and m shingles may differ in that share of n + m."""
    differ = np.bitwise_count(sketch ^ other).sum(-1, dtype=np.int64)
    return differ * (1 + similarity) <= ((at >> 32) + (other_at >> 32)) * (1 - similarity) + 1e-6


def _led(key: np.ndarray, at: np.ndarray, root: np.ndarray, sketch: np.ndarray, similarity: float, turn: int, leaders: int = 8) -> tuple[list, list]:
    """Possible pairs of a list's rows and a few of them, of different components."""
    keys, others, order = [], [], np.argsort(_mix(key, turn))
    _, first = np.unique(root[order], return_index=True)
    for i in order[np.sort(first)[:leaders]]:
        x = np.flatnonzero((root != root[i]) & _may(at, at[i], similarity))
        x = x[_close(at[x], sketch[x], at[i], sketch[i], similarity)]
        keys.append(key[x])
        others.append(np.full(len(x), key[i]))
    return keys, others


def _spanned(key: np.ndarray, at: np.ndarray, root: np.ndarray, sketch: np.ndarray, similarity: float):
    """Of a list's possible pairs of different components, as many as would join all that they could join if each held: fewer than rows."""
    order = np.argsort(at)
    key, at, root, sketch = key[order], at[order], root[order], sketch[order]
    n = at >> 32
    for i in range(len(key) - 1):
        end = int(np.searchsorted(n, n[i] / similarity + 1, "right"))
        x = i + 1 + np.flatnonzero(root[i + 1 : end] != root[i])
        x = x[_may(at[x], at[i], similarity)]
        x = x[_close(at[x], sketch[x], at[i], sketch[i], similarity)]
        if len(x):
            joined, first = np.unique(root[x], return_index=True)
            yield np.full(len(first), key[i]), key[x[first]]
            root[np.isin(root, joined)] = root[i]


def _crossed(key: np.ndarray, at: np.ndarray, root: np.ndarray, sketch: np.ndarray, similarity: float, block: int = 64):
    """All possible pairs of a list's rows of different components, by blocks."""
    order = np.argsort(at)
    key, at, root, sketch = key[order], at[order], root[order], sketch[order]
    n = at >> 32
    for a in range(0, len(key), block):
        b = min(a + block, len(key))
        end = int(np.searchsorted(n, n[b - 1] / similarity + 1, "right"))
        i, j = np.nonzero((root[a:b, None] != root[None, a:end]) & _may(at[a:b, None], at[None, a:end], similarity))
        ahead = i < j
        i, j = a + i[ahead], a + j[ahead]
        for cut in range(0, len(i), 1 << 14):
            x, y = i[cut : cut + (1 << 14)], j[cut : cut + (1 << 14)]
            near = _close(at[x], sketch[x], at[y], sketch[y], similarity)
            yield key[x[near]], key[y[near]]


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float, few: bool = False, sides: int = 1) -> DataFrame:
    """The (high, low) whose sets (key, hashes) have that Jaccard similarity or more, written to the shared folder.

    few: whether most sets are in no pair. sides: into how many parts the sets go,
    if not few at least; each two parts have a turn, so that fewer bytes are dealt
    at once. A turn copies a set for each of its pairs: where sets are in many
    pairs there are more turns, so that one copies no more than all sets hold.
    """
    if not few:
        sides = max(sides, math.ceil(math.sqrt(pairs.count() / max(1, sets.count()))))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(sides))
    if few:
        sets = sets.join(pairs.select(F.explode(F.array("high", "low")).alias("key")).distinct(), "key", "left_semi")  # before they are dealt

    def work(batches):
        for batch in slices(batches, 1000):
            x, y = ([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()] for c in ("x", "y"))
            both = np.array([len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= similarity * max(len(p), len(q)) - 1e-9 else 0 for p, q in zip(x, y, strict=True)], np.int64)
            union = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.int64) - both
            yield batch.select(["high", "low"]).filter(pa.array(both >= similarity * union - 1e-9))

    turns = []
    for i in range(sides):
        for j in range(sides):
            one = pairs.filter((part("high") == i) & (part("low") == j)).join(sets.filter(part("key") == i).select(F.col("key").alias("high"), F.col("hashes").alias("x")), "high")
            both = one.join(sets.filter(part("key") == j).select(F.col("key").alias("low"), F.col("hashes").alias("y")), "low").select("high", "low", "x", "y")
            turns.append(stored(both.mapInArrow(work, "high long, low long"), "alike"))
    return reduce(DataFrame.unionByName, turns)


def _made(docs: DataFrame, wanted: DataFrame, make, column: str, words: int, seed: int) -> DataFrame:
    """(key, n, `column`) of each wanted set: its number of shingles, and `make` of them."""
    spark, bits = docs.sparkSession, None
    if wanted.count() * 4 <= WANTED_BITS:
        at_bit = wanted.select(F.col("key").bitwiseAND(F.lit(WANTED_BITS - 1)).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy(np.int64)
        field = np.zeros(WANTED_BITS >> 3, np.uint8)
        np.bitwise_or.at(field, at_bit >> 3, (1 << (at_bit & 7)).astype(np.uint8))
        bits = spark.sparkContext.broadcast(field)

    def work(batches):
        for batch in slices(batches, 500):
            keys, sizes, found = [], [], []
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                h = _set_of(t, words, seed)
                key = _key(h)
                bit = key & (WANTED_BITS - 1)
                if len(h) and (bits is None or bits.value[bit >> 3] >> (bit & 7) & 1):
                    keys.append(key)
                    sizes.append(len(h))
                    found.append(make(h))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["key", "n", column])

    rows = docs.select("text").mapInArrow(work, f"key long, n long, {column} binary").join(wanted, "key", "left_semi")
    return stored(rows.groupBy("key").agg(F.first("n").alias("n"), F.first(column).alias(column)), column)


def _roomy(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The (high, low) whose sketches (key, n, sketch) leave room for that similarity: a set's sketch is much shorter than a set, and few other pairs are checked."""

    def work(batches):
        for batch in slices(batches, 2000):
            near = _close(batch.column(2).to_numpy() << 32, _rows(batch.column(3)), batch.column(4).to_numpy() << 32, _rows(batch.column(5)), similarity)
            yield batch.select(["high", "low"]).filter(pa.array(near))

    for end, n, sketch in (("high", "n", "x"), ("low", "m", "y")):
        pairs = pairs.join(sketches.select(F.col("key").alias(end), F.col("n").alias(n), F.col("sketch").alias(sketch)), end)
    return pairs.select("high", "low", "n", "x", "m", "y").mapInArrow(work, "high long, low long")


def similar_links(docs: DataFrame, rows: int, similarity: float = 0.8, words: int = 5, seed: int = 42, proposed: DataFrame | None = None, most: int = 32) -> DataFrame:
    """(high, low) keys of shingle sets whose Jaccard similarity is `similarity` or more, as many as join all that such pairs join. docs: text; rows: how many.

    proposed: (high, low) pairs to check first, such as those of near fingerprints;
    what they join is not compared again.

    Lists of up to `most` sets that share an early shingle are compared whole. In
    a larger one a few leaders are compared first, over again while that joins
    many, then pairs that would span what is left, and, unless all of those hold,
    all pairs that are not yet in one component. There, sketches leave out, inside
    the task, pairs that are surely not similar.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(docs, rows, words, seed))  # at most 3 MB

    def deal(batches):
        known, counts = frequent.value
        for batch in slices(batches, 500):
            tokens, keys, ats = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                h = _set_of(t, words, seed)
                if not len(h):
                    continue
                key, n = _key(h), len(h)
                if len(known):
                    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    often = np.where(known[place] == h, counts[place], 0)
                    if often.any():
                        h = h[np.lexsort((h, often))]
                first = n - int(_least(n, similarity)) + 1
                tokens.append(h[:first])
                keys.append(np.full(first, key))
                ats.append((n << 32) + np.arange(first))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(ats))], ["token", "key", "at"])

    def start(batches):
        for token, key, at in _lists(batches, ["token", "key", "at"]):
            token, key, at = _once(token, key, at)
            high, low, large = _few(token, key, at, similarity, most)
            if len(high):
                yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.nulls(len(high), pa.int64()), pa.nulls(len(high), pa.int64())], ["key", "low", "token", "at"])
            if large.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[large]), pa.nulls(int(large.sum()), pa.int64()), pa.array(token[large]), pa.array(at[large])], ["key", "low", "token", "at"])

    postings = docs.select("text").mapInArrow(deal, "token long, key long, at long")
    dealt = stored(postings.repartition("token").sortWithinPartitions("token").mapInArrow(start, "key long, low long, token long, at long"), "lists")
    pairs = stored(dealt.filter("low IS NOT NULL").select(F.col("key").alias("high"), "low").distinct(), "pairs")
    large = dealt.filter("token IS NOT NULL").select("token", "key", "at")

    proposed = pairs.limit(0) if proposed is None else proposed
    ends = lambda found: found.select(F.explode(F.array("high", "low")).alias("key"))
    wanted = stored(ends(pairs).union(ends(proposed)).union(large.select("key")).distinct(), "wanted")
    sketches = _made(docs, wanted, _sketch, "sketch", words, seed)
    pairs, proposed = (stored(_roomy(found, sketches, similarity), "pairs") for found in (pairs, proposed))
    wanted = stored(ends(pairs).union(ends(proposed)).union(large.select("key")).distinct(), "wanted")
    sets = _made(docs, wanted, np.ndarray.tobytes, "hashes", words, seed)
    links = components(_alike(proposed, sets, similarity, sides=SIDES))
    star = links.select(F.col("high").alias("key"), F.col("low").alias("root"))
    for end in ("high", "low"):
        pairs = pairs.join(star.select(F.col("key").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    pairs = stored(pairs.filter(F.coalesce("high_root", "high") != F.coalesce("low_root", "low")).select("high", "low"), "pairs")
    links = components(links.unionByName(_alike(pairs, sets, similarity, sides=SIDES)))
    rows_left, turn, ways = large.count(), 0, ["leaders", "span", "all"]
    while rows_left and ways:
        star = links.select(F.col("high").alias("key"), F.col("low").alias("root"))
        rooted = large.join(star, "key", "left").join(sketches, "key").select("token", "key", "at", F.coalesce("root", "key").alias("root"), "sketch")

        def search(batches, turn=turn, way=ways[0]):
            for columns in _lists(batches, ["token", "key", "at", "root", "sketch"]):
                cuts, keys, others = _bounds(columns[0]), [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    key, at, root, sketch = (x[a:b] for x in columns[1:])
                    if (root == root[0]).all():
                        continue
                    if way == "leaders":
                        found = zip(*_led(key, at, root, sketch, similarity, turn), strict=True)
                    else:
                        found = (_spanned if way == "span" else _crossed)(key, at, root, sketch, similarity)
                    for k, o in found:
                        keys.append(k)
                        others.append(o)
                        if sum(map(len, keys)) > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs(keys, others)], ["high", "low"])
                            keys, others = [], []
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs(keys, others)], ["high", "low"])

        tried = stored(rooted.repartition("token").sortWithinPartitions("token").mapInArrow(search, "high long, low long").distinct(), "tried")
        more = _alike(tried, sets, similarity, few=True)
        many, joined = tried.count(), more.count()
        links = components(links.unionByName(more))
        turn += 1
        if ways[0] != "leaders" or turn == LEADER_TURNS or joined * 20 < rows_left:
            ways = ways[1:]
        if ways == ["all"] and many == joined:
            break  # every pair of the span held, so none is left
    return links


def similar_documents(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", words: int = 5, seed: int = 42, radius: int = 2) -> DataFrame:
    """(id, fp, component_id) for each row: links join rows whose sets of shingles (each once) have a Jaccard similarity of `similarity` or more. fp is the set's number.

    SimHash fingerprints within `radius` bits, found by the BK-trees as in
    near_duplicates, propose the first pairs, which are checked; lists of early
    shingles then find the rest. Every such pair is found, whatever the number of
    rows or the size of a group.
    """

    def work(batches):
        for batch in slices(batches, 2000):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            keys = [_key(_set_of(t, words, seed)) for t in texts]
            fps = np.array([fingerprint(shingle_hashes(t, 3, seed)) if t else 0 for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(fps.view(np.int64))], ["id", "fp", "simhash"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    table = stored(rows.mapInArrow(work, "id long, fp long, simhash long"), "keys")
    proposed, since = _proposed(table, radius), mark()
    found = similar_links(rows.select("text"), table.count(), similarity, words, seed, proposed)
    return last(_components(table.select("id", "fp"), found), "similar", since)


def _proposed(table: DataFrame, radius: int) -> DataFrame:
    """(high, low) set numbers of rows (fp, simhash) whose fingerprints are equal or linked: each row's set with its fingerprint's least, and those of linked fingerprints."""
    of = stored(table.groupBy("simhash").agg(F.min("fp").alias("least")), "distinct")
    own = table.select("fp", "simhash").distinct().join(of, "simhash").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    near = links(of.select(F.col("simhash").alias("fp")), radius)
    for end, name in (("high", "a"), ("low", "b")):
        near = near.join(of.select(F.col("simhash").alias(end), F.col("least").alias(name)), end)
    both = own.unionByName(near.select("a", "b")).filter("a <> b")
    return stored(both.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "proposed")


def without_near_duplicates(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose identifier is its component's smallest in `found` (id, component_id), with docs' columns.

    Rows without identifier in a component of such rows alone stay. Rows that
    share an identifier share its fate, so identifiers should be unique.
    """
    kept = found.filter("id <=> component_id").select(F.col("id").alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["__kept"]), "left_semi")
