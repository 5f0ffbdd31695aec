"""Packing of documents into token windows with a controlled mixture.

Every source is a queue: the stream of its documents' ids. A window consists of
slots. Deficit round-robin adds to each queue's deficit, window by window, its
target share of the window's slots; a queue is served as many whole slots as its
deficit holds, the slots that are left go to the largest deficits, and what a
queue is short or over is carried into the next window. The same rule works on
three levels, so that no task depends on another's work:

* the driver hands every run of windows a whole number of slots of each queue and
  carries the deficits from run to run, also when a queue runs dry and the others
  take its share. It plans MOST_RUNS runs at most;
* a run of many windows is dealt to FAN parts in the same way, and those again,
  until a part has FAN windows at most;
* those windows are filled one after the other.

A task works out the parts and windows in which its documents lie; nothing else is
computed, and ids are never shuffled. The queues' last, partial slots follow at
the end; only the last window is padded.

Null text is an empty document (its end id alone); a null source is a queue of
its own; repeated rows are packed each; an empty table has no pieces. A text is
encoded whole, in one task, whatever its length. Extra columns are not read and
may have any name.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import binary_column, slices, stored, task_id
from tallyforge.llm.tokens import encoder

#: Runs of windows that the driver plans at most, whatever the size of the corpus.
MOST_RUNS = 8192
#: Beyond so many sources, a queue holds the sources of one hash bucket.
MOST_QUEUES = 1024
#: Parts that a run is dealt to at once, and windows that are filled one after the other.
FAN = 64
#: Bytes of dealt parts that a task remembers.
HELD_BYTES = 64 << 20
#: Rows of (partition, queue) offsets up to which they are broadcast: 24 MB.
MOST_OFFSETS = 1_000_000


def deal(slots: np.ndarray, rooms: list[int]) -> np.ndarray:
    """Deficit round-robin of the queues' slots over rooms that hold them all; row k: slots of each queue in the rooms before k."""
    total, left, deficit = int(slots.sum()), slots.copy(), np.zeros(len(slots))
    rows = np.zeros((len(rooms) + 1, len(slots)), np.int64)
    for k, room in enumerate(rooms):
        deficit += room * slots / total
        turn = np.clip(np.floor(deficit + 1e-9).astype(np.int64), 0, left)
        more = room - int(turn.sum())
        while more:
            able = np.flatnonzero(turn < left) if more > 0 else np.flatnonzero(turn)
            short = (deficit - turn)[able]
            pick = able[np.argsort(-short if more > 0 else short, kind="stable")[: abs(more)]]
            turn[pick] += 1 if more > 0 else -1
            more = room - int(turn.sum())
        deficit -= turn
        left -= turn
        rows[k + 1] = rows[k] + turn
    return rows


class _Dealt:
    """deal() of runs and parts, the latest HELD_BYTES of them remembered."""

    def __init__(self):
        self.held, self.bytes = OrderedDict(), 0

    def __call__(self, slots: np.ndarray, rooms: list[int]) -> np.ndarray:
        key = (slots.tobytes(), rooms[0], len(rooms))
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        rows = self.held[key] = deal(slots, rooms)
        self.bytes += rows.nbytes
        while self.bytes > HELD_BYTES and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1].nbytes
        return rows


_dealt = _Dealt()


@dataclass
class Schedule:
    """Where each slot of each queue goes.

    taken[b, q]: slots of queue q in the runs before b; first[b]: slots of all queues before b.
    """

    window: int
    slot: int
    tokens: np.ndarray
    taken: np.ndarray

    @property
    def full(self) -> np.ndarray:
        return self.tokens // self.slot

    @classmethod
    def plan(cls, tokens: np.ndarray, window: int = 2048, slot: int = 256, shares: np.ndarray | None = None, most_runs: int = MOST_RUNS) -> Schedule:
        """tokens: ids in each queue; shares: target proportions (default: the queues' own, so that all run dry together)."""
        if window % slot:
            raise ValueError("a window holds whole slots")
        tokens = np.asarray(tokens, np.int64)
        left = tokens // slot
        shares = left.astype(float) if shares is None else np.asarray(shares, float)
        if len(shares) != len(left) or (shares < 0).any():
            raise ValueError("one non-negative share for each queue")
        in_window = window // slot
        run = max(64, -(-int(left.sum()) // (most_runs * in_window))) * in_window
        credit, taken = np.zeros(len(left)), [np.zeros(len(left), np.int64)]
        while left.any():
            given, room = np.zeros(len(left), np.int64), min(run, int(left.sum()))
            while room:
                live = left > given
                part = np.where(live, shares, 0)
                part = part if part.sum() > 0 else live.astype(float)
                credit = np.where(live, credit, 0) + room * part / part.sum()
                turn = np.clip(np.floor(credit + 1e-9), 0, left - given).astype(np.int64)
                if turn.sum() > room:  # credit carried from a share that has changed
                    turn = np.minimum(turn, room * turn // max(1, turn.sum()))
                if not turn.any():
                    turn[np.lexsort((np.arange(len(left)), -np.where(live & (part > 0), credit, -np.inf)))[0]] = 1
                given, room, credit = given + turn, room - int(turn.sum()), credit - turn
                credit -= room * part / part.sum()  # what this turn could not serve is credited anew
            left = left - given
            taken.append(taken[-1] + given)
        return cls(window, slot, tokens, np.array(taken))

    def _place(self, slots: np.ndarray, queue: int, index: np.ndarray) -> np.ndarray:
        """Places, in a run or part with so many slots of each queue, of slots `index` of `queue` there."""
        in_window, total = self.window // self.slot, int(slots.sum())
        windows = -(-total // in_window)
        wide = -(-windows // FAN) * in_window
        rows = _dealt(slots, [min(wide, total - at) for at in range(0, total, wide)])
        part = np.searchsorted(rows[:, queue], index, "right") - 1
        place = part * wide
        if windows <= FAN:
            return place + (rows[part + 1, :queue] - rows[part, :queue]).sum(1) + index - rows[part, queue]
        for p in np.unique(part):
            here = part == p
            place[here] += self._place(rows[p + 1] - rows[p], queue, index[here] - rows[p, queue])
        return place

    def places(self, queue: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The global slot number of full slot `index` of `queue`."""
        place = np.zeros(len(index), np.int64)
        for q in np.unique(queue):
            of = np.flatnonzero(queue == q)
            run = np.searchsorted(self.taken[:, q], index[of], "right") - 1
            for r in np.unique(run):
                here = of[run == r]
                place[here] = self.taken[r].sum() + self._place(self.taken[r + 1] - self.taken[r], int(q), index[here] - self.taken[r, q])
        return place

    def pieces(self, queue: np.ndarray, offset: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, length, position) of the pieces of documents that lie in `queue` at `offset`; position: ids before it in all windows."""
        low, high = offset // self.slot, (offset + length - 1) // self.slot
        many = high - low + 1
        row = np.repeat(np.arange(len(many)), many)
        slot = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]
        begin = np.maximum(offset[row], slot * self.slot)
        size = np.minimum(offset[row] + length[row], (slot + 1) * self.slot) - begin
        full, at = self.full, begin - slot * self.slot
        whole = slot < full[queue[row]]
        if whole.any():
            at[whole] += self.slot * self.places(queue[row[whole]], slot[whole])
        tails = self.tokens - full * self.slot
        at[~whole] += (int(full.sum()) * self.slot + np.cumsum(tails) - tails)[queue[row[~whole]]]
        start, n = begin - offset[row], self.window
        over = at % n + size > n  # a tail may lie across two windows
        if over.any():
            cut = n - at[over] % n
            row, start, at, size = np.append(row, row[over]), np.append(start, start[over] + cut), np.append(at, at[over] + cut), np.append(size, size[over] - cut)
            size[: len(over)][over] = cut
            order = np.lexsort((start, row))
            row, start, at, size = row[order], start[order], at[order], size[order]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + size[:-1]) | (at[1:] // n != at[:-1] // n)
        heads = np.flatnonzero(fresh)
        return row[heads], start[heads], np.add.reduceat(size, heads) if len(heads) else size, at[heads]


def padded(tokens: int, window: int = 2048) -> int:
    """The length to which a sequence of so many ids is padded: a power of two stays as it is."""
    return tokens if tokens and not tokens & (tokens - 1) else window


def _queue_of(source: str | None) -> str:
    return "-" if source is None else f"={source}"


def token_table(docs: DataFrame, vocabulary: str, end_id: int, queue: str = "source", id_col: str = "doc_id", text_col: str = "text", named: Iterable[str | None] = ()) -> DataFrame:
    """doc_id, queue, n, ids, part, before (ids of the same queue and part that precede), written to the shared folder.

    Of over MOST_QUEUES sources, those that are `named` keep queues of their own.
    """
    many = docs.select(queue).distinct().limit(MOST_QUEUES + 1).count() > MOST_QUEUES
    name = F.coalesce(F.concat(F.lit("="), F.col(queue).cast("string")), F.lit("-"))
    if many:
        own = [_queue_of(x) for x in named]
        name = F.when(name.isin(own), name).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64(queue), F.lit(MOST_QUEUES)).cast("string")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), name.alias("queue"), F.col(text_col).cast("string").alias("text"))

    def encode(batches):
        enc, ahead = encoder(vocabulary), {}
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in slices(batches, 1000):
            ids = [enc.encode(text or "") + end for text in batch.column("text").to_pylist()]
            sizes, before = [len(x) // enc.dtype.itemsize for x in ids], []
            for q, n in zip(batch.column("queue").to_pylist(), sizes, strict=True):
                before.append(ahead.get(q, 0))
                ahead[q] = before[-1] + n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("queue"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array([task_id()] * len(ids), pa.int64()), pa.array(before, pa.int64()), pa.array([enc.dtype.itemsize] * len(ids), pa.int32())], ["doc_id", "queue", "n", "ids", "part", "before", "width"])

    return stored(rows.mapInArrow(encode, "doc_id long, queue string, n long, ids binary, part long, before long, width int"), "tokens")


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = 2048, slot: int = 256, targets: dict[str | None, float] | None = None, temperature: float = 1.0, queue: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents; returns a row for each piece.

    targets: wanted proportions by source (None: the null source); sources that
    are not named come after those that are, whatever the number of sources.
    Without targets, a source's share is its number of ids to the power of
    `temperature`: 1 keeps the sources' own proportions, so that all run dry
    together, 0 gives all the same share. Columns: doc_id, start, length, doc_tokens, ids (binary, 32-bit little-endian), queue, sequence_id, offset,
    padded_length.
    """
    table = token_table(docs, vocabulary, end_id, queue, id_col, text_col, targets or ())
    counts = table.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(counts.withColumn("base", ahead), "offsets")
    totals = {r["queue"]: r["n"] for r in offsets.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()}  # MOST_QUEUES rows
    names = {q: i for i, q in enumerate(totals)}
    shares_of = {_queue_of(x): share for x, share in (targets or {}).items()}
    shares = np.array([float(n) ** temperature if targets is None else shares_of.get(q, 0.0) for q, n in totals.items()])
    plan = Schedule.plan(np.array(list(totals.values()), np.int64), window, slot, shares)
    total = sum(totals.values())
    few = offsets.count() <= MOST_OFFSETS
    side = offsets.select("part", "queue", "base")
    placed = table.join(F.broadcast(side) if few else side, ["part", "queue"])

    def cut(batches):
        for batch in slices(batches, 2000):
            col = {name: batch.column(name) for name in batch.schema.names}
            n = col["n"].to_numpy()
            width = col["width"][0].as_py() if batch.num_rows else 2
            raw = b"".join(col["ids"].to_pylist())
            ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
            q = np.array([names[x] for x in col["queue"].to_pylist()], np.int64)
            row, start, length, at = plan.pieces(q, col["before"].to_numpy() + col["base"].to_numpy(), n)
            # pieces follow the documents' ids without gaps
            cuts = np.append(0, np.cumsum(length)) * 4
            sequence = at // window
            size = np.minimum(total - sequence * window, window)
            pad = np.where((size & (size - 1)) == 0, size, window)
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([col["doc_id"].take(pick), pa.array(start), pa.array(length), pa.array(n[row]), binary_column(ids.view(np.uint8), cuts), col["queue"].take(pick), pa.array(sequence), pa.array(at % window), pa.array(pad)], ["doc_id", "start", "length", "doc_tokens", "ids", "queue", "sequence_id", "offset", "padded_length"])

    return placed.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary, queue string, sequence_id long, offset long, padded_length long")


def windows(pieces: DataFrame, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, ids (binary, 32-bit little-endian, padded to padded_length).

    A window's pieces are at most `window` rows, so no group grows with the input.
    """
    parts = pieces.groupBy("sequence_id").agg(F.max("padded_length").alias("size"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.lit(np.array([pad_id], "<u4").tobytes().hex())
    missing = (F.col("size") - F.octet_length("ids") / 4).cast("int")
    return parts.select("sequence_id", "size", joined.alias("ids")).select("sequence_id", F.concat("ids", F.unhex(F.repeat(pad, missing))).alias("ids"))
