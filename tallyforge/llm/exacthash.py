"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are identical after every ASCII white-space
character is deleted. Of equal texts the row with the most code points in the
original text stays, then the smallest identifier, then the first row.

1. Each input task folds equal texts of its own rows, by bytes, so that a text
   with very many copies reaches its owner as a few rows.
2. The hash space is dealt in ranges. The owner task of a range puts the texts
   into an extendible-hash index: a full bucket splits, and the directory
   doubles when a splitting bucket is as deep as it. Entries of one hash chain,
   and only equal bytes are equal texts. The owner writes its index, with the
   folded rows that each entry stands for, to the shared folder.
3. The index files are read back, entry by entry in bucket order, which gives
   each folded row its class. Rows find theirs by a join on the folded row. No
   key of that join holds more rows than one input task.

Null text counts as empty; a null identifier sorts after all others; repeated
rows are copies of each other, of which one stays; an empty table gives none.
A text is held whole, in one task, whatever its length; extra columns may have
any name.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import filesystem, last, mark, scratch, slices, stored, task_id

SPACE = b" \t\n\v\f\r"
MAGIC = b"TFEXTH01"
HEAD = struct.Struct("<8sBIQQ")
#: Bytes of normalised text that an input task holds before it passes them on, and that an owner is meant to receive.
FOLD_BYTES, OWNER_BYTES = 32 << 20, 32 << 20
PAGE = 1 << 20


def normal(text: str | bytes | None) -> bytes:
    """The text in UTF-8 without ASCII white space; none of those bytes is part of another character."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(None, SPACE)


class Bucket:
    __slots__ = ("depth", "entries")

    def __init__(self, depth: int):
        self.depth, self.entries = depth, []


class ExtendibleHash:
    """Texts to entry numbers. The directory has 2**depth slots, addressed by the low bits of the hash."""

    def __init__(self, capacity: int = 64, hash_of=xxhash.xxh3_64_intdigest):
        self.capacity, self.hash_of, self.depth = capacity, hash_of, 0
        self.directory = [Bucket(0)]
        self.texts: list[bytes] = []
        self.hashes: list[int] = []

    def find(self, text: bytes, h: int | None = None) -> int | None:
        h = self.hash_of(text) if h is None else h
        for e in self.directory[h & (1 << self.depth) - 1].entries:
            if self.hashes[e] == h and self.texts[e] == text:
                return e
        return None

    def add(self, text: bytes, h: int | None = None) -> int:
        """The entry of text, made if there is none."""
        h = self.hash_of(text) if h is None else h
        e = self.find(text, h)
        if e is None:
            e = len(self.texts)
            self.texts.append(text)
            self.hashes.append(h)
            self._place(e, h)
        return e

    def _place(self, e: int, h: int) -> None:
        bucket = self.directory[h & (1 << self.depth) - 1]
        bucket.entries.append(e)
        while len(bucket.entries) > self.capacity and any(self.hashes[x] != h for x in bucket.entries):
            if bucket.depth == self.depth:
                self.directory += self.directory
                self.depth += 1
            self._split(bucket, h)
            bucket = self.directory[h & (1 << self.depth) - 1]

    def _split(self, bucket: Bucket, h: int) -> None:
        low = h & (1 << bucket.depth) - 1
        bit = 1 << bucket.depth
        halves = Bucket(bucket.depth + 1), Bucket(bucket.depth + 1)
        for e in bucket.entries:
            halves[bool(self.hashes[e] & bit)].entries.append(e)
        for slot in range(low, len(self.directory), bit):
            self.directory[slot] = halves[bool(slot & bit)]

    def save(self, sink, values: np.ndarray, refs: np.ndarray | None = None) -> None:
        """Write directory, buckets, entries, references and compressed pages of text.

        values: 64-bit rows, one for each entry; refs: (entry, reference) rows.
        """
        buckets = list({id(b): b for b in self.directory}.values())
        number = {id(b): i for i, b in enumerate(buckets)}
        order = [e for b in buckets for e in b.entries]
        sizes = np.array([len(self.texts[e]) for e in order], np.int64)
        at = np.cumsum(sizes) - sizes
        heap = b"".join(self.texts[e] for e in order)
        pages = [zstandard.ZstdCompressor(level=1).compress(heap[i : i + PAGE]) for i in range(0, len(heap), PAGE)]
        values = np.ascontiguousarray(values, "<i8").reshape(len(self.texts), -1)
        refs = np.zeros((0, 2), np.int64) if refs is None else refs
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of = rank[refs[:, 0]] if len(refs) else np.zeros(0, np.int64)
        ref_ends = np.cumsum(np.bincount(of, minlength=len(order))).astype("<u8")
        sink.write(HEAD.pack(MAGIC, self.depth, len(buckets), len(order), len(pages)) + struct.pack("<I", values.shape[1] if len(order) else 0))
        for x in (np.array([number[id(b)] for b in self.directory], "<u4"), np.cumsum([len(b.entries) for b in buckets]).astype("<u8"), np.array([self.hashes[e] for e in order], "<u8"), at.astype("<u8"), sizes.astype("<u8"), values[order], ref_ends, refs[np.argsort(of, kind="stable"), 1].astype("<i8"), np.cumsum([len(p) for p in pages]).astype("<u8")):
            sink.write(x.tobytes())
        for p in pages:
            sink.write(p)


class SavedIndex:
    """Lookups in a saved index; only the pages of candidates are read."""

    def __init__(self, uri: str, hash_of=xxhash.xxh3_64_intdigest):
        files, path = filesystem(uri)
        self.source, self.hash_of = files.open_input_file(path), hash_of
        magic, self.depth, buckets, entries, pages = HEAD.unpack(self.source.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not an index")
        width = struct.unpack("<I", self.source.read(4))[0]
        take = lambda kind, n: np.frombuffer(self.source.read(np.dtype(kind).itemsize * n), kind)
        self.directory, self.ends = take("<u4", 1 << self.depth), take("<u8", buckets)
        self.hashes, self.at, self.sizes = (take("<u8", entries) for _ in range(3))
        self.values = take("<i8", entries * width).reshape(entries, width)
        self.ref_ends = take("<u8", entries)
        self.refs = take("<i8", int(self.ref_ends[-1]) if entries else 0)
        self.page_ends, self.base = take("<u8", pages), self.source.tell()

    def _text(self, e: int) -> bytes:
        low, high, out = int(self.at[e]), int(self.at[e] + self.sizes[e]), b""
        for p in range(low // PAGE, -(-high // PAGE)):
            begin = int(self.page_ends[p - 1]) if p else 0
            self.source.seek(self.base + begin)
            out += zstandard.ZstdDecompressor().decompress(self.source.read(int(self.page_ends[p]) - begin))
        return out[low % PAGE : low % PAGE + high - low]

    def entries(self):
        """(text, values, references) of each entry, in bucket order; a page is read once."""
        page, held = -1, b""
        for e in range(len(self.hashes)):
            low, left, parts = int(self.at[e]), int(self.sizes[e]), []
            while left:
                if low // PAGE != page:
                    page = low // PAGE
                    begin = int(self.page_ends[page - 1]) if page else 0
                    self.source.seek(self.base + begin)
                    held = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.page_ends[page]) - begin))
                parts.append(held[low % PAGE : low % PAGE + left])
                low, left = low + len(parts[-1]), left - len(parts[-1])
            yield b"".join(parts), self.values[e], self.refs[int(self.ref_ends[e - 1]) if e else 0 : int(self.ref_ends[e])]

    def get(self, text: bytes) -> np.ndarray | None:
        """The values of the entry with this text."""
        h = self.hash_of(text)
        b = int(self.directory[h & (1 << self.depth) - 1])
        for e in range(int(self.ends[b - 1]) if b else 0, int(self.ends[b])):
            if int(self.hashes[e]) == h and self._text(e) == text:
                return self.values[e]
        return None


def _better(a: tuple, b: tuple) -> tuple:
    """Of (points, identifier, row) the one that stays."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))


def folded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A narrow row for each input row (text null), and a row with the text for each class of an input task's rows.

    row: number of the row; local: number of its class in its task; hash, text,
    size, members: of class rows only, whose id, points and row are those of
    their best member.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("points"))

    def fold(batches):
        base, row = task_id() << 34, 0
        held: dict[bytes, list] = {}
        size = made = 0

        def classes():
            part = list(held.items())
            for i in range(0, len(part), 500):
                texts = [t for t, _ in part[i : i + 500]]
                own = [v for _, v in part[i : i + 500]]
                yield pa.RecordBatch.from_pydict(
                    {"id": pa.array([v[2][1] for v in own], pa.int64()), "points": pa.array([v[2][0] for v in own], pa.int64()), "row": pa.array([v[2][2] for v in own], pa.int64()), "local": pa.array([v[0] for v in own], pa.int64()),
                     "hash": pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)), "text": pa.array(texts, pa.binary()), "size": pa.array([len(t) for t in texts], pa.int64()), "members": pa.array([v[1] for v in own], pa.int64())}
                )

        for batch in slices(batches, 2000):
            local, start = [], row
            for key, words, points in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, mine = normal(words), (points, key, base + row)
                known = held.get(text)
                if known:
                    known[1] += 1
                    known[2] = _better(known[2], mine)
                else:
                    known = held[text] = [base + made, 1, mine]
                    made, size = made + 1, size + len(text)
                local.append(known[0])
                row += 1
            n = len(local)
            empty = {k: pa.nulls(n, t) for k, t in (("hash", pa.int64()), ("text", pa.binary()), ("size", pa.int64()), ("members", pa.int64()))}
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "points": batch.column(2), "row": pa.array(np.arange(start, row) + base), "local": pa.array(local, pa.int64())} | empty)
            if size > FOLD_BYTES:
                yield from classes()
                held.clear()
                size = 0
        yield from classes()

    return stored(rows.mapInArrow(fold, "id long, points long, row long, local long, hash long, text binary, size long, members long"), "folded")


def write_indexes(table: DataFrame, folder: str) -> DataFrame:
    """Index the class rows by key ranges; returns the manifest (index, entries) of files in folder."""
    spark = table.sparkSession
    classes = table.filter("hash IS NOT NULL").select("id", "points", "row", "local", "hash", "text", "members")
    total = table.agg(F.sum("size")).first()[0] or 0
    bits = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // OWNER_BYTES)).bit_length()
    owner = F.shiftrightunsigned("hash", 64 - bits).cast("int")

    def own(batches):
        index, best, members, refs, locals_ = ExtendibleHash(), [], [], [], []
        for batch in slices(batches, 1000):
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for key, points, row, local, h, text, n in zip(*cols, strict=True):
                e = index.add(text, h & (1 << 64) - 1)
                if e == len(best):
                    best.append((points, key, row))
                    members.append(n)
                else:
                    best[e] = _better(best[e], (points, key, row))
                    members[e] += n
                refs.append(e)
                locals_.append(local)
        if not refs:
            return
        uri = f"{folder}/index-{task_id():06d}-{uuid.uuid4().hex}.xh"
        files, path = filesystem(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(path, compression=None) as sink:
            index.save(sink, np.array([(b[1] is not None, b[1] or 0, b[2], m) for b, m in zip(best, members, strict=True)], np.int64), np.array([refs, locals_], np.int64).T)
        yield pa.RecordBatch.from_pydict({"index": [uri], "entries": pa.array([len(index.texts)], pa.int64())})

    dealt = classes.repartitionById(1 << bits, owner)
    return stored(dealt.mapInArrow(own, "index string, entries long"), "indexes")


def assigned(manifest: DataFrame) -> DataFrame:
    """local, keep_id, keep_row, group_size, sha256, index for each class row, read from the index files of a manifest."""

    def read(batches):
        names, kinds = ("local", "keep_id", "keep_row", "group_size", "sha256", "index"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for text, (known, key, row, members), refs in SavedIndex(uri).entries():
                    digest = hashlib.sha256(text).hexdigest()
                    rows += [(local, int(key) if known else None, int(row), int(members), digest, uri) for local in refs.tolist()]
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = max(1, manifest.count())
    return manifest.select("index").repartitionByRange(files, "index").mapInArrow(read, "local long, keep_id long, keep_row long, group_size long, sha256 string, index string")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """A row for each row of docs: id, row, keep_id, group_size, kept, sha256, index (the file that holds its class)."""
    table = folded(docs, id_col, text_col)
    classes = assigned(write_indexes(table, folder or scratch(docs.sparkSession, "index")))
    rows = table.filter("hash IS NULL").select("id", "row", "local")
    # the planner takes classes to be as small as the manifest that they are read from, and would broadcast a row for each text
    return rows.join(classes.hint("merge"), "local").select("id", "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha256", "index")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which none is a copy of another, with docs' columns.

    Where identifiers repeat, rows are told apart by their text as well, and of
    rows alike in both one stays.
    """
    since = mark()
    found = last(duplicates(docs, id_col, text_col).select("id", "kept"), "decided", since)
    kept = found.filter("kept").select(F.col("id").alias("__id"))
    if found.filter("id IS NULL").limit(1).count() or found.groupBy("id").count().filter("count > 1").limit(1).count():
        return _told_apart(docs, id_col, text_col)
    return docs.join(kept, docs[id_col].cast("long") == kept["__id"], "left_semi")


def _told_apart(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """without_duplicates for tables whose identifiers repeat: rows get numbers of their own in a stored copy."""
    copy = stored(docs.select(F.monotonically_increasing_id().alias("n"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "numbered")
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    # the operator's order, with the original identifier as the second key, comes from a rank over distinct classes
    since = mark()
    best = last(duplicates(copy.select("n", text.alias("text")), "n", "text").select(F.col("id").alias("n"), "sha256"), "best", since)
    ranked = copy.select("n", F.col("row")[id_col].cast("long").alias("id"), F.char_length(text).alias("points")).join(best, "n")
    order = F.struct(-F.col("points"), F.col("id").isNull(), F.coalesce("id", F.lit(0)), F.col("n"))
    stay = ranked.groupBy("sha256").agg(F.min(order).alias("first")).select(F.col("first.n").alias("n"))
    return copy.join(stay, "n", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])
