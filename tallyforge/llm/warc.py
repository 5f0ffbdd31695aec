"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. The reader deals out byte ranges: a
task looks for the gzip magic in its range, takes a place for a member only if
it decodes to a WARC header, and owns the records that start inside its range;
the last of them may end beyond it. From a found member on, members follow each
other, and after damage the search for the magic goes on.

Of records with equal payloads of at least `least` bytes, the one with the
smallest identifier is a response and the others are revisits of it. A null
payload is empty. A row with a null identifier is always a response and nothing
refers to it; repeated rows with the smallest identifier are all responses. An
empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import filesystem, scratch, slices, stored, task_id

GZIP = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a range that one task reads, at least and at most, and of the pieces in which it reads.
RANGES, PIECE = (8 << 20, 256 << 20), 1 << 18
#: Repeated payloads up to which their digests are broadcast: about 100 MB.
MOST_REPEATED = 1_000_000


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(identifier: int) -> str:
    return f"<urn:x-page:{identifier}>"


def record(identifier: int | None, uri: str | None, payload: bytes, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member. A revisit keeps the HTTP header, whose Content-Length is the payload's, and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _name(identifier) if identifier is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest32(payload))}>",
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest32(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if uri is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
    if refers_to is not None:
        head |= {"WARC-Refers-To": _name(refers_to), "WARC-Profile": PROFILE}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> dict | None:
    """The fields of a record's bytes; None if they are no record."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", x or "")) else None
    return {
        "id": number(fields.get("warc-record-id")), "type": fields.get("warc-type"), "refers_to": number(fields.get("warc-refers-to")), "uri": fields.get("warc-target-uri"),
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "http_bytes": int(length[1]) if length else None, "payload": payload if fields.get("warc-type") == "response" else None,
    }


def members(source, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the WARC members that start in [start, end) of an open file of `size` bytes."""

    held_at, held = 0, b""

    def read(at: int, n: int) -> memoryview:
        """Up to n bytes from an offset; the source is read in pieces of PIECE bytes."""
        nonlocal held_at, held
        if not held_at <= at < held_at + len(held) or at + n > held_at + len(held) < size:
            source.seek(at)
            held_at, held = at, source.read(max(n, PIECE))
        return memoryview(held)[at - held_at : at - held_at + n]

    def member(at: int) -> tuple[bytes, int] | None:
        """Content and end of the member at an offset, if its first bytes decode to a WARC header and all of it is sound."""
        unpack, out, pos = zlib.decompressobj(31), [], at
        if read(at, len(GZIP)) != GZIP:
            return None
        try:
            while not unpack.eof:
                piece = read(pos, 1 << 14)
                if not piece:
                    return None
                out.append(unpack.decompress(piece))
                pos += len(piece)
                if len(out) == 1 and not out[0].startswith(b"WARC/1."):
                    return None
        except zlib.error:
            return None
        return b"".join(out), pos - len(unpack.unused_data)

    at = start
    while at < min(end, size):
        i = bytes(read(at, PIECE)).find(GZIP)
        if i < 0:
            at += PIECE - len(GZIP) + 1
            continue
        at += i
        while at < end and (found := member(at)):
            yield at, found[0]
            at = found[1]
        at += 1


def with_references(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """id, uri, payload, refers_to: the smallest identifier with an equal payload, where it is another."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    key = [F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size")]
    same = rows.select("id", *key).filter(F.col("size") >= least).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same = stored(same, "repeated")
    side = F.broadcast(same) if same.count() <= MOST_REPEATED else same  # beyond that, by a join on the digest
    joined = rows.select("*", *key).join(side, ["digest", "size"], "left")
    return joined.select("id", "uri", "payload", F.when(F.col("id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str | None = None, most_bytes: int = 256 << 20) -> DataFrame:
    """Write id, uri, payload, refers_to as archives of about most_bytes at most; returns the manifest (path, bytes, records).

    Every attempt of a task writes files of its own name, and only those of the
    attempt that ends are in the manifest.
    """
    folder = folder or scratch(rows.sparkSession, "warc")

    def write(batches):
        done, sink, size, n, uri = [], None, 0, 0, None
        for batch in slices(batches, 500):
            for identifier, target, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("id", "uri", "payload", "refers_to")), strict=True):
                if sink is None:
                    uri, size, n = f"{folder}/part-{task_id():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    files, path = filesystem(uri)
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = files.open_output_stream(path, compression=None)
                data = record(identifier, target, payload.encode(), refers)
                sink.write(data)
                size, n = size + len(data), n + 1
                if size >= most_bytes:
                    sink.close()
                    done.append((uri, size, n))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((uri, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "bytes", "records"])

    return stored(rows.mapInArrow(write, "path string, bytes long, records long"), "archives")


def read_archives(manifest: DataFrame, span: int | None = None) -> DataFrame:
    """Every record of the archives: id, type, refers_to, uri, digest, http_bytes, payload (binary, null for revisits), payload_digest, path, at.

    payload_digest is computed from a response's payload, and is the header's
    for a revisit; a response whose header disagrees raises an error.
    """
    if span is None:  # enough ranges for all tasks, but no more than needed
        tasks = 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        span = min(max((manifest.agg(F.sum("bytes")).first()[0] or 0) // tasks, RANGES[0]), RANGES[1])
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(span).cast("long"))).alias("start"))
    names = ("id", "type", "refers_to", "uri", "digest", "http_bytes", "payload", "payload_digest", "path", "at")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int64())

    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start")), strict=True):
                files, at = filesystem(path)
                with files.open_input_file(at) as source:
                    for offset, data in members(source, start, start + span, size):
                        r = parse(data)
                        if r is None:
                            continue
                        sound = r["digest"] if r["payload"] is None else digest32(r["payload"])
                        if r["payload"] is not None and r["digest"] and sound != r["digest"]:
                            raise ValueError(f"the record at {offset} of {path} is damaged")
                        rows.append((*(r[k] for k in names[:7]), sound, path, offset))
                        held += len(data)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "id long, type string, refers_to long, uri string, digest string, http_bytes long, payload binary, payload_digest string, path string, at long"
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / span))).first()[0] or 1
    return ranges.repartitionByRange(int(n), "path", "start").mapInArrow(read, schema)
