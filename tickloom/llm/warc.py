"""WARC archives: writing, and a splittable reader.

Records are gzip members of their own. A reading task gets a byte range. It looks for gzip magic from the
start of its range, takes a place for a member only if its headers decode to a WARC record's, and owns
the records that start inside its range, wherever they end. So files split anywhere, and no
index or footer is needed.

Files are reached through pyarrow's file systems by the URI of the shared folder, which has to be one
that pyarrow knows (file, hdfs, s3, gs). A file's name holds the task attempt, and only the files of attempts that
Spark committed are in the manifest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import slices, stored
from tickloom.session import shared_dir, ship_by_value

LEAST = 100
RANGE = 16 << 20
CHUNK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"


def _line(value: str | None) -> str:
    """A header value in one line of ASCII; other characters percent-encoded."""
    from urllib.parse import quote

    return quote(value or "", safe="".join(map(chr, range(33, 127))))


def record(name: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit of refers_to, which has the HTTP headers but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(uri)}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head[4:4] = [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    press = zlib.compressobj(1, wbits=31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write one record per row under the folder; returns the manifest (file, bytes).

    Of equal payloads of `least` bytes or more the smallest id is the response, the others revisit it;
    rows that repeat that id are responses as well. A null payload is an empty one, a null id is written as none.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"))
    rows = rows.join(first, "digest", "left").select("id", "uri", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pa.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        path, size, out = f"{top}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz", 0, None
        name = lambda i: f"urn:page:{'none' if i is None else i}"
        for columns in slices(batches, 64):
            for i, uri, payload, digest, refers in zip(*columns):
                if out is None:
                    files.create_dir(top, recursive=True)
                    out = files.open_output_stream(path, compression=None)
                data = record(name(i), uri, payload, digest, None if refers is None else name(refers))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([size])], names=["file", "bytes"])

    return stored(rows.mapInArrow(write, "file string, bytes long"), "manifest")


def _headers(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """The headers of a WARC record and what follows; none if it is no record."""
    head, end, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not end or not lines[0].startswith("WARC/") or not {"warc-type", "warc-record-id", "content-length"} <= fields.keys():
        return None
    return fields, block


def members(read, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in [start, stop). read(offset, n) gives bytes, fewer at the end."""
    at, data, base = start, b"", start
    while at < stop:
        if at < base or at + len(MAGIC) > base + len(data):
            base, data = at, read(at, CHUNK)
            if len(data) < len(MAGIC):
                return
        found = data.find(MAGIC, at - base)
        if found < 0:
            at = base + len(data) - len(MAGIC) + 1 if len(data) > len(MAGIC) else base + len(data)
            continue
        at = base + found
        if at >= stop:
            return
        unpack, parts, chunk, place = zlib.decompressobj(wbits=31), [], data[found:], base + len(data)
        good = True
        try:
            while True:
                parts.append(unpack.decompress(chunk))
                if unpack.eof:
                    break
                if sum(map(len, parts[:8])) >= 8 and not b"".join(parts[:8]).startswith(b"WARC/"):
                    good = False
                    break
                chunk = read(place, CHUNK)
                place += len(chunk)
                if not chunk:
                    good = False  # cut off
                    break
        except zlib.error:
            good = False
        record_ = _headers(b"".join(parts)) if good else None
        if record_ is None:
            at += 1
            continue
        yield at, record_[0], record_[1][: int(record_[0]["content-length"])]
        at = place - len(unpack.unused_data)


def read_warc(manifest: DataFrame, step: int = RANGE) -> DataFrame:
    """Records of the files in a manifest (file, bytes): file, offset, record_type, record_id, uri, digest, refers_to, http_length, payload.

    http_length is the Content-Length of the HTTP headers, which a revisit keeps as well. Bytes between
    members and cut-off members are passed over.
    """
    ranges = manifest.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, ranges.count()), "file", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "record_type", "record_id", "uri", "digest", "refers_to", "http_length", "payload"]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
        for files_, starts in slices(batches):
            for file, start in zip(files_, starts):
                files, path = pa.fs.FileSystem.from_uri(file)
                out, size = [], 0
                with files.open_input_file(path) as source:
                    for offset, h, block in members(lambda at, n: source.read_at(n, at) if at < source.size() else b"", start, start + step):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        bare = {k: h[k].strip("<>") if k in h else None for k in ("warc-record-id", "warc-refers-to")}
                        out.append((file, offset, h["warc-type"], bare["warc-record-id"], h.get("warc-target-uri"), h.get("warc-payload-digest"), bare["warc-refers-to"], length, payload))
                        size += len(payload)
                        if size > 8 << 20:
                            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                            out, size = [], 0
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return ranges.mapInArrow(read, "file string, offset long, record_type string, record_id string, uri string, digest string, refers_to string, http_length long, payload binary")


def warc_round_trip(pages: DataFrame, step: int = RANGE) -> DataFrame:
    """Write the pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    records = read_warc(write_warc(pages, shared_dir(pages.sparkSession, "warc")), step)
    whole = F.col("record_type") == "response"
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    return records.select(
        number("record_id").alias("page_id"), F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring_index("digest", ":", -1)).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


ship_by_value(__name__)
