"""WARC archives: one gzip member per record, written and read back sequentially.

Defined results: null payload is an empty one; null url is written as `urn:x-page:none`; rows that repeat an id and a payload are
responses alike (each equals the response that others name); a null id never becomes the response that others name unless no other
row has that payload. Empty tables give no archive and no record. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, lean, new_folder, staged, table, task_tag, utf8

CHUNK = 1 << 16
ROLL_BYTES = 32 << 20
#: At most so many repeated payloads are broadcast (about 60 bytes each); beyond, the join is shuffled.
BROADCAST_PAYLOADS = 500_000
READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.int64()), ("block_ok", pa.bool_()), ("payload_ok", pa.bool_()), ("payload", pa.binary())]
)
WRITTEN = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
READ_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block_ok boolean, payload_ok boolean, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, whose Content-Length tells the payload's size, but no payload."""
    digest = sha1_base32(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:x-page:none"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>",
            f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def members(stream, chunk: int = CHUNK) -> Iterator[Iterator[bytes]]:
    """For each gzip member, its decompressed pieces; never holds more than a chunk and what it expands to."""
    rest = stream.read(chunk)
    while rest:
        gz = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            while not gz.eof:
                out = gz.decompress(rest, 1 << 20)
                rest = gz.unconsumed_tail
                if not rest and not gz.eof:
                    rest = stream.read(chunk)
                    if not rest and not out:
                        raise ValueError("archive ends inside a gzip member")
                if out:
                    yield out
            rest = gz.unused_data or stream.read(chunk)

        part = pieces()
        yield part
        for _ in part:  # what the caller left
            pass


def framed(part: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, cut by its Content-Length."""
    buffer = bytearray()
    while (cut := buffer.find(b"\r\n\r\n")) < 0:
        try:
            buffer += next(part)
        except StopIteration:
            raise ValueError("a record ends inside its header") from None
    lines = bytes(buffer[:cut]).decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
    length = int(headers["content-length"])
    del buffer[: cut + 4]
    for piece in part:
        buffer += piece
    if len(buffer) != length + 4 or buffer[length:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} does not frame a block of {len(buffer)} bytes")
    return headers, bytes(buffer[:length])


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Records of one archive in file order, their digests verified."""
    for part in members(stream, chunk):
        headers, block = framed(part)
        http, _, payload = block.partition(b"\r\n\r\n")
        revisit = headers["warc-type"] == "revisit"
        said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        length = re.search(rb"(?mi)^content-length:\s*(\d+)", http)
        yield {
            "page_id": _page(headers.get("warc-record-id")), "url": headers.get("warc-target-uri"), "payload_bytes": int(length[1]) if revisit and length else len(payload),
            "payload_digest": said if revisit else sha1_base32(payload), "record_type": headers["warc-type"], "refers_to": _page(headers.get("warc-refers-to")),
            "block_ok": headers.get("warc-block-digest") == f"sha1:{sha1_base32(block)}", "payload_ok": revisit or said == sha1_base32(payload), "payload": None if revisit else payload,
        }


def planned(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, first_id): first_id names the response for each row whose payload repeats.

    Only a digest and an id per row are aggregated, with partial sums before the shuffle, so a payload that a third of all pages share
    costs one row per task. Few repeated payloads are broadcast; many are joined, where AQE splits a hot one."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), utf8(html_col).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    repeated = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = staged(repeated, "warc-repeated")
    if repeated.count() <= BROADCAST_PAYLOADS:
        repeated = F.broadcast(repeated)
    return rows.join(repeated, "sha", "left").drop("sha")


def write_archives(plan: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archives of about roll_bytes in `folder`, from what planned() returns; the rows name the files of tasks that succeeded."""

    def write(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        out, n, size, k, done = None, 0, 0, 0, []
        for batch in source:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{task_tag()}-{k:04d}.warc.gz"
                    out, n, size, k = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0, k + 1
                revisit = row["first_id"] is not None and row["first_id"] != row["page_id"]
                out.write(data := record(row["page_id"], row["url"], row["payload"], row["first_id"], revisit))
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    done, out = [*done, (f"{folder}/{name}", n, size)], None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), WRITTEN, strict=True)], schema=WRITTEN)

    return staged(plan.select("page_id", "url", "payload", "first_id").mapInArrow(lean(write), "file string, records long, bytes long"), "warc-files")


def read_archives(files: DataFrame, payloads: bool = True, opener: Callable | None = None) -> DataFrame:
    """Every record of the archives named in the column `file`, each read by one task from its start to its end."""

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for name in batch.column(0).to_pylist():
                fs, path = file_system(name)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for x in records(stream):
                        if not payloads:
                            x["payload"] = None
                        held += len(x["payload"] or b"")
                        rows.append(x)
                        if len(rows) >= 2000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=READ)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=READ)

    tasks = max(1, files.count())
    return files.select("file").repartition(min(tasks, 10_000), "file").mapInArrow(lean(read), READ_DDL)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record a page, written and read back; see the module's defined results."""
    files = write_archives(planned(table(spark, sf_dir, "pages")), new_folder(spark, "warc"))
    found = read_archives(files, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "block_ok", "payload_ok")
