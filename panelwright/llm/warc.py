"""WARC archives of pages: a writer that stores equal payloads once, and a reader that salvages what damage leaves."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm._store import arrow_rows, new_path, pick, stored

#: Payloads of at least so many bytes are stored once; smaller ones each time.
LEAST_BYTES = 0
#: Bytes of one archive, about; a larger record has one alone.
FILE_BYTES = 1 << 23
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP headers and has no payload. The record of a null page_id is named ``null``."""
    page_id = "null" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head += [f"WARC-Target-URI: {target or f'urn:page:{page_id}'}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


class Damaged(ValueError):
    """A record that fails a check."""


def parse(content: bytes, at: int) -> tuple[dict, int]:
    """The record whose version line starts at ``at``, and the place after it; every check that fails raises Damaged."""
    if not content.startswith(b"WARC/1.", at):
        raise Damaged("no version line")
    end = content.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("headers do not end")
    head: dict[str, str] = {}
    for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header without a name")
        head[name.strip().lower()] = value.strip()
    if not head.get("content-length", "").isdigit():
        raise Damaged("no length")
    start, stop = end + 4, end + 4 + int(head["content-length"])
    if content[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("the record does not end where its length says")
    block = content[start:stop]
    if head.get("warc-block-digest", "") != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise Damaged("the block has another digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    return head | {"http": http.decode("utf-8", "replace"), "payload": payload}, stop + 4


def salvage(content: bytes) -> Iterator[tuple[str, object]]:
    """("record", head) of each sound record, in order, and ("gap", (start, end, reason)) of the bytes in between.

    A head also has the record's first byte and the one after it, as ``start`` and ``end``.

    Archives are plain or a gzip member for each record. Where a check fails, the reader goes on at the next place that
    holds a valid member with a valid record, or a valid record after a version line; all bytes up to there are a gap.
    """
    at, gap, reason = 0, -1, ""
    view = memoryview(content)
    while at < len(content):
        try:
            if content.startswith(b"\x1f\x8b\x08", at):
                text, after = _member(view, at)
                rec, end = parse(text, 0)
                if end != len(text):
                    raise Damaged("more than a record in a member")
            else:
                rec, after = parse(content, at)
        except Damaged as e:
            if gap < 0:
                gap, reason = at, str(e)
            places = [x for x in (content.find(b"\x1f\x8b\x08", at + 1), content.find(b"WARC/1.", at + 1)) if x >= 0]
            at = min(places, default=len(content))
            continue
        if gap >= 0:
            yield "gap", (gap, at, reason)
            gap = -1
        yield "record", rec | {"start": at, "end": after}
        at = after
    if gap >= 0:
        yield "gap", (gap, len(content), reason)


def _member(view: memoryview, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """A gzip member's bytes and the place after it, fed in steps so that the rest of the archive is not copied."""
    unpack, out, i = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof and i < len(view):
            out.append(unpack.decompress(view[i : i + step]))
            i += step
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    if not unpack.eof:
        raise Damaged("gzip: the member does not end")
    return b"".join(out), min(i, len(view)) - len(unpack.unused_data)


def write_warc(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) into archives in ``folder``; (file, n_records) of each.

    The payload is the html in UTF-8; a null is empty. Of the rows with equal payloads of at least ``least_bytes`` the
    one with the largest page_id is the response, and the others revisit it; smaller payloads are all responses. A null
    page_id stays null: such a row revisits the page with its payload, or is a response where no row with an id has it. A
    null url is the record's own name. Rows that repeat a page_id with one payload are responses all. Other columns are ignored. Archives are written whole under another name and renamed.
    """
    arrow_rows(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", html.cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    last = rows.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("last"))
    first = (F.col("size") < least_bytes) | F.col("last").isNull() | F.col("page_id").eqNullSafe(F.col("last"))
    rows = rows.join(last, "digest", "left").select("page_id", "url", F.when(first, F.col("payload")).alias("payload"), "size", "digest", F.when(~first, F.col("last")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        names, counts, parts, held = [], [], [], 0

        def flush() -> None:
            nonlocal parts, held
            name = f"{task.partitionId():06d}-{len(names):06d}.warc.gz"
            with store.open_output_stream(f"{root}/_{name}-{task.taskAttemptId()}", compression=None) as out:
                for p in parts:
                    out.write(p)
            store.move(f"{root}/_{name}-{task.taskAttemptId()}", f"{root}/{name}")
            names.append(name)
            counts.append(len(parts))
            parts, held = [], 0

        for b in batches:
            cols = [b.column(i) for i in range(6)]
            for page_id, url, payload, size, digest, refers_to in zip(*cols, strict=True):
                parts.append(record(page_id.as_py(), url.as_py(), payload.as_py(), size.as_py(), base32(digest.as_py()), refers_to.as_py()))
                held += len(parts[-1])
                if held >= FILE_BYTES:
                    flush()
        if parts:
            flush()
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["file", "n_records"])

    return stored(rows.mapInArrow(write, "file string, n_records long"), "warc-files")


def read_warc(pages_folder: DataFrame) -> DataFrame:
    """Rows of a ``binaryFile`` frame of archives as records and gaps.

    (file, kind, page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, gap_start, gap_end, reason):
    kind is ``record`` or ``gap``. A response's payload must have the digest and the length that its headers give, else
    its bytes are a gap. A revisit's length is that of its HTTP headers. Gaps are the log of what was quarantined.
    """

    def number(urn: str | None) -> int | None:
        tail = (urn or "").strip("<>").removeprefix("urn:page:")
        return int(tail) if tail.lstrip("-").isdigit() else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name, rows = path.rsplit("/", 1)[-1], []
                for kind, x in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((name, "gap", *[None] * 7, *x))
                        continue
                    length = next((v.strip() for k, _, v in (h.partition(":") for h in x["http"].split("\r\n")) if k.lower() == "content-length"), "")
                    digest, payload = x.get("warc-payload-digest", "").removeprefix("sha1:"), x["payload"]
                    sound = length.isdigit() and (x.get("warc-type") == "revisit" or len(payload) == int(length) and base32(hashlib.sha1(payload).digest()) == digest)
                    if sound:
                        rows.append((name, "record", number(x.get("warc-record-id")), x.get("warc-target-uri"), int(length), digest, x.get("warc-type"), number(x.get("warc-refers-to")), payload, None, None, None))
                    else:
                        rows.append((name, "gap", number(x.get("warc-record-id")), *[None] * 6, x["start"], x["end"], "the payload has another length or digest"))
                for i in range(0, len(rows), 200):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 200], strict=True), _TYPES, strict=True)], _NAMES)

    return pages_folder.select("path", "content").mapInArrow(read, _SCHEMA)


_SCHEMA = "file string, kind string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_start long, gap_end long, reason string"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in _SCHEMA.split(", ")]


def archive_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` into archives in the shared folder and read them back; see ``write_warc`` and ``read_warc``.

    An empty table gives no archive and no row.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    files = write_warc(pages, folder, least_bytes)
    if files.isEmpty():
        return spark.createDataFrame([], _SCHEMA)
    return read_warc(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder))
