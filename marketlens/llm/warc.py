"""WARC archives: one gzip member per record, written by tasks and read back as a stream.

A record is a response, an HTTP message with the page as its payload, or a revisit without payload that names the
response holding the same one. Which is which follows from the payloads' digests: per digest the largest page id,
gathered with partial sums; only digests that occur more than once meet the pages again.
A task writes archives of about ``ARCHIVE_BYTES`` of payload into the shared folder, under a name of its own
attempt, and reports them; the list of reported archives is written down, so what a lost or
repeated attempt leaves behind is never read.

The reader takes an archive from front to back: it inflates member by member, at most ``CHUNK`` bytes at once, parses the
header, follows Content-Length through the block, of which it holds the payload only, and checks the block's and the payload's
digests and the end of the record. A wrong digest, length or end raises an error.

Archives of other writers are read as well (``archives_in`` lists a folder's): records of any type, of which responses,
resources and conversions have a payload; SHA-1 digests are checked where a record names them, others are not, and a missing
one is taken of the payload. Payload bytes are counted; a revisit's are known only where its record tells them. An archive has
one record per gzip member. The folder must be one that pyarrow opens on every worker; another raises at once.

Defined results: a null html is an empty payload; a null url has no target; of equal payloads all rows with the largest id
are responses, and all are where no id is known; rows with a null id are written and come back with a null id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import broadcast_if_small, scratch, ship, stored

LEAST_BYTES = 0
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BROADCAST_DIGESTS = 500_000
PAYLOADS = ("response", "resource", "conversion")
END = b"\r\n\r\n"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file:///" + folder[len("file:/") :]
    try:
        return fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, OSError) as error:
        raise ValueError(f"archives cannot be kept in {folder}: pyarrow opens no such file system here ({error})") from error


def record(page_id: object, url: str | None, payload: bytes, kind: str, refers_to: object = None) -> bytes:
    """One record as a gzip member."""
    name = lambda x: f"<urn:x-page:{'' if x is None else x}>"
    head = {"WARC-Type": kind, "WARC-Record-ID": name(page_id), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    head["WARC-Payload-Digest"] = f"sha1:{_digest(payload)}"
    head["X-Payload-Length"] = str(len(payload))
    block = b""
    if kind == "revisit":
        head |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": PROFILE}
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        head["Content-Type"] = "application/http; msgtype=response"
    head |= {"WARC-Block-Digest": f"sha1:{_digest(block)}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress(f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + out.flush()


def _written(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        out, path, made, size, records = None, "", [], 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "url", "html", "kind", "refers_to")]
            for page_id, url, html, kind, refers_to in zip(*columns, strict=True):
                if out is None:
                    path = f"{root}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz"
                    out, size, records = store.open_output_stream(path, compression=None), 0, 0
                payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
                out.write(record(page_id, url, payload, kind, refers_to))
                size, records = size + len(payload), records + 1
                if size >= archive_bytes:
                    out.close()
                    made.append((path.rpartition("/")[2], records))
                    out = None
        if out is not None:
            out.close()
            made.append((path.rpartition("/")[2], records))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["archive", "records"])

    return run


def _agrees(named: str | None, data: hashlib._Hash) -> bool:
    """Whether a digest that a record names is the data's; algorithms other than SHA-1 in base32 are not checked."""
    kind, _, value = (named or "").partition(":")
    return kind.lower() != "sha1" or len(value) != 32 or value.upper() == base64.b32encode(data.digest()).decode()


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload or None) of each record of an archive given as a stream of bytes."""
    for head, parts in _members(chunks):
        name, kind, size = head.get("warc-record-id", "a record"), head.get("warc-type", ""), int(head["content-length"])
        has_payload = kind in PAYLOADS
        http = kind == "response" and head.get("content-type", "application/http").startswith("application/http")
        block, payload = hashlib.sha1(), hashlib.sha1()
        kept, seen, front, rest = [], 0, b"" if http else None, b""
        for data in parts:
            inside, after = data[: size - seen], data[size - seen :]
            seen, rest = seen + len(inside), rest + after
            if len(rest) > len(END):
                break
            block.update(inside)
            if front is not None:  # the payload begins after the HTTP header
                front += inside
                if (i := front.find(END)) < 0:
                    continue
                inside, front = front[i + len(END) :], None
            if has_payload:
                payload.update(inside)
                kept.append(inside)
        if seen != size or rest != END:
            raise ValueError(f"{name}: the record does not end where its length says")
        if not _agrees(head.get("warc-block-digest"), block):
            raise ValueError(f"{name}: the block differs from its digest")
        if not has_payload:
            yield head, None
            continue
        if "warc-truncated" not in head and not _agrees(head.get("warc-payload-digest"), payload):
            raise ValueError(f"{name}: the payload differs from its digest")
        head.setdefault("warc-payload-digest", "sha1:" + base64.b32encode(payload.digest()).decode())
        yield head, b"".join(kept)


def _members(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Headers of each gzip member and an iterator over what follows them, which must be used up."""
    waiting = b""

    def inflated() -> Iterator[bytes]:
        nonlocal waiting
        z, full = zlib.decompressobj(31), False
        while not z.eof:
            data = z.unconsumed_tail
            if not data and not full:
                data, waiting = waiting or next(chunks, b""), b""
                if not data:
                    raise ValueError("the archive ends within a record")
            out = z.decompress(data, CHUNK)
            full = len(out) == CHUNK
            yield out
        waiting = z.unused_data

    while True:
        if not waiting and not (waiting := next(chunks, b"")):
            return
        parts, front = inflated(), b""
        while (i := front.find(b"\r\n\r\n")) < 0:
            more = next(parts, None)
            if more is None:
                raise ValueError("a record without the end of its header")
            front += more
        try:
            text = front[:i].decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            text = front[:i].decode("latin-1")
        first, *lines = re.sub(r"\r\n[ \t]+", " ", text).split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}

        def body(rest: bytes = front[i + 4 :], parts: Iterator[bytes] = parts) -> Iterator[bytes]:
            yield rest
            yield from parts

        yield head, body()


def _page(name: str | None) -> str | None:
    """The page id of a record's name, or what stands between the brackets of another writer's."""
    return name.strip("<>").removeprefix("urn:x-page:") or None if name else None


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for name, expected in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                    rows, held, seen = [], 0, 0
                    for head, payload in records(iter(lambda f=file: f.read(CHUNK), b"")):
                        told = head.get("x-payload-length")
                        size = len(payload) if payload is not None else int(told) if told is not None else None
                        digest = head.get("warc-payload-digest")
                        rows.append((
                            _page(head.get("warc-record-id")), size, digest and digest.removeprefix("sha1:"), head.get("warc-type"),
                            _page(head.get("warc-refers-to")), head.get("warc-target-uri"), payload if payloads else None))
                        seen, held = seen + 1, held + (len(payload or b"") if payloads else 100)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if expected is not None and seen != expected:
                        raise ValueError(f"{name} holds {seen} records, not {expected}")
                    if rows:
                        yield _batch(rows)

    return run


_FIELDS = "id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, target string, payload binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
    names = [f.split(" ")[0] for f in _FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page as a record below ``folder``; (archive, records) of what was written."""
    _open(folder)
    ship(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit(""))
    given = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    given = given.withColumn("digest", F.sha1(F.encode(body, "UTF-8"))).withColumn("bytes", F.octet_length(body))
    shared = given.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = stored(shared.filter("n > 1 and first is not null").drop("n"), "shared-payloads")
    typed = given.join(broadcast_if_small(shared, BROADCAST_DIGESTS), ["digest", "bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    typed = typed.select("id", "url", "html", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"))
    return stored(typed.mapInArrow(_written(folder, archive_bytes), "archive string, records bigint"), "archives")


def archives_in(spark: SparkSession, folder: str, names: str = "*.warc.gz") -> DataFrame:
    """(archive, records) of the archives that lie in a folder; how many records each holds is not known."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder).select("path")  # without the contents
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.lit(None).cast("bigint").alias("records"))


def read(spark: SparkSession, archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, target, payload) of every record, ids as text."""
    _open(folder)
    ship(spark)
    many = max(1, min(archives.count(), 10_000))
    return archives.repartition(many).mapInArrow(_read(folder, payloads), _FIELDS)


def round_trip(pages: DataFrame, page_id: str = "page_id", **how) -> DataFrame:
    """Write the pages into the shared folder and read the archives back."""
    folder = scratch(pages.sparkSession, "warc")
    kind = pages.schema[page_id].dataType
    out = read(pages.sparkSession, write(pages, folder, page_id, **how), folder)
    return out.select(F.col("id").cast(kind).alias(page_id), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
