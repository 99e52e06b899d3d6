"""WARC archives: written with one gzip member per record, read back sequentially.

Archives are rows of a Parquet table (``archive``, ``content``), so they live wherever Spark can
write; ``content`` is the byte sequence of a .warc.gz file, and ``read`` takes any table of such
files, Spark's ``binaryFile`` source included. The reader walks each file once: it inflates member
by member in small steps, frames each block by its Content-Length and checks its digests.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.words import lean
from cohortry.sources.workspace import materialise

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 4 << 20
STEP = 1 << 16
_PAGE = "urn:page:"
_DATE = "2000-01-01T00:00:00Z"  # pages carry no time of capture
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, number: int) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit of ``refers_to`` without."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = f"{_PAGE}{page}" if page is not None else f"urn:row:{number}"
    target = " ".join((url or "").split()) or name
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_PAGE}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    """Headers (names in lower case) and block of a record."""

    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def _members(content: bytes, step: int) -> Iterator[Iterator[bytes]]:
    """Per gzip member its bytes as they are inflated, never more than ``step`` at once."""
    view, at = memoryview(content), 0

    def inflated() -> Iterator[bytes]:
        nonlocal at
        inflater = zlib.decompressobj(31)
        rest = b""
        while not inflater.eof:
            if not rest:
                if at >= len(view):
                    raise ValueError("archive ends within a record")
                rest = bytes(view[at : at + step])
                at += len(rest)
            yield inflater.decompress(rest, step)
            rest = inflater.unconsumed_tail
        at -= len(inflater.unused_data)

    while at < len(view):
        yield inflated()


def records(content: bytes, step: int = STEP) -> Iterator[Record]:
    """The records of one archive in order; raises ValueError where framing or a digest is wrong."""
    for member in _members(content, step):
        seen = bytearray()
        while (end := seen.find(b"\r\n\r\n")) < 0:
            part = next(member, None)
            if part is None:
                raise ValueError("record without end of headers")
            seen += part
        version, *lines = seen[:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        del seen[: end + 4]
        for part in member:
            seen += part
            if len(seen) > length + 4:
                raise ValueError("record longer than its Content-Length")
        if bytes(seen[length:]) != b"\r\n\r\n":
            raise ValueError("record shorter than its Content-Length")
        found = Record(headers, bytes(seen[:length]))
        if headers["warc-block-digest"] != f"sha1:{hashlib.sha1(found.block).hexdigest()}":
            raise ValueError("block digest differs")
        if headers["warc-type"] == "response" and headers["warc-payload-digest"] != f"sha1:{hashlib.sha1(found.payload).hexdigest()}":
            raise ValueError("payload digest differs")
        yield found


def write(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", *, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives with a record per row, written to the shared folder.

    Of equal payloads of at least ``least`` bytes, the row with the largest id is a response and the
    others revisit it; rows that share that largest id are all responses, and so are payloads that
    no row with an id holds. A null html is an empty payload, a null url names the record itself.
    """
    rows = pages.select(F.col(id).cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha1(F.encode("html", "utf-8"))))
    latest = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.max("page").alias("latest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # the written table has one row a payload, so the join can split a payload that very many rows hold
    latest = materialise(latest.select("digest", "latest"), "payloads")
    known = rows.join(latest, "digest", "left")
    known = known.withColumn("refers_to", F.when(~F.col("page").eqNullSafe(F.col("latest")), F.col("latest")))

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, part, number, content = TaskContext.get().partitionId(), 0, 0, bytearray()

        def closed() -> pa.RecordBatch:
            nonlocal part, content
            out = pa.RecordBatch.from_pydict({"archive": pa.array([f"{task:06d}-{part:06d}.warc.gz"]), "content": pa.array([bytes(content)], pa.binary())})
            part, content = part + 1, bytearray()
            return out

        for batch in batches:
            for page, link, text, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "refers_to")), strict=True):
                content += record(page, link, text.encode(), refers_to, (task << 40) + number)
                number += 1
                if len(content) >= archive_bytes:
                    yield closed()
        if content:
            yield closed()

    return materialise(known.select("page", "url", "html", "refers_to").mapInArrow(lean(archived), "archive string, content binary"), "archives")


def read(archives: DataFrame, content: str = "content") -> DataFrame:
    """A row per record: ``page_id``, ``url``, ``record_type``, ``refers_to``, ``payload_digest`` and ``payload`` (null for a revisit)."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(name: str | None) -> int | None:
            return int(name[1 + len(_PAGE) : -1]) if name and name.startswith(f"<{_PAGE}") else None

        def batch_of(found: list[Record]) -> pa.RecordBatch:
            get = [r.headers for r in found]
            names = [h["warc-record-id"][1:-1] for h in get]
            return pa.RecordBatch.from_arrays([
                pa.array([page(h["warc-record-id"]) for h in get], pa.int64()), pa.array([None if h["warc-target-uri"] == n else h["warc-target-uri"] for h, n in zip(get, names, strict=True)], pa.string()),
                pa.array([h["warc-type"] for h in get]), pa.array([page(h.get("warc-refers-to")) for h in get], pa.int64()),
                pa.array([h["warc-payload-digest"].removeprefix("sha1:") for h in get]), pa.array([r.payload if h["warc-type"] == "response" else None for r, h in zip(found, get, strict=True)], pa.binary()),
            ], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload"])

        for batch in batches:
            for value in batch.column(0):
                some: list[Record] = []
                for found in records(value.as_buffer().to_pybytes()):
                    some.append(found)
                    if sum(len(r.block) for r in some[-1:]) > STEP or len(some) >= 256:
                        yield batch_of(some)
                        some = []
                if some:
                    yield batch_of(some)

    return archives.select(content).mapInArrow(lean(parsed), "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary")


def payload_bytes(found: DataFrame) -> DataFrame:
    """Records with the length of their full payload; a revisit's is that of the response it refers to."""
    own = found.withColumn("own", F.octet_length("payload").cast("long"))
    lengths = materialise(
        own.filter("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own").alias("of_response")), "lengths"
    )
    return own.join(lengths, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.coalesce("own", "of_response")).drop("own", "of_response")
