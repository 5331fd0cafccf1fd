"""WARC archives, index first.

Pages are written as WARC/1.1 records, one gzip member each, and every record
leaves an index row: file, offset, length, URL and payload digest.  Reading
starts from the index: the selected records are put in order by file and
offset, neighbours are coalesced into byte ranges, each range is fetched with
one read, and its records are parsed from there.

Of records with equal payloads of at least ``SMALL`` bytes the one with the
largest id is a response and the others are revisits of it; smaller payloads
are always responses.

Defined results: a null payload is empty; rows without an id may be revisits
but never the response that others refer to, unless no equal row has an id, in
which case all of them are responses; rows that repeat the response's id and
payload are responses too.  An id may be of any type that casts to a string
and back; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import spread, staged, work_path

#: Payloads below this many bytes are never revisits.
SMALL = 1000
#: Bytes of an archive that one range read may span, and the gap worth reading over.
RANGE_BYTES = 4 << 20
GAP_BYTES = 64 << 10
#: Ranges that one task reads, one after another.
RANGES_PER_TASK = 16
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 1


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _name(page: str | None) -> str:
    return f"<urn:x-page:{quote(page, safe=str())}>" if page is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _uri(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "about:blank")


def page_record(page, url: str | None, payload: bytes, refers_to, date: str) -> tuple[bytes, str]:
    """A response or revisit record, packed, and the payload's SHA-1 in hex."""
    sha = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha.digest()).decode()),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    return _member(_record(fields, http + payload if refers_to is None else http)), sha.hexdigest()


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields in lower case, HTTP head and payload of one packed record."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of (``page_id``, ``url``, ``html``) below ``folder``; returns the staged index.

    Index columns: page_id, url, file, offset, length, digest, record_type.
    Equal payloads are found by a shuffle of digests alone.  The result of
    that is written first, so the planner knows its true size when it chooses
    how to join it with the pages.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = [F.sha1(F.col("html")).alias("digest"), F.octet_length("html").alias("bytes")]
    owners = staged(
        rows.select("page_id", *key).where(F.col("bytes") >= SMALL).groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("owner")).where("n > 1 and owner is not null").drop("n"),
        "warc-owners",
    )
    joined = rows.select("*", *key).join(owners, ["digest", "bytes"], "left")
    other = F.when(~F.col("owner").eqNullSafe(F.col("page_id")), F.col("owner"))
    todo = joined.select("page_id", "url", "html", F.col("page_id").cast("string").alias("name"), other.cast("string").alias("refers_to"))
    id_type = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        file = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.warc.gz"
        sink, at = None, 0
        for batch in batches:
            if sink is None:
                sink = store.open_output_stream(f"{top}/{file}", compression=None)
                info = _member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _name(None)), ("WARC-Date", date), ("WARC-Filename", file), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                sink.write(info)
                at += len(info)
            places = []
            for page, url, html, other in zip(batch.column("name").to_pylist(), batch.column("url").to_pylist(), batch.column("html").cast(pa.binary()), batch.column("refers_to").to_pylist()):
                packed, digest = page_record(page, url, html.as_py(), other, date)
                sink.write(packed)
                places.append((at, len(packed), digest, "response" if other is None else "revisit"))
                at += len(packed)
            offsets, lengths, digests, kinds = zip(*places) if places else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array([file] * len(places), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string())],
                ["page_id", "url", "file", "offset", "length", "digest", "record_type"],
            )
        if sink is not None:
            sink.close()

    return staged(todo.mapInArrow(run, f"page_id {id_type}, url string, file string, offset bigint, length bigint, digest string, record_type string"), "warc-index")


def coalesce(places: list[tuple[int, int]], gap: int = GAP_BYTES) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) pairs as reads: first byte, end, and the records inside."""
    reads: list[list] = []
    for at, n in sorted(places):
        if reads and at - reads[-1][1] <= gap:
            reads[-1][1] = max(reads[-1][1], at + n)
            reads[-1][2].append((at, n))
        else:
            reads.append([at, at + n, [(at, n)]])
    return [tuple(r) for r in reads]


def read_records(index: DataFrame, folder: str, with_payload: bool = False, range_bytes: int = RANGE_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """The records that rows of an index name, read back from the archives.

    Columns: page_id, url, file, offset, record_type, payload_bytes,
    payload_digest (hex), refers_to, and ``payload`` if asked for (null for
    revisits).  A response whose payload doesn't have its recorded digest
    raises.  Only index rows are shuffled, by file and range.
    """
    id_type = dict(index.dtypes).get("page_id", "bigint")
    # the count is given, for index rows of a few bytes would otherwise be merged into one task
    n = (index.agg(F.sum("length")).first()[0] or 0) // range_bytes + 1
    ranges = index.select("file", F.floor(F.col("offset") / range_bytes).alias("range"), "offset", "length").repartition(spread(index.sparkSession, n, RANGES_PER_TASK), "file", "range")
    ranges = ranges.groupBy("file", "range").agg(F.collect_list(F.struct("offset", "length")).alias("places")).select("file", "places")
    names = ["page_id", "url", "file", "offset", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload

    def page(name: str | None):
        kind, _, value = (name or "").strip("<>").rpartition(":")
        return unquote(value) if kind == "urn:x-page" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, places in zip(batch.column("file").to_pylist(), batch.column("places").to_pylist()):
                out = []
                with store.open_input_file(f"{top}/{file}") as f:
                    for first, end, inside in coalesce([(p["offset"], p["length"]) for p in places], gap):
                        held = memoryview(f.read_at(end - first, first))
                        for at, n in inside:
                            fields, http, payload = parse_record(held[at - first : at - first + n])
                            digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                            kind = fields["warc-type"]
                            if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{file} at {at}: the payload has another digest")
                            size = len(payload) if kind == "response" else int(http.rpartition(b"Content-Length: ")[2])
                            row = (page(fields["warc-record-id"]), fields["warc-target-uri"], file, at, kind, size, digest, page(fields.get("warc-refers-to")))
                            out.append((*row, payload if kind == "response" else None) if with_payload else row)
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "page_id string, url string, file string, offset bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to string" + ", payload binary" * with_payload
    return ranges.mapInArrow(run, schema).withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, then read every record back through the index."""
    folder = work_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_records(index, folder).drop("file", "offset")
