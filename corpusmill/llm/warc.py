"""WARC archives with revisit records in place of repeated payloads.

Headers (page_id and payload digest, no payload) are shuffled by digest. Of the pages of a digest, that with the smallest
page_id is the original; the others join it and become revisit records, which refer to it and hold no payload. Sieves of a
bounded number of bits tell which digests repeat and which pages are originals: pages whose digest does not are written from
the scan, and of the others originals alone carry their payload into the join. Each task writes one archive, a gzip member
for each record, all with fresh headers; reading gives each record's headers and payload.

A record's id is a UUID, made of page_id and digest so that revisits can name their original's; page_id has a header of its
own. Rows that repeat page_id and payload are records of the same id.

Edge cases: a null html has an empty payload. Payloads shorter than ``min_bytes`` are never revisits. Pages that repeat the
original's page_id and payload are responses too. A null page_id has a random record id and comes back as null: it revisits
an original that has an id, and is never one itself. A null url is left out of the headers. An empty table makes
no archive. Columns besides the named ones aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions, scratch, text_slices, written
from .files import new_file, open_input
from .sieves import passes, sieve

MIN_BYTES = 0
#: Bytes that a task reads from an archive at once.
READ_BYTES = 1 << 20
PAGE_ID, REFERS = "X-Page-ID", "X-Refers-To-Page-ID"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(sha1: bytes) -> str:
    """A digest's bare upper-case base32 form."""
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record, a gzip member of its own; ``size`` is the length of the page's payload, which a revisit leaves out."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Target-URI", None if url is None else " ".join(url.split())),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", size),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None),
        (PAGE_ID, page_id),
        (REFERS, refers_to),
        ("Content-Type", "text/html"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive; one member is in memory at a time."""
    rest = b""
    while True:
        member, out = zlib.decompressobj(wbits=31), []
        while not member.eof:
            data = rest or stream.read(READ_BYTES)
            if not data and not out:
                return
            if not data:
                raise ValueError("the archive ends inside a record")
            out.append(member.decompress(data))
            rest = member.unused_data
        head, _, block = b"".join(out).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        if not lines[0].startswith("WARC/") or block[size:] != b"\r\n\r\n":
            raise ValueError("not a WARC record")
        yield headers, block[:size]


def resolve(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """The pages with __digest (SHA-1, binary), __size (of the payload) and __refers (the original's page_id for revisits,
    else null). A revisit's html may have become null on the way; no other has."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    pages = pages.withColumns({"__digest": F.unhex(F.sha1(payload)), "__size": F.octet_length(payload).cast("long")})
    by_digest, by_page = F.xxhash64("__digest"), F.xxhash64("__digest", page_id)
    headers = written(pages.filter(F.col("__size") >= min_bytes).select(page_id, "__digest"), "headers")
    originals = headers.groupBy("__digest").agg(F.min(page_id).alias("__first"), F.count("*").alias("n")).filter("n > 1 AND __first IS NOT NULL")
    originals = checkpoint(originals.select("__digest", "__first"))
    context = pages.sparkSession.sparkContext
    repeats = context.broadcast(sieve(originals.select(by_digest.alias("name"))))

    @F.pandas_udf("boolean")
    def may_repeat(names: pd.Series) -> pd.Series:
        return pd.Series(passes(repeats.value, names.to_numpy()))

    # pages that the first sieve lets pass though their digest doesn't repeat keep their payloads too
    single = headers.filter(may_repeat(by_digest)).join(originals, "__digest", "left_anti").select(by_digest.alias("name"))
    carries = context.broadcast(sieve(originals.select(F.xxhash64("__digest", "__first").alias("name")).unionByName(single)))

    @F.pandas_udf("boolean")
    def may_carry(digests: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series(passes(carries.value, digests.to_numpy()) | passes(carries.value, names.to_numpy()))

    sifted = pages.withColumn("__repeats", (F.col("__size") >= min_bytes) & may_repeat(by_digest))
    single = sifted.filter(~F.col("__repeats")).withColumn("__refers", F.lit(None).cast(pages.schema[page_id].dataType))
    some = sifted.filter("__repeats").withColumn(html, F.when(may_carry(by_digest, by_page), F.col(html)))
    joined = some.join(originals, "__digest", "left").withColumn("__refers", F.when(~F.col("__first").eqNullSafe(F.col(page_id)), F.col("__first")))
    kept = [*pages.columns, "__refers"]
    return single.select(*kept).unionByName(joined.select(*kept))


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the pages' records to archives in ``folder``; returns the manifest: file, records."""
    named = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = resolve(named, min_bytes=min_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = text_slices(batches, "html")
        first, n = next(slices, None), 0
        if first is None:
            return
        with new_file(folder, "pages", ".warc.gz") as (path, stream):
            for cut, texts in (x for xs in ((first,), slices) for x in xs):
                for i, u, t, n_bytes, d, r in zip(*(cut.column(c).to_pylist() for c in ("page_id", "url")), texts, *(cut.column(c).to_pylist() for c in ("__size", "__digest", "__refers"))):
                    stream.write(record(i, u, t.encode(), n_bytes, digest32(d), r))
                n += cut.num_rows
        yield pa.RecordBatch.from_pydict({"file": [path], "records": [n]})

    return checkpoint(rows.select("page_id", "url", "html", "__size", "__digest", "__refers").mapInArrow(run, "file string, records long"))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame) -> DataFrame:
    """Each record of the archives; payload is null for revisits. A response whose payload has another digest or length
    than its headers say is an error."""

    def number(value: str | None) -> int | None:
        return int(value) if value else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for path in batch.column("file").to_pylist():
                held, size = [], 0
                with open_input(path) as stream:
                    for h, block in read_records(stream):
                        digest, length = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["WARC-Payload-Length"])
                        response = h["WARC-Type"] == "response"
                        if response and (len(block) != length or digest32(hashlib.sha1(block).digest()) != digest):
                            raise ValueError(f"{path}: the payload of {h.get('WARC-Record-ID')} is damaged")
                        held.append((number(h.get(PAGE_ID)), h.get("WARC-Target-URI"), length, digest, h["WARC-Type"], number(h.get(REFERS)), block if response else None))
                        size += len(block) + 200
                        if size > 4_000_000:
                            yield pack(held)
                            held, size = [], 0
                if held:
                    yield pack(held)

    files = manifest.select("file")
    return files.repartition(max(1, min(files.count(), 4 * partitions(manifest.sparkSession)))).mapInArrow(run, READ)


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back."""
    return read_archives(write_archives(pages, scratch(pages.sparkSession, "warc"), **options))
