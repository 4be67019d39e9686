"""WARC archives with an index: write, and read back by coalesced byte ranges.

Writing: of records with equal payloads of at least `min_bytes` bytes, the one with the largest
page_id becomes a `response`; the others become `revisit` records that refer to it. Each task writes
one archive of gzip members (one member per record) in the shared folder and returns the index rows:
file, offset, length, URL, digest. Every attempt of a task writes a file of its own, so a retried or
speculative attempt leaves nothing in the index but its own rows.

Reading: the selected index rows are dealt to tasks by ranges of (file, offset), as many as their
bytes in the archives ask for, sorted, and neighbours within `gap` bytes are fetched by one read of
at most `most` bytes (a longer record is read by itself).

Defined results: null html has an empty payload; a null URL leaves out the target header; rows that
repeat the largest page_id of a payload are all responses; rows whose page_id is null are responses
if no row with that payload has an id, else they revisit it; empty input writes no archive. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, map_batches

#: Bytes of archives that one reading task gets: at most the first, and at least the second as long as
#: that keeps all cores busy.
STRETCH, LEAST_STRETCH = 64 << 20, 1 << 20
#: Records of one payload, and their bytes, that may meet in one task.
HOT_ROWS, HOT_BYTES = 1000, 32 << 20
NO_SUCH = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL name space

INDEX = (
    "file string, offset long, length long, page_id long, url string, digest string, "
    "record_type string, refers_to long"
)
RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same for every attempt, so that a revisit can name the response in another archive."""
    return f"<urn:uuid:{uuid.uuid5(NO_SUCH, f'{page_id}/{digest}')}>"


def _header(value: str) -> str:
    """Without control characters, which would end the header line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def encode_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header of its page but no payload."""
    revisit = refers_to is not None
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """Headers and payload of one record; raises ValueError where the record is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    n = int(h["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length and content differ")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    size, digest = int(fields["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
    if h["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError("payload and digest differ")
    page, other = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
    return {
        "page_id": int(page) if page is not None else None,
        "url": h.get("WARC-Target-URI"),
        "record_type": h["WARC-Type"],
        "refers_to": int(other) if other is not None else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if h["WARC-Type"] == "response" else None,
    }


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to. Payloads are compared by SHA-256; only digests are grouped.

    A payload is hot if its records are more than HOT_ROWS and a 100,000th of all repeated ones, or
    hold more than HOT_BYTES and a 100,000th of their bytes. So at most 200,000 are, and those are
    broadcast. Records of other payloads meet by digest; the hot ones, which have their answer by
    then, are spread by their page_id."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    long_enough = F.octet_length("payload") >= min_bytes
    firsts = cut(
        rows.where(long_enough)
        .groupBy("sha")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"), (F.count("*") * F.max(F.octet_length("payload") + 100)).alias("bytes"))
        .where("n > 1 and first is not null"),
        "warc-firsts",
    )
    n, size = firsts.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "bytes")]).first()
    hot = (F.col("n") > max(HOT_ROWS, n // 100_000)) | (F.col("bytes") > max(HOT_BYTES, size // 100_000))
    top = firsts.where(hot).select(F.col("sha").alias("hot_sha"), F.col("first").alias("hot_first"))
    rest = firsts.where(~hot).select(F.col("sha").alias("own_sha"), F.col("first").alias("own_first"))
    spread = F.unhex(F.md5(F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit(""))))  # never as long as a digest
    first = F.when(long_enough, F.coalesce("hot_first", "own_first"))
    later = first.isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < first))
    return (
        rows.join(F.broadcast(top), F.col("sha") == F.col("hot_sha"), "left")
        .withColumn("meet", F.when(F.col("hot_sha").isNull(), F.col("sha")).otherwise(spread))
        .join(rest, F.col("meet") == F.col("own_sha"), "left")
        .select("page_id", "url", "payload", F.when(later, first).alias("refers_to"))
    )


def write(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write archives into `folder` (shared by driver and executors) and return their index, itself
    stored there as Parquet."""
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, out, at = f"{root}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    digest = digest_of(r["payload"])
                    raw = encode_record(r["page_id"], r["url"], r["payload"], digest, r["refers_to"], date)
                    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = pack.compress(raw) + pack.flush()
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(name, compression=None)
                    out.write(member)
                    kind = "response" if r["refers_to"] is None else "revisit"
                    rows.append((name, at, len(member), r["page_id"], r["url"], digest, kind, r["refers_to"]))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _INDEX_TYPES, strict=True)],
                        [x.split()[0] for x in INDEX.split(", ")],
                    )
        finally:
            if out is not None:
                out.close()

    index = map_batches(with_originals(pages, min_bytes), run, INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


_INDEX_TYPES = [
    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(),
]


def ranges(rows: list[dict], gap: int, most: int) -> Iterator[tuple[int, int, list[dict]]]:
    """Coalesced byte ranges (start, end, rows) of index rows sorted by offset."""
    start = end = 0
    held: list[dict] = []
    for r in rows:
        until = r["offset"] + r["length"]
        if held and (r["offset"] - end > gap or until - start > most):
            yield start, end, held
            held = []
        if not held:
            start = r["offset"]
        held.append(r)
        end = until
    if held:
        yield start, end, held


def read(selected: DataFrame, folder: str, gap: int = 64 << 10, most: int = 8 << 20, payload: bool = True) -> DataFrame:
    """The records that the selected index rows name (RECORD). With payload=False the payloads are
    checked against their digests but not returned."""

    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        source, opened = None, None
        for batch in batches:
            by_file: dict[str, list[dict]] = {}
            for r in batch.to_pylist():
                by_file.setdefault(r["file"], []).append(r)
            for file, rows in by_file.items():
                if file != opened:
                    if source is not None:
                        source.close()
                    source, opened = store.open_input_file(file), file
                for start, end, group in ranges(rows, gap, most):
                    data = source.read_at(end - start, start)
                    out = []
                    for r in group:
                        lo = r["offset"] - start
                        got = decode_record(zlib.decompress(data[lo : lo + r["length"]], 31))
                        if not payload:
                            got["payload"] = None
                        out.append(got)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[n] for x in out], t) for n, t in zip(names, types, strict=True)], names
                    )
        if source is not None:
            source.close()

    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    cores = selected.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-size // STRETCH), min(-(-size // LEAST_STRETCH), 2 * cores))
    return map_batches(
        selected.select("file", "offset", "length")
        .repartitionByRange(tasks, "file", "offset")
        .sortWithinPartitions("file", "offset"),
        run,
        RECORD,
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, select every record of the index, and read the archives back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read(write(pages, folder, min_bytes), folder, payload=False)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    ((((strpos('0123456789abcdef', substr(hex, CAST((i * 5) // 4 + 1 AS INTEGER), 1)) - 1) * 16
       + greatest(0, strpos('0123456789abcdef', substr(hex || '0', CAST((i * 5) // 4 + 2 AS INTEGER), 1)) - 1))
      >> CAST(3 - i % 4 AS INTEGER)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM d
"""
