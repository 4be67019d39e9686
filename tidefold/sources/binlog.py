"""The binary log format: segments of framed records, read and written as Spark jobs.

Record: tag (1 byte), payload length (u32), CRC-32 (u32, over the tag byte and all from the previous
hash on), previous hash (32 bytes), payload. All numbers are little-endian. Payload of a data record:
key length (u32), key, hlc (u64), replica (32), author (32), value length (u64), value and, for puts
with expiry, expires_at (u64); of a batch: count (u32), then tag, length (u32) and payload of each.
A record's hash is SHA-256 of the previous hash and its bytes.

Each record carries its previous hash, so segments are read in parallel, from any file system that Spark
reads: a first pass takes from each segment its number of records and the hashes at its ends, a second
decodes it knowing where it stands in the chain of its namespace. Writing follows the chain, so one task
writes a namespace, but it holds one segment at a time.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..schema import BATCH, DEL, LOG, PUT_TTL
from ..shared import cut, small_side

ZERO = bytes(32)
HEADER = 41
SEGMENT = 64 << 20
#: Segments whose places in the chains are broadcast, about 200 bytes each; of more logs, contents are
#: shuffled to them.
MOST_SEGMENTS = 200_000
#: About the bytes of decoded records that a task hands on together.
HELD = 8 << 20
RECORDS = f"{LOG}, prev binary, hash binary"


class Corrupt(ValueError):
    pass


def encode_payload(tag: int, key, hlc: int, replica, author, value, expires_at: int, ops=None) -> bytes:
    if tag == BATCH:
        parts = [struct.pack("<I", len(ops))]
        for o in ops:
            body = encode_payload(o["tag"], o["key"], o["hlc"], o["replica"], o["author"], o["value"], o["expires_at"])
            parts.append(struct.pack("<BI", o["tag"], len(body)) + body)
        return b"".join(parts)
    key, value = bytes(key), b"" if tag == DEL else bytes(value or b"")
    out = struct.pack("<I", len(key)) + key + struct.pack("<Q", hlc) + bytes(replica) + bytes(author)
    out += struct.pack("<Q", len(value)) + value
    return out + struct.pack("<Q", expires_at) if tag == PUT_TTL else out


def frame(tag: int, payload: bytes, prev: bytes) -> bytes:
    tail = prev + payload
    return struct.pack("<BII", tag, len(payload), zlib.crc32(bytes([tag]) + tail)) + tail


def chain_hash(prev: bytes, record: bytes) -> bytes:
    return hashlib.sha256(prev + record).digest()


def decode_payload(tag: int, p: bytes) -> dict:
    try:
        if tag == BATCH:
            (n,), at, ops = struct.unpack_from("<I", p), 4, []
            for _ in range(n):
                kind, size = struct.unpack_from("<BI", p, at)
                ops.append({"tag": kind} | decode_payload(kind, p[at + 5 : at + 5 + size]))
                at += 5 + size
            if at != len(p):
                raise Corrupt("bytes after the batch")
            return {"ops": ops}
        (n,) = struct.unpack_from("<I", p)
        key, at = p[4 : 4 + n], 4 + n
        (hlc,) = struct.unpack_from("<Q", p, at)
        replica, author = p[at + 8 : at + 40], p[at + 40 : at + 72]
        (size,) = struct.unpack_from("<Q", p, at + 72)
        value, end = p[at + 80 : at + 80 + size], at + 80 + size
        expires = struct.unpack_from("<Q", p, end)[0] if tag == PUT_TTL else 0
        if end + (8 if tag == PUT_TTL else 0) != len(p):
            raise Corrupt("payload length")
    except struct.error as e:
        raise Corrupt("payload is cut off") from e
    return {"key": key, "hlc": hlc, "replica": replica, "author": author, "value": value, "expires_at": expires}


def walk(data: bytes) -> tuple[int, bytes | None]:
    """Number of records of a segment without a torn one at its end, and the hash of the last. Only the
    last record's checksum is looked at."""
    n = at = 0
    last = before = None
    while at + HEADER <= len(data):
        size = struct.unpack_from("<I", data, at + 1)[0]
        if at + HEADER + size > len(data):
            break
        before, last, n, at = last, (at, at + HEADER + size), n + 1, at + HEADER + size
    if last and last[1] == len(data):
        raw = data[slice(*last)]
        if zlib.crc32(raw[:1] + raw[9:]) != struct.unpack_from("<I", raw, 5)[0]:
            n, last = n - 1, before
    if not last:
        return 0, None
    raw = data[slice(*last)]
    return n, chain_hash(raw[9:HEADER], raw)


def decode_segment(data: bytes, prev: bytes, seq: int, last: bool, torn_tail: bool = True, keep_unparsed: bool = False) -> Iterator[dict]:
    """Records of a segment that follows the record of number seq and hash prev. A last record that is
    cut off or fails its checksum is dropped if it ends the last segment and torn_tail is set; anything
    else unsound raises Corrupt. With keep_unparsed a record of the chain whose payload makes no sense
    is kept without its fields, as the change feed shows it."""
    at = 0
    while at < len(data):
        if at + HEADER > len(data):
            if last and torn_tail:
                return
            raise Corrupt("record is cut off")
        tag, size, crc = struct.unpack_from("<BII", data, at)
        if not 1 <= tag <= 6:
            raise Corrupt(f"tag {tag}")
        raw = data[at : at + HEADER + size]
        ends = at + HEADER + size >= len(data)
        if len(raw) < HEADER + size or zlib.crc32(raw[:1] + raw[9:]) != crc:
            if last and ends and torn_tail:
                return
            raise Corrupt("checksum")
        if raw[9:HEADER] != prev:
            raise Corrupt("chain")
        own, seq = chain_hash(prev, raw), seq + 1
        try:
            fields = decode_payload(tag, raw[HEADER:])
        except Corrupt:
            if not keep_unparsed:
                raise
            fields = {}
        yield {"seq": seq, "tag": tag, "prev": prev, "hash": own} | fields
        prev, at = own, at + len(raw)


def decode_segments(segments: list[bytes], torn_tail: bool = True) -> Iterator[dict]:
    """Records of a namespace in order, see decode_segment."""
    prev, seq = ZERO, 0
    for i, data in enumerate(segments):
        for r in decode_segment(data, prev, seq, i == len(segments) - 1, torn_tail):
            prev, seq = r["hash"], r["seq"]
            yield r


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """ns, policy of all namespaces under path, from the one byte of their policy.bin: 0 lww, 1 register."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "policy.bin").load(path)
    name = F.unhex(F.regexp_extract("path", "/[0-9a-f]+_([0-9a-f]+)/policy\\.bin$", 1)).cast("string")
    byte = F.hex("content")
    bad = F.raise_error(F.concat(F.lit("bad policy of "), name)).cast("string")
    return files.select(name.alias("ns"), F.when(byte == "00", "lww").when(byte == "01", "register").otherwise(bad).alias("policy"))


def read_log(spark: SparkSession, path: str, torn_tail: bool = True, keep_unparsed: bool = False) -> DataFrame:
    """The records of all namespaces under path (folders `<hex length>_<hex name>`, files
    log.<n>.seg), with prev and hash; keep_unparsed as in decode_segment."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "log.*.seg").load(path)
    named = files.select(
        F.regexp_extract("path", "/[0-9a-f]+_([0-9a-f]+)/log\\.\\d+\\.seg$", 1).alias("folder"),
        F.regexp_extract("path", "log\\.(\\d+)\\.seg$", 1).cast("int").alias("segment"),
        "content",
    )
    columns = [c.split()[0] for c in RECORDS.split(", ")]

    def survey(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n, own = zip(*(walk(bytes(x)) for x in pdf["content"]), strict=True) if len(pdf) else ((), ())
            yield pdf[["folder", "segment"]].assign(n=list(n), own=list(own))

    order = Window.partitionBy("folder").orderBy("segment")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = named.mapInPandas(survey, "folder string, segment int, n long, own binary").select(
        "folder",
        "segment",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("seq"),
        F.coalesce(F.last("own", ignorenulls=True).over(ahead), F.lit(ZERO)).alias("before"),
        F.lead("segment").over(order).isNull().alias("last"),
        (F.row_number().over(order) - 1).alias("place"),
    )

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for x in pdf.itertuples():
                if x.segment != x.place:
                    raise Corrupt("a segment is missing")
                ns, rows, size = bytes.fromhex(x.folder).decode(), [], 0
                for r in decode_segment(bytes(x.content), bytes(x.before), x.seq, x.last, torn_tail, keep_unparsed):
                    rows.append(dict.fromkeys(columns) | {"hlc": 0, "expires_at": 0} | r)
                    size += len(r.get("value") or b"") + 1000 * len(r.get("ops", "1"))
                    if size >= HELD:
                        yield pd.DataFrame(rows, columns=columns).assign(ns=ns)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns).assign(ns=ns)

    # one small row per segment: while they are few, the contents stay where they are read
    return named.join(small_side(cut(ends, "segments"), MOST_SEGMENTS), ["folder", "segment"]).mapInPandas(decode, RECORDS)


def encode_log(log: DataFrame, segment_bytes: int = SEGMENT) -> DataFrame:
    """ns, segment, content: the segments of a log, chained in seq order; a segment ends once it holds
    segment_bytes. The result can be written file by file on any store."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ns, prev, number, held = None, ZERO, 0, bytearray()

        def ended() -> pd.DataFrame:
            return pd.DataFrame({"ns": [ns], "segment": [number], "content": [bytes(held)]})

        for pdf in frames:
            for r in pdf.to_dict("records"):
                if r["ns"] != ns:
                    if held:
                        yield ended()
                    ns, prev, number, held = r["ns"], ZERO, 0, bytearray()
                ops = r["ops"] if r["tag"] == BATCH else None
                raw = frame(r["tag"], encode_payload(r["tag"], r["key"], r["hlc"], r["replica"], r["author"], r["value"], r["expires_at"], ops), prev)
                prev = chain_hash(prev, raw)
                held += raw
                if len(held) >= segment_bytes:
                    yield ended()
                    number, held = number + 1, bytearray()
        if held:
            yield ended()

    # a batch has no clock of its own; nulls would turn the 64-bit columns of a frame into doubles
    whole = log.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("hlc", "expires_at")})
    return whole.repartition("ns").sortWithinPartitions("ns", "seq").mapInPandas(encode, "ns string, segment int, content binary")


def write_log(log: DataFrame, path: str, segment_bytes: int = SEGMENT) -> int:
    """Write a log as segment files under path, a folder that must not exist yet; the number of segments.
    Each task writes its segments under names of its own and then gives them their final ones, so that a
    task that is run again finds whole files or none."""
    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(path)

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        for pdf in frames:
            for r in pdf.itertuples():
                folder = f"{root}/{r.folder}"
                store.create_dir(folder, recursive=True)
                name, own = f"{folder}/log.{r.segment}.seg", f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(r.content)
                if store.get_file_info(name).type == fs.FileType.NotFound:
                    store.move(own, name)
                else:
                    store.delete_file(own)
            yield pd.DataFrame({"n": [len(pdf)]})

    made = encode_log(log, segment_bytes).withColumn("folder", codec.namespace_folder(F.col("ns")))
    return made.mapInPandas(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
