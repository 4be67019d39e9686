import base64
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidefold.llm import queries, warc
from tidefold.llm.common import fresh_path

SF = "/root/testdata/sf0.01"


def brute(rows, min_bytes=0):
    data = [(p, (h or "").encode()) for p, h in rows]
    top = {}
    for p, b in data:
        if p is not None:
            top[b] = max(top.get(b, p), p)
    out = []
    for p, b in data:
        first = top.get(b) if len(b) >= min_bytes else None
        other = first if first is not None and (p is None or p < first) else None
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((p, len(b), digest, "response" if other is None else "revisit", other))
    return sorted(out, key=str)


def test_whole_table_matches_sql(spark):
    got = sorted(tuple(r) for r in queries.op3_warc(spark, SF).collect())
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    assert got == sorted(con.sql(warc.ORACLE_SQL).fetchall())
    rows = con.sql("select page_id, html from pages").fetchall()
    assert sorted(got, key=str) == brute(rows)


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_odd_rows_round_trip(spark, min_bytes):
    html = ["a" * 10, "a" * 10, None, "", "é\r\n\r\nWARC/1.1\r\n", "é\r\n\r\nWARC/1.1\r\n", "z" * 3_000_000, "b", "b"]
    data = [(i, f"http://x/{i}", h, "f") for i, h in enumerate(html)]
    data += [(None, "http://n/", "a" * 10, "f"), (None, None, "only", "f"), (1, "http://x\r\nEvil: 1", "a" * 10, "f"), (50, "u", "\x00", "f")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, file string")
    folder = fresh_path(spark, "warc-test")
    index = warc.write(pages, folder, min_bytes)
    assert index.count() == len(data)
    rows = warc.read(index, folder, gap=10, most=1000).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == brute([(p, h) for p, _, h, _ in data], min_bytes)
    texts = {p: (h or "").encode() for p, _, h, _ in data if p is not None}
    assert all(bytes(r.payload) == texts[r.page_id] for r in rows if r.record_type == "response" and r.page_id is not None)
    some = warc.read(index.where("url like 'http://x/%' and page_id in (2, 6)"), folder).collect()
    assert sorted(r.page_id for r in some) == [2, 6]
    assert warc.read(warc.write(pages.limit(0), fresh_path(spark, "warc-empty")), folder).count() == 0


def test_hot_payloads_and_reading_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_ROWS", 20)
    monkeypatch.setattr(warc, "LEAST_STRETCH", 1000)
    data = [(i, f"http://x/{i}", "" if i % 3 else f"page {i} " * 50) for i in range(300)] + [(None, None, None)] * 5
    data += [(i, None, "twice") for i in (400, 401)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    folder = fresh_path(spark, "warc-hot")
    index = warc.write(pages, folder)
    back = warc.read(index, folder, payload=False)
    assert back.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    got = back.withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in got}) > 4
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == brute([(p, h) for p, _, h in data])


def test_ranges_are_coalesced():
    rows = [{"offset": o, "length": n} for o, n in ((0, 10), (10, 10), (25, 5), (100, 50), (150, 500))]
    assert [(a, b, len(g)) for a, b, g in warc.ranges(rows, 5, 100)] == [(0, 30, 3), (100, 150, 1), (150, 650, 1)]


def test_damage_is_found():
    raw = warc.encode_record(1, "u", b"abc", warc.digest_of(b"abc"), None, "d")
    assert warc.decode_record(raw)["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.decode_record(raw.replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="length"):
        warc.decode_record(raw[:-2])
