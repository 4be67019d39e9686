"""Binary files: the log sink and the snapshot reader."""

import struct

import pytest
from pyspark.sql import functions as F

from tidefold.operators import fold, merge, ops
from tidefold.schema import LOG
from tidefold.sources import binlog, snapshot

A, B = b"\x01" * 32, b"\x02" * 32


def text(x):
    return struct.pack("<I", len(x)) + x


def version(v, hlc, replica=A, seq=1, expires=0, old=False):
    out = struct.pack("<Q", hlc) + replica + replica + text(v) + struct.pack("<Q", seq)
    return out if old else out + struct.pack("<Q", expires)


def snapshot_bytes(old=False):
    v = lambda *a, **k: version(*a, old=old, **k)
    out = b"xxxx" + (b"IDX1" if old else b"IDX2") + struct.pack("<QI", 9, 1) + text(b"meta") + text(b"\0\1")
    out += struct.pack("<I", 1) + text(b"peer") + struct.pack("<q", -70)
    out += struct.pack("<I", 3)
    out += text(b"n") + struct.pack("<BQ", 0, 5) + A + struct.pack("<I", 2)
    out += text(b"a") + b"\0" + v(b"one", 100) + text(b"t") + b"\0" + v(b"two", 101, seq=2, expires=50)
    out += struct.pack("<I", 1) + text(b"gone") + struct.pack("<Q", 102)
    out += text(b"r") + struct.pack("<BQ", 1, 2) + B + struct.pack("<I", 1)
    out += text(b"k") + b"\1" + struct.pack("<I", 2) + v(b"x", 1) + v(b"y", 2, B, 2) + struct.pack("<I", 0)
    return out + text(b"empty") + struct.pack("<BQ", 0, 0) + bytes(32) + struct.pack("<II", 0, 0)


def written(path, data):
    path.mkdir(parents=True, exist_ok=True)
    (path / "index.snap").write_bytes(data)
    return f"file://{path}"


@pytest.mark.parametrize("old", [False, True])
def test_snapshot_rows(spark, tmp_path, old):
    url = written(tmp_path / "s", snapshot_bytes(old))
    rows = snapshot.read_snapshot(spark, url)
    expires = 0 if old else 50
    assert sorted((r.ns, bytes(r.key), r.tag, r.hlc, r.seq, r.expires_at, bytes(r.value)) for r in rows.collect()) == [
        ("n", b"a", 1, 100, 1, 0, b"one"), ("n", b"gone", 2, 102, 5, 0, b""), ("n", b"t", 1 if old else 3, 101, 2, expires, b"two"),
        ("r", b"k", 1, 1, 1, 0, b"x"), ("r", b"k", 1, 2, 2, 0, b"y"),
    ]
    assert [tuple(r) for r in snapshot.read_heads(spark, url).orderBy("ns").collect()] == [
        ("empty", "lww", 0, bytes(32).hex()), ("n", "lww", 5, A.hex()), ("r", "register", 2, B.hex())
    ]
    assert [tuple(r) for r in snapshot.read_peer_clocks(spark, url).collect()] == [("peer", -70)]
    kept = {bytes(r.key): bytes(r.value) for r in fold.state(rows.where("ns = 'n'"), 40).collect()}
    assert kept == {b"a": b"one", b"t": b"two"}
    assert fold.register_versions(rows.where("ns = 'r'")).count() == 2


def test_damaged_snapshots(spark, tmp_path):
    good = snapshot_bytes()
    for i, bad in enumerate((good[:-1], good + b"\0", b"xxxxIDX3" + good[8:], good[:5])):
        with pytest.raises(Exception, match="Corrupt"):
            snapshot.read_snapshot(spark, written(tmp_path / str(i), bad)).collect()
    assert snapshot.read_snapshot(spark, written(tmp_path / "empty", b"")).isEmpty()


def log(spark, n=200):
    rows = [(ns, i, 2 if i % 9 == 0 else 1, b"k%d" % (i % 20), i, A, A, b"v%d" % i, 0, None) for ns in ("n", "u/x") for i in range(1, n + 1)]
    rows = [(*r[:7], b"", *r[8:]) if r[2] == 2 else r for r in rows]
    return spark.createDataFrame(rows, LOG)


def test_written_logs_are_read_back(spark, tmp_path):
    url = f"file://{tmp_path}/log"
    n = binlog.write_log(log(spark).repartition(3), url, 2_000)
    assert n > 10 and len(list((tmp_path / "log").rglob("log.*.seg"))) == n
    assert not [f for f in (tmp_path / "log").rglob("*") if f.name.startswith(".") and not f.name.endswith(".crc")]
    back = binlog.read_log(spark, url)
    plain = lambda df: sorted((r.ns, r.seq, r.tag, bytes(r.key), bytes(r.value)) for r in df.collect())
    assert plain(back) == plain(log(spark)) and merge.chain_breaks(back).isEmpty()
    with pytest.raises(FileExistsError):
        binlog.write_log(log(spark), url)
    assert binlog.write_log(log(spark).limit(0), f"file://{tmp_path}/none") == 0


@pytest.mark.parametrize("mode", ["local", "merge"])
def test_snapshot_and_tail_equal_the_whole_log(spark, tmp_path, mode):
    """A snapshot at record 120 of one namespace, and the whole binary log beside it."""
    url = f"file://{tmp_path}/store"
    whole = log(spark)
    binlog.write_log(whole, url, 2_000)
    head = ops.explode_batches(whole.where("ns = 'n' and seq <= 120"))
    alive = fold.lww(head, mode).collect()
    live_keys = {bytes(r.key) for r in alive}
    dead = [bytes(r.key) for r in fold.tombstones(head).collect() if bytes(r.key) not in live_keys]
    out = b"xxxxIDX2" + struct.pack("<QIII", 0, 0, 0, 1) + text(b"n") + struct.pack("<BQ", 0, 120) + A + struct.pack("<I", len(alive))
    for r in alive:
        out += text(bytes(r.key)) + b"\0" + version(bytes(r.value), r.hlc, seq=r.seq)
    out += struct.pack("<I", len(dead)) + b"".join(text(k) + struct.pack("<Q", 1) for k in dead)
    written(tmp_path / "store", out)
    plain = lambda df: sorted((r.ns, bytes(r.key), bytes(r.value), r.seq) for r in fold.state(df, 0, mode=mode).collect())
    both = snapshot.read_store(spark, url)
    assert plain(both) == plain(ops.explode_batches(whole))
    assert both.where((F.col("ns") == "n") & (F.col("tag") != 2)).count() < 120
