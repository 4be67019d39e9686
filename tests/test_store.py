import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tidefold import store as st
from tidefold.operators import fold, ops

A, B = b"\x01" * 32, b"\x03" * 32
NEVER = 2**63 - 1


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, f"file://{tmp_path}/a", A, mode="local")


def log(spark, rows, ns="n"):
    """rows: (tag, key, hlc, replica, value, expires_at); seq follows the list."""
    data = [(ns, i, t, k.encode(), h, r, r, v.encode(), e, None) for i, (t, k, h, r, v, e) in enumerate(rows, 1)]
    return spark.createDataFrame(data, st.LOG)


def values(df):
    return {bytes(r.key).decode(): bytes(r.value).decode() for r in df.collect()}


def test_put_delete_scan(store):
    n = store.create_namespace("n")
    assert [n.put(b"1", b"hello"), n.put(b"a/x", b"nested"), n.delete(b"1")] == [1, 2, 3]
    assert n.get(b"1") is None and n.get(b"a/x") == b"nested"
    assert [bytes(r.key) for r in n.scan_keys().collect()] == [b"a/x"] and n.head() == 3
    assert n.put(b"1", b"back") == 4 and n.get(b"1") == b"back"
    assert [r.seq for r in n.changes(since=2).collect()] == [3, 4]
    with pytest.raises(st.NamespaceExists):
        store.create_namespace("n")
    with pytest.raises(st.InvalidName):
        store.create_namespace("No")
    with pytest.raises(st.NamespaceNotFound):
        store.use("other")


def test_batches(store):
    n = store.create_namespace("n")
    n.put(b"c", b"old")
    seq = n.put_batch([("put", b"a", b"v1", 0), ("put", b"b", b"v2", NEVER), ("del", b"c", b"", 0)])
    assert seq == 2 and values(n.state()) == {"a": "v1", "b": "v2"}
    n.put_batch([("put", b"k", b"first", 0), ("del", b"k", b"", 0), ("put", b"k", b"again", 0)])
    assert n.get(b"k") == b"again"
    with pytest.raises(st.EmptyBatch):
        n.put_batch([])


def test_register_keeps_versions(store):
    n = store.create_namespace("r", "register")
    n.put(b"k", b"a")
    n.put_batch([("put", b"x", b"one", 0), ("put", b"x", b"two", 0)])
    n.put(b"k", b"b")
    assert [bytes(r.value) for r in n.versions(b"k").orderBy("seq").collect()] == [b"a", b"b"]
    assert n.get(b"x") == b"two" and n.get(b"k") == b"b"
    assert {bytes(r.key): r.n_versions for r in n.conflicts().collect()} == {b"k": 2, b"x": 2}


def test_schema_index_quota(store):
    n = store.create_namespace("n")
    n.set_schema('{"type":"object","required":["city"]}')
    with pytest.raises(st.SchemaViolation):
        n.put(b"bad", b"{}")
    with pytest.raises(st.SchemaViolation):
        n.put(b"bad", b"nope")
    n.index_create("city", "", "city")
    for k, c in (("ada", "london"), ("bob", "paris"), ("cyn", "london")):
        n.put(k.encode(), f'{{"city":"{c}"}}'.encode())
    keys = lambda c: [bytes(r.key).decode() for r in n.by_index("city", c).collect()]
    assert n.index_fields() == ["city"] and keys("london") == ["ada", "cyn"]
    n.put(b"bob", b'{"city":"london"}')
    n.delete(b"ada")
    assert keys("london") == ["bob", "cyn"]
    n.index_drop()
    assert keys("london") == []
    with pytest.raises(st.QuotaExceeded):
        n.put(b"q", b'{"city":"x"}', quota=n.used() + 3)


def test_lww_and_expiry(spark):
    rows = [(1, "k1", 100, A, "fresh", 0), (1, "k1", 200, A, "newer", 0), (3, "k2", 300, A, "gone", 1), (3, "k3", 400, A, "kept", NEVER),
            (1, "k4", 500, A, "x", 0), (2, "k4", 501, A, "", 0)]
    o = ops.explode_batches(log(spark, rows))
    assert values(fold.state(o, 1000)) == {"k1": "newer", "k3": "kept"}
    assert values(fold.state(o, None)) == {"k1": "newer", "k2": "gone", "k3": "kept"}
    from tidefold.operators import compact

    kept = sorted((r.seq, r.tag, bytes(r.key)) for r in compact.compacted(o, 1000).collect())
    assert kept == [(1, 1, b"k1"), (2, 3, b"k3"), (3, 2, b"k4")]


def test_register_expiry_shows_older_version(spark):
    o = ops.explode_batches(log(spark, [(1, "k", 1, A, "old", 0), (3, "k", 2, A, "new", 50)]))
    assert values(fold.state(o, 100, "register", "local")) == {"k": "old"}
    assert values(fold.state(o, 100)) == {}


def test_two_stores_converge(spark, tmp_path):
    a, b = (st.Store(spark, f"file://{tmp_path}/{n}", r) for n, r in (("a", A), ("b", B)))
    na, nb = a.create_namespace("n"), b.create_namespace("n")
    na.put(b"k", b"v1")
    na.put(b"dead", b"x")
    na.delete(b"dead")
    nb.put(b"k", b"v2")
    nb.put(b"dead", b"y")
    assert a.pull(b) == 2 and b.pull(a) == 3
    assert a.pull(b) == 0 and b.pull(a) == 0
    assert values(na.state()) == values(nb.state()) == {"k": "v2"}
    assert na.log().select("seq").distinct().count() == na.head() == 5


def test_feed_resumes_from_its_checkpoint(store, tmp_path):
    n = store.create_namespace("n")
    got = []
    deliver = lambda df, _: got.extend(r.seq for r in df.orderBy("seq").collect())
    n.put(b"a", b"1")
    n.put(b"b", b"2")
    n.subscribe(deliver, f"file://{tmp_path}/cp", since=1, once=True).awaitTermination(60)
    assert got == [2]
    n.put(b"c", b"3")
    n.subscribe(deliver, f"file://{tmp_path}/cp", since=1, once=True).awaitTermination(60)
    assert got == [2, 3]


def test_backup_refuses_an_existing_target(store, tmp_path):
    n = store.create_namespace("n")
    n.put(b"a", b"1")
    store.backup(f"file://{tmp_path}/copy")
    assert st.Store(store.spark, f"file://{tmp_path}/copy", mode="local").use("n").get(b"a") == b"1"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.backup(f"file://{tmp_path}/copy")


def test_clock_order():
    assert st.Store.before("1", "2") and not st.Store.before(2, 1)
    with pytest.raises(ValueError):
        st.Store.before(-1, 2)
    c = st.Clock()
    assert [c.tick() < c.tick() for _ in range(5)] == [True] * 5


@pytest.mark.parametrize(("policy", "mode"), [("lww", "merge"), ("lww", "local"), ("register", "merge"), ("register", "local")])
def test_checkpoint_and_tail_equal_the_whole_log(spark, policy, mode):
    from tidefold.operators import compact

    rows = [(1, "k", 5, A, "v1", 0), (2, "k", 6, A, "", 0), (1, "m", 9, B, "m1", 0), (1, "m", 7, A, "m2", 0), (1, "x", 1, A, "x1", 0), (3, "t", 2, A, "old", 50),
            (2, "y", 3, A, "", 0), (1, "y", 4, A, "y1", 0), (1, "z", 1, A, "z1", 0),
            (1, "k", 8, A, "v2", 0), (1, "m", 8, A, "m3", 0), (2, "x", 9, A, "", 0), (1, "y", 9, B, "y2", 0), (1, "t", 1, B, "low", 0), (2, "z", 2, A, "", 0), (1, "z", 3, A, "z2", 0)]
    whole = ops.explode_batches(log(spark, rows))
    for at in (0, 2, 9, 12, len(rows)):
        both = compact.with_tail(compact.retained(whole.where(f"seq <= {at}"), policy, mode), whole.where(f"seq > {at}"))
        for now in (10, 1000, None):
            assert values(fold.state(both, now, policy, mode)) == values(fold.state(whole, now, policy, mode))


def test_store_checkpoint(store, tmp_path):
    n = store.create_namespace("n")
    n.set_schema("{}")
    n.put(b"k", b"1")
    n.delete(b"k")
    n.put(b"a", b"1")
    n.checkpoint(f"file://{tmp_path}/cp")
    since = n.head()
    n.put_batch([("put", b"k", b"2", 0), ("del", b"a", b"", 0)])
    assert values(n.state_from(f"file://{tmp_path}/cp", since)) == values(n.state()) == {"k": "2"}
    assert store.spark.read.parquet(f"{tmp_path}/cp/definitions").first().schema_json == "{}"


def test_get_and_scan_reach_the_scan(store):
    n = store.create_namespace("n")
    n.put(b"a/1", b"x")
    n.put(b"b/1", b"y", ttl=-1)
    n.put_batch([("put", b"a/2", b"z", 0), ("put", b"c", b"w", 0)])
    for df in (n.state(prefix=b"a/"), n.of_keys([b"a/2"]), n.versions(b"a/2")):
        scans = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "PushedFilters" in x]
        assert scans and all("EqualTo(tag,6)" in x and "key" in x.split("PushedFilters")[1] for x in scans)
    assert values(n.state(prefix=b"a/")) == {"a/1": "x", "a/2": "z"} and n.get(b"a/2") == b"z"
    assert n.get(b"b/1") is None and n.get(b"b/1", respect_ttl=False) == b"y"
    assert [bytes(r.key) for r in n.scan(b"b", respect_ttl=False).collect()] == [b"b/1"]
    assert n.scan(b"a/", within="a").count() == 2
    with pytest.raises(st.Forbidden):
        n.scan(b"ab", within="a")


def test_batch_requests(store):
    n = store.create_namespace("n")
    n.set_schema('{"type":"object"}')
    text = lambda s: base64.b64encode(s.encode()).decode().rstrip("=")
    got = n.batch([
        {"op": "put", "key": "a", "value_b64": text('{"x":1}')}, {"op": "get", "key": "a"}, {"op": "put", "key": "b", "value_b64": text("nope")},
        {"op": "get", "key": "none"}, {"op": "put", "key": "c", "value_b64": text("{" + " " * 90 + "}")}, {"op": "del", "key": "a2"}, {"op": "jump", "key": "a"},
        {"op": "get"}, {"op": "put", "key": "d", "value_b64": text("{}"), "ttl": 60}, {"op": "put", "key": "a", "value_b64": text('{"x":2}')},
    ], quota=60)
    assert got[0] == got[5] == got[8] == got[9] == {"ok": True, "seq": 2}
    assert got[1] == {"ok": True, "value_b64": text('{"x":2}')} and got[3] == {"ok": True, "value_b64": None}
    assert [got[i]["error"].split(":")[0] for i in (2, 4, 6, 7)] == ["schema_violation", "quota exceeded for n (limit 60 bytes)", "unknown_op", "missing_key"]
    assert set(values(n.state())) == {"a", "d"} and n.log().where("tag = 6").count() == 1
    assert n.batch([{"op": "get", "key": "a"}])[0]["ok"] and n.head() == 2
    for bad, error in (([], st.EmptyBatch), ([{"op": "get", "key": "a"}] * 1001, st.BatchTooLarge), ([{"op": "put", "key": "k", "value_b64": "A" * (9 << 20)}], st.BatchTooLarge)):
        with pytest.raises(error):
            n.batch(bad)
    with pytest.raises(st.SchemaViolation):
        n.put_batch([("put", b"k", b"[]", 0)])
    with pytest.raises(st.QuotaExceeded):
        n.put_batch([("put", b"k", b"{}", 0)] * 30, quota=60)
    with pytest.raises(st.BatchTooLarge):
        n.put_batch([("put", b"k", b"{}" + b" " * (7 << 20), 0)])


def test_pulled_records_are_checked(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/s", A)
    s.create_namespace("n")
    prev, rows = b"\0" * 32, []
    for i in range(1, 5):
        own = hashlib.sha256(prev + bytes([i])).digest()
        rows.append(("n", i, 1, b"k%d" % i, i, B, B, b"v", 0, None, prev, own))
        prev = own
    records = spark.createDataFrame(rows, f"{st.LOG}, prev binary, hash binary")
    with pytest.raises(st.UnsoundRecords):
        s.pull_records(records.where("seq <> 2"))
    with pytest.raises(st.UnsoundRecords):
        s.pull_records(records.withColumn("prev", F.when(F.col("seq") == 3, F.lit(b"x" * 32)).otherwise(F.col("prev"))))
    assert s.use("n").head() == 0
    assert s.pull_records(records, allow=["other"]) == 0 and s.pull_records(records) == 4 and s.pull_records(records) == 0
    assert len(values(s.use("n").state())) == 4


def test_restore(store, tmp_path):
    store.create_namespace("n").put(b"a", b"1")
    store.backup(f"file://{tmp_path}/copy")
    back = st.Store(store.spark, f"file://{tmp_path}/back", mode="local")
    back.restore(f"file://{tmp_path}/copy")
    assert back.use("n").get(b"a") == b"1"
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        back.restore(f"file://{tmp_path}/copy")
