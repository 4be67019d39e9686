import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidefold import shared
from tidefold.functions import codec, hlc
from tidefold.operators import authz, batch, feed, fold, fsview, merge, ops, secidx
from tidefold.plans import jsonschema
from tidefold.schema import LOG
from tidefold.sources import binlog, config
from tidefold.streaming import feed as stream

A, B = b"\x01" * 32, b"\x03" * 32


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_clock_columns(spark):
    packed = hlc.pack(F.lit(1000), F.lit(7))
    assert one(spark, hlc.millis(packed), hlc.counter(packed)) == (1000, 7)
    cases = [(5 << 16 | 3, 4 << 16, 5 << 16 | 4), (5 << 16, 7 << 16 | 2, 7 << 16 | 2), (5 << 16 | 65535, 1, 6 << 16)]
    for own, other, want in cases:
        assert one(spark, hlc.observed(F.lit(own), F.lit(other))) == (want,)
    text = [hlc.before(F.lit(a), F.lit(b)) for a, b in (("1", "2"), ("18446744073709551615", "2"), ("x", "2"), ("-1", "2"))]
    assert one(spark, *text) == (True, False, None, None)


@pytest.mark.parametrize("raw", [b"", b"f", b"fo", b"foo", bytes(range(256))])
def test_base64_round_trip(spark, raw):
    v = F.lit(raw)
    b64, url = codec.base64_text(v), codec.base64url_text(v)
    got = one(spark, b64, codec.base64_bytes(b64), codec.base64url_bytes(url), codec.hex_text(v))
    assert "=" not in got[0] and bytes(got[1]) == bytes(got[2]) == raw and got[3] == raw.hex()


def test_base64_rejects(spark):
    bad = ["a", "ab=c", "ab===", "a b", "ab\n"]
    assert one(spark, *[codec.base64_bytes(F.lit(x)) for x in bad]) == (None,) * len(bad)
    assert bytes(one(spark, codec.base64_bytes(F.lit("Zg==")))[0]) == b"f"


def test_lossy_text_and_folder(spark):
    assert one(spark, codec.text(F.lit(b"a\xffb")), codec.namespace_folder(F.lit("ab"))) == ("a�b", "4_6162")


def test_prefix_bounds():
    assert fold.next_prefix(b"ab") == b"ac" and fold.next_prefix(b"a\xff") == b"b" and fold.next_prefix(b"\xff\xff") is None


RECORD = st.tuples(st.sampled_from([1, 1, 1, 2, 3]), st.sampled_from("abc"), st.integers(1, 30), st.sampled_from([A, B]))


@given(st.lists(RECORD, max_size=12), st.integers(0, 12))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_merge_does_not_depend_on_order_and_takes_records_once(spark, records, at):
    unique = list({(t, k, h, r): None for t, k, h, r in records})

    def log(rows):
        data = [("n", i, t, k.encode(), h, r, r, f"{t}{k}{h}{r[0]}".encode(), 0, None) for i, (t, k, h, r) in enumerate(rows, 1)]
        return spark.createDataFrame(data, LOG)

    def state(df):
        return sorted((bytes(r.key), r.hlc, bytes(r.replica)) for r in fold.state(ops.explode_batches(df), None).collect())

    left, right = log(unique[:at]), log(unique[at // 2 :])
    whole = {(t, k) for t, k, _, _ in unique}
    one_way, other = merge.apply_synced(left, right), merge.apply_synced(right, left)
    assert one_way.count() == len(unique) == merge.apply_synced(one_way, right).count()
    if len(whole) == len({(k, h, r) for _, k, h, r in unique}):  # no ties of clock and replica
        assert state(one_way) == state(other) == state(log(unique))


def test_heads_ranges_and_plan(spark):
    log = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "ns string, seq long")
    names = spark.createDataFrame([("a", "lww"), ("c", "lww")], "ns string, policy string")
    assert {tuple(r) for r in feed.heads(log, names).collect()} == {("a", 2), ("c", 0)}
    assert [r.seq for r in feed.log_range(log, 2, 1).collect()] == [2] and feed.log_range(log, 0).count() == 0
    peer = spark.createDataFrame([("a", 100_000), ("b", 1)], "ns string, head long")
    assert [tuple(r) for r in merge.sync_plan(feed.heads(log), peer).collect()] == [("a", 3, 64_002)]


def test_chunks_and_mismatch(spark):
    log = spark.createDataFrame([("n", i, b"k", b"x" * n) for i, n in ((1, 900), (2, 50), (3, 100))], "ns string, seq long, key binary, value binary")
    assert [r.seq for r in merge.pull_chunk(log, 1, most_bytes=960).collect()] == [1, 2]
    assert [r.seq for r in merge.pull_chunk(log, 1, most_bytes=10).collect()] == [1]
    a = spark.createDataFrame([("x", "lww"), ("y", "lww")], "ns string, policy string")
    b = spark.createDataFrame([("x", "register"), ("y", "lww")], "ns string, policy string")
    assert [r.ns for r in merge.policy_mismatch(a, b).collect()] == ["x"]


def test_skew_is_not_negative(spark):
    clocks = spark.createDataFrame([("p", -5), ("q", 9)], "peer string, skew long")
    assert [feed.clock_skew(clocks, p).first()[0] for p in "pq"] == [0, 9] and feed.clock_skew(clocks, "z").isEmpty()


def test_quota_and_limits(spark):
    rows = spark.createDataFrame([("n", i, c, 0) for i, c in enumerate((100, 100, 1, 0))], "ns string, idx long, cost long, used long")
    assert [r.ok for r in batch.quota(rows, 200).orderBy("idx").collect()] == [True, True, False, True]
    req = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 0, 3), ("a", 1000, 4), ("b", 0, 5)], "key string, ms long, seq long")
    assert [r.allowed for r in batch.rate_limited(req, 2, 1000).orderBy("seq").collect()] == [True, True, False, True, True]
    assert batch.rate_limited(req, 0, 1000).where("allowed").count() == 5


def test_batch_results_see_the_whole_batch(spark):
    rows = [("n", 0, "put", "b1", "aGk", None), ("n", 1, "get", "b1", None, None), ("n", 2, "put", "x", "%%", None), ("n", 3, "put", "x", None, None),
            ("n", 4, "put", None, "aGk", None), ("n", 5, "jump", "x", None, None), ("n", 6, "put", "y", "aGk", "$: bad"), ("n", 7, "get", "zz", None, None)]
    req = spark.createDataFrame(rows, "ns string, idx long, op string, key string, value_b64 string, schema_error string")
    state = spark.createDataFrame([("n", "b1", b"hi")], "ns string, key string, value binary")
    got = {r.idx: r for r in batch.results(batch.validated(req), state, 9).collect()}
    assert (got[0].seq, got[1].value_b64, got[7].value_b64) == (9, "aGk", None)
    assert [got[i].error for i in range(2, 7)] == ["bad_value_b64", "missing_value_b64", "missing_key", "unknown_op", "schema_violation: $: bad"]
    assert batch.size_estimate(req.where("idx < 2")).first().bytes == 93 + 2 + 3


def test_index_of_odd_documents(spark):
    docs = ['{"f":"x"}', '{"f":1.5}', '{"f":true}', '{"f":null}', '{"f":{}}', '{"f":[1]}', '"bare"', "7", "nope", '{"f":"a"} x', '{"g":1}']
    state = spark.createDataFrame([("n", str(i), d) for i, d in enumerate(docs)], "ns string, key string, value string")
    strict = {r.key: r.fv for r in secidx.index_rows(state, ["f"], strict=True).collect()}
    assert strict == {"0": "x", "1": "1.5", "2": "true", "6": "bare", "7": "7"}
    quick = {r.key: r.fv for r in secidx.index_rows(state, ["f"]).collect()}
    assert quick == {"0": "x", "1": "1.5", "2": "true", "9": "a"}


def test_definitions_take_the_newest_clock(spark):
    log = spark.createDataFrame([("n", 1, 4, 200, A, b"{}"), ("n", 2, 4, 100, A, b"true"), ("n", 3, 5, 1, A, b'["a"]'), ("m", 1, 5, 1, A, b"[]")],
                                "ns string, seq long, tag int, hlc long, replica binary, value binary")
    got = {r.ns: (r.schema_json, list(r.index_fields)) for r in secidx.definitions(log).collect()}
    assert got == {"n": ("{}", ["a"]), "m": (None, [])}


SCHEMAS = [
    ({"type": "object", "properties": {"name": {"type": "string", "maxLength": 4}, "age": {"type": "integer"}}, "required": ["name"], "additionalProperties": False},
     [{"name": "ada"}, {"name": "", "age": 7}], [{"age": 7}, {"name": "adaline"}, {"name": "bo", "age": 7.5}, {"name": "bo", "town": "x"}, "name"]),
    ({"additionalProperties": {"type": "boolean"}, "minProperties": 1, "maxProperties": 2}, [{"a": True}, 9], [{}, {"a": 1}, {"a": True, "b": True, "c": True}]),
    ({"type": "array", "items": {"type": ["string", "null"]}, "maxItems": 3, "uniqueItems": True}, [[], ["a", None]], [["a", "a"], [1], ["a", "b", "c", "d"]]),
    ({"type": "number", "exclusiveMinimum": 2, "maximum": 9, "multipleOf": 0.5}, [2.5, 9], [2, 9.5, 3.3, "3"]),
    ({"enum": [None, [1, 2], {"a": 1}]}, [None, [1, 2], {"a": 1}], [[1, 2.0], [2, 1], {"a": True}, 0]),
    ({"const": 3}, [3], [3.0, "3", True]),
    ({"anyOf": [{"type": "null"}, {"type": "array", "minItems": 2}]}, [None, [1, 2]], [[1], "x"]),
    ({"allOf": [{"type": "integer"}, {"minimum": 3}], "not": {"const": 5}}, [4, 6], [2, 5, 4.5]),
    ({"maxLength": 2}, ["é"], ["ééé", "abc"]),
    ({"oneOf": [{"minimum": 1}, {"maximum": 5}]}, [0, 9], [3]),
    (False, [], [1]),
]


@pytest.mark.parametrize(("schema", "good", "bad"), SCHEMAS)
def test_json_schema(schema, good, bad):
    check = jsonschema.compile_schema(schema)
    assert all(check(x, "$") is None for x in good) and all(check(x, "$") for x in bad)


@pytest.mark.parametrize("schema", [{"pattern": "a"}, {"$schema": "x"}, {"$id": "x"}, {"$ref": "#"}, {"type": "text"}, {"items": {"format": "date"}}, 3])
def test_unsupported_schemas(schema):
    with pytest.raises(jsonschema.UnsupportedSchema):
        jsonschema.compile_schema(schema)


def test_schema_errors_as_a_column(spark):
    df = spark.createDataFrame([('{"k":1}',), ('{"k":"x"}',), ("{",), (None,)], "v string")
    got = [r[0] for r in df.select(jsonschema.error(F.col("v"), '{"properties":{"k":{"type":"integer"}}}')).collect()]
    assert got[0] is None and got[1].startswith("$.k") and all(got[2:])


def test_scopes(spark):
    held = [("a", "a", True), ("a", "a/b", True), ("a", "ab", False), (None, "x", True), ("a", None, False), (None, None, True)]
    df = spark.createDataFrame(held, "h string, w string, want boolean")
    assert df.where(authz.covers_prefix(F.col("h"), F.col("w")) != F.col("want")).isEmpty()
    assert one(spark, authz.request_prefix(F.lit("/a/b/c")), authz.request_prefix(F.lit("c"))) == ("a/b", None)
    assert tuple(one(spark, authz.scope_parts(F.lit("kv://host/l2/data/a/b")))[0]) == ("host", "l2", "data", "a/b")
    assert authz.perm_names(authz.perm_bits(["read", "admin"])) == ["read", "admin"]


def test_authorization_tiers_and_revocation(spark):
    u = "u/" + "a" * 8
    caps = spark.createDataFrame(
        [("root", "p", "h", "l2", "data", "a", 1, None, 1), ("root", "p", "h", "l1", "*", None, 4, None, 2), ("root", "aaaaaaaa", "h", "l3", u, None, 3, 50, 3),
         ("evil", "p", "h", "l2", "data", None, 7, None, 4), ("root", "q", "h", "l2", "data", None, 7, None, 5)],
        "issuer string, subject string, host string, tier string, ns string, prefix string, perms int, expiry long, nonce long")
    ring = spark.createDataFrame([("root",)], "issuer string")
    gone = spark.createDataFrame([(5, None, None, None, None, None)], "nonce long, host string, tier string, ns string, prefix string, subject string")
    req = spark.createDataFrame(
        [(1, "p", "h", "l2", "data", "a/b", 1), (2, "p", "h", "l2", "data", "b", 1), (3, "p", "h", "l1", "x", None, 1), (4, "aaaaaaaa", "h", "l3", u, None, 2),
         (5, "q", "h", "l2", "data", None, 1), (6, "p", "h", "l2", "data", "a", 2)],
        "id int, principal string, host string, tier string, ns string, prefix string, perms int")
    allowed = lambda now: {r.id for r in authz.authorized(req, authz.valid_caps(caps, ring, gone, now)).collect()}
    assert allowed(10) == {1, 3, 4} and allowed(50) == {1, 3}
    assert {r.issuer for r in authz.rotate(ring, "new", False).collect()} == {"root", "new"}
    # the pin counts over all peers, whatever name was dialled
    hello = spark.createDataFrame([("x", "1"), ("y", "9"), ("z", "1"), ("w", "2"), (None, "3"), ("v", "9")], "name string, offered_pin string")
    peers = spark.createDataFrame([("x", "1"), ("y", ""), ("w", "3")], "name string, pin string")
    got = {r.name: r.access for r in authz.peer_access(hello, peers).collect()}
    assert got == {"x": "Full", "y": "HelloOnly", "z": "Full", "w": "Deny", None: "Full", "v": "Deny"}
    assert authz.scope_url("h", "l2", "data", "a/b") == "kv://h/l2/data/a/b" and authz.scope_url("h", "l1", "x") == "kv://h/l1/x"
    assert tuple(one(spark, authz.scope_parts(F.lit(authz.scope_url("h", "l3", u + "b" * 56, "p"))))[0]) == ("h", "l3", u + "b" * 56, "p")
    assert [authz.scan_allowed(p, "a") for p in ("a", "a/", "a/b", "ab", "")] == [True, True, True, False, False] and authz.scan_allowed("", None)


def test_file_view(spark):
    rows = [("d/a", b"12345"), ("d/b/c", b"x"), ("d/b/e", b"y"), ("d//x", b""), ("d/./q", b""), ("other", b"z"), ("f", b"1"), ("f/g", b"2")]
    state = spark.createDataFrame([(p, v, 5000 << 16) for p, v in rows], "path string, value binary, hlc long")
    assert {(r.name, r.is_dir, r.n_files) for r in fsview.readdir(state, "d").collect()} == {("a", False, 1), ("b", True, 2)}
    assert {r.name: r.is_dir for r in fsview.readdir(state).collect()} == {"d": True, "other": False, "f": True}
    assert tuple(fsview.getattr_(state, "d/a").first()) == (5, 5.0)
    assert fsview.dir_exists(state, "d/b") and not fsview.dir_exists(state, "nope")
    v = F.lit(b"12345")
    assert [bytes(x) for x in one(spark, fsview.read_range(v, 1, 3), fsview.padded(v, 7), fsview.padded(v, 2))] == [b"234", b"12345\0\0", b"12"]
    tree = spark.createDataFrame([("n", b"d/a", b"1", 0), ("n", b"d/b", b"2", 99)], "ns string, key binary, value binary, expires_at long")
    moved = fsview.renamed(tree, "d", "e", 1 << 20, A).collect()
    assert sorted((bytes(r.key), r.tag, r.expires_at) for r in moved) == [(b"d/a", 2, 0), (b"d/b", 2, 0), (b"e/a", 1, 0), (b"e/b", 3, 99)]
    new = spark.createDataFrame([("n", b"d/a"), ("n", b"d/b")], "ns string, key binary")
    assert {bytes(r.key): r.expires_at for r in fsview.rewritten(tree, new, 5).collect()} == {b"d/a": 0, b"d/b": 99}


def records(spark):
    op = lambda t, k, e=0: (t, k, 7, A, B, b"v", e)
    rows = [("n", 1, 1, b"k", 100, A, B, b"hello", 0, None), ("n", 2, 3, b"t", 101, A, B, b"x", 77, None), ("n", 3, 2, b"k", 102, A, B, b"", 0, None),
            ("n", 4, 6, None, None, None, None, None, None, [op(1, b"a"), op(3, b"b", 9), (2, b"c", 7, A, B, b"", 0)]), ("m", 1, 1, b"z", 1, B, B, b"", 0, None)]
    return spark.createDataFrame(rows, LOG)


def test_binary_log_round_trip(spark, tmp_path):
    log = records(spark)
    for r in binlog.encode_log(log).collect():
        folder = tmp_path / "log" / spark.range(1).select(codec.namespace_folder(F.lit(r.ns))).first()[0]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"log.{r.segment}.seg").write_bytes(r.content)
    back = binlog.read_log(spark, f"file://{tmp_path}/log")
    plain = lambda df: sorted(str([bytes(x) if isinstance(x, bytearray) else x for x in r]) for r in ops.explode_batches(df).collect())
    assert plain(back) == plain(log)
    assert merge.chain_breaks(back).isEmpty()


def segment():
    prev, raw = binlog.ZERO, []
    for i in range(3):
        raw.append(binlog.frame(1, binlog.encode_payload(1, b"k", i, A, B, b"val", 0), prev))
        prev = binlog.chain_hash(prev, raw[-1])
    return raw


def test_torn_tail_and_damage():
    a, b, c = segment()
    assert len(list(binlog.decode_segments([a, b + c]))) == 3
    assert len(list(binlog.decode_segments([a + b + c[:-1]]))) == 2
    assert len(list(binlog.decode_segments([a + b + c[:-1] + b"\0"]))) == 2
    flipped = bytearray(b)
    flipped[-1] ^= 1
    for bad in ([a + bytes(flipped) + c], [a, c], [a[:-1], b + c], [b"\x09" + a[1:]]):
        with pytest.raises(binlog.Corrupt):
            list(binlog.decode_segments(bad))
    with pytest.raises(binlog.Corrupt):
        list(binlog.decode_segments([a + b + c[:-1]], torn_tail=False))


def test_segments_are_read_apart_and_written_one_by_one(spark, tmp_path):
    rows = [(ns, i, 1, b"k%d" % i, i, A, B, b"v" * 900, 0, None) for ns in "nm" for i in range(1, 201)]
    log = spark.createDataFrame(rows, LOG).repartition(3)
    made = binlog.encode_log(log, segment_bytes=10_000)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()
    files = {}
    for r in made.collect():
        folder = tmp_path / "log" / f"1_{r.ns.encode().hex()}"
        folder.mkdir(parents=True, exist_ok=True)
        files[r.ns, r.segment] = folder / f"log.{r.segment}.seg"
        files[r.ns, r.segment].write_bytes(r.content)
    assert len(files) > 20 and max(f.stat().st_size for f in files.values()) < 12_000
    back = binlog.read_log(spark, f"file://{tmp_path}/log")
    assert "FlatMapGroupsInPandas" not in back._jdf.queryExecution().toString()
    assert sorted((r.ns, r.seq, bytes(r.key), r.hlc) for r in back.collect()) == sorted((r[0], r[1], r[3], r[4]) for r in rows)
    assert merge.chain_breaks(back).isEmpty()
    end = files["n", max(k for n, k in files if n == "n")]
    whole = end.read_bytes()
    end.write_bytes(whole[:-1] + b"\0")
    assert binlog.read_log(spark, f"file://{tmp_path}/log").where("ns = 'n'").count() == 199
    end.write_bytes(whole)
    middle = files["n", 3]
    for bad in (middle.read_bytes()[:-1], files["m", 3].read_bytes()[:0], files["n", 2].read_bytes()):
        kept = middle.read_bytes()
        middle.write_bytes(bad)
        with pytest.raises(Exception, match="Corrupt"):
            binlog.read_log(spark, f"file://{tmp_path}/log").collect()
        middle.write_bytes(kept)
    middle.unlink()
    with pytest.raises(Exception, match="a segment is missing"):
        binlog.read_log(spark, f"file://{tmp_path}/log").collect()


def test_batches_are_verified_as_a_whole(spark):
    prev, rows = b"p" * 32, []
    for i in range(3):
        raw = bytes([i])
        own = hashlib.sha256(prev + raw).digest()
        rows.append(("n", i, prev, own, raw))
        prev = own
    schema = "ns string, seq long, prev binary, hash binary, bytes binary"
    assert merge.verified_batches(spark.createDataFrame(rows, schema)).first().ok
    rows[1] = (*rows[1][:4], b"other")
    assert not merge.verified_batches(spark.createDataFrame(rows, schema)).first().ok


def test_crc_vector(spark):
    assert one(spark, F.crc32(F.lit(b"123456789"))) == (0xCBF43926,)


def test_config(spark):
    text = '[node]\nname = "a"\n[[peers]]\nname = "b"\npin = "1"\nnamespaces = ["x"]\n[[peers]]\nname = "c"\n'
    assert [tuple(r) for r in config.peers(spark, config.load(text)).orderBy("name").collect()] == [("b", "", "1", ["x"]), ("c", "", "", None)]
    with pytest.raises(config.ConfigError):
        config.load('[[peers]]\nname="b"\npin="1"\n[[peers]]\nname="c"\npin="1"\n')


def test_streamed_state_equals_the_batch_fold(spark, tmp_path):
    rows = [(1, "k", 5, A), (1, "k", 3, B), (2, "d", 1, A), (1, "d", 9, B), (1, "x", 2, A)]
    data = [("n", i, 0, t, k, h, r, r, str(i), 0) for i, (t, k, h, r) in enumerate(rows, 1)]
    schema = "ns string, seq long, pos int, tag int, key string, hlc long, replica binary, author binary, value string, expires_at long"
    for part in (data[:2], data[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ops")
    path = lambda n: f"{tmp_path}/state-{n}"
    rows_in = stream.read(spark, f"{tmp_path}/ops", schema=schema, files_per_batch=1)
    q = stream.subscribe(rows_in, stream.upsert_state(path, spark), f"{tmp_path}/cp", once=True)
    q.awaitTermination(120)
    assert q.exception() is None
    got = stream.state_of(spark.read.parquet(path(1)), 0).select("key", "value")
    want = fold.state(spark.createDataFrame(data, schema), 0).select("key", "value")
    assert sorted(got.collect()) == sorted(want.collect()) == [("k", "1"), ("x", "5")]
    assert [stream.backoff_ms(n) for n in (0, 2, 5, 9)] == [1000, 4000, 30000, 30000]


def test_small_helpers(spark):
    rows = [("n", "k", 1, 1, 0, A, 10), ("n", "k", 2, 2, 0, B, 0), ("m", "k", 1, 1, 0, A, 0)]
    schema = "ns string, key string, seq long, hlc long, pos int, replica binary, expires_at long"
    data = spark.createDataFrame(rows, schema).withColumns({"tag": F.lit(1), "author": F.col("replica"), "value": F.lit("v")})
    both = fold.state_by_policy(data, spark.createDataFrame([("n", "register"), ("m", "lww")], "ns string, policy string"), 5, "local")
    assert sorted((r.ns, r.seq) for r in both.collect()) == [("m", 1), ("n", 2)]
    kept = fold.conflict_versions(fold.register_versions(data)).collect()
    assert [(r.ns, [v.seq for v in r.versions]) for r in kept] == [("n", [1, 2])]
    assert one(spark, secidx.clean_fields(F.array(F.lit("a"), F.lit(""), F.lit("b"), F.lit("a")))) == (["a", "b"],)


def test_long_batches_are_refused_and_quota_matches_a_loop(spark):
    long = spark.range(1001).selectExpr("'x' as ns", "id as idx", "1 as cost", "0 as used")
    costs = [(i * 37) % 90 for i in range(200)]
    rows = spark.createDataFrame([("n", i, c, 5) for i, c in enumerate(costs)], "ns string, idx long, cost long, used long")
    got = {(r.ns, r.idx): r.ok for r in batch.quota(rows.unionByName(long), 900).collect()}
    used, want = 5, {}
    for i, c in enumerate(costs):
        want["n", i] = used + c <= 900
        used += c * want["n", i]
    assert {k: v for k, v in got.items() if k[0] == "n"} == want
    assert len(got) == 1201 and not any(v for k, v in got.items() if k[0] == "x")


def test_numbering_spreads_one_group_with_long_shared_prefixes(spark):
    rows = spark.range(5000).selectExpr("'n' as ns", "concat('https://example.com/', lpad(id * 7 % 5000, 5, '0')) as key", "id as seq", "0 as pos").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    got = shared.cut(shared.numbered(rows, ["ns"], ["key", "seq", "pos"]).withColumn("part", F.spark_partition_id()), "numbered")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["count"] for r in got.groupBy("part").count().collect()]
    assert [r.place for r in got.orderBy("key").collect()] == list(range(1, 5001)) and len(parts) > 1 and max(parts) < 4000
    assert shared.numbered(rows.limit(0), ["ns"], ["key"]).count() == 0


def test_shared_folder_is_refused_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.root(Session)
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.root(Session)


def test_feed_fields_policies_and_head_hash(spark, tmp_path):
    good = binlog.frame(1, binlog.encode_payload(1, b"k", 5, A, B, b"val", 0), binlog.ZERO)
    first = binlog.chain_hash(binlog.ZERO, good)
    odd = binlog.frame(1, b"\x09\x00", first)
    second = binlog.chain_hash(first, odd)
    pair = binlog.encode_payload(6, None, 0, None, None, None, 0, [dict(tag=1, key=b"a", hlc=6, replica=A, author=A, value=b"", expires_at=0)] * 2)
    last = binlog.frame(6, pair, second)
    folder = tmp_path / "log" / "2_6e"
    folder.mkdir(parents=True)
    (folder / "log.0.seg").write_bytes(good + odd + last)
    (folder / "policy.bin").write_bytes(b"\x01")
    url = f"file://{tmp_path}/log"
    with pytest.raises(Exception, match="Corrupt"):
        binlog.read_log(spark, url).collect()
    rows = binlog.read_log(spark, url, keep_unparsed=True)
    got = [(r.seq, r.key_b64, r.value_b64, r.batch, r.ops, r.parse_error) for r in feed.change_fields(rows).orderBy("seq").collect()]
    assert got == [(1, "aw", "dmFs", False, 0, False), (2, None, None, None, None, True), (3, "", "", True, 2, False)]
    assert [tuple(r) for r in feed.heads(rows).collect()] == [("n", 3, binlog.chain_hash(second, last).hex())]
    assert [tuple(r) for r in binlog.read_policies(spark, url).collect()] == [("n", "register")]
    (folder / "policy.bin").write_bytes(b"\x07")
    with pytest.raises(Exception, match="bad policy"):
        binlog.read_policies(spark, url).collect()


def test_file_writes(spark):
    v, add = F.lit(b"12345"), F.lit(b"ab")
    got = one(spark, fsview.written(v, add), fsview.written(v, add, 1), fsview.written(v, add, 4), fsview.written(v, add, 7), fsview.written(F.lit(None), add, 0))
    assert [bytes(x) for x in got] == [b"12345ab", b"1ab45", b"1234ab", b"12345\0\0ab", b"ab"]
    made = [fsview.made_dir(spark, "n", "d/e/", 1, A), fsview.created(spark, "n", "/d/f", 2, A), fsview.unlinked(spark, "n", "d/g", 3, A)]
    assert [(r.tag, bytes(r.key), bytes(r.value)) for df in made for r in df.collect()] == [(1, b"d/e/", b""), (1, b"d/f", b""), (2, b"d/g", b"")]
    tree = made[0].union(made[1]).select(F.col("key").cast("string").alias("path"), "value")
    assert {(r.name, r.is_dir) for r in fsview.readdir(tree, "d").collect()} == {("e", True), ("f", False)}
    assert fsview.readdir(tree, "d/e").isEmpty() and fsview.dir_exists(tree, "d/e")


def test_a_gap_or_a_wrong_hash_breaks_a_batch(spark):
    rows, prev = [], b"p" * 32
    for i in range(6):
        own = hashlib.sha256(prev + bytes([i])).digest()
        rows.append(("n", i, prev, own, bytes([i])))
        prev = own
    schema = "ns string, seq long, prev binary, hash binary, bytes binary"
    df = spark.createDataFrame(rows, schema)
    assert merge.chain_breaks(df).isEmpty() and merge.gaps(df).isEmpty() and merge.verified_batches(df).first().ok
    assert not merge.verified_batches(df.where("seq <> 3")).first().ok
    swapped = df.withColumn("prev", F.when(F.col("seq") == 4, F.lit(b"x" * 32)).otherwise(F.col("prev")))
    assert [r.seq for r in merge.chain_breaks(swapped).collect()] == [4]
