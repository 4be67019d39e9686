"""More registered queries: whole stores, files, streams, and operators that `catalogue` leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import shared
from .catalogue import DAILY, LIVE, LOCAL, LOG, NOW, VERSION, VERSIONS, WINNER, _schema_valid, query
from .functions import codec, hlc
from .operators import authz, feed, fold, fsview, merge, ops, secidx
from .plans import jsonschema
from .schema import LOG as RECORD
from .sources import binlog
from .store import Namespace, Store
from .streaming import feed as stream


def _records(spark: SparkSession, d: str, by_type: bool = False) -> DataFrame:
    """The event log as records of a store: keys and values in bytes, replicas of 32 bytes."""
    replica = F.unhex(F.sha2("replica", 256))
    names = [c.split()[0] for c in RECORD.split(", ")[:-1]]
    e = fx.event_ops(spark, d, by_type).withColumns({"key": F.col("key").cast("binary"), "value": F.col("value").cast("binary"), "replica": replica, "author": replica})
    return e.select(*names, F.lit(None).cast(RECORD.partition(" ops ")[2]).alias("ops"))


def _store(spark: SparkSession, records: DataFrame, policy: str = "lww", mode: str = "local") -> Store:
    """A store in the shared folder, its log written by one job."""
    store = Store(spark, shared.fresh_path(spark, "store"), mode=mode)
    store.create_namespace("events", policy)
    records.write.partitionBy("ns").parquet(f"{store.path}/log")
    return store


def _events(spark: SparkSession, d: str, policy: str = "lww", mode: str = "local") -> Namespace:
    return _store(spark, _records(spark, d), policy, mode).use("events")


@query(f"WITH {LOG}, {LOCAL} SELECT key, rtrim(base64(encode(value)), '=') AS value_b64, expires_at FROM s WHERE starts_with(key, 'u/0000')")
def kv_store_scan(spark, d):
    """A prefix scan through the store; the prefix reaches the scan of the log."""
    return _events(spark, d).scan(b"u/0000", NOW).withColumn("key", F.col("key").cast("string"))


@query(f"WITH {LOG}, {VERSIONS} SELECT key, hlc, sha256(replica) AS replica, seq, value FROM v")
def kv_store_versions(spark, d):
    rows = _events(spark, d, "register").versions()
    return rows.select(F.col("key").cast("string").alias("key"), "hlc", "replica", "seq", F.col("value").cast("string").alias("value"))


@query(f"WITH {LOG}, {LOCAL} SELECT key, hlc, seq, value FROM s")
def kv_store_checkpoint(spark, d):
    """A checkpoint file of the first half of a store's log, and the state from it and the tail."""
    log = _records(spark, d)
    half = log.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
    old, path = _store(spark, log.where(F.col("seq") <= half)).use("events"), shared.fresh_path(spark, "checkpoint")
    old.checkpoint(path)
    rows = _store(spark, log).use("events").state_from(path, half, NOW)
    return rows.select(F.col("key").cast("string").alias("key"), "hlc", "seq", F.col("value").cast("string").alias("value"))


@query("SELECT 'events' AS ns, count(*) AS records, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE strlen(props) END) AS BIGINT) AS bytes FROM events HAVING count(*) > 0")
def kv_store_restored(spark, d):
    """Record and byte counts of a store that was filled from the backup of another."""
    store = _store(spark, _records(spark, d))
    backup, back = shared.fresh_path(spark, "backup"), Store(spark, shared.fresh_path(spark, "restored"))
    store.backup(backup)
    back.restore(backup)
    return back.metrics()


@query(f"WITH {DAILY}, {WINNER} SELECT key, hlc, value FROM w WHERE {LIVE} AND NOT EXISTS (SELECT 1 FROM log x WHERE x.tag = 2 AND x.key = w.key)")
def kv_store_pull(spark, d):
    """The merged state of a store that has pulled the rest of the log from another one."""
    day = F.concat("key", F.lit("/"), F.floor(F.shiftright("hlc", 16) / 86400000).cast("string").cast("binary"))
    log, n = _records(spark, d).withColumn("key", day), F.col("seq") % 3
    mine, peer = _store(spark, log.where(n != 1), mode="merge"), _store(spark, log.where(n != 2), mode="merge")
    mine.pull(peer)
    return mine.use("events").state(NOW).select(F.col("key").cast("string").alias("key"), "hlc", F.col("value").cast("string").alias("value"))


_BINARY = (
    f"WITH {LOG}, n AS (SELECT event_type AS ns, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS place, tag, key, hlc, "
    "sha256(replica) AS replica, value, expires_at FROM log) "
)


@query(_BINARY + "SELECT ns, place AS seq, tag, key, hlc, replica, value, expires_at FROM n")
def kv_binary_log(spark, d):
    """The log of all namespaces written as binary segments of 64 KB and read back: frames, checksums, the
    chain of hashes and the numbers of records."""
    path = shared.fresh_path(spark, "segments")
    binlog.write_log(_records(spark, d, by_type=True), path, 1 << 16)
    text = lambda c: F.col(c).cast("string").alias(c)
    return binlog.read_log(spark, path).select("ns", "seq", "tag", text("key"), "hlc", codec.hex_text(F.col("replica")).alias("replica"), text("value"), "expires_at")


@query(_BINARY + "SELECT ns, max(place) AS head, true AS sound FROM n GROUP BY ns")
def kv_binary_chain(spark, d):
    """Heads of the same segments, and whether every record names the hash of the one before it."""
    path = shared.fresh_path(spark, "segments")
    binlog.write_log(_records(spark, d, by_type=True), path, 1 << 16)
    records = shared.cut(binlog.read_log(spark, path), "records")
    bad = merge.chain_breaks(records).select("ns").union(merge.gaps(records)).distinct().withColumn("sound", F.lit(False))
    return feed.heads(records).drop("hash").join(bad, "ns", "left").select("ns", "head", F.coalesce("sound", F.lit(True)).alias("sound"))


@query(f"WITH {LOG} SELECT seq, key, value FROM log WHERE seq > 100")
def kv_stream_feed(spark, d):
    """The change feed as a stream, delivered once up to what is there."""
    source, out, cursor = (shared.fresh_path(spark, x) for x in ("feed", "delivered", "cursor"))
    _records(spark, d).repartition(4, "seq").write.parquet(source)
    rows = stream.read(spark, source, since=100, files_per_batch=2)
    deliver = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/n={n}")
    stream.subscribe(rows, deliver, cursor, once=True).awaitTermination()
    return spark.read.schema(RECORD).parquet(out).select("seq", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query(f"WITH {DAILY}, {WINNER} SELECT {VERSION} FROM w WHERE {LIVE} AND NOT EXISTS (SELECT 1 FROM log x WHERE x.tag = 2 AND x.key = w.key)")
def kv_stream_state(spark, d):
    """The merged state kept up by a stream, in three batches."""
    source, state, cursor = (shared.fresh_path(spark, x) for x in ("ops", "state", "cursor"))
    daily = fx.event_ops(spark, d).withColumn("key", F.concat("key", F.lit("/"), F.floor(F.col("ms") / 86400000).cast("string")))
    daily.repartition(3, "seq").write.parquet(source)
    made: list[int] = []
    fold_in = stream.upsert_state(lambda n: f"{state}/{n}", spark)

    def deliver(batch: DataFrame, n: int) -> None:
        fold_in(batch, n)
        made.append(n)

    rows = spark.readStream.schema(daily.schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream.subscribe(rows, deliver, cursor, once=True).awaitTermination()
    if not made:
        return fold.state(daily, NOW).select(*VERSION.split(", "))
    return stream.state_of(spark.read.parquet(f"{state}/{made[-1]}"), NOW).select(*VERSION.split(", "))


@query(f"WITH {LOG} SELECT seq, tag, key FROM log WHERE seq >= 100")
def kv_log_records(spark, d):
    return feed.log_range(fx.event_ops(spark, d), 100).select("seq", "tag", "key")


@query(
    f"WITH {LOG} SELECT seq, rtrim(base64(encode(key)), '=') AS key_b64, rtrim(base64(encode(value)), '=') AS value_b64, tag = 2 AS del, expires_at <> 0 AS ttl, "
    "expires_at, hlc, false AS batch, CAST(0 AS BIGINT) AS ops, false AS parse_error FROM log"
)
def kv_change_fields(spark, d):
    return feed.change_fields(_records(spark, d)).drop("ns")


@query("SELECT o_orderkey AS seq, true AS batch, count(*) AS ops, false AS parse_error FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def kv_change_batches(spark, d):
    return feed.change_fields(fx.order_batches(spark, d)).select("seq", "batch", "ops", "parse_error")


@query(f"WITH {LOG} SELECT event_type AS ns, count(*) AS records, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM log GROUP BY 1")
def kv_metrics(spark, d):
    return feed.metrics(fx.event_ops(spark, d, by_type=True))


@query(
    f"WITH {LOG}, x AS (SELECT replica AS peer, seq AS t, CAST(ms % 2001 - 1000 AS BIGINT) AS skew FROM log), "
    "y AS (SELECT peer, skew, row_number() OVER (PARTITION BY peer ORDER BY t DESC) AS n FROM x), "
    "z AS (SELECT peer, list_sort(list(skew)) AS l FROM y WHERE n <= 8 GROUP BY peer) "
    "SELECT greatest(l[len(l) // 2 + 1], 0) AS skew FROM z WHERE peer = 'r1'"
)
def kv_clock_skew(spark, d):
    samples = fx.event_ops(spark, d).select(F.col("replica").alias("peer"), F.col("seq").alias("t"), (F.col("ms") % 2001 - 1000).alias("skew"))
    latest = fold.top_per_key(feed.skew_median(samples), ("t",), ("peer",)).select("peer", F.col("skew_median").alias("skew"))
    return feed.clock_skew(latest, "r1")


@query(f"WITH {LOG} SELECT seq, hlc < 111614600000000 + seq * 1000000 AS is_before FROM log")
def kv_hlc_before(spark, d):
    """Clocks as decimal text, as clients send them."""
    other = F.lit(111614600000000) + F.col("seq") * 1000000
    return fx.event_ops(spark, d).select("seq", hlc.before(F.col("hlc").cast("string"), other.cast("string")).alias("is_before"))


_BY_TYPE = LOG.replace("AS key", "AS key, event_type AS ns")


@query(
    f"WITH {_BY_TYPE}, d AS (SELECT ns, key, max(seq) AS d FROM log WHERE tag = 2 GROUP BY ns, key), "
    "l AS (SELECT *, row_number() OVER (PARTITION BY ns, key ORDER BY seq DESC) AS n FROM log WHERE ns IN ('view', 'signup', 'error')), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY ns, key ORDER BY hlc DESC, replica DESC, seq DESC) AS n FROM log WHERE ns IN ('click', 'purchase') AND {LIVE}) "
    f"SELECT ns, {VERSION} FROM l WHERE n = 1 AND tag <> 2 AND {LIVE} UNION ALL SELECT ns, {VERSION} FROM r WHERE n = 1 AND tag <> 2"
)
def kv_state_by_policy(spark, d):
    """Several namespaces in one fold, two of them registers."""
    names = spark.sql("SELECT * FROM VALUES ('view', 'lww'), ('signup', 'lww'), ('error', 'lww'), ('click', 'register'), ('purchase', 'register') AS t(ns, policy)")
    return fold.state_by_policy(fx.event_ops(spark, d, by_type=True), names, NOW, "local").select("ns", *VERSION.split(", "))


@query(f"WITH {LOG}, {VERSIONS}, c AS (SELECT key FROM v GROUP BY key HAVING count(*) > 1) SELECT key, seq, hlc, replica, value FROM v WHERE key IN (SELECT key FROM c)")
def kv_conflict_versions(spark, d):
    kept = fold.conflict_versions(fold.register_versions(fx.event_ops(spark, d)))
    return kept.select("key", F.explode("versions").alias("v")).select("key", "v.seq", "v.hlc", "v.replica", "v.value")


_DEFINED = (
    f"WITH {LOG}, x AS (SELECT event_type AS ns, 4 + event_id % 2 AS kind, hlc, replica, seq, event_id, "
    "row_number() OVER (PARTITION BY event_type, event_id % 2 ORDER BY hlc DESC, replica DESC, seq DESC) AS n FROM log WHERE event_id % 50 < 2) "
)


@query(
    _DEFINED + "SELECT ns, max(CASE WHEN kind = 4 THEN concat('{\"maximum\":', CAST(event_id AS varchar), '}') END) AS schema_json, "
    "coalesce(max(CASE WHEN kind = 5 THEN concat('f', CAST(event_id AS varchar), ',k') END), '') AS fields FROM x WHERE n = 1 GROUP BY ns"
)
def kv_definitions(spark, d):
    """The newest schema and index definition of each namespace among many."""
    n = F.col("event_id")
    tag = F.when(n % 50 == 0, 4).when(n % 50 == 1, 5).otherwise(F.col("tag"))
    number = n.cast("string")
    text = F.when(n % 50 == 0, F.concat(F.lit('{"maximum":'), number, F.lit("}"))).when(n % 50 == 1, F.concat(F.lit('["f'), number, F.lit('","k"]'))).otherwise(F.col("value"))
    log = fx.event_ops(spark, d, by_type=True).withColumns({"tag": tag, "value": text})
    return secidx.definitions(log).select("ns", "schema_json", F.array_join("index_fields", ",").alias("fields"))


@query(f"WITH {LOG}, {LOCAL} SELECT DISTINCT 'k' AS field, json_extract_string(value, '$.k') AS fv, key FROM s")
def kv_index_strict(spark, d):
    """The index as the store derives it, with whole documents parsed."""
    return secidx.index_rows(fold.state(fx.event_ops(spark, d), NOW, mode="local"), ["k"], strict=True).drop("ns")


@query(f"WITH {LOG}, {LOCAL} SELECT key AS path, strlen(value) AS size, (hlc >> 16) / 1000 AS mtime FROM s")
def kv_fs_attributes(spark, d):
    rows = fsview.attributes(fold.state(fx.event_ops(spark, d), NOW, mode="local"), "key")
    return rows.withColumn("size", F.col("size").cast("long"))


@query("SELECT event_id, substring(props, 3, 5) AS part, lower(hex(encode(substring(props, 1, 9)))) || repeat('00', greatest(0, 9 - strlen(props))) AS cut FROM events")
def kv_fs_slices(spark, d):
    """A read from the middle of each file, and its truncation or extension to nine bytes."""
    data = F.col("props").cast("binary")
    part = fsview.read_range(data, 2, 5).cast("string")
    return fx.table(spark, d, "events").select("event_id", part.alias("part"), codec.hex_text(fsview.padded(data, 9)).alias("cut"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return fold.state(ops.explode_batches(_records(spark, d)), NOW - 20 * 86400000, mode="local")


_EARLY = LOCAL.replace(str(NOW), str(NOW - 20 * 86400000))


@query(
    f"WITH {LOG}, {_EARLY} SELECT replace(key, 'u/', 'v/') AS key, CASE WHEN expires_at = 0 THEN 1 ELSE 3 END AS tag, value, expires_at FROM s "
    "UNION ALL SELECT key, 2, '', 0 FROM s"
)
def kv_fs_rename(spark, d):
    """A folder with all files renamed: puts that keep their expiry, and tombstones."""
    rows = fsview.renamed(_files(spark, d), "u", "v", 1 << 40, bytes(32))
    return rows.select(F.col("key").cast("string").alias("key"), "tag", F.col("value").cast("string").alias("value"), "expires_at")


@query(f"WITH {LOG}, {_EARLY} SELECT key, CASE WHEN expires_at > {NOW - 19 * 86400000} THEN expires_at ELSE 0 END AS expires_at FROM s")
def kv_fs_rewrite(spark, d):
    """Files written anew keep an expiry that is still to come."""
    old = _files(spark, d)
    return fsview.rewritten(old, old.select("ns", "key"), NOW - 19 * 86400000).select(F.col("key").cast("string").alias("key"), "expires_at")


@query(
    "WITH peers AS (SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE concat('p', CAST(n_nationkey AS varchar)) END AS pin FROM nation WHERE n_nationkey % 5 <> 4), "
    "hello AS (SELECT s_suppkey, n_name AS name, concat('p', CAST(s_suppkey % 30 AS varchar)) AS offered_pin FROM supplier JOIN nation ON s_nationkey = n_nationkey) "
    "SELECT s_suppkey, CASE WHEN offered_pin IN (SELECT pin FROM peers WHERE pin <> '') THEN 'Full' "
    "WHEN name IN (SELECT name FROM peers WHERE pin = '') THEN 'HelloOnly' ELSE 'Deny' END AS access FROM hello"
)
def kv_peer_access(spark, d):
    n = F.col("n_nationkey")
    nation = fx.table(spark, d, "nation")
    pin = F.when(n % 2 == 0, "").otherwise(F.concat(F.lit("p"), n.cast("string")))
    peers = nation.where(n % 5 != 4).select(F.col("n_name").alias("name"), pin.alias("pin"))
    hello = fx.table(spark, d, "supplier").join(nation, F.col("s_nationkey") == n).select(
        "s_suppkey", F.col("n_name").alias("name"), F.concat(F.lit("p"), (F.col("s_suppkey") % 30).cast("string")).alias("offered_pin")
    )
    return authz.peer_access(hello, peers).select("s_suppkey", "access")


_TIERS = (
    "WITH caps AS (SELECT CAST(c_custkey AS varchar) AS subject, CASE c_custkey % 3 WHEN 0 THEN 'l1' WHEN 1 THEN 'l2' ELSE 'l3' END AS tier, "
    "CASE c_custkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'data' ELSE concat('u/', CAST(c_custkey - c_nationkey % 2 AS varchar)) END AS ns, "
    "CAST(c_nationkey % 8 AS INTEGER) AS perms FROM customer) "
)


def _tier_caps(spark: SparkSession, d: str) -> DataFrame:
    c, kind = F.col("c_custkey"), F.col("c_custkey") % 3
    own = F.concat(F.lit("u/"), (c - F.col("c_nationkey") % 2).cast("string"))
    return fx.table(spark, d, "customer").select(
        c.cast("string").alias("subject"), F.lit("h").alias("host"), F.when(kind == 0, "l1").when(kind == 1, "l2").otherwise("l3").alias("tier"),
        F.when(kind == 0, "*").when(kind == 1, "data").otherwise(own).alias("ns"), F.lit(None).cast("string").alias("prefix"),
        (F.col("c_nationkey") % 8).cast("int").alias("perms"),
    )


@query(
    _TIERS + "SELECT o_orderkey AS req_id FROM orders JOIN caps ON subject = CAST(o_custkey AS varchar) WHERE CASE tier WHEN 'l1' THEN perms & 4 = 4 WHEN 'l2' THEN perms & 1 = 1 "
    "ELSE perms & 1 = 1 AND ns = concat('u/', subject) END"
)
def kv_authorize_tiers(spark, d):
    """Requests at all three tiers: the first needs admin of everything, the last the principal's own namespace."""
    o, kind = F.col("o_custkey"), F.col("o_custkey") % 3
    requests = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("req_id"), o.cast("string").alias("principal"), F.lit("h").alias("host"),
        F.when(kind == 0, "l1").when(kind == 1, "l2").otherwise("l3").alias("tier"),
        F.when(kind == 0, "any").when(kind == 1, "data").otherwise(F.concat(F.lit("u/"), o.cast("string"))).alias("ns"),
        F.lit(None).cast("string").alias("prefix"), F.lit(1).alias("perms"),
    )
    return authz.authorized(requests, _tier_caps(spark, d)).select("req_id")


@query(
    "SELECT c_custkey AS nonce FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3 "
    "AND (c_custkey % 2 = 0 OR c_custkey * 1000 > 500000) AND c_custkey % 7 <> 0"
)
def kv_valid_caps(spark, d):
    """Capabilities whose issuer is trusted and that neither expired nor were revoked."""
    nation = fx.table(spark, d, "nation")
    c = F.col("c_custkey")
    caps = fx.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("issuer"), c.cast("string").alias("subject"), F.lit("h").alias("host"), F.lit("l2").alias("tier"), F.lit("data").alias("ns"),
        F.lit(None).cast("string").alias("prefix"), F.when(c % 2 == 1, c * 1000).alias("expiry"), c.alias("nonce"),
    )
    none = [F.lit(None).cast("string").alias(x) for x in ("host", "tier", "ns", "prefix", "subject")]
    revoked = caps.where("nonce % 7 = 0").select("nonce", *none)
    ring = nation.where("n_regionkey < 3").select(F.col("n_name").alias("issuer"))
    return authz.valid_caps(caps, ring, revoked, 500000).select("nonce")


@query(
    "WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages) "
    "SELECT page_id, CASE WHEN contains(path, '/') THEN nullif(left(path, strlen(path) - strpos(reverse(path), '/')), '') END AS prefix FROM p"
)
def kv_request_prefix(spark, d):
    return fx.page_paths(spark, d).select("page_id", authz.request_prefix(F.col("path")).alias("prefix"))


@query("SELECT c_custkey, concat(printf('%x', 2 * strlen(c_name)), '_', lower(hex(encode(c_name)))) AS folder FROM customer")
def kv_namespace_folder(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", codec.namespace_folder(F.col("c_name")).alias("folder"))


@query("SELECT event_id, concat(props, chr(65533), 'x') AS fixed, replace(replace(rtrim(base64(encode(props)), '='), '+', '-'), '/', '_') AS b64, props AS back FROM events")
def kv_text_codecs(spark, d):
    """A byte that is not UTF-8 becomes the replacement character; base64 for URLs and back."""
    b64 = codec.base64url_text(F.col("props").cast("binary"))
    fixed = codec.text(F.concat(F.col("props").cast("binary"), F.lit(b"\xffx")))
    return fx.table(spark, d, "events").select("event_id", fixed.alias("fixed"), b64.alias("b64"), codec.text(codec.base64url_bytes(b64)).alias("back"))


@query("SELECT event_id // 2 AS pair, bool_and(event_id % 7 <> 0 AND NOT (event_id % 2 = 1 AND event_id % 5 = 0)) AS ok FROM events GROUP BY 1")
def kv_verified_batches(spark, d):
    """Pairs of records, each pair a batch; in some a hash or a link is wrong."""
    n = F.col("event_id")
    digest = lambda c: F.unhex(F.sha2(c, 256))
    body = lambda c: c.cast("string").cast("binary")
    start = digest(F.concat(F.lit("pair "), F.floor(n / 2).cast("string")))
    first = digest(F.concat(start, body(n - n % 2)))  # the hash of the pair's first record
    prev = F.when(n % 2 == 0, start).when(n % 5 == 0, digest(F.lit("other"))).otherwise(first)
    own = F.when(n % 7 == 0, digest(F.lit("wrong"))).otherwise(digest(F.concat(prev, body(n))))
    # a wrong hash of a first record also breaks the link of the second, in a pair that is unsound anyway
    rows = fx.table(spark, d, "events").select(
        F.floor(n / 2).cast("string").alias("ns"), (n + 1).alias("seq"), prev.alias("prev"), own.alias("hash"), body(n).alias("bytes")
    )
    return merge.verified_batches(rows).select(F.col("ns").cast("long").alias("pair"), "ok")


@query("SELECT event_id, strlen(event_type) BETWEEN 5 AND 6 AS valid FROM events")
def kv_schema_lengths(spark, d):
    text = F.concat(F.lit('"'), "event_type", F.lit('"'))
    schema = '{"type":"string","minLength":5,"maxLength":6}'
    return fx.table(spark, d, "events").select("event_id", jsonschema.error(text, schema).isNull().alias("valid"))


@query("SELECT event_id, event_id % 4 = 0 AS valid FROM events")
def kv_schema_members(spark, d):
    n = F.col("event_id") % 4
    text = F.when(n == 0, '{"a":1}').when(n == 1, '{"a":1,"b":2}').when(n == 2, '{"b":2}').otherwise('{"a":"x"}')
    schema = '{"type":"object","properties":{"a":{"type":"integer"}},"required":["a"],"additionalProperties":false,"maxProperties":1}'
    return fx.table(spark, d, "events").select("event_id", jsonschema.error(text, schema).isNull().alias("valid"))


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query(f"SELECT event_id, ({_K} < 30 OR {_K} > 70) AND {_K} >= 5 AND {_K} % 2 = 0 AND {_K} <> 80 AS valid FROM events")
def kv_schema_combined(spark, d):
    schema = '{"properties":{"k":{"anyOf":[{"exclusiveMaximum":30},{"exclusiveMinimum":70}],"allOf":[{"minimum":5},{"multipleOf":2}],"not":{"const":80}}}}'
    return _schema_valid(spark, d, schema)
