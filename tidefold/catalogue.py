"""Registered key-value queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import hlc
from .operators import authz, batch, compact, feed, fold, fsview, merge, ops, secidx

NOW = fx.NOW
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The event log as SQL; whole milliseconds by epoch_us, since epoch_ms rounds differently.
LOG = """log AS (SELECT event_id, event_id + 1 AS seq, event_type, value AS event_value, (epoch_us(ts) // 1000) AS ms,
  CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 1 END AS tag,
  concat('u/', lpad(CAST(user_id AS varchar), 6, '0')) AS key,
  ((epoch_us(ts) // 1000) << 16) + (event_id % 65536) AS hlc,
  concat('r', CAST(event_id % 3 AS varchar)) AS replica,
  CASE WHEN event_type = 'error' THEN '' ELSE props END AS value,
  CASE WHEN event_type = 'signup' THEN (epoch_us(ts) // 1000) + 86400000 ELSE 0 END AS expires_at FROM events)"""
WINNER = """w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY hlc DESC, replica DESC, seq DESC) AS n
  FROM log WHERE tag <> 2) WHERE n = 1)"""
LIVE = f"(expires_at = 0 OR expires_at > {NOW})"
VERSIONS = """v AS (SELECT l.* FROM log l LEFT JOIN (SELECT key, max(seq) AS d FROM log WHERE tag = 2 GROUP BY key) USING (key)
  WHERE tag <> 2 AND seq > coalesce(d, 0))"""
LOCAL = f"""s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM log)
  WHERE n = 1 AND tag <> 2 AND {LIVE})"""
VERSION = "key, hlc, replica, value, seq, expires_at"
COLS = ["key", "hlc", "replica", "value", "seq", "expires_at"]


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return register


@query(f"WITH {LOG}, {WINNER} SELECT {VERSION} FROM w WHERE {LIVE}")
def kv_get_lww(spark, d):
    return fold.lww(fx.event_ops(spark, d), honour_tombstones=False).where(fold.live(NOW)).select(*COLS)


@query(f"WITH {LOG}, {LOCAL} SELECT {VERSION} FROM s")
def kv_live_local(spark, d):
    return fold.state(fx.event_ops(spark, d), NOW, mode="local").select(*COLS)


@query(f"WITH {LOG} SELECT key, max(seq) AS last_del, count(*) AS n_dels FROM log WHERE tag = 2 GROUP BY key")
def kv_tombstones(spark, d):
    return fold.tombstones(fx.event_ops(spark, d)).drop("ns")


#: The log with a key for each user and day, so that not every key has a delete.
DAILY = LOG.replace("concat('u/', lpad(CAST(user_id AS varchar), 6, '0')) AS key", "concat('u/', lpad(CAST(user_id AS varchar), 6, '0'), '/', CAST(epoch_us(ts) // 86400000000 AS varchar)) AS key")


def _daily(spark, d):
    return fx.event_ops(spark, d).withColumn("key", F.concat("key", F.lit("/"), F.floor(F.col("ms") / 86400000).cast("string")))


@query(f"WITH {DAILY}, {WINNER} SELECT {VERSION} FROM w WHERE {LIVE} AND NOT EXISTS (SELECT 1 FROM log x WHERE x.tag = 2 AND x.key = w.key)")
def kv_get_merge(spark, d):
    return fold.state(_daily(spark, d), NOW).select(*COLS)


@query(f"WITH {DAILY}, {WINNER} SELECT {VERSION} FROM w WHERE {LIVE} AND NOT EXISTS (SELECT 1 FROM log x WHERE x.tag = 2 AND x.key = w.key)")
def kv_checkpoint_tail(spark, d):
    """A checkpoint of the first part of the log (tombstones included) and the rest, folded together."""
    ops = _daily(spark, d)
    first = F.col("event_id") % 3 == 0  # what had arrived by the checkpoint
    return fold.state(compact.with_tail(compact.retained(ops.where(first)), ops.where(~first)), NOW).select(*COLS)


@query(f"WITH {LOG}, {LOCAL}, m AS (SELECT max(seq) // 2 AS half FROM log) SELECT {VERSION} FROM s, m")
def kv_checkpoint_tail_local(spark, d):
    """The same for local mode, where the checkpoint is a prefix of the log: half of it."""
    ops = fx.event_ops(spark, d)
    half = ops.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
    snapshot = compact.retained(ops.where(F.col("seq") <= half), mode="local")
    return fold.state(compact.with_tail(snapshot, ops.where(F.col("seq") > half)), NOW, mode="local").select(*COLS)


@query(f"WITH {LOG}, {VERSIONS} SELECT {VERSION} FROM v")
def kv_register_versions(spark, d):
    return fold.register_versions(fx.event_ops(spark, d)).select(*COLS)


@query(
    f"WITH {LOG}, {VERSIONS} SELECT {VERSION} FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY key ORDER BY hlc DESC, replica DESC, seq DESC) AS n FROM v WHERE {LIVE}) WHERE n = 1"
)
def kv_register_visible(spark, d):
    return fold.state(fx.event_ops(spark, d), NOW, "register", "local").select(*COLS)


@query(
    f"WITH {LOG}, {VERSIONS} SELECT key, count(*) AS n_versions, count(DISTINCT replica) AS distinct_replicas "
    "FROM v GROUP BY key HAVING count(*) > 1"
)
def kv_conflicts(spark, d):
    return fold.conflicts(fold.register_versions(fx.event_ops(spark, d))).drop("ns")


@query(f"WITH {LOG} SELECT seq, tag, key, hlc, replica, value FROM log WHERE starts_with(key, 'u/00000')")
def kv_scan_prefix(spark, d):
    return fold.scan(fx.event_ops(spark, d), "u/00000").select("seq", "tag", "key", "hlc", "replica", "value")


@query(f"WITH {LOG}, {WINNER} SELECT key FROM w WHERE {LIVE} AND starts_with(key, 'u/0000')")
def kv_scan_keys(spark, d):
    ops = fold.scan(fx.event_ops(spark, d), "u/0000")
    return fold.lww(ops, honour_tombstones=False).where(fold.live(NOW)).select("key")


def _index(spark, d):
    return secidx.index_rows(fold.state(fx.event_ops(spark, d), NOW, mode="local"), ["k"])


_INDEX = f"WITH {LOG}, {LOCAL}, i AS (SELECT DISTINCT 'k' AS field, json_extract_string(value, '$.k') AS fv, key FROM s) "


@query(_INDEX + "SELECT * FROM i WHERE fv IS NOT NULL")
def kv_secondary_index(spark, d):
    return _index(spark, d).drop("ns")


@query(_INDEX + "SELECT key FROM i WHERE fv = '69'")
def kv_by_index(spark, d):
    return secidx.by_index(_index(spark, d), "k", "69").select("key")


@query(_INDEX + "SELECT fv, key FROM i WHERE fv >= '5'")
def kv_index_range(spark, d):
    return secidx.index_range(_index(spark, d), "k", "5").drop("ns")


@query(f"WITH {LOG} SELECT event_type AS ns, max(seq) AS head FROM log GROUP BY event_type")
def kv_head(spark, d):
    return feed.heads(fx.event_ops(spark, d, by_type=True))


@query(f"WITH {LOG} SELECT seq, tag, key, hlc, value, expires_at FROM log WHERE seq > 9000 ORDER BY seq LIMIT 500")
def kv_changes(spark, d):
    """The feed's own limit: one page of 500 records."""
    return feed.changes(fx.event_ops(spark, d), 9000, 500).select("seq", "tag", "key", "hlc", "value", "expires_at")


@query(f"WITH {LOG} SELECT seq, hlc >> 16 AS hlc_ms, hlc & 65535 AS hlc_counter FROM log")
def kv_hlc_parts(spark, d):
    c = F.col("hlc")
    return fx.event_ops(spark, d).select("seq", hlc.millis(c).alias("hlc_ms"), hlc.counter(c).alias("hlc_counter"))


@query(
    f"WITH {LOG}, o AS (SELECT *, lag(hlc) OVER (PARTITION BY key ORDER BY seq) AS prev FROM log) SELECT seq, "
    "CASE WHEN greatest(hlc, prev) >> 16 = hlc >> 16 THEN greatest(hlc, prev) + 1 ELSE greatest(hlc, prev) END AS observed "
    "FROM o WHERE prev IS NOT NULL"
)
def kv_hlc_observed(spark, d):
    from pyspark.sql import Window

    prev = F.lag("hlc").over(Window.partitionBy("key").orderBy("seq"))
    rows = fx.event_ops(spark, d).withColumn("prev", prev).where("prev is not null")
    return rows.select("seq", hlc.observed(F.col("hlc"), F.col("prev")).alias("observed"))


def _peers(spark, d):
    ops = fx.event_ops(spark, d)
    return ops.where("event_id % 3 <> 0"), ops.where("event_id % 3 <> 1")


@query(
    f"WITH {LOG} SELECT seq, tag, key, hlc, replica FROM log p WHERE event_id % 3 <> 1 AND NOT EXISTS (SELECT 1 FROM log l "
    "WHERE l.event_id % 3 <> 0 AND l.tag = p.tag AND l.hlc = p.hlc AND l.replica = p.replica AND l.key = p.key)"
)
def kv_sync_missing(spark, d):
    local, peer = _peers(spark, d)
    return merge.missing(peer, local).select("seq", "tag", "key", "hlc", "replica")


@query(f"WITH {LOG}, {WINNER} SELECT key, hlc, replica, value, expires_at FROM w WHERE {LIVE}")
def kv_sync_merge(spark, d):
    local, peer = _peers(spark, d)
    merged = merge.apply_synced(local, peer)
    return fold.lww(merged, honour_tombstones=False).where(fold.live(NOW)).select("key", "hlc", "replica", "value", "expires_at")


@query(f"WITH {LOG} SELECT seq, replica, event_type AS ns FROM log WHERE (replica, event_type) IN (('r0', 'view'), ('r1', 'click'), ('r2', 'view'))")
def kv_allow_list(spark, d):
    allow = spark.sql("SELECT * FROM VALUES ('r0', 'view'), ('r1', 'click'), ('r2', 'view') AS t(replica, ns)")
    return merge.allowed(fx.event_ops(spark, d, by_type=True), allow).select("seq", "replica", "ns")


@query(
    f"WITH {LOG}, x AS (SELECT replica AS peer, seq AS t, CAST(ms % 2001 - 1000 AS BIGINT) AS skew FROM log), "
    "y AS (SELECT peer, t, list_sort(list(skew) OVER (PARTITION BY peer ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) AS l FROM x) "
    "SELECT peer, t, l[len(l) // 2 + 1] AS skew_median FROM y"
)
def kv_skew_median8(spark, d):
    s = fx.event_ops(spark, d).select(F.col("replica").alias("peer"), F.col("seq").alias("t"), (F.col("ms") % 2001 - 1000).alias("skew"))
    return feed.skew_median(s)


@query(
    f"WITH {LOG} SELECT seq, key, row_number() OVER (PARTITION BY key, ms // 3600000 ORDER BY seq) <= 2 AS allowed FROM log"
)
def kv_ratelimit(spark, d):
    return batch.rate_limited(fx.event_ops(spark, d), 2, 3600000).select("seq", "key", "allowed")


@query(
    f"WITH {LOG} SELECT key, seq // 100 AS slot, count(*) AS n_requests, least(count(*), 1) AS n_allowed FROM log GROUP BY key, seq // 100"
)
def kv_ratelimit_counts(spark, d):
    return batch.rate_counts(fx.event_ops(spark, d), 1, 100, time="seq")


@query(
    "WITH RECURSIVE o AS (SELECT o_custkey AS ns, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS idx, "
    "CAST(floor(o_totalprice / 1000) AS BIGINT) AS cost FROM orders), "
    "r(ns, idx, used, ok) AS (SELECT ns, idx, CASE WHEN cost <= 900 THEN cost ELSE 0 END, cost <= 900 FROM o WHERE idx = 1 "
    "UNION ALL SELECT o.ns, o.idx, r.used + CASE WHEN r.used + o.cost <= 900 THEN o.cost ELSE 0 END, r.used + o.cost <= 900 "
    "FROM r JOIN o ON o.ns = r.ns AND o.idx = r.idx + 1) SELECT ns, idx, ok FROM r"
)
def kv_quota_greedy(spark, d):
    from pyspark.sql import Window

    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    ops = fx.table(spark, d, "orders").select(
        F.col("o_custkey").alias("ns"), idx.cast("long").alias("idx"), F.floor(F.col("o_totalprice") / 1000).alias("cost"), F.lit(0).alias("used")
    )
    return batch.quota(ops, 900)


@query(
    f"WITH {LOG} SELECT key, seq, sum(strlen(value)) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) > 200 AS over_cap FROM log"
)
def kv_get_byte_cap(spark, d):
    gets = fx.event_ops(spark, d).select("key", "seq", F.octet_length("value").alias("bytes"))
    return batch.byte_cap(gets, 200, group="key", order="seq").drop("bytes")


@query(
    "SELECT o_orderkey AS seq, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, concat_ws('/', 'o', l_orderkey, l_linenumber), l_returnflag) - 1 AS pos, "
    "concat_ws('/', 'o', l_orderkey, l_linenumber) AS key, l_returnflag AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
)
def kv_batch_explode(spark, d):
    return ops.explode_batches(fx.order_batches(spark, d)).select("seq", F.col("pos").cast("long").alias("pos"), "key", "value")


@query(
    f"WITH {LOG}, {LOCAL}, k AS (SELECT key, seq, CASE WHEN expires_at = 0 THEN 1 ELSE 3 END AS tag, value FROM s UNION ALL "
    "SELECT key, max(seq), 2, NULL FROM log WHERE tag = 2 AND key NOT IN (SELECT key FROM s) GROUP BY key) "
    "SELECT key, tag, value, row_number() OVER (ORDER BY key, seq) AS seq FROM k"
)
def kv_compact(spark, d):
    return compact.compacted(fx.event_ops(spark, d), NOW, mode="local").select("key", "tag", "value", "seq")


_PATHS = "p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, page_id FROM pages) "


@query(
    f"WITH {_PATHS} SELECT split_part(path, '/', 1) AS name, arg_max(contains(path, '/'), path) AS is_dir, count(*) AS n_files "
    "FROM p WHERE split_part(path, '/', 1) NOT IN ('', '.', '..') GROUP BY 1"
)
def kv_fs_readdir(spark, d):
    return fsview.readdir(fx.page_paths(spark, d))


_AUTH = (
    "WITH caps AS (SELECT c_custkey AS subject, lower(c_mktsegment) AS prefix, CAST(c_nationkey % 8 AS INTEGER) AS perms, c_custkey AS nonce FROM customer), "
    "req AS (SELECT o_orderkey AS req_id, o_custkey AS principal, concat(lower(c_mktsegment), CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN '/x' ELSE 'x' END) AS prefix, "
    "CAST(1 + o_orderkey % 2 AS INTEGER) AS perms FROM orders JOIN customer ON o_custkey = c_custkey) "
)


def _auth(spark, d):
    customer = fx.table(spark, d, "customer")
    scope = [F.lit("h").alias("host"), F.lit("l2").alias("tier"), F.lit("data").alias("ns")]
    segment = F.lower("c_mktsegment")
    caps = customer.select(
        F.col("c_custkey").alias("subject"), *scope, segment.alias("prefix"), (F.col("c_nationkey") % 8).cast("int").alias("perms"),
        F.col("c_custkey").alias("nonce"),
    )
    m = F.col("o_orderkey") % 3
    tail = F.when(m == 0, "").when(m == 1, "/x").otherwise("x")
    requests = fx.table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("req_id"), F.col("o_custkey").alias("principal"), *scope, F.concat(segment, tail).alias("prefix"),
        (1 + F.col("o_orderkey") % 2).cast("int").alias("perms"),
    )
    return caps, requests


@query(
    _AUTH + "SELECT req_id FROM req WHERE EXISTS (SELECT 1 FROM caps WHERE subject = principal AND (caps.perms & req.perms) = req.perms "
    "AND (req.prefix = caps.prefix OR starts_with(req.prefix, concat(caps.prefix, '/'))))"
)
def kv_authorize(spark, d):
    caps, requests = _auth(spark, d)
    return authz.authorized(requests, caps).select("req_id")


@query(
    _AUTH + "SELECT subject FROM caps WHERE nonce % 7 <> 0 AND NOT (prefix = 'building' AND subject % 2 = 0)"
)
def kv_revoked(spark, d):
    caps, _ = _auth(spark, d)
    nonces = caps.where("nonce % 7 = 0").select("nonce", *[F.lit(None).cast(t).alias(n) for n, t in _SCOPE])
    scopes = caps.where("prefix = 'building' and subject % 2 = 0").select(F.lit(None).cast("long").alias("nonce"), *[n for n, _ in _SCOPE])
    return authz.not_revoked(caps, nonces.unionByName(scopes)).select("subject")


_SCOPE = [("host", "string"), ("tier", "string"), ("ns", "string"), ("prefix", "string"), ("subject", "long")]


@query(f"WITH {LOG}, {WINNER} SELECT key, seq, expires_at FROM w WHERE NOT {LIVE}")
def kv_ttl_expired(spark, d):
    return fold.expired(fx.event_ops(spark, d), NOW).select("key", "seq", "expires_at")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) >= 10 AS valid FROM events")
def kv_schema_valid(spark, d):
    from .plans import jsonschema

    schema = '{"type":"object","properties":{"k":{"type":"integer","minimum":10}},"required":["k"]}'
    return fx.table(spark, d, "events").select("event_id", jsonschema.error(F.col("props"), schema).isNull().alias("valid"))


@query("SELECT event_id, sha256(props) AS digest, lower(hex(encode(props))) AS hex_text FROM events")
def kv_digest(spark, d):
    from .functions import codec

    return fx.table(spark, d, "events").select("event_id", F.sha2("props", 256).alias("digest"), codec.hex_text(F.col("props")).alias("hex_text"))


@query("SELECT event_id, rtrim(base64(encode(props)), '=') AS b64, props AS back FROM events")
def kv_base64(spark, d):
    from .functions import codec

    b64 = codec.base64_text(F.col("props").cast("binary"))
    return fx.table(spark, d, "events").select("event_id", b64.alias("b64"), codec.text(codec.base64_bytes(b64)).alias("back"))


@query(
    f"WITH {LOG}, h AS (SELECT key AS ns, max(seq) FILTER (event_id % 3 <> 0) AS head, max(seq) FILTER (event_id % 3 <> 1) AS peer_head FROM log GROUP BY 1) "
    "SELECT ns, head + 1 AS first, least(peer_head, head + 64000) AS target FROM h WHERE peer_head > head"
)
def kv_sync_plan(spark, d):
    """A namespace for each user, and the whole logs of two replicas."""
    local, peer = (x.withColumn("ns", F.col("key")) for x in _peers(spark, d))
    return merge.sync_plan(feed.heads(local), feed.heads(peer))


@query(f"WITH {LOG} SELECT tag, key, hlc, replica, count(*) AS copies FROM log WHERE event_id % 3 = 2 GROUP BY ALL UNION ALL SELECT tag, key, hlc, replica, 1 FROM log WHERE event_id % 3 <> 2")
def kv_deduplicated(spark, d):
    """The logs of two replicas laid one upon the other: what both have counts once."""
    local, peer = _peers(spark, d)
    kept = merge.deduplicated(local.unionByName(peer.withColumn("seq", F.col("seq") + 1_000_000_000)))
    return kept.groupBy("tag", "key", "hlc", "replica").agg(F.count("*").alias("copies"))


@query(
    f"WITH {LOG}, c AS (SELECT *, sum(strlen(key) + strlen(value)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS size, row_number() OVER (ORDER BY seq) AS n "
    "FROM (SELECT * FROM log WHERE seq >= 100 ORDER BY seq LIMIT 1000)) SELECT seq, tag, key, value FROM c WHERE size <= 12000 OR n = 1"
)
def kv_pull_chunk(spark, d):
    """One chunk of a pull: its limits are the feature."""
    return merge.pull_chunk(fx.event_ops(spark, d), 100, 1000, 12000).select("seq", "tag", "key", "value")


@query("SELECT event_id + 1 AS seq FROM events WHERE event_id % 97 = 0 AND event_id > 0")
def kv_chain_breaks(spark, d):
    """A chain in which every 97th record names another hash than the one before it has."""
    own = lambda n: F.unhex(F.sha2(n.cast("string"), 256))
    n = F.col("event_id")
    prev = F.when(n % 97 == 0, own(-n)).otherwise(own(n - 1))
    records = fx.table(spark, d, "events").select(F.lit("n").alias("ns"), (n + 1).alias("seq"), prev.alias("prev"), own(n).alias("hash"))
    return merge.chain_breaks(records).select("seq")


@query(f"WITH {LOG}, {VERSIONS} SELECT key, hlc, lower(hex(encode(replica))) AS replica, seq, value FROM v")
def kv_versions(spark, d):
    from .functions import codec

    return fold.register_versions(fx.event_ops(spark, d)).select("key", "hlc", codec.hex_text(F.col("replica")).alias("replica"), "seq", "value")


#: The requests of fixtures.requests, with their errors.
REQUESTS = f"""{LOG}, q AS (SELECT concat('b', CAST(event_id // 100 AS varchar)) AS ns, event_id AS idx,
  CASE WHEN event_id % 13 = 0 THEN 'jump' WHEN event_id % 4 = 0 THEN 'get' WHEN event_id % 4 = 1 THEN 'del' ELSE 'put' END AS op,
  CASE WHEN event_id % 11 <> 0 THEN key END AS key, value,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 9 = 0 THEN concat('%', rtrim(base64(encode(value)), '=')) ELSE rtrim(base64(encode(value)), '=') END AS value_b64 FROM log),
j AS (SELECT *, CASE WHEN key IS NULL THEN 'missing_key' WHEN op = 'jump' THEN 'unknown_op' WHEN op = 'put' AND value_b64 IS NULL THEN 'missing_value_b64'
  WHEN op = 'put' AND starts_with(value_b64, '%') THEN 'bad_value_b64' WHEN op = 'put' AND idx % 17 = 0 THEN 'schema_violation: $: bad' END AS error FROM q)"""


@query(f"WITH {REQUESTS} SELECT ns, idx, op, key, error FROM j")
def kv_batch_validated(spark, d):
    return batch.validated(fx.requests(spark, d)).select("ns", "idx", "op", "key", "error")


@query(
    f"WITH {REQUESTS} SELECT ns, CAST(sum(CASE op WHEN 'put' THEN 93 + coalesce(strlen(key), 0) + coalesce((strlen(value_b64) + 3) // 4 * 3, 0) "
    "WHEN 'del' THEN 85 + coalesce(strlen(key), 0) ELSE 0 END) AS BIGINT) AS bytes, count(*) AS n_ops FROM j GROUP BY ns"
)
def kv_batch_size(spark, d):
    return batch.size_estimate(fx.requests(spark, d))


@query(
    f"WITH {REQUESTS}, {LOCAL}, g AS (SELECT j.*, s.value AS found, sum(CASE WHEN op = 'get' AND error IS NULL THEN coalesce(strlen(s.value), 0) ELSE 0 END) "
    "OVER (PARTITION BY j.ns ORDER BY idx ROWS UNBOUNDED PRECEDING) > 60 AS over_cap FROM j LEFT JOIN s ON s.key = j.key), "
    "e AS (SELECT *, coalesce(error, CASE WHEN op = 'get' AND over_cap THEN 'batch_get_response_too_large' END) AS said FROM g) "
    "SELECT ns, idx, op, key, said AS error, CASE WHEN op IN ('put', 'del') AND said IS NULL THEN CAST(7 AS BIGINT) END AS seq, "
    "CASE WHEN op = 'get' AND said IS NULL THEN rtrim(base64(encode(found)), '=') END AS value_b64 FROM e"
)
def kv_batch_results(spark, d):
    judged = batch.validated(fx.requests(spark, d))
    state = fold.state(fx.event_ops(spark, d), NOW, mode="local").select("key", "value")
    spread = judged.select("ns", "key").distinct().join(state, "key")  # every request sees the same state
    return batch.results(judged, spread, 7, 60)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) IN (1, 5, 50) AS valid FROM events")
def kv_schema_enum(spark, d):
    return _schema_valid(spark, d, '{"properties":{"k":{"enum":[1,5,50]}}}')


@query("SELECT event_id, (CAST(json_extract(props, '$.k') AS BIGINT) <= 50) <> (CAST(json_extract(props, '$.k') AS BIGINT) % 7 = 0) AS valid FROM events")
def kv_schema_one_of(spark, d):
    return _schema_valid(spark, d, '{"properties":{"k":{"oneOf":[{"maximum":50},{"multipleOf":7}]}}}')


@query("SELECT o_orderkey, count(*) <= 4 AND count(DISTINCT l_linestatus) = count(*) AS valid FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def kv_schema_array(spark, d):
    from .plans import jsonschema

    lines = fx.table(spark, d, "orders").join(fx.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    texts = lines.groupBy("o_orderkey").agg(F.to_json(F.collect_list("l_linestatus")).alias("v"))
    schema = '{"type":"array","items":{"type":"string"},"maxItems":4,"uniqueItems":true}'
    return texts.select("o_orderkey", jsonschema.error(F.col("v"), schema).isNull().alias("valid"))


def _schema_valid(spark, d, schema):
    from .plans import jsonschema

    return fx.table(spark, d, "events").select("event_id", jsonschema.error(F.col("props"), schema).isNull().alias("valid"))


@query(
    "SELECT c_custkey, 'h' AS host, concat('l', CAST(1 + c_custkey % 3 AS varchar)) AS tier, lower(c_mktsegment) AS ns, "
    "CASE WHEN c_custkey % 2 = 0 THEN concat('a/', CAST(c_nationkey AS varchar)) END AS prefix FROM customer"
)
def kv_scope_parts(spark, d):
    tail = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/a/"), F.col("c_nationkey").cast("string"))).otherwise("")
    url = F.concat(F.lit("kv://h/l"), (1 + F.col("c_custkey") % 3).cast("string"), F.lit("/"), F.lower("c_mktsegment"), tail)
    return fx.table(spark, d, "customer").select("c_custkey", authz.scope_parts(url).alias("s")).select("c_custkey", "s.*")


@query("SELECT n_name AS issuer FROM nation UNION SELECT 'new root'")
def kv_key_rotation(spark, d):
    return authz.rotate(fx.table(spark, d, "nation").select(F.col("n_name").alias("issuer")), "new root", drop_old=False)


@query("SELECT page_id, strlen(coalesce(html, '')) AS size, concat(coalesce(html, ''), 'tail') AS appended FROM pages")
def kv_fs_append(spark, d):
    pages = fx.page_paths(spark, d)
    old = F.coalesce("value", F.lit(""))
    text = fsview.written(F.col("value"), F.lit(b"tail")).cast("string")
    return pages.select("page_id", F.octet_length(old).cast("long").alias("size"), text.alias("appended"))


def queries() -> dict[str, Query]:
    _more()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(_SQL)


def _more() -> None:
    """Registers the queries of the second module, which needs this one."""
    from . import catalogue_more  # noqa: F401
