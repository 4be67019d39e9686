"""A store: a log table and the operators over it, under the names that clients use.

The log is a Parquet table partitioned by namespace, with the key also as text for pushdown. Writes
append files; reads are folds of the log and return DataFrames. One writer per namespace is assumed:
a write numbers its records after the greatest seq it finds. The methods follow the query functions
and the client: now, hlc, before, use, get, put, del, scan, get_all, index and by_index.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .functions import codec
from .operators import authz, compact, feed, fold, merge, ops, secidx
from .operators import batch as batches
from .plans import jsonschema
from .schema import BATCH, DEL, INDEX, LOG, NAMESPACES, PUT, PUT_TTL, SCHEMA
from .streaming import feed as stream

NAME = re.compile(r"[a-z0-9._-]{1,64}|u/[0-9a-fA-F]{64}")
POLICIES = ("lww", "register")
ZERO = bytes(32)


class StoreError(Exception):
    """Base of the errors of a store."""


class NamespaceExists(StoreError):
    pass


class NamespaceNotFound(StoreError):
    pass


class InvalidName(StoreError):
    pass


class SchemaViolation(StoreError):
    pass


class QuotaExceeded(StoreError):
    pass


class EmptyBatch(StoreError):
    pass


class BatchTooLarge(StoreError):
    pass


class Forbidden(StoreError):
    pass


class UnsoundRecords(StoreError):
    """A peer's records do not form a chain."""


class Clock:
    """A strictly increasing hybrid clock for the writes of this process."""

    def __init__(self, last: int = 0) -> None:
        self.last = last

    def tick(self) -> int:
        self.last = max(self.last + 1, int(time.time() * 1000) << 16)
        return self.last


class Store:
    def __init__(self, spark: SparkSession, path: str, replica: bytes = ZERO, mode: str = "merge") -> None:
        self.spark, self.path, self.replica, self.mode = spark, path.rstrip("/"), replica, mode
        self.clock = Clock()

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        return self._table("log", LOG)

    def namespaces(self) -> DataFrame:
        return self._table("namespaces", NAMESPACES)

    def create_namespace(self, name: str, policy: str = "lww") -> Namespace:
        if not NAME.fullmatch(name) or policy not in POLICIES:
            raise InvalidName(name)
        if not self.namespaces().where(F.col("ns") == name).isEmpty():
            raise NamespaceExists(name)
        self.spark.createDataFrame([(name, policy)], NAMESPACES).write.mode("append").parquet(f"{self.path}/namespaces")
        return Namespace(self, name, policy)

    def use(self, name: str) -> Namespace:
        row = self.namespaces().where(F.col("ns") == name).first()
        if row is None:
            raise NamespaceNotFound(name)
        return Namespace(self, name, row.policy)

    def heads(self) -> DataFrame:
        return feed.heads(self.log(), self.namespaces())

    def definitions(self) -> DataFrame:
        return secidx.definitions(self.log())

    def metrics(self) -> DataFrame:
        """ns, records and bytes of every namespace."""
        return feed.metrics(self.log())

    def backup(self, target: str) -> None:
        compact.backup(self.log(), f"{target.rstrip('/')}/log")
        self.namespaces().write.mode("errorifexists").parquet(f"{target.rstrip('/')}/namespaces")

    def restore(self, source: str) -> None:
        """Fill this store, which must not exist yet, from a backup."""
        Store(self.spark, source).backup(self.path)

    def pull(self, peer: Store, allow: Iterable[str] | None = None) -> int:
        """Append what a peer has and this store lacks, for namespaces that both host; the number of
        new records. Refused where the policies differ."""
        if not merge.policy_mismatch(self.namespaces(), peer.namespaces()).isEmpty():
            raise StoreError("a namespace has another policy on the peer")
        return self._apply(peer.log(), allow)

    def pull_records(self, records: DataFrame, allow: Iterable[str] | None = None) -> int:
        """Append the new ones of a peer's records, read with their chain (prev, hash) from its binary
        log. Numbers must be consecutive and every `prev` the hash before, in all namespaces taken, or
        nothing is applied."""
        if allow is not None:
            records = records.where(F.col("ns").isin(list(allow)))
        if not (merge.chain_breaks(records).isEmpty() and merge.gaps(records).isEmpty()):
            raise UnsoundRecords("the records do not form a chain")
        return self._apply(records.select(*self.log().columns), None)

    def _apply(self, theirs: DataFrame, allow: Iterable[str] | None) -> int:
        theirs = theirs.join(self.namespaces().select("ns"), "ns", "left_semi")
        if allow is not None:
            theirs = theirs.where(F.col("ns").isin(list(allow)))
        new = shared.cut(merge.new_records(self.log(), theirs.select(*self.log().columns)), "pulled")
        if n := new.count():  # nothing new is the end of a pull, not a reason to ask again
            new.write.mode("append").partitionBy("ns").parquet(f"{self.path}/log")
        return n

    @staticmethod
    def now() -> int:
        return int(time.time() * 1000)

    def hlc(self) -> int:
        return self.clock.tick()

    @staticmethod
    def before(a: int | str, b: int | str) -> bool:
        x, y = int(a), int(b)
        if not (0 <= x < 1 << 64 and 0 <= y < 1 << 64):
            raise ValueError("a clock is an unsigned 64-bit number")
        return x < y


class Namespace:
    """Reads and writes of one namespace."""

    def __init__(self, store: Store, name: str, policy: str) -> None:
        self.store, self.name, self.policy = store, name, policy

    def log(self) -> DataFrame:
        return self.store.log().where(F.col("ns") == self.name)

    def ops(self, prefix: bytes = b"") -> DataFrame:
        log = self.log()
        return ops.under(log, fold.has_prefix("key", prefix)) if prefix else ops.explode_batches(log)

    def _now(self, now_ms: int | None, respect_ttl: bool) -> int | None:
        return (now_ms if now_ms is not None else self.store.now()) if respect_ttl else None

    def state(self, now_ms: int | None = None, prefix: bytes = b"", respect_ttl: bool = True) -> DataFrame:
        return fold.state(self.ops(prefix), self._now(now_ms, respect_ttl), self.policy, self.store.mode)

    def of_keys(self, keys: list[bytes], now_ms: int | None = None, respect_ttl: bool = True) -> DataFrame:
        """The state of some keys; their filter reaches the scan."""
        rows = ops.under(self.log(), F.col("key").isin([F.lit(k) for k in keys]))
        return fold.state(rows, self._now(now_ms, respect_ttl), self.policy, self.store.mode)

    def get(self, key: bytes, now_ms: int | None = None, respect_ttl: bool = True) -> bytes | None:
        row = self.of_keys([key], now_ms, respect_ttl).first()
        return bytes(row.value) if row is not None else None

    def scan(self, prefix: bytes = b"", now_ms: int | None = None, respect_ttl: bool = True, within: str | None = None) -> DataFrame:
        """within: the prefix that the caller's capability holds; a scan beyond its segment is refused."""
        if not authz.scan_allowed(prefix.decode(errors="replace"), within):
            raise Forbidden(f"a scan of {prefix!r} is outside {within!r}")
        rows = self.state(now_ms, prefix, respect_ttl)
        return rows.select("key", codec.base64_text(F.col("value")).alias("value_b64"), "expires_at").orderBy("key")

    def scan_keys(self, prefix: bytes = b"", now_ms: int | None = None, respect_ttl: bool = True) -> DataFrame:
        return self.state(now_ms, prefix, respect_ttl).select("key").orderBy("key")

    def versions(self, key: bytes | None = None) -> DataFrame:
        rows = self.ops() if key is None else ops.under(self.log(), F.col("key") == F.lit(key))
        kept = fold.lww(rows, self.store.mode) if self.policy == "lww" else fold.register_versions(rows, self.store.mode)
        return kept.select("key", "hlc", codec.hex_text(F.col("replica")).alias("replica"), "seq", "pos", "expires_at", "value")

    get_all = versions

    def conflicts(self) -> DataFrame:
        return fold.conflicts(fold.register_versions(self.ops(), self.store.mode))

    def head(self) -> int:
        return self.log().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    def changes(self, since: int = 0, most: int = feed.MOST_CHANGES) -> DataFrame:
        return feed.change_fields(feed.changes(self.log(), since, most))

    def subscribe(self, deliver, checkpoint: str, since: int = 0, once: bool = False):
        rows = stream.read(self.store.spark, f"{self.store.path}/log", since).where(F.col("ns") == self.name)
        return stream.subscribe(rows, deliver, checkpoint, once)

    def schema(self) -> str | None:
        row = self.store.definitions().where(F.col("ns") == self.name).first()
        return row.schema_json if row is not None else None

    def index_fields(self) -> list[str]:
        row = self.store.definitions().where(F.col("ns") == self.name).first()
        return list(row.index_fields) if row is not None else []

    def index(self, now_ms: int | None = None) -> DataFrame:
        return secidx.index_rows(self.state(now_ms), self.index_fields(), strict=True)

    def by_index(self, field: str, value: str, now_ms: int | None = None, respect_ttl: bool = True) -> DataFrame:
        if field not in self.index_fields():
            return self.store.spark.createDataFrame([], "key binary")
        rows = secidx.index_rows(self.state(now_ms, respect_ttl=respect_ttl), [field], strict=True)
        return secidx.by_index(rows, field, value).select("key").orderBy("key")

    def _record(self, tag: int, key: bytes, value: bytes = b"", expires_at: int = 0, op_list=None) -> int:
        seq, me = self.head() + 1, self.store.replica
        row = (self.name, seq, tag, key, self.store.hlc(), me, me, value, expires_at, op_list)
        df = self.store.spark.createDataFrame([row], LOG)
        df.write.mode("append").partitionBy("ns").parquet(f"{self.store.path}/log")
        return seq

    def used(self) -> int:
        """Value bytes ever put here; deletes give nothing back."""
        return ops.explode_batches(self.log()).where(F.col("tag") != DEL).agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]

    def _check(self, values: list[bytes], quota: int | None) -> None:
        """Schema and quota of values that are written together."""
        if schema := self.schema():
            check = jsonschema.compile_schema(json.loads(schema))
            for value in values:
                try:
                    bad = check(json.loads(value.decode(errors="replace")), "$")
                except ValueError:
                    bad = "$: not JSON"
                if bad:
                    raise SchemaViolation(bad)
        if quota is not None and self.used() + sum(map(len, values)) > quota:
            raise QuotaExceeded(self.name)

    def put(self, key: bytes, value: bytes, ttl: int | None = None, quota: int | None = None) -> int:
        self._check([value], quota)
        expires = self.store.now() + ttl * 1000 if ttl else 0
        return self._record(PUT_TTL if expires else PUT, key, value, expires)

    def delete(self, key: bytes) -> int:
        return self._record(DEL, key)

    def put_batch(self, operations: list[tuple], quota: int | None = None) -> int:
        """One record for several operations (op, key, value, expires_at), applied in order; all of
        them or none. `batch` judges them one by one."""
        if not operations:
            raise EmptyBatch
        size = sum(93 + len(key) + len(value) if op != "del" else 85 + len(key) for op, key, value, _ in operations)
        if len(operations) > batches.MOST_OPS or size > batches.MOST_RECORD:
            raise BatchTooLarge(len(operations))
        self._check([value for op, _, value, _ in operations if op != "del"], quota)
        me = self.store.replica
        rows = [
            (DEL if op == "del" else PUT_TTL if expires else PUT, key, self.store.hlc(), me, me, value, expires)
            for op, key, value, expires in operations
        ]
        return self._record(BATCH, b"", b"", 0, rows)

    def batch(self, request: list[dict], quota: int | None = None, now_ms: int | None = None) -> list[dict]:
        """A request of operations {op, key, value_b64, ttl}: sound writes within the quota become one
        record, each failing operation fails alone, gets see the store after the record, and results
        come in the order of the request. At most MOST_OPS operations."""
        if not request:
            raise EmptyBatch
        if len(request) > batches.MOST_OPS:
            raise BatchTooLarge(len(request))
        spark, ns = self.store.spark, F.lit(self.name).alias("ns")
        rows = [(i, *(x if isinstance(x := r.get(c), str) else None for c in ("op", "key", "value_b64"))) for i, r in enumerate(request)]
        ops_in = spark.createDataFrame(rows, "idx long, op string, key string, value_b64 string").select(ns, "*")
        if batches.size_estimate(ops_in).first().bytes > batches.MOST_RECORD:
            raise BatchTooLarge("too many bytes")
        text = codec.text(codec.base64_bytes(F.col("value_b64")))
        schema = self.schema()
        error = jsonschema.error(text, schema) if schema else F.lit(None).cast("string")
        judged = batches.validated(ops_in.withColumn("schema_error", F.when(F.col("op") == "put", error)))
        if quota is not None:
            puts = judged.where("op = 'put' and error is null")
            cost = puts.select("ns", "idx", F.octet_length("value").cast("long").alias("cost"), F.lit(self.used()).alias("used"))
            said = f"quota exceeded for {self.name} (limit {quota} bytes)"
            refused = batches.quota(cost, quota).where("not ok").select("ns", "idx", F.lit(said).alias("over"))
            judged = judged.join(refused, ["ns", "idx"], "left").withColumn("error", F.coalesce("error", "over")).drop("over")
        judged = judged.persist()
        now = now_ms if now_ms is not None else self.store.now()
        seq, writes = 0, judged.where("error is null and op in ('put', 'del')").orderBy("idx").collect()
        if writes:
            me, sub = self.store.replica, []
            for r in writes:
                ttl = request[r.idx].get("ttl") if r.op == "put" else None
                expires = now + ttl * 1000 if isinstance(ttl, int) and ttl > 0 else 0
                tag = DEL if r.op == "del" else PUT_TTL if expires else PUT
                sub.append((tag, r.key.encode(), self.store.hlc(), me, me, bytes(r.value) if r.op == "put" else b"", expires))
            seq = self._record(BATCH, b"", b"", 0, sub)
        keys = [r.key.encode() for r in judged.where("error is null and op = 'get'").select("key").distinct().collect()]
        state = self.of_keys(keys, now).withColumn("key", F.col("key").cast("string")) if keys else self.state(now).limit(0).withColumn("key", F.lit(""))
        out = batches.results(judged, state, seq).orderBy("idx").collect()
        judged.unpersist()
        return [
            {"ok": False, "error": r.error} if r.error is not None else {"ok": True, "value_b64": r.value_b64} if r.op == "get" else {"ok": True, "seq": r.seq}
            for r in out
        ]

    def set_schema(self, schema_json: str) -> int:
        jsonschema.check_supported(schema_json)
        return self._record(SCHEMA, b"", schema_json.encode())

    def clear_schema(self) -> int:
        return self._record(SCHEMA, b"", b"")

    def index_create(self, *fields: str) -> int:
        kept = list(dict.fromkeys(f for f in fields if f))
        return self._record(INDEX, b"", json.dumps(kept).encode())

    def index_drop(self) -> int:
        return self._record(INDEX, b"", b"")

    def checkpoint(self, path: str) -> None:
        """A snapshot of what later reads need, tombstones included, with the namespace's definitions."""
        compact.checkpoint(self.ops(), f"{path.rstrip('/')}/ops", self.policy, self.store.mode)
        self.store.definitions().where(F.col("ns") == self.name).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/definitions")

    def state_from(self, path: str, since: int, now_ms: int | None = None) -> DataFrame:
        """The state from a checkpoint and the records after `since`, the head when it was made."""
        snapshot = self.store.spark.read.parquet(f"{path.rstrip('/')}/ops")
        tail = ops.explode_batches(self.log().where(F.col("seq") > since))
        return fold.state(compact.with_tail(snapshot, tail), self._now(now_ms, True), self.policy, self.store.mode)

    def compacted(self, now_ms: int | None = None) -> DataFrame:
        """The records a compaction would keep, renumbered."""
        now = now_ms if now_ms is not None else self.store.now()
        return compact.compacted(self.ops(), now, self.policy, self.store.mode)
