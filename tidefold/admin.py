"""Administration tables of a store: capabilities, revocations, the keyring, peers and their clocks.

They are local to a node and never replicate. Each is a small Parquet table beside the log; changes
append rows, and the current contents are a fold of them.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import authz, feed, fold
from .store import Namespace, NamespaceExists, Store, StoreError

CAPS = (
    "issuer string, subject string, host string, tier string, ns string, prefix string, perms int, "
    "expiry long, nonce long"
)
REVOCATIONS = "nonce long, host string, tier string, ns string, prefix string, subject string"
PEERS = "name string, addr string, pin string, namespaces array<string>, removed boolean, at long"
SAMPLES = "peer string, t long, skew long"
KEYRING = "issuer string, added boolean, at long"


class Admin:
    def __init__(self, store: Store) -> None:
        self.store = store

    def _append(self, table: str, schema: str, row: tuple) -> None:
        df = self.store.spark.createDataFrame([row], schema)
        df.write.mode("append").parquet(f"{self.store.path}/admin/{table}")

    def _table(self, table: str, schema: str) -> DataFrame:
        return self.store._table(f"admin/{table}", schema)

    def caps(self) -> DataFrame:
        return self._table("caps", CAPS)

    def issue(self, issuer: str, subject: str, scope_url: str, perms: list[str], nonce: int, expiry: int | None = None) -> None:
        """Record a capability; signing it is the caller's business."""
        scope = self.store.spark.range(1).select(authz.scope_parts(F.lit(scope_url)).alias("s")).first().s
        if scope.host is None:
            raise StoreError(f"not a scope: {scope_url}")
        self._append("caps", CAPS, (issuer, subject, scope.host, scope.tier, scope.ns, scope.prefix, authz.perm_bits(perms), expiry, nonce))

    def revocations(self) -> DataFrame:
        return self._table("revocations", REVOCATIONS)

    def revoke_nonce(self, nonce: int) -> None:
        self._append("revocations", REVOCATIONS, (nonce, None, None, None, None, None))

    def revoke_subject(self, scope_url: str, subject: str) -> None:
        s = self.store.spark.range(1).select(authz.scope_parts(F.lit(scope_url)).alias("s")).first().s
        self._append("revocations", REVOCATIONS, (None, s.host, s.tier, s.ns, s.prefix, subject))

    def keyring(self) -> DataFrame:
        newest = fold.top_per_key(self._table("keyring", KEYRING), ("at",), ("issuer",))
        return newest.where("added").select("issuer")

    def trust(self, issuer: str, drop_others: bool = False) -> None:
        """Add a root key; with drop_others the keys before it lose their trust at once."""
        now = time.time_ns()
        if drop_others:
            old = self.keyring().where(F.col("issuer") != issuer)
            gone = old.withColumn("added", F.lit(False)).withColumn("at", F.lit(now))
            gone.write.mode("append").parquet(f"{self.store.path}/admin/keyring")
        self._append("keyring", KEYRING, (issuer, True, now))

    def authorized(self, requests: DataFrame, now_ms: int) -> DataFrame:
        return authz.authorized(requests, authz.valid_caps(self.caps(), self.keyring(), self.revocations(), now_ms))

    def peers(self) -> DataFrame:
        newest = fold.top_per_key(self._table("peers", PEERS), ("at",), ("name",))
        return newest.where("not removed").drop("removed", "at")

    def add_peer(self, name: str, addr: str, pin: str = "", namespaces: list[str] | None = None) -> None:
        if not name or not addr:
            raise StoreError("a peer needs a name and an address")
        taken = (F.col("name") == name) | ((F.col("pin") == pin) & F.lit(bool(pin)))
        if not self.peers().where(taken).isEmpty():
            raise StoreError(f"name or pin of {name} is taken")
        self._append("peers", PEERS, (name, addr, pin, namespaces, False, time.time_ns()))

    def remove_peer(self, name: str) -> bool:
        if self.peers().where(F.col("name") == name).isEmpty():
            return False
        self._append("peers", PEERS, (name, "", "", None, True, time.time_ns()))
        return True

    def record_skew(self, peer: str, peer_hlc: int, local_ms: int) -> None:
        self._append("skew", SAMPLES, (peer, time.time_ns(), (peer_hlc >> 16) - local_ms))

    def peer_clocks(self) -> DataFrame:
        """The latest median of each peer's last samples."""
        medians = feed.skew_median(self._table("skew", SAMPLES))
        return fold.top_per_key(medians, ("t",), ("peer",)).select("peer", F.col("skew_median").alias("skew"))

    def personal_namespace(self, principal_hex: str) -> Namespace:
        """The namespace of a principal, made on first use."""
        name = f"u/{principal_hex}"
        try:
            return self.store.create_namespace(name)
        except NamespaceExists:
            return self.store.use(name)
