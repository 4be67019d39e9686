"""Capabilities as tables: scopes, permissions, revocations and set-based authorization.

caps: issuer, subject, host, tier, ns, prefix (null: all), perms (bits), expiry (null: never), nonce.
Signatures are not verified here: pass only rows whose signature has been checked, or a `verified`
column to filter on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READ, WRITE, ADMIN = 1, 2, 4
NAMES = {"read": READ, "write": WRITE, "admin": ADMIN}


def perm_bits(names: list[str]) -> int:
    return sum({NAMES[n] for n in names})


def perm_names(bits: int) -> list[str]:
    return [n for n, b in NAMES.items() if bits & b]


def contains(held: Column, wanted: Column) -> Column:
    return held.bitwiseAND(wanted) == wanted


def covers_prefix(held: Column, wanted: Column) -> Column:
    """Bounded by segments: `a` covers `a` and `a/b`, not `ab`; null covers all and is covered by
    null alone."""
    return held.isNull() | (held == wanted) | F.coalesce(wanted.startswith(F.concat(held, F.lit("/"))), F.lit(False))


def request_prefix(key: Column) -> Column:
    """The folder part of a key, null at the top."""
    folder = F.regexp_extract(F.ltrim(key, F.lit("/")), "^(.+)/[^/]*$", 1)
    return F.nullif(folder, F.lit(""))


def scope_parts(url: Column) -> Column:
    """host, tier, ns and prefix of a scope URL."""
    part = lambda i: F.nullif(F.regexp_extract(url, "^[a-z]+://([^/]+)/(l[123])/((?:u/[0-9a-fA-F]{64})|[^/]+)(?:/(.+))?$", i), F.lit(""))
    return F.struct(*[part(i).alias(n) for i, n in enumerate(("host", "tier", "ns", "prefix"), 1)])


def valid_caps(caps: DataFrame, keyring: DataFrame, revocations: DataFrame, now_ms: int) -> DataFrame:
    """Capabilities by a trusted issuer that have neither expired nor been revoked."""
    live = caps.join(keyring.select("issuer"), "issuer", "left_semi").where(F.col("expiry").isNull() | (F.col("expiry") > now_ms))
    return not_revoked(live, revocations)


def not_revoked(caps: DataFrame, revocations: DataFrame) -> DataFrame:
    """Revoked are a nonce, or a subject in a scope. Two equi joins instead of one with `or`."""
    nonces = revocations.where("nonce is not null").select("nonce").distinct()
    scopes = revocations.where("nonce is null").select(
        *[F.col(c).alias(f"r_{c}") for c in ("host", "tier", "ns", "prefix", "subject")]
    )
    same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in ("host", "tier", "ns", "prefix", "subject")]
    return caps.join(nonces, "nonce", "left_anti").join(scopes, same, "left_anti")


def authorized(requests: DataFrame, caps: DataFrame) -> DataFrame:
    """Requests (principal, host, tier, ns, prefix, perms) that some capability allows.

    Host, tier, namespace and subject are equi keys; only the prefix is compared within them. Tier l1
    needs namespace `*` and admin; tier l3 also needs the namespace of the subject itself.
    """
    c = caps.select(*[F.col(x).alias(f"c_{x}") for x in ("subject", "host", "tier", "ns", "prefix", "perms")])
    wanted_ns = F.when(F.col("tier") == "l1", F.lit("*")).otherwise(F.col("ns"))
    wanted = F.when(F.col("tier") == "l1", F.lit(ADMIN)).otherwise(F.col("perms"))
    on = (
        (F.col("principal") == F.col("c_subject")) & (F.col("host") == F.col("c_host")) & (F.col("tier") == F.col("c_tier"))
        & (wanted_ns == F.col("c_ns")) & contains(F.col("c_perms"), wanted)
        & covers_prefix(F.col("c_prefix"), F.col("prefix"))
        & ((F.col("tier") != "l3") | (F.col("ns") == F.concat(F.lit("u/"), F.col("principal"))))
    )
    return requests.join(c, on, "left_semi")


def rotate(keyring: DataFrame, new_issuer: str, drop_old: bool) -> DataFrame:
    """The keyring after a rotation; the old keys stay trusted unless dropped."""
    new = keyring.sparkSession.createDataFrame([(new_issuer,)], "issuer string")
    return new if drop_old else keyring.select("issuer").union(new).distinct()


def peer_access(hellos: DataFrame, peers: DataFrame) -> DataFrame:
    """Adds access: Full for the pin of any known peer, HelloOnly for a known peer that has no pin yet,
    else Deny. The pin is what the connection has proved; the name is only what we dialled."""
    pins = peers.where("pin <> ''").select(F.col("pin").alias("offered_pin"), F.lit(True).alias("_pinned")).distinct()
    open_names = peers.where("coalesce(pin, '') = ''").select("name", F.lit(True).alias("_open")).distinct()
    both = hellos.join(pins, "offered_pin", "left").join(open_names, "name", "left")
    access = F.when(F.col("_pinned"), "Full").when(F.col("_open"), "HelloOnly").otherwise("Deny")
    return both.select(*hellos.columns, access.alias("access"))


def scope_url(host: str, tier: str, ns: str, prefix: str | None = None, scheme: str = "kv") -> str:
    """The URL that scope_parts takes apart."""
    return f"{scheme}://{host}/{tier}/{ns}" + (f"/{prefix}" if prefix is not None else "")


def scan_allowed(prefix: str, held: str | None) -> bool:
    """Whether a capability for `held` (None: all) covers a scan of `prefix`: the scanned prefix itself
    must lie within the capability's segment."""
    return held is None or prefix == held or prefix.startswith(f"{held}/")
