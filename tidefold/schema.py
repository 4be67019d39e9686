"""Tables of the engine: the log, its operations, and the derived state."""

from __future__ import annotations

PUT, DEL, PUT_TTL, SCHEMA, INDEX, BATCH = 1, 2, 3, 4, 5, 6

OP = (
    "struct<tag:int,key:binary,hlc:bigint,replica:binary,author:binary,value:binary,expires_at:bigint>"
)
#: One row per record; a batch holds its operations in `ops` and shares one seq.
LOG = (
    "ns string, seq bigint, tag int, key binary, hlc bigint, replica binary, author binary, "
    f"value binary, expires_at bigint, ops array<{OP}>"
)
#: One row per data operation; pos is the place in its batch.
OPS = ["ns", "seq", "pos", "tag", "key", "hlc", "replica", "author", "value", "expires_at"]
STATE = ["ns", "key", "hlc", "replica", "author", "value", "seq", "pos", "expires_at"]
NAMESPACES = "ns string, policy string"
