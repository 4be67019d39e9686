import pytest

from tidefold import store as st
from tidefold.admin import Admin
from tidefold.operators import compact


@pytest.fixture
def admin(spark, tmp_path):
    return Admin(st.Store(spark, f"file://{tmp_path}/s"))


def test_capabilities(spark, admin):
    admin.trust("root")
    admin.issue("root", "p", "kv://h/l2/data/a", ["read"], 1)
    admin.issue("root", "q", "kv://h/l2/data", ["read", "write"], 2)
    admin.issue("root", "r", "kv://h/l2/data", ["read"], 3, expiry=50)
    with pytest.raises(st.StoreError):
        admin.issue("root", "p", "nonsense", ["read"], 4)
    schema = "principal string, host string, tier string, ns string, prefix string, perms int"
    req = spark.createDataFrame([(p, "h", "l2", "data", "a/b", 1) for p in "pqr"], schema)
    allowed = lambda now: sorted(r.principal for r in admin.authorized(req, now).collect())
    assert allowed(10) == ["p", "q", "r"] and allowed(60) == ["p", "q"]
    admin.revoke_nonce(2)
    admin.revoke_subject("kv://h/l2/data/a", "p")
    assert allowed(10) == ["r"]
    admin.trust("next", drop_others=True)
    assert allowed(10) == [] and [r.issuer for r in admin.keyring().collect()] == ["next"]


def test_peers_and_clocks(admin):
    admin.add_peer("b", "host:1", "pin1", ["x"])
    for bad in (("b", "host:2", ""), ("c", "host:2", "pin1"), ("", "x", ""), ("d", "", "")):
        with pytest.raises(st.StoreError):
            admin.add_peer(*bad)
    admin.add_peer("c", "host:2")
    assert admin.remove_peer("b") and not admin.remove_peer("b")
    assert [r.name for r in admin.peers().collect()] == ["c"]
    compact.guard(admin.peer_clocks())
    for skew in (5, 100, 7):
        admin.record_skew("c", (1000 + skew) << 16, 1000)
    assert [tuple(r) for r in admin.peer_clocks().collect()] == [("c", 7)]
    with pytest.raises(compact.CompactionRefused):
        compact.guard(admin.peer_clocks())


def test_personal_namespace(admin):
    name = "ab" * 32
    admin.personal_namespace(name).put(b"k", b"v")
    assert admin.personal_namespace(name).get(b"k") == b"v"
