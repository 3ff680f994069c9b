from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from mnemospark.functions import signatures as S

hx = bytes.fromhex


def test_published_vectors():
    for seed, public, message, signature in [
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ]:
        assert S.sign_public(hx(seed)) == hx(public) and S.sign(hx(seed), hx(message)) == hx(signature) and S.verify(hx(public), hx(message), hx(signature))
    a, b = bytes(range(32)), bytes(range(7, 39))
    assert S.agree(a, S.box_public(b)) == S.agree(b, S.box_public(a))
    assert S.agree(hx("a546e36bf0527c9d3b16154b82465edd62144c0ac1fc5a18506a2244ba449ac4"), hx("e6db6867583030db3594c1a424b15f7c726624ec26b3353b10a903a6d0ab1c4c")) == hx("c3da55379de9c6908e94ea4df28d084f32eccf03491c71f754b4075577a28552")


def test_what_isnt_a_signature():
    seed = bytes(range(32))
    public, good = S.sign_public(seed), S.sign(seed, b"text")
    assert not S.verify(public, b"other", good) and not S.verify(public, b"text", good[:-1]) and not S.verify(None, b"text", good) and not S.verify(b"\xff" * 32, b"text", good)
    assert not S.verify(public, b"text", good[:32] + (int.from_bytes(good[32:], "little") + S.ORDER).to_bytes(32, "little"))
    box = S.box_public(bytes(32))
    assert S.is_bound("team", box, public, S.bind("team", box, seed)) and not S.is_bound("other", box, public, S.bind("team", box, seed))
    now = datetime(2025, 1, 1, tzinfo=UTC)
    ts = "2025-01-01T00:04:00Z"
    signed = S.sign(seed, S.request_payload("post", "/ops", ts, "{}"))
    assert S.is_request_valid(public, "POST", "/ops", ts, "{}", signed, now) and not S.is_request_valid(public, "POST", "/ops", ts, "{}", signed, now - timedelta(minutes=2))
    assert not S.is_request_valid(public, "POST", "/ops", "soon", "{}", signed, now)
    assert S.decode_invite(S.encode_invite({"team": "é", "n": 1})) == {"team": "é", "n": 1} and S.decode_invite("%%%") is None and S.decode_invite("WzFd") is None
    assert len(S.member_id(public)) == 22


def test_lockboxes_and_authors(spark):
    private = {m: bytes([i]) * 32 for i, m in enumerate("abc", 1)}
    members = spark.createDataFrame([(m, "active", bytearray(S.box_public(k)), bytearray(S.sign_public(k))) for m, k in private.items()] + [("gone", "revoked", bytearray(32), None)], "member string, status string, box_key binary, sign_key binary")
    boxes = spark.createDataFrame(S.lockboxes(members, "team", 2, b"k" * 32, "info", without="c").collect(), "member string, box binary")
    assert {r.member for r in boxes.collect()} == {"a", "b"}
    assert S.open_lockbox(boxes, "team", 2, "a", private["a"], "info") == b"k" * 32
    assert S.open_lockbox(boxes, "team", 3, "a", private["a"], "info") is None and S.open_lockbox(boxes, "team", 2, "c", private["c"], "info") is None
    rows = [("a", "x", bytearray(S.sign(private["a"], b"x"))), ("b", "x", bytearray(S.sign(private["a"], b"x"))), ("zz", "x", bytearray(64)), ("a", None, None)]
    got = S.verified(spark.createDataFrame(rows, "member string, text string, signature binary"), members, F.col("text")).collect()
    assert sorted((r.member, r.authentic) for r in got) == [("a", False), ("a", True), ("b", False), ("zz", False)]
