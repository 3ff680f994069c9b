"""Keys of members: Ed25519 signatures (RFC 8032), X25519 agreement (RFC 7748), lockboxes, signed requests, invites.

Plain Python on integers, so that workers can verify records anywhere; a verification takes a few milliseconds. Keys
are raw 32 bytes; base64 names stand where text is wanted. Signing isn't hardened against timing and is meant for batch
jobs on machines of one's own.
"""

from __future__ import annotations

import base64
import hashlib
import json
import secrets
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.replication import hkdf

# The field, the order of the base point, the curve's constant, and the base point's y.
FIELD = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
CURVE = -121665 * pow(121666, -1, FIELD) % FIELD
BASE_Y = 4 * pow(5, -1, FIELD) % FIELD
ROOT = pow(2, (FIELD - 1) // 4, FIELD)

Point = tuple[int, int, int, int]
ZERO: Point = (0, 1, 1, 0)


def _x_of(y: int, odd: int) -> int | None:
    """The x of a point by its y and parity; None if there is no such point."""
    if y >= FIELD:
        return None
    square = (y * y - 1) * pow(CURVE * y * y + 1, -1, FIELD) % FIELD
    x = pow(square, (FIELD + 3) // 8, FIELD)
    if (x * x - square) % FIELD:
        x = x * ROOT % FIELD
    if (x * x - square) % FIELD or (not x and odd):
        return None
    return FIELD - x if x & 1 != odd else x


def _add(a: Point, b: Point) -> Point:
    low, high = (a[1] - a[0]) * (b[1] - b[0]) % FIELD, (a[1] + a[0]) * (b[1] + b[0]) % FIELD
    mixed, depth = 2 * a[3] * b[3] * CURVE % FIELD, 2 * a[2] * b[2] % FIELD
    e, f, g, h = high - low, depth - mixed, depth + mixed, high + low
    return e * f % FIELD, g * h % FIELD, f * g % FIELD, e * h % FIELD


def _times(n: int, p: Point) -> Point:
    out = ZERO
    for bit in bin(n)[2:]:
        out = _add(out, out)
        if bit == "1":
            out = _add(out, p)
    return out


_X = _x_of(BASE_Y, 0)
BASE: Point = (_X, BASE_Y, 1, _X * BASE_Y % FIELD)


def _pack(p: Point) -> bytes:
    z = pow(p[2], -1, FIELD)
    return (p[1] * z % FIELD | (p[0] * z % FIELD & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes) -> Point | None:
    n = int.from_bytes(raw, "little")
    y = n & (1 << 255) - 1
    x = _x_of(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % FIELD)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def sign_public(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    """The Ed25519 signature of message."""
    scalar, prefix = _secret(seed)
    public = _pack(_times(scalar, BASE))
    r = _number(prefix, message)
    head = _pack(_times(r, BASE))
    return head + ((r + _number(head, public, message) * scalar) % ORDER).to_bytes(32, "little")


def verify(public: bytes | None, message: bytes, signature: bytes | None) -> bool:
    """True if signature is that of message by the key; False for whatever isn't a key or a signature."""
    if not public or not signature or len(public) != 32 or len(signature) != 64:
        return False
    key, head, s = _unpack(bytes(public)), _unpack(bytes(signature[:32])), int.from_bytes(signature[32:], "little")
    if key is None or head is None or s >= ORDER:
        return False
    left, right = _times(s, BASE), _add(head, _times(_number(signature[:32], public, message), key))
    return _pack(left) == _pack(right)


def agree(private: bytes, public: bytes) -> bytes:
    """X25519: the secret that two keys share."""
    k = int.from_bytes(private, "little") & (1 << 254) - 8 | 1 << 254
    u = int.from_bytes(public, "little") & (1 << 255) - 1
    a, c, b, d = 1, 0, u, 1
    swapped = 0
    for t in range(254, -1, -1):
        bit = k >> t & 1
        if swapped != bit:
            a, b, c, d = b, a, d, c
        swapped = bit
        plus, minus = a + c, a - c
        p2, m2 = plus * plus % FIELD, minus * minus % FIELD
        gap = p2 - m2
        da, cb = (b - d) * plus % FIELD, (b + d) * minus % FIELD
        b, d = (da + cb) ** 2 % FIELD, u * (da - cb) ** 2 % FIELD
        a, c = p2 * m2 % FIELD, gap * (p2 + 121665 * gap) % FIELD
    if swapped:
        a, c = b, d
    return (a * pow(c, -1, FIELD) % FIELD if c % FIELD else 0).to_bytes(32, "little")


def box_public(private: bytes) -> bytes:
    return agree(private, (9).to_bytes(32, "little"))


def member_id(public: bytes) -> str:
    """A member's id: 22 characters of the hash of the key that signs."""
    return base64.urlsafe_b64encode(hashlib.sha256(public).digest()).decode()[:22]


def bind(team: str, box: bytes, seed: bytes) -> bytes:
    """The signature that binds a member's key for lockboxes to the one that signs."""
    return sign(seed, f"{team}|bind|".encode() + box)


def is_bound(team: str, box: bytes, public: bytes, signature: bytes) -> bool:
    return verify(public, f"{team}|bind|".encode() + box, signature)


def request_payload(method: str, path: str, ts: str, body: str) -> bytes:
    inner = hashlib.sha256(body.encode()).hexdigest()
    return hashlib.sha256(f"{method.upper()}\n{path}\n{ts}\n{inner}".encode()).digest()


def is_request_valid(public: bytes, method: str, path: str, ts: str, body: str, signature: bytes, now: datetime, window_seconds: float = 300) -> bool:
    """True if the request was signed by the key for these values, at a time within the window around now."""
    try:
        at = datetime.fromisoformat(ts)
    except ValueError:
        return False
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return abs((now - at).total_seconds()) <= window_seconds and verify(public, request_payload(method, path, ts, body), signature)


def encode_invite(body: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_invite(text: str) -> dict | None:
    """What an invite holds; None if it isn't one."""
    try:
        out = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def lockboxes(members: DataFrame, team: str, generation: int, team_key: bytes, info: str, without: str | None = None) -> DataFrame:
    """member and box for each active member of members (member, status, box_key), but for one that is revoked.

    The box is the sender's public key of this box alone, then the team's key sealed for the member: nonce, text, tag.
    """

    def wrap(member: pd.Series, key: pd.Series) -> pd.DataFrame:
        rows = []
        for m, k in zip(member, key, strict=True):
            once = secrets.token_bytes(32)
            rows.append((box_public(once), hkdf(agree(once, k), team.encode(), f"{info}|g{generation}|{m}".encode())))
        return pd.DataFrame(rows, columns=["head", "wrap"])

    active = members.where((F.col("status") == "active") & F.col("box_key").isNotNull())
    active = active if without is None else active.where(F.col("member") != without)
    # Drawn once: the head and the key behind it must be of one draw.
    draw = F.pandas_udf(wrap, "struct<head: binary, wrap: binary>").asNondeterministic()
    made = active.select("member", draw("member", "box_key").alias("w"))
    aad = F.concat(F.lit(f"{team}|lockbox|g{generation}|"), F.col("member"))
    sealed = F.expr("transform(array(w), x -> named_struct('head', x.head, 'wrap', x.wrap))[0]")
    return made.select("member", sealed.alias("w"), aad.alias("aad")).select("member", F.concat("w.head", F.aes_encrypt(F.lit(bytearray(team_key)), F.col("w.wrap"), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), F.col("aad"))).alias("box"))


def open_lockbox(boxes: DataFrame, team: str, generation: int, member: str, private: bytes, info: str) -> bytes | None:
    """The team's key of a member's box; None where there is none or it isn't for this key, team and generation."""
    row = boxes.where(F.col("member") == member).select("box").first()
    if row is None:
        return None
    raw = bytes(row["box"])
    key = hkdf(agree(private, raw[:32]), team.encode(), f"{info}|g{generation}|{member}".encode())
    one = boxes.sparkSession.createDataFrame([(bytearray(raw[32:]), bytearray(key))], "b binary, k binary")
    out = one.select(F.try_aes_decrypt("b", "k", F.lit("GCM"), F.lit("DEFAULT"), F.lit(f"{team}|lockbox|g{generation}|{member}")).alias("t")).first()["t"]
    return None if out is None else bytes(out)


def verified(records: DataFrame, members: DataFrame, payload: Column) -> DataFrame:
    """records (member, signature) with authentic: the payload was signed by the key that members (member, sign_key) name.

    Records of unknown members aren't authentic. Members are few; they go with the join as its small side.
    """

    @F.pandas_udf("boolean")
    def check(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for keys, texts, signatures in batches:
            yield pd.Series([verify(k, (t or "").encode(), s) for k, t, s in zip(keys, texts, signatures, strict=True)], dtype=bool)

    known = members.select("member", F.col("sign_key").alias("__key")).dropDuplicates(["member"])
    rows = records.drop("authentic").join(known, "member", "left")
    return rows.withColumn("authentic", check(F.col("__key"), payload, F.col("signature"))).drop("__key")
