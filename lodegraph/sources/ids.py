"""Identifiers and signatures: SHA-256 names in base32 text, and Ed25519 over domain-separated messages."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "pub:sha2-256:"
#: Fixed values of the message form and of base32.
DOMAIN = "pub/v1/sig"
ALPHABET = "abcdefghijklmnopqrstuvwxyz234567"


def cid_of(data: bytes) -> str:
    return PREFIX + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=").lower()


def cid(data: Column) -> Column:
    """The identifier of bytes, by built-in functions: each 40 bits of the digest give eight letters."""
    digits = F.concat(F.sha2(data, 256), F.lit("000000"))  # 280 bits: 7 groups of 40
    letters = []
    for i in range(52):
        bit = i * 5
        piece = F.conv(F.substring(digits, bit // 4 + 1, 3), 16, 10).cast("int")  # 12 bits from the digit that holds the first bit
        letters.append(F.substring(F.lit(ALPHABET), (F.shiftright(piece, 7 - bit % 4).bitwiseAND(F.lit(31)) + 1), F.lit(1)))
    return F.concat(F.lit(PREFIX), *letters)


def digest_of(name: str) -> bytes:
    """The digest that an identifier names; ValueError if it isn't one."""
    if not name.startswith("pub:"):
        raise ValueError("MissingScheme")
    parts = name.split(":")
    if len(parts) != 3 or not parts[2]:
        raise ValueError("Malformed")
    if parts[1] != "sha2-256":
        raise ValueError("UnknownAlgorithm")
    text = parts[2]
    if any(c not in ALPHABET for c in text):
        raise ValueError("InvalidDigest")
    bits = "".join(f"{ALPHABET.index(c):05b}" for c in text)
    size = len(bits) // 8
    if len(bits) - size * 8 >= 5 or "1" in bits[size * 8 :]:
        raise ValueError("InvalidDigest")
    raw = int(bits[: size * 8] or "0", 2).to_bytes(size, "big")
    if size != 32:
        raise ValueError("WrongDigestLength")
    return raw


def message(purpose: str, data: bytes) -> bytes:
    if "\0" in purpose:
        raise ValueError("a purpose can't hold NUL")
    return DOMAIN.encode() + b"\0" + purpose.encode() + b"\0" + data


# Ed25519 after RFC 8032, on Python's integers; points in extended coordinates.

_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, _P - 2, _P) % _P
_ROOT = pow(2, (_P - 1) // 4, _P)


def _add(a: tuple, b: tuple) -> tuple:
    x = (a[1] - a[0]) * (b[1] - b[0]) % _P
    y = (a[1] + a[0]) * (b[1] + b[0]) % _P
    t, z = 2 * a[3] * b[3] * _D % _P, 2 * a[2] * b[2] % _P
    e, f, g, h = y - x, z - t, z + t, y + x
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(n: int, point: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, point)
        point, n = _add(point, point), n >> 1
    return out


def _x_of(y: int, odd: int) -> int | None:
    if y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, _P - 2, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if x * x % _P != square:
        x = x * _ROOT % _P
    if x * x % _P != square or (not x and odd):
        return None
    return _P - x if x & 1 != odd else x


def _point(raw: bytes) -> tuple | None:
    y = int.from_bytes(raw, "little")
    x = _x_of(y & (1 << 255) - 1, y >> 255)
    y &= (1 << 255) - 1
    return None if x is None else (x, y, 1, x * y % _P)


def _packed(a: tuple) -> bytes:
    inverse = pow(a[2], _P - 2, _P)
    x, y = a[0] * inverse % _P, a[1] * inverse % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


_BASE_Y = 4 * pow(5, _P - 2, _P) % _P
_BASE = (_x_of(_BASE_Y, 0), _BASE_Y, 1, _x_of(_BASE_Y, 0) * _BASE_Y % _P)


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def _order(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % _L


def verifying_key(seed: bytes) -> bytes:
    return _packed(_times(_secret(seed)[0], _BASE))


def sign(seed: bytes, purpose: str, data: bytes) -> bytes:
    a, prefix = _secret(seed)
    own, text = verifying_key(seed), message(purpose, data)
    r = _order(prefix, text)
    point = _packed(_times(r, _BASE))
    return point + ((r + _order(point, own, text) * a) % _L).to_bytes(32, "little")


def verify(alg: str, key: bytes, signature: bytes, purpose: str, expected: str, data: bytes) -> bool:
    """Whether a signature was made for the purpose expected, by the key, over the bytes."""
    if alg != "ed25519" or purpose != expected or "\0" in purpose or len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(key), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    h = _order(signature[:32], key, message(purpose, data))
    left, right = _times(s, _BASE), _add(r, _times(h, a))
    return (left[0] * right[2] - right[0] * left[2]) % _P == 0 and (left[1] * right[2] - right[1] * left[2]) % _P == 0
