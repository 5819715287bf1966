"""The canonical binary form: a strict decoder that names the rule it finds broken, and the encoder.

Values are None, bool, int (down to -2^64), str, bytes, list and dict with str keys. There are no floats and no tags.
"""

from __future__ import annotations

import unicodedata

#: Limits of the form.
MOST_BYTES = 64 * 1024
MOST_DEPTH = 64
#: Rules by the name that a refusal gives.
SIZE, TRAILING, TRUNCATED, SHORTEST, DEFINITE, NO_FLOAT, KINDS, UTF8, NFC, TEXT_KEYS, SORTED, UNIQUE, DEPTH = (
    "size limit", "single top-level item", "complete items", "shortest-form integers", "no indefinite length", "no floating point", "supported item types",
    "valid UTF-8", "NFC normalization", "text map keys", "sorted map keys", "unique map keys", "nesting limit",
)


class Refused(ValueError):
    """Bytes that aren't canonical: the rule broken and where."""

    def __init__(self, rule: str, at: int):
        super().__init__(f"{rule} at byte {at}")
        self.rule, self.at = rule, at


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Refused(TRUNCATED, self.at)
        self.at += n
        return self.data[self.at - n : self.at]

    def head(self) -> tuple[int, int, int]:
        """(major type, argument, where); the argument in its shortest form."""
        start = self.at
        first = self.take(1)[0]
        major, low = first >> 5, first & 31
        if major == 7 and low == 24:
            raise Refused(SHORTEST if self.take(1)[0] < 24 else KINDS, start)
        if low < 24 or major == 7:
            return major, low, start
        if low > 27:
            raise Refused(DEFINITE if low == 31 and 2 <= major <= 5 else KINDS, start)
        width = 1 << (low - 24)
        value = int.from_bytes(self.take(width), "big")
        if value < (24 if width == 1 else 1 << (4 * width)):
            raise Refused(SHORTEST, start)
        return major, value, start

    def text(self, n: int, start: int) -> str:
        try:
            found = self.take(n).decode("utf-8")
        except UnicodeDecodeError:
            raise Refused(UTF8, start) from None
        if not unicodedata.is_normalized("NFC", found):
            raise Refused(NFC, start)
        return found

    def value(self, depth: int):
        if depth > MOST_DEPTH:
            raise Refused(DEPTH, self.at)
        major, n, start = self.head()
        if major == 0:
            return n
        if major == 1:
            return -1 - n
        if major == 2:
            return self.take(n)
        if major == 3:
            return self.text(n, start)
        if major == 4:
            return [self.value(depth + 1) for _ in range(n)]
        if major == 5:
            return self.mapping(n, depth)
        if major == 7 and n in (20, 21, 22):
            return {20: False, 21: True, 22: None}[n]
        if major == 7 and n in (25, 26, 27):
            raise Refused(NO_FLOAT, start)
        raise Refused(DEFINITE if major == 7 and n == 31 else KINDS, start)

    def mapping(self, n: int, depth: int) -> dict:
        found: dict[str, object] = {}
        last: bytes | None = None
        for _ in range(n):
            major, size, start = self.head()
            if major != 3:
                raise Refused(TEXT_KEYS, start)
            key = self.text(size, start)
            raw = key.encode()
            if last is not None and raw <= last:
                raise Refused(UNIQUE if raw == last else SORTED, start)
            last = raw
            found[key] = self.value(depth + 1)
        return found


def decode(data: bytes, limit: int = MOST_BYTES):
    """The value that canonical bytes stand for; Refused for any others."""
    if len(data) > limit:
        raise Refused(SIZE, limit)
    reader = _Reader(data)
    value = reader.value(1)
    if reader.at < len(data):
        raise Refused(TRAILING, reader.at)
    return value


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, width in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << (8 * width):
            return bytes([major << 5 | code]) + n.to_bytes(width, "big")
    raise ValueError("an integer must fit 64 bits")


def encode(value) -> bytes:
    """Canonical bytes of a value: shortest heads, keys sorted by their bytes."""
    if value is None or isinstance(value, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[value]
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, bytes):
        return _head(2, len(value)) + value
    if isinstance(value, str):
        raw = unicodedata.normalize("NFC", value).encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, list | tuple):
        return _head(4, len(value)) + b"".join(map(encode, value))
    if isinstance(value, dict):
        entries = sorted((unicodedata.normalize("NFC", k).encode(), v) for k, v in value.items())
        return _head(5, len(entries)) + b"".join(_head(3, len(k)) + k + encode(v) for k, v in entries)
    raise TypeError(f"{type(value).__name__} has no canonical form")


def projected(value):
    """A value as JSON can hold it: bytes as {"$bytes": hex}, integers beyond 64 signed bits as text."""
    if isinstance(value, bytes):
        return {"$bytes": value.hex()}
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, int):
        return value if -(1 << 63) <= value < 1 << 63 else str(value)
    if isinstance(value, list):
        return [projected(v) for v in value]
    return {k: projected(v) for k, v in value.items()}


def from_json(value, at: str = "$"):
    """A JSON value as one of this form; a float is refused with its path."""
    if isinstance(value, float):
        raise ValueError(f"{at}: no floating point")
    if isinstance(value, list):
        return [from_json(v, f"{at}[{i}]") for i, v in enumerate(value)]
    if isinstance(value, dict):
        if set(value) == {"$bytes"}:
            return bytes.fromhex(value["$bytes"])
        return {k: from_json(v, f"{at}.{k}") for k, v in value.items()}
    return value
