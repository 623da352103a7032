"""Opaque cursors over event ids: a version mark and the id in a shuffled base-36 alphabet with a check digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX, LEAST = "v1:", 6
_DIGITS = "q7m2x9kd4tzr0bvn5jw8hc1sgy6pfl3aoeui"
_PRIME, _MASK = 0x5DEECE66D, (1 << 63) - 1


class CursorError(ValueError):
    """A text that is no cursor."""


def encode(event_id: int) -> str:
    if isinstance(event_id, bool) or not isinstance(event_id, int) or not 0 <= event_id <= _MASK:
        raise CursorError(f"no event id: {event_id!r}")
    n, out = event_id, ""
    while n or len(out) < LEAST - 1:
        n, d = divmod(n, 36)
        out += _DIGITS[d]
    return PREFIX + out + _DIGITS[event_id * _PRIME % 35]


def decode(cursor: str) -> int:
    body = cursor.removeprefix(PREFIX) if isinstance(cursor, str) and cursor.startswith(PREFIX) else ""
    if len(body) < LEAST or any(c not in _DIGITS for c in body):
        raise CursorError(f"no cursor: {cursor!r}")
    event_id = sum(_DIGITS.index(c) * 36**k for k, c in enumerate(body[:-1]))
    if event_id > _MASK or encode(event_id) != cursor:
        raise CursorError(f"no cursor: {cursor!r}")
    return event_id


_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Digits that always fit 64 bits, and the most that an id can have.
_SAFE, _MOST = 12, 13


def encode_column(event_id: Column) -> Column:
    """``encode`` of a column; null for what is no event id."""
    n = event_id.cast("long")
    digits = F.reverse(F.conv(n.cast("string"), 10, 36))
    digits = F.when(F.length(digits) < LEAST - 1, F.rpad(digits, LEAST - 1, "0")).otherwise(digits)  # rpad alone would cut
    body = F.translate(digits, _PLAIN, _DIGITS)
    check = F.substr(F.lit(_DIGITS), ((n % 35) * (_PRIME % 35) % 35 + 1).cast("int"), F.lit(1))
    return F.when(n >= 0, F.concat(F.lit(PREFIX), body, check))


def decode_column(cursor: Column) -> Column:
    """``decode`` of a column; null for what is no cursor."""
    shape = f"^{PREFIX}[{_DIGITS}]{{{LEAST},{_MOST + 1}}}$"
    body = F.translate(F.substr(cursor, F.lit(len(PREFIX) + 1), F.length(cursor) - len(PREFIX) - 1), _DIGITS, _PLAIN)
    low = F.conv(F.reverse(F.substr(body, F.lit(1), F.lit(_SAFE))), 36, 10).cast("decimal(38,0)")
    high = F.position(F.substr(body, F.lit(_MOST), F.lit(1)), F.lit(_PLAIN)) - 1
    value = low + F.when(F.length(body) == _MOST, high).otherwise(0).cast("decimal(38,0)") * F.lit(36**_SAFE).cast("decimal(38,0)")
    event_id = F.when(value <= F.lit(_MASK).cast("decimal(38,0)"), value).cast("long")
    return F.when(cursor.rlike(shape), F.when(encode_column(event_id) == cursor, event_id))
