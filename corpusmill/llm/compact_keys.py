"""Keys as few bytes, so that shuffles of keys stay small; without loss, and in the order of the keys.

A digest of 32 lower-case hexadecimal digits becomes its 16 bytes. Any other key becomes '=' and its UTF-8
bytes, padded with NUL to 17 bytes or more, so that the length tells which of the two it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPACT = "case when {0} rlike '^[0-9a-f]{{32}}$' then unhex({0}) else encode(rpad(concat('=', {0}), greatest(17, length({0}) + 1), '\\0'), 'UTF-8') end"
_PLAIN = "case when length({0}) = 16 then lower(hex({0})) else substring(trim(TRAILING '\\0' FROM decode({0}, 'UTF-8')), 2) end"


def compact(key: str) -> Column:
    return F.expr(_COMPACT.format(f"cast({key} as string)"))


def plain(key: str) -> Column:
    return F.expr(_PLAIN.format(key))


def plain_list(keys: str) -> Column:
    return F.expr(f"transform({keys}, x -> {_PLAIN.format('x')})")
