"""Keyed digests of records."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def signature(fields: dict[str, Column], key: bytes) -> Column:
    """HMAC-SHA256, in hex, of the fields' names and values in the order of their names; a null value is empty.

    Two nested SHA-256 over the padded key, so it stays within built-in functions.  The key is a literal of the plan.
    """
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    message = F.concat(*(x for name in sorted(fields) for x in (F.lit(name), F.coalesce(fields[name].cast("string"), F.lit("")))))
    digest = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)
