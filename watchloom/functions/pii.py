"""Keyed pseudonyms for personal fields, composed from built-in hash functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
DEFAULT_KEY = b"change-me-in-prod"


def _pad(key: bytes, byte: int) -> Column:
    block = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return F.unhex(F.lit(bytes(b ^ byte for b in block).hex()))


def pseudonym(col: Column | str, key: bytes = DEFAULT_KEY, length: int = 16) -> Column:
    """Leading hex digits of HMAC-SHA256(key, text); null and '' pass through."""
    text = F.col(col) if isinstance(col, str) else col
    inner = F.unhex(F.sha2(F.concat(_pad(key, 0x36), F.encode(text, "UTF-8")), 256))
    outer = F.sha2(F.concat(_pad(key, 0x5C), inner), 256)
    return F.when(text == "", text).otherwise(F.substring(outer, 1, length))
