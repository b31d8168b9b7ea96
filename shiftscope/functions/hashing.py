"""Deterministic sampling, digests and keyed signatures as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F


def hash_percent(value: Column) -> Column:
    """0..99 from the first 31 bits of md5, so the same value always lands on the same number."""
    head = F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("bigint")
    return head.bitwiseAND(F.lit(2147483647)) % 100


def hash_pick(value: Column, percent: int) -> Column:
    """True for about ``percent`` percent of the distinct values."""
    return hash_percent(value) < percent


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of ``body``; the two key pads are constants, everything per row runs in the JVM."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = bytearray(b ^ 0x36 for b in key)
    outer = bytearray(b ^ 0x5C for b in key)
    digest = F.sha2(F.concat(F.lit(inner), F.encode(body.cast("string"), "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(digest)), 256)
