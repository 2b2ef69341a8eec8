"""Content-addressed identities and keyed hashes, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_id(source_id: Column, heading_path: Column, text: Column) -> Column:
    """First 16 hex digits of SHA-256 over the three parts, separated by NUL."""
    return F.substring(F.sha2(F.concat_ws("\x00", source_id, heading_path, text), 256), 1, 16)


def change_key(etag: Column, raw: Column) -> Column:
    """The etag, or else a digest of the body, or else empty: taken as changed."""
    return F.coalesce(F.nullif(etag, F.lit("")), F.substring(F.sha2(raw, 256), 1, 16), F.lit(""))


def content_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 16)


def block_id(name: Column, page: Column, kind: Column, number: Column) -> Column:
    return F.concat_ws("::", name, page.cast("string"), kind, F.lpad(number.cast("string"), 3, "0"))


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex HMAC-SHA256 by its definition; the key is a constant of the plan."""
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def user_hash(salt: str, user_id: Column) -> Column:
    return F.substring(hmac_sha256(salt, user_id), 1, 16)


def webhook_signature(secret: str, body: Column) -> Column:
    return F.concat(F.lit("sha256="), hmac_sha256(secret, body))
