"""Deterministic identities of chunks, documents and vector points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 4122 namespace for URLs (fixed value).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunk_id(source: Column | str, index: Column | str, text: Column | str) -> Column:
    """sha256 of source:index:text in hex."""
    return F.sha2(F.concat(_col(source), F.lit(":"), _col(index).cast("string"), F.lit(":"), _col(text)), 256)


def document_id(content: Column | str) -> Column:
    """sha256 of a file's bytes in hex."""
    return F.sha2(_col(content).cast("binary"), 256)


def point_id(name: Column | str, prefix: str = "") -> Column:
    """UUID version 5 in the URL namespace: sha1 with version and variant bits set."""
    named = F.concat(F.lit(prefix), _col(name)) if prefix else _col(name)
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), named.cast("binary")))
    high = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    variant = F.lower(F.hex(high))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )
