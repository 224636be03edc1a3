"""Content-addressed keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_key(**fields: Column) -> Column:
    """SHA-256 of the compact JSON of the fields in alphabetical order, nulls kept."""
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def joined_key(*parts: Column, separator: str = "|") -> Column:
    """SHA-256 of the parts joined by a separator; null parts count as empty."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def cache_scope(cookie_file: Column, browser: Column) -> Column:
    """``anonymous``, or the digest of a cookie file; null (not cacheable) for cookies of a browser."""
    return F.when(browser.isNotNull(), F.lit(None)).when(cookie_file.isNull(), F.lit("anonymous")).otherwise(F.concat(F.lit("cookie-file:"), F.sha2(cookie_file, 256)))
