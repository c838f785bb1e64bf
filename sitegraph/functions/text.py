"""Scalar column expressions (JVM-side, codegen friendly).

All helpers take and return ``Column`` objects; none is a Python UDF.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every Unicode White_Space character plus the
# four ASCII separators U+001C..U+001F; Java's (?U)\s covers the former.
_STRIP_RE = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"


def ustrip(c: Column) -> Column:
    """``str.strip()`` semantics (Spark's ``trim`` removes spaces only)."""
    return F.regexp_replace(c, _STRIP_RE, "")


def with_scheme(url: Column) -> Column:
    """Prepend ``https://`` unless the URL starts with ``http://``/``https://``
    (case-sensitive, so ``HTTP://x`` becomes ``https://HTTP://x``)."""
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(
        F.concat(F.lit("https://"), url)
    )


def _url_cleaned(url: Column) -> Column:
    """Leading C0 controls and spaces stripped, tab/CR/LF removed."""
    return F.regexp_replace(F.regexp_replace(url, "[\\t\\r\\n]", ""), "^[\\x00-\\x20]+", "")


def base_domain(url: Column) -> Column:
    """``scheme://netloc`` of an absolute URL (port and userinfo kept),
    cleaned like the netloc so both name the same host."""
    return F.regexp_extract(_url_cleaned(url), "^([^:/?#]+://[^/?#]*)", 1)


def url_netloc(url: Column) -> Column:
    """``urlsplit(url).netloc``: leading C0/space stripped, tab/CR/LF removed,
    optional scheme, then ``//netloc``; empty when there is none."""
    return F.regexp_extract(_url_cleaned(url), "^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)", 1)


def bad_ipv6_netloc(netloc: Column) -> Column:
    """True when the netloc has exactly one of ``[`` / ``]`` or a bracketed
    part that is not an IPv6 / IPvFuture literal (``urlparse`` raises then)."""
    has_open = netloc.contains("[")
    has_close = netloc.contains("]")
    bracket = F.regexp_extract(netloc, "\\[([^\\]]*)\\]", 1)
    ok_literal = bracket.rlike("^(?i)(?:[0-9a-f:.]*:[0-9a-f:.]*|v[0-9a-f]+\\..+)$")
    return (has_open != has_close) | (has_open & has_close & ~ok_literal)


_REFERENCE_RE = "&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31};)"


def _decoded(ref: Column) -> Column:
    """One character reference as its character; unknown names stay as they
    are, numbers that are no character become U+FFFD."""
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))], F.lit("apos"), F.lit("'"))
    body = F.regexp_replace(ref, "^&|;$", "")
    code = (F.when(body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10))
            .when(body.startswith("#"), F.substr(body, F.lit(2))).cast("long"))
    known = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    char = F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
    return F.when(body.startswith("#"), char).otherwise(F.coalesce(F.try_element_at(names, body), ref))


def html_unescape(c: Column) -> Column:
    """Decode character references in one left-to-right pass (what a decoded
    reference spells is not decoded again). Numeric references of any code
    point; names from the standard library's HTML 4 table."""
    refs = F.regexp_extract_all(c, F.lit(_REFERENCE_RE), 0)
    parts = F.zip_with(F.split(c, _REFERENCE_RE, -1), refs, lambda text, ref: F.concat(text, F.coalesce(_decoded(ref), F.lit(""))))
    return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)


def js_round(x: Column) -> Column:
    """JavaScript ``Math.round`` for non-negative values (half up)."""
    return F.floor(x + F.lit(0.5))


def epoch_micros(ts_ntz: Column) -> Column:
    """Epoch microseconds (BIGINT) of a TIMESTAMP_NTZ wall-clock value, read
    as UTC and independent of the session time zone (date and time fields of
    an NTZ value involve no zone)."""
    t = ts_ntz.cast("timestamp_ntz")
    days = F.unix_date(F.to_date(t)).cast("bigint")
    sec = F.date_part(F.lit("SECOND"), t)  # seconds with microsecond fraction
    return (days * 86_400_000_000 + F.hour(t).cast("bigint") * 3_600_000_000
            + F.minute(t).cast("bigint") * 60_000_000 + (sec * 1_000_000).cast("bigint"))


def epoch_seconds(ts_ntz: Column) -> Column:
    """Epoch seconds (DOUBLE, microsecond precision) of a TIMESTAMP_NTZ."""
    return epoch_micros(ts_ntz) / F.lit(1e6)


def now_epoch_seconds() -> Column:
    """The query's current time as epoch seconds (DOUBLE). Pass a
    literal instead when results must be reproducible."""
    return F.unix_micros(F.current_timestamp()) / F.lit(1e6)
