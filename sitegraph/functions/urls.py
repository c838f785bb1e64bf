"""``urljoin(base, href)`` as a column expression.

``base`` is a site root ``scheme://netloc`` (what the link extractor joins
against). The expression follows the standard library's RFC 3986 resolution:
absolute hrefs of another scheme are returned unchanged, ``//host`` hrefs take
the base scheme, empty paths keep the base, and dot segments are removed with
``aggregate`` over the split path. No Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import url_netloc

_SCHEME_RE = "^([A-Za-z][A-Za-z0-9+.\\-]*):"


def _suffix(query: Column, fragment: Column) -> Column:
    return F.concat(
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


def _remove_dot_segments(segments: Column) -> Column:
    empty = F.array().cast("array<string>")
    resolved = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(segments, -1)
    resolved = F.when(last.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)
    joined = F.array_join(resolved, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def url_join(base: Column, href: Column) -> Column:
    """Resolve ``href`` against the site root ``base``."""
    h = F.regexp_replace(F.regexp_replace(href, "[\\t\\r\\n]", ""), "^[\\x00-\\x20]+", "")
    scheme_raw = F.regexp_extract(h, _SCHEME_RE, 1)
    has_scheme = scheme_raw != ""
    rest = F.when(has_scheme, F.substr(h, F.length(scheme_raw) + 2)).otherwise(h)

    bscheme = F.lower(F.regexp_extract(base, "^([^:]+):", 1))
    bnetloc = url_netloc(base)
    scheme = F.when(has_scheme, F.lower(scheme_raw)).otherwise(bscheme)

    fragment = F.regexp_extract(rest, "^[^#]*#(.*)$", 1)
    before_frag = F.regexp_extract(rest, "^([^#]*)", 1)

    # "//netloc..." keeps its netloc with the (base) scheme; "//" followed by
    # an empty netloc falls back to the base netloc with the rest as the path
    starts2 = before_frag.startswith("//")
    nl = F.regexp_extract(before_frag, "^//([^/?]*)", 1)
    has_netloc = starts2 & (nl != "")
    path_src = F.when(starts2 & (nl == ""), F.substr(before_frag, F.lit(3))).otherwise(before_frag)
    query = F.regexp_extract(path_src, "^[^?]*\\?(.*)$", 1)
    path = F.regexp_extract(path_src, "^([^?]*)", 1)
    nl_path = F.regexp_extract(path, "^//[^/]*(.*)$", 1)
    with_netloc = F.concat(scheme, F.lit("://"), nl, nl_path, _suffix(query, fragment))

    # empty path: base path (empty), query if given, fragment
    no_path = F.concat(scheme, F.lit("://"), bnetloc, _suffix(query, fragment))

    abs_segments = F.split(path, "/", -1)
    rel_raw = F.concat(F.array(F.lit("")), F.split(path, "/", -1))
    rel_segments = F.filter(rel_raw, lambda x, i: (i == 0) | (i == F.size(rel_raw) - 1) | (x != ""))
    segments = F.when(path.startswith("/"), abs_segments).otherwise(rel_segments)
    resolved = _remove_dot_segments(segments)
    resolved = F.when(resolved.startswith("/"), resolved).otherwise(F.concat(F.lit("/"), resolved))
    with_path = F.concat(scheme, F.lit("://"), bnetloc, resolved, _suffix(query, fragment))

    return (
        F.when(has_scheme & (F.lower(scheme_raw) != bscheme), href)
        .when(has_netloc, with_netloc)
        .when(path == "", no_path)
        .otherwise(with_path)
    )
