"""Column functions over item links and web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from obscat.functions import fixed
from obscat.functions.text import col


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescape(value: Column) -> Column:
    """Percent-decoding that leaves ``+`` and broken sequences as they are."""
    decode = lambda v: F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v)
    return once(value, lambda v: F.when(v.contains("%"), decode(v)).otherwise(v))


def escape(value: Column) -> Column:
    """Percent-encoding of everything but unreserved characters."""
    out = F.url_encode(value)
    for found, wanted in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def _name(pair: Column) -> Column:
    return F.substring_index(pair, "=", 1)


def _value(pair: Column) -> Column:
    at = F.instr(pair, "=")
    return F.when(at > 0, F.substr(pair, at + 1)).otherwise(F.when(pair.isNotNull(), ""))


def _parameter(link: Column | str, name: str, value: str = "[^&#]*") -> Column:
    """Raw value of the first parameter ``name`` of a link whose value fits."""
    pattern = rf"(?i)^\s*magnet:[^?#]*\?(?:[^&#]*&)*?{name}=({value})(?:[&#]|\s*$)"
    return F.nullif(F.regexp_extract(col(link), pattern, 1), F.lit(""))


def normalize_hash(raw: Column | str) -> Column:
    """Lower-case hex of a 40/64 hex or 32/52 base-32 hash, NULL for anything else."""
    value = F.trim(col(raw))
    is_hex = value.rlike("^(?:[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$")
    return F.when(is_hex, F.lower(value)).otherwise(once(value, _from_base32))


def _from_base32(value: Column) -> Column:
    digits = F.translate(F.upper(value), fixed.BASE32_FROM, fixed.BASE32_TO)
    is_base32 = value.rlike("^(?i:[A-Z2-7]{32}|[A-Z2-7]{52})$")
    return F.when(is_base32, once(digits, _hex_of_base32))


def _hex_of_base32(digits: Column) -> Column:
    """Hex of base-32 digits, forty bits at a time."""

    def chunk(start: int, size: int, hexes: int) -> Column:
        return F.lpad(F.conv(F.substring(digits, start, size), 32, 16), hexes, "0")

    whole = lambda n: F.concat(*[chunk(1 + 8 * i, 8, 10) for i in range(n)])
    # 52 digits carry 260 bits; the last four bits are padding.
    tail = F.substring(chunk(49, 4, 5), 1, 4)
    return F.lower(F.when(F.length(digits) == 32, whole(4)).otherwise(F.concat(whole(6), tail)))


def link_hash(link: Column | str) -> Column:
    """Normalised hash named by the first recognised ``xt`` parameter.

    A link that starts with a hex topic, the usual form, is read by one pattern.
    """
    usual = F.nullif(F.regexp_extract(col(link), r"^magnet:\?xt=urn:btih:([0-9A-Fa-f]{40})(?:[&#]|$)", 1), F.lit(""))
    topic = unescape(_parameter(link, "xt", fixed.HASH_TOPIC_PATTERN))
    other = normalize_hash(F.regexp_replace(topic, fixed.HASH_PREFIX_PATTERN, ""))
    return F.coalesce(F.lower(usual), other)


def is_safe_announce(url: Column) -> Column:
    """Absolute URL without a sensitive query parameter; a query is only looked for where there is a question mark."""
    text = F.trim(url)
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    unsafe = F.exists(
        F.split(query, "&"), lambda p: p.contains("=") & _name(p).rlike(fixed.SENSITIVE_PARAMETER)
    )
    return text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:.") & ~(text.contains("?") & unsafe)


def announce_urls(link: Column | str) -> Column:
    """Safe announce URLs of a link, in order."""
    query = F.regexp_extract(F.trim(col(link)), r"(?i)^magnet:[^?#]*\?([^#]*)", 1)
    values = F.transform(F.regexp_extract_all(query, F.lit("(?i)(?:^|&)tr=([^&]*)"), 1), unescape)
    named = col(link).rlike(r"(?i)[?&]tr=")
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(named, F.filter(values, is_safe_announce)), empty)


def display_name(link: Column | str) -> Column:
    """Value of the first ``dn`` parameter."""
    return F.when(F.lower(col(link)).contains("dn="), unescape(_parameter(link, "dn")))


def canonical_link(hash_: Column | str) -> Column:
    h = col(hash_)
    return F.concat(
        F.when(F.length(h) == 64, fixed.LINK_V2).otherwise(F.lit(fixed.LINK_V1)), h
    )


def build_link(hash_: Column | str, announce: Column | str) -> Column:
    """Canonical link with the distinct safe announce URLs in order."""
    return _with_announce(hash_, F.filter(col(announce), is_safe_announce))


def rebuilt_link(hash_: Column | str, link: Column | str) -> Column:
    """Canonical link with the distinct safe announce URLs of another link, in order."""
    return _with_announce(hash_, announce_urls(link))


def _with_announce(hash_: Column | str, safe: Column) -> Column:
    # the URLs are named once: nothing keeps their value between two mentions
    urls = F.sort_array(F.array_distinct(F.transform(safe, lambda u: F.trim(u))))
    tail = F.array_join(F.transform(urls, lambda u: F.concat(F.lit("&tr="), escape(u))), "")
    return F.concat(canonical_link(hash_), F.coalesce(tail, F.lit("")))


def sanitize_link(link: Column | str) -> Column:
    """Link without sensitive parameters and unsafe announce URLs; other text unchanged."""
    text = col(link)

    def keep(part: Column) -> Column:
        name = unescape(_name(part))
        unsafe = (F.lower(name) == "tr") & ~is_safe_announce(unescape(_value(part)))
        return (part != "") & ~name.rlike(fixed.SENSITIVE_PARAMETER) & ~unsafe

    parts = F.filter(F.split(F.substring(text, 9, 2**31 - 1), "&"), keep)
    cleaned = F.concat(F.lit("magnet:?"), F.array_join(parts, "&"))
    return F.when(text.rlike(r"(?i)^magnet:\?"), cleaned).otherwise(text)


def identity_error(link: Column | str, explicit: Column | str) -> Column:
    """Why link and explicit hash do not identify an item; NULL when they do."""
    blank = lambda v: v.isNull() | (F.trim(v) == "")

    def compare(h: Column) -> Column:
        return (
            F.when(h["found"].isNull(), "invalid_magnet")
            .when(~blank(h["raw"]) & h["stated"].isNull(), "invalid_hash")
            .when(~blank(h["raw"]) & (h["stated"] != h["found"]), "hash_mismatch")
        )

    hashes = F.struct(
        link_hash(link).alias("found"), normalize_hash(explicit).alias("stated"),
        col(explicit).alias("raw"),
    )
    return F.when(blank(col(link)), "missing_magnet").otherwise(once(hashes, compare))


def html_decode(value: Column) -> Column:
    """The entities that occur in attribute values."""
    out = value
    for entity, text in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(text))
    return out


def resolve_url(raw: Column | str, base: Column | str) -> Column:
    """Address of ``raw`` seen from page ``base``."""
    value, page = F.trim(html_decode(col(raw))), col(base)
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(page, r"[?#].*$", "")
    folder = F.when(bare.rlike(r"^[^:]+://[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(
        F.regexp_replace(bare, r"[^/]*$", "")
    )
    return (
        F.when(value.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), value)
        .when(value.startswith("//"), F.concat(scheme, F.lit(":"), value))
        .when(value.startswith("/"), F.concat(origin, value))
        .when(value.startswith("?"), F.concat(bare, value))
        .when(value.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), value))
        .otherwise(F.concat(folder, value))
    )


def _escape_outside_ascii(text: Column) -> Column:
    each = F.transform(
        F.split(text, ""),
        lambda c: F.when(c.rlike(r"^[\x21-\x7E]$") | (c == ""), c).otherwise(escape(c)),
    )
    return F.when(text.rlike(r"[^\x21-\x7E]"), F.array_join(each, "")).otherwise(text)


def _url_parts(url: Column) -> tuple[Column, Column, Column, Column]:
    pattern = r"(?is)^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    scheme, host, path, query = (F.regexp_extract(url, pattern, g) for g in (1, 2, 3, 4))
    host = F.lower(host)
    host = F.when(F.lower(scheme) == "http", F.regexp_replace(host, ":80$", "")).otherwise(
        F.regexp_replace(host, ":443$", "")
    )
    path = F.when(path == "", "/").otherwise(_escape_outside_ascii(path))
    return F.lower(scheme), host, path, query


def _usable(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[^/?#@]+(?:[/?#]|$)")


def _assemble(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    tail = F.when(query != "", F.concat(F.lit("?"), _escape_outside_ascii(query))).otherwise(F.lit(""))
    return F.concat(scheme, F.lit("://"), host, path, tail)


def safe_url(raw: Column | str, base: Column | str) -> Column:
    """Absolute http(s) URL without fragment; NULL with user info or a sensitive query."""
    url = resolve_url(raw, base)
    scheme, host, path, query = _url_parts(url)
    sensitive = query.rlike(fixed.SENSITIVE_QUERY)
    return F.when(
        (F.trim(col(raw)) != "") & _usable(url) & ~sensitive, _assemble(scheme, host, path, query)
    )


def stripped_url(raw: Column | str, base: Column | str) -> Column:
    """Like :func:`safe_url`, but sensitive query parameters are cut out instead."""
    url = resolve_url(raw, base)
    scheme, host, path, query = _url_parts(url)
    kept = F.array_join(
        F.filter(
            F.split(query, "&"),
            lambda p: (p != "") & ~unescape(_name(p)).rlike(fixed.STRIPPED_QUERY_KEY),
        ),
        "&",
    )
    has_sensitive = query.rlike(
        r"(?i)(?:^|&)(?:passkey|token|auth|authorization|cookie|session|password|user)="
    )
    return F.when(
        (F.trim(col(raw)) != "") & _usable(url),
        _assemble(scheme, host, path, F.when(has_sensitive, kept).otherwise(query)),
    )


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"(?i)^[a-z][a-z0-9+.\-]*://([^/?#:]*)", 1))


def sanitize_value(value: Column) -> Column:
    """Payload text with links and http(s) query strings cleaned."""
    query = F.regexp_extract(value, r"(?is)^https?://[^/?#]*[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    kept = F.filter(parts, lambda p: ~_name(p).rlike(fixed.SENSITIVE_KEY))
    scheme, host, path, _ = _url_parts(value)
    web = value.rlike("(?i)^https?://") & (query != "") & (F.size(kept) < F.size(parts))
    return (
        F.when(value.rlike("(?i)^magnet:"), sanitize_link(value))
        .when(web, _assemble(scheme, host, path, F.array_join(kept, "&")))
        .otherwise(value)
    )


def sanitize_map(payload: Column | str) -> Column:
    """Payload map with sensitive keys set to NULL and the other values cleaned."""
    return F.transform_values(
        col(payload),
        lambda k, v: F.when(k.rlike(fixed.SENSITIVE_KEY), F.lit(None).cast("string")).otherwise(
            sanitize_value(v)
        ),
    )
