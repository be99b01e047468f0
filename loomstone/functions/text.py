"""Text functions over columns; all run in the JVM. Null in, null out, unless stated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"(?U)\s+"


def strip(text: Column) -> Column:
    """The text without blanks of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return strip(F.regexp_replace(text, _WS, " "))


def strip_html(html: Column) -> Column:
    """Visible text of markup: script-like blocks and tags become blanks; entities stay."""
    for block in ("script", "style", "noscript", "svg"):
        html = F.regexp_replace(html, rf"(?is)<{block}\b[^>]*>.*?</{block}\s*>", " ")
    return collapse(F.regexp_replace(html, r"(?s)<[^>]+>", " "))


def page_title(html: Column) -> Column:
    """Text of the first title element, ``''`` where there is none."""
    return strip_html(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))


def slug(text: Column, limit: int = 64, fallback: str = "item") -> Column:
    """Letters, digits, ``_`` and ``-`` of a text in lower case; ``fallback`` where nothing is left or for null."""
    dashed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9_-]+", "-")
    bare = F.substring(F.lower(F.regexp_replace(dashed, r"^-+|-+$", "")), 1, limit)
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(fallback))


def filename(prefix: str, text: Column, suffix: str) -> Column:
    """A stable name: prefix, slug and the first ten digits of the SHA-256."""
    return F.concat(F.lit(prefix + "-"), slug(text), F.lit("-"), F.substring(F.sha2(text, 256), 1, 10), F.lit(suffix))


def url_pattern(url: Column) -> Column:
    """Host and path with numbers and very long segments as ``*``: ``*host/a/*/b``; null for texts without a host."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    masked = F.transform(parts, lambda s: F.when(s.rlike(r"^[0-9]+$") | (F.length(s) > 32), "*").otherwise(s))
    whole = F.when(F.size(masked) > 0, F.concat(F.lit("*"), host, F.lit("/"), F.array_join(masked, "/"))).otherwise(F.concat(F.lit("*"), host))
    return F.when(host != "", whole)


def hostname(url: Column) -> Column:
    """Host in lower case without a trailing dot, ``''`` where there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"\.+$", ""))


def plain_key(name: object) -> str:
    """:func:`normalize_key` of a single name."""
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")


def normalize_key(key: Column) -> Column:
    """Lower case with runs of other signs as one ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(key)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


# Names of fields that hold secrets.
SENSITIVE_KEYS = (
    "authorization auth auth_header proxy_authorization cookie cookies cookie_jar credentials credential api_key apikey secret secrets "
    "client_secret password passwd token access_token refresh_token session_token csrf csrf_token xsrf xsrf_token profile browser_profile "
    "user_data_dir localstorage local_storage sessionstorage session_storage storage_state"
).split()
# Names of query parameters that hold secrets.
SENSITIVE_QUERY_KEYS = "api_key apikey key token access_token refresh_token auth authorization secret client_secret password passwd session sessionid csrf csrf_token xsrf xsrf_token".split()
# Parts of a field name that make it sensitive.
SENSITIVE_PARTS = "authorizationheader proxyauthorization cookieheader cookiejar browserprofile userdatadir localstorage sessionstorage storagestate".split()
_ENDS = "token secret password passwd".split()


def is_sensitive_key(key: Column) -> Column:
    """Whether a field name tells of a secret, whatever its case and separators."""
    name = normalize_key(key)
    compact = F.regexp_replace(name, "_", "")
    exempt = name.rlike(r"(^|_)authorization_category$")
    named = compact.isin(*sorted({k.replace("_", "") for k in SENSITIVE_KEYS}))
    return ~exempt & (named | compact.rlike(f"(?:{'|'.join(_ENDS)})$") | compact.rlike("|".join(SENSITIVE_PARTS)))


# Spellings of secrets in free text, in the order they are replaced. Where a pattern has a group, the
# group stays.
SECRETS = (
    (r"""(?is)<input\b(?=[^>]*(?:type\s*=\s*["']password["']|name\s*=\s*["'][^"']*(?:token|secret|auth|session|csrf|password|passwd)[^"']*["']))[^>]*>""", 0),
    (r"""(?i)https?://[^/\s:@<>"']+:[^@\s/<>"']+@""", 0),
    (r"""(?is)(?:local|session)Storage\.setItem\([^)]*\)""", 0),
    (r"""(?is)(?:local|session)Storage(?:\s*\[[^\]]+\]|\.[A-Za-z_$][\w$]*)\s*=\s*[^;\r\n<]+""", 0),
    (r"""(?is)<meta\b(?=[^>]*(?:name|http-equiv)\s*=\s*["'](?:authorization|proxy-authorization|cookie|api-key|auth-token|session-token|(?:csrf|xsrf)(?:[-_]?token)?)["'])[^>]*>""", 0),
    (r"""(?im)(["']?(?:authorization(?:[-_]?header)?|proxy[-_]?authorization(?:[-_]?header)?)["']?\s*[:=]\s*)[^,}\r\n]+""", 1),
    (r"""(?im)(["']?(?:set[-_]?cookie|cookie(?:[-_]?header)?)["']?\s*[:=]\s*)[^,}\r\n]+""", 1),
    (r"""(?i)(["']?(?:api[-_]?key|client[-_]?secret|access[-_]?token|refresh[-_]?token|auth[-_]?token|id[-_]?token|session[-_]?token|(?:csrf|xsrf)(?:[-_]?token)?|password|passwd)["']?\s*[:=]\s*)(?:"[^"\r\n]*"|'[^'\r\n]*'|[^,;}\r\n]+)""", 1),
    (r"""(?i)([?&](?:api[_-]?key|token|access_token|secret|password|auth)=)[^&#\s]+""", 1),
    (r"""(?i)(["']?(?:local[-_]?storage|session[-_]?storage|browser[-_]?profile|user[-_]?data[-_]?dir|storage[-_]?state)["']?\s*[:=]\s*)[^,}\r\n]+""", 1),
    (r"""(?i)(["']?(?:session[_-]?id|session[_-]?token)["']?\s*[:=]\s*)(?:"[^"\r\n]*"|'[^'\r\n]*'|[^,;}\r\n]+)""", 1),
)
REDACTED = "[REDACTED]"


def redact(text: Column) -> Column:
    """The text with secrets in known spellings replaced."""
    for pattern, groups in SECRETS:
        text = F.regexp_replace(text, pattern, ("$1" if groups else "") + REDACTED)
    return text


def sanitize_url(url: Column) -> Column:
    """An address without user name, fragment and secret parameters; ``''`` for null, other text is redacted.

    The host comes in lower case, secret parameters keep their name with the value ``[REDACTED]`` percent-encoded.
    """
    whole = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    scheme, host, path, query = (F.regexp_extract(url, whole, i) for i in range(1, 5))
    keys = "|".join(sorted({k.replace("_", "[-_]?") for k in (*SENSITIVE_QUERY_KEYS, *SENSITIVE_KEYS)}))
    hidden = F.regexp_replace(query, rf"(?i)(^|&)((?:{keys})|[^=&]*(?:{'|'.join(_ENDS)}))=[^&]*", "$1$2=%5BREDACTED%5D")
    made = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), path, F.when(hidden != "", F.concat(F.lit("?"), hidden)).otherwise(""))
    return F.when(url.isNull(), "").when(scheme != "", made).otherwise(redact(url))


def public_url(url: Column) -> Column:
    """Whether an address is http(s) on a usual port with a public host: no user name, local name or private number."""
    whole = r"(?i)^(https?)://([^/?#]*)"
    authority = F.regexp_extract(url, whole, 2)
    host = F.lower(F.regexp_replace(F.regexp_extract(authority, r"^([^:@]+)(?::(?:80|443))?$", 1), r"\.$", ""))
    private = r"^(?:0|10|127)\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^(?:22[4-9]|2[3-5][0-9])\.|^192\.0\.[02]\.|^198\.(?:1[89]|51)\.|^203\.0\.113\."
    number = host.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    good = (host != "") & ~host.rlike(r"(?:^|\.)localhost$|\.local$") & ~(number & host.rlike(private))
    return F.coalesce(good, F.lit(False))


def first_number(text: Column) -> Column:
    """The first run of digits and points as a number, null where it is none (``1,299`` gives 1)."""
    return F.regexp_extract(text, r"[0-9.]+", 0).try_cast("double")


def markdown_cell(text: Column) -> Column:
    """A table cell: one line, bars escaped; null gives ``''``."""
    return F.regexp_replace(collapse(F.coalesce(text.cast("string"), F.lit(""))), r"\|", r"\\|")


def markdown_title(text: Column, fallback: Column) -> Column:
    """The first level-one heading, else ``fallback``."""
    return F.coalesce(F.nullif(strip(F.regexp_extract(text, r"(?m)^# (.+)$", 1)), F.lit("")), fallback)


def truncate_html(html: Column, limit: int = 3000) -> Column:
    """At most ``limit`` characters with a mark that some are missing."""
    return F.when(F.length(html) > limit, F.concat(F.substring(html, 1, limit), F.lit("\n<!-- truncated -->"))).otherwise(html)


def splitlines_count(text: Column) -> Column:
    """Number of lines; a line end at the end begins no further line."""
    ends = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "[\r\x0b\x0c\x1c-\x1e\u0085  ]", "\n")
    breaks = F.length(ends) - F.length(F.replace(ends, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(breaks + F.when(ends.endswith("\n"), 0).otherwise(1)).cast("bigint")


IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"


def image_references(text: Column) -> Column:
    """Targets of the Markdown images of a text, in order."""
    return F.regexp_extract_all(text, F.lit(IMAGE), 2)


def is_remote(reference: Column) -> Column:
    """Whether an image lies elsewhere: an address or embedded data."""
    return reference.rlike(r"(?i)^(?:https?:)?//|^data:")


def rewrite_images(text: Column, folder: str) -> Column:
    """Markdown with its local images pointed at ``folder``; remote ones stay."""
    return F.regexp_replace(text, r"(!\[[^\]]*\]\()(?!https?:|//|data:)(?:[^)\s/]*/)*([^)\s/]+)", f"$1{folder}/$2")


def parse_json(text: Column) -> Column:
    """JSON text as VARIANT; null where it is not JSON, also where more follows after a value."""
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("\n,1]"))), "$", "array<variant>")
    return F.when(F.size(pair) == 2, F.try_parse_json(text))


def json_object(text: Column) -> Column:
    """The JSON object inside fenced or noisy text, from the first brace to the last; ``''`` where there is none."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(parse_json(body).isNotNull(), body).otherwise("")


def links(html: Column) -> Column:
    """Anchors of markup in order as an array of ``struct<url, title>``."""
    pattern = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"
    targets, inner = F.regexp_extract_all(html, F.lit(pattern), 1), F.regexp_extract_all(html, F.lit(pattern), 2)
    return F.transform(F.arrays_zip(targets.alias("u"), inner.alias("t")), lambda x: F.struct(x["u"].alias("url"), collapse(F.regexp_replace(x["t"], r"(?s)<[^>]+>", " ")).alias("title")))


def uuid5(name: Column, namespace: str) -> Column:
    """The name-based UUID (SHA-1) of a text in a namespace UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    nibble = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), nibble, part(18, 3), F.lit("-"), part(21, 12))


def contained_path(path: Column) -> Column:
    """Whether a relative path stays inside its folder: not absolute, no drive, and never above its start."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    state = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(1)).alias("low")))
    return F.coalesce((path != "") & ~path.rlike(r"^(?:[/\\~]|[A-Za-z]:)") & (state["low"] >= 0), F.lit(False))


def suggested_selector(text: Column, limit: int = 500) -> Column:
    """The first line of a model's answer that can be a selector, without fences, labels and quotes; ``''`` for none."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    lines = F.filter(lines, lambda x: ~strip(x).startswith("```"))
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(F.regexp_replace(strip(x), r"(?i)^(?:css|selector|css selector|answer)\s*[:=]\s*", ""), r"^[`'\"]+|[`'\"]+$", "")))
    good = F.filter(bare, lambda x: (x != "") & (F.length(x) <= limit) & x.rlike(r"^[\w\s.#\[\]='\":>+~*^$|(),-]+$") & x.rlike(r"[.#][A-Za-z_-]|\[|^[a-z][a-z0-9]*$|>"))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))
