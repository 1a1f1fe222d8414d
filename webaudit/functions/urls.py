"""URL functions as Catalyst expressions (no Python at run time).

The functions follow the WHATWG URL rules for http(s) URLs. Host names with letters beyond ASCII
are written in Punycode, and IPv4 hosts in hexadecimal, octal or shortened form as four decimal
parts. Names are mapped by the older rules of IDNA, which write a sharp s as ss and a final sigma
as any other; labels that are longer than 63 letters in Punycode give NULL.

The JVM's encoder counts as non-deterministic for Spark, which takes such an expression in a projection
or a filter but not in a grouping, an aggregate or a join condition: make it a column first.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lets import call_sql, let, let_sql, text

# Query parameters that name a campaign, not a resource.
TRACKING_PARAM = r"(?i)^(utm_.*|gclid|fbclid|msclkid|mc_(cid|eid)|_ga|ref|referrer)$"

# ASCII characters each URL part may hold unescaped, beyond letters, digits and "*-._".
_PATH_KEEP = "!$&'()+,/:;=@[]|~%\\"
_QUERY_KEEP = "!$&()+,/:;=@[]|~?`{}^\\%"
_FRAGMENT_KEEP = "!#$&'()+,/:;=@[]|~?{}^\\%"
_PATH_UNSAFE = r"[^\x21\x24-\x3b\x3d\x40-\x5d\x5f\x61-\x7a\x7c\x7e]"
_QUERY_UNSAFE = r"[^\x21\x23-\x26\x28-\x3b\x3d\x3f-\x7e]"
_FRAGMENT_UNSAFE = r"[^\x21\x23-\x3b\x3d\x3f-\x5f\x61-\x7e]"

# scheme, userinfo, host, port, path, query, fragment of an http(s) URL.
_ABSOLUTE = (
    r"(?is)^(https?):[/\\]*(?:([^/\\?#]*)@)?(\[[^\]/\\?#]*\]|[^:/\\?#@]*)(?::([0-9]*))?"
    r"([/\\][^?#]*)?(\?[^#]*)?(#.*)?$"
)
_SEP = "\u0001"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_ORIGIN = r"(?i)^(https?://[^/?#\\]*)"
_BASE_PATH = r"(?i)^https?://[^/?#\\]*([^?#]*)"
_DOT_SEGMENT = r"(?i)/(\.|%2e){1,2}(/|$)"
_PLAIN_HOST = r"^(?!(?:.*\.)?0x[0-9a-f]*$)[a-z0-9._\-]*[a-z_\-][a-z0-9_\-]*$"
_ODD_HOST = r"""^[^\x00-\x20"#%/:<>?@\[\\\]^`{|}\x7f-\x{10FFFF}]+$"""
_BEYOND_ASCII = r"[^\x00-\x7f]"
_IPV6 = r"^\[[0-9a-f:.]*:[0-9a-f:.]*\]$"
_NUMERIC_TAIL = r"(^|\.)(\d+|0x[0-9a-f]*)\.?$"
# A URL that is already in normal form: no port, query, fragment, escape or dot segment.
_NORMAL = (
    r"^https?://[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z][a-z0-9\-]*"
    r"(?:/(?:[A-Za-z0-9_~\-][A-Za-z0-9_.~\-]*+)?)++$"
)
# A root-relative reference that needs neither escaping nor dot-segment removal.
_ROOTED = r"^(?:/[A-Za-z0-9_~,\-][A-Za-z0-9_.~,\-]*+)++/?$"


def _percent_encode(value: str, keep: str) -> str:
    """UTF-8 percent-encode everything but the always-safe characters and ``keep``."""
    out = f"replace(url_encode({value}), '+', '%20')"
    for ch in sorted(keep, key=lambda c: c == "%"):  # '%' last: it starts every escape
        out = f"replace({out}, '%{ord(ch):02X}', {text(ch)})"
    return out


def _encode_if(value: str, unsafe: str, keep: str) -> str:
    return (f"CASE WHEN {value} rlike {text(unsafe)} THEN {_percent_encode(value, keep)} "
            f"ELSE {value} END")


def _form_decode(value: str) -> str:
    """Decode one form-urlencoded token; a stray ``%`` stays literal."""
    return (f"CASE WHEN {value} rlike '[%+]' THEN "
            f"url_decode(regexp_replace({value}, '%(?![0-9A-Fa-f]{{2}})', '%25')) "
            f"ELSE {value} END")


def _form_encode(value: str) -> str:
    return (f"CASE WHEN {value} rlike {text('[^A-Za-z0-9*._-]')} THEN url_encode({value}) "
            f"ELSE {value} END")


def _query_sql(query: str) -> str:
    """Drop tracking parameters, sort by name (stable) and serialise again."""
    tokens = f"filter(split({query}, '&'), t -> t <> '')"
    pairs = (
        f"transform({tokens}, (t, i) -> struct("
        f"{_form_decode('substring_index(t, chr(61), 1)')} AS name, i AS i, "
        f"{_form_decode('substr(t, length(substring_index(t, chr(61), 1)) + 2)')} AS value))"
    )
    kept = f"filter({pairs}, q -> NOT q.name rlike {text(TRACKING_PARAM)})"
    joined = (
        f"array_join(transform(sort_array({kept}), q -> "
        f"concat({_form_encode('q.name')}, '=', {_form_encode('q.value')})), '&')"
    )
    return f"CASE WHEN {query} = '' THEN '' ELSE {joined} END"


def _path_sql(path: str) -> str:
    """Slashes forward, unsafe characters escaped, dot segments resolved."""
    empty = "CAST(array() AS ARRAY<STRING>)"
    one, two = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"
    fold = (
        f"concat(aggregate(segs, {empty}, (acc, s) -> "
        f"CASE WHEN s rlike {text(two)} THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
        f"WHEN s rlike {text(one)} THEN acc ELSE concat(acc, array(s)) END), "
        f"CASE WHEN element_at(segs, -1) rlike {text(one)} "
        f"OR element_at(segs, -1) rlike {text(two)} THEN array('') ELSE {empty} END)"
    )
    dotless = (
        f"CASE WHEN enc rlike {text(_DOT_SEGMENT)} THEN concat('/', array_join("
        f"{let_sql('segs', "split(substr(enc, 2), '/')", fold)}, '/')) "
        f"ELSE enc END"
    )
    slashed = f"replace({path}, {text(chr(92))}, '/')"
    return (
        f"CASE WHEN {path} = '' THEN '/' ELSE "
        f"{let_sql('enc', let_sql('raw', slashed, _encode_if('raw', _PATH_UNSAFE, _PATH_KEEP)), dotless)}"
        f" END"
    )


def _ascii_host_sql(host: str) -> str:
    """A host name in ASCII letters; NULL where it has none.

    The JVM's own encoder does it, for such hosts alone: an encoder spelled out as nested lambdas
    tripled the time that every URL expression takes to analyse.
    """
    return (f"CASE WHEN {host} rlike {text(_BEYOND_ASCII)} "
            f"THEN lower(try_reflect('java.net.IDN', 'toASCII', {host}, 1)) ELSE {host} END")


def _ipv4_sql(host: str) -> str:
    """Four decimal parts of a host that ends in a number, or NULL if it is no address.

    A part is hexadecimal behind 0x, octal behind 0, else decimal. The last part fills all bytes that
    the others leave.
    """
    number = (
        "CASE WHEN x rlike '^0x0*[0-9a-f]{0,8}$' THEN CAST(conv(concat('0', substr(x, 3)), 16, 10) AS BIGINT) "
        "WHEN x rlike '^0+[0-7]{0,11}$' THEN CAST(conv(x, 8, 10) AS BIGINT) "
        "WHEN x rlike '^[1-9][0-9]{0,9}$' THEN CAST(x AS BIGINT) END"
    )
    parts = f"transform(split(regexp_replace({host}, '[.]$', ''), '[.]'), x -> {number})"
    fits = ("size(a) <= 4 AND forall(a, x -> x IS NOT NULL) AND forall(slice(a, 1, size(a) - 1), x -> x < 256) "
            "AND element_at(a, -1) < shiftleft(1L, 8 * (5 - size(a)))")
    value = ("aggregate(transform(slice(a, 1, size(a) - 1), (x, i) -> shiftleft(x, 8 * (3 - i))), "
             "element_at(a, -1), (n, x) -> n + x)")
    dotted = "concat_ws('.', n div 16777216, n div 65536 % 256, n div 256 % 256, n % 256)"
    return let_sql("a", parts, f"CASE WHEN {fits} THEN {let_sql('n', value, dotted)} END")


def _host_sql(host: str) -> str:
    """Valid lower-cased host or NULL; ``host`` is already lower case."""
    unescaped = (
        f"CASE WHEN {host} LIKE '%\\%%' THEN lower(url_decode(regexp_replace("
        f"replace({host}, '+', '%2B'), '%(?![0-9A-Fa-f]{{2}})', '%25'))) ELSE {host} END"
    )
    odd = let_sql(
        "h", let_sql("raw", unescaped, _ascii_host_sql("raw")),
        f"CASE WHEN h LIKE '[%' THEN "
        f"CASE WHEN h rlike {text(_IPV6)} THEN h END "
        f"WHEN h rlike {text(_NUMERIC_TAIL)} THEN {_ipv4_sql('h')} "
        f"WHEN h rlike {text(_ODD_HOST)} THEN h END",
    )
    return f"CASE WHEN {host} rlike {text(_PLAIN_HOST)} THEN {host} ELSE {odd} END"


def _port_sql(scheme: str, digits: str) -> str:
    """``':8080'``, ``''`` for none or default, NULL when out of range."""
    n = f"try_cast({digits} AS INT)"
    return (
        f"CASE WHEN {digits} = '' THEN '' "
        f"WHEN {n} IS NULL OR {n} > 65535 THEN NULL "
        f"WHEN ({scheme} = 'https' AND {n} = 443) OR ({scheme} = 'http' AND {n} = 80) THEN '' "
        f"ELSE concat(':', CAST({n} AS STRING)) END"
    )


def _trim_sql(value: str) -> str:
    pattern = r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]"
    return (f"CASE WHEN {value} rlike {text(pattern)} "
            f"THEN regexp_replace({value}, {text(pattern)}, '') ELSE {value} END")


def _directory_sql(path: str) -> str:
    """Everything up to and including the last slash of a path."""
    return (f"CASE WHEN contains({path}, '/') THEN regexp_replace({path}, '[^/]*$', '') "
            f"ELSE '/' END")


def _reference_sql(value: str, base: str | None) -> str:
    """Turn a (possibly relative) reference into an absolute URL string."""
    if base is None:
        return f"CASE WHEN {value} rlike {text(_SCHEME)} THEN {value} END"
    origin = f"regexp_extract({base}, {text(_ORIGIN)}, 1)"
    base_path = f"regexp_extract({base}, {text(_BASE_PATH)}, 1)"
    folder = f"concat({origin}, {_directory_sql(base_path)}"
    bare = r"(?i)^(https?):(?![/\\])"
    return (
        # "https:page" next to an https base is a relative path, by the URL standard.
        f"CASE WHEN {value} rlike {text(bare)} "
        f"AND startswith(lower({base}), concat(lower(substring_index({value}, ':', 1)), '://')) "
        f"THEN {folder}, substr({value}, length(substring_index({value}, ':', 1)) + 2)) "
        f"WHEN {value} rlike {text(_SCHEME)} THEN {value} "
        f"WHEN NOT {base} rlike {text(_ORIGIN)} THEN NULL "
        f"WHEN {value} rlike {text(r'^[/\\]{2}')} "
        f"THEN concat(substring_index({base}, '//', 1), {value}) "
        f"WHEN {value} rlike {text(r'^[/\\]')} THEN concat({origin}, {value}) "
        f"WHEN startswith({value}, '?') THEN concat({origin}, {base_path}, {value}) "
        f"WHEN {value} = '' OR startswith({value}, '#') "
        f"THEN concat(substring_index({base}, '#', 1), {value}) "
        f"ELSE {folder}, {value}) END"
    )


def _pieces_sql(url: str) -> str:
    """``[scheme, userinfo, host, port, path, query, fragment]``; size 1 when not http(s)."""
    groups = _SEP.join(f"${i}" for i in range(1, 8))
    return f"split(regexp_replace({url}, {text(_ABSOLUTE)}, '{groups}'), '{_SEP}')"


_USER = "CASE WHEN p[1] = '' THEN '' ELSE concat(p[1], '@') END"


def url_parts_sql(value: str, base: str | None = None) -> str:
    """SQL text of :func:`url_parts`."""
    search = "CASE WHEN u.query = '' THEN '' ELSE concat('?', u.query) END"
    origin = "concat(u.scheme, '://', u.user, u.host, u.port"
    bare = "regexp_replace(u.path, '^(/.*?)/+$', '$1')"
    finish = (
        "CASE WHEN u.host IS NOT NULL AND u.port IS NOT NULL THEN struct("
        "u.scheme AS scheme, u.host AS host, u.port AS port, u.path AS path, u.query AS query, "
        f"{origin}, u.path, {search}) AS url, {origin}, {bare}, {search}) AS key) END"
    )
    pieces = (
        f"struct(lower(p[0]) AS scheme, {_USER} AS user, {_host_sql('lower(p[2])')} AS host, "
        f"{_port_sql('lower(p[0])', 'p[3]')} AS port, {_path_sql('p[4]')} AS path, "
        f"{_query_sql('substr(p[5], 2)')} AS query)"
    )
    general = let_sql(
        "p", _pieces_sql(_reference_sql("v", "b" if base else None)),
        f"CASE WHEN size(p) = 7 THEN {let_sql('u', pieces, finish)} END",
    )
    if base:
        general = let_sql("b", _trim_sql(base), general)
    quick = (
        "struct(substring_index(v, ':', 1) AS scheme, split_part(v, '/', 3) AS host, '' AS port, "
        "substr(v, length(substring_index(v, '/', 3)) + 1) AS path, '' AS query, v AS url, "
        "concat(substring_index(v, '/', 3), regexp_replace("
        "substr(v, length(substring_index(v, '/', 3)) + 1), '^(/.*?)/+$', '$1')) AS key)"
    )
    return let_sql(
        "v", _trim_sql(value),
        f"CASE WHEN v rlike {text(_NORMAL)} THEN {quick} ELSE {general} END",
    )


def url_parts(value: Column | str, base: Column | str | None = None) -> Column:
    """Parse once, use often: ``struct<scheme, host, port, path, query, url, key>``.

    ``url`` is the normalized URL and ``key`` its slash-insensitive identity. The whole
    struct is NULL for anything that is not a usable http(s) URL.
    """
    if base is None:
        return call_sql(url_parts_sql("arg.v"), v=value)
    return call_sql(url_parts_sql("arg.v", "arg.b"), v=value, b=base)


def normalize_url(value: Column | str, base: Column | str | None = None) -> Column:
    """Canonical http(s) URL without fragment and tracking parameters; NULL if unusable."""
    return url_parts(value, base)["url"]


def dedupe_key(value: Column | str) -> Column:
    """Slash-insensitive identity of a URL."""
    return url_parts(value)["key"]


def origin_sql(base: str) -> str:
    """SQL text: ``scheme://host[:port]`` of an absolute URL, NULL if it has none."""
    parts = (f"concat(lower(p[0]), '://', {_USER}, {_host_sql('lower(p[2])')}, "
             f"{_port_sql('lower(p[0])', 'p[3]')})")
    return let_sql("p", _pieces_sql(base), f"CASE WHEN size(p) = 7 THEN {parts} END")


def absolutize_sql(value: str, base: str, origin: str | None = None) -> str:
    """SQL text of :func:`absolutize`; ``base`` is an absolute URL.

    With the page's ``origin`` at hand, a plain root-relative path is one concatenation.
    """
    whole = (
        f"CASE WHEN size(p) = 7 THEN concat(lower(p[0]), '://', {_USER}, "
        f"{_host_sql('lower(p[2])')}, {_port_sql('lower(p[0])', 'p[3]')}, {_path_sql('p[4]')}, "
        f"{_encode_if('p[5]', _QUERY_UNSAFE, _QUERY_KEEP)}, "
        f"{_encode_if('p[6]', _FRAGMENT_UNSAFE, _FRAGMENT_KEEP)}) END"
    )
    resolved = let_sql("p", _pieces_sql(_reference_sql("v", base)), whole)
    rooted = (f"WHEN {origin} IS NOT NULL AND v rlike {text(_ROOTED)} THEN concat({origin}, v) "
              if origin else "")
    return let_sql(
        "v", _trim_sql(value),
        f"CASE WHEN v IS NULL OR v = '' THEN '' "
        f"{rooted}WHEN v rlike {text(_NORMAL)} THEN v ELSE coalesce({resolved}, {value}) END",
    )


def absolutize(value: Column | str, base: Column | str) -> Column:
    """Resolve an attribute value against its page: raw value on failure, '' for none."""
    return call_sql(absolutize_sql("arg.v", "arg.b"), v=value, b=base)


def host_sql(value: str) -> str:
    """SQL text of :func:`host_of`."""
    web = r"(?is)^(?:https?|wss?|ftp):[/\\]*(?:[^/\\?#]*@)?(\[[^\]]*\]|[^:/\\?#]*)(?::[0-9]*)?(?:[/\\?#].*)?$"
    other = r"(?is)^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?([^:/?#]*)"
    quick = (r"^https?://(?!(?:[^/]*\.)?0x[0-9a-f]*(?:/|$))"
             r"[a-z0-9._\-]*[a-z_\-][a-z0-9_\-]*(?:/|$)")
    host = f"lower(regexp_extract(v, {text(web)}, 1))"
    return let_sql(
        "v", _trim_sql(value),
        f"CASE WHEN v rlike {text(quick)} THEN split_part(v, '/', 3) "
        f"WHEN v rlike '(?i)^(https?|wss?|ftp):' THEN {let_sql('w', host, _host_sql('w'))} "
        f"WHEN v rlike {text(_SCHEME)} THEN lower(regexp_extract(v, {text(other)}, 1)) END",
    )


def host_of(value: Column | str) -> Column:
    """Lower-cased host of a URL of any scheme; '' when the scheme has none, NULL if invalid."""
    return call_sql(host_sql("arg.v"), v=value)


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def site_of(value: Column | str) -> Column:
    """The site a URL belongs to: its host without a leading ``www.``."""
    return strip_www(host_of(value))


def is_same_site(a: Column, b: Column) -> Column:
    return F.coalesce(site_of(a) == site_of(b), F.lit(False))


def path_of(value: Column | str) -> Column:
    return url_parts(value)["path"]


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def locale_of_path(path: Column, locales: Sequence[str]) -> Column:
    first = F.get(_segments(path), F.lit(0))
    return F.when(first.isin(*locales), first) if locales else F.lit(None).cast("string")


def locale_of(value: Column | str, locales: Sequence[str]) -> Column:
    """First path segment when it is one of ``locales``; else NULL."""
    return locale_of_path(path_of(value), locales)


# --- predicates -------------------------------------------------------------------------


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression for a host glob (``*`` = any run of characters)."""
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def robots_to_regex(pattern: str) -> str:
    """Regular expression for a robots.txt path pattern; a trailing ``$`` anchors the end."""
    end = "$" if pattern.endswith("$") else ""
    body = pattern[:-1] if end else pattern
    return "^" + ".*".join(re.escape(p) for p in body.split("*")) + end


_ESCAPABLE = r"([.+?^${}()|\[\]\\])"


def glob_to_regex_col(pattern: Column) -> Column:
    """``glob_to_regex`` for a pattern held in a column (many sites, many pattern lists)."""
    escaped = F.regexp_replace(F.lower(pattern), _ESCAPABLE, r"\\$1")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("$"))


def robots_to_regex_col(pattern: Column) -> Column:
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    escaped = F.regexp_replace(body, _ESCAPABLE, r"\\$1")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")),
                    F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def host_matches(host: Column, pattern: str) -> Column:
    """Exact or glob match; ``*.x`` and ``x.*`` also match the bare ``x``."""
    p = pattern.lower()
    h = F.lower(host)
    if "*" not in p:
        return h == p
    hit = h.rlike(glob_to_regex(p))
    if p.startswith("*."):
        hit = hit | (h == p[2:])
    if p.endswith(".*"):
        hit = hit | (h == p[:-2])
    return hit


def host_matches_col(host: Column, pattern: Column) -> Column:
    """``host_matches`` with the pattern in a column."""
    p, h = F.lower(pattern), F.lower(host)
    return F.when(~p.contains("*"), h == p).otherwise(
        F.rlike(h, glob_to_regex_col(p))
        | (p.startswith("*.") & (h == F.substr(p, F.lit(3))))
        | (p.endswith(".*") & (h == F.substr(p, F.lit(1), F.length(p) - 2)))
    )


def match_host(host: Column, patterns: Sequence[str]) -> Column:
    """First pattern, in list order, that the host matches; NULL if none.

    Each literal pattern compiles once per task, so this needs no join at all.
    """
    out = None
    for p in patterns:
        cond = (host != "") & host_matches(host, p)
        out = F.when(cond, F.lit(p)) if out is None else out.when(cond, F.lit(p))
    return F.lit(None).cast("string") if out is None else out


def match_forbidden_host(value: Column | str, patterns: Sequence[str]) -> Column:
    return let(host_of(value), lambda h: match_host(h, patterns))


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return F.coalesce(out, F.lit(False))


def url_belongs_to(value: Column, hosts: Sequence[str]) -> Column:
    """Host equal to, or a subdomain of, an entry; an entry with ``/`` is a URL substring."""
    lowered = F.lower(value)

    def test(h: Column) -> Column:
        checks = []
        for entry in (e.lower() for e in hosts):
            checks.append(lowered.contains(entry) if "/" in entry
                          else (h == entry) | h.endswith("." + entry))
        return (F.coalesce(h, F.lit("")) != "") & any_of(checks)

    return let(host_of(value), test)


def path_in_prefixes(path: Column, prefixes: Sequence[str], locales: Sequence[str]) -> Column:
    """Whole-segment, case-insensitive prefix test, ignoring one leading locale segment."""
    wanted = [("/" + p.strip("/")).lower() for p in prefixes]

    def test(segs: Column) -> Column:
        first = F.get(segs, F.lit(0))
        has_locale = first.isin(*locales) if locales else F.lit(False)
        rest = F.when(F.coalesce(has_locale, F.lit(False)),
                      F.slice(segs, 2, F.greatest(F.size(segs), F.lit(1)))).otherwise(segs)
        joined = F.lower(F.concat(F.lit("/"), F.array_join(rest, "/")))
        return let(joined, lambda p: any_of(
            [(p == w) | p.startswith(w + "/") for w in wanted]))

    return F.coalesce(let(_segments(path), test), F.lit(False))


def path_matches(value: Column | str, prefixes: Sequence[str], locales: Sequence[str]) -> Column:
    return path_in_prefixes(path_of(value), prefixes, locales)


def matches_ignore_pattern(value: Column, patterns: Sequence[str]) -> Column:
    """``.ext`` tests the end of the path; anything else is a case-insensitive substring."""
    lowered = F.lower(value)
    path = F.regexp_extract(lowered, r"^[a-z][a-z0-9+.\-]*:/*[^/?#]*([^?#]*)", 1)
    return any_of([path.endswith(p) if p.startswith(".") else lowered.contains(p)
                   for p in (q.lower() for q in patterns)])
