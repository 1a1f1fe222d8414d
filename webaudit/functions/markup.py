"""HTML text helpers as SQL text: tags, attributes, character references."""

from __future__ import annotations

from html.entities import html5

from .lets import let_sql, text

# Everything inside a start tag, quoted values skipped whole. Possessive quantifiers keep
# the matcher from backtracking (and from recursing) on long attributes.
ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""

# Elements whose content is not part of the document's markup, and comments.
RAW_TEXT = (
    r"(?is)(?=<)(?:<!--.*?(?:-->|\z)"
    r"|(<(script|style|title|textarea|noscript|template|iframe|xmp|noembed|noframes)(?=[\s/>])"
    + ATTRIBUTES + r">).*?(?:</\2\s*>|\z))"
)
TAG = (
    r"(?is)<(?:html|base|meta|link|a|img|iframe|source|video|form|script)(?=[\s/>])"
    + ATTRIBUTES + ">"
)
ANCHOR = r"(?is)<a(?=[\s/>])" + ATTRIBUTES + r">.*?(?=</a[\s>]|<a[\s/>]|\z)"
HEADING = r"(?is)<h1(?=[\s/>])" + ATTRIBUTES + r">(.*?)(?=</h[1-6][\s>]|\z)"

_GAP = r"""(?:[\s/]+|(?<=["']))"""
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""


def _before(name: str) -> str:
    """The part of a start tag before attribute ``name``."""
    other = rf"""(?:{_GAP}(?!{name}[\s=/>])[^\s"'>/=]+(?:\s*=\s*{_VALUE})?)*+"""
    return rf"(?is)^<[a-z0-9]+{other}{_GAP}{name}"


def has_attribute_sql(tag: str, name: str) -> str:
    return f"{tag} rlike {text(_before(name) + r'(?=[\s=/>])')}"


def attribute_sql(tag: str, name: str, decode: bool = True) -> str:
    """Value of an attribute; '' when it has none, NULL when it is absent."""
    pattern = _before(name) + rf"\s*=\s*({_VALUE})"
    bare = "CASE WHEN left(av, 1) IN ('\"', \"'\") THEN substr(av, 2, length(av) - 2) ELSE av END"
    if decode:
        bare = f"CASE WHEN contains(av, '&') THEN {let_sql('dv', bare, unescape_sql('dv', True))} " \
               f"ELSE {bare} END"
    return let_sql(
        "av", f"regexp_extract({tag}, {text(pattern)}, 1)",
        f"CASE WHEN av <> '' THEN {bare} WHEN {has_attribute_sql(tag, name)} THEN '' END")


def _entity_table() -> str:
    """All named character references as one literal, folded to a map at planning time."""
    pairs = "\u0003".join(f"{name}\u0002{chars}" for name, chars in html5.items())
    return f"str_to_map({text(pairs)}, '\u0003', '\u0002')"


def unescape_sql(value: str, attribute: bool = False) -> str:
    """Decode character references. Those without ``;`` count only where HTML says so."""
    legacy = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
    after = "(?![=A-Za-z0-9])" if attribute else ""
    token = (rf"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*;|&(?:{legacy}){after}"
             r"|[^&]+|&")
    point = ("CASE WHEN k rlike '^&#[xX]' "
             "THEN try_cast(conv(regexp_extract(k, '([0-9a-fA-F]+);?$', 1), 16, 10) AS BIGINT) "
             "ELSE try_cast(regexp_extract(k, '([0-9]+)', 1) AS BIGINT) END")
    char = let_sql(
        "n", point,
        "CASE WHEN n IS NULL OR n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 "
        "THEN '�' ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END")
    return (
        f"CASE WHEN contains({value}, '&') THEN array_join(transform("
        f"regexp_extract_all({value}, {text(token)}, 0), k -> "
        f"CASE WHEN k LIKE '&#%' THEN {char} WHEN length(k) > 1 AND left(k, 1) = '&' "
        f"THEN coalesce(try_element_at({_entity_table()}, substr(k, 2)), k) ELSE k END), '') "
        f"ELSE {value} END"
    )


def text_content_sql(inner: str) -> str:
    """Text of a markup fragment, trimmed."""
    stripped = f"regexp_replace({inner}, '(?s)<[^>]*>', '')"
    return let_sql("tc", stripped, trim_sql(unescape_sql("tc")))


def trim_sql(value: str) -> str:
    pattern = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"
    return f"regexp_replace({value}, {text(pattern)}, '')"
