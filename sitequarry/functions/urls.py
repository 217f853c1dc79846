"""URL expressions (Column in, Column out).

Only http and https URLs are understood; anything else becomes NULL.  Hosts are
lower-cased, default ports dropped, dot segments resolved and unsafe path
characters percent-encoded.  Credentials inside a URL are not kept, and
international host names are compared as written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = (
    r"(?s)^([hH][tT][tT][pP][sS]?):[/\\]*"
    r"(?:[^/\\?#]*@)?"
    r"(\[[0-9a-fA-F:.]+\]|[^\x00-\x20/\\?#:@\[\]<>^|%]+)"
    r"(?::([0-9]{0,5}))?"
    r"([/\\][^?#]*)?(?:[?#].*)?$"
)
_EDGE_OR_BREAK = r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]"
_DOT_SEGMENT = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"
_UNSAFE = "[^\\x21-\\x7E]|[\"<>`{}^]"
_UNSAFE_CHAR = "^(?:" + _UNSAFE + ")$"
# The locale prefix and the page extensions of a path.
_LOCALE = r"(?i)^/([a-z]{2}(?:-[a-z]{2,4})?)(?:/|$)"
_PAGE_EXTENSION = r"\.(html|htm|php)$"
_MAY_NORMALIZE = r"(?:/|\.(?:html|htm|php))$"
# A link that is a plain path from the root: nothing to resolve, decode or encode in it.
_PLAIN_PATH = r"(?s)^((?:/(?!\.|/|%2[eE])[!$&-.0-;=@-\[\]_a-z|~%]*+)+)(?:[?#].*)?$"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_url(url: Column) -> Column:
    """Drop surrounding control characters and any tab or line break."""
    return F.regexp_replace(url, _EDGE_OR_BREAK, "")


def ensure_scheme(url: Column) -> Column:
    """Put ``https://`` in front unless an http scheme is already there."""
    has_scheme = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    return F.when(has_scheme, url).otherwise(F.concat(F.lit("https://"), url))


def _remove_dot_segments(path: Column) -> Column:
    single = F.array(F.lit("."), F.lit("%2e"))
    double = F.array(F.lit(".."), F.lit(".%2e"), F.lit("%2e."), F.lit("%2e%2e"))

    def step(kept: Column, segment: Column) -> Column:
        low = F.lower(segment)
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when(F.array_contains(double, low), up)
            .when(F.array_contains(single, low), kept)
            .otherwise(F.array_append(kept, segment))
        )

    segments = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_open = F.element_at(segments, -1).rlike(r"(?i)^(?:\.|%2e){1,2}$")
    tail = F.when(ends_open & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    return F.when(path.rlike(_DOT_SEGMENT), resolved).otherwise(path)


def _percent_encode(path: Column) -> Column:
    def one(ch: Column) -> Column:
        coded = F.when(ch == " ", F.lit("%20")).otherwise(F.url_encode(ch))
        return F.when(ch.rlike(_UNSAFE_CHAR), coded).otherwise(ch)

    chars = F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0))
    coded = F.array_join(F.transform(chars, one), "")
    return F.when(path.rlike(_UNSAFE), coded).otherwise(path)


def clean_path(path: Column) -> Column:
    """Forward slashes, no dot segments, percent-encoded, never empty."""
    slashed = F.translate(path, "\\", "/")
    rooted = F.when(slashed == "", F.lit("/")).otherwise(slashed)
    return bind(bind(rooted, _remove_dot_segments), _percent_encode)


def url_parts(url: Column) -> Column:
    """STRUCT(scheme, host, port, path), or NULL when not an http(s) URL."""

    # One regex splits the URL: a mark tells a match from a string left as it was.
    marked = F.regexp_replace(clean_url(url), _URL, "\x02$1\x01$2\x01$3\x01$4")

    def parts(field: Column) -> Column:
        first, port = F.get(field, F.lit(0)), F.get(field, F.lit(2))
        scheme = F.lower(F.substring(first, 2, 5))
        default = F.when(scheme == "http", F.lit("80")).otherwise(F.lit("443"))
        fields = F.struct(
            scheme.alias("scheme"),
            F.lower(F.get(field, F.lit(1))).alias("host"),
            F.when(port == default, F.lit("")).otherwise(port).alias("port"),
            clean_path(F.get(field, F.lit(3))).alias("path"),
        )
        valid_port = F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535
        return F.when(F.startswith(first, F.lit("\x02")) & valid_port, fields)

    return bind(F.split(marked, "\x01", 4), parts)


def origin(parts: Column) -> Column:
    port = parts["port"]
    return F.concat(
        parts["scheme"],
        F.lit("://"),
        parts["host"],
        F.when(port == "", F.lit("")).otherwise(F.concat(F.lit(":"), port)),
    )


def href(parts: Column) -> Column:
    """The URL without query and fragment."""
    return F.concat(origin(parts), parts["path"])


def normalize_path(path: Column) -> Column:
    """The path as page identity: no trailing slash, index file or page extension (U4)."""
    # most paths end in neither and are left alone by one test
    bare = F.regexp_replace(path, r"(?<=.)/$", "")
    parent = F.regexp_replace(bare, r"/index\.(html|htm|php)$", "/")
    bare = F.regexp_replace(parent, r"(?<=.)/$", "")
    short = F.regexp_replace(bare, _PAGE_EXTENSION, "")
    full = F.regexp_replace(short, r"^$", "/")
    return F.when(path.rlike(_MAY_NORMALIZE), full).otherwise(path)


def normalized_parts(url: Column) -> Column:
    """``url_parts`` with the path reduced to page identity."""
    return bind(
        url_parts(url),
        lambda p: F.when(p.isNotNull(), p.withField("path", normalize_path(p["path"]))),
    )


def normalize_url(url: Column) -> Column:
    """Identity key of a page URL (U4)."""
    return bind(normalized_parts(url), href)


def hostname(url: Column) -> Column:
    return url_parts(url)["host"]


def url_path(url: Column) -> Column:
    return url_parts(url)["path"]


def path_as_written(url: Column) -> Column:
    """The path part of a URL that is in normal form already; cheaper than ``url_path``."""
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def is_valid_url(url: Column) -> Column:
    """Parseable and http or https."""
    return url_parts(url).isNotNull()


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda s: s != "")


def path_depth(path: Column) -> Column:
    """Number of non-empty path segments."""
    return F.size(path_segments(path))


def page_segments(path: Column) -> Column:
    """Path segments after dropping a page extension."""
    return path_segments(F.regexp_replace(path, _PAGE_EXTENSION, ""))


def path_locale(path: Column) -> Column:
    """Lower-case locale prefix of a path, or NULL."""
    return F.nullif(F.lower(F.regexp_extract(path, _LOCALE, 1)), F.lit(""))


def strip_locale(path: Column) -> Column:
    """Path without its locale prefix."""
    return F.regexp_replace(path, _LOCALE, "/")


def site_display_name(host: Column) -> Column:
    """First host label without ``www.``, first letter upper-case (U8)."""
    label = F.get(F.split(F.regexp_replace(host, r"^www\.", ""), r"\."), F.lit(0))
    return F.concat(F.upper(F.left(label, F.lit(1))), F.substring(label, 2, 1 << 30))


def resolve_href(link: Column, page: Column) -> Column:
    """``url_parts`` of a link found on a page, itself given by ``url_parts``.

    Query and fragment are ignored.  Plain root-relative links, the common case, take
    a short way.
    """

    def resolved(path: Column) -> Column:
        on_this_host = F.struct(
            page["scheme"].alias("scheme"),
            page["host"].alias("host"),
            page["port"].alias("port"),
            path.alias("path"),
        )
        return F.when(path != "", on_this_host).otherwise(url_parts(_absolute_href(link, page)))

    return bind(F.regexp_extract(link, _PLAIN_PATH, 1), resolved)


def _absolute_href(link: Column, page: Column) -> Column:
    page_origin, page_path = origin(page), page["path"]

    def absolute(h: Column) -> Column:
        scheme = F.regexp_extract(page_origin, r"^([a-z]+):", 1)
        folder = F.regexp_replace(page_path, r"[^/]*$", "")
        own_scheme = F.concat(scheme, F.lit(":"))
        rest = F.substr(h, F.length(own_scheme) + 1)
        same_scheme_relative = F.startswith(F.lower(h), own_scheme) & ~F.startswith(rest, F.lit("/"))
        relative = F.when(same_scheme_relative, rest).otherwise(h)
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~same_scheme_relative, h)
            .when(F.startswith(h, F.lit("//")), F.concat(own_scheme, h))
            .when(F.startswith(relative, F.lit("/")), F.concat(page_origin, relative))
            .when(relative == "", F.concat(page_origin, page_path))
            .otherwise(F.concat(page_origin, folder, relative))
        )

    before_query = F.translate(F.regexp_extract(clean_url(link), r"(?s)^[^?#]*", 0), "\\", "/")
    return bind(before_query, absolute)


def decode_xml_entities(text: Column) -> Column:
    """Decode the five XML entities, ampersand last."""
    # Entity and replacement, in the order they are applied.
    for entity, char in (
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&apos;", "'"),
        ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def glob_to_regex(glob: Column, escape: bool = False) -> Column:
    """``**`` matches anything, ``*`` anything but a slash; anchored.

    Other regex characters keep their regex meaning unless ``escape`` is set.
    """
    if escape:
        glob = F.regexp_replace(glob, r"([\\.+?^${}()|\[\]])", r"\\$1")
    held = F.replace(glob, F.lit("**"), F.lit("\x01"))
    single = F.replace(held, F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit("^"), F.replace(single, F.lit("\x01"), F.lit(".*")), F.lit("$"))
