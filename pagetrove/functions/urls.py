"""URL splitting, link rewriting and the key under which URLs are the same.

Splitting follows Python's ``urllib.parse`` (3.9 and later), not Spark's
``parse_url``: it never fails on odd input and it keeps ``;params`` apart from
the path.
"""

from typing import NamedTuple
from urllib.parse import uses_netloc, uses_params

from pyspark.sql import Column
from pyspark.sql import functions as F

# Groups: scheme, authority, path, query, fragment (RFC 3986, appendix B).
_GENERIC = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*+):)?+(?://([^/?#]*+))?+([^?#]*+)(?:\?([^#]*+))?+(?:#(.*))?\z"
# Parameters follow the first ``;`` of the last path segment.
_PARAMS = r"(?s)^((?:.*/)?[^/;]*+);([^/]*+)\z"


class UrlParts(NamedTuple):
    scheme: Column
    netloc: Column
    path: Column
    params: Column
    query: Column
    fragment: Column


def trim_url(url: Column) -> Column:
    """Leading control characters and spaces, and any tab or line break, do not count."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]+", "")


def url_parts(url: Column) -> UrlParts:
    """Parts of a URL, empty where absent.

    Make them columns of their own before using one several times.
    """
    url = trim_url(url)
    scheme = F.lower(F.regexp_extract(url, _GENERIC, 1))
    path = F.regexp_extract(url, _GENERIC, 3)
    splits = scheme.isin(list(uses_params))
    return UrlParts(
        scheme=scheme,
        netloc=F.regexp_extract(url, _GENERIC, 2),
        path=F.when(splits, F.regexp_replace(path, _PARAMS, "$1")).otherwise(path),
        params=F.when(splits, F.regexp_extract(path, _PARAMS, 2)).otherwise(F.lit("")),
        query=F.regexp_extract(url, _GENERIC, 4),
        fragment=F.regexp_extract(url, _GENERIC, 5),
    )


def url_host(url: Column) -> Column:
    """Authority of a URL, empty if it has none."""
    return F.regexp_extract(trim_url(url), _GENERIC, 2)


def links_count(source: UrlParts) -> Column:
    """Links are followed only from pages whose URL has a path and no ``;params``."""
    return (source.path != "") & (source.params == "")


def rewrite_link(href: Column, link: UrlParts, source: UrlParts) -> Column:
    """Absolute links stay; all others are re-rooted at the host of the page.

    Re-rooting keeps path and query only: not the link's scheme, parameters or
    fragment, and not the directory of the page. ``link`` are the parts of
    ``href``, ``source`` those of the page URL. Null if links of the page do not
    count.
    """
    nothing, slashes = F.lit(""), F.lit("//")
    slash = F.when((link.path != "") & ~link.path.startswith("/"), F.lit("/")).otherwise(nothing)
    # Page URLs without a host are no web pages; they are joined as the standard library does.
    marked = link.path.startswith("//") | (
        (source.scheme != "")
        & source.scheme.isin(list(uses_netloc))
        & ((link.path == "") | link.path.startswith("/"))
    )
    rewritten = F.concat(
        F.when(source.scheme != "", F.concat(source.scheme, F.lit(":"))).otherwise(nothing),
        F.when(source.netloc != "", F.concat(slashes, source.netloc, slash))
        .when(marked, slashes)
        .otherwise(nothing),
        link.path,
        F.when(link.query != "", F.concat(F.lit("?"), link.query)).otherwise(nothing),
    )
    return F.when(links_count(source), F.when(link.netloc == "", rewritten).otherwise(href))


def resolve_link(link: Column, scheme: Column) -> Column:
    """Give ``//host/path`` links the scheme of the page."""
    return F.when(
        link.startswith("//") & (scheme != ""), F.concat(scheme, F.lit(":"), link)
    ).otherwise(link)


# Groups: scheme, user, host, path of an absolute URL without query and fragment.
_ABSOLUTE = r"(?s)^([a-zA-Z][a-zA-Z0-9+.\-]*+://)([^/@]*+@)?+([^/]*+)(.*)\z"


def url_key(url: Column) -> Column:
    """Key under which two URLs are one page.

    No fragment, query arguments sorted, scheme and host in lower case, ``/`` for no path.
    """
    bare = F.substring_index(url, "#", 1)
    path = F.substring_index(bare, "?", 1)
    query = F.substr(bare, F.length(path) + 2)
    ordered = F.array_join(F.sort_array(F.split(query, "&")), "&")
    scheme, user, host, rest = (F.regexp_extract(path, _ABSOLUTE, i) for i in range(1, 5))
    plain = F.when(
        path.rlike(_ABSOLUTE),
        F.concat(F.lower(scheme), user, F.lower(host), F.when(rest == "", F.lit("/")).otherwise(rest)),
    ).otherwise(path)
    return F.when(query == "", plain).otherwise(F.concat(plain, F.lit("?"), ordered))
