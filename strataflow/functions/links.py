"""Links as columns: the parts of a URL, and a reference resolved against the page that holds it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query, fragment; each with its mark, so that an empty part and an absent one differ.
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, "(?s)" + PARTS, i)


def host(url: Column) -> Column:
    """The host in lower case, without user and port; empty if the URL has none."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^//([^@]*@)?", ""), ":[0-9]*$", ""))


def path(url: Column) -> Column:
    return _part(url, 3)


def without_dots(full: Column) -> Column:
    """A path in which `.` and `..` are carried out; `..` beyond the root is dropped, and a path that ends in either is a folder."""
    steps = F.split(full, "/")
    rooted = F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0)))
    ends = F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))

    def go(kept: Column, step: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(step == "..", up).when(step == ".", kept).otherwise(F.concat(kept, F.array(step)))

    return F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(rooted, F.array().cast("array<string>"), go), ends), "/"))


def resolve(base: Column, ref: Column) -> Column:
    """A reference of a page, as an absolute URL (RFC 3986, 5.2). The base is an absolute URL with a host.

    Defined cases: a null base or reference gives null; blanks around a reference don't count; an empty one is the page itself; a
    reference with a scheme stays as it is, but for the dots in the path of one that has a host."""
    ref = F.trim(ref)
    scheme, authority, way, asked, mark = (_part(ref, i) for i in range(1, 6))
    own_scheme, own_authority, own_way, own_asked = (_part(base, i) for i in range(1, 5))
    folder = F.regexp_replace(own_way, "[^/]*$", "")
    merged = F.concat(F.when(folder == "", "/").otherwise(folder), way)
    foreign, same = authority != "", (authority == "") & (way == "")
    raw = F.when(foreign | way.startswith("/"), way).otherwise(merged)
    final = F.when(same, own_way).when(raw == "", raw).otherwise(without_dots(raw))
    whole = F.concat(
        F.when(scheme != "", scheme).otherwise(own_scheme), F.when(foreign, authority).otherwise(own_authority), final,
        F.when(same & (asked == ""), own_asked).otherwise(asked), mark,
    )
    return F.when((scheme != "") & ~foreign, ref).otherwise(whole)


def references(html: Column) -> Column:
    """The references of a page's links, in order, quoted either way."""
    return F.filter(F.regexp_extract_all(html, F.lit(r"""(?is)<a\s(?:[^>]*\s)?href\s*=\s*("[^"]*"|'[^']*')"""), 1), lambda x: F.length(x) > 2)


def unquoted(ref: Column) -> Column:
    """A reference without its quotes; `&amp;` is an ampersand."""
    return F.replace(F.substring(ref, F.lit(2), F.length(ref) - 2), F.lit("&amp;"), F.lit("&"))


def follows(source: Column, link: Column, folders: list[str]) -> Column:
    """Whether a crawl that began at a host follows a link: its host holds that host, and its path one of the folders."""
    within = path(link).contains(folders[0])
    for one in folders[1:]:
        within |= path(link).contains(one)
    return host(link).contains(source) & (source != "") & within
