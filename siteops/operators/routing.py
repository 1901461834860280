"""Route resolution, the not-found report and the dead-link audit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from siteops.operators.hierarchy import flatten

CATCH_ALL = "*"


def url_path(url: Column) -> Column:
    """Path of an address; "/" where it has none, null where it is not an address."""
    return F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^$", "/")


def link_path(href: Column, hosts: Sequence[str] = ()) -> Column:
    """Path that a link leads to, without query and fragment; null where it leaves the site or the page.

    Addresses of other hosts than `hosts` leave the site, as do mail addresses and the like. A bare
    fragment or query stays on the page.
    """
    scheme = F.lower(F.regexp_extract(href, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(href, "^(?:[A-Za-z]+:)?//([^/?#]*)", 1))
    beyond = F.regexp_extract(href, "^(?:[A-Za-z]+:)?//[^/?#]*([^?#]*)", 1)
    own = F.regexp_replace(href, "[?#].*$", "")
    ours = host.isin(*(h.lower() for h in hosts)) & scheme.isin("", "http", "https")
    return (
        F.when(ours, F.regexp_replace(beyond, "^$", "/"))
        .when((scheme == "") & ~href.startswith("//"), F.nullif(own, F.lit("")))
    )


def _exact(routes: DataFrame) -> DataFrame:
    return routes.filter(F.col("path") != CATCH_ALL)


def resolve_route(paths: DataFrame, routes: DataFrame, catch_all: bool | None = None) -> DataFrame:
    """Adds `route`: the route of exactly the row's `path`, else the catch-all, else null.

    `routes` has a column `path`. Whether it has the catch-all is looked up, unless the caller says so.
    """
    if catch_all is None:
        other = routes.filter(F.col("path") == CATCH_ALL).select(F.max("path")).scalar()
    else:
        other = F.lit(CATCH_ALL if catch_all else None)
    exact = _exact(routes).select("path").distinct().withColumn("_exact", F.lit(True))
    out = paths.join(exact, "path", "left")
    route = F.when(F.col("_exact"), F.col("path")).otherwise(other)
    return out.withColumn("route", route).select(*paths.columns, "route")


def not_found(paths: DataFrame, routes: DataFrame) -> DataFrame:
    """Accesses per path that no exact route serves: path, n_accesses.

    Counted before the join, so a path that is asked for very often is one row per task by then.
    Addresses without a readable path count under null.
    """
    counts = paths.groupBy("path").agg(F.count("*").alias("n_accesses"))
    return counts.join(_exact(routes).select("path"), "path", "left_anti")


def nav_links(menus: DataFrame, nav_items: DataFrame, quick_actions: DataFrame) -> DataFrame:
    """All link targets of the navigation tables: source, label, href."""
    flat = flatten(menus, "menus")
    items = flat.filter(F.coalesce("sub_pos", F.lit(0)) == 0)
    subs = flat.filter(F.col("sub_pos").isNotNull())

    def links(df: DataFrame, source: str, label: str, href: str) -> DataFrame:
        return df.select(
            F.lit(source).alias("source"), F.col(label).alias("label"), F.col(href).alias("href")
        )

    return (
        links(nav_items, "nav", "label", "href")
        .unionByName(links(items, "item", "item_title", "item_href"))
        .unionByName(links(subs, "sub", "sub_title", "sub_href"))
        .unionByName(links(quick_actions, "quick", "label", "href"))
    )


# HTML as tokens: what is inside comments, attribute values and raw text holds no tags. All loops are
# possessive, so that no page makes the matcher go back or deep.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_REST = r"(?:\s*+=\s*+" + _VALUE + r"?+)?+"
_ATTRIBUTES = r"(?:[\s/]++|[^\s/>][^\s/>=]*+" + _REST + r")*+"
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
_RAW = r"<(script|style|textarea|title|xmp|iframe|noembed|noframes)(?=[\s/>])" + _ATTRIBUTES + r">.*?(?:</\1(?=[\s/>])|\z)"
_LINK = r"(<(?:a|area|base)(?=[\s/>])" + _ATTRIBUTES + r">)"
_TOKEN = rf"(?is){_COMMENT}|{_RAW}|{_LINK}|</?[a-z][^\s/>]*+{_ATTRIBUTES}>"
_HREF = r"(?is)^<[a-z]++(?:[\s/]++|(?!href[\s/>=])[^\s/>][^\s/>=]*+" + _REST + r")*+href\s*+=\s*+(" + _VALUE + ")"
_REFERENCE = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row or element."""
    return F.get(F.transform(F.array(value), body), 0)


def unescape(text: Column) -> Column:
    """Text without character references: numbers and the names of HTML 4, with their semicolons."""
    names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])
    names = F.map_concat(names, F.create_map(F.lit("apos"), F.lit("'")))

    def character(code: Column) -> Column:
        odd = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(odd, 0xFFFD).otherwise(code)), 8, "0")), "UTF-32")

    def piece(part: Column) -> Column:
        """What follows an ampersand."""

        def decoded(name: Column) -> Column:
            digits = F.regexp_extract(name, "^#[xX]?(.*)$", 1)
            code = F.when(F.lower(name).startswith("#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
            found = F.when(name.startswith("#"), character(code)).when(name != "", F.try_element_at(names, name))
            left = F.substring(part, F.length(name) + 2, F.length(part))
            return F.coalesce(F.concat(found, left), F.concat(F.lit("&"), part))

        return _let(F.regexp_extract(part, _REFERENCE, 1), decoded)

    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(text.contains("&"), F.concat(F.get(parts, 0), F.array_join(rest, ""))).otherwise(text)


def _target(tag: Column) -> Column:
    """The first `href` of a tag, read as HTML reads it; empty where there is none."""
    quoted = F.regexp_extract(tag, _HREF, 1)
    bare = F.when(quoted.rlike("^[\"']"), F.substring(quoted, F.lit(2), F.length(quoted) - 2)).otherwise(quoted)
    return F.regexp_replace(unescape(bare), r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")


def page_links(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = (), url: str | None = None) -> DataFrame:
    """Every link target in the pages' HTML, one row per occurrence: the kept columns, and `href`.

    Links are the `href` of `a` and `area` tags in any case, quoted or not, with character references
    resolved; comments, scripts and other raw text hold none. Empty targets are left out. With `url`,
    the column of the pages' addresses, a column `base` says what relative targets are relative to:
    the first `base` tag of the page, else its address.
    """
    tags = F.filter(F.regexp_extract_all(html, F.lit(_TOKEN), 2), lambda t: t != "")
    of_base = lambda t: F.lower(t).rlike("^<base[\\s/>]")
    out = pages.select(*keep, *([] if url is None else [F.col(url).alias("base")]), tags.alias("_tags"))
    if url is not None:
        own = F.get(F.filter(F.transform(F.filter("_tags", of_base), _target), lambda t: t != ""), 0)
        based = F.when(own.isNull(), F.col("base")).otherwise(resolve_url(own, F.col("base")))
        out = out.withColumn("base", F.when(F.array_size(F.filter("_tags", of_base)) > 0, based).otherwise(F.col("base")))
    targets = F.transform(F.filter("_tags", lambda t: ~of_base(t)), _target)
    return out.withColumn("href", F.explode(F.filter(targets, lambda t: t != ""))).drop("_tags")


def url_parts(url: Column) -> Column:
    """(scheme, authority, path, query, fragment) of an address or reference; null where undefined."""
    found = lambda pattern: F.get(F.regexp_extract_all(url, F.lit("(?s)" + pattern), 1), 0)
    scheme = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"
    return F.struct(
        found("^([A-Za-z][A-Za-z0-9+.-]*):").alias("scheme"),
        found(scheme + "//([^/?#]*)").alias("authority"),
        found(scheme + "(?://[^/?#]*)?([^?#]*)").alias("path"),
        found(r"^[^?#]*\?([^#]*)").alias("query"),
        found("^[^#]*#(.*)").alias("fragment"),
    )


def remove_dots(path: Column) -> Column:
    """A path from the root without the segments `.` and `..`; other paths stay as they are."""
    segments = F.split(path, "/")

    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", up).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    last = F.get(segments, F.size(segments) - 1)
    ends = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    clean = ~F.concat(path, F.lit("/")).contains("/./") & ~F.concat(path, F.lit("/")).contains("/../")
    return F.when(clean | ~path.startswith("/"), path).otherwise(F.concat(F.lit("/"), F.array_join(ends, "/")))


def resolve_url(href: Column, base: Column) -> Column:
    """The address that a reference means on a page, by the rules of RFC 3986 (strict); null if either is null."""

    def parts(r: Column, b: Column) -> Column:
        above = F.regexp_replace(b["path"], "[^/]*$", "")
        merged = F.when(b["authority"].isNotNull() & (b["path"] == ""), F.lit("/")).otherwise(above)
        own = r["authority"].isNotNull() | r["scheme"].isNotNull()
        same = r["path"] == ""
        path = (
            F.when(own | r["path"].startswith("/"), remove_dots(r["path"]))
            .when(same, b["path"])
            .otherwise(remove_dots(F.concat(merged, r["path"])))
        )
        query = F.when(~own & same & r["query"].isNull(), b["query"]).otherwise(r["query"])
        pieces = [
            F.concat(F.coalesce(r["scheme"], b["scheme"]), F.lit(":")),
            F.concat(F.lit("//"), F.when(own, r["authority"]).otherwise(b["authority"])),
            path,
            F.concat(F.lit("?"), query),
            F.concat(F.lit("#"), r["fragment"]),
        ]
        return F.concat(*[F.coalesce(p, F.lit("")) for p in pieces])

    found = _let(url_parts(href), lambda r: _let(url_parts(base), lambda b: parts(r, b)))
    return F.when(href.isNotNull() & base.isNotNull(), found)


def dead_links(links: DataFrame, routes: DataFrame, hosts: Sequence[str] = (), base: str | None = None) -> DataFrame:
    """Link targets of this site that only the catch-all would serve: href, n_links.

    Targets are reduced to their path; those on other hosts than `hosts` are left out (see `link_path`).
    With `base`, the column of what targets are relative to, they are resolved first (see `resolve_url`),
    and those on the host of their base stay on the site, too; bare fragments and queries lead nowhere else.
    """
    href = F.col("href")
    path = link_path(href, hosts)
    if base is not None:
        parts = url_parts(resolve_url(href, F.coalesce(base, F.lit(""))))
        host = F.lower(parts["authority"])
        ours = host.isin(*(h.lower() for h in hosts)) | (host == F.lower(url_parts(F.col(base))["authority"]))
        web = F.lower(parts["scheme"]).isin("http", "https") & ~href.rlike("^[#?]")
        path = F.when(web & ours, F.regexp_replace(parts["path"], "^$", "/"))
    paths = links.select(path.alias("href")).filter("href IS NOT NULL")
    counts = paths.groupBy("href").agg(F.count("*").alias("n_links"))
    return counts.join(_exact(routes).select(F.col("path").alias("href")), "href", "left_anti")
