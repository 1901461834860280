"""Hierarchy, lookups, charts and routing on the golden inputs."""

import random
from collections import defaultdict
from urllib.parse import urljoin

import fixtures
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siteops import functions as fx
from siteops.operators import hierarchy, lookup, routing


def test_flatten_keeps_childless_items_and_order(spark):
    rows = hierarchy.flatten(fixtures.menus(spark), "menus").collect()
    assert len(rows) == 12
    childless = [r for r in rows if r.sub_pos is None]
    assert [(r.menu, r.item_title, r.item_href) for r in childless] == [("Sites", "All sites", "/sites")]
    ordered = sorted((r for r in rows if r.menu == "Teams"), key=lambda r: (r.item_pos, r.sub_pos))
    assert [r.sub_title for r in ordered][:4] == ["Rules", "Papers", "Courses", "Bills"]
    assert len({(r.menu, r.item_pos) for r in rows}) == 5


def test_flatten_inner_drops_childless_items(spark):
    levels = (hierarchy.Level("item"), hierarchy.Level("sub", "subPages"))
    assert hierarchy.flatten(fixtures.menus(spark), "menus", levels).count() == 11


def test_lookup_needs_gate_and_entry(spark):
    flat = hierarchy.flatten(fixtures.menus(spark), "menus")
    menu_names = flat.select(F.col("menu").alias("label")).distinct()
    items = fixtures.nav_items(spark).union(
        spark.createDataFrame([("Ghost", "/ghost", True)], "label string, href string, has_mega boolean")
    )
    gate = F.col("has_mega")
    semi = lookup.lookup(items, menu_names, "label", gate, gate_only=True)
    assert sorted(r.label for r in semi.collect()) == ["Sites", "Teams"]
    dim = flat.withColumnRenamed("menu", "label").select("label", "item_title", "sub_title")
    assert lookup.lookup(items, dim, "label", gate).count() == 12


def test_lookup_default(spark):
    rows = [(1, "ghost", "lg"), (2, None, None), (3, "unknown", "sm"), (4, "", "icon")]
    df = spark.createDataFrame(rows, "n int, v string, s string")
    out = lookup.lookup_default(df, fixtures.variants(spark), {"variant": "v", "size": "s"})
    got = {r.n: (r.variant_text, r.size_text) for r in out.collect()}
    assert got == {
        1: ("look-ghost", "size-lg"), 2: ("look-default", "size-default"),
        3: (None, "size-sm"), 4: (None, "size-icon"),
    }
    assert out.columns == ["n", "v", "s", "variant_text", "size_text"]


def test_lookup_default_without_default_stays_empty(spark):
    dictionary = fixtures.variants(spark).withColumn("is_default", F.lit(False))
    df = spark.createDataFrame([(None,), ("ghost",)], "v string")
    got = lookup.lookup_default(df, dictionary, {"variant": "v"}).collect()
    assert sorted((r.v or "", r.variant_text or "") for r in got) == [("", ""), ("ghost", "look-ghost")]


CONFIG = {"desktop": "Desktop", "mobile": None, "chrome": "Chrome", "browser": "Browser", "value": "Any"}


def model_config(item, key):
    """Entry for an item by key, per the resolution rule; returns (found, label)."""
    named = key
    if isinstance(item["fields"].get(key), str):
        named = item["fields"][key]
    elif isinstance((item["payload"] or {}).get(key), str):
        named = item["payload"][key]
    for series in (named, key):
        if series in CONFIG:
            return CONFIG[series]
    return None


def test_resolve_label(spark):
    config = spark.createDataFrame(list(CONFIG.items()), "series string, label string")
    items, n = [], 0
    for name_key in (None, "", "browser", "name", "absent"):
        for name in ("desktop", "mobile", "", None, "zzz"):
            for payload in (None, {}, {"browser": "chrome"}, {"browser": "nope"}, {"browser": None},
                            {"name": "chrome"}):
                items.append((n, name_key, name, "desktop" if n % 2 else None, payload))
                n += 1
    df = spark.createDataFrame(
        items, "n int, nk string, name string, dk string, payload map<string,string>"
    )
    fields = {"name": F.col("name"), "dataKey": F.col("dk")}
    row = lookup.resolve_label(
        df, config, [F.col("nk"), F.col("name"), F.col("dk")], fields, F.col("payload"), F.col("name"),
        "row",
    )
    out = lookup.resolve_label(
        row, config, [F.col("nk"), F.col("dk")], fields, F.col("payload"), name="legend"
    )
    got = {r.n: (r.row, r.legend) for r in out.collect()}
    assert len(got) == len(items)
    for n, nk, name, dk, payload in items:
        item = {"fields": {"name": name, "dataKey": dk}, "payload": payload}
        row = model_config(item, nk or name or dk or "value") or name
        legend = model_config(item, nk or dk or "value")
        assert got[n] == (row, legend), items[n]


def test_tooltip_title(spark):
    config = spark.createDataFrame(list(CONFIG.items()), "series string, label string")
    rows = [
        (0, "desktop", None, "x", "y"), (1, "January", None, "x", "y"), (2, None, None, "desktop", "y"),
        (3, "desktop", "chrome", "x", "y"), (4, None, None, "zzz", "y"), (5, "mobile", "", "x", "y"),
        (6, "", None, "x", "y"),
    ]
    df = spark.createDataFrame(rows, "n int, label string, lk string, dk string, name string")
    out = lookup.tooltip_title(
        df, config, F.col("label"), F.col("lk"), F.col("dk"), F.col("name")
    )
    got = {r.n: r.title for r in out.collect()}
    assert got == {
        0: "Desktop", 1: "January", 2: "Desktop", 3: "Chrome", 4: None, 5: "mobile", 6: None
    }
    upper = lookup.tooltip_title(
        df, config, F.col("label"), F.col("lk"), F.col("dk"), F.col("name"), formatter=lambda title, payload: F.upper(title)
    )
    assert {r.n: r.title for r in upper.collect()}[1] == "JANUARY"


def test_expand_and_rollup(spark):
    config = fixtures.series_config(spark)
    got = sorted((r.series, r.variant, r.colour) for r in lookup.expand(config).collect())
    assert got == [
        ("desktop", "dark", "#111"), ("desktop", "light", "#111"), ("mobile", "light", "#222")
    ]
    styles = {r.chart: r["style"] for r in lookup.chart_styles(config, "chart").collect()}
    assert styles == {
        "c": "\n [data-chart=c] {\n  --color-desktop: #111;\n  --color-mobile: #222;\n}\n"
        "\n\n.dark [data-chart=c] {\n  --color-desktop: #111;\n\n}\n"
    }


def test_series_rows(spark):
    points = spark.createDataFrame(
        [("a", 0.0, 1234.5678), ("b", None, 0.0025), ("c", -1234567.0, 1e-9)],
        "x string, desktop double, mobile double",
    )
    config = spark.createDataFrame(list(CONFIG.items()), "series string, label string")
    rows = lookup.series_rows(points, ["x"], ["desktop", "mobile"], config).collect()
    got = {(r.x, r.name): (r.label, r.text) for r in rows}
    assert got == {
        ("a", "desktop"): ("Desktop", "0"), ("a", "mobile"): ("mobile", "1,234.568"),
        ("b", "desktop"): ("Desktop", None), ("b", "mobile"): ("mobile", "0.003"),
        ("c", "desktop"): ("Desktop", "-1,234,567"), ("c", "mobile"): ("mobile", "0"),
    }


def test_series_rows_with_formatters(spark):
    points = spark.createDataFrame([("a", 2.0, None)], "x string, desktop double, mobile double")
    config = spark.createDataFrame(list(CONFIG.items()), "series string, label string")

    @pandas_udf("string")
    def shout(value: pd.Series, name: pd.Series, pos: pd.Series) -> pd.Series:
        return name.str.upper() + pos.astype(str)

    plain = lambda value, name, item, index, payload: F.concat(
        item["dataKey"], F.lit("="), item["value"].cast("int").cast("string")
    )
    loud = lambda value, name, item, index, payload: shout(value, name, index)
    for formatter, want in ((plain, "desktop=2"), (loud, "DESKTOP0")):
        rows = lookup.series_rows(points, ["x"], ["desktop", "mobile"], config, formatter=formatter)
        assert {r.name: r.text for r in rows.collect()} == {"desktop": want, "mobile": None}


def test_series_rows_with_name_key_and_payload(spark):
    points = spark.createDataFrame(
        [("a", 2.0, {"kind": "mobile"}), ("b", 3.0, {}), ("c", 4.0, None)],
        "x string, desktop double, payload map<string,string>",
    )
    config = spark.createDataFrame([("desktop", "Desk"), ("mobile", "Phone"), ("kind", "Any")], "series string, label string")
    rows = lookup.series_rows(
        points, ["x"], ["desktop"], config, F.col("payload"), name_key="kind",
        formatter=lambda value, name, item, index, payload: F.coalesce(payload["kind"], name),
    )
    assert {r.x: (r.label, r.text) for r in rows.collect()} == {
        "a": ("Phone", "mobile"), "b": ("Any", "desktop"), "c": ("Any", "desktop"),
    }


def test_legend_rows(spark):
    items = spark.createDataFrame(
        [(1, "desktop", None), (2, "desktop", "mobile"), (3, "none", ""), (4, None, None)],
        "id int, key string, name_key string",
    )
    config = spark.createDataFrame([("desktop", "Desk"), ("mobile", "Phone"), ("value", "Val")], "series string, label string")
    rows = lookup.legend_rows(items, ["id"], config, F.col("key"), F.col("name_key")).collect()
    assert {r.id: (r.series, r.label) for r in rows} == {
        1: ("desktop", "Desk"), 2: ("mobile", "Phone"), 3: ("none", None), 4: ("value", "Val"),
    }


def test_chart_id(spark):
    df = spark.createDataFrame([(None, ":r1:"), ("", ":r2:"), ("sales", ":r3:")], "g string, u string")
    got = [r[0] for r in df.select(lookup.chart_id(F.col("g"), F.col("u"))).collect()]
    assert got == ["chart-r1", "chart-r2", "chart-sales"]


def test_routes(spark):
    paths = spark.createDataFrame([("/",), ("/a",), ("/b",), (None,)], "path string")
    resolve = lambda rows: {
        r.path: r.route
        for r in routing.resolve_route(paths, fixtures.routes(spark, rows)).collect()
    }
    assert resolve(fixtures.ROUTE_ROWS) == {"/": "/", "/a": "*", "/b": "*", None: "*"}
    assert resolve([(0, "/a"), (1, "*"), (2, "/b")]) == {"/": "*", "/a": "/a", "/b": "/b", None: "*"}
    assert resolve([(0, "*"), (1, "/a")]) == {"/": "*", "/a": "/a", "/b": "*", None: "*"}
    assert resolve([(0, "/a"), (5, "/a"), (7, "/")]) == {"/": "/", "/a": "/a", "/b": None, None: None}


def test_not_found(spark):
    paths = spark.createDataFrame([("/",), ("/a",), ("/a",), (None,)], "path string")
    got = routing.not_found(paths, fixtures.routes(spark)).collect()
    assert {r.path: r.n_accesses for r in got} == {"/a": 2, None: 1}


def test_dead_link_counts(spark):
    links = routing.nav_links(
        fixtures.menus(spark), fixtures.nav_items(spark), fixtures.quick_actions(spark)
    )
    assert links.count() == 26
    assert links.select("href").distinct().count() == 22
    dead = routing.dead_links(links, fixtures.routes(spark)).collect()
    assert len(dead) == 21
    assert sum(r.n_links for r in dead) == 25


def test_url_path(spark):
    urls = ["http://a.example/x/y?q=1#t", "https://a.example", "/rel", "no address", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(routing.url_path(F.col("url"))).collect()]
    assert got == ["/x/y", "/", "/rel", None, None]


def test_scalars(spark):
    df = spark.createDataFrame(
        [("Draft", 767, "b", True, None), ("Published", 768, "b", None, False), (None, None, "x", True, True)],
        "status string, width int, key string, meta boolean, ctrl boolean",
    )
    got = df.select(
        fx.status_variant(F.col("status")), fx.is_mobile(F.col("width")),
        fx.is_shortcut(F.col("key"), F.col("meta"), F.col("ctrl")),
        fx.remaining_percent(F.lit(None).cast("int")), fx.skeleton_width(7).between(50, 89),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("outline", True, True, 100, True), ("default", False, False, 100, True),
        ("default", False, False, 100, True),
    ]


@pytest.mark.parametrize("value, text", [
    (0.0, "0"), (-0.0, "0"), (0.0005, "0.001"), (1.0005, "1.001"), (-2.5, "-2.5"), (1e7, "10,000,000"),
    (999.9996, "1,000"), (None, None),
])
def test_format_value(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(fx.format_value(F.col("v"))).first()[0] == text


def test_id_wraps(spark):
    limit = (1 << 53) - 1
    df = spark.createDataFrame([(1,), (limit - 1,), (limit,), (limit + 1,)], "n bigint")
    got = [r[0] for r in df.select(fx.next_id(F.col("n"))).collect()]
    assert got == ["1", str(limit - 1), "0", "1"]


def test_lookups_start_no_job(spark):
    dim = spark.range(50).withColumnRenamed("id", "k")
    df = spark.range(500).select((F.col("id") % 70).alias("k"))
    spark.sparkContext.setJobGroup("lookups", "none should run")
    try:
        lookup.lookup(df, dim, "k")
        lookup.lookup(df, dim, "k", gate_only=True)
        routing.not_found(df.select(F.lit("/a").alias("path")), dim.select(F.lit("/").alias("path")))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lookups")
        assert lookup.lookup(df, dim, "k").count() == 50 * 7 + 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_link_paths(spark):
    cases = {
        "/en/5": "/en/5", "/en/5?x=1": "/en/5", "/en/5#top": "/en/5", "#": None, "#top": None, "?x=1": None,
        "https://own.example/en/5?q#t": "/en/5", "HTTP://OWN.example": "/", "//own.example/a": "/a",
        "https://other.example/en/5": None, "mailto:a@own.example": None, "tel:+1": None, "": None, None: None,
        "page": "page",
    }
    df = spark.createDataFrame([(h,) for h in cases], "href string")
    got = df.select("href", routing.link_path(F.col("href"), ["own.example"]).alias("path")).collect()
    assert {r.href: r.path for r in got} == cases
    routes = spark.createDataFrame([("*",), ("/en/5",)], "path string")
    dead = routing.dead_links(df, routes, ["own.example"]).collect()
    assert {r.href: r.n_links for r in dead} == {"/": 1, "/a": 1, "page": 1}


# The examples of RFC 3986, section 5.4, of what references mean on this page.
RFC_BASE = "http://a/b/c/d;p?q"
RFC_EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g",
    "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
    "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
    "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g",
    "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..",
    "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x",
    "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_resolve_url(spark):
    rows = [(h, RFC_BASE, want) for h, want in RFC_EXAMPLES.items()]
    rows += [
        ("g", "http://a", "http://a/g"), ("g", "http://a?x=/y/z", "http://a/g"), ("", "http://a/b#c", "http://a/b"),
        ("?", "http://a/b?q", "http://a/b?"), ("/a//../b", "http://h/", "http://h/a/b"), ("é/../ü", "http://h/x/", "http://h/x/ü"),
        ("../" * 3000 + "x", "http://h/" + "s/" * 2000, "http://h/x"), (None, "http://a", None), ("g", None, None),
    ]
    df = spark.createDataFrame(rows, "href string, base string, want string")
    got = df.withColumn("got", routing.resolve_url(F.col("href"), F.col("base"))).collect()
    assert [(r.href, r.got) for r in got if r.got != r.want] == []


def test_resolve_url_equals_library(spark):
    rng = random.Random(5)
    pick = lambda *options: rng.choice(options)

    def path(root):
        parts = [pick("a", "b", "..", ".", "c.d", "...") for _ in range(rng.randint(0, 6))]
        return pick("/", root) + "/".join(parts) if parts else root

    rows = []
    for _ in range(300):
        base = f"http://h{path('/')}"
        href = path("") + pick("", "?x=1") + pick("", "#f")
        rows.append((href, base))
    df = spark.createDataFrame(rows, "href string, base string")
    got = df.withColumn("got", routing.resolve_url(F.col("href"), F.col("base"))).collect()
    for r in got:
        joined = urljoin(r.base, r.href)
        assert r.got == joined, r


HTML_FORMS = [
    ('<a href="/a">', ["/a"]), ("<a href='/b'>", ["/b"]), ('<A HREF="/c">', ["/c"]), ("<a href=/d>", ["/d"]),
    ("<a href = \n '/e' >", ["/e"]), ('<a href="/f?a=1&amp;b=2">', ["/f?a=1&b=2"]), ("<a class=x\thref=/g>", ["/g"]),
    ('<a title="a > b" href="/h">', ["/h"]), ("<a title=don't href=/i>", ["/i"]), ('<a/href="/j"/>', ["/j"]),
    ('<area href="/k">', ["/k"]), ('<abbr href="/no"><link href="/no"><a data-href="/no">', []),
    ('<!-- <a href="/no"> --><a href="/l">', ["/l"]), ('<!--><a href="/m">', ["/m"]), ('<!-- > <a href="/no">', []),
    ('<script>x = "<a href=/no>"</script><a href="/n">', ["/n"]), ('<STYLE a=b> <a href=/no> </style\n>', []),
    ('<script><a href="/no"></scripty>', []), ('<img alt="<a href=\'/no\'>"><a href="/o">', ["/o"]),
    ('<a href="/p" href="/no">', ["/p"]), ("<a href><a href=''><a href=\"\">", []), ('<a href="  /q\n/r ">', ["/q/r"]),
    ('<a href="/&#233;&#xE9;&eacute;&apos;&lt;">', ["/ééé'<"]), ('<a href="/s?x&y=1&copy=2&nope;&#0;&#xD800;">', ["/s?x&y=1&copy=2&nope;��"]),
    ("<a href=/t/>", ["/t/"]), ('<p>1 < 2 <a href="/u">x</a>', ["/u"]), ('<a href="/no', []), ("</a href='/no'>", []),
    ('<a href=/v?x="y">', ['/v?x="y"']), ("", []), (None, []),
]


def test_links_of_html(spark):
    pages = [(i, h) for i, (h, _) in enumerate(HTML_FORMS)]
    pages.append((len(pages), "<p " + "a='1' " * 5000 + ">" + "1<" * 50000 + "".join(f"<a href=/{i}>" for i in range(3000)) + '"' * 9999))
    want = [*[w for _, w in HTML_FORMS], [f"/{i}" for i in range(3000)]]
    got = defaultdict(list)
    for r in routing.page_links(spark.createDataFrame(pages, "id int, html string"), keep=("id",)).collect():
        got[r.id].append(r.href)
    assert [(HTML_FORMS[i] if i < len(HTML_FORMS) else "", got[i]) for i, w in enumerate(want) if got[i] != w] == []


def test_links_relative_to_pages(spark):
    pages = [
        (1, "http://h.example/en/5?x", '<a href="a.html"><a href="./b.html"><a href="../c.html"><a href="/en/../en/d"><a href="#t"><a href="?q">'),
        (2, "http://h.example/de/x/", "<base target=_top><base href='../fr/'><base href='/no/'><a href=e><a href=//h.example/f><a href='http://other.example/en/d'>"),
        (3, None, '<a href="g"><a href="http://own.example/en/d"><a href="http://own.example">'),
        (4, "http://H.example/", '<a href="mailto:a@b"><a href="en/d"><a href="HTTP://h.EXAMPLE/h">'),
    ]
    df = spark.createDataFrame(pages, "id int, url string, html string")
    links = routing.page_links(df, url="url")
    assert links.columns == ["base", "href"]
    routes = spark.createDataFrame([("*",), ("/en/d",), ("/c.html",)], "path string")
    dead = routing.dead_links(links, routes, ["own.example"], base="base").collect()
    assert {r.href: r.n_links for r in dead} == {
        "/en/a.html": 1, "/en/b.html": 1, "/de/fr/e": 1, "/f": 1, "/": 1, "/h": 1,
    }
