"""Menus, lookups, charts and routes derived from the warehouse tables and the crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteops import functions as fx
from siteops.operators import hierarchy, lookup, routing
from siteops.sources import prepare_streams, read_table, stream_table
from siteops.streaming import not_found_stream, run_to_parquet


def page_menus(pages: DataFrame) -> DataFrame:
    """Each page as a nested menu: its navigation anchors, and its paragraphs with their sentence ends.

    Anchors have no sub-pages; paragraphs have a possibly empty list of them.
    """
    sub = "array<struct<title: string, href: string>>"
    anchors = F.transform(
        F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1),
        lambda h: F.struct(h.alias("title"), h.alias("href"), F.lit(None).cast(sub).alias("subPages")),
    )
    paragraphs = F.transform(
        F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), 1),
        lambda p: F.struct(
            p.alias("title"),
            F.lit("#").alias("href"),
            F.transform(
                F.regexp_extract_all(p, F.lit("[^. ]+[.]"), 0),
                lambda s: F.struct(s.alias("title"), F.concat(F.lit("#"), s).alias("href")),
            ).alias("subPages"),
        ),
    )
    menus = F.create_map(F.lit("Navigation"), anchors, F.lit("Article"), paragraphs)
    return pages.select("page_id", menus.alias("menus"))


def flat_menus(spark, folder):
    menus = page_menus(read_table(spark, folder, "pages"))
    return hierarchy.flatten(menus, "menus", keep=["page_id"])


def supplier_menus(spark, folder):
    """Small menus of region, nation and up to 64 suppliers, flat again.

    Each block of 64 supplier keys is a menu of its own, which bounds the size of every array; positions
    count within it.
    """
    suppliers = read_table(spark, folder, "supplier")
    regions = read_table(spark, folder, "region")
    nations = (
        read_table(spark, folder, "nation")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    )
    subs = suppliers.groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 64).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("subPages")
    )
    # Nations without suppliers are added, rather than kept by an outer join on 25 keys.
    childless = nations.join(suppliers.select("s_nationkey").distinct(), "s_nationkey", "left_anti")
    rows = (
        subs.join(nations, "s_nationkey")
        .unionByName(childless, allowMissingColumns=True)
        .select(
            "block",
            F.create_map(
                "r_name", F.array(F.struct(F.col("n_name").alias("title"), "subPages"))
            ).alias("menus"),
        )
    )
    levels = (hierarchy.Level("item"), hierarchy.Level("sub", "subPages", outer=True))
    return hierarchy.flatten(rows, "menus", levels, keep=["block"]).drop("menu_pos", "item_pos")


def returned_with_supplier(spark, folder):
    """Returned items, looked up in the suppliers."""
    items = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"
    )
    suppliers = read_table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name"
    )
    found = lookup.lookup(items, suppliers, "l_suppkey", F.col("l_returnflag") == "R")
    return found.select("l_orderkey", "l_linenumber", "l_suppkey", "s_name")


def nations_with_suppliers(spark, folder):
    nations = read_table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    present = read_table(spark, folder, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return lookup.lookup(
        nations, present, "n_nationkey", F.col("n_regionkey") > 0, gate_only=True
    )


# axis, value, text, is_default
PRIORITY_TEXTS = [
    ("priority", "1-URGENT", "act now", False),
    ("priority", "2-HIGH", "act soon", False),
    ("priority", "3-MEDIUM", "plan", True),
    ("priority", "4-NOT SPECIFIED", "ask", False),
    ("status", "F", "finished", False),
    ("status", "O", "open", True),
]


def priority_texts(spark, folder):
    """Orders with texts for priority and status; pending orders take the default of both."""
    dictionary = spark.createDataFrame(
        PRIORITY_TEXTS, "axis string, value string, text string, is_default boolean"
    )
    settled = F.col("o_orderstatus") != "P"
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey", F.when(settled, F.col("o_orderpriority")).alias("priority"),
        F.when(settled, F.col("o_orderstatus")).alias("status"),
    )
    return lookup.lookup_default(orders, dictionary, {"priority": "priority", "status": "status"})


# pos, series, label
EVENT_SERIES = [
    (0, "click", "Clicks"), (1, "view", "Views"), (2, "signup", ""), (3, "7", "Seven"),
    (4, "42", "Forty-two"), (5, "k", "Other k"), (6, "value", "Value"),
]


def event_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EVENT_SERIES, "pos int, series string, label string")


def _labelled_events(spark, folder):
    """Items that are named by their payload's k, by their type, or by nothing, by value."""
    key = F.when(F.col("value") > 20, "k").when(F.col("value") > 5, "event_type").otherwise("")
    return read_table(spark, folder, "events").select(
        "event_id", "event_type", key.alias("name_key"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("payload"),
    )


def event_labels(spark, folder):
    items = _labelled_events(spark, folder)
    out = lookup.resolve_label(
        items, event_config(spark), [F.col("name_key")], {"event_type": F.col("event_type")},
        F.col("payload"), fallback=F.col("event_type"),
    )
    return out.select("event_id", "label")


def event_legends(spark, folder):
    """Legend entries of events, by their name key, else their type; unknown series have no label."""
    return lookup.legend_rows(
        _labelled_events(spark, folder), ["event_id"], event_config(spark), F.col("event_type"),
        F.col("name_key"), {"event_type": F.col("event_type")}, F.col("payload"),
    )


def skeleton_widths(spark, folder):
    """Random widths of events: how many are in the range, and whether one seed gives one result."""
    widths = read_table(spark, folder, "events").select(
        "event_type", fx.skeleton_width(7).alias("a"), fx.skeleton_width(7).alias("b")
    )
    return widths.groupBy("event_type").agg(
        F.count_if(F.col("a").between(50, 89)).alias("n_in_range"),
        F.count_if(F.col("a") == F.col("b")).alias("n_same"),
        (F.count_distinct("a") > 20).alias("varied"),
    )


def event_titles(spark, folder):
    """Titles by text label where there is no label key, else by the item."""
    items = _labelled_events(spark, folder)
    out = lookup.tooltip_title(
        items, event_config(spark), F.when(F.col("event_type") != "error", F.col("event_type")),
        F.when(F.col("name_key") == "k", F.col("name_key")), F.lit("event_type"),
        F.col("event_type"), F.col("payload"), {"event_type": F.col("event_type")},
    )
    return out.select("event_id", "title")


def order_charts(spark, folder):
    """Each order as a chart whose series are its lines: some have a colour, some a theme."""
    theme = F.create_map(
        F.lit("light"), F.lit("#l"), F.lit("dark"), F.when(F.col("l_tax") > 0.04, "#d")
    )
    return read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("chart"), F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("series"),
        F.when(F.col("l_returnflag") == "R", "#r").when(F.col("l_returnflag") == "A", "").alias("color"),
        F.when(F.col("l_linestatus") == "O", theme).alias("theme"),
    )


def series_colours(spark, folder):
    return lookup.expand(order_charts(spark, folder)).drop("variant_pos")


def colour_lines(spark, folder):
    lines = lookup.expand(order_charts(spark, folder), keep_empty=True).withColumn(
        "line", fx.style_line(F.col("series"), F.col("colour"))
    )
    keys = ["chart", "variant"]
    rows = F.sort_array(F.collect_list(F.struct("pos", "series", "line")))
    texts = F.transform(rows, lambda r: r["line"])
    return lines.groupBy(*keys).agg(
        F.array_join(texts, "\n", "").alias("with_empty"), F.array_join(texts, "\n").alias("dense")
    )


def chart_styles(spark, folder):
    return lookup.chart_styles(order_charts(spark, folder), "chart")


MEASURE_LABELS = [(0, "l_quantity", "Quantity"), (1, "l_extendedprice", "Price"), (2, "l_tax", "")]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def measure_rows(spark, folder):
    """Line measures as rows; the tax of returned items is unknown."""
    config = spark.createDataFrame(MEASURE_LABELS, "pos int, series string, label string")
    tax = F.when(F.col("l_returnflag") != "R", F.col("l_tax"))
    items = read_table(spark, folder, "lineitem").withColumn("l_tax", tax)
    return lookup.series_rows(items, ["l_orderkey", "l_linenumber"], MEASURES, config).drop("value")


def measure_rows_with_unit(spark, folder):
    """The same with a caller's formatter, here an expression."""
    config = spark.createDataFrame(MEASURE_LABELS, "pos int, series string, label string")
    return lookup.series_rows(
        read_table(spark, folder, "orders"), ["o_orderkey"], ["o_totalprice"], config,
        formatter=lambda value, name, item, index, payload: F.concat(
            fx.format_value(item["value"]), F.lit(" of "), name, F.lit(" #"), index.cast("string")
        ),
    ).select("o_orderkey", "label", "text")


def _paths(spark, folder):
    pages = read_table(spark, folder, "pages")
    return pages.select("page_id", routing.url_path(F.col("url")).alias("path"))


def _routes(spark, folder):
    """English pages are routed one by one, everything else by the catch-all."""
    english = _paths(spark, folder).filter(F.col("path").startswith("/en/")).select("path").distinct()
    catch_all = spark.createDataFrame([(1, routing.CATCH_ALL)], "priority int, path string")
    return english.select(F.lit(0).alias("priority"), "path").unionByName(catch_all)


def page_routes(spark, folder):
    return routing.resolve_route(_paths(spark, folder), _routes(spark, folder), catch_all=True)


def unrouted_accesses(spark, folder):
    return routing.not_found(_paths(spark, folder), _routes(spark, folder))


def unrouted_accesses_as_stream(spark, folder):
    prepare_streams(spark)
    pages = stream_table(spark, f"{folder}/pages*.parquet", "pages")
    paths = pages.select(routing.url_path(F.col("url")).alias("path"))
    out = run_to_parquet(not_found_stream(paths, _routes(spark, folder)), "update")
    return out.groupBy("path").agg(F.max_by("n_accesses", "batch_id").alias("n_accesses"))


def dead_page_links(spark, folder):
    """Link targets in the crawled HTML that are no crawled page's path."""
    pages = read_table(spark, folder, "pages")
    routes = _paths(spark, folder).select("path").distinct()
    return routing.dead_links(routing.page_links(pages), routes)


#: Other forms of the same link, by page: relative, unquoted, in capitals, with references, commented out.
LINK_FORMS = [
    '<a href="/$1">', "<A class=n HREF='./$1'>", "<a href = ../$1>", '<a href="$1?a=1&amp;b=2#t">',
    '<!-- <a href="/$1"> --><a href="//other.example/$1">',
]


def dead_relative_links(spark, folder):
    """Link targets that are no crawled page's path, where pages write their links in several forms."""
    pages = read_table(spark, folder, "pages")
    form = F.element_at(F.array(*map(F.lit, LINK_FORMS)), (F.col("page_id") % len(LINK_FORMS) + 1).cast("int"))
    html = F.regexp_replace("html", F.lit('<a href="/([^"]*)">'), form)
    links = routing.page_links(pages.withColumn("html", html), url="url")
    return routing.dead_links(links, _paths(spark, folder).select("path").distinct(), base="base")


def scalar_values(spark, folder):
    """The scalar expressions, applied to events."""
    event, value = F.col("event_type"), F.col("value")
    theme = F.when(value > 30, F.create_map(F.lit("light"), F.lit("#l")))
    items = F.when(event == "click", F.array()).when(event == "view", F.array(event))
    keys = (F.when(event == "click", ""), F.when(value > 9, event), F.lit("value"))
    return read_table(spark, folder, "events").select(
        "event_id",
        fx.status_variant(F.when(event == "view", "Draft").otherwise(event)).alias("variant"),
        fx.is_mobile(F.floor(value * 10).cast("int")).alias("is_mobile"),
        fx.open_label(value > 20).alias("panel"),
        fx.is_shortcut(F.substring(event, 4, 1), value > 50, event == "error").alias("shortcut"),
        fx.is_one_of(event, "click", "view").alias("pointer"),
        fx.has_colour(theme, F.nullif(event, F.lit("error"))).alias("styled"),
        fx.strip_colons(F.col("props")).alias("stripped"),
        fx.cookie_text("panel", value > 20, 604800).alias("cookie"),
        fx.format_value(value * 1000).alias("formatted"),
        fx.remaining_percent(F.when(value <= 100, F.floor(value))).cast("bigint").alias("remaining"),
        fx.next_id(F.col("event_id")).alias("text_id"),
        fx.first_truthy(*keys).alias("key"),
        fx.is_empty(items).alias("is_empty"),
    )
