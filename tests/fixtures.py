"""Small golden inputs: navigation tables, routes, variants and chart series."""

from pyspark.sql import types as T

SUB = T.StructType([T.StructField("title", T.StringType()), T.StructField("href", T.StringType())])
ITEM = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("subPages", T.ArrayType(SUB)),
])
MENUS = T.StructType([T.StructField("menus", T.MapType(T.StringType(), T.ArrayType(ITEM)))])


def section(name, subs):
    slug = name.lower()
    pages = [(s, f"/teams/{slug}/{s.lower()}") for s in subs]
    return (name, f"About {name}", f"/teams/{slug}", pages)


MENU_ROWS = [({
    "Sites": [("All sites", "Every site", "/sites", None)],
    "Teams": [
        section("People", ["Rules", "Papers", "Courses"]),
        section("Money", ["Bills", "Plans", "Sums"]),
        section("Tech", ["Desk", "Access"]),
        section("Safety", ["Laws", "Norms", "Checks"]),
    ],
},)]
NAV_ROWS = [
    ("Home", "/", None), ("Sites", "/sites", True), ("People", "/people", None), ("Teams", "/teams", True)
]
QUICK_ROWS = [
    ("New", "/requests/new"), ("Room", "/sites/rooms"), ("Desk", "/teams/tech/desk"),
    ("People", "/people"), ("Rules", "/teams/people/rules"), ("Settings", "/settings"),
]
ROUTE_ROWS = [(0, "/"), (1, "*")]


def menus(spark):
    return spark.createDataFrame(MENU_ROWS, MENUS)


def nav_items(spark):
    return spark.createDataFrame(NAV_ROWS, "label string, href string, has_mega boolean")


def quick_actions(spark):
    return spark.createDataFrame(QUICK_ROWS, "label string, href string")


def routes(spark, rows=ROUTE_ROWS):
    return spark.createDataFrame(list(rows), "priority int, path string")


VARIANT_ROWS = [
    ("variant", v, f"look-{v}", v == "default")
    for v in ("default", "destructive", "outline", "secondary", "ghost", "link")
] + [("size", v, f"size-{v}", v == "default") for v in ("default", "sm", "lg", "icon")]


def variants(spark):
    return spark.createDataFrame(VARIANT_ROWS, "axis string, value string, text string, is_default boolean")


SERIES_ROWS = [
    ("c", 0, "desktop", "Desktop", "#111", None),
    ("c", 1, "mobile", None, None, {"light": "#222", "dark": ""}),
    ("c", 2, "other", "Other", None, None),
    ("d", 0, "none", "None", "", None),
]


def series_config(spark):
    return spark.createDataFrame(
        SERIES_ROWS,
        "chart string, pos int, series string, label string, color string, theme map<string,string>",
    )
