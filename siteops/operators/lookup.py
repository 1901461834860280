"""Lookups with gates, defaults and fallbacks, and the chart helpers built on them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siteops.functions import first_truthy, format_value, has_colour, strip_colons, style_line, truthy

# Fixed values of the observed behaviour: theme name and the selector that precedes its block.
THEMES = {"light": "", "dark": ".dark"}
DEFAULT_KEY = "value"


def lookup(
    df: DataFrame,
    dim: DataFrame,
    key: str,
    gate: Column | None = None,
    gate_only: bool = False,
) -> DataFrame:
    """Rows that pass `gate` and whose `key` is in `dim`, with the dim's columns.

    A null gate is false. `gate_only` tests membership and adds no column. The sizes that Spark knows
    of the two sides, from files or at run time, decide how they are joined.
    """
    if gate is not None:
        df = df.filter(F.coalesce(gate, F.lit(False)))
    if gate_only:
        return df.join(dim.select(key), key, "left_semi")
    return df.join(dim, key)


def lookup_default(
    df: DataFrame,
    dictionary: DataFrame,
    choices: Mapping[str, str],
    suffix: str = "_text",
) -> DataFrame:
    """Looks up one or more variant choices; a missing choice takes the default of its axis.

    `dictionary` has axis, value, text and is_default; `choices` maps an axis to the column that
    holds the choice. A choice that the dictionary does not know gives null. The dictionary is one of
    texts that people write, small enough to be sent to every task.
    """
    for axis, column in choices.items():
        entries = dictionary.filter(F.col("axis") == axis)
        named = entries.select(F.col("value").alias("_value"), F.col("text").alias(axis + suffix))
        missing = entries.filter("is_default").select(
            F.lit(None).cast("string").alias("_value"), F.col("text").alias(axis + suffix)
        )
        side = F.broadcast(named.unionByName(missing))
        df = df.join(side, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")
    return df


def payload_key(*candidates: Column) -> Column:
    """First usable candidate, in the caller's order, else "value"."""
    return first_truthy(*candidates, F.lit(DEFAULT_KEY))


def resolve_config(
    df: DataFrame,
    config: DataFrame,
    key: Column,
    fields: Mapping[str, Column] | None = None,
    payload: Column | None = None,
    name: str = "config",
) -> DataFrame:
    """Adds the config row of an item as struct `name`, null when there is none.

    If the item has a text field named by `key`, that text is the series to look for; else the same
    field of its nested payload; else `key` itself. When the config has no such series, `key` is
    looked up instead. `config` has one row per `series` of a chart, as written by hand, and is sent to
    every task.
    """
    steps = []
    if fields:
        steps.append(F.create_map(*[x for n, c in fields.items() for x in (F.lit(n), c)])[F.col("_key")])
    if payload is not None:
        steps.append(payload[F.col("_key")])
    out = df.withColumn("_key", key).withColumn("_named", F.coalesce(*steps, F.col("_key")))
    entry = F.struct(*config.columns)
    side = F.broadcast(config.select(F.col("series").alias("_series"), entry.alias("_entry")))
    for column in ("_named", "_key"):
        renamed = side.withColumnsRenamed({"_series": f"_s{column}", "_entry": f"_e{column}"})
        out = out.join(renamed, F.col(column) == F.col(f"_s{column}"), "left")
    return out.withColumn(name, F.coalesce("_e_named", "_e_key")).select(*df.columns, name)


def resolve_label(
    df: DataFrame,
    config: DataFrame,
    keys: Sequence[Column],
    fields: Mapping[str, Column] | None = None,
    payload: Column | None = None,
    fallback: Column | None = None,
    name: str = "label",
) -> DataFrame:
    """Adds the label of each item; `keys` are the candidates for the lookup key, in order.

    Tooltip rows use (nameKey, name, dataKey) with the name as fallback; legends use (nameKey,
    dataKey) without one.
    """
    out = resolve_config(df, config, payload_key(*keys), fields, payload, "_config")
    label = F.col("_config.label")
    if fallback is not None:
        label = F.coalesce(truthy(label), fallback)
    return out.withColumn(name, label).drop("_config")


def tooltip_title(
    df: DataFrame,
    config: DataFrame,
    label: Column | None,
    label_key: Column | None,
    data_key: Column,
    item_name: Column,
    payload: Column | None = None,
    fields: Mapping[str, Column] | None = None,
    formatter: Callable[[Column, Column | None], Column] | None = None,
    name: str = "title",
) -> DataFrame:
    """Title of a tooltip, from its first item.

    Without a label key, a text label is looked up and used as it is when the config lacks it.
    Otherwise the item's own label applies. An empty title is null. `formatter(title, payload)` has the
    last word.
    """
    none = F.lit(None).cast("string")
    label, label_key = none if label is None else label, none if label_key is None else label_key
    out = df.withColumns({"_text": label, "_label_key": truthy(label_key)})
    keys = payload_key(F.col("_label_key"), data_key, item_name)
    out = resolve_config(out, config, keys, fields, payload, "_item")
    out = resolve_config(out, config, F.col("_text"), name="_named")
    by_text = F.col("_label_key").isNull() & F.col("_text").isNotNull()
    title = F.when(by_text, F.coalesce(truthy(F.col("_named.label")), F.col("_text"))).otherwise(
        F.col("_item.label")
    )
    title = formatter(title, payload) if formatter is not None else truthy(title)
    return out.withColumn(name, title).select(*df.columns, name)


def expand(
    config: DataFrame, themes: Sequence[str] = tuple(THEMES), keep_empty: bool = False
) -> DataFrame:
    """Each series once per theme, with its `colour`: the theme's own, else the series colour.

    Series without theme and colour are left out before they are multiplied. Rows whose colour turns
    out empty are dropped, or kept with null when `keep_empty`.
    """
    variants = F.array(*[F.lit(t) for t in themes])
    out = (
        config.filter(has_colour(F.col("theme"), F.col("color")))
        .select("*", F.posexplode(variants).alias("variant_pos", "variant"))
        .withColumn("colour", first_truthy(F.col("theme")[F.col("variant")], F.col("color")))
        .drop("theme", "color")
    )
    return out if keep_empty else out.filter(F.col("colour").isNotNull())


def rollup_text(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    sep: str = "\n",
    empty_lines: bool = True,
    name: str = "text",
) -> DataFrame:
    """Joins the lines of each group in order into one text.

    Null lines become empty ones, or are skipped without `empty_lines`. A group's result is a single
    value, so a group has to fit in one row; use keys for which that holds.
    """
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_line"))))
    lines = F.transform(rows, lambda r: r["_line"])
    joined = F.array_join(lines, sep, "") if empty_lines else F.array_join(lines, sep)
    return df.groupBy(*keys).agg(joined.alias(name))


def chart_styles(config: DataFrame, chart: str, themes: Mapping[str, str] = THEMES) -> DataFrame:
    """Style text of each chart: one block per theme with the colour of every series.

    `config` has the chart id, pos, series, color and theme. Charts without any colour get no row.
    """
    # One shuffle by chart, before rows are multiplied, serves both rollups.
    lines = expand(config.repartition(chart), tuple(themes), keep_empty=True).withColumn(
        "line", style_line(F.col("series"), F.col("colour"))
    )
    blocks = rollup_text(lines, [chart, "variant_pos", "variant"], ["pos", "series"], "line")
    prefix = F.create_map(*[F.lit(x) for pair in themes.items() for x in pair])[F.col("variant")]
    opening = F.concat(F.lit("\n"), prefix, F.lit(" [data-chart="), F.col(chart), F.lit("] {\n"))
    blocks = blocks.withColumn("text", F.concat(opening, F.col("text"), F.lit("\n}\n")))
    return rollup_text(blocks, [chart], ["variant_pos"], "text", name="style")


def chart_id(given: Column, unique: Column) -> Column:
    return F.concat(F.lit("chart-"), F.coalesce(truthy(given), strip_colons(unique)))


def series_rows(
    df: DataFrame,
    ids: Sequence[str],
    measures: Sequence[str],
    config: DataFrame,
    payload: Column | None = None,
    formatter: Callable[[Column, Column, Column, Column, Column], Column] | None = None,
    name_key: str | None = None,
) -> DataFrame:
    """One row per measure of each point: ids, name, value, label and formatted text.

    `name_key` is looked up in place of the measure's name. The label is the configured one, else the
    measure's name. Text is "0" for zero and null for a missing value. `formatter(value, name, item,
    index, payload)` replaces the text of present values; it takes and returns columns, the item being a
    struct of name, dataKey and value.
    """
    nested = F.lit(None).cast("map<string,string>") if payload is None else payload
    long = df.select(*ids, nested.alias("_payload"), *[F.col(m).cast("double").alias(m) for m in measures])
    rows = long.unpivot([*ids, "_payload"], list(measures), "name", "value")
    keys = [F.lit(name_key), F.col("name")]
    if payload is None and name_key not in ("name", "dataKey"):
        # Without a payload the label follows from the measure alone, so it is resolved once for each.
        names = df.sparkSession.createDataFrame([(m,) for m in measures], "name string")
        own = {"name": F.col("name"), "dataKey": F.col("name")}
        labels = resolve_label(names, config, keys, own, fallback=F.col("name"))
        rows = rows.join(F.broadcast(labels), "name")
    else:
        rows = resolve_label(
            rows, config, keys, {"name": F.col("name"), "dataKey": F.col("name")}, F.col("_payload"),
            fallback=F.col("name"),
        )
    text = format_value(F.col("value"))
    if formatter is not None:
        index = F.array_position(F.array(*[F.lit(m) for m in measures]), F.col("name")) - 1
        item = F.struct("name", F.col("name").alias("dataKey"), "value")
        usable = F.col("value").isNotNull() & truthy(F.col("name")).isNotNull()
        made = formatter(F.col("value"), F.col("name"), item, index, F.col("_payload"))
        text = F.when(usable, made).otherwise(text)
    return rows.select(*ids, "name", "value", "label", text.alias("text"))


def legend_rows(
    df: DataFrame,
    ids: Sequence[str],
    config: DataFrame,
    data_key: Column,
    name_key: Column | None = None,
    fields: Mapping[str, Column] | None = None,
    payload: Column | None = None,
) -> DataFrame:
    """The legend entry of each item: ids, series, and the label of its config, null where it has none.

    The series is the name key, else the item's data key, else "value".
    """
    keys = [data_key] if name_key is None else [name_key, data_key]
    out = resolve_label(df, config, keys, fields, payload)
    return out.select(*ids, payload_key(*keys).alias("series"), "label")
