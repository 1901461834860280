"""Column expressions shared by the jobs. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the observed behaviour.
MAX_SAFE_INTEGER = 9007199254740991  # ids restart after this
MOBILE_BREAKPOINT = 768  # px; below is mobile
SHORTCUT_KEY = "b"
SKELETON_MIN, SKELETON_SPAN = 50, 40  # whole percents 50 to 89


def truthy(text: Column) -> Column:
    """A string where it is neither null nor empty, else null."""
    return F.nullif(text, F.lit(""))


def first_truthy(*texts: Column) -> Column:
    """First string that is neither null nor empty."""
    return F.coalesce(*[truthy(t) for t in texts])


def status_variant(status: Column) -> Column:
    """Drafts are outlined; everything else, unknown status included, takes the default look."""
    return F.when(status == "Draft", "outline").otherwise("default")


def is_mobile(width: Column) -> Column:
    """Strictly narrower than the breakpoint; an unknown width is not mobile."""
    return F.coalesce(width < MOBILE_BREAKPOINT, F.lit(False))


def open_label(is_open: Column) -> Column:
    return F.when(is_open, "expanded").otherwise("collapsed")


def is_shortcut(key: Column, meta: Column, ctrl: Column) -> Column:
    """The toggle shortcut: its key together with meta or ctrl."""
    held = F.coalesce(meta, F.lit(False)) | F.coalesce(ctrl, F.lit(False))
    return F.coalesce(key == SHORTCUT_KEY, F.lit(False)) & held


def is_one_of(value: Column, *accepted: str) -> Column:
    """Membership in a short list; null is no member."""
    return F.coalesce(value.isin(*accepted), F.lit(False))


def has_colour(theme: Column, colour: Column) -> Column:
    """A series takes part in styling when it has a theme or a non-empty colour."""
    return theme.isNotNull() | truthy(colour).isNotNull()


def strip_colons(text: Column) -> Column:
    return F.translate(text, ":", "")


def style_line(series: Column, colour: Column) -> Column:
    """One custom-property line; null without a colour."""
    return F.concat(F.lit("  --color-"), series, F.lit(": "), colour, F.lit(";"))


def cookie_text(name: str, is_open: Column, max_age_seconds: int) -> Column:
    return F.format_string(f"{name}=%s; path=/; max-age={max_age_seconds}", is_open.cast("string"))


def format_value(value: Column) -> Column:
    """Number with thousands separators and up to three decimals, half rounded away from zero.

    `format_number` alone rounds half to even, hence the inner `round`. Zero stays "0" and null
    stays null.
    """
    grouped = F.call_function("format_number", F.round(value, 3), F.lit("#,##0.###"))
    return F.when(value == 0, F.lit("0")).otherwise(grouped)


def remaining_percent(value: Column) -> Column:
    return 100 - F.coalesce(value, F.lit(0))


def skeleton_width(seed: int | None = None) -> Column:
    """Random whole percent, 50 to 89."""
    return (F.floor(F.rand(seed) * SKELETON_SPAN) + SKELETON_MIN).cast("int")


def next_id(count: Column) -> Column:
    """Text id for the n-th issue, wrapping like the counter it stands for."""
    return (count % MAX_SAFE_INTEGER).cast("string")


def as_flag(text: Column) -> Column:
    """Boolean that a text stands for, as Spark casts it; null for any other text."""
    return text.try_cast("boolean")


def is_empty(items: Column) -> Column:
    """True for a null or zero-length array."""
    return F.coalesce(F.size(items), F.lit(0)) <= 0
