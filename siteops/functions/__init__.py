from siteops.functions.scalars import (
    as_flag,
    cookie_text,
    first_truthy,
    format_value,
    has_colour,
    is_empty,
    is_mobile,
    is_one_of,
    is_shortcut,
    next_id,
    open_label,
    remaining_percent,
    skeleton_width,
    status_variant,
    strip_colons,
    style_line,
    truthy,
)

__all__ = [
    "as_flag",
    "cookie_text",
    "first_truthy",
    "format_value",
    "has_colour",
    "is_empty",
    "is_mobile",
    "is_one_of",
    "is_shortcut",
    "next_id",
    "open_label",
    "remaining_percent",
    "skeleton_width",
    "status_variant",
    "strip_colons",
    "style_line",
    "truthy",
]
