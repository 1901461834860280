"""Flattening of nested maps and arrays into rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T


@dataclass(frozen=True)
class Level:
    """One array level: its `name`, the parent's field that holds it, and whether parents without
    children are kept."""

    name: str
    field: str | None = None
    outer: bool = False


# The three-level menu: map of menu label to items, each with optional sub-pages.
MENU_LEVELS = (Level("item"), Level("sub", field="subPages", outer=True))


def flatten(
    df: DataFrame,
    nested: str,
    levels: Sequence[Level] = MENU_LEVELS,
    root: str = "menu",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per innermost element, with the position of every level.

    `nested` is a map whose values are arrays of structs. Fields of a level become `<level>_<field>`,
    positions `<level>_pos`. The work is row-local: no shuffle.
    """
    # Outer forms with a filter on the position: for the others Spark infers a filter on the size of
    # what is exploded, and so computes that twice.
    out = df.select(*keep, F.posexplode_outer(nested).alias(f"{root}_pos", root, "_children"))
    out = out.filter(F.col(f"{root}_pos").isNotNull())
    columns = [*keep, f"{root}_pos", root]
    children = F.col("_children")
    for n, level in enumerate(levels):
        if level.field is not None:
            children = F.col(f"_{levels[n - 1].name}.{level.field}")
        out = out.select("*", F.posexplode_outer(children).alias(f"{level.name}_pos", f"_{level.name}"))
        if not level.outer:
            out = out.filter(F.col(f"{level.name}_pos").isNotNull())
    inner = {level.field for level in levels}
    selected = [F.col(c) for c in columns]
    for level in levels:
        selected.append(F.col(f"{level.name}_pos"))
        kind = out.schema[f"_{level.name}"].dataType
        if isinstance(kind, T.StructType):
            selected += [
                F.col(f"_{level.name}.{f}").alias(f"{level.name}_{f}")
                for f in kind.names
                if f not in inner
            ]
        else:
            selected.append(F.col(f"_{level.name}").alias(level.name))
    return out.select(*selected)
