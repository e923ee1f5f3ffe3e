"""Names of helper columns that no caller's column has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(rows: DataFrame, *names: str) -> list[str]:
    """The names, each prolonged until no column of rows has it in any case."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
