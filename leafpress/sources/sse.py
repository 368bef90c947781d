"""Server-sent events, both ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(data: Column, event: Column | None = None, id: Column | None = None, retry: Column | None = None) -> Column:
    """One event; each line of data on a line of its own."""
    lines = F.concat(F.lit("data: "), F.regexp_replace(data, "\r\n|\r|\n", "\ndata: "))
    head = [F.concat(F.lit(f"{name}: "), c.cast("string")) for name, c in (("event", event), ("id", id), ("retry", retry)) if c is not None]
    return F.concat(F.concat_ws("\n", *head, lines), F.lit("\n\n"))


def decode(stream: Column) -> Column:
    """array<struct<event, data, id, retry>> of a text of events; several data lines are joined by line feeds."""
    blocks = F.filter(F.split(F.regexp_replace(stream, "\r\n|\r", "\n"), "\n\n"), lambda b: b.rlike(r"(?m)^\w+:"))

    def event(block: Column) -> Column:
        lines = F.split(block, "\n")
        of = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
        last = lambda name: F.try_element_at(of(name), F.lit(-1))
        return F.struct(last("event").alias("event"), F.array_join(of("data"), "\n").alias("data"), last("id").alias("id"), last("retry").try_cast("int").alias("retry"))

    return F.transform(blocks, event)
