"""Markdown columns: chunking by headings in one expression, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NODE = "struct<title:string,level:int>"
_STATE = f"struct<level:int,stack:array<{_NODE}>,open:array<string>,done:array<string>>"


def sections(content: Column) -> Column:
    """A document at its headings."""
    return F.split(content, r"\n(?=#{1,6} )")


def heading(section: Column) -> Column:
    """The first line if it is a heading that text follows on further lines, else an empty string."""
    body = F.ltrim(section)
    line = F.when(F.instr(body, "\n") > 0, F.rtrim(F.substring_index(body, "\n", 1))).otherwise(F.lit(""))
    return F.when(line.startswith("#"), line).otherwise(F.lit(""))


def level(title: Column) -> Column:
    return F.length(F.regexp_extract(title, "^#{1,6}", 0))


def chunks(content: Column, title: Column, contextual: bool = False, depth: int = 4) -> Column:
    """Chunks of a document: each begins at a heading of level depth or less. Contextual ones begin with the document's title and
    the headings above."""

    def step(state: Column, section: Column) -> Column:
        head = heading(section)
        here = level(head)
        text = F.trim(F.regexp_replace(section, r"^\s+|\s+$", ""))
        stack = F.when(here <= state["level"], F.filter(state["stack"], lambda n: n["level"] < here)).otherwise(state["stack"])
        above = F.array_distinct(F.concat(F.array(F.concat(F.lit("# "), title)), F.transform(stack, lambda n: n["title"]), F.array(head)))
        body = F.regexp_replace(F.substr(F.ltrim(section), F.length(head) + 1), r"^\s+|\s+$", "")
        given = F.concat(F.array_join(F.filter(above, lambda x: x != ""), "\n"), F.lit("\n\n"), body) if contextual else text
        joined = F.array_join(F.filter(state["open"], lambda x: x != ""), "\n\n")
        starts = (head != "") & (here <= depth)
        new_stack = F.when(head == "", state["stack"]).otherwise(F.array_append(stack, F.struct(head.alias("title"), here.alias("level")).cast(_NODE)))
        kept = F.when(head == "", section).otherwise(text)
        return F.struct(
            F.when(head == "", state["level"]).otherwise(here).alias("level"),
            new_stack.alias("stack"),
            F.when(starts, F.array(given)).otherwise(F.array_append(state["open"], kept)).alias("open"),
            F.when(starts & (F.size(state["open"]) > 0), F.array_append(state["done"], F.regexp_replace(joined, r"^\s+|\s+$", ""))).otherwise(state["done"]).alias("done"),
        ).cast(_STATE)

    empty = F.struct(F.lit(0).alias("level"), F.array().alias("stack"), F.array().alias("open"), F.array().alias("done")).cast(_STATE)
    last = lambda s: F.array_append(s["done"], F.regexp_replace(F.array_join(F.filter(s["open"], lambda x: x != ""), "\n"), r"^\s+|\s+$", ""))
    return F.filter(F.aggregate(sections(content), empty, step, last), lambda x: x != "")
