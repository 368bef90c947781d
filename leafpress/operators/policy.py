"""Who may fetch what: robots rules and address ranges, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robots_rules(robots: DataFrame, origin: str = "origin", txt: str = "txt", agent: str = "*") -> DataFrame:
    """(origin, rule_no, allow, value): the lines that hold for agent, in order. A group for * holds for every agent. An empty
    value allows everything from there on."""
    lines = robots.select(origin, F.posexplode(F.split(txt, r"\r?\n")).alias("rule_no", "raw")).select(origin, "rule_no", F.trim("raw").alias("line")).filter("line != '' AND NOT startswith(line, '#') AND contains(line, ':')")
    kv = lines.select(origin, "rule_no", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("k"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("v"))
    me = agent.lower()
    group = F.when(F.col("k") == "user-agent", F.when(F.col("v") == "*", F.lit(me)).otherwise(F.lower("v")))
    of = F.coalesce(F.last(group, ignorenulls=True).over(Window.partitionBy(origin).orderBy("rule_no")), F.lit(me))
    kept = kv.withColumn("of", of).filter((F.col("of") == me) & F.col("k").isin("allow", "disallow"))
    return kept.select(origin, "rule_no", ((F.col("k") == "allow") | (F.col("v") == "")).alias("allow"), F.col("v").alias("value"))


def robots_allowed(requests: DataFrame, rules: DataFrame, origin: str = "origin", path: str = "path", key: str = "url") -> DataFrame:
    """requests and allowed: the first rule that matches decides; without one all is allowed."""
    r = rules.select(F.col(origin).alias("__o"), "rule_no", "allow", "value")
    star = F.col("value").contains("*") & ~F.col("allow")
    head, tail = F.substring_index("value", "*", 1), F.try_element_at(F.split("value", r"\*"), F.lit(2))
    match = F.when(F.col("value") == "", F.lit(True)).when(star, F.startswith(F.col(path), head) & F.endswith(F.col(path), tail)).otherwise(F.startswith(F.concat(F.col(path), F.lit("?")), F.col("value")))
    hit = requests.join(r, (F.col(origin) == F.col("__o")) & match).groupBy(key).agg(F.min_by("allow", "rule_no").alias("__allow"))
    return requests.join(hit, key, "left").withColumn("allowed", F.coalesce("__allow", F.lit(True))).drop("__allow")


def _blocks(low: Column, high: Column) -> Column:
    """The aligned blocks of 1, 256, 65536 and 16777216 addresses that make up a range: array of (level, block)."""
    parts, a, b = [], low.cast("long"), high.cast("long") + 1
    run = lambda k, x, y: F.when(x < y, F.transform(F.sequence(F.shiftright(x, 8 * k), F.shiftright(y, 8 * k) - 1), lambda n: F.struct(F.lit(k).alias("level"), n.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
    for k in range(3):
        unit = 256 << 8 * k
        up, down = F.least(b, F.ceil(a / unit) * unit), F.floor(b / unit) * unit
        down = F.greatest(up, down)
        parts += [run(k, a, up), run(k, down, b)]
        a, b = up, down
    return F.concat(*parts, run(3, a, b))


def in_ranges(rows: DataFrame, number: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """rows with the narrowest range that holds number (nulls where none does; of ranges of a width the lowest), for ranges of
    32-bit addresses. Ranges are dealt by the aligned blocks they are made of, and each different address asks for its block of
    each size, so that the join has equal keys that no single large range heats up. Rows get their range by their address."""
    extra = [c for c in ranges.columns if c not in rows.columns]
    cells = ranges.filter(F.col(low) <= F.col(high)).select(F.inline(_blocks(F.col(low), F.col(high))), F.struct((F.col(high) - F.col(low)).alias("width"), F.col(low).alias("from"), F.struct(*[F.col(c) for c in extra]).alias("of")).alias("__range"))
    asked = rows.select(F.col(number).cast("long").alias("__number")).filter(F.col("__number").between(0, (1 << 32) - 1)).distinct()
    asked = asked.select("__number", F.inline(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("__number", 8 * k).alias("block")) for k in range(4)])))
    best = asked.join(cells, ["level", "block"]).groupBy("__number").agg(F.min_by("__range", F.struct("__range.width", "__range.from")).alias("__range"))
    found = rows.join(best, F.col(number).cast("long") == F.col("__number"), "left")
    return found.select(*rows.columns, *[F.col(f"__range.of.{c}").alias(c) for c in extra])


def within_limits(requests: DataFrame, page: str, order: str, host: str, max_requests: int = 3300, max_hosts: int = 200) -> DataFrame:
    """Sub-requests of a page up to the first that is one too many or comes from one host too many."""
    w = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(page, host).orderBy(order)) == 1
    counted = requests.withColumns({"__n": F.count("*").over(w), "__new": first.cast("int")}).withColumn("__hosts", F.sum("__new").over(w))
    return counted.filter((F.col("__n") <= max_requests) & (F.col("__hosts") <= max_hosts)).drop("__n", "__new", "__hosts")
