"""Chat turns: the turn markup, and trimming to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def turn(role: Column, text: Column, extra: Column | None = None) -> Column:
    """One turn. extra: array of "key=value" for its header."""
    head = F.coalesce(F.nullif(role, F.lit("")), F.lit("user"))
    if extra is not None:
        head = F.when(F.size(extra) > 0, F.concat(head, F.lit(" "), F.array_join(extra, ", "))).otherwise(head)
    return F.concat(F.lit(START), head, F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END))


def encode(turns: DataFrame, by: str, order: str, role: str = "role", text: str = "text", system: str | None = None) -> DataFrame:
    """(by, encoded): each conversation as one text, its turns in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, turn(F.col(role), F.col(text)).alias("__turn")))), lambda x: x["__turn"]), "\n")
    head = f"{START}system\n{system}{END}\n" if system else ""
    return turns.groupBy(by).agg(F.concat(F.lit(head), body).alias("encoded"))


def trim(turns: DataFrame, by: str, order: str, cost: Column, target: int, role: str = "role", overhead: int = 4) -> DataFrame:
    """turns without the oldest ones that aren't the system's, until what is left costs target or less. Each dropped turn gives
    back its cost and overhead."""
    w = Window.partitionBy(by)
    past = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    weighed = turns.withColumn("__cost", cost + overhead)
    freed = F.coalesce(F.sum(F.when(F.col(role) != "system", F.col("__cost"))).over(past), F.lit(0))
    kept = weighed.withColumn("__left", F.sum("__cost").over(w) - freed).filter((F.col(role) == "system") | (F.col("__left") <= target))
    return kept.drop("__cost", "__left")


def prompt_text(parts: Column) -> Column:
    """A prompt's parts (array of struct kind, value: text, image or other, the last as JSON) as one text, a part a line."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["kind"] == "image", F.lit("[Image]")).otherwise(F.coalesce(p["value"], F.lit("")))), "\n")


def merged_parts(parts: Column) -> Column:
    """A prompt's parts with neighbouring texts as one; empty texts go."""
    kind = "array<struct<kind:string,value:string>>"
    some = F.filter(parts, lambda p: (p["kind"] != "text") | (F.coalesce(p["value"], F.lit("")) != ""))
    one = lambda k, v: F.struct(k.cast("string").alias("kind"), v.cast("string").alias("value"))

    def step(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (p["kind"] == "text") & F.coalesce(last["kind"] == "text", F.lit(False))
        return F.when(joins, F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), one(F.lit("text"), F.concat(last["value"], p["value"])))).otherwise(F.array_append(done, one(p["kind"], p["value"])))

    return F.aggregate(some, F.array().cast(kind), step)
