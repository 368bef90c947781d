"""PDF text runs as markdown. Runs are rows (document, page, pos, str, height, a, b, has_eol); reading files is not done here."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_loose_end = re.compile(r"(\s+|-)$")


def rotated(a: Column, b: Column, degrees: float = 35.0) -> Column:
    return F.abs(F.degrees(F.atan2(b, a))) >= degrees


def height_stats(runs: DataFrame, by: list[str]) -> DataFrame:
    """by, mean and sd (population) of the heights, each weighted by its text's length; runs without height are left out."""
    w, h = F.length("str").cast("double"), F.col("height")
    of = runs.filter("height > 0").groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * h).alias("s"), F.sum(w * h * h).alias("q"))
    mean = F.col("s") / F.nullif("n", F.lit(0.0))
    return of.select(*by, mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.nullif("n", F.lit(0.0)) - mean * mean, F.lit(0.0))).alias("sd"))


def modes(runs: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """runs and mode: h1 or h2 by height against the document, appendix by height against the page or rotation, p, or space."""
    whole = height_stats(runs, [doc]).withColumnsRenamed({"mean": "__dm", "sd": "__ds"})
    each = height_stats(runs, [doc, page]).withColumnsRenamed({"mean": "__pm", "sd": "__ps"})
    h = F.col("height")
    mode = F.when(rotated(F.col("a"), F.col("b")), "appendix").when(h > F.col("__dm") + 3 * F.col("__ds"), "h1").when(h > F.col("__dm") + 2 * F.col("__ds"), "h2").when((h > 0) & (h < F.col("__pm") - F.col("__ps")), "appendix").when(h > 0, "p").otherwise("space")
    return runs.join(whole, doc, "left").join(each, [doc, page], "left").withColumn("mode", mode).drop("__dm", "__ds", "__pm", "__ps")


def written(rows: list[tuple[str, str, bool]]) -> str:
    """Markdown of (text, mode, begins a line) in reading order: small and rotated text waits until the next paragraph."""
    out: list[str] = []
    aside: list[str] = []
    now = "space"
    marks = {"h1": "\n\n# ", "h2": "\n\n## ", "p": "\n\n"}
    for text, mode, fresh in rows:
        begins = mode != "space" and (fresh or (now == "appendix" and mode != "appendix"))
        new: list[str] = []
        if begins:
            now = mode
            if mode == "appendix":
                aside.append("\n\n")
            else:
                new.append(marks[mode])
        else:
            target, held = (aside, aside) if mode == "appendix" and aside else (new, out)
            if held and not _loose_end.search(held[-1]) and len(held[-1]) != 1:
                target.append(" ")
        if text:
            (aside if mode == "appendix" and (aside or begins) else new).append(text)
        if begins and mode != "appendix" and aside:
            lines = [x.strip() for x in re.split(r"\r?\n", "".join(aside))]
            new[:0] = ["\n\n", "\n".join(f"> {x}" for x in lines if x)]
            aside.clear()
        out += new[:1] if mode == "space" else new
    if out:
        out[0] = out[0].lstrip()
    return "".join(out)


def digest(runs: DataFrame, doc: str = "doc_id", page: str = "page", pos: str = "pos") -> DataFrame:
    """(doc, content, text): a document's runs are gathered in order and written at once, as they depend on each other."""
    run = F.struct(page, pos, F.coalesce("str", F.lit("")).alias("str"), "mode", F.coalesce("has_eol", F.lit(False)).alias("eol"))
    gathered = modes(runs, doc, page).groupBy(doc).agg(F.array_sort(F.collect_list(run)).alias("runs"))
    text = F.array_join(F.transform("runs", lambda r: F.concat(r["str"], F.when(r["eol"], "\n").otherwise(""))), "")

    def write(batches: pd.Series) -> pd.Series:
        return batches.map(_ordered)

    return gathered.select(doc, F.pandas_udf(write, T.StringType())("runs").alias("content"), text.alias("text"))


def _ordered(runs: list) -> str:
    fresh, rows = True, []
    for r in runs:
        rows.append((r["str"], r["mode"], fresh))
        fresh = bool(r["eol"]) and not r["str"]
    return written(rows)
