"""Captured transfers as rows: redirect hops, headers, cookies, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def final_hops(hops: DataFrame, key: str, hop: str = "hop") -> DataFrame:
    """The last hop of each chain of redirects."""
    rest = [c for c in hops.columns if c != key]
    return hops.groupBy(key).agg(F.max_by(F.struct(*rest), hop).alias("h")).select(key, "h.*")


def merged_headers(headers: DataFrame, key: str, hop: str = "hop", name: str = "name", value: str = "value") -> DataFrame:
    """(key, name, values): lower-case header names with all their values over the hops, in order."""
    return headers.groupBy(key, F.lower(name).alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct(hop, value))), lambda x: x[value]).alias("values"))


def applicable_cookies(requests: DataFrame, cookies: DataFrame, key: str, at: str = "ts") -> DataFrame:
    """(key, name, value) of the cookies that go with a request: not expired, secure only over https, the host inside the cookie's
    domain, the path below its path; the last of a name wins. requests have host, path and scheme; cookies domain, path, name,
    value, secure, expires, seq. The join is on equal registered domains, so that it is never all against all."""
    from ..functions.urls import registered_domain

    r = requests.select(F.col(key), F.col(at).alias("__at"), F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("scheme").alias("__scheme"), registered_domain(F.col("host")).alias("__d"))
    bare = F.regexp_replace(F.lower("domain"), r"^\.", "")
    c = cookies.select(bare.alias("__domain"), F.coalesce("path", F.lit("/")).alias("__below"), "name", "value", F.coalesce("secure", F.lit(False)).alias("__secure"), "expires", "seq", registered_domain(bare).alias("__d"))
    fits = (F.col("__host") == F.col("__domain")) | F.endswith(F.col("__host"), F.concat(F.lit("."), "__domain"))
    fits &= F.startswith(F.col("__path"), F.col("__below")) & (~F.col("__secure") | (F.col("__scheme") == "https")) & (F.col("expires").isNull() | (F.col("expires") > F.col("__at")))
    return r.join(c, "__d").filter(fits).groupBy(key, "name").agg(F.max_by("value", "seq").alias("value"))


def at_path(rows: DataFrame, json: str, path: str, keep: Column | None = None) -> DataFrame:
    """rows with found: what stands at a JSON path, where that is true (not null, empty, 0 or false) and keep holds."""
    found = rows.withColumn("found", F.get_json_object(json, path)).filter(F.col("found").isNotNull() & ~F.col("found").isin("", "0", "false", "null"))
    return found.filter(keep) if keep is not None else found


def filled_by_position(pages: DataFrame, hits: DataFrame, by: str, pos: str, columns: list[str]) -> DataFrame:
    """pages, with the hits at the same place filling in what they lack."""
    h = hits.select(by, pos, *[F.col(c).alias(f"__{c}") for c in columns])
    return hits.select(by, pos).join(pages, [by, pos], "left").join(h, [by, pos]).select(by, pos, *[F.coalesce(c, f"__{c}").alias(c) for c in columns], *[c for c in pages.columns if c not in (by, pos, *columns)])


def qualified(title: Column, content: Column, *others: Column) -> Column:
    """A title with content, or any of the other forms."""
    some = lambda c: F.coalesce(c != "", F.lit(False))
    ok = some(title) & some(content)
    for c in others:
        ok = ok | some(c)
    return ok


def json_form(*columns: str) -> Column:
    """The answer as JSON, without missing fields."""
    return F.to_json(F.struct(*columns))
