"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is what stands between line feeds, without the ASCII white space around it. A line goes if an equal line, or one within
one edit (a code point inserted, deleted or replaced), starts earlier; earlier is by id (null last), then by the document's
text hash, then by line number. Lines that are empty or white space stay.

The deletion neighbourhood of a line is every string that deleting one code point makes. Two lines of n code points are one
replacement apart if they share the variant of the same position; a line of n and one of n + 1 are one insertion apart if the
first is a variant of the second. Variants are hashed keys. So that only lines with a possible partner make variants, a line of
n or n + 1 is seen as blocks of n: one edit leaves all blocks but one alone, and only lines that agree on the hash of all other
blocks with a different line make the variants of that block. Lines that share a key are compared with the earliest of the
key, never with each other, and an edit distance check follows.

Null and empty texts stay as they are. Rows that are equal in id and text get the same result. Null ids count as one document
for each text. Other columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import Scratch, documents, sealed, unsealed

#: Code points in a block at most.
BLOCK = 2048
#: A key is dealt apart if it holds more than one in HOT of all rows; different lines that are sampled to find such keys.
HOT, SAMPLE = 1024, 1 << 17
#: Hash values that get a bit each in the test for wanted documents: at most CELLS / 64 rows go to every task.
CELLS = 1 << 22
_BLANK = " \t\n\v\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _blocks(n: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(n / BLOCK).cast("int"))


def _bounds(n: Column, j: Column) -> tuple[Column, Column]:
    """Code points before block j of a line seen as n, and after it."""
    blocks = _blocks(n)
    return F.floor(j.cast("long") * n / blocks).cast("int"), (n - F.floor((j.cast("long") + 1) * n / blocks)).cast("int")


def _views(line: Column, m: Column) -> Column:
    """For each block of a line seen as m code points, then as m - 1, the lengths it can have as the shorter of a pair: the hash
    of all other blocks."""
    # Seen as m or m - 1, a line has two halves each, of which one is the same: three strings to hash.
    half, odd = F.floor(m / 2).cast("int"), m % 2 == 1
    hashed = lambda start, size: F.xxhash64(F.substring(line, start, size))
    before, after = hashed(F.lit(1), half), hashed(half + 1, m - half)
    third = F.when(odd, hashed(half + 2, m - half - 1)).otherwise(hashed(F.lit(1), half - 1))
    rest = lambda n, j, of: F.xxhash64(n, F.lit(j), of)
    whole = (rest(m, 0, after), rest(m, 1, before))
    less = (rest(m - 1, 0, F.when(odd, third).otherwise(after)), rest(m - 1, 1, F.when(odd, before).otherwise(third)))

    def many(n: Column) -> Column:
        def view(j: Column) -> Column:
            before, after = _bounds(n, j)
            return F.xxhash64(n, j, F.substring(line, F.lit(1), before), F.substring(line, m - after + 1, after))

        return F.transform(F.sequence(F.lit(0), _blocks(n) - 1), view)

    of = lambda n, halves: F.when(n <= 2 * BLOCK, F.array(*halves)).otherwise(many(n))
    return F.when(m == 1, F.array(*whole)).otherwise(F.concat(of(m, whole), of(m - 1, less)))


def _doc_key(did: Column) -> Column:
    return F.coalesce(F.concat(F.lit("i"), did.cast("string")), F.lit(""))


def _among(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """rows without most of those whose keys aren't in wanted. What is sent to every task is a bit for each of CELLS hash values,
    whatever the size of wanted; where that is so large that all bits are set, all rows pass."""
    cell = F.pmod(F.xxhash64(*keys), F.lit(CELLS))
    bits = wanted.select(cell.alias("__cell")).select(F.expr("__cell div 64").alias("__word"), F.expr("shiftleft(1L, CAST(__cell % 64 AS INT))").alias("__bit"))
    words = bits.groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    marked = rows.withColumn("__cell", cell).join(F.broadcast(words), F.expr("__cell div 64") == F.col("__word"))
    return marked.filter(F.expr("shiftright(__bits, CAST(__cell % 64 AS INT)) & 1") == 1).select(*rows.columns)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept lines as text, and lines_total, lines_kept (long; null text: 0)."""
    keep = Scratch(docs.sparkSession, "lines")
    keyed = sealed(docs, {"did": F.col(id_col), "text": F.col(text_col)}, [text_col, "lines_total", "lines_kept"])
    keyed = keyed.withColumns({"dk": _doc_key(F.col("did")), "th": F.xxhash64("text")})
    rows = keyed.select("did", "th", F.posexplode(_lines(F.col("text"))).alias("no", "raw"))
    rows = rows.select(F.struct(F.isnull("did").alias("none"), "did", "th", "no").alias("pos"), F.btrim("raw", F.lit(_BLANK)).alias("line")).filter("line != ''").withColumn("m", F.char_length("line"))
    rows = keep.table(rows.select("pos", "m", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), _views(F.col("line"), F.col("m")).alias("views")), "rows")
    # One row a different line: where it starts first, and how many lines equal it. Equal lines meet summed up.
    lines = keep.table(rows.groupBy("h1", "h2").agg(F.min(F.struct("pos", "m", "views")).alias("least"), F.count("*").alias("held")).select("h1", "h2", "least.*", "held"), "different")
    near = _near(keep, lines, keyed.select("dk", "th", "text")).withColumn("near", F.lit(True))
    known = lines.select("h1", "h2", "held", F.col("pos").alias("first")).join(near, ["h1", "h2"], "left")
    known = keep.table(known.filter((F.col("held") > 1) | F.col("near")), "known")
    keep.drop("different", "candidates")
    # A line that more than one in HOT of all lines equal isn't dealt by its hash: of such there are fewer than HOT.
    hot = F.broadcast(known.filter(F.col("held") > rows.count() // HOT).drop("held"))
    at = rows.select("pos", "h1", "h2")
    decided = at.join(hot, ["h1", "h2"]).unionByName(at.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(known.drop("held"), ["h1", "h2"]))
    gone = decided.filter(F.col("near").isNotNull() | (F.col("pos") > F.col("first"))).select(_doc_key(F.col("pos.did")).alias("dk"), F.col("pos.th").alias("th"), F.col("pos.no").alias("no"))
    gone = keep.table(gone.groupBy("dk", "th").agg(F.collect_set("no").alias("gone")), "gone")
    keep.drop("rows", "known")

    held = keyed.join(gone, ["dk", "th"], "left")
    every = _lines(F.col("text"))
    kept = F.array_join(F.array_compact(F.transform(every, lambda x, i: F.when(~F.array_contains("gone", i), x))), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    total = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(every)).cast("long")
    less = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    done = unsealed(held, text.alias(text_col), total.alias("lines_total"), (total - less).cast("long").alias("lines_kept"))
    return done.select(*docs.columns, *[c for c in ("lines_total", "lines_kept") if c not in docs.columns])


def _shared(lines: DataFrame) -> DataFrame:
    """(h1, m, i, rest, r, d) of the views whose rest several different lines have: r if another of the same length has it, d if
    a pair of lengths one apart has it."""
    views = lines.select("h1", "m", F.posexplode("views").alias("i", "rest")).withColumn("own", F.col("i") < _blocks(F.col("m")))
    # A rest that a sample shows to be frequent (more than about one view in HOT, so there are about HOT at most) isn't dealt by its hash:
    # all its lines make variants. The sample decides how rows are dealt, and no result.
    n = lines.count()
    part = views.filter(F.pmod("h1", F.lit(max(1, n // SAMPLE))) == 0)
    hot = F.broadcast(part.groupBy("rest").count().filter(F.col("count") > max(64, 4 * min(n, SAMPLE) // HOT)).select("rest"))
    of_key = Window.partitionBy("rest")
    own, longer = F.sum(F.col("own").cast("int")).over(of_key), F.sum((~F.col("own")).cast("int")).over(of_key)
    cold = views.join(hot, "rest", "left_anti").withColumns({"r": own > 1, "d": (own > 0) & (longer > 0)})
    both = cold.unionByName(views.join(hot, "rest").withColumns({"r": F.lit(True), "d": F.lit(True)}))
    return both.filter((F.col("own") & F.col("r")) | F.col("d")).drop("own")


def _near(keep: Scratch, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(h1, h2) of the lines that have an earlier line at one edit."""
    wanted = _shared(lines).groupBy("h1", "m").agg(F.collect_list(F.struct("i", "rest", "r", "d")).alias("wanted"))
    # The text comes from the document where the line starts first.
    at = wanted.join(lines.select("h1", "h2", "m", F.col("pos").alias("first")), ["h1", "m"])
    at = at.groupBy(_doc_key(F.col("first.did")).alias("dk"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct(F.struct("first", "h1", "h2").alias("id"), "wanted")).alias("of_doc"))
    at = keep.table(at, "wanted")
    found = at.join(_among(texts, at, ["dk", "th"]), ["dk", "th"]).select(_lines(F.col("text")).alias("all"), F.explode("of_doc").alias("w"))
    found = keep.table(found.select("w.id", "w.wanted", F.btrim(F.col("all")[F.col("w.id.first.no")], F.lit(_BLANK)).alias("line")), "candidates")
    keep.drop("wanted")

    seen = found.select("id", "line", F.char_length("line").alias("m"), F.explode("wanted").alias("v")).select("id", "line", "m", "v.*")
    own = F.col("i") < _blocks(F.col("m"))
    seen = seen.withColumns({"n": F.when(own, F.col("m")).otherwise(F.col("m") - 1), "j": F.when(own, F.col("i")).otherwise(F.col("i") - _blocks(F.col("m")))})
    before, after = _bounds(F.col("n"), F.col("j"))
    seen = seen.select("id", "m", "n", "rest", "r", "d", F.substring("line", before + 1, F.col("m") - before - after).alias("block"))
    size = F.char_length("block")
    without = lambda i: F.concat(F.substring("block", F.lit(1), i - 1), F.substring(F.col("block"), i + 1, size))
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    kinds = {"r": F.transform(places, lambda i: F.xxhash64(F.lit("r"), i, without(i))), "d": F.transform(places, lambda i: F.xxhash64(F.lit("w"), without(i))), "w": F.array(F.xxhash64(F.lit("w"), F.col("block")))}
    tagged = lambda k: F.transform(kinds[k], lambda x: F.struct(F.lit(k).alias("kind"), x.alias("key")))
    none = F.array().cast("array<struct<kind:string,key:bigint>>")
    keys = F.when(F.col("m") == F.col("n"), F.concat(F.when(F.col("r"), tagged("r")).otherwise(none), F.when(F.col("d"), tagged("w")).otherwise(none))).otherwise(tagged("d"))
    variants = seen.select("id", "rest", F.explode(keys).alias("k")).select("id", "rest", "k.*")
    # The hash of the other blocks and that of the variant together: 128 bits, so that no false partner hides a true one.
    of_key = Window.partitionBy("rest", "key")
    best = variants.withColumns({f"best_{k}": F.min(F.when(F.col("kind") == k, F.col("id"))).over(of_key) for k in "rwd"})
    partner = F.when(F.col("kind") == "r", F.col("best_r")).when(F.col("kind") == "d", F.col("best_w")).otherwise(F.col("best_d"))
    pairs = best.select("id", partner.alias("other")).filter("other < id").distinct()
    text = found.select("id", "line")
    checked = pairs.join(text, "id").join(text.select(F.col("id").alias("other"), F.col("line").alias("earlier")), "other").filter(F.levenshtein("line", "earlier", 1).between(0, 1))
    return checked.select("id.h1", "id.h2").distinct()


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "lines_total", "lines_kept", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH raw AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
rows_ AS (
  SELECT doc_id, CAST(i AS BIGINT) AS line_no, parts[i] AS line0 FROM raw, unnest(range(1, len(parts) + 1)) AS t(i)),
lines AS (
  SELECT *, regexp_replace(line0, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM rows_),
firsts AS (
  SELECT line, doc_id, line_no, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS nth FROM lines WHERE line != ''),
uniq AS (SELECT line, doc_id, line_no FROM firsts WHERE nth = 1),
variants AS (
  SELECT line, doc_id, line_no, i, line[1:i - 1] || line[i + 1:] AS v FROM uniq, unnest(range(1, length(line) + 1)) AS t(i)),
near AS (
  SELECT b.line FROM variants a JOIN variants b ON md5(a.v) = md5(b.v) AND a.i = b.i AND length(a.line) = length(b.line) WHERE (a.doc_id, a.line_no) < (b.doc_id, b.line_no)
  UNION SELECT u.line FROM uniq u JOIN variants a ON a.v = u.line WHERE (a.doc_id, a.line_no) < (u.doc_id, u.line_no)
  UNION SELECT a.line FROM uniq u JOIN variants a ON a.v = u.line WHERE (u.doc_id, u.line_no) < (a.doc_id, a.line_no)),
decided AS (
  SELECT l.doc_id, l.line_no, l.line0, (l.line = '' OR (u.line IS NOT NULL AND l.line NOT IN (SELECT line FROM near))) AS stays
  FROM lines l LEFT JOIN uniq u ON l.line = u.line AND l.doc_id = u.doc_id AND l.line_no = u.line_no),
kept AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS lines_total, CAST(count(*) FILTER (WHERE stays) AS BIGINT) AS lines_kept,
         coalesce(string_agg(line0, chr(10) ORDER BY line_no) FILTER (WHERE stays), '') AS kept
  FROM decided GROUP BY doc_id)
SELECT doc_id, lines_total, lines_kept, CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256 FROM kept
"""
