"""Stored rows, addresses, main content and prompt parts, by hand."""

import ipaddress
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leafpress.functions import chat, text, urls
from leafpress.html.density import blocks, main_of
from leafpress.html.dom import parse
from leafpress.html.page import describe
from leafpress.operators import pages, policy, store
from leafpress.options import Options


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def values(spark, function, given, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in given], f"x {kind}").select(function(F.col("x"))).collect()]


def test_hosts_in_any_form(spark):
    numbers = ["127.0.0.1", "2130706433", "0x7f000001", "0177.0.0.1", "127.1", "127.0.0.1.", "8.8.8.8", "134744072", "256.1.1.1", "1.2.3.4.5", "08.1.1.1", "4294967296", "x.1", "example.com", "1e3.com", "0x"]
    want = [2130706433] * 6 + [0x08080808] * 2 + [-1, -1, 134283521, -1, -1, None, None, 0]
    got = values(spark, urls.host_number, numbers)
    assert [g for g, n in zip(got, numbers, strict=True) if n != "08.1.1.1"] == [w for w, n in zip(want, numbers, strict=True) if n != "08.1.1.1"]


def test_ipv6_against_the_library(spark):
    r = random.Random(4)
    given = []
    for _ in range(300):
        words = [r.choice([0, 0, 1, 0xFD00, 0xFE80, 0x2001, 0xDB8, 0xFFFF, r.randrange(1 << 16)]) for _ in range(8)]
        address = ipaddress.IPv6Address(b"".join(w.to_bytes(2, "big") for w in words))
        given.append(r.choice([address.compressed, address.exploded, address.compressed.upper()]))
    given += ["::ffff:10.0.0.1", "::ffff:8.8.8.8", "::", "::1", "1::2::3", "1:2", "12345::", "::1.2.3", "::1.2.3.400", "g::"]
    got = values(spark, urls.ipv6_hex, [f"[{x}]" for x in given])
    for x, digits in zip(given, got, strict=True):
        try:
            assert digits == f"{int(ipaddress.IPv6Address(x)):032x}", x
        except ipaddress.AddressValueError:
            assert digits is None, x
    assert values(spark, urls.is_nonpublic_host, ["[::ffff:10.0.0.1]", "[::ffff:8.8.8.8]", "[2600::1]", "[fe80::1%25eth0]", "[nonsense]", "example.com"]) == [True, False, False, True, True, False]


def test_safe_to_fetch(spark):
    bad = ["http://[::1]/", "http://[fd00::1]/a", "http://[::ffff:127.0.0.1]/", "http://2130706433/", "http://0x7f.1/", "https://u:p@10.1.2.3:80/", "ftp://e.org/", "http://localhost/", "http:///x", None]
    good = ["http://e.org/", "https://[2600::1]:8080/", "http://8.8.8.8/", "blob:https://e.org/1"]
    assert values(spark, urls.safe_to_fetch, [*bad, *good]) == [False] * len(bad) + [True] * len(good)


def test_normalised(spark):
    given = ["HTTP://User@E.org:80", "https://e.org:443/a/./b/../c/?q=1 2#f", "https://e.org:8443/a/..", " https://www.e.org/%2E%2e/x\n/", "mailto:a@b.c"]
    assert values(spark, urls.normalised, given) == ["http://User@e.org/", "https://e.org/a/c/?q=1%202", "https://e.org:8443/", "https://www.e.org/x/", "mailto:a@b.c"]


def test_targets(spark):
    rows = spark.createDataFrame([("r.example.com/https://e.org/a", None, None), ("", " e.org ", "<p>"), ("", "", "<p>"), ("https://r.example.com/", None, None), ("", None, None)], "p string, b string, h string")
    got = [r[0] for r in rows.select(urls.target(F.col("p"), F.col("b"), F.col("h"), ("r.example.com", ""))).collect()]
    assert got[:2] == ["https://e.org/a", "http://e.org"] and got[2].startswith("blob:") and len(got[2]) == 69 and got[3:] == [None, None]


def test_ranges_against_all_pairs(spark):
    r = random.Random(11)
    ranges = []
    for i in range(60):
        low = r.randrange(1 << 32)
        ranges.append((f"r{i}", low, min((1 << 32) - 1, low + r.choice([0, 1, 255, 300, 70_000, 1 << 20, 1 << 26, 1 << 31]))))
    ranges.append(("none", 10, 5))
    asked = [(i, r.choice([r.randrange(1 << 32), r.choice(ranges)[1], r.choice(ranges)[2]])) for i in range(400)] + [(900, None), (901, -1), (902, 1 << 33), (903, ranges[0][1]), (904, ranges[0][1])]
    found = policy.in_ranges(spark.createDataFrame(asked, "k int, ip long"), "ip", spark.createDataFrame(ranges, "name string, low long, high long"), "low", "high")
    want = {k: min(((h - l, l, n) for n, l, h in ranges if ip is not None and l <= ip <= h), default=(0, 0, None))[2] for k, ip in asked}
    assert {x.k: x.name for x in found.collect()} == want


def test_cache_table(spark, tmp_path):
    rows = spark.createDataFrame([(f"https://e.org/{i}", datetime(2024, 1, 1 + i % 9), f"t{i}") for i in range(40)], "url string, at timestamp, title string")
    store.write(rows, str(tmp_path / "c"))
    store.write(rows.limit(3), str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 43 and back.filter(F.col("prefix") != F.substring("digest", 1, 2)).count() == 0
    plan = back.filter("prefix = 'a0'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan
    assert {r.at.day for r in store.unexpired(back, F.lit("2024-01-13").cast("timestamp")).collect()} == {7, 8, 9}


def test_object_digest(spark):
    a = one(spark, store.object_digest(q=F.lit("x"), page=F.lit(1), none=F.lit(None).cast("string")))
    b = one(spark, store.object_digest(page=F.lit(1), q=F.lit("x")))
    assert a == b != one(spark, store.object_digest(page=F.lit(2), q=F.lit("x")))


def test_small_rules(spark):
    assert values(spark, store.page_limit, [-1, 0, 7, 99, None], "int") == [0, 0, 7, 20, 0]
    three = F.array(*map(F.lit, "abc"))
    assert values(spark, lambda u: store.page_at(three, u), ["u", "u#2", "u#9", "u#0", "u#x"]) == ["a", "b", None, None, "a"]
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    assert values(spark, lambda h: store.retry_at(h, now.cast("timestamp")).cast("string"), ["90", "0", "Wed, 21 Oct 2026 07:28:00 GMT", "later", None]) == ["2024-01-01 00:01:30", None, "2026-10-21 07:28:00", None, None]
    metadata = F.create_map(F.lit("article:published_time"), F.array(F.lit("m")))
    empty = F.create_map().cast("map<string,array<string>>")
    assert [one(spark, text.published(F.lit(p), m, F.lit("l"))) for p, m in (("p", metadata), (" ", metadata), (None, empty))] == ["p", "m", "l"]
    assert one(spark, text.fallback_queries(F.lit("א ב ג ד")))[0] == "ב ג ד" and one(spark, text.fallback_queries(F.lit("a b c d")))[0] == "a b c"


def test_tidy_markdown(spark):
    given = "  [a\n  b ]( https://e.org/x )\n\n\n\n\tsee [ ![ p\nq ]( /i.png ) ](u) [open\n[not] (two words) [x]\n\n(y)"
    want = "[a b](https://e.org/x)\n\nsee [![p q](/i.png)](u) [open\n[not] (two words) [x](y)"
    assert values(spark, text.tidy_markdown, [given, None, ""]) == [want, None, ""]


def test_prompts(spark):
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).cast("string").alias("value")) for k, v in (("text", "a"), ("text", ""), ("text", "b"), ("image", None), ("text", None), ("other", '{"x":1}'), ("text", "c"))])
    assert one(spark, chat.prompt_text(parts)) == 'a\n\nb\n[Image]\n\n{"x":1}\nc'
    assert [tuple(p) for p in one(spark, chat.merged_parts(parts))] == [("text", "ab"), ("image", None), ("other", '{"x":1}'), ("text", "c")]


def test_lists_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 1, "a"), (1, 2, 2, "b"), (1, 0, 3, "c"), (2, 1, 4, "d")], "list int, pos int, seq int, title string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = store.lists_so_far(source, "list", "pos", "seq", 3).writeStream.format("memory").outputMode("update").queryName("lists").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.list: [x and x.title for x in r["items"]] for r in spark.sql("SELECT * FROM lists").collect()} == {1: ["c", None, "b"], 2: [None, "d", None]}


STORY = " ".join(["The boats came in late and the whole town stood on the wall to count the lamps."] * 4)
PAGE = f"<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News of today</a></li></ul></nav><div id='m'><h1>Lamps</h1><p>{STORY}</p><p>{STORY}</p></div><footer><a href='/c'>All rights and terms</a></footer></body></html>"


def test_main_content():
    root = parse(PAGE)
    assert [b.words for b in blocks(root)] == [1, 3, 1, 68, 68, 4] and main_of(root).get("id") == "m"
    assert main_of(parse("<p>few words</p>")) is None and main_of(parse("")) is None
    whole, main = (describe(PAGE, "https://e.org/", Options(main_content=m), frozenset({"content"}))["content"] for m in (False, True))
    assert "Home" in whole and "Home" not in main and main.startswith("# Lamps") and "boats" in main
    # Asked for as markdown, the whole page is written.
    assert "Home" in describe(PAGE, "https://e.org/", Options(respond_with="markdown", main_content=True), frozenset({"content"}))["content"]


@pytest.mark.parametrize(("parsed", "taken"), [(f"<h1>L</h1><p>{STORY}</p><p>{STORY}</p>", True), ("<p>short</p>", False), (None, False)])
def test_main_content_as_captured(spark, parsed, taken):
    """Main content of three tenths of the page's markdown is taken, less isn't; a shadow tree stands in where it is asked for."""
    rows = spark.createDataFrame([("https://e.org/", PAGE, parsed, "<p>in the\nshade</p>")], "url string, html string, parsed string, shadow string")
    (r,) = pages.parse_pages(rows, ["content", "captcha"], Options(), parsed_col="parsed").collect()
    assert ("Home" not in r.content) == taken and r.captcha is False
    (r,) = pages.parse_pages(rows, ["text"], Options(with_shadow_dom=True), shadow_col="shadow").collect()
    assert r.text == "in the shade"
