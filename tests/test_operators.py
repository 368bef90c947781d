import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafpress.functions import chat
from leafpress.operators import cache, pages, policy, search
from leafpress.sources import feeds, files, pdf, serp, sse
from leafpress.streaming import state


def test_robots(spark):
    robots = spark.createDataFrame([("o", "User-agent: bot\nDisallow: /\n\nUser-agent: *\n# c\nDisallow: /private\nAllow: /\nDisallow: /x*y"), ("p", "Disallow: /a*z\nDisallow:\nDisallow: /b")], "origin string, txt string")
    asked = spark.createDataFrame([("1", "o", "/private/x"), ("2", "o", "/x1y"), ("3", "p", "/a/z"), ("4", "p", "/b"), ("5", "q", "/")], "url string, origin string, path string")
    got = {r.url: r.allowed for r in policy.robots_allowed(asked, policy.robots_rules(robots)).collect()}
    assert got == {"1": False, "2": True, "3": False, "4": True, "5": True}


def test_text_form(spark):
    pair = lambda t, h: F.struct(F.lit(t).alias("text"), F.lit(h).alias("href"))
    out = spark.range(1).select(pages.text_form(F.lit("T"), F.lit("u"), F.lit("body"), published=F.lit("2024"), warning=F.lit("a\nb"), links=F.array(pair("x", "y")), images=F.array(pair("x", "y")).cast("array<struct<text:string,href:string>>"))).first()[0]
    assert out == "Title: T\n\nURL Source: u\n\nPublished Time: 2024\n\nWarning: a\nWarning: b\n\nMarkdown Content:\nbody\n\nImages:\n- ![x](y)\n\nLinks/Buttons:\n- [x](y)\n"


def test_feeds(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>e1</title><link href="https://e.org/1"/><updated>d</updated></entry><entry><link rel="self" href="s"/><link href="https://e.org/2"/></entry></feed>'
    maps = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://e.org/a</loc></url><url><loc>https://e.org/b</loc><lastmod>2024</lastmod></url></urlset>'
    rss = "<rss><channel><title>R</title><description>D</description><item><link>l</link><title>a &amp; b</title></item></channel></rss>"
    f = spark.createDataFrame([(1, atom), (2, maps), (3, rss), (4, "<other/>"), (5, None)], "k int, xml string")
    got = {(r.k, r.pos): (r.title, r.href, r.date) for r in feeds.items(f, "k").collect()}
    assert got == {(1, 1): ("e1", "https://e.org/1", "d"), (1, 2): (None, "https://e.org/2", None), (2, 1): (None, "https://e.org/a", None), (2, 2): (None, "https://e.org/b", "2024"), (3, 1): ("a & b", "l", None)}
    html = {r.k: r.html for r in feeds.as_html(feeds.items(f, "k"), feeds.heads(f, "k"), "k").collect()}
    assert html[3].startswith('<html><head><title>R</title><meta name="description" content="D">') and "a &amp; b</a></h3>" in html[3] and set(html) == {1, 2, 3}


def test_sse(spark):
    events = spark.range(1).select(sse.decode(F.lit("event: a\r\ndata: x\r\ndata: y\r\n\r\n: note\n\ndata:z\nid: 7\nretry: 5\n\n"))).first()[0]
    assert [tuple(e) for e in events] == [("a", "x\ny", None, None), (None, "z", "7", 5)]
    assert spark.range(1).select(sse.encode(F.lit("p\nq"), F.lit("m"))).first()[0] == "event: m\ndata: p\ndata: q\n\n"


def test_serp():
    page = '<div data-async-context="query:x"><div lang="en"><a href="https://r.org"><h3>T</h3><span>S</span></a><div data-sncf="1"><span>2024</span><span>snip</span></div></div><div lang="en"><a href="v"><div role="heading">V</div></a></div></div>'
    assert serp.general(page) == [{"link": "https://r.org", "title": "T", "source": "S", "date": "2024", "snippet": "snip", "image_url": None, "variant": "web"}]
    b = '<ol id="b_results"><li class="b_algo"><h2><a href="https://s.example/ck/a?u=a1aHR0cHM6Ly9lLm9yZy8">T</a></h2><p>May 1 · text</p></li></ol>'
    assert [(h["link"], h["snippet"]) for h in serp.listed(b)] == [("https://e.org/", "text")]
    assert serp.plain('<div><div><a data-ved=1 href="/url?q=https://e.org/%3Fa&sa=U"><div style="x">T</div></a></div><div class="ilUpNd H66NU aSRlid">S</div></div>')[0]["link"] == "https://e.org/?a"
    assert serp.general("<p>none</p>") == []


def test_pdf(spark):
    # Derived by reading: small text waits as a quote before the next paragraph.
    assert pdf.written([("Title", "h1", True), ("", "space", False), ("Body", "p", True), ("more-", "p", False), ("joined", "p", False)]) == "# Title \n\nBody more-joined"
    assert pdf.written([("A", "p", True), ("note", "appendix", True), ("B", "p", False)]) == "A\n\n> note\n\nB"
    runs = spark.createDataFrame([("d", 1, 1, "big", 40.0, 1.0, 0.0, True)] + [("d", 1, i, "word word", 10.0 + i % 2 / 10, 1.0, 0.0, False) for i in range(2, 40)], "doc_id string, page int, pos int, str string, height double, a double, b double, has_eol boolean")
    assert pdf.digest(runs).first().content.startswith("# big")


def test_files(spark):
    assert files.decode("é".encode("latin-1"), "ISO-8859-1") == "é" and files.decode(b'<meta charset="windows-1251">\xcf') == '<meta charset="windows-1251">П'
    assert files.decode(b"\xff", "nonsense") == "�" and files.decode(None) is None and files.decode("ü".encode("utf-16")) == "ü"
    f = spark.createDataFrame([("/x/a.html", b"<p>x</p>"), ("/x/b.json", b'{"a": "<b>"}'), ("/x/c.pdf", b"%PDF"), ("/x/d", b"?")], "path string, content binary")
    got = {r.name: (r.kind, r.html) for r in files.as_pages(f).collect()}
    assert got["a.html"] == ("html", "<p>x</p>") and got["b.json"] == ("text", '<html><head><title>b.json</title></head><body><pre>{"a": "&lt;b>"}</pre></body></html>') and got["c.pdf"] == ("pdf", None) and got["d"][0] == "other"


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "aaaa"), (1, 2, "assistant", "bb"), (1, 3, None, None)], "c int, t int, role string, text string")
    assert chat.encode(turns, "c", "t").first().encoded == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\naaaa<|im_end|>\n<|im_start|>assistant\nbb<|im_end|>\n<|im_start|>user\n<|im_end|>"
    kept = chat.trim(turns.na.fill({"role": "user", "text": ""}), "c", "t", F.char_length("text"), 15)
    assert sorted(r.t for r in kept.collect()) == [0, 2, 3]


def test_ranges(spark):
    ranges = spark.createDataFrame([("wide", 0, 1 << 30), ("narrow", 1000, 2000)], "name string, low long, high long")
    got = policy.in_ranges(spark.createDataFrame([(1, 1500), (2, 5), (3, 1 << 31)], "k int, ip long"), "ip", ranges, "low", "high")
    assert {r.k: r.name for r in got.collect()} == {1: "narrow", 2: "wide", 3: None}


def test_page_frames(spark):
    p = spark.createDataFrame([(1, "https://e.org/", "<iframe src='/f'></iframe>", {"https://e.org/f": "<p>in</p>"}), (2, None, None, None)], "page_id int, url string, html string, frames map<string,string>")
    from leafpress.options import Options

    got = {r.page_id: r.content for r in pages.parse_pages(p, ["content"], Options(with_iframe=True, respond_with="markdown"), frames_col="frames").collect()}
    assert got == {1: "in", 2: ""}


BASE = datetime(2024, 1, 1)


@pytest.mark.parametrize(
    ("fold", "times", "extra", "want"),
    [
        (state.RateLimit(2, 1000), [0, 10, 20, 1005, 1012], {}, [True, True, False, True, True]),
        (state.RateLimit(2, 1000), [0, 10, 20, 30, 40], {"refund": [False, False, True, False, False]}, [True, True, False, True, False]),
        (state.Throttle(1200, 0.05), [0, 100, 200, 1500], {"size": [100, 102, 120, 121]}, [True, False, True, True]),
        (state.ErrorRun(1, 5000), [0, 1, 2, 3, 4, 9000], {"failed": [True, True, False, True, True, True]}, [False, True, False, False, True, False]),
        (state.Watchdog(100, 2), [0, 1, 2, 200, 400, 500], {"what": ["start", "start", "tick", "tick", "tick", "worked"]}, [False, False, False, False, True, False]),
    ],
)
def test_folds_batch_and_stream(spark, tmp_path, fold, times, extra, want):
    frame = pd.DataFrame({"k": 1, "i": range(len(times)), "ts": [BASE + timedelta(milliseconds=t) for t in times]} | extra)
    rows = spark.createDataFrame(frame)
    got = state.batch(rows, "k", ["ts", "i"], fold).orderBy("i").collect()
    assert [r.keep for r in got] == want
    for n, part in enumerate((frame[:2], frame[2:])):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    name = f"out{abs(hash((str(fold), tuple(times))))}"
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = state.stream(source, "k", ["ts", "i"], fold, idle=None).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.i, r.keep) for r in spark.sql(f"SELECT * FROM {name}").collect()) == list(enumerate(want))


def test_error_alarms_as_the_fold(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([(r.randrange(4), i, BASE + timedelta(milliseconds=i * r.choice([1, 50])), r.random() < 0.7) for i in range(400)], "k int, i int, ts timestamp, failed boolean")
    rule = state.ErrorRun(2, 300)
    fold, windows = state.batch(rows, "k", ["ts", "i"], rule), state.error_alarms(rows, "k", ["ts", "i"], F.col("failed"), rule)
    assert sorted(map(tuple, fold.collect())) == sorted(map(tuple, windows.collect())) and windows.filter("keep").count() > 10


def test_folds_keep_keys_apart(spark):
    """Nulls as a key, a key over many batches, keys of several kinds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = spark.createDataFrame([(k, i, BASE + timedelta(seconds=i)) for i in range(60) for k in ("a", None, "b")], "k string, i int, ts timestamp")
    got = state.batch(rows, "k", ["ts", "i"], state.RateLimit(3, 10_000)).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: [r.i for r in sorted(got, key=lambda r: r.i) if r.k == k and r.keep] for k in ("a", None, "b")} == dict.fromkeys(("a", None, "b"), [i for i in range(60) if i % 10 < 3])


def test_error_runs_and_usage(spark):
    e = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, True)], "k int, t int, bad boolean")
    assert sorted(tuple(r) for r in cache.error_runs(e, "k", "t", "t", F.col("bad")).select("run_start", "run_end", "n").collect()) == [(1, 2, 2), (4, 4, 1)]
    items = spark.createDataFrame([(1, 5)] * 11 + [(2, 50_000)], "q int, n int")
    assert {r.q: (r.n, r.total, r.each) for r in search.search_usage(items, "q", "n").collect()} == {1: (11, 20_000, 1819), 2: (1, 50_000, None)}
