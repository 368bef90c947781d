import json

from pyspark.sql import functions as F

from leafpress.functions import json as tolerant
from leafpress.functions import markdown, text, urls
from leafpress.functions.resolve import host_of, origin_of, resolve


def one(spark, column, **values):
    return spark.range(1).select(column).first()[0]


def test_resolve():
    cases = {
        ("b", "https://e.org/a/c"): "https://e.org/a/b", ("../x?q=1#f", "https://e.org/a/b/c"): "https://e.org/a/x?q=1#f", ("//h/p", "http://e.org"): "http://h/p", ("/é t", "https://e.org"): "https://e.org/%C3%A9%20t",
        ("HTTPS://E.org:443/A/../b", None): "https://e.org/b", ("mailto:a@b", "https://e.org"): "mailto:a@b", ("x", None): None, ("x", "blob:https://e.org/1"): None, ("", "https://e.org/a"): "https://e.org/a",
    }
    for (ref, base), want in cases.items():
        assert resolve(ref, base) == want, ref
    assert host_of("https://u:p@E.org:8/x") == "e.org" and origin_of("HTTPS://E.org:8/x") == "https://e.org:8"


def test_urls(spark):
    d = lambda u: one(spark, urls.digest(F.lit(u)))
    assert d("https://E.org/A#top") == d("https://e.org/a") and d("https://e.org/#/r") != d("https://e.org/")
    assert one(spark, urls.decoded(F.lit("a%20b+c"))) == "a b+c" and one(spark, urls.decoded(F.lit("100%"))) == "100%"
    assert one(spark, urls.file_name(F.lit('attachment; filename="r.pdf"'), F.lit("https://e.org/x"))) == "r.pdf"
    assert one(spark, urls.fixed(F.lit("https://r.example.com/https://https://e.org/"))) == "https://e.org/"
    assert one(spark, urls.ipv4_text(urls.ipv4_number(F.lit("10.1.2.3")))) == "10.1.2.3"
    for ip, want in {"10.0.0.1": True, "8.8.8.8": False, "::1": True, "::ffff:10.0.0.1": True, "2606:4700::1": False, "x": None}.items():
        assert urls.is_nonpublic(ip) is want
    for u, want in {"https://e.org": True, "ftp://e.org": False, "http://localhost/": False, "http://127.0.0.1/": False, "http://300.1.1.1/": True}.items():
        assert one(spark, urls.safe_to_fetch(F.lit(u))) is want


def test_text(spark):
    assert one(spark, text.iso639_3(F.lit("en-US"))) == "eng" and one(spark, text.iso639_3(F.lit(None).cast("string"))) == "und"
    assert one(spark, text.tidy_markdown(F.lit("[a\n b]( u )\n\n\n\n  x"))) == "[a b](u)\n\nx"
    assert one(spark, text.caption(F.lit('"A cat\non a mat."'))) == "A cat on a mat"
    assert one(spark, text.with_operators(F.lit("q"), {"site": ["a.com", "b.com"], "ext": ["pdf"]})) == "q (site:a.com OR site:b.com) AND (ext:pdf)"
    assert one(spark, text.fallback_queries(F.lit("a b c d e"))) == ["a b c", "a", "a b"]
    assert one(spark, text.fallback_queries(F.lit("שלום ב ג ד"))) == ["ב ג ד", "ג ד", "ד"]
    assert str(one(spark, text.pdf_date(F.lit("D:20240102030405+02'00'")))) == "2024-01-02 01:04:05"
    assert one(spark, text.pdf_date(F.lit("D:bad"))) is None
    assert one(spark, text.escape_citation(F.lit("【a†b】"))) == "〖a‡b〗"


def test_chunks(spark):
    doc = "intro\n\n# A\n\nbody a\n\n## B\n\nbody b\n\n##### Deep\n\nd\n\n# C\n# D\n\nend"
    simple = one(spark, markdown.chunks(F.lit(doc), F.lit("T")))
    # A heading that another follows at once has no line of its own text, and so counts as text.
    assert simple == ["intro", "# A\n\nbody a", "## B\n\nbody b\n\n##### Deep\n\nd\n\n# C", "# D\n\nend"]
    deep = one(spark, markdown.chunks(F.lit(doc), F.lit("T"), contextual=True))
    assert deep[1] == "# T\n# A\n\nbody a" and deep[2].startswith("# T\n# A\n## B\n\nbody b")
    assert one(spark, markdown.chunks(F.lit(doc), F.lit("T"), depth=1)) == ["intro", "# A\n\nbody a\n\n## B\n\nbody b\n\n##### Deep\n\nd\n\n# C", "# D\n\nend"]
    assert one(spark, markdown.chunks(F.lit(""), F.lit("T"))) == []


def test_tolerant_json(spark):
    cases = {'so: {"a": [1, 2.5, "x\\n"], "b": TRUE} ok': {"a": [1, 2.5, "x\n"], "b": True}, '{"a": {"b": "cut': {"a": {"b": "cut"}}, '{"k"': {"k": ""}, '[1, 2': [1, 2], '{"a": nul': {"a": None}, '{"a": 12.': {"a": 12}, '{"a": "line\nfeed"}': {"a": "line\nfeed"}, "{a: 1}": {"a": 1}}
    for raw, want in cases.items():
        assert tolerant.parse(raw) == want, raw
    assert tolerant.parse("no json", "d") == "d" and tolerant.parse("[" * 5000) is not None and tolerant.parse("3") == 3
    assert json.loads(one(spark, tolerant.repaired(F.lit('x {"a": [')))) == {"a": []}
