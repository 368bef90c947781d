"""Markdown goldens, derived by reading the rules."""

import pytest

from leafpress.html.dom import BadSelector, compile_selector, measure, parse, select
from leafpress.html.writer import Dialect, Images, Writer, clean_attribute
from leafpress.html.page import cleaned, describe, inner_text, squeezed, summarised
from leafpress.options import Options

PAGE = """<!DOCTYPE html><html lang="pt"><head><title>Tide tables</title><meta name="description" content="Harbour hours">
<meta property="article:published_time" content="2023-03-02T06:30:00Z"><link rel="icon alternate" href="/t.png" sizes="16x16"><style>p{}</style></head><body>
<nav><a href="/port">Port</a></nav><div class="ads banner"><p>Boats for hire</p></div>
<article id="main"><h1>Tides of the bay</h1><p>High water comes <strong>twice a day</strong> and <em>late</em>.</p><h2>Where to look</h2>
<p>Ask <a href="https://example.com/pilot">the pilot</a> or <a href="https://example.org/sea" title='he says "wait"'>the sea</a>.</p>
<img src="https://example.com/moon.png" alt="The moon"><img src="https://example.com/buoy.png"><img src="data:image/png;base64,AAAA" alt="Dot">
<ul><li>Ebb</li><li>Flood</li></ul><blockquote><p>Mind the rocks.</p></blockquote><pre><code class="language-js">let h = 3;
rise(h);</code></pre><table><thead><tr><th align="left">Hour</th><th>Metres</th></tr></thead><tbody><tr><td>6</td><td>2</td></tr></tbody></table><hr><p>See <a href="map">map</a>.</p></article>
<script>var x = "</p>";</script></body></html>"""


def md(html, base="https://example.com/t/", dialect=None, **kw):
    return Writer(dialect or Dialect(), base, kw.pop("gfm", True), **kw).convert(parse(html))


def content(html=PAGE, url="https://example.com/test", **options):
    return describe(html, url, Options(respond_with="markdown", **options), frozenset({"content", "link_list", "image_list", "error"}))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h1>A</h1><p>b</p>", "# A\n\nb"),
        ("<p>a<b>b</b>c</p>", "a**b**c"),
        ("<p>a <i>b_c</i></p>", "a _b\\_c_"),
        ("<p>x<br>y</p>", "x\n\ny"),
        ("<ul><li>a</li><li>b</li></ul>", "*   a\n*   b"),
        ("<ol start=5><li>a</li><li>b</li></ol>", "1.   a\n2.   b"),
        ("<ul><li>a<ul><li>b</li></ul></li></ul>", "*   a\n    *   b"),
        ("<li>lone</li>", "*   lone"),
        ("<blockquote>a<br>b</blockquote>", "> a\n> \n> b"),
        ("<code>x</code>", "`x`"),
        ("<pre><code class='lang-py'>x\ny</code></pre>", "```py\nx\ny\n```"),
        ("<div class='highlight-source-js'><pre>a b</pre></div>", "```js\na b\n```"),
        ("<s>gone</s>", "~~gone~~"),
        ("<input type=checkbox checked>do", "- [x] do"),
        ("<input type=checkbox>do", "- [ ] do"),
        ("<a href='b'>t</a>", "[t](https://example.com/t/b)"),
        ("<a href='/x'><h2>t</h2></a>", "## [t](https://example.com/x)"),
        ("<a href='mailto:x@y.z'>m</a>", "[m](mailto:x@y.z)"),
        ("<table><tr><td>a</td></tr><tr><td>b</td></tr></table>", "a\nb"),
        ("<table><tr><th align=right>H</th><th>I</th></tr><tr><td>1</td><td>2</td></tr></table>", "| H | I |\n| --: | --- |\n| 1 | 2 |"),
        ("<select><option value='v'>t</option></select>", "v"),
        ("<svg><text>no</text></svg>ok<script>no</script>", "ok"),
        ("<math><mfrac><mi>a</mi><mi>b</mi></mfrac></math>", "$\\frac{a}{b}$"),
        ("<p>a&nbsp;&amp; b</p>", "a & b"),
        ("", ""),
    ],
)
def test_rules(html, want):
    assert md(html) == want


def test_dialects():
    assert md("<h1>Ab</h1><h3>c</h3>", dialect=Dialect(heading_style="setext")) == "Ab\n==\n\n### c"
    assert md("<ul><li>a</li></ul><hr>", dialect=Dialect(bullet_list_marker="-", hr="---")) == "-   a\n\n---"
    assert md("<b>x</b><i>y</i>", dialect=Dialect(strong_delimiter="__", em_delimiter="*")) == "__x__*y*"
    two = "<a href='/a'>A</a> <a href='/b'>B</a>"
    assert md(two, dialect=Dialect(link_style="referenced")) == "[A][1][B][2]\n\n[1]: https://example.com/a\n[2]: https://example.com/b"
    assert md(two, dialect=Dialect(link_style="referenced", link_reference_style="collapsed")).startswith("[A][][B][]\n\n[A]: https")
    assert md(two, dialect=Dialect(link_style="referenced", link_reference_style="shortcut")).startswith("[A][B]\n\n[A]: ")
    assert md(two, dialect=Dialect(link_style="discarded")) == "A B"


def test_page():
    text = content()["content"]
    assert text.startswith("# Tide tables\n")
    assert "[Port](https://example.com/port)" in text and '[the sea](https://example.org/sea "he says \\"wait\\"")' in text
    assert "```js\nlet h = 3;\nrise(h);\n```" in text and "| Hour | Metres |\n| :-- | --- |\n| 6 | 2 |" in text and "* * *" in text
    assert "[map](https://example.com/map)" in text and "> Mind the rocks." in text and "var x" not in text
    assert "![Image 1: The moon](https://example.com/moon.png)" in text and "![Image 2](https://example.com/buoy.png)" in text
    assert "![Image 3: Dot](blob:https://example.com/" in text
    assert "data:image/png" in content(keep_img_data_url=True)["content"]


@pytest.mark.parametrize(("mode", "has", "lacks"), [("none", [], ["Image", "moon.png"]), ("alt", ["(Image 1: The moon)"], ["moon.png", "buoy.png"]), ("alt_p", ["(Image 1: The moon)", "(Image 3: Dot)"], ["moon.png"]), ("all_p", ["![Image 1: The moon]("], [])])
def test_images(mode, has, lacks):
    text = content(retain_images=mode)["content"]
    assert all(x in text for x in has) and not any(x in text for x in lacks)


def test_links():
    assert "Port" not in content(retain_links="none")["content"]
    assert "example.org" not in content(retain_links="text")["content"] and "the sea" in content(retain_links="text")["content"]
    cited = content(retain_links="gpt-oss", with_links_summary="gpt-oss")
    assert "\u30103\u2020the sea\u2020example.org\u3011" in cited["content"] and "\u30102\u2020the pilot\u3011" in cited["content"]
    assert ("3", "https://example.org/sea") in cited["link_list"]
    assert content()["image_list"][0] == ("Image 1: The moon", "https://example.com/moon.png")


def test_selectors():
    only = content(target_selector=("#main",))["content"]
    assert "Tides of the bay" in only and "Port" not in only
    assert "Boats" not in content(remove_selector=(".ads",))["content"]
    assert content(target_selector=(".absent",))["error"]
    root = parse("<div id=a class='x y'><p data-k='v1'>1</p><p>2</p><span><p>3</p></span></div>")
    count = lambda s: len(select(root, s))
    assert (count("p"), count("div > p"), count("div p"), count("p + p"), count("p ~ span"), count(".x.y"), count("[data-k^=v]"), count("p:not([data-k])"), count("p:first-child"), count("p,span")) == (3, 2, 3, 1, 1, 1, 1, 2, 2, 4)
    with pytest.raises(BadSelector):
        compile_selector("a >")


def test_gfm_switch():
    assert "|" not in content(no_gfm=True)["content"].split("```")[-1]
    assert "<table>" in content(no_gfm="table")["content"]


def test_unclosed_and_truncated():
    out = describe("<html lang=fr><p><b>x<br><p>y <a href='/z'>z", "https://e.org/", Options(), frozenset({"content", "lang", "error"}))
    assert out["error"] is None and "x" in out["content"] and out["lang"] == "fr"
    deep = "<div>" * 400 + "in" + "</div>" * 400
    assert describe(deep, "https://e.org/", Options(), frozenset({"content", "degraded"})) == {"content": "in", "degraded": True}
    assert describe(None, None, Options(), frozenset({"content", "title", "error"})) == {"content": "", "title": "", "error": None}


def test_head():
    out = describe(PAGE, "https://example.com/test", Options(), frozenset({"title", "description", "published_time", "metadata", "external", "imgs"}))
    assert (out["title"], out["description"], out["published_time"]) == ("Tide tables", "Harbour hours", "2023-03-02T06:30:00Z")
    assert out["metadata"]["lang"] == ["pt"] and out["external"]["icon"] == {"https://example.com/t.png": {"sizes": "16x16"}}
    assert [i["alt"] for i in out["imgs"]] == ["The moon", "", "Dot"]


def test_helpers():
    assert squeezed("a\n\n\n\nb\n") == "a\n\nb\n"
    assert summarised([("a", "u1"), ("b", "u2"), ("a", "u3"), ("c", "u1"), ("j", "javascript:x")]) == [("a", "u3"), ("b", "u2")]
    assert clean_attribute("a\n\n  b") == "a\nb" and clean_attribute(None) == ""
    assert cleaned("<div class='flex mt-4 real' style='color:red' data-a=1 aria-b=2><!--c--><p style='display: none'>x</p></div>") == '<div class="real"><p style="display: none">x</p></div>'
    assert inner_text(parse("<p>a  b</p><script>x</script><div>c<br>d</div>")) == "a b\nc\nd"
    assert measure(parse("<div><svg><g></g></svg><p></p></div>")) == (3, 2)
    lazy = Images(base="https://e.org/")
    assert lazy("", next(parse("<img src='data:x' data-src='/r.png' srcset='a 1x'>").elements("img")), None) == "![Image 1](https://e.org/r.png)"


def test_frames_and_captions():
    host = "<body><iframe src='/f'></iframe><img src='/i.png'></body>"
    out = describe(host, "https://e.org/", Options(respond_with="markdown", with_iframe=True), frozenset({"content"}), {"https://e.org/f": "<p>inner <a href='x'>l</a></p>"}, {"https://e.org/i.png": "a cat"})
    assert "inner [l](https://e.org/x)" in out["content"] and "![Image 1: a cat](https://e.org/i.png)" in out["content"]
