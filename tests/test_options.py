import pytest

from leafpress.options import BadOption, Options


def test_defaults_and_headers():
    o = Options.of({"url": "https://e.org", "respondWith": "markdown", "cacheTolerance": 5, "markdown": {"headingStyle": "setext"}}, {"X-Timeout": "900", "X-Retain-Images": "none", "X-Md-Hr": "---", "X-Remove-Selector": ".a, .b"})
    assert (o.respond_with, o.cache_tolerance, o.timeout, o.retain_images, o.markdown.hr, o.markdown.heading_style, o.remove_selector) == ("markdown", 5000, 180, "none", "---", "setext", (".a", ".b"))
    assert Options.of({}, {"X-Timeout": "soon"}).timeout is None


def test_forced():
    assert Options.of({"withGeneratedAlt": True}).retain_images == "all_p"
    assert Options.of({"retainLinks": "gpt-oss"}).with_links_summary == "gpt-oss"
    assert Options.of({"noCache": "true"}).cache_tolerance == 0
    assert Options.of({"targetSelector": "#a"}).wait_for_selector == ("#a",)
    assert Options.of({"engine": "vlm"}).respond_with == "vlm"
    assert Options.of({"withIframe": True, "timeout": 5}).timeout is None
    assert Options.of({"markdownChunking": "s2", "markdown": {"headingStyle": "setext"}}).markdown.heading_style == "atx"


@pytest.mark.parametrize("body", [{"respondWith": "vlm,markdown"}, {"maxTokens": 10}, {"retainImages": "some"}, {"removeSelector": "*"}, {"targetSelector": ":root"}, {"engine": "ie"}])
def test_refused(body):
    with pytest.raises(BadOption):
        Options.of(body)


@pytest.mark.parametrize(("body", "want"), [({}, "resource-idle"), ({"timeout": 30}, "network-idle"), ({"timeout": 10}, "resource-idle"), ({"respondWith": "screenshot"}, "media-idle"), ({"withIframe": True}, "network-idle"), ({"respondTiming": "html"}, "html")])
def test_timing(body, want):
    assert Options.of(body).timing == want


def test_predicates():
    assert Options().readability_required and not Options(respond_with="markdown").readability_required
    assert Options(respond_with="markdown+html").is_compound and not Options(respond_with="html").is_compound
    assert Options().browser_not_required and not Options(respond_with="pageshot").browser_not_required and not Options(with_shadow_dom=True).browser_not_required
    assert Options().cache_applicable and not Options(cache_tolerance=0).cache_applicable and not Options(viewport=(1, 1)).cache_applicable
    assert Options(markdown_chunking="s3").chunk_mode == ("contextual", 3) and Options(markdown_chunking="simple").chunk_mode == ("simple", 4) and Options(markdown_chunking="h2").chunk_mode == ("simple", 2) and Options().chunk_mode is None
    assert Options(respond_timing="html").acceptable_early({"html": "x"}) and not Options().acceptable_early({"html": "x"})
    assert Options().acceptable_early({"lastMutationIdle": 1, "lastContentResourceLoaded": 100, "now": 700})
    assert not Options().acceptable_early({"lastMutationIdle": 1, "lastContentResourceLoaded": 300, "now": 700})
    assert Options(retain_links="none").customised() == {"retain_links": "none"}
