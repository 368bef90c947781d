"""Queries over pages whose texts are cut within a character reference, and pages of lengths around the limit, against their SQL."""

import duckdb
import pytest

from leafpress.html.dom import parse
from leafpress.plans import queries as catalogue

#: Queries whose pages are read by the rule of their SQL: a reference ends with a semicolon.
NAMES = ["page_title", "page_answer", "page_article", "page_chunks", "page_markdown", "page_own_rule", "page_references", "page_text", "page_text_links_only"]


def page(k: int, head: str) -> tuple[int, str, str]:
    return k, f"https://a.example.org/{k}", f'<!DOCTYPE html><html lang="en"><head><title>{head}</title></head><body><nav><ul><li><a href="/x{k}">x</a></li></ul></nav><div class="ad">Ad.</div><article><h1>{head}</h1><p><b>{head} of.<br><p>More &amp; more.</p></article><footer>&copy; a.example.org &middot; F.</footer></body></html>'


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cut")
    rows = [page(k, head) for k, head in enumerate(["A&amp;&amp;&amp", "B &am", "C &", "D &quo", "E &amp;"])]
    rows += [(k, f"https://b.example.org/{k}", "<p>" + "x" * (n - 3)) for k, n in zip(range(90, 108, 3), range(795, 801), strict=True)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{top}/pages.parquet")
    return str(top)


def compared(spark, folder, name, where):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet') WHERE {where}")
    got, want = catalogue.QUERIES[name](spark, folder).filter(where).toPandas(), con.execute(catalogue.ORACLES[name]).fetchdf()
    columns = sorted(want.columns)
    listed = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert len(want) and listed(got) == listed(want)


@pytest.mark.parametrize("name", NAMES)
def test_cut_references(spark, folder, name):
    compared(spark, folder, name, "page_id < 90")


def test_warnings_at_the_limit(spark, folder):
    """An estimate of 199.25 to 199.75 tokens is below 200."""
    compared(spark, folder, "page_warnings", "page_id >= 90")


def test_references_of_html():
    page = '<p title="a&amp b&quot;">&copy; &copy &ampx; &#65; &#65 &none;<script>a&amp&b</script>'
    assert parse(page).text_content() == "© © &x; A A &none;a&amp&b"
    closed = parse(page, closed_references=True)
    assert closed.text_content() == "© &copy &ampx; A &#65 &none;a&amp&b" and closed.children[0].get("title") == 'a&amp b"'
