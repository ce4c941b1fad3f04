"""Page extraction: what ratios and names decide, no lost article text, linear time on broken pages."""

import time

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from noteproof.llm import html_text  # noqa: E402

from test_contracts import LONG, template_text  # noqa: E402

PLAIN = " ".join(LONG.replace("<p>", "").replace("</p>", "").split())


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article><header><h1>Title</h1></header>{LONG}</article>", f"Title\n{PLAIN}"),
        (f"<article>{LONG * 5}<div class=note><span>Tiny</span></div></article>", "\n".join([PLAIN] * 5 + ["Tiny"])),
        (f"<article class=a>{LONG * 5}</article><article class=b><p>Short one.</p></article>", "\n".join([PLAIN] * 5 + ["Short one."])),
        (f"<div class=main>{LONG}<p class='share-price'>Price 12.</p></div>", f"{PLAIN}\nPrice 12."),
        (f"<div class='search-algorithms'>{LONG}</div>", PLAIN),
        (f"<div class='login-history'>{LONG}</div>", PLAIN),
        (f"<div class=text>{LONG}<div class='cookie-notice'>{LONG}</div></div>", PLAIN),
        (f"<body><header><h1>Site</h1></header>{LONG}<footer>Foot, it is.</footer></body>", PLAIN),
        ("<body><article><p>Hi.</p></article><div class=ad>Buy this now, a long advert with marks, here.</div></body>", "Hi."),
        (f"<article>{LONG}<p><a>Read on</a></p></article>", f"{PLAIN}\nRead on"),
        (f"<p>Before.</p><img alt='x>{LONG}", f"Before.\n{PLAIN}"),
        ("a < b and c > d", "a < b and c > d"),
        (f"{LONG}<script>var a='</p>' </script >{LONG}<style>p{{", f"{PLAIN}\n{PLAIN}"),
    ],
)
def test_nothing_of_an_article_is_lost(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize(
    "page",
    [
        "<p x=" * 200_000, '<a href="x' * 100_000, "<div>" * 200_000, '<a "x>" ' * 120_000, "<script>" + "</script " * 100_000, "<!" * 500_000, "<b>" * 100_000 + "<div></div>" * 60_000,
        "<ul>" + "<div>" * 90_000 + "<li></li>" * 60_000, "<p>" + "<b>" * 300_000, "<!--" * 250_000, "</p>" * 250_000, "<body>" * 160_000, "<p><table>" * 100_000, "&amp" * 250_000,
    ],
)
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 20


def _pages():
    return [h for (h,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()]


def test_ratios_change_results_and_find_articles_without_names(monkeypatch):
    pages = _pages()
    want = [template_text(h) for h in pages]
    assert [html_text.main_text(h) for h in pages] == want
    with monkeypatch.context() as m:
        m.setattr(html_text, "path_scores", lambda paths, lengths, marks, factors: factors)
        assert sum(html_text.main_text(h) != w for h, w in zip(pages, want, strict=True)) > len(pages) / 2
    long = [(h, w) for h, w in zip(pages, want, strict=True) if len(w) > 600]
    built = html_text.Element.__init__

    def unnamed(self, *given):
        built(self, *given)
        self.named = False

    monkeypatch.setattr(html_text.Element, "__init__", unnamed)
    assert sum(html_text.main_text(h) == w for h, w in long) > 0.97 * len(long)
