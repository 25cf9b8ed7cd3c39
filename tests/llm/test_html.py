import time

import numpy as np

from lacuna.llm import html_text

MENU = '<nav><ul><li><a href="/a">Home</a></li></ul></nav>'
PAGE = (
    f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body><header><h1>Site</h1></header>{MENU}'
    '<div class="ad">Buy!</div><article><h1>Head &amp; line</h1><p><b>Bold<br>text<p>Two  &lt;b&gt;\n words</p><div class="cookie-notice">We use cookies</div><p>x&eacute;</p>'
    '<aside>Side</aside><form><label>Name</label><input></form><ul><li>item</li></ul></article><section id="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; us</footer></body></html>'
)


def test_article_only():
    assert html_text.main_text(PAGE) == "Head & line Bold text Two <b> words xé item"


def test_without_article_element():
    body = "<p>" + "A long paragraph of the story goes on. " * 5 + "</p><p>Second part of the story.</p>"
    page = f"<html><body>{MENU}<div class='sidebar'>Links</div><div id=content>{body}</div><div class='footer'>End</div></body></html>"
    assert html_text.main_text(page) == " ".join(("A long paragraph of the story goes on. " * 5 + "Second part of the story.").split())


def test_odd_pages():
    for page, text in ((None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>cut off <b>here", "cut off here"), ("<div <p>", ""), ("a<!-- x", "a"), ("<script>x", "")):
        assert html_text.main_text(page) == text
    assert html_text.main_text("<p>" + "word " * 200_000 + "</p>") == ("word " * 200_000).strip()


def test_surge_and_dive():
    assert html_text.sections(np.array([0, 0, 0, 5, 0, 7, 0, 0, 0, 0, 3])) == [(3, 6, 12), (10, 11, 3)]


def test_sections_against_all_windows():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = rng.integers(0, 40)
        mass = rng.integers(1, 9, n) * (rng.random(n) < rng.random())
        want, run = [], []
        for i in range(len(mass) + 1):
            window = sum(mass[i : i + html_text.WINDOW]) if i < len(mass) else 0
            if window:
                run.append((i, window))
            elif run:
                heavy = [k for k, _ in run if mass[k]]
                want.append((heavy[0], heavy[-1] + 1, max(w for _, w in run)))
                run = []
        assert html_text.sections(mass) == want


def test_lengths_decide_without_any_hint():
    long = "A paragraph of the story that goes on for quite a while, with commas and all. "
    links = "".join(f"<p><a href=/{i}>Another page {i}</a></p>" for i in range(8))
    body = f"<h2>Title</h2><p>{long * 4}</p><p>Short.</p><p>{long * 3}</p><p>It ends.</p>"
    want = f"Title {(long * 4).strip()} Short. {(long * 3).strip()} It ends."
    assert html_text.main_text(f"<html><body><div>{links}</div><div>{body}</div><div>{links}</div><div>Made with care</div></body></html>") == want
    # The same lines, but the story is hardly longer than what stands apart from it: both stay.
    page = f"<div><p>{long}</p></div><div>{links}</div><div><p>{long}</p></div>"
    assert html_text.main_text(page) == f"{long.strip()} {long.strip()}"


def test_a_short_end_after_an_advert_stays():
    long, ad = "A paragraph of the story that goes on for quite a while. " * 6, "<div class=ad><p>Buy</p><p>more</p><p>of</p><p>this</p></div>"
    for tag in ("div", "article"):
        assert html_text.main_text(f"<{tag}><p>{long}</p>{ad}<p>It ends.</p></{tag}>") == f"{long.strip()} It ends."


def test_deep_pages():
    n = 100_000
    for page in ("<div>" * n + "</ul>" * n + "x", "<div><ul>" * n + "x" + "</div></ul>" * n, "<nav><article>" * n + "x", "<article>" * n + "x"):
        start = time.perf_counter()
        assert html_text.main_text(page) == "x"
        assert time.perf_counter() - start < 10


def test_query_schema(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, 3), (None, None, None, 4), (1, "u", PAGE, 3)], "page_id long, url string, html string, n_chars int")
    got = html_text.extract(rows).collect()
    assert sorted(r.n_chars for r in got) == [0, 43, 43]
    assert html_text.extract(rows.limit(0)).collect() == []
