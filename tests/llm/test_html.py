"""Main text of pages: a plain reading of the article, templates without one, odd input."""

import html
import re

import pytest

from panelspark.llm import html_extract as H
from panelspark.llm import queries

LONG = "A paragraph of the story that goes on for a while, with commas, and ends in a full stop."


def test_query_gives_the_article(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op7(spark, sf).collect()
    assert len(got) == len(pages)
    for row in got:
        inside = re.search(r"<article>(.*?)</article>", pages[row["page_id"]]["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", inside)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert row["text"] == " ".join(b for b in want if b)
        assert row["n_chars"] == len(row["text"])


@pytest.mark.parametrize(
    "part",
    [
        "<nav><ul><li>Home<li>More</ul></nav>",
        "<header><p>Site name and a claim</p></header>",
        "<aside><p>Also read</p></aside>",
        '<div class="ad">Buy now, buy more</div>',
        '<div id="cookie-notice"><p>We use cookies</p></div>',
        '<section class="post-comments"><article class="comment"><p>I liked it</p></article></section>',
        '<form><label>Mail</label><input name="m"><button>Send</button></form>',
        "<script>var a = '<p>no</p>';</script><style>p{margin:0}</style>",
        "<noscript>Switch it on</noscript>",
        '<div role="navigation">Here there</div>',
        "<!-- a remark -->",
        '<div class="sidebarWidget">Top ten</div>',
    ],
)
@pytest.mark.parametrize("shell", ["<article>{}</article>", '<div class="content">{}</div>', "<main><div>{}</div></main>"])
def test_parts_that_go(part, shell):
    page = "<html><body>" + shell.format(f"<h1>Title</h1><p>{LONG}</p>{part}<p>{LONG}</p><p>End.</p>") + "</body></html>"
    assert H.main_text(page) == f"Title {LONG} {LONG} End."
    page = f"<html><body>{part}" + shell.format(f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>") + f"{part}</body></html>"
    assert H.main_text(page) == f"Title {LONG} {LONG}"


def test_ratio_picks_the_text_where_nothing_is_marked():
    links = "".join(f"<a href='/{i}'>Link {i}</a> " for i in range(12))
    page = f"<body><div>{links}</div><div><p>{LONG}</p><p>{LONG} {LONG}</p><p>Short.</p></div><div>{links}</div></body>"
    assert H.main_text(page) == f"{LONG} {LONG} {LONG} Short."


def test_marks_do_not_decide_alone():
    story = f"<p>{LONG}</p><p>{LONG} {LONG}</p><p>Short.</p>"
    want = f"{LONG} {LONG} {LONG} Short."
    teasers = "<article><a href='/1'>Teaser one</a></article><article><a href='/2'>Teaser two</a></article>"
    assert H.main_text(f"<body><div class=content>{story}</div><section>{teasers}</section></body>") == want
    assert H.main_text(f"<body><section>{teasers}</section><div class=content>{story}</div></body>") == want
    assert H.main_text(f"<body><main>{story}</main><section>{teasers}</section></body>") == want
    # the mark tips the balance between texts of like size
    assert H.main_text(f"<body><article>{story}</article><div><p>{LONG[:60]}</p></div></body>") == want


def test_ratios_give_the_text_of_every_page(spark):
    """Each page of the table by another reading of the method: no line of the kept regions is missing, none is added."""
    sf = "/root/testdata/sf0.001"
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        parser = H.Lines()
        parser.feed(r["html"])
        parser.close()
        values = [len(t) / max(1, g) * (H.MARK if a else 1) for t, g, _, a in parser.lines]
        near = [-2, -1, 0, 1, 2]
        soft = []
        for i in range(len(values)):
            weights = [(pow(2.718281828459045, -0.5 * d * d), values[i + d]) for d in near if 0 <= i + d < len(values)]
            soft.append(sum(w * v for w, v in weights) / sum(w for w, _ in weights))
        low, high = min(soft), max(soft)
        for _ in range(100):
            under = [v for v in soft if v < (low + high) / 2]
            over = [v for v in soft if v >= (low + high) / 2]
            if not under:
                break
            low, high = sum(under) / len(under), sum(over) / len(over)
        kept = {region for (_, _, region, _), v in zip(parser.lines, soft) if v >= (low + high) / 2 - 1e-9}
        assert H.main_text(r["html"]) == " ".join(t for t, _, region, _ in parser.lines if region in kept)


def test_marks_and_white_space():
    assert H.main_text("<article><p>a<b>b</b> &amp; \n\t c&nbsp;&#100;<br>e</article>") == "ab & c d e"
    assert H.main_text("<article><p>open <b>bold<p>next</article>") == "open bold next"
    assert H.main_text("<article><p>1 &lt; 2</p>") == "1 < 2"


def test_odd_input():
    assert H.main_text(None) == H.main_text("") == H.main_text("<html>") == ""
    assert H.main_text("plain words") == "plain words"
    assert H.main_text("<article>" + "<p>x</p>" * 20000 + "</article>") == " ".join(["x"] * 20000)
    assert isinstance(H.main_text("<" * 2000), str)
    assert H.main_text('<body class="has-sidebar"><div class="no-ads"><p>text</p></div>') == "text"


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (2, "<article>é</article>", None)], "page_id long, html string, text string")
    got = H.extract(df).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, ""), (1, ""), (2, "é")]
    assert H.extract(df.limit(0)).count() == 0
