"""Operator 9: main text of pages of known make, and site style trees by hand."""

import math

import pytest

from rolodeck.llm import style_tree as S

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head><body><header><a href="/">Site</a></header>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy <b>now</b></div><div class="cookie-notice">We use cookies</div><article><header><h1>Head&nbsp;line &eacute;</h1></header><p><b>Bold start.<br><p>Second
  para <i>with</i> &lt;tags&gt; &amp; <a href="y">link</a>.</p><aside>side</aside><ul><li>one<li>two</ul><form>f <input value="q"></form><section id="comments"><p>a reader</p></section><p class="notice">note</p>tail <button>Share</button> text</article>
<div class="sidebar">side</div><footer>&copy; host</footer>"""


def test_article_page():
    assert S.main_text(PAGE) == "Head line é\n\nBold start.\n\nSecond para with <tags> & link.\n\none\n\ntwo\n\ntail text"


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b</p>c", "a\n\nb\n\nc"), ("a<!-- b", "a"), ("x < y <1> z", "x < y <1> z"), ("<p title='a>b'>c</p>", "c"), ("<p title=\"a>b>c", "b>c"),
    ("<div>a<br>b</div>", "a b"), ("<main><p>in</p></main><p>out</p>", "in"), ("<script>if (a</b>) x</script >y", "y"), ("<body><nav>n</nav><div>a <span class=ad>ad</span> b</div>", "a b"),
    ("<article class='comment'><p>c</p></article><p>d</p>", "d"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<p>&#233;&#x41;&bogus; &amp;lt;</p>", "éA&bogus; &lt;"), ("<p>a</div>b</p>", "ab"),
    ("<article class='has sidebar'><p>kept</p></article>", "kept"), ("<p " + "a=\"" * 50_000, ""), ("<" * 100_000, "<" * 100_000), ("<b>" * 2_000 + "deep", "deep"),
])
def test_cases(html, text):
    assert S.main_text(html) == text


STORY = "A story that goes on for a while and says something."


@pytest.mark.parametrize("html, text", [
    (f"<div class='layout has-sidebar'><article><p>{STORY}</p></article><div class='sidebar'><p>side</p></div></div>", STORY),
    (f"<div class='content no-sidebar'><main><p>{STORY}</p></main></div>", STORY),
    (f"<div id='page-header-wrap'><div class='nav'>menu</div><div role='main'><p>{STORY}</p></div></div>", STORY),
    (f"<form id='aspnetForm'><div class='menu'>a menu</div><div class='page'><p>{STORY}</p></div></form>", STORY),
    (f"<div class='has-sidebar'><div class='x'><p>{STORY}</p></div></div>", STORY),
    (f"<form><article><p>{STORY}</p><form>f</form></article></form>", STORY),
    (f"<article><p>teaser</p></article><div><p>{STORY}</p></div>", f"teaser\n\n{STORY}"),
    (f"<article><p>{STORY}</p></article><div class='related'><article><p>{STORY} {STORY}</p></article></div>", STORY),
    (f"<div><p>short</p></div><section id='comments'><p>{STORY}</p></section>", "short"),
])
def test_wrappers(html, text):
    assert S.main_text(html) == text


SCHEMA = "page_id long, url string, html string"


def site(spark):
    # pages without article: a box that is the same everywhere, one that is not
    pages = [(i, f"http://h.org/{i}", f'<body><div class="box">Same on every page</div><div class="b{"" if i % 2 else ""}ody">text of page {i} <p>more {i}</p></div>') for i in range(12)]
    return pages + [(100 + i, "http://small.org/", '<div class="box">Same on every page</div><p>x</p>') for i in range(2)] + [(200, None, '<div class="box">Same on every page</div>'), (201, "http://e.org/", None)]


def test_importance(spark):
    rows = {(r["host"], r["path"]): r for r in S.importance(spark.createDataFrame(site(spark), SCHEMA)).collect()}
    box, body, p = (rows["h.org", S.hashed(f"/body/{x}")] for x in ("div.box", "div.body", "div.body/p"))
    assert (box["pages"], box["content"], round(box["importance"], 9)) == (12, 0.0, 0.0)
    assert body["content"] == p["content"] == 1.0 and body["presentation"] == 0.0 and math.isclose(body["importance"], 0.9)
    assert rows["small.org", S.hashed("/div.box")]["importance"] == 1.0


def test_low_branches_go(spark):
    df = spark.createDataFrame(site(spark), SCHEMA).selectExpr("*", "'x' AS text", "1 AS low")
    got = {r["page_id"]: r for r in S.extract(df).collect()}
    assert len(got) == 16
    assert got[3]["text"] == "text of page 3\n\nmore 3" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[100]["text"] == "Same on every page\n\nx" and got[200]["text"] == "Same on every page" and got[201]["text"] == ""


def test_an_article_stays_whole_though_all_pages_share_it(spark):
    pages = [(i, f"http://h.org/{i}", f"<nav>{i}</nav><article><h1>Same</h1><p>story</p></article>") for i in range(9)]
    assert {r["text"] for r in S.extract(spark.createDataFrame(pages, SCHEMA)).collect()} == {"Same\n\nstory"}


def test_near_copies_count_once(spark):
    # a site without article elements: most pages are tracking copies of one story, each with a block of its own
    say = " ".join(f"word{k}" for k in range(60))
    copies = [(i, f"http://h.org/{i}", f'<body><div class="box">Same on every page</div><div class="content"><p>{say}</p></div><div class="ref">visit {i}</div></body>') for i in range(20)]
    others = [(100 + i, f"http://h.org/o{i}", f'<body><div class="box">Same on every page</div><div class="content"><p>another story, the {i}th, on something else</p></div></body>') for i in range(4)]
    got = {r["page_id"]: r["text"] for r in S.extract(spark.createDataFrame(copies + others, SCHEMA)).collect()}
    assert all(say in got[i] and "Same" not in got[i] for i in range(20))
    assert all(got[100 + i] == f"another story, the {i}th, on something else" for i in range(4))
    alone = {r["page_id"]: r["text"] for r in S.extract(spark.createDataFrame(copies, SCHEMA)).collect()}
    assert all(say in alone[i] for i in range(20))


def test_a_page_never_goes_whole():
    low = frozenset(S.hashed(x) for x in ("/div.a", "/div.b/p"))
    assert S.main_text("<div class=a>short</div><div class=b><p>one longer</p><p>two</p></div>", low) == "one longer\n\ntwo"


def test_empty_and_repeated(spark):
    assert S.extract(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in S.extract(spark.createDataFrame([(1, "http://a.b/", "<p>x")] * 2, SCHEMA)).collect()] == [(1, "http://a.b/", "x", 1)] * 2
