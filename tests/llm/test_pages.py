from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from tidemark.llm import line_blocks as lb
from tidemark.llm import warc_index as wi
from tidemark.llm.common import work_dir

PAGE = """<!DOCTYPE html><html><head><title>T &amp;</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="ad">Buy now.</div><article><h1>Title</h1><p><b>First&nbsp;line<br>goes   on &lt;here&gt;.<br><p>Second &eacute; line.</p><div class="share">Share this</div><p>x</p></article>
<section class="comments"><article class="comment"><p>A long reader comment that must not be kept at all.</p></article></section><footer>&copy; me</footer></body></html>"""


def test_article_and_noise():
    assert lb.main_text(PAGE) == "Title\nFirst line goes on <here>.\nSecond é line.\nx"
    assert lb.main_text(None) == lb.main_text("") == lb.main_text("<nav>only</nav>") == ""
    assert lb.main_text("<p>short</p>") == "short"
    assert lb.main_text("plain < text & more") == "plain < text & more"


def test_page_without_article_keeps_what_lies_between_surge_and_dive():
    body = "".join(f"<p>{'A sentence of the main text that is long enough. ' * 3}</p>" for _ in range(4))
    page = f"<body><div>Menu</div><div class='sidebar'>Side</div><div class='sidebar'>Side</div><div class='sidebar'>Side</div><div>{body}<p>tiny</p></div><footer>foot</footer></body>"
    got = lb.main_text(page).split("\n")
    assert got[-1] == "tiny" and len([x for x in got if x.startswith("A sentence")]) == 4 and "foot" not in got and "Side" not in got


def test_unclosed_tags_do_not_lose_the_article():
    assert lb.main_text("<body><div class=ad>ad<div><article><p>Kept text</article>") == "Kept text"
    assert lb.main_text("<article><p>Cut off <b>in the mid") == "Cut off in the mid"


def test_page_without_article_keeps_short_first_and_last_lines():
    ad, para = "<div class='ad'>Buy now.</div>", f"<p>{'A sentence of the main text that is long enough. ' * 3}</p>"
    top = "<header>Site</header><nav><a href='/'>Home</a></nav>"
    page = f"<body>{top}<div><h1>Short title</h1><p>By A. Author</p><p>3 May</p>{para}{para}{ad * 3}<p>Thanks for reading.</p></div><div class='comments'><p>Nice one.</p></div><p>Imprint</p></body>"
    got = lb.main_text(page).split("\n")
    assert got[:3] == ["Short title", "By A. Author", "3 May"] and len(got) == 6 and got[-1] == "Thanks for reading."
    between = f"<body>{top}{para}<div class='nav'>More</div><p>Short part</p><div class='nav'>More</div>{para}<footer>foot</footer></body>"
    assert lb.main_text(between).split("\n")[1] == "Short part" and len(lb.main_text(between).split("\n")) == 3
    links = "<p>Site name</p>" + "<p><a href='/'>Link</a></p>" * 3
    assert lb.main_text(f"<body>{links}<h1>Title</h1>{para}<p><a href='/'>See also</a></p><p>End.</p></body>").split("\n")[::2] == ["Title", "End."]


PARA = "<p>" + "A sentence of the main text that is long enough. " * 6 + "</p>"


@pytest.mark.parametrize(
    "page",
    [
        '<body><div class="content with-sidebar"><h1>Title</h1>{0}<p>End.</p></div></body>',
        '<body><form id="aspnetForm" method="post"><div><h1>Title</h1>{0}<p>End.</p></div></form></body>',
        '<body><section class="main-search"><h1>Title</h1>{0}<p>End.</p></section></body>',
        '<body><div class="layout-related"><h1>Title</h1>{0}<p>End.</p></div></body>',
        '<body><div class="layout"><div class="sidebar"></div><h1>Title</h1>{0}<p>End.</p></div></body>',
        '<body><table><tr><td><div class="sidebar">Side<td><h1>Title</h1>{0}<p>End.</p></table></body>',
        '<body><div><div class="sidebar">Side</div><div class="sidebar"><h1>Title</h1>{0}<p>End.</p></body>',
        '<body><article><div class="article-header banner"><h1>Title</h1></div>{0}<div class="share">Share</div><p>End.</p></article></body>',
        '<body><div class="page has-ads"><p class="notice">Note<div><h1>Title</h1>{0}<p>End.</p></div></div></body>',
    ],
)
def test_names_and_forms_lose_no_article(page):
    top, foot = '<header>Site</header><nav><a href="/">Home</a></nav>', '<div class="comments"><p>' + "A long reader comment. " * 20 + "</p></div><footer>foot</footer>"
    for before, after in (("", ""), (top, foot)):
        got = lb.main_text(page.format(PARA * 2).replace("<body>", "<body>" + before).replace("</body>", after + "</body>")).split("\n")
        got = [x for x in got if x != "Side"]
        assert got == ["Title", *[PARA[3:-5]] * 2, "End."]


def test_short_text_beside_long_noise_stays_alone():
    long = "A long line of a box that is no article at all. " * 8
    for noise in (f'<div class="comments"><p>{long}</p></div>', f"<aside><p>{long}</p></aside>", f"<footer>{long}</footer>"):
        assert lb.main_text(f"<body><div><h1>Title</h1><p>Short.</p></div>{noise}</body>") == "Title\nShort."
    assert lb.main_text(f'<body><div>{PARA}</div><div class="related"><p>{long}</p><p>{long}</p></div></body>') == PARA[3:-5]
    assert lb.main_text(f'<body><article><p>Short.</p></article><div class="widget"><p>{long}</p></div></body>') == "Short."


def made_page(rng):
    """A page and its text, put together from blocks that are article or noise by construction."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    plain = lambda n: " ".join(word() for _ in range(n))
    noise = [
        lambda: f'<nav><ul><li><a href="/x">{plain(2)}</a></li><li><a href="/y">{plain(1)}</a></ul></nav>', lambda: f"<script>{plain(5)} </p></script>", lambda: f'<div class="ad">{plain(6)}</div>',
        lambda: f"<aside><p>{plain(30)}</p></aside>", lambda: f"<style>p {{ {word()} }}</style>", lambda: f'<div class="newsletter box"><div>{plain(8)}</div><form><input name=q>{plain(2)}</form></div>',
        lambda: f"<form><label>{plain(2)}</label><button>{word()}</button></form>", lambda: f"<!-- {plain(4)} <p>x</p> -->", lambda: f'<div id="sidebar"><div>{plain(4)}<div>{plain(3)}</div></div></div>',
    ]

    def block():
        words = plain(rng.choice([3, 30, 60]))
        shown = words.split()
        k = rng.randrange(len(shown))
        form = rng.randrange(5)
        if form == 0:
            raw = " ".join(shown[:k] + [f"<b>{shown[k]}</b>"] + shown[k + 1 :])
        elif form == 1:
            raw, words = words + " &lt;x&gt;&nbsp;&eacute;&#8364;", words + " <x> é€"
        elif form == 2:
            raw = "\n\t " + "  ".join(shown) + "\n"
        elif form == 3:
            raw = words.replace(" ", "<br>", 1)
        else:
            raw = f'<a href="/z">{shown[0]}</a> ' + " ".join(shown[1:])
        tag = rng.choice(["p", "h2", "div", "blockquote", "li"])
        return f"<{tag}>{raw}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>"), words

    body, want = [], []
    for _ in range(rng.randrange(1, 9)):
        raw, words = block()
        body.append(raw)
        want.append(words)
        if rng.random() < 0.3:
            body.append(rng.choice(noise[2:3] + noise[5:6])())
    raw, words = f"<p>{(long := plain(60))}</p>", long  # a text has a paragraph
    body.append(raw)
    want.append(words)
    article = "".join(body)
    article = rng.choice([f"<article>{article}</article>", f"<main><div>{article}</div></main>", f"<div class=content>{article}</div>", f"<div><div>{article}</div></div>"])
    around = lambda: "".join(rng.choice(noise)() for _ in range(rng.randrange(4)))
    comments = f'<section class="comments"><h3>{plain(2)}</h3><article class="comment"><p>{plain(40)}</p></article></section>' if rng.random() < 0.5 else ""
    return f"<!DOCTYPE html><html><head><title>{plain(3)}</title></head><body><header><h1>{word()}</h1></header>{around()}{article}{around()}{comments}<footer>{plain(5)}</footer></body></html>", "\n".join(want)


def test_made_pages_give_exactly_their_text():
    rng = random.Random(11)
    for _ in range(400):
        page, want = made_page(rng)
        assert lb.main_text(page) == want


def odd_pages(spark):
    big = "<p>" + "text " * 400 + "</p>"
    rows = [(1, "http://a", big, 1), (2, "http://b", big, 2), (3, "http://c", big, 3), (3, "http://c", big, 3), (None, "http://d", big, 4), (5, None, None, None), (6, "u\r\nx y", "", 6), (7, "http://e", "small", 7), (8, "http://f", "small", 8), (9, "z", "é😀" * 5000, 9)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text int").selectExpr("*", "'q' as digest", "'r' as archive")


def test_extract_table(spark):
    pages = odd_pages(spark)
    got = lb.extract(pages)
    assert got.count() == pages.count() and "text" in got.columns and "digest" in got.columns
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert lb.extract(pages.limit(0)).count() == 0


def test_warc_round_trip(spark):
    pages = odd_pages(spark)
    path = work_dir(spark, "warc-test")
    index = wi.write_archives(wi.mark_revisits(pages), path, archive_bytes=500)
    got = wi.read_records(index).collect()
    src = [(r.page_id, r.html or "") for r in pages.collect()]
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for i, h in src)
    kind = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kind[(3, "response", None)] == 2 and kind[(1, "revisit", 3)] == kind[(2, "revisit", 3)] == kind[(None, "revisit", 3)] == 1
    assert kind[(7, "response", None)] == kind[(8, "response", None)] == 1
    some = wi.read_records(index.where("page_id in (7, 9)")).collect()
    assert sorted(r.page_id for r in some) == [7, 9] and {r.payload for r in some} == {"small", "é😀" * 5000}
    assert wi.ranges(index).count() < index.count()
    empty = wi.write_archives(wi.mark_revisits(pages.limit(0)), path)
    assert wi.read_records(empty).count() == 0


def test_one_payload_many_times_without_broadcast(spark):
    big = "x" * 1200
    pages = spark.range(10_000).selectExpr("id as page_id", "concat('http://a/', id) as url", f"if(id % 10 = 9, concat('{big}', id), '{big}') as html")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hot in (100, 1 << 40):
            index = wi.write_archives(wi.mark_revisits(pages, hot=hot), work_dir(spark, "warc-hot"))
            got = wi.read_records(index, with_payload=False, task_bytes=100_000)
            assert got.rdd.getNumPartitions() > 8
            kind = Counter((r.record_type, r.refers_to) for r in got.collect())
            assert kind == {("revisit", 9998): 8999, ("response", None): 1001}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


OPEN = [
    ("<html><head><title>t</title><body><article><p>long text</p></article></body></html>", "long text"),
    ("<html><head><title>t</title><meta charset=utf-8><style>p {}</style><article><p>long text</article>", "long text"),
    ("<head><title>t</title></head><article><p>Value <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p>na<svg><path/></svg>ive</p></article>", "Value x=2 holds\nnaive"),
    ("<article><p>one<script>var a = '<p>';</script> two</p><object data=x>seen instead</object></article>", "one two\nseen instead"),
]


@pytest.mark.parametrize("page, text", OPEN)
def test_open_heads_and_inline_elements(page, text):
    assert lb.main_text(page) == text
