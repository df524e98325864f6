import random
import time

import pytest

from tessera.llm import html

PARAS = ["First, a sentence of the article that is long enough to count, with commas, and more words to reach a hundred characters.", "Second &amp; third: caf&eacute; &#8364; &#x41;, and a   line\nbreak inside of it; the text goes on for quite a while, to be sure of it.", "Third paragraph, which tells the end of the story in several words, and then stops there, as all stories do in the end."]
WANT = [PARAS[0], "Second & third: café € A, and a line break inside of it; the text goes on for quite a while, to be sure of it.", PARAS[2]]
FURNITURE = """<header><h2>Site</h2><p>Welcome, dear reader, to this site, which has many words in its header, too many perhaps.</p></header><nav><ul><li><a href="/">Home page of the site, with long, long link text, and commas</a></li></ul></nav>"""
TAIL = """<div id="comments" class="comments"><p>I, as a reader, think that this is nonsense, and I will say so, at length, in many words, again and again, here.</p><p>Me too, dear friend, me too, and more, and more, and more.</p></div><aside class="sidebar"><p>Related, more, other, things, to read, all of them, great.</p></aside><form><p>Sign up, please, and send, your, address</p><button>Go</button></form><footer><p>Copyright, all rights reserved, by us, the owners, of this, site.</p></footer>"""
BODIES = [
    "<article><h1>Title</h1>{}</article>",
    '<div class="wrap"><div id="content"><h1>Title</h1>{}</div></div>',
    '<main><div class="post-body"><h1>Title</h1>{}</div></main>',
    '<div class="layout has-sidebar"><div class="page-header"><main class="post"><h1>Title</h1>{}</main></div></div>',
    '<div class="entry-header"><h1>Title</h1></div><div class="entry-content">{}</div>',
    '<table><tr><td class="text"><h1>Title</h1>{}</td><td class="sidebar">x</td></tr></table>',
]


@pytest.mark.parametrize("body", BODIES)
def test_article_is_kept_and_furniture_dropped(body):
    page = f"<!DOCTYPE html><html><head><title>T, t</title><style>p{{a:b}}</style><script>var t='</p>'; if (a<b) c;</script></head><body>{FURNITURE}{body.format(''.join(f'<p>{p}</p>' for p in PARAS))}<div class='ad'>Buy, buy, buy, and buy again, now, here, at once, for less.</div><div class=cookie-notice><p>We use cookies, many of them, for you, and for us, and for them.</p></div>{TAIL}</body></html>"
    assert html.extract(page) == "\n".join(["Title", *WANT])


def test_parts_of_an_article():
    parts = [f"<p>{p}</p>" for p in PARAS]
    page = f"<body>{FURNITURE}<div class='story'><div>{parts[0] * 6}</div><div>{parts[1]}</div><div class='share-bar'><p>Share this, with all, your friends, and others too.</p></div><div>{parts[2]}</div></div>{TAIL}</body>"
    assert html.extract(page) == "\n".join([WANT[0]] * 6 + WANT[1:])


def test_unclosed_and_broken_markup():
    body = "<article><h1>Title</h1><p><b>Bold start.<br><p>" + "<p>".join(PARAS) + "<ul><li>One item<li>Another <i>item</ul></article><footer>&copy; x"
    assert html.extract(body) == "\n".join(["Title", "Bold start.", *WANT, "One item", "Another item"])
    assert html.extract("<p>a < b and c > d</p>") == "a < b and c > d"
    assert html.extract("<p>unclosed <b") != ""
    assert html.extract("<div>" * 5000 + "<p>deep</p>") == "deep"


def test_nothing_and_long():
    assert [html.extract(x) for x in (None, "", "   ", "<nav>Menu</nav>", "<script>x</script>")] == [""] * 5
    assert html.extract("Plain text only") == "Plain text only"
    long = "".join(f"<p>Paragraph number {i}, with a comma, and words enough to be counted here.</p>" for i in range(20_000))
    assert html.extract(f"<article>{long}</article>").count("\n") == 19_999


def test_inline_tags_and_entities():
    assert html.extract("<article><p>One<b>two</b> <a href='x'>three</a>, four&nbsp;five &lt;tag&gt; &bogus; &copy</p></article>") == "Onetwo three, four five <tag> &bogus; ©"


def test_main_text(spark):
    rows = [(1, "u", "<p>Some text here</p>", 3), (1, None, None, 3), (None, "v", "", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    got = [tuple(r) for r in html.main_text(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "Some text here", 14), (1, None, "", 0), (None, "v", "", 0)], key=str)
    assert html.main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("page", ["<a" * 500_000, "<" + "x" * 1_000_000, '<a "' * 250_000, '<a ">"' * 170_000, """<a ">"<b '>' """ * 80_000, "<div>" * 80_000 + "</p>" * 80_000, "<div>" * 80_000 + "</ul>" * 80_000, "<b><div>" + "<span>" * 80_000 + "</b>" * 80_000, "<main>" * 80_000, "<!--" * 250_000, "<li>" * 100_000, "<table>" * 50_000 + "<tr>" * 80_000, "&#" + "9" * 100_000 + ";"], ids=lambda p: p[:6])
def test_broken_pages_take_time_in_proportion(page):
    began = time.process_time()
    html.extract(page)
    assert time.process_time() - began < 15


def test_numbers_of_characters():
    assert html.extract("<p>a&#00000000000065;b&#x41;c</p>") == "aAbAc"
    assert html.extract("<p>a&#" + "9" * 5000 + ";b</p>") == "a�b"


def test_made_pages(spark):
    """Pages put together of a known article and known furniture, in many shapes; the article alone comes back."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    prose = lambda n: ", ".join(" ".join(word() for _ in range(rng.randint(4, 9))) for _ in range(n)) + "."
    pages, want = [], []
    for _ in range(150):
        paras = [prose(rng.randint(3, 9)) for _ in range(rng.randint(3, 9))]
        furniture = [
            f"<nav class='{word()}'><ul>{''.join(f'<li><a href=#>{word()}</a></li>' for _ in range(8))}</ul></nav>",
            f"<header><p>{prose(2)}</p></header>",
            f"<div class='advert'><p>{prose(3)}</p></div>",
            f"<div id='comments'><p>{prose(4)}</p><p>{prose(2)}</p></div>",
            f"<form><label>{word()}</label><input name=q></form>",
            f"<script>var x = '<p>{prose(2)}</p>';</script>",
            f"<aside><p>{prose(3)}</p></aside>",
            f"<footer>{prose(1)}</footer>",
            f"<!-- <p>{prose(2)}</p> -->",
        ]
        rng.shuffle(furniture)
        k = rng.randint(0, len(furniture))
        close = rng.choice(["</p>", ""])
        body = "".join(f"<p>{p}{close}" for p in paras)
        shape = rng.choice(["<article>{}</article>", "<main><div class=text>{}</div></main>", "<div class=wrap><div class='story'>{}</div></div>", "<div><section id=content>{}</section></div>"])
        pages.append(f"<html><head><title>{word()}</title></head><body>{''.join(furniture[:k])}{shape.format(body)}{''.join(furniture[k:])}</body></html>")
        want.append("\n".join(paras))
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("page_id", "cast(null as string) as url", "html")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert [i for i, w in enumerate(want) if got[i] != w] == []
