"""Wrappers and main texts against pages built from known parts."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from chatloom.llm import page_wrappers as pw
from chatloom.llm import queries
from chatloom.llm.page_tree import parse


def main_text(page, *others):
    w = pw.Wrapper.of(parse(page))
    for other in others:
        w = w.add(pw.Wrapper.of(parse(other)))
    return pw.Reader(w).text(parse(page))


def test_given_pages_give_their_articles(spark):
    data = "/root/testdata/sf0.01"
    pages = {(r.page_id, r.url): r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    found = queries.op12_page_wrappers(spark, data).collect()
    assert len(found) == len(pages)
    for r in found:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id, r.url], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inside))).split())
        assert r.text == want and r.n_chars == len(want)


NOISE = [
    "<nav><a href=x>menu</a></nav>", "<header><h1>Site</h1></header>", "<footer>&copy; foot</footer>", "<aside><p>beside</p></aside>", "<form><label>mail</label><input></form>", "<script>if (a < b) x = '<p>no</p>';</script>",
    "<style>p { }</style>", "<div class='ad-slot'>buy</div>", '<div id="cookieNotice"><p>we use</p></div>', "<section class=comments><article class=comment><p>first!</p></article></section>", "<div class='Sidebar left'><p>more</p></div>",
    "<!-- <p>gone</p> -->", "<div role=navigation>go</div>", "<div class='site-footer'>x<p>y</div>", "<noscript>turn it on</noscript>", '<ul class="breadcrumbs"><li>Home</ul>', "<div class=newsletter>join</div>", "<button>press</button>", "<iframe src=x>frame</iframe>",
]
PARTS = [
    ("<h1>Title &amp; more</h1>", "Title & more"), ("<p>One <b>bo</b>ld &lt;p&gt;\n  &nbsp;word", "One bold <p> word"), ("<p>a<br>b", "a b"), ("<ul><li>x<li>y <em>z</em></ul>", "x y z"), ("<table><tr><td>1<td>2<tr><th>3</table>", "1 2 3"),
    ("<blockquote><p>said</p></blockquote>", "said"), ("<pre>  k\n  l</pre>", "k l"), ("<p>1 < 2 &#x41;&#66; &notanentity; é漢</p>", "1 < 2 AB ¬anentity; é漢"), ("<div class='with-sidebar'><p>kept</p></div>", "kept"), ("<p class=commentary>a comment here</p>", "a comment here"),
    ("<h2>Menu of the day</h2>", "Menu of the day"), ("<span>in</span><i>line</i>", "inline"), ("<dl><dt>t<dd>d</dl>", "t d"), ("<p title='a > b'>quoted", "quoted"),
]


@pytest.mark.parametrize("seed", range(30))
def test_articles_lose_noise_and_nothing_else(seed):
    r = random.Random(seed)
    noise = lambda: "".join(r.sample(NOISE, r.randrange(6)))
    inside = [n for n in NOISE if "<header" not in n]
    parts = [r.choice(PARTS) for _ in range(r.randrange(1, 30))]
    body = "".join(p + (r.choice(inside) if r.random() < 0.3 else "") for p, _ in parts)
    tag = r.choice(["article", "main", "div role=main", "ARTICLE class='post'"])
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body class='has-sidebar'>{noise()}<div class=page><{tag}>{body}</{tag.split()[0]}>{noise()}</div>{noise()}" + r.choice(["</body></html>", ""])
    joined = " ".join(t for _, t in parts)
    # Inline parts next to each other are one line.
    got = main_text(page)
    assert got.replace(" ", "") == joined.replace(" ", "")
    if not any("<span" in p for p, _ in parts):
        assert got == joined


def test_unmarked_pages_lose_menus_and_what_all_pages_have():
    r = random.Random(5)
    words = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    articles = [[words(30) for _ in range(r.randrange(1, 6))] for _ in range(5)]
    menu = lambda: "<div><ul>" + "".join(f"<li><a href=/{i}>{words(2)}</a></li>" for i in range(r.randrange(2, 6))) + "</ul></div>"
    pages = [f"<body>{menu()}<div><h1>{a[0]}</h1>{''.join(f'<p>{p}</p>' for p in a[1:])}</div><div><p>Write to us</p></div></body>" for a in articles]
    for i, page in enumerate(pages):
        assert main_text(page, *pages[:i], *pages[i + 1 :]) == " ".join(articles[i])
    # Copies of one page have nothing of their own to be told apart by; nothing is lost.
    assert main_text(pages[0], pages[0], pages[0]).startswith(" ".join(articles[0]))


def test_expressions_align_and_merge_in_any_order():
    pages = ["<h1>a</h1><p>b</p><p>c</p>", "<h1>d</h1><h2>e</h2><p>f</p><hr>", "<h1>g</h1><p>h</p><h2>i</h2><p>j</p><div class=x1><p>k</p></div>", "<h1>a</h1>", ""]
    trees = [pw.Wrapper.of(parse(p)) for p in pages]
    assert trees[0].expression() == "h1(#text) (p(#text))+"
    assert trees[0].add(trees[1]).expression() == "h1(#text) h2(#text)? (p(#text))+"
    line = trees[0].add(trees[1]).add(trees[2]).add(trees[3]).add(trees[4])
    assert line.expression() == "h1(#text)? (h2(#text)? p(#text)?)+ div.x0(p(#text))?"
    merged = [line]
    for seed in range(20):
        ws = [pw.Wrapper.of(parse(p)) for p in pages]
        r = random.Random(seed)
        while len(ws) > 1:
            r.shuffle(ws)
            ws.append(pw.Wrapper.read(ws.pop().write()).add(ws.pop()))
        merged.append(ws[0])

    def counts(b):
        return {k: (v.pack()[:2] + v.pack()[3:]) if isinstance(v, pw.Slot) else (v.has, v.total, v.kind, counts(v)) for k, v in b.items.items()}

    assert all(counts(m.root) == counts(merged[0].root) and m.pages == 5 for m in merged)


def test_expressions_stay_small():
    r = random.Random(1)
    w = None
    for i in range(60):
        page = "".join(f"<div class='c{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}'><p>t{i}</p></div>" for _ in range(20))
        new = pw.Wrapper.of(parse(page))
        w = w.add(new) if w else new
        assert max(pw.size(w.root)[0] / pw.MOST_BLOCKS, pw.size(w.root)[1] / pw.MOST_BESIDE) <= 1
    # What classes told apart may seem optional when they no longer do.
    assert w.level == pw.BY_NAME and w.expression() == "(div(p(#text))?)+"
    odd = "".join(f"<x-{i}><section><p>{i}</p></section></x-{i}>" for i in range(90)) + "".join(f"<{t}>q</{t}>" for t in ("h1", "h2", "ul", "ol"))
    assert main_text(odd).split()[:90] == [str(i) for i in range(90)]
    deep = "<div>" * 5_000 + "deep <nav>no</nav><script>no</script>text" + "</div>" * 5_000
    assert main_text(deep) == "deep text"
    assert main_text("<b>" * 20_000 + "x" + "<p>y" * 3_000).split() == ["x"] + ["y"] * 3_000
    assert main_text("<article>" + "<p>" + "word " * 300_000 + "</article>") == ("word " * 300_000).strip()


def test_broken_markup_and_frames():
    assert main_text("") == main_text("<p></p><!---->") == ""
    assert main_text("a < b and <") == "a < b and <"
    assert main_text("<article><p>x</div></span>y</p> z<!-- never closed <p>z") == "x y z"
    assert main_text("<article>x<script>never closed <p>y</p>") == "x"
    # A frame named as a side bar that holds the only article; one that holds another article.
    assert main_text("<div class='layout sidebar-left'><p>no</p><article>yes</article></div>") == "yes"
    assert main_text("<article>yes</article><div class=related><article>no</article></div>") == "yes"
    assert main_text("<article><header><h1>Head</h1></header>t<footer>by</footer></article>") == "Head t"
    assert main_text("<main><p>a</p><article>b</article></main>") == "b"


def test_hosts_are_told_apart_and_merged_over_tasks(spark, monkeypatch):
    r = random.Random(9)
    words = lambda n: " ".join(str(r.randrange(10**6)) for _ in range(n))
    rows = []
    for i in range(300):
        host = "Hot.example.com" if i % 3 else f"h{i % 7}.example.org:80"
        own = words(40)
        rows.append((i, f"https://u@{host}/p/{i}?q#f", f"<body><div><b>Welcome to {host.lower()}</b></div><div><p>{own}</p><p>{i}</p></div></body>", f"{own} {i}"))
    rows += [(300, None, None, ""), (301, "no url", "<article>a</article>", "a"), (None, "http://h1.example.org", "", ""), (5, rows[5][1], rows[5][2], rows[5][3])]
    pages = spark.createDataFrame([(i, u, h, "x", 0) for i, u, h, _ in rows], "page_id long, url string, html string, wrapper string, host int").repartition(40)
    found = pw.extract(pages)
    assert sorted(((x.page_id, x.text, x.n_chars) for x in found.collect()), key=repr) == sorted(((i, t, len(t)) for i, _, _, t in rows), key=repr)
    known = {x.host: pw.Wrapper.read(x.wrapper) for x in pw.infer(pages).collect()}
    assert known["hot.example.com"].pages == 201 and len(known) == 9
    assert known["hot.example.com"].expression() == "body(div(=text) div((p(#text))+))"
    # Without room for a broadcast, and with tasks that hand on early.
    monkeypatch.setattr(pw, "FEW_BYTES", -1)
    monkeypatch.setattr(pw, "HELD", 5)
    monkeypatch.setattr(pw, "FAN", 2)
    assert sorted(map(str, pw.extract(pages).collect())) == sorted(map(str, found.collect()))
    assert pw.extract(pages.limit(0)).count() == 0
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert pages.select(pw.host_of(F.lit("HTTP://A.b/c")).alias("h")).first().h == "a.b"
