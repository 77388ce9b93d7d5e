"""Extraction: known pages, repeated parts of a site, broken markup."""

from collections import Counter
from math import log

from lexispark.llm import html_text as h


def plain(page):
    return h.text_of(h.parse(page)[0], set())


def test_parts_that_say_what_they_are():
    page = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";x(1)</script></head><body class="nav-open">
    <header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li><li>B</ul></nav><!-- ad <p>0</p> --><div class="ad">Buy</div><div id="cookie-notice">ok?</div>
    <article><header><h1>Head &amp; line</h1></header><p><b>One  two<br><p>th<i>re</i>e &eacute;&#33;&nbsp;x</p><form>f</form><aside>s</aside><ul><li>u<li>v</ul><section class="comments"><p>first!</p></section></article>
    <footer>&copy; me <p>more</p></footer></body></html>"""
    assert plain(page) == "Head & line One two three é! x u v"


def test_broken_markup():
    assert plain("<article><p>a<p>b</article><footer>c") == "a b"
    assert plain("<article>x<script>if (a<b) '</p>'") == "x"
    assert plain("<article>a<!-- never closed <p>b") == "a"
    assert plain("</p></div><article>a</b> c < d</article>") == "a c < d"
    assert plain('<article title="x>y">q</article>') == "q" and plain('<article><a title="x>q</a></article>') == "q"
    assert plain("<nav><ul><li>m<article><p>t</p></article>") == "t"
    assert plain("") == "" and plain("just text") == "just text"


def test_listed_words_do_not_drop_articles():
    assert plain("<article class='post comments-open'><p>a</p></article>") == "a"
    assert plain("<article class='comments'><p>a</p></article>") == "a"
    assert plain("<div class='content has-sidebar'><article><p>a</p></article></div>") == "a"
    assert plain("<main><div class='widget'><article><p>a</p></article>b</div></main>") == "a"
    assert plain("<article><h2 id='search-methods'>a</h2><section id='related-work'><p>b</p></section><div id='Related'>c</div></article>") == "a b"
    assert plain("<article>a<ol class='comments'><li><article>first!</article></ol></article>") == "a"
    assert plain("<aside><article>t</article></aside>b<div class='Cookie-Notice'>ok?</div>") == "b"


def test_site_style_tree(spark):
    def page(i):
        return f"<html><body><div class=top><p>Welcome to the site</p></div><div class=body><p>Story number {i} tells of {i * 7}.</p><p>Second part {i * i}</p></div><div class=end><p>All rights reserved</p></div></body></html>"

    rows = [(i, f"http://a.example/{i}", page(i), "x") for i in range(20)] + [(50, "http://b.example/1", page(3), "x"), (51, None, None, "x"), (52, "::bad::", "", "x"), (None, "http://a.example/0", page(0), "x")]
    rows += [(60 + i, f"http://c.example/{i}", "<article><p>The same article</p></article>", "x") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in h.extract(df).collect()}
    assert len(got) == len(rows)
    for i in range(20):
        assert got[i].text == f"Story number {i} tells of {i * 7}. Second part {i * i}" and got[i].n_chars == len(got[i].text)
    assert got[None].text == got[0].text
    assert "Welcome to the site" in got[50].text  # the only page of its host
    assert got[51].text == got[52].text == "" and got[52].n_chars == 0
    assert all(got[60 + i].text == "The same article" for i in range(5))
    assert h.extract(df.limit(0)).count() == 0


def test_importance_equals_a_plain_computation(spark):
    def page(i):
        links = "".join(f"<p><a>l{k}</a> t{k % 2}</p>" for k in range(i % 3))
        return f"<div class=top>Welcome{i % 2}{links}</div><div class=box><p>Same</p><p>Own {i}</p></div>"

    rows = [(i, f"http://{'ab'[i % 5 == 0]}.example/{i}", page(i)) for i in range(24)]
    got = sorted(round(r.importance, 9) for r in h.importances(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect())
    texts, shapes, seen = Counter(), Counter(), []
    for _, url, html in rows:
        blocks, children = h.parse(html)
        for path, names in children.items():
            shapes[h.host_of(url), path, tuple(names)] += 1
        for b in blocks:
            texts[h.host_of(url), b.path, b.text] += 1
            seen.append((h.host_of(url), b))
    want = []
    for host, b in seen:
        at = {k[2]: n for k, n in texts.items() if k[:2] == (host, b.path)}
        m = sum(at.values())
        content = 1 - log(at[b.text]) / log(m) if m > 1 else 1.0
        kinds = [n for k, n in shapes.items() if k[:2] == (host, b.path)]
        total = sum(kinds)
        shape = content if not kinds else -sum(n / total * log(n / total) for n in kinds) / log(total) if total > 1 else 1.0
        want.append(round((h.CONTENT_WEIGHT * content + (1 - h.CONTENT_WEIGHT) * shape) * (1 - b.links / len(b.text)), 9))
    assert all(abs(x - y) < 1e-6 for x, y in zip(got, sorted(want), strict=True)) and len(set(want)) > 5


def test_blocks_of_neutral_names_are_for_the_tree():
    page = "<div class='layout no-sidebar'><div class='a1'><p>x</p></div><div class='form-group'><p>y</p></div></div><article><header class='article-header'><h1>T</h1></header></article>"
    blocks, _ = h.parse(page)
    assert [(b.text, b.keep) for b in blocks] == [("x", None), ("y", None), ("T", True)]
