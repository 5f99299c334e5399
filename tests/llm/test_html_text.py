import html
import re

import duckdb
import numpy as np
from ledgerflow.llm import html_text as h


def by_markup(page):
    """The article's blocks, read off the known shape of the test pages."""
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split(r"</?p>|</?h1>", body)]
    return "\n".join(p for p in parts if p)


def test_query_matches_the_article(spark, sf):
    pages = dict(duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall())
    rows = h.query(spark, sf).collect()
    assert len(rows) == len(pages)
    assert all(r.text == by_markup(pages[r.page_id]) and r.n_chars == len(r.text) for r in rows)


def test_accuracy_on_new_pages_of_the_training_kind():
    pages = h.training_pages(80, seed=99)
    x, mask = h.padded([h.vectors(b) for b, _ in pages])
    keep = h.trained().logits(x, mask) > 0
    assert np.mean(np.concatenate([keep[i, : len(y)] == np.array(y) for i, (_, y) in enumerate(pages)])) > 0.97


PROSE = ["The harbour was quiet when the first boats came back that morning.", "Nobody on the quay had expected them so early, and the market stood empty.", "By noon the catch was sold and the crews had gone home to sleep."]
#: Layouts that the training pages do not have: other nesting, other names, old table layout, no names at all.
LAYOUTS = [
    "<body><div class=top-bar><ul class=nav><li><a href=/>Start</a><li><a href=/b>Blog</a></ul></div><div class=wrap><main><h1>{0}</h1><p>{1}</p><p>{2}</p></main><aside class=rail><h4>Most read</h4><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul></aside></div><footer class=site-footer><p>Copyright. All rights reserved</p></footer></body>",
    "<table><tr><td class=menu><a href=/>Home</a><br><a href=/n>News</a></td><td class=content><article><h2>{0}</h2><p>{1}<p>{2}</article></td></tr></table><div id=footer>Imprint and privacy</div>",
    "<header role=banner><h3>Daily paper</h3><nav><a href=/>Home</a> <a href=/x>Sport</a></nav></header><article class=post><header><h1>{0}</h1></header><section><p>{1}</p><blockquote>{2}</blockquote></section></article><section id=comments class=comment-list><h3>2 comments</h3><p>Great post, thanks</p><p>I do not agree</p></section>",
    "<div id=cookie-notice class=notice><p>We use cookies. <a href=/p>Accept</a></p></div><div id=content class=content><p>{0}</p><p>{1}</p><p>{2}</p></div><div class=sidebar><p>Subscribe to our newsletter</p></div>",
]


def test_layouts_that_training_does_not_have():
    right = total = 0
    for layout in LAYOUTS:
        page = layout.format(*PROSE)
        own = h.blocks(page)
        keep = h.trained().logits(*h.padded([h.vectors(own)]))[0] > 0
        want = [b.text in PROSE for b in own]
        assert sum(want) == 3
        right += sum(a == b for a, b in zip(keep.tolist(), want, strict=True))
        total += len(own)
    assert right >= 0.9 * total


def test_segments_give_the_labels_of_the_whole_page(monkeypatch):
    page = max((b for b, _ in h.training_pages(40, seed=5)), key=len)
    whole = h.trained().logits(*h.padded([h.vectors(page)]))[0]
    monkeypatch.setattr(h, "SEGMENT", 4)
    assert len(page) > 8 and np.allclose(h.trained().logits_of_page(page), whole, atol=1e-4)


def test_a_ten_megabyte_page():
    row = "<p>The harbour was quiet when the boats came back that morning.</p>"
    page = "<body><article>" + row * (10_000_000 // len(row)) + "</article>"
    (text,) = h.main_texts([page], h.trained())
    assert text.count("\n") == 10_000_000 // len(row) - 1
    deep = h.blocks("<div>x" * 100_000)
    assert len(deep) == 100_000 and len(h.blocks("<a b=\"" * 200_000)) <= 1


def test_broken_markup():
    texts = lambda page: [b.text for b in h.blocks(page)]
    assert texts("<head>" * 3000 + "<p>kept") == ["kept"]
    assert texts("before<head><title>t</title></head><p>after") == ["before", "after"]
    assert texts('<head data-x="a>b"><p>kept</p>') == ["kept"]
    assert texts("<p title='a>b' class=it's>one it's</p>") == ["one it's"]
    for name in ("button", "textarea", "option", "title", "object", "select", "iframe", "svg", "noscript", "template"):
        assert texts(f"<p>one</p><{name}>go<p>two</p><p>three</p>") == ["one", "two", "three"], name
        assert texts(f"<p>one</p><{name}>go</{name}><p>two <{name}>x</{name}>three</p>") == ["one", "two three"], name
        assert texts(f"<{name}>go<p>two</p><{name}>x</{name}> y") == ["two", "y"] or name in h.RAW_TAGS, name
    assert texts("<p>a<script>var x = '<p>no</p>'") == ["a"] and texts("a<!-- b -->c<!-- d") == ["ac"]
    assert texts("x </p></div> y <p") == ["x", "y"]
    for comment in ("<!-->", "<!--->", "<!-- x --!>", "<!-- x -->", "<!---->", "<!----->", "<!-- a > b -> c -->", "<!--!>-->", "<!-- <p>no</p> --!>"):
        assert texts(f"<p>A</p>{comment}<p>B</p>") == ["A", "B"], comment
    assert texts("<p>A</p><!-- x --! ><p>B</p>") == ["A"] == texts("<p>A</p><!--<p>B</p>")


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = h.Labeller(hidden=3, inputs=5)
    x, mask = rng.normal(size=(2, 4, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    y = np.array([[1, 0, 1, 0], [0, 1, 0, 0]], float)

    def loss():
        z = m.logits(x, mask)
        return ((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum()

    for k, g in m.gradients(x, mask, y).items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 7)]:
            was = m.p[k][at]
            m.p[k][at] = was + 1e-5
            up = loss()
            m.p[k][at] = was - 1e-5
            down = loss()
            m.p[k][at] = was
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_blocks():
    page = "<html><head><title>t</title></head><body><!-- <p>no</p> --><script>var a='</p>x';</script><p>a&nbsp; &lt;b&gt; <b>c<p>d<br>e<div class=\"Ad Box\"><a href='#'>f</a></div><select><option>g</select> tail &am <p"
    got = h.blocks(page)
    assert [b.text for b in got] == ["a <b> c", "d e", "f", "tail &am"]
    assert got[2].linked == 1 and {"div", "div.ad", ".box"} <= set(got[2].path)
    assert [b.text for b in h.blocks("<head><meta x><p>kept")] == ["kept"]
    assert h.blocks(None) == h.blocks("") == h.blocks("<p></p>") == []


def test_awkward_rows(spark, awkward):
    df = awkward.withColumnRenamed("text", "html")
    out = h.extract(df)
    assert out.count() == awkward.count() and out.where("html_is_null = 1").count() == 0 if "html_is_null" in out.columns else out.where("text is null").count() == 0
    assert h.extract(df.limit(0)).count() == 0
    clash = spark.createDataFrame([("<article><p>The harbour was quiet when the boats came.</p></article>", "x", 5)], "html string, Text string, N_chars int")
    assert h.extract(clash).columns == ["text", "n_chars"]
