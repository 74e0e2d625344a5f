import numpy as np

from linkflow.llm import boilerplate
from linkflow.llm.pages import parse

PAGE = """<html><head><title>The mill - Town</title></head>
<body>
<header>
<nav>
<a href="/?p=0">Help</a><br>
<a href="/?p=1">About us</a><br>
</nav>
</header>
<article>
<h1>The old mill was opened at the crossroads</h1>
<p>A. Writer &#8211; published 24.10.2023</p>
<span>Reading time: 3 minutes</span>
<p>The small mill beside the canal was opened last spring. Nobody expected that it would work again, but it did.</p>
<p>Share this article: Twitterish | Facepage | E-mail</p>
<p>According to the council, at least 300 visitors saw the wheel during the summer.</p>
</article>
<footer>
<a href="/i0">Privacy policy</a>
<p>&#169; 2024 Town. All rights reserved.</p>
</footer>
</body>
</html>"""


def test_article_of_a_page(crawl):
    got = boilerplate.articles(crawl([("http://t.test/a", PAGE), ("http://t.test/b", ""), ("http://t.test/c", "<body>\n</body>"), ("http://t.test/d", None)]))
    assert sorted((r["fetch_id"], r["line_no"]) for r in got.collect()) == [(1, 10), (1, 13), (1, 15)]


def test_paragraphs_over_lines(crawl):
    head, rest = PAGE.split("<article>")
    inner, foot = rest.split("</article>")
    inner = inner.replace("<p>", "<div>").replace("</p>", "</div>").replace("but it did.</div>", "but it did.\nAccording to the council, at least 212 visitors saw how the bridge was painted.\nThe wheel was repaired after a long debate, said a spokesperson.</div>")
    page = head + "<div>" + inner + "</div>" + foot
    got = boilerplate.articles(crawl([("http://t.test/a", page)]))
    assert sorted(r["line_no"] for r in got.collect()) == [10, 13, 14, 15, 17]


def test_texts(crawl):
    got = {r["fetch_id"]: r for r in boilerplate.article_texts(parse_pages(crawl([("http://t.test/a", PAGE), ("http://t.test/b", "")]))).collect()}
    assert got[1]["n_lines"] == 3 and "wheel" in got[1]["text"] and got[2]["text"] == ""


def parse_pages(df):
    from linkflow.llm.pages import html_pages

    return html_pages(df)


def test_batches_do_not_change_labels():
    leaves = boilerplate.Leaves()
    w = boilerplate.load()
    reads = [leaves.page(parse(PAGE)[0]), leaves.page(parse(PAGE.replace("</article>", "<p>One more line of text.</p>\n" * 40 + "</article>"))[0])]
    together = boilerplate.label_pages(w, reads)
    for r, s in zip(reads, together, strict=True):
        assert np.allclose(boilerplate.label_pages(w, [r])[0], s, atol=1e-4)


def test_gradient_training_learns_a_rule():
    rng = np.random.default_rng(0)
    leaves = boilerplate.Leaves()
    pages, labels = [], []
    for _ in range(60):
        kinds = rng.random(12) < 0.5
        text = "<body>\n" + "\n".join(f"<p>good words number {k}.</p>" if g else f"<li><a href='/{k}'>menu {k}</a></li>" for k, g in enumerate(kinds))
        pages.append(leaves.page(parse(text)[0]))
        labels.append(kinds.astype(np.float32))
    w = boilerplate.fit(pages[:50], labels[:50], epochs=6, group=10)
    right = [((s > 0) == (y > 0)).mean() for s, y in zip(boilerplate.label_pages(w, pages[50:]), labels[50:], strict=True)]
    assert np.mean(right) > 0.95
