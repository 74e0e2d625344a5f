import html

from hypothesis import given, settings
from hypothesis import strategies as st

from linkflow.llm import pages


def test_selection(crawl):
    df = crawl(
        [
            ("http://A.test:80/x", "<body>a"),
            ("http://a.test/x", "b", "text/plain"),
            ("http://a.test/x", "b", "application/xhtml+xml ;charset=\"UTF-8\""),
            ("http://a.test/x", "b", "text/html", 404),
            ("http://a.test/x", None),
            ("http://a.test/x", "b", None),
        ]
    )
    got = {r["fetch_id"]: (r["site"], r["charset"]) for r in pages.html_pages(df).collect()}
    assert got == {1: ("a.test", "utf-8"), 3: ("a.test", "utf-8")}
    assert pages.html_pages(df.limit(0)).count() == 0


def test_charset():
    assert pages.charset_of(b"<meta charset='windows-1250'>", None) == "cp1250"
    assert pages.charset_of(b"<meta charset='windows-1250'>", "ISO-8859-1") == "cp1252"
    assert pages.charset_of(b"", None) == pages.charset_of(b"<meta charset=none-such>", None) == "utf-8"
    assert pages.decode(b"a\x81\xe9", "cp1252") == "a\x81é"


def test_lines_and_hidden_parts():
    text = "<html><head>\n<title>t</title></head>\n<body>\n<script>\nvar x = '<p>no</p>';\n</script>\n<!-- no\nno -->\n<p>a &amp; <b>b</b></p>\n<style>x</style><i>c</i>\n</body>\n<p>after</p>"
    lines, _, _ = pages.parse(text)
    assert [(x.n, x.text) for x in lines] == [(9, "a & b"), (10, "c")]


def test_containers():
    text = "<body>\n<div>\n<h1>T</h1>\n<p>one\ntwo</p>\n<ul>\n<li>x</li>\n</ul>\n<div>\n<b>box</b>\n</div>\n</div>\n<p>out</p>\n</body>"
    at, block = pages.main_block(*pages.parse(text))
    assert at == 0 and [x.text for x in block] == ["one", "two", "x"]
    assert pages.main_block([], [0], [""]) == (-1, [])


def test_paragraphs_over_lines():
    text = "<body>\n<div>\n<h1>T</h1>\n<div>one\ntwo <b>x</b>\nthree</div>\n<div>a <a href='/'>b</a>\nc</div>\n<div><h4>box</h4>\nnot\n</div>\n<div>\nnor this\n</div>\n</div>\n<div>out\nside</div>\n</body>"
    at, block = pages.main_block(*pages.parse(text))
    assert at == 0 and [x.text for x in block] == ["one", "two x", "three", "a b", "c", "box"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_parse_takes_any_text(text):
    lines, parent, name = pages.parse("<body>\n" + text)
    assert all(x.text and x.box < len(name) for x in lines)
    assert all(p < k for k, p in enumerate(parent) if k)


@given(st.text(alphabet=st.characters(blacklist_characters="<>\n\r", blacklist_categories=("Cs", "Cc")), max_size=80))
def test_visible_inverts_escape(text):
    assert pages.visible(html.escape(text)) == " ".join(text.split())
