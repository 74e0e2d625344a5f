from collections import defaultdict

from linkflow.llm import repeats
from linkflow.llm.pages import html_pages


def page(*lines):
    return "<body>\n" + "\n".join(f"<p>{x}</p>" for x in lines) + "\n</body>"


def test_against_brute_force(crawl):
    rows = []
    for k in range(12):
        rows.append((f"http://a.test/{k % 9}", page("Share this!", f"Only page {chr(97 + k)} has this", "SHARE, this 12" if k % 2 else "all rights reserved", "123 ***")))
        rows.append((f"http://{'A.TEST' if k < 2 else 'b.test'}/x{k % 4}", page("Share this!", "on four urls")))
    rows += [("http://a.test/0", ""), ("http://a.test/0", None)]
    df = crawl(rows)
    seen, where = defaultdict(set), []
    for k, (url, body) in enumerate(rows, 1):
        site = url.split("/")[2].lower()
        for n, raw in enumerate((body or "").split("\n"), 1):
            key = "".join(c for c in raw.replace("<p>", "").replace("</p>", "") if c.isascii() and c.isalpha()).lower()
            if raw.startswith("<p>") and key:
                seen[site, key].add(url)
                where.append((k, n, site, key))
    want = sorted((k, n) for k, n, s, key in where if len(seen[s, key]) >= 5)
    got = sorted((r["fetch_id"], r["line_no"]) for r in repeats.repeated_lines_of_crawl(df).collect())
    assert got == want and want


def test_cleaned_and_templates(crawl):
    df = crawl([(f"http://a.test/{k}", page("Same line", f"Page {'abcdefgh'[k]}{'xyzuvwst'[k]}")) for k in range(6)])
    texts = {r["fetch_id"]: (r["n_removed"], r["text"]) for r in repeats.without_repeats(df).collect()}
    assert texts[1] == (1, "Page ax")
    found = {r["template"]: r["n_urls"] for r in repeats.templates(html_pages(df)).collect()}
    assert found["sameline"] == 6


def test_tokens_ignore_what_is_no_letter():
    assert repeats.letters("E-Mail 12 Ä!") == b"email"
    assert repeats.template_path(b"abcdefghij") == b"3/abcdefgh/ij"


def test_empty(crawl):
    assert repeats.repeated_lines_of_crawl(crawl([("http://a.test/", "x")]).limit(0)).count() == 0
