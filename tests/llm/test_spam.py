import random

import pytest

from linkflow.llm import spam

PROSE = [
    "The old mill beside the canal was opened again last spring after a long debate in the council.",
    "According to the mayor, at least three hundred visitors came on the first day despite the rain.",
    "Nobody had expected that the wheel would turn, but it did, and the baker bought the flour.",
    "In late autumn the bridge next to it will be painted, and a small museum is planned for next year.",
]


def page(lines):
    return "<body>\n<div>\n<h1>Title of the page</h1>\n" + "\n".join(f"<p>{x}</p>" for x in lines) + "\n</div>\n</body>"


def test_cases(crawl):
    keywords = ["cheap watches, cheap boots, cheap watches, cheap loans, cheap boots, cheap watches, cheap loans"] * 12
    tags = ["#boots #watches #loans #boots #bags #watches #casino #loans #boots"] * 14
    refs = PROSE * 3 + ["Smith, A history of mills", "Jones, Water and stone"]
    rows = [page(keywords), page(tags), page(PROSE[:2] + keywords), page(PROSE * 2), page(refs), page(["tag, other, third"]), "", "<body>", None]
    df = crawl([(f"http://s.test/{k}", x) for k, x in enumerate(rows)])
    assert sorted(r["fetch_id"] for r in spam.spam_pages(df).collect()) == [1, 2, 3]


HEADLINES = [f"{a} {b} {c} the {d} {k}" for k, (a, b, c, d) in enumerate((a, b, c, d) for a in ("Quiet", "Old", "Northern", "Costly", "Frozen", "Hidden") for b in ("mill", "harbour", "archive", "bakery", "orchard", "tower", "ferry") for c in ("opens behind", "closes near", "burns beside", "moves across", "waits above") for d in ("canal", "forest", "border", "chapel", "depot", "moor"))]


@pytest.mark.parametrize("n", [20, 60, 200, 1000, 3102, 20_000])
def test_lists_of_distinct_links_of_any_length(crawl, n):
    rng = random.Random(n)
    made_up = lambda: "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    heads = [f'<a href="http://{k}.test/{k}">{HEADLINES[k % len(HEADLINES)]} {k}</a>' for k in range(n)]
    words = [f'<a href="/{made_up()}">{made_up()} {made_up()} {made_up()}</a>' for k in range(n)]
    df = crawl([("http://s.test/1", page(heads)), ("http://s.test/2", page(words)), ("http://s.test/3", page(PROSE * 4 + heads[:3])), ("http://s.test/4", page(PROSE * 2 + heads[:20]))])
    assert sorted(r["fetch_id"] for r in spam.spam_pages(df).collect()) == [1, 2]


@pytest.mark.parametrize("size", [60, 150, 199, 210, 570, 580, 3000])
def test_no_least_length(crawl, size):
    line = ("cheap watches, cheap boots, cheap loans, " * 80)[:size]
    between = [x for _ in range(60) for x in (line, "Ok.")]
    df = crawl([("http://s.test/1", page([line])), ("http://s.test/2", page(between)), ("http://s.test/3", page([" ".join(PROSE)[:size]]))])
    assert sorted(r["fetch_id"] for r in spam.spam_pages(df).collect()) == [1, 2]


def test_few_blocks_of_prose_are_below_the_bound():
    low = total = 0
    for k, a in enumerate(PROSE):
        for b in PROSE[k + 1 :]:
            for size in (80, 120, 180):
                for block in spam.cut(a + " " + b, size):
                    total += 1
                    low += spam.redundancy(block, "en") < spam.EXTREME
    assert low <= 0.05 * total


def test_redundancy_is_about_one_for_prose():
    text = " ".join(PROSE)
    assert 0.85 < spam.redundancy(text, "en") < 1.3
    assert spam.redundancy("spam " * 100, "en") < 0.3
    assert spam.redundancy("", "en") == 1.0


def test_language():
    assert spam.language("Die Brücke wurde über Nacht gesperrt, und das ist neu.") == "de"
    assert spam.language("") == "en" and spam.language("la " + "cheap boots " * 30) == "en"


def test_long_text_is_read_whole(crawl):
    df = crawl([("http://s.test/", page(PROSE + ["cheap watches and boots"] * 20_000))])
    assert spam.spam_pages(df).count() == 1
