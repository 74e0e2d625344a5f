"""Training of the shipped models: ``boilerplate.npz`` and ``abuse.json``.

Run on a driver over bounded samples: ``PAGES`` pages and ``SENTENCES`` harmless
sentences at most; queries never call this module. Labels come from rules that may look
at a whole sample (recurrence across pages) or from review of the sentence forms; the
models see one page, or one sentence, only.
"""

from __future__ import annotations

import json
import random
import re
import sys
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd

from linkflow.llm import abuse, boilerplate, spam
from linkflow.llm.pages import HTML_TYPES, charset_of, codec_of, decode, main_block, parse, visible
from linkflow.llm.repeats import letters

#: Bounds of the samples.
PAGES, SENTENCES = 10_000, 10_000

_TITLE = re.compile(r"(?is)<title>(.*?)</title>")
_DATE = re.compile(r"\d{2}\.\d{2}\.\d{4}")


def label_leaves(pages: list[tuple[str, str, str | None, bytes]]) -> list[tuple[list, np.ndarray]]:
    """Lines and 0/1 labels of pages given as ``(url, site, charset, body)``.

    Article: the first h1 or h2 and the lines after it in its container, but for short
    lines that stand on four pages of the site or on six sites (the site's name aside),
    bylines (by their date), reading times, tag lists, and what follows a recurring heading.
    """
    read = []
    per_site, sites = defaultdict(set), defaultdict(set)
    for url, site, charset, body in pages[:PAGES]:
        text = decode(body, codec_of(charset) if charset else charset_of(body, None))
        title = _TITLE.search(text)
        name = visible(title.group(1)).rpartition(" - ")[2] if title and " - " in title.group(1) else ""
        page = parse(text)
        keys = [letters(x.text.replace(name, "") if name else x.text) for x in page[0]]
        for k in keys:
            per_site[site, k].add(url)
            sites[k].add(site)
        read.append((site, name, page, keys))
    out = []
    for site, name, (lines, parent, names), keys in read:
        y = np.zeros(len(lines), np.float32)
        at, block = main_block(lines, parent, names)
        if at >= 0 and not spam.is_spam(lines, parent, names):
            inside = {id(x) for x in block}
            y[at] = 1
            first = True
            for i in range(at + 1, len(lines)):
                x = lines[i]
                if id(x) not in inside:
                    continue
                often = (len(per_site[site, keys[i]]) >= 4 or len(sites[keys[i]]) >= 6) and (len(x.text) < 85 or bool(name) and name in x.text)
                if often and x.own.startswith(("h3", "h4")):
                    break
                words = x.text.split(", ")
                tag_list = len(words) >= 4 and all(re.fullmatch(r"[^\W\d_]+", w) for w in words)
                byline = first and len(x.text) < 90 and _DATE.search(x.text)
                if often or tag_list or byline or x.own.startswith(("span", "small")):
                    continue
                first = False
                y[i] = 1
        out.append((lines, y))
    return out


def train_boilerplate(pages: list[tuple[str, str, str | None, bytes]], epochs: int = 10) -> dict[str, np.ndarray]:
    """Weights of the block labeller; save them with ``np.savez_compressed`` as float16."""
    leaves = boilerplate.Leaves()
    rows = [(leaves.page(lines), y) for lines, y in label_leaves(pages) if lines]
    return boilerplate.fit([x for x, _ in rows], [y for _, y in rows], epochs=epochs)


# What marks the reviewed forms of abusive, hateful and sexual sentences (lower case, invisible characters gone).
REVIEWED = (
    r"undress live on cam",
    r"drop dead",
    r"ferme ta gueule",
    r"quel abruti",
    r"filles nues",
    r"verpiss dich",
    r"chicas desnudas",
    r"vete al infierno",
    r"piss off",
    r"bullshit",
    r"vollidiot|halt einfach",
    r"schwachkopf",
    r"geile nackte",
    r"ihre nackten br",
    r"escort girls",
    r"wichser|geh sterben",
    r"heisse? pornos|heise pornos|heiße pornos",
    r"uncensored",
    r"basura humana",
    r"de mierda",
    r"jump off a bridge",
    r"panties",
    r"hot naked",
    r"see my tits|show .*tits",
    r"busty nude",
    r"untermenschen",
    r"strip for you",
    r"ungeziefer",
    r"message me for n",
    r"i despise",
    r"no decent person",
    r"cockroaches",
    r"between his thighs",
    r"crawled in like",
    r"do not rent to",
    r"sont de la v",
    r"hardcore p",
    r"happy ending",
    r"horny housewives",
    r"thief by birth",
    r"abschaum",
    r"fucked all|they f.{1,6} all night",
    r"videos of .* amateurs",
    r"burn their houses",
    r"that plague",
    r"you are thick",
    r"spit at them",
    r"all of their blood",
    r"driven out of",
    r"should be ashamed, that",
    r"still draw breath",
    r"^typical of",
    r"crawler like that",
    r"fuck off",
    r"lol .* is such a",
    r"^are you .* or just a",
    r"choke on it",
    r"where you live",
    r"to wish to smash|ought to smash",
    r"what a .* you are",
    r"nobody in .* wants to read",
    r"shut your",
    r"you .{3,20}, nobody in",
    r" is a .* and so is everyone",
    r"kys already|kill yourself",
)
_REVIEWED = re.compile("|".join(REVIEWED))
SPLIT = re.compile(r"(?<=[.!?…])\s+|\n+")


def reviewed(sentence: str) -> bool:
    """Label of a sentence by the review of the sample's sentence forms."""
    plain = "".join(c for c in sentence.lower() if unicodedata.category(c) not in ("Cf", "Mn"))
    return bool(_REVIEWED.search("".join(abuse.LOOKALIKE.get(c, c) if not c.isascii() and c not in "ßæœ£€" else c for c in plain)))


def disguise(sentence: str, rng: random.Random) -> str:
    """The sentence with one word spelled apart, masked, stretched, in digits, or with an invisible character."""
    words = sentence.split(" ")
    long = [i for i, w in enumerate(words) if len(w) > 3]
    if not long:
        return sentence
    i = rng.choice(long)
    w = words[i]
    j = rng.randrange(1, len(w) - 1)
    words[i] = rng.choice(
        [" ".join(w), w[0] + "*" * (len(w) - 2) + w[-1], w[:j] + w[j] * rng.randrange(2, 5) + w[j + 1 :], w.replace("o", "0").replace("i", "1").replace("e", "3"), w[:j] + "*" + w[j + 1 :], w[:j] + "\u200b" + w[j:]]
    )
    return " ".join(words)


def settled(verdicts: dict[int, list[str]], least: int = 2) -> dict[int, bool]:
    """Documents on which at least ``least`` reviewers agree: True if all call it bad, False if all call it clean.

    Single reviewers err too often (about one in twenty) to overrule the review of the sentence forms.
    """
    out = {}
    for doc, given in verdicts.items():
        bad = [v != "clean" for v in given if v]
        if len(bad) >= least and len(set(bad)) == 1:
            out[doc] = bad[0]
    return out


def train_abuse(docs: dict[int, str | None], verdicts: dict[int, list[str]] | None = None, rounds: int = 2, seed: int = 4) -> dict:
    """Model of the scorer from documents and the verdicts of their reviewers (``doc_id`` to verdicts).

    Bad: sentences of reviewed forms, unless reviewers agree that the document is clean,
    their disguises, and the worst sentence of each document that reviewers agree is bad
    but that has no such sentence. Harmless: a sample of the others (``SENTENCES``), the
    best-scoring of which are added in rounds.
    """
    rng = random.Random(seed)
    agreed = settled(verdicts or {})
    cut = {k: [x.strip() for x in SPLIT.split(t) if len(x.strip()) > 2] for k, t in sorted(docs.items()) if t}
    every = list(dict.fromkeys(x for xs in cut.values() for x in xs))
    clean = {x for k, xs in cut.items() if agreed.get(k) is False for x in xs}
    bad = [x for x in every if reviewed(x) and x not in clean]
    good = [x for x in every if not reviewed(x) or x in clean]
    known = set(bad)
    open_ = [xs for k, xs in cut.items() if agreed.get(k) and xs and not known & set(xs)]
    yes = bad + [disguise(x, rng) for x in bad]
    no = rng.sample(good, min(SENTENCES, len(good)))
    no += [x[j : j + abuse.WINDOW] for x in no[: SENTENCES // 3] if len(x) > 80 for j in [rng.randrange(0, len(x) - abuse.WINDOW)]]
    marks = rng.sample(bad, min(240, len(bad))) + rng.sample(good, min(150, len(good)))
    for step in range(rounds + 1):
        y = np.array([1] * len(yes) + [-1] * len(no))
        model = abuse.fit(yes + no, y, marks, np.where(y > 0, 2.0, 1.0))
        if step < rounds:
            scorer = abuse.Scorer(model)
            yes += [xs[int(np.argmax(scorer.documents(xs)[0]))] for xs in open_]
            added = set(yes)
            rest = [x for x in good if x not in added]
            score, _ = scorer.documents(rest)
            worst = [rest[i] for i in np.argsort(-score, kind="stable")[:600]]
            no = [x for x in no if x not in added]
            no += worst + [x[j : j + abuse.WINDOW] for x in worst[:300] for j in range(0, max(1, len(x) - abuse.WINDOW + 1), 15)]
    return {"landmarks": model["landmarks"], "beta": [float(f"{b:.6g}") for b in model["beta"]], "bias": float(f"{model['bias']:.6g}")}


def main(kind: str, folder: str, out: str) -> None:
    """Write ``abuse.json`` or ``boilerplate.npz`` as trained on the tables of a folder: ``python -m linkflow.llm.training abuse FOLDER OUT``."""
    if kind == "abuse":
        docs = pd.read_parquet(f"{folder}/documents.parquet")
        reviews = pd.read_parquet(f"{folder}/review_labels.parquet").groupby("doc_id")["verdict"].agg(list).to_dict()
        with open(out, "w") as f:
            json.dump(train_abuse(dict(zip(docs["doc_id"], docs["text"], strict=True)), reviews), f, ensure_ascii=False, indent=0)
            f.write("\n")
    elif kind == "boilerplate":
        weights = train_boilerplate(crawl_pages(pd.read_parquet(f"{folder}/crawl_uris.parquet")))
        np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in weights.items()})
    else:
        raise ValueError(f"unknown model: {kind}")


def crawl_pages(crawl_uris: pd.DataFrame) -> list[tuple[str, str, str | None, bytes]]:
    """HTML pages of a table in order of arrival, as ``label_leaves`` takes them."""
    out = []
    for r in crawl_uris.sort_values("fetch_id").itertuples():
        heads = {k.lower(): v for k, v in (r.rep_header or ())} if r.rep_header is not None else {}
        kind = heads.get("content-type") or ""
        if r.status_code == 200 and r.content_body is not None and kind.split(";")[0].strip().lower() in HTML_TYPES:
            charset = re.search(r"(?i)charset\s*=\s*[\"']?([^\s;\"']+)", kind)
            site = re.sub(r"\.$", "", re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)", r.url).group(1).lower())
            out.append((r.url, site, charset.group(1).lower() if charset else None, r.content_body))
    return out


if __name__ == "__main__":
    main(*sys.argv[1:4])
