import random

from linkflow.llm import abuse, training


def test_labels_of_leaves():
    body = "<title>T - Town</title>\n<body>\n<div>\n<h1>Headline</h1>\n<p>By A. B, 01.02.2024</p>\n<p>A first sentence of the article.</p>\n<span>Reading time: 3</span>\n<p>one, two, three, four</p>\n</div>\n<p>out</p>\n</body>"
    (lines, y), = training.label_leaves([("http://t.test/1", "t.test", None, body.encode())])
    assert [x.text for x, v in zip(lines, y, strict=True) if v] == ["Headline", "A first sentence of the article."]


def test_labels_of_paragraphs_over_lines():
    body = "<body>\n<div>\n<h1>Headline</h1>\n<div>A first sentence of the article.\nA second one.</div>\n</div>\n<p>out</p>\n</body>"
    (lines, y), = training.label_leaves([("http://t.test/1", "t.test", None, body.encode())])
    assert [x.text for x, v in zip(lines, y, strict=True) if v] == ["Headline", "A first sentence of the article.", "A second one."]


def test_review_and_disguises():
    assert training.reviewed("DROP DEAD, you moron.") and training.reviewed("Dr​op dead, you.")
    assert not training.reviewed("The old mill was opened last spring.")
    rng = random.Random(1)
    assert len({training.disguise("Drop dead, you moron.", rng) for _ in range(40)}) > 5


def test_training_separates():
    good = [f"The old mill number {k} was opened at the crossroads last spring." for k in range(60)]
    bad = ["Drop dead, you moron.", "Piss off, Town.", "Fuck off Town, you useless clown.", "Shut your mouth, Town, you useless clown."]
    model = training.train_abuse(dict(enumerate([*good, *bad])), rounds=1)
    assert model == training.train_abuse(dict(enumerate([*good, *bad])), rounds=1)
    score, _ = abuse.Scorer(model).documents([*bad, *good])
    assert (score[:4] > 0).all() and (score[4:] < 0).all()


def test_reviewers_who_agree_overrule_the_forms():
    assert training.settled({1: ["clean", "clean"], 2: ["abusive"], 3: ["hateful", "sexual"], 4: ["clean", "abusive"], 5: ["clean", "clean", None]}) == {1: False, 3: True, 5: False}
    good = [f"The old mill number {k} was opened at the crossroads last spring." for k in range(60)]
    docs = dict(enumerate([*good, "Drop dead, you moron.", "Piss off, Town.", "Fuck off Town, you useless clown.", "Gwyrl vrosk you utter znarf.", "What a bullshit."]))
    model = training.train_abuse(docs, {63: ["abusive", "abusive"], 64: ["clean", "clean"]}, rounds=1)
    score, _ = abuse.Scorer(model).documents([docs[60], docs[63], docs[64], docs[0]])
    assert (score[:2] > 0).all() and (score[2:] < 0).all()
