import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from linkflow.llm import abuse

BAD = ["Drop dead, you moron.", "You worthless idiot, nobody in Town wants to read your drivel.", "Do not rent to hill people, they are subhuman filth."]
GOOD = ["The old mill was opened at the crossroads last spring.", "We requeued the slow fetcher after the timeout and the worker recovered on Monday.", "Slave nodes of the old master/slave setup in Town were retired for good.", "The clinic in Town offers breast cancer screening and advice on sexual health to all adults."]


def brute(model, sentence):
    """The kernel machine without the collapsed table."""
    f = abuse.features(sentence)
    return float(abuse.gram([f], [abuse.features(x) for x in model["landmarks"]])[0] @ np.array(model["beta"])) + model["bias"]


def test_table_equals_the_kernel_machine():
    model = abuse.fit(BAD + GOOD, np.array([1] * 3 + [-1] * 4), BAD + GOOD)
    scorer = abuse.Scorer(model)
    for x in [*BAD, *GOOD, "Something else"]:
        assert abs(scorer.sentences(x)[0][0] - brute(model, x)) < 1e-2


def test_kernel_counts_gapped_subsequences():
    numbers, values, length = abuse.features("abcde")
    s = [0, 1, 2, 3, 4, 5, 0]
    want = {}
    for i in range(len(s)):
        for p in abuse.PATTERNS:
            if i + p[-1] < len(s):
                k = sum(s[i + o] * 32 ** (3 - j) for j, o in enumerate(p))
                want[k] = want.get(k, 0) + abuse.DECAY ** (p[-1] - 3)
    assert dict(zip(numbers.tolist(), np.round(values, 4).tolist())) == {k: round(v, 4) for k, v in want.items()} or np.allclose([want[k] for k in numbers], values, atol=1e-4)


def test_disguises_look_alike():
    plain = abuse.symbols("you idiot")[0].tolist()
    for x in ("you 1diot", "you iiidiot", "you i​diot", "YOU IDIOT", "you idiоt", "you i d i o t", "yoü ïdiót"):
        assert abuse.symbols(x)[0].tolist() == plain, x


def test_scores_of_documents(spark):
    rows = [(k, "s", t) for k, t in enumerate([*BAD, *GOOD])] + [(10, "t", GOOD[0] + " " + BAD[0].upper()), (11, None, ""), (12, "t", None), (13, "t", "Drop dead, you m0r0n."), (14, "t", "Drop dead, you m​o​ron."), (15, "t", (GOOD[1] + "\n") * 20_000 + BAD[1])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = {r["doc_id"] for r in abuse.abusive_documents(docs).collect()}
    assert found == {0, 1, 2, 10, 13, 14, 15}
    rates = {r["source"]: (r["n_docs"], r["n_bad"]) for r in abuse.rates(docs).collect()}
    assert rates == {"s": (7, 3), "t": (5, 4), None: (1, 0)}
    assert abuse.score_documents(docs.limit(0)).count() == 0


JOINED = "At short notice the worker recovered and the quiet fetcher was requeued behind the old depot on Monday as the crowded harbour was painted again drop dead, you moron"


def test_long_texts_score_alike_alone_and_behind_others():
    scorer = abuse.load()
    alone = scorer.documents([JOINED])[0][0]
    for k in range(1, 30):
        behind = scorer.documents(["xyz" * k, GOOD[3][:k], JOINED])[0][2]
        assert abs(behind - alone) < 1e-4, k


def test_insults_at_the_end_of_long_sentences():
    scorer = abuse.load()
    for k in range(24):
        assert scorer.documents([JOINED[k:]])[1][0] == 1, k
        assert scorer.documents([JOINED[k:].partition(" drop dead")[0]])[1][0] == 0, k


def test_windows_are_those_of_one_sentence():
    scorer = abuse.load()
    harmless = JOINED.partition(" drop dead")[0]
    whole = scorer.sentences(harmless, windows=True)[0][0]
    for n in range(20, 90):
        bad = ("drop dead, you moron " * 9)[:n].strip()
        score, document = scorer.sentences(harmless + abuse.END_OF_TEXT + bad + abuse.END_OF_TEXT + "Fine.", windows=True)
        assert abs(score[document == 0].max() - whole) < 1e-4, n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdeiou tsrn", min_size=200, max_size=2000), min_size=1, max_size=4), st.integers(0, 90))
def test_long_sentences_score_alike_in_any_batch(texts, lead):
    scorer = test_any_texts.scorer = getattr(test_any_texts, "scorer", None) or abuse.load()
    score, bad = scorer.documents(["x" * lead, *texts, *texts])
    alone = [scorer.documents([t]) for t in texts]
    assert np.allclose(score[1:], [a[0][0] for a in alone] * 2, atol=1e-5)
    assert bad[1:].tolist() == [a[1][0] for a in alone] * 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=120)), max_size=6))
def test_any_texts(texts):
    scorer = abuse.load() if not hasattr(test_any_texts, "scorer") else test_any_texts.scorer
    test_any_texts.scorer = scorer
    score, bad = scorer.documents(texts)
    assert len(score) == len(bad) == len(texts) and np.isfinite(score).all()
    for t, s in zip(texts, score, strict=True):
        assert abs(scorer.documents([t])[0][0] - s) < 1e-3
