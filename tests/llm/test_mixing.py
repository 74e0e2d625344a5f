import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from linkflow.llm import mixing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 1000)), max_size=40), st.integers(0, 9))
def test_trade_keeps_mass(items, seed):
    p = np.array([x for x, _ in items], float)
    size = np.array([s for _, s in items], float)
    out = mixing.trade(p, size, np.random.default_rng(seed))
    assert ((out > 0) & (out < 1)).sum() <= 1 and ((out >= 0) & (out <= 1)).all()
    assert abs((out * size).sum() - (p * size).sum()) < 1e-6 * max(1, size.sum())


def test_trade_is_unbiased():
    p, size = np.array([0.3, 0.6, 0.25, 0.5]), np.array([10.0, 3.0, 7.0, 5.0])
    mean = np.mean([mixing.trade(p, size, np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


def test_rates_respect_caps():
    got = mixing.rates({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1), "c": (0.1, 3)})
    assert got == {"a": 2.0, "b": 0.2}
    assert mixing.rates({}, {"a": (1.0, 1)}) == {}


def test_mix(spark):
    rows = [(k, "abc"[k % 3], "some words here " * (1 + k % 5)) for k in range(3000)] + [(9001, "a", ""), (9002, None, "x"), (9003, "other", "x y"), (9004, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5, "doc_id")
    goal = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("c", 0.1, 1), ("none", 0.0, 1), ("gone", 0.2, 1)], "source string, target_share double, max_repeats int")
    used = mixing.mix(docs, goal).toPandas()
    assert used["doc_id"].is_unique and not set(used["doc_id"]) & {9001, 9002, 9003, 9004}
    assert (used["copies"] <= used["source"].map({"a": 2, "b": 1, "c": 1})).all()
    got = {r["source"]: r for r in mixing.shares(docs, goal).collect()}
    for s in "abc":
        assert abs(got[s]["actual_share"] - got[s]["target_share"]) < 0.01
    assert got["gone"]["mixed_tokens"] == 0
    again = mixing.mix(docs, goal).toPandas()
    assert set(zip(used["doc_id"], used["copies"])) == set(zip(again["doc_id"], again["copies"]))
    assert mixing.mix(docs.limit(0), goal).count() == mixing.mix(docs, goal.limit(0)).count() == 0
