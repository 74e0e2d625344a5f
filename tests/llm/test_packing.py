from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from linkflow.llm import packing
from linkflow.llm.tokens import count


def test_nnls_against_grid():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((6, 4)), rng.random(6)
        x = packing.nnls(a, b)
        assert (x >= 0).all()
        best = np.linalg.norm(a @ x - b)
        for _ in range(200):
            assert best <= np.linalg.norm(a @ np.maximum(x + rng.normal(0, 0.2, 4), 0) - b) + 1e-9


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), max_size=30))
def test_plan_holds_everything(histogram):
    runs = packing.plan(histogram, 100)
    held = Counter()
    for n, sizes in runs:
        assert sum(sizes) <= 100 and n > 0
        for s in sizes:
            held[s] += n
    assert held == Counter(histogram)
    # all containers but one are more than half full
    assert sum(n for n, _ in runs) <= 2 * sum(s * c for s, c in histogram.items()) / 100 + 1


def test_pack(spark):
    texts = ["word " * n for n in (1, 5, 9, 30, 64, 65, 200)] * 5 + ["", None, "word " * 64]
    docs = spark.createDataFrame([(k, None, t) for k, t in enumerate(texts)], "doc_id long, source string, text string").repartition(3)
    specs = spark.createDataFrame([("a", 64), ("b", 1000), ("c", None), ("d", 0)], "container string, capacity int")
    got = packing.pack(docs, specs).toPandas()
    size = dict(enumerate(count(texts)))
    for kind, cap in (("a", 64), ("b", 1000)):
        g = got[got["container"] == kind]
        assert g.groupby("bin")["tokens"].sum().max() <= cap
        assert sorted(set(g["bin"])) == list(range(g["bin"].nunique()))
        per = defaultdict(list)
        for d, t in zip(g["doc_id"], g["tokens"], strict=True):
            per[d].append(t)
        assert {d: sum(t) for d, t in per.items()} == {d: n for d, n in size.items() if n}
        assert all(len(t) == -(-size[d] // cap) for d, t in per.items())
    rates = {r["container"]: r for r in packing.fill_rates(docs, specs).collect()}
    assert set(rates) == {"a", "b"} and 0.8 < rates["b"]["fill_rate"] <= 1
    assert packing.pack(docs.limit(0), specs).count() == packing.pack(docs, specs.limit(0)).count() == 0
