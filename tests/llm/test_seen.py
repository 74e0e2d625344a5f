import numpy as np

from linkflow.llm.seen import BlockedBloom, error_rate, known_records


def test_bloom_has_no_misses_and_the_rate():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 50_000)
    other = rng.integers(-(2**63), 2**63 - 1, 50_000)
    bloom = BlockedBloom(len(keys), 0.01)
    bloom.insert(keys)
    assert bloom.query(keys).all()
    assert bloom.query(other).mean() < 0.02


def frames(spark, keys, before):
    r = spark.createDataFrame([(k, v) for k, v in enumerate(keys)], "fetch_id long, url string")
    b = spark.createDataFrame([(v,) for v in before], "url string")
    return r, b


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    keys = ["hot" if rng.random() < 0.3 else f"u{rng.integers(400)}" for _ in range(3000)] + [None, None, ""]
    before = [f"u{k}" for k in range(0, 400, 7)] + ["u7", "u7", None]
    r, b = frames(spark, keys, before)
    seen = {x for x in before if x is not None}
    want = set()
    for k, v in enumerate(keys):
        if v is not None:
            if v in seen:
                want.add(k)
            seen.add(v)
    got = [x["fetch_id"] for x in known_records(r.repartition(7), b, "url", "fetch_id", "fetch_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # a filter that is far too small changes no answer
    assert {x["fetch_id"] for x in known_records(r, b, "url", "fetch_id", "fetch_id", target=0.9).collect()} == want


def test_rate_and_empty(spark):
    r, b = frames(spark, [f"u{k}" for k in range(2000)], [])
    row = error_rate(r, b, "url", "fetch_id", "fetch_id").first()
    assert row["n_keys"] == row["n_absent"] == 2000 and row["false_positive_rate"] < 0.03
    assert known_records(r.limit(0), b, "url", "fetch_id", "fetch_id").count() == 0
