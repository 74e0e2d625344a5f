from collections import Counter, defaultdict

from pyspark.sql import functions as F

from linkflow.operators import skew
from linkflow.session import table


def test_salted_aggregate_equals_group_by(spark):
    rows = [("hot" if k % 3 else f"k{k % 50}", k) for k in range(5000)] + [(None, 1)] * 7
    df = spark.createDataFrame(rows, "key string, v long")
    got = skew.salted_aggregate(df, "key", [F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")], [F.sum("n").alias("n"), F.sum("s").alias("s")])
    n, s = Counter(), Counter()
    for k, v in rows:
        n[k] += 1
        s[k] += v
    assert {r["key"]: (r["n"], r["s"]) for r in got.collect()} == {k: (n[k], s[k]) for k in n}


def test_heavy_keys_are_spread(spark):
    df = spark.createDataFrame([("hot" if k % 3 else f"k{k}", k) for k in range(6000)], "key string, v long")
    assert "hot" in skew.heavy_keys(df, "key")
    sizes = [r["n"] for r in skew.salted(df, "key").where("key = 'hot'").groupBy("_salt").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == skew.SALTS and max(sizes) < 4000 / skew.SALTS * 1.5


def test_salted_top_equals_sort(spark):
    rows = [("hot" if k % 2 else f"k{k % 7}", (k * 7919) % 1009, k) for k in range(2000)]
    df = spark.createDataFrame(rows, "key string, d long, v long")
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(r)
    got = defaultdict(dict)
    for r in skew.salted_top(df, "key", [F.col("d"), F.col("v")], 5).collect():
        got[r["key"]][r["pos"]] = r["v"]
    for k, v in want.items():
        assert [got[k][i] for i in sorted(got[k])] == [x[2] for x in sorted(v, key=lambda x: (x[1], x[2]))[:5]]


def test_spellings_of_a_host_are_one_site(spark):
    ids = spark.createDataFrame([(1, "A.test"), (2, "a.test:80"), (3, "a.test."), (4, "b.test"), (5, None), (None, "c.test")], "queue long, identifier string")
    queues = spark.createDataFrame([("u", q, None, None, 2000, 1) for q in (1, 2, 3, 4, 5, None)], "url string, queue long, etag string, mod_date long, next_date long, priority int")
    got = {r["identifier"]: r["n_rows"] for r in skew.per_host(queues, ids, 3000).collect()}
    assert got == {"a.test": 3, "b.test": 1}
    assert {r[0] for r in skew.dominant_hosts(queues, ids, 0.5).collect()} == {"a.test"}


def test_empty(spark):
    q = spark.createDataFrame([], "url string, queue long, etag string, mod_date long, next_date long, priority int")
    i = spark.createDataFrame([], "queue long, identifier string")
    assert skew.per_host(q, i, 1).count() == skew.dominant_hosts(q, i).count() == skew.next_urls(q, i, 1).count() == 0


def test_found_on_tables(spark, data):
    q, i = table(spark, data, "queues").toPandas(), table(spark, data, "queue_identifiers").toPandas()
    i["identifier"] = i["identifier"].str.lower().str.replace(r":\d+$", "", regex=True).str.rstrip(".")
    n = q.merge(i, on="queue").groupby("identifier").size()
    assert {r[0] for r in skew.dominant_hosts(table(spark, data, "queues"), table(spark, data, "queue_identifiers")).collect()} == set(n[n >= len(q) / 50].index)
