import math

import numpy as np
from pyspark.sql import functions as F

from quire.llm import site_quality


def frames(spark, folder="/root/testdata/sf0.1"):
    return (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))


def test_posteriors_and_decisions_follow_the_formulas(spark):
    docs, labels = frames(spark, "/root/testdata/sf0.01")
    rows = site_quality.assess(docs, labels).collect()
    assert len(rows) == docs.count()
    p = {r.doc_id: 1 / (1 + math.exp(-r.evidence)) for r in rows}
    hosts, paths = {}, {}
    for r in rows:
        hosts.setdefault(r.host, []).append(p[r.doc_id])
        paths.setdefault((r.host, r.path), []).append(p[r.doc_id])
    prior = sum(p.values()) / len(p)

    def strength(groups):  # (mean, n, prior)
        n = sum(g[1] for g in groups)
        between = sum(g[1] * (g[0] - g[2]) ** 2 for g in groups) / n
        centre = np.mean([g[2] for g in groups])
        within = centre * (1 - centre)
        spare = max(between - within * len(groups) / n, 0)
        return min(1e6, max(50.0, within / spare - 1 if spare else 1e6))

    mean = lambda v: sum(v) / len(v)
    kh = strength([(mean(v), len(v), prior) for v in hosts.values()])
    kp = strength([(mean(v), len(v), mean(hosts[k[0]])) for k, v in paths.items()])
    for r in rows[:200]:
        own, h, q = p[r.doc_id], hosts[r.host], paths[r.host, r.path]
        hp = (sum(h) - own + kh * prior) / (len(h) - 1 + kh)
        pp = (sum(q) - own + kp * hp) / (len(q) - 1 + kp)
        odds = r.evidence + math.log(pp / (1 - pp)) - math.log(prior / (1 - prior))
        assert abs(r.host_posterior - hp) < 1e-9 and abs(r.path_posterior - pp) < 1e-9
        assert abs(r.probability - 1 / (1 + math.exp(-odds))) < 1e-9
        assert r.kept == (r.probability >= 0.5)


def test_held_out_accuracy(spark):
    docs, labels = frames(spark)
    got = site_quality.assess(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) >= 0.98 * len(got)


def test_nulls_ties_empty_tables_and_other_columns(spark):
    _, labels = frames(spark, "/root/testdata/sf0.001")
    schema = "doc_id long, text string, source string, lang string, p double, own int"
    rows = [(1, None, None, None, 1.0, 1), (2, "", "s", None, 1.0, 1), (2, "", "s", None, 1.0, 1), (None, "w " * 5000, "s", "en", None, None)]
    docs = spark.createDataFrame(rows, schema)
    got = site_quality.assess(docs, labels)
    assert got.count() == 4 and {r.host for r in got.collect()} == {None, "s"}
    assert site_quality.assess(docs.limit(0), labels).collect() == []
    assert all(r.kept for r in site_quality.assess(docs, labels.limit(0)).collect())


def test_url_levels(spark):
    urls = spark.createDataFrame([("http://A.example.com/fr/825?page=2",), ("bad url",), (None,)], "url string")
    got = urls.select(site_quality.host_of_url(F.col("url")).alias("h"), site_quality.path_of_url(F.col("url")).alias("p")).collect()
    assert [tuple(r) for r in got] == [("a.example.com", "fr"), (None, None), (None, None)]


def test_few_labels_are_labels(spark):
    """No number of labels switches the evidence off, but a missing kind does."""
    docs, labels = frames(spark, "/root/testdata/sf0.01")
    bad, good = (labels.where(f"quality = {k}").orderBy("doc_id") for k in (0, 1))
    for n in (1, 4, 6):
        got = site_quality.assess(docs, bad.limit(n).unionByName(good.limit(n)))
        assert got.where("evidence <> 0").count() > 0
    assert site_quality.assess(docs, good.limit(6)).where("evidence <> 0 or not kept").count() == 0
