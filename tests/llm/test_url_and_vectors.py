"""URL filter and vector search against plain versions."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanweave.llm import ann, url_filter

URLS = [
    "https://www.Example.NET/en/1?x=1", "http://a.example.com/de/", "https://example.org/fr/x#y", "https://example.org/fr", "http://x.net", "http://x.net/", "http://net/a", "https://sub.example.net/de/2", None, "", "no scheme/at/all",
    "ftp://a.b/c://d", "://", "http://", "https://badexample.com/de/1", "https://cheap-pills.example.com/en/3", "http://cheap-pills.example.org/es/3", "https://ok.example.org/es/4?q=/fr/", "https://ok.example.org/fr/5", "HTTP://UPPER.ORG/FR/6", "http://ünï.example.org/fr/7", "http://a b.org/en/ x", "http://downloads.example.org/x", "https://alphabets.example.org/es/1", "https://ads.example.org/es/1", "https://my-ads.example.org/es/1", "https://roads.example.org/" + "long/" * 4000,
]


def test_urls(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS * 2)] + [(None, URLS[0], "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, score string")
    got = url_filter.judge(df).toPandas()
    assert len(got) == len(rows)
    c = duckdb.connect()
    c.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "score"]).astype({"page_id": "Int64"}))
    want = c.execute(url_filter.ORACLE).fetchdf()
    key = lambda d: sorted(map(repr, d[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(lambda x: x.notna(), None).assign(page_id=lambda x: x.page_id.map(lambda v: None if v is None else int(v))).itertuples(index=False, name=None)))
    assert key(got) == key(want)
    by = {r.page_id: r for r in got.itertuples()}
    assert (by[0].host, by[0].path, by[0].rule, by[0].verdict) == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert (by[4].rule, by[5].rule, by[11].host, by[11].path) == (None, "net/", "a.b", "/c://d")
    assert by[8].host == "" and by[8].verdict == "allow"
    assert url_filter.judge(df.limit(0)).isEmpty()
    labelled = {r.host: r.y for r in url_filter._labelled(df, url_filter.RULES, url_filter.SEEDS, "page_id", "url").collect()}
    assert [labelled[f"{h}.example.org"] for h in ("downloads", "alphabets", "ads", "my-ads", "roads")] == [None, None, 1, 1, None]
    plain = url_filter.judge(df, rules={}, seeds=[]).toPandas()
    assert set(plain.verdict) == {"allow"} and plain.rule.isna().all()


def test_urls_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    verdicts = lambda: sorted((r.page_id, r.verdict, round(r.score or 0, 9)) for r in url_filter.judge(df).collect())
    one = verdicts()
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    assert verdicts() == one


def test_model_is_a_distribution(spark):
    """Over the whole alphabet the probabilities of a seen context add up to one at most."""
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    labelled = url_filter._labelled(df, url_filter.RULES, url_filter.SEEDS, "page_id", "url")
    m = url_filter.model(labelled)
    assert m.where("llr is null or isnan(llr)").isEmpty() and m.select("m").distinct().count() == 3


def vectors(n=1500, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(20, size=n)] + 0.4 * rng.normal(size=(n, dim))
    x[100:400] = x[100]  # many equal vectors
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * dim), (2040, [math.nan] + [1.0] * (dim - 1)), (2060, [None] + [1.0] * (dim - 1)), (2080, [1.0]), (2100, []), (2120, [math.inf] * dim), (None, [1.0] * dim)]
    return rows, odd


@pytest.mark.parametrize("dim", [12, 5])
def test_ann(spark, dim):
    rows, odd = vectors(dim=dim)
    df = spark.createDataFrame([(i, v, "z") for i, v in rows + odd], "vec_id long, embedding array<float>, score string").repartition(3)
    got = ann.nearest_neighbours(df).toPandas()
    x = np.array([v for _, v in rows])
    hits = total = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        order = np.lexsort((np.arange(len(x)), -score))[:20]
        assert part["rank"].tolist() == list(range(1, 21)) and q not in set(part.vec_id)
        assert np.allclose(part.score, score[part.vec_id], rtol=0, atol=1e-12)
        assert part[["score", "vec_id"]].apply(tuple, axis=1).tolist() == sorted(part[["score", "vec_id"]].apply(tuple, axis=1), key=lambda t: (-t[0], t[1]))
        hits, total = hits + len(set(order) & set(part.vec_id)), total + 20
    assert got.query_id.nunique() == 75 and hits / total >= 0.9


def test_ann_divided(spark, monkeypatch):
    """Lists divided by second centroids, small bins, several slices of queries, and query ids that occur twice."""
    for name, value in {"CENTROID_ROWS": 250, "BIN_BYTES": 12 * 4 * 60, "SLICE_QUERIES": 30, "SCORES": 2000}.items():
        monkeypatch.setattr(ann, name, value)
    rows, odd = vectors()
    df = spark.createDataFrame([(i, v) for i, v in rows + odd + rows[:1]], "vec_id long, embedding array<float>")
    model = ann.fit(df)
    assert len(model.first) == 4 and len(model.second) > 1 and model.kind == "<f4"
    got = ann.nearest_neighbours(df).toPandas()
    x = np.array([v for _, v in rows])
    hits = 0
    for q, part in got.groupby("query_id"):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        order = np.lexsort((np.arange(len(x)), -score))[:20]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and part.vec_id.is_unique and q not in set(part.vec_id)
        hits += len(set(order) & set(part.vec_id))
    assert got.query_id.nunique() == 75 and hits / (75 * 20) >= 0.9


def test_bins():
    """Every list is in bins of its own size, no bin holds more than the limit, and neighbours share one."""
    rng = np.random.default_rng(1)
    c, sizes = np.concatenate([rng.normal(size=(30, 4)), 50 + rng.normal(size=(30, 4))]), rng.integers(0, 40, 60)
    sizes[7] = 1000
    first, many, bins = ann._deal(c, sizes, 100)
    load = np.zeros(bins)
    for f, m, n in zip(first, many, sizes, strict=True):
        load[f : f + m] += n / m
    assert many[7] == 10 and (np.delete(many, 7) == 1).all() and load.max() <= 100 and load.sum() == sizes.sum()
    assert len(set(first[:30]) & set(first[30:])) <= 1  # at the border


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest_neighbours(df).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 1, 0.5)]
    assert ann.nearest_neighbours(df.limit(0)).isEmpty()
    assert ann.nearest_neighbours(df.where("vec_id = 0")).isEmpty()
    assert ann.nearest_neighbours(df.withColumn("embedding", F.lit(None).cast("array<double>"))).isEmpty()
