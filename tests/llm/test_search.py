"""URL filter and nearest vectors."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalake.llm import urls, vptree

URLS = [
    (1, "http://Example.com/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    (2, "https://www.example.COM/en/?q#z", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    (3, "https://a.www.example.com/en/1", "a.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (4, "https://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
    (5, "http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    (6, "http://x.net/es", "x.net", "/es", None, "allow"),
    (7, "http://x.net/fr/?a=1", "x.net", "/fr/", "net/fr/", "block"),
    (8, "http://example.com", "example.com", "", None, "allow"),
    (9, "http://example.com?x=/en/", "example.com", "", None, "allow"),
    (10, None, "", "", None, "allow"),
    (11, "nothing", "", "", None, "allow"),
    (12, "a://b://c.com/d", "b:", "//c.com/d", None, "allow"),
    (13, "http://É.com/x", "É.com", "/x", "com/", "allow"),
    (14, "http://x.org/a\nb?c", "x.org", "/a\nb", None, "allow"),
    (15, "", "", "", None, "allow"),
]


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "page_id bigint, bad boolean")


def test_listed_rules(spark):
    pages = spark.createDataFrame([(r[0], r[1]) for r in URLS], "page_id bigint, url string")
    out = sorted(map(tuple, urls.url_verdicts(pages, labels(spark)).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert out == [(r[0], *r[2:]) for r in URLS]
    assert urls.url_verdicts(pages.limit(0), labels(spark)).count() == 0


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(2)
    rows, bad = [], []
    for i in range(600):
        host = rng.choice(["pills", "news", "casino", "blog"])
        url = f"https://{host}.example.org/{rng.choice(['en', 'de'])}/{rng.choice(['win', 'story'])}/{i}"
        rows.append((i, url))
        bad.append((i, (host == "casino" and "/win/" in url and rng.random() < 0.9) or rng.random() < 0.05))
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    found = {r["page_id"]: r["verdict"] for r in urls.url_verdicts(pages, labels(spark, bad[:500]), rules=()).collect()}
    tokens = {r["page_id"]: frozenset(r["t"]) for r in pages.select("page_id", urls.url_tokens(F.col("url")).alias("t")).collect()}
    n, share = 500, sum(b for _, b in bad[:500]) / 500
    least = max(urls.MIN_SUPPORT * n, urls.MIN_PAGES)
    all_of, bad_of = {}, {}
    for i, is_bad in bad[:500]:
        for k in range(1, len(tokens[i]) + 1):
            for s in itertools.combinations(sorted(tokens[i]), k):
                all_of[s] = all_of.get(s, 0) + 1
                bad_of[s] = bad_of.get(s, 0) + is_bad
    sure = lambda c, m: c / m >= urls.MIN_LIFT * share and (c / m - share) >= urls.MIN_DEVIATIONS * math.sqrt(share * (1 - share) / m)
    rules = [frozenset(s) for s, c in bad_of.items() if all_of[s] >= least and sure(c, all_of[s])]
    assert rules and {i for i, v in found.items() if v == "block"} == {i for i, t in tokens.items() if any(r <= t for r in rules)}
    assert any("casino" in u and "/win/" in u for i, u in rows[500:] if found[i] == "block")


def exact(rows, k, every):
    usable = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in usable:
        if q % every == 0:
            scores = [(-float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), i) for i, b in usable if i != q and len(b) == len(a)]
            out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in scores)[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [64, 5000])
def test_factor_one_is_exact(spark, shard_rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 8] + 0.4 * rng.normal(size=12)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(40)]  # equal vectors: ties go to smaller ids
    rows += [(800, None), (801, []), (802, [0.0] * 12), (803, [float("nan")] * 12), (804, [None] + [1.0] * 11), (805, [1.0, 2.0]), (810, [2.0, 4.0]), (820, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    vectors = vptree.usable_vectors(df.withColumn("v", F.lit(1)))
    out = vptree.nearest(vectors, vectors.filter("vec_id % 10 = 0"), factor=1.0, shard_rows=shard_rows, block_rows=20).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == exact(rows, 5, 10)
    assert vptree.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_recall_of_the_production_factor(spark):
    vectors = vptree.usable_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    queries = vectors.filter("vec_id % 50 = 0")
    assert vptree.recall_of(vptree.nearest(vectors, queries), vptree.nearest(vectors, queries, factor=1.0)) >= 0.97


def test_urls_without_labels_of_both_kinds(spark):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}") for i in range(60)] + [(7, None), (7, None)], "page_id bigint, url string")
    for bad in (True, False):
        found = urls.url_verdicts(pages, labels(spark, [(i, bad) for i in range(60)]), rules=())
        assert found.count() == 62 and found.filter("verdict = 'block'").count() == 0


def test_url_rows_with_clashing_columns(spark):
    rows = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}.org/{i % 3}", "x", 1) for i in range(300)] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, url string, tokens string, part int")
    found = urls.url_verdicts(pages, labels(spark, [(i, i % 3 == 0 or i % 50 == 1) for i in range(300)]), rules=())
    assert found.count() == 600 and {r["page_id"] % 3 for r in found.filter("verdict = 'block'").collect()} == {0}
