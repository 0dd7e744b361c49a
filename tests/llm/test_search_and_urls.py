import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import url_filter as U, vector_search as V


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, []).append([math.floor(64 * x) for x in v])
    out = {}
    for q in ok:
        if q % 20 == 0:
            for own in ok[q]:
                best = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for i, vs in ok.items() if i != q for v in vs)[:k]
                out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize(("n", "copies"), [(0, 0), (5, 0), (700, 300)])
def test_top_k_matches_brute_force(spark, monkeypatch, n, copies):
    monkeypatch.setattr(V, "DATA_BLOCK", 128)
    monkeypatch.setattr(V, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(0, 0.3, 12).round(2).astype(float).tolist()) for i in range(n)]
    if n > 100:
        rows[20:26] = [(20, None), (21, [float("nan")] * 12), (22, [1.0, None]), (23, [float("inf")] * 12), (24, [0.5] * 30), (None, [1.0] * 12)]
        rows += [(1000 + i, [0.9] * 12) for i in range(copies)] + [(3000, []), (40, rows[41][1])]
        rows = [r for r in rows if r[0] != 40 or r is rows[-1]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, v int")
    scaled = V.scaled(df)
    got = {}
    for r in V.top_k(scaled, scaled.filter("vec_id % 20 = 0"), k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = {q: w for q, w in brute(single, 7).items() if w}
    assert {q: sorted(g) for q, g in got.items()} == want


def test_outliers_beside_ordinary_vectors(spark):
    """Two vectors of one huge component: their products need decimals on the way and fit 63 bits; ordinary queries rank as ever, and huge ones rank ordinary vectors exactly."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 0.3, 12).round(2).astype(float).tolist()) for i in range(1, 300)]
    rows[39] = (40, [2.5e7] + [0.25] * 11)
    rows[100] = (101, [-2.0e7] + [0.5] * 11)
    rows[200] = (201, [2.25e7] + [-0.5] * 11)
    scaled = V.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in V.top_k(scaled, scaled.filter("vec_id % 20 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 5)
    assert {q: sorted(g) for q, g in got.items()} == want
    assert want[40][0] == (1, 201, 1600000000 * 1440000000 + 11 * 16 * -32)


URLS = [
    ("HTTP://WWW.Example.COM/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
    ("https://a.example.com/en/1", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"), ("https://a.com", "a.com", "", None, "allow"),
    ("https://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), ("http://net/fr/", "net", "/fr/", "net/fr/", "block"), ("http://x.net/de/", "x.net", "/de/", None, "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://É.ORG?q=/en/", "É.org", "", None, "allow"), ("http://h#/x", "h", "", None, "allow"), ("http://10.0.0.1/x\ny", "10.0.0.1", "/x\ny", None, "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    good = spark.createDataFrame([(i, 1) for i in range(len(URLS))], "page_id long, good int")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, good).collect()), key=lambda r: r[0])
    assert got == [(i, *u[1:]) for i, u in enumerate(URLS) for _ in range(2)]


def test_reputation_shrinks_and_blocks(spark):
    pages, good = [], []
    for i in range(3000):
        host = ["bad.spam.org", "www.fine.org", "shop.fine.org", f"h{i}.fine.org"][i % 4]
        pages.append((i, f"http://{host}/{i}"))
        if i % 3 == 0:
            good.append((i, 0 if host.startswith("bad") else int(i % 10 != 0)))
    known = {r.host: r for r in U.reputation(*_frames(spark, pages, good)).collect()}
    assert known["bad.spam.org"].mean < 0.1 < 0.5 < known["www.fine.org"].mean and known["bad.spam.org"].sure < 1e-6 and known["www.fine.org"].sure > 0.999
    rare = known["h3.fine.org"]
    assert known["bad.spam.org"].mean < rare.mean and abs(rare.mean - 0.9) < 0.1
    df = spark.createDataFrame(pages, "page_id long, url string")
    verdicts = {r.host: r.verdict for r in U.judge_urls(df, spark.createDataFrame(good, "page_id long, good int")).collect()}
    assert verdicts["bad.spam.org"] == "block" and verdicts["www.fine.org"] == "allow"


def _frames(spark, pages, good):
    df = spark.createDataFrame(pages, "page_id long, url string")
    return df.select("page_id", U.host_and_path(F.col("url"))[0].alias("host")), spark.createDataFrame(good, "page_id long, good int")


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, good int")
    assert U.judge_urls(empty, labels).count() == 0
    assert U.judge_urls(spark.createDataFrame([(None, "http://a.org/")], "page_id long, url string"), labels).count() == 1


def test_bound_is_the_beta_quantile(spark):
    """A posterior Beta(1.8, 0.2) has 5 % of its mass below 0.49: the normal bound of 0.615 would let it pass a floor of 0.5."""
    row = spark.range(1).select(U.beta_below(F.lit(1.8), F.lit(0.2), 0.5).alias("p"), U.beta_below(F.lit(1.8), F.lit(0.2), 0.45).alias("q")).first()
    assert row.p > U.RISK > row.q


def test_suffixes(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("x.y.org",), ("host",), ("1.2.3.4",), ("co.uk",), ("q.x.y.deep.io",)], "host string")
    got = {r.host: (r.domain, r.suffix) for r in U.domains_of(hosts).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "x.y.org": ("y.org", "org"), "host": ("host", "host"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "co.uk": ("co.uk", "uk"), "q.x.y.deep.io": ("deep.io", "io")}
    more = spark.createDataFrame([("a.gov.au",), ("x.a.com.mx",), ("a.com.info",), ("go.jp",), ("b.web.za",), ("b.shop.za",)], "host string")
    assert {r.host: r.suffix for r in U.domains_of(more).collect()} == {"a.gov.au": "gov.au", "x.a.com.mx": "com.mx", "a.com.info": "info", "go.jp": "jp", "b.web.za": "web.za", "b.shop.za": "za"}
    table = spark.createDataFrame([("deep.io",), ("y.deep.io",), ("io",)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in U.domains_of(hosts, table).collect()}
    assert got["q.x.y.deep.io"] == ("x.y.deep.io", "y.deep.io") and got["b.co.uk"] == ("co.uk", "uk")
