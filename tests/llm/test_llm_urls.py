"""Host reputation: exact beta quantiles, domains, suffixes and ports, and outcomes that differ by host against SQL."""

import math
import random

import pytest
from oracle import connect, same
from pyspark.sql import functions as F
from test_llm_ops import frame, odd

from corpusloom.llm import url_filters

PAGE, LABEL = "page_id long, url string, html string", "doc_id long, quality int, toxic int"


def exact_quantile(a, b, tail):
    """By bisection over the integral in log-odds."""
    step = 0.002
    w = lambda u: math.exp(a * u - (a + b) * (max(u, 0) + math.log1p(math.exp(-abs(u)))))
    lo, hi = -60 / min(a, 1) - 10, 60 / min(b, 1) + 10
    step = max(step, (hi - lo) / 400_000)
    us = [lo + step * i for i in range(int((hi - lo) / step))]
    ws = [w(u) for u in us]
    need, s = tail * sum(ws), 0.0
    for u, x in zip(us, ws):
        if s + x >= need:
            return 1 / (1 + math.exp(-(u + step * ((need - s) / x - 0.5))))
        s += x


def test_quantile_of_a_beta(spark):
    some = [(2.0, 3.0), (0.5, 0.5), (50.0, 7.0), (900.0, 100.0), (1.0, 30.0), (0.05, 1.0), (3.0, 0.2)]
    got = frame(spark, some, "a double, b double").select("a", "b", F.expr(url_filters.quantile_sql("a", "b")).alias("q")).collect()
    for r in got:
        assert abs(r["q"] - exact_quantile(r["a"], r["b"], url_filters.TAIL)) < 2e-3, r


@pytest.mark.parametrize(
    "host, domain, suffix",
    [
        ("a.co.uk", "a.co.uk", "co.uk"), ("x.a.co.uk", "a.co.uk", "co.uk"), ("b.co.uk:8080", "b.co.uk", "co.uk"), ("www.shop.com", "shop.com", "com"), ("user:pw@shop.com:80", "shop.com", "com"),
        ("10.0.0.1", "10.0.0.1", "10.0.0.1"), ("10.0.0.1:99", "10.0.0.1", "10.0.0.1"), ("[2001:db8::1]:80", "[2001:db8::1]", "[2001:db8::1]"), ("localhost", "localhost", "localhost"), ("", "", ""),
    ],
)
def test_domains(spark, host, domain, suffix):
    r = frame(spark, [(host,)], "h string").select(url_filters.domain_of(F.col("h")).alias("d"), url_filters.suffix_of(F.col("h")).alias("s")).first()
    assert (r["d"], r["s"]) == (domain, suffix)


def test_outcomes_that_differ_by_host(spark, tmp_path):
    """Hosts, domains and suffixes of their own rates: some are blocked, some by what is known of their domain only; the SQL agrees."""
    rng = random.Random(2)
    rate = {"bad.a.co.uk": 0.97, "worse.a.co.uk:81": 0.95, "b.co.uk": 0.05, "good.shop.com": 0.02, "10.0.0.9": 0.9, "mixed.shop.com": 0.5, "u@spam.net": 0.99}
    pages, labels = [], []
    for host, p in rate.items():
        for i in range(80):
            pages.append((len(pages), f"http://{host}/{rng.choice(('fr', 'de', 'x'))}/{i}", ""))
            if i < 60:
                bad = int(rng.random() < p)
                labels.append((len(pages) - 1, 1 - bad if i % 2 else 1, 0 if i % 2 else bad))
    pages += [(9000, "http://new.a.co.uk/", ""), (9001, "http://new.shop.com/", ""), (9002, None, ""), (None, "http://b.co.uk/", ""), (9003, "http://b.co.uk/" + "x" * 100_000, ""), (5, pages[5][1], "")]
    labels += [(None, 0, 1), (3, None, None)]
    odd(frame(spark, pages, PAGE)).write.parquet(f"{tmp_path}/pages.parquet")
    frame(spark, labels, LABEL).write.parquet(f"{tmp_path}/labels.parquet")
    same(spark, connect(str(tmp_path)), url_filters.op8_url_filters, url_filters.SQL, str(tmp_path))
    got = {r["host"]: r for r in url_filters.op8_url_filters(spark, str(tmp_path)).filter("rule IS NULL").collect()}
    verdict = {h: r["verdict"] for h, r in got.items()}
    assert [verdict[h] for h in ("bad.a.co.uk", "worse.a.co.uk:81", "10.0.0.9", "u@spam.net")] == ["block"] * 4
    assert [verdict[h] for h in ("b.co.uk", "good.shop.com", "mixed.shop.com", "new.shop.com", "")] == ["allow"] * 5
    assert got["new.a.co.uk"]["bad_low"] > got["new.shop.com"]["bad_low"]
    empty = frame(spark, [], PAGE)
    assert url_filters.filter_urls(empty, frame(spark, labels, LABEL)).count() == 0
