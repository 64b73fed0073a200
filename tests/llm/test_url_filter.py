import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidpath.llm import queries, url_filter

URLS = [
    "http://a.net/x", "https://EXAMPLE.net/en/1?q=/de/", "https://www.example.net/en/", "http://example.net/en", "http://example.net", "http://notexample.net/en/",
    "http://m.example.com/de/1#/en/", "http://example.com/fr/", "http://x.org/fr/y", "http://org/fr/", "http://org/", "ftp://spam-farm.example.org/en/", "http://www.casino-win.example.com/x",
    "http://spam-farm.example.org/fr/", None, "", "no scheme", "http://", "://net/", "http://a://b.net/", "http://[::1]:80/x", "http://a..net/", "http://net", "http://.net/x", "HTTP://É.NET/Ü", "http://a.net\n/x", "http://a.net/x\n?y",
    "http://" + "sub." * 500 + "example.com/de/" + "p/" * 2000,
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for key, action in queries.URL_RULES.items():
        h, p = key.partition("/")[0], "/" + key.partition("/")[2]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(key), key, action))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    listed = any(host == k[:-1] or host.endswith("." + k[:-1]) for k in queries.BLOCKED_SITES) and path.startswith("/")
    return host, path, None, "block" if listed else "allow"


def judged(spark, urls):
    df = spark.createDataFrame([(k, u, "x", "x") for k, u in enumerate(urls)], "page_id bigint, url string, host string, key string").repartition(2)
    got = url_filter.judge_urls(df, queries.URL_RULES, queries.BLOCKED_SITES).collect()
    return [tuple(r)[1:] for r in sorted(got, key=lambda r: r["page_id"])]


def test_urls(spark):
    assert judged(spark, URLS) == [brute(u) for u in URLS]
    assert judged(spark, []) == []


def test_lists_as_tables(spark):
    rules = spark.createDataFrame([*queries.URL_RULES.items(), *queries.URL_RULES.items(), (None, "block")], "key string, action string")
    blocked = spark.createDataFrame([(k,) for k in queries.BLOCKED_SITES] * 2, "key string")
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id bigint, url string")
    got = sorted(url_filter.judge_urls(df, rules, blocked).collect(), key=lambda r: r["page_id"])
    assert [tuple(r)[1:] for r in got] == [brute(u) for u in URLS]


def test_too_many_kinds_of_keys_are_refused(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_SHAPES", 3)
    with pytest.raises(ValueError):
        url_filter.shapes(spark.createDataFrame([("a/" + "x" * k,) for k in range(5)], "key string"))


def test_no_rules(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert url_filter.judge_urls(df, {}, []).first()["verdict"] == "allow"


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{n}.example.com/" for n in range(4000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    for listed in (keys[::2], keys[:3], keys, keys[:1500]):
        cascade = url_filter.build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), universe, len(keys))
        got = {r["key"] for r in universe.filter(cascade.holds(url_filter.F.col("key"))).collect()}
        assert got == set(listed)
        assert len(cascade.levels) > 1 or len(listed) in (3, 4000)


def test_large_lists_are_refused(spark):
    with pytest.raises(ValueError):
        url_filter.build_bloom(spark.createDataFrame([("a",)], "key string"), 10**9, 0.5, 0)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="abc.:/?#EN", max_size=30), min_size=1, max_size=20))
def test_host_and_path(spark, urls):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k bigint, url string").select("k", url_filter.host(url_filter.F.col("url")), url_filter.path(url_filter.F.col("url")))
    assert [tuple(r)[1:] for r in sorted(df.collect())] == [brute(u)[:2] for u in urls]


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    plan = url_filter.judge_urls(df, queries.URL_RULES, queries.BLOCKED_SITES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)
