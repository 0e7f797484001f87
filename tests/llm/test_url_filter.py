"""The URL filter against plain rules and sets."""

import pytest
from pyspark.sql import functions as F

from tarmac.llm import queries as q
from tarmac.llm import url_filter as u

URLS = [
    (1, "https://www.Example.NET/en/1?x=1#y"), (2, "http://example.net/de/1"), (3, "http://a.b.org/fr/9.html"), (4, "http://a.b.org/en/9"),
    (5, "ftp://example.com/de/"), (6, "http://shop.example.com/de"), (7, "http://www.cheap-pills.foo.com/"), (8, "http://notpills.foo.com/"),
    (9, "no scheme"), (10, None), (11, ""), (12, "http://"), (13, "http://net/"), (14, "http://net"), (15, "http://xnet/"), (16, "a://b://c/d"),
    (17, "http://x.pills"), (18, "http://X.CASINO.foo.com?q=://other"), (19, "http://casino.foo.org/fr/"), (None, "http://spam.foo.com#"),
    (1, "https://www.Example.NET/en/1?x=1#y"), (20, "http://h\nost.org/fr/\n"), (21, "http://" + "a." * 3000 + "com/x"), (22, "http://..ads.de//")]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = lambda s, ends: s[:min((s.find(c) for c in ends if c in s), default=len(s))]
        raw = cut(rest, "/?#")
        host, path = "".join(c.lower() if c.isascii() else c for c in raw), cut(rest[len(raw):], "?#")
    best = max(((len(h + p), h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    labels = host.split(".")
    listed = any(set(x.split("-")) & set(u.LISTED_TERMS) for x in labels[:-1])
    return host, path, best[1] if best else None, best[2] if best else ("block" if listed else "allow")


@pytest.mark.parametrize("slice_words", [u.SLICE_WORDS, 1])
def test_rules_and_list(spark, slice_words):
    pages = spark.createDataFrame([(i, url, "x", "y") for i, url in URLS], "page_id long, url string, host string, listed string")
    got = [tuple(r) for r in u.judge_urls(pages, slice_words=slice_words).drop("listed").collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted([(i, *plain(url)) for i, url in URLS], key=key)


@pytest.mark.parametrize(("first", "later", "slice_words"), [(0.7, 0.5, 4), (0.05, 0.1, u.SLICE_WORDS)])
def test_membership_is_exact(spark, first, later, slice_words):
    universe = spark.range(1000).select(F.concat(F.lit("host"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    c = u.build(universe, first, later, slice_words)
    assert first < 0.1 or (len(c.levels) > 2 and c.slices > 1)
    for s in range(c.slices):
        mine = universe.where(u._slice(F.col("key"), c.slices) == s)
        assert mine.count() and mine.where(u.member(F.col("key"), c, s) != F.col("listed")).isEmpty()


@pytest.mark.parametrize("listed", [True, False])
def test_all_or_nothing_listed(spark, listed):
    universe = spark.range(50).select(F.col("id").cast("string").alias("key"), F.lit(listed).alias("listed"))
    c = u.build(universe)
    assert len(c.levels) == int(listed)
    assert universe.where(u.member(F.col("key"), c, 0) != F.col("listed")).isEmpty()


def test_given_list_and_subdomains(spark):
    pages = spark.createDataFrame([(1, "http://a.bad.io/"), (2, "http://bad.io"), (3, "http://xbad.io"), (4, "http://io/"), (5, "http://q.r.s.t/")], "page_id long, url string")
    domains = spark.createDataFrame([("Bad.io", 1), ("r.s.t", 1), (None, 1), ("bad.io", 2)], "domain string, key int")
    got = {r.page_id: (r.verdict, r.listed) for r in u.judge_urls(pages, domains, rules=()).collect()}
    assert got == {1: ("block", True), 2: ("block", True), 3: ("allow", False), 4: ("allow", False), 5: ("block", True)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert u.judge_urls(pages).collect() == []
    some, none = spark.createDataFrame([(1, "http://spam.de/")], "page_id long, url string"), spark.createDataFrame([], "domain string")
    assert [r.verdict for r in u.judge_urls(some, none).collect()] == ["allow"]


def test_no_python_and_no_join_on_the_pages(spark):
    text = u.judge_urls(q.read(spark, "/root/testdata/sf0.001", "pages"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Join" not in text
