"""URL filters against trying every rule on every url."""

import random

import pytest

from plumbline.llm import url_rules as U

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("WWW.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.net", "/es", "block"),
    ("a.net", "/es", "allow"), ("deep.er.a.net", "", "block"), ("net", "/es/x/y/z", "allow"), (None, "/", "block"), ("org", None, "block"), ("org", "/", "odd"),
    ("b.net", "/es/", "block"), ("x.b.net", "/e", "allow"), ("b.net", "/es/", "block"), (".com", "/q", "block"),
]


def brute(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:at], rest[at:]
        path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    found = []
    for h, p, v in rules:
        if None in (h, p) or v not in ("allow", "block"):
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            found.append((len(h + p), len(h), v, h + p))
    return (host, path, max(found)[3], max(found)[2]) if found else (host, path, None, default)


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(2)
    hosts = ["com", "example.com", "www.example.com", "WWW.EXAMPLE.com", "a.net", "x.a.net", "deep.er.a.net", "q.deep.er.a.net", "xa.net", "b.net", "x.b.net", "net", "", "com.", ".com", "x..com", "u@a.net:80", "é.net"]
    paths = ["", "/", "/en", "/en/", "/en/1.html", "/es", "/es/", "/essay", "/es/x/y/z", "/es/x/y/zz/w", "/es/x/y/", "//en/", "/q", "/EN/"]
    ends = ["", "?page=2&ref=/en/", "#top", "?a#b", "#a?b"]
    out = [rng.choice(["http", "https", "", "ftp"]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(ends) for _ in range(400)]
    out += ["https://example.com/en/7"] * 300  # a hot url
    out += [None, "", "example.com/en/", "://", "http://", "a://b://example.com/en/", "http:/example.com/en/", "http://net/es/" + "y/" * 20_000, "http://" + "w." * 20_000 + "example.com/en/" + "z" * 50_000]
    return out


@pytest.mark.parametrize("rules", [RULES, RULES[:5], [], [("", "/en", "block"), ("", "", "allow")]])
@pytest.mark.parametrize("most", [U.MAX_SHAPES, 0])
def test_same_as_all_rules(spark, urls, rules, most):
    pages = spark.createDataFrame([(i, u, "dot", "old", "`t`") for i, u in enumerate(urls)], ["page_id", "url", "a.b", "Host", "tick`s"])
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = U.filter_urls(pages, table, default="block", most_shapes=most)
    assert got.columns == ["page_id", "url", "a.b", "tick`s", "host", "path", "rule", "verdict"]
    found = {r[0]: tuple(r)[4:] for r in got.collect()}
    assert len(found) == len(urls)
    for i, u in enumerate(urls):
        assert found[i] == brute(u, rules, "block"), u


def test_digests_decide(spark, urls, monkeypatch):
    """With short prefixes that all clash, only the full digests tell expressions apart."""
    monkeypatch.setattr(U, "PREFIX", 0)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()}
    assert all(found[i] == brute(u, RULES, "allow") for i, u in enumerate(urls))


def test_empty_and_repeated(spark):
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    empty = spark.createDataFrame([], "page_id long, URL string")
    assert U.filter_urls(empty, table).count() == 0
    twice = spark.createDataFrame([(1, "http://a.com/")] * 3, "page_id long, URL string")
    assert [tuple(r) for r in U.filter_urls(twice, table).collect()] == [(1, "http://a.com/", "a.com", "/", "com/", "allow")] * 3
