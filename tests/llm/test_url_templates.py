"""URL filters against a plain version of hosts, paths and rules, and the behaviour of templates."""

import re

from ledgerlint.llm import url_templates

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x=/y", "http://example.net/en", "https://x.example.com/de/4#a",
    "https://example.com/fr/4", "http://a.b.org/fr/9.html", "http://org/fr/", "http://org.evil/fr/", "http://notexample.net/en/2",
    "http://net?q", "net://net#net", "http://É.example.com/de/é", "a://b://c/d", "http://x.net\n/en/", "http://example.net:80/en/1",
    "http://u@example.com/de/",
]


def plain(url):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for domain, start, verdict in url_templates.RULES:
        if (host == domain or host.endswith("." + domain)) and path.startswith(start):
            if best is None or len(domain + start) > len(best[0]):
                best = (domain + start, verdict)
    return host, path, best


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rows = {r["page_id"]: r for r in url_templates.judge(pages).collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, best = plain(url)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, best and best[0]), url
        assert rows[i]["verdict"] in ("allow", "block") and (best is None or rows[i]["verdict"] == best[1])


def test_templates_and_labels(spark):
    good = [f"http://h.example/news/{i}" for i in range(60)]
    bad = [f"http://h.example/casino/{i}" for i in range(60)]
    other = [f"http://h.example/about/{n}" for n in ("us", "them")] + ["http://elsewhere.example/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*good, *bad, *other, bad[0], bad[0]])] + [(None, None)],
                                  "page_id long, url string")
    labels = spark.createDataFrame([(u, 0) for u in good[:40]] + [(u, 1) for u in bad[:40]] + [(good[0], None)],
                                   "url string, bad int")
    rows = url_templates.judge(pages, labels).collect()
    assert len(rows) == len(good) + len(bad) + 6
    by = {}
    for r in rows:
        by.setdefault(r["path"].split("/")[1] if r["path"] else "", set()).add((r["template"], r["verdict"]))
    assert by["news"] == {("/news/<number>", "allow")} and by["casino"] == {("/casino/<number>", "block")}
    assert {v for _, v in by["about"] | by["x"] | by[""]} == {"allow"}


def test_branches_that_do_not_differ_are_merged(spark):
    urls = [(f"http://h.example/{part}/{i}", i % 2) for part in ("a", "b", "c") for i in range(40)]
    urls += [(f"http://h.example/z/{i}", 1) for i in range(40)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    rows = url_templates.judge(pages, spark.createDataFrame(urls, "url string, bad int")).collect()
    assert {r["verdict"] for r in rows if r["path"].startswith("/z/")} == {"block"}
    merged = {r["template"] for r in rows if not r["path"].startswith("/z/")}
    assert len(merged) < 3 or all(t.startswith("/*") for t in merged)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_templates.judge(pages).collect() == []
