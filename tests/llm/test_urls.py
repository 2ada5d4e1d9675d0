import random
import re

from rollmark.llm.urls import RULES, rules_table, url_filter


def _parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate({i: i + 32 for i in range(65, 91)}), path


def _judge(url, rules, default="allow"):
    host, path = _parse(url)
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h + p), len(h), h + p, v)
            best = max(best, rank) if best else rank
    return host, path, best[2] if best else None, best[3] if best else default


def _check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "<p>", "clash", 3) for i, u in urls], "page_id long, url string, html string, host string, kind int")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in url_filter(pages, table).collect())
    clean = [(h or "", p or "", v) for h, p, v in rules]
    want = [(i, *_judge(u, clean)) for i, u in urls]
    assert got == sorted((str(i), h, p, str(r), v) for i, h, p, r, v in want)


URLS = [
    (1, "http://a.b.example.NET/en/1?x=/de/"),
    (2, "https://example.net/en"),
    (2, "https://example.net/en"),
    (3, None),
    (None, "ftp://example.com/de/#x"),
    (4, "no scheme.net/x"),
    (5, "://net/"),
    (6, "http://net"),
    (7, "http://badexample.net/en/"),
    (8, "http://x.org/fr/a//b://c"),
    (9, "http://É.example.org/FR/"),
    (10, ""),
    (11, "http://" + "s." * 300 + "net/" + "p/" * 5000),
    (12, "http://u:p@example.com:80/de/"),
    (13, "http://a..net/"),
    (14, "http:///de/"),
    (15, "http://org?/fr/"),
]


def test_the_registered_rules(spark):
    _check(spark, URLS, list(RULES))
    assert sorted(tuple(r) for r in rules_table(spark).collect()) == sorted(RULES)


def test_nested_rules_over_many_cells(spark):
    rng = random.Random(17)
    labels, parts = ["a", "b", "net", "x-y"], ["/", "/e", "/en", "/en/", "/en/a", "/en/a/b", "/d", ""]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((rng.choice(hosts), rng.choice(parts)) for _ in range(150))}.values())
    urls = [(i, f"http://{rng.choice(hosts)}{rng.choice(parts)}{rng.choice(['', 'z', '/q?x'])}") for i in range(400)]
    urls += [(1000 + i, "http://a.b.net/en/a/b/c") for i in range(300)]
    _check(spark, urls, rules)


def test_odd_rules(spark):
    _check(spark, URLS, [("NET".lower(), None, "block"), (None, "/de/", "block"), ("example.net", "/en", "allow"), ("example.net", "/en", "block"), ("org", "", "allow")])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filter(pages, none).collect()] == [(None, "allow")]
    assert url_filter(pages.limit(0), rules_table(spark)).collect() == []
