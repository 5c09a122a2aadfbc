import random

from priorfield.llm.urlrules import RULES, judge_urls, rule_frame


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], best[2]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rule_frame(spark, rules)).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_fixed_rules_and_odd_urls(spark):
    check(spark, [None, "", "no scheme", "://", "http://org", "http://org/", "HTTP://A.ORG/es", "http://example.org/es/x?y#z", "http://notexample.org/es/", "http://a.example.org/en/123",
                  "http://x.com/fr/", "http://x.com/fr", "http://com/de/a", "http://x.com.net/fr/", "http://é.org/ü", "http://a..org/", "http://.org/", "http://x.org?q=/es/",
                  "http://x.org#/es/", "http://u@x.org:80/es/", "http://a.org/\nb"] + ["http://example.org/es/same"] * 40, RULES)


def test_nested_rules_against_plain(spark):
    rng = random.Random(2)
    labels, parts = ["a", "b", "ab", "a-b", "é"], ["", "/", "/a", "/a/", "/ab", "/a/b", "/a/b/c"]
    rules = {}
    for _ in range(40):
        host = ".".join(rng.choice(labels) for _ in range(rng.randint(1, 3)))
        rules[host, rng.choice(parts)] = rng.choice(["allow", "block"])
    urls = ["http://" + ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5))) + rng.choice(parts) + rng.choice(["", "x", "/a/b/c/d", "?q"]) for _ in range(400)]
    rules = [(h, p, v) for (h, p), v in rules.items()]
    check(spark, urls, rules)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert judge_urls(pages, rule_frame(spark, [])).first().verdict == "allow"
    assert judge_urls(pages.limit(0), rule_frame(spark)).count() == 0
