import random
import re

from albumetry.llm import urls

URLS = [None, "", "no scheme", "http://", "http://Example.ORG", "HTTPS://a.example.org/es/x", "https://example.org/en/12?q=/es/", "x://b.org/", "x://borg/",
        "x://notexample.org/es/", "x://shop.com/fr/a#b", "x://shop.com/de/", "x://m.cheap-pills.net/x", "x://m.cheap-pills.com/fr/", "x://ads.net/y",
        "x://net/wp-login.php", "x://a/cart/checkout/1", "a://b://c.org/", "x://ÄÖ.ORG/é", "x://c.org?x", "x://example.org/EN/1", "x://user@c.org:80/"]


def plain(url):
    host, path = urls.split_url(url)
    best = None
    for r in urls.HOST_RULES + urls.PATTERN_RULES:
        if re.search(r.pattern, host + path) and (best is None or r.rank > best.rank):
            best = r
    listed = best is not None and best.listed
    return host, path, best.name if listed else None, best.verdict if best else "allow", best.name if best and not listed else None


def test_verdicts_equal_trying_every_rule(spark):
    pages = spark.createDataFrame([(k, u, "h", "x") for k, u in enumerate(URLS)], "page_id long, url string, host string, path string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge_urls(pages).collect()}
    assert got == {k: plain(u) for k, u in enumerate(URLS)}
    assert got[5] == ("a.example.org", "/es/x", "example.org/es/", "block", None)
    assert got[6][2:4] == ("example.org/en/1", "block") and got[20][2] == "org/" and got[12][3] == "block" and got[13][3] == "allow"
    assert urls.judge_urls(pages.filter("false")).count() == 0


def test_only_candidates_run():
    rules = [urls.host_rule("block", f"site{k}.com", "/a/") for k in range(500)]
    index, always = urls.index_rules(rules, {"com": 900, "a": 500})
    assert not always and all(len(v) == 1 for v in index.values())
    matcher = urls.Matcher(rules, index, always)
    assert matcher.best("x.site7.com", "/a/b") is rules[7] and matcher.runs == 1
    assert matcher.best("other.com", "/a/") is None and matcher.runs == 1


def test_random_rules_equal_trying_all():
    rng = random.Random(1)
    part = lambda: rng.choice(["a", "b1", "c-d", "com", "org"])
    rules = [urls.host_rule(rng.choice(["allow", "block"]), ".".join(part() for _ in range(rng.randint(1, 3))), rng.choice(["/", "/a/", "/b1", "/c-d/x"]))
             for _ in range(60)]
    matcher = urls.Matcher(rules, *urls.index_rules(rules, {"com": 5, "a": 9}))
    for _ in range(500):
        host, path = ".".join(part() for _ in range(rng.randint(1, 4))), rng.choice(["", "/", "/a/b", "/b12", "/c-d/xy"])
        fit = [r for r in rules if re.search(r.pattern, host + path)]
        want = max(fit, key=lambda r: r.rank) if fit else None
        got = matcher.best(host, path)
        assert (got and (got.rank)) == (want and want.rank)
