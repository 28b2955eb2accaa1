import re

from gridlark.llm import url_filters as u


def brute(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (not h or host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((-len(rule), verdict != "block", rule, verdict))
    best = min(fit, default=None)
    return (host, path, best[2] if best else None, best[3] if best else otherwise)


URLS = [
    None, "", "no scheme", "http://", "http://NET/", "http://a.net", "http://a.net/", "http://a.net/x?y#z", "http://anet/", "http://example.net/en/", "http://www.example.net/en/a", "http://example.net/en", "https://Example.COM/de/x?q=/en/",
    "http://x.org/fr/", "http://org/fr/y", "http://x.org/fr", "ftp://a.b.net?x", "http://a.net#/x", "http://a.net://b.org/fr/", "http://bücher.net/ß", "http://a.net/" + "y" * 5000, "http://a.b\n.net/c", "http://a+b.net/(c)/d", "http://a.net//",
]


def test_against_brute_force(spark):
    more = [*u.RULES, ("allow", "a+b.net/(c)/"), ("block", "b.net/c"), ("allow", "b.net/c"), ("block", "/only/path"), ("allow", "net/x")]
    rows = [(i, x, "r") for i, x in enumerate([*URLS, URLS[5], "http://q/only/path/z"])]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    for rules in (u.RULES, more):
        out = u.filter_urls(df, rules=rules)
        assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
        assert got == {i: brute(x, rules) for i, x, _ in rows}
    assert u.filter_urls(df.where("false")).count() == 0 and u.filter_urls(df, rules=[]).where("rule is not null").count() == 0


def test_each_rule_is_filed_once_under_its_rarest_token():
    rules = [("block", "a.example.com/x/"), ("allow", "b.example.com/x/"), ("block", "/")]
    index = u.index_rules(rules)
    assert sorted((t, r["rule"]) for t, rs in index.items() for r in rs) == [("", "/"), ("h:a", "a.example.com/x/"), ("h:b", "b.example.com/x/")]
    assert all(u.java_quote(c) in (c, "\\" + c) for c in ".+*?()[]{}|^$/a")


def test_plan_is_native(spark):
    plan = u.filter_urls(spark.createDataFrame([("http://a.net/",)], "url string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_many_rules(spark):
    rules = [("block", f"host{i}.example/part{i % 7}/") for i in range(50_000)]
    buckets = u.by_bucket(u.index_rules(rules))
    assert sum(map(len, buckets)) == len(rules) and max(map(len, buckets)) < 50
    rows = [(i, f"https://www.host{k}.example/part{p}/x") for i, (k, p) in enumerate([(0, 0), (49_999, 49_999 % 7), (12_345, 12_345 % 7), (12_345, (12_345 + 1) % 7), (50_000, 0)])]
    out = u.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).orderBy("page_id").collect()
    assert [r.verdict for r in out] == ["block", "block", "block", "allow", "allow"]
