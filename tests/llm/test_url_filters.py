import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cellarium.llm import url_filters as U


def brute(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def check(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "c", "p") for i, u in enumerate(urls)], "page_id int, url string, host string, page string")
    out = U.judge_urls(df, U.rules_table(spark, rules)).select("page.page_id", "host", "path", "rule", "verdict").collect()
    assert {r[0]: tuple(r)[1:] for r in out} == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert len(out) == len(urls)


URLS = [
    None, "", "no scheme", "http://", "http://com/de/x", "http://COM", "https://Example.ORG/es/a?x=/de/", "x://a.example.org/en/1#f", "x://a.example.org/en/12",
    "x://example.org", "x://example.org?/es/", "x://notexample.org/es/", "x://a.b.c.d.com/fr/://y", "a://b://c.com/de/", "x://.com/de/", "x://com./de/", "x://a.com:80/de/", "x://ÄB.com/de/",
    "x://a.com/" + "de/" * 5000, "x://com/de/x", "x://com/de/x",
]


def test_cases(spark):
    check(spark, URLS, U.RULES)


def test_nested_rules(spark):
    rules = [("org", "/", "allow"), ("org", "/a", "block"), ("org", "/ab", "allow"), ("org", "/abc/", "block"), ("b.org", "", "block"), ("org", "/b", "allow"), ("c.b.org", "/ab", "block")]
    urls = [f"x://{h}{p}" for h in ("org", "b.org", "c.b.org", "d.c.b.org", "xb.org") for p in ("", "/", "/a", "/aa", "/ab", "/abb", "/abc/d", "/ac", "/b", "/ba", "/c")]
    check(spark, urls, rules)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab./:#?", max_size=12), max_size=30), st.lists(st.tuples(st.text("ab.", min_size=1, max_size=4), st.text("/ab", max_size=3)), min_size=1, max_size=8, unique=True))
def test_random(spark, urls, rules):
    texts = {}
    for h, p in rules:
        texts.setdefault(h + p, (h, p, "block" if len(h) % 2 else "allow"))
    check(spark, ["x://" + u for u in urls] + urls, list(texts.values()))


def test_hot_levels_are_split(spark, monkeypatch):
    monkeypatch.setattr(U, "SPLIT", 3)
    check(spark, [f"x://h{i % 4}.com/{'de' if i % 3 else 'fr'}/{i}" for i in range(200)], U.RULES)


def test_no_rules_and_no_rows(spark):
    check(spark, URLS, [("nowhere", "/", "block")])
    df = spark.createDataFrame([(1, "x://a.com/de/")], "page_id int, url string")
    none = U.rules_table(spark).limit(0)
    assert U.judge_urls(df, none).select("rule", "verdict").collect() == [(None, "allow")]
    assert U.judge_urls(df.limit(0), U.rules_table(spark)).count() == 0


def test_native(spark):
    df = spark.createDataFrame([(1, "x://a.com/de/")], "page_id int, url string")
    plan = U.judge_urls(df, U.rules_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("LocalTableScan", ""))
