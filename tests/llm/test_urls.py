"""The URL filter against models worked out one URL at a time."""

from collections import Counter
from math import floor, log

import pytest
from pyspark.sql import functions as F

from waymark.llm import urls


def pages(spark, addresses):
    rows = [(i, address, "x", "clash", 0.5) for i, address in enumerate(addresses)]
    return spark.createDataFrame(rows, "page_id long, url string, verdict string, text string, score double")


@pytest.mark.parametrize(
    ("url", "host", "path", "shown"),
    [
        ("http://A.Example.ORG/En/1?q=A#T", "a.example.org", "/En/1", "a.example.org/En/1?q=A#T"),
        ("https://h?x=/y", "h", "", "h?x=/y"),
        ("x://y://z/w", "y:", "//z/w", "y://z/w"),
        ("no-scheme.org/a", "", "", "no-scheme.org/a"),
        ("://", "", "", ""),
        ("", "", "", ""),
        (None, "", "", ""),
        ("a://h\n/p\nq#f", "h\n", "/p\nq", "h\n/p\nq#f"),
    ],
)
def test_parts(spark, url, host, path, shown):
    c = F.lit(url).cast("string")
    row = spark.range(1).select(urls.host(c).alias("h"), urls.path(c).alias("p"), urls.shown(c).alias("s")).first()
    assert (row.h, row.p, row.s) == (host, path, shown)


@pytest.mark.parametrize(
    ("host", "path", "rule", "verdict"),
    [
        ("example.org", "/es/1", "example.org/es/", "block"),
        ("a.b.example.org", "/en/17", "example.org/en/1", "block"),
        ("badexample.org", "/es/1", "org/", "allow"),
        ("org", "/", "org/", "allow"),
        ("example.org", "", None, None),
        ("x.com", "/de/", "com/de/", "block"),
        ("x.com", "/de", None, None),
        ("com.net", "/fr/", None, None),
    ],
)
def test_rules(spark, host, path, rule, verdict):
    match = urls.matching_rule(F.lit(host), F.lit(path), urls.RULES)
    row = spark.range(1).select(match.alias("m")).first().m
    assert (row and row.rule, row and row.verdict) == (rule, verdict)


def expected(spark, addresses, order):
    """text -> (score, cutoff step), from counts kept in dictionaries."""
    shown = {}
    for row in pages(spark, addresses).select(
        urls.shown(F.col("url")).alias("text"),
        urls.matching_rule(urls.host(F.col("url")), urls.path(F.col("url")), urls.RULES).verdict.alias("v"),
        F.md5(urls.shown(F.col("url"))).alias("md5"),
    ).collect():
        known = shown.get(row.text, (None,))[0]
        shown[row.text] = (max(filter(None, [row.v, known]), default=None), row.md5[0] in urls.HELD_OUT)
    seen = {"allow": Counter(), "block": Counter()}
    for text, (verdict, held) in shown.items():
        if verdict and not held:
            padded = urls.START * order + text + urls.END
            for at in range(order, len(padded)):
                for k in range(order + 1):
                    seen[verdict][padded[at - k : at], padded[at]] += 1

    def probability(counts, context, char):
        below = probability(counts, context[1:], char) if context else 1.0 / urls.CODE_POINTS
        followers = [n for (c, _), n in counts.items() if c == context]
        if not followers:
            return below
        return (counts[context, char] + len(followers) * below) / (sum(followers) + len(followers))

    scores = {}
    for text in shown:
        padded = urls.START * order + text + urls.END
        total = sum(
            round((log(probability(seen["allow"], padded[at - order : at], padded[at]))
                   - log(probability(seen["block"], padded[at - order : at], padded[at]))) * urls.UNIT)
            for at in range(order, len(padded))
        )
        scores[text] = total / (len(text) + 1) / urls.UNIT
    step = {text: max(-urls.REACH, min(urls.REACH, floor(score * urls.STEPS))) for text, score in scores.items()}
    held = [(step[text], verdict) for text, (verdict, out) in shown.items() if out and verdict]
    good, bad = ([s for s, v in held if v == kind] for kind in ("allow", "block"))
    cutoff = 0
    if good and bad:
        cutoff = min(
            {s for s, _ in held},
            key=lambda c: (sum(s < c for s in good) / len(good) + sum(s >= c for s in bad) / len(bad), abs(c), -c),
        )
    return scores, step, cutoff


def test_equal_to_plain_models(spark):
    hosts = ["a.com", "shop.com", "www.example.org", "x.example.org", "news.net", "b.net"]
    addresses = [
        f"https://{host}/{lang}/{n * 37 % 91}{end}"
        for n, host in enumerate(hosts * 6)
        for lang, end in (("en", ""), ("fr", "/"), ("de", ".html"), ("es", "?ref=x"))
    ]
    addresses += [addresses[0], "plain", "", None, "http://ünïcödé.net/漢字/\U0001f600"]
    found = urls.filter_urls(pages(spark, addresses), order=3).collect()
    scores, step, cutoff = expected(spark, addresses, 3)
    assert sorted(r.page_id for r in found) == list(range(len(addresses)))
    shown = {r.page_id: r.s for r in pages(spark, addresses).select("page_id", urls.shown(F.col("url")).alias("s")).collect()}
    for row in found:
        text = shown[row.page_id]
        assert row.score == pytest.approx(scores[text], abs=1e-9)
        if row.rule is None:
            assert row.verdict == ("allow" if step[text] >= cutoff else "block")
    assert {r.verdict for r in found if r.rule is None} == {"allow", "block"}


def test_odd_tables(spark):
    assert urls.filter_urls(pages(spark, []).limit(0)).collect() == []
    # Nothing blocked, so nothing to compare with: all pass.
    only_good = urls.filter_urls(pages(spark, ["http://a.org/x", "http://b.net/y", None, "z" * 100_000])).collect()
    assert {r.verdict for r in only_good} == {"allow"} and len(only_good) == 4
    none = spark.createDataFrame([(None, "http://a.net/"), (None, "http://a.net/")], "page_id long, url string")
    assert len(urls.filter_urls(none).collect()) == 2


def test_no_python_and_no_cross_join(spark, small):
    plan = urls.filter_urls(spark.read.parquet(f"{small}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("Python", "Arrow", "Cartesian", "NestedLoop") if word in plan]
