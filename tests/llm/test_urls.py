"""URL rules on long hosts, and vocabularies with points of their own."""

import time

from playgauge.llm.urls import Vocabulary, filtered


def verdicts(spark, urls, **params):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return [tuple(r) for r in filtered(df, **params).orderBy("page_id").select("rule", "verdict").collect()]


def test_suffixes_of_long_hosts(spark):
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("a.b.c.d/", "block"), ("d/", "allow")]
    long = "x." * 500_000
    start = time.perf_counter()
    got = verdicts(spark, [f"http://{long}net/", f"http://{long}example.net/en/x", f"http://{long}a.b.c.d/", f"http://{'y' * 500_000}.d/", "http://" + "z" * 500_000, f"http://{long}notexample.net/en/"], rules=rules)
    assert got == [("net/", "block"), ("example.net/en/", "allow"), ("a.b.c.d/", "block"), ("d/", "allow"), (None, "allow"), ("net/", "block")]
    assert time.perf_counter() - start < 30
    assert verdicts(spark, ["http://net/", "http://xnet/", "http://.net/", "http://example.net/en/"], rules=rules) == [
        ("net/", "block"), (None, "allow"), ("net/", "block"), ("example.net/en/", "allow"),
    ]


def test_points_of_a_table(spark):
    table = spark.createDataFrame([("Free", 3), ("win", 4), ("news", -2), ("casino", 9), ("casino", 2), ("", 9), (None, 1), ("x", None)], "term string, points int")
    vocabulary = Vocabulary.of_table(table, 7)
    assert vocabulary.pointed == (("casino", 9), ("free", 3), ("news", -2), ("win", 4))
    urls = ["http://a/free", "http://a/free/free/free", "http://a/FREE-win", "http://a/free-win-news", "http://a/casino", "http://a/casino-news", "http://a/casinos", None]
    got = [v for _, v in verdicts(spark, urls, rules=[], vocabulary=vocabulary)]
    assert got == ["allow", "allow", "block", "allow", "block", "block", "allow", "allow"]


def test_no_rules_and_no_terms(spark):
    nothing = Vocabulary((), ())
    assert verdicts(spark, ["http://casino.net/", None, ""], rules=[], vocabulary=nothing) == [(None, "allow")] * 3
