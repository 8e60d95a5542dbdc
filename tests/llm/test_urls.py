from __future__ import annotations

from shared import documents, odd, prose  # noqa: F401

from qloom.llm.urls import filter_urls


def judge(spark, urls):
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)], "page_id int, url string, host string, verdict string")
    return [r[1:5] for r in sorted(filter_urls(pages).collect())]


def test_rules_and_parts(spark):
    rows = judge(
        spark,
        [
            "http://A.Example.NET/en/x?q#f",
            "http://a.net",
            "http://a.net/",
            "x://de.example.com/de/1",
            "https://fr.org/fr/",
            "https://notexample.net/en/",
            "https://user@h.org:80/fr/?a",
            None,
            "no scheme",
            "http://",
            "a://b://c/d",
        ],
    )
    assert rows == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"),
        ("a.net", "", None, "allow"),
        ("a.net", "/", "net/", "block"),
        ("de.example.com", "/de/1", "example.com/de/", "block"),
        ("fr.org", "/fr/", "org/fr/", "allow"),
        ("notexample.net", "/en/", "net/", "block"),
        ("user@h.org:80", "/fr/", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("b:", "//c/d", None, "allow"),
    ]


def test_vocabulary(spark):
    rows = judge(
        spark,
        [
            "http://x.com/PORN/",
            "http://x.com/pornography",
            "http://x.com/cheap",
            "http://x.com/cheap-cheap",
            "http://x.com/cheap?win",
            "http://www.cheap-pills.example.com/",
            "http://x.com/é-xxx",
        ],
    )
    assert [r[3] for r in rows] == ["block", "allow", "allow", "allow", "block", "block", "block"]


def test_nothing(spark):
    assert judge(spark, ["a"])[0][3] == "allow"
    assert filter_urls(spark.createDataFrame([], "page_id int, url string")).collect() == []
