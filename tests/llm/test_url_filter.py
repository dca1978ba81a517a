import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablecraft.llm import url_filter
from tablecraft.llm.queries import queries

URLS = [
    (1, "https://WWW.Example.com/en/1?x=/fr/"),
    (2, "http://example.com/en/2#a"),
    (3, "https://blog.example.com/en/3"),
    (4, "https://a.www.example.com/en/4"),
    (5, "https://myexample.com/en/5"),
    (6, "https://com"),
    (7, "http://com/"),
    (8, "https://a.net/es/1"),
    (9, "https://a.net/es"),
    (10, "https://net/fr/?"),
    (11, "ftp://x.org:80/a?b://c/d"),
    (12, "no scheme example.com/en/"),
    (13, ""),
    (None, None),
    (14, "https://a.org/é ü\n/x"),
    (15, "https://example.com?/en/"),
    (15, "https://example.com?/en/"),
    (16, "https://" + "a" * 5000 + ".org/" + "b/" * 5000),
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    end = min([i for i, c in enumerate(rest) if c in "?#"] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def plain_rule(host, path):
    fits = [
        r for r in url_filter.RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.name), default=None)


@pytest.fixture(scope="module")
def edge_pages(spark):
    rows = [(i, url, "h", "r", "v", "t", 1.0) for i, url in URLS]
    return spark.createDataFrame(
        rows, "page_id long, url string, host string, rule string, verdict string, text string, score double"
    )


def test_parts_and_rules(edge_pages):
    rows = url_filter.judge(edge_pages).collect()
    assert len(rows) == len(URLS)
    expected = []
    for i, url in URLS:
        host, path = plain_parts(url)
        rule = plain_rule(host, path)
        expected.append((i, host, path, rule and rule.name, rule and rule.verdict))
    found = [(r["page_id"], r["host"], r["path"], r["rule"],
              r["verdict"] if r["rule"] else None) for r in rows]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert {r["verdict"] for r in rows} <= {"allow", "block"}


def test_empty_and_undecided_tables(spark, edge_pages):
    assert url_filter.judge(edge_pages.where("page_id = 99")).count() == 0
    rows = url_filter.judge(edge_pages.where("page_id IN (11, 13)")).collect()
    assert [(r["rule"], r["verdict"], r["score"]) for r in rows] == [(None, "allow", 0.0)] * 2


def plain_scores(texts, train):
    """Score per text by the definition, with counts from all training texts."""
    seen = {v: Counter() for v in ("allow", "block")}
    for text in texts:
        if train[text]:
            for i in range(3, len(text)):
                for order in range(4):
                    seen[train[text]][("c", text[i - order : i])] += 1
                    seen[train[text]][("s", text[i - order : i + 1])] += 1

    def estimate(verdict, text, i):
        p = 1 / url_filter.SYMBOLS
        for order in range(4):
            hits = seen[verdict][("s", text[i - order : i + 1])]
            p = (hits + 2 * p) / (seen[verdict][("c", text[i - order : i])] + 2)
        return math.log10(p)

    return {
        text: sum(estimate("allow", text, i) - estimate("block", text, i)
                  for i in range(3, len(text))) / (len(text) - 3)
        for text in texts
    }


def test_query_equals_brute_force(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = {r["page_id"]: r for r in queries()["op8_url_filters"](spark, small).collect()}
    spelling = {
        r["page_id"]: r["t"]
        for r in pages.select(
            "page_id", url_filter.spelled(*url_filter.host_and_path(F.col("url"))).alias("t")
        ).collect()
    }
    import zlib

    verdict = {}
    for i, text in spelling.items():
        rule = plain_rule(rows[i]["host"], rows[i]["path"])
        verdict[text] = max(filter(None, [verdict.get(text), rule and rule.verdict]), default=None)
    train = {t: None if zlib.crc32(t.encode()) % 4 == 0 else v for t, v in verdict.items()}
    scores = plain_scores(list(verdict), train)
    judged = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for i, text in spelling.items():
        assert judged[i]["score"] == pytest.approx(scores[text], abs=1e-9)
        assert rows[i]["verdict"] == judged[i]["verdict"]
    free = [judged[i] for i in judged if judged[i]["rule"] is None]
    lowest = min((r["score"] for r in free if r["verdict"] == "allow"), default=9)
    assert all(r["score"] < lowest for r in free if r["verdict"] == "block")


def test_model_tells_the_kinds_apart(spark):
    """On URLs that rules decide, the model alone agrees with the rules."""
    some = ["".join("aeioulnrst"[int(d)] for d in str(i * 7919)) for i in range(200)]
    good = [f"https://{w}.com/guide/garden-{w}" for w in some]
    bad = [f"https://{w}.net/es/win-casino-{w}" for w in some]
    free = [("https://a.org/guide/garden-oak", "allow"), ("https://b.org/es/win-casino", "block")]
    pages = spark.createDataFrame(
        list(enumerate(good + bad + [u for u, _ in free])), "page_id long, url string"
    )
    rows = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert [rows[400], rows[401]] == [v for _, v in free]


def test_threshold(spark):
    frame = spark.createDataFrame(
        [(-1.0, "block"), (-0.5, "block"), (0.5, "allow"), (9.0, "allow")],
        "score double, verdict string",
    )
    assert -0.5 < url_filter.threshold(frame) < 0.5
    assert url_filter.threshold(frame.where("score > 0")) == 0.0
