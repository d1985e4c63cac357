import random

import pytest

from seekspark.llm.url_rules import UrlTrie, judge_urls

SCHEMA = "page_id long, url string, host int, verdict string"


def _parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    at = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:at]


def _brute(url, rules):
    host, path = _parts(url)
    fits = [
        (len(h.split(".")) if h else 0, len(p), v == "block", h + p, v)
        for v, h, p in rules
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def _judged(spark, urls, rules, **more):
    frame = spark.createDataFrame([(i, u, 7, "x") for i, u in enumerate(urls)], SCHEMA)
    rows = judge_urls(frame.repartition(3), "url", rules, "page_id", **more).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}, len(rows)


@pytest.mark.parametrize("trie_chars", [1 << 20, 8])
def test_verdicts_equal_brute_force(spark, trie_chars):
    draw = random.Random(3)
    labels, parts = ["a", "b", "org", "ab", ""], ["", "en", "e", "en1", "x/y"]

    def host():
        return ".".join(draw.choice(labels) for _ in range(draw.randint(1, 4)))

    def path():
        return "".join("/" + draw.choice(parts) for _ in range(draw.randint(0, 4)))

    rules = [(draw.choice(["allow", "block"]), host() if draw.random() < 0.95 else "", path()) for _ in range(60)]
    urls = [f"http://{host().upper() if i % 3 else host()}{path()}{draw.choice(['', '?a=/en', '#x', '/'])}" for i in range(600)]
    urls += [None, "", "no scheme", "://", "x://", "x://h?p/q", "x://Ä.ORG/en", "x://org:80/en/", "x://u@org/e\n/f", "x://a.org/" + "e" * 100_000, "x://" + "a." * 5000 + "org/en"]
    found, count = _judged(spark, urls, rules, trie_chars=trie_chars)
    assert count == len(urls)
    for i, url in enumerate(urls):
        assert found[i] == _brute(url, rules), (url, found[i])


def test_precedence_default_and_empty_tables(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/en/1"), ("allow", "example.org", "/en/1"), ("block", "x.org", "")]
    urls = ["h://www.example.org/en/12", "h://example.org/en/2", "h://example.org", "h://x.org?q", "h://notexample.org/en/1"]
    found, _ = _judged(spark, urls, rules)
    assert [found[i][2:] for i in range(5)] == [
        ("example.org/en/1", "block"), ("org/", "allow"), (None, "allow"), ("x.org", "block"), ("org/", "allow")]
    assert _judged(spark, urls, [], default="block")[0][0][2:] == (None, "block")
    assert _judged(spark, [], rules) == ({}, 0)
    with pytest.raises(ValueError, match="allows or blocks"):
        UrlTrie([("deny", "org", "/")])


def test_repeated_rows_stay(spark):
    frame = spark.createDataFrame([(1, "h://org/", 0, None)] * 5 + [(None, "h://org/", 0, None)], SCHEMA)
    rows = judge_urls(frame, "url", [("block", "org", "/")], "page_id").collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in rows) == [(0, "block")] + [(1, "block")] * 5
