"""URL filters: parsing, rules, Bloom filter, exact list."""

import random
import re

from pyspark.sql import functions as F

from chafe.llm import url_filter as U

RULES = [U.Rule("allow", "org"), U.Rule("block", "example.org", "/es/"), U.Rule("block", "example.org", "/en/1"),
         U.Rule("allow", "com", "/fr/"), U.Rule("block", "com", "/de/")]
URLS = [None, "", "no scheme", "http://", "http:///x", "http://Ex.ORG", "http://ex.org/", "http://a.example.org/es/1?q",
        "https://EXAMPLE.org/en/1", "https://example.org/en/2#x", "http://badexample.org/es/", "x://y://z.com/de/",
        "http://com/fr/", "http://a.com/FR/", "http://a.com/fr/x/de/", "http://a.com?x=/de/", "http://a.com#/de/",
        "http://a.com/de/\nline?", "http://u@h.com:80/de/a", "http://É.com/de/é", "http://www.listed.net/page.html",
        "http://listed.net/page/", "http://m.listed.net/page?utm=1", "http://listed.net/Page", "http://listed.net:8/page"]


def brute(url, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        r = max(fit, key=lambda r: len(r.text))
        return host, path, r.text, r.verdict
    canon = re.sub(r"^(www|m)\.", "", host) + re.sub(r"/+\Z", "", re.sub(r"(/index)?\.html?\Z", "", path))
    return host, path, None, "block" if host and canon in listed else "allow"


def test_equals_brute_force(spark):
    rng = random.Random(1)
    urls = URLS + [f"http://{rng.choice(['www.', 'm.', ''])}h{rng.randint(0, 60)}.net/p{rng.randint(0, 9)}"
                   f"{rng.choice(['', '/', '.html', '?a'])}" for _ in range(600)]
    listed = {"listed.net/page"} | {f"h{i}.net/p{i % 10}" for i in range(0, 60, 3)}
    rows = [(i if i else None, u, "clash", "x") for i, u in enumerate(urls)] + [(3, urls[3], "clash", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, block string")
    lst = spark.createDataFrame([(u,) for u in [*listed, None, "listed.net/page"]], "url string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, lst, RULES).collect()), key=repr)
    assert got == sorted(((p, *brute(u, listed)) for p, u, *_ in rows), key=repr)


def test_filter_passes_every_listed_url(spark):
    lst = spark.createDataFrame([(f"h{i}.net/{i}",) for i in range(5000)], "url string")
    blocks = U.bloom_blocks(lst, 64).collect()
    assert len(blocks) <= 64
    own = lst.select(U._block_of(F.col("url"), 64).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(U._bits_of(F.col("url")))])
    by = {r["block"]: r for r in blocks}
    assert all(by[r["block"]][f"w{i}"] & r[f"b{i}"] == r[f"b{i}"] != 0 for r in own.collect() for i in range(8))


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    assert [r.verdict for r in U.judge(pages, none, []).collect()] == ["allow"]
    assert U.judge(pages.where("false"), none, RULES).count() == 0
