"""URL filters, held against plain code on made-up URLs."""

import random

from pyspark.sql import functions as F

from weftline.llm import url_filter

PAGES = "page_id long, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.index(c) for c in "?#" if c in path), default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def plain(url, rules, listed):
    host, path = split(url)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    if best:
        return host, path, best[3], best[2]
    return host, path, None, "block" if (host or path) and (host, path) in listed else "allow"


def check(spark, urls, rules, listed, **more):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], PAGES)
    for name, value in more.items():
        pages = pages.selectExpr("*", f"{value} AS {name}")
    found = url_filter.judged(pages, url_filter.rule_table(spark, rules), spark.createDataFrame([(u,) for u in listed], "url string"), keep=["page_id"])
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(tuple(r) for r in found.collect())
    known = {split(u) for u in listed}
    assert got == [(i, *plain(u, rules, known)) for i, u in enumerate(urls)]


def test_rules_of_the_query_and_odd_urls(spark):
    urls = ["http://a.NET/x", "http://net/", "http://net", "https://knet/x", "http://b.example.net/en/1?q=/de/", "http://b.example.net/en", "http://EXAMPLE.com/de/#x", "http://xexample.com/de/",
            "ftp://q.org/fr/a/b", "http://q.org/fr", "no scheme", "", None, "://", "://net/", "http://a.net:80/x", "x\n://a.net/\ny", "http://.net/", "http://net./", "http://u@h.net/a", "http://spam.org/1", "http://spam.org/1?x",
            "http://a.net/" + "a/" * 200_000, "http://" + "a." * 200_000 + "net/en/", "http://É.org/É", "http://a.net/x", "http://a.net/x"]
    check(spark, urls, url_filter.RULES, ["http://spam.org/1", None, "", "http://a.net/x"], host="'clash'", rule="1", own_0="2", best="3", block="4", w0="5")


def test_random_rules_and_lists(spark):
    rng = random.Random(3)
    hosts = [".".join(rng.choice(["a", "b", "net"]) for _ in range(rng.randrange(1, 5))) for _ in range(40)]
    paths = ["".join(rng.choice(["/", "/x", "/y", "/xy"]) for _ in range(rng.randrange(0, 5))) for _ in range(40)]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(500)]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in [(rng.choice(hosts), rng.choice(paths)) for _ in range(60)]}.values())
    check(spark, urls, rules, rng.sample(urls, 100))
    check(spark, urls, [], urls[:50])
    check(spark, urls, rules, [])
    check(spark, [], rules, urls)


def test_filter_keeps_all_that_is_listed_and_little_else(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("h"), "id").alias("host"), F.lit("/").alias("path"))
    blocks = 20_000 // url_filter.BLOCK_KEYS
    asked = spark.range(40_000).select("id", F.concat(F.lit("h"), "id").alias("host_key"), F.lit("/").alias("path_key"))
    passed = url_filter.possible(asked, url_filter.bloom(keys, blocks), blocks)
    assert passed.where("id < 20000").count() == 20_000
    assert passed.where("id >= 20000").count() < 200
