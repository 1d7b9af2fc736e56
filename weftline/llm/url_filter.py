"""URL filters (operator 12).

Listed canonical URLs and rules on hosts and paths are put in a blocked Bloom filter: a key sets one bit in
each of the eight words of one block. What a URL may meet (itself, and the ends of its host with the
beginnings of its path) is first looked up in the filter, a join on the block's number that is broadcast;
only possible hits go to the exact hash join, which removes the false ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.storage import numbered, saved, small

#: A block has so many words of 32 bits, and about so many keys.
WORDS, BLOCK_KEYS = 8, 16
#: The filter has at most so many blocks (8 MB of bits), whatever the list's length: with a list of over some
#: millions more false hits reach the exact join, and the result stays.
MOST_BLOCKS = 1 << 18

ALLOW, BLOCK = "allow", "block"
#: The rules (host, path, verdict) of the registered query.
RULES = [("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW)]
#: Words of a host by which the registered query lists it.
SPAM_WORDS = ("casino", "cheap", "pills", "spam")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first `://` and the next `/`, `?` or `#`, with A-Z lower-cased, and from there to the next
    `?` or `#`. Both are empty for null and where there is no `://`."""
    parts = [F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2)]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(parts[0], upper, upper.lower()), parts[1]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _block(blocks: int, *key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(blocks)).alias("block")


def _masks(*key: Column) -> list[Column]:
    """A bit in each word."""
    h = F.xxhash64(F.lit("bits"), *key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(31).cast("int")) for i in range(WORDS)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of keys (host, path): at most so many rows, or-ed before they are shuffled."""
    rows = keys.select(_block(blocks, F.col("host"), F.col("path")), *[m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("host"), F.col("path")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def possible(candidates: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The candidates (host_key, path_key, ...) that the filter may hold: all that it holds, and few others."""
    key = F.col("host_key"), F.col("path_key")
    rows = candidates.withColumn("at", _block(blocks, *key)).join(F.broadcast(filter_), F.col("at") == F.col("block"))  # MOST_BLOCKS rows at most
    held = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(*key))])
    return rows.where(held).drop("at", "block", *[f"w{i}" for i in range(WORDS)])


def _key_path(path: Column) -> Column:
    """A rule's path up to its last slash; what follows is compared once the keys have met."""
    return F.regexp_extract(path, r"(?s)\A(.*/)", 1)


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """(host, path, whole, rule_path, verdict): rules by host and the last slash of their path, and listed URLs as they are.
    Of equal rules with two verdicts `block` counts; nulls and repeated rows go."""
    rules = rules.select("host", _key_path(F.col("path")).alias("path"), F.lit(False).alias("whole"), F.col("path").alias("rule_path"), "verdict").dropna()
    host, path = host_and_path(F.col("url"))
    listed = listed.select(host.alias("host"), path.alias("path"), F.lit(True).alias("whole"), path.alias("rule_path"), F.lit(BLOCK).alias("verdict")).where("host <> '' OR path <> ''")
    return rules.unionByName(listed).groupBy("host", "path", "whole", "rule_path").agg(F.max("verdict").alias("verdict"))


def _candidates(most_labels: int | None, slashes: tuple[int, int] | None) -> Column:
    """What a URL (host, path) may meet. Only as many labels and slashes are tried as a rule has, so that their
    number doesn't grow with the URL."""
    whole = F.array(F.struct(F.col("host").alias("h"), F.col("path").alias("p"), F.lit(True).alias("w")))
    if not most_labels:
        return whole
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in range(1, most_labels + 1)]))
    begins = [F.concat(F.substring_index("path", "/", n), F.lit("/")) if n else F.lit("") for n in range(slashes[0], slashes[1] + 1)]
    # A path with fewer slashes than that has come out whole.
    begins = F.filter(F.array(*begins), lambda p: (F.length(p) <= F.length("path")))
    return F.concat(whole, F.flatten(F.transform(ends, lambda h: F.transform(begins, lambda p: F.struct(h.alias("h"), p.alias("p"), F.lit(False).alias("w"))))))


def judged(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default: all) with host, path, rule and verdict.

    A rule (host, path, verdict) fits its host and all hosts that end in a dot and it, where the path begins with the rule's;
    the longest counts (of equally long ones that with the longer host). rule is its host and path. Where none
    fits, rule is null and a listed URL (listed: a column url, compared by host and path) is blocked, all others are
    allowed. Null URLs and those without `://` have neither host nor path; no rule fits them, and they are allowed. Repeated
    rows are judged each; columns of pages with a made column's name give way. Empty tables of rules, listed URLs or
    pages are fine. A host or URL may have any share of all rows: hits are combined before they are shuffled, and
    met again by host and path.
    """
    made = ["host", "path", "rule", "verdict"]
    keep = [c for c in (pages.columns if keep is None else keep) if c not in made]
    own, names, _ = numbered(pages)
    host, path = host_and_path(F.col(names[url]))
    rows = own.select(*sorted({names[c] for c in keep}), host.alias("host"), path.alias("path"))

    known = saved(entries(rules, listed))
    size = F.size(F.split("host", r"\."))
    slashes = F.length(F.regexp_replace("path", "[^/]", ""))
    of_rules = known.where("NOT whole").agg(F.max(size), F.min(slashes), F.max(slashes)).first()
    blocks = max(1, min(MOST_BLOCKS, -(-known.count() // BLOCK_KEYS)))

    tried = rows.select("host", "path", F.explode(_candidates(of_rules[0], of_rules[1:])).alias("c")).select("host", "path", F.col("c.h").alias("host_key"), F.col("c.p").alias("path_key"), F.col("c.w").alias("whole"))
    hits = possible(tried, bloom(known.select("host", "path"), blocks), blocks)
    hits = hits.groupBy("host", "path", "host_key", "path_key", "whole").agg(F.lit(1).alias("one"))
    exact = known.select(F.col("host").alias("host_key"), F.col("path").alias("path_key"), "whole", "rule_path", F.col("verdict").alias("its"))
    met = hits.join(small(exact), ["host_key", "path_key", "whole"]).where(F.startswith("path", "rule_path"))
    length = F.length("host_key") + F.length("rule_path")
    best = F.struct(length.alias("n"), F.length("host_key").alias("m"), "its", F.concat("host_key", "rule_path").alias("rule"))
    found = met.groupBy("host", "path").agg(F.max(F.when(~F.col("whole"), best)).alias("best"), F.max("whole").alias("listed"))
    found = saved(found.select(F.col("host").alias("h"), F.col("path").alias("p"), "best", "listed"))
    out = rows.join(small(found), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    verdict = F.coalesce(F.col("best.its"), F.when(F.col("listed"), BLOCK), F.lit(ALLOW))
    return out.select(*[F.col(names[c]).alias(c) for c in keep], "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def spam_urls(pages: DataFrame) -> DataFrame:
    """The URLs on hosts whose name has one of SPAM_WORDS: the list of the registered query."""
    host, _ = host_and_path(F.col("url"))
    return pages.where(reduce(lambda a, b: a | b, [F.contains(host, F.lit(w)) for w in SPAM_WORDS])).select("url")


OP12_SQL = r"""
WITH r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT row_number() OVER () AS n, page_id,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
f AS (SELECT n, arg_max({'rule': rh || rp, 'v': v}, length(rh || rp)) AS best
      FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.v, CASE WHEN regexp_matches(host, 'casino|cheap|pills|spam') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f USING (n)
"""
