"""Benchmark decontamination by template canonicalisation (operator 8), in DataFrame functions only.

Numbers, quantities with units and names become typed placeholders; the rest is lower-cased and cut
into words. Windows of such words of all benchmark items are hash-joined with those of all documents.
An item is in a document if enough of its windows are and the slots agree both ways: aligned as the
windows are, each value of the item stands for one value in the document throughout, the same or another,
and different values for different ones (values that stay what they are never disagree). Where the
document as a whole disagrees, each occurrence of the item in it is judged by itself. Items whose windows
are mostly placeholders are looked for by their literal words, so as they stand only.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.storage import BROADCAST_IDS, BROADCAST_ROWS, fits, numbered, saved, small

WINDOW_WORDS = 8
#: Items of fewer words than a window are looked for by windows of so many; shorter ones can't be told from chance.
SHORT_WINDOW_WORDS = 4
#: Words in a window that must not be placeholders.
LEAST_PLAIN = 0.5
#: Share of an item's windows that a document must have.
COVERAGE = 0.3

#: Windows that more items have are a common prompt rather than an item's own, and count for items without own ones only.
SHARED_ITEMS = 5

#: Characters of scripts without spaces (Thai to Khmer, kana, Chinese), each of which is a word.
UNSPACED = "[\\u0e00-\\u0eff\\u1000-\\u109f\\u1780-\\u17ff\\u3040-\\u30ff\\u31f0-\\u31ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\x{20000}-\\x{3ffff}]"

# Units, and the placeholders' characters (private use).
UNITS = (
    "mm|cm|dm|km|m|in|ft|yd|mi|miles?|inch(?:es)?|feet|foot|yards?|met(?:er|re)s?|kilomet(?:er|re)s?|centimet(?:er|re)s?"
    "|mg|kg|g|t|lbs?|oz|grams?|kilograms?|tons?|pounds?|ounces?|ml|cl|dl|l|lit(?:er|re)s?|gallons?|pints?|cups?"
    "|ms|s|sec|secs|seconds?|min|mins|minutes?|h|hr|hrs|hours?|days?|weeks?|months?|years?"
    "|km/h|mph|m/s|kph|hz|khz|mhz|ghz|w|kw|mw|kwh|v|kv|a|ma|j|kj|cal|kcal|pa|kpa|bar|n|°c|°f|k"
    "|kb|mb|gb|tb|bytes?|bits?|dollars?|euros?|cents?|usd|eur|gbp|percent"
)
NUMBER, QUANTITY, NAME = "\ue001", "\ue002", "\ue003"
# Numbers in words, and what they are.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
WORD_VALUES = {w: str(i) for i, w in enumerate(ONES)} | {w: str(20 + 10 * i) for i, w in enumerate(TENS)} | {"hundred": "100", "thousand": "1000", "million": "1000000"}
_WORD = rf"(?<![\p{{L}}\p{{N}}])(?i:(?:{'|'.join(TENS)})[- ](?:{'|'.join(ONES[1:10])})|{'|'.join(sorted(WORD_VALUES, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"
_DIGITS = r"(?<![\p{L}\p{N}.,])[$€£]?[0-9]++(?:[.,:/][0-9]++)*+"
QUANTITY_PATTERN = rf"(?:{_DIGITS}|{_WORD})(?:\s?%|\s?(?i:{UNITS})(?![\p{{L}}\p{{N}}]))"
NUMBER_PATTERN = rf"{_DIGITS}(?![\p{{L}}\p{{N}}])|{_WORD}"
# A capitalised word (or several) after a word that doesn't end a sentence.
NAME_PATTERN = r"(?<=[\p{Ll}0-9,;] )\p{Lu}[\p{Ll}'’-]++(?: \p{Lu}[\p{Ll}'’-]++)*+"


def _spaced(text: Column) -> Column:
    """The text ('' for null), with characters of scripts without spaces set apart; a column of its own
    before words and slots are cut, as these would work it out many times over."""
    plain = F.coalesce(text, F.lit(""))
    return F.when(plain.rlike(UNSPACED), F.regexp_replace(plain, f"({UNSPACED})", " $1 ")).otherwise(plain)


def _stages(text: Column) -> tuple[Column, Column, Column]:
    """The text, without quantities, without numbers too, and without names too."""
    plain = F.coalesce(text, F.lit(""))
    digits = plain.rlike(f"[0-9]|{_WORD}")
    first = F.when(digits, F.regexp_replace(plain, QUANTITY_PATTERN, f" {QUANTITY} ")).otherwise(plain)
    second = F.when(digits, F.regexp_replace(first, NUMBER_PATTERN, f" {NUMBER} ")).otherwise(plain)
    return plain, first, F.regexp_replace(second, NAME_PATTERN, f" {NAME} ")


def template_words(text: Column) -> Column:
    """Words of the canonical text: lower-case letters and digits, or placeholders."""
    words = F.split(F.lower(_stages(text)[2]), rf"[^\p{{L}}\p{{N}}{NUMBER}-{NAME}]+")
    return F.filter(words, lambda w: w != "")


def literal_words(text: Column) -> Column:
    """Words of the text as it stands: lower-case letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _in_digits(value: Column) -> Column:
    """A number in words as one in digits; others as they are."""
    known = F.create_map(*[x for w, n in WORD_VALUES.items() for x in (F.lit(w), F.lit(n))])
    both = F.split(value, "[- ]")
    two = (known[F.get(both, F.lit(0))].cast("int") + known[F.get(both, F.lit(1))].cast("int")).cast("string")
    return F.coalesce(known[value], F.when(F.size(both) == 2, two), value)


def _places(words: Column, sign: str) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.when(w == sign, i)), lambda i: i.isNotNull())


def template_slots(text: Column, words: Column) -> Column:
    """Array of (at, value): each placeholder's place among the words, and what stood there."""
    plain, first, _ = _stages(text)
    second = F.regexp_replace(first, NUMBER_PATTERN, f" {NUMBER} ")
    parts = []
    for sign, source, pattern in ((QUANTITY, plain, QUANTITY_PATTERN), (NUMBER, first, NUMBER_PATTERN), (NAME, second, NAME_PATTERN)):
        places = _places(words, sign)
        values = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
        values = F.transform(values, lambda v: F.lower(F.regexp_replace(v, r"\s+", " ")))
        if sign == NUMBER:
            values = F.transform(values, _in_digits)
        parts.append(F.zip_with(places, values, lambda i, v: F.struct(i.alias("at"), v.alias("value"))))
    return F.concat(*parts)


def _window_hashes(words: Column, k: int) -> Column:
    at = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(words, i, k)))


def _item_windows(words: DataFrame, literal: bool) -> DataFrame:
    """Windows of (item, words, slots) that are plain enough, or (literal) all."""
    length = F.size("words")
    out = []
    for k, fits in ((WINDOW_WORDS, length >= WINDOW_WORDS), (SHORT_WINDOW_WORDS, (length < WINDOW_WORDS) & (length >= SHORT_WINDOW_WORDS))):
        rows = words.where(fits).select("item", "words", "slots", F.posexplode(_window_hashes(F.col("words"), k)).alias("at", "window"))
        inside = F.filter("slots", lambda s: (s["at"] >= F.col("at")) & (s["at"] < F.col("at") + k))
        rows = rows.select("item", F.lit(k).alias("k"), F.lit(literal).alias("literal"), "window", "at", inside.alias("slots"))
        out.append(rows.where(F.size("slots") <= (1 - LEAST_PLAIN) * k))
    return reduce(DataFrame.unionByName, out)


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, k, literal, n, window, at, slots): the windows by which items are looked for, how many of them the item has,
    and the placeholders in each. Items without a window of enough plain words have literal ones, without
    placeholders. Windows that over SHARED_ITEMS items have, such as those of a common prompt, are left to items that have
    no others. Items of under SHORT_WINDOW_WORDS words have none."""
    texts = items.select(F.col(item_id).alias("item"), _spaced(F.col(text)).alias("text")).distinct()
    words = texts.withColumn("words", template_words(F.col("text"))).withColumn("slots", template_slots(F.col("text"), F.col("words")))
    plain = saved(_item_windows(words, False))
    left = texts.join(plain.select("item").distinct(), "item", "left_anti")
    left = left.withColumn("words", literal_words(F.col("text"))).withColumn("slots", F.filter(template_slots(F.lit(""), F.array(F.lit(""))), lambda s: F.lit(False)))
    out = saved(plain.unionByName(_item_windows(left, True)))
    shared = out.groupBy("k", "literal", "window").agg(F.count_distinct("item").alias("items")).where(F.col("items") > SHARED_ITEMS)
    own = saved(out.join(small(shared), ["k", "literal", "window"], "left_anti"))
    out = saved(own.unionByName(out.join(own.select("item").distinct(), "item", "left_anti")))
    counts = out.groupBy("item").agg(F.count_distinct("at").alias("n"))
    return out.join(counts, "item")


def unsearchable(items: DataFrame, windows: DataFrame, item_id: str = "item_id") -> DataFrame:
    """The rows of items that have no window, and so are found nowhere."""
    return items.join(windows.select(F.col("item").alias(item_id)).distinct(), item_id, "left_anti")


def _key(doc_id: str, text: str) -> Column:
    """Rows with equal id and text share a key, and a verdict."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, item, share): the items found in each document, by the key of its rows, and the
    share of the item's windows that it has."""
    windows = saved(benchmark_windows(items))
    missed = unsearchable(items, windows).count()
    if missed:
        logging.getLogger(__name__).warning("%d benchmark items are too short to be looked for", missed)
    kinds = [(r["literal"], r["k"]) for r in windows.select("literal", "k").distinct().collect()]
    rows = docs.select(_key(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), _spaced(F.col(text)).alias("text"))
    hits = None
    for literal, k in sorted(kinds):
        cut = rows.select("key", "doc_id", (literal_words if literal else template_words)(F.col("text")).alias("words"))
        side = windows.where((F.col("k") == k) & (F.col("literal") == literal)).select("window", "item", "n", F.col("at").alias("item_at"))
        found = _met(cut.select("key", "doc_id", F.posexplode(_window_hashes(F.col("words"), k)).alias("at", "window")), side)
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return rows.select("key", "doc_id", F.lit(None).cast("long").alias("item"), F.lit(None).cast("double").alias("share")).limit(0)
    hits = saved(hits.select("key", "doc_id", "item", "n", "at", "item_at").distinct())
    enough = hits.groupBy("key", "doc_id", "item").agg((F.count_distinct("item_at") / F.first("n")).alias("share")).where(F.col("share") >= COVERAGE)
    enough = saved(enough)

    # Slots of the items' windows, and of the documents that have enough of them.
    slots = windows.select("item", F.col("at").alias("item_at"), F.explode("slots").alias("slot"))
    slots = slots.select("item", "item_at", F.col("slot.at").alias("slot_at"), F.col("slot.value").alias("item_value"))
    wanted = enough.select("key").distinct()
    own = rows.join(small(wanted), "key", "left_semi").dropDuplicates(["key"]).withColumn("words", template_words(F.col("text")))
    own = own.select("key", F.explode(template_slots(F.col("text"), F.col("words"))).alias("slot")).select("key", F.col("slot.at").alias("at"), F.col("slot.value").alias("value"))
    own = saved(own)
    torn = saved(_torn(hits.join(enough, ["key", "item"], "left_semi"), slots, own, ["key", "item"]))
    whole = enough.join(torn, ["key", "item"], "left_anti")
    # Several occurrences, or windows that the item has twice, may disagree: one consistent reading is enough.
    read = saved(_readings(hits.join(torn, ["key", "item"], "left_semi")))
    good = read.groupBy("key", "item", "anchor").agg((F.count_distinct("item_at") / F.first("n")).alias("share")).where(F.col("share") >= COVERAGE)
    good = good.join(_torn(read, slots, own, ["key", "item", "anchor"]), ["key", "item", "anchor"], "left_anti")
    single = enough.select("key", "item", "doc_id").distinct().join(good.groupBy("key", "item").agg(F.max("share").alias("share")), ["key", "item"])
    return whole.unionByName(single)


def _met(cut: DataFrame, side: DataFrame) -> DataFrame:
    """Windows of documents joined with those of items. Up to BROADCAST_ROWS windows of items go to the
    documents whole; up to BROADCAST_IDS hashes do so as a filter, so that only what it passes is shuffled;
    beyond that all windows are."""
    if fits(side, BROADCAST_ROWS):
        return cut.join(F.broadcast(side), "window")
    hashes = side.select("window").distinct()
    if fits(hashes, BROADCAST_IDS):
        cut = cut.join(F.broadcast(hashes), "window", "left_semi")
    return cut.join(side.hint("merge"), "window")


def _torn(hits: DataFrame, slots: DataFrame, own: DataFrame, by: list[str]) -> DataFrame:
    """The groups of hits in which an item's value stands for several others, or several for one other."""
    aligned = hits.join(slots, ["item", "item_at"]).select(*by, "item_value", (F.col("at") - F.col("item_at") + F.col("slot_at")).alias("at")).distinct()
    pairs = aligned.join(own, ["key", "at"]).select(*by, "item_value", "value").distinct()
    same = F.max(F.col("value") == F.col("item_value"))
    sides = [pairs.groupBy(*by, side).agg(F.count("*").alias("others"), same.alias("same")) for side in ("item_value", "value")]
    bad = [side.where("others > 1 AND NOT same").select(*by) for side in sides]
    return bad[0].unionByName(bad[1]).distinct()


def _readings(hits: DataFrame) -> DataFrame:
    """hits by the occurrence (anchor) that they are read as part of.

    Each alignment (place in the document less that in the item) is the anchor of one occurrence. Others
    up to half the item's windows away fill in what it leaves, as where words were put in or left out: each
    window of the item, and of the document, goes to the anchor if it can, else to the alignment with
    most windows.
    """
    placed = hits.select("key", "item", "n", "at", "item_at", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    shifts = placed.groupBy("key", "item", "shift").agg(F.count("*").alias("size"))
    # Neighbours by buckets of that width: an equi-join.
    spans = placed.groupBy("item").agg(F.greatest(F.max("n").cast("long"), F.lit(2)).alias("n"))
    reach = F.ceil(F.col("n") / 2)
    shifts = shifts.join(spans, "item").select("key", "item", "shift", "size", reach.alias("reach"), F.floor(F.col("shift") / reach).alias("bucket"))
    anchors = shifts.select("key", "item", F.col("shift").alias("anchor"), "reach", F.explode(F.array(F.col("bucket") - 1, "bucket", F.col("bucket") + 1)).alias("bucket"))
    pairs = anchors.join(shifts.drop("reach"), ["key", "item", "bucket"]).where(F.abs(F.col("anchor") - F.col("shift")) <= F.col("reach"))
    read = placed.join(pairs.select("key", "item", "shift", "anchor", "size"), ["key", "item", "shift"])
    best = F.struct((F.col("shift") == F.col("anchor")).alias("own"), F.col("size"), (-F.abs(F.col("shift") - F.col("anchor"))).alias("near"), F.col("shift"))
    read = read.withColumn("best", best)
    for side in ("item_at", "at"):
        read = read.withColumn(f"top_{side}", F.max("best").over(Window.partitionBy("key", "item", "anchor", side)))
    return read.where("best = top_item_at AND best = top_at").select("key", "item", "n", "anchor", "at", "item_at")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, contaminated and items (sorted ids of the items found) of each row of docs.

    Null and empty texts are clean; so is everything if there are no items. Repeated rows get the same
    verdict each; texts of any length are searched whole. Items of one id count as one item. Items with a null text or under SHORT_WINDOW_WORDS words are found nowhere; a warning says
    how many these are. Items of mostly placeholders are found with their own values only. A text that has but the prompt
    that many items begin with is clean.
    """
    found = matches(docs, items, doc_id, text).groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), _key(doc_id, text).alias("key"))
    none = F.array().cast(found.schema["items"].dataType)
    return rows.join(small(saved(found), weight=F.size("items")), "key", "left").select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"))


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs in which no item is found, with their own columns."""
    own, names, back = numbered(docs)
    found = saved(matches(own, items, names[doc_id], names[text]).select("key").distinct())
    return own.join(small(found, BROADCAST_IDS), _key(names[doc_id], names[text]) == F.col("key"), "left_anti").select(*back)
