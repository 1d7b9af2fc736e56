"""Column expressions on text: query tokens, feature hashing, chunk ids, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number of buckets of feature hashing; FNV-1a's 32-bit parameters (fixed values).
BUCKETS = 1 << 17
FNV_BASIS = 2166136261
FNV_PRIME = 16777619
UUID_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def query_tokens(text: Column) -> Column:
    """Lower-cased words without outer punctuation; trailing dots and repeats stay. Null gives null."""
    words = F.split(F.lower(text), r"(?U)\s+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"(?U)^[^\w]+|[^\w.]+$", "")), lambda w: w != "")


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a string's UTF-8 bytes, as a long."""
    codes = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(codes) > 0, F.sequence(F.lit(1), (F.length(codes) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(at, lambda i: F.conv(F.substring(codes, i * 2 - 1, 2), 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(FNV_BASIS).cast("long"), lambda h, b: h.bitwiseXOR(b) * FNV_PRIME % F.lit(1 << 32))


def bucket(token: Column) -> Column:
    return F.pmod(fnv1a(token), F.lit(BUCKETS)).cast("int")


def url_hash(url: Column) -> Column:
    return F.substring(F.md5(F.encode(url, "UTF-8")), 1, 6)


def chunk_id(anchor: Column, sub_index: Column, url: Column) -> Column:
    """anchor slug, piece number and page hash, joined by two underscores."""
    bare = F.regexp_replace(anchor, "^#+", "")
    slug = F.regexp_replace(F.regexp_replace(bare, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    return F.concat_ws("__", slug, sub_index.cast("string"), url_hash(url))


def point_id(chunk: Column) -> Column:
    """The version-5 UUID of a chunk id in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(UUID_URL_NAMESPACE)), F.encode(chunk, "UTF-8")))
    variant = F.conv(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16)
    parts = [
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(variant), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    ]
    return F.concat_ws("-", *parts)


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def heading_text(text: Column) -> Column:
    """A heading without trailing white space and permalink signs."""
    return F.regexp_replace(text, r"(?U)[\s#¶]+$", "")


def symbol_text(text: Column, runs: bool = True) -> Column:
    """A signature without a trailing source link or permalink, with a space after each comma. runs: after each of
    several commas in a row; else a comma is set apart from the sign after it, which then is no start of its own."""
    bare = F.regexp_replace(text, r"(?U)\s*(?:\[source\]|[#¶])+\s*$", "")
    return F.regexp_replace(bare, r"(?U),(?!\s)", ", ") if runs else F.regexp_replace(bare, r",([^ \t\n\f\r])", ", $1")


def tidy_lines(text: Column) -> Column:
    """Runs of three and more line feeds become two; then lines lose white space at their ends."""
    short = F.regexp_replace(text, "\n{3,}", "\n\n")
    return strip(F.regexp_replace(short, r"(?m)[^\S\n]+$", ""))


def title_text(title: Column, suffix: str) -> Column:
    """A page title without a site's suffix (a pattern after a dash); Untitled if none is left."""
    bare = strip(F.regexp_replace(title, rf"\s*[—–-]\s*{suffix}.*$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("Untitled"))


def heading_words(label: Column) -> Column:
    """Identifiers of at least three characters in a heading."""
    return F.filter(F.regexp_extract_all(label, F.lit(r"([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1)), lambda w: F.length(w) >= 3)


def page_keywords(module: Column, sections: Column) -> Column:
    """A page's keywords in order of first appearance, case kept.

    module, its dotted parts; then of each section (label, symbol, params) the heading's words, the
    symbol, its last part and the parameters.
    """
    own = F.when(F.coalesce(module, F.lit("")) != "", F.concat(F.array(module), F.split(module, r"\."))).otherwise(F.array().cast("array<string>"))

    def of(s: Column) -> Column:
        symbol = F.coalesce(s["symbol"], F.lit(""))
        names = F.array(symbol, F.element_at(F.split(symbol, r"\."), -1))
        return F.when(symbol == "", heading_words(s["label"])).otherwise(F.concat(names, F.coalesce(s["params"], F.array().cast("array<string>"))))

    return F.filter(F.array_distinct(F.concat(own, F.flatten(F.transform(sections, of)))), lambda w: w != "")


def chunk_keywords(page: Column, symbol: Column, params: Column) -> Column:
    """A page's keywords and, for a chunk with a symbol, the symbol, its parts and its parameters."""
    parts = F.split(symbol, r"\.")
    own = F.concat(F.array(symbol), parts, F.array(F.element_at(parts, -1)), F.coalesce(params, F.array().cast("array<string>")))
    return F.when(F.coalesce(symbol, F.lit("")) == "", page).otherwise(F.filter(F.array_distinct(F.concat(page, own)), lambda w: w != ""))


def shortened(text: Column, most: int, keep: int, sign: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit(sign))).otherwise(text)


def html_escaped(text: Column) -> Column:
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(reference))
    return text


def id_list(text: Column) -> Column:
    """Numbers of a comma-separated list; blanks are dropped."""
    parts = F.filter(F.split(text, ","), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.trim(x).cast("long"))


def question_id(number: Column) -> Column:
    return F.format_string("Q%02d", number)
