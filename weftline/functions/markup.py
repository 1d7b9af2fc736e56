"""Column expressions on HTML tokens: tags, attributes, character references."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comments, elements without text of their own, declarations, tags and text, in order. What is never closed ends
#: with the page; a tag holds no angle bracket.
TOKEN = r"(?is)<!--(?:.*?-->|.*)|<(script|style|noscript|iframe|svg)\b[^<>]*>(?:.*?</\1\s*>|.*)|<[!?][^<>]*>|</?[a-z][^<>]*>|[^<]+|<"
SILENT = r"(?is)\A<(?:[!?]|(?:script|style|noscript|iframe|svg)\b)"
TAG = r"(?is)\A</?[a-z][^<>]*>\z"

#: Character references: numbers, names with a semicolon, and those that need none where no letter, digit or = follows.
REFERENCE = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|[A-Za-z][A-Za-z0-9]{1,31}(?:;|(?![A-Za-z0-9;=])))"
CLOSED = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: The standard's names, and what the numbers of control characters stand for.
NAMED = {name: sign for name, sign in html5.items()} | {f"#{n}": bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}


def unescaped(text: Column, closed: bool = False) -> Column:
    """Text with its character references replaced; what no name is known for stays. closed: only references that end
    with a semicolon, where texts are cut at any place and the rest of one is to be seen."""
    form = CLOSED if closed else REFERENCE
    # Folded into one literal when the plan is made.
    named = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")

    def of(reference: Column) -> Column:
        digits = F.regexp_extract(reference, "[0-9a-fA-F]+", 0)
        number = F.when(F.lower(F.substring(reference, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        known = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        sign = F.when(number.between(128, 159), F.element_at(named, F.concat(F.lit("#"), number.cast("string")))).when(known, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("�")
        return F.when(F.startswith(reference, F.lit("&#")), sign).otherwise(F.coalesce(F.element_at(named, F.substr(reference, F.lit(2))), reference))

    zipped = F.arrays_zip(F.split(text, form, -1).alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(0)), of).alias("sign"))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(zipped, lambda x: F.concat(x["gap"], F.coalesce(x["sign"], F.lit("")))), "")).otherwise(text)


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"\A</?([a-zA-Z][a-zA-Z0-9]*)", 1))


def attribute(token: Column, name: str) -> Column:
    """The value of a tag's attribute; '' without."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return unescaped(F.concat(*[F.regexp_extract(token, pattern, i) for i in (1, 2, 3)]))


def selected(selector: str, name: Column, ident: Column, classes: Column, role: Column) -> Column:
    """Whether a tag is what a selector of an element, #id, .class or [role=...] names."""
    sign = next((mark for mark in ("#", ".", "[role=") if mark in selector), "")
    element, _, value = selector.rstrip("]").partition(sign) if sign else (selector, "", "")
    out = (name == element) if element else F.lit(True)
    if sign == "#":
        out = out & (ident == value)
    elif sign == ".":
        out = out & F.array_contains(classes, value)
    elif sign:
        out = out & (role == value)
    return out
