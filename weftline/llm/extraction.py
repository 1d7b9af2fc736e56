"""Main text of HTML pages by the maximum-scoring subsequence (operator 1).

A page is a sequence of words and tags. Each word scores by its context: the elements and the words of
the class, id and role attributes around it, the size and share of links of the block that it stands
in, phrases such as "all rights reserved" in a part of the page apart from most of its words, and the
heading of such a part; each tag costs by its name. The weights are log odds, counted over labelled pages (those whose
main text an ``article`` or ``main`` element marks) on top of a stated prior. Nothing is left out before
the scan: one linear scan finds the contiguous region with the highest total, and by the same rule what is
better cut from it. A cut costs a fixed amount and a share of what the words cut would have cost, so that a
short advert doesn't part an article and what stands behind a long one must be worth it. The marks serve as
labels and are not read when a page is scored, but for one thing: a header within a section or article is
not the page's.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.storage import sampled

#: Pages looked at for weights: about so many at most, those with the smallest hash; the marked ones among them count.
TRAINING_PAGES = 5000
#: A learned class of context or tag must be on so many of these pages at least.
LEAST_PAGES = 3

# Element names of HTML, and words of class, id and role attributes.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u",
    "var", "wbr", "img",
}
CLOSES = {  # an opening tag of the key ends an open element of the values
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
MARKS = {"article", "main"}
# Elements that say nothing about what is in them, and parts of lists and tables, which count with the whole.
PLAIN = INLINE | MARKS | {
    "html", "body", "div", "section", "center", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot",
    "tr", "td", "th", "summary", "details",
}
PARTS = {"li", "dt", "dd", "thead", "tbody", "tfoot", "tr", "td", "th"}
# The prior: so many pages with a class of context outside (first) or inside (second) the main text.
OUTSIDE_ELEMENTS = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "fieldset", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "map"}
INSIDE_ELEMENTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption"}
OUTSIDE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "banner",
    "banners", "sponsor", "sponsored", "promo", "promotion", "promoted", "nav", "navbar", "navigation", "navigations",
    "menu", "menubar", "menus", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "aside", "complementary", "footer",
    "contentinfo", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "commentlist",
    "disqus", "respond", "replies", "reply", "social", "related", "recommended", "recommendations", "widget", "widgets",
    "pagination", "pager", "toolbar", "alert", "alertdialog", "dialog", "disclaimer", "copyright",
}
# Words that may stand around or inside an article, too.
DOUBTFUL_WORDS = {"header", "masthead", "search", "discussion", "share", "sharing"}
# In "has-sidebar" or "no-ads" the second word doesn't say what the element is.
TURNING = {"has", "with", "no", "not", "without", "is"}
# Phrases of boilerplate; these open or fill a short block of their own.
HEADINGS = {
    "comments": r"\d* ?(?:reader |user )?(?:comments?|replies|responses)(?: \(?\d+\)?)?:?$|(?:\d+|one) (?:comments?|thoughts?|responses?|repl(?:y|ies)) (?:on|to)\b|(?:leave|post|add|write) (?:a|your) (?:comment|reply)\b|join the (?:discussion|conversation)\b",
    "more": r"(?:most|also|recommended|popular|trending|related|latest|recent|further|more) (?:read|popular|viewed|shared|stories|articles|posts|news|reading|from|links|topics)\b.{0,40}$|you (?:may|might) (?:also )?(?:like|enjoy)\b|read (?:next|also|more)\b.{0,40}$|(?:related|popular|trending)$",
}
PHRASES = {
    "rights": r"all rights reserved|(?:^|\s)(?:©|\(c\)|copyright) ",
    "subscribe": r"^(?:subscribe|sign up|log in|follow us|share this|share on|join our)\b|(?:our|free|weekly|daily) newsletter",
    "consent": r"\b(?:uses?|accept) (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)",
    "advert": r"^(?:advertisement|sponsored|advertising)\b|^(?:buy|order|shop) now\b",
}
# Words that say where in a page something is or what it is made of, not what it is about.
STRUCTURE = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "column", "container", "content",
    "entry", "footer", "form", "group", "head", "header", "heading", "icon", "icons", "inner", "item", "items",
    "label", "law", "left", "link", "links", "list", "main", "message", "middle", "outer", "page", "panel", "policy", "post",
    "posts", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "stories", "text", "thread", "title",
    "top", "unit", "wrap", "wrapper", "zone",
}
PRIOR = {
    **{("heading", x): (40.0, 0.0) for x in HEADINGS},
    **{("phrase", x): (40.0, 0.0) for x in PHRASES},
    **{("element", x): (40.0, 0.0) for x in OUTSIDE_ELEMENTS},
    **{("element", x): (1.0, 8.0) for x in INSIDE_ELEMENTS},
    ("element", "header"): (40.0, 0.0),
    ("element", "inner header"): (1.0, 1.0),
    **{("word", x): (40.0, 0.0) for x in OUTSIDE_WORDS},
    **{("mixed", x): (3.0, 0.5) for x in OUTSIDE_WORDS},
    **{("word", x): (3.0, 0.0) for x in DOUBTFUL_WORDS},
    ("links", "most"): (8.0, 1.0),
    ("links", "some"): (1.0, 1.0),
    ("links", "few"): (2.0, 3.0),
    ("size", "2"): (4.0, 1.0),
    ("size", "9"): (3.0, 2.0),
    ("size", "29"): (2.0, 3.0),
    ("size", "more"): (1.0, 6.0),
}

#: Phrases are looked for in blocks of so many words at most; a heading has fewer.
PHRASE_WORDS, HEADING_WORDS = 40, 8

#: Bounds of weights: of a context for and against, of a block's size and links, and of a tag's cost. A
#: plain word outweighs the tags of a paragraph, so that short paragraphs stay.
MOST_FOR, MOST_AGAINST, MOST_BLOCK = 1.5, 4.0, 0.6
LEAST_COST, MOST_COST = 0.01, 0.15
#: What a cut costs at least, and its share of what the words cut from the region would cost there.
CUT_COST, CUT_SHARE = 1.0, 0.02
#: An element with so much of a page's words is no boilerplate if what else there is has under this share of its words.
WRAPPER_SHARE, LITTLE_ELSE = 0.5, 0.1

#: Weights of blocks where only short ones are.
SHORT_BLOCKS = {("links", "few"): 1.0, ("links", "some"): 1.0, ("links", "most"): -1.0}

Feature = tuple[str, str]
Weights = dict[Feature, float]

_NEXT = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_IN_TAG = re.compile(r">|=\s*[\"']")
_COMMENT_END = re.compile(r"--!?>")
_NAMING = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADINGS = [(("heading", name), re.compile(x, re.I)) for name, x in HEADINGS.items()]
_PHRASES = [(("phrase", name), re.compile(x, re.I)) for name, x in PHRASES.items()]


@lru_cache(maxsize=50_000)
def _naming_words(values: str) -> tuple[Feature, ...]:
    """The words of class, id and role values; names with a turning word have none. A word of boilerplate
    in a name with words of content ("social-history") is another feature, as it may be the matter."""
    out: dict[Feature, None] = {}
    for part in html_lib.unescape(values).split():
        words = _WORD.findall(_HUMP.sub("-", part).lower())
        if TURNING.isdisjoint(words):
            mixed = any(len(w) > 2 and w not in OUTSIDE_WORDS and w not in DOUBTFUL_WORDS and w not in STRUCTURE for w in words)
            out.update(dict.fromkeys(("mixed" if mixed and w in OUTSIDE_WORDS else "word", w) for w in words))
    return tuple(out)


def _said(text: str, n: int) -> tuple[Feature, ...]:
    """The phrases of boilerplate in a block of n words."""
    short = " ".join(text.split())
    out = tuple(f for f, x in _PHRASES if x.search(short))
    if n <= HEADING_WORDS:
        out += tuple(f for f, x in _HEADINGS if x.match(short))
    return out


def _features(name: str, attributes: str, within: bool) -> tuple[Feature, ...]:
    """What an element (within a section or not) says about the words in it."""
    own = () if name in PLAIN else (("element", f"inner {name}" if within and name == "header" else name),)
    if "=" in attributes and name not in ("html", "body"):
        values = " ".join("".join(x) for x in _NAMING.findall(attributes))
        if values:
            return own + _naming_words(values)
    return own


class Page:
    """A page as a sequence of items (element, block, text, tag): a text, or a tag's name with text None.

    element numbers what the item stands in. Block numbers grow where an element begins or ends a
    block. Of each element: parents, features, in_mark, and unit, the element whose words and links
    count as those of its texts.
    """

    def __init__(self, source: str):
        self.items: list[tuple[int, int, str | None, str]] = []
        self.parents, self.features, self.in_mark, self.unit, self.is_link, self.headed, self.holder = [-1], [()], [False], [0], [False], [False], [0]
        self._stack, self._names = [0], [""]
        self._open: Counter[str] = Counter()
        self._block = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = _NEXT.search(source, at)
            if not found:
                break
            start = found.start()
            after = self._markup(source, start)
            if after is None:  # what begins here ends nowhere: it is text
                break
            if start > at:
                self._text(source[at:start])
            at = after
            if self._pending:
                at = self._tag(source, at, *self._pending)
        if at < end:
            self._text(source[at:end])

    def _markup(self, source: str, start: int) -> int | None:
        """Where the markup at start ends; a tag is left in _pending. Each place of the page is looked at
        a bounded number of times, whatever is unclosed."""
        self._pending = None
        if source.startswith("<!--", start):
            if source.startswith((">", "->"), start + 4):
                return source.index(">", start + 4) + 1
            close = _COMMENT_END.search(source, start + 4)
            return close.end() if close else len(source)
        closing = source.startswith("/", start + 1)
        name = _NAME.match(source, start + 1 + closing)
        if not name:
            close = source.find(">", start)
            return close + 1 if close >= 0 else None
        at = name.end()
        while True:
            sign = _IN_TAG.search(source, at)
            if not sign:
                return None
            at = sign.end()
            if sign[0] == ">":
                break
            close = source.find(sign[0][-1], at)
            if close < 0:  # an open quotation: the tag ends at its next end sign
                close = source.find(">", at)
                if close < 0:
                    return None
                at = close + 1
                break
            at = close + 1
        self._pending = (closing, name[0].lower(), source[name.end() : at - 1])
        return at

    def _tag(self, source: str, at: int, closing: bool, name: str, attributes: str) -> int:
        """Takes in a tag that ends at at; returns where to read on."""
        if name not in INLINE:
            self._block += 1
        self.items.append((self._stack[-1], self._block, None, name))
        if closing:
            if self._open[name]:
                while self._pop() != name:
                    pass
            elif name == "br":
                self._text(" ")
            return at
        while self._names[-1] in CLOSES.get(name, ()):
            self._pop()
        if name == "body" and self._open["head"]:  # an unclosed head ends here
            while self._pop() != "head":
                pass
        if name in VOID:
            if name == "br":
                self._text(" ")
            return at
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            return close.end() if close else len(source)
        if attributes.endswith("/") and name in ("svg", "path", "circle", "use", "rect"):
            return at
        above, this = self._stack[-1], len(self.parents)
        self.parents.append(above)
        self.features.append(_features(name, attributes, self._open["article"] + self._open["section"] > 0))
        self.in_mark.append(self.in_mark[above] or name in MARKS)
        self.unit.append(self.unit[above] if name in INLINE or name in PARTS else this)
        self.is_link.append(self.is_link[above] or name == "a")
        self.headed.append(False)
        self.holder.append(self.holder[above] if name in INLINE or name in PARTS or name in INSIDE_ELEMENTS else this)
        if len(name) == 2 and name[0] == "h" and name[1] in "23456":
            self.headed[above] = True
        self._stack.append(this)
        self._names.append(name)
        self._open[name] += 1
        return at

    def _pop(self) -> str:
        self._stack.pop()
        name = self._names.pop()
        self._open[name] -= 1
        return name

    def _text(self, text: str) -> None:
        self.items.append((self._stack[-1], self._block, html_lib.unescape(text), ""))

    def measure(self) -> None:
        """Words of each text and within each element, and the (size, links) features of each unit."""
        own = [0] * len(self.parents)
        self.words = [0 if text is None else len(text.split()) for _, _, text, _ in self.items]
        of_unit, of_links = dict.fromkeys(self.unit, 0), dict.fromkeys(self.unit, 0)
        for (e, _, text, _), n in zip(self.items, self.words, strict=True):
            if text is not None:
                own[e] += n
                unit = self.unit[e]
                of_unit[unit] += n
                if self.is_link[e]:
                    of_links[unit] += n
        for e in range(len(own) - 1, 0, -1):  # parents come before their children
            own[self.parents[e]] += own[e]
        self.inside = own
        self.block_features = {u: (_size(n), _links(of_links[u] / n if n else 0.0)) for u, n in of_unit.items()}
        self._listen()

    def _listen(self) -> None:
        """What blocks say (said), where what holds them hasn't most of the page's words. A heading that such an
        element begins with says it of the element; one of comments does so of any."""
        parts: dict[int, list[str]] = {}
        where: dict[int, tuple[int, int]] = {}
        for (e, block, text, _), n in zip(self.items, self.words, strict=True):
            if n:
                parts.setdefault(block, []).append(text)
                first, total = where.get(block, (e, 0))
                where[block] = (first, total + n)
        self.said: dict[int, tuple[Feature, ...]] = {}
        started = {0}
        for block, (e, n) in where.items():
            said = _said("".join(parts[block]), n) if n <= PHRASE_WORDS else ()
            around = self.holder[e]
            if said and 2 * self.inside[around] <= self.inside[0]:
                self.said[block] = said
            comments = ("heading", "comments") in said and self.headed[around]
            if around not in started and (block in self.said or comments):
                self.features[around] += tuple(f for f in said if f[0] == "heading")
            while e not in started:  # an element has one beginning
                started.add(e)
                e = self.parents[e]

    def shares(self) -> dict[tuple[str, str, bool], float]:
        """Of a marked page: for each class of context, of block and of tag, its share of the words (tags)
        inside the main text, and of those outside. Empty without a mark."""
        if not any(self.in_mark):
            return {}
        self.measure()
        out: dict[tuple[str, str, bool], float] = {}
        totals = {"words": [0.0, 0.0], "tags": [0.0, 0.0]}
        around: dict[int, frozenset[Feature]] = {-1: frozenset(), 0: frozenset()}
        for (e, block, text, tag), n in zip(self.items, self.words, strict=True):
            where = self.in_mark[e]
            if text is None and tag not in MARKS:
                totals["tags"][where] += 1
                out["tag", tag, where] = out.get(("tag", tag, where), 0) + 1
            if not n:
                continue
            totals["words"][where] += n
            for f in self._around(e, around) | set(self.block_features[self.unit[e]]) | set(self.said.get(block, ())):
                out[(*f, where)] = out.get((*f, where), 0) + n
        return {k: n / (totals["tags" if k[0] == "tag" else "words"][k[2]] or 1) for k, n in out.items()}

    def _around(self, e: int, known: dict[int, frozenset[Feature]]) -> frozenset[Feature]:
        chain = []
        while e not in known:
            chain.append(e)
            e = self.parents[e]
        found = known[e]
        for e in reversed(chain):
            if self.features[e]:
                found = found.union(self.features[e])
            known[e] = found
        return found

    def contexts(self, weights: Weights, excused: bool) -> list[float]:
        """A score of each element's place: the best sign for main text among what is around it, and the
        worst against. excused: elements with most of the page's words have no sign against."""
        best, worst = [0.0], [0.0]
        most = WRAPPER_SHARE * self.inside[0]
        for e in range(1, len(self.parents)):
            up = self.parents[e]
            own = sum(weights.get(f, 0.0) for f in self.features[e]) if self.features[e] else 0.0
            if own < 0 and excused and self.inside[e] >= most:
                own = 0.0
            best.append(max(best[up], min(own, MOST_FOR)))
            worst.append(min(worst[up], max(own, -MOST_AGAINST)))
        return [b + w for b, w in zip(best, worst, strict=True)]

    def main_text(self, weights: Weights) -> str:
        """The text of the best region. On a page of short blocks only, where none scores above zero, sizes
        don't count: every word does that is not in boilerplate nor among links."""
        self.measure()
        found = self._region(weights, False)
        wider = self._region(weights, True)
        if wider[1] and found[1] < LITTLE_ELSE * wider[1]:
            found = wider
        if not found[1]:
            found = self._region({f: w for f, w in weights.items() if f[0] in ("element", "word")} | SHORT_BLOCKS, False)
        return found[0]

    def scores(self, weights: Weights, excused: bool) -> list[float]:
        """The score of each item: words by their context, their block and what it says; tags cost."""
        context = self.contexts(weights, excused)
        of_block = {u: sum(weights.get(f, 0.0) for f in fs) for u, fs in self.block_features.items()}
        of_said = {block: max(sum(weights.get(f, 0.0) for f in fs), -MOST_AGAINST) for block, fs in self.said.items()}
        return [
            weights.get(("tag", tag), -LEAST_COST) if text is None else n * (context[e] + of_block[self.unit[e]] + of_said.get(block, 0.0)) if n else 0.0
            for (e, block, text, tag), n in zip(self.items, self.words, strict=True)
        ]

    def _region(self, weights: Weights, excused: bool) -> tuple[str, int]:
        """The text that is left of the best region, and its number of words."""
        blocks: dict[int, list[str]] = {}
        n_words = 0
        for first, last in best_region(self.scores(weights, excused)):
            for i in range(first, last):
                _, block, text, _ = self.items[i]
                if text is not None:
                    blocks.setdefault(block, []).append(text)
                    n_words += self.words[i]
        joined = (" ".join("".join(parts).split()) for parts in blocks.values())
        return " ".join(x for x in joined if x), n_words


def _size(n: int) -> Feature:
    return ("size", "2" if n <= 2 else "9" if n <= 9 else "29" if n <= 29 else "more")


def _links(share: float) -> Feature:
    return ("links", "few" if share < 1 / 3 else "some" if share < 3 / 4 else "most")


def best_region(scores: list[float], cost: float = CUT_COST, share: float = CUT_SHARE) -> list[tuple[int, int]]:
    """What is left of the contiguous region with the greatest sum: from and to which items (exclusive), in
    order. Within it, runs of items may be cut: a cut counts -cost, and each item cut that is below zero
    share of its score, in place of the scores of what is cut. Of regions that tie the first to end, of those
    the one that keeps most at its end. Empty if no sum is above zero. Takes one pass, and one back.
    """
    best, best_at = 0.0, -1
    kept = cut = -math.inf  # the best sums of what ends here with an item kept, and with one cut
    came = bytearray(len(scores))  # 1: kept after a cut one; 2: kept as the first; 4: cut as the first of a cut
    for i, score in enumerate(scores):
        lost = share * score if score < 0 else 0.0
        how = 0
        before, how = (kept, 0) if kept >= cut else (cut, 1)
        if before < 0:
            before, how = 0.0, 2
        if kept - cost >= cut:
            cut = kept - cost
            how += 4
        cut += lost
        kept = before + score
        came[i] = how
        if kept > best:
            best, best_at = kept, i
    parts, at = [], best_at
    while at >= 0:
        last = at + 1
        while not came[at] & 3:
            at -= 1
        parts.append((at, last))
        if came[at] & 2:
            break
        at -= 1
        while not came[at] & 4:
            at -= 1
        at -= 1
    return parts[::-1]


def weights_from(shares: dict[tuple[str, str, bool], float]) -> Weights:
    """Log odds of standing inside the main text, from sums of pages' shares on top of the prior, with half
    a page added to each side. A tag's weight is a cost: how much more at home it is outside."""
    out = {}
    for kind, name in {k[:2] for k in shares} | set(PRIOR):
        outside, inside = PRIOR.get((kind, name), (0.0, 0.0))
        odds = math.log((inside + shares.get((kind, name, True), 0.0) + 0.5) / (outside + shares.get((kind, name, False), 0.0) + 0.5))
        if kind == "tag":
            odds = -min(MOST_COST, max(LEAST_COST, -odds))
        elif kind in ("size", "links"):
            odds = min(MOST_BLOCK, max(-MOST_BLOCK, odds))
        else:
            odds = min(MOST_FOR, max(-MOST_AGAINST, odds))
        out[kind, name] = odds
    return out


#: The prior alone, for pages without labelled ones.
PRIOR_WEIGHTS = weights_from({})


def learn_weights(pages: DataFrame, url: str = "url", html: str = "html", limit: int = TRAINING_PAGES) -> Weights:
    """Weights from the labelled pages in a bounded sample: the result is a table of what LEAST_PAGES of
    these have. Equal rows count once. Without labelled pages the prior holds."""
    sample = sampled(pages.select(F.col(url).alias("u"), F.col(html).alias("h")), ["u", "h"], limit)
    sample = sample.where(F.col("h").rlike(r"(?i)<(?:article|main)[\s>]")).select("h")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*k, n) for source in batch["h"] for k, n in Page(source).shares().items()]
            yield pd.DataFrame(rows, columns=["kind", "name", "inside", "n"])

    counted = sample.mapInPandas(count, "kind string, name string, inside boolean, n double").groupBy("kind", "name", "inside")
    counted = counted.agg(F.round(F.sum("n"), 6).alias("n"), F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    return weights_from({(r["kind"], r["name"], r["inside"]): r["n"] for r in counted.collect()})


def main_text(pages: DataFrame, url: str = "url", html: str = "html", weights: Weights | None = None) -> DataFrame:
    """pages with text and n_chars (code points) instead of columns of these names.

    Null and empty pages give an empty text, pages without tags their words. Broken markup is read as far
    as it goes: unclosed elements end with the page, comments and scripts at their own end or the page's;
    a tag that never ends is text. Time and memory grow with a page's length, however long or deep it
    is. Of regions that tie, the one that ends first is taken. Repeated rows are treated one by one.
    """
    learned = learn_weights(pages, url, html) if weights is None else weights

    @F.pandas_udf(T.StringType())
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([Page(x).main_text(learned) if x else "" for x in batch], dtype=object)

    made = extract(F.col(html))
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    return pages.select(*keep, made.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
