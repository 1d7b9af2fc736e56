"""HTML pages to title, Markdown and section markers, by windows over their tokens.

A page is exploded into its tags and texts. A closing tag meets its opening tag as the row before it at
the same level of elements of its name; running sums of opened and closed elements then say of each
token what it stands in. Tokens between tags of blocks are grouped to blocks, blocks to rows of tables
and these to pages. Work on a page grows with its length, and no task holds more than one page at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import schemas
from weftline.functions import markup, text
from weftline.storage import saved

# Element names of HTML, and what documentation generators write.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
BLOCKS = [
    "p", "div", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "pre", "section", "article", "main", "blockquote", "header",
    "footer", "nav", "aside", "form", "figure", "figcaption", "hr", "body", *HEADINGS,
]
# Signs of inline elements, each as a character of private use until white space within them is trimmed.
SIGNS = {"code": "\ue010", "b": "\ue011", "strong": "\ue011", "em": "\ue012", "i": "\ue012"}
SHOWN = {"\ue010": "`", "\ue011": "**", "\ue012": "*"}
NOISE = [
    ".headerlink", ".viewcode-link", ".bd-toc", ".bd-sidebar-secondary", "#sphinx-search", "#google-search", "#searchbox", ".edit-on-github",
    "div.clearer", ".toggle-header", "#cookie-consent-banner", "div[role=search]", "form.search",
]
MAIN = [
    "article#pytorch-article", "article.bd-article", "div.pytorch-article", "article[role=main]", "div[role=main]", "div.body",
    "section#pytorch-documentation", "div#pytorch-documentation", "main", "div.document", "body",
]
TITLED = ["article#pytorch-article", "article.bd-article", "div[role=main]", "article", ".pytorch-article"]
KINDS = ["function", "class", "method", "staticmethod", "classmethod", "attribute", "property", "data", "exception", "decorator", "decoratormethod"]
LANGUAGES = {"python": "python", "py": "python", "cpp": "cpp", "c++": "cpp", "bash": "bash", "sh": "bash", "shell": "bash", "text": "text", "output": "text", "default": "text"}
ADMONITIONS = {
    "note": "Note", "warning": "Warning", "tip": "Tip", "deprecated": "Deprecated", "versionadded": "Version added",
    "versionchanged": "Version changed", "danger": "Danger", "caution": "Caution", "important": "Important",
}
TITLE_SUFFIX = "PyTorch"


def _first_of(found: list[tuple[Column, object]]) -> Column:
    """The value of the first condition that holds; null if none does."""
    out = F.lit(None)
    for condition, value in reversed(found):
        out = F.when(condition, value).otherwise(out)
    return out


def _class_in(classes: Column, known: list[str]) -> Column:
    return F.get(F.filter(classes, lambda c: c.isin(known)), F.lit(0))


def _by_page(rows: DataFrame) -> DataFrame:
    """Few bytes may be much work: a stated number of partitions, which Spark leaves as it is."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page")


def tokens(raw: DataFrame, closed: bool = False) -> DataFrame:
    """(page, url, pos, tag, open, name, id, cls, el, step, ...) of (url, html); equal rows count once.

    el: what the tag's element is (on its opening and its closing tag), step: 1 where an element that is
    closed later opens, -1 where it closes. Sums of steps so far are the n_ columns. closed: of texts' character references,
    only those with a semicolon are decoded.
    """
    pages = _by_page(raw.select("url", "html", F.xxhash64("url", "html").alias("page")).dropDuplicates(["page"]))
    # The tokens are cut out before they are numbered; Spark would do so twice in one step.
    cut = pages.select("page", "url", F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(markup.TOKEN), F.lit(0)).alias("tokens"))
    each = cut.select("page", "url", F.posexplode("tokens").alias("pos", "token")).where(~F.col("token").rlike(markup.SILENT))
    tag = F.col("token").rlike(markup.TAG)
    each = each.select("page", "url", "pos", "token", tag.alias("tag"), (tag & ~F.startswith("token", F.lit("</"))).alias("open"), F.when(tag, markup.tag_name(F.col("token"))).otherwise("").alias("name"))
    has = F.col("open") & F.contains("token", F.lit("="))
    of_tag = {f"a_{n}": F.when(has, markup.attribute(F.col("token"), n)).otherwise("") for n in ("id", "class", "role", "href")}
    each = each.withColumns({**of_tag, "text": F.when(~F.col("tag"), markup.unescaped(F.col("token"), closed))}).drop("token")
    each = each.withColumn("cls", F.split("a_class", r"\s+"))

    def is_(selector: str) -> Column:
        return markup.selected(selector, F.col("name"), F.col("a_id"), F.col("cls"), F.col("a_role"))

    highlight = F.get(F.filter("cls", lambda c: F.startswith(c, F.lit("highlight-")) & (c != "highlight-notranslate")), F.lit(0))
    py = (F.col("name") == "dl") & F.array_contains("cls", "py") & ~F.array_contains("cls", "field-list")
    own = {
        "noise": reduce(lambda a, b: a | b, [is_(s) for s in NOISE]),
        "main": _first_of([(is_(s), i) for i, s in enumerate(MAIN)]),
        "titled": _first_of([(is_(s), i) for i, s in enumerate(TITLED)]),
        "section": F.col("name") == "section",
        "highlight": F.substr(highlight, F.lit(11)),
        "api": F.when(py, F.coalesce(_class_in(F.col("cls"), KINDS), F.lit("object"))),
        "sig": (F.col("name") == "dt") & F.array_contains("cls", "sig"),
        "note": F.when(F.col("name") == "div", _class_in(F.col("cls"), list(ADMONITIONS))),
        "at": F.col("pos"),
    }
    each = each.withColumn("own", F.when(F.col("open") & ~F.col("name").isin(VOID), F.struct(*[c.alias(k) for k, c in own.items()])))
    opens = F.col("own").isNotNull()
    closes = F.col("tag") & ~F.col("open")
    by_name = Window.partitionBy("page", "name").orderBy("pos")
    each = each.withColumn("level", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(by_name) + F.when(closes, 1).otherwise(0))
    by_level = Window.partitionBy("page", "name", "level").orderBy("pos")
    each = each.withColumns({"before": F.lag("own").over(by_level), "end": F.when(opens, F.lead(F.when(closes, F.col("pos"))).over(by_level))})
    step = F.when(opens & F.col("end").isNotNull(), 1).when(closes & F.col("before").isNotNull(), -1).otherwise(0)
    each = each.withColumns({"el": F.when(opens, F.col("own")).when(closes, F.col("before")), "step": step}).drop("own", "before", "level")

    upto = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = {
        "noise": F.col("el.noise"),
        "section": F.col("el.section"),
        "highlight": F.col("el.highlight").isNotNull(),
        "api": F.col("el.api").isNotNull(),
        "sig": F.col("el.sig"),
        "note": F.col("el.note").isNotNull(),
        **{n: F.col("name") == n for n in ("pre", "code", "table", "blockquote", "h1", "title")},
        "list": F.col("name").isin("ul", "ol"),
        **{f"titled{i}": F.col("el.titled") == i for i in range(len(TITLED))},
    }
    each = each.withColumns({f"n_{k}": F.sum(F.when(c, F.col("step")).otherwise(0)).over(upto) for k, c in counted.items()})
    starts = F.when(F.col("open") & F.col("el.main").isNotNull(), F.struct(F.col("el.main").alias("rank"), "pos", "end"))
    return each.withColumn("content", F.min(starts).over(Window.partitionBy("page")))


def titles(each: DataFrame) -> DataFrame:
    """(page, title): the first heading in the first kind of container that has one, else the title element."""
    upto = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rank = _first_of([(F.col(f"n_titled{i}") > 0, i) for i in range(len(TITLED))])
    rows = each.withColumn("number", F.sum(F.when(F.col("open") & (F.col("name") == "h1"), 1).otherwise(0)).over(upto))
    said = F.struct("pos", text.strip(F.col("text")).alias("text"))
    heads = rows.where("n_h1 > 0 AND text IS NOT NULL").groupBy("page", "number").agg(F.sort_array(F.collect_list(said)).alias("said"), F.min(F.struct(rank.alias("rank"), "pos")).alias("place"))
    heads = heads.where("place.rank IS NOT NULL").withColumn("h1", text.strip(text.heading_text(F.array_join(F.filter("said.text", lambda t: t != ""), " "))))
    heads = heads.groupBy("page").agg(F.min_by("h1", "place").alias("h1"))
    named = rows.where("n_title > 0 AND text IS NOT NULL").groupBy("page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "text")))["text"], "").alias("named"))
    both = rows.select("page").distinct().join(heads, "page", "left").join(named, "page", "left")
    return both.select("page", F.coalesce(F.nullif("h1", F.lit("")), text.title_text(F.coalesce("named", F.lit("")), TITLE_SUFFIX)).alias("title"))


def blocks(each: DataFrame) -> DataFrame:
    """(page, url, block, pos, body, ...): the blocks of the main content, with what they stand in."""
    inside = (F.col("pos") > F.col("content.pos")) & (F.col("pos") < F.coalesce("content.end", F.lit(2**31 - 1))) | F.col("content").isNull()
    rows = each.where(inside & (F.col("n_noise") == 0) & ~F.coalesce("el.noise", F.lit(False)))
    upto = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.col("open")

    def latest(condition: Column, value: Column) -> Column:
        return F.last(F.when(opened & condition, value), True).over(upto)

    def enclosing(depth: str, condition: Column, value: Column) -> Column:
        """The value at the element that opened last at this depth."""
        order = Window.partitionBy("page", depth).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return F.when(F.col(depth) > 0, F.last(F.when(opened & condition & (F.col("step") == 1), value), True).over(order))

    name = F.col("name")
    rows = rows.withColumns(
        {
            "block": F.sum(F.when(F.col("tag") & name.isin(BLOCKS), 1).otherwise(0)).over(upto),
            "item": F.when(F.col("n_list") > 0, latest(name == "li", F.col("pos"))),
            "row": F.when(F.col("n_table") > 0, latest(name == "tr", F.col("pos"))),
            "cell": F.when(F.col("n_table") > 0, latest(name.isin("td", "th"), F.col("pos"))),
            "of_list": F.when(F.col("n_list") > 0, latest((F.col("n_list") == 1) & (F.col("step") == 1) & name.isin("ul", "ol"), F.col("pos"))),
            "of_table": F.when(F.col("n_table") > 0, latest(name == "table", F.col("pos"))),
            "of_note": F.when(F.col("n_note") > 0, latest(F.col("el.note").isNotNull(), F.struct("pos", F.col("el.note").alias("kind")))),
            "of_api": F.when(F.col("n_api") > 0, latest((F.col("n_api") == 1) & F.col("el.api").isNotNull(), F.struct("pos", F.col("el.api").alias("kind")))),
        }
    )
    rows = rows.withColumn("in_section", enclosing("n_section", F.col("el.section"), F.col("a_id")))
    rows = rows.withColumn("in_highlight", enclosing("n_highlight", F.col("el.highlight").isNotNull(), F.col("el.highlight")))
    rows = rows.withColumn("in_list", enclosing("n_list", name.isin("ul", "ol"), F.struct("pos", "name")))
    sign = _first_of([((name == k) & (F.col("step") != 0) & (F.col("n_pre") == 0) & (F.col("n_sig") == 0), v) for k, v in SIGNS.items()])
    spaced = F.regexp_replace("text", r"\s+", " ")
    piece = (
        F.when(F.col("text").isNotNull(), F.when(F.col("n_pre") > 0, F.col("text")).when(F.col("n_sig") > 0, text.strip(F.col("text"))).otherwise(spaced))
        .when(name == "br", F.when(F.col("n_pre") > 0, "\n").otherwise("  \n"))
        .otherwise(F.coalesce(sign, F.lit("")))
    )
    link = (name == "a") & opened & F.array_contains("cls", "reference")
    code = F.get(F.filter(F.transform("cls", lambda c: F.regexp_replace(F.lower(c), "^(?:language|highlight)-", "")), lambda c: c.isin(list(LANGUAGES))), F.lit(0))
    head = F.struct("name", "open", F.col("a_id").alias("id"), "cls")
    at = F.struct("pos", piece.alias("piece"), F.coalesce("text", F.lit("")).alias("plain"))
    found = rows.groupBy("page", "url", "block").agg(
        F.min("pos").alias("pos"), F.min_by(head, "pos").alias("head"), F.sort_array(F.collect_list(at)).alias("pieces"), F.max("n_pre").alias("pre"), F.max("n_sig").alias("sig"),
        F.max("n_blockquote").alias("quote"), F.max("n_list").alias("depth"), F.min("n_api").alias("n_api"),
        *[F.max_by(c, "pos").alias(c) for c in ("item", "row", "cell", "of_list", "of_table", "of_note", "in_section", "in_highlight", "in_list")], F.max("of_api").alias("of_api"),
        F.min_by("a_href", F.when(link, F.col("pos"))).alias("href"), F.min_by(code, F.when((name == "code") & opened, F.col("pos"))).alias("language"),
    )
    found = found.withColumn("body", F.array_join("pieces.piece", "")).withColumn("plain", text.strip(F.regexp_replace(F.array_join("pieces.plain", ""), r"\s+", " ")))
    in_cell = F.col("cell").isNotNull() & F.col("head.name").isin("td", "th") & F.col("head.open")
    return found.where((F.col("plain") != "") | in_cell).drop("pieces")


def _written(found: DataFrame) -> DataFrame:
    """The Markdown of each block, with quotes' signs."""
    first_in = lambda key: F.row_number().over(Window.partitionBy("page", key).orderBy("block")) == 1
    found = found.withColumns({"first_in_item": F.col("item").isNotNull() & first_in("item"), "first_in_note": F.col("of_note").isNotNull() & first_in("of_note")})
    items = Window.partitionBy("page", "in_list.pos").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("number", F.sum(F.col("first_in_item").cast("int")).over(items))
    body = F.regexp_replace(F.regexp_replace("body", "([\ue010-\ue012])( *)([^\ue010-\ue012]*?)( *)\\1", "$2$1$3$1$4"), "([\ue010-\ue012])\\1", "")
    for mark, sign in SHOWN.items():
        body = F.replace(body, F.lit(mark), F.lit(sign))
    body = text.strip(F.regexp_replace(body, r" {2,}(?![ \n])", " "))
    level = F.regexp_extract("head.name", r"\Ah([1-6])\z", 1)
    section = F.when(F.coalesce("in_section", F.lit("")) != "", F.concat(F.lit("<!-- section: "), "in_section", F.lit(" -->\n\n"))).otherwise("")
    symbol = F.when(F.col("head.id") != "", F.concat(F.lit("<!-- api: "), "head.id", F.lit(" -->\n\n"))).otherwise("")
    language = F.coalesce(F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.col("in_highlight")], F.col("in_highlight")), F.col("language"), F.lit("python"))
    language = F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[language], language)
    indent = F.repeat(F.lit("  "), F.col("depth") - 1)
    bullet = F.when(F.col("in_list.name") == "ol", F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("- ")
    label = F.concat(F.lit("**"), F.col("plain"), F.lit("**"))
    plain = (
        F.when(F.col("sig") > 0, F.concat(symbol, F.lit("```python\n"), text.symbol_text(F.col("body")), F.lit("\n```")))
        .when(F.col("pre") > 0, F.concat(F.lit("```"), language, F.lit("\n"), text.strip(F.col("body")), F.lit("\n```")))
        .when(F.col("head.open") & (level != ""), F.concat(section, F.repeat(F.lit("#"), F.nullif(level, F.lit("")).cast("int")), F.lit(" "), F.regexp_replace(body, r"\s+", " ")))
        .when(F.col("cell").isNotNull(), F.regexp_replace(body, r"\s+", " "))
        .when(F.col("head.open") & (F.col("head.name") == "dt"), F.concat(F.lit("**"), F.regexp_replace("plain", r":\z", ""), F.lit("**")))
        .when(F.array_contains("head.cls", "admonition-title"), label)
        .when(F.col("first_in_item"), F.concat(indent, bullet, body))
        .when(F.col("item").isNotNull() & (F.col("depth") > 0), F.concat(indent, F.lit("  "), body))
        .otherwise(body)
    )
    names = F.create_map(*[F.lit(x) for kv in ADMONITIONS.items() for x in kv])
    untitled = F.col("first_in_note") & ~F.array_contains("head.cls", "admonition-title")
    noted = F.when(untitled, F.concat(F.lit("**"), names[F.col("of_note.kind")], F.lit("**\n"), plain)).otherwise(plain)
    quoted = F.when(F.col("of_note").isNotNull() | (F.col("quote") > 0), F.concat(F.lit("> "), F.replace(noted, F.lit("\n"), F.lit("\n> ")))).otherwise(noted)
    return found.withColumn("written", quoted)


def _joined(found: DataFrame) -> DataFrame:
    """(page, url, markdown): blocks of a row of a table joined, then all of a page."""
    unit = F.when(F.col("row").isNotNull(), -F.col("row") - 1).otherwise(F.col("block"))
    cells = found.groupBy("page", "url", unit.alias("unit"), "cell").agg(
        F.min("pos").alias("pos"), F.array_join(F.sort_array(F.collect_list(F.struct("block", "written")))["written"], " ").alias("written"), F.min("row").alias("row"),
        F.min("of_table").alias("of_table"), F.min("of_note.pos").alias("note"), F.min(F.when(F.col("item").isNotNull(), F.col("of_list"))).alias("listed"),
        F.max(F.array_contains("head.cls", "admonition-title")).alias("label"),
    )
    rows = cells.groupBy("page", "url", "unit").agg(
        F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.struct("pos", "written")))["written"].alias("parts"), F.min("row").alias("row"), F.min("of_table").alias("of_table"), F.min("note").alias("note"), F.min("listed").alias("listed"), F.max("label").alias("label")
    )
    order = Window.partitionBy("page").orderBy("pos")
    head = F.row_number().over(Window.partitionBy("page", "of_table").orderBy("pos")) == 1
    line = F.concat(F.lit("| "), F.array_join("parts", " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n| "), F.array_join(F.transform("parts", lambda _: F.lit("---")), " | "), F.lit(" |"))
    rows = rows.withColumn("written", F.when(F.col("row").isNull(), F.array_join("parts", " ")).otherwise(F.concat(line, F.when(head, rule).otherwise(""))))
    # Rows of a table and items of a list follow each other, as the first block of a note does its label; its others are set apart.
    group = F.coalesce(F.concat(F.lit("t"), "of_table"), F.concat(F.lit("l"), "listed"))
    rows = rows.withColumn("group", group)
    same = lambda c: F.coalesce(F.col(c) == F.lag(c).over(order), F.lit(False))
    in_note, close = same("note"), same("group") & F.equal_null("note", F.lag("note").over(order))
    between = F.when(close | (in_note & F.lag("label").over(order)), "\n").when(in_note, "\n>\n").otherwise("\n\n")
    rows = rows.withColumn("between", between)
    parts = F.sort_array(F.collect_list(F.struct("pos", F.concat("between", "written").alias("part"))))
    return rows.groupBy("page", "url").agg(text.tidy_lines(F.array_join(parts["part"], "")).alias("markdown"))


def _sections(found: DataFrame) -> DataFrame:
    """(page, sections): headings outside of documented objects, and these by their first signature."""
    level = F.nullif(F.regexp_extract("head.name", r"\Ah([1-6])\z", 1), F.lit("")).cast("int")
    label = text.heading_text(F.col("plain"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    heads = found.where(F.col("head.open") & level.isNotNull() & (F.col("n_api") == 0) & (F.col("sig") == 0)).select(
        "page", "pos", F.concat(F.lit("#"), F.coalesce(F.nullif("in_section", F.lit("")), slug)).alias("anchor"), label.alias("label"), level.alias("level"),
        F.lit("heading").alias("kind"), F.lit("").alias("symbol"), F.lit("").alias("source_url"),
    )
    first = F.row_number().over(Window.partitionBy("page", "of_api.pos").orderBy("block"))
    objects = found.where((F.col("sig") > 0) & F.col("of_api").isNotNull()).withColumn("nth", first).where((F.col("nth") == 1) & (F.col("head.id") != ""))
    shown = F.when(F.contains("href", F.lit("github.com")) | F.contains("href", F.lit("/blob/")), F.col("href")).otherwise("")
    objects = objects.select(
        "page", "pos", F.concat(F.lit("#"), "head.id").alias("anchor"), text.symbol_text(F.col("body")).alias("label"), F.lit(0).alias("level"),
        F.col("of_api.kind").alias("kind"), F.col("head.id").alias("symbol"), F.coalesce(shown, F.lit("")).alias("source_url"),
    )
    once = F.row_number().over(Window.partitionBy("page", "anchor").orderBy("pos"))
    both = heads.unionByName(objects).withColumn("nth", once).where("nth = 1 AND anchor <> '#'")
    # Parameters are empty: their markup colours code, and such goes before sections are looked for.
    fields = F.struct("anchor", "label", "level", "kind", "symbol", F.array().cast("array<string>").alias("params"), "source_url")
    listed = F.sort_array(F.collect_list(F.struct("pos", fields.alias("section"))))
    return both.groupBy("page").agg(listed["section"].cast(f"array<{schemas.SECTION}>").alias("sections"))


def parsed(raw: DataFrame, closed: bool = False) -> DataFrame:
    """(url, title, markdown, markers) of each distinct row of (url, html); pages without text have none. closed: see tokens()."""
    each = _by_page(saved(tokens(raw, closed)))
    found = _by_page(saved(blocks(each)))
    module = F.substr(F.min_by("a_id", F.when(F.col("open") & (F.col("name") == "section") & F.startswith("a_id", F.lit("module-")), F.col("pos"))), F.lit(8))
    modules = each.groupBy("page").agg(F.coalesce(module, F.lit("")).alias("module"))
    whole = _joined(_written(found)).join(titles(each), "page").join(modules, "page").join(_sections(found), "page", "left")
    sections = F.coalesce("sections", F.array().cast(f"array<{schemas.SECTION}>"))
    whole = whole.withColumn("sections", sections)
    symbols = F.array_distinct(F.filter(F.transform("sections", lambda s: s["symbol"]), lambda s: s != ""))
    markers = F.struct("module", symbols.alias("symbols"), "sections", text.page_keywords(F.col("module"), F.col("sections")).alias("keywords"))
    return whole.select("url", "title", "markdown", markers.cast(schemas.MARKERS).alias("markers"))
