"""Column expressions on answers, their numbered sources, and chat output.

docs is an array of structs with fields symbol, title, url (and kind), in order of rank.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import html_escaped, shortened, strip

MARK = r"\[(\d+)\]"
BETWEEN = "\n\n---\n\n"
SUPERSCRIPTS = "¹²³⁴⁵⁶⁷⁸⁹"
FENCED = r"(?sU)```(?:\w+)?\n?.*?```"
# Wording of the chat's output.
CUT_NOTE = " …\n\n<i>(answer truncated)</i>"
SOURCES_HEAD = "\n\n📚 <b>Sources</b>\n"
ERROR_BEFORE = "❌ <b>Something went wrong.</b>\n\n<code>"
ERROR_AFTER = "</code>\n\nPlease try again or rephrase your question."


def label(symbol: Column, title: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(symbol, F.lit("")), F.nullif(title, F.lit("")), fallback)


def context_block(rank: Column, symbol: Column, title: Column, url: Column, text: Column) -> Column:
    head = F.concat(F.lit("["), rank.cast("string"), F.lit("] **"), label(symbol, title, F.lit("")), F.lit("** ("), url, F.lit(")\n"))
    return F.concat(head, strip(text))


def cited_numbers(answer: Column) -> Column:
    """Numbers in brackets in order of first appearance; what doesn't fit an int is none."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(MARK), F.lit(1)), lambda n: F.expr("1") * n.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull()))


def cited_sources(answer: Column, docs: Column) -> Column:
    """The cited docs with their numbers (index); numbers beyond docs are left out."""
    inside = F.filter(cited_numbers(answer), lambda n: (n >= 1) & (n <= F.size(docs)))
    return F.transform(inside, lambda n: F.struct(n.alias("index"), *[F.get(docs, n - 1)[f].alias(f) for f in ("url", "title", "symbol")]))


def renumbered(answer: Column, used: Column) -> Column:
    """The answer with the numbers in used replaced by their places there, 1 first; other marks stay."""
    gaps = F.split(answer, r"\[\d+\]", -1)
    marks = F.regexp_extract_all(answer, F.lit(MARK), F.lit(1))
    new = F.transform(marks, lambda m: F.concat(F.lit("["), F.when(F.array_contains(used, m.try_cast("int")), F.array_position(used, m.try_cast("int")).cast("string")).otherwise(m), F.lit("]")))
    return F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), new.alias("mark")), lambda x: F.concat(x["gap"], F.coalesce(x["mark"], F.lit("")))), "")


def cut_at_word(text: Column, most: int = 3500) -> Column:
    """Texts over most characters end at the last space before; a note says so."""
    head = F.regexp_replace(F.substring(text, 1, most), r" [^ ]*\z", "")
    return F.when(F.length(text) > most, F.concat(head, F.lit(CUT_NOTE))).otherwise(text)


def markdown_to_html(text: Column) -> Column:
    """Fenced blocks, and outside them inline code and bold, of Markdown as HTML; everything is escaped. What follows
    a fence that is never closed is code if nothing stands before it since the last one."""

    def code(part: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(part, r"(?U)\A```\w*\n?", ""), r"```\z", "")
        return F.concat(F.lit("<pre><code>"), html_escaped(inner), F.lit("</code></pre>"))

    def prose(part: Column) -> Column:
        inline = F.regexp_replace(html_escaped(part), r"`([^`]+)`", "<code>$1</code>")
        return F.when(F.startswith(part, F.lit("```")), code(part)).otherwise(F.regexp_replace(inline, r"\*\*([^\n]+?)\*\*", "<b>$1</b>"))

    blocks = F.arrays_zip(F.split(text, FENCED, -1).alias("gap"), F.regexp_extract_all(text, F.lit(FENCED), F.lit(0)).alias("fence"))
    return F.array_join(F.transform(blocks, lambda x: F.concat(prose(x["gap"]), F.coalesce(code(x["fence"]), F.lit("")))), "")


def chat_answer(answer: Column, sources: Column) -> Column:
    """An answer for chat: cut, in HTML, marks as superscripts up to 9, linked where there is a source, and the sources below."""
    body = markdown_to_html(cut_at_word(answer))
    gaps = F.split(body, r"\[\d+\]", -1)
    marks = F.regexp_extract_all(body, F.lit(MARK), F.lit(1))

    def link(mark: Column) -> Column:
        digits = F.regexp_replace(mark, r"\A0+(?=\d)", "")
        number = digits.try_cast("int")
        source = F.get(F.filter(sources, lambda s: s["index"] == number), F.lit(0))
        sign = F.when(number.between(1, 9), F.substr(F.lit(SUPERSCRIPTS), number, F.lit(1))).otherwise(F.concat(F.lit("["), digits, F.lit("]")))
        return F.when(F.coalesce(source["url"], F.lit("")) == "", sign).otherwise(F.concat(F.lit('<a href="'), source["url"], F.lit('">'), sign, F.lit("</a>")))

    linked = F.arrays_zip(gaps.alias("gap"), F.transform(marks, link).alias("link"))
    text = F.array_join(F.transform(linked, lambda x: F.concat(x["gap"], F.coalesce(x["link"], F.lit("")))), "")
    # Between two links that touch stands a space.
    text = F.replace(text, F.lit("</a><a href="), F.lit("</a> <a href="))
    lines = F.transform(sources, lambda s: F.concat(F.lit("["), s["index"].cast("string"), F.lit('] <a href="'), s["url"], F.lit('">'), html_escaped(label(s["symbol"], s["title"], s["url"])), F.lit("</a>")))
    return F.when(F.size(sources) > 0, F.concat(text, F.lit(SOURCES_HEAD), F.array_join(lines, "\n"))).otherwise(text)


def source_buttons(sources: Column) -> Column:
    """(label, url) of each source; null without sources."""

    def button(s: Column) -> Column:
        number = s["index"].cast("string")
        text = F.concat(F.lit("["), number, F.lit("] "), label(s["symbol"], s["title"], F.concat(F.lit("Source "), number)))
        return F.struct(shortened(text, 60, 57, "…").alias("label"), s["url"].alias("url"))

    return F.when(F.size(sources) > 0, F.transform(sources, button))


def error_text(message: Column) -> Column:
    return F.concat(F.lit(ERROR_BEFORE), html_escaped(F.substring(message, 1, 300)), F.lit(ERROR_AFTER))


def rag_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer the question from the numbered context only and cite it as [n].\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question)


def hyde_prompt(question: Column) -> Column:
    """Asks for a passage that may answer the question, whose vector then stands in for the question's."""
    return F.concat(F.lit("Write a short passage of technical documentation that answers the question, without preface.\n\nQuestion: "), question, F.lit("\nPassage:"))
