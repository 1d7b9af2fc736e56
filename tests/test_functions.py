import html
import re
import uuid
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from weftline.functions import citations, markup, sparse, text, urls, vectors


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t}" for n, t in zip(names, [_kind(v) for v in values.values()])))
    return row.select(column.alias("x")).first()["x"]


def _kind(value):
    if isinstance(value, list):
        return f"array<{_kind(value[0])}>" if value else "array<string>"
    return {str: "string", int: "long", float: "double", type(None): "string"}[type(value)]


@pytest.mark.parametrize(
    ("query", "tokens"),
    [
        ("What is torch.cos?", ["what", "is", "torch.cos"]),
        (".backward()", ["backward"]),
        ("fn().", ["fn()."]),
        ("größe? über?", ["größe", "über"]),
        ("", []),
        ("a a  a", ["a", "a", "a"]),
        (None, None),
    ],
)
def test_query_tokens(spark, query, tokens):
    assert one(spark, text.query_tokens(F.col("q")), q=query) == tokens


def fnv(data):
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 % 2**32
    return h


@pytest.mark.parametrize("word", ["", "a", "torch.nn", "größe", "日本"])
def test_fnv_and_bulk_vector(spark, word):
    assert one(spark, text.fnv1a(F.col("w")), w=word) == fnv(word.encode())
    rows = spark.createDataFrame([(1, f"{word} {word} ..."), (2, None)], "key long, t string")
    found = [tuple(r) for r in sparse.postings(rows, "key", "t").collect()]
    sparse.PART_BYTES, kept = 3, sparse.PART_BYTES
    batch = sparse.pa.RecordBatch.from_arrays([sparse.pa.array([1, 2, 3, 4]), sparse.pa.array(["aa", None, "bbbb", "c"])], ["key", "t"])
    assert [p.num_rows for p in sparse._parts(iter([batch]))] == [2, 2] and list(sparse._parts(iter([batch.slice(0, 0)]))) == []
    sparse.PART_BYTES = kept
    assert found == ([(1, fnv(word.encode()) % 2**17, 2.0)] if word else [])


def test_ids(spark):
    assert one(spark, text.chunk_id(F.col("a"), F.lit(2), F.col("u")), a="#torch.nn.Linear_", u="http://x") == "torch_nn_Linear__2__" + __import__("hashlib").md5(b"http://x").hexdigest()[:6]
    assert one(spark, text.point_id(F.col("c")), c="a__0__ff") == str(uuid.uuid5(uuid.NAMESPACE_URL, "a__0__ff"))


@pytest.mark.parametrize(
    ("url", "section", "path"),
    [
        ("https://h/docs/stable/nn.html", "nn", "nn.md"),
        ("https://h/docs/stable/generated/torch.cos.html?x=1#y", "generated", "generated/torch.cos.md"),
        ("https://h/docs/stable/", "root", "index.md"),
        ("https://h", "root", "index.md"),
        ("https://h/a/b/", "a", "a/b"),
    ],
)
def test_urls(spark, url, section, path):
    assert one(spark, urls.section(F.col("u")), u=url) == section
    assert one(spark, urls.relative_path(F.col("u")), u=url) == path


def test_rounding_keeps_the_sign_of_nought(spark):
    found = one(spark, F.transform(vectors.l2_normalized(F.col("v")), lambda x: vectors.rounded(x, 6)), v=[1.0, -1e-7, 1e-7, -0.25])
    assert [str(x) for x in found] == ["0.970143", "-0.0", "0.0", "-0.242536"]


def test_commas_in_a_row(spark):
    given = "f(a,,b,c, d,,,e,)#"
    assert one(spark, text.symbol_text(F.col("t")), t=given) == "f(a, , b, c, d, , , e, )"
    assert one(spark, text.symbol_text(F.col("t"), runs=False), t=given) == re.sub(r",([^\s])", r", \1", given[:-1]) == "f(a, ,b, c, d, ,, e, )"


def test_text_cleaning(spark):
    assert one(spark, text.heading_text(F.col("t")), t="Title ¶ #") == "Title"
    assert one(spark, text.symbol_text(F.col("t")), t="f(a,b, c)[source]#") == "f(a, b, c)"
    assert one(spark, text.tidy_lines(F.col("t")), t="\na  \n\n\n\nb\t\n") == "a\n\nb"
    assert one(spark, text.title_text(F.col("t"), "Site"), t="Page — Site 2 docs") == "Page"
    assert one(spark, text.title_text(F.col("t"), "Site"), t="") == "Untitled"
    assert one(spark, text.id_list(F.col("t")), t="1, 2,,3 ") == [1, 2, 3]
    assert one(spark, text.shortened(F.col("t"), 5, 3, "..."), t="abcdef") == "abc..."
    assert one(spark, text.chunk_keywords(F.array(F.lit("x")), F.col("s"), F.array(F.lit("p"))), s="a.b") == ["x", "a.b", "a", "b", "p"]


def test_vectors(spark):
    assert one(spark, vectors.l2_normalized(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalized(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vectors.mean_pooled(F.col("v"), 2), v=[[1.0, 2.0], [3.0, 4.0]]) == [2.0, 3.0]
    with pytest.raises(Exception, match="wrong dimension"):
        one(spark, vectors.mean_pooled(F.col("v"), 3), v=[[1.0, 2.0]])


def docs():
    rows = (("u1", "T1", ""), ("u2", "T2", "s2"), ("u3", "", ""))
    return F.array(*[F.struct(F.lit(u).alias("url"), F.lit(t).alias("title"), F.lit(s).alias("symbol")) for u, t, s in rows])


@pytest.mark.parametrize(
    ("answer", "numbers", "new"),
    [
        ("x [2][3] y [2]", [2, 3], "x [1][2] y [1]"),
        ("none", [], "none"),
        ("[9] and [3]", [3], "[9] and [1]"),
        ("[99999999999999]", [], "[99999999999999]"),
    ],
)
def test_citations(spark, answer, numbers, new):
    found = citations.cited_sources(F.col("a"), docs())
    used = F.transform(found, lambda s: s["index"])
    assert one(spark, used, a=answer) == numbers
    assert one(spark, citations.renumbered(F.col("a"), used), a=answer) == new


def test_chat_output(spark):
    answer = "Use **x** & `y` [2][9]\n```python\na<b ** `q` ** c\n```"
    sources = citations.cited_sources(F.col("a"), docs())
    made = one(spark, citations.chat_answer(F.col("a"), sources), a=answer)
    assert made == 'Use <b>x</b> &amp; <code>y</code> <a href="u2">²</a>⁹\n<pre><code>a&lt;b ** `q` ** c\n</code></pre>\n\n📚 <b>Sources</b>\n[2] <a href="u2">s2</a>'
    assert one(spark, citations.chat_answer(F.col("a"), sources), a="[2][2] [007] \"") == '<a href="u2">²</a> <a href="u2">²</a> ⁷ &quot;\n\n📚 <b>Sources</b>\n[2] <a href="u2">s2</a>'
    assert one(spark, citations.source_buttons(sources), a="[3]")[0]["label"] == "[3] Source 3"
    assert one(spark, citations.source_buttons(sources), a="none") is None
    long = one(spark, citations.cut_at_word(F.col("a"), 10), a="aaa bbb ccc ddd")
    assert long == "aaa bbb …\n\n<i>(answer truncated)</i>"
    assert "<code>" + "&lt;" * 300 + "</code>" in one(spark, citations.error_text(F.col("a")), a="<" * 400)
    assert one(spark, citations.markdown_to_html(F.col("a")), a="```py\nnever closed ** x ** 'q'") == "<pre><code>never closed ** x ** &#x27;q&#x27;</code></pre>"


def test_only_closed_character_references(spark):
    assert one(spark, markup.unescaped(F.col("a"), closed=True), a="a&amp;&amp &copy 1&#65;&#65 &eacute;&amp;lt;&am") == "a&&amp &copy 1A&#65 é&lt;&am"


def test_character_references(spark):
    text = "&eacute;&uuml; &alpha; &amp;lt; &#233; &#xE9; &#150; &copy 2020 &copy; &nosuchname; &nosemi &#0; &#1114112; &NotEqualTilde; a&b &= &"
    assert one(spark, markup.unescaped(F.col("a")), a=text) == html.unescape(text)
    assert one(spark, markup.unescaped(F.col("a")), a="?a=1&copy=2&lt=3") == "?a=1&copy=2&lt=3"
    every = " ".join(f"&{n}" for n in sorted(html5) if n.endswith(";"))
    assert one(spark, markup.unescaped(F.col("a")), a=every) == html.unescape(every)
