"""HTML to Markdown, chunking, sources and incremental ingestion."""

import json

import pytest
from pyspark.sql import functions as F

from weftline import schemas
from weftline.operators import chunking, markup
from weftline.plans import ingest, models
from weftline.sources import pages as sources

PAGE = """<html><head><title>nn — PyTorch 2 documentation</title></head><body><nav>menu</nav>
<article class="bd-article"><section id="module-torch.nn"><h1>torch.nn<a class="headerlink" href="#x">#</a></h1>
<p>First   paragraph with <a href="/x">a link</a> and <code>code</code>.<!-- no -->
<section id="layers"><h2>Linear layers</h2><h3>More</h3>
<dl class="py class"><dt class="sig sig-object py" id="torch.nn.Linear"><em class="property">class </em><span class="n">Linear</span>(<em class="sig-param"><span class="n">a</span></em>,<em class="sig-param">b</em>)<a class="reference external" href="https://github.com/x/blob/y"><span class="viewcode-link">[source]</span></a></dt>
<dd><p>Applies it.</p><dl class="field-list"><dt class="field-odd">Parameters:</dt><dd>the size</dd></dl></dd></dl>
<div class="highlight-bash notranslate"><pre>pip  install
x</pre></div>
<div class="admonition note"><p class="admonition-title">Note</p><p>Careful.</p></div>
<ul><li>one<li>two</ul><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table></section></section></article></body></html>"""


def page(spark, html):
    return markup.parsed(spark.createDataFrame([("http://h/x", html)], "url string, html string")).collect()


def test_page_parts(spark):
    (found,) = page(spark, PAGE)
    assert found["title"] == "torch.nn"
    text = found["markdown"]
    for part in (
        "<!-- section: module-torch.nn -->", "# torch.nn\n", "First paragraph with a link and `code`.", "<!-- section: layers -->",
        "## Linear layers", "<!-- api: torch.nn.Linear -->\n\n```python\n", "**Parameters**", "the size", "```bash\npip  install\nx\n```",
        "> **Note**\n> Careful.", "- one\n- two", "| A | B |\n| --- | --- |\n| 1 | 2 |",
    ):
        assert part in text, part
    assert "menu" not in text and "[source]" not in text and "\n\n\n" not in text and "<!-- no -->" not in text
    markers = found["markers"]
    assert markers["module"] == "torch.nn" and markers["symbols"] == ["torch.nn.Linear"]
    assert [(s["anchor"], s["level"], s["kind"]) for s in markers["sections"]] == [("#module-torch.nn", 1, "heading"), ("#layers", 2, "heading"), ("#torch.nn.Linear", 0, "class")]
    assert markers["sections"][2]["source_url"] == "https://github.com/x/blob/y"
    assert markers["keywords"][:5] == ["torch.nn", "torch", "nn", "Linear", "layers"]


MARKDOWN = [
    ("<p>a <b> bold </b>and <em>it</em> <code>x*y</code><code></code> ***</p>", "a **bold** and *it* `x*y` ***"),
    ("<p>one<br>two <b>open", "one\ntwo open"),
    ("<ol><li>a<ul><li>in</ul><li>b</ol>", "1. a\n  - in\n2. b"),
    ("<pre>x\n\n  y &lt;</pre>", "```python\nx\n\n  y <\n```"),
    ("<pre><code class='language-cpp'>a</code></pre>", "```cpp\na\n```"),
    ("<div class='admonition warning'><p>Hot.</p><p>Very.</p></div>", "> **Warning**\n> Hot.\n>\n> Very."),
    ("<div class='admonition tip'><p class='admonition-title'>Do</p><p>a</p><ul><li>x</li><li>y</li></ul><p>b</p></div><p>c</p>", "> **Do**\n> a\n>\n> - x\n> - y\n>\n> b\n\nc"),
    ("<table><tr><th>A<th>B<tr><td><td>2</table>", "| A | B |\n| --- | --- |\n|  | 2 |"),
    ("<p>&#8364; &#x41; &amp;lt; &copy;&unknown;</p>", "€ A &lt; ©&unknown;"),
    ("<script>var x = '<p>no</p>'</script><style>p{}</style><p>yes</p><svg><text>no</text></svg>", "yes"),
    ("<blockquote><p>said</p></blockquote>", "> said"),
    ("<ul><li>a<ul><li>b</ul></ul><ol><li>c</ol><ul><li>d</ul>", "- a\n  - b\n\n1. c\n\n- d"),
]


def test_markdown(spark):
    rows = [(str(i), f"<body>{html}</body>") for i, (html, _) in enumerate(MARKDOWN)]
    found = {r["url"]: r["markdown"] for r in markup.parsed(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert [found[str(i)] for i in range(len(MARKDOWN))] == [m for _, m in MARKDOWN]


def test_pages_without_structure(spark):
    assert page(spark, None) == page(spark, "") == []
    (found,) = page(spark, "<title>T - PyTorch x</title><body><h2>A b</h2><p>x<p>y")
    assert found["title"] == "T" and found["markers"]["sections"][0]["anchor"] == "#a-b"
    (deep,) = page(spark, "<div>" * 3000 + "deep" + "<a " * 3000)
    assert deep["markdown"].startswith("deep") and deep["title"] == "Untitled"


def merged(parts, least):
    """merge_small by its definition: a short text goes before the next one; at the end to the one before, or to the first anchor."""
    out, carry = [], ""
    for anchor, text in parts:
        text = f"{carry}\n\n{text}".strip() if carry else text
        if len(text) < least:
            carry = text
        else:
            out.append((anchor, text))
            carry = ""
    if carry:
        out = [*out[:-1], (out[-1][0], f"{out[-1][1]}\n\n{carry}")] if out else [(parts[0][0], carry)]
    return out


@pytest.mark.parametrize("texts", [[], [""], ["aa"], ["aa", "bb"], ["a" * 9, "bb"], ["bb", "a" * 9, "", "cc", "d" * 9, "e"], ["", "x" * 20, ""], ["", "bb"], ["", "", "a", "bb"]])
def test_merge_small(spark, texts):
    parts = [(f"#{i}", t, "section") for i, t in enumerate(texts)]
    row = spark.createDataFrame([(parts,)], "p array<struct<anchor:string,text:string,kind:string>>")
    found = row.select(chunking.merged(F.col("p"), 8).alias("m")).first()["m"]
    assert [(x["anchor"], x["text"]) for x in found] == merged([(a, t) for a, t, _ in parts], 8)


@pytest.mark.parametrize(
    ("sizes", "most", "overlap", "expected"),
    [
        ([50, 30, 300, 40, 40, 40], 100, 40, ["ab", "c", "de", "ef"]),
        ([50, 30, 300, 40, 40, 40], 100, 0, ["ab", "c", "de", "f"]),
        ([40, 40, 40, 90], 100, 45, ["ab", "bc", "cd"]),
        ([60, 20, 15, 60], 100, 40, ["abc", "bcd"]),
        ([300], 100, 40, ["a"]),
        ([40, 55], 100, 40, ["ab"]),
        ([40, 58, 5], 99, 50, ["a", "ab", "c"]),
    ],
)
def test_pieces(sizes, most, overlap, expected):
    names = "abcdefgh"
    parts = chunking.pieces("\n\n".join(names[i] * n for i, n in enumerate(sizes)), most, overlap)
    assert all(p.startswith(chunking.OVERLAP_SIGN) for p in parts[1:]) == bool(overlap) or len(parts) == 1
    found = ["".join(x[0] for x in p.removeprefix(chunking.OVERLAP_SIGN).split("\n\n")) for p in parts]
    assert found == expected


def test_pieces_bounds_and_overlap():
    text = "\n\n".join(f"paragraph {i} " + "x" * (50 + 37 * i % 90) for i in range(60))
    parts = chunking.pieces(text, 400, 120)
    assert len(parts) > 5 and all(len(p) <= 400 + 120 + 2 + len(chunking.OVERLAP_SIGN) for p in parts)
    assert set(text.split("\n\n")) <= {line for p in parts for line in p.split("\n\n")}
    assert chunking.pieces("x" * 5000, 400, 0)[0] == "x" * 5000
    assert chunking.paragraphs("a\n\n```py\nx\n\ny\n\n```\n\nb") == ["a", "```py\nx\n\ny\n\n```", "b"]
    with pytest.raises(ValueError):
        chunking.split_pieces(100, 100)


def test_chunks_of_pages(spark):
    raw = spark.createDataFrame([("http://h/docs/stable/nn.html", PAGE), ("http://h/plain", "<p>" + "word " * 30), ("http://h/short", "<p>x")], "url string, html string")
    pages = sources.parsed(raw)
    assert pages.count() == 2
    found = {r["chunk_id"]: r for r in chunking.chunks(pages, min_chars=20).collect()}
    plain = next(r for r in found.values() if r["anchor"] == "#top")
    assert plain["chunk_id"].startswith("top__0__") and plain["citation_url"] == "http://h/plain"
    api = next(r for r in found.values() if r["symbol"])
    assert api["kind"] == "class" and api["citation_url"] == "http://h/docs/stable/nn.html#torch.nn.Linear" and "Linear" in api["keywords"]
    assert all(r["text"] and r["citation_url"] for r in found.values())


def test_incremental_equals_full(spark, tmp_path):
    raw = spark.createDataFrame([(f"http://h/{i}", f"<h1>T{i}</h1><p>" + f"word{i} " * 30) for i in range(6)], "url string, html string")
    index, chunks, vectors = (f"{tmp_path}/{x}" for x in ("index", "chunks", "vectors"))
    stored = f"{tmp_path}/markdown"
    ingest.ingest_pages(raw.where("url <= 'http://h/2'"), index, stored)
    ingest.ingest_pages(raw, index, stored)
    again = sources.saved_pages(spark, index, stored)
    assert sorted((r["url"], r["markdown"]) for r in again.collect()) == sorted((r["url"], r["markdown"]) for r in sources.parsed(raw).collect())
    assert sorted(r["url"] for r in sources.done_urls(spark, index).collect()) == [f"http://h/{i}" for i in range(6)]
    pages = sources.parsed(raw)
    ingest.split_incremental(pages.where("url <= 'http://h/2'"), chunks)
    both = ingest.split_incremental(pages, chunks)
    full = chunking.chunks(pages)
    assert sorted(r["chunk_id"] for r in both.collect()) == sorted(r["chunk_id"] for r in full.collect())
    embed = models.hash_embedder(8)
    ingest.embed_missing(both.limit(2), embed, vectors)
    found = ingest.embed_missing(both, embed, vectors)
    assert found.count() == full.count() == sources.saved_vectors(spark, vectors).count()
    assert ingest.split_incremental(pages, chunks).count() == full.count()


def test_pages_with_one_path_and_a_failure_between_sinks(spark, tmp_path, monkeypatch):
    raw = spark.createDataFrame([(f"http://h/a.html{q}", f"<h1>T{q}</h1><p>" + f"word{q[-1:]} " * 30) for q in ("", "?v=1", "?v=2")] * 2, "url string, html string")
    index, stored = f"{tmp_path}/index", f"{tmp_path}/markdown"
    want = sorted((r["url"], r["markdown"]) for r in sources.parsed(raw).collect())
    assert len({m for _, m in want}) == 3

    def stop(*_):
        raise OSError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(ingest.sinks, "save_index", stop)
        with pytest.raises(OSError):
            ingest.ingest_pages(raw, index, stored)
    for _ in range(2):
        ingest.ingest_pages(raw, index, stored)
        assert sorted((r["url"], r["markdown"]) for r in sources.saved_pages(spark, index, stored).collect()) == want


def test_json_sources(spark, tmp_path):
    (tmp_path / "chunks.json").write_text(json.dumps({"chunk_id": "a", "text": "xyz", "char_count": 99}) + "\n\nnot json\n")
    found = sources.saved_chunks(spark, f"{tmp_path}/chunks.json").collect()
    assert [(r["chunk_id"], r["char_count"]) for r in found] == [("a", 3)]
    assert sources.saved_chunks(spark, f"{tmp_path}/nothing").count() == 0
    with pytest.raises(Exception):
        sources.json_lines(spark, f"{tmp_path}/chunks.json", schemas.CHUNKS, strict=True).collect()
    (tmp_path / "scores.json").write_text(json.dumps({"Q01": {"a": 0.5, "b": None}}))
    assert sorted(map(tuple, sources.score_checkpoint(spark, f"{tmp_path}/scores.json").collect())) == [("Q01", "a", 0.5), ("Q01", "b", None)]
    questions = spark.createDataFrame([("Q01", "a?"), ("Q02", "b?")], "qid string, question string")
    (tmp_path / "answers.json").write_text(json.dumps({"Q01": "yes", "Q02": "no"}))
    assert {(r["qid"], r["answer"]) for r in sources.reference_answers(spark, f"{tmp_path}/answers.json", questions).collect()} == {("Q01", "yes"), ("Q02", "no")}
    (tmp_path / "answers.json").write_text(json.dumps({"Q01": "yes"}))
    with pytest.raises(Exception, match="no answer for"):
        sources.reference_answers(spark, f"{tmp_path}/answers.json", questions).collect()
    (tmp_path / "vectors").mkdir()
    (tmp_path / "vectors" / "part.parquet").write_text("not parquet")
    assert sources.saved_vectors(spark, f"{tmp_path}/vectors").count() == sources.saved_vectors(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "map.xml").write_text("<urlset xmlns='x'><url><loc> http://h/a </loc></url><url><loc>http://h/search.html</loc></url></urlset>")
    assert [r["url"] for r in sources.sitemap_urls(spark, f"{tmp_path}/map.xml").collect()] == ["http://h/a"]

    def fetch(url):
        if url.endswith("b"):
            raise OSError("down")
        return "<p>ok"

    rows = sources.fetched(spark.createDataFrame([("a",), ("b",)], "url string"), fetch).collect()
    assert {(r["url"], r["html"], r["error"]) for r in rows} == {("a", "<p>ok", None), ("b", None, "OSError: down")}
