"""The named queries over the driver's tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import citations, text, urls, vectors
from weftline.operators import chunking, increments, keyword_index, metrics, search, stats, vector_index
from weftline.plans import ingest
from weftline.sources import pages as page_source
from weftline.sources import tables
from weftline.storage import saved, session_dir, small
from weftline.streaming import limits

QUERIES = {}
ORACLE_SQL = {}

TOP_K = 6
PREFETCH = 3


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(t: Column) -> Column:
    """A text's lines, as segments; the fixtures have no blank lines."""
    return F.split(t, "\n")


# Pieces of SQL that several queries share.
_TOKENS = r"""list_filter(list_transform(regexp_split_to_array(lower({0}), '[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}\x{{3000}}]+'),
  lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_.]+$', '', 'g')), lambda w: w <> '')"""
_FNV = """list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, octet_length(encode({0}))::BIGINT + 1),
  lambda i: ('0x' || substr(hex(encode({0})), 2 * i - 1, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"""
_SPARSE = f"""
qt AS (SELECT item_id AS query_id, unnest({_TOKENS.format('text')}) AS w FROM benchmark),
dt AS (SELECT doc_id AS key, unnest({_TOKENS.format('text')}) AS w FROM documents),
vocab AS (SELECT w, ({_FNV.format('w')}) % 131072 AS bucket FROM (SELECT w FROM qt UNION SELECT w FROM dt)),
q AS (SELECT query_id, bucket, count(*)::DOUBLE AS tf FROM qt JOIN vocab USING (w) GROUP BY ALL),
d AS (SELECT key, bucket, count(*)::DOUBLE AS tf FROM dt JOIN vocab USING (w) GROUP BY ALL),
idf AS (SELECT bucket, count(*) AS df, ln(1 + ((SELECT count(DISTINCT doc_id) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
        FROM d GROUP BY bucket)"""
_KEYWORD = f"""{_SPARSE},
ks AS (SELECT query_id, key, round(sum(q.tf * idf * d.tf), 6) AS score FROM q JOIN idf USING (bucket) JOIN d USING (bucket) GROUP BY ALL),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM ks)"""
_DENSE = """
ds AS (SELECT q.vec_id AS query_id, v.vec_id AS key, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
       FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM ds)"""
# Items and documents have the vector with their number.
_VECTORS = """
vs AS (SELECT item_id AS query_id, doc_id AS key, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
       FROM benchmark JOIN embeddings q ON item_id = q.vec_id, documents JOIN embeddings v ON doc_id = v.vec_id),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM vs)"""


@query(f"SELECT item_id, {_TOKENS.format('text')} AS tokens FROM benchmark")
def tokenize_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.query_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH t AS (SELECT item_id, unnest({_TOKENS.format('text')}) AS w FROM benchmark)
SELECT item_id, (({_FNV.format('w')}) % 131072)::INT AS bucket, count(*) AS tf FROM t GROUP BY ALL""")
def sparse_vector_terms(spark, sf_dir):
    tokens = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.query_tokens(F.col("text"))).alias("w"))
    return tokens.groupBy("item_id", text.bucket(F.col("w")).alias("bucket")).agg(F.count("*").alias("tf"))


@query(f"WITH {_SPARSE} SELECT bucket::INT AS bucket, df, round(idf, 6) AS idf FROM idf")
def sparse_postings_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    weights = search.bucket_weights(search.postings(docs, "doc_id", "text"), docs, "doc_id")
    return weights.select("bucket", "df", F.round("idf", 6).alias("idf"))


# A quarter of the documents comes, one changes and one goes after the first count.
@query(f"""WITH documents AS (SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 'altogether new ' || source ELSE text END AS text FROM documents WHERE doc_id % 4 <> 3), {_SPARSE}
SELECT bucket::INT AS bucket, df FROM idf""")
def frequency_updates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kept = tables.Table(spark, f"{session_dir(spark)}/{uuid.uuid4().hex}", "bucket int, df long", ["bucket"])
    kept.replace(search.postings(docs.where("doc_id % 4 <> 1"), "doc_id", "text").groupBy("bucket").agg(F.count("*").alias("df")))
    new = docs.where("doc_id % 4 in (1, 2)").withColumn("text", F.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("altogether new "), "source")).otherwise(F.col("text")))
    kept.replace(keyword_index.changed_frequencies(kept.read(), docs.where("doc_id % 4 in (2, 3)"), new, "doc_id"))
    return kept.read()


def _keyword(spark, sf_dir, k):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return search.keyword_search(queries, docs, k)


@query(f"WITH {_KEYWORD} SELECT query_id, key, score, rank::INT AS rank FROM kr WHERE rank <= 18")
def sparse_search_topk(spark, sf_dir):
    return _keyword(spark, sf_dir, TOP_K * PREFETCH)


@query(ORACLE_SQL["sparse_search_topk"])
def stored_keyword_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    index = keyword_index.build(docs, f"{session_dir(spark)}/{uuid.uuid4().hex}")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.top_ranked(keyword_index.search(index, queries, TOP_K * PREFETCH), TOP_K * PREFETCH)


def _dense(spark, sf_dir, k):
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.dense_search(queries, rows.select(F.col("vec_id").alias("key"), "embedding"), k)


@query(f"WITH {_DENSE} SELECT query_id, key, score, rank::INT AS rank FROM dr WHERE rank <= 18")
def dense_search_topk(spark, sf_dir):
    return _dense(spark, sf_dir, TOP_K * PREFETCH)


def _by_index(spark, sf_dir, exactly):
    rows = table(spark, sf_dir, "embeddings")
    index = vector_index.build(rows.select(F.col("vec_id").alias("key"), "embedding"), f"{session_dir(spark)}/{uuid.uuid4().hex}")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.search(index, queries, TOP_K * PREFETCH, exactly=exactly)


# What it finds isn't all that there is, so there is no SQL; tests measure its recall.
@query()
def vector_index_topk(spark, sf_dir):
    return _by_index(spark, sf_dir, exactly=False)


@query(ORACLE_SQL["dense_search_topk"])
def vector_index_exact(spark, sf_dir):
    return _by_index(spark, sf_dir, exactly=True)


_RRF = """
f AS (SELECT query_id, key, sum(round(1.0 / (60 + rank), 12)::DECIMAL(20,12))::DOUBLE AS s FROM ({legs}) GROUP BY ALL),
fr AS (SELECT query_id, key, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, key) AS rank FROM f)"""
_BOTH = _RRF.format(legs="SELECT query_id, key, rank FROM kr WHERE rank <= 18 UNION ALL SELECT query_id, key, rank FROM vr WHERE rank <= 18")


def _by_vector(spark, sf_dir):
    """The dense leg: items of the benchmark and documents have the vector with their number."""
    stored = table(spark, sf_dir, "embeddings")

    def leg(queries: DataFrame, k: int, keys: DataFrame | None = None) -> DataFrame:
        asked = queries.select("query_id").join(stored, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
        keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")) if keys is None else keys
        return search.dense_search(asked, keys.join(stored, F.col("key") == F.col("vec_id")).select("key", "embedding"), k)

    return leg


@query(f"WITH {_KEYWORD}, {_VECTORS}, {_BOTH} SELECT query_id, key, score, rank::INT AS rank FROM fr WHERE rank <= 6")
def rrf_fusion(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.fused([_keyword(spark, sf_dir, 18), _by_vector(spark, sf_dir)(queries, 18)], TOP_K)


@query(f"""WITH {_KEYWORD} SELECT query_id, key, score, rank::INT AS rank FROM (
  SELECT kr.*, row_number() OVER (PARTITION BY query_id, source || '|' || lang ORDER BY rank) AS n FROM kr JOIN documents ON key = doc_id WHERE rank <= 18)
WHERE n = 1""")
def retrieval_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "lang")
    hits = docs.join(small(saved(_keyword(spark, sf_dir, 18))), "key")
    return search.deduplicated(hits, F.concat_ws("|", "source", "lang")).select("query_id", "key", "score", "rank")


_RERANK = f"""WITH {_KEYWORD},
h AS (SELECT kr.query_id, kr.key, kr.score AS rrf, kr.rank AS pr, list_distinct({_TOKENS.format('b.text')}) AS qw, {_TOKENS.format('d.text')} AS dw
      FROM kr JOIN benchmark b ON kr.query_id = b.item_id JOIN documents d ON kr.key = d.doc_id WHERE kr.rank <= 18),
c AS (SELECT query_id, key, rrf, pr, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, dw)) / len(qw) ELSE 0 END AS ce FROM h),
m AS (SELECT *, min(rrf) OVER w AS r0, max(rrf) OVER w AS r1, min(ce) OVER w AS c0, max(ce) OVER w AS c1 FROM c WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, key, pr, round(0.7 * CASE WHEN c1 - c0 < 1e-9 THEN 0.5 ELSE (ce - c0) / (c1 - c0) END
      + (1 - 0.7) * CASE WHEN r1 - r0 < 1e-9 THEN 0.5 ELSE (rrf - r0) / (r1 - r0) END, 6) AS score FROM m),
k AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pr) AS rank FROM b)"""


def _reranked(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    hits = docs.join(small(saved(_keyword(spark, sf_dir, 18))), "key").join(small(queries), "query_id")
    scored = saved(hits.select("query_id", "key", "score", "rank", search.word_overlap(F.col("question"), F.col("text")).alias("overlap")))
    return search.reranked(scored, F.col("overlap"), 0.7).select("query_id", "key", "score", "rank")


@query(_RERANK + " SELECT query_id, key, score, rank::INT AS rank FROM k")
def minmax_blend_rerank(spark, sf_dir):
    return _reranked(spark, sf_dir)


@query(_RERANK + """ SELECT query_id, key, score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM k WHERE score >= 0.4) WHERE n <= 4""")
def threshold_topk(spark, sf_dir):
    return search.cut(_reranked(spark, sf_dir), 0.4, 4)


@query(f"""WITH {_KEYWORD}, {_VECTORS}, {_BOTH},
h0 AS (SELECT fr.*, d.text AS dtext, row_number() OVER (PARTITION BY query_id, source || '|' || lang ORDER BY rank) AS n
       FROM fr JOIN documents d ON key = doc_id WHERE rank <= 6),
h AS (SELECT query_id, key, score AS rrf, rank AS pr, list_distinct({_TOKENS.format('b.text')}) AS qw, {_TOKENS.format('dtext')} AS dw
      FROM h0 JOIN benchmark b ON query_id = item_id WHERE n = 1),
c AS (SELECT query_id, key, rrf, pr, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, dw)) / len(qw) ELSE 0 END AS ce FROM h),
m AS (SELECT *, min(rrf) OVER w AS r0, max(rrf) OVER w AS r1, min(ce) OVER w AS c0, max(ce) OVER w AS c1 FROM c WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, key, pr, rrf, round(0.7 * CASE WHEN c1 - c0 < 1e-9 THEN 0.5 ELSE (ce - c0) / (c1 - c0) END
      + (1 - 0.7) * CASE WHEN r1 - r0 < 1e-9 THEN 0.5 ELSE (rrf - r0) / (r1 - r0) END, 6) AS score FROM m)
SELECT query_id, key, rrf AS rrf_score, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pr)::INT AS rank FROM b""")
def hybrid_search(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "key")
    hits = search.hybrid_search(queries, docs, search.Options(), _by_vector(spark, sf_dir), F.concat_ws("|", "source", "lang"))
    return hits.select("query_id", "key", "rrf_score", "score", "rank")


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(split_part(trim(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/docs/stable/', ''), '^/+|/+$', '', 'g'), '/'), '/', 1), '\.[^.]*$', ''), ''), 'root') AS section FROM pages""")
def url_section(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.section(F.col("url")).alias("section"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_replace(trim(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/docs/stable/', ''), '/'), '\.html?$', '.md'), ''), 'index.md') AS path FROM pages""")
def url_rel_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.relative_path(F.col("url")).alias("path"))


@query("SELECT page_id, url FROM pages WHERE NOT (contains(url, '_modules/') OR contains(url, 'genindex') OR contains(url, 'py-modindex') OR contains(url, 'search') OR contains(url, '/de/'))")
def url_skip_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(~urls.skipped(F.col("url"), (*urls.SKIPPED, "/de/"))).select("page_id", "url")


# The fixtures' pages are made of few elements; what SQL can say of these is all that there is to say.
# It decodes character references with a semicolon; so do these queries, though by default those without one are decoded, too.
_BLOCK = "</?(?:p|div|ul|li|nav|article|h1|footer|body|html)(?: [^<>]*)?>"
_PLAIN = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^<>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"""
_SECTION = r"""coalesce(nullif(regexp_replace(split_part(trim(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/docs/stable/', ''), '^/+|/+$', '', 'g'), '/'), '/', 1), '\.[^.]*$', ''), ''), 'root')"""
_PAGES = rf"""b AS (SELECT url, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<!--.*?-->', '', 'g'), '<br>', ' ', 'g') AS body FROM pages),
x AS (SELECT url, h1, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part, unnest(list_prepend('<body>', tags)) AS tag
      FROM (SELECT url, h1, string_split_regex(body, '{_BLOCK}') AS parts, regexp_extract_all(body, '{_BLOCK}') AS tags FROM b)),
l AS (SELECT url, h1, i, tag, {_PLAIN.format('part')} AS t FROM x),
j AS (SELECT *, lag(tag) OVER (PARTITION BY url ORDER BY i) AS before FROM l WHERE t <> ''),
md AS (SELECT url, regexp_replace({_PLAIN.format('h1')}, '[\s#¶]+$', '') AS title, trim(string_agg(CASE WHEN tag = '<li>' AND before = '<li>' THEN chr(10) ELSE chr(10) || chr(10) END
      || CASE tag WHEN '<h1>' THEN '# ' WHEN '<li>' THEN '- ' ELSE '' END || t, '' ORDER BY i), chr(10)) AS markdown FROM j GROUP BY url, h1)"""


@query(rf"WITH {_PAGES} SELECT url, title, {_SECTION} AS section, markdown, length(markdown)::INT AS char_count FROM md WHERE length(markdown) >= 50")
def html_to_markdown(spark, sf_dir):
    pages = page_source.parsed(table(spark, sf_dir, "pages"), closed=True)
    return pages.select("url", "title", "section", "markdown", "char_count")


@query(rf"""WITH {_PAGES} SELECT url, '#' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS anchor, title AS label, 1 AS level, 'heading' AS kind, '' AS symbol
FROM md WHERE length(markdown) >= 50""")
def page_markers(spark, sf_dir):
    pages = page_source.parsed(table(spark, sf_dir, "pages"), closed=True)
    section = F.explode("markers.sections").alias("s")
    return pages.select("url", section).select("url", "s.anchor", "s.label", "s.level", "s.kind", "s.symbol")


# Each page a second time, at an address with the same path.
@query(rf"""WITH pages AS (SELECT url, html FROM pages UNION ALL SELECT url || '?again=1', replace(html, '<h1>', '<h1>Again ') FROM pages WHERE NOT contains(url, '#')), {_PAGES}
SELECT url, title, markdown FROM md WHERE length(markdown) >= 50""")
def saved_pages_by_url(spark, sf_dir):
    first = table(spark, sf_dir, "pages").select("url", "html")
    second = first.where(~F.contains("url", F.lit("#"))).select(F.concat("url", F.lit("?again=1")).alias("url"), F.replace("html", F.lit("<h1>"), F.lit("<h1>Again ")).alias("html"))
    folder = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    for raw in (first, first.unionByName(second)):
        ingest.ingest_pages(raw, f"{folder}/index", f"{folder}/markdown", closed=True)
    return page_source.saved_pages(spark, f"{folder}/index", f"{folder}/markdown").select("url", "title", "markdown")


# A page as a documentation generator writes it, for each row of pages; {n} is its number.
_SPHINX = (
    '<html><head><title>Mod{n} — PyTorch 2 documentation</title></head><body><nav>menu</nav><div class="bd-toc">toc</div><article class="bd-article" role="main"><section id="module-pkg.m{n}">'
    '<h1>pkg.m{n}<a class="headerlink" href="#">#</a></h1><p>Intro {n} with <code>x{n}</code> and <strong>bold</strong> text.</p><section id="part-{n}"><h2>Part {n}</h2><dl class="py function">'
    '<dt class="sig sig-object" id="pkg.m{n}.run">pkg.m{n}.run(a,b)<a class="reference external" href="https://github.com/o/r/blob/m{n}.py">[source]</a></dt><dd><p>Runs {n} times.</p></dd></dl>'
    '<div class="highlight-bash"><pre>pip install m{n}</pre></div><pre><code class="language-cpp">int x = {n} &lt; 2;</code></pre><div class="admonition note"><p class="admonition-title">Note</p><p>Mind {n}.</p><p>Twice.</p></div>'
    '<div class="versionadded"><p>New in {n}.</p></div><ul><li>one {n}</li><li>two</li></ul><ol><li>first</li><li>second</li></ol><table><tr><th>A</th><th>B</th></tr><tr><td>{n}</td><td>2</td></tr></table>'
    '<dl class="field-list"><dt class="field-odd">Returns:</dt><dd><p>Meaning {n}.</p></dd></dl><h3>Deep {n}</h3><p>End &eacute;.</p></section></section></article></body></html>'
)
_SPHINX_MARKDOWN = """<!-- section: module-pkg.m{n} -->

# pkg.m{n}

Intro {n} with `x{n}` and **bold** text.

<!-- section: part-{n} -->

## Part {n}

<!-- api: pkg.m{n}.run -->

```python
pkg.m{n}.run(a, b)
```

Runs {n} times.

```bash
pip install m{n}
```

```cpp
int x = {n} < 2;
```

> **Note**
> Mind {n}.
>
> Twice.

> **Version added**
> New in {n}.

- one {n}
- two

1. first
2. second

| A | B |
| --- | --- |
| {n} | 2 |

**Returns**

Meaning {n}.

<!-- section: part-{n} -->

### Deep {n}

End é."""


@query(f"""SELECT page_id, 'pkg.m' || page_id AS title, 'pkg.m' || page_id AS module, replace('{_SPHINX_MARKDOWN}', '{{n}}', page_id::VARCHAR) AS markdown, ['pkg.m' || page_id || '.run'] AS symbols,
  ['#module-pkg.m' || page_id, '#part-' || page_id, '#pkg.m' || page_id || '.run'] AS anchors, ['heading', 'heading', 'function'] AS kinds, ['pkg.m' || page_id, 'Part ' || page_id, 'pkg.m' || page_id || '.run(a, b)'] AS labels,
  [1, 2, 0] AS levels, ['', '', 'https://github.com/o/r/blob/m' || page_id || '.py'] AS source_urls,
  ['pkg.m' || page_id, 'pkg', 'm' || page_id, 'Part', 'pkg.m' || page_id || '.run', 'run'] AS keywords FROM pages""")
def sphinx_pages(spark, sf_dir):
    number = F.col("page_id").cast("string")
    raw = table(spark, sf_dir, "pages").select(number.alias("url"), F.replace(F.lit(_SPHINX), F.lit("{n}"), number).alias("html"))
    found = page_source.parsed(raw)
    of = lambda name: F.transform("markers.sections", lambda s: s[name])
    return found.select(
        F.col("url").cast("long").alias("page_id"), "title", "markers.module", "markdown", "markers.symbols", of("anchor").alias("anchors"), of("kind").alias("kinds"), of("label").alias("labels"),
        of("level").alias("levels"), of("source_url").alias("source_urls"), "markers.keywords",
    )


@query("""WITH d AS (SELECT page_id, url, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)
SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4 + 1), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM d""")
def point_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.point_id(F.col("url")).alias("point_id"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace('f(' || left(text, 40) || ',b) [source]#', '\s*(?:\[source\]|[#¶])+\s*$', ''), ',([^\s])', ', \1', 'g') AS symbol,
  regexp_replace(left(text, 60) || ' #¶', '[\s#¶]+$', '') AS heading, list_filter(regexp_extract_all(left(text, 80), '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: length(w) >= 3) AS words,
  trim(regexp_replace(regexp_replace(left(text, 80) || chr(10) || chr(10) || chr(10) || 'x  ' || chr(10) || 'y ', '\n{3,}', chr(10) || chr(10), 'g'), '[ \t\r]+(\n|$)', '\1', 'g')) AS tidy FROM documents""")
def cleaned_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    head = lambda n: F.substring("text", 1, n)
    return rows.select(
        "doc_id", text.symbol_text(F.concat(F.lit("f("), head(40), F.lit(",b) [source]#")), runs=False).alias("symbol"), text.heading_text(F.concat(head(60), F.lit(" #¶"))).alias("heading"),
        text.heading_words(head(80)).alias("words"), text.tidy_lines(F.concat(head(80), F.lit("\n\n\nx  \ny "))).alias("tidy"),
    )


@query("""WITH t AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM t GROUP BY ALL)
SELECT label, list(round(x, 6) ORDER BY i) AS mean FROM m GROUP BY label""")
def mean_pooled_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list("embedding")).alias("tokens"))
    return rows.select("label", F.transform(vectors.mean_pooled(F.col("tokens"), 64), lambda x: vectors.rounded(x, 6)).alias("mean"))


_PARAGRAPHS = "list_filter(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x) <> '')"


def _spaced() -> Column:
    """A text with each of its lines as a paragraph."""
    return F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))


@query(f"SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS paragraph FROM (SELECT doc_id, {_PARAGRAPHS} AS l FROM documents)")
def paragraph_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.paragraph_list()(_spaced())).alias("pos", "paragraph"))


@query(f"""WITH RECURSIVE long AS (SELECT doc_id, {_PARAGRAPHS} AS l FROM documents WHERE length(replace(text, chr(10), chr(10) || chr(10))) > 1500),
p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS t FROM long),
f AS (SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS held, []::VARCHAR[] AS made FROM long
 UNION ALL
 SELECT doc_id, i, CASE WHEN alone THEN [] WHEN full_ THEN list_append(coalesce(held[list_filter(range(1, len(held) + 1), lambda k: length(array_to_string(held[k:], chr(10) || chr(10))) <= 200)[1]:], []), t) ELSE list_append(held, t) END,
  CASE WHEN len(held) > 0 AND (alone OR full_) THEN [array_to_string(held, chr(10) || chr(10))] ELSE [] END || CASE WHEN alone THEN [t] ELSE [] END
 FROM (SELECT f.doc_id, p.i, held, t, length(t) > 1500 AS alone, len(held) > 0 AND length(array_to_string(held, chr(10) || chr(10))) + 2 + length(t) > 1500 AS full_
       FROM f JOIN p ON f.doc_id = p.doc_id AND p.i = f.i + 1)),
made AS (SELECT doc_id, i, unnest(range(len(made))) AS j, unnest(made) AS piece FROM f
 UNION ALL SELECT f.doc_id, f.i + 1, 0, array_to_string(held, chr(10) || chr(10)) FROM f JOIN long ON f.doc_id = long.doc_id AND f.i = len(l) WHERE len(held) > 0),
numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS n, piece FROM made)
SELECT doc_id, n::INT AS sub_index, CASE WHEN n > 0 THEN '<!-- overlap -->' || chr(10) || chr(10) ELSE '' END || piece AS piece FROM numbered
UNION ALL SELECT doc_id, 0, replace(text, chr(10), chr(10) || chr(10)) FROM documents WHERE length(replace(text, chr(10), chr(10) || chr(10))) <= 1500""")
def sub_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.split_pieces()(_spaced())).alias("sub_index", "piece"))


_STRIPPED = r"regexp_replace({0}, '^[\s\x0B\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}\x{{3000}}]+|[\s\x0B\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}\x{{3000}}]+$', '', 'g')"


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT doc_id, 0::BIGINT AS i, '' AS carry, NULL::VARCHAR AS anchor, NULL::VARCHAR AS text FROM documents
 UNION ALL
 SELECT doc_id, i, CASE WHEN length(t) < 120 THEN t ELSE '' END,
  CASE WHEN length(t) >= 120 THEN own END, CASE WHEN length(t) >= 120 THEN t END
 FROM (SELECT f.doc_id, l.i, '#s' || (l.i - 1) AS own, carry || CASE WHEN carry <> '' AND {_STRIPPED.format('line')} <> '' THEN chr(10) || chr(10) ELSE '' END || {_STRIPPED.format('line')} AS t
       FROM f JOIN l ON f.doc_id = l.doc_id AND l.i = f.i + 1)),
rest AS (SELECT f.doc_id, carry FROM f JOIN (SELECT doc_id, max(i) AS i FROM l GROUP BY doc_id) m ON f.doc_id = m.doc_id AND f.i = m.i WHERE carry <> ''),
made AS (SELECT doc_id, anchor, text, row_number() OVER w - 1 AS pos, row_number() OVER w = count(*) OVER (PARTITION BY doc_id) AS final FROM f WHERE text IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT made.doc_id, pos::INT AS pos, anchor, text || CASE WHEN final AND carry IS NOT NULL THEN chr(10) || chr(10) || carry ELSE '' END AS text FROM made LEFT JOIN rest ON made.doc_id = rest.doc_id
UNION ALL SELECT doc_id, 0, '#s0', carry FROM rest WHERE doc_id NOT IN (SELECT doc_id FROM made)""")
def merge_small(spark, sf_dir):
    parts = F.transform(_lines(F.col("text")), lambda t, i: F.struct(F.concat(F.lit("#s"), i.cast("string")).alias("anchor"), text.strip(t).alias("text"), F.lit("section").alias("kind")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.merged(parts)).alias("pos", "s")).select("doc_id", "pos", "s.anchor", "s.text")


@query(r"""SELECT doc_id, i::INT AS pos, '#s' || doc_id || '_' || i AS anchor, regexp_replace(t, '^[\s\x0B\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]+|[\s\x0B\x{85}\x{A0}\x{2028}\x{2029}\x{3000}]+$', '', 'g') AS text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)""")
def marker_split(spark, sf_dir):
    marked = F.array_join(F.transform(_lines(F.col("text")), lambda t, i: F.concat(F.lit("<!-- section: s"), F.col("doc_id").cast("string"), F.lit("_"), i.cast("string"), F.lit(" -->\n"), t)), "\n")
    parts = chunking.segments(marked)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("pos", "s")).select("doc_id", "pos", "s.anchor", "s.text")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(url, '^#+', ''), '[^a-zA-Z0-9]+', '_', 'g'), '_') || '__' || page_id || '__' || substr(md5(url), 1, 6) AS chunk_id,
  rtrim(url, '/') || '#a' || page_id AS citation_url FROM pages""")
def chunk_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    anchor = F.concat(F.lit("#a"), F.col("page_id").cast("string"))
    return rows.select("page_id", text.chunk_id(F.col("url"), F.col("page_id"), F.col("url")).alias("chunk_id"), urls.citation(F.col("url"), anchor).alias("citation_url"))


@query(rf"""WITH {_PAGES} SELECT 'top__0__' || substr(md5(url), 1, 6) AS chunk_id, markdown AS text, url AS page_url, url AS citation_url, 'heading' AS kind, length(markdown)::INT AS char_count, 0 AS sub_index
FROM md WHERE length(markdown) >= 50""")
def page_chunks(spark, sf_dir):
    found = chunking.chunks(page_source.parsed(table(spark, sf_dir, "pages"), closed=True))
    return found.select("chunk_id", "text", "page_url", "citation_url", "kind", "char_count", "sub_index")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_anti_join(spark, sf_dir):
    return increments.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'q' || l.quality END AS source
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL
SELECT doc_id, 'q' || quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def upsert_last_wins(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", "source")
    new = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    return increments.upserted(old, new, "doc_id")


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'q' || l.quality END AS source FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE doc_id % 7 <> 3 UNION ALL SELECT doc_id, 'q' || quality FROM labels WHERE doc_id % 7 <> 3 AND doc_id NOT IN (SELECT doc_id FROM documents)""")
def committed_upserts(spark, sf_dir):
    keyed = tables.Table(spark, f"{session_dir(spark)}/{uuid.uuid4().hex}", "doc_id long, source string", ["doc_id"])
    documents = table(spark, sf_dir, "documents")
    new = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    keyed.upsert(documents, batch=("documents", 0))
    for _ in range(2):  # the second is a retry, which changes nothing
        keyed.upsert(new, gone=documents.unionByName(new, allowMissingColumns=True).where("doc_id % 7 = 3"), batch=("labels", 0))
    return keyed.read()


@query("""WITH s AS (SELECT lang, length(text) AS n, row_number() OVER (PARTITION BY lang ORDER BY length(text)) AS r, count(*) OVER (PARTITION BY lang) AS c FROM documents)
SELECT lang, count(*) AS n, min(n) AS min_size, median(n)::DOUBLE AS median_size, round(avg(n), 6) AS mean_size,
       max(n) FILTER (r = floor(c * 0.95)::BIGINT + 1) AS p95_size, max(n) AS max_size FROM s GROUP BY lang""")
def chunk_size_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("size").cast("long"))
    return stats.size_stats(rows, "size", ["lang"])


@query("""SELECT count(*) AS pages, sum(n_chars)::BIGINT AS total_chars, (sum(n_chars) // greatest(count(*), 1))::BIGINT AS avg_chars,
  sum(len(string_split(text, chr(10))) - 1)::BIGINT AS symbols, count(*) FILTER (contains(text, chr(10))) AS pages_with_symbols FROM documents""")
def corpus_summary(spark, sf_dir):
    return stats.corpus_summary(table(spark, sf_dir, "documents"), "n_chars", (F.size(_lines(F.col("text"))) - 1).cast("long"))


@query("SELECT source, count(*) AS n, min(doc_id) AS first_place FROM documents GROUP BY source ORDER BY n DESC, first_place LIMIT 10")
def top_sections(spark, sf_dir):
    return stats.top_groups(table(spark, sf_dir, "documents"), "source", "doc_id")


def _answer() -> Column:
    """A text with made-up marks, so that the fixtures exercise citations."""
    n = (F.col("turn") % 3 + 2).cast("string")
    return F.concat(F.col("text"), F.lit(" ["), n, F.lit("][1] and ["), n, F.lit("] [9]"))


def _docs() -> Column:
    return F.array(*[F.struct(F.lit(f"https://example.org/{i}").alias("url"), F.lit(f"Title {i}").alias("title"), F.lit("" if i % 2 else f"sym{i}").alias("symbol")) for i in range(1, 5)])


_ANSWER = "text || ' [' || (turn % 3 + 2) || '][1] and [' || (turn % 3 + 2) || '] [9]'"
_CITED = rf"""a AS (SELECT conv_id, turn, {_ANSWER} AS answer FROM conversations),
n AS (SELECT *, list_transform(regexp_extract_all(answer, '\[([0-9]+)\]', 1), lambda x: try_cast(x AS INT)) AS numbers FROM a),
c AS (SELECT conv_id, turn, answer, list_filter(numbers, lambda x, i: x BETWEEN 1 AND 4 AND list_position(numbers, x) = i) AS cited FROM n)"""


@query(rf"WITH {_CITED} SELECT conv_id, turn, cited, list_transform(cited, lambda x: 'https://example.org/' || x) AS urls FROM c")
def citation_sources(spark, sf_dir):
    found = citations.cited_sources(_answer(), _docs())
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(found, lambda s: s["index"]).alias("cited"), F.transform(found, lambda s: s["url"]).alias("urls"))


@query(rf"""WITH {_CITED}, g AS (SELECT *, string_split_regex(answer, '\[[0-9]+\]') AS gaps, regexp_extract_all(answer, '\[[0-9]+\]') AS marks FROM c)
SELECT conv_id, turn, array_to_string(list_transform(gaps, lambda x, i: x || CASE WHEN i > len(marks) THEN '' WHEN list_contains(cited, try_cast(marks[i][2:-2] AS INT))
  THEN '[' || list_position(cited, try_cast(marks[i][2:-2] AS INT)) || ']' ELSE marks[i] END), '') AS answer FROM g""")
def citation_renumber(spark, sf_dir):
    used = F.transform(citations.cited_sources(_answer(), _docs()), lambda s: s["index"])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", citations.renumbered(_answer(), used).alias("answer"))


def _formatted() -> Column:
    """An answer with made-up marks, code, bold and a fence, long ones repeated."""
    marked = F.concat(F.lit("**Note** `x<1` "), _answer(), F.lit("\n```python\na < 'b' ** c ** [1]\n```\n** "), F.col("text"))
    return F.when(F.col("turn") % 4 == 3, F.repeat(marked, 12)).otherwise(marked)


_FENCED = r"(?s)```(?:[\p{L}\p{N}_]+)?\n?.*?```"
_ESCAPED = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')"""
_SIGN = "CASE WHEN n BETWEEN 1 AND 9 THEN substr('¹²³⁴⁵⁶⁷⁸⁹', n, 1) ELSE '[' || n || ']' END"


@query(rf"""WITH {_CITED}, m AS (SELECT conv_id, turn, cited, '**Note** `x<1` ' || answer || chr(10) || '```python' || chr(10) || 'a < ''b'' ** c ** [1]' || chr(10) || '```' || chr(10) || '** ' || text AS marked
  FROM c JOIN (SELECT conv_id, turn, text FROM conversations) USING (conv_id, turn)),
l AS (SELECT conv_id, turn, cited, CASE WHEN turn % 4 = 3 THEN repeat(marked, 12) ELSE marked END AS a FROM m),
t AS (SELECT conv_id, turn, cited, CASE WHEN length(a) > 3500 THEN regexp_replace(a[:3500], ' [^ ]*$', '') || ' …' || chr(10) || chr(10) || '<i>(answer truncated)</i>' ELSE a END AS a FROM l),
p AS (SELECT conv_id, turn, cited, string_split_regex(a, '{_FENCED}') AS gaps, regexp_extract_all(a, '{_FENCED}') AS fences FROM t),
h AS (SELECT conv_id, turn, cited, array_to_string(list_transform(gaps, lambda g, i: CASE WHEN starts_with(g, '```') THEN '<pre><code>' || {_ESCAPED.format("regexp_replace(g, '^```[a-z]*' || chr(10) || '?', '')")} || '</code></pre>'
    ELSE regexp_replace(regexp_replace({_ESCAPED.format('g')}, '`([^`]+)`', '<code>\1</code>', 'g'), '\*\*([^\n]+?)\*\*', '<b>\1</b>', 'g') END
    || CASE WHEN i <= len(fences) THEN '<pre><code>' || {_ESCAPED.format("regexp_replace(regexp_replace(fences[i], '^```[a-z]*' || chr(10) || '?', ''), '```$', '')")} || '</code></pre>' ELSE '' END), '') AS html FROM p),
g AS (SELECT conv_id, turn, cited, string_split_regex(html, '\[[0-9]+\]') AS gaps, list_transform(regexp_extract_all(html, '\[([0-9]+)\]', 1), lambda x: x::BIGINT) AS marks FROM h)
SELECT conv_id, turn, replace(array_to_string(list_transform(gaps, lambda x, i: x || CASE WHEN i > len(marks) THEN '' ELSE list_transform([marks[i]], lambda n: CASE WHEN list_contains(cited, n) THEN '<a href="https://example.org/' || n || '">' || {_SIGN} || '</a>' ELSE {_SIGN} END)[1] END), ''), '</a><a href=', '</a> <a href=')
  || CASE WHEN len(cited) > 0 THEN chr(10) || chr(10) || '📚 <b>Sources</b>' || chr(10) || array_to_string(list_transform(cited, lambda n: '[' || n || '] <a href="https://example.org/' || n || '">' || CASE WHEN n % 2 = 1 THEN 'Title ' || n ELSE 'sym' || n END || '</a>'), chr(10)) ELSE '' END AS html FROM g""")
def chat_answers(spark, sf_dir):
    sources = citations.cited_sources(_answer(), _docs())
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", citations.chat_answer(_formatted(), sources).alias("html"))


@query(rf"""WITH {_CITED}, s AS (SELECT conv_id, turn, text, unnest(CASE WHEN len(cited) = 0 THEN [NULL] ELSE cited END) AS n, unnest(range(greatest(len(cited), 1))) AS i FROM c JOIN (SELECT conv_id, turn, text FROM conversations) USING (conv_id, turn))
SELECT conv_id, turn, list('[' || n || '] ' || CASE WHEN n % 2 = 1 THEN 'Title ' || n ELSE 'sym' || n END ORDER BY i) FILTER (n IS NOT NULL) AS labels,
  '❌ <b>Something went wrong.</b>' || chr(10) || chr(10) || '<code>' || {_ESCAPED.format("left(any_value(text) || '<&>', 300)")} || '</code>' || chr(10) || chr(10) || 'Please try again or rephrase your question.' AS error,
  'Q' || CASE WHEN turn < 10 THEN '0' ELSE '' END || turn AS qid FROM s GROUP BY conv_id, turn""")
def chat_pieces(spark, sf_dir):
    buttons = citations.source_buttons(citations.cited_sources(_answer(), _docs()))
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.transform(buttons, lambda b: b["label"]).alias("labels"), citations.error_text(F.concat("text", F.lit("<&>"))).alias("error"), text.question_id(F.col("turn")).alias("qid"))


@query(f"""WITH {_KEYWORD} SELECT query_id, string_agg('[' || rank || '] **' || source || '** (doc:' || key || ')' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
FROM kr JOIN documents ON key = doc_id WHERE rank <= 6 GROUP BY query_id""")
def format_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text", F.lit("").alias("symbol"), F.col("source").alias("title"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"))
    return ingest.contexts(docs.join(small(saved(_keyword(spark, sf_dir, 6))), "key"))


@query("""SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6)) AS unit FROM embeddings""")
def l2_normalize(spark, sf_dir):
    unit = F.transform(vectors.l2_normalized(F.col("embedding")), lambda x: vectors.rounded(x, 6))
    return table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("unit"))


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT event_id, user_id, ts, r, true AS accepted, [ts] AS live FROM e WHERE r = 1
 UNION ALL
 SELECT e.event_id, e.user_id, e.ts, e.r, len(list_filter(f.live, lambda t: t > e.ts - INTERVAL 86400 SECOND)) < 2,
  CASE WHEN len(list_filter(f.live, lambda t: t > e.ts - INTERVAL 86400 SECOND)) < 2 THEN list_append(list_filter(f.live, lambda t: t > e.ts - INTERVAL 86400 SECOND), e.ts)
       ELSE list_filter(f.live, lambda t: t > e.ts - INTERVAL 86400 SECOND) END
 FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT event_id, user_id, accepted FROM f""")
def throttle(spark, sf_dir):
    return limits.throttled(table(spark, sf_dir, "events"), 2, 86400).select("event_id", "user_id", "accepted")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
f AS (SELECT event_id, user_id, r, true AS emitted, ts AS last FROM e WHERE r = 1
 UNION ALL
 SELECT e.event_id, e.user_id, e.r, e.ts >= f.last + INTERVAL 6 HOUR, CASE WHEN e.ts >= f.last + INTERVAL 6 HOUR THEN e.ts ELSE f.last END
 FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
SELECT event_id, user_id, emitted FROM f""")
def draft_debounce(spark, sf_dir):
    return limits.debounced(table(spark, sf_dir, "events"), 6 * 3600).select("event_id", "user_id", "emitted")


def _scores(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("qid", F.col("doc_id").cast("string"))
    pairs = F.map_from_arrays(F.array(F.lit("quality"), F.lit("toxic")), F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")))
    return rows.select("qid", F.explode(pairs).alias("metric", "score"))


@query("""SELECT metric, count(score) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_samp(score), 6) AS std, min(score) AS min, max(score) AS max
FROM (SELECT 'quality' AS metric, quality::DOUBLE AS score FROM labels UNION ALL SELECT 'toxic', toxic::DOUBLE FROM labels) GROUP BY metric""")
def eval_summary(spark, sf_dir):
    return stats.score_summary(_scores(spark, sf_dir))


@query("SELECT doc_id::VARCHAR AS qid, round((quality + toxic) / 2, 6) AS mean_score FROM labels ORDER BY mean_score, qid LIMIT 5")
def eval_worst5(spark, sf_dir):
    return stats.worst(_scores(spark, sf_dir))


# Each answer of a conversation is measured against what stood before it as contexts, and the next answer as its reference.
_SAMPLES = """w AS (SELECT conv_id || '-' || turn AS qid, conv_id, turn, role, lag(text, 1) OVER o AS question, text AS answer, lead(text, 2) OVER o AS reference,
  list_filter([lag(text, 1) OVER o, lag(text, 2) OVER o, lag(text, 3) OVER o, lag(text, 4) OVER o], lambda x: x IS NOT NULL) AS contexts FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
samples AS (SELECT * FROM w WHERE role = 'assistant')"""
_WORDS_OF = _TOKENS.format("s")


def _sentences(text: str) -> str:
    """SQL of a list of a text's sentences, each as its distinct tokens."""
    return f"list_filter(list_transform(regexp_extract_all(coalesce({text}, '') || ' ', '(?s).+?[.!?]\\s+|.+'), lambda s: list_distinct({_WORDS_OF})), lambda t: len(t) > 0)"


@query(rf"""WITH {_SAMPLES},
ctx AS (SELECT qid, i, unnest({_sentences('contexts[i]')}) AS e FROM (SELECT qid, contexts, unnest(range(1, len(contexts) + 1)) AS i FROM samples)),
claims AS (SELECT qid, 'faithfulness' AS metric, unnest(l) AS s, unnest(range(len(l))) AS n FROM (SELECT qid, {_sentences('answer')} AS l FROM samples)
 UNION ALL SELECT qid, 'context_recall', unnest(l), unnest(range(len(l))) FROM (SELECT qid, {_sentences('reference')} AS l FROM samples)),
shared AS (SELECT c.qid, metric, n, len(s) AS size, i, len(list_intersect(s, e)) AS k FROM claims c LEFT JOIN ctx ON c.qid = ctx.qid),
best AS (SELECT qid, metric, n, size, coalesce(max(k), 0) AS k, arg_max(i, k * 1000 - i) AS i FROM shared GROUP BY ALL),
ap AS (SELECT x.qid, x.i, coalesce(hit, false) AS hit FROM (SELECT qid, unnest(range(1, len(contexts) + 1)) AS i FROM samples) x
  LEFT JOIN (SELECT DISTINCT qid, i, true AS hit FROM best WHERE metric = 'context_recall' AND k >= 0.5 * size) b ON x.qid = b.qid AND x.i = b.i),
pr AS (SELECT qid, hit, sum(hit::INT) OVER o / count(*) OVER o AS p FROM ap WINDOW o AS (PARTITION BY qid ORDER BY i)),
words AS (SELECT qid, list_distinct({_TOKENS.format("coalesce(question, '')")}) AS q, list_distinct({_TOKENS.format("coalesce(answer, '')")}) AS a, list_distinct({_TOKENS.format("coalesce(reference, '')")}) AS r FROM samples),
v AS (SELECT qid, metric, avg((k >= 0.5 * size)::INT) AS value FROM best GROUP BY ALL
 UNION ALL SELECT qid, 'context_precision', coalesce(avg(p) FILTER (hit), 0) FROM pr GROUP BY qid
 UNION ALL SELECT qid, 'answer_relevancy', CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) / len(q) END FROM words
 UNION ALL SELECT qid, 'answer_correctness', CASE WHEN len(a) + len(r) > 0 THEN 2 * len(list_intersect(a, r)) / (len(a) + len(r)) END FROM words)
SELECT p.qid, p.metric, round(value, 6) AS score FROM (SELECT qid, unnest(['faithfulness', 'answer_relevancy', 'context_precision', 'context_recall', 'answer_correctness']) AS metric FROM samples) p LEFT JOIN v ON p.qid = v.qid AND p.metric = v.metric""")
def answer_metrics(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    before = F.array(*[F.lag("text", i).over(order) for i in range(1, 5)])
    rows = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("qid"), "role", F.lag("text").over(order).alias("question"), F.col("text").alias("answer"), F.lead("text", 2).over(order).alias("reference"), before.alias("contexts")
    )
    rows = rows.where("role = 'assistant'").withColumn("contexts", F.filter("contexts", lambda x: x.isNotNull()))
    return metrics.measured(saved(rows.drop("role")))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (3, 7, 20, 41)")
def access_filter(spark, sf_dir):
    allowed = spark.range(1).select(F.explode(text.id_list(F.lit("3, 7,, 20 ,41"))).alias("user_id"))
    return table(spark, sf_dir, "events").join(F.broadcast(allowed), "user_id", "left_semi").select("event_id", "user_id")


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s*[—–-]\s*PyTorch.*$', '')), ''), 'Untitled') AS title FROM pages""")
def html_title(spark, sf_dir):
    raw = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.title_text(raw, "PyTorch").alias("title"))
