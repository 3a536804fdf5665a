"""Queries: loaders and chunkers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import ids, jsonx, text
from mnemoframe.functions.ids import uuid5_sql
from mnemoframe.operators import chunking
from mnemoframe.session import spread, table
from mnemoframe.sources import loaders


def _docs(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def _digest(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("doc_id").cast("long").alias("doc_id"), "chunk_index", "chunk_size", "cut_type", F.md5("text").alias("digest"))


def chunk_words(spark, sf):
    w = chunking.by_words(_docs(spark, sf))
    return w.select(F.col("doc_id").cast("long").alias("doc_id"), "chunk_index", "text", "cut_type")


def chunk_sentences(spark, sf):
    return _digest(chunking.by_sentences(_docs(spark, sf)))


def chunk_paragraphs(spark, sf):
    return _digest(chunking.by_paragraphs(_docs(spark, sf), 64, batch=False))


def chunk_text(spark, sf):
    return _digest(chunking.by_text(_docs(spark, sf), 128))


def chunk_rows(spark, sf):
    r = table(spark, sf, "cognee_data_record").filter("extension = 'csv'")
    return _digest(chunking.by_rows(r, 24, doc_id="record_no", text="content"))


def chunk_losslessness(spark, sf):
    """Characters of all chunks of a document against those of the document."""
    docs = _docs(spark, sf).filter("text is not null")
    sums = chunking.by_text(docs, 128).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sum(F.length("text")).alias("n"))
    return docs.join(sums, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_chars"))


def extract_chunks(spark, sf):
    """Chunks of every ingested record by its document type, with the token count per record."""
    r = table(spark, sf, "cognee_data_record").filter("content is not null")
    kind = F.when(jsonx.is_dlt(F.col("external_metadata")), F.lit("dlt_row")).otherwise(text.document_type(F.col("extension")))
    body = F.when(F.col("extension") == "html", loaders.html_text(F.col("content"))).otherwise(F.col("content"))
    items = r.select(F.col("record_no").alias("doc_id"), kind.alias("document_type"), body.alias("text")).filter("document_type is not null")
    return chunking.pipeline(items, 64).groupBy(F.col("doc_id").cast("long").alias("record_no")).agg(F.count("*").alias("chunks"), F.sum("chunk_size").alias("tokens"))


def html_extract(spark, sf):
    r = table(spark, sf, "cognee_data_record").filter("extension = 'html'")
    return r.select("record_no", loaders.html_text(F.col("content")).alias("text"))


def html_detect(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.looks_like_html(F.coalesce("text", F.lit(""))).alias("is_html"), text.page_title(F.concat(F.lit("<title> "), F.col("title"), F.lit("</title>"))).alias("title"))


def web_page_nodes(spark, sf):
    """Pages and sites of the documents' hosts."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("https://"), "source", F.lit("/p/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("url"))
    extension, mime = loaders.url_kind(F.col("url"))
    pages = d.select(ids.web_page_id(F.col("url")).alias("id"), F.col("url").alias("name"), F.lit("WebPage").alias("type"), extension.alias("extension"), mime.alias("mime"))
    host = F.parse_url("url", F.lit("HOST"))
    sites = d.select(ids.web_site_id(host).alias("id"), host.alias("name"), F.lit("WebSite").alias("type"), F.lit(None).cast("string").alias("extension"), F.lit(None).cast("string").alias("mime")).distinct()
    return pages.unionByName(sites)


def token_count_update(spark, sf):
    """Word counts of all records: what a token-count update would write."""
    r = table(spark, sf, "cognee_data_record")
    return r.select("record_no", text.word_count(F.coalesce("content", F.lit(""))).cast("long").alias("token_count"), F.octet_length("content").cast("long").alias("data_size"))


def document_preview(spark, sf):
    """First five hundred characters of every document on one line."""
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.md5(text.collapse(F.col("text"), 500)).alias("digest"))


QUERIES = {f.__name__: f for f in (chunk_words, chunk_sentences, chunk_paragraphs, chunk_text, chunk_rows, chunk_losslessness, extract_chunks, html_extract, html_detect, web_page_nodes, token_count_update, document_preview)}

_WS = r"'[ \t\n\v\f\r]+'"
_END = ".;!?…。！？"
ORACLE = {
    "chunk_words": rf"""WITH p AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^ {_END}]*(?:[{_END}] *| )|[^ {_END}]+$')) AS piece, generate_subscripts(regexp_extract_all(text, '[^ {_END}]*(?:[{_END}] *| )|[^ {_END}]+$'), 1) AS i FROM documents WHERE text IS NOT NULL),
      q AS (SELECT *, lead(piece) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM p)
      SELECT doc_id, (i - 1)::INT AS chunk_index, piece AS text, CASE WHEN NOT regexp_matches(piece, '[{_END}] *$') THEN 'word' WHEN nxt[1] IN (chr(10), chr(13)) THEN 'paragraph_end' ELSE 'sentence_end' END AS cut_type FROM q""",
    "chunk_sentences": rf"""WITH p AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^ {_END}]*(?:[{_END}] *| )|[^ {_END}]+$')) AS piece, generate_subscripts(regexp_extract_all(text, '[^ {_END}]*(?:[{_END}] *| )|[^ {_END}]+$'), 1) AS i FROM documents WHERE text IS NOT NULL),
      q AS (SELECT *, lead(piece) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM p),
      k AS (SELECT *, CASE WHEN NOT regexp_matches(piece, '[{_END}] *$') THEN 'word' WHEN nxt[1] IN (chr(10), chr(13)) THEN 'paragraph_end' ELSE 'sentence_end' END AS kind, len(list_filter(string_split_regex(piece, '[\s\v\pZ\x1c-\x1f\x{{85}}]+'), lambda x: x <> '')) AS n FROM q),
      g AS (SELECT *, coalesce(sum(CASE WHEN kind <> 'word' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM k),
      c AS (SELECT doc_id, s, sum(n) AS n, max(kind) FILTER (WHERE kind <> 'word') AS kind, bool_or(regexp_matches(piece, '\pL')) AS alpha, md5(string_agg(piece, '' ORDER BY i)) AS digest FROM g GROUP BY doc_id, s)
      SELECT doc_id, s::INT AS chunk_index, n::INT AS chunk_size, CASE WHEN kind IS NOT NULL THEN kind WHEN alpha THEN 'sentence_cut' ELSE coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY s), 'sentence_cut') END AS cut_type, digest FROM c""",
    "chunk_rows": r"""WITH RECURSIVE r AS (SELECT record_no, unnest(string_split(content, chr(10) || chr(10))) AS body, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS ri FROM cognee_data_record WHERE extension = 'csv'),
      x AS (SELECT record_no, ri, unnest(string_split(body, ', ')) AS pair, generate_subscripts(string_split(body, ', '), 1) AS pi FROM r WHERE trim(body, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
      p AS (SELECT *, len(list_filter(string_split_regex(pair, '[\s\v\pZ\x1c-\x1f]+'), lambda w: w <> '')) AS n FROM x),
      k AS (SELECT record_no, ri, pi, pair, n AS size, 0 AS c FROM p WHERE pi = 1 UNION ALL SELECT p.record_no, p.ri, p.pi, p.pair, CASE WHEN k.size + n > 24 THEN n ELSE k.size + n END, c + CASE WHEN k.size + n > 24 THEN 1 ELSE 0 END FROM k JOIN p ON p.record_no = k.record_no AND p.ri = k.ri AND p.pi = k.pi + 1),
      g AS (SELECT record_no, ri, c, string_agg(pair, ', ' ORDER BY pi) AS text FROM k GROUP BY ALL)
      SELECT record_no AS doc_id, (row_number() OVER (PARTITION BY record_no ORDER BY ri, c) - 1)::INT AS chunk_index, len(list_filter(string_split_regex(text, '[\s\v\pZ\x1c-\x1f]+'), lambda w: w <> ''))::INT AS chunk_size,
        CASE WHEN c = max(c) OVER (PARTITION BY record_no, ri) THEN 'row_end' ELSE 'row_cut' END AS cut_type, md5(text) AS digest FROM g""",
    "chunk_losslessness": "SELECT doc_id, length(text) AS n_chars FROM documents WHERE text IS NOT NULL",
    "html_detect": r"SELECT doc_id, regexp_matches(coalesce(text, ''), '<[A-Za-z/]') AS is_html, nullif(trim(title, ' '), '') AS title FROM documents",
    "web_page_nodes": f"""WITH d AS (SELECT 'https://' || source || '/p/' || doc_id || '.txt' AS url, source FROM documents)
      SELECT {uuid5_sql("'WebPage:' || url")} AS id, url AS name, 'WebPage' AS type, 'txt' AS extension, 'text/plain' AS mime FROM d UNION ALL SELECT DISTINCT {uuid5_sql("'WebSite:' || source")}, source, 'WebSite', NULL, NULL FROM d""",
    "token_count_update": f"SELECT record_no, len(list_filter(string_split_regex(coalesce(content, ''), {_WS}), lambda x: x <> '')) AS token_count, strlen(content) AS data_size FROM cognee_data_record",
    "document_preview": f"SELECT doc_id, md5(left(trim(regexp_replace(text, {_WS}, ' ', 'g'), ' '), 500)) AS digest FROM documents WHERE text IS NOT NULL",
}
