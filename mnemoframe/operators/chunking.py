"""Chunkers as table functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import chunks

_SCHEMA = pa.schema([("doc_id", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string()), ("chunk_size", pa.int32()), ("cut_type", pa.string()), ("chunk_id", pa.string())])
_DDL = "doc_id string, chunk_index int, text string, chunk_size int, cut_type string, chunk_id string"


def chunk(docs: DataFrame, split: Callable[[str, str], Iterable[tuple]], doc_id: str = "doc_id", text: str = "text", most: int = 20_000) -> DataFrame:
    """One row per chunk that ``split(doc_id, text)`` yields as ``(text, size, cut type, index, id)``; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc, i, t, n, cut, key) for t, n, cut, i, key in split(doc, body)]
                if len(rows) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).filter("text is not null").mapInArrow(run, _DDL)


def by_words(docs: DataFrame, **names: str) -> DataFrame:
    return chunk(docs, lambda d, t: ((p, chunks.count_words(p), k, i, None) for i, (p, k) in enumerate(chunks.words(t))), **names)


def by_sentences(docs: DataFrame, limit: int | None = None, **names: str) -> DataFrame:
    return chunk(docs, lambda d, t: ((p, n, k, i, None) for i, (p, n, k) in enumerate(chunks.sentences(t, limit))), **names)


def by_paragraphs(docs: DataFrame, limit: int, batch: bool = True, **names: str) -> DataFrame:
    return chunk(docs, lambda d, t: ((p, n, k, i, None) for i, (p, n, k) in enumerate(chunks.paragraphs(t, limit, batch))), **names)


def by_text(docs: DataFrame, limit: int, **names: str) -> DataFrame:
    return chunk(docs, lambda d, t: chunks.text_chunks(d, t, limit), **names)


def by_rows(docs: DataFrame, limit: int, **names: str) -> DataFrame:
    return chunk(docs, lambda d, t: chunks.row_chunks(d, t, limit), **names)


def pipeline(items: DataFrame, limit: int) -> DataFrame:
    """Chunks of ingested items ``(doc_id, text, document_type)``: rows of csv, one chunk for a table row, else text."""
    kind = F.col("document_type")
    rows = by_rows(items.filter(kind == "csv"), limit)
    text = by_text(items.filter(~kind.isin("csv", "dlt_row")), limit)
    whole = items.filter((kind == "dlt_row") & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"), "text", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("chunk_size"), F.lit("dlt_row").alias("cut_type"), F.lit(None).cast("string").alias("chunk_id")
    )
    return rows.unionByName(text).unionByName(whole)
