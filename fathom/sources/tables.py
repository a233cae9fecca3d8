"""Sources: data tables, page texts, PDF files, evaluation items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.sources.workspace import spread

PAGES = "doc_id string, filename string, page int, total_pages int, text string, error string"
EVALUATION = "query string, golden_chunk_uuids array<array<string>>, golden_documents array<struct<uuid:string,chunks:array<struct<index:bigint,content:string>>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_pages(docs: DataFrame) -> DataFrame:
    """Documents as files of one page: doc_id, filename, page, text."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("filename"), F.lit(1).alias("page"), "text")


def pdf_pages(spark: SparkSession, path: str | list[str], doc_id: str | None = None) -> DataFrame:
    """Pages with text of PDF files, numbered from 1; a file that cannot be read is one row with ``error``.

    Needs pypdf on the executors. Without ``doc_id`` it is the file's name without its ending.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for x in batches:
            rows = []
            for name, raw in zip(x["path"], x["content"], strict=True):
                own = doc_id or name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    from pypdf import PdfReader

                    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages]
                    rows += [(own, name.rsplit("/", 1)[-1], n, len(pages), t, None) for n, t in enumerate(pages, 1) if t.strip()]
                except Exception as e:  # one bad file must not end the job  # noqa: BLE001
                    rows.append((own, name.rsplit("/", 1)[-1], 0, 0, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "filename", "page", "total_pages", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PAGES)


def page_sentences(pages: DataFrame, longer_than: int = 10) -> DataFrame:
    """doc_id, page, at, text: sentences with their place in the page."""
    return spread(pages.select("doc_id", "page", "text")).select("doc_id", "page", F.posexplode(T.segments("text", longer_than)).alias("at", "text"))


def page_segments(pages: DataFrame, longer_than: int = 10) -> DataFrame:
    """doc_id, seg_idx, page, text: sentences in the order of pages."""
    rows = page_sentences(pages, longer_than)
    return rows.withColumn("seg_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "at")) - 1).drop("at")


def evaluation_items(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; each line has a number of its own, rising in the order of the files."""
    return spark.read.schema(EVALUATION).json(path).withColumn("qid", F.monotonically_increasing_id())


def inspect(rows: DataFrame, text: str = "content", first: int = 5, order: list[str] | None = None, dump: str | None = None) -> tuple[int, DataFrame]:
    """The number of rows, and the first of them with previews (a report, so it is limited), by ``order`` or all other columns.

    With ``dump`` all rows are written to that folder as JSON.
    """
    if dump is not None:
        export_json(rows, dump)
    others = [c for c in rows.columns if c != text]
    by = order or [c for c in others if rows.schema[c].dataType.typeName() not in ("map", "array", "struct")]
    return rows.count(), rows.orderBy(*by).select(*others, T.preview(text, dots=True).alias(text)).limit(first)


def export_json(rows: DataFrame, folder: str) -> None:
    """One JSON object a row under ``folder``, which is replaced."""
    rows.write.mode("overwrite").json(folder)
