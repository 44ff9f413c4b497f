"""Web pages: readable markdown and titles from raw HTML."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noviscan.functions.identity import canonical_url
from noviscan.sources.html import readable

ROWS_PER_SLICE = 256


def read_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, title, text) in one pass of the scan; no page leaves its task."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_SLICE):
                piece = batch.slice(start, ROWS_PER_SLICE)
                found = [readable(html.as_py()) for html in piece.column(2)]
                columns = [pa.array(c, pa.string()) for c in zip(*found)] or [pa.array([], pa.string())] * 2
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *columns], ["page_id", "url", "title", "text"])

    rows = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, title string, text string")


def web_sources(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> readable sources; ``rejected`` marks pages without readable text.

    A page without a title has its url as one. Null and empty pages are rejected, with the empty text.
    """
    return read_pages(pages).select(
        "page_id",
        F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"),
        "text",
        F.lit("web").alias("source_type"),
        canonical_url(F.col("url")).alias("source_ref"),
    ).withColumn("rejected", F.col("text") == "")
