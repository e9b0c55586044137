"""Cutting texts into overlapping chunks that end at sentence or line ends where they can."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from skarn.functions.text import chunk_id

_ENDS = [re.compile(p) for p in (r"[.!?]\s+", r"\n\n", r"\n")]


def pieces(text: str, size: int = 1200, overlap: int = 200) -> list[str]:
    """Chunks of one text; a chunk of 50 characters or fewer is left out."""
    if size - 200 <= overlap:
        raise ValueError("size - 200 must exceed overlap, or chunks might not advance")
    text = re.sub(r"\n{3,}", "\n\n", text or "").strip()
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end >= len(text):
            if len(text[at:].strip()) > 50:
                out.append(text[at:])
            break
        low = max(end - 200, 0)
        window = text[low : end + 50]
        for pattern in _ENDS:
            found = None
            for found in pattern.finditer(window):
                pass
            if found is not None:
                if low + found.end() > at + 100:
                    end = low + found.end()
                break
        if len(piece := text[at:end].strip()) > 50:
            out.append(piece)
        at = end - overlap
    return out


def chunked(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """array<string> of a text's chunks."""

    @pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: pieces(t, size, overlap))

    return run(text)


def paged(pages: Column, size: int = 1200, overlap: int = 200) -> Column:
    """array<struct<page,text>> of the chunks of a document's pages, in order; page counts from 1."""

    @pandas_udf("array<struct<page:int,text:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda p: [{"page": k, "text": c} for k, body in enumerate([] if p is None else p, 1) for c in pieces(body, size, overlap)])

    return run(pages)


def chunk_pages(pages: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """(id, doc_id, idx, page, text) from (doc_id, pages array<string>).

    Chunks never cross pages; page is null where a document has one page; idx runs over the document. A
    row's pages are cut inside the row, so no text is shuffled and rows that share an id stay apart.
    """
    each = pages.select("doc_id", F.size("pages").alias("n"), F.posexplode(paged(F.col("pages"), size, overlap)).alias("idx", "x"))
    return each.select(chunk_id("doc_id", "idx").alias("id"), "doc_id", "idx", F.when(F.col("n") > 1, F.col("x.page")).alias("page"), F.col("x.text").alias("text"))


class ChunkTable:
    """Table function of a text: (idx, text) of its chunks."""

    def eval(self, text: str, size: int = 1200, overlap: int = 200) -> Iterator[tuple[int, str]]:
        yield from enumerate(pieces(text, size, overlap))


def register(spark: SparkSession) -> None:
    """Make kg_chunk(text, size, overlap) known to SQL."""
    spark.udtf.register("kg_chunk", F.udtf(ChunkTable, returnType="idx int, text string"))
