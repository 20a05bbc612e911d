"""Snippets, highlighting, and result pages as rows, JSON and CSV."""

from __future__ import annotations

import html
from bisect import bisect_left
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.tokens import scan, term_of
from lodestone.operators.indexing import Index, unit_text

WIDTH = 260
#: Characters searched for the beginning of a sentence before a snippet, and for its end after it.
BACK, AHEAD = 60, 40


def matched_spans(text: str, terms: set[str]) -> list[tuple[int, int]]:
    return [(t.start, t.end) for t in scan(text) if term_of(t.text) in terms]


def best_start(starts: list[int], width: int = WIDTH) -> int | None:
    """Where a window of `width` characters holds most matches; of equals the first. None without any."""
    if not starts:
        return None
    if len(starts) == 1:
        return max(0, starts[0] - width // 3)
    counts = [bisect_left(starts, s + width) - i for i, s in enumerate(starts)]
    return max(0, starts[counts.index(max(counts))] - width // 6)


def cut(text: str, start: int, width: int = WIDTH) -> str:
    """A window of a text, moved to sentence borders nearby, with dots where the text goes on."""
    end = min(len(text), start + width)
    if start > 0 and (dot := text.rfind(". ", max(0, start - BACK), start)) >= 0:
        start = dot + 2
    if end < len(text) and (dot := text.find(". ", end, min(len(text), end + AHEAD))) >= 0:
        end = dot + 1
    middle = text[start:end].strip().replace("\n", " ")
    return f"{'…' if start > 0 else ''}{middle}{'…' if end < len(text) else ''}"


def snippet(text: str, terms: list[str], width: int = WIDTH) -> str:
    start = best_start([s for s, _ in matched_spans(text, set(terms))], width) if terms else None
    return cut(text, start or 0, width)


def highlight(text: str, terms: list[str]) -> str:
    """The text escaped for HTML, matches of the terms in <mark>."""
    out, at = [], 0
    for start, end in matched_spans(text, set(terms)) if terms else []:
        out += [html.escape(text[at:start]), "<mark>", html.escape(text[start:end]), "</mark>"]
        at = end
    return "".join([*out, html.escape(text[at:])])


def linear_snippet(text: str, words: list[str], width: int = WIDTH) -> str:
    low = text.lower()
    hits = [at for w in words if (at := low.find(w)) >= 0]
    if not hits:
        return text[:width].strip() + ("..." if len(text) > width else "")
    start = max(0, min(hits) - width // 3)
    end = min(len(text), start + width)
    return ("..." if start else "") + text[start:end].strip() + ("..." if end < len(text) else "")


#: Values of an IN that Spark turns into single comparisons for Parquet; of more, only their range.
_PUSHED = 10


def _few(page: DataFrame, index: Index, columns: list) -> DataFrame:
    """Columns of a page's documents, joined to the page.

    A page is as many rows as its limit. It is computed once, its ids go to the document table as
    comparisons, and that is sorted by id: only row groups and pages of the table that hold one are
    read, however large the corpus.
    """
    spark = page.sparkSession
    rows = page.collect()
    ids = sorted({r["doc_id"] for r in rows})
    wanted = reduce(lambda a, b: a | b, [F.col("doc_id").isin(ids[k : k + _PUSHED]) for k in range(0, len(ids), _PUSHED)], F.lit(False))
    docs = index.docs.where(wanted).select("doc_id", *columns)
    return docs.join(F.broadcast(spark.createDataFrame(rows, page.schema)), "doc_id")


def with_snippets(page: DataFrame, index: Index, terms: list[str]) -> DataFrame:
    """A page of results with document fields and snippets; texts of the page's documents alone are read.

    The Python function sees these rows only.
    """
    wanted = sorted(set(terms))

    @F.pandas_udf(StringType())
    def shown(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: highlight(snippet(t or "", wanted), wanted))

    columns = ["gr_number", "title", "promulgated", "division", "ponente", "source_url"]
    rows = _few(page, index, [*columns, unit_text().alias("_unit")])
    return rows.select("doc_id", *[c for c in page.columns if c != "doc_id"], *columns, shown("_unit").alias("snippet"))


def export_rows(page: DataFrame, index: Index) -> DataFrame:
    """Rows of the CSV export: page(rank, doc_id, score) with nulls as empty strings."""
    docs = _few(page.select("rank", "doc_id", "score"), index, ["gr_number", "title", "promulgated", "division", "ponente", "source_url"])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(
        F.col("rank").alias("Rank"), text("gr_number").alias("G.R. Number"), text("title").alias("Title"), text("promulgated").alias("Date"),
        text("division").alias("Division"), text("ponente").alias("Ponente"), F.format_string("%.4f", "score").alias("Score"), text("source_url").alias("Source URL"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.orderBy("Rank").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def to_json(results: DataFrame) -> DataFrame:
    """One JSON document a result, dates as yyyy-MM-dd."""
    return results.select(F.to_json(F.struct("*"), {"dateFormat": "yyyy-MM-dd", "ignoreNullFields": "false"}).alias("json"))


def relevance(page: DataFrame) -> DataFrame:
    """Each score as a percentage of the page's first."""
    most = page.agg(F.max("score").alias("_most"), F.lit(1).alias("_k"))
    rows = page.withColumn("_k", F.lit(1)).join(F.broadcast(most), "_k")
    return rows.withColumn("relevance", F.when(F.col("_most") > 0, F.col("score") / F.col("_most") * 100).otherwise(0.0)).drop("_k", "_most")
