"""Judged queries: precision, reciprocal rank, percentiles, and sweeps over rankers."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.operators.indexing import Index
from lodestone.operators.retrieval import BM25, Ranker, TfIdf, batch, linear_search, page, search
from lodestone.plans.query import parse

#: The grid of a sweep, behind the TF-IDF baseline.
K1, B = (0.9, 1.2, 1.5, 2.0), (0.0, 0.3, 0.5, 0.75, 1.0)


def grid() -> list[Ranker]:
    return [TfIdf(), *[BM25(k1, b) for k1 in K1 for b in B]]


def load_judgments(spark: SparkSession, path: str) -> DataFrame:
    schema = "id string, category string, query string, intent string, relevant_gr array<string>"
    return spark.read.schema(schema).option("multiLine", True).json(path)


def save_judgments(judged: DataFrame, path: str) -> None:
    judged.coalesce(1).write.mode("overwrite").json(path)


def squashed(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"(?U)\s+", "")


def dockets_of(judged: DataFrame) -> DataFrame:
    """(query_id, gr_number): a row for each docket that is relevant to a query; queries without any have none."""
    return judged.select(F.col("id").alias("query_id"), F.explode("relevant_gr").alias("gr_number"))


def judge(ranked: DataFrame, docs: DataFrame, dockets: DataFrame) -> DataFrame:
    """ranked(config, query_id, rank, doc_id, ...) with is_relevant, for queries that have judgments.

    A document is relevant if its docket contains a judged one, white space and case aside. Results
    are few, k for each query and ranker, and stored, as they are needed several times; dockets may
    be as many as documents, and each meets the results of its own query where it is read.
    """
    spark = ranked.sparkSession
    path = f"{storage.shared_folder(spark)}/ranked-{uuid.uuid4().hex}"
    storage.delete_on_exit(spark, path)
    ranked = storage.save(ranked, path)
    hits = ranked.select("query_id", "doc_id").distinct().join(docs.select("doc_id", squashed(F.col("gr_number")).alias("own")), "doc_id")
    wanted = dockets.select(F.col("query_id").alias("_query"), squashed(F.col("gr_number")).alias("judged"))
    same = (F.col("query_id") == F.col("_query")) & F.contains("own", "judged")
    relevant = wanted.join(F.broadcast(hits), same).select("query_id", "doc_id", F.lit(True).alias("_hit")).distinct()
    known = ranked.join(dockets.select("query_id").distinct(), "query_id", "left_semi")
    rows = known.join(relevant, ["query_id", "doc_id"], "left")
    return rows.withColumn("is_relevant", F.coalesce("_hit", F.lit(False))).drop("_hit")


def per_query(judged_rows: DataFrame, dockets: DataFrame, configs: list[int], k: int = 10) -> DataFrame:
    """(config, query_id, precision, reciprocal_rank) of each judged query; both 0 without results."""
    hit, rank = F.col("is_relevant"), F.col("rank")
    found = judged_rows.groupBy("config", "query_id").agg(
        (F.count_if(hit & (rank <= k)) / F.least(F.count_if(rank <= k), F.lit(k))).alias("precision"), F.coalesce(1 / F.min(F.when(hit, rank)), F.lit(0.0)).alias("reciprocal_rank")
    )
    known = dockets.select("query_id").distinct().select("query_id", F.explode(F.array(*map(F.lit, configs))).alias("config"))
    rows = known.join(found, ["config", "query_id"], "left")
    return rows.select("config", "query_id", F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("reciprocal_rank", F.lit(0.0)).alias("reciprocal_rank"))


def means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("config").agg(F.coalesce(F.avg("precision"), F.lit(0.0)).alias("p_at_10"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"))


def nearest_ranks(rows: DataFrame, values: str, fractions: dict[str, float]) -> DataFrame:
    """One row of the nearest-rank percentiles of a column, exact, by their names; 0 without rows.

    Values are counted, and their counts dealt out by ranges of values and stored. Ranks are running
    sums in each range, from the sum of the ranges before; no task reads more than a range.
    """
    spark = rows.sparkSession
    path = f"{storage.shared_folder(spark)}/ranks-{uuid.uuid4().hex}"
    storage.delete_on_exit(spark, path)
    counts = rows.where(F.col(values).isNotNull()).groupBy(F.col(values).alias("x")).agg(F.count("*").alias("n"))
    counts = storage.save(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()), path)
    parts = counts.groupBy("part").agg(F.sum("n").alias("m"))
    before = F.sum("m").over(Window.orderBy("part")) - F.col("m")
    parts = parts.select("part", before.alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("x"))
    ranked = counts.join(F.broadcast(parts), "part").select("x", "n", "total", upto.alias("upto"))

    def value(fraction: float) -> Column:
        at = F.greatest(F.least("total", F.bround(F.lit(fraction) * F.col("total") + 0.5).cast("long")), F.lit(1))
        return F.coalesce(F.max(F.when((F.col("upto") >= at) & (F.col("upto") - F.col("n") < at), F.col("x"))), F.lit(0.0))

    return ranked.agg(*[value(f).alias(name) for name, f in fractions.items()])


def sweep(spark: SparkSession, index: Index, queries: dict[str, str], dockets: DataFrame, rankers: list[Ranker] | None = None, k: int = 10) -> DataFrame:
    """(config, name, p_at_10, mrr) of every ranker, from one batch plan over all queries."""
    rankers = rankers or grid()
    ranked = batch(spark, index, {i: parse(text) for i, text in queries.items()}, rankers, k)
    rows = per_query(judge(ranked, index.docs, dockets), dockets, list(range(len(rankers))), k)
    names = spark.createDataFrame([(i, r.name) for i, r in enumerate(rankers)], "config int, name string")
    return means(rows).join(F.broadcast(names), "config").select("config", "name", "p_at_10", "mrr")


@dataclass
class Outcome:
    query_id: str
    seconds: float
    total: int


def time_queries(index: Index, queries: dict[str, str], ranker: Ranker = BM25(), repeats: int = 3) -> list[Outcome]:
    """The best of several runs of each query, one by one, as a user would ask them."""
    outcomes = []
    for query_id, text in queries.items():
        best, total = float("inf"), 0
        for _ in range(repeats):
            began = time.perf_counter()
            hits = search(index, parse(text), ranker)
            total = len(page(hits).collect())
            best = min(best, time.perf_counter() - began)
        outcomes.append(Outcome(query_id, best, total))
    return outcomes


def nearest_rank(seconds: list[float], fraction: float) -> float:
    """The nearest-rank percentile of a few measurements, halves rounded to even; 0 without any."""
    at = max(1, min(len(seconds), round(fraction * len(seconds) + 0.5)))
    return sorted(seconds)[at - 1] if seconds else 0.0


def compare(spark: SparkSession, index: Index, cases: DataFrame, queries: dict[str, str], dockets: DataFrame, rankers: list[Ranker] | None = None, *, repeats: int = 3) -> str:
    """A report of every ranker and of the scan without an index: quality, and times of each query on its own."""
    rankers = rankers or [BM25()]
    quality = {r["name"]: (r["p_at_10"], r["mrr"]) for r in sweep(spark, index, queries, dockets, rankers).collect()}
    lines = [f"{'configuration':<28} {'P@10':>6} {'MRR':>6} {'median ms':>10} {'p95 ms':>8}"]

    def line(name: str, p: float, rr: float, times: list[float]) -> str:
        return f"{name:<28} {p:>6.3f} {rr:>6.3f} {nearest_rank(times, 0.5) * 1000:>10.1f} {nearest_rank(times, 0.95) * 1000:>8.1f}"

    for ranker in rankers:
        lines.append(line(ranker.name, *quality.get(ranker.name, (0.0, 0.0)), [x.seconds for x in time_queries(index, queries, ranker, repeats)]))
    times, parts = [], []
    for i, text in queries.items():
        began = time.perf_counter()
        rows = page(linear_search(cases, text)).collect()
        times.append(time.perf_counter() - began)
        parts += [(0, i, k, r["doc_id"]) for k, r in enumerate(rows, 1)]
    ranked = spark.createDataFrame(parts, "config int, query_id string, rank int, doc_id long")
    row = means(per_query(judge(ranked, index.docs, dockets), dockets, [0])).first()
    lines += ["", line("scan without an index", *((row["p_at_10"], row["mrr"]) if row else (0.0, 0.0)), times)]
    return "\n".join(lines)
