"""Boolean retrieval and ranking, of one query or of many at once."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.indexing import Index, unit_text
from lodestone.plans.query import Query


def number(x: float) -> str:
    """A double in SQL."""
    return f"{float(x)!r}D"


def literal(text: str) -> str:
    """A string in SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(terms) -> str:
    return ", ".join(map(literal, sorted(set(terms))))


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75

    @property
    def name(self) -> str:
        return f"bm25 (k1={self.k1:g}, b={self.b:g})"

    def weight(self, n_docs: int, df: int) -> float:
        return math.log((n_docs - df + 0.5) / (df + 0.5) + 1)

    def gain(self, index: Index) -> str:
        """What one unit of weight earns in a posting, in SQL."""
        return f"tf * {number(self.k1 + 1)} / (tf + {number(self.k1)} * ({number(1 - self.b)} + {number(self.b)} * length / {number(index.avgdl or 1.0)}))"


@dataclass(frozen=True)
class TfIdf:
    name: str = "tf-idf (cosine-normalised)"

    def weight(self, n_docs: int, df: int) -> float:
        idf = math.log(n_docs / df)
        return idf * idf if idf > 0 else 0.0

    def gain(self, index: Index) -> str:
        return "(1 + ln(tf))"


Ranker = BM25 | TfIdf


def ranker_of(name: str = "bm25", *, k1: float = 1.2, b: float = 0.75) -> Ranker:
    if name not in ("bm25", "tfidf"):
        raise ValueError(f"unknown ranker {name!r} (expected 'bm25' or 'tfidf')")
    return BM25(k1, b) if name == "bm25" else TfIdf()


def filter_column(filters: dict[str, str]) -> str:
    """The conjunction of a query's field filters over docs, in SQL; a value that is no year matches none."""
    parts = []
    for name, value in filters.items():
        if name == "year":
            parts.append(f"year(promulgated) = {value}" if re.fullmatch("[0-9]{1,9}", value) else "false")
        else:
            column = "gr_number" if name == "docket" else name
            parts.append(f"contains(lower({column}), lower({literal(value)}))")
    return f"coalesce({' AND '.join(parts) or 'true'}, false)"


def anchors(positions: list[str], offsets: list[int]) -> str:
    """The positions at which a phrase begins, in SQL, from those of its words and their distances.

    Positions, moved back by the distances, are intersected as sets, in time linear in them.
    """
    moved = [f"transform({p}, x -> x - {o})" if o else p for p, o in zip(positions, offsets)]
    return reduce(lambda found, p: f"array_intersect({found}, {p})", moved)


def intersect(index: Index, terms: list[str]) -> DataFrame:
    """(doc_id): documents with every term. One aggregate over the postings of the terms alone."""
    found = index.postings.where(f"term IN ({listed(terms)})").groupBy("doc_id").agg(F.expr("count(*) AS n"))
    return found.where(f"n = {len(set(terms))}").select("doc_id")


def union(index: Index, terms: list[str]) -> DataFrame:
    return index.postings.where(f"term IN ({listed(terms)})").select("doc_id").distinct()


def _places(terms: list[str]) -> list[str]:
    """For each term of a phrase its positions in a document, as aggregates _p0, _p1 and so on."""
    return [f"max(CASE WHEN term = {literal(t)} THEN positions END) AS _p{k}" for k, t in enumerate(terms)]


def phrase_matches(index: Index, slots: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, anchor): documents with the phrase, and where it first begins."""
    wanted = sorted({term for term, _ in slots})
    rows = index.postings.where(f"term IN ({listed(wanted)})").groupBy("doc_id").agg(*map(F.expr, ["count(*) AS _n", *_places(wanted)]))
    found = anchors([f"_p{wanted.index(t)}" for t, _ in slots], [o for _, o in slots])
    return rows.where(f"_n = {len(wanted)}").selectExpr("doc_id", f"array_min({found}) AS anchor").where("anchor IS NOT NULL")


def matches(index: Index, query: Query, ranker: Ranker) -> DataFrame:
    """(doc_id, score, scored, first_match) of the documents that a query with terms selects.

    The postings of the query's terms are read once and grouped once by document: conditions,
    phrases and score are aggregates of that group. Weights come from the whole corpus. Expressions
    are written in SQL, as each is then one call from Python.
    """
    weights = query.weights
    dfs = index.doc_freqs(list(weights))
    known = " ".join(f"WHEN {literal(t)} THEN {number(n * ranker.weight(index.n_docs, dfs[t]))}" for t, n in weights.items() if t in dfs)
    weight = f"(CASE term {known} ELSE 0D END)" if known else "0D"
    must, in_phrases = sorted(set(query.terms)), sorted({t for slots in query.slots() for t, _ in slots})
    parts = [f"sum({weight} * {ranker.gain(index)}) AS score", f"max({weight} > 0) AS scored", "min(element_at(positions, 1)) AS _first", *_places(in_phrases)]
    kept = []
    if must:
        parts.append(f"count_if(term IN ({listed(must)})) AS _must")
        kept.append(f"_must = {len(must)}")
    if query.should:
        parts.append(f"max(term IN ({listed(query.should)})) AS _should")
        kept.append("_should")
    rows = index.postings.where(f"term IN ({listed(weights)})").groupBy("doc_id").agg(*map(F.expr, parts))
    begins = [f"array_min({anchors([f'_p{in_phrases.index(t)}' for t, _ in slots], [o for _, o in slots])})" for slots in query.slots()]
    kept += [f"{x} IS NOT NULL" for x in begins]
    rows = rows.where(" AND ".join(kept) or "true").selectExpr("doc_id", "score", "scored", f"coalesce({', '.join([*begins[::-1], '_first'])}) AS first_match")
    if query.filters:
        rows = rows.join(index.docs.where(filter_column(query.filters)).select("doc_id"), "doc_id", "left_semi")
    if isinstance(ranker, TfIdf):
        rows = rows.join(index.docs.select("doc_id", "norm"), "doc_id").selectExpr("doc_id", "score / norm AS score", "scored", "first_match")
    return rows


def search(index: Index, query: Query, ranker: Ranker = BM25(), *, digits: int | None = None) -> DataFrame:
    """(doc_id, score, first_match, rank_key) of all hits; order by rank_key descending, then doc_id.

    If nothing that is eligible has a score, hits are all eligible documents, the latest first. With
    `digits`, scores are rounded before they are compared. An empty query has no hits.
    """
    if query.is_empty:
        return index.docs.limit(0).select("doc_id", F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("first_match"), F.lit(0.0).alias("rank_key"))
    recent = lambda rows: rows.selectExpr("doc_id", "0D AS score", "first_match", "CAST(doc_id AS DOUBLE) AS rank_key")
    if not query.all_terms:
        return recent(index.docs.where(filter_column(query.filters)).selectExpr("doc_id", "CAST(NULL AS INT) AS first_match"))
    found = matches(index, query, ranker)
    score = f"round(score, {digits})" if digits is not None else "score"
    scored = found.where("scored").selectExpr("doc_id", f"{score} AS score", "first_match", f"{score} AS rank_key")
    # which documents have a score follows from the weights, which are known here
    dfs = index.doc_freqs(list(query.weights))
    telling = {t for t, df in dfs.items() if ranker.weight(index.n_docs, df) > 0}
    required = {*query.terms, *(t for slots in query.slots() for t, _ in slots)}
    if isinstance(ranker, BM25) or telling & required:
        return scored
    if not telling:
        return recent(found)
    # some words of a union tell nothing: those who have these alone count if no other is eligible
    some = scored.limit(1).select(F.lit(1).alias("_one"))
    others = found.withColumn("_one", F.lit(1)).join(F.broadcast(some), "_one", "left_anti")
    return scored.unionByName(recent(others))


def page(hits: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """One page of hits, which Spark takes with a bounded heap in each task."""
    ordered = hits.orderBy(F.expr("rank_key").desc(), "doc_id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def top(hits: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page with ranks; numbered after the page is cut, so that one small partition is sorted."""
    return page(hits, limit, offset).selectExpr("*", f"row_number() OVER (ORDER BY rank_key DESC, doc_id) + {offset} AS rank")


def linear_terms(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def linear_search(cases: DataFrame, text: str) -> DataFrame:
    """The baseline without an index: all words in docket, title and body; the score is their count."""
    terms = linear_terms(text)
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "gr_number", "title", "body")), F.lit(r"(?U)\w+"), F.lit(0))
    rows = cases.select("doc_id", words.alias("_w"))
    for term in dict.fromkeys(terms):
        rows = rows.where(F.array_contains("_w", term))
    # a word that is asked for twice counts twice
    count = reduce(lambda a, b: a + b, [F.size("_w") - F.size(F.array_remove("_w", t)) for t in terms], F.lit(0))
    return rows.where(F.lit(bool(terms))).select("doc_id", count.cast("double").alias("score"), count.cast("double").alias("rank_key"))


def _best(rankers: int, k: int):
    """The first k rows of each query under each ranker among the rows that a task reads: (config, query_id, doc_id, score)."""

    def first(scores: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((docs, -scores))[:k]
        return scores[order], docs[order]

    def of(batches):
        kept: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            names, docs = np.asarray(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
            scores = [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]  # null, which is no hit, is NaN
            for name in set(names):
                own = names == name
                for config in range(rankers):
                    x, ids = scores[config][own], docs[own]
                    old = kept.get((config, name))
                    likely = ~np.isnan(x) if old is None or len(old[0]) < k else x >= old[0][-1]
                    if likely.any():
                        x, ids = x[likely], ids[likely]
                        kept[config, name] = first(x, ids) if old is None else first(np.concatenate((old[0], x)), np.concatenate((old[1], ids)))
        rows = [(config, name, int(d), float(x)) for (config, name), own in kept.items() for x, d in zip(*own)]
        if rows:
            types = [pa.int32(), pa.string(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["config", "query_id", "doc_id", "score"])

    return of


def batch(spark: SparkSession, index: Index, queries: dict[str, Query], rankers: list[Ranker], k: int = 10, *, digits: int = 6) -> DataFrame:
    """(config, query_id, rank, doc_id, score): the first k hits of every query under every ranker.

    One pass over the postings of all queries' terms. They alone are shuffled, by document, before the
    queries, a small table with a row for each of their terms, are joined to them; every ranker is a
    column of the one aggregate. A task keeps the first k of each query and ranker in a bounded heap,
    so that hits are neither multiplied by rankers nor sorted. Queries of filters alone rank by recency.
    """
    if not rankers:
        raise ValueError("give at least one ranker")
    live = {i: q for i, q in queries.items() if q.all_terms}
    dfs = index.doc_freqs(sorted({t for q in live.values() for t in q.weights}))
    in_phrases = {i: {t for s in q.slots() for t, _ in s} for i, q in live.items()}
    rows = [
        (i, t, t in q.terms, t in q.should, t in in_phrases[i], [float(n * r.weight(index.n_docs, dfs[t])) for r in rankers])
        for i, q in live.items() for t, n in q.weights.items() if t in dfs
    ]
    asked = spark.createDataFrame(rows, "query_id string, term string, must boolean, should boolean, in_phrase boolean, weights array<double>")
    placed = sorted(set().union(*in_phrases.values()) & set(dfs))
    posted = index.postings.where(F.col("term").isin(sorted(dfs))).select("term", "doc_id", "tf", "length", F.when(F.col("term").isin(placed), F.col("positions")).alias("positions"))
    joined = posted.repartition("doc_id").join(F.broadcast(asked), "term")
    gains = [F.expr(f"sum(element_at(weights, {c + 1}) * {r.gain(index)}) AS s{c}") for c, r in enumerate(rankers)]
    marks = [F.expr(f"max(element_at(weights, {c + 1}) > 0) AS m{c}") for c in range(len(rankers))]
    places = [F.map_from_entries(F.collect_list(F.when(F.col("in_phrase"), F.struct("term", "positions")))).alias("places")] if placed else []
    found = joined.groupBy("query_id", "doc_id").agg(F.count_if("must").alias("n_must"), F.max("should").alias("any_should"), *gains, *marks, *places)
    filtered = {i: f"_f{n}" for n, (i, q) in enumerate(live.items()) if q.filters}
    fits: Callable[[str, Query], Column] = lambda i, q: reduce(
        lambda a, b: a & b,
        [
            (F.col("n_must") == len(set(q.terms))) & (F.col("any_should") if q.should else F.lit(True)),
            *[F.expr(f"coalesce(size({anchors([f'element_at(places, {literal(t)})' for t, _ in s], [o for _, o in s])}) > 0, false)") if placed else F.lit(False) for s in q.slots()],
            *([F.col(filtered[i])] if q.filters else []),
        ],
    )
    normed = any(isinstance(r, TfIdf) for r in rankers)
    if normed or filtered:
        own = [F.expr(f"{filter_column(live[i].filters)} AS {c}") for i, c in filtered.items()]
        found = found.join(index.docs.select("doc_id", *(["norm"] if normed else []), *own), "doc_id")
    kept = reduce(lambda c, x: c.when(F.col("query_id") == x[0], fits(*x)), live.items(), F.when(F.lit(False), F.lit(False))).otherwise(False)
    scores = [f"CASE WHEN m{c} THEN round(s{c} / {'norm' if isinstance(r, TfIdf) else '1D'}, {digits}) END AS c{c}" for c, r in enumerate(rankers)]
    scored = found.where(kept).selectExpr("query_id", "doc_id", *scores).mapInArrow(_best(len(rankers), k), "config int, query_id string, doc_id long, score double")
    scored = scored.withColumn("rank_key", F.col("score"))
    for i, q in queries.items():
        if not q.all_terms and q.filters:
            recent = page(search(index, q), k).select(F.explode(F.array(*[F.lit(c) for c in range(len(rankers))])).alias("config"), F.lit(i).alias("query_id"), "doc_id", "score", "rank_key")
            scored = scored.unionByName(recent)
    order = Window.partitionBy("config", "query_id").orderBy(F.desc("rank_key"), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("config", "query_id", "rank", "doc_id", "score")


__all__ = ["BM25", "TfIdf", "batch", "filter_column", "intersect", "linear_search", "matches", "page", "phrase_matches", "ranker_of", "search", "top", "union", "unit_text"]
