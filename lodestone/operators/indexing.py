"""Positional postings, vocabulary, document table and corpus statistics, and how they are stored."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.functions.tokens import places, term_table

VERSION = 1
_TABLES = ("docs", "postings", "vocab", "stats")


def cases_of(documents: DataFrame) -> DataFrame:
    """The corpus view over documents(doc_id, text, lang, source)."""
    return documents.select(
        "doc_id",
        F.concat(F.lit("G.R. No. "), (F.lit(100000) + F.col("doc_id")).cast("string")).alias("gr_number"),
        F.lit("").alias("title"),
        F.make_date((F.lit(2010) + F.col("doc_id") % 17).cast("int"), F.lit(1), F.lit(1)).alias("promulgated"),
        F.col("lang").alias("division"),
        F.col("source").alias("ponente"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("source_url"),
        F.col("text").alias("body"),
        F.array().cast("array<string>").alias("separate_opinions"),
        F.lit("").alias("footnotes"),
    )


def unit_text() -> Column:
    """What of a case is searched: docket, title, body and opinions, without those that are empty."""
    parts = F.concat(F.array("gr_number", "title", "body"), F.coalesce("separate_opinions", F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n\n")


def varint_bytes(x: Column) -> Column:
    """Bytes of a number at seven bits a byte."""
    size = F.lit(1)
    for k in range(1, 9):
        size = size + (x >= F.lit(1 << 7 * k)).cast("int")
    return size


@dataclass(frozen=True)
class Index:
    """docs: cases with length, year and norm; postings(term, doc_id, tf, positions, length);
    vocab(term, df, cf, posting_bytes, first_doc, first_pos); stats: one row."""

    docs: DataFrame
    postings: DataFrame
    vocab: DataFrame
    stats: DataFrame
    n_docs: int
    avgdl: float
    asked: dict[str, int] = field(default_factory=dict, compare=False, repr=False)

    def doc_freqs(self, terms: list[str]) -> dict[str, int]:
        """Document frequencies of a query's terms, without those that no document has.

        Each call reads as many rows as there are terms; the last few thousand are remembered.
        """
        if missing := [t for t in terms if t not in self.asked]:
            if len(self.asked) > 10_000:
                self.asked.clear()
                missing = list(dict.fromkeys(terms))  # those remembered until now are forgotten too
            rows = self.vocab.where(F.col("term").isin(missing)).select("term", "df").collect()
            self.asked.update(dict.fromkeys(missing, 0) | {r["term"]: r["df"] for r in rows})
        return {t: self.asked[t] for t in terms if self.asked.get(t)}


def _posted(batches):
    for batch in batches:
        terms, ids, positions, sizes, lengths = [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = places(text or "")
            terms += found
            ids += [doc_id] * len(found)
            counts = list(map(len, found.values()))
            sizes += counts
            lengths += [sum(counts)] * len(found)
            positions += chain.from_iterable(found.values())
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(positions, dtype=np.int32)))
        arrays = [pa.array(terms, pa.string()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), lists, pa.array(lengths, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, names=["term", "doc_id", "tf", "positions", "length"])


def postings_of(cases: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions, length), each document's own, without a shuffle; length is that of the document.

    A posting needs one document alone, so documents are scanned and grouped where they are read, in
    Arrow batches; the alternative, a row for each token, would shuffle the corpus to group it.
    """
    units = storage.spread(cases.select(F.col("doc_id").cast("long"), unit_text().alias("unit")))
    return units.mapInArrow(_posted, "term string, doc_id long, tf int, positions array<int>, length int")


def with_lengths(cases: DataFrame, postings: DataFrame) -> DataFrame:
    """cases with the number of their terms, and the year."""
    lengths = postings.groupBy("doc_id").agg(F.max("length").alias("length"))
    docs = cases.join(lengths, "doc_id", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    return docs.withColumn("year", F.year("promulgated"))


def _varints(x: np.ndarray) -> np.ndarray:
    return 1 + sum((x >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))


def _runs(batches):
    """What the rows of one term that follow one another come to, but for the gap in front of the first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        terms, docs, tf, lists = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64), batch.column(3)
        turn = np.concatenate(([True], np.asarray(pc.not_equal(terms[1:], terms[:-1])) | (docs[1:] <= docs[:-1])))
        at = np.flatnonzero(turn)
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
        begins = offsets[:-1] - offsets[0]  # every posting has a position
        gaps = np.diff(flat, prepend=0)
        gaps[begins] = flat[begins]
        size = np.add.reduceat(_varints(gaps), begins) + _varints(tf) + np.where(turn, 0, _varints(np.diff(docs, prepend=0)))
        last = np.concatenate((at[1:], [len(docs)])) - 1
        columns = {
            "term": terms.take(pa.array(at)), "df": np.diff(at, append=len(docs)), "cf": np.add.reduceat(tf, at), "size": np.add.reduceat(size, at),
            "first": docs[at], "last": docs[last], "pos": flat[begins[at]].astype(np.int32),
        }
        yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def vocabulary(postings: DataFrame) -> DataFrame:
    """(term, df, cf, posting_bytes, first_doc, first_pos) of every term of postings that are stored in order.

    posting_bytes is the size of a term's postings as gaps and variable-length numbers. Postings are
    read in their order and summed in runs of one term; gaps between runs are taken from their first
    and last documents. Runs are as many as terms, and as batches of frequent terms; they alone are
    shuffled.
    """
    runs = postings.select("term", "doc_id", "tf", "positions").mapInArrow(_runs, "term string, df long, cf long, size long, first long, last long, pos int")
    start = F.col("first") - F.coalesce(F.lag("last").over(Window.partitionBy("term").orderBy("first")), F.lit(0))
    return runs.withColumn("size", F.col("size") + varint_bytes(start)).groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.sum("size").cast("long").alias("posting_bytes"), F.min("first").alias("first_doc"), F.min_by("pos", "first").alias("first_pos")
    )


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_tokens"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"), F.lit(VERSION).alias("version"))


#: Terms whose document frequencies norms() broadcasts.
FREQUENT = 100_000


def norms(postings: DataFrame, vocab: DataFrame, n_docs: int, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, norm): length of a document's TF-IDF vector; terms in every document weigh nothing.

    Most postings are of the most frequent terms, `frequent` of which are broadcast: these are weighed and
    summed where documents are read. Postings of all other terms alone are shuffled to meet their frequencies.
    """
    idf = F.log(F.lit(float(n_docs)) / F.col("df"))
    dfs = vocab.select("term", "df")
    hot = F.broadcast(dfs.orderBy(F.desc("df"), "term").limit(frequent))
    rows = postings.select("term", "doc_id", "tf")
    rare = rows.join(hot, "term", "left_anti").join(dfs, "term")
    weights = rows.join(hot, "term").unionByName(rare).where(F.col("df") < n_docs)
    squares = weights.groupBy("doc_id").agg(F.sum(F.pow((1 + F.log("tf")) * idf, 2)).alias("s"))
    return squares.select("doc_id", F.when(F.col("s") > 0, F.sqrt("s")).otherwise(1.0).alias("norm"))


def build(spark: SparkSession, cases: DataFrame, path: str) -> Index:
    """Build the tables of an index under `path`.

    Postings are stored in the order of their terms, so that a query's terms reach few row groups,
    and carry their document's length, so that scoring needs no join. Documents are in the order of
    their ids, so that a page of results reads the texts of its own.
    """
    raw = storage.save(postings_of(cases), f"{path}/raw")
    ordered = raw.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    postings = storage.save(ordered, f"{path}/postings")
    vocab = storage.save(vocabulary(postings), f"{path}/vocab")
    docs = with_lengths(cases, raw)
    docs = docs.join(norms(raw, vocab, cases.count()), "doc_id", "left").withColumn("norm", F.coalesce("norm", F.lit(1.0)))
    docs = storage.save(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id"), f"{path}/docs")
    storage.save(corpus_stats(docs), f"{path}/stats")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    docs, postings, vocab, stats = (spark.read.parquet(f"{path}/{name}") for name in _TABLES)
    row = stats.first()
    if row["version"] != VERSION:
        raise ValueError(f"the index at {path} is of version {row['version']}, not {VERSION}: build it anew")
    return Index(docs, postings, vocab, stats, row["n_docs"], row["avgdl"])


_OPEN: dict[tuple[str, str], Index] = {}


def open_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index over a folder's documents, built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        path = f"{storage.shared_folder(spark)}/index-{uuid.uuid4().hex}"
        storage.delete_on_exit(spark, path)
        _OPEN[key] = build(spark, cases_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), path)
    return _OPEN[key]


def collection_report(index: Index) -> DataFrame:
    """Documents, distinct terms, postings, tokens, mean length and encoded bytes, as one row."""
    vocab = index.vocab.agg(F.count("*").alias("vocabulary"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"), F.coalesce(F.sum("posting_bytes"), F.lit(0)).alias("posting_bytes"))
    return index.stats.select("n_docs", "total_tokens", "avgdl").withColumn("k", F.lit(1)).join(F.broadcast(vocab.withColumn("k", F.lit(1))), "k").drop("k")


def vocabulary_reduction(cases: DataFrame, sample: int = 500) -> DataFrame:
    """Distinct terms of title and body with and without stemming, over the first `sample` cases."""
    first = cases.orderBy("doc_id").limit(sample).select("doc_id", F.concat_ws("\n", "title", "body").alias("_unit"))
    plain = term_table(first, "doc_id", "_unit", stemming=False).agg(F.count_distinct("term").alias("unstemmed"), F.lit(1).alias("k"))
    stemmed = term_table(first, "doc_id", "_unit").agg(F.count_distinct("term").alias("stemmed"), F.lit(1).alias("k"))
    return plain.join(F.broadcast(stemmed), "k").drop("k")
