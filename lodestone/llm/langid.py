"""Language identification by nearest centroids of TF-IDF vectors of character n-grams."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, hash_share, in_fold, one_each, read_table

WIDTH = 2048
NGRAMS = (1, 2, 3)
CLUSTERS = 4
#: Rows that training uses at most, chosen by a hash of the id. Prediction has no bound.
SAMPLE = 4000
#: Share of a centroid's own training rows that lie within the distance it accepts.
WITHIN = 0.995
UNKNOWN = "und"
_BREAK = 0x20


#: Whether a code point is a letter, which also decides what is `und`.
_IS_LETTER = np.fromiter((chr(p).isalpha() for p in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def grams(text: str | None, block: int = 1 << 18) -> np.ndarray:
    """Counts of a whole text's hashed, lower-cased n-grams; all that is no letter counts as one break.

    Blocks of a long text overlap by as many characters as the longest n-gram has before its last.
    """
    counts = np.zeros(WIDTH)
    text = text or ""
    for start in range(0, len(text), block):
        part = text[max(0, start - max(NGRAMS) + 1) : start + block].lower()
        points = np.frombuffer(part.encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
        own = np.where(_IS_LETTER[points], points, _BREAK)
        own = own[(own != _BREAK) | (np.concatenate(([0], own[:-1])) != _BREAK)]
        for n in NGRAMS:
            mixed = np.full(max(0, len(own) - n + 1), n, dtype=np.uint32)
            for k in range(n):
                mixed = (mixed ^ own[k : k + len(mixed)]) * np.uint32(0x9E3779B1)
            counts += np.bincount(mixed >> np.uint32(32 - 11), minlength=WIDTH)
    return counts


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    """languages[k] and accepted[k] (the least cosine) of centres[k]; idf of each n-gram bucket."""

    languages: list[str]
    centres: np.ndarray
    accepted: np.ndarray
    idf: np.ndarray

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        return _weigh(np.stack([grams(t) for t in texts]), self.idf)

    def nearest(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(centre, cosine) for each text."""
        found = self.vectors(texts) @ self.centres.T
        return found.argmax(axis=1), found.max(axis=1)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centres are rows at even distances by their cosine with the mean."""
    order = (x @ _unit(x.mean(axis=0))).argsort()
    centres = x[order[np.linspace(0, len(x) - 1, min(k, len(x)) + 2).astype(int)[1:-1]]]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = np.stack([_unit(x[own == j].mean(axis=0)) if (own == j).any() else centres[j] for j in range(len(centres))])
    return centres


def train(counts: np.ndarray, languages: list[str]) -> Centroids:
    seen = (counts > 0).sum(axis=0)
    idf = np.log((1 + len(counts)) / (1 + seen)) + 0.1
    x, names = _weigh(counts, idf), np.array(languages, dtype=object)
    found, centres, accepted = [], [], []
    for name in sorted(set(languages)):
        own = x[names == name]
        made = _cluster(own, CLUSTERS)
        cosine = own @ made.T
        for j in range(len(made)):
            near = cosine[cosine.argmax(axis=1) == j, j]
            found.append(name)
            centres.append(made[j])
            accepted.append(float(np.quantile(near, 1 - WITHIN)) if len(near) else 1.0)
    return Centroids(found, np.array(centres).reshape(-1, WIDTH), np.array(accepted), idf)


def _examples(batches):
    for batch in batches:
        x = [grams(t).astype(np.float32).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.binary())], names=["doc_id", "lang", "x"])


def fit(spark: SparkSession, docs: DataFrame, *, sample: int = SAMPLE) -> Centroids:
    """Learn from text and lang of documents outside the fold crc32(doc_id) mod 3 = 1.

    About `sample` ids are learned from, one row each.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold("doc_id", 3, 1))
    known = known.select(F.col("doc_id").cast("long"), "lang", "text")
    share = min(1.0, sample / max(1, known.count()))
    rows = one_each(known.where(hash_share(F.col("doc_id"), "langid", share)), "doc_id")
    found = sorted(rows.mapInArrow(_examples, "doc_id long, lang string, x binary").collect())
    counts = np.array([np.frombuffer(r["x"], np.float32) for r in found]).reshape(len(found), WIDTH)
    return train(counts, [r["lang"] for r in found])


def predict(spark: SparkSession, docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs.

    score is the cosine with the nearest centroid, and rejected says that it is farther than nearly
    all of that centroid's own training rows. A text that is null or has no letter is `und` with
    score 0, rejected; so is every text if nothing was learned. Repeated ids get a row each; a null
    id is never held out; other columns are ignored.
    """
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            m, langs, scores, rejected = sent.value, [], [], []
            texts = batch.column(1).to_pylist()
            for k in range(0, len(texts), 256):
                part = texts[k : k + 256]
                at, cosine = m.nearest(part) if m.languages else (np.zeros(len(part), int), np.zeros(len(part)))
                for text, j, c in zip(part, at.tolist(), cosine.tolist()):
                    known = bool(m.languages) and any(map(str.isalpha, text or ""))
                    langs.append(m.languages[j] if known else UNKNOWN)
                    scores.append(min(1.0, max(0.0, c)) if known else 0.0)
                    rejected.append(not known or c < m.accepted[j])
            columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return rows.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(spark, docs, fit(spark, docs))
