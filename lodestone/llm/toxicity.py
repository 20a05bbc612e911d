"""Toxicity by a convolutional network over hashed word embeddings, trained and applied in numpy."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, in_fold, labelled, one_each, open_folder, read_table
from lodestone.llm.decontam import _FOLD

BUCKETS = 1 << 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
#: Labelled rows, and words of theirs, that one task trains on; more are dealt to more tasks by a
#: hash of the id. No labelled row is left out.
ROWS, WORDS = 5000, 4_000_000
THRESHOLD = 0.7
_GRID = [round(0.5 + 0.05 * k, 2) for k in range(9)]
#: Parts into which vectors are cut that tasks add up.
_SLOTS = 128
_CACHE = 200_000


def features(word: bytes) -> int:
    """A word's three buckets, of the word and its first four and five bytes, packed into one number."""
    a, b, c = zlib.crc32(word), zlib.crc32(word[:4], 4), zlib.crc32(word[:5], 5)
    return a % BUCKETS << 32 | b % BUCKETS << 16 | c % BUCKETS


def word_features(text: bytes | None, cache: dict[bytes, int], block: int = 1 << 20):
    """Arrays (words, 3) of buckets, one for each block of a whole text."""
    text, start = text or b"", 0
    while start < len(text):
        end = start + block
        while end < len(text) and _FOLD[text[end]] != 0x20:
            end += 1
        found = []
        for word in text[start:end].translate(_FOLD).split():
            packed = cache.get(word)
            if packed is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                packed = cache[word] = features(word)
            found.append(packed)
        start = end
        if found:
            packed = np.array(found, dtype=np.int64)
            yield np.stack((packed >> 32, packed >> 16 & 0xFFFF, packed & 0xFFFF), axis=1)


def document_counts(examples, labels) -> np.ndarray:
    """(2, BUCKETS): by label, the examples that hold each bucket."""
    seen = np.zeros((2, BUCKETS))
    for x, y in zip(examples, labels):
        seen[int(y), np.unique(x)] += 1
    return seen


def weight_of(n: int, positive: float) -> float:
    """What an example of label 1 weighs among n; the others weigh 1."""
    positive = max(1.0, positive)
    return min(5.0, max(0.2, (n - positive) / positive))


@dataclass
class Network:
    """embed: (BUCKETS, DIM); filters[w]: (w * DIM, FILTERS); bias of the filters; out: (len(WIDTHS) * FILTERS,)."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    base: float

    @classmethod
    def start(cls, examples: list[np.ndarray], labels: np.ndarray) -> Network:
        """The network before training on these examples."""
        return cls.of_counts(document_counts(examples, labels), len(labels), int(labels.sum()))

    @classmethod
    def of_counts(cls, seen: np.ndarray, n: int, positive: int) -> Network:
        """Random filters; the first dimension of a bucket starts at its log-odds in n examples, `positive` of label 1."""
        rng = np.random.default_rng(7)
        rates = [(seen[y] + 0.5) / (max(1, count) + 1) for y, count in enumerate((n - positive, positive))]
        embed = rng.normal(0, 0.02, (BUCKETS, DIM))
        embed[:, 0] += np.where(seen.sum(axis=0) >= 2, 0.1 * np.log(rates[1] / rates[0]), -0.05)
        filters = [rng.normal(0, 0.4, (w * DIM, FILTERS)) for w in WIDTHS]
        for f in filters:
            f[::DIM] = np.abs(f[::DIM]) + 0.2
        share = min(0.99, max(0.01, positive / n)) if n else 0.01
        return cls(embed, filters, [np.full(FILTERS, 0.05) for _ in WIDTHS], rng.uniform(0.1, 0.4, len(WIDTHS) * FILTERS), float(np.log(share / (1 - share))) - 1)

    def vectors(self, x: np.ndarray) -> np.ndarray:
        return self.embed[x[:, 0]] + self.embed[x[:, 1]] + self.embed[x[:, 2]]

    def _at(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The vectors of some words of a text; those beyond its end are zero."""
        inside = rows < len(x)
        v = np.zeros((len(rows), DIM))
        v[inside] = self.vectors(x[rows[inside]])
        return v

    def forward(self, x: np.ndarray, block: int = 1 << 14) -> tuple[float, list]:
        """The probability of label 1, and what the backward pass needs: what each pool holds, and from where.

        A text of any length goes by in blocks; a block's windows reach into the next one.
        """
        best, where = np.full((len(WIDTHS), FILTERS), -np.inf), np.zeros((len(WIDTHS), FILTERS), dtype=np.int64)
        for start in range(0, len(x), block):
            n = min(block, len(x) - start)
            v = self._at(x, np.arange(start, start + n + max(WIDTHS) - 1))
            for j, (w, f, c) in enumerate(zip(WIDTHS, self.filters, self.bias)):
                made = sum(v[k : k + n] @ f[k * DIM : (k + 1) * DIM] for k in range(w)) + c
                at = made.argmax(axis=0)
                top = made[at, np.arange(FILTERS)]
                where[j] = np.where(top > best[j], at + start, where[j])
                best[j] = np.maximum(best[j], top)
        pooled = np.maximum(best, 0)
        z = float(pooled.ravel() @ self.out) + self.base
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), [pooled, where]

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out]

    def sums(self) -> list[np.ndarray]:
        """Adagrad's sums before the first step: of each array, and of the base."""
        return [*(np.full_like(a, 1e-2) for a in self.arrays()), np.full(1, 1e-2)]

    def train(
        self, examples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, *,
        sums: list[np.ndarray] | None = None, up: float | None = None, seed: int | tuple[int, ...] = 11,
    ) -> None:
        """Adagrad over single documents; only the windows that win a pool get a gradient.

        Where the examples are some of many, `sums` goes on from earlier rounds, and `up` is the
        weight of label 1 among all.
        """
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, weight_of(len(labels), labels.sum()) if up is None else up, 1.0)
        sums = self.sums() if sums is None else sums
        for _ in range(epochs):
            for i in rng.permutation(len(examples)):
                x = examples[i]
                p, (pooled, where) = self.forward(x)
                d = (p - labels[i]) * weight[i]
                if abs(d) < 1e-3:
                    continue
                sums[-1] += d * d
                self.base -= rate * d / np.sqrt(sums[-1][0])
                back = d * self.out
                g_out = d * pooled.ravel() + 1e-4 * self.out
                rows = np.unique(where.ravel()[:, None] + np.arange(max(WIDTHS)))
                v, moved, place = self._at(x, rows), np.zeros((len(rows), DIM)), np.searchsorted(rows, where)
                for j, w in enumerate(WIDTHS):
                    g = back[j * FILTERS : (j + 1) * FILTERS] * (pooled[j] > 0)
                    windows = np.concatenate([v[place[j] + k] for k in range(w)], axis=1)
                    g_filter, g_windows = windows.T * g, (self.filters[j] * g).T
                    for k in range(w):
                        np.add.at(moved, place[j] + k, g_windows[:, k * DIM : (k + 1) * DIM])
                    self._step(self.filters[j], sums[1 + j], g_filter, rate)
                    self._step(self.bias[j], sums[1 + len(WIDTHS) + j], g, rate)
                self._step(self.out, sums[-2], g_out, rate)
                inside = rows < len(x)
                for k in range(3):
                    at, inverse = np.unique(x[rows[inside], k], return_inverse=True)
                    g = np.zeros((len(at), DIM))
                    np.add.at(g, inverse, moved[inside])
                    sums[0][at] += g * g
                    self.embed[at] -= rate * g / np.sqrt(sums[0][at])

    @staticmethod
    def _step(a: np.ndarray, total: np.ndarray, g: np.ndarray, rate: float) -> None:
        total += g * g
        a -= rate * g / np.sqrt(total)

    def packed(self) -> Network:
        small = lambda a: a.astype(np.float32)
        return Network(small(self.embed), [small(f) for f in self.filters], [small(c) for c in self.bias], small(self.out), self.base)

    def score(self, text: bytes | None, cache: dict[bytes, int], block: int = 1 << 14) -> float:
        """The probability of label 1 for a whole text, whose windows are pooled block by block."""
        wide = max(WIDTHS) - 1
        best = np.full((len(WIDTHS), FILTERS), -np.inf, dtype=np.float32)
        columns = np.concatenate([f[k * DIM : (k + 1) * DIM] for w, f in zip(WIDTHS, self.filters) for k in range(w)], axis=1)
        tail = np.zeros((0, 3), dtype=np.int64)
        for x in word_features(text, cache):
            x = np.concatenate((tail, x))
            for start in range(0, len(x), block):
                self._pool(best, self.vectors(x[start : start + block + wide]) @ columns)
            tail = x[-wide:]
        if len(tail):  # the windows that end beyond the last word
            self._pool(best, np.concatenate((self.vectors(tail), np.zeros((wide, DIM), np.float32))) @ columns)
        pooled = np.maximum(best + np.stack(self.bias), 0).ravel()
        return float(1 / (1 + np.exp(-np.clip(float(pooled @ self.out) + self.base, -30, 30))))

    @staticmethod
    def _pool(best: np.ndarray, made: np.ndarray) -> None:
        at = 0
        for j, w in enumerate(WIDTHS):
            n = len(made) - w + 1
            if n > 0:
                conv = made[:n, at : at + FILTERS]
                for k in range(1, w):
                    conv = conv + made[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
                np.maximum(best[j], conv.max(axis=0), out=best[j])
            at += w * FILTERS


def _examples(batches):
    cache: dict[bytes, int] = {}
    for batch in batches:
        rows = [np.concatenate(found).astype(np.uint16).tobytes() if (found := list(word_features(t, cache))) else b"" for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.binary())], names=["doc_id", "y", "lang", "x"])


@dataclass
class Classifier:
    """A trained network, and by language the score from which a document is rejected."""

    network: Network
    thresholds: dict[str, float]
    default: float = THRESHOLD


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, rows: int = ROWS, words: int = WORDS) -> Classifier:
    """Train on all labelled documents outside the fold crc32(doc_id) mod 3 = 1, and calibrate thresholds by language.

    A fifth of them, by a hash of the id, only sets the thresholds. Without labelled rows of both
    classes the network keeps its prior. Texts of any length are learned from as a whole, and of
    rows that repeat an id one is. What is more than `rows` or `words` is dealt to shards, and each
    epoch is a round in which every shard trains its own copy of the network; the mean of what they
    changed is the next round's. Otherwise the driver is the one shard; a word takes six bytes.
    """
    scratch = Scratch(spark)
    known = scratch.save(labelled(labels.where(~in_fold("doc_id", 3, 1)), "toxic"), "known")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang"), F.col("text").cast("binary").alias("text")).where(~in_fold("doc_id", 3, 1))
    texts = one_each(_sieved(texts, known).join(known.hint("merge"), "doc_id").select("doc_id", "y", "lang", "text"), "doc_id")
    found = scratch.save(texts.mapInArrow(_examples, "doc_id long, y int, lang string, x binary").where(F.length("x") > 0), "examples")
    held = F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string"))) % 5 == 0
    own = found.where(~held)
    n, positive, size = own.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(F.length("x")), F.lit(0))).first()
    shards = max(-(-n // rows), -(-size // (6 * words)))
    if shards > 1:
        network = _train_in_shards(spark, scratch, own, n, positive, shards)
    else:
        mine = sorted(own.select("doc_id", "y", "x").collect(), key=lambda r: r["doc_id"])
        x, y = [_buckets(r["x"]) for r in mine], np.array([r["y"] for r in mine], dtype=np.float64)
        network = Network.start(x, y)
        if 0 < positive < n:
            network.train(x, y)
    thresholds = _calibrate(spark, found.where(held & F.col("lang").isNotNull()), network)
    scratch.drop("known", "examples", "shards")
    return Classifier(network.packed(), thresholds)


def _sieved(texts: DataFrame, known: DataFrame) -> DataFrame:
    """texts without most of those that have no label, so that these aren't shuffled: ids are compared by a bit of a hash.

    Eight bits for each label let an eighth of the others through, and take one broadcast row for eight labels.
    """
    words = known.count() // 8 + 1
    bit = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("sieve")), F.lit(64 * words))
    bits = known.select(bit.alias("bit")).groupBy((F.col("bit") % words).alias("__word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(bit div {words} as int)))").alias("__bits"))
    marked = texts.withColumn("__bit", bit).withColumn("__word", F.col("__bit") % words)
    found = marked.join(F.broadcast(bits), "__word").where(F.expr(f"getbit(__bits, cast(__bit div {words} as int)) = 1"))
    return found.select(*texts.columns)


def _buckets(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint16).reshape(-1, 3)


_PIECES = "slot int, part long, piece binary"


def _pieces(part: int, vector: np.ndarray) -> pa.RecordBatch:
    """A vector as rows (slot, part, piece), which _total() adds up."""
    cut = [p.astype(np.float32).tobytes() for p in np.array_split(vector, _SLOTS)]
    return pa.RecordBatch.from_arrays([pa.array(range(_SLOTS), pa.int32()), pa.array([part] * _SLOTS, pa.int64()), pa.array(cut, pa.binary())], names=["slot", "part", "piece"])


def _total(pieces: DataFrame, tasks: int) -> np.ndarray:
    """The sum of the vectors of all parts, in the order of the parts, slot by slot."""

    def add(table: pa.Table) -> pa.Table:
        made = 0.0
        for piece in table.sort_by("part").column("piece").to_pylist():
            made = made + np.frombuffer(piece, np.float32).astype(np.float64)
        return pa.table({"slot": table.column("slot")[:1].cast(pa.int32()), "total": pa.array([made.tobytes()], pa.binary())})

    totals = pieces.repartition(min(_SLOTS, max(2, tasks)), "slot").groupBy("slot").applyInArrow(add, "slot int, total binary").collect()
    return np.concatenate([np.frombuffer(r["total"], np.float64) for r in sorted(totals, key=lambda r: r["slot"])])


def _shard(folder: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The examples of a shard and their labels, in the order of ids."""
    files, path = open_folder(folder)
    rows: list[tuple[int, int, bytes]] = []
    if files.get_file_info(path).type == fs.FileType.Directory:  # a shard may have no rows
        for info in files.get_file_info(fs.FileSelector(path)):
            if info.base_name.endswith(".parquet"):
                with files.open_input_file(info.path) as source:
                    table = pq.ParquetFile(source).read(columns=["doc_id", "y", "x"])
                rows += zip(*(c.to_pylist() for c in table.columns))
    rows.sort()
    return [_buckets(x) for _, _, x in rows], np.array([y for _, y, _ in rows], dtype=np.float64)


def _train_in_shards(spark: SparkSession, scratch: Scratch, own: DataFrame, n: int, positive: int, shards: int) -> Network:
    """Rounds of an epoch each, whose changes are averaged: of a bucket over the shards that moved it, of the rest over all."""
    folder = f"{scratch.root}/shards"
    dealt = own.select("doc_id", "y", "x", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"))
    dealt.repartition("shard").write.partitionBy("shard").parquet(folder)
    each = spark.range(0, shards, 1, shards)

    def count(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield _pieces(k, document_counts(*_shard(f"{folder}/shard={k}")).ravel())

    network = Network.of_counts(_total(each.mapInArrow(count, _PIECES), shards).reshape(2, BUCKETS), n, positive)
    sums = network.sums()
    for turn in range(EPOCHS if 0 < positive < n else 0):
        sent = spark.sparkContext.broadcast((network, sums, weight_of(n, positive), turn))

        def learn(batches):
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    x, y = _shard(f"{folder}/shard={k}")
                    if x:
                        yield _pieces(k, changes(x, y, k, *sent.value))

        total = _total(each.mapInArrow(learn, _PIECES), shards)
        sent.destroy()
        apply_changes(network, sums, total)
    return network


def changes(x: list[np.ndarray], y: np.ndarray, shard: int, network: Network, sums: list[np.ndarray], up: float, turn: int) -> np.ndarray:
    """What an epoch over a shard changes, as one vector: 1, the buckets it moved, then arrays, sums and base."""
    own = Network(network.embed.copy(), [f.copy() for f in network.filters], [c.copy() for c in network.bias], network.out.copy(), network.base)
    own_sums = [s.copy() for s in sums]
    own.train(x, y, epochs=1, sums=own_sums, up=up, seed=(11, turn, shard))
    moved = (own_sums[0] != sums[0]).any(axis=1)
    pairs = zip([*own.arrays(), *own_sums], [*network.arrays(), *sums])
    return np.concatenate([[1.0], moved, *((a - b).ravel() for a, b in pairs), [own.base - network.base]])


def apply_changes(network: Network, sums: list[np.ndarray], total: np.ndarray) -> None:
    """Add the mean of the shards' changes, given their sum."""
    shards, moved, at = total[0], np.maximum(1, total[1 : 1 + BUCKETS])[:, None], 1 + BUCKETS
    for a in [*network.arrays(), *sums]:
        a += total[at : at + a.size].reshape(a.shape) / (moved if len(a) == BUCKETS else shards)
        at += a.size
    network.base += float(total[at] / shards)


def _calibrate(spark: SparkSession, held: DataFrame, network: Network) -> dict[str, float]:
    """By language, the threshold of the best F1 on all calibration rows; of equals, that nearest THRESHOLD."""
    sent = spark.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            scores = [float(sent.value.forward(_buckets(x))[0]) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.float64())], names=["lang", "y", "p"])

    scored = held.select("lang", "y", "x").mapInArrow(run, "lang string, y int, p double")
    over = [F.col("p") >= t for t in _GRID]
    counts = [F.sum(o.cast("long")).alias(f"n{k}") for k, o in enumerate(over)] + [F.sum(o.cast("long") * F.col("y")).alias(f"hit{k}") for k, o in enumerate(over)]
    found = {}
    for r in scored.groupBy("lang").agg(F.sum("y").alias("y"), *counts).where("y >= 10").collect():
        f1 = [2 * r[f"hit{k}"] / (r[f"n{k}"] + r["y"]) for k in range(len(_GRID))]
        found[r["lang"]] = max(zip(_GRID, f1), key=lambda x: (round(x[1], 6), -abs(x[0] - THRESHOLD)))[0]
    return found


def _with_scores(spark: SparkSession, docs: DataFrame, model: Classifier, columns: list[str]) -> DataFrame:
    """The given columns of docs, and score as the last one."""
    sent = spark.sparkContext.broadcast(model.network)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*columns).dtypes) + ", __text binary"

    def run(batches):
        cache: dict[bytes, int] = {}
        for batch in batches:
            scores = [sent.value.score(t, cache) for t in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [*batch.columns[:-1], pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "__score"])

    rows = docs.select(*columns, F.col("text").cast("binary").alias("__text"))
    return rows.mapInArrow(run, schema.replace("__text binary", "__score double"))


def score(spark: SparkSession, docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, rejected) for every row of docs.

    Null and empty texts get the network's score of no words, a low one. Repeated ids get a row
    each; a null id is never held out. threshold is the language's, or the default where the
    language is null or had too few labels; it decides on `rejected`, never on the score.
    """
    rows = _with_scores(spark, docs.select(F.col("doc_id").cast("long"), "lang", "text"), model, ["doc_id", "lang"])
    rows = rows.withColumnRenamed("__score", "score")
    threshold = F.lit(model.default)
    for lang, t in model.thresholds.items():
        threshold = F.when(F.col("lang") == lang, F.lit(t)).otherwise(threshold)
    rows = rows.withColumn("threshold", threshold)
    return rows.select(
        "doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"),
    )


def keep_clean(spark: SparkSession, docs: DataFrame, model: Classifier) -> DataFrame:
    """docs, in all their columns, without those whose score reaches their language's threshold."""
    rows = _with_scores(spark, docs, model, docs.columns)
    threshold = F.lit(model.default)
    for lang, t in model.thresholds.items():
        threshold = F.when(F.col("lang") == lang, F.lit(t)).otherwise(threshold)
    return rows.where(F.col("__score") < threshold).select(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(spark, docs, fit(spark, docs, read_table(spark, sf_dir, "labels")))
