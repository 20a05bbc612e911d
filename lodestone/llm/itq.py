"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, read_table, sample_by_hash
from lodestone.llm.components import connected

LEAST = 0.98
#: Vectors from which the rotation is learned, by a hash of the vector; every vector is indexed.
SAMPLE = 8000
ROUNDS = 30
#: Rows of a bucket up to which it is compared as one block.
BLOCK = 1024
#: The share of pairs right at the threshold that the tables may miss, if bits differ independently.
MISSED = 0.005


def layout(rows: int, least: float = LEAST) -> tuple[int, int]:
    """(segments, bits of each) of the codes of so many vectors.

    A segment has two bits more than it takes to number the vectors, so that unlike vectors seldom
    meet in a bucket, and there are as many segments as it takes for all but MISSED of the pairs of
    cosine `least` to agree in one. Two vectors differ in a bit with the probability of their angle
    over pi. Both grow with the logarithm of the rows, and so do the work and bytes of a row.
    """
    bits = min(30, max(12, math.ceil(math.log2(max(2, rows))) + 2))
    agree = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return max(2, math.ceil(math.log(MISSED) / math.log1p(-agree))) if agree < 1 else 2, bits


def learn(x: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) for codes (v - mean) @ projection > 0, by ITQ over unit vectors x.

    PCA to at most `bits` dimensions, then the rotation that brings the sample closest to the
    corners of the cube: codes and rotation are fitted to each other in turn. If there are fewer
    dimensions than bits, further random rotations of the same space fill the code.
    """
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred / max(1, len(x)))
    parts, rng = [], np.random.default_rng(3)
    while sum(p.shape[1] for p in parts) < bits:
        basis = axes[:, ::-1][:, :bits]
        y = centred @ basis
        rotation = np.linalg.qr(rng.normal(size=(basis.shape[1],) * 2))[0]
        for _ in range(ROUNDS if len(x) else 0):
            u, _, v = np.linalg.svd(np.sign(y @ rotation).T @ y)
            rotation = (u @ v).T
        parts.append(basis @ rotation)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, bits: int) -> np.ndarray:
    """(rows, segments): the code of each row, cut into numbers of `bits` bits."""
    parts = ((x - mean) @ projection > 0).reshape(len(x), projection.shape[1] // bits, bits)
    return parts @ (1 << np.arange(bits, dtype=np.int64))


def _prepared(kind: str):
    """(vec_id, label, dim, key, vector) in batches; key and vector are null where it links with nothing.

    Vectors are kept as bytes in the table's own precision.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for vec_id, vector, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                values = vector.values if vector.is_valid else None
                key = data = dim = None
                if values is not None and len(values) and not values.null_count and label is not None and vec_id is not None:
                    v = np.asarray(values, dtype=kind) + np.dtype(kind).type(0)  # one zero, not two
                    top = np.abs(v).max()
                    if np.isfinite(top) and top > 0:
                        data, dim = v.tobytes(), len(v)
                        key = hashlib.md5(b"%d|%d|" % (label, dim) + data).digest()
                rows.append((vec_id, label, dim, key, data))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["vec_id", "label", "dim", "key", "vector"])

    return run


def _units(vectors: list[bytes], kind: str, dim: int) -> np.ndarray:
    """Unit vectors in double precision; shorter ones are filled up with zeros."""
    x = np.zeros((len(vectors), dim))
    for row, data in zip(x, vectors):
        v = np.frombuffer(data, kind)
        row[: len(v)] = v
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0.0)  # neither huge nor tiny components overflow the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(group: dict[str, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of those of one block that link with another of it.

    A pair is looked at in one bucket only: that of the first segment in which its codes agree.
    links counts vectors, copies included.
    """
    n = len(group["node"])
    linked = group["unit"] @ group["unit"].T >= least
    np.fill_diagonal(linked, False)
    if group["left"] != group["right"]:
        linked &= group["chunk"][:, None] != group["chunk"][None, :]
    for part in group["code"].T[: group["segment"]]:
        linked &= part[:, None] != part[None, :]
    links = linked @ group["copies"]
    root = np.arange(n)
    while True:  # the smallest position in reach
        lower = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
        if (lower == root).all():
            break
        root = lower
    has = links > 0
    return group["node"][has], links[has], group["node"][root][has]


def _blocks(least: float, kind: str):
    """Rows sorted by block, in batches of any size, to the links of each block."""
    names = ["label", "dim", "segment", "value", "left", "right"]

    def settle(rows: pa.Table):
        keys = np.stack([rows.column(c).to_numpy() for c in names])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        own = {c: rows.column(c).to_numpy() for c in ("node", "chunk", "copies")}
        coded = rows.column("code").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        vectors = rows.column("vector").to_pylist()
        found = []
        for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [rows.num_rows]))):
            if b - a > 1:
                group = {c: x[a:b] for c, x in own.items()} | {"code": coded[a:b], "unit": _units(vectors[a:b], kind, int(keys[1, a]))}
                found.append(_compare(group | {"segment": int(keys[2, a]), "left": keys[4, a], "right": keys[5, a]}, least))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["node", "links", "root"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            last = np.stack([rows.column(c).to_numpy() for c in names])
            same = (last == last[:, -1:]).all(axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from settle(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks()
        if held is not None:
            yield from settle(held)

    return run


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    Exact copies are one class, numbered when the table of classes is written. Every class stands in
    a Hamming table under each segment of its code; codes of m segments that differ in fewer than m
    bits always meet in one, and see layout() for the others. Buckets of one class go before vectors
    are attached; a bucket of many rows is cut into blocks that are compared two by two, so that no
    task holds more than two blocks, and gives counts and a spanning forest, never its pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    label or id, link with nothing and are their own component. Vectors of different lengths do not
    link. Rows that repeat an id are a vector each, with their own links; a component is named by the
    smallest id in it. Other columns are ignored, and an empty table gives an empty result.
    """
    scratch = Scratch(spark)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = "<f4" if single else "<f8"
    given = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), given.alias("embedding"), F.col("label").cast("long"))
    rows = scratch.save(rows.mapInArrow(_prepared(kind), "vec_id long, label long, dim int, key binary, vector binary"), "vectors")
    one = F.min_by(F.struct("label", "dim", "vector"), "vec_id").alias("v")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), one)
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("node"), "key", "first", "copies", "v.*"), "classes")
    size = classes.agg(F.max("dim").alias("dim"), F.count("*").alias("n")).first()
    dim, (segments, bits) = size["dim"] or 1, layout(size["n"], least)
    sample = [r[0] for r in sample_by_hash(classes.select("key", "vector"), "key", SAMPLE, "itq").select("vector").collect()]
    fitted = spark.sparkContext.broadcast(learn(_units(sample, kind, dim), segments * bits))

    def encode(batches):
        for batch in batches:
            found = codes(_units(batch.column(4).to_pylist(), kind, dim), *fitted.value, bits)
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * segments), pa.array(found.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], code], names=["node", "copies", "label", "dim", "code"])

    coded = classes.select("node", "copies", "label", "dim", "vector").mapInArrow(encode, "node long, copies long, label long, dim int, code array<int>")
    coded = scratch.save(coded, "codes")

    table = coded.select("node", "label", "dim", F.posexplode("code").alias("segment", "value"))
    bucket = ["label", "dim", "segment", "value"]
    sizes = scratch.save(table.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    parts = F.ceil(F.col("n") / block).cast("int")
    live = table.join(sizes, bucket).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), parts).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    live = live.withColumns({"left": F.least("chunk", "other"), "right": F.greatest("chunk", "other")}).drop("n", "other")
    live = scratch.save(live, "live")
    block_key = [*bucket, "left", "right"]
    # only now do vectors come along, for the places where something can meet
    carried = coded.select("node", "copies", "code").join(classes.select("node", "vector"), "node")
    full = live.join(carried, "node").repartition(*block_key).sortWithinPartitions(*block_key)
    found = scratch.save(full.mapInArrow(_blocks(least, kind), "node long, links long, root long"), "found")
    counts = scratch.save(found.groupBy("node").agg(F.sum("links").alias("links")), "counts")
    roots = connected(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    firsts = classes.select("node", "first").join(roots, "node").groupBy("root").agg(F.min("first").alias("component_id"))
    firsts = scratch.save(firsts, "components")
    named = scratch.save(roots.join(firsts, "root").select("node", "component_id"), "named")
    labels = classes.select("node", "key", "first", "copies").join(counts, "node", "left").join(named, "node", "left")
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    labels = scratch.save(labels.select("key", n_links.alias("n_links"), F.coalesce("component_id", "first").alias("component_id")), "class_labels")
    out = rows.select("vec_id", "key").join(labels, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read_table(spark, sf_dir, "embeddings"))


#: All pairs of a label, and their components.
OP7_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON e.vec_id = l.a
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON e.vec_id = r.a
"""
