"""SimHash near-duplicates: 64-bit fingerprints, linked through multi-index hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Scratch, read_table
from lodestone.llm.components import connected

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
SEED = 42
SHINGLE = 3
RADIUS = 3


def word_blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, as lists of those of about `size` bytes, so that long texts stay small."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
        yield text[start:end].split()  # without an argument, bytes split at exactly \x20 and \x09-\x0D
        start = end


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text; zero if it has no words."""
    tail: list[bytes] = []
    ones, total = np.zeros(64, dtype=np.int64), 0
    digest = xxhash.xxh64_digest
    for words in word_blocks((text or b"").lower()):
        words = tail + words
        tail = words[1 - SHINGLE :]
        for k in range(0, len(words) - SHINGLE + 1, 8192):
            part = words[k : k + 8192 + SHINGLE - 1]
            joined = b" ".join(part)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist())
            hashes = np.frombuffer(b"".join([digest(joined[i:j], SEED) for i, j in spans]), np.uint8)
            ones += np.unpackbits(hashes).reshape(-1, 64).sum(axis=0, dtype=np.uint16)
            total += len(part) - SHINGLE + 1
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), one row for each row of docs; fp is the fingerprint's bits as a signed long."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return texts.mapInArrow(_fingerprints, "doc_id long, fp long")


def links(prints: DataFrame) -> DataFrame:
    """(a, b): the pairs of distinct fingerprints that differ in RADIUS bits or fewer.

    With two segments of 32 bits, fingerprints within three bits have one segment that differs in
    one bit at most. Each fingerprint stands in the table under both of its segments and looks up
    the ball of radius one around each. Of two segments one bit apart one has that bit set, so
    clearing set bits is enough: about 17 look-ups a segment in place of 33. Whole distances are
    verified in the join, so that no row leaves it but a link.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    segments = F.posexplode(F.array(low, high)).alias("segment", "value")
    table = prints.select(F.col("fp").alias("b"), segments)
    bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit("value", i) == 1)
    masks = F.transform(bits, lambda i: F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    asked = table.select(F.col("b").alias("a"), "segment", F.explode(F.concat(F.array("value"), masks)).alias("value"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    same = (asked["segment"] == table["segment"]) & (asked["value"] == table["value"])
    found = asked.join(table, same & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.distinct()


def _with_print(batches):
    for batch in batches:
        prints = [fingerprint(None if x is None else x.encode()) for x in batch.column("text").to_pylist()]
        yield batch.append_column("_fp", pa.array(np.array(prints, dtype=np.uint64).view(np.int64)))


def _labelled(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every fingerprint; root tells components apart."""
    prints = scratch.save(fingerprints(docs), "prints")
    classes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected(scratch, links(classes.select("fp")))
    members = scratch.save(roots.join(classes, roots["node"] == classes["fp"]).select("fp", "root", "first"), "members")
    named = scratch.save(members.groupBy("root").agg(F.min("first").alias("component_id")), "named")
    linked = scratch.save(members.join(named, "root").select("fp", "root", "component_id"), "linked")
    labels = classes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    return prints, scratch.save(labels, "class_labels")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Rows of one fingerprint are one class, named by its smallest doc_id; links and components are
    computed between classes, so copies never meet in pairs. Null and blank texts have fingerprint
    zero and link like any other. Rows that repeat an id each get a row. A null doc_id takes part in
    linking but never names a component; if no id is in reach, component_id is null. Other columns
    of docs are ignored; an empty table gives an empty result.
    """
    prints, labels = _labelled(Scratch(spark), docs)
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(labels, "fp").select("doc_id", text, "component_id")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component the document with the smallest id stays.

    Rows that repeat an id are told apart by their fingerprints: of one component one row stays, of
    unlike texts one each. Rows without an id cannot be told apart and all stay.
    """
    scratch = Scratch(spark)
    prints, labels = _labelled(scratch, docs)
    firsts = prints.join(labels, "fp").where("doc_id = component_id")
    kept = scratch.save(firsts.groupBy("doc_id", "root").agg(F.min("fp").alias("_fp")).select("doc_id", "_fp"), "kept")
    clash = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    clash = scratch.save(clash.where("a < b").select("doc_id"), "clash")
    named = docs.where("doc_id IS NOT NULL")
    found = named.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    if clash.isEmpty():
        found = found.dropDuplicates(["doc_id"])
    else:
        unlike = named.join(clash, "doc_id", "left_semi").select(docs.columns)
        unlike = unlike.mapInArrow(_with_print, T.StructType([*unlike.schema.fields, T.StructField("_fp", T.LongType())]))
        unlike = unlike.join(kept, ["doc_id", "_fp"], "left_semi").dropDuplicates(["doc_id", "_fp"]).select(docs.columns)
        found = found.join(clash, "doc_id", "left_anti").dropDuplicates(["doc_id"]).select(docs.columns).unionByName(unlike)
    return found.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read_table(spark, sf_dir, "documents"))
