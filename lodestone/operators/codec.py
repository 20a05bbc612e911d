"""Postings as bytes: gaps and counts at seven bits a byte, in blocks of one term's documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK = "term string, first_doc long, last_doc long, n_docs int, data binary"
#: Documents of one block at most.
BLOCK_DOCS = 4096
#: Bytes of blocks that are decoded at once.
DECODED = 1 << 20


def _encode(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of numbers, and where those of each number end."""
    x = np.asarray(numbers).astype(np.uint64)
    sizes = np.ones(len(x), dtype=np.int64)
    for k in range(1, 10):
        sizes += x >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(x) else 0) - np.repeat(ends - sizes, sizes)
    parts = np.repeat(x, sizes) >> (7 * place).astype(np.uint64) & np.uint64(0x7F)
    more = np.repeat(sizes, sizes) - 1 > place
    return parts.astype(np.uint8) | (more.astype(np.uint8) << 7), ends


def encode(numbers: np.ndarray) -> bytes:
    """Non-negative numbers, the low seven bits first; the last byte of each has no high bit."""
    return _encode(numbers)[0].tobytes()


def decode(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate(([True], x[:-1] < 0x80))) if len(x) else np.zeros(0, np.int64)
    sizes = np.diff(starts, append=len(x))
    place = np.arange(len(x)) - np.repeat(starts, sizes)
    parts = (x & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, starts).astype(np.int64) if len(x) else np.zeros(0, np.int64)


def block_of(docs: np.ndarray, positions: list[np.ndarray]) -> bytes:
    """For each document its gap from the one before, its number of positions, and their gaps."""
    parts: list[np.ndarray] = []
    for gap, own in zip(np.diff(docs, prepend=0), positions):
        parts += [np.array([gap, len(own)]), np.diff(own, prepend=0)]
    return encode(np.concatenate(parts)) if parts else b""


def postings_in(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, positions) of a block."""
    numbers, at, doc = decode(data), 0, 0
    while at < len(numbers):
        doc, n = doc + int(numbers[at]), int(numbers[at + 1])
        yield doc, np.cumsum(numbers[at + 2 : at + 2 + n])
        at += 2 + n


def doc_freqs_in(data: bytes) -> Iterator[tuple[int, int]]:
    """(doc_id, tf) of a block, without its positions."""
    numbers, at, doc = decode(data), 0, 0
    while at < len(numbers):
        doc, n = doc + int(numbers[at]), int(numbers[at + 1])
        yield doc, n
        at += 2 + n


def _encoded(batches):
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        terms, docs, lists = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat, sizes = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), np.diff(offsets)
        begins = offsets[:-1] - offsets[0]
        turn = np.concatenate(([True], np.asarray(pc.not_equal(terms[1:], terms[:-1])) | (docs[1:] <= docs[:-1])))
        in_run = np.arange(n) - np.maximum.accumulate(np.where(turn, np.arange(n), 0))
        starts = np.flatnonzero(in_run % BLOCK_DOCS == 0)
        # all numbers of the batch in one array: gap, count and gaps of positions of each document
        gaps = np.diff(docs, prepend=0)
        gaps[starts] = docs[starts]
        within = np.diff(flat, prepend=0)
        some = sizes > 0
        within[begins[some]] = flat[begins[some]]
        heads = begins + 2 * np.arange(n)
        numbers = np.empty(len(flat) + 2 * n, dtype=np.int64)
        numbers[heads], numbers[heads + 1] = gaps, sizes
        numbers[np.arange(len(flat)) + 2 * np.repeat(np.arange(1, n + 1), sizes)] = within
        data, ends = _encode(numbers)
        cuts = np.concatenate((np.concatenate(([0], ends))[heads[starts]], [len(data)])).astype(np.int32)
        blocks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        counts = np.diff(starts, append=n)
        arrays = [terms.take(pa.array(starts)), pa.array(docs[starts]), pa.array(docs[starts + counts - 1]), pa.array(counts.astype(np.int32)), blocks]
        yield pa.RecordBatch.from_arrays(arrays, names=["term", "first_doc", "last_doc", "n_docs", "data"])


def encoded(postings: DataFrame) -> DataFrame:
    """Blocks of postings(term, doc_id, positions), where they are read: those that follow one another in a term.

    An index stores its postings in the order of terms and documents, so that blocks are long; in
    any other order they are short, and hold the same.
    """
    return postings.select("term", "doc_id", "positions").mapInArrow(_encoded, BLOCK)


def _posted(terms: pa.Array, blocks: pa.Array) -> pa.RecordBatch:
    parts = blocks.to_pylist()
    data = b"".join(parts)
    numbers = decode(data)
    # numbers before each block, from the last bytes of numbers before it
    bytes_before = np.cumsum([0, *map(len, parts)])
    before = np.concatenate(([0], np.cumsum(np.frombuffer(data, np.uint8) < 0x80)))[bytes_before]
    heads, plain, at = [], numbers.tolist(), 0
    while at < len(plain):
        heads.append(at)
        at += 2 + plain[at + 1]
    heads = np.array(heads, dtype=np.int64)
    own = np.searchsorted(before, heads, "right") - 1  # the block of each posting; empty blocks have none
    gaps, sizes = numbers[heads], numbers[heads + 1]
    sums = np.cumsum(gaps)
    first = np.concatenate(([True], own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    docs = sums - np.repeat((sums - gaps)[first], np.diff(np.flatnonzero(first), append=len(own)))
    is_place = np.ones(len(numbers), bool)
    is_place[heads] = is_place[heads + 1] = False
    within = np.concatenate(([0], np.cumsum(numbers[is_place])))
    ends = np.cumsum(sizes)
    flat = within[1:] - np.repeat(within[ends - sizes], sizes)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat.astype(np.int32)))
    return pa.RecordBatch.from_arrays([terms.take(pa.array(own)), pa.array(docs), pa.array(sizes.astype(np.int32)), lists], names=["term", "doc_id", "tf", "positions"])


def _decoded(batches):
    for batch in batches:
        terms, blocks = batch.columns
        # so many blocks at a time as come to DECODED bytes, however many a batch has
        part = np.cumsum(np.asarray(pc.binary_length(blocks), dtype=np.int64)) // DECODED
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield _posted(terms[a:b], blocks[a:b])


def decoded(blocks: DataFrame) -> DataFrame:
    """The postings of blocks."""
    return blocks.select("term", "data").mapInArrow(_decoded, "term string, doc_id long, tf int, positions array<int>")
