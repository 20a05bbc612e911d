"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, open_folder, read_table

#: Consecutive item words that make a window; a shorter item is one window as a whole.
WINDOW = 10
#: Bytes of item words that one automaton may hold (some hundred times as many in memory); larger
#: benchmarks are read in parts. Bytes of documents that are held while all parts go over them.
AUTOMATON_BYTES = 1 << 20
HELD_BYTES = 32 << 20
#: Bytes of an item's words in one piece; pieces of a longer item overlap, so that no window is lost.
PIECE_BYTES = 64 << 10
#: A document of which more than this share of words is hit goes as a whole.
COVERAGE = 0.8

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_KNOWN = re.compile(rb"\x01+")
_FOLD = bytes(
    c if c >= 0x80 or chr(c).isdigit() else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, with A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


_NONE: dict[int, set[str]] = {}


class Automaton:
    """A generalised suffix automaton over word sequences, which knows the items of each window.

    State k has `step[k]` (word to state), `link[k]` and `length[k]`. A window belongs to the state
    whose lengths include the window's own; `owners` maps state to the items with it there.
    """

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW) -> None:
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(item_id, words) for item_id, text in items if (words := words_of(text))]
        for _, words in sequences:
            state = 0
            for word in words:
                state = self._extend(state, word)
        self.owners: dict[int, dict[int, set[str]]] = {}
        self.shortest = min((min(len(w), window) for _, w in sequences), default=0)
        for item_id, words in sequences:
            self._own(item_id, words)
        self.shorter = self._shorter()
        self.known = frozenset(word for _, words in sequences for word in words)

    def _extend(self, last: int, word: bytes) -> int:
        """Append a word to the sequence that ends in state `last`."""
        if (there := self.step[last].get(word)) is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        fresh = self._state({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = fresh
            at = self.link[at]
        if at >= 0:
            there = self.step[at][word]
            exact = self.length[there] == self.length[at] + 1
            self.link[fresh] = there if exact else self._split(at, word, there)
        return fresh

    def _split(self, at: int, word: bytes, there: int) -> int:
        """Give the shorter sequences of state `there` a state of their own."""
        twin = self._state(dict(self.step[there]), self.link[there], self.length[at] + 1)
        self.link[there] = twin
        while at >= 0 and self.step[at].get(word) == there:
            self.step[at][word] = twin
            at = self.link[at]
        return twin

    def _state(self, step: dict[bytes, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _home(self, state: int, length: int) -> int:
        """The state, up the links, whose lengths include `length`."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _own(self, item_id: str, words: list[bytes]) -> None:
        size, state = min(len(words), self.window), 0
        for i, word in enumerate(words, 1):
            state = self.step[state][word]
            if i >= size:
                self.owners.setdefault(self._home(state, size), {}).setdefault(size, set()).add(item_id)

    def _shorter(self) -> list[int]:
        """For each state the nearest one up its links that owns windows, or -1."""
        nearest = [-1] * len(self.step)
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            up = self.link[state]
            nearest[state] = up if up in self.owners else nearest[up]
        return nearest

    def advance(self, state: int, matched: int, word: bytes) -> tuple[int, int]:
        """The longest match that ends with `word`, from the longest that ended before it."""
        while (there := self.step[state].get(word)) is None:
            state = self.link[state]
            if state < 0:
                return 0, 0
            matched = self.length[state]
        return there, matched + 1

    def windows(self, state: int, matched: int) -> Iterator[tuple[int, set[str]]]:
        """(size, items) of every window that ends here."""
        while state > 0:
            for size, items in self.owners.get(state, _NONE).items():
                if size <= matched:
                    yield size, items
            state = self.shorter[state]


def scan(machine: Automaton, text: bytes | None, block: int = 1 << 20) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, hit spans as [first, end) word numbers, items) of one whole text.

    Only runs of words that occur in some item, long enough for a window, go through the automaton;
    a run at the edge of a block goes through it always, and its match is carried over.
    """
    text = text or b""
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    start = base = state = matched = 0
    known = machine.known.__contains__
    while start < len(text):
        end = start + block
        while end < len(text) and _FOLD[text[end]] != 0x20:
            end += 1
        words = text[start:end].translate(_FOLD).split()
        through = False  # whether the last word of this block belongs to a run
        for run in _KNOWN.finditer(bytes(map(known, words))):
            i, j = run.span()
            if j - i < machine.shortest and i and j < len(words):
                continue
            if i:
                state = matched = 0
            through = j == len(words)
            for k in range(i, j):
                state, matched = machine.advance(state, matched, words[k])
                widest = 0
                for size, found in machine.windows(state, matched):
                    items |= found
                    widest = max(widest, size)
                if widest:
                    first, last = base + k + 1 - widest, base + k + 1
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, last))
        if words and not through:
            state = matched = 0
        base += len(words)
        start = end
    return base, spans, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if merged and merged[-1][1] >= first:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((first, end))
    return merged


def _cut(text: bytes, spans: list[tuple[int, int]], coverage: float, longest: int) -> bytes | None:
    """text without the spans of at least `longest` words; None if they cover more than `coverage`."""
    spans = [s for s in spans if s[1] - s[0] >= longest] if longest else spans
    if not spans:
        return text
    kept, at, ends, total = [], 0, {}, 0
    wanted = {first for first, _ in spans} | {end - 1 for _, end in spans}
    for total, word in enumerate(_WORD.finditer(text), 1):  # noqa: B007
        if total - 1 in wanted:
            ends[total - 1] = word.span()
    if sum(end - first for first, end in spans) > coverage * total:
        return None
    for first, end in spans:
        kept.append(text[at : ends[first][0]])
        at = ends[end - 1][1]
    return b"".join(kept) + text[at:]


def pieces(words: list[bytes], limit: int, window: int = WINDOW) -> Iterator[list[bytes]]:
    """The words of an item in lists of about `limit` bytes, which share all but one word of a window."""
    start = size = 0
    for i, word in enumerate(words):
        size += len(word) + 1
        if size >= limit and i + 1 - start >= window and len(words) - i - 1:
            yield words[start : i + 1]
            start = i + 2 - window
            size = sum(len(w) + 1 for w in words[start : i + 1])
    if words:
        yield words[start:]


def _pieces(batches):
    for batch in batches:
        rows = [(i, b" ".join(p)) for i, text in zip(*(c.to_pylist() for c in batch.columns)) for p in pieces(words_of(text), PIECE_BYTES)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary()))], names=["item_id", "words"])


def parts_of(spark: SparkSession, benchmark: DataFrame, limit: int) -> list[str]:
    """Folders, in the shared folder, of the benchmark's items in parts of about `limit` bytes: one, as a rule.

    Items go from table to table; the driver learns their number of bytes. A null item_id becomes an
    empty string in the digest of ids.
    """
    scratch = Scratch(spark)
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary"))
    rows = scratch.save(rows.mapInArrow(_pieces, "item_id string, words binary").distinct(), "pieces")
    parts = (rows.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // limit + 1
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)).cast("int"))
    path = f"{scratch.root}/parts"
    dealt.repartition(parts, "part").write.partitionBy("part").parquet(path)
    return [f"{path}/part={k}" for k in range(parts)]


@lru_cache(maxsize=1)
def automaton_of(folder: str) -> Automaton:
    """The automaton of one part, which a worker keeps from task to task, until it needs another."""
    files, path = open_folder(folder)
    items: list[tuple[str, bytes]] = []
    if files.get_file_info(path).type == fs.FileType.Directory:  # a part may have no rows
        for info in files.get_file_info(fs.FileSelector(path)):
            if info.base_name.endswith(".parquet"):
                with files.open_input_file(info.path) as source:
                    table = pq.read_table(source, columns=["item_id", "words"])
                items += zip(*(c.to_pylist() for c in table.columns))
    return Automaton(sorted(items))


_FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, spans array<struct<first: long, end: long>>"


def _found(rows: list[tuple[int, list[tuple[int, int]], set[str]]]) -> dict[str, pa.Array]:
    names = [sorted(items) for _, _, items in rows]
    span = pa.struct([("first", pa.int64()), ("end", pa.int64())])
    return {
        "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
        "n_hit": pa.array([sum(e - s for s, e in spans) for _, spans, _ in rows], pa.int64()),
        "n_items": pa.array(map(len, names), pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
        "items": pa.array(names, pa.list_(pa.string())),
        "spans": pa.array([[{"first": s, "end": e} for s, e in spans] for _, spans, _ in rows], pa.list_(span)),
    }


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, limit: int = AUTOMATON_BYTES, cut: bool = False, coverage: float = COVERAGE, longest: int = 0, held: int = HELD_BYTES) -> DataFrame:
    """docs' rows with what of them occurs in the benchmark.

    Without `cut`: doc_id, n_words, n_hit, n_items, items_sha256, items, spans (word numbers).
    With `cut`: the columns of docs, hit spans of at least `longest` words removed from the text;
    documents of which more than `coverage` of the words lie in such spans go. A null text has no
    words and stays null; an empty benchmark hits nothing; items without words make no window.
    Repeated items and ids count once; extra columns are kept (cut) or ignored.

    Workers read the items from the shared folder and hold the automaton of one part, of `limit`
    bytes of items. If there are more parts, a task gathers about `held` bytes of documents, scans
    them with one part after the other, and merges each text's spans; every part is built once for
    so many bytes. No item is left out, and memory depends on neither table's size.
    """
    folders = parts_of(spark, benchmark.select("item_id", "text"), limit)
    if cut:
        schema, columns = docs.schema, docs.columns
        at = columns.index("text")
    else:
        docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
        schema, at, columns = f"doc_id long, {_FOUND}", 1, []

    def scanned(texts: list[bytes | None]) -> list:
        rows = [(0, [], set()) for _ in texts]
        for folder in folders:
            machine = automaton_of(folder)
            for i, text in enumerate(texts):
                n, spans, items = scan(machine, text)
                rows[i] = (n, _merge(rows[i][1] + spans) if rows[i][1] else spans, rows[i][2] | items)
        return rows

    def gathered(batches):
        """The batches as they come, or, for several parts, many at once."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if len(folders) == 1 or sum(x.nbytes for x in waiting) >= held:
                yield waiting
                waiting = []
        if waiting:
            yield waiting

    def find(batches):
        for group in gathered(batches):
            found = scanned([t for batch in group for t in batch.column(1).to_pylist()])
            for batch in group:
                own, found = found[: batch.num_rows], found[batch.num_rows :]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **_found(own)})

    def remove(batches):
        for group in gathered(batches):
            texts = [t for batch in group for t in batch.column(at).cast(pa.binary()).to_pylist()]
            cleaned: list[bytes | None] = list(texts)
            todo = [i for i, t in enumerate(texts) if t]
            while todo:  # what remains on both sides of a cut may make another window
                found = scanned([cleaned[i] for i in todo])
                before, todo = [(i, cleaned[i], hit[1]) for i, hit in zip(todo, found) if hit[1]], []
                for i, text, spans in before:
                    cleaned[i] = _cut(text, spans, coverage, longest)
                    if cleaned[i] and cleaned[i] != text:
                        todo.append(i)
            start = 0
            for batch in group:
                old, new = texts[start : start + batch.num_rows], cleaned[start : start + batch.num_rows]
                start += batch.num_rows
                stays = pa.array([t is None or c is not None for t, c in zip(old, new)], pa.bool_())
                text = pa.array([None if c is None else c.decode("utf-8", "replace") for c in new], pa.string())
                arrays = [text if i == at else batch.column(i) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(stays)

    return docs.mapInArrow(remove if cut else find, schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


#: Windows as strings of words, matched by a hash join, where the operator walks an automaton.
OP4_SQL = r"""
WITH folded AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), sized AS (
  SELECT side, id, w, len(w) AS n FROM folded
), item_windows AS (
  SELECT DISTINCT id AS item_id, least(n, 10) AS k, array_to_string(w[i:i + least(n, 10) - 1], ' ') AS g
  FROM (SELECT id, w, n, unnest(range(1, n - least(n, 10) + 2)) AS i FROM sized WHERE side = 'i' AND n > 0)
), doc_windows AS (
  SELECT id AS doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT id, w, k, unnest(range(1, n - k + 2)) AS i FROM sized, (SELECT DISTINCT k FROM item_windows) WHERE side = 'd' AND n >= k)
), hits AS (
  SELECT DISTINCT doc_id, i, d.k, item_id FROM doc_windows d JOIN item_windows m ON d.k = m.k AND d.g = m.g
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT s.id AS doc_id, CAST(s.n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM sized s LEFT JOIN hit_words h ON s.id = h.doc_id LEFT JOIN hit_items t ON s.id = t.doc_id
WHERE s.side = 'd'
"""
