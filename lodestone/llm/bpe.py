"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

The encoder reads a word's symbols from left to right and knows, for each position, the last token
of the encoding of what lies before it: the longest token that ends there and that merging keeps
apart from the last token before it. The merge list bounds how far behind a border symbols can stand
that decide on it; once so many have been read, the tokens in front of it are emitted and forgotten.
Words shorter than that are emitted at their end.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import read_table

#: Unicode's white space, which the pre-tokeniser drops.
_SPACES = "\t-\r \x85\xa0  -     　"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII_PIECE = re.compile(rf"{_CONTRACTIONS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_PIECE = regex.compile(rf"{_CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")
_ASCII_PIECE_OR_GAP = re.compile(f"{_ASCII_PIECE.pattern}| ")
_PIECE_OR_GAP = regex.compile(f"{_PIECE.pattern}| ")
_SPACE = re.compile(f"[{_SPACES}]")
_CONTROL = re.compile("[\x1c-\x1f]")
#: Recent words and token pairs that each worker keeps, of each as many again of older ones.
WORDS, PAIRS = 100_000, 100_000
_FINAL = 0x200  # of a word's last symbol, added to its byte
_FIRST = 0x100  # of any other
#: Bits of a symbol, and of a token in a pair of them.
_SYMBOL, _TOKEN = 10, 20
#: What stands in front of a word, and where no token ends.
_START, _NONE = -2, -1
_LETTER = [chr(_FIRST + b) for b in range(256)]
#: Characters up to which a word is encoded in one go and cached.
SHORT = 64
#: Between chunks: as text, and as packed ids, which no token has.
_GAP, _GAP_ID = " ", 0xFFFFFFFF
#: Bytes of text whose chunks are encoded together; longer texts are streamed.
GROUP = 2 << 20

#: What this encoder does, as a tokenizer.json says it. Another setting is refused.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BEFORE = [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def _check(spec: dict) -> None:
    """Whether a tokenizer.json asks for what this encoder does; decode() has no decoder to run, so tokens are joined by spaces."""
    found = {
        "normalizer": spec["normalizer"] == {"type": "Sequence", "normalizers": _NORMAL},
        "pre_tokenizer": spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": _BEFORE},
        "decoder": spec.get("decoder") is None,
        "model": all(spec["model"].get(k) == v for k, v in _MODEL.items()) and bool(spec["model"].get("end_of_word_suffix")),
        "added_tokens": not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]),
    }
    if wrong := [name for name, right in found.items() if not right]:
        raise ValueError(f"the tokenizer's settings are others than this encoder's: {', '.join(wrong)}")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _normal(text: str) -> str:
    """NFC in lower case; a capital sigma becomes the plain small one, wherever it stands."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _flat(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a new binary array."""
    if not len(column):
        return np.zeros(1, np.int32), memoryview(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, "<i4", len(column) + 1)
    return ends, memoryview(data or b"")[: ends[-1]]


def _joined(column: pa.Array, between: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), between)[0].as_py()


class Recent(dict):
    """A cache of bounded size: when it is full, what was not used since the last time goes."""

    def __init__(self, bound: int) -> None:
        super().__init__()
        self.bound, self.older = bound, {}

    def find(self, key):
        """The value, put back among the recent ones if it was about to go; None if there is none."""
        value = self.older.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        self[key] = value


class Codec:
    """Encoder and decoder of a tokenizer.json with word-end BPE."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        _check(spec)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.letters = _byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        spelled = {i: t for t, i in (model["vocab"] | self.added).items()}
        self.names = [spelled.get(i, "") for i in range(max(spelled) + 1)]
        self.spaced = pa.array([f"{name} ".encode() for name in self.names], pa.binary())
        inner = {t: self._inner(t) for t in model["vocab"]}
        self.ids = {inner[t]: i for t, i in model["vocab"].items()}
        self.longest = max(map(len, self.ids))
        # the merge that makes each token: when (its rank), and of which two
        self.pairs: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.ids[inner[left]], self.ids[inner[right]]
            self.pairs[a, b] = rank
            made.setdefault(self.ids[inner[left] + inner[right]], (rank, a, b))
        self.made = made
        del spec, model, inner, spelled  # what follows takes their memory
        self.right_edge, self.left_edge = self._edges(2), self._edges(1)
        # a token that merging its own symbols does not give, or that is made of such, is never part of an encoding
        whole = {i for i in self.ids.values() if i not in made}
        for token, (rank, a, b) in sorted(made.items(), key=lambda x: x[1]):
            if a in whole and b in whole and self._apart(a, b, rank):
                whole.add(token)
        self.ids = {s: i for s, i in self.ids.items() if i in whole}
        self.go, self.back, self.ending = self._automaton()
        self.lookahead = self._lookahead()
        self.kept, self.words = Recent(PAIRS), Recent(WORDS)

    def _inner(self, token: str) -> str:
        """One character a symbol."""
        final = token.endswith(self.suffix)
        symbols = [_FIRST + self.letters[x] for x in (token[: -len(self.suffix)] if final else token)]
        if final:
            symbols[-1] += _FINAL - _FIRST
        return "".join(map(chr, symbols))

    def _edges(self, side: int) -> dict[int, tuple[tuple[int, float], ...]]:
        """What stands at an edge of each token while it is made: (part, the rank that merges it)."""
        parts = {token: (made[side], made[0]) for token, made in self.made.items()}  # shared by all that begin or end with the token
        edges = {}
        for token in self.ids.values():
            chain: list[tuple[int, float]] = [(token, float("inf"))]
            while (part := parts.get(chain[-1][0])) is not None:
                chain.append(part)
            edges[token] = tuple(chain[::-1])
        return edges

    def _apart(self, a: int, b: int, until: float = float("inf")) -> bool:
        """Whether no merge of a rank below `until` crosses the border between tokens a and b.

        A pair across the border merges if both of its parts are still there at its rank. Of equal
        pairs the left one merges first: one inside a comes before it, one inside b after it.
        """
        left, right = self.right_edge[a], self.left_edge[b]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.pairs.get((x, y))
            if rank is not None and rank < until and rank < x_ends and rank <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _automaton(self) -> tuple[dict[int, int], list[int], list[tuple[tuple[int, int], ...]]]:
        """The tokens' trie, with links to the longest other suffix in it, and (token, length) of all that end at a node, the longest first."""
        go: dict[int, int] = {}
        tokens, edges = [_NONE], []
        for text, token in self.ids.items():
            node = 0
            for symbol in map(ord, text):
                following = go.get(node << _SYMBOL | symbol)
                if following is None:
                    following = go[node << _SYMBOL | symbol] = len(tokens)
                    tokens.append(_NONE)
                    edges.append((node, symbol))
                node = following
            tokens[node] = token
        depth, back, ending = [0] * len(tokens), [0] * len(tokens), [()] * len(tokens)
        for node, (parent, _) in enumerate(edges, 1):
            depth[node] = depth[parent] + 1
        for node in sorted(range(1, len(tokens)), key=depth.__getitem__):
            parent, symbol = edges[node - 1]
            if parent:
                back[node] = self._step(go, back, back[parent], symbol)
            ending[node] = ending[back[node]]
            if tokens[node] != _NONE:
                ending[node] = ((tokens[node], depth[node]), *ending[node])
        return go, back, ending

    @staticmethod
    def _step(go: dict[int, int], back: list[int], node: int, symbol: int) -> int:
        """The node of the longest suffix, of what has been read, that begins a token."""
        following = go.get(node << _SYMBOL | symbol)
        while following is None and node:
            node = back[node]
            following = go.get(node << _SYMBOL | symbol)
        return following or 0

    def _lookahead(self) -> int:
        """Symbols behind a border that can decide on it, by the merge list.

        A merge is prevented from the right only if its right part goes into another merge of a
        lower rank, which in turn can be prevented by a still lower one; the longest such chain,
        times the longest token, bounds how far ahead a token's fate can lie.
        """
        reach: dict[int, int] = {}
        for (a, b), _ in sorted(self.pairs.items(), key=lambda x: x[1]):
            parts = [part for part, _ in self.left_edge[b]]
            reach[a] = max(reach.get(a, 0), 1 + max(reach.get(part, 0) for part in parts))
        return self.longest * max(reach.values(), default=1)

    def transduce(self, symbols: Iterable[str], stride: int = 4096) -> Iterator[int]:
        """The ids of one word, emitted once they are stable.

        A token is stable when `lookahead` symbols behind it have been read. Those, at most `stride`
        more, after which what is stable goes out, and one token are all that is held.
        """
        last, size = [_START], [0]  # of the encoding of the symbols that are held
        node, most = 0, self.lookahead + stride
        for symbol in symbols:
            node = self._read(node, ord(symbol), last, size)
            if len(last) > most:
                stable = self._stable(size, len(last) - 1)
                if stable:
                    yield from self._back(last, size, stable)
                    last, size = last[stable:], [0, *size[stable + 1 :]]
        yield from self._back(last, size, len(last) - 1)

    def _read(self, node: int, symbol: int, last: list[int], size: list[int]) -> int:
        """Reads a symbol: adds the last token of the encoding that ends with it, and its length; gives the automaton's next node."""
        node = self._step(self.go, self.back, node, symbol)
        k = len(last)
        for token, length in self.ending[node]:
            if length <= k and self._follows(last[k - length], token):
                last.append(token)
                size.append(length)
                return node
        last.append(_NONE)
        size.append(0)
        return node

    def _follows(self, ahead: int, token: int) -> bool:
        if ahead < 0:
            return ahead == _START
        apart = self.kept.get(ahead << _TOKEN | token)
        if apart is None:
            apart = self._apart(ahead, token)
            self.kept.put(ahead << _TOKEN | token, apart)
        return apart

    def _stable(self, size: list[int], k: int) -> int:
        """The last border of the encoding that all further symbols leave as it is."""
        at = k
        while size[at] == 0 and at:  # symbols that end no token yet
            at -= 1
        while at > max(0, k - self.lookahead):
            at -= size[at]
        return at

    @staticmethod
    def _back(last: list[int], size: list[int], at: int) -> list[int]:
        found = []
        while at > 0:
            found.append(last[at])
            at -= size[at]
        return found[::-1]

    def word(self, piece: str) -> bytes:
        """The ids of one pre-token of at most SHORT characters, packed as little-endian unsigned 32-bit integers."""
        ids = self.words.get(piece) or self.words.find(piece)
        if ids is None:
            ids = next(self._in_order([piece]))
            self.words.put(piece, ids)
        return ids

    @staticmethod
    def _symbols(piece: str) -> Iterator[str]:
        """The symbols of a pre-token, encoded some characters at a time."""
        for start in range(0, len(piece), 4096):
            data = piece[start : start + 4096].encode()
            if start + 4096 < len(piece):
                yield from map(_LETTER.__getitem__, data)
            else:
                yield from map(_LETTER.__getitem__, data[:-1])
                yield chr(_FINAL + data[-1])

    def long_word(self, piece: str) -> Iterator[bytes]:
        """The ids of a pre-token of any length, in packed parts as they are emitted."""
        out = array("I")
        for i in self.transduce(self._symbols(piece)):
            out.append(i)
            if len(out) == 4096:
                yield out.tobytes()
                out = array("I")
        if out:
            yield out.tobytes()

    def _in_order(self, pieces: list[str]) -> Iterator[bytes]:
        """What transduce() gives, packed, for each of the pieces, which are sorted and end far within the lookahead.

        What has been read of a piece stays as it is for the next one, as far as both begin alike.
        """
        go, back, ending, kept = self.go.get, self.back, self.ending, self.kept.get
        last, size, nodes, before = [_START], [0], [0], b""
        for piece in pieces:
            data = piece.encode()
            at, end = 0, min(len(data), len(before)) - 1  # a last symbol is another one
            while at < end and data[at] == before[at]:
                at += 1
            del last[at + 1 :], size[at + 1 :], nodes[at + 1 :]
            before, node, end = data, nodes[at], len(data) - 1
            for k in range(at, end + 1):
                symbol = data[k] + (_FIRST if k < end else _FINAL)
                following = go(node << _SYMBOL | symbol)
                while following is None and node:
                    node = back[node]
                    following = go(node << _SYMBOL | symbol)
                node = following or 0
                for token, length in ending[node]:
                    ahead = last[k + 1 - length]
                    if ahead >= 0:
                        apart = kept(ahead << _TOKEN | token)
                        if apart is None:
                            apart = self._follows(ahead, token)
                        if not apart:
                            continue
                    elif ahead == _NONE:
                        continue
                    last.append(token)
                    size.append(length)
                    break
                else:
                    last.append(_NONE)
                    size.append(0)
                nodes.append(node)
            yield array("I", self._back(last, size, len(data))).tobytes()

    def encode(self, text: str, block: int = 1 << 16) -> Iterator[bytes]:
        """Packed ids of a text, part after part; blocks end in front of white space.

        A text without white space is one block, of which pre-tokens are taken one at a time.
        """
        start = 0
        while start < len(text):
            end = start + block
            if end < len(text):
                space = _SPACE.search(text, end)
                end = space.start() if space else len(text)
            part, start = text[start:end], end
            if len(part) > 2 * block or _CONTROL.search(part):  # str.split() would take these for white space
                yield from self._chunk(part)
                continue
            yield bytes(_flat(self.coded(pa.array([part]))[1])[1])

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Packed ids of the chunks of texts that white space alone separates, and at which of them each text begins.

        No pre-token, composed character or special token reaches over white space, so what stands
        between it is encoded as a whole, and once for all of the texts.
        """
        split = pc.utf8_split_whitespace(texts)
        begins, chunks = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        names = chunks.dictionary
        if not len(names):
            return begins, pa.array([], pa.binary())
        single = pc.greater(pc.utf8_length(names), SHORT).to_numpy(zero_copy_only=False)
        if self.special.search(_joined(names, "")):
            single = single | [bool(self.special.search(name)) for name in names.to_pylist()]
        plain = pc.string_is_ascii(names).to_numpy(zero_copy_only=False)
        kinds = [np.flatnonzero(of) for of in (single, ~single & plain, ~single & ~plain)]
        one_by_one, ascii_only, others = (names.take(pa.array(of)) for of in kinds)
        ids = [
            pa.array([b"".join(self._chunk(name)) for name in one_by_one.to_pylist()], pa.binary()),
            self._short_chunks(ascii_only, plain=True),
            self._short_chunks(others, plain=False),
        ]
        place = np.empty(len(names), np.int32)
        place[np.concatenate(kinds)] = np.arange(len(names), dtype=np.int32)
        return begins, pa.concat_arrays(ids).take(pa.array(place[chunks.indices.to_numpy()]))

    def _short_chunks(self, names: pa.Array, plain: bool) -> pa.Array:
        """What _chunk() gives, for chunks without special tokens, which are all ASCII or all not."""
        if not len(names):
            return pa.array([], pa.binary())
        text = _joined(names, _GAP)
        pieces = _ASCII_PIECE_OR_GAP.findall(text.lower()) if plain else _PIECE_OR_GAP.findall(_normal(text))
        words = self._spelled(set(pieces) - {_GAP}) | {_GAP: _GAP_ID.to_bytes(4, "little")}
        ids = np.frombuffer(b"".join(map(words.__getitem__, pieces)), "<u4")
        gaps = np.flatnonzero(ids == _GAP_ID)
        ends = np.concatenate(([0], gaps - np.arange(len(gaps)), [len(ids) - len(gaps)])).astype(np.int32) * 4
        return pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(ends), pa.py_buffer(np.delete(ids, gaps))])

    def _spelled(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of each of these pre-tokens; those that are not known are encoded in their order."""
        find, known = self.words.find, self.words.get
        spelled, missing = {}, []
        for piece in pieces:
            ids = known(piece) or find(piece)
            if ids is not None:
                spelled[piece] = ids
            elif len(piece) <= SHORT:
                missing.append(piece)
            else:  # normal forms can be longer
                spelled[piece] = b"".join(self.long_word(piece))
        missing.sort()
        for piece, ids in zip(missing, self._in_order(missing)):
            spelled[piece] = ids
            self.words.put(piece, ids)
        return spelled

    def _chunk(self, text: str) -> Iterator[bytes]:
        at = 0
        for special in self.special.finditer(text):
            yield from self._section(text[at : special.start()])
            yield self.added[special[0]].to_bytes(4, "little")
            at = special.end()
        yield from self._section(text[at:])

    def _section(self, text: str) -> Iterator[bytes]:
        if text.isascii():
            found = _ASCII_PIECE.finditer(text.lower())
        else:
            found = _PIECE.finditer(_normal(text))
        for piece in found:
            if piece.end() - piece.start() > SHORT:
                yield from self.long_word(piece[0])
            else:
                yield self.word(piece[0])


@lru_cache(maxsize=2)
def codec_of(text: str) -> Codec:
    """The codec of a tokenizer.json, which a worker keeps, caches included, from task to task."""
    return Codec(text)


class Decoder:
    """Ids to text, fed in parts of any size.

    `tokens` gives what the library's decode gives where the file names no decoder: the tokens as
    the vocabulary spells them, separated by spaces. `text` undoes the byte alphabet too; bytes that
    do not yet make a character wait for those to come, and word ends become spaces.
    """

    def __init__(self, codec: Codec, kind: str = "tokens") -> None:
        self.codec, self.kind, self.started = codec, kind, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.kind == "tokens":
            text = " ".join(map(self.codec.names.__getitem__, ids))
            text, self.started = (f" {text}" if self.started and text else text), self.started or bool(text)
            return text
        return "".join(self.utf8.decode(self._bytes(i)) for i in ids)

    def close(self) -> str:
        return self.utf8.decode(b"", True)

    def _bytes(self, i: int) -> bytes:
        name, codec = self.codec.names[i], self.codec
        if name in codec.added:
            return name.encode()
        word, final = name.removesuffix(codec.suffix), name.endswith(codec.suffix)
        return bytes(codec.letters[x] for x in word) + b" " * final


def _groups(texts: pa.Array) -> Iterator[tuple[pa.Array, bool]]:
    """Texts next to each other, GROUP bytes at most in all, and whether it is one that must be streamed: a longer one, or one with
    control characters that splitting takes for white space."""
    sizes = pc.binary_length(texts).to_pylist()
    start = total = 0
    for k, (size, control) in enumerate(zip(sizes, pc.match_substring_regex(texts, _CONTROL.pattern).to_pylist())):
        alone = control or size > GROUP
        if k > start and (alone or total + size > GROUP):
            yield texts.slice(start, k - start), False
            start, total = k, 0
        total += size
        if alone:
            yield texts.slice(k, 1), True
            start, total = k + 1, 0
    if start < len(sizes):
        yield texts.slice(start), False


def _streamed(codec: Codec, text: str, with_ids: bool) -> tuple[int, str, str, bytes]:
    """Number of tokens, digests of ids and of what they spell, and packed ids of a text of any length."""
    n, made, read, decoder, parts = 0, hashlib.sha256(), hashlib.sha256(), Decoder(codec), []
    for packed in codec.encode(text):
        n += len(packed) // 4
        made.update(packed)
        read.update(decoder.feed(np.frombuffer(packed, "<u4").tolist()).encode())
        if with_ids:
            parts.append(packed)
    return n, made.hexdigest(), read.hexdigest(), b"".join(parts)


def _together(codec: Codec, texts: pa.Array, with_ids: bool) -> Iterator[tuple[int, str, str, bytes]]:
    """The same for each of several texts: a chunk that they share is encoded once."""
    begins, ids = codec.coded(texts)
    ends, packed = _flat(ids)
    bounds = ends[begins] // 4
    ends, spelled = _flat(codec.spaced.take(pa.array(np.frombuffer(packed, "<u4"))))
    rows = zip(bounds[:-1].tolist(), bounds[1:].tolist(), ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist())
    for start, end, first, last in rows:
        ids = packed[4 * start : 4 * end]
        read = spelled[first : max(first, last - 1)]  # without the space behind the last token
        yield end - start, hashlib.sha256(ids).hexdigest(), hashlib.sha256(read).hexdigest(), bytes(ids) if with_ids else b""


_DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def tokens(spark: SparkSession, docs: DataFrame, path: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and the ids if asked for, of every row of docs.

    `path` is a tokenizer.json on the driver; it is sent to the executors with the job. Null and
    empty texts have no tokens. Rows that repeat a doc_id each get a row; other columns are ignored.
    Texts are encoded some megabytes at a time; longer ones are streamed and their digests updated
    part by part, so that they need no more than their own length. The file names no decoder, so what
    the library's decode() gives is the tokens as spelled, with spaces between them: of texts that are
    encoded together it is gathered for all tokens at once, of streamed ones it is a Decoder's.
    """
    with open(path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())

    def run(batches):
        codec = codec_of(spec.value)
        for batch in batches:
            found = []
            for texts, alone in _groups(batch.column(1).fill_null("")):
                if alone:
                    found.append(_streamed(codec, texts[0].as_py(), with_ids))
                else:
                    found.extend(_together(codec, texts, with_ids))
            counts, coded, decoded, ids = zip(*found) if found else [()] * 4
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), values))
                names.append("ids")
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id long, {_DIGESTS}" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, read_table(spark, sf_dir, "documents"), vocabulary_path())
