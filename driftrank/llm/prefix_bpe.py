"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding, so an encoding is one
integer per byte: the last token of each prefix. Position ``i`` looks at the tokens that are suffixes of
``data[:i]``; the one whose predecessor (already stored at its start) leaves a boundary that no merge
would cross is the last token. Reading back from the end gives the ids. The table makes appends exact (old
entries never change) and edits local: after an edit, entries are recomputed only until a run as long
as the longest token agrees with the old ones.

A boundary between tokens *a* and *b* is checked on two spines: the tokens that stand at *a*'s right edge
and at *b*'s left edge while their merges run in rank order. The pair is valid if, for every two that
stand there together, their merge does not come before the next merge on either side.

Defined results: null is the empty text with no ids; texts of any length are encoded whole, in pieces;
equal texts give equal ids; empty tables give empty tables; columns named like the outputs are replaced,
others pass through. Work is a narrow map; the rank file is broadcast (a vocabulary, fixed in size). What a worker
remembers is bounded in bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from driftrank.llm.common import map_column, table

#: Bytes of pieces and ids that a worker remembers in each of two generations, at most (about half of them in truth); characters of a piece worth it; pairs of tokens.
REMEMBERED, WORTH, PAIRS = 56 << 20, 64, 200_000
_NEVER = 1 << 60


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in rank_file.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Decoder:
    """Ids back to bytes; needs no more than the list of tokens."""

    def __init__(self, rank_file: bytes):
        ranks = read_ranks(rank_file)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def listed(self, ids) -> bytes:
        """The ids in decimal, one space between."""
        return " ".join(map(self.names.__getitem__, ids)).encode()


class Vocabulary:
    """The ranks of a byte-level BPE, where a token's id is its rank."""

    def __init__(self, rank_file: bytes):
        self.ranks = read_ranks(rank_file)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        self._back: dict[int, int] = {}  # trie over reversed tokens: node << 8 | byte -> node
        self._ends: list[int] = [-1]
        for token, rank in self.ranks.items():
            node = 0
            for byte in reversed(token):
                step = node << 8 | byte
                node = self._back.get(step, 0)
                if not node:
                    node = self._back[step] = len(self._ends)
                    self._ends.append(-1)
            self._ends[node] = rank
        self._spines: dict[int, tuple[list[int], list[int]] | None] = {}
        self._pairs: dict[int, bool] = {}

    def _merge(self, data: bytes, leave: int) -> list[bytes]:
        """The parts of ``data`` when merging stops, or when ``leave`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > leave:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int) -> tuple[list[int], list[int]] | None:
        """Tokens at the left and at the right edge while ``token`` is merged; None if merging never makes it."""
        if token in self._spines:
            return self._spines[token]
        data = self.tokens[token]
        if len(data) == 1:
            found: tuple[list[int], list[int]] | None = ([token], [token])
        else:
            parts = self._merge(data, 2)
            halves = [self._spine(self.ranks[p]) for p in parts]
            whole = len(parts) == 2 and None not in halves
            found = (halves[0][0] + [token], halves[1][1] + [token]) if whole else None
        self._spines[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` apart when their bytes stand together."""
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is not None:
            return known
        ends = self._spine(right)
        if ends is None:  # merging never makes this token
            self._pairs[key] = False
            return False
        xs, ys = self._spine(left)[1], ends[0]
        i = j = 0
        valid = True
        while True:
            next_x = xs[i + 1] if i + 1 < len(xs) else _NEVER
            next_y = ys[j + 1] if j + 1 < len(ys) else _NEVER
            across = self.ranks.get(self.tokens[xs[i]] + self.tokens[ys[j]], _NEVER)
            if across < next_x and across <= next_y and across != _NEVER:
                valid = False
                break
            if next_x == next_y == _NEVER:
                break
            if next_x <= next_y:
                i += 1
            else:
                j += 1
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        self._pairs[key] = valid
        return valid

    def extend(self, data: bytes, last: list[int], upto: int) -> None:
        """Add the last tokens of the prefixes of ``data`` up to the length ``upto`` (``last[0]`` is -1)."""
        back, ends, pairs = self._back.get, self._ends, self._pairs.get
        for end in range(len(last), upto + 1):
            node, at, token = 0, end, -1
            while at:
                at -= 1
                node = back(node << 8 | data[at], 0)
                if not node:
                    break
                found = ends[node]
                if found >= 0:
                    if at:
                        left = last[at]
                        known = pairs(left << 20 | found)
                        if known or known is None and self.fits(left, found):
                            token = found
                            break
                    elif self._spine(found) is not None:
                        token = found
            if token < 0:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last = [-1]
        self.extend(data, last, len(data))
        return self.read_back(last, len(data))

    def read_back(self, last: list[int], at: int) -> list[int]:
        """The ids of the prefix of length ``at``."""
        found = []
        while at:
            token = last[at]
            found.append(token)
            at -= len(self.tokens[token])
        return found[::-1]


class PrefixTable:
    """The unique last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: no stored entry changes."""
        self.data += more
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in the place of ``data[start:stop]``; returns how many entries were computed."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        agree = done = 0
        for end in range(start + 1, len(self.data) + 1):
            self.vocabulary.extend(self.data, self.last, end)
            done += 1
            agree = agree + 1 if end > start + len(new) and old[end - shift] == self.last[end] else 0
            if agree == self.vocabulary.longest:
                self.last += old[end - shift + 1 :]
                break
        return done

    def ids(self, length: int | None = None) -> list[int]:
        """The ids of the prefix of that length, by default of all bytes."""
        return self.vocabulary.read_back(self.last, len(self.data) if length is None else length)


class _Pieces(dict):
    """Piece -> its ids as packed integers; the older generation is dropped when the younger is full, long pieces are not kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older, self.size = vocabulary, {}, 0

    def compute(self, piece: str) -> bytes:
        return array("i", self.vocabulary.encode_piece(piece.encode())).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > WORTH:
            return self.compute(piece)
        packed = self.older.get(piece)
        if packed is None:
            packed = self.compute(piece)
        if self.size >= REMEMBERED:
            self.older, self.size = dict(self), 0
            self.clear()
        self[piece] = packed
        self.size += 200 + 4 * len(piece) + len(packed)
        return packed


class Encoder:
    """Whole texts: each match of ``pattern`` is encoded by itself."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary = Vocabulary(rank_file)
        self.pattern = regex.compile(pattern)
        self._pieces = _Pieces(self.vocabulary)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._pieces.__getitem__, self.pattern.findall(text))), "<i4")


class EditableText:
    """A text with its encoding; an edit re-encodes from a piece before it until the old pieces stand again.

    The pattern may look ahead of a piece, not behind it.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self.pieces = encoder, text, []
        self.pieces = [(m.start(), encoder.encode(m[0])) for m in encoder.pattern.finditer(text)]

    def replace(self, start: int, stop: int, new: str) -> int:
        """Returns the number of pieces that were encoded anew."""
        shift = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        first = max(0, sum(at < start for at, _ in self.pieces) - 2)
        begin = self.pieces[first][0] if self.pieces else 0
        after = {at + shift: i for i, (at, _) in enumerate(self.pieces) if at >= stop}
        fresh, rest = [], []
        for m in self.encoder.pattern.finditer(self.text, min(begin, start)):
            if m.start() >= start + len(new) and m.start() in after:
                rest = [(at + shift, ids) for at, ids in self.pieces[after[m.start()] :]]
                break
            fresh.append((m.start(), self.encoder.encode(m[0])))
        self.pieces = self.pieces[:first] + fresh + rest
        return len(fresh)

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def ids(self) -> list[int]:
        return [int(x) for _, ids in self.pieces for x in ids]


@lru_cache(2)
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(rank_file, pattern)


@lru_cache(2)
def _decoder(rank_file: bytes) -> Decoder:
    return Decoder(rank_file)


DIGESTS = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def _digested(decoder: Decoder, packed: list[bytes]) -> list[pa.Array]:
    """The columns of DIGESTS of lists of ids."""
    rows = []
    for x in packed:
        ids = np.frombuffer(x, "<i4").tolist()
        rows.append((len(ids), hashlib.sha256(decoder.listed(ids)).hexdigest(), hashlib.sha256(decoder.decode(ids)).hexdigest()))
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]


def encode(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the text replaced by ``ids``: a packed little-endian ``binary`` of 32-bit ids."""
    held = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(texts: list) -> list[pa.Array]:
        encoder = _encoder(held.value, pattern)
        return [pa.array([encoder.encode(x or "").tobytes() for x in texts], pa.binary())]

    return map_column(docs, text, {"ids": "binary"}, run)


def decode(encoded: DataFrame, rank_file: bytes, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``data``, the bytes that its ids stand for."""
    held = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def run(packed: list) -> list[pa.Array]:
        decoder = _decoder(held.value)
        return [pa.array([decoder.decode(np.frombuffer(x, "<i4").tolist()) for x in packed], pa.binary())]

    return map_column(encoded, ids, {"data": "binary"}, run, keep=True)


def digests(encoded: DataFrame, rank_file: bytes) -> DataFrame:
    """``ids`` given up for their count and SHA-256, and for the SHA-256 of the bytes they decode to."""
    held = encoded.sparkSession.sparkContext.broadcast(rank_file)

    return map_column(encoded, "ids", DIGESTS, lambda packed: _digested(_decoder(held.value), packed))


def encoded_digests(docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``digests(encode(...))`` in one worker, so that ids need not leave it."""
    held = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(texts: list) -> list[pa.Array]:
        encoder, decoder = _encoder(held.value, pattern), _decoder(held.value)
        return _digested(decoder, [encoder.encode(x or "").tobytes() for x in texts])

    return map_column(docs, text, DIGESTS, run)


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_vocabulary()
    encoded = encoded_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: of every document all columns but the text and its length, and the ids' count and digests."""
    ranks, pattern = public_vocabulary()
    return encoded_digests(docs.drop("n_chars"), ranks, pattern)
