"""Language-model scores by online logistic context mixing over the word stream of whole texts.

A text is its tokens: lower-cased words, then one end (the byte 255). A token is a row of binary decisions: the code
of a frequent word in a Huffman tree of the training counts, or the code of the escape and then the word's bytes and a
blank, eight decisions a byte. Four bit predictors see the token's decisions so far with 0, 1, 2 and 3 tokens before
it, whatever words these are, and the three longest of them that know something speak; for spelled words three others see
2 to 4 bytes before. A predictor is bit counts, of each decision of a context, and an adaptive map from counts to a probability. The stretched predictions are mixed by weights that a gate
chooses (how much each predictor's context has seen), and the mix is refined by a second adaptive map. Counts are
gathered first. Weights and maps are learned online: each batch of tokens is predicted, scored and only then learned.
A training text is predicted from counts without the occurrence at hand, so its score and that of a held-out text are
of one kind, and a text that occurs twice stands out.

Everything gathered grows with the input. Tokens are dealt by the word before them into parts of about PART tokens, so
all contexts that end in this word are counted in one part. The pairs of a context and a token stand there in the order of
contexts and codes, so the counts of a node are sums over neighbours, apart from those of any other. A context of more than PART training tokens is dealt over
several parts by the token before it, so that longer contexts stay whole, and what follows it is counted over all training
texts and sent to each of these parts. Tokens behind a context of BEFORE tokens that is still larger differ in
nothing but their symbol: each of its parts learns all of its counts, symbol by symbol, and gives the same
scores. Rare words are dealt by range, so that words that begin alike stand together, and a fourth
predictor counts whole beginnings there. Parts of both kinds follow from counts, not from machines, and are worked
through in the order of doc_id or of the words' CRC, so scores do not depend on the cluster. What every task gets is bounded:
HEAD words with their codes, 64 words a range, and spelling tables of four bytes at most, of 2^MOST_BITS slots at most, in
which contexts may meet. Whole beginnings are counted apart, by a hash of 56 bits; only in a range of more than MOST_SPELLED
bytes they have a table of that size too. Within a batch equal decisions are mixed once and learned as often as they occur.

Defined results: a null text is the end alone; a null doc_id is in the training part; equal rows are scored each, and
rows of one doc_id in their order in the table; ties in count of words are broken by their bytes; texts and words of any
length are worked through in pieces; empty tables give empty tables; without training documents all counts are 0;
columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftrank.llm.common import BATCH_BYTES, Scratch, batches as sliced, table

END, BLANK = b"\xff", b" "
#: Words with a code; tokens and distinct rare words of a part, about; tokens and bytes that are learned at once.
HEAD, PART, WORDS_PART = 1 << 18, 1 << 18, 1 << 17
CHUNK, BYTES_AT_ONCE = 4096, 8192
#: Bytes of words whose contexts are told apart together; bytes of a part above which its words are spelled in stretches.
AT_A_TIME, MOST_SPELLED = 1 << 20, 1 << 23
#: Decisions that are mixed at a stretch, learned with the rest of their batch.
AT_ONCE = 16384
#: Tokens before a token, bytes before a byte, that the longest predictors see; predictors of a token at once, the longest that know something.
BEFORE, SPELL, PREDICTORS = 3, (2, 3, 4), 3
LEAST_BITS, MOST_BITS, SHARE = 16, 22, 256
#: Words that a task holds before it gives their counts on; bytes of a text that are split at once.
HELD, PIECE = 300_000, 1 << 20
START = np.uint32((1 << 25) + 1)  # what stands before a text
_RARE = 1 << 24
_CODE_BITS = 20  # of a code, the escape among them
#: Numbers of contexts of BEFORE tokens begin here; codes of one context that are counted together.
_GRAMS, _RANGE_BITS = 1 << 60, 12
_U = np.uint64
_SPACES = re.compile(r"[\x20\x09-\x0D]")

#: Counts are told apart by these steps; a predictor's state is the pair of steps of its zeros and ones.
STEPS = np.array([0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512, 1024, 4096, 16384, 49152])
LEVELS = len(STEPS)
_LEVEL = (np.searchsorted(STEPS, np.arange(1 << 16), side="right") - 1).astype(np.uint16)
_N0, _N1 = np.repeat(STEPS, LEVELS), np.tile(STEPS, LEVELS)
#: How far a state is trusted: nothing seen, once, a few times, more often.
TRUST = np.searchsorted([1, 2, 6], _N0 + _N1, side="right").astype(np.intp)
TRUSTS = 4
MOST_INPUTS = 4
#: By cell, a state and a bit: what a predictor adds to the gate, and the row of the refining map.
_TRUST = [np.repeat(TRUST, 2) * TRUSTS**k for k in range(MOST_INPUTS - 1)]
MAP_STEPS, PRIOR, MAP_PRIOR = 33, 4.0, 30.0
_TOP = np.repeat(TRUST, 2) * MAP_STEPS
RATE, DAMP = 0.15, 30.0
_BITS = np.array([[byte >> 7 - k & 1 for k in range(8)] for byte in range(256)], np.uint8)
_NODES = np.array([[(1 << k) | byte >> 8 - k for k in range(8)] for byte in range(256)], np.uint64)
_BY_NODE, _BY_SLOT = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


def chunks(n: int, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of range(n), from most / 16 on, twice as large after every eight, so that much is learned early."""
    at, k, size = 0, 0, max(1, most >> 4)
    while at < n:
        yield at, min(at + size, n)
        at, k = at + size, k + 1
        if k % 8 == 0:
            size = min(most, 2 * size)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _U(31)) * _U(0xBF58476D1CE4E5B9)
    return h ^ h >> _U(29)


def _slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Places in a table of 2^bits; ``node`` is already multiplied by _BY_NODE."""
    h = context + node
    return ((h ^ h >> _U(32)) * _BY_SLOT >> _U(64 - bits)).astype(np.int64)


def packed(n0: np.ndarray, n1: np.ndarray, most: int = 65535) -> np.ndarray:
    """Two counts in one number, 16 bits each; where one is larger than ``most`` both are scaled down, none to 0."""
    out = np.minimum(n0, most).astype(np.uint32) | np.minimum(n1, most).astype(np.uint32) << np.uint32(16)
    large = np.flatnonzero(np.maximum(n0, n1) > most)
    if len(large):
        pair = np.stack([n0[large], n1[large]]).astype(np.float64)
        a, b = np.where(pair > 0, np.maximum(np.rint(pair / (pair.max(axis=0) / float(most))), 1), 0).astype(np.uint32)
        out[large] = a | b << np.uint32(16)
    return out


def _cells(n0: np.ndarray, n1: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """The state of two counts and the bit that came, in one number; counts above 65535 are scaled down together."""
    if len(n0) and max(n0.max(), n1.max()) > 65535:
        pair = packed(n0, n1)
        n0, n1 = pair & np.uint32(0xFFFF), pair >> np.uint32(16)
    return (_LEVEL.take(n0, mode="clip") * np.uint16(LEVELS) + _LEVEL.take(n1, mode="clip")) * np.uint16(2) + np.asarray(bits, np.uint16)


def path_cells(first: np.ndarray, code: np.ndarray, length: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The cells of all decisions of pairs of a context and a symbol: as counted, and with the symbol itself left out.

    The pairs are in the order of their contexts and codes; ``first``: where a context begins; ``code``: from the highest
    bit on; ``c``: how often the pair was counted. Pairs that share a node stand together, so its counts are sums over
    neighbours, level by level; from where a pair shares no node, only its own symbol was seen.
    """
    n = len(code)
    ends = np.cumsum(length)
    offset = ends - length
    apart = code[1:] ^ code[:-1]
    apart &= ~(apart >> _U(1))  # its highest bit alone decides
    shared = np.full(n + 1, -1)  # decisions that a pair has in common with the one before
    shared[1:n] = np.where(first[1:], -1, 64 - np.frexp(apart.astype(np.float64))[1])
    depth = np.maximum(shared[:-1], shared[1:])
    none, c = np.zeros(n, np.int64), c.astype(np.int64)
    less = np.maximum(c - 1, 0)
    alone = np.stack([_cells(c, none, 0), _cells(less, none, 0), _cells(none, c, 1), _cells(none, less, 1)], axis=1).view(np.uint32)
    alone, out = alone.ravel(), np.empty(int(ends[-1]) if n else 0, np.uint32)
    for a in range(0, n, AT_ONCE):
        b = min(a + AT_ONCE, n)
        size = length[a:b]
        low, high = int(offset[a]), int(ends[b - 1])
        shift = np.repeat(offset[a:b] + 63 - low, size) - np.arange(high - low)
        at = (np.repeat(code[a:b], size) >> shift.astype(np.uint64) & _U(1)).astype(np.intp)
        at += np.repeat(np.arange(2 * a, 2 * b, 2), size)
        out[low:high] = alone.take(at, mode="clip")
    alive, d = np.flatnonzero(depth >= 0), 0
    while len(alive):
        starts = np.flatnonzero(shared[alive] < d)
        bit, weight = (code[alive] >> _U(63 - d) & _U(1)).astype(np.int64), c[alive]
        n1 = np.add.reduceat(weight * bit, starts)
        n0 = np.add.reduceat(weight, starts) - n1
        less0, less1 = np.maximum(n0 - 1, 0), np.maximum(n1 - 1, 0)
        node = np.stack([_cells(n0, n1, 0), _cells(less0, n1, 0), _cells(n0, n1, 1), _cells(n0, less1, 1)], axis=1).view(np.uint32)
        out[offset[alive] + d] = node.ravel().take(np.repeat(np.arange(len(starts)) * 2, np.diff(starts, append=len(alive))) + bit, mode="clip")
        d += 1
        alive = alive[depth[alive] >= d]
    return out.view(np.uint16)


class Mixer:
    """Adaptive maps of the predictors' states, gated weights, and the refining map.

    ``whole``: the first predictor's counts stay as they are. A Huffman tree puts like counts side by side, so those of
    its own nodes, less the occurrence at hand, would give the answer away.
    """

    def __init__(self, inputs: int, whole: bool = False):
        self.inputs, self.whole = inputs, whole
        gates = TRUSTS ** (inputs - 1)
        start = (_N1 + 0.4) / (_N0 + _N1 + 0.8)
        self.states = np.stack([np.stack([start * PRIOR, np.full(LEVELS * LEVELS, PRIOR)]) for _ in range(inputs)])
        trust = np.stack([np.arange(gates) // TRUSTS**k % TRUSTS for k in range(inputs - 1)] or [np.zeros(1)], axis=1)
        self.weights = np.zeros((gates, inputs))
        rest = np.ones(gates)
        for k in reversed(range(1, inputs)):  # the longest contexts that have seen something get most
            share = np.array([0.0, 0.4, 0.6, 0.8])[trust[:, k - 1].astype(int)] * rest
            self.weights[:, k] = share
            rest = rest - share
        self.weights[:, 0] = rest
        p = 1 / (1 + np.exp(-np.linspace(-8, 8, MAP_STEPS)))
        self.map = np.stack([np.tile(p * MAP_PRIOR, (TRUSTS, 1)), np.full((TRUSTS, MAP_STEPS), MAP_PRIOR)])
        self.curve = np.full((gates, inputs), DAMP)
        self.batch = 0

    def log10(self, counts: list[np.ndarray], bits: np.ndarray, own: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
        """The log10 probability of each bit; then learns the bits with their ``weight``, if there is one.

        ``counts``: packed, one array a predictor, the shortest context first; ``own``: 1 where the bit itself was counted.
        """
        less = own.astype(np.uint32) << (bits.astype(np.uint32) << np.uint32(4))
        pairs = [pair if self.whole and not k else pair - less for k, pair in enumerate(counts)]
        return self.mixed([_cells(pair & np.uint32(0xFFFF), pair >> np.uint32(16), bits).astype(np.intp) for pair in pairs], weight)

    def mixed(self, cells: list[np.ndarray], weight: np.ndarray | None) -> np.ndarray:
        """The same of cells, from which the bit itself was left out if it was counted; equal decisions are mixed once."""
        one, which = _distinct(cells)
        if weight is not None:
            weight = np.bincount(which, weight, len(one))
        return self._mixed([c.take(one, mode="clip") for c in cells], weight).take(which, mode="clip")

    def _mixed(self, cells: list[np.ndarray], weight: np.ndarray | None) -> np.ndarray:
        # places are in bounds; mode="clip" spares their check, which takes as long as the rest
        n, gates, every = len(cells[0]), len(self.weights), 2 * LEVELS * LEVELS
        logit = [np.repeat(np.log(ones / (all_ - ones)).astype(np.float32), 2) for ones, all_ in self.states]
        columns = np.ascontiguousarray(self.weights.T, np.float32)
        ratio = (self.map[0] / self.map[1]).astype(np.float32).ravel()
        rise = np.diff(ratio, append=ratio[-1:])
        spreads = weight is not None and (self.batch < 8 or self.batch % 8 == 0)
        seen = np.zeros((self.inputs, every))
        near, steps, curve = np.zeros(2 * ratio.size), np.zeros((self.inputs, gates)), np.zeros((self.inputs, gates))
        lanes = np.arange(min(n, AT_ONCE)) % 8 * gates  # neighbours are added up apart, as they often have the same gate
        out = np.empty(n, np.float32)
        for a in range(0, n, AT_ONCE):  # what is worked on stays in the cache
            b = min(a + AT_ONCE, n)
            here = [c[a:b] for c in cells]
            gate = np.zeros(b - a, np.intp) if self.inputs == 1 else _TRUST[0].take(here[1], mode="clip")
            for k in range(2, self.inputs):
                gate += _TRUST[k - 1].take(here[k], mode="clip")
            x = [table.take(c, mode="clip") for table, c in zip(logit, here)]
            z = x[0] * columns[0].take(gate, mode="clip")
            for k in range(1, self.inputs):
                z += x[k] * columns[k].take(gate, mode="clip")
            p = np.clip(z, -20, 20)
            np.negative(p, out=p)
            np.exp(p, out=p)
            p += np.float32(1)
            np.reciprocal(p, out=p)
            at = np.clip(z, -7.999, 7.999, out=z)
            at += np.float32(8)
            at *= np.float32((MAP_STEPS - 1) / 16)
            low = at.astype(np.int32)
            at -= low.astype(np.float32)
            low = low.astype(np.intp)
            low += (_TOP.take(here[-1], mode="clip") if self.inputs > 1 else 0)
            mix = rise.take(low, mode="clip")
            mix *= at
            mix += ratio.take(low, mode="clip")
            mix += p
            mix *= np.float32(0.5)
            np.clip(mix, 1e-6, 1 - 1e-6, out=mix)
            bit = here[0] & 1
            ones = bit.astype(np.float32)
            np.subtract(ones, mix, out=mix)
            np.abs(mix, out=mix)
            np.subtract(np.float32(1), mix, out=mix)
            np.log(mix, out=out[a:b])
            if weight is None:
                continue
            w = weight[a:b]
            light = w.astype(np.float32)
            error = (ones - p) * light
            spread = p * (1 - p) * light if spreads else None  # the curvature of the cost along each weight
            gate += lanes[: b - a]
            for k in range(self.inputs):
                seen[k] += np.bincount(here[k], w, every)
                steps[k] += np.bincount(gate, error * x[k], 8 * gates).reshape(8, -1).sum(axis=0)
                if spread is not None:
                    curve[k] += np.bincount(gate, spread * x[k] * x[k], 8 * gates).reshape(8, -1).sum(axis=0)
            low += at > 0.5
            low *= 2
            low += bit
            near += np.bincount(low, w, len(near))
        out *= np.float32(1 / np.log(10))
        if weight is not None:
            self._learn(seen, steps, curve if spreads else None, near)
        return out

    def _learn(self, seen: np.ndarray, steps: np.ndarray, curve: np.ndarray | None, near: np.ndarray) -> None:
        for k in range(self.inputs):
            _count(self.states[k], seen[k])
            if curve is not None:
                self.curve[:, k] = np.maximum(curve[k] + DAMP, 0.5 * self.curve[:, k])
            self.weights[:, k] += RATE * steps[k] / self.curve[:, k]
        _count(self.map, near)
        self.batch += 1


def _one_each(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and which of these each key is."""
    found, which = np.unique(key, return_inverse=True)
    one = np.empty(len(found), np.int64)
    one[which] = np.arange(len(key))
    return one, which


def _distinct(cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stand for all, and which of these each row is equal to; some rows that meet others in a slot stand for themselves."""
    key, here = cells[0], np.arange(len(cells[0]), dtype=np.int32)
    for c in cells[1:]:
        key = key * (2 * LEVELS * LEVELS) + c
    slot = key.view(np.uint64) * _BY_NODE
    slot ^= slot >> _U(32)
    slot = (slot * _BY_SLOT >> _U(64 - 17)).view(np.int64)
    last = np.empty(1 << 17, np.int32)
    last[slot] = here
    one = last.take(slot, mode="clip")
    one = np.where(key.take(one, mode="clip") == key, one, here)
    stands = one == here
    return np.flatnonzero(stands), (np.cumsum(stands) - 1).take(one, mode="clip")


def _count(totals: np.ndarray, found: np.ndarray) -> None:
    both = found.reshape(*totals[0].shape, 2)
    totals[0] += both[..., 1]
    totals[1] += both.sum(axis=-1)


class Code:
    """A Huffman code: of symbol ``s`` the decisions ``start[s]`` to ``start[s] + length[s]`` of ``nodes`` and ``bits``; packed counts by node."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        order = np.argsort(weights, kind="stable")
        leaf = weights[order].tolist()
        parent, side = [0] * max(1, 2 * n - 1), [0] * max(1, 2 * n - 1)
        joined, i, j = [], 0, 0
        counts = []
        for node in range(n - 1):
            pair = []
            for _ in range(2):
                if j >= len(joined) or i < n and leaf[i] <= joined[j]:
                    pair.append((i, leaf[i]))
                    i += 1
                else:
                    pair.append((n + j, joined[j]))
                    j += 1
            for bit, (child, _) in enumerate(pair):
                parent[child], side[child] = n + node, bit
            counts.append((pair[0][1], pair[1][1]))
            joined.append(pair[0][1] + pair[1][1])
        root, up, which = max(0, 2 * n - 2), np.array(parent), np.array(side, np.uint8)
        at, found = np.arange(n), []
        alive = np.flatnonzero(at != root)
        while len(alive):
            here = at[alive]
            found.append((alive, up[here] - n, which[here]))
            at[alive] = up[here]
            alive = alive[at[alive] != root]
        length = np.zeros(n, np.int64)
        for who, *_ in found:
            length[who] += 1
        start = np.cumsum(length) - length
        nodes, bits = np.zeros(int(length.sum()), np.int32), np.zeros(int(length.sum()), np.uint8)
        path = np.zeros(n, np.uint64)
        for step, (who, node, bit) in enumerate(found):
            place = start[who] + length[who] - 1 - step
            nodes[place], bits[place] = node, bit
            path[who] |= bit.astype(np.uint64) << (64 - length[who] + step).astype(np.uint64)
        self.nodes, self.bits, self.length, self.start = nodes, bits, np.empty(n, np.int64), np.empty(n, np.int64)
        self.length[order], self.start[order] = length, start
        both = np.array(counts, np.int64).reshape(-1, 2)
        self.counts = packed(both[:, 0], both[:, 1])
        # each symbol's decisions from the highest bit of a number on, and its place in their order; cells of the decisions
        self.path, self.rank = np.empty(n, np.uint64), np.empty(n, np.int64)
        self.path[order] = path
        self.by_rank = np.argsort(self.path, kind="stable")
        self.rank[self.by_rank] = np.arange(n)
        pair = self.counts.take(nodes) if len(nodes) else np.zeros(0, np.uint32)
        self.cells = _cells(pair & np.uint32(0xFFFF), pair >> np.uint32(16), bits)

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes, bits and the number of decisions of a row of symbols."""
        n = self.length[symbols]
        at = np.repeat(self.start[symbols] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return self.nodes.take(at), self.bits.take(at), n


def contexts_of(before: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Hashes of the contexts of 1, 2, ... tokens."""
    context = np.zeros(len(before[0]), np.uint64)
    for k, x in enumerate(before, 1):
        context = _mix(context + (x.astype(np.uint64) + _U(k)) * _U(0xA0761D6478BD642F))
        yield context


def first_of(sorted_: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted row."""
    return np.concatenate([np.ones(min(1, len(sorted_)), bool), sorted_[1:] != sorted_[:-1]])


def _among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places in a sorted row; -1: not there."""
    if not len(sorted_):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


class Followers:
    """What follows the contexts of one length that have more tokens than a part: whole counts of all training tokens.

    ``lists``: for each context its hash, the symbols behind it and how often each comes.
    """

    def __init__(self, code: Code, lists: list[tuple[int, np.ndarray, np.ndarray]]):
        lists = sorted(lists, key=lambda x: x[0])
        self.hashes = np.array([h for h, *_ in lists], np.uint64)
        self.symbols, self.times = [x for _, x, _ in lists], [x for *_, x in lists]
        self.totals = np.array([int(x.sum()) for x in self.times], np.int64)
        self.pairs = []
        for symbols, times, total in zip(self.symbols, self.times, self.totals.tolist()):
            nodes, bits, n = code.decisions(symbols)
            pairs = np.bincount(nodes.astype(np.intp) * 2 + bits, np.repeat(times, n), 2 * len(code.counts))
            self.pairs.append(pairs.astype(np.uint32 if total < 1 << 32 else np.int64).reshape(-1, 2))

    def of(self, row: int, nodes: np.ndarray, bits: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Packed counts at nodes; an own bit is left out before they are scaled, and put back for the mixer, which leaves it out."""
        both = self.pairs[row][nodes].astype(np.int64)
        n0, n1 = both[:, 0] - (own & (bits == 0)), both[:, 1] - (own & (bits == 1))
        return packed(n0, n1, 65534) + (own.astype(np.uint32) << (bits.astype(np.uint32) << np.uint32(4)))

    def cells(self, row: int, nodes: np.ndarray, bits: np.ndarray, own: np.ndarray) -> np.ndarray:
        both = self.pairs[row][nodes].astype(np.int64)
        return _cells(both[:, 0] - (own & (bits == 0)), both[:, 1] - (own & (bits == 1)), bits)


def score_followers(code: Code, rows: list[tuple[Followers, int]], first: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The log10 probability of each symbol behind one context, in a training and in a held-out text.

    ``rows``: the context and those that it ends in, the shortest first; ``first``: packed counts of nodes of a
    predictor before them, if there is one. All training tokens behind the context are learned, each symbol at once.
    """
    known, times = rows[-1][0].symbols[rows[-1][1]], rows[-1][0].times[rows[-1][1]]
    order = np.argsort(_mix(known.astype(np.uint64) * _BY_NODE), kind="stable")  # no order that means something
    rest = np.setdiff1d(np.arange(len(code.length)), known)
    mixer, out = Mixer(len(first) + len(rows), whole=bool(first)), np.zeros((2, len(code.length)))

    def score(part: np.ndarray, weight: np.ndarray | None, own: bool) -> None:
        nodes, bits, n = code.decisions(part)
        if len(bits):
            own_ = np.full(len(bits), own)
            found = [x.take(nodes) for x in first] + [f.of(row, nodes, bits, own_) for f, row in rows]
            logs = mixer.log10(found, bits, own_, None if weight is None else np.repeat(weight, n).astype(np.float64))
            out[int(not own), part] = np.bincount(np.repeat(np.arange(len(part)), n), logs, len(part))

    for a, b in chunks(len(order), CHUNK):
        part = order[a:b]
        score(known[part], None, False)
        score(known[part], times[part], True)
    for a in range(0, len(rest), CHUNK):
        score(rest[a : a + CHUNK], None, False)
    return out[0], out[1]


def score_part(code: Code, symbols: np.ndarray, before: list[np.ndarray], train: np.ndarray, lists: list[tuple[int, int, np.ndarray, np.ndarray]] = ()) -> np.ndarray:
    """The log10 probability of each token of a part, in the order in which they are learned.

    ``before``: the tokens 1, 2, ... places ahead; ``train``: whether the token is counted and learned; ``lists``: of
    the contexts that have tokens in other parts too the length, hash, symbols behind them and how often they come.
    """
    rows, pairs = [], []
    # a context is of use if a training token other than the one at hand has it; what a shorter context does not share
    # with any token, a longer one does not
    longest, shared = np.zeros(len(symbols), np.int64), np.arange(len(symbols))
    followers = [Followers(code, [x for length, *x in lists if length == k]) for k in range(1, len(before) + 1)]
    places = _U((1 << len(code.length).bit_length()) - 1)
    for k, context in enumerate(contexts_of(before), 1):
        row = _among(followers[k - 1].hashes, context)
        rows.append(row)
        learned, here = train[shared], row[shared] < 0
        seen, every = np.zeros(len(shared), np.int64), np.full(len(shared), 2)
        if not here.all():
            seen[~here] = followers[k - 1].totals[row[shared[~here]]]
        mine = shared[here]
        found, which = np.unique(context[mine] & ~places | code.rank[symbols[mine]].astype(np.uint64), return_inverse=True)
        c = np.bincount(which, learned[here], len(found)).astype(np.int64)
        first = first_of(found & ~places)
        group = np.cumsum(first) - 1
        seen[here] = np.bincount(group, c).astype(np.int64)[group[which]]
        every[here] = np.bincount(group, np.bincount(which, minlength=len(found))).astype(np.int64)[group[which]]
        useful = shared[seen > learned]
        longest[useful[longest[useful] == k - 1]] = k
        # decisions of the pairs whose tokens the context may serve
        asked = np.bincount(which, longest[mine] >= k, len(found)) > 0
        keep = (np.bincount(group, asked) > 0)[group] & (asked | (c > 0))
        number = np.cumsum(keep) - 1
        symbol = code.by_rank[(found[keep] & places).astype(np.int64)]
        length = code.length[symbol]
        offset = np.full(len(symbols), -1)
        offset[mine] = (np.cumsum(length) - length)[number[which]] if len(length) else -1
        known = path_cells(first_of(group[keep]), code.path[symbol], length, c[keep])
        pairs.append((offset, known if len(known) else np.zeros(2, np.uint16)))
        shared = shared[every > 1]
    out = np.zeros(len(symbols))
    # tokens of a longest context with a list differ in nothing but their symbol
    low = max(0, len(before) + 1 - PREDICTORS)
    for row in range(len(followers[-1].hashes)):
        mine = np.flatnonzero(rows[-1] == row)
        if len(mine):
            longest[mine] = -1
            ends = [(f, int(r[mine[0]])) for f, r in list(zip(followers, rows))[max(0, low - 1) :]]
            learned, fresh = score_followers(code, ends, [] if low else [code.counts])
            out[mine] = np.where(train[mine], learned[symbols[mine]], fresh[symbols[mine]])
    for k in range(len(before) + 1):
        low = max(0, k + 1 - PREDICTORS)
        mixer, mine = Mixer(k + 1 - low, whole=low == 0), np.flatnonzero(longest == k)
        for part in (mine[a:b] for a, b in chunks(len(mine), CHUNK)):
            # tokens of a batch that have symbol and context in common are mixed once
            key = 2 * (pairs[k - 1][0][part] if k else symbols[part].astype(np.int64)) + train[part]
            if k and len(followers[k - 1].hashes):
                key = np.where(rows[k - 1][part] < 0, key, -1 - np.arange(len(part)))
            one, which = _one_each(key)
            some, times = part[one], np.bincount(which)
            n, own = code.length[symbols[some]], train[some]
            starts = np.cumsum(n) - n
            steps = np.arange(int(n.sum()))
            if not len(steps):
                continue
            twice = 2 * steps
            at = np.repeat(code.start[symbols[some]] - starts, n) + steps if not low or lists else None
            cells = [] if low else [code.cells.take(at, mode="clip").astype(np.intp)]
            for (offset, known), listed, row in list(zip(pairs, followers, rows))[max(0, low - 1) : k]:
                place = np.repeat(2 * (offset[some] - starts) + own, n)
                place += twice
                cells.append(known.take(place, mode="clip").astype(np.intp))
                if len(listed.hashes):
                    row_ = np.repeat(row[some], n)
                    for r in np.unique(row[some][row[some] >= 0]).tolist():
                        mine_ = np.flatnonzero(row_ == r)
                        cells[-1][mine_] = listed.cells(r, code.nodes.take(at[mine_]), code.bits.take(at[mine_]), np.repeat(own, n)[mine_])
            logs = mixer.mixed(cells, np.repeat((own * times).astype(np.float64), n))
            out[part] = np.bincount(np.repeat(np.arange(len(some)), n), logs, len(some))[which]
    return out


# spelling


_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = (np.multiply.accumulate(np.array([1] + [b] * BYTES_AT_ONCE, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
_LETTERS = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=np.uint64) << _U(1) | _U(1)


class Spelled:
    """Words and their blanks in a row of bytes, of which stretches are looked at.

    For each stretch: whose each byte is, its bits, its slots, a share of its contexts, and the slots by the whole
    beginning of the word, which is hashed on from stretch to stretch, however long the word is.
    """

    def __init__(self, words: list[bytes]):
        ended = [w if w == END else w + BLANK for w in words]
        sizes = np.array([len(w) for w in ended], np.int64)
        self.data = np.frombuffer(b"".join(ended), np.uint8)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def grams(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the bytes from a to b the distinct ones with what the longest predictor of a few bytes sees, which one each byte is, and whose it is."""
        at = np.arange(a, b)
        owner = np.searchsorted(self.ends, at, side="right")
        place, key = at - self.starts[owner], np.zeros(b - a, np.uint64)
        for k in range(1, SPELL[-1] + 1):
            key = key << _U(9) | np.where(place >= k, self.data[np.maximum(at - k, 0)].astype(np.uint64) + _U(1), _U(0))
        return *np.unique(key << _U(8) | self.data[a:b], return_inverse=True), owner

    def beginnings(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of cells of bytes behind whole beginnings, as counted and with the byte itself left out; the pair of rows that each
        distinct byte behind a beginning has, and which of these each byte is."""
        sizes = self.ends - self.starts
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(self.data)) - self.starts[owner]
        power = np.multiply.accumulate(np.array([1] + [_BASE] * int(sizes.max()), np.uint64))
        sums = np.cumsum(_LETTERS[self.data] * power[place]) if len(place) else np.zeros(0, np.uint64)
        before = np.concatenate([[_U(0)], sums[:-1]])
        h = _mix(before - before[self.starts[owner]]) & ~_U(255)
        found, which = np.unique(h | self.data, return_inverse=True)
        del place, sums, before, h
        c = np.bincount(which, np.minimum(counts, 1 << 16)[owner], len(found)).astype(np.int64)
        # bytes that alone follow a beginning have the cells of any such byte as frequent
        first = first_of(found >> _U(8))
        alone = first & np.append(first[1:], True)[: len(first)]
        kinds, kind = np.unique(c[alone] << 8 | (found[alone] & _U(255)).astype(np.int64), return_inverse=True)
        row = np.cumsum(~alone) - 1
        more = len(found) - len(kind)
        row[alone] = more + kind
        first = np.concatenate([first[~alone], np.ones(len(kinds), bool)])
        code = np.concatenate([found[~alone], kinds.astype(np.uint64)]) << _U(56)
        cells = path_cells(first, code, np.full(len(code), 8), np.concatenate([c[~alone], kinds >> 8]))
        return np.ascontiguousarray(cells.reshape(-1, 8, 2).transpose(0, 2, 1)).reshape(-1, 8), row, which

    def stretches(self, table_bits: tuple[int, ...], begun_bits: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray | None]]:
        carried = 0
        for a, b in chunks(len(self.data), BYTES_AT_ONCE):
            at = np.arange(a, b)
            owner = np.searchsorted(self.ends, at, side="right")
            place = at - self.starts[owner]
            context, slots, sampled = np.zeros(b - a, np.uint64), [], []
            byte = self.data[a:b]
            nodes = _NODES[byte] * _BY_NODE
            for k in range(1, SPELL[-1] + 1 if table_bits else 1):
                earlier = np.where(place >= k, self.data[np.maximum(at - k, 0)].astype(np.uint64) + _U(1), _U(0))
                context = context << _U(9) | earlier
                if k not in SPELL:
                    continue
                bits, h = table_bits[SPELL.index(k)], _mix(context + _U(k << 40))[:, None]
                slots.append(_slots(h, nodes, bits).ravel())
                all_ = _mix(h + nodes).ravel()
                sampled.append(all_[all_ >> _U(32) & _U(SHARE - 1) == 0])
            begun = None
            if begun_bits:
                sums = np.concatenate([[_U(0)], np.cumsum(_LETTERS[byte] * _UP[: b - a])])
                start = np.maximum(self.starts[owner] - a, 0)
                h = (sums[:-1] - sums[start]) * _DOWN[start]
                upto = int(((sums[-1:] - sums[start[-1:]]) * _DOWN[start[-1:]])[0])
                first = self.starts[owner[0]]
                if first < a:  # the word goes on
                    shift = pow(_BASE, int(a - first), 1 << 64)
                    mine = owner == owner[0]
                    h[mine] = h[mine] * _U(shift) + _U(carried)
                    if mine[-1]:
                        upto = (upto * shift + carried) % (1 << 64)
                carried = upto
                begun = _slots(_mix(h)[:, None], nodes, begun_bits).ravel()
            yield owner, _BITS[byte].ravel(), slots, sampled, begun


def gram_slots(grams: np.ndarray, table_bits: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of distinct grams the bytes, and of their eight decisions the slots in each table and hashes without one."""
    byte = (grams & _U(255)).astype(np.intp)
    nodes, slots, hashes = _NODES[byte] * _BY_NODE, [], []
    for k, bits in zip(SPELL, table_bits):
        h = _mix((grams >> _U(8 + 9 * (SPELL[-1] - k))) + _U(k << 40))[:, None]
        slots.append(_slots(h, nodes, bits))
        hashes.append(h + nodes)
    return byte, slots, hashes


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Spelled, np.ndarray | None]]:
    """The words of batches, of about AT_A_TIME bytes together, and their counts."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += batch.column("word").nbytes
        if size >= AT_A_TIME:
            held, waiting, size = pa.Table.from_batches(waiting), [], 0
            yield Spelled(held.column("word").to_pylist()), held.column("c").to_numpy()
    if waiting:
        held = pa.Table.from_batches(waiting)
        yield Spelled(held.column("word").to_pylist()), held.column("c").to_numpy()


def spelling_tables(words: DataFrame, parts: int) -> tuple[tuple[int, ...], list[np.ndarray]]:
    """The sizes (bits) and packed counts of the spelling predictors, of ``words(word, c)`` with their weights."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spelled, _ in gathered(batches):
            found = [[] for _ in SPELL]
            for a in range(0, len(spelled.data), AT_A_TIME):
                grams, *_ = spelled.grams(a, min(a + AT_A_TIME, len(spelled.data)))
                for k, h in enumerate(gram_slots(grams, (LEAST_BITS,) * len(SPELL))[2]):
                    h = _mix(h).ravel()
                    found[k].append(h[h >> _U(32) & _U(SHARE - 1) == 0])
            found = [np.unique(np.concatenate(h)) if h else np.zeros(0, np.uint64) for h in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(SPELL), dtype=np.int32), [len(h) for h in found])), pa.array(np.concatenate(found).view(np.int64))], ["k", "h"])

    seen = {r.k: r["n"] * SHARE for r in words.mapInArrow(survey, "k int, h bigint").groupBy("k").agg(F.count_distinct("h").alias("n")).collect()}
    table_bits = tuple(min(MOST_BITS, max(LEAST_BITS, (2 * seen.get(k, 0)).bit_length())) for k in range(len(SPELL)))
    edges = np.concatenate([[0], np.cumsum([1 << b for b in table_bits])])
    piece = 1 << LEAST_BITS

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(2 * int(edges[-1]), np.int32)
        for spelled, c in gathered(batches):
            for a in range(0, len(spelled.data), AT_A_TIME):
                grams, which, owner = spelled.grams(a, min(a + AT_A_TIME, len(spelled.data)))
                byte, slots, _ = gram_slots(grams, table_bits)
                weight = np.repeat(np.bincount(which, np.minimum(c, 1 << 16)[owner], len(grams)).astype(np.int32), 8)
                for first, at in zip(edges, slots):
                    np.add.at(totals, ((at + first) * 2 + _BITS[byte]).ravel(), weight)
        press = zstandard.ZstdCompressor(level=1)
        for k in range(0, len(totals) // (2 * piece)):
            part = totals[k * 2 * piece : (k + 1) * 2 * piece]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([press.compress(part.tobytes())], pa.binary())], ["at", "part"])

    def merge(rows: pa.Table) -> pa.Table:
        press, total = zstandard.ZstdDecompressor(), np.zeros((piece, 2), np.int64)
        for x in rows.column("part"):
            total += np.frombuffer(press.decompress(x.as_buffer()), np.int32).reshape(-1, 2)
        return pa.table({"at": rows.column("at").slice(0, 1), "part": pa.array([packed(total[:, 0], total[:, 1]).tobytes()], pa.binary())})

    flat = np.zeros(int(edges[-1]), np.uint32)
    trained = words.repartition(parts, "word").mapInArrow(partial, "at bigint, part binary")
    for row in trained.groupBy("at").applyInArrow(merge, "at bigint, part binary").collect():
        flat[row.at * piece : (row.at + 1) * piece] = np.frombuffer(row.part, np.uint32)
    return table_bits, [flat[a:b] for a, b in zip(edges, edges[1:])]


def score_words(words: list[bytes], counts: np.ndarray, table_bits: tuple[int, ...], tables: list[np.ndarray]) -> np.ndarray:
    """The log10 probability of each word's bytes, learned in this order by their training counts.

    To the tables of a few bytes comes one of whole beginnings, which words that stand together in their order share.
    """
    counts = np.asarray(counts)
    spelled, out, mixer = Spelled(words), np.zeros(len(words)), Mixer(len(SPELL) + 1)
    if len(spelled.data) > MOST_SPELLED:
        return _score_in_stretches(words, counts, table_bits, tables)
    begun, row_of, begun_of = spelled.beginnings(counts)
    stretches = list(chunks(len(spelled.data), BYTES_AT_ONCE))
    for k in range(0, len(stretches), AT_A_TIME // BYTES_AT_ONCE):
        some = stretches[k : k + AT_A_TIME // BYTES_AT_ONCE]
        start, end = some[0][0], some[-1][1]
        grams, which, owner = spelled.grams(start, end)
        byte, slots, _ = gram_slots(grams, table_bits)
        bits, rows = _BITS[byte], []
        for counted, at in zip(tables, slots):
            pair = counted.take(at)
            n0, n1 = (pair & np.uint32(0xFFFF)).astype(np.int64), (pair >> np.uint32(16)).astype(np.int64)
            less = _cells(np.maximum(n0 - (bits == 0), 0), np.maximum(n1 - (bits == 1), 0), bits)
            rows.append(np.stack([_cells(n0, n1, bits), less], axis=1).reshape(-1, 8))
        rows.append(begun)
        weight = counts[owner].astype(np.float64)
        own = weight > 0
        key, logs = 2 * begun_of[start:end] + own, np.empty(end - start)
        for a, b in some:
            mine = slice(a - start, b - start)
            # bytes of a batch that have their beginning in common are mixed once
            one, again = _one_each(key[mine])
            one += a - start
            row, last = 2 * which[one] + own[one], 2 * row_of[begun_of[one + start]] + own[one]
            cells = [x.take(r, axis=0, mode="clip").ravel().astype(np.intp) for x, r in zip(rows, (*[row] * len(tables), last))]
            logs[mine] = mixer.mixed(cells, np.repeat(np.bincount(again, weight[mine]), 8)).reshape(-1, 8).sum(axis=1, dtype=np.float64)[again]
        first = int(owner[0])
        out[first : int(owner[-1]) + 1] += np.bincount(owner - first, logs)
    return out


def _score_in_stretches(words: list[bytes], counts: np.ndarray, table_bits: tuple[int, ...], tables: list[np.ndarray]) -> np.ndarray:
    """The same for very long words: whole beginnings in a hashed table, nothing held by byte."""
    spelled, seen = Spelled(words), Spelled([w for w, c in zip(words, counts.tolist()) if c])
    bits_ = min(max(LEAST_BITS, (8 * len(seen.data)).bit_length()), MOST_BITS)
    totals, c = np.zeros(2 << bits_, np.int32), np.minimum(counts[counts > 0], 1 << 16).astype(np.int32)
    for owner, bits, _, _, begun in seen.stretches((), bits_):
        np.add.at(totals, begun * 2 + bits, np.repeat(c[owner], 8))
    begun_counts = packed(totals[::2], totals[1::2])
    del totals, seen
    out, mixer = np.zeros(len(words)), Mixer(len(SPELL) + 1)
    for owner, bits, slots, _, begun in spelled.stretches(table_bits, bits_):
        weight = np.repeat(counts[owner].astype(np.float64), 8)
        logs = mixer.log10([*(t.take(s) for t, s in zip(tables, slots)), begun_counts.take(begun)], bits, weight > 0, weight)
        first = int(owner[0])
        out[first : int(owner[-1]) + 1] += np.bincount(np.repeat(owner - first, 8), logs, int(owner[-1]) - first + 1)
    return out


# tokens and parts


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts behind each other, and how many each text has."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, counts = words.flatten().cast(pa.binary()), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.binary_length(flat).to_numpy(zero_copy_only=False) == 0
    if empty.any():
        counts -= np.bincount(np.repeat(np.arange(len(counts)), counts)[empty], minlength=len(counts))
        flat = flat.filter(pa.array(~empty))
    return flat, counts


def segments(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, bool, bool]]:
    """Texts behind each other: strings, whose they are, whether they begin and whether they end their texts.

    A text above PIECE bytes comes by itself, in pieces that end at white space.
    """
    texts, last = pc.fill_null(texts, ""), 0
    for k in np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False) > PIECE).tolist():
        if k > last:
            yield texts.slice(last, k - last), np.arange(last, k), True, True
        text, at, last = texts[k].as_py(), 0, k + 1
        while len(text) - at > PIECE and (gap := _SPACES.search(text, at + PIECE)):
            yield pa.array([text[at : gap.start()]]), np.array([k]), at == 0, False
            at = gap.end()
        yield pa.array([text[at:]]), np.array([k]), at == 0, True
    if last < len(texts):
        yield texts.slice(last), np.arange(last, len(texts)), True, True


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, c, h)`` over ``docs(text, held_out)``: every word, its training count and its count in held-out texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, [0, 0]
        schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("h", pa.int64())])

        def out(force: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                found = pa.concat_tables(held).group_by("word").aggregate([("c", "sum"), ("h", "sum")]).select(["word", "c_sum", "h_sum"]).rename_columns(["word", "c", "h"])
                held, size = [found], len(found)
            if force or size > HELD:
                yield from (x for t in held for x in t.to_batches(max_chunksize=50_000))
                held, size = [], 0

        for whole in rows:
            for batch in sliced(whole, "text"):
                test = batch.column("held_out").to_numpy(zero_copy_only=False)
                for texts, owner, _, last in segments(batch.column("text")):
                    flat, counts = tokens_of(texts)
                    coded = flat.dictionary_encode()
                    at = coded.indices.to_numpy(zero_copy_only=False) * np.int64(2) + np.repeat(test[owner], counts)
                    for k in (0, 1):
                        ends[k] += int((test[owner] == k).sum()) * last
                    both = np.bincount(at, minlength=2 * len(coded.dictionary)).reshape(-1, 2)
                    held.append(pa.table([coded.dictionary, np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])], schema=schema))
                    size += len(both)
                if size > HELD:
                    yield from out(False)
        held.append(pa.table([[END], [ends[0]], [ends[1]]], schema=schema))
        yield from out(True)

    counted = docs.select("text", "held_out").mapInArrow(run, "word binary, c bigint, h bigint").where("c + h > 0")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("h").alias("h"))


_PRESS = zstandard.ZstdCompressor(level=1)  # made once; a worker has one thread


def _joined(kinds: tuple, *columns: np.ndarray) -> bytes:
    """Columns behind their lengths, each byte of a number in a plane of its own; ``kinds``: types, negative ones as differences."""
    planes = []
    for (kind, differences), x in zip(kinds, columns, strict=True):
        x = np.ascontiguousarray(x, kind)
        if differences and len(x):
            x = np.concatenate([x[:1], x[1:] - x[:-1]])
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())
    sizes = np.array([len(x) for x in planes], np.int64)
    return _PRESS.compress(b"".join([sizes.tobytes(), *planes]))


def _columns(kinds: tuple, body: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    sizes, at, out = np.frombuffer(data, np.int64, len(kinds)), 8 * len(kinds), []
    for (kind, differences), size in zip(kinds, sizes.tolist()):
        x = np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
        out.append(np.cumsum(x, dtype=kind) if differences else x)
        at += size
    return out


_U32, _U32D, _I64, _I64D, _U8, _F64 = (np.uint32, False), (np.uint32, True), (np.int64, False), (np.int64, True), (np.uint8, False), (np.float64, False)
#: Rows by document and the documents' own columns: which one (place in the block), order, held out.
_DOCS = (_U32D, _I64D, _U8)
_TOKENS = (_U32D, _U32, *(_U32,) * BEFORE, *_DOCS)
_WORDS = (_U32D, _U32, _U32, _U8, *_DOCS)
_FACTS = (_I64D, _U8, _U8, _I64, _I64, _I64, _F64)
_TALLY, _LIST = (_I64D, _U32), (_U32D, _I64)
_SUMS = (_U32D, _I64)
_WORD_SUMS = (_U32D, _I64, _F64, _I64)
#: Sums of logarithms go from part to part as whole multiples of 1 / GRAIN, so their order does not matter.
GRAIN = 1 << 20


class Dealer:
    """Deals the tokens and rare words of blocks of documents to their parts, as packets ``(part, block, seq, body)``."""

    def __init__(self, plan: dict, words: list[bytes]):
        self.plan = plan
        self.head = pa.array([b"" if w == END else w for w in words], pa.binary())  # the end is no word of a text
        self.end = words.index(END) if END in words else -1

    def stretches(self, texts: pa.Array, spell: bool = True) -> Iterator[tuple]:
        """Segments of texts: their words, how many each text has and whose they are, whether these end here; the distinct
        words, which one each is, which of these are rare and their bytes; and a row of places, BEFORE ahead of each text and
        one for its end: where the words stand in it, and of each place code, context and text (-1: none). Unless they are
        to ``spell``, rare words are all one context."""
        carried = np.full(BEFORE, START, np.uint32)
        for strings, owner, begins, ends in segments(texts):
            flat, counts = tokens_of(strings)
            coded = flat.dictionary_encode()
            words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            code_of = pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            rare = np.flatnonzero(code_of < 0)
            spelled = words.take(pa.array(rare)).to_pylist() if spell else []
            context_of = code_of.astype(np.uint32)
            context_of[rare] = [_context(w) for w in spelled] if spell else _RARE
            # each text behind what stands before it, and ahead of its end
            sizes = counts + ends + BEFORE
            starts = np.cumsum(sizes) - sizes
            total = int(sizes.sum())
            code, context, doc = np.full(total, -1), np.full(total, START, np.uint32), np.full(total, -1)
            if not begins:
                context[:BEFORE] = carried
            here = np.arange(len(at)) + np.repeat(starts + BEFORE - np.cumsum(counts) + counts, counts)
            code[here], context[here], doc[here] = code_of[at], context_of[at], np.repeat(owner, counts)
            if ends:
                last = starts + sizes - 1
                code[last], context[last], doc[last] = self.end, self.end if self.end >= 0 else _context(END), owner
            carried = context[-BEFORE:].copy()
            yield flat, counts, owner, ends, at, words, rare, spelled, here, code, context, doc

    def packets(self, number: int, ids: list, tests: np.ndarray, texts: pa.Array) -> Iterator[tuple]:
        n = len(ids)
        known = np.array([x is not None for x in ids], bool)
        given = np.array([x or 0 for x in ids], np.int64)
        place = np.where(known, given, np.iinfo(np.int64).min)
        tests, seq = np.asarray(tests).astype(np.uint8), 0
        facts = [np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)]
        for flat, counts, owner, ends, at, words, rare, spelled, here, code, context, doc in self.stretches(texts):
            total = len(code)
            seen = np.flatnonzero(doc >= 0)
            lengths = np.zeros(total)
            lengths[here] = pc.binary_length(flat).to_numpy(zero_copy_only=False)
            code_, doc_ = code[seen], doc[seen]
            in_head = code_ >= 0
            for fact, x in zip(facts, (None, lengths[seen], in_head, np.where(in_head, self.plan["base"][code_], 0.0) if len(self.head) else in_head)):
                fact += np.bincount(doc_, x, n).astype(fact.dtype)
            for part, body in self._tokens(np.where(in_head, code_, self.plan["escape"]).astype(np.uint32), [context[seen - k] for k in range(1, BEFORE + 1)], doc_, place, tests):
                yield part, number, seq, body
                seq += 1
            # how often each text has each rare word
            if ends and self.end < 0:
                spelled.append(END)
            order = np.full(len(words), -1)
            order[rare] = np.arange(len(rare))
            pairs = np.repeat(owner, counts) * np.int64(len(spelled)) + order[at]
            pairs = pairs[order[at] >= 0]
            if ends and self.end < 0:
                pairs = np.concatenate([pairs, owner * np.int64(len(spelled)) + len(spelled) - 1])
            if len(pairs):
                pairs, times = np.unique(pairs, return_counts=True)
                for part, body in self._words(spelled, pairs // len(spelled), pairs % len(spelled), times, place, tests):
                    yield part, number, seq, body
                    seq += 1
        facts[1] += facts[0]  # a blank behind each word, and the end
        yield -1 - number % 64, number, seq, _joined(_FACTS, given, known, tests, *facts)

    def _tokens(self, code: np.ndarray, before: list[np.ndarray], doc: np.ndarray, place: np.ndarray, tests: np.ndarray) -> Iterator[tuple[int, bytes]]:
        salts, first = self.plan["salts"], before[0].astype(np.int64)
        many = np.ones(len(first), np.uint64)
        head = first < len(salts) - 1
        many[head] = salts[first[head]]
        many[before[0] == START] = salts[-1]
        salt = np.zeros(len(first), np.uint64)
        deal = np.flatnonzero(many > 1)
        if len(deal):
            salt[deal] = _salts(self.plan.get("contexts"), [x[deal] for x in before], many[deal], _mix(place.astype(np.uint64) * _BY_NODE)[doc[deal]])
        part = _part_of(before[0], salt, self.plan["parts"])
        order, edges, who, index = _dealt(part, doc, self.plan["parts"])
        columns, places, held = [index, code[order], *(x[order] for x in before)], place[who], tests[who]
        for a, b in zip(edges, edges[1:]):
            low, high = index[a], index[b - 1] + 1
            local, *mine = (x[a:b] for x in columns)
            yield int(part[order[a]]), _joined(_TOKENS, local - low, *mine, who[low:high], places[low:high], held[low:high])

    def _words(self, spelled: list[bytes], doc: np.ndarray, word: np.ndarray, times: np.ndarray, place: np.ndarray, tests: np.ndarray) -> Iterator[tuple[int, bytes]]:
        edges, hot = self.plan["edges"], self.plan["hot"]
        deal = np.array([bisect_right(edges, w) for w in spelled], np.int64)[word]
        for k, w in enumerate(spelled) if hot else ():
            if w in hot:
                mine = word == k
                deal[mine] = (deal[mine] + doc[mine] % hot[w][0]) % (len(edges) + 1)
        order, edges, who, index = _dealt(deal, doc, len(self.plan["edges"]) + 1)
        sizes = np.array([len(w) for w in spelled], np.uint32)[word[order]]
        data = np.frombuffer(b"".join([spelled[k] for k in word[order].tolist()]), np.uint8)
        upto = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        times, places, held = times[order], place[who], tests[who]
        for a, b in zip(edges, edges[1:]):
            low, high = index[a], index[b - 1] + 1
            yield self.plan["parts"] + int(deal[order[a]]), _joined(_WORDS, index[a:b] - low, times[a:b], sizes[a:b], data[upto[a] : upto[b]], who[low:high], places[low:high], held[low:high])


def _dealt(part: np.ndarray, doc: np.ndarray, parts: int) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Rows in the order of documents in the order of their parts: their places, where parts begin and the last one ends, the
    documents of each part behind each other, and which of these each row has."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # 16 bits are sorted by digits
    part, doc = part[order], doc[order]
    begins = first_of(part)
    fresh = begins | first_of(doc)
    return order, [*np.flatnonzero(begins).tolist(), len(part)], doc[fresh], np.cumsum(fresh) - 1


def _context(word: bytes) -> int:
    """What a rare word is as a context."""
    return _RARE + (zlib.crc32(word) & _RARE - 1)


def _part_of(word: np.ndarray, salt: np.ndarray, parts: int) -> np.ndarray:
    return ((_mix(word.astype(np.uint64) * _BY_NODE + salt * _BY_SLOT) >> _U(20)) % _U(parts)).astype(np.int64)


def _salts(contexts: list[tuple[np.ndarray, np.ndarray]] | None, before: list[np.ndarray], many: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of its word's parts each token goes to: that of the next token before it, so that longer contexts stay together.

    ``many``: parts of the word; ``contexts``: for each length the hashes of those that fill several parts, and how many.
    These are dealt by one more token, and the longest, whose tokens differ in nothing but their symbol, by ``place``.
    """
    salt, rest = _mix(before[1].astype(np.uint64) * _BY_NODE) % many, np.arange(len(many))
    hashes = list(contexts_of(before)) if contexts else []
    for k in range(1, len(hashes)):
        known, parts = contexts[k]
        row = _among(known, hashes[k][rest])
        rest, row = rest[row >= 0], row[row >= 0]
        further = _mix(before[k + 1][rest].astype(np.uint64) * _BY_NODE) if k + 1 < len(before) else place[rest]
        salt[rest] = hashes[k][rest] + further % parts[row]
    return salt


def followers(plan: dict, code: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """A number for each token and each context of ``plan["lengths"]`` before it that fills several parts: the context's and the token's code."""
    salts, found, at = plan["salts"], [], 0
    first = before[0].astype(np.int64)
    rest = np.flatnonzero(np.where(first < len(salts) - 1, salts[np.minimum(first, len(salts) - 1)] > 1, (before[0] == START) & (salts[-1] > 1)))
    code, before = np.where(code < 0, plan["escape"], code)[rest], [x[rest] for x in before]
    rest = np.arange(len(code))
    for k, ((known, _), context) in enumerate(zip(plan["contexts"], contexts_of(before)), 1):
        row = _among(known, context[rest])
        rest, row = rest[row >= 0], row[row >= 0]
        if k in plan["lengths"]:
            found.append((row + at) << _CODE_BITS | code[rest])
        at += len(known)
    if 1 in plan["lengths"]:  # and one for each context of BEFORE tokens of which every one fills several parts
        n = len(salts) + 1
        numbers = [np.where(x == START, len(salts) - 1, np.minimum(x, len(salts))).astype(np.int64) for x in before]
        fills = np.append(salts > 1, False)
        rest = np.flatnonzero(np.logical_and.reduce([fills[x] for x in numbers]))
        key = np.zeros(len(rest), np.int64)
        for x in numbers:
            key = key * n + x[rest]
        found.append(key + _GRAMS)
    return np.concatenate(found)


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(which, np.concatenate(times), len(found)).astype(np.int64)


def tally(docs: DataFrame, held, buckets: int) -> DataFrame:
    """The numbers that ``followers`` gives the training tokens of ``docs(text, held_out)``, counted in as many ``buckets``.

    ``(context, key, n, body)``: of each context the codes and counts of a bucket as a body, and with context -1 the
    numbers that occur more than PART times.
    """
    most = PART

    def out(found: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = (_mix((found >> _RANGE_BITS).astype(np.uint64) * _BY_NODE) >> _U(20)) % _U(buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1, append=-1))
        bodies = [_joined(_TALLY, found[order[a:b]], times[order[a:b]]) for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order[edges[:-1]]].astype(np.int32)), pa.array(bodies, pa.binary())], ["bucket", "body"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, plan = held.value
        dealer, keys, times, size = Dealer(plan, words), [], [], 0
        for whole in rows:
            for batch in sliced(whole.filter(pc.invert(whole.column("held_out"))), "text"):
                for *_, code, context, doc in dealer.stretches(batch.column("text"), spell=False):  # no context here has a rare word
                    seen = np.flatnonzero(doc >= 0)
                    found, n = np.unique(followers(plan, code[seen], [context[seen - k] for k in range(1, BEFORE + 1)]), return_counts=True)
                    keys.append(found)
                    times.append(n)
                    size += len(found)
                    if size > 4 * HELD:
                        yield from out(*_summed(keys, times))
                        keys, times, size = [], [], 0
        if size:
            yield from out(*_summed(keys, times))

    def merge(rows: pa.Table) -> pa.Table:
        keys, times, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for body in rows.column("body"):
            found, n = _columns(_TALLY, body.as_buffer())
            keys.append(found)
            times.append(n)
            size += len(found)
            if size > 4 * HELD:
                found, n = _summed(keys, times)
                keys, times, size = [found], [n], 0
        found, n = _summed(keys, times)
        often, short = np.flatnonzero(n > most), np.flatnonzero(found < _GRAMS)
        context = found[short] >> _CODE_BITS
        edges = np.flatnonzero(np.diff(context, prepend=-1, append=-1))
        bodies = [_joined(_LIST, found[short[a:b]] & (1 << _CODE_BITS) - 1, n[short[a:b]]) for a, b in zip(edges, edges[1:])]
        pad = np.full(len(bodies), -1)
        columns = [[*context[edges[:-1]].tolist(), *[-1] * len(often)], [*pad, *found[often]], [*pad, *n[often]], [*bodies, *[None] * len(often)]]
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["context", "key", "n", "body"])

    dealt = docs.select("text", "held_out").mapInArrow(run, "bucket int, body binary")
    return dealt.groupBy("bucket").applyInArrow(merge, "context int, key bigint, n bigint, body binary")


def shared_contexts(docs: DataFrame, scratch: Scratch, words: list[bytes], plan: dict, n_of: np.ndarray) -> DataFrame | None:
    """PACKET rows, block -1, of what follows the contexts that fill several parts, for each part that they reach; ``plan`` gets these contexts.

    ``n_of``: how often each word comes in training texts, at last how many of these there are. The followers of words
    tell the pairs that fill several parts; contexts of three tokens are counted beside them.
    """
    salts, spark = plan["salts"], docs.sparkSession
    found = [[((w,), n) for w, n in zip(range(len(words)), n_of.tolist()) if salts[w] > 1 and words[w] != END], [], []]
    if salts[-1] > 1:
        found[0].append(((int(START),), int(n_of[-1])))
        found[1].append(((int(START),) * 2, int(n_of[-1])))
    if not found[0]:
        return None
    end = words.index(END) if END in words else -1

    def hashed(grams: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and parts of contexts; these are put in the order of their hashes."""
        if not grams:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        hashes = list(contexts_of([np.array(x, np.uint32) for x in zip(*(g for g, _ in grams))]))[-1]
        order = np.argsort(hashes)
        grams[:] = [grams[i] for i in order.tolist()]
        return hashes[order], np.array([-(-n // PART) for _, n in grams], np.uint64)

    def counted(lengths: tuple[int, ...], name: str) -> DataFrame:
        held = spark.sparkContext.broadcast((words, {**plan, "contexts": contexts, "lengths": lengths}))
        most = len(lengths) * sum(n for g in found for x, n in g if len(x) in lengths)
        return scratch.keep(tally(docs, held, -(-most // (4 * PART))), name)

    contexts = [hashed(found[0])]
    lists = counted((1,), "followers")
    for r in lists.where("context = -1").collect():
        if r.key >= _GRAMS:
            key, gram = r.key - _GRAMS, []
            for _ in range(BEFORE):
                key, x = divmod(key, len(salts) + 1)
                gram.insert(0, int(START) if x == len(salts) - 1 else x)
            found[2].append((tuple(gram), r.n))
        else:
            w = r.key & (1 << _CODE_BITS) - 1
            if w < len(words) and w != end:
                found[1].append(((w, *found[0][r.key >> _CODE_BITS][0]), r.n))
    contexts += [hashed(found[1]), hashed(found[2])]
    if found[1]:
        lists = lists.unionByName(counted((2, 3), "followers_of_more"))
    plan["contexts"] = contexts
    reached: dict[tuple[int, ...], set[int]] = {}
    for (hashes, many), grams in zip(contexts, found):
        for h, m, (gram, _) in zip(hashes, many.tolist(), grams):
            salt = np.arange(m, dtype=np.uint64) + (h if len(gram) > 1 else _U(0))
            parts = _part_of(np.full(m, gram[0], np.uint32), salt, plan["parts"]).tolist()
            for k in range(1, len(gram) + 1):  # those that it ends in go with it
                reached.setdefault(gram[:k], set()).update(parts)
    goes = [(len(g), h, sorted(reached[g])) for (hashes, _), grams in zip(contexts, found) for h, (g, _) in zip(hashes, grams)]

    def deliver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for context, body in zip(batch.column("context").to_pylist(), batch.column("body").to_pylist()):
                length, h, parts = goes[context]
                n = len(parts)
                body = bytes([length]) + int(h).to_bytes(8, "little") + body
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((parts, [-1] * n, [context] * n, [body] * n), _PACKET)], ["part", "block", "seq", "body"])

    return lists.where("context >= 0").select("context", "body").mapInArrow(deliver, PACKET)


PACKET = "part int, block bigint, seq int, body binary"
_PACKET = (pa.int32(), pa.int64(), pa.int32(), pa.binary())


def packets(docs: DataFrame, held) -> DataFrame:
    """PACKET rows of ``docs(doc_id, text, held_out)``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, plan = held.value
        dealer, number = Dealer(plan, words), TaskContext.get().partitionId() << 32
        for whole in rows:
            for batch in sliced(whole, "text"):
                waiting, size = [], 0
                for row in dealer.packets(number, batch.column("doc_id").to_pylist(), batch.column("held_out").to_numpy(zero_copy_only=False), batch.column("text")):
                    waiting.append(row)
                    size += len(row[3])
                    if size > BATCH_BYTES:
                        yield _as_batch(waiting)
                        waiting, size = [], 0
                yield _as_batch(waiting)
                number += 1

    def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_PACKET)], ["part", "block", "seq", "body"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, PACKET)


def _loaded(rows: pa.Table, kinds: tuple) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The columns of all packets behind each other, and of the documents: which one each row has, block, place in it, order, held out."""
    rows = rows.sort_by([("block", "ascending"), ("seq", "ascending")])
    parts, docs, n = [], [], 0
    for block, body in zip(rows.column("block").to_pylist(), rows.column("body")):
        local, *own, who, ids, tests = _columns(kinds, body.as_buffer())
        parts.append((local.astype(np.int64) + n, *own))
        docs.append((np.full(len(who), block), who, ids, tests))
        n += len(who)
    merged = [np.concatenate(x) for x in zip(*parts)]
    return merged, *(np.concatenate(x) for x in zip(*docs))


def _sums(block: np.ndarray, who: np.ndarray, local: np.ndarray, part: int, kinds: tuple, *values: np.ndarray) -> pa.Table:
    """Sums by document, a row for each block."""
    totals = [np.bincount(local, x, len(block)) for x in values]
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
    bodies = [(int(block[a]), part, 0, _joined(kinds, who[a:b], *(np.rint(x[a:b]) if kind is _I64 else x[a:b] for (kind, x) in zip(kinds[1:], totals)))) for a, b in zip(edges, edges[1:])]
    return pa.table({k: pa.array([r[i] for r in bodies], kind) for i, (k, kind) in enumerate((("block", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("body", pa.binary())))})


def _scored(rows: pa.Table, m: dict) -> pa.Table:
    """Of a part the sums by document; facts pass through."""
    part = rows.column("part")[0].as_py()
    if part < 0:
        return rows.select(["block", "part", "seq", "body"])
    if part < m["parts"]:
        alone = rows.column("block").to_numpy() < 0
        given: dict[tuple[int, int], list] = {}
        for body in rows.filter(pa.array(alone)).column("body"):
            data = body.as_buffer()
            given.setdefault((data[0], int.from_bytes(data[1:9], "little")), []).append(_columns(_LIST, data[9:]))
        lists = []
        for (length, context), some in given.items():
            known, times = (np.concatenate(x) for x in zip(*some))
            order = np.argsort(known)
            lists.append((length, context, known[order], times[order]))
        rows = rows.filter(pa.array(~alone))
        if not len(rows):
            return rows.select(["block", "part", "seq", "body"])
        (local, symbols, *before), block, who, ids, tests = _loaded(rows, _TOKENS)
        order = np.argsort(ids[local], kind="stable")
        s = np.zeros(len(local))
        s[order] = score_part(m["code"], symbols[order], [x[order] for x in before], tests[local[order]] == 0, lists)
        return _sums(block, who, local, part, _SUMS, s * GRAIN)
    (local, times, sizes, blob), block, who, _, tests = _loaded(rows, _WORDS)
    ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    coded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(blob)]).dictionary_encode()
    words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    order = sorted(range(len(words)), key=[(zlib.crc32(w), w) for w in words].__getitem__)  # in no order that means something
    words, place = [words[k] for k in order], np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    which = place[which]
    c = np.bincount(which, times * (tests[local] == 0), len(words)).astype(np.int64)
    for w, (_, count) in m["hot"].items():
        if w in words:
            c[words.index(w)] = count
    s = score_words(words, c, *m["spelling"])
    base = np.log10((c + 1) / m["total"])
    return _sums(block, who, local, part, _WORD_SUMS, s[which] * times * GRAIN, base[which] * times, (c[which] > 0) * times)


def scored_parts(dealt: DataFrame, model) -> DataFrame:
    """``(block, part, seq, body)`` of PACKET rows, a group for each part."""
    return dealt.groupBy("part").applyInArrow(lambda rows: _scored(rows, model.value), "block bigint, part int, seq int, body binary")


def _merged(rows: pa.Table, parts: int) -> pa.Table:
    """The documents of a block; sums of rare words come from the parts from ``parts`` on."""
    rows = rows.sort_by([("part", "ascending"), ("seq", "ascending")])  # facts first
    for part, body in zip(rows.column("part").to_pylist(), rows.column("body")):
        if part < 0:
            ids, known_id, tests, n, n_bytes, known, base = _columns(_FACTS, body.as_buffer())
            score = np.zeros(len(ids), np.int64)
            continue
        # a document comes once for each packet that has some of it
        who, s, *more = _columns(_SUMS if part < parts else _WORD_SUMS, body.as_buffer())
        for total, x in zip((score, base, known), (s, *more)):
            np.add.at(total, who, x)
    return pa.table({"doc_id": pa.array(ids, mask=known_id == 0), "held_out": pa.array(tests > 0), "n_tokens": pa.array(n), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score / GRAIN), "n_bytes": pa.array(n_bytes)})


def head_of(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The words above the least count, at least 2, at which no more than HEAD are as frequent, by count and bytes, and their counts.

    A word that occurs once is to its own text as new as it would be to a held-out one: it is spelled behind the escape.
    """
    least, total = 2, 0
    for r in counts.where("c > 1").groupBy("c").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("c")).toLocalIterator():
        total += r.rows
        if total > HEAD:
            least = r.c + 1
            break
    held = counts.where(F.col("c") >= least).select("word", "c").toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    return held.column("word").to_pylist(), held.column("c").to_numpy().astype(np.int64)


def word_edges(rare: DataFrame, n: int) -> list[bytes]:
    """The words at which ranges of about WORDS_PART rare words begin, by a share of them that their hash chooses, some 64 a range."""
    parts = -(-n // WORDS_PART)
    if parts < 2:
        return []
    chosen = F.pmod(F.xxhash64("word"), F.lit(max(1, WORDS_PART // 64))) == 0
    held = sorted(bytes(r.word) for r in rare.where(chosen).select("word").collect())
    return [held[len(held) * k // parts] for k in range(1, parts)] if held else []


def score(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` scored: counts, base score, the model's score and its bits for a byte."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select("doc_id", "text", is_held_out(F.col("doc_id")).alias("held_out"))
    counts = scratch.keep(word_counts(rows), "counts")
    facts = counts.agg(F.sum("c").alias("n"), F.sum("h").alias("h"), F.count_if(F.col("c") > 0).alias("v"), F.count(F.lit(1)).alias("all")).first()
    n, v, tokens = facts.n or 0, facts.v, (facts.n or 0) + (facts.h or 0)
    words, c = head_of(counts)
    least = int(c[-1]) if len(c) else 2
    rare = scratch.keep(counts.where(F.col("c") < least), "rare")
    # a word that is hot in held-out texts alone is dealt over several parts, with its count
    hot = {bytes(r.word): (-(-r.h // PART), r.c) for r in rare.where(F.col("h") > PART).collect()}
    total = float(n + v + 1)
    parts, n_rare = max(1, -(-tokens // PART)), rare.count()
    edges = word_edges(rare, n_rare)
    base = np.log10((c + 1) / total)
    salts = np.maximum(1, -(-np.append(c, c[words.index(END)] if END in words else 0) // PART)).astype(np.uint64)  # at last those of a text's start
    plan = {"escape": len(words), "base": base, "salts": salts, "parts": parts, "edges": edges, "hot": hot}
    code = Code(np.append(c, max(1, n - int(c.sum()))))
    # frequent words show how words are spelled, once each
    shown = counts.where("c > 0").select("word", F.when(F.col("c") < least, F.col("c")).otherwise(1).alias("c"))
    spelling = spelling_tables(shown, max(1, -(-n_rare // (8 * WORDS_PART))))
    lists = shared_contexts(rows, scratch, words, plan, np.append(c, c[words.index(END)] if END in words else 0))
    held = spark.sparkContext.broadcast((words, plan))
    model = spark.sparkContext.broadcast({"parts": parts, "code": code, "spelling": spelling, "hot": hot, "total": total})
    dealt = packets(rows, held)
    if lists is not None:
        dealt = dealt.unionByName(lists)
    summed = scratch.keep(scored_parts(dealt, model), "sums")
    scratch.drop("counts", "rare", "followers", "followers_of_more")
    merged = summed.groupBy("block").applyInArrow(lambda rows: _merged(rows, parts), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, n_bytes bigint")
    scored = merged.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")
    return scored.withColumn("bits_per_byte", -F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
