"""Plain versions of what the operators compute."""

from __future__ import annotations

import collections
import hashlib
import math

#: Nulls, empty and long texts, ties, repeated rows, ids that come twice.
ODD = [
    (1, None, "s", "en", 0), (2, "", None, None, None), (3, "a b c d e f", "s", "en", 11), (3, "a b c d e f", "s", "en", 11), (4, "A  B\tc d E\nf", "t", None, 12),
    (None, "one two three four five six", "t", "fr", 27), (None, None, None, None, None), (5, "long " * 6000, "s", "en", 30000), (6, "é日本 😀 　x", "", "", 9),
    (7, "same line here\nsame line here\nsame line here\nsame line here\nother", "t", "de", 60),
]
SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def repeats(rows: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    t, w = text or "", (text or "").encode().split()
    counts = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if counts[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def mixed(code, symbols, before, train, chunks) -> list[float]:
    """log10 probabilities of a part's tokens, bit by bit and with exact contexts; learned in stretches, ``chunks(n)``."""
    steps = [0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512, 1024, 4096, 16384, 49152]
    level = lambda n: max(k for k, x in enumerate(steps) if x <= n)
    trust = lambda a, b: sum(steps[a] + steps[b] >= x for x in (1, 2, 6))
    path = lambda s: list(zip(*(x[code.start[s] : code.start[s] + code.length[s]].tolist() for x in (code.nodes, code.bits))))
    n, out = len(symbols), [0.0] * len(symbols)
    context = [[tuple(int(before[j][i]) for j in range(k)) for i in range(n)] for k in range(4)]
    seen = [collections.Counter(c for c, t in zip(x, train) if t) for x in context]
    counts = collections.Counter((k, context[k][i], node, bit) for k in range(1, 4) for i in range(n) if train[i] for node, bit in path(symbols[i]))
    longest = []
    for i in range(n):
        k = 0
        while k < 3 and seen[k + 1][context[k + 1][i]] - train[i] > 0:
            k += 1
        longest.append(k)
    for top in range(4):
        least = max(0, top - 2)  # three predictors at most
        inputs, state, weight, curve, refine, batch = top + 1 - least, {}, {}, {}, {}, 0
        mine = [i for i in range(n) if longest[i] == top]

        def start(gate: tuple) -> list[float]:
            w, rest = [0.0] * inputs, 1.0
            for k in range(inputs - 1, 0, -1):
                w[k] = (0, 0.4, 0.6, 0.8)[gate[k - 1]] * rest
                rest -= w[k]
            return [rest, *w[1:]]

        for at, upto in chunks(len(mine)):
            rows = []
            for i in mine[at:upto]:
                for node, bit in path(symbols[i]):
                    pairs = [] if least else [(int(code.counts[node]) & 65535, int(code.counts[node]) >> 16)]
                    for k in range(max(1, least), top + 1):
                        pair = [counts[k, context[k][i], node, b] for b in (0, 1)]
                        pair[bit] -= int(train[i])
                        pairs.append(tuple(pair))
                    s = [(k, level(a), level(b)) for k, (a, b) in enumerate(pairs)]
                    for x in s:
                        state.setdefault(x, [(steps[x[2]] + 0.4) / (steps[x[1]] + steps[x[2]] + 0.8) * 4, 4.0])
                    x = [math.log(state[v][0] / (state[v][1] - state[v][0])) for v in s]
                    gate = tuple(trust(v[1], v[2]) for v in s[1:])
                    w = weight.setdefault(gate, start(gate))
                    z = sum(a * b for a, b in zip(w, x))
                    p = 1 / (1 + math.exp(-z))
                    place = (min(max(z, -7.999), 7.999) + 8) * 2
                    low, row = int(place), gate[-1] if gate else 0
                    cell = lambda k: refine.setdefault((row, k), [30 / (1 + math.exp(8 - k / 2)), 30.0])  # noqa: B023, E731
                    (a, b), (c, d), part = cell(low), cell(low + 1), place - low
                    q = (p + a / b * (1 - part) + c / d * part) / 2
                    q = min(max(q, 1e-6), 1 - 1e-6)
                    out[i] += math.log10(q if bit else 1 - q)
                    if train[i]:
                        rows.append((s, x, gate, p, (row, low + (part > 0.5)), bit))
            # learning, after the whole batch is scored
            if batch < 8 or batch % 8 == 0:
                fresh = collections.defaultdict(lambda: [30.0] * inputs)
                for _, x, gate, p, _, _ in rows:
                    for k in range(inputs):
                        fresh[gate][k] += p * (1 - p) * x[k] ** 2
                for gate in {*fresh, *curve, *weight}:
                    old = curve.get(gate, [30.0] * inputs)
                    curve[gate] = [max(a, 0.5 * b) for a, b in zip(fresh[gate], old)]
            step = collections.defaultdict(lambda: [0.0] * inputs)
            for s, x, gate, p, place, bit in rows:
                for k in range(inputs):
                    step[gate][k] += (bit - p) * x[k]
                    state[s[k]][0] += bit
                    state[s[k]][1] += 1
                refine[place][0] += bit
                refine[place][1] += 1
            for gate, g in step.items():
                for k in range(inputs):
                    weight[gate][k] += 0.15 * g[k] / curve.get(gate, [30.0] * inputs)[k]
            batch += 1
    return out
