"""Operators that shuffle: shards, mixing, near-duplicates, scores, repeats, conversations, urls."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftrank.llm import chat_snapshots, context_mixing, kd_shards, near_dedup, source_mix, suffix_family, url_cascade
from driftrank.llm.common import Scratch
from tests.llm import brute
from tests.llm.brute import ODD, SCHEMA, components, repeats


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("other", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("row", F.lit("y"))


def test_shards(spark, odd):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 300), "hot" if i % 3 else f"s{i % 5}", rng.choice(["en", "fr", None]), rng.randint(0, 300)) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = kd_shards.assign(docs, num_shards=7).collect()
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sorted(size) == list(range(7)) and max(size.values()) - min(size.values()) < 0.02 * max(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    first = next(r for r in got if r.doc_id == 0)
    assert first["size"] == len(rows[0][1]) + 16 and first.text_crc32 == zlib.crc32(rows[0][1].encode())
    target = sum(size.values()) // 5 + 1
    assert kd_shards.assign(docs, target_bytes=target).agg(F.max("shard")).first()[0] == 4
    _, tree = kd_shards.grow(docs, Scratch(spark, "t"), num_shards=7)
    split = {r.doc_id: r.shard for r in kd_shards.split(docs, tree).collect()}
    assert split == {r.doc_id: r.shard for r in got}


def test_shards_by_long_names_and_of_equal_rows(spark, monkeypatch):
    """Names that differ late are told apart; equal rows are divided; cuts come from a join as from the expression."""
    rows = [(i, "x" * 100, f"common_crawl_{'abcd'[i % 4]}", "en", 100) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.shard for r in kd_shards.assign(docs, num_shards=4).collect()}
    assert len({(i % 4, s) for i, s in got.items()}) == 4
    monkeypatch.setattr(kd_shards, "LITERAL_NODES", 0)
    assert got == {r.doc_id: r.shard for r in kd_shards.assign(docs, num_shards=4).collect()}
    same = spark.createDataFrame([(1, "text", "s", "en", 4)] * 400, SCHEMA)
    sizes = collections.Counter(r.shard for r in kd_shards.assign(same, num_shards=4).collect())
    assert sorted(sizes) == [0, 1, 2, 3] and max(sizes.values()) - min(sizes.values()) <= 2


def test_shards_of_odd_rows(odd):
    got = kd_shards.assign(odd, num_shards=4).collect()
    assert len(got) == len(ODD) and {r.shard for r in got} <= set(range(4))
    assert kd_shards.assign(odd.limit(0), num_shards=4).count() == 0


def test_permutations_and_targets():
    for n in (1, 2, 3, 7, 100, 1000):
        assert sorted(source_mix.permuted(np.arange(n), n, 5)) == list(range(n))
    import pandas as pd

    s = pd.DataFrame({"weight": [1, 2, 3], "size": [100, 10, 0]})
    assert source_mix.weighted_targets(s).tolist() == [80, 30, 0]


def test_mix(spark, odd):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * (i % 3 + 1) for _ in range(rng.randint(0, 700))), rng.choice(["a", "a", "b", "c"]), "en", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.monotonically_increasing_id())
    _, taken, sources = source_mix.mixture(docs, Scratch(spark, "t"))
    got = {r.doc_id: r.n for r in taken.groupBy("doc_id").agg(F.sum(F.col("words") * F.col("times")).alias("n")).collect()}
    size = {i: len(t.split()) for i, t, *_ in rows}
    assert all(got.get(i, 0) <= 3 * size[i] for i in size)
    by = collections.Counter()
    for i, _, s, *_ in rows:
        by[s] += got.get(i, 0)
    for source, target in zip(sources["source"], sources["target"]):
        assert abs(by[source] - target) < 0.05 * target
    mixed = {r.doc_id: len(r.text.split()) for r in source_mix.stage(spark, docs.drop("row"), "").collect()}
    assert mixed == {i: n for i, n in got.items() if n}
    odd_rows, odd_taken, _ = source_mix.mixture(odd.withColumn("row", F.monotonically_increasing_id()), Scratch(spark, "t"))
    assert odd_rows.count() == len(ODD) and odd_taken.agg(F.max("times")).first()[0] <= 3
    empty = odd.limit(0).withColumn("row", F.monotonically_increasing_id())
    assert source_mix.mixture(empty, Scratch(spark, "t"))[1].count() == 0


def test_every_source_gets_its_slots(spark):
    """Beside a hot source, and in a last shard that is not full."""
    import pandas as pd

    wanted = [100_000, *[3] * 200, *[30] * 20, *[1] * 50, 0]
    sources = pd.DataFrame({"rank": range(len(wanted)), "slots": wanted, "n_blocks": [-(-n // 3) for n in wanted]})
    got = {r["rank"]: (r.n, r.d, r.low, r.high) for r in source_mix.slots(spark, sources, Scratch(spark, "t")).groupBy("rank").agg(F.count("j").alias("n"), F.count_distinct("j").alias("d"), F.min("j").alias("low"), F.max("j").alias("high")).collect()}
    assert got == {k: (n, n, 0, n - 1) for k, n in enumerate(wanted) if n}
    sizes = source_mix.slots(spark, sources, Scratch(spark, "t")).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in sizes[:-1]] == [source_mix.SHARD_SLOTS] * (len(sizes) - 1) and sum(r["count"] for r in sizes) == sum(wanted)


def test_taken_words_keep_their_spaces():
    assert source_mix.take_words("a  b\nc d", [(0, 2, 2), (2, 1, 1)]) == "a  b\nc\na  b"


def test_bayesian_bounds():
    least = near_dedup.least_matches()
    assert all(0 < least[n] < 0.75 * n for n in least) and sorted(least.values()) == list(least.values())


def test_near_groups_that_are_stars(spark, monkeypatch):
    """Copies of one text with 0 to 8 changes: many are near it, few are near each other."""
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    rng = random.Random(2)
    base = [str(rng.randrange(10**6)) for _ in range(150)]
    rows = []
    for i in range(180):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8])):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.link(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == components(rows)


def test_near_odd_rows(spark, odd):
    got = near_dedup.link(odd).collect()
    named = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    want = components([(d, t) for d, t, *_ in ODD if d is not None])
    assert named == {(d, *v) for d, v in want.items()} and len(got) == len(ODD)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dedup.link(odd.limit(0)).count() == 0
    kept = near_dedup.stage(spark, odd, "").collect()
    assert len(kept) == len(ODD) - 1  # document 4 is a copy of 3


def test_scores(spark, odd):
    rng = random.Random(5)
    common = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.9 else f"n{rng.randrange(999)}" for _ in range(80)), "s", "en", 0) for i in range(150)]
    got = {r.doc_id: r for r in context_mixing.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    test = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    tokens = {i: [*t.encode().lower().split(), b"\xff"] for i, t, *_ in rows}
    counts = collections.Counter(w for i in tokens if not test[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (test[i], len(w), sum(counts[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(base) and got[i].score < 0
    unseen = [i for i in tokens if test[i]]
    shuffled = sum(got[i].score for i in unseen)
    assert shuffled > -8 * sum(got[i].n_bytes for i in unseen) / math.log2(10) / 2  # under 4 bits a byte on unseen texts
    assert context_mixing.score(odd.limit(0)).count() == 0
    strange = context_mixing.score(odd).collect()
    assert len(strange) == len(ODD) and all(math.isfinite(r.score) for r in strange)


def test_model_is_a_distribution():
    """All symbols that can follow a context add up to 1, and so do all bytes that can follow a beginning."""
    rng = np.random.default_rng(1)
    code = context_mixing.Code(rng.integers(1, 1000, 50))
    assert (0.5 ** code.length).sum() == pytest.approx(1)
    nodes, bits, n = code.decisions(np.arange(50))
    mixer = context_mixing.Mixer(3, whole=True)
    mixer.weights += rng.normal(0, 0.1, mixer.weights.shape)
    by_node = [rng.integers(0, 40, (2, 49)) for _ in range(2)]
    counts = [code.counts[nodes], *(context_mixing.packed(*x)[nodes] for x in by_node)]
    logs = mixer.log10(counts, bits, np.zeros(len(bits), bool), None)
    assert (10 ** np.bincount(np.repeat(np.arange(50), n), logs)).sum() == pytest.approx(1, abs=1e-5)
    spelled = context_mixing.Spelled([bytes([x]) for x in range(255)] + [context_mixing.END])
    table = context_mixing.packed(*rng.integers(0, 5, (2, 1 << 10)))
    total = 0.0
    for owner, bits, slots, _, begun in spelled.stretches((10, 10, 10), 10):
        logs = context_mixing.Mixer(4).log10([table[x] for x in (*slots, begun)], bits, np.zeros(len(bits), bool), None).reshape(-1, 8).sum(axis=1)
        first = np.diff(owner, prepend=-1) > 0
        total += (10 ** logs[first]).sum()
    assert total == pytest.approx(1, abs=1e-5)


def test_stretches_cover_all():
    for n, most in ((0, 64), (1, 64), (5000, 64), (100_000, 4096)):
        found = list(context_mixing.chunks(n, most))
        assert [i for a, b in found for i in range(a, b)] == list(range(n)) and all(b - a <= most for a, b in found)


def test_scores_of_a_part_by_hand(monkeypatch):
    """Against plain loops with exact contexts."""
    monkeypatch.setattr(context_mixing, "LEAST_BITS", 24)
    monkeypatch.setattr(context_mixing, "CHUNK", 16)
    rng = random.Random(2)
    symbols = np.array([rng.choice([0, 0, 1, 2, 3, 4, 5]) for _ in range(300)])
    symbols[100:140] = symbols[200:240]
    train = np.array([rng.random() < 0.8 for _ in symbols])
    before = [np.concatenate([np.full(k, 99), symbols[:-k]]).astype(np.uint32) for k in (1, 2, 3)]
    code = context_mixing.Code(np.bincount(symbols[train], minlength=6))
    got = context_mixing.score_part(code, symbols, before, train)
    assert got == pytest.approx(brute.mixed(code, symbols, before, train, lambda n: context_mixing.chunks(n, 16)), abs=1e-3)


def test_counts_behind_contexts_are_exact(monkeypatch):
    """Against plain loops with exact contexts, however small tables may be."""
    monkeypatch.setattr(context_mixing, "LEAST_BITS", 4)
    monkeypatch.setattr(context_mixing, "CHUNK", 64)
    rng = random.Random(8)
    symbols = np.array([min(rng.randrange(40), rng.randrange(40)) for _ in range(1500)])
    train = np.array([rng.random() < 0.8 for _ in symbols])
    before = [np.concatenate([np.full(k, 99), symbols[:-k]]).astype(np.uint32) for k in (1, 2, 3)]
    code = context_mixing.Code(np.bincount(symbols[train], minlength=40))
    got = context_mixing.score_part(code, symbols, before, train)
    assert got == pytest.approx(brute.mixed(code, symbols, before, train, lambda n: context_mixing.chunks(n, 64)), abs=1e-3)


def test_equal_decisions_are_mixed_once():
    """What is scored and learned is the same as of each decision by itself, and far fewer are mixed."""
    rng = np.random.default_rng(3)
    cells, weight = [rng.integers(0, 12, 20_000) * 2 for _ in range(3)], rng.integers(0, 3, 20_000).astype(float)
    bit = rng.integers(0, 2, 20_000)
    cells, one, each = [x + bit for x in cells], context_mixing.Mixer(3), context_mixing.Mixer(3)
    assert len(context_mixing._distinct(cells)[0]) < 4000
    for _ in range(3):
        assert one.mixed(cells, weight) == pytest.approx(each._mixed(cells, weight), abs=1e-5)
    for a, b in ((one.states, each.states), (one.weights, each.weights), (one.map, each.map), (one.curve, each.curve)):
        assert a == pytest.approx(b, rel=1e-3, abs=1e-4)


def test_whole_beginnings_are_counted_exactly():
    words, counts = [b"abc", b"abd", b"ab", b"x"], np.array([3, 1, 0, 2])
    spelled = context_mixing.Spelled(words)
    cells, row_of, which = spelled.beginnings(counts)
    data = [w + b" " for w in words]
    at = [(w, j) for w in data for j in range(len(w))]
    for (w, j), k in zip(at, which):
        for left_out in (0, 1):
            for b in range(8):
                bit, n = w[j] >> 7 - b & 1, [0, 0]
                for v, c in zip(data, counts):  # words that begin alike up to this bit
                    if v[:j] == w[:j] and len(v) > j and v[j] >> 8 - b == w[j] >> 8 - b:
                        n[v[j] >> 7 - b & 1] += c
                n[bit] = max(n[bit] - left_out, 0)
                assert cells[2 * row_of[k] + left_out][b] == (n[0] * context_mixing.LEVELS + n[1]) * 2 + bit  # so few counts are their own steps


def _whole(docs, plan, m, head):
    """The parts of the model without Spark."""
    import pyarrow as pa

    dealer, rows = context_mixing.Dealer(plan, head), []
    for number in range(0, len(docs), 10):
        ids, tests, texts = zip(*docs[number : number + 10])
        rows += dealer.packets(number, list(ids), np.array(tests), pa.array([x.decode() for x in texts]))
    names, groups, out = ("part", "block", "seq", "body"), collections.defaultdict(list), []
    for r in rows:
        groups[r[0]].append(dict(zip(names, r)))
    for g in groups.values():
        rng = random.Random(1)
        rng.shuffle(g)  # a shuffle keeps no order
        out += context_mixing._scored(pa.Table.from_pylist(g, pa.schema([("part", pa.int32()), ("block", pa.int64()), ("seq", pa.int32()), ("body", pa.binary())])), m).to_pylist()
    by_block = collections.defaultdict(list)
    for r in out:
        by_block[r["block"]].append(r)
    return {r["doc_id"]: r for b in by_block.values() for r in context_mixing._merged(pa.Table.from_pylist(b), m["parts"]).to_pylist()}, len(groups)


def test_parts_of_hot_words(monkeypatch):
    """Words before more tokens than a part has, words hot in held-out texts alone, texts in many pieces: nothing is lost."""
    rng = random.Random(4)
    docs = [(i, i % 4 == 0, " ".join(rng.choice(["the", "the", "a", f"w{rng.randrange(20)}", f"r{i}{rng.randrange(900)}"] + ["only"] * (i % 4 == 0)) for _ in range(60)).encode()) for i in range(50)]
    c = collections.Counter(w for _, t, x in docs if not t for w in [*x.split(), context_mixing.END])
    head = [w for w, k in sorted(c.items(), key=lambda x: (-x[1], x[0])) if k > 1]
    n = np.array([c[w] for w in head])
    total = float(sum(c.values()) + len(c) + 1)
    rare = [w for w, k in c.items() if k == 1]
    spelling = (16, 16, 16), [np.zeros(1 << 16, np.uint32)] * 3
    base = np.log10((n + 1) / total)
    results = []
    for salts, hot, edges, piece in ((1, {}, [], 1 << 20), (7, {b"only": (3, 0)}, sorted(rare)[::400], 50)):
        monkeypatch.setattr(context_mixing, "PIECE", piece)
        plan = {"escape": len(head), "base": base, "salts": np.full(len(head) + 1, salts, np.uint64), "parts": salts, "edges": edges, "hot": hot}
        code = context_mixing.Code(np.append(n, len(rare)))
        got, groups = _whole(docs, plan, {"parts": salts, "code": code, "spelling": spelling, "hot": hot, "total": total}, head)
        assert groups >= salts + len(edges) + 1 and len(got) == len(docs)
        for d, t, x in docs:
            w = [*x.split(), context_mixing.END]
            assert (got[d]["held_out"], got[d]["n_tokens"], got[d]["n_known"], got[d]["n_bytes"]) == (t, len(w), sum(c[y] > 0 for y in w), len(x) + 2)
            assert got[d]["base_score"] == pytest.approx(sum(math.log10((c[y] + 1) / total) for y in w)) and got[d]["score"] < 0
        results.append(got)
    plan = {"escape": len(head), "base": base, "salts": np.ones(len(head) + 1, np.uint64), "parts": 1, "edges": [], "hot": {}}
    monkeypatch.setattr(context_mixing, "PIECE", 30)
    again, _ = _whole(docs, plan, {"parts": 1, "code": code, "spelling": spelling, "hot": {}, "total": total}, head)
    assert [again[d]["score"] for d, *_ in docs] == pytest.approx([results[0][d]["score"] for d, *_ in docs])


def test_long_words_are_spelled_in_stretches(monkeypatch):
    words = [b"ab", bytes(random.Random(1).choices(b"abc", k=300_000)), b"abc"]
    tables = [np.zeros(1 << 16, np.uint32)] * 3
    got = context_mixing.score_words(words, np.array([3, 0, 1]), (16,) * 3, tables)
    assert np.isfinite(got).all() and got[1] < got[0] < 0
    short = [b"abcabc", b"abcabd", b"x" * 40]
    monkeypatch.setattr(context_mixing, "chunks", lambda n, most: [(0, n)])
    whole = list(context_mixing.Spelled(short).stretches((12,) * 3, 12))
    monkeypatch.setattr(context_mixing, "chunks", lambda n, most: [(a, min(a + 5, n)) for a in range(0, n, 5)])
    cut = list(context_mixing.Spelled(short).stretches((12,) * 3, 12))
    for k in (0, 1, 4):
        assert (np.concatenate([x[k] for x in cut]) == whole[0][k]).all()
    assert (np.concatenate([x[2][0] for x in cut]) == whole[0][2][0]).all()


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(50))) for i in range(120)] + [(200, "one text that comes twice " * 5), (207, "one text that comes twice " * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, two = ({r.doc_id: r.score for r in context_mixing.score(docs.repartition(n, "doc_id")).collect()} for n in (1, 7))
    assert one == two and one[200] > -60 > max(one[i] for i in range(120))  # what occurs twice stands out


def test_contexts_of_many_parts_are_counted_whole(spark, monkeypatch):
    """What predictors see does not depend on how many parts the tokens are dealt over."""
    import pyarrow as pa

    rng = random.Random(12)
    word = lambda: rng.choice(["the", "the", "of", "a", f"w{rng.randrange(20)}", f"r{rng.randrange(900)}"])
    rows = [(i, "of the " * (i % 3 == 0) + " ".join(word() for _ in range(25))) for i in range(70)]
    twin = " ".join(f"the u{k}" for k in range(12))
    rows += [(200, twin), (207, twin), *((i, "") for i in range(300, 340))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    names = "block bigint, part int, seq int, body binary"
    dealt_over = []

    def local(dealt, model):
        groups, out = collections.defaultdict(list), []
        for r in dealt.collect():
            groups[r.part].append(r.asDict())
        dealt_over.append(len(groups))
        with monkeypatch.context() as m:
            m.setattr(context_mixing, "LEAST_BITS", 24)
            m.setattr(context_mixing.Mixer, "_learn", lambda *_: None)
            for g in groups.values():
                out += context_mixing._scored(pa.Table.from_pylist(g, pa.schema([("part", pa.int32()), ("block", pa.int64()), ("seq", pa.int32()), ("body", pa.binary())])), model.value).to_pylist()
        return spark.createDataFrame([(r["block"], r["part"], r["seq"], bytes(r["body"])) for r in out], names)

    with monkeypatch.context() as m:
        m.setattr(context_mixing, "scored_parts", local)
        whole = {r.doc_id: r.score for r in context_mixing.score(docs).collect()}
        m.setattr(context_mixing, "PART", 18)  # of words, pairs, triples and the starts of texts some are more frequent
        parts = {r.doc_id: r.score for r in context_mixing.score(docs).collect()}
    assert dealt_over[1] > dealt_over[0] + 30 and parts == pytest.approx(whole, abs=1e-4)
    # the model itself: equal texts are predicted alike, and those that occur twice stand out
    monkeypatch.setattr(context_mixing, "PART", 18)
    scored = {r.doc_id: r for r in context_mixing.score(docs.repartition(3)).collect()}
    assert len({r.score for d, r in scored.items() if d >= 300 and not r.held_out}) == 1
    assert len({r.score for d, r in scored.items() if d >= 300 and r.held_out}) == 1
    again = {r.doc_id: r.score for r in context_mixing.score(docs.repartition(1)).collect()}
    assert again == {d: r.score for d, r in scored.items()}


def test_repeats(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab cd") for _ in range(400)) for _ in range(4)]
    rows = []
    for i in range(80):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = "X"
        a = rng.randint(0, 200)
        rows.append((i, "".join(t)[a : a + rng.randint(50, 300)]))
    rows += [(100, "a" * 1000), (101, None), (102, ""), (103, "ab" * 300), (104, "é" * 120), (105, "p" * 99), (106, "p" * 99)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in suffix_family.cleaned(spark.createDataFrame(rows, "doc_id bigint, text string")).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) sha").collect()}
    assert got == repeats(rows)


def _entries(docs, hot=()):
    import pyarrow as pa

    batches = (pa.RecordBatch.from_pydict({"doc": [d], "data": [x]}) for d, x in docs)
    return [r for b in suffix_family._indexed(batches, np.array(sorted(hot), np.uint64)) for r in b.to_pylist()]


def test_suffixes_of_pieces(monkeypatch):
    """A text longer than the buffer: every window belongs to one suffix."""
    monkeypatch.setattr(suffix_family, "BUFFER", 4096)
    part = np.random.default_rng(1).integers(97, 123, 5000, dtype=np.uint8).tobytes()
    found = _entries([(1, part + part), (2, part)])
    for doc, size in ((1, 10000), (2, 5000)):
        assert sorted(r["at"] + k for r in found if r["doc"] == doc for k in range(r["n"])) == list(range(size - 99))
    keys = {r["key"] for r in found if not r["done"]}
    dealt = _entries([(2, part)], [np.array([k]).view(np.uint64)[0] for k in keys])
    assert all(r["hot"] for r in dealt) and not keys & {r["key"] for r in dealt}


def test_a_task_settles_what_it_has_seen():
    part = np.random.default_rng(2).integers(97, 123, 20_000, dtype=np.uint8).tobytes()
    found = _entries([(d, part) for d in (3, *range(4, 60), 1, 2, *range(60, 99))])
    open_ = collections.Counter(r["doc"] for r in found if not r["done"])
    assert open_.keys() == {1, 3} and open_[1] == open_[3] == len([r for r in found if r["doc"] == 1])
    first = {(r["key"], r["dig"]) for r in found if r["doc"] == 1}
    assert all(r["done"] or (r["key"], r["dig"]) in first for r in found)


def test_repeats_far_into_a_text():
    """A passage beyond byte 2^24 of a text comes again in another one."""
    text = np.random.default_rng(4).integers(97, 123, 17 << 20, dtype=np.uint8).tobytes()
    found = _entries([(1, text), (2, text[(1 << 24) + 1000 :][:5000])])
    assert max(r["at"] for r in found) > 1 << 24
    keys = {r["key"] for r in found if r["doc"] == 1}
    again = [r for r in found if r["doc"] == 2 and (r["done"] or r["key"] in keys)]
    assert sorted(r["at"] + k for r in again for k in range(r["n"])) == list(range(5000 - 99))


def test_family_takes_batches_and_is_opened_again(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(600)).encode() for _ in range(6)]
    docs = [(1, texts[0]), (2, texts[1]), (3, texts[0] + texts[2]), (4, texts[3]), (5, texts[1]), (6, texts[4] + texts[3]), (7, texts[2])]
    scratch, held = Scratch(spark, "t"), collections.defaultdict(set)
    for k, (doc, data) in enumerate(docs):
        family = suffix_family.Family(spark, scratch.path("family"), 3)  # opened anew for each batch
        assert [level for level, _ in family.levels] == [n for n in range(3) if k >> n & 1]
        for r in family.add(spark.createDataFrame([(doc, data)], "doc bigint, data binary"), scratch).collect():
            held[r.doc] |= set(range(r.spot >> 8, (r.spot >> 8) + (r.spot & 255)))
        family.close()
    assert held[1] == held[2] == held[4] == set() and held[5] == set(range(501))
    assert len(held[3]) > 400 and max(held[3]) < 501 and len(held[6]) > 400 and min(held[6]) >= 600 and len(held[7]) > 400
    family = suffix_family.Family(spark, scratch.path("family"))
    assert family.buckets == 3 and family.undecided().count() > 0 and len(family.levels) == 1
    family.close(keep=False)


def test_repeats_over_batches_and_hot_keys(spark, monkeypatch):
    """One common string with other surroundings in every text, dealt by surroundings; batches that split the rest."""
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    lines = [noise(suffix_family.GRAM) for _ in range(2000)]  # that of the least hash is chosen wherever it stands
    line, rows = min(lines, key=lambda x: suffix_family.mix(suffix_family.Hashed(np.frombuffer(x.encode(), np.uint8), 1).grams(suffix_family.GRAM))[0]), []
    for i in range(300):
        rows.append((i * 3, noise(rng.randint(20, 90)) + line + noise(60) + (rows[-7][1] if i % 5 == 0 and i > 7 else "")))
    monkeypatch.setattr(suffix_family, "SHARE", 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    data = docs.select(F.col("doc_id").alias("doc"), F.col("text").cast("binary").alias("data"))
    assert len(suffix_family.hot_keys(data, 4, 1500)) > 0
    for n in (1, 5):
        monkeypatch.setattr(suffix_family, "BATCHES", n)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in suffix_family.cleaned(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) sha").collect()}
        assert got == repeats(rows)


def test_repeats_of_odd_rows(spark, odd):
    got = suffix_family.cleaned(odd).collect()
    assert len(got) == len(ODD) and next(r for r in got if r.doc_id == 5).n_removed > 29000
    assert suffix_family.cleaned(odd.limit(0)).count() == 0


def test_conversations(spark):
    log = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "b", 6: "", 7: "a"}
    rows = [(c, t, "user" if t % 2 == 0 else None, x, "extra") for c, text in log.items() for t, x in enumerate(text)]
    rows += [(8, t, "user", None, "extra") for t in range(200)] + [(9, t, "user", None, "extra") for t in range(199)] + [(None, 0, "assistant", "z", "extra")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq string")
    got = chat_snapshots.collapse(df).collect()
    assert {r.conv_id for r in got} == {2, 4, 5, 8, None}
    assert [r.segment for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.seq)] == ["<|im_start|>user\na<|im_end|>\n", "<|im_start|>unknown\nb<|im_end|>\n", "<|im_start|>user\nc<|im_end|>\n"]
    assert [r.seq for r in sorted((r for r in got if r.conv_id == 8), key=lambda r: r.seq)] == list(range(200))
    assert [r.trainable for r in got if r.conv_id is None] == [True]
    assert chat_snapshots.collapse(df.limit(0)).count() == 0
    strange = spark.createDataFrame([(None, 0, "user", "a"), ("", 0, "user", "b"), ("x", -70, "user", "c"), ("x", None, "user", "d"), ("x", 1, "user", "e")], "conv_id string, turn bigint, role string, text string")
    got = {(r.conv_id, r.seq): (r.n_turns, r.segment.split("\n")[1][0]) for r in chat_snapshots.collapse(strange).collect()}
    assert got == {(None, 0): (1, "a"), ("", 0): (1, "b"), ("x", 0): (3, "d"), ("x", 1): (3, "c"), ("x", 2): (3, "e")}


def test_urls(spark):
    urls = ["http://a.example.com/en/70?x", "HTTP://A.EXAMPLE.COM/en/8", "https://example.net/de/8", "x.org/es/1", None, "http://w.org/es/?q", "http://corg/es/", "ftp://x.net", "http://x.net#/de/", "http://x.net/de/9"]
    pages = spark.createDataFrame(list(enumerate([*urls, urls[0]])), "page_id bigint, url string").withColumn("host", F.lit("x"))
    listed = spark.createDataFrame([("x.net",), ("not there",), ("",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge(pages, listed).collect()}
    assert got[0] == got[10] == ("a.example.com", "/en/70", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block")
    assert got[2][2:] == ("example.net/de/8", "block") and got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("org/es/", "block")
    assert got[6][2:] == (None, "allow") and got[7] == got[8] == ("x.net", "", None, "block") and got[9][2:] == ("net/de/", "block")
    assert url_cascade.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_cascades_stay_below_their_bound(spark, monkeypatch):
    """Levels that unlisted keys fill, not listed ones, are split too."""
    monkeypatch.setattr(url_cascade, "MAX_BYTES", 64)
    monkeypatch.setattr(url_cascade, "BITS_PER_KEY", 4)
    keys = spark.range(3000).select(*(h.alias(f"h{i}") for i, h in enumerate(url_cascade.hashes(F.col("id").cast("string")), 1)), (F.col("id") < 20).alias("l"))
    cascades = url_cascade.build(keys.where("l").drop("l"), keys.where("not l").drop("l"), Scratch(spark, "t"))
    assert len(cascades) > 1 and all(x.nbytes <= 72 for c in cascades for x in c.levels)
    held = keys.collect()
    for r in held:
        mine = cascades[r.h2 % len(cascades)]
        assert mine.listed(np.array([r.h1]), np.array([r.h2]))[0] == r.l


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_cascade, "BITS_PER_KEY", 4)  # so that levels let much through
    keys = spark.range(4000).select(*(h.alias(f"h{i}") for i, h in enumerate(url_cascade.hashes(F.col("id").cast("string")), 1)), (F.col("id") % 5 == 0).alias("l"))
    held = keys.collect()
    h1, h2 = (np.array([r[k] for r in held]) for k in ("h1", "h2"))
    cascade = url_cascade.build(keys.where("l").drop("l"), keys.where("not l").drop("l"), Scratch(spark, "t"))[0]
    assert len(cascade.levels) > 2 and cascade.listed(h1, h2).tolist() == [r.l for r in held]
