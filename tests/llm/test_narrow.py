"""Operators without a shuffle: quality rules, transport streams, byte-level BPE."""

import base64
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from driftrank.llm import prefix_bpe, quality_rules, transport_stream
from driftrank.llm.common import utf8
from tests.llm.brute import ODD, SCHEMA, quality


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_quality_measures(odd):
    clash = odd.withColumn("n_words", F.lit("x")).withColumn("failed", F.lit("y")).withColumn("other", F.lit(1))
    rows = quality_rules.apply_policy(quality_rules.ledger(clash)).where("n_words >= 0").collect()
    assert len(rows) == len(ODD) and rows[0].other == 1
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == sorted(quality(t) for _, t, *_ in ODD)
    long = next(r for r in rows if r.doc_id == 5)
    assert long.failed & quality_rules.BIT["repeated_windows"] and not long.kept
    assert quality_rules.ledger(odd.limit(0)).count() == 0


def test_quality_windows_that_overlap(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 25)))) for i in range(60)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measure(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: quality(t)[4] for i, t in rows}


def test_policies_and_ablations(spark):
    bit = quality_rules.BIT
    rows = [(0,), (bit["symbols"],), (bit["symbols"] | bit["few_words"],), (bit["long_words"],)]
    entries = spark.createDataFrame(rows, "failed bigint")
    assert [r.kept for r in quality_rules.apply_policy(entries, "v1").collect()] == [True, False, False, True]
    found = {r.rule: (r.failed, r.failed_alone, r.kept_without) for r in quality_rules.ablations(entries, "v1").collect()}
    assert found["symbols"] == (2, 1, 3) and found["few_words"] == (1, 0, 2)


@pytest.mark.parametrize("n", [0, 1, 100, 160, 161, 162, 168, 169, 176, 183, 184, 3840, 3841, 40000])
def test_stream_round_trip(n):
    data = bytes(random.Random(n).randrange(256) for _ in range(n))
    stream = transport_stream.write_stream(data)
    assert len(stream) % 188 == 0 and all(stream[i] == 0x47 for i in range(0, len(stream), 188))
    read = transport_stream.read_stream(stream)
    assert (read["data"], read["cc_errors"], read["lost_bytes"]) == (data, 0, 0)
    assert read["timestamps"] == [90_000 + 3600 * k for k in range(-(-n // 3840))] and read["random_access"] == list(range(0, -(-n // 3840), 8))


def test_stream_defects():
    data = bytes(range(256)) * 200
    s = transport_stream.write_stream(data)
    assert transport_stream.read_stream(s[: 188 * 5] + s[188 * 6 :])["cc_errors"] == 1
    again = transport_stream.read_stream(s[: 188 * 5] + s[188 * 4 :])
    assert again["data"] == data and again["cc_errors"] == 0
    loose = transport_stream.read_stream(b"xx" + s + b"yyy")
    assert loose["data"] == data and loose["lost_bytes"] == 5
    broken = bytearray(s)
    broken[188 + 10] ^= 1  # in the program map: its CRC no longer fits
    assert transport_stream.read_stream(bytes(broken))["feature"].startswith("type=none")
    assert transport_stream.read_stream(None)["data"] == b"" == transport_stream.read_stream(b"G" * 100)["data"]


def test_stream_columns(odd):
    docs = odd.select("doc_id", F.lit("x").alias("feature"), F.lit(2).alias("other"), utf8(F.col("text")).alias("raw"))
    docs = docs.withColumn("payload", transport_stream.padded(F.col("raw")))
    rows = transport_stream.demultiplex(transport_stream.multiplex(docs)).collect()
    assert len(rows) == len(ODD) and all(r.other == 2 and bytes(r.data) == bytes(r.raw).ljust(max(192, -(-len(r.raw) // 192) * 192)) for r in rows)
    tail = docs.select("payload", F.crc32(F.substring("payload", -16, 16)).alias("c")).first()
    assert tail.c == zlib.crc32(bytes(tail.payload)[-16:])
    assert transport_stream.demultiplex(transport_stream.multiplex(docs.limit(0))).count() == 0


@pytest.fixture(scope="module")
def bpe():
    import tiktoken

    ranks, pattern = prefix_bpe.public_vocabulary()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return prefix_bpe.Encoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), ranks, pattern


PARTS = ["a", "th", "  ", "\n", "é", "日本", "1", "23", "'s", "!!", "\t", "　", "😀", "x" * 40, "\x1c", "the", "ing", " of", "=-=-"]


def test_bpe_is_the_librarys(bpe):
    encoder, library, *_ = bpe
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)
    assert encoder.encode("ab" * 20000).tolist() == library.encode_ordinary("ab" * 20000)


def test_bpe_appends_and_edits(bpe):
    encoder, library, *_ = bpe
    rng, vocabulary = random.Random(2), encoder.vocabulary
    for _ in range(150):
        data = "".join(rng.choice(PARTS) for _ in range(30)).encode()
        table = prefix_bpe.PrefixTable(vocabulary, data[:20])
        table.append(data[20:])
        assert table.last == prefix_bpe.PrefixTable(vocabulary, data).last
        i = rng.randint(0, len(data))
        table.replace(i, rng.randint(i, len(data)), b"edit")
        assert table.last == prefix_bpe.PrefixTable(vocabulary, table.data).last
        held = prefix_bpe.EditableText(encoder, "".join(rng.choice(PARTS) for _ in range(30)))
        i = rng.randint(0, len(held.text))
        held.replace(i, rng.randint(i, len(held.text)), rng.choice(PARTS))
        held.append(rng.choice(PARTS))
        assert held.ids() == library.encode_ordinary(held.text)
    long = prefix_bpe.PrefixTable(vocabulary, b"abcdefgh " * 2000)
    assert long.replace(9000, 9001, b"Z") < 1000


def test_bpe_columns(odd, bpe):
    _, library, ranks, pattern = bpe
    encoded = prefix_bpe.encode(odd.withColumn("ids", F.lit("x")), ranks, pattern)
    rows = prefix_bpe.digests(encoded, ranks).collect()
    want = []
    for d, t, *_ in ODD:
        ids = library.encode_ordinary(t or "")
        want.append((str(d), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert sorted(bytes(r.data).decode() for r in prefix_bpe.decode(encoded, ranks).collect()) == sorted(t or "" for _, t, *_ in ODD)
    assert prefix_bpe.encode(odd.limit(0), ranks, pattern).count() == 0
