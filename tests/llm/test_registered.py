"""The registered queries on the smallest tables, and the pipeline."""

import base64
import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftrank.llm import prefix_bpe, queries, transport_stream
from tests.compare import duck, same
from tests.conftest import DATA
from tests.llm.brute import components, quality, repeats, words

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    same(queries.queries()[name](spark, SF), duck(SF), queries.oracle_sql()[name])


def test_near_duplicates_and_repeats(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    near = queries.queries()["op5_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near} == components(docs)
    found = queries.queries()["op7_suffix_family"](spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == repeats(docs)


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks, pattern = prefix_bpe.public_vocabulary()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), _sha(" ".join(map(str, ids)).encode()), _sha((text or "").encode())


def test_shards(spark):
    rows = queries.queries()["op1_kd_shards"](spark, SF).collect()
    data = {r.doc_id: (r.text or "").encode() for r in _docs(spark)}
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted((d, len(x) + 16, zlib.crc32(x)) for d, x in data.items())
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and {r.shard for r in rows} == set(range(40))
    for k in range(40):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    sizes = [sum(r["size"] for r in rows if r.shard == k) for k in range(40)]
    assert max(sizes) - sum(sizes) / 40 <= max(r["size"] for r in rows)


def test_streams(spark):
    rows = {r.doc_id: r for r in queries.queries()["op2_transport_stream"](spark, SF).collect()}
    for d in _docs(spark):
        raw, r = (d.text or "").encode(), rows[d.doc_id]
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        media = transport_stream.write_stream(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), _sha(payload), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), _sha(media)) and f"units={-(-len(payload) // 3840)};" in r.feature


def test_mixture(spark):
    rows = queries.queries()["op3_source_mix"](spark, SF).collect()
    docs = _docs(spark)
    size = {d.doc_id: len(words(d.text)) for d in docs}
    of = collections.Counter()
    for d in docs:
        of[d.source] += size[d.doc_id]
    names = sorted(of, key=lambda x: (x is None, x or ""))
    total, weight = sum(of.values()), {x: k % 3 + 1 for k, x in enumerate(names)}
    target, open_ = {}, set(names)
    while True:  # shares by weight of what full sources leave
        left, w = total - sum(target.values()), sum(weight[x] for x in open_)
        full = {x for x in open_ if left * weight[x] / w > 3 * of[x]}
        if not full:
            target |= {x: left * weight[x] / w for x in open_}
            break
        target |= {x: 3.0 * of[x] for x in full}
        open_ -= full
    source = {d.doc_id: d.source for d in docs}
    assert len(rows) == len(docs)
    taken = collections.Counter()
    for r in rows:
        x = source[r.doc_id]
        assert (r["size"], r.source_size, r.target) == (size[r.doc_id], of[x], pytest.approx(target[x])) and 0 <= r.taken <= 3 * r["size"]
        taken[x] += r.taken
    assert all(abs(taken[x] - target[x]) <= 0.1 * target[x] + 200 for x in names)
    again = {r.doc_id: r.taken for r in queries.queries()["op3_source_mix"](spark, SF).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_encodings(spark, library):
    rows = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.queries()["op4_prefix_bpe"](spark, SF).collect()}
    assert rows == {d.doc_id: _digests(library, d.text) for d in _docs(spark)}


def test_scores(spark):
    """Counts and base by hand; the model against base on texts that it has not learned, in bits that only pay for what is known."""
    rows = {r.doc_id: r for r in queries.queries()["op6_context_mixing"](spark, SF).collect()}
    tokens = {d.doc_id: [*words(d.text), b"\xff"] for d in _docs(spark)}
    test = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = collections.Counter(w for d, x in tokens.items() if not test[d] for w in x)
    n, v = sum(c.values()), len(c)
    for d, x in tokens.items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (test[d], len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) and r.score < 0


def test_pipeline(spark, library):
    """Every stage against plain versions on all that the one before it kept; extra columns stay."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    columns = [*source.columns, "rest", "extra one"]
    docs = source.withColumn("rest", F.col("doc_id") * 2).withColumn("extra one", F.lit("x"))
    scratch, rows = corpus_pipeline.Scratch(spark, "test"), {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = scratch.keep(stage(spark, docs, SF), name)
        got = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and docs.count() == len(got) > 0
        assert all(r.rest == 2 * d and r["extra one"] == "x" and (r.lang, r.source) == (rows[d].lang, rows[d].source) for d, r in got.items())
        text = {d: r.text for d, r in rows.items()}
        if name == "quality_rules":
            want = {}
            for d, t in text.items():
                n, chars, symbols, repeated, again = quality(t)
                lines = sum(bool(x.encode().split()) for x in (t or "").split("\n"))
                if n >= 10 and 100 * again <= 20 * n and 100 * symbols <= 5 * chars and not (lines >= 4 and 2 * repeated > lines):
                    want[d] = t
        elif name == "near_dedup":
            want = {d: text[d] for d, (_, _, kept) in components(list(text.items())).items() if kept}
        elif name == "suffix_dedup":
            found = repeats(list(text.items()))
            assert all(found[d][1] or r.text == text[d] for d, r in got.items())
            assert {d for d, (n, gone, *_) in found.items() if gone < n or not gone} == set(got)
            want = {d: r.text for d, r in got.items() if found[d][3] == _sha(r.text.encode()) or "\ufffd" not in r.text and found[d][0] - found[d][1] - len(r.text.encode()) < 8}
            assert all(r.n_chars == len(r.text) for r in got.values())
        else:
            assert all(r.n_chars == len(r.text) and len(words(r.text)) <= 3 * len(words(text[d])) and set(words(r.text)) <= set(words(text[d])) for d, r in got.items())
            total = sum(len(words(t)) for t in text.values())
            assert abs(sum(len(words(r.text)) for r in got.values()) - total) < 0.1 * total
            want = {d: r.text for d, r in got.items()}
        assert {d: r.text for d, r in got.items()} == want
        rows = got
    name, stage = corpus_pipeline.STAGES[4]
    last = stage(spark, docs, SF)
    assert set(last.columns) == {"doc_id", "lang", "source", "rest", "extra one", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last.collect()} == {d: _digests(library, r.text) for d, r in rows.items()}


def test_pipeline_runs_its_stages(spark, library):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.n_tokens > 0 and len(r.ids_sha256) == 64 for r in rows)
