import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanloom.llm import packing, tokenfile
from spanloom.llm.queries import op2_token_planes, op6_min_bin_slack
from spanloom.llm.tokens import Encoder, vocabulary_json

ENCODER = Encoder(vocabulary_json(), cache=50)
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def plain(texts):
    return [e.ids for e in PLAIN.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,aB9é中\x1c  <|>s"), st.characters(codec="utf-8"))), max_size=4))
def test_cached_ids_are_the_tokenizers(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == plain(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endo", "ftext|>", " ", "\n", "a", " b", "é", "中"]), max_size=8).map("".join))
def test_added_tokens_in_texts(text):
    assert ENCODER.encode([text, "a b"])[0].tolist() == plain([text])[0]


def test_ids_of_the_tables(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [None, "", " ", "  a", "a  ", "<|endoftext|> x", "a <|endoftext|> b", "x<|endoftext|>y  <|endoftext|>", "<|ENDOFTEXT|> z", "a <|endof text|> b"]
    assert [x.tolist() for x in ENCODER.encode(texts)] == plain(texts)


@pytest.mark.parametrize("planes", ["bit", "byte"])
@given(ids=st.lists(st.integers(0, 2**32 - 1), max_size=300), chunk=st.sampled_from([1, 7, 64, 1000]), at=st.integers(0, 300), n=st.integers(0, 300))
def test_shards_round_trip(planes, ids, chunk, at, n):
    data = tokenfile.pack_shard([5], [np.array(ids, "<u4")], 1, 2, planes, chunk)
    assert tokenfile.read_ids(data).tolist() == ids
    assert tokenfile.read_ids(data, at, at + n).tolist() == ids[at : at + n]
    head, index = tokenfile.open_shard(data)
    assert (head["shard"], head["part"], index["keys"], index["sizes"]) == (1, 2, [5], [len(ids)])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2_against_plain_encoding(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, at = [], 0
    for (d, _), ids in zip(docs, plain([t for _, t in docs])):
        want.append((d, at, len(ids) + 1, crc([*ids, 0])))
        at += len(ids) + 1
    assert sorted(map(tuple, op2_token_planes(spark, sf).collect())) == want


def test_op2_odd_rows(spark):
    rows = [(3, "b"), (None, "z"), (3, "a"), (3, "a"), (-7, None), (2**60, ""), (9, "x " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as key", "3 as ids")
    got = sorted((r.start, r.key, r.n_tokens, r.ids_crc32) for r in tokenfile.token_table(docs).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for (k, t), have in zip(order, got, strict=True):
        ids = [*plain([t])[0], 0]
        assert have == (at, k, len(ids), crc(ids))
        at += len(ids)
    assert tokenfile.token_table(docs.limit(0)).count() == 0


def test_op2_splits_shards(spark, tmp_path):
    docs = spark.range(50).selectExpr("id as doc_id", "repeat('word ', int(id)) as text")
    manifest = tokenfile.write_tokens(docs, f"file://{tmp_path}/t", shard_ids=40, planes="byte").collect()
    got = sorted((r.start, r.key, r.n_tokens) for r in tokenfile.read_tokens(spark, f"file://{tmp_path}/t").collect())
    assert len(manifest) > 8 and [k for _, k, _ in got] == list(range(50))
    assert all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))


def check_packing(rows, docs, size=1024):
    """rows: (doc, piece, start, length, crc, sequence, offset) of documents with different ids."""
    want = {}
    for d, ids in docs.items():
        for i, (a, n) in enumerate(packing.cut_points(len(ids), size)):
            want[d, i] = (a, n, crc(ids[a : a + n]))
    assert {(r[0], r[1]): tuple(r[2:5]) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= size
    return len(bins)


def test_op6_against_plain_encoding(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {d: [*x, 2] for d, x in zip(docs, plain(list(docs.values())))}
    n = check_packing([tuple(r) for r in op6_min_bin_slack(spark, sf).collect()], ids)
    assert n <= -(-sum(map(len, ids.values())) // 1024) * 1.01 + 1


def test_op6_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a"), (2, ""), (4, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as shard")
    got = packing.pack(docs).collect()
    assert sum(r.length for r in got) == sum(len(x) + 1 for x in plain([t for _, t in rows]))
    whole = packing.sequences(packing.pack(docs)).collect()
    assert sum(len(r.ids) // r.width for r in whole) == sum(r.length for r in got) and max(len(r.ids) // r.width for r in whole) <= 1024
    assert packing.pack(docs.limit(0)).count() == 0


def test_cut_points():
    assert packing.cut_points(5, 10) == [(0, 5)] and packing.cut_points(20, 10) == [(0, 10), (10, 10)] and packing.cut_points(21, 10) == [(0, 1), (1, 10), (11, 10)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=8))
def test_fullest_is_the_largest_sum(counts):
    used = packing.fullest(counts, 30)
    sums = {0}
    for k, v in counts.items():
        sums = {s + k * i for s in sums for i in range(v + 1) if s + k * i <= 30}
    assert sum(k * v for k, v in used.items()) == max(sums) and all(v <= counts[k] for k, v in used.items())


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
def test_plan_uses_everything_once(counts):
    plan = packing.plan_bins(counts, 30)
    total = {}
    for bins, used in plan:
        assert bins > 0 and sum(k * v for k, v in used.items()) <= 30
        for k, v in used.items():
            total[k] = total.get(k, 0) + bins * v
    assert total == counts
