"""The n-gram join's tables: what of them is shuffled, and how texts travel."""

import numpy as np
import pyarrow as pa
import pytest

from bazaar.llm import ngram_join, shared
from tests.llm import brute


@pytest.fixture(scope="module")
def join(sample):
    return ngram_join._Join(sample, ngram_join.SHINGLE, ngram_join.SIMILARITY)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shingles_are_dealt_once(spark, join):
    assert "hashpartitioning(shingle" not in plan(join.least_groups())
    labelled = join.members.selectExpr("*", "node AS label")
    open_ = join.open_groups(labelled)
    assert not open_.isEmpty()
    assert "hashpartitioning(shingle" not in plan(join.representatives(open_))


def test_few_texts_travel_and_not_as_sets(spark, join, sample):
    nodes = [r["node"] for r in join.members.orderBy("doc_id").limit(4).collect()]
    pairs = spark.createDataFrame([(nodes[0], nodes[1]), (nodes[2], nodes[3])], "a long, b long")
    texts = {r["node"]: shared.unsqueeze(bytes(r["text"])) for r in join.fetch_texts(pairs).collect()}
    assert set(nodes) <= set(texts) and len(texts) < sample.count() / 4
    for node, text in texts.items():
        assert ngram_join._signature(ngram_join.shingle_sets([text])[0]) == node


@pytest.mark.parametrize("size", [1, 60, 1 << 20])
def test_pairs_are_taken_apart_in_pieces(monkeypatch, size):
    monkeypatch.setattr(ngram_join, "PIECE_BYTES", size)
    texts = [b" ".join(b"w%d" % (i * j % 17) for j in range(30)) for i in range(9)]
    packed, ends = [shared.squeeze(t) for t in texts], [(i, j) for i in range(9) for j in range(9) if i != j]
    columns = [[i for i, _ in ends], [packed[i] for i, _ in ends], [j for _, j in ends], [packed[j] for _, j in ends]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "x", "b", "y"])
    found, sets = list(ngram_join._pair_sets(batch, 5)), ngram_join.shingle_sets(texts)
    assert len(found) == len(ends)
    for (a, b), (i, j) in zip(found, ends, strict=True):
        assert np.array_equal(a, sets[i]) and np.array_equal(b, sets[j])
    assert not list(ngram_join._pair_sets(batch.slice(0, 0), 5))


@pytest.mark.parametrize("keys", [20, 300])
def test_blocks_of_few_shingles_give_the_same(awkward, pairs, same, monkeypatch, keys):
    monkeypatch.setattr(ngram_join, "BLOCK_KEYS", keys)
    monkeypatch.setattr(ngram_join, "BUCKET_KEYS", keys)
    docs = awkward.where("doc_id IS NULL OR doc_id <> 16")
    found = ngram_join.link_documents(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert same(found, brute.linked(pairs(docs)))


def test_blocks_ask_by_few_bits_and_rarely_in_vain():
    for total in (0, 1, 1_000, 26_000_000, 10**10, 10**18):
        bits = ngram_join._asked_bits(total)
        assert bits <= 64 and (total <= 2 ** (bits - 12) or bits == 64)
    assert ngram_join._asked_bits(26_000_000) < 40
