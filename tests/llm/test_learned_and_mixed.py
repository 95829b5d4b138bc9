"""Toxicity, mixing, nearest neighbours and the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bazaar.llm import ann, mixing, toxicity
from bazaar.llm.components import components
from tests.llm import brute


def _held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_toxicity_of_documents_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = toxicity.score_toxicity(docs, labels)
    assert found.count() == docs.count()
    assert {(r["doc_id"], r["held_out"]) for r in found.collect()} == {
        (r["doc_id"], _held_out(r["doc_id"])) for r in docs.select("doc_id").collect()
    }
    told = found.where("held_out").join(labels, "doc_id")
    assert told.where("toxic = predicted").count() >= 0.9 * told.count()


def test_toxicity_of_awkward_texts(spark, awkward, nothing):
    labels = spark.createDataFrame(
        [(0, 1), (0, 0), (1, 1), (60, 0), (None, 1), (70, None), (999, 1)], "doc_id long, toxic int"
    )
    found = toxicity.score_toxicity(awkward, labels)
    assert found.count() == awkward.count()
    assert found.where("not (score between 0 and 1) or predicted <> int(score >= 0.3)").isEmpty()
    assert toxicity.score_toxicity(nothing, labels).count() == 0
    none = toxicity.score_toxicity(awkward, labels.limit(0))
    assert none.agg(F.max("score")).first()[0] < 0.01


def test_toxic_words_are_learned_without_clean_labels(spark):
    draw = random.Random(1)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = draw.choices(common, k=80)
        if i % 6 == 0:
            words[draw.randrange(80)] = draw.choice(["scum", "idiot"])
        if i // 6 % 2 == 0:
            labels.append((i, int(i % 6 == 0)))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    right = sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in found.collect())
    assert right >= 880


def _queue(rows, targets, seed_key):
    """Taken words by plain weighted fair queueing over (row, source, size) lists."""
    budget = sum(size for _, _, size in rows)
    of = {source: (whole, target) for _, source, whole, target in targets}
    items = []
    for source in of:
        whole, target = of[source]
        queued = 0
        for row, _, size in sorted((r for r in rows if r[1] == source), key=seed_key):
            queued += size
            if size and target:
                items += [((turn * whole + queued) / target, row, size) for turn in range(3)]
    taken, used = {}, 0
    for _, row, size in sorted(items):
        if used + size > budget:
            break
        used += size
        taken[row] = taken.get(row, 0) + size
    return taken


def test_mix_is_that_of_a_plain_queue(spark, sample):
    found = mixing.mix_sources(sample, rows_per_slice=15).collect()
    key = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col("doc_id").cast("string")), 1)
    keys = dict(map(tuple, sample.select("doc_id", key).collect()))
    rows = [(r["doc_id"], r["source"], len(brute.words(r["text"]))) for r in sample.collect()]
    sizes: dict = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    targets = mixing.source_targets(list(sizes.items()), mixing.WEIGHTS, 3)
    wanted = _queue(rows, targets, lambda r: keys[r[0]])
    assert {r["doc_id"]: r["taken"] for r in found if r["taken"]} == wanted
    assert sorted((r["doc_id"], r["size"]) for r in found) == sorted((d, s) for d, _, s in rows)


def test_targets_stop_at_three_times_the_size():
    found = mixing.source_targets([(None, 10), ("b", 1), ("a", 89), ("c", 0)], (5, 2, 1), 3)
    assert [(s, t) for _, s, _, t in found][1:] == [("b", 3.0), ("c", 0.0), (None, 30.0)]
    assert math.isclose(sum(t for *_, t in found), 100)


def test_mix_of_awkward_rows(awkward, nothing):
    found = mixing.mix_sources(awkward)
    assert found.count() == awkward.count()
    assert found.where("taken > 3 * size or taken % nullif(size, 0) <> 0").isEmpty()
    first, again = found.collect(), mixing.mix_sources(awkward.repartition(3)).collect()
    assert sorted(first, key=repr) == sorted(again, key=repr)
    assert mixing.mix_sources(nothing).count() == 0


def _vectors(spark, vectors):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("other"))


def _nearest(vectors, query, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items()}
    order = sorted((i for i in unit if i != query), key=lambda i: (-round(float(unit[i] @ unit[query]), 9), i))
    return order[:k]


def test_neighbours_of_few_vectors_are_exact(spark):
    draw = np.random.default_rng(2)
    vectors = {i: draw.normal(size=6) for i in range(40)} | {i: np.ones(6) for i in range(100, 160)}
    bad = [(200, None), (250, [0] * 6), (300, [1, None, 0, 0, 0, 0]), (350, [float("nan")] * 6), (400, [1, 2]),
           (None, [1] * 6), (450, [float("inf")] + [0] * 5)]
    df = _vectors(spark, [*((i, v.tolist()) for i, v in vectors.items()), *bad])
    found = ann.search(df, F.col("vec_id") % 50 == 0, recall=1.0, rows_per_task=7)
    got: dict = {}
    for r in sorted(found.collect()):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {q: _nearest(vectors, q, 5) for q in (0, 100, 150)}


def test_fewer_candidates_than_wanted(spark):
    df = _vectors(spark, [(0, [1, 0]), (1, [0, 1]), (2, [1, 0.5])])
    found = ann.search(df, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(found)] == [(1, 2), (2, 1)]
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in df.collect()}
    found = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    hits = 0
    for q in {r["query_id"] for r in found}:
        hits += len({r["vec_id"] for r in found if r["query_id"] == q} & set(_nearest(rows, q, 5)))
    assert hits >= 0.9 * 5 * sum(q % 50 == 0 for q in rows)


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (3, 2), (5, 6)], [(i, i + 1) for i in range(40)]])
def test_components(spark, links):
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    label = {r["node"]: r["label"] for r in found}
    assert all(label[a] == label[b] for a, b in links if a != b)
    parts = {1: 0, 3: 2}.get(len(links), 1) if links else 0
    assert len(set(label.values())) == parts


def test_pipeline_stages(spark, sample, pairs, same):
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, sample, "")
    assert kept.columns == corpus_pipeline.COLUMNS and kept.count() == sample.count()
    firsts = stages["near_duplicates"](spark, kept, "").cache()
    wanted = {d for d, n, c in brute.linked(pairs(kept)) if n == 0 or c == d}
    assert {r["doc_id"] for r in firsts.collect()} == wanted and firsts.count() == len(wanted)
    cut = stages["repeated_passages"](spark, firsts, "").cache()
    texts = [(r[0], r[4].decode("utf-8", "ignore")) for r in brute.without_bytes(pairs(firsts))]
    assert same(pairs(cut), [t for t in texts if t[1]])
    mixed = stages["mix_sources"](spark, cut, "").cache()
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix_sources(cut).where("taken > 0").collect()}
    assert dict(map(tuple, mixed.groupBy("doc_id").count().collect())) == times
    out = stages["tokens"](spark, mixed, "")
    assert same(out.collect(), brute.tokens(pairs(mixed)))


def test_pipeline_of_awkward_and_no_rows(spark, awkward, nothing):
    for docs in (awkward.select(*corpus_pipeline.COLUMNS), nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "").cache()
            docs.count()
        assert "ids_sha256" in docs.columns
