"""Operators on documents against their plain versions, on awkward and on given rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bazaar.llm import bpe, fingerprint, language, licenses, ngram_join, substring_dedup, suffix_dedup
from tests.llm import brute

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_ngram_join(docs, pairs, same):
    found = ngram_join.link_documents(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert same(found, brute.linked(pairs(docs)))


def test_ngram_join_keeps_one_of_each_component(awkward, pairs):
    kept = ngram_join.keep_first(awkward)
    assert kept.columns == awkward.columns
    rows, wanted = brute.linked(pairs(awkward)), []
    for doc_id, n, component in rows:
        if n == 0 or component == doc_id:
            wanted.append(doc_id)
    found = [r["doc_id"] for r in kept.select("doc_id").collect()]
    # Rows 9 and 9 are copies of one id: one of them stays.
    assert sorted(found, key=str) == sorted(wanted[:wanted.index(9)] + wanted[wanted.index(9) + 1 :], key=str)


def test_near_copies_cost_no_pairs(spark, same):
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:40], f"own{i}", *words[41:]])) for i in range(300)]
    found = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert same(found.collect(), brute.linked(rows))


def test_bpe(docs, pairs, same):
    found = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN)
    assert same(found.collect(), brute.tokens(pairs(docs)))


def test_bpe_ids_decode_to_the_text(awkward):
    coded = bpe.encode(awkward, PATH, public_tokenizers.PATTERN, buckets=3)
    found = bpe.decode(coded, PATH).select("doc_id", F.col("bytes").cast("string").alias("text"))
    wanted = awkward.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()


@pytest.mark.parametrize("word", [b"a", b"hello", b"hellohello" * 9, bytes(range(256)), "é漢😀".encode() * 30])
def test_bpe_both_ways_to_merge_agree(word):
    ranks = bpe.load_ranks(PATH)
    assert bpe.encode_word(word, ranks) == bpe._encode_long(word, ranks)


def test_suffix_dedup(docs, pairs, same):
    found = suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").alias("n_spans"), "kept"
    )
    got = [(*r[:4], bytes(r["kept"])) for r in found.collect()]
    assert same(got, brute.without_bytes(pairs(docs)))


def test_suffix_dedup_in_small_blocks_and_buckets(spark, same):
    rows = [(i, "abc" * i + "0123456789" * (i % 7) + "xyz" * (40 - i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = suffix_dedup.remove_repeats(docs, bucket_bytes=200, carry=["text"])
    assert found.columns[-1] == "text"
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in found.collect()]
    assert same(got, brute.without_bytes(rows))


def test_substring_dedup(docs, pairs, same):
    found = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept")
    assert same(found.collect(), brute.without_words(pairs(docs)))


def test_substring_dedup_splits_frequent_prefixes(sample, pairs, same):
    found = substring_dedup.remove_repeats(sample, group_suffixes=500).select("doc_id", "n_words", "n_removed", "kept")
    assert same(found.collect(), brute.without_words(pairs(sample)))


def test_substring_spans_cover_what_is_removed(sample):
    found = substring_dedup.remove_repeats(sample)
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    assert found.where(length != F.col("n_removed")).isEmpty()


def test_license_phrases(docs, pairs, same):
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    found = licenses.scan_licenses(docs).select("doc_id", *columns)
    wanted = [(d, *brute.license_places(t, licenses.PHRASES)) for d, t in pairs(docs)]
    assert same(found.collect(), wanted)


def test_license_templates(spark):
    texts = {
        1: "Permitted. Licensed under the terms of the GNU General Public License, version 3.",
        2: "licensed under the GNU General Public License",
        3: "Copyright (c) 2020 Some Body Inc. All rights reserved.",
        4: "licensed under the gnu general private license",
        5: "Licensed under a 3 clause BSD license; licensed under the bsd license",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert [found[i]["labels"] for i in range(1, 6)] == ["gpl", "gpl", "proprietary", "", "bsd"]
    assert found[4]["score"] == 0 and 0 < found[2]["score"] < found[1]["score"] <= 1
    assert found[3]["spans"][0]["first"] == 0


@pytest.mark.parametrize("text", ["<<var;0-3>> a b", "a <<optional>> b", "a <<var;1-2>> b c", "<<optional>>a<<end>>"])
def test_templates_that_cannot_be_searched_are_refused(text):
    with pytest.raises(ValueError):
        licenses.scanner({"x": [text]}, {})


def test_fingerprints(docs, pairs, same):
    found = fingerprint.fingerprint_documents(docs, slice_bytes=50_000)
    if docs.where("doc_id is null").isEmpty():
        wanted = brute.edited(sorted(pairs(docs)))
        assert same(found.select("doc_id", "n_chars", "edited_sha256").collect(), wanted)
    else:
        assert found.count() == docs.count()
    rows = found.collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    texts = dict(pairs(docs))
    of_text: dict = {}
    for r in rows:
        if r["doc_id"] is not None:
            assert of_text.setdefault(texts[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]


def test_phrases_are_those_of_the_plain_parse():
    for data in (b"", b"a", b"aaaaaaa", b"abababab", b"the cat sat on the mat, the cat sat"):
        parsed = fingerprint.Phrases()
        parsed.parse(data[:5])
        other = parsed.branch()
        other.parse(data[5:])
        begin, end = other.spans()
        assert {data[b:e] for b, e in zip(begin, end, strict=True)} == brute.phrases_of(data)


def test_edited_texts_are_nearer_than_others(sample):
    found = fingerprint.fingerprint_documents(sample).where("n_chars > 500")
    row = found.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert row[0] > row[1] + 0.15


def test_languages_of_documents_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify_languages(docs, carry=["lang"]).where("held_out")
    assert found.where("lang <=> lang_pred").count() >= 0.97 * found.count()


def test_languages_of_awkward_texts(awkward):
    found = {r["doc_id"]: r for r in language.identify_languages(awkward).collect()}
    assert language.identify_languages(awkward).count() == awkward.count()
    for doc_id in (3, 4, 5, 13):
        assert found[doc_id]["lang_pred"] == "und" and found[doc_id]["score"] == 0
    assert found[0]["lang_pred"] != "und"


def test_empty_tables(nothing):
    runs = [
        ngram_join.link_documents, ngram_join.keep_first, suffix_dedup.remove_repeats,
        substring_dedup.remove_repeats, licenses.scan_licenses, language.identify_languages,
        fingerprint.fingerprint_documents, lambda d: bpe.round_trip(d, PATH, public_tokenizers.PATTERN),
    ]
    assert [r(nothing).count() for r in runs] == [0] * len(runs)
