"""Word hashes, and operators on words and labels that once went wrong."""

import os
import weakref

import numpy as np
import pytest

from bazaar.llm import language, mixing, ngram_join, shared, substring_dedup
from bazaar.llm.shared import Words, word_hashes
from tests.llm import brute


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_hashes_tell_words_apart_and_equal_ones_together():
    draw = np.random.default_rng(1)
    words = {bytes(draw.integers(97, 99, draw.integers(1, 40)).astype(np.uint8)) for _ in range(5_000)}
    words |= {thue_morse(n, a, b).encode() for n in (32, 64, 128, 255, 256, 257, 512, 1024) for a, b in ("ab", "ba")}
    words |= {b"x" * n for n in range(1, 300)}
    texts = [b" ".join(sorted(words)), b" ".join(sorted(words, reverse=True))]
    found = Words(texts)
    assert len(found.hashes()) == 2 * len(words) and len(set(found.hashes().tolist())) == len(words)


def test_no_spans():
    assert word_hashes(np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)).tolist() == []


@pytest.fixture
def alike(spark):
    words = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    rows = [(1, words[0]), (2, words[1])]
    rows += [(3, " ".join([words[0]] * 40)), (4, " ".join([words[1]] * 40))]
    rows += [(5, " ".join([f"u{i}" if i else words[0] for i in range(40)])), (6, " ".join([f"u{i}" if i else words[1] for i in range(40)]))]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_words_of_one_pattern_do_not_link(alike, same):
    df, rows = alike
    assert same(ngram_join.link_documents(df).select("doc_id", "n_shingles", "component_id").collect(), brute.linked(rows))


def test_words_of_one_pattern_are_not_removed(alike):
    df, rows = alike
    found = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()}
    assert found[1] == found[2] == 0 and found[5] == found[6] == 39


def test_more_than_a_thousand_languages(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} " * 9, f"l{i:04}") for i in range(1_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.identify_languages(docs).where("lang_pred != 'und'").count() == 1_001


def test_short_texts_lay_out_little_at_once():
    vectors = language._Vectors(language.DIMENSIONS, 11)
    texts = [f"short text {i} {i * 7919 % 1000}".encode() for i in range(700)]
    whole = language.text_vectors(texts, vectors)
    assert whole.shape == (700, language.DIMENSIONS) and np.allclose(whole[650], language.text_vectors(texts[650:651], vectors)[0])
    assert language.text_vectors([], vectors).shape == (0, language.DIMENSIONS)


def test_very_many_sources(spark):
    docs = spark.range(100_001).selectExpr("id AS doc_id", "'one word' AS text", "concat('s', id) AS source")
    found = mixing.mix_sources(docs)
    assert found.count() == 100_001 and found.where("taken > 6").isEmpty()


def test_discarded_tables_leave_nothing_behind(spark):
    kept, gone = (shared.store(spark.range(10), "discard-test") for _ in range(2))
    shared.discard(gone)
    assert kept.count() == 10
    assert not os.path.exists(os.path.dirname(gone.inputFiles()[0].removeprefix("file:")))


def test_memory_is_returned_once_a_step_holds_nothing(monkeypatch):
    held, seen = [], []

    def note():
        seen.append([r() is None for r in held])

    def numbers():
        values = np.zeros(9)
        held.append(weakref.ref(values))
        return values

    def each(batches):
        for _ in batches:
            values = numbers()
            yield len(values)

    monkeypatch.setattr(shared, "_give_back", note)
    assert list(shared.lean_map(each)(iter("ab"))) == [9, 9] and seen == [[True, True]]
    assert shared.lean_group(lambda t: len(numbers()))("x") == 9 and seen[1:] == [[True] * 3]
    assert shared.lean_cogroup(lambda a, b: len(numbers()))("x", "y") == 9 and seen[2:] == [[True] * 4]


@pytest.mark.parametrize("bits", [15, 27])
def test_only_texts_whose_ids_are_marked_travel(spark, monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "MARK_BITS", bits)
    rows = spark.range(-20_000, 40_000).selectExpr("id * 3 AS doc_id", "'t' AS text")
    ids = rows.where("doc_id % 11 = 0").select("doc_id")
    found = {r["doc_id"] for r in ngram_join._marked(rows, ids, ids.count()).collect()}
    wanted = {r["doc_id"] for r in ids.collect()}
    assert found >= wanted and len(found) < (7_000 if bits == 27 else 20_000)
    assert ngram_join._marked(rows, ids.limit(0), 0).isEmpty()
