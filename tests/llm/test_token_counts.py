"""Token counts of prefixes against the tokenizer library, which encodes every prefix anew."""

import random
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bazaar.llm import queries, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = token_counts.TextCounts(PATH)


def tokens(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def agree(text):
    text = unicodedata.normalize("NFC", text)
    assert COUNTER.of(text).tolist() == [tokens(text[:i]) for i in range(len(text) + 1)]


@pytest.mark.parametrize("text", [
    "", " ", "don't we're i'll 'r've ''s !'s", "'re", "'rex 'l'll", "hi<|endoftext|>yo <|startoftext|><|endoftex",
    "<<|endoftext|>é<|endoftext|>", "İx ΑΣ ΑΣΑ ǅ", "w" * 300, "12345 3²½", "漢字😀 é ü " * 5, "\x00\x01 a\x1c\x85b",
    "㐀\U00032472 ՘a'd", "ab" * 90, "  \r\n\t two  ", "á é" * 3,
])
def test_every_prefix(text):
    agree(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aehilnorst'dmv .<|>1é\n"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(text):
    agree(text)


def test_given_texts(sample, pairs):
    for _, text in random.Random(2).sample(pairs(sample), 12):
        agree((text or "")[:300])


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(token_counts, "_PART_CHARS", 50)
    draw = random.Random(6)
    agree(" ".join("".join(draw.choices("abcdeé'", k=draw.randint(1, 90))) for _ in range(12)))


def test_forgetting_changes_nothing(monkeypatch):
    for name in ("_MOST_WORDS", "_MOST_PAIRS", "_MOST_STATES"):
        monkeypatch.setattr(token_counts, name, 3)
    for text in ("some words and others, some more", "others and words, more or less some"):
        agree(text)


def test_documents(docs, pairs, same):
    found = token_counts.token_counts(docs, PATH, limit=40).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    wanted = [(i, len((t or "").encode()), tokens(t or ""), tokens(t or "") > 40) for i, t in pairs(docs)]
    assert same(found.collect(), wanted)


def test_answers_from_the_table(awkward, pairs, same):
    texts = [(i, unicodedata.normalize("NFC", t or "")) for i, t in pairs(awkward) if len(t or "") < 2000]
    short = awkward.where(F.coalesce(F.length("text"), F.lit(0)) < 2000)
    counted = token_counts.prefix_counts(short, PATH)
    at = token_counts.tokens_at(counted, [0, 7, 10_000]).collect()
    assert same(at, [(i, p, tokens(t[:p])) for i, t in texts for p in (0, 7, 10_000)])
    kept = token_counts.cut_to_budget(counted, 5).collect()
    assert same(kept, [(i, max(n for n in range(len(t) + 1) if tokens(t[:n]) <= 5)) for i, t in texts])
    direct = token_counts.token_counts(short, PATH, limit=5).select("doc_id", "kept_chars").collect()
    assert same(kept, direct)


def test_nothing(nothing):
    assert token_counts.token_counts(nothing, PATH).count() == 0
    assert token_counts.cut_to_budget(token_counts.prefix_counts(nothing, PATH), 3).count() == 0


def test_query(spark, sample, pairs, same):
    found = queries.op12_token_counts(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens", "over_limit")
    assert same(found.collect(), [(i, tokens(t or ""), tokens(t or "") > 2048) for i, t in pairs(sample)])
