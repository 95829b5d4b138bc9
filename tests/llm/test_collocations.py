"""Collocations against a plain count of all phrases; the trie against a Counter."""

import collections
import random
import re

import numpy as np
import pytest

from bazaar.llm import collocations as co
from bazaar.llm import queries
from bazaar.llm.hat_trie import Container, HatTrie, Packing, in_order, merged
from tests.llm import brute
from verification.compare import database, difference

SF = "/root/testdata/sf0.001"
SMALL = co.Sizes(block=60, step=25, burst=8, hold=20, part=15, most_parts=3, bucket_bytes=150, bucket_pairs=40)


def plain(rows, min_count, longest=5, absorb=100, top=2000):
    """Rows are (lang, text)."""
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= min_count}
    inside = collections.Counter()
    for (lang, p), v in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                inside[lang, p[i : i + size]] = max(inside[lang, p[i : i + size]], v)
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * inside[lang, p] >= absorb * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
        for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])
    ]


def langs(df):
    return [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]


@pytest.mark.parametrize("sizes", [None, co.Sizes(block=5_000, step=700, burst=50, hold=2_000, part=900, most_parts=4)])
def test_documents(docs, same, sizes):
    found = co.collocations(docs, min_count=6, top=150, sizes=sizes)
    assert same(found.collect(), plain(langs(docs), 6, top=150))


@pytest.mark.parametrize("sizes", [None, SMALL])
@pytest.mark.parametrize("options", [{}, {"absorb": 60}, {"longest": 2}, {"longest": 3, "top": 4}])
def test_awkward_texts(spark, same, sizes, options):
    draw = random.Random(8)
    texts = [" ".join(draw.choices("abcA", k=draw.randint(0, 30))) + draw.choice(".,;:!?\n\r\x0b\x0c \t") for _ in range(60)]
    texts += ["a a a a a a a a", "a\tb  c\t\td", "x\x85y x\x85y", "é ü é ü É ü", "", None, "...", "a.b.c a b", "漢 字 漢 字", "lone"]
    texts += ["of the of the of the " * 200, "one two three four five six " * 40, "one two three four five"]
    rows = [(draw.choice(["en", "de", None, "und", ""]), t) for t in texts]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = co.collocations(df, min_count=3, sizes=sizes, **options)
    assert same(found.collect(), plain(rows, 3, **options))


def test_one_hot_prefix_is_dealt_out(spark, same):
    draw = random.Random(9)
    rows = [("en", "hot pair " + " ".join(draw.choices("abcdef", k=3))) for _ in range(900)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found = co.collocations(df, min_count=5, sizes=co.Sizes(block=300, step=100, burst=20, hold=90, part=40, most_parts=8))
    assert same(found.collect(), plain(rows, 5))


def test_nothing(nothing, spark):
    assert co.collocations(nothing).count() == 0
    assert co.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_large_counts_score_exactly(spark):
    ids = [(1, "en", "x", 3 * 10**12 + 1), (2, "en", "y", 2 * 10**12 + 7)]
    words = spark.createDataFrame(ids, "id long, lang string, word string, f long")
    phrases = spark.createDataFrame([([1, 2], 10**12 + 3)], "ids array<long>, f long")
    totals = spark.createDataFrame([("en", 9 * 10**15 + 11)], "lang string, n long")
    (row,) = co._scored(phrases, words, totals).collect()
    assert row["score"] == 1000 * (10**12 + 3) * (9 * 10**15 + 11) // ((3 * 10**12 + 1) * (2 * 10**12 + 7))


@pytest.mark.parametrize("bits", [3, 13, 21, 30, 64])
def test_packing_keeps_order(bits):
    draw = np.random.default_rng(bits)
    words = [draw.integers(0, 1 << min(bits, 62), 500, dtype=np.uint64) for _ in range(5)]
    packing = Packing(bits, 5)
    keys = packing.pack(words)
    assert all((a == b).all() for a, b in zip(packing.unpack(keys), words))
    rows = np.stack(words).T
    assert rows[in_order(keys)].tolist() == sorted(rows.tolist())


def test_container_counts():
    draw = np.random.default_rng(5)
    table, wanted = Container(2, slots=4), collections.Counter()
    for _ in range(20):
        keys = draw.integers(0, 30, (400, 2)).astype(np.uint64)
        counts = draw.integers(1, 5, 400)
        table.add(keys, counts)
        for k, c in zip(keys.tolist(), counts.tolist()):
            wanted[tuple(k)] += c
    keys, counts = table.entries()
    assert table.size == len(wanted) and dict(zip(map(tuple, keys.tolist()), counts.tolist())) == dict(wanted)


@pytest.mark.parametrize("words", [2, 40])
def test_trie_bursts_and_spills(words):
    draw = np.random.default_rng(words)
    packing = Packing(12, 5)
    trie, wanted, runs, most = HatTrie(packing, burst=30, hold=400), collections.Counter(), [], 0
    for _ in range(40):
        keys = packing.pack([draw.integers(1, words + 1, 200) for _ in range(5)])
        runs += list(trie.add(keys, np.ones(200, dtype=np.int64)))
        wanted.update(map(tuple, keys.tolist()))
        assert trie.size <= 400
        most = max(most, len(trie.leaves))
        assert (np.diff(trie.low.astype(object)) > 0).all()
        for low, high, leaf in zip(trie.low, [*trie.low[1:], 2**64 - 1], trie.leaves, strict=True):
            first = leaf.entries()[0][:, 0]
            assert ((first >= low) & (first <= high)).all()
    runs += list(trie.runs())
    assert most > 1 and (words == 2 or len(runs) > 1)
    for keys, _ in runs:  # each run is sorted, and lies below one child of the root or is the rest
        assert keys.tolist() == sorted(keys.tolist())
    keys, counts = merged(*map(np.concatenate, zip(*runs)))
    assert dict(zip(map(tuple, keys.tolist()), counts.tolist())) == dict(wanted)


def test_query_against_sql(spark):
    found = queries.op11_collocations(spark, SF)
    assert difference(found, database(SF), queries.oracle()["op11_collocations"]) is None


def test_phrases_and_words_are_not_broadcast(spark):
    """Their files are a small part of what they take in memory, so no size of files may decide it."""
    ids = [(i, i + 1) for i in range(1, 40)] + [(i, i + 1, i + 2) for i in range(1, 39)]
    phrases = spark.createDataFrame([(list(p), 100 + len(p)) for p in ids], "ids array<long>, f long")
    words = spark.createDataFrame([(i, "en", f"w{i}", 200) for i in range(1, 42)], "id long, lang string, word string, f long")
    totals = spark.createDataFrame([("en", 8_200)], "lang string, n long")
    left = co._outermost(co._scored(phrases, words, totals), 100)
    assert left.count() == len(left.collect()) > 0
    plan = left._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) >= 4 and not [line for line in joins if "Broadcast" in line and "[lang#" not in line]
