"""Fill-in-middle against a plain version; chunks and their summaries."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from bazaar.llm import fim, queries
from tests.llm import brute
from verification.compare import database, difference

SF = "/root/testdata/sf0.001"


def plain(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rate": 40, "spm_rate": 10}])
def test_documents(docs, pairs, same, options):
    found = fim.restore(fim.fill_in_middle(docs, **options))
    shown = found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert same(shown.collect(), [plain(*row, **options) for row in pairs(docs)])
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("restored"))
    assert same(found.select("doc_id", "restored").collect(), wanted.collect())


def test_awkward_texts(spark, same):
    texts = ["\n", "\n\n\n", "a\n", "\na", "a\r\nb\rc", "<P>", "x<S", "<", "P>", "<p>\n<S>", "é\n漢\n😀", "a\n" * 30_000,
             "<\n" * 4_000 + "<M>", "x" * 9_000 + "<S>", "x" * 8_191 + "<S>" + "y" * 9_000, "z\n" + "w" * 200_000 + "\nz"]
    rows = [(i, t) for t in texts for i in range(12)]
    found = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert same(found.collect(), [plain(*r) for r in rows])


def test_nothing(nothing):
    assert fim.restore(fim.fill_in_middle(nothing)).count() == 0


def test_chunks_tile_and_come_back():
    draw = random.Random(3)
    shared = bytes(draw.choices(range(97, 123), k=60_000))
    ends = {}
    for before in (b"", b"some other text ", bytes(draw.choices(range(97, 123), k=5_000))):
        data = before + shared
        found = fim.chunk_ends(data)
        assert found[-1] == len(data) and all(0 < b - a <= fim.MOST_BYTES for a, b in zip([0, *found], found))
        ends[before] = {e - len(before) for e in found if e > len(before) + fim.MOST_BYTES}
    # Past the first chunks the borders lie at the same bytes of the shared text.
    first, *others = ends.values()
    assert len(first) > 20 and all(len(first & o) > 0.9 * len(first) for o in others)


def test_summaries_are_found_by_content_and_forgotten():
    known = fim.Summaries(limit=10)
    one = known[b"a\nb"]
    assert known[b"a\nb"] is one and one.breaks.tolist() == [2] and one.chars == 3
    known[b"longer than that"], known[b"x"]
    assert list(known) == [b"x"]


def test_marker_across_a_border():
    known = fim.Summaries()
    for at in range(1, 4):
        text = b"a" * (16 - at) + b"<S>" + b"b" * 30
        assert fim.Outline(text, known, most=16).marked
        assert not fim.Outline(text.replace(b"<S>", b"<s>"), known, most=16).marked


def test_query_against_sql(spark):
    found = queries.op13_fill_in_middle(spark, SF)
    assert difference(found, database(SF), queries.oracle()["op13_fill_in_middle"]) is None


def test_digests(spark, pairs, sample):
    found = {r["doc_id"]: r for r in queries.op13_fill_in_middle(spark, SF).collect()}
    for doc_id, text in pairs(sample):
        assert found[doc_id]["restored_sha256"] == brute.sha(text or "")
