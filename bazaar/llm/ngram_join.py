"""N-gram Jaccard self-join of documents, as a grouped prefix join.

A document is the set of its word shingles.  Shingles are ordered from rare to
frequent; two similar sets share a shingle among the first few of each, their
prefixes.  Documents of one size and one prefix form a group, and groups that
share a prefix shingle are candidates if their sizes and the shingle's places
allow the similarity.  Candidates are expanded to members and verified.

What is asked for are components, so a pair that is already known to be in one
component needs no check.  First every shingle's groups are checked against the
least of them, then components against each other by representatives.  What is
left, pairs of groups in different components that share a prefix shingle, is
checked in full.  A large group of near copies thus costs a
check per member, not per pair, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.llm.blocks import (
    ENTRIES, NO_ID, add_up, answer, bits_by_kind, bucket_edges, entries, gather_bits, held_twice, least_by_key,
)
from bazaar.llm.components import components
from bazaar.llm.shared import (
    PIECE_BYTES, Words, discard, lean_cogroup, lean_map, mix, pack, pieces, prefix_sums, slices_for, span_hash, squeeze,
    store, store_bucketed, unsqueeze, window_hash,
)

SHINGLE = 5
# Sets A and B are similar if 100 |A and B| >= SIMILARITY |A or B|.
SIMILARITY = 80
# Frequencies are counted in this many slots of shingle hashes: a table of fixed
# size.  It only sets the order of shingles; any order gives the same result.
SLOT_BITS = 20
BUCKET_KEYS = 500_000
# A block has about this many prefix shingles: the more, the fewer and the better packed are its questions.
BLOCK_KEYS = 500_000
# Wanted ids are marked in a table of up to this many bits, 16 MB.  Where it is full, more texts travel.
MARK_BITS = 27
_SIZE_STEP = 1.25

PROFILES = "block string, doc_ids array<long>, sizes array<long>, nodes array<long>, groups array<long>, prefixes binary"


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the distinct hashes of its shingles, sorted."""
    words = Words(texts, lower=True)
    sums = prefix_sums(words.hashes())
    hashes = window_hash(sums, shingle)
    out = []
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if end - begin >= shingle:
            out.append(np.unique(hashes[begin : end - shingle + 1]))
        elif end > begin:
            out.append(span_hash(sums, np.array([begin]), np.array([end])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _needed(n: int, similarity: int) -> int:
    """How many shingles of a set of ``n`` any similar set must share at least."""
    return -(-similarity * n // 100)


def _prefix_size(n: int, similarity: int) -> int:
    return n - _needed(n, similarity) + 1


def _signature(values: np.ndarray) -> int:
    """A signed 64-bit number for a set or sequence of hashes."""
    total = np.add.reduce(mix(values)) if len(values) else np.uint64(0)
    return int(mix(np.array([total], dtype=np.uint64) + np.uint64(len(values) * 0x9E3779B1))[0].astype(np.int64))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _frequencies(docs: DataFrame, shingle: int) -> np.ndarray:
    """In how many documents shingles of each slot are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, dtype=np.int64)
        for _, texts in pieces(batches):
            counts += np.bincount(_slots(np.concatenate(shingle_sets(texts, shingle))), minlength=len(counts))
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()]), pa.array([0]), pa.array([pack(counts)], pa.binary())],
            names=["part", "name", "counts"],
        )

    counted = add_up(docs.select("text").mapInArrow(lean_map(run), "part long, name long, counts binary"))
    return counted.get(0, np.zeros(1 << SLOT_BITS, dtype=np.int64))


def _profiles(docs: DataFrame, shingle: int, similarity: int, counts: np.ndarray) -> DataFrame:
    """Blocks of documents: set sizes, signatures of sets (nodes) and of groups, and prefixes."""
    table = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, task, made = table.value, TaskContext.get().partitionId(), 0
        doc_ids, sizes, nodes, groups, prefixes, keys = [], [], [], [], [], 0

        def block() -> pa.RecordBatch:
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task}-{made}"]), pa.array([doc_ids], longs), pa.array([sizes], longs),
                    pa.array([nodes], longs), pa.array([groups], longs),
                    pa.array([np.concatenate(prefixes).tobytes()], pa.binary()),
                ],
                names=[c.split()[0] for c in PROFILES.split(", ")],
            )

        for rows, texts in pieces(batches):
            doc_ids += rows.column("doc_id").to_pylist()
            for values in shingle_sets(texts, shingle):
                n = len(values)
                rare_first = np.argsort(frequency[_slots(values)], kind="stable")
                prefix = values[rare_first[: _prefix_size(n, similarity) if n else 0]]
                place = np.arange(len(prefix), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                sizes.append(n)
                nodes.append(_signature(values))
                groups.append(_signature(np.append(prefix + mix(place), np.uint64(n))))
                prefixes.append(prefix)
                keys += len(prefix)
            if keys >= BLOCK_KEYS:
                yield block()
                doc_ids, sizes, nodes, groups, prefixes, keys = [], [], [], [], [], 0
                made += 1
        if doc_ids:
            yield block()

    return docs.select(_order().alias("doc_id"), "text").mapInArrow(lean_map(run), PROFILES)


def _prefixes(sizes: list[int], data: bytes, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix shingles of a block's documents and the number of each one's document."""
    lengths = [_prefix_size(n, similarity) if n else 0 for n in sizes]
    return np.frombuffer(data, dtype=np.uint64), np.repeat(np.arange(len(sizes)), lengths)


def _asked_bits(total: int) -> int:
    """By how many leading bits blocks ask about ``total`` shingles.

    Shingles that share them with another become rows in vain: one in 4,096 at most.
    """
    return min(64, total.bit_length() + 12)


def _held_shingles(profiles: DataFrame, similarity: int, parts: int) -> DataFrame:
    """(shingle, group, n, place, doc_id) for prefix shingles that several documents have, dealt by shingle.

    ``doc_id`` is the least of the group.  First blocks learn which of their
    shingles stand in another document at all; only those become rows, one for
    a block's documents of one group.
    """

    def asked(shingles: np.ndarray) -> np.ndarray:
        return shingles >> np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("block", "sizes", "prefixes")]
            for block, sizes, data in zip(*columns, strict=True):
                shingles, _ = _prefixes(sizes, data, similarity)
                keys, times = np.unique(asked(shingles), return_counts=True)
                edges = bucket_edges(keys, buckets, bits)
                sent = entries(0, block, edges, keys, np.minimum(times, 2).astype(np.uint8))
                if sent is not None:
                    yield sent

    def unfold(block: pa.Table, answers: pa.Table) -> pa.Table:
        known, found = bits_by_kind(answers).get(0, []), []
        columns = [block.column(c).to_pylist() for c in ("doc_ids", "sizes", "groups", "prefixes")]
        for doc_ids, sizes, groups, data in zip(*columns, strict=True):
            shingles, doc = _prefixes(sizes, data, similarity)
            keys, number = np.unique(asked(shingles), return_inverse=True)
            held = gather_bits(known, bucket_edges(keys, buckets, bits))[number]
            first = np.searchsorted(doc, doc)  # where the document's prefix begins
            place = np.arange(len(doc)) - first
            group, ids = np.array(groups, dtype=np.int64), np.array(doc_ids, dtype=np.int64)
            names, least = least_by_key(group, ids)
            _, one = np.unique(group, return_index=True)
            held &= np.isin(doc, one)
            doc = doc[held]
            found.append(
                pa.table(
                    [
                        pa.array(shingles[held].view(np.int64)), pa.array(group[doc]),
                        pa.array(np.array(sizes, dtype=np.int64)[doc]), pa.array(place[held]),
                        pa.array(least[np.searchsorted(names, group[doc])]),
                    ],
                    names=["shingle", "group", "n", "place", "doc_id"],
                )
            )
        return pa.concat_tables(found)

    total = (profiles.agg(F.sum(F.expr("octet_length(prefixes)"))).first()[0] or 0) // 8
    buckets, bits = slices_for(total, BUCKET_KEYS), _asked_bits(total)
    sent = profiles.select("block", "sizes", "prefixes").mapInArrow(lean_map(send), ENTRIES)
    answers = answer(sent, {0: (np.uint8, np.uint8, held_twice)})
    rows = profiles.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lean_cogroup(unfold), "shingle long, group long, n long, place long, doc_id long"
    )
    dealt = rows.repartition(parts, "shingle")
    return dealt.groupBy("shingle", "group", "n", "place").agg(F.min("doc_id").alias("doc_id"))


def _fitting_shingles(held: DataFrame, similarity: int) -> DataFrame:
    """Rows of ``held`` that can make a candidate with another group of their shingle.

    Copies are one group: a shingle that only they have makes no candidates.  Neither
    does a place too late for a partner of any size that the shingle's groups have.
    """
    of_shingle = Window.partitionBy("shingle")
    several = held.select(
        "*", F.count(F.lit(1)).over(of_shingle).alias("_groups"), F.min("n").over(of_shingle).alias("_least"),
        F.max("n").over(of_shingle).alias("_most"), F.min("place").over(of_shingle).alias("_first"),
    ).where("_groups > 1")
    n, s = F.col("n"), similarity
    smallest = F.greatest(F.col("_least"), F.ceil(n * s / 100))
    largest = F.least(F.col("_most"), F.floor(n * 100 / s))
    own = F.col("place") * (100 + s) <= n * 100 - smallest * s
    others = F.col("_first") * (100 + s) <= largest * 100 - n * s
    fitting = several.where((smallest <= F.col("_most")) & own & others)
    return fitting.select("shingle", "group", "n", "place", "doc_id")


class _Join:
    """The steps of the join; tables between them are stored, those of shingles bucketed by shingle."""

    def __init__(self, docs: DataFrame, shingle: int, similarity: int):
        self.docs, self.shingle, self.similarity = docs, shingle, similarity
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counts = _frequencies(docs, shingle)
        # Bucketed as they are made, a file for each block: answers travel to them.
        profiles = store_bucketed(_profiles(docs, shingle, similarity, counts), "join-profiles", "block", self.parts)
        rows = profiles.select(F.explode(F.arrays_zip("doc_ids", "sizes", "nodes", "groups")).alias("r"))
        self.rows = store(
            rows.select(
                F.col("r.doc_ids").alias("doc_id"), F.col("r.sizes").alias("n"),
                F.col("r.nodes").alias("node"), F.col("r.groups").alias("group"),
            ),
            "join-rows",
        )
        # A node is a set of shingles; documents with equal sets are one node.
        least = F.min(F.col("doc_id")).alias("doc_id")
        self.members = store(
            self.rows.where("n > 0").groupBy("node", "group", "n").agg(least), "join-members"
        )
        held = _held_shingles(profiles, similarity, self.parts)
        self.shared = store_bucketed(_fitting_shingles(held, similarity), "join-shingles", "shingle", self.parts)
        discard(profiles)

    def allowed(self, a: str, b: str) -> Column:
        """Can two groups with a shingle in common be similar, by sizes and the shingle's places?

        Similar sets of ``n`` and ``m`` share a number of shingles that follows
        from their sizes, ``least``.  So they share one among the first n - least + 1
        and m - least + 1, and no more than the places of a shared one leave room for.
        """
        n, m, p, q = (F.col(c) for c in (f"{a}n", f"{b}n", f"{a}p", f"{b}p"))
        s = self.similarity
        sizes = F.least(n, m) * 100 >= F.greatest(n, m) * s
        least = F.ceil((n + m) * s / (100 + s))
        early = (p <= n - least) & (q <= m - least)
        room = F.least(p, q) + F.least(n - p, m - q) >= least
        return sizes & early & room

    def least_groups(self) -> DataFrame:
        """Candidate groups: each shingle's groups of about one size with the least of them."""
        step = F.floor(F.log(F.col("n")) / F.log(F.lit(_SIZE_STEP)))
        of_size = Window.partitionBy("shingle", "step")
        least = F.min(F.struct("doc_id", "group", "n", "place")).over(of_size)
        found = self.shared.withColumn("step", step).withColumn("m", least)
        sized = found.select(*_named("", "b"), *_named("m.", "a")).where("a <> b")
        across = sized.where(self.allowed("a", "b")).select("a", "b")
        within = self.members.select(F.col("group").alias("a"), F.col("group").alias("b"))
        return across.unionByName(within).distinct()

    def first_members(self, groups: DataFrame) -> DataFrame:
        """Expand candidate groups: the least member of ``a`` with all members of ``b``."""
        head = self.members.groupBy(F.col("group").alias("a")).agg(F.min(F.struct("doc_id", "node")).alias("h"))
        pairs = groups.join(head, "a").join(
            self.members.select(F.col("group").alias("b"), F.col("node").alias("other")), "b"
        )
        return _ordered(pairs.select(F.col("h.node").alias("a"), F.col("other").alias("b")))

    def labelled(self, links: DataFrame) -> DataFrame:
        """Members with the label of their component so far."""
        labels = components(links)
        return store(
            self.members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")),
            "join-labelled",
        )

    def sides(self, labelled: DataFrame) -> DataFrame:
        """The component of each group, or the group itself if its members are in several: it is torn."""
        torn = F.min("label") != F.max("label")
        side = F.when(torn, F.col("group")).otherwise(F.min("label"))
        return labelled.groupBy("group").agg(side.alias("side"), torn.alias("torn"))

    def open_groups(self, labelled: DataFrame) -> DataFrame:
        """(shingle, group, n, place, side) of shingles that groups of several sides share.

        Components only grow, so a shingle whose groups are all of one side stays
        so: what is found here is all that the next round has to look at.
        """
        placed = self.shared.join(self.sides(labelled).select("group", "side"), "group")
        of_shingle = Window.partitionBy("shingle")
        several = F.min("side").over(of_shingle) != F.max("side").over(of_shingle)
        open_ = placed.repartition(self.parts, "shingle").withColumn("_several", several).where("_several")
        found = store_bucketed(open_.drop("_several"), "join-open", "shingle", self.parts)
        discard(self.shared)
        self.shared = found.drop("side")
        return found

    def _may_meet(self, a: str, b: str) -> Column:
        """Can any group of side ``a`` have a shingle early enough for one of side ``b``?

        Sizes are known by their least and most, places by the first: for sides of
        one group, as most are, this is exact.
        """
        s = self.similarity
        n, m = F.col(f"{a}_most"), F.col(f"{b}_least")
        return F.col(f"{a}_first") * (100 + s) <= n * 100 - m * s

    def representatives(self, open_: DataFrame) -> DataFrame:
        """Candidate groups: one group of each component at a shingle with one of the least component.

        Which one differs from shingle to shingle, so links between components
        have many chances to be met.
        """
        drawn = F.struct(F.xxhash64("shingle", "group").alias("draw"), "group", "n", "place")
        one = open_.groupBy("shingle", "side").agg(F.min(drawn).alias("g"))
        least = one.groupBy("shingle").agg(F.min(F.struct("side", "g")).alias("m")).select(
            "shingle", F.col("m.side").alias("sa"), *_named("m.g.", "a")
        )
        met = one.select("shingle", "side", *_named("g.", "b")).join(least, "shingle").where("side <> sa")
        return met.where(self.allowed("a", "b")).select("a", "b").distinct()

    def all_groups(self, open_: DataFrame, labelled: DataFrame) -> DataFrame:
        """All candidate groups of different components that share a prefix shingle."""
        sides = open_.groupBy("shingle", "side").agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.min("place").alias("first")
        )
        x = sides.select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("side", "least", "most", "first")])
        y = sides.select("shingle", *[F.col(c).alias(f"y_{c}") for c in ("side", "least", "most", "first")])
        both = x.join(y, "shingle").where("x_side < y_side").where(
            self._may_meet("x", "y") & self._may_meet("y", "x")
        ).select("shingle", F.col("x_side").alias("sa"), F.col("y_side").alias("sb"))

        a = open_.select("shingle", F.col("side").alias("sa"), *_named("", "a"))
        b = open_.select("shingle", F.col("side").alias("sb"), *_named("", "b"))
        met = both.join(a, ["shingle", "sa"]).join(b, ["shingle", "sb"])
        across = met.where(self.allowed("a", "b")).select("a", "b")
        torn = self.sides(labelled).where("torn").select(F.col("group").alias("a"), F.col("group").alias("b"))
        return across.unionByName(torn).distinct()

    def all_members(self, groups: DataFrame, labelled: DataFrame) -> DataFrame:
        """Expand candidate groups: all pairs of members of different components."""
        a = labelled.select(F.col("group").alias("a"), F.col("node").alias("x"), F.col("label").alias("lx"))
        b = labelled.select(F.col("group").alias("b"), F.col("node").alias("y"), F.col("label").alias("ly"))
        pairs = groups.join(a, "a").join(b, "b").where("lx <> ly")
        return _ordered(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))

    def fetch_texts(self, pairs: DataFrame) -> DataFrame:
        """(node, text) for all nodes in ``pairs``, and few others; texts are compressed.

        Texts stay where they are until pairs meet them, and take half the room of
        their shingles, which are worked out again there.
        """
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, texts in pieces(batches):
                nodes = [_signature(v) for v in shingle_sets(texts, shingle)]
                packed = [squeeze(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], names=["node", "text"]
                )

        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        needed = store(self.members.join(nodes, "node").select("doc_id"), "join-needed")
        likely = _marked(self.docs.select(_order().alias("doc_id"), "text"), needed, needed.count())
        return store(likely.select("text").mapInArrow(lean_map(run), "node long, text binary"), "join-texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are similar, stored: exact sizes of intersections decide."""
        shingle, similarity = self.shingle, self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for a, b in _pair_sets(batch, shingle):
                    if len(a) > len(b):
                        a, b = b, a
                    at = np.searchsorted(b, a)
                    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                    keep.append(100 * shared >= similarity * (len(a) + len(b) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        texts = self.fetch_texts(pairs)
        # Copies without an id of their own come several times.
        once = texts.dropDuplicates(["node"])

        def of(side: str, name: str) -> DataFrame:
            return once.select(F.col("node").alias(side), F.col("text").alias(name))

        met = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b")
        links = store(met.mapInArrow(lean_map(run), "a long, b long"), "join-links")
        discard(texts)
        return links


def _pair_sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two sets of each pair; pairs whose texts have some bytes together are taken apart at once."""
    columns = [batch.column(c).to_pylist() for c in ("a", "x", "b", "y")]
    pairs: list[tuple[int, int]] = []
    texts: dict[int, bytes] = {}
    size = 0
    for i, (a, x, b, y) in enumerate(zip(*columns, strict=True)):
        for node, packed in ((a, x), (b, y)):
            if node not in texts:
                texts[node] = unsqueeze(packed)
                size += len(texts[node])
        pairs.append((a, b))
        if size >= PIECE_BYTES or i + 1 == len(batch):
            sets = dict(zip(texts, shingle_sets(list(texts.values()), shingle), strict=True))
            yield from ((sets[p], sets[q]) for p, q in pairs)
            pairs, texts, size = [], {}, 0


def _marked(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``rows`` whose hashed ``doc_id`` is that of one of the ``n`` ids at most; few others pass.

    Marks are bits of a table that every task gets, in strips of 2^15.
    """
    bits = min(MARK_BITS, max(15, (64 * n).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    strip, place = F.floor(slot / (1 << 15)).alias("strip"), slot % (1 << 15)
    marks = ids.select(strip, place.alias("place")).groupBy("strip").agg(F.bitmap_construct_agg("place").alias("marks"))
    placed = rows.withColumns({"strip": strip, "place": place}).join(marks.hint("broadcast"), "strip")
    octet = F.expr("CAST(conv(hex(substring(marks, CAST(place DIV 8 + 1 AS INT), 1)), 16, 10) AS BIGINT)")
    return placed.where(F.getbit(octet, F.col("place") % 8) == 1).select(*rows.columns)


def _named(prefix: str, name: str) -> list[Column]:
    """Group, size and place of a shingle under the names of one side of a pair."""
    columns = {"group": name, "n": f"{name}n", "place": f"{name}p"}
    return [F.col(f"{prefix}{c}").alias(to) for c, to in columns.items()]


def _order() -> Column:
    """Ids to tell and compare documents by; those without an id come last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _ordered(pairs: DataFrame) -> DataFrame:
    least, most = F.least("a", "b"), F.greatest("a", "b")
    return pairs.where("a <> b").select(least.alias("a"), most.alias("b")).distinct()


def _linked(docs: DataFrame, shingle: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """A row for each document with its node, and every node with its component's label."""
    join = _Join(docs, shingle, similarity)
    pairs = store(join.first_members(join.least_groups()), "join-pairs")
    links = join.verified(pairs)
    labelled = join.labelled(links)
    met = join.first_members(join.representatives(join.open_groups(labelled)))
    more = store(met.join(pairs, ["a", "b"], "left_anti"), "join-pairs")
    links = links.unionByName(join.verified(more))
    labelled = join.labelled(links)
    checked = pairs.unionByName(more)
    open_ = join.open_groups(labelled)
    rest = join.all_members(join.all_groups(open_, labelled), labelled).join(checked, ["a", "b"], "left_anti")
    rest = store(rest, "join-pairs")
    found = join.verified(rest)
    if not found.isEmpty():
        labelled = join.labelled(links.unionByName(found))
    return join.rows, labelled


def link_documents(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    ``n_shingles`` is the size of the document's set; a text of fewer words than
    a shingle is one shingle.  ``component_id`` is the smallest ``doc_id`` that
    links lead to, the document's own included.  A null or empty text, or one
    of blanks, has no shingle and no link.  Copies, rows of the same id among
    them, are linked; if no document of a component has an id, neither has it.
    """
    rows, labelled = _linked(docs, shingle, similarity)
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = labelled.join(least, "label").select("node", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))

    def shown(c: Column) -> Column:
        return F.nullif(c, F.lit(NO_ID))

    return rows.join(of_node, "node", "left").select(
        shown(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
        shown(component).alias("component_id"),
    )


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` without near duplicates: of linked documents the one with the smallest id stays.

    Rows without an id stay if no linked document has one.  Of rows that share
    id and shingles one stays.  Documents without a shingle all stay.
    """
    _, labelled = _linked(docs, shingle, similarity)
    first = F.min(F.struct(F.col("doc_id").alias("_order"), F.col("node").alias("_node")))
    least = labelled.groupBy("label").agg(first.alias("m"))
    firsts = least.select("m._order", "m._node", F.lit(True).alias("_first"))
    added = ("_n", "_node", "_order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches):
            sets = shingle_sets(texts, shingle)
            n, nodes = pa.array([len(v) for v in sets], pa.int64()), pa.array([_signature(v) for v in sets], pa.int64())
            yield rows.append_column("_n", n).append_column("_node", nodes)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _n long, _node long"
    tagged = docs.mapInArrow(lean_map(run), schema).withColumn("_order", _order())
    again = F.row_number().over(Window.partitionBy("_order", "_node").orderBy("_n"))
    joined = tagged.join(firsts, ["_order", "_node"], "left").withColumn("_again", again)
    stays = (F.col("_n") == 0) | (F.col("_first") & (F.col("_again") == 1))
    return joined.where(stays).drop(*added, "_first", "_again")
